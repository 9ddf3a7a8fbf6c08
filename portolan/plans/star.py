"""The movement view stored as a star whose two large tables need no shuffle to be joined.

Lines with their lookups and orders with theirs are written in equal numbers of buckets of the order
key, sorted by it. A reader names the star in place of a folder (`catalog:<name>`): every query over
movements then runs on it. Buckets suit joins that are run often; a single query is better off with
the folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.plans.movements import LINE_SIDE, ORDER_SIDE, STORED, _line_side, _order_side, table, with_boxes, with_period

# Tables that are entered as they lie.
OTHERS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


# What moves to the buckets; the other columns of a side follow from these, in the task that writes them.
LINE_MOVED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "data_embarque", "qtd_container", "receita", "small", "armador", "porto_embarque", "tipo_carga", "produto")
ORDER_MOVED = ("o_orderkey", "tipo_operacao", "data_pedido", "o_custkey", "cliente", "porto_descarga")

# Lines in a bucket: a task sorts one bucket, which has to fit its memory.
BUCKET_LINES = 1_000_000


def buckets_for(spark: SparkSession, folder: str, least: int) -> int:
    """Buckets that keep the lines of each to a million or so."""
    return max(least, math.ceil(table(spark, folder, "lineitem").count() / BUCKET_LINES))


def store(spark: SparkSession, folder: str, path: str, name: str, buckets: int) -> str:
    """Write both sides under a path, enter them in the catalog under a name, and return what readers use for a folder.

    One task writes one bucket, so a bucket is one file and its order holds over all of it.
    """
    lines = _line_side(spark, folder, set(LINE_SIDE), None, None).select(*LINE_MOVED).repartition(buckets, "l_orderkey")
    lines = with_boxes(lines.select(*[c for c in LINE_MOVED if c != "data_embarque"], *with_period(F.col("data_embarque")), F.col("armador").alias("exportador")))
    orders = _order_side(spark, folder, set(ORDER_SIDE)).select(*ORDER_MOVED).repartition(buckets, "o_orderkey")
    _write(lines.select(*LINE_SIDE), "l_orderkey", f"{path}/linhas", f"{name}_linhas", buckets)
    _write(orders.withColumn("consignatario", F.col("cliente")).select(*ORDER_SIDE), "o_orderkey", f"{path}/pedidos", f"{name}_pedidos", buckets)
    for other in OTHERS:
        spark.catalog.createTable(f"{name}_{other}", path=f"{folder}/{other}.parquet", source="parquet")
    return STORED + name


def _write(rows: DataFrame, key: str, path: str, name: str, buckets: int) -> None:
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").format("parquet").saveAsTable(name)


def drop(spark: SparkSession, name: str) -> None:
    """Take a star out of the catalog; its files stay."""
    for side in ("linhas", "pedidos", *OTHERS):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{side}")
