"""The movement view: one row per shipment line, with its dimensions looked up.

Every lookup is a left join on a unique key, so it adds columns and never changes
the rows; a caller names the columns it reads and only their lookups are joined.
No side is hinted: the nation table is 25 rows, the others grow with the data, and
adaptive execution broadcasts a side only after measuring it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.dates import year_month

# Order status to operation type.
OPERATIONS = {"P": "importacao", "F": "exportacao", "O": "cabotagem"}

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "data_embarque", "ano", "mes", "ano_mes",
        "qtd_container", "receita")
ORDER = ("tipo_operacao", "data_pedido", "o_custkey")
CLIENT = ("cliente", "consignatario")
CLIENT_NATION = ("porto_descarga",)
CARRIER = ("armador", "exportador")
CARRIER_NATION = ("porto_embarque",)
PART = ("c20", "c40", "teus", "tipo_carga", "produto")
ALL = LINE + ORDER + CLIENT + CLIENT_NATION + CARRIER + CARRIER_NATION + PART


LINE_SIDE = LINE + CARRIER + CARRIER_NATION + PART
ORDER_SIDE = ("o_orderkey", *ORDER, *CLIENT, *CLIENT_NATION)

# A folder that begins so names a star stored in the catalog (`plans.star`).
STORED = "catalog:"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name, from a folder of Parquet tables or from a stored star."""
    if folder.startswith(STORED):
        return spark.table(f"{folder.removeprefix(STORED)}_{name}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def operation_of(status: Column) -> Column:
    result = F.lit(None).cast("string")
    for code, label in OPERATIONS.items():
        result = F.when(status == code, label).otherwise(result)
    return result


def _nation(spark: SparkSession, folder: str, port: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_nationkey"), F.col("n_name").alias(port))


def movements(
    spark: SparkSession, folder: str, *columns: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Movement rows with the named columns (all of them when none is named).

    ``start`` (inclusive) and ``end`` (exclusive) bound the loading date on the raw
    column, so the bound reaches the Parquet scan.
    """
    wanted = set(columns or ALL)
    unknown = wanted - set(ALL)
    if unknown:
        raise ValueError(f"unknown movement columns: {sorted(unknown)}")

    if folder.startswith(STORED):
        lines, orders = _stored_sides(spark, folder, start, end)
    else:
        lines, orders = _line_side(spark, folder, wanted, start, end), _order_side(spark, folder, wanted)
    if wanted & set(ORDER_SIDE):
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    return lines.select(*(columns or ALL))


def _stored_sides(spark: SparkSession, folder: str, start: str | None, end: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a stored star; they lie in equal buckets of the order key, so their join moves no rows."""
    lines = table(spark, folder, "linhas")
    if start:
        lines = lines.where(F.col("data_embarque") >= F.lit(start).cast("date"))
    if end:
        lines = lines.where(F.col("data_embarque") < F.lit(end).cast("date"))
    return lines, table(spark, folder, "pedidos")


def with_period(day: Column) -> list[Column]:
    """The loading date and its year, month and both as a number."""
    return [day.alias("data_embarque"), F.year(day).alias("ano"), F.month(day).alias("mes"), year_month(day).alias("ano_mes")]


def with_boxes(lines: DataFrame) -> DataFrame:
    """Lines with their containers by size, from whether the part is `small`."""
    return lines.withColumns({
        "c20": F.when(F.col("small"), F.col("qtd_container")).otherwise(0.0),
        "c40": F.when(F.col("small"), 0.0).otherwise(F.col("qtd_container")),
    }).withColumn("teus", F.col("c20") + 2 * F.col("c40"))


def _line_side(spark: SparkSession, folder: str, wanted: set[str], start: str | None, end: str | None) -> DataFrame:
    """Lines with what hangs on them: part, carrier and the carrier's port."""
    lines = table(spark, folder, "lineitem")
    if start:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        lines = lines.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    lines = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *with_period(F.col("l_shipdate").cast("date")),
        F.col("l_quantity").alias("qtd_container"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("receita"),
    )

    if wanted & set(PART):
        small = F.col("p_size") <= 25
        parts = table(spark, folder, "part").select(
            F.col("p_partkey"), small.alias("small"),
            F.col("p_type").alias("tipo_carga"), F.col("p_name").alias("produto"),
        )
        lines = with_boxes(lines.join(parts, lines.l_partkey == parts.p_partkey, "left"))

    if wanted & set(CARRIER + CARRIER_NATION):
        carriers = table(spark, folder, "supplier").select(
            "s_suppkey", "s_nationkey", F.col("s_name").alias("armador"), F.col("s_name").alias("exportador"),
        )
        if wanted & set(CARRIER_NATION):
            ports = _nation(spark, folder, "porto_embarque")
            carriers = carriers.join(ports, carriers.s_nationkey == ports.n_nationkey, "left")
        lines = lines.join(carriers, lines.l_suppkey == carriers.s_suppkey, "left")
    return lines


def _order_side(spark: SparkSession, folder: str, wanted: set[str]) -> DataFrame:
    """Orders with their client and the client's port, so the line table moves once for all of it."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", operation_of(F.col("o_orderstatus")).alias("tipo_operacao"),
        F.col("o_orderdate").cast("date").alias("data_pedido"),
    )
    if wanted & set(CLIENT + CLIENT_NATION):
        clients = table(spark, folder, "customer").select(
            "c_custkey", "c_nationkey", F.col("c_name").alias("cliente"), F.col("c_name").alias("consignatario"),
        )
        if wanted & set(CLIENT_NATION):
            ports = _nation(spark, folder, "porto_descarga")
            clients = clients.join(ports, clients.c_nationkey == ports.n_nationkey, "left")
        orders = orders.join(clients, orders.o_custkey == clients.c_custkey, "left")
    return orders


# The same view for the DuckDB side of the checks.
MOVEMENTS_SQL = """m AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
         CAST(l.l_shipdate AS DATE) AS data_embarque,
         CAST(year(l.l_shipdate) AS INTEGER) AS ano, CAST(month(l.l_shipdate) AS INTEGER) AS mes,
         CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS INTEGER) AS ano_mes,
         l.l_quantity AS qtd_container, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS receita,
         CASE o.o_orderstatus WHEN 'P' THEN 'importacao' WHEN 'F' THEN 'exportacao' WHEN 'O' THEN 'cabotagem' END AS tipo_operacao,
         CAST(o.o_orderdate AS DATE) AS data_pedido, o.o_custkey,
         c.c_name AS cliente, c.c_name AS consignatario, nc.n_name AS porto_descarga,
         s.s_name AS armador, s.s_name AS exportador, ns.n_name AS porto_embarque,
         CASE WHEN p.p_size <= 25 THEN l.l_quantity ELSE 0.0 END AS c20,
         CASE WHEN p.p_size <= 25 THEN 0.0 ELSE l.l_quantity END AS c40,
         CASE WHEN p.p_size <= 25 THEN l.l_quantity ELSE 2 * l.l_quantity END AS teus,
         p.p_type AS tipo_carga, p.p_name AS produto
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation nc ON c.c_nationkey = nc.n_nationkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation ns ON s.s_nationkey = ns.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""
