"""Approximate vector search: cells around centroids, of which a query looks into the nearest few.

Centroids are fitted on a bounded sample, every vector is filed under its nearest one, and a query
meets the vectors of its `probes` nearest cells, exactly. A cell of any size is searched in parts
(`search.tile_search`), so nothing is capped. What is lost are neighbours in cells not looked into;
`recall` measures it against the exact search. With as many probes as cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators.search import tile_search, usable_vector

# Vectors that centroids are fitted on at most.
SAMPLE = 20_000


def fit(vectors: DataFrame, cells: int, rounds: int = 0, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids as rows: the vectors whose keys have the smallest MD5, then `rounds` rounds of k-means over the sample.

    The sample (at most `sample` vectors, or `cells` if more) is what reaches the driver. Vectors of
    another length than most of it are left out; fewer usable vectors than cells give fewer cells.
    """
    known = vectors.where(usable_vector(F.col(vector))).select(F.md5(F.col(key).cast("string")).alias("m"), F.col(vector).cast("array<double>").alias("v"))
    rows = [r["v"] for r in known.orderBy("m", "v").limit(max(sample, cells) if rounds else cells).collect()]
    if not rows:
        return np.zeros((0, 0))
    lengths = [len(r) for r in rows]
    usual = max(set(lengths), key=lambda n: (lengths.count(n), n))
    points = np.array([r for r in rows if len(r) == usual])
    centres = points[:cells].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres, 1)[:, 0]
        for c in range(len(centres)):
            if (mine := points[nearest == c]).size:
                centres[c] = mine.mean(axis=0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, by difference; the lower number among equals."""
    out = np.empty((len(rows), n), np.int32)
    step = max(1, (1 << 22) // max(centres.size, 1))
    for lo in range(0, len(rows), step):
        gaps = ((rows[lo:lo + step, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        out[lo:lo + step] = np.argsort(gaps, axis=1, kind="stable")[:, :n]
    return out


def assign(rows: DataFrame, centres: np.ndarray, n: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(chave, vetor, celula) of each usable row of the centres' length, once for each of its n nearest cells."""
    n, size = min(n, len(centres)), centres.shape[1]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, vector)}
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)
            each = pa.array(np.repeat(np.arange(len(points)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), pa.array(_nearest(points, sent.value, n).ravel())], names=["chave", "vetor", "celula"])

    usable = rows.where(usable_vector(F.col(vector)) & (F.size(vector) == size)).select(F.col(key).alias("chave"), F.col(vector).alias("vetor"))
    return usable.mapInArrow(work, f"chave {kinds[key]}, vetor {kinds[vector]}, celula int")


def build_index(vectors: DataFrame, centres: np.ndarray, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """File every usable vector under its cell; a probe reads the folders of its cells alone."""
    filed = assign(vectors, centres, 1, key, vector)
    filed.hint("rebalance", "celula").write.partitionBy("celula").parquet(path)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, probes: int, k: int = 5, metric: str = "l2",
           key: str = "vec_id", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """Best k per query among the vectors (chave, vetor, celula) of its `probes` nearest cells."""
    asked = assign(queries, centres, probes, query_key, query).withColumnRenamed("chave", "nome")
    return tile_search(index.select("celula", "chave", "vetor"), asked, k, metric, key, query_key)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", query_key: str = "query_id") -> DataFrame:
    """How many of the exact hits were found: (acertos, total, recall)."""
    both = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("achado")), [query_key, key], "left")
    return both.agg(F.count("achado").alias("acertos"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.try_divide("acertos", "total"))
