"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by cell: source, language and topic. The cell weights are raked until
their sums over each dimension meet that dimension's targets, then every document is drawn with
the probability that its cell's weight calls for. The table of cells stays a DataFrame, so many
sources are no matter; a draw depends only on the row, so a rerun draws the same rows.

Topics stand for any further dimension that a corpus is balanced by; the tables have no column for
one, so `TOPICS` tags texts by patterns. Give other patterns, or a target for `topic`, as arguments.

Defined results: a null text has no tokens; null dimension values are a value of their own and stay null;
repeated rows get the same draw; cells without tokens get probability 1 (nothing to weigh); an
empty table gives no rows. Dimension values without a target share what the named targets leave,
in proportion to their tokens.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import written
from portolan.llm.rows import keyed

DIMENSIONS = ("source", "lang", "topic")
#: Topic by the first pattern that occurs; `general` without one.
TOPICS = {"markup": r"[#*$%&|<>]{2}", "records": r"[0-9]{3}", "exclaimed": r"!!", "questions": r"\?"}
#: Default targets: shares of tokens raised to these powers and scaled to 1; below 1 they lift small values.
FLATTEN = {"source": 0.9, "lang": 0.9, "topic": 1.0}
MISSING = "\u0000null"


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(list(topics.items())):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words between blanks."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, r"[ \t\n\x0B\f\r]+")) - F.when(t.rlike(r"^[ \t\n\x0B\f\r]"), 1).otherwise(0) - F.when(t.rlike(r"[ \t\n\x0B\f\r]\z"), 1).otherwise(0)
    return F.when(t == "", 0).otherwise(pieces).cast("long")


def cell_rows(docs: DataFrame, topics: Mapping[str, str] = TOPICS, seed: int = 0) -> DataFrame:
    """Each row as a struct with its id, cell, tokens and its draw from [0, 1)."""
    here = keyed(docs)
    text = F.col("row.text").cast("string")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "tk"), 11).cast("double") / F.lit(float(1 << 53))
    return here.select(
        "row", "id", F.coalesce(F.col("row.source").cast("string"), F.lit(MISSING)).alias("source"),
        F.coalesce(F.col("row.lang").cast("string"), F.lit(MISSING)).alias("lang"), topic_of(text, topics).alias("topic"),
        token_count(text).alias("tokens"), draw.alias("draw"))


def targets_of(cells: DataFrame, dimension: str, named: Mapping[str, float] | None = None, flatten: float = 1.0) -> DataFrame:
    """(value, target): shares that sum to 1 over the values present."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t"))
    if named:
        given = F.coalesce(reduce(lambda a, kv: a.when(F.col(dimension) == kv[0], F.lit(float(kv[1]))), named.items(), F.when(F.lit(False), F.lit(0.0))), F.lit(None).cast("double"))
        sums = sums.withColumn("given", given)
        rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum("given"), F.lit(0.0))).alias("rest")
        left = sums.agg(F.struct(rest, F.sum(F.when(F.col("given").isNull(), F.col("t"))).alias("others"))).scalar()
        raw = sums.select(dimension, F.coalesce("given", F.col("t") / left["others"] * left["rest"]).alias("raw"))
    else:
        raw = sums.select(dimension, F.pow("t", F.lit(flatten)).alias("raw"))
    return raw.select(dimension, (F.col("raw") / raw.agg(F.sum("raw")).scalar()).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-6, most: int = 60, between: int = 5) -> DataFrame:
    """Add `weight` to the cells: sums over each dimension meet its targets within the tolerance.

    Rounds go on until the largest gap of any marginal is small, or `most` are done (marginals that
    contradict each other never meet). The table is written every few rounds to keep the plan short.
    Cells are sums, one row per combination of values however many documents there are.
    """
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d, target in targets.items():
        now = now.join(target.select(d, F.col("target").alias(f"target_{d}")), d)
    now, done = written(now, "rake"), 0
    while done < most:
        for _ in range(between):
            for d in targets:
                now = now.withColumn("weight", F.col("weight") * F.col(f"target_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        done += between
        now = written(now, "rake")
        gaps = [now.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"target_{d}")).alias("gap")).agg(F.max("gap")) for d in targets]
        if max(r[0] or 0.0 for r in reduce(DataFrame.union, gaps).collect()) < tolerance:
            break
    return now.select(*targets, "tokens", "weight")


def chances(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, flatten: Mapping[str, float] = FLATTEN, budget: float | None = None) -> DataFrame:
    """(source, lang, topic, weight, probability) of each cell of the rows that have tokens.

    weight: the share of all tokens wanted in the cell. budget: tokens wanted in all; by default as
    many as can be had without taking a document twice, so the scarcest cell is taken whole. Under a
    larger budget, cells that run out are taken whole.
    """
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, {d: targets_of(cells.where("tokens > 0"), d, (targets or {}).get(d), flatten.get(d, 1.0)) for d in DIMENSIONS})
    rate = F.col("weight") / F.col("tokens")
    top = raked.agg(F.max(rate)).first()[0] if budget is None else 1.0 / budget
    return written(raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), rate / F.lit(top or 1.0)).alias("probability")), "chances")


def drawn(rows: DataFrame, chance: DataFrame) -> DataFrame:
    """Rows with the weight and probability of their cell, and `sampled`."""
    met = rows.join(chance, list(DIMENSIONS), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return met.withColumn("sampled", F.col("draw") < F.col("probability"))


def calibrated(docs: DataFrame, topics: Mapping[str, str] = TOPICS, seed: int = 0, **options) -> DataFrame:
    """For each row: id, cell, tokens, weight, probability, draw, sampled; texts are read once."""
    rows = written(cell_rows(docs, topics, seed).drop("row"), "cell-rows")
    found = drawn(rows, chances(rows, **options))
    return found.withColumns({c: F.nullif(F.col(c), F.lit(MISSING)) for c in ("source", "lang")})


def sampled_rows(docs: DataFrame, topics: Mapping[str, str] = TOPICS, seed: int = 0, **options) -> DataFrame:
    """The rows drawn, with their own columns; texts are read twice and never shuffled by this step."""
    rows = cell_rows(docs, topics, seed)
    return drawn(rows, chances(rows.drop("row"), **options)).where("sampled").select("row.*")
