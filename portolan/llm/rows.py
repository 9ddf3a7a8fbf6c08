"""Taking rows out of a table by id and text, whatever other columns it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import BITMAP_BITS, written


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as a struct, beside its id and a hash of its text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"].cast("string")).alias("tk"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (doc_id, tk) is not among the keys; a null id matches a null id.

    A bitmap of the keys, at most 1 MB whatever their number, lets rows that surely are not among
    them pass where they lie; only the others, with their texts, are shuffled for the exact join.
    """
    gone, here, marked = _marked(docs, keys)
    clear = here.where(~marked).select("row.*")
    rest = here.where(marked)
    kept = rest.join(gone, _same_key(rest, gone), "left_anti")
    return clear.unionByName(kept.select("row.*"))


def one_per_key(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of each (doc_id, tk) among the keys; a null id matches a null id. Repeats are dropped before the shuffle."""
    wanted, here, marked = _marked(docs, keys)
    once = here.where(marked).groupBy("id", "tk").agg(F.first("row").alias("row"))
    return once.join(wanted, _same_key(once, wanted), "left_semi").select("row.*")


def _marked(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """The distinct keys as (key_id, key_tk), the keyed rows, and whether a row may be among the keys, by a bitmap of them."""
    known = written(keys.select(F.col("doc_id").cast("long").alias("key_id"), F.col("tk").alias("key_tk")).distinct(), "keys")
    marks = known.select(_slot("key_id", "key_tk").alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(F.expr("bitmap_construct_agg(slot & 32767)").alias("bits"))
    bits = marks.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits")))).scalar()  # 256 parts of 4 kB at most
    here = keyed(docs).withColumn("slot", _slot("id", "tk"))
    part = F.try_element_at(bits, F.shiftright("slot", 15))
    value = F.conv(F.hex(F.substr(part, F.shiftright(F.col("slot").bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return known, here, F.coalesce(F.floor(value / F.pow(F.lit(2), F.col("slot").bitwiseAND(F.lit(7)))) % 2 == 1, F.lit(False))


def _same_key(rows: DataFrame, keys: DataFrame) -> Column:
    return rows["id"].eqNullSafe(keys["key_id"]) & (rows["tk"] == keys["key_tk"])


def _slot(doc_id: str, tk: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, tk), 64 - BITMAP_BITS)
