"""Benchmark decontamination by winnowing.

Of every `span` consecutive words the smallest hash among its runs of `k` words is kept, for
documents and benchmark items alike, so any shared run of `span` words shares a kept hash. Kept
hashes are joined, then each hit is extended word by word to both sides; runs of `span` words or
more are hits. An item shorter than `span` words is looked for as a whole.

Before the join, a bitmap of fixed size drops document hashes that no item has; when the
benchmark outgrows it, more hashes go into the join and the result stays the same.

Defined results: a null text has no words; items without words are left out; items with equal
ids count once; items without an id count as hits but are not named in item_ids; documents with
the same words are examined once and each row gets the result;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import PLAIN_WORDS, bitmap_test, grams, key_bitmap, mix, text_steps, words_of, written
from portolan.llm.rows import without

SPAN, K = 10, 5

PRINT = "struct<fp: long, pos: int, size: int, lefts: array<long>, gram: array<long>, rights: array<long>>"
_WORDS = pa.list_(pa.int64())
_PRINT = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("lefts", _WORDS), ("gram", _WORDS), ("rights", _WORDS)])


def chosen(hashes: np.ndarray, owner: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept runs of k words, and their hashes."""
    keys = grams(hashes, k)
    if len(hashes) < span:
        return np.zeros(0, np.int64), keys[:0]
    inside = np.flatnonzero(owner[:len(hashes) - span + 1] == owner[span - 1:])
    lowest = np.lib.stride_tricks.sliding_window_view(keys, span - k + 1)[inside].argmin(axis=1) + inside
    at = lowest[np.concatenate([[True], lowest[1:] != lowest[:-1]])] if len(lowest) else lowest
    return at, keys[at]


def whole_runs(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of a short item's length, and its hash."""
    keys = grams(hashes, size)
    inside = np.flatnonzero(owner[:len(keys)] == owner[size - 1:]) if len(keys) else np.zeros(0, np.int64)
    return inside, mix(keys[inside] ^ np.uint64(0x5851F42D4C957F2D))


def _lists(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, back: bool) -> pa.ListArray:
    """hashes[lo:hi] of each print, nearest first when they stand before it."""
    sizes = hi - lo
    ends = np.concatenate([[0], np.cumsum(sizes)])
    steps = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
    at = np.repeat(hi, sizes) - 1 - steps if back else np.repeat(lo, sizes) + steps
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[at].view(np.int64)))


def prints(texts: DataFrame, span: int, k: int, lengths: Sequence[int] | None, wanted: bytes | None) -> DataFrame:
    """(id, tk, n_words, digest of the words, kept runs) of each text.

    texts: columns id, tk, text. lengths: the lengths of short items to look for, or None to take
    a short text as an item. wanted: a key bitmap, or None to give every kept run.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = bitmap_test(wanted) if wanted else None
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                _, _, hashes, first = words_of(data, offsets, PLAIN_WORDS)
                counts = np.diff(first)
                owner = np.repeat(np.arange(hi - lo), counts)
                found = [(*chosen(hashes, owner, span, k), k, span)]
                if lengths is None:
                    short = np.flatnonzero((counts > 0) & (counts < span))
                    for size in np.unique(counts[short]):
                        at = first[short[counts[short] == size]]
                        runs, keys = whole_runs(hashes, owner, int(size))
                        found.append((at, keys[np.searchsorted(runs, at)], int(size), int(size)))
                else:
                    found += [(*whole_runs(hashes, owner, size), size, size) for size in lengths]
                if test:
                    found = [(at[hit], keys[hit], width, size) for at, keys, width, size in found for hit in [test(keys)]]
                at = np.concatenate([x[0] for x in found]).astype(np.int64)
                keys = np.concatenate([x[1] for x in found])
                width = np.concatenate([np.full(len(x[0]), x[2]) for x in found]).astype(np.int64)
                size = np.concatenate([np.full(len(x[0]), x[3]) for x in found]).astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, keys, width, size = at[order], keys[order], width[order], size[order]
                of = owner[at]
                begin, end = first[of], first[of + 1]
                around = np.where(size == width, 0, size - width)
                rows = pa.StructArray.from_arrays([
                    pa.array(keys.view(np.int64)), pa.array(at - begin, pa.int32()), pa.array(size, pa.int32()),
                    _lists(hashes, np.maximum(begin, at - around), at, True), _lists(hashes, at, at + width, False),
                    _lists(hashes, at + width, np.minimum(end, at + width + around), False)], fields=list(_PRINT))
                ends = np.searchsorted(of, np.arange(hi - lo + 1))
                digests = [hashlib.blake2b(hashes[first[d]:first[d + 1]].tobytes(), digest_size=16).digest() if ends[d] < ends[d + 1] else None for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)],
                    names=["id", "tk", "n_words", "digest", "prints"])

    return texts.mapInArrow(work, f"id long, tk long, n_words long, digest binary, prints array<{PRINT}>")


def text_key(docs: DataFrame) -> Column:
    """With the id, what a row is found again by."""
    return F.xxhash64(docs["text"].cast("string"))


def _keyed(table: DataFrame, name: str) -> DataFrame:
    return table.select(table[name].cast("long").alias("id"), text_key(table).alias("tk"), table["text"].cast("string").alias("text"))


def _same_ahead(a: str, b: str) -> Column:
    """How many words agree from the start of two lists."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(equal, F.lit(False))
    return F.when(at == 0, F.size(equal)).otherwise(at - 1).cast("int")


def hit_runs(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, runs, members): rows (id, tk, n_words, digest); runs (digest, start, end, class) in words; members (class, item_id).

    Items that hold the same words around a kept hash meet texts as one, and items that always come
    together are one class, so a passage that many items share meets a text once for each hash.
    """
    items = written(prints(_keyed(benchmark, "item_id"), span, k, None, None).select("id", F.explode("prints").alias("p")).select("id", "p.fp", "p.size", "p.gram", "p.lefts", "p.rights").distinct(), "item-prints")
    lengths = sorted(r[0] for r in items.where(F.col("size") < span).select("size").distinct().collect())
    rows = written(prints(_keyed(docs, "doc_id"), span, k, lengths, key_bitmap(items, "fp")), "prints")
    once = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first("prints").alias("prints"))
    mine = once.select("digest", F.explode("prints").alias("p")).select("digest", "p.*")
    # A class is told by 128 bits of its items, whatever their order.
    words = ["fp", "size", "gram", "lefts", "rights"]
    name = F.struct(F.expr("bit_xor(xxhash64(1, id))").alias("x"), F.expr("bit_xor(xxhash64(2, id))").alias("y"), F.count(F.lit(1)).alias("n"))
    theirs = written(items.groupBy(*words).agg(name.alias("class")), "item-classes")
    members = items.join(theirs, words).select("class", F.col("id").alias("item_id")).distinct()
    met = mine.join(theirs.select("fp", "size", F.col("gram").alias("gram_"), F.col("lefts").alias("lefts_"), F.col("rights").alias("rights_"), "class"), ["fp", "size"]).where(F.col("gram") == F.col("gram_"))
    grown = met.select("digest", "class", "size", "pos", F.size("gram").alias("n"), _same_ahead("lefts", "lefts_").alias("l"), _same_ahead("rights", "rights_").alias("r"))
    runs = grown.where(F.col("l") + F.col("n") + F.col("r") >= F.col("size"))
    return rows.drop("prints"), runs.select("digest", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("n") + F.col("r")).alias("end"), "class"), members


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """For each row: doc_id, tk, n_words, n_hit, spans of hit words, item_ids (sorted as text), contaminated."""
    rows, runs, members = hit_runs(docs, benchmark, span, k)
    runs = written(runs.distinct(), "runs")
    held = runs.select("digest", "class").distinct().join(members, "class").groupBy("digest").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = runs.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs")).join(held, "digest")
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate("runs", start, lambda a, x: F.struct(
        F.greatest(a["upto"], x["end"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n")), lambda a: a["n"])
    found = found.select("digest", "runs", "item_ids", n_hit.alias("n_hit"))
    # Rows without a kept run have no digest: they pass by the join, or its missing keys would meet in one task.
    met = rows.where(F.col("digest").isNotNull()).join(found, "digest", "left").select("id", "tk", "n_words", "runs", "item_ids", "n_hit")
    unmet = rows.where(F.col("digest").isNull()).select("id", "tk", "n_words", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("runs", "item_ids", "n_hit")])
    return met.union(unmet).select(
        F.col("id").alias("doc_id"), "tk", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "runs",
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """The rows that share no run with an item, with their own columns."""
    return without(docs, contamination(docs, benchmark, span, k).where("contaminated").select("doc_id", "tk"))
