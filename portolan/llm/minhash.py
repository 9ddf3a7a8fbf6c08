"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two fixed permutations of a universe of 2**20 places: the first scatters the elements, the second,
shifted circularly by k, gives signature coordinate k. Signatures are cut into bands; texts that
share a band value are candidates; a link counts only after the full shingle sets are compared.

Texts with the same words in the same order form one class and are compared once. Inside a band
value, texts are first compared with one hub, which joins most of a large group of near copies;
what still bears different labels is compared in blocks that give a forest of labels, fewer edges
than labels. Blocks are compared in two phases: first the largest band value of every text, then
whatever other band values still hold different labels after the first phase's links. So every two
texts of one band value end up either compared or connected, and no step emits all pairs. All tables
between the steps are written to the shared folder; links, components and sets never reach the driver.

Defined results: a text without words (null, empty, blank) has no shingles and no links; fewer
words than a shingle make one shingle of the whole text; rows without an id take part, and their
component is the smallest id that they reach, or null. Groups are told apart by their texts, so
different texts under one id, or without an id, stay different.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import BLANK_WORDS, bitmap_test, grams, key_bitmap, mix, text_steps, words_of, written
from portolan.llm.rows import keyed, one_per_key, without

UNIVERSE_BITS = 20
#: At a similarity of 0.8 a link is missed by every band with a chance of 5e-7.
BANDS, ROWS = 48, 6
#: Elements whose coordinates are held at once.
BLOCK = 4096
#: Shingles in one part of a band value, and cells of one block of columns, when sets are compared in full.
COMPARED_SHINGLES = 1 << 21
COMPARED_CELLS = 1 << 22

ROW_SCHEMA = "doc_id long, tk long, n_shingles long, digest binary, bands array<long>"
SET_SCHEMA = "digest binary, shingles array<long>"


@cache
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifted one as a row of windows that wraps around."""
    size = 1 << UNIVERSE_BITS
    first = np.random.default_rng(1).permutation(size).astype(np.uint32)
    second = np.random.default_rng(2).permutation(size).astype(np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates - 1]]), coordinates)
    return first, windows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a step.

    Gives (sorted shingle hashes by document, first one of each document with the total last,
    word hashes, first word of each document with the total last). Hashes keep 54 bits.
    """
    _, _, hashes, first = words_of(data, offsets, BLANK_WORDS)
    docs = len(offsets) - 1
    counts = np.diff(first)
    keys, owner = grams(hashes, size), np.repeat(np.arange(docs), counts)
    inside = owner[:len(keys)] == owner[size - 1:] if len(keys) else np.zeros(0, bool)
    keys, of = keys[inside], owner[:len(inside)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.concatenate([grams(hashes[first[d]:first[d + 1]], int(counts[d])) for d in short])
        keys, of = np.concatenate([keys, whole]), np.concatenate([of, short])
    packed = np.sort(of.astype(np.uint64) << np.uint64(54) | keys >> np.uint64(10))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    starts = np.searchsorted(packed >> np.uint64(54), np.arange(docs + 1, dtype=np.uint64))
    return packed & np.uint64((1 << 54) - 1), starts, hashes, first


def signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash coordinates, one row per document; empty sets keep the largest value."""
    scatter, windows = permutations(coordinates)
    places = scatter[(mix(shingles) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = np.full((len(starts) - 1, coordinates), np.uint32(0xFFFFFFFF))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for lo in range(0, len(places), BLOCK):
        of = owner[lo:lo + BLOCK]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        lowest = np.minimum.reduceat(windows[places[lo:lo + BLOCK]], heads, axis=0)
        out[of[heads]] = np.minimum(out[of[heads]], lowest)
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per document and band; the band's number is part of it."""
    parts = coordinates.reshape(len(coordinates), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        keys = mix(keys * np.uint64(0xD1342543DE82EF95) + parts[:, :, k])
    return keys


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _digest_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def signed_rows(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: the id, the size of its set, the digest of its words and its band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(2)):
                shingles, starts, hashes, first = shingle_sets(data, offsets, size)
                keys = band_keys(signatures(shingles, starts, bands * rows), bands)
                counts = np.diff(starts)
                full = counts > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]), pa.int32()), pa.array(keys[full].view(np.int64).reshape(-1)))
                digests = [_digest(hashes[first[d]:first[d + 1]]) if full[d] else None for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists],
                    names=["doc_id", "tk", "n_shingles", "digest", "bands"])

    return keyed(docs).select(F.col("id").alias("doc_id"), "tk", F.col("row.text").cast("string").alias("text")).mapInArrow(work, ROW_SCHEMA)


def full_sets(docs: DataFrame, size: int, wanted: bytes) -> DataFrame:
    """The whole shingle sets of texts whose digest may be wanted (by a key bitmap); a task gives copies once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, seen = bitmap_test(wanted), set()
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(0)):
                shingles, starts, hashes, first = shingle_sets(data, offsets, size)
                found = {_digest(hashes[first[d]:first[d + 1]]): d for d in range(hi - lo) if starts[d] < starts[d + 1]}
                found = [(x, d) for x, d in found.items() if x not in seen]
                if not found:
                    continue
                hit = test(np.array([_digest_key(x) for x, _ in found], np.int64).view(np.uint64))
                found = [x for x, yes in zip(found, hit) if yes]
                if found:
                    seen.update(x for x, _ in found)
                    parts = [shingles[starts[d]:starts[d + 1]] for _, d in found]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), lists], names=["digest", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(work, SET_SCHEMA)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each one reaches, by alternating large and small stars.

    edges: columns a and b (long). Hub rows are spread by joins on the node that Spark can split.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.union(lowest.where("a <> m")).distinct(), "edges")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = written(small.union(lowest).distinct(), "edges")
        if pairs.count() == small.count() and pairs.join(small, ["a", "b"], "left_anti").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("label"))
        pairs = small


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose sets share at least `similarity` hundredths of their union."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(
        (100 * F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))))
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return shared.where(100 * F.col("shared") >= similarity * (F.col("total") - F.col("shared"))).select("a", "b")


def _joined(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Group numbers of labels (the smallest member's) after joining the groups `of` along pairs a, b of label numbers."""
    while True:
        lowest = np.minimum(of[a], of[b])
        before = of.copy()
        np.minimum.at(of, of[a], lowest)
        np.minimum.at(of, of[b], lowest)
        of = of[of]
        if (of == before).all():
            return of


def _label_links(bucket_rows: pa.Table, similarity: int) -> pa.Table:
    """A forest of the labels that links join, among the sets of one band value: fewer edges than labels.

    Only sets outside the commonest label are held against all others, and only until they have joined
    its group. Shingles that occur once add nothing to an intersection; the rest become columns of 0
    and 1, a block at a time.
    """
    names, label = np.unique(bucket_rows.column("label").to_numpy(), return_inverse=True)
    lists = bucket_rows.column("shingles").combine_chunks()
    values, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    commonest = int(np.bincount(label).argmax())
    of = np.arange(len(names))
    rest = np.flatnonzero(label != commonest)
    if len(rest):
        row = np.repeat(np.arange(len(label)), sizes)
        tokens, code, uses = np.unique(values, return_inverse=True, return_counts=True)
        number = np.cumsum(uses > 1) - 1
        shared = uses[code] > 1
        row, code = row[shared], number[code[shared]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        columns = max(64, COMPARED_CELLS // len(label))
        for lo in range(0, len(rest), columns):
            part = rest[lo:lo + columns]
            part = part[of[label[part]] != of[commonest]]
            if not len(part):
                continue
            common = np.zeros((len(part), len(label)), np.float32)
            for at in range(0, int((uses > 1).sum()), columns):
                begin, end = np.searchsorted(code, [at, at + columns])
                block = np.zeros((len(label), columns), np.float32)
                block[row[begin:end], code[begin:end] - at] = 1
                common += block[part] @ block.T
            union = sizes[part][:, None] + sizes[None, :] - common
            i, j = np.nonzero((100 * common >= similarity * union) & (of[label[part]][:, None] != of[label][None, :]))
            of = _joined(of, label[part[i]], label[j])
    moved = np.flatnonzero(of != np.arange(len(names)))
    return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[of[moved]], pa.int64())})


def _compared(rest: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between labels inside band values: (a, b) of labels.

    A band value with many or large sets is cut into parts of COMPARED_SHINGLES shingles, and every
    two parts meet in a task of their own, so a task holds two parts at most.
    """
    with_sets = rest.join(sets, "cid")
    parts = rest.join(sets.select("cid", F.size("shingles").cast("long").alias("n")), "cid").groupBy("bucket").agg(F.ceil(F.sum("n") / COMPARED_SHINGLES).cast("int").alias("parts"))
    dealt = with_sets.join(parts, "bucket").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "label", "shingles")

    def work(rows: pa.Table) -> pa.Table:
        return _label_links(rows, similarity)

    return met.groupBy("bucket", "p", "q").applyInArrow(work, "a long, b long")


def group_classes(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame | None:
    """(cid, label) of the classes that link with another one; None without links.

    members: (bucket, cid) of band values with two classes or more. First every member is compared
    with one hub of its band value, the one with the most candidates; that joins most of a group of
    near copies. A hub has then met all others of the band value and leaves it. Band values whose
    members still bear several labels are compared in full, in blocks that give forests of labels:
    first the largest one of each member, then the others that are still mixed.
    """
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    score = members.join(size, "bucket").groupBy("cid").agg(F.sum("n").alias("score"))
    active = written(members.join(score, "cid").select("bucket", "cid", "score"), "active")
    hubs = written(active.groupBy("bucket").agg(F.max(F.struct("score", "cid")).alias("hub")).select("bucket", F.col("hub.cid").alias("hub")), "hubs")
    meet = active.join(hubs, "bucket").where("cid <> hub")
    pairs = meet.select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct()
    links = written(_verified(pairs, sets, similarity), "links")
    labels = written(components(links).select(F.col("node").alias("cid"), "label"), "labels")
    rest = active.select("bucket", "cid").join(hubs, "bucket").where("cid <> hub").select("bucket", "cid")
    largest = None
    for phase in range(2):
        here = written(rest.join(labels, "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label")), "rest")
        mixed = here.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("bucket", "n")
        if phase == 0:
            # Near copies meet in most of their band values; one of them tells most of it.
            largest = written(here.join(mixed, "bucket").groupBy("cid").agg(F.max(F.struct("n", "bucket")).alias("top")).select(F.col("top.bucket").alias("bucket")).distinct(), "largest")
            chosen = largest
        else:
            chosen = mixed.select("bucket").join(largest, "bucket", "left_anti")
        more = written(_compared(here.join(chosen, "bucket"), sets, similarity).distinct(), "more")
        if not more.isEmpty():
            labels = written(_merged(labels, components(more)), "labels")
    return None if labels.isEmpty() else labels


def _merged(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """Labels after components of labels have joined; nodes without a label yet get theirs."""
    kept = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("cid", F.coalesce("new", "label").alias("label"))
    return kept.union(moved.join(labels.select(F.col("cid").alias("node")), "node", "left_anti").select("node", "label"))


def one_of_each(docs: DataFrame, size: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each group of near-duplicates, one of its smallest id, with its own columns; texts without words stay."""
    found = written(near_duplicates(docs, size, similarity, bands, rows), "near")
    firsts = found.where("kept AND digest IS NOT NULL").groupBy("label", "doc_id", "tk").agg(F.count(F.lit(1)).alias("n"))
    chosen = firsts.groupBy("label").agg(F.sum("n").alias("n"), F.min(F.struct("tk", "doc_id")).alias("one")).where("n > 1")
    chosen = written(chosen.select("label", F.col("one.doc_id").alias("doc_id"), F.col("one.tk").alias("tk")), "chosen")
    gone = found.where("NOT kept").select("doc_id", "tk")
    if chosen.isEmpty():
        return without(docs, gone)
    # Groups with several rows of their smallest id: all of these go, and one comes back.
    several = firsts.join(chosen.select("label"), "label", "left_semi").select("doc_id", "tk")
    return without(docs, gone.union(several)).unionByName(one_per_key(docs, chosen.select("doc_id", "tk")))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: doc_id, tk (a hash of the text), n_shingles, component_id, digest, label, kept.

    docs: columns doc_id and text. size: words in a shingle. similarity: hundredths of the union.
    label: the group of near-duplicates, null without words; several groups may share a component_id
    when ids repeat or are null.
    """
    signed = written(signed_rows(docs, size, bands, rows), "signed")
    classes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = classes.select("cid", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(members.join(shared, "bucket"), "members")
    candidates = members.select("cid").distinct().join(classes, "cid").select("cid", "digest")
    candidates = written(candidates.withColumn("key", F.shiftleft(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32)), "candidates")
    wanted = key_bitmap(candidates, "key")
    found = full_sets(docs, size, wanted).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = written(found.join(candidates, "digest").select("cid", "shingles"), "sets")
    labels = group_classes(members, sets, similarity)
    named = classes.select("digest", "cid", "first")
    if labels is None:
        named = named.select("digest", F.col("first").alias("component_id"), F.col("cid").alias("label"))
    else:
        grouped = written(named.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "grouped")
        smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
        named = grouped.join(smallest, "label")
    named = written(named.select("digest", "component_id", "label"), "named")
    # Rows without words have no digest: they pass by the join, or its missing keys would meet in one task.
    columns = ("doc_id", "tk", "n_shingles", "component_id", "digest", "label")
    met = signed.where(F.col("digest").isNotNull()).join(named, "digest", "left").select(*columns)
    unmet = signed.where(F.col("digest").isNull()).withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")}).select(*columns)
    same = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull())
    return met.union(unmet).withColumn("kept", same)
