"""Token ids as binary shards with a minimal perfect hash index.

Documents are dealt out by ranges of their id (and text, so a hot id is split), encoded, and
written in ascending order. A shard is one row of a Parquet table: the raw little-endian ids of
consecutive documents (16 bits where the vocabulary allows, else 32), the keys in order, and an
index from key to place. The index is a minimal perfect hash over the shard's keys (levels of
bit arrays; a key belongs to the first level where it has a bit to itself, its number is the rank
of that bit) with a 32-bit fingerprint per number, which turns foreign keys away. Spark commits
the table, so a task that runs again leaves one copy, on any storage that Spark can write.

Texts are encoded by cutting them where the vocabulary's own pre-tokenizer always cuts (before a
space, and around a line break, between two visible characters; after a letter, before a stop);
equal pieces are encoded once and kept in a cache of bounded size. A vocabulary with another
pre-tokenizer, a normalizer, or an added token that these cuts could divide gets whole texts.

Defined results: a null or empty text has the end id alone; rows without an id come first and are
read in order, since they have no key; repeated ids are stored side by side and found together;
an empty table gives an empty file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.llm.common import bounded_batches, mix, text_steps
from portolan.llm.rows import keyed
from portolan.session import work_folder

END_ID = 2
SHARD_IDS = 1 << 20
#: Pieces that one worker remembers, and new ones that are encoded in one call.
CACHE_PIECES = 400_000
JOINED_PIECES = 1 << 13
#: Bytes and documents of one step.
STEP_BYTES, STEP_DOCS = 1 << 21, 1 << 13

SHARD_SCHEMA = ("part int, seq int, docs long, tokens long, width int, nulls long, lo long, hi long, ids binary, keys binary, index binary")
PLACE_SCHEMA = "doc_id long, part int, seq int, begin long, n_tokens long, ids_crc32 long"


#: Kinds of bytes: visible ASCII; ASCII letters; stops that end a run of letters.
VISIBLE = np.array([0x21 <= b <= 0x7E for b in range(256)])
LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
STOP = np.array([chr(b) in ".,;:!?)" for b in range(256)])
#: The second byte of a Latin-1 letter, whose first byte is 0xC3.
LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


class PieceEncoder:
    """Ids of texts by way of distinct pieces, the same as encoding each text whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        described = json.loads(vocabulary)
        before = described.get("pre_tokenizer") or {}
        self.break_id = self.tokenizer.encode("\n", add_special_tokens=False).ids
        added = "".join(t["content"] for t in described.get("added_tokens") or [])
        self.cuts = (described.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                     and len(self.break_id) == 1 and not any(c.isspace() or ord(c) < 256 and STOP[ord(c)] for c in added))
        self.number: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _remember(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.size), len(self.size) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        """Keep the half of the pieces that was used most since the last time, once they are too many."""
        if len(self.size) <= CACHE_PIECES:
            return
        kept = np.zeros(len(self.size), bool)
        kept[np.argsort(-self.uses, kind="stable")[:CACHE_PIECES // 2]] = True
        kept &= self.uses > 1
        names = [name for name, keep in zip(self.number, kept.tolist()) if keep]
        sizes, starts = self.size[kept].astype(np.int64), self.start[kept]
        ids = self.ids[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        self.number = {}
        self.start, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self._remember(names, sizes, ids)

    def _encode_odd(self, pieces: list[bytes]) -> None:
        sizes, ids = [], []
        for lo in range(0, len(pieces), JOINED_PIECES):
            group = [p.decode("utf-8", "replace") for p in pieces[lo:lo + JOINED_PIECES]]
            found = [f.ids for f in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            sizes.append(np.array([len(f) for f in found], np.int64))
            ids.append(np.array([i for f in found for i in f], np.uint32))
        self._remember(pieces, np.concatenate(sizes), np.concatenate(ids))

    def _encode_new(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces not seen before, and return their numbers.

        Pieces that begin (after one space) and end with a visible character and hold no line break are
        joined by line breaks, encoded in one call and cut apart again by the break's id.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum(sizes)
        begin = end - sizes
        begin += (data[begin] == 0x20) & (sizes > 1)
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        head, tail, second = data[begin], data[end - 1], data[np.maximum(end - 2, 0)]
        plain = (VISIBLE[head] | (head == 0xC3)) & (VISIBLE[tail] | LATIN[tail] & (second == 0xC3)) & (breaks[end] == breaks[begin])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = len(self.size) + np.arange(len(pieces))
        joined = [pieces[k] for k in order.tolist()]
        count, counts, found = int(plain.sum()), [], []
        for lo in range(0, count, JOINED_PIECES):
            group = joined[lo:min(lo + JOINED_PIECES, count)]
            ids = np.array(self.tokenizer.encode_batch_fast([b"\n".join(group).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            inner = ids != self.break_id[0]
            edges = np.concatenate([[-1], np.flatnonzero(~inner), [len(ids)]])
            assert len(edges) == len(group) + 1
            counts.append(np.diff(edges) - 1)
            found.append(ids[inner])
        if count:
            self._remember(joined[:count], np.concatenate(counts), np.concatenate(found))
        if count < len(joined):
            self._encode_odd(joined[count:])
        return numbers

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of pieces, with the end of the data last."""
        size = len(data)
        cut = np.zeros(size + 1, bool)
        cut[offsets] = True
        if self.cuts and size > 2:
            def before(at: np.ndarray) -> np.ndarray:
                return VISIBLE[data[at - 1]] | (data[at - 2] == 0xC3) & (data[at - 1] >= 0x80) & (at > 1)

            def after(at: np.ndarray) -> np.ndarray:
                return VISIBLE[data[at + 1]] | (data[at + 1] == 0xC3)

            at = np.flatnonzero(data[1:-1] == 0x20) + 1
            cut[at[before(at) & after(at)]] = True
            at = np.flatnonzero(data[1:-1] == 0x0A) + 1
            at = at[before(at) & after(at)]
            cut[at] = True
            cut[at + 1] = True
            at = np.flatnonzero(STOP[data[1:]]) + 1
            cut[at[LETTER[data[at - 1]] | (data[at - 2] == 0xC3) & LATIN[data[at - 1]] & (at > 1)]] = True
        cut[size] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with their end ids, first id of each document with the total last)."""
        docs, size = len(offsets) - 1, len(data)
        if not size:
            return np.full(docs, END_ID, np.uint32), np.arange(docs + 1)
        edges = self._cuts(data, offsets)
        wide = size >= 1 << 31
        pieces = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pc.dictionary_encode(pieces)
        names = coded.dictionary.to_pylist()
        get = self.number.get
        slots = np.fromiter((get(name, -1) for name in names), np.int64, len(names))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            slots[missing] = self._encode_new([names[k] for k in missing.tolist()])
        which = slots[np.asarray(coded.indices)]
        self.uses[slots] += 1
        lengths = self.size[which]
        sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.repeat(self.start[which] - sums[:-1], lengths)
        at += np.arange(sums[-1])
        ids = self.ids[at]
        self._forget()
        first = sums[np.searchsorted(edges, offsets)] + np.arange(docs + 1)
        out = np.empty(len(ids) + docs, np.uint32)
        text = np.ones(len(out), bool)
        text[first[1:] - 1] = False
        out[text] = ids
        out[~text] = END_ID
        return out, first


_ENCODERS: dict[int, PieceEncoder] = {}


def encoder(vocabulary: str) -> PieceEncoder:
    """One encoder per worker and vocabulary."""
    key = zlib.crc32(vocabulary.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(vocabulary)
    return _ENCODERS[key]


def build_index(keys: np.ndarray, offsets: np.ndarray) -> bytes:
    """The index of one shard: keys (sorted, repeats allowed) of its last records, and the first id of each record with the total last.

    Each level is stored as 64-bit words and the number of keys before each word, so a look-up tests
    one bit and counts within one word.
    """
    unique, record, count = np.unique(keys, return_index=True, return_counts=True)
    record = record + len(offsets) - 1 - len(keys)
    hashed = mix(unique.astype(np.int64).view(np.uint64) + np.uint64(1))
    left, words, before, sizes, numbers, base = np.arange(len(unique)), [], [], [], np.zeros(len(unique), np.int64), 0
    while len(left):
        size = max(64, -(-len(left) * 3 // 128) * 64)
        at = (mix(hashed[left] ^ np.uint64(len(sizes))) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        level = np.packbits(alone, bitorder="little").view("<u8")
        words.append(level)
        before.append(base + np.cumsum(np.bitwise_count(level), dtype=np.uint32) - np.bitwise_count(level))
        sizes.append(len(level))
        own = alone[at]
        ranks = np.cumsum(alone) - 1
        numbers[left[own]] = base + ranks[at[own]]
        base += int(own.sum())
        left = left[~own]
    place = np.empty((len(unique), 3), np.uint32)
    place[numbers] = np.stack([(hashed >> np.uint64(32)).astype(np.uint32), record.astype(np.uint32), count.astype(np.uint32)], axis=1)
    head = np.array([len(unique), len(offsets) - 1, len(sizes), *sizes], "<i8")
    return b"".join([head.tobytes(), np.asarray(offsets, "<i8").tobytes(), *[w.tobytes() for w in words], *[x.astype("<u4").tobytes() for x in before], place.tobytes()])


class Index:
    """Reads an index in place: which records a key has and where their ids lie."""

    def __init__(self, data: bytes):
        n, records, levels = np.frombuffer(data, "<i8", 3).tolist()
        sizes = np.frombuffer(data, "<i8", levels, 24).tolist()
        at = 24 + 8 * levels
        self.offsets = np.frombuffer(data, "<i8", records + 1, at)
        at += 8 * (records + 1)
        self.words = []
        for size in sizes:
            self.words.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        self.before = []
        for size in sizes:
            self.before.append(np.frombuffer(data, "<u4", size, at))
            at += 4 * size
        self.place = np.frombuffer(data, np.uint32, 3 * n, at).reshape(n, 3)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; no records for a key that is not here."""
        hashed = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(1))
        number, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.words, self.before)):
            at = mix(hashed[left] ^ np.uint64(level)) % np.uint64(64 * len(words))
            word, bit = words[at >> np.uint64(6)], np.uint64(1) << (at & np.uint64(63))
            own = (word & bit) != 0
            rank = before[at >> np.uint64(6)] + np.bitwise_count(word & (bit - np.uint64(1)))
            number[left[own]] = rank[own]
            left = left[~own]
        ok = number >= 0
        ok[ok] = self.place[number[ok], 0] == (hashed[ok] >> np.uint64(32)).astype(np.uint32)
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[ok], count[ok] = self.place[number[ok], 1], self.place[number[ok], 2]
        return first, count


def shards(docs: DataFrame, vocabulary: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode documents in ascending order of id into shard rows."""
    ordered = keyed(docs).select("id", "tk", F.col("row.text").cast("string").alias("text")).repartitionByRange(F.asc_nulls_first("id"), "tk").sortWithinPartitions(F.asc_nulls_first("id"), "tk")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(sent.value)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, seq = TaskContext.get().partitionId(), 0
        ids, keys, lengths, nulls, held = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            key = np.concatenate(keys)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            whole = np.concatenate(ids).astype("<u2" if width == 2 else "<u4")
            values = [part, seq, len(ends) - 1, int(ends[-1]), width, nulls, int(key[0]) if len(key) else None, int(key[-1]) if len(key) else None, whole.tobytes(), key.astype("<i8").tobytes(), build_index(key, ends)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SHARD_TYPES)], names=_SHARD_NAMES)

        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            key = np.asarray(batch.column(0).fill_null(0))
            for lo, hi, data, offsets in text_steps(batch.column(2), STEP_BYTES, STEP_DOCS):
                got, first = coder.encode(data, offsets)
                row_at = 0
                while row_at < hi - lo:
                    end = max(int(np.searchsorted(first, first[row_at] + shard_ids - held, "right")) - 1, row_at + 1)
                    end = min(end, hi - lo)
                    ids.append(got[first[row_at]:first[end]])
                    lengths.append(np.diff(first[row_at:end + 1]))
                    mine = slice(lo + row_at, lo + end)
                    keys.append(key[mine][known[mine]])
                    nulls += int((~known[mine]).sum())
                    held += int(first[end] - first[row_at])
                    row_at = end
                    if held >= shard_ids or row_at < hi - lo:
                        yield row()
                        ids, keys, lengths, nulls, held, seq = [], [], [], 0, 0, seq + 1
        if lengths:
            yield row()

    return ordered.mapInArrow(work, SHARD_SCHEMA)


_SHARD_NAMES = ["part", "seq", "docs", "tokens", "width", "nulls", "lo", "hi", "ids", "keys", "index"]
_SHARD_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Write the shard table of docs (columns doc_id, text) to a folder."""
    with open(vocabulary_path or default_vocabulary(), encoding="utf-8") as file:
        vocabulary = file.read()
    with bounded_batches(docs.sparkSession):
        shards(docs, vocabulary, shard_ids).write.option("compression", "zstd").parquet(path)


def _ids_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Shards one at a time, since each holds megabytes."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files, found through the index: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. Shard sizes are summed by part, so the
    running sums stay short.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, index, keys = _ids_of(row), Index(row["index"]), np.unique(np.frombuffer(row["keys"], "<i8"))
                first, count = index.find(keys)
                if count.sum() + row["nulls"] != row["docs"]:
                    raise ValueError(f"the index of shard {row['part']}/{row['seq']} does not cover its documents")
                keyless = np.arange(row["nulls"])
                record = np.concatenate([keyless, np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
                begin, end = index.offsets[record], index.offsets[record + 1]
                doc = pa.concat_arrays([pa.nulls(len(keyless), pa.int64()), pa.array(np.repeat(keys, count), pa.int64())])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begin.tolist(), end.tolist())]
                n = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(begin), pa.array(end - begin), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "begin", "n_tokens", "ids_crc32"])

    files = _stored(spark, path)
    sizes = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = sizes.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))
    read = files.mapInArrow(work, PLACE_SCHEMA)
    return read.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: Sequence[int]) -> DataFrame:
    """(doc_id, ids) of a short list of keys: Parquet skips shards by their key range, the index finds the place."""
    wanted = np.unique(np.array(list(keys), np.int64))
    near = _stored(spark, path).where(F.exists(F.array(*[F.lit(int(k)) for k in wanted]), lambda k: (k >= F.col("lo")) & (k <= F.col("hi"))) if len(wanted) else F.lit(False))
    if len(wanted):
        near = near.where((F.col("lo") <= int(wanted[-1])) & (F.col("hi") >= int(wanted[0])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, index = _ids_of(row), Index(row["index"])
                for key, first, count in zip(wanted.tolist(), *(x.tolist() for x in index.find(wanted))):
                    for record in range(first, first + count):
                        found = ids[index.offsets[record]:index.offsets[record + 1]].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return near.mapInArrow(work, "doc_id long, ids array<long>")


def token_table(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = work_folder(spark, "tokens")
    write_tokens(docs, path, vocabulary_path)
    return places(spark, path)
