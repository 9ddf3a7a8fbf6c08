"""What the corpus operators share: reading, written tables, word hashes over Arrow text, and key bitmaps."""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.session import work_folder

#: Bytes and documents that one numpy step holds; a longer document is a step of its own.
STEP_BYTES = 1 << 20
STEP_DOCS = 1024

#: Bytes that Spark sends to a Python worker at once; left alone it counts 10 000 rows, however long their texts are.
BATCH_BYTES = 1 << 22
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bits of a key bitmap: one MB at any size of the data. A full bitmap lets more keys through, never fewer.
BITMAP_BITS = 23

SPACES = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of bounded bytes, unless the session sets a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


_SCRATCH: list[list[str]] = []


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """The rows of df from a table in the cluster's shared folder; lost executors then cost no recomputing.

    Inside `scratch` the table goes with the others of its block, unless it is kept.
    """
    path = work_folder(df.sparkSession, name)
    if _SCRATCH and not kept:
        _SCRATCH[-1].append(path)
    with bounded_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end; whatever is to outlive the block is written with `kept` before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, in one row."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_steps(column: pa.Array, step_bytes: int = STEP_BYTES, step_docs: int = STEP_DOCS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into steps: (first row, end row, bytes, offsets into them); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    count = len(column)
    buffers = column.buffers()
    if not count:
        return
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, count + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < count:
        end = int(np.searchsorted(offsets, offsets[row] + step_bytes, "right")) - 1
        end = min(max(end, row + 1), row + step_docs, count)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below count; tables for one step are kept, longer ones are not."""
    if count <= STEP_BYTES + 1 and _POWERS:
        return _POWERS["up"], _POWERS["down"]
    size = max(count, STEP_BYTES + 1)
    found = {}
    with np.errstate(over="ignore"):
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found[key] = np.multiply.accumulate(steps)
    if size == STEP_BYTES + 1:
        _POWERS.update(found)
    return found["up"], found["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(word: Callable[[int], bool]) -> np.ndarray:
    """For each byte: 0 outside words, else the byte plus one with A-Z in lower case."""
    return np.array([(b + 32 if 65 <= b <= 90 else b) + 1 if word(b + 32 if 65 <= b <= 90 else b) else 0 for b in range(256)], np.uint16)


#: Words of anything but space and the five control blanks.
BLANK_WORDS = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of digits, letters and whatever lies beyond ASCII.
PLAIN_WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several documents: (start byte, end byte, hash of each word, first word of each document with the total last)."""
    docs = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(docs + 1, np.int64)
    letters = table[data]
    inside = letters != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters * up[:len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return start, end, hashes, np.searchsorted(start, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words (runs across documents included; the caller leaves them out)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, np.uint64(size))
    for k in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[k:k + count]
    return mix(total)


def key_bitmap(keys: DataFrame, column: str) -> bytes:
    """A bitmap of fixed size that has a bit for each 64-bit key, made by Spark; it answers "surely not" or "maybe"."""
    slots = keys.select(F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS).alias("slot"))
    rows = (slots.groupBy(F.shiftright("slot", 15).alias("part"))
            .agg(F.expr("bitmap_construct_agg(slot & 32767)").alias("bits")).collect())
    out = np.zeros((1 << (BITMAP_BITS - 15), 4096), np.uint8)
    for part, bits in rows:
        out[part] = np.frombuffer(bytes(bits), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def bitmap_test(packed: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A test of unsigned 64-bit keys against a key bitmap."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little").view(bool)
    return lambda keys: bits[(keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
