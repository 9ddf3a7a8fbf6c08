"""Table and file readers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from portolan.functions.text import extension, mime_type

# Encodings tried for a CSV, in this order.
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")

# Extensions an upload may have, and its largest size.
ALLOWED_EXTENSIONS = (".xlsx", ".xls", ".csv", ".pdf", ".docx", ".txt", ".json")
MAX_SIZE = 50 * 1024 * 1024

READERS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".txt": "text"}


def format_of(path: str) -> str:
    for suffix, kind in READERS.items():
        if path.lower().endswith(suffix):
            return kind
    raise ValueError(f"unsupported format: {path}")


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None,
               **options) -> DataFrame:
    """Read a table by extension. Text formats load as text unless a schema is given."""
    kind = kind or format_of(path)
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", False).option("multiLine", options.get("multiLine", False))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


def probe_columns(spark: SparkSession, path: str, kind: str | None = None) -> list[str]:
    """Column names from the header or footer alone."""
    return read_table(spark, path, kind).columns


def column_catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (source, posicao, coluna) of many sources, ready for the schema rules."""
    rows = [(name, i, c) for name, path in paths.items() for i, c in enumerate(probe_columns(spark, path))]
    return spark.createDataFrame(rows, "source string, posicao int, coluna string")


def read_csv_any_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, **options) -> DataFrame:
    """CSV files, each in its own encoding: the first one when all its bytes are valid in it, else the second.

    The first must be UTF-8, the only one of them that can fail. One pass reads lines as bytes and tells
    the files apart; a folder of one kind stays one read.
    """
    if encodings[0].upper() != "UTF-8":
        return read_table(spark, path, "csv", encoding=encodings[0], **options)
    lines = spark.read.text(path)  # the bytes as they are
    files = lines.groupBy(F.col("_metadata.file_path").alias("arquivo")).agg(F.min(F.is_valid_utf8("value")).alias("valido"))
    kinds = {True: [], False: []}
    for row in files.collect():  # the names of the files, as any listing holds
        kinds[row["valido"]].append(row["arquivo"])
    if not kinds[False] or not kinds[True]:
        return read_table(spark, path, "csv", encoding=encodings[0 if kinds[True] or not kinds[False] else 1], **options)
    first, second = (spark.read.options(header=True, inferSchema=False, encoding=e, **options).csv(kinds[k]) for e, k in ((encodings[0], True), (encodings[1], False)))
    return first.unionByName(second, allowMissingColumns=True)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file, UTF-8 with Latin-1 for files that are not."""
    files = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("texto"))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, one_per_line: bool = False) -> DataFrame:
    """Whole JSON documents, one per file or array element, or one per line."""
    reader = spark.read.option("multiLine", not one_per_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def scan_directory(spark: SparkSession, groups: dict[str, str | Sequence[str]], kind: str = "parquet",
                   casts: dict[str, str] | None = None) -> DataFrame:
    """Union the files of a folder by column name, each row with its file name.

    ``groups`` maps a schema name to the paths that share it, so every group is one read.
    """
    frames = []
    for name, paths in groups.items():
        paths = [paths] if isinstance(paths, str) else list(paths)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        frame = reader.format(kind).load(paths)
        columns: list[Column] = [F.col(c).cast(casts[c]).alias(c) if casts and c in casts else F.col(f"`{c}`") for c in frame.columns]
        frames.append(frame.select(*columns, F.lit(name).alias("esquema"), F.col("_metadata.file_name").alias("arquivo_origem")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_registry(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, size, time and type of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("nome"), "path", "length", "modificationTime").withColumns({
        "extensao": extension("nome"), "mime": mime_type("nome")})


def processing_status(registry: DataFrame) -> DataFrame:
    """Files, bytes and latest time per extension."""
    return registry.groupBy("extensao").agg(
        F.count(F.lit(1)).alias("arquivos"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("ultimo"))


def admissible(registry: DataFrame, extensions: Sequence[str] = ALLOWED_EXTENSIONS, max_size: int = MAX_SIZE) -> DataFrame:
    """The registry with whether each file may be taken in."""
    return registry.withColumn("admitido", F.col("extensao").isin(*extensions) & (F.col("length") <= max_size))
