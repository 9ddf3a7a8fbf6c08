"""A versioned table: batches of keyed changes under a manifest.

A batch is the difference between the table as it stands and a new snapshot, as rows to insert, to
update and to delete, or such rows given outright. It is written under its batch id and counts once
its line is in the manifest: a batch that runs again after that changes nothing, and one that broke
off before it writes its files anew. Every version can be read; `compact` writes a whole copy, from
which later reads start.

One writer at a time: the manifest line of a version is a folder of its own, so a second writer of
the same version fails instead of overwriting it.

Defined results: keys may be null and a null key is a key; of several rows with one key in a snapshot
the largest, column by column, counts; a snapshot without changes still makes a version; an empty
snapshot deletes everything; a batch of given rows that deletes or updates what is not there is kept
as given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, batch_id string, kind string, inserted long, updated long, deleted long"
OPERATIONS = ("insert", "update", "delete")


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row per version: its batch, whether it holds changes or a whole copy, and how many rows it changed."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` to insert or update and rows of `old` to delete, with their `operation`; one shuffle.

    Only keys and two rows a key meet; equal keys are reduced before the shuffle.
    """
    columns = old.columns
    rest = [c for c in columns if c not in keys]

    def side(frame: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(True).alias("there"))
        other = "after" if name == "before" else "before"
        kept = frame.select(*keys, row.alias(name))
        return kept.withColumn(other, F.lit(None).cast(kept.schema[name].dataType))

    both = side(old, "before").unionByName(side(new.select(*columns), "after"))
    met = both.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    operation = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    changed = met.where(~F.col("before").eqNullSafe(F.col("after"))).withColumns({"operation": operation, "row": F.coalesce("after", "before")})
    return changed.select(*[F.col(c) if c in keys else F.col(f"row.`{c}`").alias(c) for c in columns], "operation")


def _versions(spark: SparkSession, path: str, version: int | None) -> list:
    """Lines of the manifest that a reader of a version needs: the last whole copy and the changes after it. One line a batch."""
    rows = history(spark, path)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    copy = rows.where("kind = 'copy'").agg(F.coalesce(F.max("version"), F.lit(0))).scalar()
    return rows.where(F.col("version") >= copy).orderBy("version").collect()


def read(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The table as of a version (the newest by default)."""
    lines = _versions(spark, path, version)
    if not lines:
        return spark.createDataFrame([], schema)
    columns = schema.fieldNames()
    stored = StructType(list(schema.fields)).add("operation", "string")
    parts = None
    for line in lines:
        part = spark.read.schema(stored).parquet(_folder(path, line["version"])).withColumn("_version", F.lit(line["version"]))
        parts = part if parts is None else parts.unionByName(part)
    if len(lines) == 1:
        return parts.where("operation <> 'delete'").select(*columns)
    newest = parts.groupBy(*keys).agg(F.max_by(F.struct("operation", *[F.col(c).alias(f"_{c}") for c in columns if c not in keys]), "_version").alias("row"))
    return newest.where("row.operation <> 'delete'").select(*[F.col(c) if c in keys else F.col(f"row.`_{c}`").alias(c) for c in columns])


def _folder(path: str, version: int) -> str:
    return f"{path}/data/version={version}"


def _last(spark: SparkSession, path: str) -> int:
    return history(spark, path).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def _line(spark: SparkSession, path: str, version: int, batch_id: str, kind: str) -> None:
    """Count what was written and enter the version; an entry that is there already is an error."""
    counts = spark.read.parquet(_folder(path, version)).agg(*[F.count_if(F.col("operation") == o).alias(o) for o in OPERATIONS])
    line = counts.select(F.lit(version).cast("long").alias("version"), F.lit(batch_id).alias("batch_id"), F.lit(kind).alias("kind"),
                         F.col("insert").alias("inserted"), F.col("update").alias("updated"), F.col("delete").alias("deleted"))
    line.coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")


def apply(spark: SparkSession, path: str, batch_id: str, changed: DataFrame) -> int:
    """Enter rows with their `operation` as a batch; returns the version that holds it."""
    held = history(spark, path).where((F.col("batch_id") == batch_id) & (F.col("kind") == "changes")).agg(F.max("version").alias("v")).first()["v"]
    if held is not None:
        return held
    version = _last(spark, path) + 1
    changed.write.mode("overwrite").parquet(_folder(path, version))
    _line(spark, path, version, batch_id, "changes")
    return version


def commit(spark: SparkSession, path: str, batch_id: str, snapshot: DataFrame, keys: Sequence[str]) -> int:
    """Enter what a new snapshot changes; returns the version that holds it. The same batch again changes nothing."""
    return apply(spark, path, batch_id, changes(read(spark, path, snapshot.schema, keys), snapshot, keys))


def compact(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str]) -> int:
    """Write the newest version as a whole copy; older versions stay readable."""
    version = _last(spark, path) + 1
    read(spark, path, schema, keys).withColumn("operation", F.lit("insert")).write.mode("overwrite").parquet(_folder(path, version))
    _line(spark, path, version, f"copy-{version}", "copy")
    return version


def between(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """What changed from one version to another, by operation."""
    return changes(read(spark, path, schema, keys, first), read(spark, path, schema, keys, last), keys)


def rows_as_of(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], versions: Sequence[int]) -> DataFrame:
    """Rows of several versions side by side, with their version."""
    parts = [read(spark, path, schema, keys, v).withColumn("version", F.lit(v).cast("long")) for v in versions]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


