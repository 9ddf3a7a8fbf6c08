"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# AQE measures each side at run time, so joins broadcast only below the
# threshold and hot partitions are split; nothing here depends on table size.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


_OWN: dict[str, str] = {}


def build_session(app: str = "portolan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; cluster settings win when present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    One of our own is made only where a single machine runs everything (master
    ``local``); on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "folder" not in _OWN or not os.path.isdir(_OWN["folder"]):
        _OWN["folder"] = tempfile.mkdtemp(prefix="portolan-")
        atexit.register(shutil.rmtree, _OWN["folder"], ignore_errors=True)
    return _OWN["folder"]


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on the cluster's shared storage, beside its checkpoints."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# A write drops its shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop their shuffle files; a setting of the session's own is left alone."""
    if spark.conf.get(CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a fresh folder, for a reader that goes over them several times."""
    folder = work_folder(df.sparkSession, name)
    with passing_shuffles(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder the cluster names in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Give every worker this package once per session, so tasks run whatever folder they start in."""
    context = spark.sparkContext
    if _OWN.get("shipped") == context.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="portolan-")  # stays until the driver ends: workers fetch it when they start
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "portolan.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(os.path.join(root, "portolan")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _OWN["shipped"] = context.applicationId
