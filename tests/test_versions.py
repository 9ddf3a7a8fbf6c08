"""A versioned table against plain dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from portolan.sources import versions

SCHEMA = "k int, a string, b double"


def frame(spark, table):
    return spark.createDataFrame([(k, *v) for k, v in table.items()], SCHEMA)


def table_of(rows):
    return {r["k"]: (r["a"], r["b"]) for r in rows.collect()}


def test_every_version_is_readable(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "t")
    now, stored, schema = {}, [], frame(spark, {1: ("x", 1.0)}).schema
    for batch in range(5):
        now = {k: v for k, v in now.items() if rng.random() > 0.2}
        now |= {rng.choice([None, *range(30)]): (rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, None])) for _ in range(12)}
        for _ in range(1 + batch % 2):  # odd batches run twice
            assert versions.commit(spark, path, f"b{batch}", frame(spark, now), ["k"]) == len(stored) + 1
        stored.append(dict(now))
        if batch == 2:
            assert versions.compact(spark, path, schema, ["k"]) == 4
            stored.append(dict(now))
    for number, want in enumerate(stored, 1):
        assert table_of(versions.read(spark, path, schema, ["k"], number)) == want
    assert table_of(versions.read(spark, path, schema, ["k"])) == now
    lines = versions.history(spark, path).orderBy("version").collect()
    assert [r["kind"] for r in lines] == ["changes"] * 3 + ["copy"] + ["changes"] * 2
    for number in range(2, 4):
        a, b = stored[number - 2], stored[number - 1]
        assert tuple(lines[number - 1])[3:] == (len(b.keys() - a.keys()), sum(a[k] != b[k] for k in a.keys() & b.keys()), len(a.keys() - b.keys()))
    moved = {(r["k"], r["operation"]) for r in versions.between(spark, path, schema, ["k"], 1, 6).collect()}
    a, b = stored[0], stored[5]
    assert moved == {(k, "insert") for k in b.keys() - a.keys()} | {(k, "delete") for k in a.keys() - b.keys()} | {(k, "update") for k in a.keys() & b.keys() if a[k] != b[k]}


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark, path, "one", frame(spark, {1: ("x", 1.0), 2: ("y", 2.0)}), ["k"])
    # Files of a second batch, but no line in the manifest.
    frame(spark, {9: ("lost", 0.0)}).withColumn("operation", F.lit("insert")).write.parquet(f"{path}/data/version=2")
    schema = frame(spark, {1: ("x", 1.0)}).schema
    assert table_of(versions.read(spark, path, schema, ["k"])) == {1: ("x", 1.0), 2: ("y", 2.0)}
    versions.commit(spark, path, "two", frame(spark, {2: ("y", 3.0)}), ["k"])
    assert table_of(versions.read(spark, path, schema, ["k"])) == {2: ("y", 3.0)}


def test_odd_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark, {1: ("x", 1.0)}).schema
    assert versions.read(spark, path, schema, ["k"]).count() == 0 and versions.history(spark, path).count() == 0
    doubled = spark.createDataFrame([(1, "x", 1.0), (1, "y", 0.0), (1, "y", None), (None, "n", None)], SCHEMA)
    versions.commit(spark, path, "one", doubled, ["k"])
    assert table_of(versions.read(spark, path, schema, ["k"])) == {1: ("y", 0.0), None: ("n", None)}
    versions.commit(spark, path, "same", doubled, ["k"])
    assert tuple(versions.history(spark, path).where("version = 2").first())[3:] == (0, 0, 0)
    versions.commit(spark, path, "gone", doubled.limit(0), ["k"])
    assert versions.read(spark, path, schema, ["k"]).count() == 0
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    versions.commit(spark, str(tmp_path / "keys"), "one", keys, ["k"])
    assert sorted(r["k"] for r in versions.read(spark, str(tmp_path / "keys"), keys.schema, ["k"]).collect()) == [1, 2]


def test_a_second_writer_of_one_version_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.commit(spark, path, "one", frame(spark, {1: ("x", 1.0)}), ["k"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions._line(spark, path, 1, "other", "changes")
