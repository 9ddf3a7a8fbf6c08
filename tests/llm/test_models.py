"""What is learned: held-out accuracy, raking to targets, the decision list, SQL twins, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from portolan.llm import catalog, mixing, quality_rules, token_files
from portolan.llm.common import read
from tests.llm import plain
from tools.check_oracles import TABLES, table_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_twin(spark, edge, name):
    for folder, tables in ((SF, TABLES), (edge, ("documents", "conversations"))):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if folder == edge else ''}'")
        frame = catalog.QUERIES[name](spark, folder)
        result = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in result.description]
        assert table_of(frame.columns, [tuple(r) for r in frame.collect()]) == table_of(columns, result.fetchall())


def test_language_is_right_on_held_out_rows(spark):
    got = catalog.QUERIES["op9_language_bloom"](spark, SF).where("held_out").join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality_is_right_on_held_out_rows(spark):
    got = catalog.QUERIES["op8_byte_cnn"](spark, SF).where("held_out").join(read(spark, SF, "labels"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)


def test_long_training_texts_are_read_whole():
    """Texts that differ at one place only, wherever it lies."""
    import numpy as np

    from portolan.llm import byte_cnn

    rng = np.random.default_rng(7)
    labels = np.arange(40) % 2
    texts = []
    for label in labels:
        text = bytearray((b"lorem ipsum dolor sit amet " * 400)[:9_216])
        at = int(rng.integers(900, 1_100))  # between the runs of the former cut
        if label:
            text[at:at + 300] = b"#!" * 150
        texts.append(bytes(text))
    net = byte_cnn.train(texts[:20], labels[:20].astype(np.float32), 0.5, steps=60, batch=20)
    p = byte_cnn.probability(net, np.frombuffer(b"".join(texts[20:]), np.uint8), np.arange(21) * 9_216)
    assert ((p >= 0.5) == labels[20:]).all()


def test_toxic_rows_are_found_and_clean_ones_left_alone(spark):
    got = catalog.QUERIES["op5_toxicity_chain"](spark, SF).withColumnRenamed("toxic", "found").join(read(spark, SF, "labels"), "doc_id").collect()
    toxic = [r.found for r in got if r.toxic]
    clean = [r.found for r in got if not r.toxic]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_decision_list_separates_labels(spark):
    judged = catalog.QUERIES["op1_quality_rules"](spark, SF).join(read(spark, SF, "labels"), "doc_id").where("NOT base_failed").collect()
    bad = [r.kept for r in judged if r.quality == 0]
    good = [r.kept for r in judged if r.quality == 1]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_personal_data", "op3_secret_scan"])
def test_native_operators_run_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_raking_meets_targets(spark):
    docs = read(spark, SF, "documents")
    targets = {"lang": {"en": 0.4, "de": 0.3}}
    got = mixing.calibrated(docs, targets=targets)
    sums = {r.lang: r.s for r in got.selectExpr("lang", "tokens * probability AS e").groupBy("lang").agg({"e": "sum"}).withColumnRenamed("sum(e)", "s").collect()}
    total = sum(sums.values())
    assert abs(sums["en"] / total - 0.4) < 1e-3 and abs(sums["de"] / total - 0.3) < 1e-3
    again = mixing.calibrated(docs.repartition(7), targets=targets)
    assert {(r.id, r.sampled) for r in got.collect()} == {(r.id, r.sampled) for r in again.collect()}


def test_pipeline_stages_against_brute_force(spark, small):
    """Each stage is held against plain Python on what the stage before it kept."""
    from tokenizers import Tokenizer

    docs = read(spark, small, "documents")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
        now = stage(spark, now, small)
        after = {r.doc_id for r in now.select("doc_id").collect()}
        ids = {i for i, _ in before}
        if name == "token_files":
            whole = Tokenizer.from_file(token_files.default_vocabulary())
            assert sorted(tuple(r) for r in now.collect()) == plain.token_rows(before, whole)
            break
        assert now.columns == docs.columns
        if name == "quality_rules":
            judged = {r["doc_id"] for r in quality_rules.score_table(docs, read(spark, small, "labels")).where("kept").select("row.doc_id").collect()}
            assert after == judged and not any(plain.base_counts(t)[-1] for i, t in before if i in after)
        if name == "near_duplicates":
            assert after == {i for i, n, c in plain.components(before, 5) if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()]
            assert after == ids - {r[0] for r in plain.contamination(before, items) if r[-1]}
        if name == "mixing":
            drawn = {r.id for r in mixing.calibrated(now_before).where("sampled").select("id").collect()}
            assert after == drawn and len(after) > 0.5 * len(ids)
        now = spark.createDataFrame(now.collect(), docs.schema)
        now_before = now
    import os

    from portolan.session import shared_folder

    earlier = set(os.listdir(shared_folder(spark)))
    assert corpus_pipeline.run(spark, small).count() == len(before)
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(shared_folder(spark))) - earlier)
    assert left == sorted(["tokens", *[f"stage-{name}" for name, _ in corpus_pipeline.STAGES]])


# --- samples and odd labels ----------------------------------------------------------------------


def _label_tables(spark, docs, labels):
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


PROSE = [(i, f"the river and the hill {i} are here", "en") for i in range(40)]
ODD_LABELS = {
    "no labels": (PROSE, [], 0.5),
    "no documents": ([], [(i, i % 2, 0) for i in range(40)], None),
    "labels that meet no document": (PROSE, [(i + 1000, i % 2, 0) for i in range(80)], 0.5),
    "one class found": (PROSE, [(i, 1, 0) for i in range(40)] + [(i + 1000, 0, 1) for i in range(40)], 1.0),
    "one class": (PROSE, [(i, 0, 0) for i in range(40)], 0.0),
    "only disagreeing labels": (PROSE, [(i, q, q) for i in range(40) for q in (0, 1)], 0.5),
    "null labels and ids": (PROSE, [(None, 1, 0), (3, None, None), (None, None, None)], 0.5),
    "texts that are null or empty": ([(i, [None, ""][i % 2], "en") for i in range(40)], [(i, i % 3 == 0, 0) for i in range(40)], None),
}


@pytest.mark.parametrize("name", sorted(ODD_LABELS))
def test_odd_labels(spark, name):
    from portolan.llm import byte_cnn, quality_rules, toxicity

    docs, labels, score = ODD_LABELS[name]
    frames = _label_tables(spark, docs, [(i, None if q is None else int(q), t) for i, q, t in labels])
    got = byte_cnn.classify(*frames).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    if score is not None:
        assert all(abs(r.score - score) < 1e-6 for r in got)
    chained = toxicity.toxic_rows(*frames).collect()
    assert len(chained) == len(docs) and all(0 <= r.p_toxic <= 1 for r in chained)
    assert quality_rules.score_table(*frames).count() == len(docs)


ODD_LANGUAGES = {
    "commonest language without text": ([(i, [None, "", " 12 "][i % 3], "xx") for i in range(60)] + [(100 + i, "der Fluss und der Berg", "de") for i in range(9)], {"de"}),
    "no language": ([(i, "the river", None) for i in range(9)], set()),
    "no text at all": ([(i, None, "en") for i in range(9)], set()),
    "one id under two languages": ([(1, t, lang) for t, lang in [("the river and the hill", "en"), ("der Fluss und der Berg", "de")] * 5], {"en", "de"}),
    "ids that are null": ([(None, "the river and the hill", "en"), (None, "der Fluss und der Berg", "de")], {"en", "de"}),
}


@pytest.mark.parametrize("name", sorted(ODD_LANGUAGES))
def test_odd_languages(spark, name):
    from portolan.llm import lang_bloom

    docs, learned = ODD_LANGUAGES[name]
    got = lang_bloom.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs) and {r.lang_pred for r in got} - {"und"} <= learned
    if len(learned) == 2:
        # Each text was learned under its own language, so it is told by it.
        right = dict((text, lang) for _, text, lang in docs)
        found = lang_bloom.predictions(spark.createDataFrame([(k, t) for k, t in enumerate(right)], "doc_id long, text string"), lang_bloom.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))).collect()
        assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == list(right.values())


def test_sample_is_that_of_the_smallest_hashes_whatever_the_layout(spark):
    from pyspark.sql import functions as F

    from portolan.llm import sampling

    rows = spark.range(0, 20_000).select("id", F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 9, "hot").alias("kind"))
    for layout in (rows.repartition(7), rows.coalesce(1)):
        got = sampling.smallest_hashes(layout, "kind", 300, ["id"])
        best = rows.withColumn("h", F.conv(F.hex(F.xxhash64(F.lit(0), "id")), 16, 10).cast("decimal(20,0)")).collect()
        want = set()
        for kind in ("rare", "hot", None):
            want |= {r.id for r in sorted((r for r in best if r.kind == kind), key=lambda r: r.h)[:300]}
        assert {r.id for r in got.collect()} == want and len(want) == 900
    assert sampling.smallest_hashes(rows.limit(0), "kind", 5, ["id"]).count() == 0


def test_no_task_ranks_a_whole_class(spark):
    """Rows that reach the ranking: the sample and the rest of one slot of the hash."""
    from pyspark.sql import functions as F

    from portolan.llm import sampling

    rows = spark.range(0, 200_000).select("id", F.lit("hot").alias("kind"))
    hashed = rows.withColumn("slot", F.shiftrightunsigned(F.xxhash64(F.lit(0), "id"), 64 - sampling.SLOT_BITS))
    last = sampling.smallest_hashes(rows, "kind", 1500, ["id"]).join(hashed, "id").agg(F.max("slot")).first()[0]
    assert hashed.where(F.col("slot") <= last).count() <= 1500 + 2 * 200_000 / (1 << sampling.SLOT_BITS)


def test_labelled_sample_counts_an_id_once(spark):
    from portolan.llm import sampling

    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (9, 1)], "doc_id long, quality int")
    got = sorted((r.doc_id, r.quality, r.text) for r in sampling.labelled_sample(docs, labels, "quality", 10).collect())
    assert [(i, q) for i, q, _ in got] == [(1, 1), (2, 0)] and got[0][2] in ("a", "b") and got[1][2] is None
