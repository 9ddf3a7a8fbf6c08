"""Plan shape: what must hold for large tables."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"armador", "total_containers"}


def test_flagship_pushes_dates_and_reads_few_columns(spark):
    text = plan(entry.entry(spark))
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_extendedprice" not in text and "TakeOrderedAndProject" in text


@pytest.mark.parametrize("name", ["c3_normalize_table", "c4_parse_quantity", "c14_parse_dates", "n6_filters", "x4_chunks"])
def test_no_python_in_cleaning(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", ["k10_last_messages", "k8_top_per_column", "a28_drill_down"])
def test_ranks_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["g2_upsell", "a21_outliers", "a18_share", "n4_entities"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_every_movement_lookup_is_optional(spark):
    from portolan.plans.movements import movements

    assert "Join" not in plan(movements(spark, SF, "ano_mes", "qtd_container"))


@pytest.mark.parametrize("name", ["k5_carriers_at_port", "f1_filter_set", "f6_year_month", "f7_period_range", "f19_year_fallback"])
def test_periods_prune_the_scan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdat" in text


def test_stored_star_joins_without_an_exchange(spark, tmp_path):
    """Under the join of lines and orders no row moves, and the period prunes the stored lines."""
    from portolan.plans import star
    from portolan.plans.catalog import filters
    from portolan.plans.movements import movements

    name = star.store(spark, SF, str(tmp_path / "star"), "star_test", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(movements(spark, name, "cliente", "armador", "porto_descarga", "porto_embarque", "tipo_carga", "qtd_container", start="1998-01-01"))
        assert "SortMergeJoin" in joined and "Exchange" not in joined and "Bucketed: true" in joined
        assert "Exchange" in plan(movements(spark, SF, "cliente", "qtd_container"))
        ranked = plan(filters.carriers_at_port(spark, name))
        assert "Exchange" not in ranked[ranked.index("SortMergeJoin"):] and "GreaterThanOrEqual(data_embarque" in ranked
        only_lines = plan(movements(spark, name, "armador", "porto_embarque", "ano_mes"))
        assert "Join" not in only_lines and "cliente" not in only_lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    star.drop(spark, "star_test")
    assert not spark.catalog.tableExists("star_test_linhas")


def test_stored_star_has_buckets_by_its_lines(spark, monkeypatch):
    """A bucket holds so many lines whatever the table's size, and what follows from other columns does not move to it."""
    from portolan.plans import star
    from portolan.plans.catalog import stored
    from portolan.plans.movements import table

    lines = table(spark, SF, "lineitem").count()
    assert star.buckets_for(spark, SF, 4) == 4
    monkeypatch.setattr(star, "BUCKET_LINES", lines // 20)
    monkeypatch.setattr(stored, "_STARS", {})
    name = stored.stored_star(spark, SF)
    held = table(spark, name, "linhas")
    assert held.inputFiles() and len(held.inputFiles()) == star.buckets_for(spark, SF, 16) >= 20
    assert held.count() == lines and set(star.LINE_MOVED).isdisjoint({"ano", "mes", "ano_mes", "exportador", "c20", "c40", "teus"})


def test_ingestion_converts_each_row_once(spark, tmp_path):
    """The filter, the write and the integrity row read what was converted; rows without a month are counted, not filed."""
    from pyspark.sql import functions as F

    from portolan.plans import ingest

    seen = spark.sparkContext.accumulator(0)

    def counted(day):
        seen.add(1)
        return day

    raw = spark.createDataFrame([("Ana", "3/1/2024", "1,5"), ("ana ", "4/2/2024", "2"), (None, "5/2/2024", "x"), ("Rui", "none", "7"), ("Eva", None, "8"), (None, None, None)], "cliente string, dia string, qtd_container string")
    raw = raw.withColumn("dia", F.udf(counted, "string")("dia"))
    row = ingest.ingest(raw, {}, "dia", str(tmp_path / "set"), "s").first()
    assert (row["total_records"], row["nulos_cliente"], row["nulos_ano_mes"], row["unique_clients"], row["periodo_min"], row["periodo_max"]) == (5, 1, 2, 3, "202401", "202402")
    filed = spark.read.parquet(str(tmp_path / "set"))
    assert sorted((r["cliente"] or "", r["qtd_container"]) for r in filed.collect()) == [("", 0.0), ("ana", 1.5), ("ana", 2.0)]
    assert seen.value <= 2 * raw.count()  # dropping empty rows asks for the day once more


@pytest.mark.parametrize("name", ["n7_batch", "n7_batch_answers"])
def test_movements_of_a_question_table_are_joined_once(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "lineitem" not in text and "Expand" not in text  # sums start from the written rows, one set of columns after the other


def test_hybrid_search_moves_texts_once(spark):
    text = entry.queries()["x11_hybrid_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("CoGroup") == 2 and "split(lower(text" not in text.replace("split(lower(query", "")
