"""Operator semantics on small fixtures, against plain Python."""

import datetime
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portolan.operators import (
    aggregates, budget, cells, cleaning, conversations, documents, filters, forecast, inverted, numbering, profile, questions, ranking,
    ratelimit, schema, search, segments, series, tracking,
)
from portolan.sources import logs
from portolan.streaming import jobs

MOVES = "cliente string, ano_mes int, qtd_container double, tipo_operacao string, mes int"


def moves(spark, rows):
    return spark.createDataFrame([(c, p, float(q), o, p % 100) for c, p, q, o in rows], MOVES)


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_resample_fills_gaps(spark):
    df = moves(spark, [("a", 202401, 5, "x"), ("a", 202402, 7, "x"), ("b", 202405, 1, "x")])
    assert [r[1] for r in sorted(rows_of(series.resample(df)))] == [5.0, 7.0, 0.0, 0.0, 1.0]
    assert [r[1] for r in sorted(rows_of(series.resample(df, "Q")))] == [12.0, 1.0]


def test_moving_average_needs_a_full_window(spark):
    df = moves(spark, [("a", 202400 + m, m, "x") for m in range(1, 6)])
    got = {r["ano_mes"]: (r["ma_3"], r["ma_6"]) for r in series.monthly_series(df).collect()}
    assert got[202402] == (None, None) and got[202403] == (2.0, None) and got[202405][0] == 4.0


@pytest.mark.parametrize("months", [5, 6, 11, 12])
def test_minimum_lengths(spark, months):
    df = moves(spark, [("a", 202400 + m, 10 * m, "x") for m in range(1, months + 1)])
    assert forecast.forecast(df, 2).count() == (2 if months >= 6 else 0)
    assert series.seasonality(df).count() == (12 if months >= 12 else 0)


def test_forecast_in_one_year_is_minimum_norm(spark):
    y = [12.0, 15, 11, 18, 20, 26]
    df = moves(spark, [("a", 202401 + i, v, "x") for i, v in enumerate(y)])
    x = np.array([(i, i + 1, i // 3 + 1) for i in range(6)], dtype=float)
    beta, *_ = np.linalg.lstsq(x - x.mean(0), np.array(y) - np.mean(y), rcond=None)
    last = datetime.date(2024, 6, 1)
    want = []
    for i in (1, 2):
        day = last + datetime.timedelta(days=30 * i)
        f = np.array([5 + i, day.month, (day.month - 1) // 3 + 1], dtype=float)
        want.append((day.strftime("%Y-%m"), max(0, int(np.mean(y) + (f - x.mean(0)) @ beta))))
    assert [(r["mes"], r["containers_previstos"]) for r in forecast.forecast(df, 2).orderBy("passo").collect()] == want


def test_empty_input_keeps_the_schema(spark):
    df = moves(spark, [])
    assert aggregates.kpi_cards(df, datetime.date(2024, 1, 5)).first()["variacao"] == 0.0
    for frame in (series.trend_summary(df), segments.upsell(df), segments.opportunities(df), ranking.top_clients(df.withColumn("ano", F.lit(1)))):
        frame.collect()
    assert profile.quality_score(df.select("cliente", "ano_mes", "qtd_container")).first()["score"] == 0


def test_previous_month_of_january_and_zero(spark):
    df = moves(spark, [("a", 202312, 4, "x"), ("a", 202401, 6, "x")])
    assert aggregates.kpi_cards(df, datetime.date(2024, 1, 31)).first()["variacao"] == 50.0
    assert aggregates.kpi_cards(df, datetime.date(2023, 12, 31)).first()["variacao"] == 0.0


def test_ties_break_on_the_key(spark):
    df = moves(spark, [("b", 202401, 5, "x"), ("a", 202401, 5, "x"), (None, 202401, 99, "x")])
    assert rows_of(ranking.top_n(df, "cliente", 2, by="qtd_container")) == [("a", 5.0), ("b", 5.0)]


def test_company_in_two_columns_counts_twice(spark):
    df = spark.createDataFrame([("A ", "A", 3.0), ("B", None, 4.0), (" ", "B", 1.0)], "x string, y string, qtd_container double")
    assert rows_of(ranking.top_company(df, ["x", "y"], 5)) == [("A", 6.0), ("B", 5.0)]


def test_container_cascade_per_group(spark):
    data = [("a", "1,5", "2", 9.0), ("b", "0", None, 8.9)]
    df = spark.createDataFrame(data, "k string, C20 string, C40 string, TEUS double")
    assert dict(rows_of(aggregates.total_containers_by(df, "k"))) == {"a": 5, "b": 8}


def test_exact_quantiles_on_a_skewed_column(spark):
    rng = random.Random(1)
    data = [("a", 7.0)] * 4000 + [("a", rng.lognormvariate(0, 3)) for _ in range(6001)] + [("b", 1.0), ("b", 2.0), ("c", None)]
    df = spark.createDataFrame(data, "coluna string, valor double")
    got = {(r[0], r[1]): r[2] for r in profile.exact_quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    xs = [v for k, v in data if k == "a"]
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert got[("a", p)] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    assert got[("b", 0.25)] == 1.25 and ("c", 0.5) not in got


def test_exact_quantiles_of_short_columns(spark):
    rng = random.Random(6)
    columns = {f"c{n}": [rng.choice([rng.random(), 0.5]) for _ in range(n)] for n in range(1, 31)}
    df = spark.createDataFrame([(c, v) for c, vs in columns.items() for v in vs], "coluna string, valor double")
    probabilities = [0.05, 0.25, 0.5, 0.75, 0.9, 0.99]
    got = {(r[0], r[1]): r[2] for r in profile.exact_quantiles(df, probabilities).collect()}
    assert all(got[(c, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12) for c, vs in columns.items() for p in probabilities)


def test_quality_figures(spark):
    data = [("a", "202401", 1.0)] * 2 + [(None, "20241", 2.0), ("b", None, 500.0)] + [(f"c{i}", "202402", float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(data, "cliente string, ano_mes string, qtd_container double")
    row = profile.quality_score(df).first()
    assert (row["duplicados"], row["periodos_invalidos"], row["outliers"], row["score"]) == (1, 2, 1, 70)


def test_greedy_chunks(spark):
    def greedy(content, size):
        out, cur, n = [], [], 0
        for part in (p.strip() for p in content.split("\n\n")):
            if not part:
                continue
            if cur and n + len(part) > size:
                out.append("\n\n".join(cur))
                cur, n = [], 0
            cur.append(part)
            n += len(part)
        return out + (["\n\n".join(cur)] if cur else [])

    rng = random.Random(2)
    texts = ["", " \n\n ", "x" * 50] + ["\n\n".join("p" * rng.randint(0, 30) + " " for _ in range(rng.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size in (5, 12, 100):
        got = {r[0]: r[1] for r in df.select("id", documents.chunk_text(F.col("t"), size)).collect()}
        assert got == {i: greedy(t, size) for i, t in enumerate(texts)}


def brute_rate(events, limit, window):
    state, out = {}, {}
    for user, t, number in sorted(events, key=lambda e: (e[1], e[2])):
        start, n = state.get(user, (None, 0))
        if start is None or t - start > window:
            start, n = t, 0
        n += 1
        state[user] = (start, n)
        out[number] = (start, n, n <= limit)
    return out


def test_rate_limit_matches_brute_force(spark):
    rng = random.Random(4)
    times = [("hot", rng.randint(0, 3000)) for _ in range(1500)] + [(f"u{rng.randint(0, 5)}", rng.randint(0, 9000)) for _ in range(300)]
    times += [("edge", t) for t in (0, 60, 61, 121, 122, 182, 183)]
    events = [(u, t, i) for i, (u, t) in enumerate(times)]
    df = spark.createDataFrame(events, "u string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    for slices in (61, 130, 3600):
        got = ratelimit.rate_limit(df, "u", "ts", "id", limit=10, window=60, slice_seconds=slices)
        found = {r["id"]: (int(r["w"]), r["position"], r["accepted"]) for r in
                 got.withColumn("w", F.unix_seconds("window_start")).collect()}
        assert found == brute_rate(events, 10, 60)


def test_hundred_and_one_events(spark):
    df = spark.range(102).select(F.lit("k").alias("u"), "id", F.timestamp_seconds(F.when(F.col("id") == 101, 61).otherwise(F.col("id") % 60)).alias("ts"))
    got = ratelimit.rate_limit(df, "u", "ts", "id")
    assert got.where("NOT accepted").count() == 1 and got.where("id = 101 AND accepted").count() == 1


def test_keyword_search_ways_agree(spark):
    rng = random.Random(5)
    words = ["aa", "ab", "aaa", "porto", "por", "to", "São"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", "aa", "."]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    asked = [(i, " ".join(rng.choice(words) for _ in range(3))) for i in range(8)] + [(8, "zzz"), (9, " ")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(asked, "query_id int, query string")
    want = set()
    for qi, question in asked:
        scored = [(-sum(t.lower().count(w) for w in question.lower().split()), i) for i, t in docs]
        want |= {(qi, i, -s) for s, i in sorted(scored)[:5] if s < 0}
    few = search.keyword_search_many(d, q, 5)
    assert {(r[0], r[1], r[2]) for r in few.collect()} == want
    joined = search._best(search._keyword_join(d, q, "doc_id", "text", "query_id", "query"), "query_id", F.desc("score"), "doc_id", 5)
    assert {(r[0], r[1], r[2]) for r in joined.collect()} == want


def _vectors(spark, seed=0, rows=80, asked=9):
    rng = np.random.default_rng(seed)
    base, wanted = rng.normal(size=(rows, 6)), rng.normal(size=(asked, 6))
    base[5] = base[3]  # equal distances go by the id
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(wanted)], "query_id int, query array<double>")
    return base, wanted, v, q


@pytest.mark.parametrize(("block", "asked"), [(1 << 17, 1 << 14), (7, 2), (1, 1)])
@pytest.mark.parametrize("metric", ["l2", "inner"])
def test_vector_search_in_tiles(spark, monkeypatch, block, asked, metric):
    monkeypatch.setattr(search, "VECTOR_BLOCK", block)
    monkeypatch.setattr(search, "QUERY_BLOCK", asked)
    base, wanted, v, q = _vectors(spark)
    got = search.vector_search_many(v.repartition(3), q, 3, metric).collect()
    cost = ((base[None] - wanted[:, None]) ** 2).sum(-1) if metric == "l2" else -(wanted @ base.T)
    assert sorted((r["query_id"], r["vec_id"], r["posicao"]) for r in got) == sorted(
        (i, int(j), p + 1) for i in range(9) for p, j in enumerate(np.lexsort((np.arange(80), cost[i]))[:3]))
    assert all(abs(r["score"] - (cost if metric == "l2" else -cost)[r["query_id"], r["vec_id"]]) < 1e-9 for r in got)


def test_vector_search_over_odd_vectors(spark):
    """Nulls, nulls inside, empty vectors and other lengths are no hits and ask for none; a null key comes first among equals."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, []), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (6, [0.0, 1.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", []), ("e", [1.0]), ("f", [0.0, 0.0, 1.0])], "query_id string, query array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"], r["posicao"]) for r in search.vector_search_many(v, q, 2).orderBy("query_id", "posicao").collect()]
    assert got == [("a", None, 0.0, 1), ("a", 1, 0.0, 2), ("f", 5, 2.0, 1)]
    assert search.vector_search_many(v.limit(0), q).count() == 0 and search.vector_search_many(v, q.limit(0)).count() == 0


def test_vector_search_stays_off_the_driver(spark):
    _, _, v, q = _vectors(spark)
    plan = search.vector_search_many(v, q)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("rounds", [0, 5])
def test_cells_find_most_of_the_nearest(spark, tmp_path, rounds):
    """Queries are every 50th vector; recall at the registered numbers of cells and probes, and 1 with all cells looked into."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = search.vector_search_many(vectors, queries).cache()
    centres = cells.fit(vectors, 32, rounds)
    cells.build_index(vectors, centres, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == vectors.count()
    assert cells.recall(cells.search(index, centres, queries, 20), exact).first()["recall"] >= 0.9
    every = cells.search(index, centres, queries, 32).select(*exact.columns)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_cells_of_odd_vectors(spark, monkeypatch):
    """One hot vector fills a cell many times over; odd vectors are left out; no vectors give no cells."""
    monkeypatch.setattr(search, "VECTOR_BLOCK", 8)
    rows = [(i, [1.0, 1.0]) for i in range(60)] + [(100 + i, [float(i), -1.0]) for i in range(10)] + [(200, None), (201, [1.0]), (202, [None, 1.0])]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = v.where("vec_id IN (0, 103, 200)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = cells.fit(v, 4, 2)
    index = cells.assign(v, centres)
    assert centres.shape == (4, 2) and index.count() == 70
    got = [(r["query_id"], r["vec_id"]) for r in cells.search(index, centres, q, 4, k=3).orderBy("query_id", "posicao").collect()]
    assert got[:3] == [(0, 0), (0, 1), (0, 2)] and got[3] == (103, 103) and len(got) == 6
    assert cells.fit(v.limit(0), 4).shape == (0, 0)


def test_entity_match(spark):
    q = spark.createDataFrame([(1, "Carga do CLIENTE ab ltda"), (2, "abc"), (3, "nada"), (4, None)], "id int, t string")
    e = spark.createDataFrame([("ab",), ("ab ltda",), ("bc",), ("cliente",)], "entidade string")
    assert dict(rows_of(questions.match_entities(q, e, "id", "t"))) == {1: "ab ltda", 2: "ab"}


def test_question_rules(spark):
    asked = ["Compare janeiro de 2025 e fevereiro de 2025", "Compare março de 2025", "Quais as maiores rotas?", "Total de maio/2024", "vs jan 2024"]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    got = df.select("id", questions.intent(F.col("t")).alias("k"), questions.month_of(F.col("t")).alias("m"),
                    questions.comparison_period(F.col("t")).alias("p")).orderBy("id").collect()
    d = datetime.date
    assert [r["k"] for r in got] == ["comparacao", "comparacao", "ranking", "total", "comparacao"]
    assert [r["m"] for r in got] == [1, 3, None, 5, 1]
    assert tuple(got[0]["p"]) == (d(2025, 1, 1), d(2025, 2, 1)) and tuple(got[1]["p"]) == (d(2025, 2, 1), d(2025, 3, 1))
    assert tuple(got[2]["p"]) == (None, None)


def test_numbering_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert numbering.number_rows(df, ["k"]).where("numero <> k + 1").count() == 0


def test_first_seen_names(spark):
    df = spark.createDataFrame([("z", 1), ("a", 2), ("z", 3), (None, 0)], "cliente string, data_embarque int")
    assert sorted(rows_of(numbering.anonymize(df)), key=str) == [("CLIENTE_001", 1), ("CLIENTE_001", 3), ("CLIENTE_002", 2), (None, 0)]


def test_upsert_and_row_changes(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, updated_at int, v string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d"), (2, 0, "x")], "id int, updated_at int, v string")
    merged = budget.upsert(old, new, ["id"])
    assert sorted(rows_of(merged)) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]
    changes = sorted(rows_of(tracking.row_changes(old, merged)))
    assert changes == [("novo", 1, 2, 2, "c"), ("novo", 1, 3, 1, "d"), ("removido", 1, 2, 1, "b")]


def test_fingerprint_sees_any_row(spark):
    one = spark.createDataFrame([(1, "a"), (2, None)], "i int, v string")
    two = spark.createDataFrame([(2, None), (1, "a")], "i int, v string")
    three = spark.createDataFrame([(1, "a"), (2, "")], "i int, v string")
    prints = [tuple(tracking.fingerprint(f).first()) for f in (one, two, three)]
    assert prints[0] == prints[1] != prints[2]


def test_date_format_choice(spark):
    df = spark.createDataFrame([("01/02/2024", "2024-02-01", "13/01/2024"), (None, "x", "2024-01-01")], "`ETA` string, b string, c string")
    assert dict(rows_of(cleaning.detect_date_formats(df, ["ETA", "b", "c"]))) == {"ETA": "d/M/yyyy", "b": None, "c": None}
    assert [str(r[0]) for r in cleaning.parse_dates(df).select("ETA").collect()] == ["2024-02-01", "None"]


@pytest.mark.parametrize("kind", ["date", "string"])
def test_period_filters_read_the_period_columns(spark, kind):
    """Dates may be missing, unparsed or of another month than the period."""
    days = [None, "1998-03-05", "2001-01-01"] + ["05/03/1998"] * (kind == "string")
    df = spark.createDataFrame([(1998, 3, 199803, d) for d in days], "ano int, mes int, ano_mes int, dia string").select(
        "ano", "mes", "ano_mes", F.col("dia").cast(kind).alias("data_embarque"))
    for f in (filters.FilterSet(ano=1998), filters.FilterSet(ano=1998, mes=3), filters.FilterSet(data_inicio=199802, data_fim=199804)):
        assert filters.apply_filters(df, f).count() == len(days)
    assert filters.filter_year(df, 1998).count() == filters.filter_year_or_fallback(df, 2025, 1998).count() == len(days)


def test_filters_ignore_accents_and_nulls(spark):
    df = spark.createDataFrame([("importacao", "A"), ("Importação", None)], "tipo_operacao string, cliente string")
    assert filters.apply_filters(df, filters.FilterSet(categoria="IMPORTAÇÃO")).count() == 2
    assert df.where(~filters.any_column_contains(["cliente"], "a")).count() == 1


def test_percentage_scale_and_auto_numeric(spark):
    df = spark.createDataFrame([(0.5, "1"), (50.0, "x")], "probabilidade double, t string")
    assert [r[0] for r in cleaning.rescale_percentage(df).collect()] == [0.005, 0.5]
    assert [r["t"] for r in cleaning.auto_numeric(df).collect()] == [1.0, None]


def test_schema_detection_prefers_the_fuller_match(spark):
    names = {"s1": ["QTD_CONTAINER", "cliente", "ano_mes", "cliente2"], "s2": ["cliente", "receita", "periodo", "margem"], "s3": ["cliente"]}
    catalog = spark.createDataFrame([(s, i, c) for s, cs in names.items() for i, c in enumerate(cs)], "source string, posicao int, coluna string")
    assert {r["source"]: r["esquema"] for r in schema.detect_schema(catalog).collect()} == {"s1": "logistico", "s2": "comercial"}


def test_titles_and_log_lines(spark):
    chat = spark.createDataFrame([(1, 0, "user", "x" * 60), (2, 0, "system", "s"), (2, 1, "user", "u")], "conv_id long, turn long, role string, text string")
    assert dict(rows_of(conversations.titles(chat))) == {1: "x" * 50 + "...", 2: None}
    lines = ["2025-01-01 10:00:00 - INFO - ACCESS: ana - LER - a - b", "2025-01-01 10:00:01 - WARNING - ACCESS_DENIED: rui - LER - x", "ruído"]
    got = logs.parse_lines(spark.createDataFrame([(v,) for v in lines], "value string")).orderBy("momento").collect()
    assert [(r["usuario"], r["recurso"], r["permitido"]) for r in got] == [("ana", "a - b", True), ("rui", "x", False)]


def test_same_text_in_other_cells_has_another_fingerprint(spark):
    from portolan.operators import tracking

    def soma(*row):
        return tracking.fingerprint(spark.createDataFrame([row], "a string, b string")).first()["soma"]

    assert len({soma("x|y", "z"), soma("x", "y|z"), soma("n", "z"), soma(None, "z"), soma("\\N", "z")}) == 5


def test_questions_with_plurals_and_a_shared_year(spark):
    from portolan.operators import questions

    rows = [("Qual foi o volume total de importações em março de 2025",), ("Compare as exportações entre janeiro e fevereiro de 2025",)]
    df = spark.createDataFrame(rows, "q string").select(
        questions.category_of(F.col("q")).alias("c"), questions.comparison_period(F.col("q")).alias("p"))
    a, b = df.collect()
    assert (a.c, b.c) == ("importacao", "exportacao")
    assert (str(b.p.inicio), str(b.p.fim)) == ("2025-01-01", "2025-02-01")


def test_near_distances_are_exact():
    import numpy as np

    from portolan.operators.search import _near_distances

    rng = np.random.default_rng(0)
    base = rng.normal(0, 1e4, 64)
    rows = np.vstack([base + rng.normal(0, 1e-5 * (n + 1), 64) for n in range(40)])
    exact = ((rows - base) ** 2).sum(1)
    found = _near_distances(rows, base[None, :], 5)[:, 0]
    assert (np.argsort(found, kind="stable")[:5] == np.argsort(exact, kind="stable")[:5]).all()
    assert (found[np.isfinite(found)] == exact[np.isfinite(found)]).all()


def test_findings_are_not_cut(spark):
    from portolan.operators import segments

    rows = [(f"c{i:03d}", 199801, 1.0, "importacao") for i in range(30) for _ in range(6)] + [("big", 199801, 1e6, "importacao")] * 40 + [(f"d{i}", 199801, 1e4, "importacao") for i in range(40)]
    df = spark.createDataFrame(rows, "cliente string, ano_mes int, qtd_container double, tipo_operacao string")
    assert segments.opportunities(df).where("tipo = 'upsell_cliente'").count() == segments.upsell(df).count() > 15


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from portolan.session import shared_folder

    here = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(here)


def test_answers_of_a_question_table(spark):
    rows = spark.createDataFrame([
        ("Ana", "P1", "P2", "importacao", 2024, 1, "N", 10.0), ("Ana", "P1", "P1", "exportacao", 2024, 2, "M", 5.0), ("Bia", "P2", "P1", "importacao", 2024, 2, "M", 7.0),
        ("Bia", "P2", "P2", "importacao", 2024, 3, None, 3.0), ("Bia", "P2", "P2", "importacao", 2023, 12, "O", 0.0)],
        "cliente string, porto_embarque string, porto_descarga string, tipo_operacao string, ano int, mes int, armador string, qtd_container double")
    asked = spark.createDataFrame([
        (1, "total", "ana", None, None, None, None, None, None), (2, "total", None, "p1", None, 2024, None, None, None), (3, "total", "zoe", None, None, None, None, None, None),
        (4, "ranking", None, None, None, 2024, None, None, None), (5, "ranking", "zoe", None, None, None, None, None, None), (6, "tendencia", None, None, None, None, None, None, None),
        (7, "comparacao", None, None, None, None, None, "2024-01-01", "2024-02-01"), (8, "comparacao", None, None, None, None, None, None, "2024-02-01"), (9, "comparacao", "zoe", None, None, None, None, "2024-01-01", "2024-02-01"),
        (10, "outra", None, None, None, None, None, None, None)],
        "id int, tipo_analise string, cliente string, porto string, categoria string, ano int, mes int, data_inicio string, data_fim string")
    asked = asked.withColumns({c: F.col(c).cast("date") for c in ("data_inicio", "data_fim")})
    got = {}
    for r in questions.answers(asked, rows, "id", n=2).collect():
        got.setdefault(r["id"], []).append((r["posicao"], r["chave"], r["anterior"], r["total"], r["variacao"], r["percentual"], r["media"], r["rotulo"]))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1] == [(1, "total", None, 15.0, None, None, None, None)] and got[2][0][3] == 22.0 and got[3][0][3] == 0.0
    # Carriers M 12 and N 10 of 25; rows without a carrier count in the whole.
    assert got[4] == [(1, "M", None, 12.0, None, 88.0, None, None), (2, "N", None, 10.0, None, 88.0, None, None)]
    assert [x[1:5] for x in got[6]] == [("202401", None, 10.0, None), ("202402", 10.0, 12.0, 20.0), ("202403", 12.0, 3.0, -75.0)]
    assert {x[6:] for x in got[6]} == {(-27.5, "QUEDA SIGNIFICATIVA")}
    assert [x[:5] for x in got[7]] == [(1, "geral", 10.0, 12.0, 20.0), (2, "exportacao", 0.0, 5.0, None), (3, "importacao", 10.0, 7.0, -30.0)]
    assert got[9] == [(1, "geral", 0.0, 0.0, 0.0, None, None, None)]
    assert not {5, 8, 10} & set(got)
    assert questions.answers(asked.limit(0), rows, "id").count() == 0


def _plain_windows(events, window, limit):
    """(key, id, opening, order, accepted) by walking each key's events in order of time."""
    out, opened = [], {}
    for key, moment, number in sorted((k, t, i) for k, t, i in events if t is not None):
        first, seen = opened.get(key, (None, 0))
        if first is None or moment - first > window:
            first, seen = moment, 0
        opened[key] = first, seen + 1
        out.append((key, number, first, seen + 1, seen + 1 <= limit))
    return sorted(out)


def _events(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, None if t is None else start + datetime.timedelta(seconds=t), i) for k, t, i in rows], "k string, ts timestamp, i int")


def _seconds(frame):
    start = datetime.datetime(2024, 1, 1)
    return sorted((r["k"], r["i"], None if r["window_start"] is None else (r["window_start"] - start).total_seconds(), r["position"], r["accepted"]) for r in frame.collect())


def _hot_rows():
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 4000), i) for i in range(200)] + [(f"k{i % 7}", rng.randint(0, 4000), 1000 + i) for i in range(100)]
    return rows + [("hot", 100, 5000 + i) for i in range(20)]  # events of one moment go by their id


def test_rate_limit_marks_events_without_a_time(spark):
    rows = [*_hot_rows(), ("hot", None, 9001), ("late", None, 9002)]
    got = _seconds(ratelimit.rate_limit(_events(spark, rows), "k", "ts", "i", limit=3, window=60, slice_seconds=100))
    assert sorted(r for r in got if r[2] is not None) == _plain_windows(rows, 60, 3)
    assert [r for r in got if r[2] is None] == [("hot", 9001, None, None, None), ("late", 9002, None, None, None)]
    assert ratelimit.rate_limit(_events(spark, []), "k", "ts", "i").count() == 0


def test_rate_limit_stream_in_slices(spark, tmp_path):
    """Batches out of order by less than the lateness; windows are handed on between slices."""
    rows = _hot_rows()
    events = [*rows, ("hot", None, 9001), ("last", 100_000, 9003)]
    for part in range(3):
        chosen = [r for r in events if r[1] is not None and min(r[1] + 37 * r[2] % 150, 4400) // 1500 == part or part == 2 and (r[1] is None or r[1] > 5000)]
        _events(spark, chosen).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_table(spark, str(tmp_path / "in"), _events(spark, []).schema, files_per_trigger=1)
    with jobs.keyed_state(spark):
        decided = jobs.rate_limit_stream(stream, "k", "ts", "i", limit=3, window=60, late="300 seconds", slice_seconds=200)
        jobs.write_stream(decided, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = _seconds(spark.read.parquet(str(tmp_path / "out")))
    assert got == _plain_windows(rows, 60, 3)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_rate_limit_stream_keeps_state_by_group(spark, tmp_path):
    """Many keys, a null one among them, share the state of a few groups, and the stream goes on from its checkpoint."""
    rng = random.Random(6)
    rows = [(f"k{i % 300}", rng.randint(0, 800), i) for i in range(1200)] + [("", rng.randint(0, 800), 5000 + i) for i in range(9)]
    whole = [(k or None, t, i) for k, t, i in rows]
    batches = [[r for r in whole if r[1] < 400], [r for r in whole if r[1] >= 400], [("last", 100_000, 9003)]]
    for number, batch in enumerate(batches):
        _events(spark, batch).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_table(spark, str(tmp_path / "in"), _events(spark, []).schema, files_per_trigger=None)
        with jobs.keyed_state(spark, more=number < 2):
            decided = jobs.rate_limit_stream(stream, "k", "ts", "i", limit=2, window=60, late="300 seconds", slice_seconds=200, groups=4)
            query = jobs.write_stream(decided, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
            query.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert held and max(held) < 150
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("k IS NULL").count() == 9
    assert _seconds(got.fillna("", ["k"])) == _plain_windows(rows, 60, 2)


def test_forecast_by_group_is_that_of_each_group(spark):
    """Against numpy: full rank, six months of one year, one calendar month a year, constant values, too few months."""
    rng = random.Random(9)
    months = {"long": range(0, 40), "year": range(0, 6), "same month": range(0, 84, 12), "two months": [0, 1, 12, 13, 24, 25, 36], "flat": range(0, 14), "short": range(0, 5), "gaps": sorted(rng.sample(range(60), 11)), "quarter": range(3, 9)}
    rows = [(g, 202001 + (k // 12) * 100 + k % 12, 7.0 if g == "flat" else float(rng.randint(0, 90))) for g, ks in months.items() for k in ks]
    rows += [(None, *r[1:]) for r in rows if r[0] == "gaps"] + [("long", None, 5.0)]
    df = spark.createDataFrame(rows, "g string, ano_mes int, qtd_container double")
    got = {(r["g"], r["passo"]): r for r in forecast.forecast_by(df, ["g"], 2).collect()}
    for group in [*months, None]:
        one = df.where(F.col("g").eqNullSafe(group)).withColumn("cliente", F.lit("c"))
        if group == "short":
            assert (group, 1) not in got
            continue
        for r in forecast.forecast(one, 2).collect():
            mine = got[group, r["passo"]]
            for c in ("mes", "mae", "r2", "precisao", "confianca", "dados_historicos"):
                assert mine[c] == r[c] or abs(mine[c] - r[c]) < 1e-4, (group, c, mine, r)
            assert abs(mine["containers_previstos"] - r["containers_previstos"]) <= (0 if group not in ("flat", "year") else 1), (group, mine, r)
    assert len(got) == 2 * len(months) and forecast.forecast_by(df.limit(0), ["g"]).count() == 0


def test_forecast_of_one_group_is_the_global_one(spark):
    from portolan.plans.movements import movements

    df = movements(spark, "/root/testdata/sf0.001", "cliente", "ano_mes", "qtd_container").withColumn("g", F.lit(1))
    assert rows_of(forecast.forecast_by(df, ["g"]).drop("g").orderBy("passo")) == rows_of(forecast.forecast(df).orderBy("passo"))


def test_inverted_index_gives_the_hits_of_the_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["carga", "cargas", "porto", "portos do", "ab", "a", "Ção", "navio-01", "navionavio"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) or None, f"f{i % 3}", "x" if i % 2 else "y") for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tag string")
    q = spark.createDataFrame([(1, "carga"), (2, "a navio"), (3, "ção  AB"), (4, "nada"), (5, ""), (6, None), (7, "navionavi")], "query_id int, query string")
    path = str(tmp_path / "index")
    for batch in range(3):
        for _ in range(2):  # every batch runs twice
            files = inverted.add(d.where(f"doc_id % 3 = {batch}"), path, f"b{batch}", tags=["tag"])
        assert [tuple(r)[:3] for r in files.collect()] == [(f"f{batch}", 20, sum(len((t or "").split()) for i, t, *_ in docs if i % 3 == batch))]
    want = sorted(map(tuple, search.keyword_search_many(d, q, 7).collect()))
    assert sorted(map(tuple, inverted.search_many(spark, path, q, 7).collect())) == want and len(want) > 20
    inverted.compact(spark, path, str(tmp_path / "merged"))
    assert sorted(map(tuple, inverted.search_many(spark, str(tmp_path / "merged"), q, 7).collect())) == want
    tagged = sorted(map(tuple, search.keyword_search_many(d.where("tag = 'x'"), q, 7).collect()))
    assert sorted(map(tuple, inverted.search_many(spark, path, q, 7, tag="x").collect())) == tagged
    inverted.add(d.limit(0), path, "b1", tags=["tag"])
    fewer = sorted(map(tuple, search.keyword_search_many(d.where("doc_id % 3 <> 1"), q, 7).collect()))
    assert sorted(map(tuple, inverted.search_many(spark, path, q, 7).collect())) == fewer


def test_index_search_reads_the_drawers_it_needs(spark, tmp_path):
    d = spark.createDataFrame([(i, f"palavra{i} outra{i}", "f") for i in range(200)], "doc_id bigint, text string, source string")
    inverted.add(d, str(tmp_path), "b")
    q = spark.createDataFrame([(1, "palavra77")], "query_id int, query string")
    text = inverted.search_many(spark, str(tmp_path), q)._jdf.queryExecution().executedPlan().toString()
    # One anchor and one token: a drawer of each table, out of 64.
    assert len(re.findall(r"PartitionFilters: \[[^]]*\(gaveta#\d+ = \d+\)", text)) == 2


def test_entities_of_several_dictionaries_in_one_pass(spark):
    rng = random.Random(3)
    names = {k: sorted({"".join(rng.choices("abc ", k=rng.randint(1, 6))).strip() or "a" for _ in range(40)}) for k in ("x", "y")}
    names["y"] += ["", "a" * 30]
    asked = [(i, "".join(rng.choices("abcdé  ", k=rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, ""), (902, "a" * 500), (903, "Á")]
    q = spark.createDataFrame(asked, "id int, t string")
    got = {r["id"]: (r["x"], r["y"]) for r in questions.match_all(q, {k: spark.createDataFrame([(v,) for v in vs], "entidade string") for k, vs in names.items()}, "id", "t").collect()}
    for i, t in asked:
        plain = (t or "").lower().replace("é", "e").replace("á", "a").strip()
        want = tuple(min([v for v in names[k] if v and v in plain], key=lambda v: (-len(v), v), default=None) for k in ("x", "y"))
        assert got.get(i, (None, None)) == want, (i, t)


def test_pieces_are_held_against_the_entities_before_they_move(spark):
    q = spark.range(50).selectExpr("CAST(id AS INT) AS id", "concat(repeat('z', 200), ' ana ', id) AS t")
    e = spark.createDataFrame([("ana",), ("anabela",)], "entidade string")
    matched = questions.match_entities(q, e, "id", "t")
    text = matched._jdf.queryExecution().executedPlan().toString()
    shuffled = text[text.index("hashpartitioning"):]
    assert "Python" not in text and shuffled.index("xxhash64") < shuffled.index("Generate explode")
    assert matched.where("entidade = 'ana'").count() == 50


def test_keyword_tiles_are_the_pairs(spark, monkeypatch):
    from portolan.operators import search

    monkeypatch.setattr(search, "WORD_BLOCK", 8)  # many tiles
    rng = random.Random(4)
    some = ["a", "ab", "bab", "c", "cab", "d"]
    d = spark.createDataFrame([(None if i % 9 == 0 else i % 25, " ".join(rng.choice(some) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i if i else None, " ".join(rng.choice(some) for _ in range(3))) for i in range(7)] + [(8, ""), (9, None)], "query_id long, query string")
    pairs = search._best(search._keyword_join(d, q, "doc_id", "text", "query_id", "query"), "query_id", F.desc("score"), "doc_id", 4)
    tiles = search.keyword_search_many(d, q, 4)
    assert set(tiles.collect()) == set(pairs.select(tiles.columns).collect()) and tiles.count() > 20
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan


def test_distinct_values_before_they_are_normalised(spark):
    from portolan.operators.sets import distinct_values

    rows = spark.createDataFrame([("É", "e"), (" e ", None), ("", "b")], "a string, b string")
    got = distinct_values(rows, ["a", "b"])
    assert sorted(r[0] for r in got.collect()) == ["b", "e"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_questions_are_dealt_over_tasks(spark):
    from portolan.operators import questions

    asked = spark.createDataFrame([(1, "do cliente Ana e Ana Maria, ana maria"), (2, "nada")], "id long, q string").coalesce(1)
    names = spark.createDataFrame([("ana",), ("ana maria",)], "entidade string")
    got = questions.match_all(asked, {"c": names}, "id", "q")
    assert [tuple(r) for r in got.collect()] == [(1, "ana maria")]
    assert "Repartition" in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_texts_in_small_files(spark, tmp_path, monkeypatch):
    from portolan.plans.catalog import files

    spark.createDataFrame([(i, "x" * 90) for i in range(50)] + [(50, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path / "out")
    monkeypatch.setattr(files, "FILE_BYTES", 1000)
    monkeypatch.setattr(files, "work_folder", lambda *_: folder)
    rows = files.whole_texts(spark, str(tmp_path)).collect()
    import os
    sizes = [os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".txt")]
    assert sum(r["copias"] for r in rows if r["tamanho"] == 90) == 50 and max(sizes) < 2500


def test_texts_move_once_to_meet_the_words(spark):
    d = spark.createDataFrame([(1, "uma carga"), (2, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "carga")], "query_id int, query string")
    plan = search.keyword_search_many(d, q)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan and "split(lower(text" not in plan  # no row per token, no join of them


def test_words_in_tokens_are_counted_as_text_does(monkeypatch):
    rng = random.Random(3)
    for step in (1, 7, 1 << 20):
        monkeypatch.setattr(search, "TOKEN_STEP", step)
        for letters in ("a", "ab", "abcé", "ação€😀x") * 10:
            tokens, words = (sorted({"".join(rng.choices(letters, k=rng.randint(1, most))) for _ in range(20)}) for most in (14, 6))
            got = {(tokens[t], words[w]): n for t, w, n in zip(*(x.tolist() for x in search._held(pa.array(tokens), pa.array(words))))}
            assert got == {(t, w): t.count(w) for t in tokens for w in words if w in t}


def test_word_counts_of_texts_in_steps(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "b", "", "abab", "ç"], k=rng.randint(0, 9))) for _ in range(40)]
    words = ["a", "ab", "ba", "ç", "z"]
    for block, pairs in ((1 << 20, 1 << 21), (1, 3), (5, 1)):
        monkeypatch.setattr(search, "WORD_BLOCK", block)
        monkeypatch.setattr(search, "PAIR_STEP", pairs)
        rows, word, n = search._text_words(pa.table({"texto": texts}), np.arange(40) // 2, pa.array(words))  # two rows to a text
        both = [" ".join(texts[i:i + 2]) for i in range(0, 40, 2)]
        assert {(r, words[w]): c for r, w, c in zip(rows.tolist(), word.tolist(), n.tolist())} == {
            (i, w): sum(t.count(w) for t in text.split()) for i, text in enumerate(both) for w in words if w in text}
        assert len(n) == len(set(zip(rows.tolist(), word.tolist()))) and sorted(word.tolist()) == word.tolist()


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from portolan.session import CLEANUP, passing_shuffles, stored

    rows = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "t")
    assert rows.count() == 7 and spark.conf.get(CLEANUP, None) is None
    spark.conf.set(CLEANUP, "false")
    with passing_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "false"  # the session's own setting
    spark.conf.unset(CLEANUP)
    with passing_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"


def test_pieces_begin_where_a_name_may_begin(spark):
    names = spark.createDataFrame([("ana",), ("anabela souza",), ("anabel",), ("zé",)], "entidade string")
    q = spark.createDataFrame([(1, "da Anabela Souza e anabela"), (2, "anabe"), (3, "ze, anabel"), (4, "an"), (5, None)], "id int, t string")
    matched = questions.match_entities(q, names, "id", "t")
    assert sorted(map(tuple, matched.collect())) == [(1, "anabela souza"), (2, "ana"), (3, "anabel")]
    text = matched._jdf.queryExecution().optimizedPlan().toString()
    # Two bitmaps: of beginnings where a piece may start, then of whole names.
    assert text.count("scalar-subquery") >= 4 and text.count("shiftrightunsigned") >= 4


def test_bitmaps_of_many_values_are_larger(spark):
    from portolan.functions import membership

    assert [membership.place_bits(n) for n in (0, 1, 10**6, 2 * 10**6, 10**9)] == [23, 23, 23, 24, 26]
    some = spark.range(0, 3000, 3)
    for bits in (23, 25):
        got = spark.range(3000).where(membership.may_hold(some, "id", bits)(F.col("id"))).count()
        assert 1000 <= got <= 1010


def test_index_files_a_place_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "cargas porto", "f"), (1, "cargas", "f"), (2, None, "f"), (None, "aba", "g")], "doc_id bigint, text string, source string")
    path, merged = str(tmp_path / "a"), str(tmp_path / "b")
    inverted.add(d, path, "x")
    inverted.add(d.where("doc_id = 2"), path, "y")
    inverted.compact(spark, path, merged)
    for where in (path, merged):
        pieces = inverted.read(spark, where, "pieces")
        assert pieces.count() == len("cargas") + len("porto") + len("aba")  # not a row for every length of piece
        posts = inverted.read(spark, where, "postings")
        assert sorted((r["token"], r["key"] or 0, r["tf"]) for r in posts.collect()) == [("aba", 0, 1), ("cargas", 1, 2), ("porto", 1, 1)]
    q = spark.createDataFrame([(1, "a"), (2, "carga rto"), (3, "abab")], "query_id int, query string")
    assert sorted((r["query_id"], r["doc_id"] or 0, r["score"]) for r in inverted.search_many(spark, merged, q).collect()) == [(1, 0, 2), (1, 1, 4), (2, 1, 3)]
