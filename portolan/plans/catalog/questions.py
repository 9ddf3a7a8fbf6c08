"""Questions and conversations as tables; the questions are derived from the orders."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from portolan.operators import conversations, questions
from portolan.operators.filters import FilterSet
from portolan.operators.sets import distinct_values
from portolan.plans.movements import MOVEMENTS_SQL, movements, table
from portolan.plans.registry import query
from portolan.session import stored

NAMES = [n for n in questions.MONTHS if len(n) > 3]
SHORT = [n for n in questions.MONTHS if len(n) == 3]


def _questions(spark, d):
    orders, clients = table(spark, d, "orders"), table(spark, d, "customer")
    year, month = F.year("o_orderdate") + 20, F.month("o_orderdate")
    names, short = F.array(*[F.lit(n) for n in NAMES]), F.array(*[F.lit(n) for n in SHORT])
    name = F.element_at(names, month)
    other = F.element_at(names, (F.col("o_orderkey") % 12).cast("int") + 1)
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Quantos containers do cliente "), "c_name", F.lit(" em "), name, F.lit(" de "), year, F.lit("?")))
        .when(kind == 1, F.concat(F.lit("Compare a exportação entre "), name, F.lit(" de "), year, F.lit(" e "), other, F.lit(" de "), year + 1))
        .when(kind == 2, F.concat(F.lit("Quais os principais armadores no porto NATION_"), F.col("o_custkey") % 25, F.lit(" em "), year))
        .when(kind == 3, F.lit("Qual a evolução da IMPORTAÇÃO nos últimos meses"))
        .otherwise(F.concat(F.lit("Total de importação em "), F.element_at(short, month), F.lit("/"), year)))
    return orders.join(clients, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), text.alias("pergunta"))


QUESTIONS = f"""qs AS (SELECT o_orderkey AS id, CASE o_orderkey % 5
 WHEN 0 THEN 'Quantos containers do cliente ' || c_name || ' em ' || ({NAMES!r})[month(o_orderdate)] || ' de ' || (year(o_orderdate) + 20) || '?'
 WHEN 1 THEN 'Compare a exportação entre ' || ({NAMES!r})[month(o_orderdate)] || ' de ' || (year(o_orderdate) + 20) || ' e ' || ({NAMES!r})[o_orderkey % 12 + 1] || ' de ' || (year(o_orderdate) + 21)
 WHEN 2 THEN 'Quais os principais armadores no porto NATION_' || (o_custkey % 25) || ' em ' || (year(o_orderdate) + 20)
 WHEN 3 THEN 'Qual a evolução da IMPORTAÇÃO nos últimos meses'
 ELSE 'Total de importação em ' || ({SHORT!r})[month(o_orderdate)] || '/' || (year(o_orderdate) + 20) END AS pergunta
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _any(words):
    return "(" + " OR ".join(f"contains(lower(pergunta), '{w}')" for w in words) + ")"


INTENT = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in questions.INTENT_WORDS.items()) + " ELSE 'total' END"
YEAR_OF = "TRY_CAST(nullif(regexp_extract(pergunta, '\\b(20[0-9]{2})\\b', 1), '') AS INTEGER)"
MONTH_OF = "CASE " + " ".join(
    f"WHEN list_contains(regexp_split_to_array(strip_accents(lower(pergunta)), '[^a-z0-9]+'), '{n.replace('ç', 'c')}') THEN {v}"
    for n, v in questions.MONTHS.items()) + " END"
DATED = f"dt AS (SELECT *, {INTENT} AS tipo, {YEAR_OF} AS y, CAST({MONTH_OF} AS INTEGER) AS mo FROM qs)"
SINGLE = "CASE WHEN y IS NOT NULL AND mo IS NOT NULL THEN make_date(y, mo, 1) END"
MONTH_MAP = "mm(w, mo) AS (VALUES " + ", ".join(f"('{n.replace('ç', 'c')}', {v})" for n, v in questions.MONTHS.items()) + ")"
PERIODS = f"""{MONTH_MAP}, wd AS (SELECT id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT id, regexp_split_to_array(trim(strip_accents(lower(pergunta))), '\\s+') AS ws FROM qs)),
pr AS (SELECT DISTINCT a.id, make_date(CAST(regexp_extract(b.w, '\\b(20[0-9]{{2}})\\b', 1) AS INTEGER), mm.mo, 1) AS dia FROM wd a JOIN mm ON a.w = mm.w JOIN wd b ON a.id = b.id AND abs(a.i - b.i) <= 2
 WHERE regexp_matches(b.w, '^20[0-9]{{2}}') AND regexp_extract(b.w, '\\b(20[0-9]{{2}})\\b', 1) <> ''),
pd AS (SELECT id, min(dia) AS a, max(dia) AS z FROM pr GROUP BY id HAVING count(*) >= 2),
pe AS (SELECT dt.id, coalesce(pd.a, CAST({SINGLE} - INTERVAL 1 MONTH AS DATE)) AS inicio, coalesce(pd.z, {SINGLE}) AS fim FROM dt LEFT JOIN pd USING (id))"""


@query("n1_intent", f"WITH {QUESTIONS} SELECT id, {INTENT} AS tipo_analise FROM qs")
def intent(spark, d):
    return _questions(spark, d).select("id", questions.intent(F.col("pergunta")).alias("tipo_analise"))


@query("n2_dates", f"WITH {QUESTIONS}, {DATED} SELECT id, y AS ano, mo AS mes, {SINGLE} AS data FROM dt")
def dates(spark, d):
    q = F.col("pergunta")
    return _questions(spark, d).select(
        "id", questions.year_of(q).alias("ano"), questions.month_of(q).alias("mes"), questions.date_of(q).alias("data"))


@query("n3_comparison_period", f"WITH {QUESTIONS}, {DATED}, {PERIODS} SELECT id, inicio, fim FROM pe")
def comparison_period(spark, d):
    period = questions.comparison_period(F.col("pergunta"))
    return _questions(spark, d).select("id", period.alias("p")).select("id", "p.inicio", "p.fim")


def _entity_sql(name, table_name, column):
    return f"""{name} AS (SELECT id, arg_min(e, (-length(e), e)) AS e FROM qn JOIN (SELECT DISTINCT lower({column}) AS e FROM {table_name}) ON contains(n, e) GROUP BY id)"""


ENTITIES = "qn AS MATERIALIZED (SELECT id, strip_accents(lower(pergunta)) AS n FROM qs), " + _entity_sql("ec", "customer", "c_name") + ", " + _entity_sql("ep", "nation", "n_name")


def _clients(spark, d):
    return distinct_values(table(spark, d, "customer"), ["c_name"])


def _ports(spark, d):
    return distinct_values(table(spark, d, "nation"), ["n_name"])


@query("n4_entities", f"WITH {QUESTIONS}, {ENTITIES} SELECT id, ec.e AS cliente, ep.e AS porto FROM qs LEFT JOIN ec USING (id) LEFT JOIN ep USING (id)")
def entities(spark, d):
    asked = _questions(spark, d)
    named = questions.match_all(asked, {"cliente": _clients(spark, d), "porto": _ports(spark, d)}, "id", "pergunta")
    return asked.select("id").join(named, "id", "left")


@query("j3_entity_match", f"WITH {QUESTIONS}, {ENTITIES} SELECT id, e AS entidade FROM ec")
def entity_match(spark, d):
    return questions.match_entities(_questions(spark, d), _clients(spark, d), "id", "pergunta")


CATEGORY = """CASE WHEN regexp_matches(strip_accents(lower(pergunta)), '\\bimporta') THEN 'importacao' WHEN regexp_matches(strip_accents(lower(pergunta)), '\\bexporta') THEN 'exportacao' END"""


@query("n5_operation", f"WITH {QUESTIONS} SELECT id, {CATEGORY} AS categoria FROM qs")
def operation(spark, d):
    return _questions(spark, d).select("id", questions.category_of(F.col("pergunta")).alias("categoria"))


@query("n6_filters", f"""
WITH {QUESTIONS}, {DATED}, {PERIODS}, {ENTITIES}
SELECT dt.id, tipo AS tipo_analise, ec.e AS cliente, ep.e AS porto, {CATEGORY} AS categoria, CASE WHEN tipo <> 'comparacao' THEN y END AS ano,
 CASE WHEN tipo <> 'comparacao' AND y IS NOT NULL THEN mo END AS mes, CASE WHEN tipo = 'comparacao' THEN inicio END AS data_inicio, CASE WHEN tipo = 'comparacao' THEN fim END AS data_fim
FROM dt JOIN pe USING (id) LEFT JOIN ec USING (id) LEFT JOIN ep USING (id)""")
def filters(spark, d):
    return questions.question_filters(_questions(spark, d), _clients(spark, d), _ports(spark, d), "id", "pergunta")


@query("n7_total", """
WITH @m SELECT CAST(sum(qtd_container) AS BIGINT) AS total_containers FROM m WHERE cliente = 'Customer#000000010' AND ano = 1998""")
def answer_total(spark, d):
    rows = movements(spark, d, "cliente", "ano", "qtd_container", start="1998-01-01", end="1999-01-01").withColumnRenamed(
        "qtd_container", "QTDE CONTAINER")
    return questions.answer(rows, "total", FilterSet(cliente="customer#000000010", ano=1998))


@query("n7_month_total", """
WITH @m SELECT CAST(sum(qtd_container) AS BIGINT) AS total_containers FROM m WHERE tipo_operacao = 'importacao' AND ano = 1998 AND mes = 3""")
def answer_month_total(spark, d):
    rows = movements(spark, d, "tipo_operacao", "ano", "mes", "qtd_container", start="1998-03-01", end="1998-04-01").withColumnRenamed(
        "qtd_container", "QTDE CONTAINER")
    return questions.answer(rows, "total", FilterSet(categoria="importação", ano=1998, mes=3))


@query("n7_comparison", """
WITH @m, r AS (SELECT tipo_operacao, ano_mes, qtd_container FROM m WHERE tipo_operacao = 'exportacao' AND ano_mes IN (199801, 199802)),
c AS (SELECT coalesce(tipo_operacao, 'total') AS categoria, CAST(coalesce(sum(qtd_container) FILTER (ano_mes = 199801), 0) AS BIGINT) AS total1,
 CAST(coalesce(sum(qtd_container) FILTER (ano_mes = 199802), 0) AS BIGINT) AS total2 FROM r GROUP BY GROUPING SETS ((), (tipo_operacao)))
SELECT categoria, total1, total2, total2 - total1 AS diferenca, CASE WHEN total1 > 0 THEN CAST(total2 - total1 AS DOUBLE) * 100 / total1 WHEN total2 = 0 THEN 0 END AS variacao FROM c""")
def answer_comparison(spark, d):
    rows = movements(spark, d, "tipo_operacao", "ano_mes", "qtd_container", start="1998-01-01", end="1998-03-01").withColumnRenamed(
        "qtd_container", "QTDE CONTAINER")
    return questions.answer(rows, "comparacao", FilterSet(categoria="exportação", data_inicio=199801, data_fim=199802))


@query("n7_ranking", """
WITH @m, f AS (SELECT * FROM m WHERE (lower(porto_descarga) = 'nation_5' OR lower(porto_embarque) = 'nation_5') AND ano = 1998),
t AS (SELECT armador, CAST(sum(qtd_container) AS BIGINT) AS total FROM f GROUP BY armador), g AS (SELECT CAST(sum(qtd_container) AS BIGINT) AS total_geral FROM f),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, armador) AS INTEGER) AS posicao FROM t)
SELECT posicao, armador, total, CAST(sum(total) OVER () AS DOUBLE) * 100.0 / total_geral AS percentual_top, total_geral FROM r, g WHERE posicao <= 5""")
def answer_ranking(spark, d):
    rows = movements(spark, d, "armador", "porto_descarga", "porto_embarque", "ano", "qtd_container", start="1998-01-01", end="1999-01-01")
    return questions.answer(rows.withColumnRenamed("qtd_container", "QTDE CONTAINER"), "ranking", FilterSet(porto="NATION_5", ano=1998))


@query("n7_trend", """
WITH @m, t AS (SELECT ano_mes, trunc(sum(qtd_container)) AS total FROM m WHERE cliente = 'Customer#000000010' GROUP BY 1),
l AS (SELECT * FROM t ORDER BY ano_mes DESC LIMIT 3),
v AS (SELECT (total - lag(total) OVER w) * 100.0 / lag(total) OVER w AS x, lag(total) OVER w AS p FROM l WINDOW w AS (ORDER BY ano_mes)),
a AS (SELECT avg(x) FILTER (p > 0) AS mean FROM v)
SELECT CASE WHEN mean > 5 THEN 'CRESCIMENTO SIGNIFICATIVO' WHEN mean > 0 THEN 'CRESCIMENTO MODERADO' WHEN mean < -5 THEN 'QUEDA SIGNIFICATIVA'
 WHEN mean < 0 THEN 'QUEDA MODERADA' WHEN mean = 0 THEN 'ESTÁVEL' END AS tendencia, round_even(mean, 6) AS variacao_media FROM a""")
def answer_trend(spark, d):
    rows = movements(spark, d, "cliente", "ano_mes", "qtd_container").withColumnRenamed("qtd_container", "QTDE CONTAINER")
    return questions.answer(rows, "tendencia", FilterSet(cliente="CUSTOMER#000000010"))


@query("n7_top_client_at_port", """
WITH @m, f AS (SELECT * FROM m WHERE tipo_operacao = 'importacao' AND ano = 1998 AND mes = 2 AND (contains(lower(porto_descarga), 'nation_5') OR contains(lower(porto_embarque), 'nation_5'))),
u AS (SELECT cliente AS nome, qtd_container FROM f UNION ALL SELECT exportador, qtd_container FROM f)
SELECT nome AS empresa, sum(qtd_container) AS total FROM u GROUP BY 1 ORDER BY total DESC, empresa LIMIT 1""")
def top_client_at_port(spark, d):
    from portolan.operators.filters import apply_filters, filter_port
    from portolan.operators.ranking import top_company

    rows = movements(spark, d, "cliente", "exportador", "porto_descarga", "porto_embarque", "tipo_operacao", "ano", "mes",
                     "qtd_container", start="1998-02-01", end="1998-03-01")
    found = filter_port(apply_filters(rows, FilterSet(categoria="importação", ano=1998, mes=2)), "NATION_5")
    return top_company(found, ["cliente", "exportador"])


def _batch_sql():
    """Totals by every set of filters, each by equality joins."""
    names = ("cliente", "porto", "categoria", "ano", "mes")
    parts = []
    for kind in itertools.product((False, True), repeat=len(names)):
        used = [n for n, on in zip(names, kind) if on]
        want = " AND ".join(f"a.{n} IS {'NOT ' if n in used else ''}NULL" for n in names)
        source = "mp" if "porto" in used else "mq"
        group = f"SELECT {', '.join([*used, 'sum(q) AS t'])} FROM {source}" + (f" GROUP BY {', '.join(used)}" if used else "")
        on = " AND ".join(f"a.{n} = g.{n}" for n in used) or "true"
        parts.append(f"SELECT a.id, a.tipo_analise, a.parte, CAST(coalesce(g.t, 0) AS DOUBLE) AS total FROM ap a LEFT JOIN ({group}) g ON {on} WHERE {want}")
    return " UNION ALL ".join(parts)


@query("n7_batch", f"""
WITH {QUESTIONS}, {DATED}, {PERIODS}, {ENTITIES}, {MOVEMENTS_SQL},
fl AS (SELECT dt.id, tipo AS tipo_analise, ec.e AS cliente, ep.e AS porto, {CATEGORY} AS categoria, y, mo, inicio, fim FROM dt JOIN pe USING (id) LEFT JOIN ec USING (id) LEFT JOIN ep USING (id)),
ap AS (SELECT id, tipo_analise, 'total' AS parte, cliente, porto, categoria, y AS ano, CASE WHEN y IS NOT NULL THEN mo END AS mes FROM fl WHERE tipo_analise IS DISTINCT FROM 'comparacao'
 UNION ALL SELECT id, tipo_analise, 'inicio', cliente, porto, categoria, year(inicio), month(inicio) FROM fl WHERE tipo_analise = 'comparacao'
 UNION ALL SELECT id, tipo_analise, 'fim', cliente, porto, categoria, year(fim), month(fim) FROM fl WHERE tipo_analise = 'comparacao'),
mq AS (SELECT lower(cliente) AS cliente, tipo_operacao AS categoria, ano + 20 AS ano, mes, lower(porto_embarque) AS pe, lower(porto_descarga) AS pd, sum(qtd_container) AS q FROM m GROUP BY ALL),
mp AS (SELECT cliente, categoria, ano, mes, pe AS porto, q FROM mq UNION ALL SELECT cliente, categoria, ano, mes, pd, q FROM mq WHERE pd <> pe)
{_batch_sql()}""")
def batch(spark, d):
    """Every question of the table answered by its totals; the questions speak of years 20 later."""
    rows = movements(spark, d, "cliente", "porto_embarque", "porto_descarga", "tipo_operacao", "ano", "mes", "qtd_container").withColumn("ano", F.col("ano") + 20)
    asked = questions.question_filters(_questions(spark, d), _clients(spark, d), _ports(spark, d), "id", "pergunta")
    return questions.answer_totals(stored(asked, "n7"), stored(rows, "n7"), "id")  # read once per kind of question


def _cube_sql(name, detail):
    """Sums by any set of filters, and by one more column; a movement counts under both its ports, or under none if ports are left open."""
    group = f"porto, CUBE (cliente, categoria, ano, mes){f', {detail}' if detail else ''}"
    return f"{name} AS (SELECT cliente, porto, categoria, ano, mes, {f'{detail} AS detalhe, ' if detail else ''}GROUPING(cliente, categoria, ano, mes) AS g, sum(q) AS t FROM mx GROUP BY {group})"


MEETS = "ON a.g = c.g AND a.cliente IS NOT DISTINCT FROM c.cliente AND a.porto IS NOT DISTINCT FROM c.porto AND a.categoria IS NOT DISTINCT FROM c.categoria AND a.ano IS NOT DISTINCT FROM c.ano AND a.mes IS NOT DISTINCT FROM c.mes"


@query("n7_batch_answers", f"""
WITH {QUESTIONS}, {DATED}, {PERIODS}, {ENTITIES}, {MOVEMENTS_SQL},
fl AS (SELECT dt.id, tipo AS tipo_analise, lower(ec.e) AS cliente, lower(ep.e) AS porto, {CATEGORY} AS categoria, y, mo, inicio, fim FROM dt JOIN pe USING (id) LEFT JOIN ec USING (id) LEFT JOIN ep USING (id)),
aq AS (SELECT id, tipo_analise, 0 AS lado, cliente, porto, categoria, y AS ano, CASE WHEN y IS NOT NULL THEN mo END AS mes FROM fl WHERE tipo_analise IS DISTINCT FROM 'comparacao'
 UNION ALL SELECT id, tipo_analise, lado, cliente, porto, categoria, year(dia), month(dia) FROM (SELECT *, unnest([0, 1]) AS lado, unnest([inicio, fim]) AS dia FROM fl WHERE tipo_analise = 'comparacao' AND inicio IS NOT NULL AND fim IS NOT NULL)),
a AS MATERIALIZED (SELECT *, (cliente IS NULL)::INT * 8 + (categoria IS NULL)::INT * 4 + (ano IS NULL)::INT * 2 + (mes IS NULL)::INT AS g FROM aq),
mq AS (SELECT lower(cliente) AS cliente, tipo_operacao AS categoria, ano + 20 AS ano, mes, armador AS nome, lower(porto_embarque) AS pe, lower(porto_descarga) AS pd, sum(qtd_container) AS q FROM m GROUP BY ALL),
mx AS MATERIALIZED (SELECT cliente, x.porto, categoria, ano, mes, nome, ano * 100 + mes AS periodo, categoria AS tipo, q FROM (SELECT *, unnest(list_distinct([pe, pd])) AS porto FROM mq) x
 UNION ALL SELECT cliente, NULL, categoria, ano, mes, nome, ano * 100 + mes, categoria, q FROM mq),
{_cube_sql('cg', None)}, {_cube_sql('cn', 'nome')}, {_cube_sql('cp', 'periodo')}, {_cube_sql('ct', 'tipo')},
rk AS (SELECT a.id, c.detalhe AS nome, c.t, row_number() OVER (PARTITION BY a.id ORDER BY c.t DESC, c.detalhe) AS p FROM a JOIN cn c {MEETS} WHERE tipo_analise = 'ranking' QUALIFY p <= 5),
rg AS (SELECT a.id, c.t FROM a JOIN cg c {MEETS} WHERE tipo_analise = 'ranking'),
tr AS (SELECT a.id, c.detalhe AS periodo, c.t FROM a JOIN cp c {MEETS} WHERE tipo_analise = 'tendencia' QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY c.detalhe DESC) <= 3),
tv AS (SELECT *, row_number() OVER w AS p, lag(t) OVER w AS anterior FROM tr WINDOW w AS (PARTITION BY id ORDER BY periodo)),
tw AS (SELECT *, CASE WHEN anterior > 0 THEN (t - anterior) * 100.0 / anterior END AS variacao FROM tv), tm AS (SELECT *, avg(variacao) OVER (PARTITION BY id) AS media FROM tw),
cx AS (SELECT a.id, NULL AS tipo, lado, c.t FROM a LEFT JOIN cg c {MEETS} WHERE tipo_analise = 'comparacao' UNION ALL SELECT a.id, c.detalhe, lado, c.t FROM a JOIN ct c {MEETS} WHERE tipo_analise = 'comparacao'),
cy AS (SELECT id, tipo, coalesce(sum(t) FILTER (lado = 0), 0) AS um, coalesce(sum(t) FILTER (lado = 1), 0) AS dois FROM cx GROUP BY id, tipo)
SELECT a.id, tipo_analise, 1 AS posicao, 'total' AS chave, NULL::DOUBLE AS anterior, CAST(coalesce(c.t, 0) AS DOUBLE) AS total, NULL::DOUBLE AS variacao, NULL::DOUBLE AS percentual, NULL::DOUBLE AS media, NULL::VARCHAR AS rotulo
 FROM a LEFT JOIN cg c {MEETS} WHERE tipo_analise = 'total'
UNION ALL SELECT rk.id, 'ranking', CAST(p AS INTEGER), nome, NULL, CAST(rk.t AS DOUBLE), NULL, round_even(CAST(CASE WHEN rg.t > 0 THEN sum(rk.t) OVER (PARTITION BY rk.id) * 100.0 / rg.t END AS DOUBLE), 6), NULL, NULL FROM rk JOIN rg USING (id)
UNION ALL SELECT id, 'tendencia', CAST(p AS INTEGER), CAST(periodo AS VARCHAR), CAST(anterior AS DOUBLE), CAST(t AS DOUBLE), round_even(CAST(variacao AS DOUBLE), 6), NULL, round_even(CAST(media AS DOUBLE), 6),
 CASE WHEN media > 5 THEN 'CRESCIMENTO SIGNIFICATIVO' WHEN media > 0 THEN 'CRESCIMENTO MODERADO' WHEN media < -5 THEN 'QUEDA SIGNIFICATIVA' WHEN media < 0 THEN 'QUEDA MODERADA' WHEN media = 0 THEN 'ESTÁVEL' END FROM tm
UNION ALL SELECT id, 'comparacao', CAST(row_number() OVER (PARTITION BY id ORDER BY tipo NULLS FIRST) AS INTEGER), coalesce(tipo, 'geral'), CAST(um AS DOUBLE), CAST(dois AS DOUBLE),
 round_even(CAST(CASE WHEN um > 0 THEN (dois - um) * 100.0 / um WHEN dois = 0 THEN 0 END AS DOUBLE), 6), NULL, NULL, NULL FROM cy WHERE tipo IS NULL OR um > 0 OR dois > 0""")
def batch_answers(spark, d):
    """Every question of the table answered by its intent; the questions speak of years 20 later."""
    rows = movements(spark, d, "cliente", "armador", "porto_embarque", "porto_descarga", "tipo_operacao", "ano", "mes", "qtd_container").withColumn("ano", F.col("ano") + 20)
    asked = questions.question_filters(_questions(spark, d), _clients(spark, d), _ports(spark, d), "id", "pergunta")
    found = questions.answers(stored(asked, "n7"), stored(rows, "n7"), "id")
    return found.withColumns({c: F.bround(c, 6) for c in ("variacao", "percentual", "media")})


@query("n8_titles", """
WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS t FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN role = 'user' THEN CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END END AS titulo FROM f""")
def titles(spark, d):
    return conversations.titles(table(spark, d, "conversations"))


@query("n9_messages", "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn")
def messages(spark, d):
    return conversations.ordered_messages(table(spark, d, "conversations"))


@query("n9_append", """
WITH n AS (SELECT conv_id, 'user' AS role, 'resumo ' || role AS text, turn AS ordem FROM conversations WHERE role <> 'user'
 UNION ALL SELECT max(conv_id) + 1, 'user', 'nova conversa', 0 FROM conversations),
l AS (SELECT conv_id, max(turn) AS u FROM conversations GROUP BY 1)
SELECT conv_id, turn, role, text FROM conversations UNION ALL
SELECT n.conv_id, coalesce(u, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY ordem), role, text FROM n LEFT JOIN l ON n.conv_id = l.conv_id""")
def append(spark, d):
    chats = table(spark, d, "conversations")
    answers = chats.where("role <> 'user'").select(
        "conv_id", F.lit("user").alias("role"), F.concat(F.lit("resumo "), "role").alias("text"), F.col("turn").alias("ordem"))
    fresh = chats.agg((F.max("conv_id") + 1).alias("conv_id")).select(
        "conv_id", F.lit("user").alias("role"), F.lit("nova conversa").alias("text"), F.lit(0).cast("bigint").alias("ordem"))
    return conversations.append_messages(chats, answers.unionByName(fresh))


@query("k9_list_conversations", """
WITH c AS (SELECT conv_id % 7 AS user_id, conv_id, to_timestamp(1704067200 + conv_id * 37 % 1000 * 3600 + turn * 60)::TIMESTAMP AS ts, turn, role, text FROM conversations),
h AS (SELECT user_id, conv_id, max(ts) AS updated_at, count(*) AS message_count, arg_min(role, turn) AS role, arg_min(text, turn) AS t FROM c GROUP BY ALL)
SELECT user_id, conv_id, CASE WHEN role = 'user' THEN CASE WHEN length(t) > 50 THEN left(t, 50) || '...' ELSE t END END AS titulo, updated_at, message_count FROM h
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id) <= 50""")
def list_conversations(spark, d):
    seconds = F.lit(1704067200) + F.col("conv_id") * 37 % 1000 * 3600 + F.col("turn") * 60
    chats = table(spark, d, "conversations").withColumns({
        "user_id": F.col("conv_id") % 7, "timestamp": F.timestamp_seconds(seconds).cast("timestamp_ntz")})
    return conversations.list_conversations(chats)


@query("k10_last_messages", """
SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5""")
def last_messages(spark, d):
    return conversations.last_messages(table(spark, d, "conversations"))


@query("a29_conversation_statistics", "SELECT count(DISTINCT conv_id) AS total_conversations, count(*) AS total_messages FROM conversations")
def statistics(spark, d):
    return conversations.statistics(table(spark, d, "conversations"))
