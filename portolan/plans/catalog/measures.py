"""Totals, KPI blocks, budget performance and summaries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from portolan.operators import aggregates as agg
from portolan.plans.movements import movements
from portolan.plans.registry import query

AS_OF = datetime.date(1998, 6, 15)


def _headers(spark, d):
    """Movements under raw headers, with size columns filled in some years only."""
    ano = F.col("ano")
    return movements(spark, d, "ano", "cliente", "c20", "c40", "teus").select(
        "ano", "cliente",
        F.when(ano < 1997, F.col("c20")).otherwise(0.0).cast("string").alias("C20"),
        F.when(ano < 1997, F.col("c40")).otherwise(0.0).cast("string").alias("C40"),
        F.when(ano < 1999, F.regexp_replace(F.col("c20").cast("string"), r"\.", ",")).alias("QUANTIDADE C20"),
        F.when(ano < 1999, F.col("c40")).alias("QUANTIDADE C40"),
        F.col("teus").alias("TEUS"),
    )


_HEADERS_SQL = """h AS (SELECT ano, cliente, CASE WHEN ano < 1997 THEN c20 ELSE 0 END AS c20, CASE WHEN ano < 1997 THEN c40 ELSE 0 END AS c40,
 CASE WHEN ano < 1999 THEN c20 ELSE 0 END AS q20, CASE WHEN ano < 1999 THEN c40 ELSE 0 END AS q40, teus FROM m)"""
_CASCADE_SQL = """CAST(trunc(CASE WHEN sum(c20)+2*sum(c40) <> 0 THEN sum(c20)+2*sum(c40)
 WHEN sum(q20)+2*sum(q40) <> 0 THEN sum(q20)+2*sum(q40) ELSE sum(teus) END) AS BIGINT)"""


@query("a1_container_total", f"WITH @m, {_HEADERS_SQL} SELECT {_CASCADE_SQL} AS total_containers FROM h")
def container_total(spark, d):
    return agg.total_containers(_headers(spark, d))


@query("a1_quantity_column", "WITH @m SELECT CAST(sum(qtd_container) AS BIGINT) AS total_containers FROM m")
def quantity_column(spark, d):
    rows = movements(spark, d, "qtd_container", "c20").select(
        F.regexp_replace(F.col("qtd_container").cast("string"), r"\.", ",").alias("QTDE CONTAINER"), F.col("c20").alias("C20"))
    return agg.total_containers(rows)


@query("a2_container_total_by", f"WITH @m, {_HEADERS_SQL} SELECT ano, {_CASCADE_SQL} AS total_containers FROM h GROUP BY ano")
def container_total_by(spark, d):
    return agg.total_containers_by(_headers(spark, d), "ano")


@query("a3_kpi_block", """
WITH @m, f AS (SELECT * FROM m WHERE ano = 1998 AND contains(lower(cliente), '00001'))
SELECT 'total_containers' AS metrica, '' AS chave, sum(qtd_container) AS valor FROM f
UNION ALL SELECT 'total_operacoes', '', CAST(count(*) AS DOUBLE) FROM f
UNION ALL SELECT 'clientes_unicos', '', CAST(count(DISTINCT cliente) AS DOUBLE) FROM f
UNION ALL SELECT 'por_operacao', tipo_operacao, sum(qtd_container) FROM f GROUP BY tipo_operacao""")
def kpi_block(spark, d):
    rows = movements(spark, d, "cliente", "tipo_operacao", "qtd_container", start="1998-01-01", end="1999-01-01")
    return agg.kpi_block(rows.where(F.contains(F.lower("cliente"), F.lit("00001"))))


_CARDS_SQL = """c AS (SELECT coalesce(sum(qtd_container) FILTER (ano_mes = 199806), 0) AS t,
 count(*) FILTER (ano_mes = 199806) AS n, count(DISTINCT cliente) FILTER (ano_mes = 199806) AS k,
 coalesce(sum(qtd_container) FILTER (ano_mes = 199805), 0) AS p FROM m)"""


@query("a4_kpi_cards", f"""
WITH @m, {_CARDS_SQL} SELECT t AS total_containers, n AS total_operacoes, k AS clientes_unicos,
 coalesce(t / nullif(n, 0), 0) AS media_por_operacao, CASE WHEN p > 0 THEN (t - p) * 100.0 / p ELSE 0 END AS variacao FROM c""")
def kpi_cards(spark, d):
    rows = movements(spark, d, "ano_mes", "cliente", "qtd_container", start="1998-05-01", end="1998-07-01")
    return agg.kpi_cards(rows, AS_OF)


@query("a5_performance", """
WITH @m SELECT 'mensal_atual' AS escopo, '' AS chave, coalesce(sum(qtd_container), 0) AS containers, count(*) AS operacoes,
 count(DISTINCT cliente) AS clientes_unicos FROM m WHERE ano = 1998 AND mes = 6
UNION ALL SELECT 'anual', '', coalesce(sum(qtd_container), 0), count(*), count(DISTINCT cliente) FROM m WHERE ano = 1998
UNION ALL SELECT 'por_operacao', tipo_operacao, sum(qtd_container), count(*), NULL FROM m WHERE ano = 1998 GROUP BY tipo_operacao""")
def performance(spark, d):
    rows = movements(spark, d, "ano", "mes", "cliente", "tipo_operacao", "qtd_container", start="1998-01-01", end="1999-01-01")
    return agg.performance(rows, AS_OF)


@query("a8_sum_by_operation", "WITH @m SELECT tipo_operacao, sum(qtd_container) AS total FROM m GROUP BY tipo_operacao")
def sum_by_operation(spark, d):
    return agg.sum_by(movements(spark, d, "tipo_operacao", "qtd_container"), "tipo_operacao")


@query("a8_sum_by_client", "WITH @m SELECT cliente, sum(qtd_container) AS total FROM m GROUP BY cliente")
def sum_by_client(spark, d):
    return agg.sum_by(movements(spark, d, "cliente", "qtd_container"), "cliente")


@query("a9_client_summary", """
WITH @m SELECT cliente, sum(qtd_container) AS total, count(qtd_container) AS operacoes,
 sum(qtd_container) / count(qtd_container) AS media FROM m GROUP BY cliente""")
def client_summary(spark, d):
    return agg.group_summary(movements(spark, d, "cliente", "qtd_container"))


@query("a10_period_summary", "WITH @m SELECT ano_mes, sum(qtd_container) AS total FROM m GROUP BY ano_mes")
def period_summary(spark, d):
    return agg.sum_by(movements(spark, d, "ano_mes", "qtd_container"), "ano_mes")


@query("a11_monthly", """
WITH @m SELECT ano_mes, sum(qtd_container) AS qtd_container, count(DISTINCT cliente) AS clientes FROM m GROUP BY ano_mes""")
def monthly(spark, d):
    return agg.monthly(movements(spark, d, "ano_mes", "cliente", "qtd_container"))


@query("a12_metric_totals", """
WITH @m SELECT 'VOLUMES' AS metrica, sum(qtd_container) AS total FROM m
UNION ALL SELECT 'PESO BRUTO', CAST(sum(l_linenumber) AS DOUBLE) FROM m""")
def metric_totals(spark, d):
    rows = movements(spark, d, "qtd_container", "l_linenumber").select(
        F.col("qtd_container").alias("VOLUMES"), F.col("l_linenumber").alias("PESO BRUTO"))
    return agg.metric_totals(rows)


@query("a17_value_counts", "WITH @m SELECT porto_descarga AS valor, count(*) AS registros FROM m GROUP BY 1")
def value_counts(spark, d):
    return agg.value_counts(movements(spark, d, "porto_descarga"), "porto_descarga")


@query("a18_share", """
WITH @m, t AS (SELECT tipo_operacao, sum(qtd_container) AS total FROM m GROUP BY 1)
SELECT tipo_operacao, total, total / (SELECT sum(total) FROM t) * 100 AS percentual FROM t""")
def share(spark, d):
    return agg.share_by(movements(spark, d, "tipo_operacao", "qtd_container"), "tipo_operacao")


@query("a19_mean_of_months", """
WITH @m, t AS (SELECT ano_mes, sum(qtd_container) AS total FROM m GROUP BY 1)
SELECT sum(total) / count(*) AS media_mensal, sum(total) AS total FROM t""")
def mean_of_months(spark, d):
    return agg.mean_of_months(movements(spark, d, "ano_mes", "qtd_container"))


@query("a26_period_extent", """
WITH @m SELECT min(data_embarque) AS data_min, max(data_embarque) AS data_max, count(*) AS registros,
 (SELECT string_agg(ano, ',' ORDER BY ano) FROM (SELECT DISTINCT ano FROM m)) AS anos,
 (SELECT string_agg(mes, ',' ORDER BY mes) FROM (SELECT DISTINCT mes FROM m)) AS meses FROM m""")
def period_extent(spark, d):
    return agg.period_extent(movements(spark, d, "data_embarque", "ano", "mes"))


@query("a26_rows_in_year", """
WITH @m SELECT ano, count(*) AS registros, sum(qtd_container) AS total FROM m GROUP BY ano""")
def rows_in_year(spark, d):
    return movements(spark, d, "ano", "qtd_container").groupBy("ano").agg(
        F.count(F.lit(1)).alias("registros"), F.sum("qtd_container").alias("total"))


@query("a27_config_aggregates", """
WITH @m SELECT tipo_operacao, sum(qtd_container) AS sum_qtd_container, sum(teus) AS "sum_TEUS", count(l_orderkey) AS "count_ID",
 count(DISTINCT armador) AS "unique_ARMADOR", min(data_embarque) AS "first_DATA EMBARQUE" FROM m GROUP BY tipo_operacao""")
def config_aggregates(spark, d):
    rows = movements(spark, d, "tipo_operacao", "qtd_container", "teus", "l_orderkey", "armador", "data_embarque").select(
        "tipo_operacao", "qtd_container", F.col("teus").alias("TEUS"), F.col("l_orderkey").alias("ID"),
        F.col("armador").alias("ARMADOR"), F.col("data_embarque").alias("DATA EMBARQUE"))
    return agg.agg_by_config(rows, ["tipo_operacao"], order="`DATA EMBARQUE`")


@query("a28_drill_down", """
WITH @m, u AS (SELECT 'geografica' AS dimensao, 'PORTO' AS coluna, porto_descarga AS valor FROM m
 UNION ALL SELECT 'temporal', 'ANO/MÊS', CAST(ano_mes AS VARCHAR) FROM m
 UNION ALL SELECT 'comercial', 'CLIENTE', cliente FROM m UNION ALL SELECT 'comercial', 'ARMADOR', armador FROM m
 UNION ALL SELECT 'operacional', 'TIPO CARGA', tipo_carga FROM m),
c AS (SELECT dimensao, coluna, valor, count(*) AS registros FROM u GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY coluna ORDER BY registros DESC, valor) AS INTEGER) AS posicao FROM c)
SELECT * FROM r WHERE posicao <= 10""")
def drill_down(spark, d):
    rows = movements(spark, d, "porto_descarga", "ano_mes", "cliente", "armador", "tipo_carga").select(
        F.col("porto_descarga").alias("PORTO"), F.col("ano_mes").alias("ANO/MÊS"), F.col("cliente").alias("CLIENTE"),
        F.col("armador").alias("ARMADOR"), F.col("tipo_carga").alias("TIPO CARGA"))
    return agg.drill_down(rows)


@query("a31_metric_block", f"""
WITH @m, {_CARDS_SQL} SELECT t AS total_containers, k AS clientes_ativos,
 round_even(CASE WHEN p > 0 THEN (t - p) * 100.0 / p ELSE 0 END, 6) AS taxa_crescimento, '1998-06' AS periodo FROM c""")
def metric_block(spark, d):
    rows = movements(spark, d, "ano_mes", "cliente", "qtd_container", start="1998-05-01", end="1998-07-01")
    return agg.metric_block(rows, AS_OF)
