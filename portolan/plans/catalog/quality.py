"""Profiles and data quality, on projections that do hold nulls, copies and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.operators import profile
from portolan.plans.movements import movements, table
from portolan.plans.registry import query


@query("a13_distribution", """
SELECT round_even(avg(l_extendedprice), 6) AS media, round_even(median(l_extendedprice), 6) AS mediana,
 round_even(stddev_samp(l_extendedprice), 6) AS desvio_padrao, min(l_extendedprice) AS minimo, max(l_extendedprice) AS maximo,
 round_even(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round_even(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem""")
def distribution(spark, d):
    return profile.distribution(table(spark, d, "lineitem"), "l_extendedprice")


def _describe_sql(column, source):
    return f"""SELECT '{column}' AS coluna, count({column}) AS n, round_even(avg({column}), 4) AS media,
 round_even(stddev_samp({column}), 4) AS desvio_padrao, CAST(min({column}) AS DOUBLE) AS minimo, CAST(max({column}) AS DOUBLE) AS maximo,
 round_even(quantile_cont(CAST({column} AS DOUBLE), 0.25), 4) AS q1, round_even(quantile_cont(CAST({column} AS DOUBLE), 0.5), 4) AS mediana,
 round_even(quantile_cont(CAST({column} AS DOUBLE), 0.75), 4) AS q3 FROM {source}"""


@query("a14_describe", " UNION ALL ".join(
    _describe_sql(c, "lineitem") for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_suppkey")))
def describe(spark, d):
    return profile.describe(table(spark, d, "lineitem").select(
        "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_suppkey", "l_returnflag"))


@query("a14_shape", "SELECT count(*) AS linhas, 5 AS colunas FROM customer")
def shape(spark, d):
    return profile.table_shape(table(spark, d, "customer"))


@query("a14_first_rows", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def first_rows(spark, d):
    clients = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return profile.first_rows(clients, [F.desc("c_acctbal"), "c_custkey"])


def _profile_sql(column, kind, source):
    return f"""SELECT '{column}' AS coluna, '{kind}' AS tipo, count({column}) AS preenchidos, count(DISTINCT {column}) AS distintos,
 (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM {source} WHERE {column} IS NOT NULL ORDER BY v LIMIT 5)) AS exemplos
 FROM {source}"""


@query("a15_column_profile", "WITH @m, x AS (SELECT cliente, nullif(mes, 3) AS mes, tipo_operacao, qtd_container, data_embarque FROM m) "
       + " UNION ALL ".join(_profile_sql(c, k, "x") for c, k in (
           ("cliente", "string"), ("mes", "int"), ("tipo_operacao", "string"), ("qtd_container", "double"), ("data_embarque", "date"))))
def column_profile(spark, d):
    rows = movements(spark, d, "cliente", "mes", "tipo_operacao", "qtd_container", "data_embarque")
    return profile.column_profile(rows.withColumn("mes", F.nullif("mes", F.lit(3))))


@query("a16_quantity_totals", """
WITH @m, x AS (SELECT qtd_container, teus, CASE WHEN l_linenumber = 2 THEN 'n/d' ELSE CAST(qtd_container AS VARCHAR) END AS volumes FROM m)
SELECT 'qtd_container' AS coluna, sum(qtd_container) AS total, sum(qtd_container) / count(qtd_container) AS media, count(qtd_container) AS validos FROM x
UNION ALL SELECT 'teus', sum(teus), sum(teus) / count(teus), count(teus) FROM x
UNION ALL SELECT 'volumes', sum(TRY_CAST(volumes AS DOUBLE)), sum(TRY_CAST(volumes AS DOUBLE)) / count(TRY_CAST(volumes AS DOUBLE)), count(TRY_CAST(volumes AS DOUBLE)) FROM x""")
def quantity_totals(spark, d):
    rows = movements(spark, d, "qtd_container", "teus", "l_linenumber")
    text = F.when(F.col("l_linenumber") == 2, "n/d").otherwise(F.col("qtd_container").cast("string"))
    return profile.quantity_totals(rows.withColumn("volumes", text), ["qtd_container", "teus", "volumes"])


@query("a20_duplicates", """
WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_quantity) SELECT CAST(sum(c - 1) AS BIGINT) AS duplicados FROM g""")
def duplicates(spark, d):
    return profile.duplicate_rows(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"))


_SKEWED_SQL = "s AS (SELECT CASE WHEN l_quantity > 47 THEN l_quantity * 10 ELSE l_quantity END AS qtd_container FROM lineitem)"


def _skewed(column="l_quantity"):
    return F.when(F.col(column) > 47, F.col(column) * 10).otherwise(F.col(column))


@query("a21_outliers", f"""
WITH {_SKEWED_SQL}, q AS (SELECT quantile_cont(qtd_container, 0.25) AS q1, quantile_cont(qtd_container, 0.75) AS q3 FROM s),
c AS (SELECT count(*) FILTER (qtd_container < q1 - 1.5*(q3-q1) OR qtd_container > q3 + 1.5*(q3-q1)) AS outliers, count(*) AS registros FROM s, q)
SELECT outliers, registros, outliers > registros * 0.05 AS excede_5pct FROM c""")
def outliers(spark, d):
    return profile.outliers(table(spark, d, "lineitem").select(_skewed().alias("qtd_container")))


_DIRTY_SQL = """x AS (SELECT CASE WHEN qtd_container > 47 THEN qtd_container * 10 ELSE qtd_container END AS qtd_container,
 nullif(cliente, 'Customer#000000001') AS cliente,
 CASE WHEN l_linenumber = 7 THEN '98-3' WHEN l_linenumber = 6 THEN NULL ELSE CAST(ano_mes AS VARCHAR) END AS ano_mes,
 CASE WHEN l_linenumber <= 3 THEN armador END AS armador FROM m)"""


def _dirty(spark, d):
    rows = movements(spark, d, "qtd_container", "cliente", "l_linenumber", "ano_mes", "armador")
    line = F.col("l_linenumber")
    return rows.select(
        _skewed("qtd_container").alias("qtd_container"),
        F.nullif("cliente", F.lit("Customer#000000001")).alias("cliente"),
        F.when(line == 7, "98-3").when(line == 6, None).otherwise(F.col("ano_mes").cast("string")).alias("ano_mes"),
        F.when(line <= 3, F.col("armador")).alias("armador"),
    )


_SCORE_SQL = f"""{_DIRTY_SQL}, g AS (SELECT count(*) AS c FROM x GROUP BY ALL),
q AS (SELECT quantile_cont(qtd_container, 0.25) AS q1, quantile_cont(qtd_container, 0.75) AS q3 FROM x),
r AS (SELECT (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM x GROUP BY qtd_container, cliente, ano_mes, armador)) AS duplicados,
 count(*) FILTER (length(coalesce(ano_mes, 'nan')) <> 6) AS periodos_invalidos,
 count(*) FILTER (qtd_container < q1 - 1.5*(q3-q1) OR qtd_container > q3 + 1.5*(q3-q1)) AS outliers, count(*) AS n,
 (count(qtd_container)*100.0/count(*) + count(cliente)*100.0/count(*) + count(ano_mes)*100.0/count(*) + count(armador)*100.0/count(*)) / 4 AS completude FROM x, q),
z AS (SELECT CAST(100 - CASE WHEN duplicados > 0 THEN 10 ELSE 0 END - CASE WHEN periodos_invalidos > 0 THEN 15 ELSE 0 END
 - CASE WHEN outliers > n * 0.05 THEN 5 ELSE 0 END - CASE WHEN completude < 90 THEN 20 ELSE 0 END AS INTEGER) AS score, * FROM r)"""


@query("a22_completeness", f"""
WITH @m, {_DIRTY_SQL} SELECT (count(qtd_container)*100.0/count(*) + count(cliente)*100.0/count(*) + count(ano_mes)*100.0/count(*)
 + count(armador)*100.0/count(*)) / 4 AS completude FROM x""")
def completeness(spark, d):
    return profile.completeness(_dirty(spark, d))


@query("a23_quality_score", f"""
WITH @m, {_SCORE_SQL} SELECT score, duplicados, periodos_invalidos, outliers, round_even(completude, 6) AS completude FROM z""")
def quality_score(spark, d):
    return profile.quality_score(_dirty(spark, d))


@query("a24_integrity", f"""
WITH @m, {_DIRTY_SQL}, y AS (SELECT *, CASE WHEN armador IS NULL THEN -qtd_container ELSE qtd_container END AS q FROM x)
SELECT count(*) AS total_records, count(*) FILTER (q IS NULL) AS nulos_qtd_container, count(*) FILTER (cliente IS NULL) AS nulos_cliente,
 count(*) FILTER (ano_mes IS NULL) AS nulos_ano_mes, count(*) FILTER (q < 0) AS negativos, min(ano_mes) AS periodo_min,
 max(ano_mes) AS periodo_max, count(DISTINCT cliente) AS unique_clients, '' AS colunas_ausentes, true AS valid FROM y""")
def integrity(spark, d):
    rows = _dirty(spark, d)
    signed = F.when(F.col("armador").isNull(), -F.col("qtd_container")).otherwise(F.col("qtd_container"))
    return profile.integrity(rows.withColumn("qtd_container", signed))


@query("a25_security_score", f"""
WITH @m, {_SCORE_SQL} SELECT least(100.0, (score + 100) / 2.0)::DOUBLE AS security_score, score, true AS valid FROM z""")
def security_score(spark, d):
    return profile.security_score(_dirty(spark, d))
