"""Series, forecast, segments and budget."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from portolan.operators import budget, forecast, segments, series
from portolan.operators.aggregates import sum_by
from portolan.plans.movements import movements, table
from portolan.plans.registry import query

AS_OF = datetime.date(1998, 6, 15)
MONTH = "t AS (SELECT ano_mes, sum(qtd_container) AS total FROM m GROUP BY 1)"
DATED = """t AS (SELECT CAST(strptime(CAST(ano_mes AS VARCHAR), '%Y%m') AS DATE) AS periodo, ano_mes, sum(qtd_container) AS total
 FROM m GROUP BY ALL)"""
FILLED = """cal AS (SELECT CAST(unnest(generate_series((SELECT min(periodo) FROM t), (SELECT max(periodo) FROM t), INTERVAL 1 MONTH)) AS DATE) AS periodo),
f AS (SELECT cal.periodo, coalesce(sum(t.total), 0) AS total FROM cal LEFT JOIN t USING (periodo) GROUP BY 1)"""


def _months(spark, d, *more):
    return movements(spark, d, "ano_mes", "qtd_container", *more)


def _gappy(spark, d):
    """A series with empty months: all lines, those of seven months moved to an earlier one."""
    rows = _months(spark, d)
    return rows.withColumn("ano_mes", (F.col("ano_mes") - F.col("ano_mes") % 100 + F.element_at(F.array(*map(F.lit, MOVED)), (F.col("ano_mes") % 100).cast("int"))).cast(rows.schema["ano_mes"].dataType))


# The month that each month's lines are moved to.
MOVED = (1, 2, 1, 2, 5, 6, 5, 6, 9, 9, 9, 9)
GAPPY = f"g AS (SELECT * REPLACE (ano_mes - ano_mes % 100 + {list(MOVED)}[ano_mes % 100] AS ano_mes) FROM m)"


@query("w1_month_features", """
WITH @m, t AS (SELECT ano_mes, sum(qtd_container) AS qtd_container, count(DISTINCT cliente) AS clientes,
 CAST(strptime(CAST(ano_mes AS VARCHAR), '%Y%m') AS DATE) AS data FROM m GROUP BY ano_mes)
SELECT ano_mes, qtd_container, clientes, data, CAST(month(data) AS INTEGER) AS mes, CAST(quarter(data) AS INTEGER) AS trimestre,
 CAST(year(data) AS INTEGER) AS ano, CAST(row_number() OVER (ORDER BY data) - 1 AS INTEGER) AS mes_sequencial FROM t""")
def month_features(spark, d):
    return series.monthly_series(_months(spark, d, "cliente")).drop("ma_3", "ma_6", "tendencia")


@query("w2_moving_average", f"""
WITH @m, {MONTH} SELECT ano_mes,
 round_even(CASE WHEN count(total) OVER a = 3 THEN avg(total) OVER a END, 6) AS ma_3,
 round_even(CASE WHEN count(total) OVER b = 6 THEN avg(total) OVER b END, 6) AS ma_6 FROM t
WINDOW a AS (ORDER BY ano_mes ROWS 2 PRECEDING), b AS (ORDER BY ano_mes ROWS 5 PRECEDING)""")
def moving_average(spark, d):
    rows = series.monthly_series(_months(spark, d, "cliente"))
    return rows.select("ano_mes", F.bround("ma_3", 6).alias("ma_3"), F.bround("ma_6", 6).alias("ma_6"))


@query("w3_difference", f"WITH @m, {MONTH} SELECT ano_mes, total - lag(total) OVER (ORDER BY ano_mes) AS tendencia FROM t")
def difference(spark, d):
    return series.monthly_series(_months(spark, d, "cliente")).select("ano_mes", "tendencia")


def _resample_sql(unit, step):
    return f"""SELECT '{unit}' AS grao, c.periodo, coalesce(sum(x.total), 0) AS total
FROM (SELECT CAST(unnest(generate_series((SELECT min(date_trunc('{unit}', periodo)) FROM t), (SELECT max(date_trunc('{unit}', periodo)) FROM t), INTERVAL {step} MONTH)) AS DATE) AS periodo) c
LEFT JOIN (SELECT CAST(date_trunc('{unit}', periodo) AS DATE) AS p, total FROM t) x ON x.p = c.periodo GROUP BY ALL"""


@query("w4_resample", f"WITH @m, {GAPPY}, {DATED.replace('FROM m', 'FROM g')} " + " UNION ALL ".join(
    _resample_sql(u, s) for u, s in (("month", 1), ("quarter", 3), ("year", 12))))
def resample(spark, d):
    frames = [series.resample(_gappy(spark, d), p).select(F.lit(name).alias("grao"), "periodo", "total")
              for p, name in (("M", "month"), ("Q", "quarter"), ("Y", "year"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("w5_trend_summary", f"""
WITH @m, {GAPPY}, {DATED.replace('FROM m', 'FROM g')}, {FILLED},
r AS (SELECT arg_min(total, periodo) AS a, arg_max(total, periodo) AS z, avg(total) AS media, max(total) AS pico, min(total) AS vale FROM f)
SELECT CASE WHEN z > a THEN 'crescente' ELSE 'decrescente' END AS tendencia, coalesce((z / nullif(a, 0) - 1) * 100, 0) AS variacao_total,
 media AS media_periodo, pico, vale FROM r""")
def trend_summary(spark, d):
    return series.trend_summary(_gappy(spark, d))


@query("w6_last_change", f"""
WITH @m, {MONTH}, r AS (SELECT ano_mes, total, lag(total) OVER (ORDER BY ano_mes) AS anterior FROM t)
SELECT ano_mes, total, anterior, total - anterior AS diferenca, (total - anterior) * 100.0 / nullif(anterior, 0) AS variacao
FROM r ORDER BY ano_mes DESC LIMIT 1""")
def last_change(spark, d):
    return series.last_change(_months(spark, d))


@query("w7_recent_direction", f"""
WITH @m, {MONTH}, l AS (SELECT * FROM t ORDER BY ano_mes DESC LIMIT 3),
r AS (SELECT count(*) AS n, arg_min(total, ano_mes) AS primeiro, arg_max(total, ano_mes) AS ultimo FROM l)
SELECT CASE WHEN n < 3 THEN 'insuficiente' WHEN ultimo > primeiro THEN 'crescimento' ELSE 'queda' END AS tendencia, primeiro, ultimo FROM r""")
def recent_direction(spark, d):
    return series.recent_direction(_months(spark, d))


@query("w8_trend_label", """
WITH @m, t AS (SELECT ano_mes, trunc(sum(c20) + 2 * sum(c40)) AS total FROM m GROUP BY 1),
l AS (SELECT * FROM t ORDER BY ano_mes DESC LIMIT 3),
v AS (SELECT (total - lag(total) OVER w) * 100.0 / lag(total) OVER w AS x, lag(total) OVER w AS p FROM l WINDOW w AS (ORDER BY ano_mes)),
a AS (SELECT avg(x) FILTER (p > 0) AS mean FROM v)
SELECT CASE WHEN mean > 5 THEN 'CRESCIMENTO SIGNIFICATIVO' WHEN mean > 0 THEN 'CRESCIMENTO MODERADO' WHEN mean < -5 THEN 'QUEDA SIGNIFICATIVA'
 WHEN mean < 0 THEN 'QUEDA MODERADA' WHEN mean = 0 THEN 'ESTÁVEL' END AS tendencia, round_even(mean, 6) AS variacao_media FROM a""")
def trend_label(spark, d):
    rows = movements(spark, d, "ano_mes", "c20", "c40").select("ano_mes", F.col("c20").alias("C20"), F.col("c40").alias("C40"))
    return series.trend_label(rows)


@query("w9_compare_periods", """
WITH @m, r AS (SELECT tipo_operacao, ano_mes, qtd_container FROM m WHERE ano_mes IN (199801, 199802)),
c AS (SELECT coalesce(tipo_operacao, 'total') AS categoria, CAST(coalesce(sum(qtd_container) FILTER (ano_mes = 199801), 0) AS BIGINT) AS total1,
 CAST(coalesce(sum(qtd_container) FILTER (ano_mes = 199802), 0) AS BIGINT) AS total2 FROM r GROUP BY GROUPING SETS ((), (tipo_operacao)))
SELECT categoria, total1, total2, total2 - total1 AS diferenca,
 CASE WHEN total1 > 0 THEN CAST(total2 - total1 AS DOUBLE) * 100 / total1 WHEN total2 = 0 THEN 0 END AS variacao FROM c""")
def compare_periods(spark, d):
    rows = movements(spark, d, "ano_mes", "tipo_operacao", "qtd_container", start="1998-01-01", end="1998-03-01").select(
        "ano_mes", "tipo_operacao", F.col("qtd_container").alias("QTDE CONTAINER"))
    return series.compare_periods(rows, 199801, 199802)


@query("w10_compare_months", """
WITH @m, r AS (SELECT coalesce(sum(qtd_container) FILTER (ano_mes = 199801), 0) AS total1, coalesce(sum(qtd_container) FILTER (ano_mes = 199802), 0) AS total2
 FROM m WHERE tipo_operacao = 'exportacao')
SELECT total1, total2, total2 - total1 AS diferenca, coalesce((total2 - total1) * 100.0 / nullif(total1, 0), 0) AS variacao FROM r""")
def compare_months(spark, d):
    from portolan.operators.filters import is_export

    rows = _months(spark, d, "tipo_operacao")
    return series.compare_months(rows.where(is_export("tipo_operacao")), 199801, 199802)


@query("w11_last_periods", f"WITH @m, {MONTH} SELECT * FROM t ORDER BY ano_mes DESC LIMIT 6")
def last_periods(spark, d):
    return series.last_periods(_months(spark, d), 6)


@query("w12_period_comparisons", f"""
WITH @m, {GAPPY}, {DATED.replace('FROM m', 'FROM g')}, {FILLED},
mm AS (SELECT periodo, total, lag(total) OVER (ORDER BY periodo) AS a, lag(total, 12) OVER (ORDER BY periodo) AS b FROM f),
q AS (SELECT date_trunc('quarter', periodo) AS q, sum(total) AS total FROM f GROUP BY 1),
qq AS (SELECT q, (total - lag(total) OVER (ORDER BY q)) * 100.0 / nullif(lag(total) OVER (ORDER BY q), 0) AS qoq FROM q)
SELECT periodo, total, round_even((total - a) * 100.0 / nullif(a, 0), 6) AS mom, round_even(qoq, 6) AS qoq,
 round_even((total - b) * 100.0 / nullif(b, 0), 6) AS yoy FROM mm JOIN qq ON qq.q = date_trunc('quarter', periodo)""")
def period_comparisons(spark, d):
    return series.period_comparisons(_gappy(spark, d))


@query("w13_proactive_insights", f"""
WITH @m, {MONTH}, l AS (SELECT ano_mes, total - lag(total) OVER (ORDER BY ano_mes) AS x FROM t ORDER BY ano_mes DESC LIMIT 1),
c AS (SELECT cliente, sum(qtd_container) AS v FROM m GROUP BY 1 ORDER BY v DESC, cliente LIMIT 1),
b AS (SELECT mes, sum(qtd_container) / count(qtd_container) AS v FROM m GROUP BY 1 ORDER BY v DESC, mes LIMIT 1)
SELECT CASE WHEN x > 0 THEN 'crescimento' ELSE 'reducao' END AS tipo, CAST(ano_mes AS VARCHAR) AS chave, abs(x) AS valor FROM l
WHERE x <> 0 AND (SELECT count(*) FROM t) >= 3
UNION ALL SELECT 'top_cliente', cliente, v FROM c UNION ALL SELECT 'melhor_mes', CAST(mes AS VARCHAR), v FROM b""")
def proactive_insights(spark, d):
    return series.proactive_insights(_months(spark, d, "mes", "cliente"))


SEASON = """p AS (SELECT CAST(ano_mes % 100 AS INTEGER) AS mes, avg(total) AS media FROM t GROUP BY 1),
o AS (SELECT avg(total) AS g, count(*) AS n FROM t),
s AS (SELECT mes, CAST(floor(media) AS BIGINT) AS media_containers, (media - g) * 100.0 / g AS v,
 row_number() OVER (ORDER BY media DESC, mes) AS pk, row_number() OVER (ORDER BY media, mes) AS tr,
 round_even((max(media) OVER () - min(media) OVER ()) * 100.0 / g, 1) AS amplitude FROM p, o WHERE n >= 12)"""


@query("w14_seasonality", f"""
WITH @m, {MONTH}, {SEASON} SELECT mes, media_containers, round_even(v, 1) AS variacao_percentual,
 CASE WHEN v > 10 THEN 'Alto' WHEN v < -10 THEN 'Baixo' ELSE 'Normal' END AS classificacao,
 CASE WHEN pk = 1 THEN 'pico' WHEN tr = 1 THEN 'vale' ELSE '' END AS extremo, amplitude FROM s""")
def seasonality(spark, d):
    return series.seasonality(_months(spark, d))


# Cramer's rule on centred cross products.
FORECAST = """a AS (SELECT CAST(row_number() OVER (ORDER BY ano_mes) - 1 AS DOUBLE) AS x1, CAST(ano_mes % 100 AS DOUBLE) AS x2,
 CAST(ceil((ano_mes % 100) / 3.0) AS DOUBLE) AS x3, total AS y, CAST(strptime(CAST(ano_mes AS VARCHAR), '%Y%m') AS DATE) AS dt FROM t),
k AS (SELECT covar_pop(x1,x1) a11, covar_pop(x1,x2) a12, covar_pop(x1,x3) a13, covar_pop(x2,x2) a22, covar_pop(x2,x3) a23, covar_pop(x3,x3) a33,
 covar_pop(x1,y) c1, covar_pop(x2,y) c2, covar_pop(x3,y) c3, avg(x1) m1, avg(x2) m2, avg(x3) m3, avg(y) my, max(x1) mx, max(dt) md, count(*) n FROM a),
dd AS (SELECT *, a11*(a22*a33-a23*a23) - a12*(a12*a33-a23*a13) + a13*(a12*a23-a22*a13) AS det FROM k),
be AS (SELECT *, (c1*(a22*a33-a23*a23) - a12*(c2*a33-a23*c3) + a13*(c2*a23-a22*c3)) / det AS b1,
 (a11*(c2*a33-a23*c3) - c1*(a12*a33-a23*a13) + a13*(a12*c3-c2*a13)) / det AS b2,
 (a11*(a22*c3-c2*a23) - a12*(a12*c3-c2*a13) + c1*(a12*a23-a22*a13)) / det AS b3 FROM dd),
mo AS (SELECT *, my - b1*m1 - b2*m2 - b3*m3 AS b0 FROM be),
qu AS (SELECT avg(abs(y - (b0+b1*x1+b2*x2+b3*x3))) AS mae, 1 - sum(pow(y - (b0+b1*x1+b2*x2+b3*x3), 2)) / sum(pow(y - my, 2)) AS r2 FROM a, mo),
st AS (SELECT CAST(unnest([1,2,3]) AS INTEGER) AS passo),
pr AS (SELECT passo, CAST(md + passo * 30 AS DATE) AS dia, mo.* FROM st, mo),
fc AS (SELECT passo, strftime(dia, '%Y-%m') AS mes, CAST(greatest(0, trunc(b0 + b1*(mx+passo) + b2*month(dia) + b3*quarter(dia))) AS BIGINT) AS containers_previstos,
 round_even(mae, 4) AS mae, round_even(r2, 6) AS r2, CASE WHEN r2 > 0.7 THEN 'Alta' WHEN r2 > 0.4 THEN 'Média' ELSE 'Baixa' END AS precisao,
 CASE WHEN r2 > 0.8 THEN 'Alta' WHEN r2 > 0.6 THEN 'Média' ELSE 'Baixa' END AS confianca, n AS dados_historicos FROM pr, qu)"""


@query("w15_forecast", f"WITH @m, {MONTH}, {FORECAST} SELECT * FROM fc")
def demand_forecast(spark, d):
    return forecast.forecast(_months(spark, d, "cliente"), 3)


def _forecast_by_sql(group):
    """The same rule by group; every group of the given tables has independent features."""
    return f"""t AS (SELECT {group} AS grupo, ano_mes, sum(qtd_container) AS total FROM m GROUP BY ALL),
a AS (SELECT grupo, CAST(row_number() OVER (PARTITION BY grupo ORDER BY ano_mes) - 1 AS DOUBLE) AS x1, CAST(ano_mes % 100 AS DOUBLE) AS x2, CAST(ceil((ano_mes % 100) / 3.0) AS DOUBLE) AS x3, CAST(total AS DOUBLE) AS y,
 CAST(strptime(CAST(ano_mes AS VARCHAR), '%Y%m') AS DATE) AS dt FROM t),
k AS (SELECT grupo, covar_pop(x1,x1) a11, covar_pop(x1,x2) a12, covar_pop(x1,x3) a13, covar_pop(x2,x2) a22, covar_pop(x2,x3) a23, covar_pop(x3,x3) a33,
 covar_pop(x1,y) c1, covar_pop(x2,y) c2, covar_pop(x3,y) c3, avg(x1) m1, avg(x2) m2, avg(x3) m3, avg(y) my, max(x1) mx, max(dt) md, count(*) n FROM a GROUP BY grupo HAVING count(*) >= 6),
dd AS (SELECT *, a11*(a22*a33-a23*a23) - a12*(a12*a33-a23*a13) + a13*(a12*a23-a22*a13) AS det FROM k),
be AS (SELECT *, (c1*(a22*a33-a23*a23) - a12*(c2*a33-a23*c3) + a13*(c2*a23-a22*c3)) / det AS b1, (a11*(c2*a33-a23*c3) - c1*(a12*a33-a23*a13) + a13*(a12*c3-c2*a13)) / det AS b2,
 (a11*(a22*c3-c2*a23) - a12*(a12*c3-c2*a13) + c1*(a12*a23-a22*a13)) / det AS b3 FROM dd),
mo AS (SELECT *, my - b1*m1 - b2*m2 - b3*m3 AS b0 FROM be),
qu AS (SELECT grupo, avg(abs(y - (b0+b1*x1+b2*x2+b3*x3))) AS mae, 1 - sum(pow(y - (b0+b1*x1+b2*x2+b3*x3), 2)) / sum(pow(y - my, 2)) AS r2 FROM a JOIN mo USING (grupo) GROUP BY grupo),
pr AS (SELECT passo, CAST(md + passo * 30 AS DATE) AS dia, mo.*, mae, r2 FROM (SELECT CAST(unnest([1,2,3]) AS INTEGER) AS passo), mo JOIN qu USING (grupo))
SELECT grupo AS {group}, passo, strftime(dia, '%Y-%m') AS mes, CAST(greatest(0, trunc(round_even(b0 + b1*(mx+passo) + b2*month(dia) + b3*quarter(dia), 6))) AS BIGINT) AS containers_previstos,
 round_even(mae, 4) AS mae, round_even(r2, 6) AS r2, CASE WHEN r2 > 0.7 THEN 'Alta' WHEN r2 > 0.4 THEN 'Média' ELSE 'Baixa' END AS precisao,
 CASE WHEN r2 > 0.8 THEN 'Alta' WHEN r2 > 0.6 THEN 'Média' ELSE 'Baixa' END AS confianca, n AS dados_historicos FROM pr"""


@query("w15_forecast_by_client", f"WITH @m, {_forecast_by_sql('cliente')}")
def forecast_by_client(spark, d):
    return forecast.forecast_by(_months(spark, d, "cliente"), ["cliente"])


@query("w15_forecast_by_port", f"WITH @m, {_forecast_by_sql('porto_descarga')}")
def forecast_by_port(spark, d):
    return forecast.forecast_by(_months(spark, d, "porto_descarga"), ["porto_descarga"])


CLIENTS = """c AS (SELECT cliente, sum(qtd_container) AS total_containers, count(qtd_container) AS num_operacoes,
 sum(qtd_container) / count(qtd_container) AS media_containers, min(ano_mes) AS primeiro_mes, max(ano_mes) AS ultimo_mes FROM m GROUP BY cliente)"""
UPSELL = "u AS (SELECT cliente, total_containers, num_operacoes FROM c WHERE num_operacoes >= 5 AND total_containers < (SELECT median(total_containers) FROM c))"
LOW = "w AS (SELECT left(CAST(ano_mes AS VARCHAR), 4) || '-' || right(CAST(ano_mes AS VARCHAR), 2) AS periodo, total FROM t WHERE total < 0.7 * (SELECT avg(total) FROM t))"
CLV = """d AS (SELECT *, date_diff('day', strptime(CAST(primeiro_mes AS VARCHAR), '%Y%m'), strptime(CAST(ultimo_mes AS VARCHAR), '%Y%m')) / 30.0 AS duracao FROM c),
v AS (SELECT *, media_containers * CAST(duracao AS DOUBLE) AS clv FROM d)"""


@query("g1_client_metrics", f"WITH @m, {CLIENTS} SELECT * FROM c")
def client_metrics(spark, d):
    return segments.client_metrics(_months(spark, d, "cliente"))


@query("g2_upsell", f"WITH @m, {CLIENTS}, {UPSELL} SELECT * FROM u")
def upsell(spark, d):
    return segments.upsell(_months(spark, d, "cliente"))


@query("g3_low_months", f"WITH @m, {MONTH}, {LOW} SELECT * FROM w")
def low_months(spark, d):
    return segments.low_months(_months(spark, d))


CALENDAR = """x AS (SELECT mes, sum(CASE WHEN mes = 8 THEN qtd_container / 2 ELSE qtd_container END) AS total FROM m GROUP BY mes),
lc AS (SELECT mes, total, (SELECT avg(total) FROM x) AS media FROM x WHERE total < 0.7 * (SELECT avg(total) FROM x))"""


def _calendar(spark, d, *more):
    """Movements with a weak August."""
    rows = _months(spark, d, "mes", *more)
    half = F.when(F.col("mes") == 8, F.col("qtd_container") / 2).otherwise(F.col("qtd_container"))
    return rows.withColumn("qtd_container", half)


@query("g4_low_calendar_months", f"WITH @m, {CALENDAR} SELECT mes, total, round_even(media, 6) AS media FROM lc")
def low_calendar_months(spark, d):
    return segments.low_calendar_months(_calendar(spark, d)).withColumn("media", F.bround("media", 6))


SHARES = "sh AS (SELECT tipo_operacao, sum(qtd_container) AS total FROM m GROUP BY 1), so AS (SELECT tipo_operacao, total, total / (SELECT sum(total) FROM sh) * 100 AS participacao FROM sh)"


@query("g5_small_operations", f"WITH @m, {SHARES} SELECT * FROM so WHERE participacao < 33.4")
def small_operations(spark, d):
    return segments.small_operations(_months(spark, d, "tipo_operacao"), 33.4)


@query("g6_opportunities", f"""
WITH @m, {MONTH}, {CLIENTS}, {UPSELL}, {LOW}, {SHARES},
al AS (SELECT 1 AS ordem, cliente AS chave, 'upsell_cliente' AS tipo, 'Alto' AS potencial, 'Cliente frequente (' || num_operacoes || ' ops) com volume baixo' AS descricao FROM u
 UNION ALL SELECT 2, periodo, 'sazonalidade', 'Médio', 'Mês com volume ' || CAST(round_even(total, 0) AS BIGINT) || ' (70% abaixo da média)' FROM w
 UNION ALL SELECT 3, tipo_operacao, 'diversificacao_operacao', 'Alto', 'Operação ' || tipo_operacao || ' representa apenas ' || printf('%.1f', participacao) || '% do volume' FROM so WHERE participacao < 20)
SELECT * FROM al""")
def opportunities(spark, d):
    return segments.opportunities(_months(spark, d, "cliente", "tipo_operacao"))


@query("g6_commercial_opportunities", f"""
WITH @m, cc AS (SELECT cliente, sum(CASE WHEN mes = 8 THEN qtd_container / 2 ELSE qtd_container END) AS total, count(*) AS n FROM m GROUP BY 1), {CALENDAR},
al AS (SELECT 1 AS ordem, cliente AS chave, 'upsell' AS tipo, 'Alto' AS potencial, 0 AS k FROM cc WHERE n >= 5 AND total < (SELECT median(total) FROM cc)
 UNION ALL SELECT 2, 'Mês ' || mes, 'sazonalidade', 'Médio', mes FROM lc)
SELECT ordem, chave, tipo, potencial FROM al""")
def commercial_opportunities(spark, d):
    return segments.commercial_opportunities(_calendar(spark, d, "cliente"))


@query("g7_lifetime_value", f"""
WITH @m, {CLIENTS}, {CLV} SELECT cliente, round_even(clv, 2) AS clv_score, CAST(total_containers AS BIGINT) AS total_containers,
 round_even(CAST(duracao AS DOUBLE), 1) AS duracao_meses, round_even(media_containers, 1) AS avg_mensal FROM v ORDER BY clv DESC, cliente LIMIT 10""")
def lifetime_value(spark, d):
    return segments.top_lifetime_value(_months(spark, d, "cliente"))


MEAN_CLV = """mc AS (SELECT round_even(avg(clv), 2) AS clv_medio, round_even(avg(CAST(duracao AS DOUBLE)), 1) AS duracao_media,
 round_even(avg(media_containers), 1) AS containers_medio_mensal FROM v)"""


@query("g8_mean_lifetime_value", f"WITH @m, {CLIENTS}, {CLV}, {MEAN_CLV} SELECT * FROM mc")
def mean_lifetime_value(spark, d):
    return segments.mean_lifetime_value(_months(spark, d, "cliente"))


@query("g9_commercial_insights", f"""
WITH @m, {MONTH}, {FORECAST}, {SEASON}, {CLIENTS}, {UPSELL}, {CLV}, {MEAN_CLV}
SELECT 1 AS ordem, 'previsao' AS tipo, mes AS chave, CAST(containers_previstos AS DOUBLE) AS valor FROM fc WHERE passo = 1
UNION ALL SELECT 2, 'pico_sazonal', CAST(mes AS VARCHAR), CAST(media_containers AS DOUBLE) FROM s WHERE pk = 1
UNION ALL SELECT 3, 'upsell', '', CAST(count(*) AS DOUBLE) FROM u HAVING count(*) > 0
UNION ALL SELECT 4, 'duracao_media', '', duracao_media FROM mc""")
def commercial_insights(spark, d):
    return segments.commercial_insights(_months(spark, d, "cliente", "tipo_operacao"))


# Goals derived from the order table: a target per year, month and client.
def _annual_goals(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("ano")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("receita_total"),
        (F.count(F.lit(1)) * 100).alias("containers_total"),
        F.count_distinct("o_custkey").alias("novos_clientes"), F.lit(0.2).alias("margem_lucro"))


ANNUAL = """ga AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS receita_total,
 count(*) * 100 AS containers_total, count(DISTINCT o_custkey) AS novos_clientes, CAST(0.2 AS DOUBLE) AS margem_lucro FROM orders GROUP BY 1)"""


def _monthly_goals(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("mes_chave")).agg(
        (F.count(F.lit(1)) * 90).alias("containers"))


MONTHLY_GOALS = "gm AS (SELECT strftime(o_orderdate, '%Y-%m') AS mes_chave, count(*) * 90 AS containers FROM orders GROUP BY 1)"
STATUS = "CASE WHEN percentual >= 100 THEN 'atingida' WHEN percentual >= 80 THEN 'boa' WHEN percentual >= 50 THEN 'moderada' ELSE 'baixa' END"


@query("j1_budget_join", f"""
WITH @m, {MONTHLY_GOALS}, r AS (SELECT strftime(data_embarque, '%Y-%m') AS mes_chave, sum(qtd_container) AS realizado FROM m GROUP BY 1)
SELECT mes_chave, CAST(containers AS DOUBLE) AS meta, coalesce(realizado, 0) AS realizado,
 coalesce(realizado * 100.0 / nullif(containers, 0), 0) AS percentual FROM gm LEFT JOIN r USING (mes_chave)""")
def budget_join(spark, d):
    actual = movements(spark, d, "data_embarque", "qtd_container").groupBy(
        F.date_format("data_embarque", "yyyy-MM").alias("mes_chave")).agg(F.sum("qtd_container").alias("realizado"))
    goals = _monthly_goals(spark, d).select("mes_chave", F.col("containers").cast("double").alias("meta"))
    return budget.budget_vs_actual(goals, actual, ["mes_chave"])


BUDGET = f"""b AS (SELECT 'anual' AS escopo, CAST(containers_total AS DOUBLE) AS meta, (SELECT coalesce(sum(qtd_container), 0) FROM m WHERE ano = 1998) AS realizado FROM ga WHERE ano = 1998
 UNION ALL SELECT 'mensal_atual', CAST(containers AS DOUBLE), (SELECT coalesce(sum(qtd_container), 0) FROM m WHERE ano_mes = 199806) FROM gm WHERE mes_chave = '1998-06'),
bp AS (SELECT *, coalesce(realizado * 100.0 / nullif(meta, 0), 0) AS percentual FROM b)"""


@query("a6_budget_vs_actual", f"WITH @m, {ANNUAL}, {MONTHLY_GOALS}, {BUDGET} SELECT * FROM bp")
def budget_vs_actual(spark, d):
    return _budget(spark, d).drop("status")


def _budget(spark, d):
    rows = movements(spark, d, "ano", "mes", "cliente", "tipo_operacao", "qtd_container", start="1998-01-01", end="1999-01-01")
    return budget.budget_as_of(rows, _annual_goals(spark, d), _monthly_goals(spark, d), AS_OF)


@query("a7_budget_status", f"""
WITH @m, {ANNUAL}, {MONTHLY_GOALS}, {BUDGET} SELECT escopo, round_even(percentual, 1) AS percentual, CASE WHEN escopo = 'anual' THEN {STATUS}
 WHEN percentual >= 100 THEN 'atingida' WHEN percentual >= 80 THEN 'boa' ELSE 'em_andamento' END AS status FROM bp""")
def budget_status(spark, d):
    return _budget(spark, d).select("escopo", F.bround("percentual", 1).alias("percentual"), "status")


@query("b1_set_goals", f"""
WITH {ANNUAL}, n AS (SELECT ano, receita_total * 1.5 AS receita_total, containers_total + 7 AS containers_total, TIMESTAMP '2024-02-01' AS updated_at
 FROM ga WHERE ano % 2 = 0 UNION ALL SELECT ano + 20, receita_total, containers_total, TIMESTAMP '2024-02-01' FROM ga),
u AS (SELECT ano, receita_total, containers_total, TIMESTAMP '2024-01-01' AS updated_at FROM ga UNION ALL SELECT * FROM n)
SELECT ano, receita_total, containers_total, updated_at FROM u QUALIFY row_number() OVER (PARTITION BY ano ORDER BY updated_at DESC) = 1""")
def set_goals(spark, d):
    def at(frame, day):
        return frame.select("ano", "receita_total", "containers_total", F.lit(day).cast("timestamp_ntz").alias("updated_at"))

    goals = _annual_goals(spark, d)
    raised = goals.where("ano % 2 = 0").withColumns({
        "receita_total": F.col("receita_total") * 1.5, "containers_total": F.col("containers_total") + 7})
    later = goals.withColumn("ano", F.col("ano") + 20)
    changes = at(raised, "2024-02-01").unionByName(at(later, "2024-02-01"))
    return budget.upsert(at(goals, "2024-01-01"), changes, ["ano"])


@query("b2_realizations", """
WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'mensal' ELSE 'por_cliente' END AS tipo,
 CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE CAST(o_custkey AS VARCHAR) END AS periodo,
 o_totalprice AS receita, o_orderkey AS pedido, o_orderdate AS updated_at FROM orders)
SELECT tipo, periodo, receita, pedido, updated_at FROM r
QUALIFY row_number() OVER (PARTITION BY tipo, periodo ORDER BY updated_at DESC, receita DESC, pedido DESC) = 1""")
def realizations(spark, d):
    orders = table(spark, d, "orders")
    monthly = F.col("o_orderkey") % 3 == 0
    rows = orders.select(
        F.when(monthly, "mensal").otherwise("por_cliente").alias("tipo"),
        F.when(monthly, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.col("o_custkey").cast("string")).alias("periodo"),
        F.col("o_totalprice").alias("receita"), F.col("o_orderkey").alias("pedido"), F.col("o_orderdate").alias("updated_at"))
    return budget.upsert(rows.where("tipo = 'mensal'"), rows.where("tipo = 'por_cliente'"), ["tipo", "periodo"])


@query("b3_default_goals", f"""
WITH {ANNUAL}, g AS (SELECT * FROM ga WHERE ano % 2 = 0), y AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS ano FROM lineitem)
SELECT y.ano, coalesce(receita_total, 0) AS receita_total, coalesce(containers_total, 0) AS containers_total, coalesce(novos_clientes, 0) AS novos_clientes,
 coalesce(margem_lucro, 0.15)::DOUBLE AS margem_lucro FROM y LEFT JOIN g ON y.ano = g.ano""")
def default_goals(spark, d):
    return budget.with_default_goals(_annual_goals(spark, d).where("ano % 2 = 0"), movements(spark, d, "ano"))


@query("b3_default_operations", """
WITH @m SELECT o AS tipo_operacao, CAST(0 AS BIGINT) AS meta_containers, CAST(0 AS DOUBLE) AS meta_receita, coalesce(t, 0) AS realizado
FROM (SELECT unnest(['importacao', 'exportacao', 'cabotagem']) AS o) LEFT JOIN
 (SELECT tipo_operacao, sum(qtd_container) AS t FROM m GROUP BY 1) ON o = tipo_operacao""")
def default_operations(spark, d):
    return budget.default_operation_goals(movements(spark, d, "tipo_operacao", "qtd_container"))


@query("b4_client_goals", """
WITH @m, g AS (SELECT c_name AS cliente, floor(abs(c_acctbal) / 10) AS meta FROM customer),
r AS (SELECT cliente, sum(qtd_container) AS realizado FROM m GROUP BY 1)
SELECT cliente, meta, coalesce(realizado, 0) AS realizado, coalesce(realizado * 100.0 / nullif(meta, 0), 0) AS percentual FROM g LEFT JOIN r USING (cliente)""")
def client_goals(spark, d):
    goals = table(spark, d, "customer").select(
        F.col("c_name").alias("cliente"), F.floor(F.abs("c_acctbal") / 10).cast("double").alias("meta"))
    actual = sum_by(movements(spark, d, "cliente", "qtd_container"), "cliente")
    return budget.budget_vs_actual(goals, actual.withColumnRenamed("total", "realizado"), ["cliente"])


@query("j5_delete_by_key", """
SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def delete_by_key(spark, d):
    chats = table(spark, d, "conversations")
    return budget.delete_by_key(chats, chats.where("role = 'system'"), ["conv_id"])


@query("j6_upsert", """
WITH u AS (SELECT o_custkey AS chave, o_orderdate AS updated_at, o_orderkey AS pedido FROM orders
 UNION ALL SELECT c_custkey, TIMESTAMP '1997-01-01', -1 FROM customer)
SELECT chave, updated_at, pedido FROM u QUALIFY row_number() OVER (PARTITION BY chave ORDER BY updated_at DESC, pedido DESC) = 1""")
def upsert(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("chave"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("pedido"))
    clients = table(spark, d, "customer").select(
        F.col("c_custkey").alias("chave"), F.lit("1997-01-01").cast("timestamp_ntz").alias("updated_at"),
        F.lit(-1).cast("bigint").alias("pedido"))
    return budget.upsert(orders, clients, ["chave"])
