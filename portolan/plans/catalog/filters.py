"""Movement view, filters and the flagship ranking."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from portolan.operators import filters as flt
from portolan.operators import ranking, roles
from portolan.plans.movements import movements
from portolan.plans.registry import query

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qtd_container")
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, qtd_container"
PORT, YEAR = "NATION_5", 1998


@query("k5_carriers_at_port", f"""
WITH @m SELECT armador, sum(qtd_container) AS total_containers FROM m
WHERE porto_descarga = '{PORT}' AND ano = {YEAR} GROUP BY armador
ORDER BY total_containers DESC, armador LIMIT 5""")
def carriers_at_port(spark, d):
    rows = flt.filter_year(movements(spark, d, "armador", "porto_descarga", "qtd_container", "ano", "data_embarque"), YEAR, "data_embarque")
    return ranking.carriers_at_port(flt.filter_port(rows, PORT).where(F.col("porto_descarga") == PORT), 5)


@query("j7_movements", """
WITH @m SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, data_embarque, ano, mes, ano_mes, qtd_container,
 CAST(receita AS DOUBLE) AS receita, tipo_operacao, data_pedido, cliente, porto_descarga, armador, porto_embarque,
 c20, c40, teus, tipo_carga, produto FROM m""")
def movement_view(spark, d):
    return movements(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "data_embarque", "ano", "mes", "ano_mes", "qtd_container",
        F.col("receita").cast("double").alias("receita"), "tipo_operacao", "data_pedido", "cliente", "porto_descarga",
        "armador", "porto_embarque", "c20", "c40", "teus", "tipo_carga", "produto",
    )


@query("f1_filter_set", f"""
WITH @m SELECT {KEYS_SQL} FROM m WHERE tipo_operacao = 'importacao'
 AND (lower(porto_embarque) = 'nation_5' OR lower(porto_descarga) = 'nation_5')
 AND ano = {YEAR} AND ano_mes BETWEEN 199802 AND 199811""")
def filter_set(spark, d):
    f = flt.FilterSet(categoria="Importação", porto="nation_5", ano=YEAR, data_inicio=199802, data_fim=199811)
    rows = movements(spark, d, *KEYS, "tipo_operacao", "porto_embarque", "porto_descarga", "ano", "ano_mes", "data_embarque")
    return flt.apply_filters(rows, f, dates="data_embarque").select(*KEYS)


@query("f2_operation", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE tipo_operacao = 'exportacao'")
def operation(spark, d):
    rows = movements(spark, d, *KEYS, "tipo_operacao")
    return rows.where(flt.operation_equals("tipo_operacao", "EXPORTAÇÃO")).select(*KEYS)


@query("f3_client_any_column", f"""
WITH @m SELECT {KEYS_SQL} FROM m WHERE lower(cliente) = 'supplier#000000003' OR lower(exportador) = 'supplier#000000003'
 OR lower(consignatario) = 'supplier#000000003'""")
def client_any_column(spark, d):
    rows = movements(spark, d, *KEYS, "cliente", "consignatario", "exportador")
    return rows.where(flt.any_column_equals(roles.client_columns(rows.columns), "SUPPLIER#000000003")).select(*KEYS)


@query("f4_port_any_column", f"""
WITH @m SELECT {KEYS_SQL} FROM m WHERE lower(porto_embarque) = 'nation_7' OR lower(porto_descarga) = 'nation_7'""")
def port_any_column(spark, d):
    rows = movements(spark, d, *KEYS, "porto_embarque", "porto_descarga")
    return rows.where(flt.any_column_equals(roles.port_columns(rows.columns), "Nation_7")).select(*KEYS)


@query("f5_carrier", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE lower(armador) = 'supplier#000000004'")
def carrier(spark, d):
    rows = movements(spark, d, *KEYS, "armador")
    return flt.apply_filters(rows, flt.FilterSet(armador="SUPPLIER#000000004")).select(*KEYS)


@query("f6_year_month", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE ano = 1999 AND mes = 3")
def year_month(spark, d):
    rows = movements(spark, d, *KEYS, "ano", "mes", "data_embarque")
    return flt.apply_filters(rows, flt.FilterSet(ano=1999, mes=3), dates="data_embarque").select(*KEYS)


@query("f7_period_range", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE ano_mes BETWEEN 199711 AND 199802")
def period_range(spark, d):
    rows = movements(spark, d, *KEYS, "ano_mes", "data_embarque")
    return flt.apply_filters(rows, flt.FilterSet(data_inicio=199711, data_fim=199802), dates="data_embarque").select(*KEYS)


@query("f8_period_fallback", f"""
WITH @m SELECT 'data' AS modo, {KEYS_SQL} FROM m WHERE data_embarque BETWEEN DATE '1997-11-15' AND DATE '1998-02-10'
UNION ALL SELECT 'ano_mes' AS modo, {KEYS_SQL} FROM m WHERE ano*100+mes BETWEEN 199711 AND 199802""")
def period_fallback(spark, d):
    start, end = datetime.date(1997, 11, 15), datetime.date(1998, 2, 10)
    by_date = flt.filter_by_period(movements(spark, d, *KEYS, "data_embarque", "ano", "mes"), start, end)
    by_month = flt.filter_by_period(movements(spark, d, *KEYS, "ano", "mes"), start, end)
    return by_date.select(F.lit("data").alias("modo"), *KEYS).unionByName(
        by_month.select(F.lit("ano_mes").alias("modo"), *KEYS))


@query("f9_client_substring", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE contains(lower(cliente), 'r#00000001')")
def client_substring(spark, d):
    rows = movements(spark, d, *KEYS, "cliente")
    return rows.where(flt.any_column_contains(["cliente"], "R#00000001")).select(*KEYS)


@query("f10_any_column_substring", f"""
WITH @m SELECT {KEYS_SQL} FROM m WHERE contains(lower(cliente), '00007') OR contains(lower(exportador), '00007')""")
def any_column_substring(spark, d):
    rows = movements(spark, d, *KEYS, "cliente", "exportador")
    return rows.where(flt.any_column_contains(["cliente", "exportador"], "00007")).select(*KEYS)


# Periods as text in four notations, by line number.
def _period():
    line = F.col("l_linenumber") % 4
    return (
        F.when(line == 0, F.date_format("data_embarque", "MM/yyyy"))
        .when(line == 1, F.date_format("data_embarque", "yyyy-MM"))
        .when(line == 2, F.date_format("data_embarque", "yyyyMM"))
        .otherwise(F.date_format("data_embarque", "MM-yyyy"))
    )


_PERIOD_SQL = """CASE l_linenumber % 4 WHEN 0 THEN strftime(data_embarque, '%m/%Y') WHEN 1 THEN strftime(data_embarque, '%Y-%m')
 WHEN 2 THEN strftime(data_embarque, '%Y%m') ELSE strftime(data_embarque, '%m-%Y') END"""


@query("f11_year_from_period", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE ano = 1997")
def year_from_period(spark, d):
    rows = movements(spark, d, *KEYS, "data_embarque").withColumn("periodo", _period())
    return flt.filter_year(rows, 1997, "data_embarque").select(*KEYS)


@query("f12_month_year_text", f"WITH @m SELECT {KEYS_SQL} FROM m WHERE ano = 1998 AND mes = 3")
def month_year_text(spark, d):
    rows = movements(spark, d, *KEYS, "data_embarque").withColumn("periodo", _period())
    return flt.filter_month_year(rows, 3, 1998).select(*KEYS)


@query("f13_import_export", """
WITH @m, x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(left(tipo_operacao, 1)) ELSE tipo_operacao END AS op, qtd_container FROM m)
SELECT op, (regexp_matches(lower(op), '^i$') OR contains(lower(op), 'imp')) AS importacao,
 (regexp_matches(lower(op), '^e$') OR contains(lower(op), 'exp')) AS exportacao,
 sum(qtd_container) AS total FROM x GROUP BY ALL""")
def import_export(spark, d):
    short = F.upper(F.substring("tipo_operacao", 1, 1))
    rows = movements(spark, d, "l_linenumber", "tipo_operacao", "qtd_container").select(
        F.when(F.col("l_linenumber") % 2 == 0, short).otherwise(F.col("tipo_operacao")).alias("op"), "qtd_container")
    return rows.groupBy("op", flt.is_import("op").alias("importacao"), flt.is_export("op").alias("exportacao")).agg(
        F.sum("qtd_container").alias("total"))


@query("f14_port_substring", f"""
WITH @m SELECT {KEYS_SQL} FROM m WHERE contains(lower(porto_embarque), 'ion_1') OR contains(lower(porto_descarga), 'ion_1')""")
def port_substring(spark, d):
    rows = movements(spark, d, *KEYS, "porto_embarque", "porto_descarga")
    return flt.filter_port(rows, "ION_1").select(*KEYS)


@query("f15_loading_port", """
WITH @m SELECT tipo_operacao, sum(qtd_container) AS total FROM m WHERE contains(lower(porto_embarque), 'nation_2')
GROUP BY tipo_operacao""")
def loading_port(spark, d):
    rows = movements(spark, d, "porto_embarque", "porto_descarga", "tipo_operacao", "qtd_container")
    return flt.filter_port(rows, "NATION_2", loading_only=True).groupBy("tipo_operacao").agg(F.sum("qtd_container").alias("total"))


@query("f16_pattern_census", f"""
WITH @m, x AS (SELECT {_PERIOD_SQL} AS periodo, CAST(data_embarque AS VARCHAR) AS data FROM m),
p AS (SELECT unnest(['1998-03','03/1998','março','mar/98','1998/03','03-1998']) AS padrao)
SELECT 'periodo' AS coluna, padrao, count(*) AS registros FROM x JOIN p ON contains(lower(periodo), padrao) GROUP BY ALL
UNION ALL SELECT 'data', padrao, count(*) FROM x JOIN p ON contains(lower(data), padrao) GROUP BY ALL""")
def pattern_census(spark, d):
    rows = movements(spark, d, "l_linenumber", "data_embarque").select(_period().alias("periodo"), F.col("data_embarque").alias("data"))
    return flt.pattern_census(rows, ["periodo", "data"], flt.month_notations(3, 1998))


@query("f16_pattern_examples", f"""
WITH @m, x AS (SELECT {_PERIOD_SQL} AS periodo, CAST(data_embarque AS VARCHAR) AS data FROM m),
p AS (SELECT unnest(['1998-03','03/1998','março','mar/98','1998/03','03-1998']) AS padrao),
e AS (SELECT DISTINCT 'periodo' AS coluna, padrao, periodo AS valor FROM x JOIN p ON contains(lower(periodo), padrao)
 UNION ALL SELECT DISTINCT 'data', padrao, data FROM x JOIN p ON contains(lower(data), padrao))
SELECT coluna, padrao, CAST(row_number() OVER (PARTITION BY coluna, padrao ORDER BY valor) AS INTEGER) AS ordem, valor FROM e QUALIFY ordem <= 5""")
def pattern_examples(spark, d):
    rows = movements(spark, d, "l_linenumber", "data_embarque").select(_period().alias("periodo"), F.col("data_embarque").alias("data"))
    return flt.pattern_examples(rows, ["periodo", "data"], flt.month_notations(3, 1998))


@query("f17_year_census", f"""
WITH @m, x AS (SELECT {_PERIOD_SQL} AS periodo, CAST(data_embarque AS VARCHAR) AS data, CAST(l_orderkey AS VARCHAR) AS pedido FROM m)
SELECT * FROM (SELECT 'periodo' AS coluna, count(*) FILTER (contains(periodo, '1998')) AS registros FROM x
UNION ALL SELECT 'data', count(*) FILTER (contains(data, '1998')) FROM x
UNION ALL SELECT 'pedido', count(*) FILTER (contains(pedido, '1998')) FROM x) WHERE registros > 0""")
def year_census(spark, d):
    rows = movements(spark, d, "l_linenumber", "data_embarque", "l_orderkey").select(
        _period().alias("periodo"), F.col("data_embarque").alias("data"), F.col("l_orderkey").alias("pedido"))
    return flt.year_census(rows, ["periodo", "data", "pedido"], 1998)


@query("f17_year_values", f"""
WITH @m, x AS (SELECT {_PERIOD_SQL} AS valor FROM m) SELECT valor, count(*) AS registros FROM x
WHERE contains(valor, '1998') GROUP BY valor ORDER BY registros DESC, valor LIMIT 5""")
def year_values(spark, d):
    rows = movements(spark, d, "l_linenumber", "data_embarque").select(_period().alias("periodo"))
    return flt.year_value_census(rows, "periodo", 1998)


@query("f19_year_fallback", """
WITH @m SELECT mes, sum(qtd_container) AS total, count(*) AS operacoes FROM m
WHERE ano = (SELECT CASE WHEN count(*) FILTER (ano = 2025) > 0 THEN 2025 ELSE 1999 END FROM m) GROUP BY mes""")
def year_fallback(spark, d):
    rows = movements(spark, d, "ano", "mes", "qtd_container", "data_embarque")
    return flt.filter_year_or_fallback(rows, 2025, 1999, "data_embarque").groupBy("mes").agg(
        F.sum("qtd_container").alias("total"), F.count(F.lit(1)).alias("operacoes"))
