"""Cleaning and schema rules, on dirty text derived from the clean tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.functions import dates, numbers, text
from portolan.operators import cleaning, schema
from portolan.plans.movements import movements, table
from portolan.plans.registry import query

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
LINE_SQL = ", ".join(LINE)


def brazilian(c):
    """Price text with dots between thousands and a decimal comma."""
    return F.translate(F.format_number(c, 2), ",.", ".,")


def _accented():
    return F.concat(F.lit(" "), F.upper(F.translate("p_name", "aeiou", "ãéîõü")), F.lit(" €\t"))


ACCENTED_SQL = "' ' || upper(translate(p_name, 'aeiou', 'ãéîõü')) || ' €' || chr(9)"
NORMAL = "trim(lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')), ' ' || chr(9))"


@query("c1_normalize_text", f"SELECT p_partkey, {NORMAL.format(ACCENTED_SQL)} AS nome FROM part")
def normalize_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_text(_accented()).alias("nome"))


@query("c2_fold_accents", "SELECT p_partkey, strip_accents(lower(upper(translate(p_name, 'aeiou', 'ãéîõü')))) AS nome FROM part")
def fold_accents(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", text.fold_accents(F.upper(F.translate("p_name", "aeiou", "ãéîõü"))).alias("nome"))


@query("c3_normalize_table", f"""
SELECT p_partkey, {NORMAL.format(ACCENTED_SQL)} AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size, p_retailprice FROM part""")
def normalize_table(spark, d):
    return cleaning.normalize_strings(table(spark, d, "part").withColumn("p_name", _accented()))


def _quantity_text():
    line, whole = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    return (
        F.when(line == 1, brazilian("l_extendedprice")).when(line == 2, F.concat(F.lit("R$ "), brazilian("l_extendedprice")))
        .when(line == 3, F.concat(F.lit(" -"), whole)).when(line == 4, "abc")
        .when(line == 6, F.concat(F.lit("1,2,"), whole)).when(line == 7, F.col("l_quantity").cast("string"))
    )


BRAZILIAN = "translate(format('{:,.2f}', l_extendedprice), ',.', '.,')"
QUANTITY_TEXT = f"""CASE l_linenumber WHEN 1 THEN {BRAZILIAN} WHEN 2 THEN 'R$ ' || {BRAZILIAN}
 WHEN 3 THEN ' -' || CAST(l_quantity AS INTEGER) WHEN 4 THEN 'abc' WHEN 6 THEN '1,2,' || CAST(l_quantity AS INTEGER)
 WHEN 7 THEN CAST(l_quantity AS VARCHAR) END"""


@query("c4_parse_quantity", f"""
WITH v AS (SELECT {LINE_SQL}, {QUANTITY_TEXT} AS bruto FROM lineitem),
x AS (SELECT *, regexp_replace(replace(replace(trim(bruto), '.', ''), ',', '.'), '[^0-9.]', '', 'g') AS x FROM v)
SELECT {LINE_SQL}, bruto, coalesce(TRY_CAST(CASE WHEN length(x) - length(replace(x, '.', '')) > 1
 THEN replace(left(x, length(x) - strpos(reverse(x), '.')), '.', '') || '.' || right(x, strpos(reverse(x), '.') - 1) ELSE x END AS DOUBLE), 0) AS valor FROM x""")
def parse_quantity(spark, d):
    rows = table(spark, d, "lineitem").select(*LINE, _quantity_text().alias("bruto"))
    return rows.withColumn("valor", numbers.parse_quantity("bruto"))


@query("c4_clean_quantities", f"""
WITH v AS (SELECT {QUANTITY_TEXT} AS bruto, l_linenumber, l_quantity FROM lineitem)
SELECT l_linenumber, CAST(sum(l_quantity) FILTER (l_linenumber <> 5) AS DOUBLE) AS teus, count(bruto) AS textos FROM v GROUP BY 1""")
def clean_quantities(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_linenumber", F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("TEUS"), _quantity_text().alias("bruto"))
    cleaned = cleaning.clean_quantities(rows)
    return cleaned.groupBy("l_linenumber").agg(
        F.nullif(F.sum("TEUS"), F.lit(0.0)).alias("teus"), F.count("bruto").alias("textos"))


@query("c5_numeric_coerce", f"SELECT {LINE_SQL}, TRY_CAST(trim({QUANTITY_TEXT}) AS DOUBLE) AS valor FROM lineitem")
def numeric_coerce(spark, d):
    return table(spark, d, "lineitem").select(*LINE, numbers.to_number(_quantity_text()).alias("valor"))


@query("c6_numeric_or_digits", f"""
SELECT {LINE_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a, CAST(-l_quantity AS DOUBLE) AS b FROM lineitem""")
def numeric_or_digits(spark, d):
    whole = F.col("l_quantity").cast("int").cast("string")
    rows = table(spark, d, "lineitem").select(
        *LINE, F.when(F.col("l_linenumber") % 2 == 0, whole).otherwise(F.concat(whole, F.lit(" un"))).alias("a"),
        F.concat(F.lit("n -"), whole, F.lit(" un")).alias("b"))
    return cleaning.numeric_or_digits(rows, ["a", "b"])


@query("c7_decimal_comma", f"""
WITH v AS (SELECT {LINE_SQL}, replace(CAST(l_extendedprice AS VARCHAR), '.', ',') AS t FROM lineitem)
SELECT {LINE_SQL}, TRY_CAST(replace(t, ',', '.') AS DOUBLE) AS valor FROM v""")
def decimal_comma(spark, d):
    comma = F.replace(F.format_string("%.2f", F.col("l_extendedprice")), F.lit("."), F.lit(","))
    return table(spark, d, "lineitem").select(*LINE, numbers.decimal_comma(comma).alias("valor"))


@query("c8_parse_revenue", f"""
WITH v AS (SELECT {LINE_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN 'R$ ' || replace(printf('%.2f', l_extendedprice), '.', ',') ELSE {BRAZILIAN} END AS t FROM lineitem)
SELECT {LINE_SQL}, TRY_CAST(replace(regexp_replace(t, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) AS receita FROM v""")
def parse_revenue(spark, d):
    plain = F.replace(F.format_string("%.2f", F.col("l_extendedprice")), F.lit("."), F.lit(","))
    t = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("R$ "), plain)).otherwise(brazilian("l_extendedprice"))
    return table(spark, d, "lineitem").select(*LINE, numbers.parse_revenue(t).alias("receita"))


@query("c9_rescale_percentage", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 100 AS probabilidade, l_discount AS margem FROM lineitem""")
def rescale_percentage(spark, d):
    rows = table(spark, d, "lineitem").select(
        *LINE[:4], F.col("l_quantity").alias("probabilidade"), F.col("l_discount").alias("margem"))
    return cleaning.rescale_percentage(cleaning.rescale_percentage(rows, "probabilidade"), "margem")


@query("c10_count_from_sizes", f"""
SELECT {LINE_SQL}, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity END + CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END AS qtd_container FROM lineitem""")
def count_from_sizes(spark, d):
    rows = table(spark, d, "lineitem").select(
        *LINE, F.when(F.col("l_linenumber") % 3 == 0, "n/d").otherwise(F.col("l_quantity").cast("string")).alias("qtd_c20"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("qtd_c40"))
    return rows.select(*LINE, cleaning.count_from_sizes().alias("qtd_container"))


@query("c11_split_period", """
WITH @m SELECT ano_mes // 100 AS ano, ano_mes % 100 AS mes, count(*) AS registros FROM m GROUP BY ALL""")
def split_period(spark, d):
    rows = movements(spark, d, "ano_mes").select(F.col("ano_mes").cast("string").alias("ano_mes"))
    return cleaning.split_period(rows).groupBy("ano", "mes").agg(F.count(F.lit(1)).alias("registros"))


@query("c12_parse_period", """
WITH @m SELECT CAST(strptime(lpad(CAST(ano_mes AS VARCHAR), 6, '0'), '%Y%m') AS DATE) AS periodo, ano, mes, count(*) AS registros FROM m GROUP BY ALL""")
def parse_period(spark, d):
    rows = movements(spark, d, "ano_mes").select(F.col("ano_mes").alias("ANO/MÊS"))
    return cleaning.parse_dates(rows).groupBy(F.col("ANO/MÊS").alias("periodo"), "ano", "mes").agg(
        F.count(F.lit(1)).alias("registros"))


FORMATS = ("dd/MM/yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "yyyy/MM")
SQL_FORMATS = ("%d/%m/%Y", "%Y-%m-%d", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%Y/%m")


def _detect_sql(name, value):
    cases = " ".join(
        f"WHEN count(*) FILTER (try_strptime(v, '{s}') IS NULL AND v IS NOT NULL) = 0 THEN '{f}'"
        for s, f in zip(SQL_FORMATS, dates.DATE_FORMATS))
    return f"SELECT '{name}' AS coluna, CASE {cases} END AS formato FROM (SELECT {value} AS v FROM lineitem)"


@query("c13_date_formats", " UNION ALL ".join(
    [_detect_sql(f"d{i}", f"strftime(l_shipdate, '{s}')") for i, s in enumerate(SQL_FORMATS)]
    + [_detect_sql("misto", "CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END")]))
def date_formats(spark, d):
    rows = table(spark, d, "lineitem").select(
        *[F.date_format("l_shipdate", f).alias(f"d{i}") for i, f in enumerate(FORMATS)],
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("misto"))
    return cleaning.detect_date_formats(rows, rows.columns)


@query("c14_parse_dates", """
SELECT CAST(l_shipdate AS DATE) AS data_embarque, CAST(l_shipdate AS DATE) AS eta, CAST(year(l_shipdate) AS INTEGER) AS ano,
 CAST(month(l_shipdate) AS INTEGER) AS mes, count(*) AS registros FROM lineitem GROUP BY ALL""")
def parse_dates(spark, d):
    mixed = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "dd-MM-yyyy").alias("DATA EMBARQUE"), mixed.alias("ETA"))
    return cleaning.parse_dates(rows).groupBy(
        F.col("DATA EMBARQUE").alias("data_embarque"), F.col("ETA").alias("eta"), "ano", "mes").agg(F.count(F.lit(1)).alias("registros"))


# Headers a source of the catalog may have; each source holds about half of them.
HEADERS = [c for required, optional in schema.SCHEMAS.values() for c in (*required, *optional)] + [
    "CONSIGNATARIO FINAL", "QTDE CONTAINER", "ANO/MÊS", "PORTO EMBARQUE", "DATA PAGAMENTO", "ETA", "DATA MOVIMENTO", "CARRIER NAME", "I/E"]
CATALOG_SQL = f"""cat AS (SELECT 'src_' || o_orderkey AS source, CAST(i AS INTEGER) AS posicao, ({HEADERS!r})[i] AS coluna
 FROM orders, (SELECT unnest(range(1, {len(HEADERS) + 1})) AS i) WHERE md5(o_orderkey || '#' || i) < '8')"""


def _catalog(spark, d):
    headers = F.posexplode(F.array(*[F.lit(h) for h in HEADERS]))
    listed = table(spark, d, "orders").select("o_orderkey", headers.alias("i", "coluna"))
    position = F.col("i") + 1
    present = F.md5(F.concat_ws("#", F.col("o_orderkey").cast("string"), position.cast("string"))) < "8"
    return listed.where(present).select(
        F.concat(F.lit("src_"), F.col("o_orderkey")).alias("source"), position.alias("posicao"), "coluna")


REGISTRY_SQL = "reg(esquema, ordem, coluna, obrigatoria) AS (VALUES " + ", ".join(
    f"('{name}', {i}, '{c.upper()}', {str(c in required).lower()})"
    for i, (name, (required, optional)) in enumerate(schema.SCHEMAS.items()) for c in (*required, *optional)) + ")"


@query("c15_detect_schema", f"""
WITH {CATALOG_SQL}, {REGISTRY_SQL}, sz AS (SELECT esquema, count(*) AS n, count(*) FILTER (obrigatoria) AS need FROM reg GROUP BY 1),
s AS (SELECT source, esquema, ordem, count(*) AS k, count(DISTINCT reg.coluna) FILTER (obrigatoria) AS o FROM cat JOIN reg ON upper(cat.coluna) = reg.coluna GROUP BY ALL)
SELECT source, esquema, k / n AS score FROM s JOIN sz USING (esquema) WHERE o = need
QUALIFY row_number() OVER (PARTITION BY source ORDER BY k / n DESC, ordem) = 1""")
def detect_schema(spark, d):
    return schema.detect_schema(_catalog(spark, d))


def _folded(words):
    return "(" + " OR ".join(f"contains(f, '{w}')" for w in words) + ")"


ROLES_SQL = " UNION ALL ".join(
    f"SELECT source, '{role}' AS papel, arg_min(coluna, posicao) AS coluna FROM fol WHERE {_folded(words)} GROUP BY source"
    for role, words in schema.roles.ROLE_KEYWORDS.items())
FOLDED_SQL = "fol AS (SELECT *, strip_accents(lower(coluna)) AS f FROM cat)"


@query("c20_tag_roles", f"WITH {CATALOG_SQL}, {FOLDED_SQL} {ROLES_SQL}")
def tag_roles(spark, d):
    return schema.tag_roles(_catalog(spark, d))


DATE_SCORE_SQL = " + ".join(f"CASE WHEN {_folded(w)} THEN {p} ELSE 0 END" for w, p in schema.DATE_SCORES)


@query("c21_best_date_column", f"""
WITH {CATALOG_SQL}, {FOLDED_SQL}, s AS (SELECT source, posicao, coluna, CAST({DATE_SCORE_SQL} AS INTEGER) AS score FROM fol WHERE {_folded(schema.roles.ROLE_KEYWORDS['data'])})
SELECT source, coluna, score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, posicao) = 1""")
def best_date_column(spark, d):
    return schema.best_date_column(_catalog(spark, d))


@query("c16_validate", """
WITH @m SELECT 'logistico' AS esquema, 'CLIENTE' AS ausentes, false AS valid, count(*) AS registros,
 count(*) FILTER (l_linenumber = 7) AS periodos_invalidos FROM m""")
def validate(spark, d):
    rows = movements(spark, d, "qtd_container", "ano_mes", "l_linenumber")
    return schema.validate(rows.select("qtd_container", F.when(F.col("l_linenumber") == 7, "1998-03").otherwise(
        F.col("ano_mes").cast("string")).alias("ANO_MES")), "logistico")


@query("c17_rename_canonical", """
WITH @m SELECT qtd_container, CASE WHEN l_linenumber = 1 THEN cliente WHEN l_linenumber = 2 THEN exportador ELSE 'sem nome' END AS cliente,
 porto_embarque, ano_mes, l_linenumber FROM m""")
def rename_canonical(spark, d):
    line = F.col("l_linenumber")
    rows = movements(spark, d, "qtd_container", "cliente", "exportador", "porto_embarque", "ano_mes", "l_linenumber").select(
        F.col("qtd_container").alias("QTDE CONTAINER"), F.when(line == 1, F.col("cliente")).alias("CONSIGNATARIO FINAL"),
        F.when(line == 2, F.col("exportador")).alias("Nome Exportador"), F.lit("sem nome").alias("DESTINATÁRIO"),
        F.col("porto_embarque").alias("PORTO EMBARQUE"), F.col("ano_mes").alias("ANO/MÊS"), "l_linenumber")
    return cleaning.rename_canonical(rows, schema.ALIASES)


@query("c18_tidy", "SELECT c_name AS nome, c_acctbal AS saldo FROM customer WHERE c_custkey % 5 <> 0")
def tidy(spark, d):
    keep = F.col("c_custkey") % 5 != 0
    rows = table(spark, d, "customer").select(
        F.when(keep, F.col("c_custkey")).alias("Unnamed: 0"), F.when(keep, F.col("c_name")).alias(" nome "),
        F.when(keep, F.col("c_acctbal")).alias("saldo "))
    return cleaning.tidy(rows)


@query("c19_auto_numeric", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS a, 'n' || l_linenumber AS b FROM lineitem""")
def auto_numeric(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(line % 2 == 0, F.col("l_quantity").cast("string")).otherwise("x").alias("a"),
        F.concat(F.lit("n"), line).alias("b"))
    return cleaning.auto_numeric(rows)


def _quantities(spark, d):
    line = F.col("l_linenumber")
    return movements(spark, d, "l_linenumber", "qtd_container", "teus").select(
        F.when(line % 4 == 0, "n/d").otherwise(F.col("qtd_container").cast("string")).alias("QTDE CONTAINER"),
        F.col("teus").alias("TEUS"), F.when(line == 1, F.col("qtd_container")).alias("VOLUMES"),
        (F.col("qtd_container") * 1000).alias("QTD NOTA CONT"))


@query("c22_pick_quantity", """
WITH @m SELECT 'QTDE CONTAINER' AS coluna, 'containers' AS unidade, 18 AS name_score, CAST(count(*) FILTER (l_linenumber % 4 <> 0) AS DOUBLE) / count(*) AS valid_ratio,
 sum(qtd_container) FILTER (l_linenumber % 4 <> 0) AS total FROM m""")
def pick_quantity(spark, d):
    return schema.pick_quantity_column(_quantities(spark, d))


@query("c23_largest_quantity", "WITH @m SELECT 'QTD NOTA CONT' AS coluna, sum(qtd_container * 1000) AS total FROM m")
def largest_quantity(spark, d):
    rows = _quantities(spark, d)
    return schema.largest_quantity_column(rows, rows.columns)


@query("c24_first_quantity", f"""
SELECT {LINE_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS qtd FROM lineitem""")
def first_quantity(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        *LINE, F.when(line % 2 == 0, F.col("l_quantity").cast("string")).otherwise("n/d").alias("qtde"),
        F.when(line % 3 == 0, line).alias("TEUS"))
    return rows.select(*LINE, cleaning.first_quantity(["qtde", "TEUS"]).alias("qtd"))


@query("c25_derive_year_month", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ano_derivado, CAST(CASE WHEN l_linenumber < 6 THEN month(l_shipdate) END AS INTEGER) AS mes_derivado,
 concat_ws('-', CAST(year(l_shipdate) AS VARCHAR), CASE WHEN l_linenumber < 6 THEN strftime(l_shipdate, '%m') END) AS periodo, count(*) AS registros FROM lineitem GROUP BY ALL""")
def derive_year_month(spark, d):
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.when(line < 6, F.month("l_shipdate")).otherwise(13).alias("MÊS"),
        F.when(line == 1, F.date_format("l_shipdate", "dd/MM/yyyy")).alias("DATA CONSULTA"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("DATA EMBARQUE"))
    return cleaning.derive_year_month(rows).groupBy("ano_derivado", "mes_derivado", "periodo").agg(F.count(F.lit(1)).alias("registros"))


@query("c26_canonical_period", "SELECT strftime(l_shipdate, '%Y-%m') AS periodo, count(*) AS registros FROM lineitem GROUP BY ALL")
def canonical_period(spark, d):
    line, day = F.col("l_linenumber"), F.col("l_shipdate")
    rows = table(spark, d, "lineitem").select(
        F.when(line == 1, F.date_format(day, "yyyyMM")).when(line == 2, F.date_format(day, "MM/yyyy"))
        .when(line == 3, F.date_format(day, "yyyy-MM")).alias("ano_mes"),
        F.when(line <= 5, F.year(day)).alias("ano"), F.when(line <= 5, F.month(day)).alias("mes"),
        F.date_format(day, "dd/MM/yyyy").alias("data"))
    return rows.groupBy(cleaning.canonical_period(rows.columns, "data").alias("periodo")).agg(F.count(F.lit(1)).alias("registros"))


LABEL_SQL = "CASE o_orderstatus WHEN 'P' THEN 'Importação' WHEN 'F' THEN 'Exportação' ELSE 'outra' END"


def _label():
    status = F.col("o_orderstatus")
    return F.when(status == "P", "Importação").when(status == "F", "Exportação").otherwise("outra")


@query("c27_operation_codes", f"""
SELECT {LABEL_SQL} AS rotulo, CASE o_orderstatus WHEN 'P' THEN 'importacao' WHEN 'F' THEN 'exportacao' END AS codigo,
 CASE o_orderstatus WHEN 'P' THEN 'importacao' WHEN 'F' THEN 'exportacao' ELSE 'cabotagem' END AS codigo_padrao, count(*) AS pedidos FROM orders GROUP BY ALL""")
def operation_codes(spark, d):
    rows = table(spark, d, "orders").select(_label().alias("rotulo"))
    return rows.select(
        "rotulo", cleaning.map_values(F.col("rotulo"), cleaning.OPERATION_LABELS).alias("codigo"),
        cleaning.map_values(F.col("rotulo"), cleaning.OPERATION_LABELS, "cabotagem").alias("codigo_padrao"),
    ).groupBy("rotulo", "codigo", "codigo_padrao").agg(F.count(F.lit(1)).alias("pedidos"))


@query("j2_mapped_column", f"""
SELECT o_orderkey, CASE {LABEL_SQL} WHEN 'Importação' THEN 'importacao' WHEN 'Exportação' THEN 'exportacao' END AS operacao FROM orders""")
def mapped_column(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", cleaning.map_values(_label(), cleaning.OPERATION_LABELS).alias("operacao"))


@query("c28_client_by_operation", """
WITH @m SELECT tipo_operacao, CASE tipo_operacao WHEN 'importacao' THEN CASE WHEN l_linenumber % 2 = 0 THEN cliente ELSE armador END
 WHEN 'exportacao' THEN exportador WHEN 'cabotagem' THEN CASE WHEN l_linenumber = 3 THEN cliente END END AS quem, count(*) AS registros FROM m GROUP BY ALL""")
def client_by_operation(spark, d):
    line = F.col("l_linenumber")
    rows = movements(spark, d, "tipo_operacao", "cliente", "exportador", "armador", "l_linenumber").select(
        "tipo_operacao", F.when(line % 2 == 0, F.col("cliente")).alias("CONSIGNATARIO FINAL"), F.col("armador").alias("NOME IMPORTADOR"),
        F.col("exportador").alias("NOME EXPORTADOR"), F.when(line == 3, F.col("cliente")).alias("DESTINATÁRIO"))
    return rows.groupBy("tipo_operacao", cleaning.client_of(rows.columns, F.col("tipo_operacao")).alias("quem")).agg(
        F.count(F.lit(1)).alias("registros"))
