"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.functions import crypto, dates, numbers, text
from portolan.plans.movements import table
from portolan.plans.registry import query


@query("l1_strings", """
SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS minusculo, replace(p_name, ' ', '_') AS trocado, lpad(CAST(p_size AS VARCHAR), 6, '0') AS codigo,
 substr(p_brand, 2, 4) AS parte, CAST(length(p_name) AS INTEGER) AS tamanho FROM part""")
def strings(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("minusculo"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("trocado"), F.lpad(F.col("p_size").cast("string"), 6, "0").alias("codigo"),
        F.substring("p_brand", 2, 4).alias("parte"), F.length("p_name").alias("tamanho"))


@query("l2_accents", f"SELECT doc_id, translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}') AS texto FROM documents")
def accents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold_accents("text").alias("texto"))


@query("l3_contains", """
SELECT doc_id, contains(lower(nullif(text, '')), 'the') AS literal, coalesce(regexp_matches(lower(nullif(text, '')), 'th[ae]n'), false) AS padrao FROM documents""")
def contains(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.contains_text("text", "THE").alias("literal"), text.matches("text", "TH[AE]N").alias("padrao"))


@query("l4_regex", """
SELECT event_id, regexp_extract(props, '"k": ([0-9]+)', 1) AS k, CAST(len(regexp_extract_all(props, '[0-9]')) AS INTEGER) AS digitos,
 regexp_matches(props, '^\\{') AS objeto FROM events""")
def regex(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.regexp_extract("props", r'"k": ([0-9]+)', 1).alias("k"),
        F.size(F.regexp_extract_all("props", F.lit("[0-9]"), F.lit(0))).alias("digitos"), F.col("props").rlike(r"^\{").alias("objeto"))


@query("l5_formats", """
SELECT o_orderkey, replace(format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), ',', '.') AS milhar, printf('%+d', CAST(trunc(o_totalprice) - 200000 AS BIGINT)) AS sinal,
 printf('%.2f', o_totalprice / 7) || '%' AS fixo FROM orders""")
def formats(spark, d):
    whole = numbers.truncate("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.format_thousands("o_totalprice").alias("milhar"), F.format_string("%+d", whole - 200000).alias("sinal"),
        F.concat(numbers.format_fixed(F.col("o_totalprice") / 7, 2), F.lit("%")).alias("fixo"))


@query("l6_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS ano, CAST(month(o_orderdate) AS INTEGER) AS mes, CAST(quarter(o_orderdate) AS INTEGER) AS trimestre,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS inicio, strftime(o_orderdate, '%Y-%m') AS rotulo FROM orders""")
def date_parts(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.year(day).alias("ano"), F.month(day).alias("mes"), F.quarter(day).alias("trimestre"),
        F.trunc(day, "month").alias("inicio"), dates.month_label(day).alias("rotulo"))


@query("l7_date_arithmetic", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS mais30, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS mes_antes,
 CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dias, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 30 AS meses FROM orders""")
def date_arithmetic(spark, d):
    day, start = F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_add(day, 30).alias("mais30"), F.add_months(day, -1).alias("mes_antes"),
        F.datediff(day, start).alias("dias"), dates.months_between_starts(start, day).alias("meses"))


@query("l8_rounding", """
SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS inteiro, round_even(c_acctbal, 1) AS par, abs(c_acctbal) AS absoluto, greatest(0, c_acctbal) AS minimo_zero FROM customer""")
def rounding(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", numbers.truncate("c_acctbal").alias("inteiro"), F.bround("c_acctbal", 1).alias("par"),
        F.abs("c_acctbal").alias("absoluto"), F.greatest(F.lit(0.0), "c_acctbal").alias("minimo_zero"))


@query("l9_guarded_division", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_quantity * 100.0 / nullif(l_linenumber - 3, 0), 0) AS percentual, (l_quantity - (l_linenumber - 3)) * 100.0 / nullif(l_linenumber - 3, 0) AS variacao FROM lineitem""")
def guarded_division(spark, d):
    base = (F.col("l_linenumber") - 3).cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.percent(F.col("l_quantity"), base).alias("percentual"),
        numbers.percent_change(F.col("l_quantity"), base).alias("variacao"))


@query("l10_coerce", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sem valor' ELSE CAST(o_totalprice AS VARCHAR) END AS v,
 CASE WHEN o_orderkey % 4 = 0 THEN '31/02/1998' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS s FROM orders)
SELECT o_orderkey, TRY_CAST(v AS DOUBLE) AS numero, CAST(try_strptime(s, '%d/%m/%Y') AS DATE) AS data FROM x""")
def coerce(spark, d):
    number = F.when(F.col("o_orderkey") % 3 == 0, "sem valor").otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(F.col("o_orderkey") % 4 == 0, "31/02/1998").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.to_number(number).alias("numero"), dates.parse_date(day, "d/M/yyyy").alias("data"))


@query("l11_digests", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def digests(spark, d):
    return table(spark, d, "documents").select("doc_id", crypto.digest("text").alias("md5"), crypto.digest("text", 256).alias("sha256"))


@query("l12_first_filled", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), CASE WHEN l_linenumber > 3 THEN l_linestatus END, 'nenhum') AS valor FROM lineitem""")
def first_filled(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")), F.lit("nenhum")).alias("valor"))


@query("l13_json", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS texto FROM events""")
def json(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.to_json(F.struct("user_id", "event_type")).alias("texto"))


@query("l14_encryption", "SELECT c_custkey, c_name AS aberto, true AS cifrado, c_name AS invalido FROM customer")
def encryption(spark, d):
    key = F.unhex(F.substring(F.sha2(F.lit("portolan"), 256), 1, 32))
    rows = table(spark, d, "customer").select("c_custkey", "c_name", crypto.encrypt("c_name", key).alias("secreto"))
    return rows.select(
        "c_custkey", crypto.decrypt("secreto", key).alias("aberto"), (F.col("secreto") != F.col("c_name")).alias("cifrado"),
        crypto.decrypt("c_name", key).alias("invalido"))


# Share links derived from the pages, one kind per page in turn.
LINKS = (
    ("https://docs.google.com/spreadsheets/d/", "/edit#gid="), ("https://1drv.ms/x/s!", "?e="), ("https://onedrive.live.com/view.aspx?resid=", "&id="),
    ("https://firma.sharepoint.com/excel/", "?web="), ("https://www.dropbox.com/s/", "/a.xlsx?dl=0&n="), ("https://dropbox.com/s/", "/b?n="),
    ("https://app.box.com/s/", "/"), ("https://www.icloud.com/d/", "/"), ("https://example.com/", ".XLSX"), ("https://onedrive.live.com/", "/view.aspx/"),
)


def _links(spark, d):
    pages = table(spark, d, "pages")
    token = F.md5("url")
    kind = F.col("page_id") % (len(LINKS) + 1)
    link = F.col("url")
    for i, (head, tail) in enumerate(LINKS):
        end = F.lit(tail) if tail == ".XLSX" else F.concat(F.lit(tail), F.col("page_id").cast("string"))
        link = F.when(kind == i, F.concat(F.lit(head), token, end)).otherwise(link)
    return pages.select("page_id", link.alias("link"))


LINKS_SQL = "ln AS (SELECT page_id, CASE page_id % " + str(len(LINKS) + 1) + " " + " ".join(
    f"WHEN {i} THEN '{head}' || md5(url) || '{tail}'" + ("" if tail == ".XLSX" else " || page_id") for i, (head, tail) in enumerate(LINKS)
) + " ELSE url END AS link FROM pages)"
PROVIDER_SQL = """pv AS (SELECT *, CASE WHEN contains(lower(link), 'docs.google.com/spreadsheets') THEN 'google_sheets'
 WHEN contains(lower(link), '1drv.ms') OR contains(lower(link), 'onedrive.live.com') THEN 'onedrive'
 WHEN contains(lower(link), 'sharepoint.com') AND contains(lower(link), 'excel') THEN 'sharepoint' WHEN contains(lower(link), 'dropbox.com') THEN 'dropbox'
 WHEN contains(lower(link), 'box.com') THEN 'box' WHEN contains(lower(link), 'icloud.com') THEN 'icloud'
 WHEN regexp_matches(lower(link), '\\.(xlsx|xls|csv)$') THEN 'direct_file' ELSE 'unknown' END AS provedor FROM ln)"""


@query("l15_provider", f"WITH {LINKS_SQL}, {PROVIDER_SQL} SELECT page_id, provedor FROM pv")
def provider(spark, d):
    return _links(spark, d).select("page_id", text.cloud_provider("link").alias("provedor"))


@query("l16_download_links", f"""
WITH {LINKS_SQL}, {PROVIDER_SQL}, sp AS (SELECT *, CASE WHEN contains(link, '?') THEN '&' ELSE '?' END AS sep, replace(link, '/view.aspx', '/download.aspx') AS visto FROM pv)
SELECT page_id, CASE provedor WHEN 'google_sheets' THEN 'https://docs.google.com/spreadsheets/d/' || regexp_extract(link, '/spreadsheets/d/([a-zA-Z0-9_-]+)', 1)
 || '/export?format=csv&gid=' || regexp_extract(link, '[#&]gid=([0-9]+)', 1) || '&usp=sharing'
 WHEN 'onedrive' THEN CASE WHEN contains(link, 'onedrive.live.com') THEN visto || sep || 'download=1' ELSE link END
 WHEN 'dropbox' THEN CASE WHEN contains(link, 'dl=0') THEN replace(link, 'dl=0', 'dl=1') ELSE link || sep || 'dl=1' END
 WHEN 'sharepoint' THEN link || sep || 'download=1' WHEN 'direct_file' THEN link END AS direto FROM sp""")
def download_links(spark, d):
    return _links(spark, d).select("page_id", text.direct_download_url("link").alias("direto"))


@query("l17_mime", """
WITH f AS (SELECT p_partkey, 'a/' || replace(p_name, ' ', '_') || (['.pdf', '.DOCX', '.xlsx', '.csv', '.txt', '.json', '.parquet', ''])[p_size % 8 + 1] AS arquivo FROM part)
SELECT p_partkey, CASE lower(regexp_extract(arquivo, '(\\.[^./]+)$', 1)) WHEN '.pdf' THEN 'application/pdf'
 WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
 WHEN '.csv' THEN 'text/csv' WHEN '.txt' THEN 'text/plain' WHEN '.json' THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM f""")
def mime(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".pdf", ".DOCX", ".xlsx", ".csv", ".txt", ".json", ".parquet", "")]), F.col("p_size") % 8 + 1)
    name = F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("_")), suffix)
    return table(spark, d, "part").select("p_partkey", text.mime_type(name).alias("mime"))


@query("l18_safe_name", """
SELECT page_id, replace(trim(regexp_replace(' Planilha ção ' || url || ' (v.2) ', '[^\\p{L}\\p{N}_. -]', '', 'g')), ' ', '_') AS nome FROM pages""")
def safe_name(spark, d):
    name = F.concat(F.lit(" Planilha ção "), "url", F.lit(" (v.2) "))
    return table(spark, d, "pages").select("page_id", text.safe_name(name).alias("nome"))


@query("l19_similarity", "SELECT event_id, 1.0::DOUBLE / (1.0::DOUBLE + value) AS similaridade FROM events")
def similarity(spark, d):
    return table(spark, d, "events").select("event_id", numbers.similarity("value").alias("similaridade"))


@query("l20_bands", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity / 50 > 0.8 THEN 'Alta' WHEN l_quantity / 50 > 0.6 THEN 'Média' ELSE 'Baixa' END AS confianca,
 CASE WHEN l_quantity / 50 > 0.7 THEN 'Alta' WHEN l_quantity / 50 > 0.4 THEN 'Média' ELSE 'Baixa' END AS precisao FROM lineitem""")
def bands(spark, d):
    r2 = F.col("l_quantity") / 50
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.confidence_band(r2).alias("confianca"),
        numbers.precision_band(r2).alias("precisao"))
