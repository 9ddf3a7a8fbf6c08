"""Sources and sinks: tables are written in each format and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.plans import ingest
from portolan.plans.movements import movements, table
from portolan.plans.registry import query
from portolan.session import work_folder
from portolan.sources import chats, sinks, tables

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("s1_read_by_extension", f"SELECT 'parquet' AS formato, * FROM ({CUSTOMER}) UNION ALL SELECT 'csv', * FROM ({CUSTOMER}) UNION ALL SELECT 'json', * FROM ({CUSTOMER})")
def read_by_extension(spark, d):
    folder = work_folder(spark, "s1")
    clients = tables.read_table(spark, f"{d}/customer.parquet")
    sinks.export_csv(clients, f"{folder}/c.csv")
    sinks.export_json(clients, f"{folder}/c.json")
    names = clients.columns
    frames = [clients.select(F.lit("parquet").alias("formato"), *names)]
    for kind in ("csv", "json"):
        back = tables.read_table(spark, f"{folder}/c.{kind}", schema=CUSTOMER_SCHEMA)
        frames.append(back.select(F.lit(kind).alias("formato"), *names))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


TABLE_NAMES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("s2_probe_schemas", " UNION ALL ".join(
    f"SELECT '{t}' AS source, CAST(row_number() OVER () - 1 AS INTEGER) AS posicao, column_name AS coluna, (SELECT count(*) FROM {t}) AS linhas FROM (DESCRIBE SELECT * FROM {t})" for t in TABLE_NAMES))
def probe_schemas(spark, d):
    """The columns of every source, and its rows."""
    paths = {t: f"{d}/{t}.parquet" for t in TABLE_NAMES}
    rows = reduce(DataFrame.union, [tables.read_table(spark, p).agg(F.lit(t).alias("source"), F.count(F.lit(1)).alias("linhas")) for t, p in paths.items()])
    return tables.column_catalog(spark, paths).join(rows, "source").select("source", "posicao", "coluna", "linhas")


@query("s3_all_text", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_acctbal AS saldo FROM customer")
def all_text(spark, d):
    folder = work_folder(spark, "s3")
    sinks.export_csv(table(spark, d, "customer"), f"{folder}/c.csv")
    text = tables.read_table(spark, f"{folder}/c.csv")
    return text.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.col("c_acctbal").try_cast("double").alias("saldo"))


@query("s4_scan_directory", """
SELECT c_name AS nome, 'customer' AS esquema, 'customer.parquet' AS arquivo_origem, c_acctbal AS c_acctbal, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
UNION ALL SELECT s_name, 'supplier', 'supplier.parquet', NULL, s_acctbal FROM supplier""")
def scan_directory(spark, d):
    rows = tables.scan_directory(spark, {"customer": f"{d}/customer.parquet", "supplier": [f"{d}/supplier.parquet"]})
    return rows.select(F.coalesce("c_name", "s_name").alias("nome"), "esquema", "arquivo_origem", "c_acctbal", "s_acctbal")


ACCENTED = "upper(translate(p_name, 'aeiou', 'ãéîõü'))"


@query("s5_csv_encodings", f"SELECT p_partkey, {ACCENTED} AS nome FROM part")
def csv_encodings(spark, d):
    """One folder of files in two encodings; each file is read in its own."""
    folder = work_folder(spark, "s5")
    parts = table(spark, d, "part").select("p_partkey", F.upper(F.translate("p_name", "aeiou", "ãéîõü")).alias("nome"))
    for rest, encoding in enumerate(("UTF-8", "ISO-8859-1")):
        parts.where(F.col("p_partkey") % 2 == rest).write.mode("append").option("header", True).option("encoding", encoding).csv(folder)
    back = tables.read_csv_any_encoding(spark, folder)
    return back.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "nome")


# Bytes of text in one file of whole texts.
FILE_BYTES = 1 << 23


@query("s6_whole_texts", "SELECT md5(text) AS md5, CAST(length(text) AS INTEGER) AS tamanho, count(*) AS copias FROM documents GROUP BY ALL")
def whole_texts(spark, d):
    folder = work_folder(spark, "s6")
    texts = table(spark, d, "documents").select("text")
    # A file is read whole, so files are kept to some megabytes of text.
    files = texts.agg(F.ceil(F.sum(F.octet_length("text")) / FILE_BYTES).cast("int")).first()[0] or 1
    texts.repartition(files).write.option("lineSep", "\u001e").text(folder)
    files = tables.read_documents(spark, folder)
    texts = files.select(F.explode(F.split(F.rtrim("texto", F.lit("\u001e")), "\u001e")).alias("text"))
    return texts.groupBy(F.md5("text").alias("md5"), F.length("text").alias("tamanho")).agg(F.count(F.lit(1)).alias("copias"))


CHATS = "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS turn, role, text FROM conversations"


@query("s7_json_documents", "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS mensagens FROM conversations GROUP BY 1")
def json_documents(spark, d):
    folder = work_folder(spark, "s7")
    sinks.export_json(chats.as_chats(table(spark, d, "conversations")), folder)
    rows = tables.read_json(spark, folder, chats.SCHEMA, one_per_line=True)
    return rows.select("id", F.size("messages").cast("bigint").alias("mensagens"))


def _stored_files(spark, d):
    """Files of text rows, one per source of the documents, and what was written to them."""
    folder = work_folder(spark, "s8")
    docs = table(spark, d, "documents")
    docs.select("source", "doc_id", "lang", "n_chars").write.partitionBy("source").option("header", True).csv(folder)
    return folder


ROWS_SQL = "SELECT source, count(*) AS linhas, CAST(sum(n_chars) AS BIGINT) AS caracteres FROM documents GROUP BY 1"


@query("s8_file_registry", f"SELECT source, '.csv' AS extensao, 'text/csv' AS mime, true AS preenchido, linhas, caracteres FROM ({ROWS_SQL})")
def file_registry(spark, d):
    """The registry of the files written, with the rows that each holds."""
    return _registered(spark, d).groupBy("source", "extensao", "mime").agg(
        F.bool_and((F.col("length") > 0) & F.col("modificationTime").isNotNull()).alias("preenchido"), F.sum("linhas").alias("linhas"), F.sum("caracteres").alias("caracteres"))


def _registered(spark, d):
    folder = _stored_files(spark, d)
    source = r"source=([^/]+)/"
    files = tables.file_registry(spark, f"{folder}/*", "*.csv").withColumn("source", F.regexp_extract("path", source, 1))
    rows = spark.read.schema("doc_id BIGINT, lang STRING, n_chars BIGINT").option("header", True).csv(f"{folder}/*").select(
        F.col("_metadata.file_name").alias("nome"), F.regexp_extract(F.col("_metadata.file_path"), source, 1).alias("source"), "n_chars")
    held = rows.groupBy("source", "nome").agg(F.count(F.lit(1)).alias("linhas"), F.sum("n_chars").alias("caracteres"))
    return files.join(held, ["source", "nome"])


@query("s8_processing_status", "SELECT '.csv' AS extensao, true AS preenchido, count(*) AS linhas FROM documents")
def processing_status(spark, d):
    files = _registered(spark, d)
    rows = files.groupBy("extensao").agg(F.sum("linhas").alias("linhas"))
    status = tables.processing_status(files)
    return status.join(rows, "extensao").select("extensao", ((F.col("arquivos") > 0) & (F.col("bytes") > 0) & F.col("ultimo").isNotNull()).alias("preenchido"), "linhas")


@query("s9_admission", f"SELECT source, true AS admitido, false AS sem_csv, linhas FROM ({ROWS_SQL})")
def admission(spark, d):
    """Whether the files written may be taken in, by source, and the rows that come in with them."""
    files = _registered(spark, d)
    narrow = tuple(e for e in tables.ALLOWED_EXTENSIONS if e != ".csv")
    both = tables.admissible(tables.admissible(files, narrow).withColumnRenamed("admitido", "sem_csv"))
    return both.groupBy("source").agg(F.bool_and("admitido").alias("admitido"), F.bool_or("sem_csv").alias("sem_csv"), F.sum("linhas").alias("linhas"))


@query("s11_chat_files", CHATS)
def chat_files(spark, d):
    folder = work_folder(spark, "s11")
    messages = table(spark, d, "conversations")
    chats.as_chats(messages).write.json(folder)
    return chats.read_chats(spark, folder, one_per_line=True).select("conv_id", "turn", "role", "text")


@query("s12_processed_set", """
WITH @m SELECT 'logistico' AS schema, ano_mes, sum(qtd_container) AS total, count(*) AS linhas, count(DISTINCT cliente) AS clientes FROM m GROUP BY ano_mes""")
def processed_set(spark, d):
    folder = work_folder(spark, "s12")
    sinks.write_processed(movements(spark, d, "ano_mes", "cliente", "qtd_container"), folder, "logistico")
    stored = spark.read.parquet(folder).where("schema = 'logistico'")
    return stored.groupBy("schema", "ano_mes").agg(
        F.sum("qtd_container").alias("total"), F.count(F.lit(1)).alias("linhas"), F.count_distinct("cliente").alias("clientes"))


@query("s13_snapshots", f"SELECT DATE '2024-01-01' AS snapshot, * FROM ({CUSTOMER}) UNION ALL SELECT DATE '2024-01-02', * FROM ({CUSTOMER}) WHERE c_acctbal > 0")
def snapshots(spark, d):
    folder = work_folder(spark, "s13")
    clients = table(spark, d, "customer")
    sinks.write_snapshot(clients, folder, "2024-01-01")
    sinks.write_snapshot(clients, folder, "2024-01-02")
    sinks.write_snapshot(clients.where("c_acctbal > 0"), folder, "2024-01-02")
    return spark.read.parquet(folder)


@query("s14_csv_export", "SELECT doc_id, text, lang FROM documents")
def csv_export(spark, d):
    folder = work_folder(spark, "s14")
    sinks.export_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), f"{folder}/d.csv")
    return tables.read_table(spark, f"{folder}/d.csv", schema="doc_id BIGINT, text STRING, lang STRING", multiLine=True, escape='"')


RAW_HEADERS = {"CONSIGNATARIO FINAL": "cliente", "QTDE CONTAINER": "qtd_container", "DATA EMBARQUE": "data_embarque"}


def _raw(spark, d):
    """Movements as a spreadsheet gives them: texts under other headers, dates day first, decimal commas, blanks."""
    rows = movements(spark, d, "l_orderkey", "l_linenumber", "cliente", "data_embarque", "qtd_container")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chave"), F.concat(F.lit("  "), F.upper("cliente")).alias(" Consignatario Final "),
        F.date_format("data_embarque", "d/M/yyyy").alias("Data Embarque"), F.translate(F.format_number("qtd_container", 2), ",.", ".,").alias("Qtde Container"),
        F.lit(None).cast("string").alias("Unnamed: 5"))


@query("s15_ingestion", """
WITH @m SELECT ano_mes, sum(qtd_container) AS total, count(*) AS linhas, count(DISTINCT lower(cliente)) AS clientes FROM m GROUP BY ano_mes""")
def ingestion(spark, d):
    """Raw texts through the whole job, and what a reader of the processed set then finds."""
    folder = work_folder(spark, "s15")
    ingest.ingest(_raw(spark, d), RAW_HEADERS, "data_embarque", folder, "logistico")
    return spark.read.parquet(folder).groupBy(F.col("ano_mes").cast("int").alias("ano_mes")).agg(
        F.sum("qtd_container").alias("total"), F.count(F.lit(1)).alias("linhas"), F.count_distinct("cliente").alias("clientes"))


@query("s15_ingestion_rerun", """
WITH @m SELECT l_linenumber % 2 = 0 AS par, sum(qtd_container) AS total, count(*) AS linhas FROM m GROUP BY 1""")
def ingestion_rerun(spark, d):
    """Two batches, the first of which runs again; every row is in the set once."""
    folder, raw = work_folder(spark, "s15"), _raw(spark, d)
    even = F.col("chave").rlike("[02468]$")
    for batch, part in (("a", raw.where(even)), ("b", raw.where(~even)), ("a", raw.where(even))):
        ingest.ingest(part, RAW_HEADERS, "data_embarque", folder, "logistico", batch=batch)
    return spark.read.parquet(folder).groupBy((F.col("lote") == "a").alias("par")).agg(F.sum("qtd_container").alias("total"), F.count(F.lit(1)).alias("linhas"))


@query("s15_ingestion_integrity", """
WITH @m SELECT count(*) AS total_records, CAST(0 AS BIGINT) AS nulos_cliente, CAST(min(ano_mes) AS VARCHAR) AS periodo_min, CAST(max(ano_mes) AS VARCHAR) AS periodo_max,
 count(DISTINCT cliente) AS unique_clients, true AS valid FROM m""")
def ingestion_integrity(spark, d):
    row = ingest.ingest(_raw(spark, d), RAW_HEADERS, "data_embarque", work_folder(spark, "s15"), "logistico")
    return row.select("total_records", "nulos_cliente", "periodo_min", "periodo_max", "unique_clients", "valid")
