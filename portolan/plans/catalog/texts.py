"""Documents, chunks, search and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.operators import cells, documents, inverted, numbering, search
from portolan.plans.movements import movements, table
from portolan.plans.registry import query
from portolan.session import work_folder

QUERY = "the thon and than"


@query("x1_row_documents", """
SELECT c_custkey, 'data_record' AS tipo, concat_ws(' | ', 'c_name: ' || c_name, 'c_nationkey: ' || c_nationkey,
 'c_acctbal: ' || CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS VARCHAR) END, 'c_mktsegment: ' || nullif(c_mktsegment, 'MACHINERY')) AS conteudo,
 CAST(4 - CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END - CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS INTEGER) AS campos FROM customer""")
def row_documents(spark, d):
    rows = table(spark, d, "customer").withColumns({
        "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), "c_mktsegment": F.nullif("c_mktsegment", F.lit("MACHINERY"))})
    return documents.row_documents(rows, key="c_custkey").select("c_custkey", "tipo", "conteudo", F.size("metadata").alias("campos"))


@query("x2_summary_documents", """
WITH @m SELECT 'client_summary' AS tipo, cliente AS chave,
 'Cliente: ' || cliente || ' | Total: ' || CAST(sum(qtd_container) AS VARCHAR) || ' | Operações: ' || count(*) || ' | Média: ' || printf('%.2f', sum(qtd_container) / count(*)) AS conteudo,
 'Resumo do cliente ' || cliente || ': Total de ' || CAST(CAST(sum(qtd_container) AS BIGINT) AS VARCHAR) || ' unidades em ' || count(*) || ' operações, média de ' || printf('%.2f', sum(qtd_container) / count(*)) || ' por operação' AS resumo FROM m GROUP BY cliente
UNION ALL SELECT 'period_summary', CAST(ano_mes AS VARCHAR), 'Período: ' || ano_mes || ' | Total: ' || CAST(sum(qtd_container) AS VARCHAR), NULL FROM m GROUP BY ano_mes""")
def summary_documents(spark, d):
    return documents.summary_documents(movements(spark, d, "cliente", "ano_mes", "qtd_container"))


@query("x3_role_metadata", """
WITH @m SELECT l_orderkey AS record_index, CASE WHEN l_linenumber = 3 THEN cliente ELSE exportador END AS cliente,
 CAST(teus AS VARCHAR) AS quantidade, CAST(ano_mes AS VARCHAR) AS periodo, 'dataframe' AS source_type FROM m""")
def role_metadata(spark, d):
    rows = movements(spark, d, "l_orderkey", "l_linenumber", "cliente", "exportador", "qtd_container", "teus", "data_embarque", "ano_mes")
    hidden = F.when(F.col("l_linenumber") != 3, F.col("exportador"))
    return documents.role_metadata(rows.withColumn("exportador", hidden).drop("l_linenumber"), "l_orderkey")


CHUNKS = """pz AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31))), lambda p: p <> '') AS ps FROM documents),
st AS (SELECT doc_id, list_transform(ps, lambda p: {'done': CAST([] AS VARCHAR[]), 'cur': p, 'sz': length(p)}) AS ss FROM pz WHERE len(ps) > 0),
rd AS (SELECT doc_id, list_reduce(ss, lambda a, b: CASE WHEN a.sz + b.sz > 1000 THEN {'done': list_append(a.done, a.cur), 'cur': b.cur, 'sz': b.sz}
 ELSE {'done': a.done, 'cur': a.cur || chr(10) || b.cur, 'sz': a.sz + b.sz} END) AS r FROM st),
ch AS (SELECT doc_id, list_append(r.done, r.cur) AS partes FROM rd)"""


@query("x4_chunks", f"""
WITH {CHUNKS} SELECT doc_id, CAST(len(partes) AS INTEGER) AS total_chunks, CAST(generate_subscripts(partes, 1) - 1 AS INTEGER) AS chunk_id,
 unnest(partes) AS conteudo FROM ch""")
def chunks(spark, d):
    return documents.chunk_documents(table(spark, d, "documents"), "doc_id", "text", 1000, "\n")


@query("x5_chunk_numbers", f"""
WITH {CHUNKS} SELECT doc_id, count(*) AS partes, CAST(max(i) AS INTEGER) AS ultimo FROM (SELECT doc_id, unnest(range(len(partes))) AS i FROM ch) GROUP BY doc_id""")
def chunk_numbers(spark, d):
    rows = documents.chunk_documents(table(spark, d, "documents"), "doc_id", "text", 1000, "\n")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("partes"), F.max("chunk_id").alias("ultimo"))


def _occurrences_sql(word):
    return f"(length(lower(text)) - length(replace(lower(text), '{word}', ''))) // {len(word)}"


SCORE_SQL = " + ".join(_occurrences_sql(w) for w in QUERY.split())


@query("x6_keyword_search", f"""
SELECT doc_id, CAST({SCORE_SQL} AS BIGINT) AS score FROM documents WHERE {SCORE_SQL} > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def keyword_search(spark, d):
    return search.keyword_search(table(spark, d, "documents"), QUERY, 10).select("doc_id", "score")


MANY = """qw AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+')) AS w FROM benchmark),
wc AS (SELECT item_id, w, count(*) AS k FROM qw WHERE w <> '' GROUP BY ALL),
dw AS (SELECT DISTINCT w FROM wc),
oc AS (SELECT doc_id, w, (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) AS n FROM documents JOIN dw ON contains(lower(text), w)),
kw AS (SELECT item_id AS query_id, doc_id, CAST(sum(n * k) AS BIGINT) AS score FROM oc JOIN wc USING (w) GROUP BY ALL),
kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS posicao FROM kw)"""


def _keyword_hits(spark, d, k, blanks=("", "")):
    """blanks: what a space becomes in queries and in documents."""
    docs = table(spark, d, "documents").withColumn("text", F.translate("text", " " * len(blanks[1]), blanks[1]))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.translate("text", " " * len(blanks[0]), blanks[0]).alias("query"))
    return search.keyword_search_many(docs, queries, k)


@query("x6_keyword_search_many", f"WITH {MANY} SELECT query_id, doc_id, score, posicao FROM kr WHERE posicao <= 5")
def keyword_search_many(spark, d):
    return _keyword_hits(spark, d, 5)


@query("x6_keyword_search_many_blanks", f"WITH {MANY} SELECT query_id, doc_id, score, posicao FROM kr WHERE posicao <= 5")
def keyword_search_many_blanks(spark, d):
    """Unicode spaces part words as the ASCII space does."""
    return _keyword_hits(spark, d, 5, ("\u2003", "\u00a0"))


def _index(spark, d):
    """Three batches by language, the second of which ran twice, with the language as a tag."""
    path = work_folder(spark, "x16")
    docs = table(spark, d, "documents")
    for batch, some in (("a", "lang = 'en'"), ("b", "lang = 'de'"), ("b", "lang = 'de'"), ("c", "lang NOT IN ('en', 'de')")):
        inverted.add(docs.where(some), path, batch, tags=["lang"])
    return path


@query("x16_index_files", """
WITH t AS (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')) AS n FROM documents)
SELECT CASE WHEN lang = 'en' THEN 'a' WHEN lang = 'de' THEN 'b' ELSE 'c' END AS lote, source AS arquivo, count(*) AS registros, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY ALL""")
def index_files(spark, d):
    return inverted.read(spark, _index(spark, d), "files").select("lote", "arquivo", "registros", "tokens")


@query("x16_index_search", f"WITH {MANY} SELECT query_id, doc_id, score, posicao FROM kr WHERE posicao <= 5")
def index_search(spark, d):
    """The scan's hits from the index, after its batches are merged."""
    path, merged = _index(spark, d), work_folder(spark, "x16")
    inverted.compact(spark, path, merged)
    inverted.remove(spark, path)  # nothing reads it any more
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return inverted.search_many(spark, merged, queries)


def _first_vector(vectors):
    """The vector with the smallest id, as a scalar."""
    return vectors.agg(F.min_by("embedding", "vec_id")).scalar()


@query("x7_inner_product", """
WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings)
SELECT vec_id, label, round_even(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) DESC, vec_id LIMIT 10""")
def inner_product(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = search.vector_search(vectors, _first_vector(vectors), 10)
    return hits.select("vec_id", "label", F.bround("score", 6).alias("score"))


L2 = "pow(list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 2)"


@query("x8_l2_distance", f"""
WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
s AS (SELECT vec_id, {L2} AS s FROM embeddings, q ORDER BY s, vec_id LIMIT 10)
SELECT vec_id, round_even(s, 6) AS score, round_even(1 / (1 + s), 6) AS similarity FROM s""")
def l2_distance(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = search.vector_search(vectors, _first_vector(vectors), 10, metric="l2")
    return hits.select("vec_id", F.bround("score", 6).alias("score"), F.bround("similarity", 6).alias("similarity"))


@query("x9_distance_ceiling", f"""
WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
s AS (SELECT vec_id, {L2} AS s FROM embeddings, q ORDER BY s, vec_id LIMIT 50)
SELECT vec_id, round_even(s, 6) AS score FROM s WHERE s <= 1.42""")
def distance_ceiling(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = search.vector_search(vectors, _first_vector(vectors), 50, metric="l2", max_distance=1.42)
    return hits.select("vec_id", F.bround("score", 6).alias("score"))


@query("x10_filtered_search", f"""
SELECT doc_id, source, CAST({SCORE_SQL} AS BIGINT) AS score FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND {SCORE_SQL} > 0
ORDER BY score DESC, doc_id LIMIT 10""")
def filtered_search(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en' AND source IN ('src1', 'src2')")
    return search.keyword_search(docs, QUERY, 10).select("doc_id", "source", "score")


VECTORS = """vq AS (SELECT item_id AS query_id, embedding AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
vs AS (SELECT query_id, vec_id, pow(list_distance(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 2) AS s FROM embeddings, vq),
vr AS (SELECT query_id, vec_id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS INTEGER) AS posicao FROM vs)"""


def _vector_hits(spark, d, k):
    vectors = table(spark, d, "embeddings")
    queries = table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(
        F.col("item_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.vector_search_many(vectors, queries, k)


@query("x8_l2_many", f"""
WITH {VECTORS} SELECT query_id, vec_id, round_even(s, 6) AS score, round_even(1 / (1 + s), 6) AS similarity, posicao FROM vr WHERE posicao <= 5""")
def l2_many(spark, d):
    hits = _vector_hits(spark, d, 5)
    return hits.select("query_id", "vec_id", F.bround("score", 6).alias("score"), F.bround("similarity", 6).alias("similarity"), "posicao")


CELLS, PROBES = 32, 20
# The nearest cells of vectors and of queries; every vector is filed, the queries are those whose id 50 divides.
FILED = f"""ce AS (SELECT CAST(row_number() OVER (ORDER BY md5(vec_id::VARCHAR), embedding) - 1 AS INTEGER) AS celula, CAST(embedding AS DOUBLE[]) AS c FROM embeddings QUALIFY celula < {CELLS}),
nr AS (SELECT vec_id, embedding, celula, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(CAST(embedding AS DOUBLE[]), c), celula) AS perto FROM embeddings, ce),
fi AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, celula FROM nr WHERE perto = 1),
ak AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, celula FROM nr WHERE perto <= {PROBES} AND vec_id % 50 = 0),
ap AS (SELECT query_id, vec_id, pow(list_distance(e, v), 2) AS s FROM ak JOIN fi USING (celula)),
ah AS (SELECT query_id, vec_id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS INTEGER) AS posicao FROM ap QUALIFY posicao <= 5)"""


def _cell_hits(spark, d, rounds=0):
    """Hits by cells, and the exact ones, of the same queries."""
    vectors = table(spark, d, "embeddings")
    centres = cells.fit(vectors, CELLS, rounds)
    folder = work_folder(spark, "x8")
    cells.build_index(vectors, centres, folder)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return cells.search(spark.read.parquet(folder), centres, queries, PROBES), search.vector_search_many(vectors, queries)


@query("x8_cells", f"WITH {FILED} SELECT query_id, vec_id, round_even(s, 6) AS score, posicao FROM ah")
def cell_search(spark, d):
    return _cell_hits(spark, d)[0].select("query_id", "vec_id", F.bround("score", 6).alias("score"), "posicao")


@query("x8_cells_recall", f"""
WITH {FILED}, eq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
ex AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_distance(CAST(embedding AS DOUBLE[]), v), vec_id) AS INTEGER) AS posicao FROM embeddings, eq QUALIFY posicao <= 5)
SELECT count(ah.vec_id) AS acertos, count(*) AS total, count(ah.vec_id)::DOUBLE / count(*) AS recall FROM ex LEFT JOIN ah USING (query_id, vec_id)""")
def cell_recall(spark, d):
    return cells.recall(*_cell_hits(spark, d))


@query("x7_label_centroids", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM c GROUP BY label),
s AS (SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS posicao FROM s)
SELECT query_id, vec_id, round_even(s, 6) AS score, posicao FROM r WHERE posicao <= 5""")
def label_centroids(spark, d):
    vectors = table(spark, d, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    queries = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select(
        F.col("label").alias("query_id"), F.transform("c", lambda p: p["x"]).alias("query"))
    hits = search.vector_search_many(vectors, queries, 5, metric="inner")
    return hits.withColumn("score", F.bround("score", 6))


@query("j4_hit_to_document", f"""
WITH q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings), s AS (SELECT vec_id, {L2} AS s FROM embeddings, q ORDER BY s, vec_id LIMIT 10)
SELECT vec_id, round_even(s, 6) AS score, source, text FROM s JOIN documents ON vec_id = doc_id""")
def hit_to_document(spark, d):
    vectors = table(spark, d, "embeddings")
    hits = search.vector_search(vectors, _first_vector(vectors), 10, metric="l2")
    return hits.join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(
        "vec_id", F.bround("score", 6).alias("score"), "source", "text")


FUSED = """pa AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + posicao) AS s FROM kr WHERE posicao <= 20
 UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (60 + posicao) FROM vr WHERE posicao <= 20),
fu AS (SELECT query_id, doc_id, sum(s) AS score FROM pa GROUP BY ALL)"""


@query("x11_hybrid_search", f"""
WITH {MANY}, {VECTORS}, {FUSED} SELECT query_id, doc_id, round_even(score, 9) AS score,
 CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS posicao FROM fu QUALIFY posicao <= 5""")
def hybrid_search(spark, d):
    keyword = _keyword_hits(spark, d, 20)
    vector = _vector_hits(spark, d, 20).withColumnRenamed("vec_id", "doc_id")
    return search.fuse_rankings([keyword, vector], 5).withColumn("score", F.bround("score", 9))


@query("x12_truncate", """
SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || chr(10) || chr(10) || '[Conteúdo truncado...]' ELSE text END AS text,
 CAST(CASE WHEN length(text) > 5000 THEN 5000 + 24 ELSE length(text) END AS INTEGER) AS char_count FROM documents""")
def truncate(spark, d):
    return documents.truncated(table(spark, d, "documents"), "text", 5000).select("doc_id", "text", "char_count")


def _lists(spark, d):
    """Document texts, and numbered lists derived from the carriers."""
    carriers = table(spark, d, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("id"),
        F.concat(F.lit("Resumo\n 1. "), "s_name", F.lit(" - "), F.format_number("s_acctbal", 2), F.lit(" containers\n2. Nação: "),
                 F.col("s_nationkey").cast("string"), F.lit("\n3. sem valor")).alias("texto"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto")).unionByName(carriers)


LISTS = """tx AS (SELECT doc_id AS id, text AS texto FROM documents UNION ALL SELECT -s_suppkey - 1, 'Resumo' || chr(10) || ' 1. ' || s_name || ' - ' || format('{:,.2f}', s_acctbal)
 || ' containers' || chr(10) || '2. Nação: ' || s_nationkey || chr(10) || '3. sem valor' FROM supplier)"""
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"


@query("x13_tabular", f"WITH {LISTS} SELECT id, " + " OR ".join(
    f"regexp_matches(texto, '(?i){p}')" for p in documents.TABULAR_PATTERNS) + " AS tabular FROM tx")
def tabular(spark, d):
    return _lists(spark, d).select("id", documents.is_tabular("texto").alias("tabular"))


@query("x14_numbered_lines", f"""
WITH {LISTS}, ln AS (SELECT id, generate_subscripts(string_split(texto, chr(10)), 1) - 1 AS n, trim(unnest(string_split(texto, chr(10))), {SPACES}) AS linha FROM tx),
ex AS (SELECT id, n, regexp_extract(linha, '{documents.NUMBERED_LINE}', 1) AS p, trim(regexp_extract(linha, '{documents.NUMBERED_LINE}', 2), {SPACES}) AS nome,
 trim(regexp_extract(linha, '{documents.NUMBERED_LINE}', 3), {SPACES}) AS detalhes FROM ln WHERE regexp_matches(linha, '{documents.NUMBERED_LINE}'))
SELECT id, CAST(n AS INTEGER) AS linha_no, TRY_CAST(p AS BIGINT) AS posicao, nome, detalhes,
 CASE WHEN regexp_matches(detalhes, '[0-9,]') THEN replace(regexp_extract(detalhes, '[0-9,]+', 0), ',', '') ELSE detalhes END AS valor FROM ex""")
def numbered_lines(spark, d):
    return documents.numbered_lines(_lists(spark, d), "id", "texto")


@query("x15_growth_flag", """
WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN text || ' Houve AUMENTO.' ELSE text END AS texto FROM conversations)
SELECT conv_id, turn, (contains(lower(texto), 'crescimento') OR contains(lower(texto), 'aumento')) AS crescimento FROM a""")
def growth_flag(spark, d):
    answer = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" Houve AUMENTO."))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", documents.mentions_growth(answer).alias("crescimento"))


@query("x16_batches", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS numero, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 100 AS BIGINT) AS lote FROM documents""")
def batches(spark, d):
    return documents.batches(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("x17_context", f"""
WITH {VECTORS}, h AS (SELECT query_id, posicao, s, text, source FROM vr JOIN documents ON vec_id = doc_id WHERE posicao <= 3)
SELECT query_id, string_agg('[Documento ' || posicao || ']' || chr(10) || 'Conteúdo:' || chr(10) || text || chr(10) || 'Fonte: ' || source || chr(10)
 || 'Relevância: ' || printf('%.2f', 1 / (1 + s)) || chr(10) || chr(10), '' ORDER BY posicao) AS contexto,
 string_agg(DISTINCT source, ', ' ORDER BY source) AS fontes FROM h GROUP BY query_id""")
def context(spark, d):
    hits = _vector_hits(spark, d, 3).withColumnRenamed("vec_id", "doc_id")
    return search.assemble_context(hits, table(spark, d, "documents"))


@query("a30_index_statistics", f"""
WITH {CHUNKS} SELECT count(DISTINCT doc_id) AS documentos, CAST(sum(len(partes)) AS BIGINT) AS chunks, (SELECT count(*) FROM embeddings) AS vetores,
 (SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS dimensao FROM ch""")
def index_statistics(spark, d):
    rows = documents.chunk_documents(table(spark, d, "documents"), "doc_id", "text", 1000, "\n")
    return search.index_statistics(rows, table(spark, d, "embeddings"))


@query("w16_anonymize", """
WITH @m, f AS (SELECT cliente, min(data_embarque) AS d FROM m GROUP BY 1),
n AS (SELECT cliente, format('CLIENTE_{:03d}', row_number() OVER (ORDER BY d, cliente)) AS anonimo FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, qtd_container, anonimo AS cliente FROM m JOIN n USING (cliente)""")
def anonymize(spark, d):
    rows = movements(spark, d, "l_orderkey", "l_linenumber", "l_partkey", "qtd_container", "cliente", "data_embarque")
    return numbering.anonymize(rows).drop("data_embarque")


@query("x18_brief", """
WITH @m, t AS (SELECT ano_mes, sum(qtd_container) AS total FROM m GROUP BY 1),
u AS (SELECT 'porto_embarque' AS coluna, porto_embarque AS v FROM m UNION ALL SELECT 'porto_descarga', porto_descarga FROM m
 UNION ALL SELECT 'cliente', cliente FROM m UNION ALL SELECT 'exportador', exportador FROM m),
c AS (SELECT coluna, v, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY coluna ORDER BY n DESC, v) AS INTEGER) AS p FROM c),
e AS (SELECT *, row_number() OVER (ORDER BY ano_mes) AS p FROM (SELECT * FROM t ORDER BY ano_mes DESC LIMIT 6)),
z AS (SELECT ano_mes, (total - lag(total) OVER (ORDER BY ano_mes)) * 100.0 / nullif(lag(total) OVER (ORDER BY ano_mes), 0) AS x FROM t ORDER BY ano_mes DESC LIMIT 1),
g AS (SELECT tipo_carga AS v, count(*) AS n FROM m GROUP BY 1)
SELECT 'registros' AS secao, 1 AS ordem, 'total' AS chave, CAST(count(*) AS VARCHAR) AS valor FROM m
UNION ALL SELECT 'periodo', 1, 'inicio', strftime(min(data_embarque), '%d/%m/%Y') FROM m UNION ALL SELECT 'periodo', 2, 'fim', strftime(max(data_embarque), '%d/%m/%Y') FROM m
UNION ALL SELECT 'periodo', 3, 'anos', string_agg(ano, ',' ORDER BY ano) FROM (SELECT DISTINCT ano FROM m)
UNION ALL SELECT 'periodo', 4, 'meses', string_agg(mes, ',' ORDER BY mes) FROM (SELECT DISTINCT mes FROM m)
UNION ALL SELECT 'containers', 1, 'total', CAST(CAST(sum(qtd_container) AS BIGINT) AS VARCHAR) FROM m
UNION ALL SELECT 'principais ' || coluna, p, v, CAST(n AS VARCHAR) FROM r WHERE p <= 5
UNION ALL SELECT 'evolucao', CAST(p AS INTEGER), CAST(ano_mes AS VARCHAR), CAST(CAST(total AS BIGINT) AS VARCHAR) FROM e
UNION ALL SELECT 'variacao', 1, CAST(ano_mes AS VARCHAR), printf('%.1f', x) || '%' FROM z
UNION ALL SELECT 'distribuicao tipo_carga', CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER), v, CAST(n AS VARCHAR) FROM g QUALIFY row_number() OVER (ORDER BY n DESC, v) <= 10""")
def table_brief(spark, d):
    from portolan.plans.brief import brief

    rows = movements(spark, d, "data_embarque", "ano", "mes", "ano_mes", "qtd_container", "porto_embarque", "porto_descarga",
                     "cliente", "exportador", "tipo_carga")
    return brief(rows, {"operacional": ["tipo_carga"]})
