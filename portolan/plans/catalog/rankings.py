"""Top-k reports, unions and entity dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from portolan.operators import ranking
from portolan.plans.movements import movements, table
from portolan.plans.registry import query


@query("k1_top_by_count", """
SELECT l_suppkey, CAST(count(*) AS DOUBLE) AS valor FROM lineitem GROUP BY l_suppkey ORDER BY valor DESC, l_suppkey LIMIT 10""")
def top_by_count(spark, d):
    return ranking.top_n(table(spark, d, "lineitem"), "l_suppkey", 10)


@query("k1_top_by_sum", """
WITH @m SELECT armador, sum(qtd_container) AS valor FROM m GROUP BY armador ORDER BY valor DESC, armador LIMIT 10""")
def top_by_sum(spark, d):
    return ranking.top_n(movements(spark, d, "armador", "qtd_container"), "armador", 10, by="qtd_container")


@query("k2_top_clients", """
WITH @m SELECT cliente, CAST(sum(qtd_container) AS BIGINT) AS total_containers, count(ano_mes) AS num_operacoes FROM m
WHERE ano = 1998 GROUP BY cliente ORDER BY total_containers DESC, cliente LIMIT 10""")
def top_clients(spark, d):
    rows = movements(spark, d, "cliente", "ano", "ano_mes", "qtd_container", start="1998-01-01", end="1999-01-01")
    return ranking.top_clients(rows, 10, 1998)


@query("k3_ranking_with_share", """
WITH @m, t AS (SELECT armador, CAST(sum(c20) + 2 * sum(c40) AS BIGINT) AS total FROM m GROUP BY armador),
g AS (SELECT CAST(sum(c20) + 2 * sum(c40) AS BIGINT) AS total_geral FROM m),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, armador) AS INTEGER) AS posicao FROM t)
SELECT posicao, armador, total, CAST(sum(total) OVER () AS DOUBLE) * 100.0 / total_geral AS percentual_top, total_geral
FROM r, g WHERE posicao <= 5""")
def ranking_with_share(spark, d):
    rows = movements(spark, d, "armador", "c20", "c40").select(
        "armador", F.col("c20").alias("C20"), F.col("c40").alias("C40"))
    return ranking.ranking_with_share(rows, "armador", 5)


@query("k4_top_clients_by_volume", """
WITH @m SELECT cliente, sum(qtd_container) AS valor FROM m GROUP BY cliente ORDER BY valor DESC, cliente LIMIT 10""")
def top_clients_by_volume(spark, d):
    return ranking.top_n(movements(spark, d, "cliente", "qtd_container"), "cliente", 10, by="qtd_container")


@query("k6_arg_max", """
WITH @m, a AS (SELECT 'cliente' AS campo, cliente AS chave, sum(qtd_container) AS valor FROM m GROUP BY cliente ORDER BY valor DESC, cliente LIMIT 1),
b AS (SELECT 'ano_mes' AS campo, CAST(ano_mes AS VARCHAR) AS chave, sum(qtd_container) AS valor FROM m GROUP BY ano_mes ORDER BY valor DESC, ano_mes LIMIT 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def arg_max(spark, d):
    def one(key):
        best = ranking.arg_max(movements(spark, d, key, "qtd_container"), key)
        return best.select(F.lit(key).alias("campo"), F.col(key).cast("string").alias("chave"), "valor")
    return one("cliente").unionByName(one("ano_mes"))


@query("k7_top_company", """
WITH @m, u AS (SELECT cliente AS nome, qtd_container FROM m UNION ALL SELECT consignatario, qtd_container FROM m
 UNION ALL SELECT exportador, qtd_container FROM m)
SELECT trim(nome) AS empresa, sum(qtd_container) AS total FROM u GROUP BY 1 ORDER BY total DESC, empresa LIMIT 1""")
def top_company(spark, d):
    rows = movements(spark, d, "cliente", "consignatario", "exportador", "qtd_container")
    return ranking.top_company(rows, ["cliente", "consignatario", "exportador"])


@query("k8_top_per_column", """
WITH @m, u AS (SELECT 'porto_embarque' AS coluna, porto_embarque AS valor FROM m UNION ALL SELECT 'porto_descarga', porto_descarga FROM m
 UNION ALL SELECT 'cliente', cliente FROM m UNION ALL SELECT 'exportador', exportador FROM m),
c AS (SELECT coluna, valor, count(*) AS registros FROM u GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY coluna ORDER BY registros DESC, valor) AS INTEGER) AS posicao FROM c)
SELECT * FROM r WHERE posicao <= 5""")
def top_per_column(spark, d):
    columns = ["porto_embarque", "porto_descarga", "cliente", "exportador"]
    return ranking.top_per_column(movements(spark, d, *columns), columns, 5)


@query("u1_union_by_name", """
SELECT c_name AS nome, c_acctbal AS saldo, c_mktsegment AS segmento, CAST(NULL AS VARCHAR) AS marca FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, NULL FROM supplier
UNION ALL SELECT p_name, NULL, NULL, p_brand FROM part""")
def union_by_name(spark, d):
    from portolan.operators.sets import union_all

    clients = table(spark, d, "customer").select(F.col("c_name").alias("nome"), F.col("c_acctbal").alias("saldo"),
                                                 F.col("c_mktsegment").alias("segmento"))
    carriers = table(spark, d, "supplier").select(F.col("s_name").alias("nome"), F.col("s_acctbal").alias("saldo"))
    parts = table(spark, d, "part").select(F.col("p_name").alias("nome"), F.col("p_brand").alias("marca"))
    return union_all([clients, carriers, parts])


@query("u2_entity_dictionary", """
WITH @m SELECT DISTINCT lower(trim(nome)) AS entidade FROM (SELECT cliente AS nome FROM m UNION ALL SELECT exportador FROM m
 UNION ALL SELECT porto_embarque FROM m)""")
def entity_dictionary(spark, d):
    from portolan.operators.sets import distinct_values

    columns = ["cliente", "exportador", "porto_embarque"]
    return distinct_values(movements(spark, d, *columns), columns)


@query("u3_append_documents", """
SELECT doc_id AS id, 'document' AS tipo, text AS conteudo, source AS origem FROM documents
UNION ALL SELECT item_id, 'benchmark', text, NULL FROM benchmark""")
def append_documents(spark, d):
    from portolan.operators.sets import union_all

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("tipo"),
                                               F.col("text").alias("conteudo"), F.col("source").alias("origem"))
    more = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("tipo"),
                                               F.col("text").alias("conteudo"))
    return union_all([docs, more])
