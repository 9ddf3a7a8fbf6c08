"""Schema rules over a catalog of many sources: rows (source, posicao, coluna)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.numbers import to_number
from portolan.functions.text import any_of, fold_accents, fold_name
from portolan.operators import roles
from portolan.operators.aggregates import sum0
from portolan.operators.cleaning import numeric_or_digits

# Declared schemas as (required, optional) columns.
SCHEMAS = {
    "logistico": (("qtd_container", "cliente", "ano_mes"), ("tipo_operacao", "porto", "armador", "navio")),
    "comercial": (("cliente", "receita", "periodo"), ("vendedor", "regiao", "produto", "margem")),
    "budget": (("periodo", "meta_receita", "meta_containers"), ("departamento", "responsavel", "observacoes")),
    "oportunidades": (("cliente", "valor_estimado", "probabilidade", "data_fechamento"),
                      ("origem", "responsavel", "status", "observacoes")),
}

# Period columns per schema, checked to be yyyyMM.
PERIOD_COLUMNS = {"logistico": "ano_mes", "comercial": "periodo", "budget": "periodo"}

# Header aliases.
ALIASES = {
    "QTDE CONTAINER": "qtd_container", "QTDE CONTEINER": "qtd_container",
    "QUANTIDADE C20": "qtd_c20", "QUANTIDADE C40": "qtd_c40",
    "CONSIGNATÁRIO": "cliente", "CONSIGNATARIO FINAL": "cliente", "NOME EXPORTADOR": "cliente", "DESTINATÁRIO": "cliente",
    "ANO/MÊS": "ano_mes", "PORTO EMBARQUE": "porto_embarque", "PORTO DESCARGA": "porto_descarga",
    "RECEITA": "receita", "FATURAMENTO": "receita", "VALOR": "receita", "VENDEDOR": "vendedor", "REGIÃO": "regiao",
    "META RECEITA": "meta_receita", "META CONTAINERS": "meta_containers", "ORÇAMENTO": "meta_receita",
    "VALOR ESTIMADO": "valor_estimado", "PROBABILIDADE": "probabilidade", "DATA FECHAMENTO": "data_fechamento",
    "CLIENTE POTENCIAL": "cliente",
}

# Points of a header as period column.
DATE_SCORES = (
    (("ano_mes", "ano/mes", "ano-mes", "mes/ano"), 6), (("mov",), 5), (("embarque",), 4), (("eta", "ets"), 3),
    (("pagament", "fatura", "desconto", "emissao"), -5), (("data",), 1), (("mes",), 1),
)

# Points of a header as quantity column.
QUANTITY_SCORES = (
    (("qtd", "qtde", "qte", "quant"), 10), (("container", "cntr", "cont"), 8), (("teus",), 6), (("volume",), 5),
    (("data", "pagament", "desconto", "fatura", "emissao", "nota", "nfe", "document"), -20),
)


def registry(spark: SparkSession) -> DataFrame:
    """The declared schemas as rows; the table has a fixed, small size."""
    rows = [(name, order, column.upper(), column in required)
            for order, (name, (required, optional)) in enumerate(SCHEMAS.items()) for column in (*required, *optional)]
    return spark.createDataFrame(rows, "esquema string, ordem int, coluna string, obrigatoria boolean")


def detect_schema(catalog: DataFrame) -> DataFrame:
    """Best schema of every source: all required columns present, highest matched share, first on ties."""
    declared = registry(catalog.sparkSession)
    sizes = {name: (len(required), len(required) + len(optional)) for name, (required, optional) in SCHEMAS.items()}
    named = catalog.select("source", F.upper("coluna").alias("coluna"))
    matched = named.join(F.broadcast(declared), "coluna").groupBy("source", "esquema", "ordem").agg(
        F.count(F.lit(1)).alias("achadas"),
        F.count_distinct(F.when(F.col("obrigatoria"), F.col("coluna"))).alias("obrigatorias"),
    )
    needed, size = F.lit(0), F.lit(1)
    for name, (n, m) in sizes.items():
        needed = F.when(F.col("esquema") == name, n).otherwise(needed)
        size = F.when(F.col("esquema") == name, m).otherwise(size)
    score = F.col("achadas") / size
    return matched.where(F.col("obrigatorias") == needed).groupBy("source").agg(
        F.max_by(F.struct("esquema", score.alias("score")), F.struct(score, -F.col("ordem"))).alias("b")
    ).select("source", "b.esquema", "b.score")


def _headers(catalog: DataFrame) -> DataFrame:
    """Distinct headers with their folded form; a catalog repeats few headers many times."""
    return catalog.select("coluna").distinct().withColumn("dobrada", fold_accents("coluna"))


def _folded_contains(words: Sequence[str]) -> Column:
    return any_of(F.contains(F.col("dobrada"), F.lit(word)) for word in words)


def tag_roles(catalog: DataFrame) -> DataFrame:
    """First column of every role in every source."""
    tags = F.array_compact(F.array(*[F.when(_folded_contains(words), F.lit(role)) for role, words in roles.ROLE_KEYWORDS.items()]))
    tagged = _headers(catalog).select("coluna", F.explode(tags).alias("papel"))
    return catalog.join(tagged, "coluna").groupBy("source", "papel").agg(F.min_by("coluna", "posicao").alias("coluna"))


def _score(rules) -> Column:
    total = F.lit(0)
    for words, points in rules:
        total = total + F.when(_folded_contains(words), points).otherwise(0)
    return total


def best_date_column(catalog: DataFrame) -> DataFrame:
    """Date column with the highest header score of every source, first on ties."""
    scored = _headers(catalog).where(_folded_contains(roles.ROLE_KEYWORDS["data"])).select("coluna", _score(DATE_SCORES).alias("score"))
    dated = catalog.join(scored, "coluna")
    return dated.groupBy("source").agg(
        F.max_by(F.struct("coluna", "score"), F.struct("score", -F.col("posicao"))).alias("b")
    ).select("source", "b.coluna", "b.score")


def validate(df: DataFrame, schema: str) -> DataFrame:
    """Missing required columns and periods that are not yyyyMM, in one pass."""
    required, _ = SCHEMAS[schema]
    present = {c.upper(): c for c in df.columns}
    missing = [c.upper() for c in required if c.upper() not in present]
    period = present.get(PERIOD_COLUMNS.get(schema, "").upper())
    bad = F.lit(0).cast("bigint")
    if period:
        text = F.col(f"`{period}`").cast("string")
        bad = F.count_if(text.isNotNull() & ~text.rlike("^[0-9]{6}$"))
    return df.agg(F.count(F.lit(1)).alias("registros"), bad.alias("periodos_invalidos")).select(
        F.lit(schema).alias("esquema"), F.lit(", ".join(missing)).alias("ausentes"), F.lit(not missing).alias("valid"),
        "registros", "periodos_invalidos")


def name_score(name: str, rules=QUANTITY_SCORES) -> int:
    folded = fold_name(name)
    return sum(points for words, points in rules if any(w in folded for w in words))


def quantity_unit(name: str) -> str:
    folded = fold_name(name)
    return "TEUs" if "teus" in folded else "volumes" if "volume" in folded else "containers"


def pick_quantity_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Best quantity column by header score, share of numbers (5 % at least) and total."""
    names = list(columns or roles.role_columns(df.columns, "quantidade"))
    texts = [f.name for f in df.schema.fields if f.name in names and f.dataType.simpleString() == "string"]
    read = numeric_or_digits(df.select(*[F.col(f"`{c}`") for c in names]), texts) if texts else df
    measures = []
    for i, c in enumerate(names):
        measures += [F.avg(F.col(f"`{c}`").isNotNull().cast("int")).alias(f"v{i}"), sum0(F.col(f"`{c}`").cast("double")).alias(f"t{i}")]
    row = read.agg(*measures)
    candidates = F.array(*[
        F.struct(F.lit(name_score(c)).alias("name_score"), F.col(f"v{i}").alias("valid_ratio"), F.col(f"t{i}").alias("total"),
                 F.lit(-i).alias("ordem"), F.lit(c).alias("coluna"), F.lit(quantity_unit(c)).alias("unidade"))
        for i, c in enumerate(names)
    ])
    best = F.array_max(F.filter(candidates, lambda x: (x["valid_ratio"] >= 0.05) & (x["name_score"] >= -10)))
    return row.select(best.alias("b")).where("b is not null").select("b.coluna", "b.unidade", "b.name_score", "b.valid_ratio", "b.total")


def largest_quantity_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quantity column with the largest positive sum."""
    row = df.agg(*[F.sum(to_number(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.col(f"s{i}").alias("total"), F.lit(-i).alias("ordem"), F.lit(c).alias("coluna"))
                      for i, c in enumerate(columns)])
    best = F.array_max(F.filter(cells, lambda x: x["total"] > 0))
    return row.select(best.alias("b")).where("b is not null").select("b.coluna", "b.total")
