"""Rows as documents, chunking and text checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions.numbers import format_fixed, to_number
from portolan.functions.text import ASCII_SPACE, truncate_text
from portolan.operators import roles
from portolan.operators.aggregates import sum0

# Signs of tabular text (a word character is a letter, digit or underscore).
WORD = r"[\p{L}\p{N}_]"
TABULAR_PATTERNS = (
    rf"[0-9]+\.\s+{WORD}+.*[0-9]+",
    rf"\|\s*{WORD}+\s*\|",
    r":\s*[0-9]+",
    r"Ranking|Top [0-9]+|Lista|Principais|Maiores|Menores",
)

# A numbered line "n. name - value" or "n. name: value".
NUMBERED_LINE = r"^([0-9]+)\.\s*([^-:]+)[-:]?\s*(.+)?"

# Words that mark growth in an answer.
GROWTH_WORDS = "crescimento|aumento"


def as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text, whole doubles with one decimal at any size."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
        return F.when(c == F.floor(c), whole).otherwise(c.cast("string"))
    return c.cast("string")


def row_documents(df: DataFrame, key: str | None = None) -> DataFrame:
    """One document per row: filled columns as ``name: value`` joined by bars, and as metadata."""
    fields = [f for f in df.schema.fields if f.name != key]
    values = {f.name: as_text(F.col(f"`{f.name}`"), f.dataType) for f in fields}
    content = F.concat_ws(" | ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v)) for n, v in values.items()])
    pairs = [cell for n, v in values.items() for cell in (F.lit(n), v)]
    metadata = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    out = df.select(*([key] if key else []), F.lit("data_record").alias("tipo"), content.alias("conteudo"), metadata.alias("metadata"))
    return out.where("conteudo <> ''")


def role_metadata(df: DataFrame, index: str) -> DataFrame:
    """Documents with their roles: the last filled client, quantity and period column of a row, and its index."""
    def last_filled(names: Sequence[str]) -> Column:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        cells = [as_text(F.col(f"`{c}`"), kinds[c]) for c in reversed(names)]
        return F.coalesce(*cells) if cells else F.lit(None).cast("string")

    named = [c for c in df.columns if c != index]
    client = roles.columns_with(named, ("cliente", "consignatario", "importador", "exportador"))
    quantity = [c for c in roles.columns_with(named, ("qtd", "quantidade", "container", "teus")) if c not in client]
    period = [c for c in roles.columns_with(named, ("data", "mes", "ano", "periodo")) if c not in client + quantity]
    return df.select(
        F.col(index).alias("record_index"), last_filled(client).alias("cliente"), last_filled(quantity).alias("quantidade"),
        last_filled(period).alias("periodo"), F.lit("dataframe").alias("source_type"))


def summary_documents(df: DataFrame, client: str = "cliente", period: str = "ano_mes", value: str = "qtd_container") -> DataFrame:
    """Summary texts per client and per period."""
    number = to_number(value)
    per_client = df.where(F.col(client).isNotNull()).groupBy(F.col(client).cast("string").alias("chave")).agg(
        sum0(number).alias("t"), F.count(number).alias("n"), F.avg(number).alias("a"))
    per_period = df.where(F.col(period).isNotNull()).groupBy(F.col(period).cast("string").alias("chave")).agg(sum0(number).alias("t"))
    total = as_text(F.col("t"), T.DoubleType())
    clients = per_client.select(
        F.lit("client_summary").alias("tipo"), "chave",
        F.concat(F.lit("Cliente: "), "chave", F.lit(" | Total: "), total, F.lit(" | Operações: "), F.col("n").cast("string"),
                 F.lit(" | Média: "), format_fixed("a", 2)).alias("conteudo"),
        F.concat(F.lit("Resumo do cliente "), "chave", F.lit(": Total de "), format_fixed("t", 0),
                 F.lit(" unidades em "), F.col("n").cast("string"), F.lit(" operações, média de "),
                 format_fixed("a", 2), F.lit(" por operação")).alias("resumo"))
    periods = per_period.select(
        F.lit("period_summary").alias("tipo"), "chave",
        F.concat(F.lit("Período: "), "chave", F.lit(" | Total: "), total).alias("conteudo"), F.lit(None).cast("string").alias("resumo"))
    return clients.unionByName(periods)


def chunk_text(text: Column, size: int = 1000, separator: str = "\n\n") -> Column:
    """Paragraphs packed greedily into chunks of up to ``size`` characters.

    Separators are not counted and a paragraph above the size stays whole; blank
    text has no chunks.
    """
    paragraphs = F.filter(
        F.transform(F.split(text, separator.replace("\n", r"\n")), lambda p: F.trim(p, F.lit(ASCII_SPACE))), lambda p: p != "")
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("sz"))

    def merge(acc: Column, p: Column) -> Column:
        full = acc["cur"].isNotNull() & (acc["sz"] + F.length(p) > size)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["cur"].isNull(), p).otherwise(F.concat(acc["cur"], F.lit(separator), p)).alias("cur"),
            F.when(full, F.length(p)).otherwise(acc["sz"] + F.length(p)).alias("sz"),
        )

    return F.aggregate(
        paragraphs, start, merge,
        lambda acc: F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def chunk_documents(df: DataFrame, key: str, text: str, size: int = 1000, separator: str = "\n\n") -> DataFrame:
    """Numbered chunks of every document with the total of its document."""
    chunks = df.select(key, chunk_text(F.col(text), size, separator).alias("partes"))
    return chunks.select(key, F.size("partes").alias("total_chunks"), F.posexplode("partes").alias("chunk_id", "conteudo"))


def truncated(df: DataFrame, text: str, limit: int = 50_000) -> DataFrame:
    return df.withColumn(text, truncate_text(text, limit)).withColumn("char_count", F.length(text))


def is_tabular(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    found = F.lit(False)
    for pattern in TABULAR_PATTERNS:
        found = found | c.rlike("(?i)" + pattern)
    return F.coalesce(found, F.lit(False))


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Items of numbered lists: position, name, first number of the rest, and the rest."""
    line = F.trim(F.col("linha"), F.lit(ASCII_SPACE))
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("linha_no", "linha")).select(key, "linha_no", line.alias("linha"))
    rest = F.trim(F.regexp_extract("linha", NUMBERED_LINE, 3), F.lit(ASCII_SPACE))
    number = F.replace(F.regexp_extract("detalhes", "[0-9,]+", 0), F.lit(","), F.lit(""))
    has_number = F.col("detalhes").rlike("[0-9,]")
    return lines.where(F.col("linha").rlike(NUMBERED_LINE)).select(
        key, "linha_no", F.regexp_extract("linha", NUMBERED_LINE, 1).try_cast("bigint").alias("posicao"),
        F.trim(F.regexp_extract("linha", NUMBERED_LINE, 2), F.lit(ASCII_SPACE)).alias("nome"), rest.alias("detalhes"),
    ).withColumn("valor", F.when(has_number, number).otherwise(F.col("detalhes")))


def mentions_growth(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.lower(c).rlike(GROWTH_WORDS), F.lit(False))


def batches(df: DataFrame, order: Sequence[str], size: int = 100) -> DataFrame:
    """Rows with a running number in the given unique order, and their batch."""
    from portolan.operators.numbering import number_rows

    return number_rows(df, order, "numero").withColumn("lote", F.floor((F.col("numero") - 1) / size))
