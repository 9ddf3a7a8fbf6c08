"""Questions as a table: intent, dates, entities and filters of every question."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.membership import may_hold, place_bits
from portolan.functions.numbers import percent_change
from portolan.functions.text import any_of, fold_accents, normalize_text
from portolan.operators import aggregates as agg
from portolan.operators import ranking, series
from portolan.operators.filters import FilterSet, apply_filters

# Words per intent, tried in this order; none means a total.
INTENT_WORDS = {
    "comparacao": ("compare", "comparar", "diferença", "variação", "versus", "vs"),
    "ranking": ("principais", "ranking", "top", "maiores", "ordenados", "classificação"),
    "tendencia": ("tendência", "tendencia", "evolução", "últimos meses", "ultimos meses"),
}

# Month names and abbreviations, in the order they are looked for.
MONTHS = {
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6,
    "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "jan": 1, "fev": 2, "mar": 3, "abr": 4, "mai": 5, "jun": 6,
    "jul": 7, "ago": 8, "set": 9, "out": 10, "nov": 11, "dez": 12,
}

# What a question can filter by, and what an answer is broken down by.
FILTERED = {"cliente": "string", "porto": "string", "categoria": "string", "ano": "int", "mes": "int"}
DETAILS = {"ranking": "nome", "tendencia": "periodo", "comparacao": "tipo"}
CUBE = (*FILTERED, *DETAILS.values())

YEAR = r"\b(20[0-9]{2})\b"

# Letters of a name that a piece of a question is held against first.
BEGINNING = 6


def _plain(word: str) -> str:
    return word.replace("ç", "c")


def _map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(cell) for pair in values.items() for cell in pair])


def intent(question: Column) -> Column:
    text = F.lower(question)
    result = F.lit("total")
    for name, words in reversed(INTENT_WORDS.items()):
        result = F.when(any_of(F.contains(text, F.lit(w)) for w in words), name).otherwise(result)
    return result


def year_of(question: Column) -> Column:
    return F.regexp_extract(question, YEAR, 1).try_cast("int")


def month_of(question: Column) -> Column:
    """First month, in the order of the name list, that is a word of the question."""
    places = _map_of({_plain(name): i for i, name in enumerate(MONTHS)})
    words = F.split(fold_accents(question), "[^a-z0-9]+")
    return F.pmod(F.array_min(F.transform(words, lambda w: F.try_element_at(places, w))), F.lit(12)) + 1


def date_of(question: Column) -> Column:
    """First day of the month a question names with its year."""
    year, month = year_of(question), month_of(question)
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return F.when(year.isNotNull() & month.isNotNull(), text).try_cast("date")


def comparison_period(question: Column) -> Column:
    """Struct (inicio, fim): the first and last month named within two words of a
    year, or before the next year named; with fewer than two, the single date and
    the month before it.
    """
    months = _map_of({_plain(name): f"{n:02d}" for name, n in MONTHS.items()})

    def years_in(words: Column) -> Column:
        found = F.transform(words, lambda w: F.when(w.rlike("^20[0-9]{2}"), F.regexp_extract(w, YEAR, 1)))
        return F.filter(found, lambda y: y.isNotNull() & (y != ""))

    def near(words: Column, word: Column, i: Column) -> Column:
        start = F.greatest(i - 2, F.lit(0))
        close = years_in(F.slice(words, start + 1, i + 3 - start))
        years = F.when(F.size(close) > 0, close).otherwise(F.slice(years_in(F.slice(words, i + 1, F.size(words))), 1, 1))
        month = F.try_element_at(months, word)
        return F.when(month.isNotNull(), F.transform(years, lambda y: F.concat_ws("-", y, month, F.lit("01")))).otherwise(
            F.array().cast("array<string>"))

    # One-element outer array: the words are split once per question.
    split = F.array(F.split(F.trim(fold_accents(question)), r"\s+"))
    found = F.transform(split, lambda words: F.array_distinct(F.flatten(F.transform(words, lambda w, i: near(words, w, i)))))
    single = date_of(question)

    def ends(dates: Column) -> Column:
        return F.when(F.size(dates) >= 2, F.struct(
            F.array_min(dates).try_cast("date").alias("inicio"), F.array_max(dates).try_cast("date").alias("fim"),
        )).otherwise(F.struct(F.add_months(single, -1).alias("inicio"), single.alias("fim")))

    return F.element_at(F.transform(found, ends), 1)  # the dates are looked for once


def category_of(question: Column) -> Column:
    text = normalize_text(question)
    return F.when(text.rlike(r"\bimporta"), "importacao").when(text.rlike(r"\bexporta"), "exportacao")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks: a question is few bytes and much work, so tasks by size of the input would be few and long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def match_all(questions: DataFrame, dictionaries: Mapping[str, DataFrame], key: str, text: str, entity: str = "entidade") -> DataFrame:
    """Longest entity of every dictionary that a question contains (alphabetical on ties): the key and a column per dictionary.

    A question is read once for all dictionaries. Where the beginning of some name may stand, by a bitmap of
    beginnings, it is cut into pieces of the lengths entities have; where they are cut, pieces are held
    against a bitmap of all entities, and only those that may be one are shuffled to meet the dictionaries
    by equality. Questions that hold no entity give no row; blank entities are no entity.
    """
    named = reduce(DataFrame.unionByName, [d.select(F.lit(kind).alias("_tipo"), F.col(entity).alias("_e")) for kind, d in dictionaries.items()]).where("_e <> ''").distinct()
    lengths, starts = (named.agg(F.collect_set(n)).scalar() for n in (F.length("_e"), F.least(F.length("_e"), F.lit(BEGINNING))))
    # A generated row: what is asked of the key later stays above it, so callers that spread the same questions share the exchange.
    normal = _spread(questions.select(key, text)).select(F.explode(F.array(F.struct(F.col(key).alias("k"), normalize_text(F.col(text)).alias("q")))).alias("_r"))
    sized = normal.select(F.col("_r.k").alias(key), F.col("_r.q").alias("_q"), F.explode(starts).alias("_a")).where(F.col("_a") <= F.length("_q"))
    placed = sized.select(key, "_q", "_a", F.explode(F.sequence(F.lit(1), F.length("_q") - F.col("_a") + 1)).alias("_i"))
    begun = placed.where(may_hold(named.select(F.substring("_e", 1, BEGINNING).alias("_b")), "_b")(F.col("_q").substr(F.col("_i"), F.col("_a"))))
    cut = begun.select(key, "_q", "_a", "_i", F.explode(lengths).alias("_n")).where((F.least(F.col("_n"), F.lit(BEGINNING)) == F.col("_a")) & (F.col("_i") + F.col("_n") <= F.length("_q") + 1))
    pieces = cut.select(key, F.col("_q").substr(F.col("_i"), F.col("_n")).alias("_e")).where(may_hold(named, "_e")(F.col("_e")))
    found = pieces.join(named, "_e")  # a piece that comes twice changes no longest one
    best = [F.min(F.when(F.col("_tipo") == kind, F.struct((-F.length("_e")).alias("n"), F.col("_e").alias("e")))).alias(kind) for kind in dictionaries]
    return found.groupBy(key).agg(*best).select(key, *[F.col(f"`{kind}`.e").alias(kind) for kind in dictionaries])


def match_entities(questions: DataFrame, entities: DataFrame, key: str, text: str, entity: str = "entidade") -> DataFrame:
    """Longest entity contained in every question (alphabetical on ties): rows (key, entity)."""
    return match_all(questions, {entity: entities}, key, text, entity)


def question_filters(questions: DataFrame, clients: DataFrame, ports: DataFrame, key: str, text: str) -> DataFrame:
    """One filter row per question. A year without a month filters by year alone."""
    q, kind, year = F.col(text), F.col("_r.tipo"), F.col("_r.ano")
    read = _spread(questions.select(key, text)).select(key, text, F.explode(F.array(F.struct(intent(q).alias("tipo"), year_of(q).alias("ano")))).alias("_r"))  # worked out once
    base = read.select(
        key, kind.alias("tipo_analise"), category_of(q).alias("categoria"),
        F.when(kind != "comparacao", year).alias("ano"),
        F.when((kind != "comparacao") & year.isNotNull(), month_of(q)).alias("mes"),
        F.when(kind == "comparacao", comparison_period(q)).alias("_periodo"),
    )
    named = match_all(questions, {"cliente": clients, "porto": ports}, key, text)
    return base.join(named, key, "left").select(
        key, "tipo_analise", "cliente", "porto", "categoria", "ano", "mes",
        F.col("_periodo.inicio").alias("data_inicio"), F.col("_periodo.fim").alias("data_fim"))


def answer(df: DataFrame, kind: str, filters: FilterSet, field: str = "armador", n: int = 5) -> DataFrame:
    """Answer one parameterised question on a movement table."""
    rows = apply_filters(df, filters)
    if kind == "total":
        return rows.agg(agg.container_total(rows.columns).alias("total_containers"))
    if kind == "comparacao":
        return series.compare_periods(rows, filters.data_inicio, filters.data_fim)
    if kind == "ranking":
        return ranking.ranking_with_share(rows, field, n)
    if kind == "tendencia":
        return series.trend_label(rows)
    raise ValueError(f"unknown analysis: {kind}")


def asked_parts(filters: DataFrame, key: str) -> DataFrame:
    """One row per total a question needs: (key, tipo_analise, parte, cliente, porto, categoria, ano, mes).

    A comparison needs the totals of its first and last month; any other question needs one.
    """
    def part(name: str, year, month) -> Column:
        return F.struct(F.lit(name).alias("parte"), year.cast("int").alias("ano"), month.cast("int").alias("mes"))

    first, last = F.col("data_inicio"), F.col("data_fim")
    parts = F.when(F.col("tipo_analise") == "comparacao", F.array(part("inicio", F.year(first), F.month(first)), part("fim", F.year(last), F.month(last)))).otherwise(
        F.array(part("total", F.col("ano"), F.col("mes"))))
    return filters.select(key, "tipo_analise", F.lower("cliente").alias("cliente"), F.lower("porto").alias("porto"), "categoria", F.explode(parts).alias("p")).select(
        key, "tipo_analise", "p.parte", "cliente", "porto", "categoria", "p.ano", "p.mes")


def answer_totals(filters: DataFrame, rows: DataFrame, key: str, quantity: str = "qtd_container") -> DataFrame:
    """The totals of a whole table of questions: (key, tipo_analise, parte, total), 0 where nothing fits.

    Questions are taken by which filters they set, at most 32 kinds, and each kind meets the sums of its own
    cells by equality; movements of cells that none asks for go before they are summed. `filters` and
    `rows` are read once per kind; give written tables.
    """
    names = ("cliente", "porto", "categoria", "ano", "mes")
    asked = asked_parts(filters, key)
    moves = _moves(rows, quantity)
    kinds = asked.groupBy(*[F.col(n).isNotNull().alias(n) for n in names]).count().collect()
    answers = []
    for kind in kinds:
        used = [n for n in names if kind[n]]
        mine = asked.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() if n in used else F.col(n).isNull() for n in names]))
        held = moves.withColumn("porto", F.explode("portos")) if "porto" in used else moves
        if used:
            cell = F.struct(*used)
            held = held.where(may_hold(mine.select(cell.alias("c")), "c", place_bits(kind["count"]))(cell))
        totals = held.groupBy(*used).agg(F.sum("q").alias("total"))
        met = mine.join(totals, used, "left") if used else mine.withColumn("total", totals.scalar())
        answers.append(met.select(key, "tipo_analise", "parte", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total")))
    empty = asked.where(F.lit(False)).select(key, "tipo_analise", "parte", F.lit(0.0).alias("total"))
    return reduce(DataFrame.unionByName, answers, empty)


def _moves(rows: DataFrame, quantity: str, *more: Column) -> DataFrame:
    """Movements by what a question can name, types as questions have them."""
    ports = [F.lower(c) for c in ("porto_embarque", "porto_descarga") if c in rows.columns]
    return rows.select(
        F.lower("cliente").alias("cliente"), F.array_distinct(F.array(*ports)).alias("portos"), F.col("tipo_operacao").cast("string").alias("categoria"),
        F.col("ano").cast("int").alias("ano"), F.col("mes").cast("int").alias("mes"), *more, F.col(quantity).alias("q"))


def _grouping(detail: str | None = None) -> Column:
    """The group of the cells that answer a question: a bit per column that it leaves open."""
    bits = F.lit(0)
    for place, name in enumerate(reversed(CUBE)):
        left_open = F.lit(name != detail) if name in DETAILS.values() else F.col(name).isNull()
        bits = bits + F.when(left_open, 1 << place).otherwise(0)
    return bits.cast("long")


def _filled(names: tuple[str, ...]) -> list[Column]:
    """The group of a set of filters, its columns, and nulls for the filters left open."""
    group = sum(1 << place for place, c in enumerate(reversed(CUBE)) if c not in names)
    return [F.lit(group).cast("long").alias("grupo"), *[F.col(c) if c in names else F.lit(None).cast(FILTERED[c]).alias(c) for c in FILTERED]]


def _cube(moves: DataFrame, sets: set[tuple[str, ...]], may: Callable[[Column], Column], detail: str | None = None) -> DataFrame:
    """Sums by every set of filters that is asked for, and by a detail, of those cells that `may` be asked for. A movement counts under both its ports."""
    cubes = []
    for names in sorted(sets):
        held = moves.withColumn("porto", F.explode("portos")) if "porto" in names else moves
        by = (*names, detail) if detail else names
        sums = held.where(may(F.struct(*_filled(names)))).groupBy(*by).agg(F.sum("q").alias("total"))
        cubes.append(sums.select(*_filled(by), *([detail] if detail else []), "total"))
    return reduce(DataFrame.unionByName, cubes)


def _by_cell(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join rows with a group and its filters; a filter left open meets one left open."""
    there = right.select(*[F.col(c).alias(f"_{c}") if c in ("grupo", *FILTERED) else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FILTERED], F.col("grupo") == F.col("_grupo"))
    met = left.join(there, same, how)
    return met if how == "left_semi" else met.drop("_grupo", *[f"_{c}" for c in FILTERED])


def answers(filters: DataFrame, rows: DataFrame, key: str, field: str = "armador", n: int = 5, quantity: str = "qtd_container") -> DataFrame:
    """Every question of a table answered by its intent: (key, tipo_analise, posicao, chave, anterior, total, variacao, percentual, media, rotulo).

    * total: one row, ``total``; 0 where nothing fits.
    * comparacao: the first (``anterior``) and the last month (``total``) with the change in percent, first
      overall (``geral``), then by operation where either is above 0; no rows without two months.
    * ranking: the n largest of ``field`` with their joint share of the whole (``percentual``).
    * tendencia: the last three months that have rows, the change from each to the next, their mean and its label.

    Movements are summed by the sets of filters that questions of an intent set; those of cells that none
    asks for go before. Rankings and trends are cut to n and three rows per cell, and questions meet their
    cells by equality. `filters` and `rows` are read once per set; give written tables.
    """
    # A comparison asks for two months in place of a year and a month.
    of_month = F.col("tipo_analise") == "comparacao"
    months = F.when(of_month & F.col("data_inicio").isNotNull() & F.col("data_fim").isNotNull(), F.array("data_inicio", "data_fim")).otherwise(F.array(F.lit(None).cast("date")))
    asked = filters.select(key, "tipo_analise", F.lower("cliente").alias("cliente"), F.lower("porto").alias("porto"), "categoria", "ano", "mes", F.posexplode(months).alias("lado", "dia"))
    asked = asked.where(~of_month | F.col("dia").isNotNull()).select(
        key, "tipo_analise", "lado", "cliente", "porto", "categoria",
        F.when(of_month, F.year("dia")).otherwise(F.col("ano")).cast("int").alias("ano"), F.when(of_month, F.month("dia")).otherwise(F.col("mes")).cast("int").alias("mes"))
    moves = _moves(rows, quantity, F.col(field).alias("nome")).withColumns({"periodo": F.col("ano") * 100 + F.col("mes"), "tipo": F.col("categoria")})
    # At most 32 sets of filters by intent, whatever the number of questions.
    sets: dict[str, dict[tuple[str, ...], int]] = {}
    for kind in asked.groupBy("tipo_analise", *[F.col(c).isNotNull().alias(c) for c in FILTERED]).count().collect():
        sets.setdefault(kind["tipo_analise"], {})[tuple(c for c in FILTERED if kind[c])] = kind["count"]

    def cube_of(kind: str) -> Callable[..., DataFrame]:
        wanted = asked.where(F.col("tipo_analise") == kind).withColumn("grupo", _grouping())
        may = may_hold(wanted.select(F.struct("grupo", *FILTERED).alias("c")), "c", place_bits(sum(sets[kind].values())))
        return lambda detail=None: _cube(moves, set(sets[kind]), may, detail)

    build = {"total": _totals, "ranking": _rankings, "tendencia": _trends, "comparacao": _comparisons}
    parts = [build[kind](asked, cube_of(kind), key, n) for kind in sorted(set(sets) & set(build))]
    return reduce(DataFrame.unionByName, parts) if parts else _answer(asked.where(F.lit(False)), key)


_TYPES = {"posicao": "int", "chave": "string", "anterior": "double", "total": "double", "variacao": "double", "percentual": "double", "media": "double", "rotulo": "string"}


def _answer(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """Answer rows with the columns given, null for the rest."""
    return rows.select(key, "tipo_analise", *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()])


def _met(asked: DataFrame, kind: str, cells: DataFrame, how: str, detail: str | None = None) -> DataFrame:
    """Questions of one intent beside the columns of their cells."""
    return _by_cell(asked.where(F.col("tipo_analise") == kind).withColumn("grupo", _grouping(detail)), cells, how).drop("grupo")


def _cells(asked: DataFrame, kind: str, cube: DataFrame, detail: str | None = None) -> DataFrame:
    """Cube rows of the cells that questions of one intent ask for."""
    wanted = asked.where(F.col("tipo_analise") == kind).withColumn("grupo", _grouping(detail)).select("grupo", *FILTERED).distinct()
    return _by_cell(cube, wanted, "left_semi").select("grupo", *FILTERED, *([detail] if detail else []), "total")


def _totals(asked: DataFrame, cube: Callable[..., DataFrame], key: str, n: int) -> DataFrame:
    met = _met(asked, "total", _cells(asked, "total", cube()), "left")
    return _answer(met, key, posicao=F.lit(1), chave=F.lit("total"), total=F.coalesce("total", F.lit(0.0)))


def _rankings(asked: DataFrame, cube: Callable[..., DataFrame], key: str, n: int) -> DataFrame:
    cell = ["grupo", *FILTERED]
    order = Window.partitionBy(*cell).orderBy(F.desc("total"), "nome")
    top = _cells(asked, "ranking", cube("nome").where("nome IS NOT NULL"), "nome").withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= n)
    top = top.withColumn("juntos", F.sum("total").over(Window.partitionBy(*cell)))  # of n rows at most
    whole = _cells(asked, "ranking", cube()).withColumnRenamed("total", "geral")
    met = _met(_met(asked, "ranking", whole, "inner"), "ranking", top, "inner", "nome")
    return _answer(met, key, posicao=F.col("posicao"), chave=F.col("nome"), total=F.col("total"), percentual=F.when(F.col("geral") > 0, F.col("juntos") * 100.0 / F.col("geral")))


def _trends(asked: DataFrame, cube: Callable[..., DataFrame], key: str, n: int) -> DataFrame:
    cell = ["grupo", *FILTERED]
    newest = Window.partitionBy(*cell).orderBy(F.desc("periodo"))
    last = _cells(asked, "tendencia", cube("periodo").where("periodo IS NOT NULL"), "periodo").withColumn("atras", F.row_number().over(newest)).where("atras <= 3")
    over = Window.partitionBy(*cell).orderBy("periodo")
    last = last.withColumns({"posicao": F.row_number().over(over), "anterior": F.lag("total").over(over)})
    last = last.withColumn("variacao", F.when(F.col("anterior") > 0, percent_change(F.col("total"), F.col("anterior"))))
    last = last.withColumn("media", F.avg("variacao").over(Window.partitionBy(*cell)))
    met = _met(asked, "tendencia", last, "inner", "periodo")
    names = {c: F.col(c) for c in ("posicao", "anterior", "total", "variacao", "media")}
    return _answer(met, key, chave=F.col("periodo").cast("string"), rotulo=series.trend_name(F.col("media")), **names)


def _comparisons(asked: DataFrame, cube: Callable[..., DataFrame], key: str, n: int) -> DataFrame:
    overall = _met(asked, "comparacao", _cells(asked, "comparacao", cube()), "left").withColumn("tipo", F.lit(None).cast("string"))
    by_type = _met(asked, "comparacao", _cells(asked, "comparacao", cube("tipo").where("tipo IS NOT NULL"), "tipo"), "inner", "tipo")

    def side(number: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("lado") == number, F.col("total"))), F.lit(0.0))

    both = overall.unionByName(by_type).groupBy(key, "tipo_analise", "tipo").agg(side(0).alias("um"), side(1).alias("dois"))
    kept = both.where("tipo IS NULL OR um > 0 OR dois > 0")
    one, two = F.col("um"), F.col("dois")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("tipo").asc_nulls_first()))
    return _answer(kept.withColumn("posicao", place), key, posicao=F.col("posicao"), chave=F.coalesce("tipo", F.lit("geral")), anterior=one, total=two,
                   variacao=F.when(one > 0, percent_change(two, one)).when(two == 0, 0.0))
