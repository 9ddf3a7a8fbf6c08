"""Quality rules: a learned decision list over text statistics, all in Spark columns.

``statistics`` measures a text; ``learn`` covers the low-quality labelled rows one rule at a
time (grow a conjunction of threshold conditions by gain, prune it on rows kept apart, accept
it, take its rows away); ``DecisionList.verdict`` is the ordered CASE expression.

Defined results: a null text is empty (no words); empty texts fail the base rule; rows are
judged one by one, so ties and repeated rows get equal results; an empty table gives no rows;
without labelled rows the list is empty and only the base rule decides. Null labels are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import let, written

WORD_BREAK = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "mean_word", "symbol_share", "bang_share", "upper_share", "digit_share", "dup_line_share", "repeat_share",
    "distinct_share", "n_words",
)


def _count_of(text: str, letters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of five words, by first word."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more.

    Windows are sorted by hash, neighbours of equal hash and equal words marked, and the union
    of the marked windows measured.
    """
    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (F.slice(words, x["i"] + 1, WINDOW) == F.slice(words, y["i"] + 1, WINDOW)), F.lit(False))

    def marked(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked), covered)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The given rows as column `row` (a struct), with the base counts and the features of their text.

    Only texts in which a window hash repeats are sorted; all others have no repeated window.
    """
    start = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    cut = start.select(
        "row", F.filter(F.split("t", WORD_BREAK), lambda x: x != "").alias("w"),
        F.regexp_replace("t", f"[^{SYMBOLS}!?0-9A-Z]+", "").alias("marks"),
        let(F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\x0b\f\r"))) > 0),
            lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("different"))).alias("lines"),
    )
    hashed = cut.select("*", _window_hashes(F.col("w")).alias("h"))
    # One generated row per text: conditions on the counts stay above it and never copy the work on words.
    measured = hashed.select("row", F.inline(F.array(F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_of("marks", SYMBOLS).alias("n_symbols"),
        (F.col("lines.all") - F.col("lines.different")).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeat_words(F.col("w"), F.col("h"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.col("lines.all").alias("lines"), F.size(F.array_distinct("w")).alias("distinct"),
        _count_of("marks", "!?").alias("bangs"), _count_of("marks", "A-Z").alias("uppers"), _count_of("marks", "0-9").alias("digits"),
    ))))

    def share(of: str, by: str) -> Column:
        return (F.col(of) / F.greatest(F.col(by), F.lit(1))).cast("double")

    return measured.select(
        "row", *COUNTS, share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"),
        share("bangs", "n_words").alias("bang_share"), share("uppers", "word_chars").alias("upper_share"),
        share("digits", "word_chars").alias("digit_share"), share("n_dup_lines", "lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("distinct", "n_words").alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """feature >= threshold, or feature < threshold."""

    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


def _all(conditions: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions], F.lit(True))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects the row."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def verdict(self) -> Column:
        """The text of the rule that rejects a row, or null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of covering p of p0 wanted and n of n0 other rows."""
    return p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least: int = 4) -> DecisionList:
    """Sequential covering over all labelled rows; each step is one aggregation.

    labelled: the features, `low` (1: to reject, 0: to keep) and `id` (any type), which parts the
    rows into two thirds to grow rules and one third to prune them. `bins` bounds what a step
    gathers: features x bins x 2 rows. A rule must reach `precision` on both parts and reject
    `least` rows while growing.
    """
    rows = written(labelled.select(*[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("low").cast("int").alias("low"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune")), "rule-rows")
    marks = [k / bins for k in range(1, bins)]
    cuts_row = rows.agg(*[F.percentile_approx(c, marks, 2000).alias(c) for c in FEATURES],
                        *[F.percentile_approx(F.when(F.col("low") == 1, F.col(c)), marks, 2000).alias(f"low_{c}") for c in FEATURES]).first()
    cuts = {c: sorted({*(cuts_row[c] or ()), *(cuts_row[f"low_{c}"] or ())}) for c in FEATURES}
    if not any(cuts.values()):
        return DecisionList()
    binned = written(rows.select("low", "prune", *FEATURES, F.array(*[
        reduce(lambda a, b: a + b, [(F.col(c) >= F.lit(t)).cast("int") for t in cuts[c]], F.lit(0)) for c in FEATURES
    ]).alias("bin")), "rule-bins")

    rules: list[tuple[Condition, ...]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            step = binned.where(left & ~F.col("prune") & _all(rule)).select("low", F.posexplode("bin").alias("f", "b"))
            cells = step.groupBy("f", "b").agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")).collect()
            best, total = _best_condition(cells, cuts)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
            if best[2] >= 0.995 * (best[2] + best[3]):
                break
        if not rule:
            break
        tests = [_all(rule[:k + 1]) for k in range(len(rule))]
        kept_apart = binned.where(left & F.col("prune")).agg(*[F.sum(F.when(t, F.col("low"))).alias(f"p{k}") for k, t in enumerate(tests)], *[F.sum(F.when(t, 1 - F.col("low"))).alias(f"n{k}") for k, t in enumerate(tests)]).first()
        worth = [((kept_apart[f"p{k}"] or 0), (kept_apart[f"n{k}"] or 0)) for k in range(len(rule))]
        size = max(range(len(rule)), key=lambda k: ((worth[k][0] - worth[k][1]) / (worth[k][0] + worth[k][1] + 1), -k)) + 1
        rule = rule[:size]
        grown = binned.where(left & ~F.col("prune") & _all(rule)).agg(F.sum("low").alias("p"), F.sum(1 - F.col("low")).alias("n")).first()
        p, n = grown["p"] or 0, grown["n"] or 0
        q, m = worth[size - 1]
        if p < least or p < precision * (p + n) or q + m and q < precision * (q + m):
            break
        rules.append(tuple(rule))
        left = left & ~_all(rule)
    return DecisionList(tuple(rules))


def _best_condition(cells: list, cuts: dict[str, list[float]]) -> tuple[tuple | None, tuple[float, float]]:
    """The condition of most gain: (gain, condition, wanted rows, other rows); and the totals."""
    best, totals = None, (0.0, 0.0)
    for f, feature in enumerate(FEATURES):
        marks = cuts[feature]
        p, n = [0.0] * (len(marks) + 1), [0.0] * (len(marks) + 1)
        for cell in cells:
            if cell["f"] == f:
                p[cell["b"]], n[cell["b"]] = float(cell["p"]), float(cell["n"])
        totals = (sum(p), sum(n))
        if not totals[0] or not totals[1]:
            continue
        below = [0.0, 0.0]
        for k, mark in enumerate(marks):
            below[0] += p[k]
            below[1] += n[k]
            for at_least, (a, b) in ((True, (totals[0] - below[0], totals[1] - below[1])), (False, tuple(below))):
                found = (_gain(a, b, *totals), Condition(feature, at_least, mark), a, b)
                if a + b < sum(totals) and (best is None or found[0] > best[0]):
                    best = found
    return best, totals


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """Add base_failed, the rejecting rule and kept."""
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def labels_of(labels: DataFrame) -> DataFrame:
    """One label per id: the lowest quality given; null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("label_id")).agg((1 - F.min("quality")).alias("low"))


def _learn_from(measured: DataFrame, labels: DataFrame) -> DecisionList:
    given = labels_of(labels)
    return learn(measured.join(given, measured["row.doc_id"] == given["label_id"]).select(*FEATURES, "low", F.col("label_id").alias("id")))


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measure every row once, learn from the labelled ones, judge all: ids and counts, without texts."""
    measured = written(statistics(docs.select("doc_id", "text")).select("row.doc_id", *COUNTS, *[f for f in FEATURES if f not in COUNTS]), "rule-statistics")
    rows = measured.select(F.struct("doc_id").alias("row"), *[c for c in measured.columns if c != "doc_id"])
    return judge(rows, _learn_from(rows, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns. Texts are measured twice, to learn and to judge, and never shuffled."""
    measured = written(statistics(docs.select("doc_id", "text")).select("row.doc_id", *COUNTS, *[f for f in FEATURES if f not in COUNTS]), "rule-statistics")
    rows = measured.select(F.struct("doc_id").alias("row"), *[c for c in measured.columns if c != "doc_id"])
    return judge(statistics(docs), _learn_from(rows, labels)).where("kept").select("row.*")
