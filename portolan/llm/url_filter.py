"""URL filters: rules by host and path, then logistic regression on hashed character n-grams of host and path.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the
longest rule wins, the longer host between rules of one length. What no rule fits is judged by a
linear model over the distinct 3- and 4-grams of host and path (digits count as one character),
hashed to a fixed number of slots. It is trained from a small labelled table of urls, here a bounded
sample of urls that the rules judge, by gradient steps: each is one Spark aggregation over the
sample, of which only the sums by slot (a fixed number) reach the driver. Everything is DataFrame
functions.

Defined results: a null url, or one without "://", has an empty host and path and no rule; rows are
judged one by one, so equal urls get equal verdicts; extra columns are ignored; urls labelled both
ways are not learned from; with one label among the learned urls the verdict is that label, without
any it is allow; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import let, written
from portolan.llm.sampling import smallest_hashes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES = (3, 4)
SLOTS = 4096
PER_CLASS = 2000
STEPS, RATE, PENALTY = 25, 0.15, 1e-3


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]  # by slot, the shift last


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with host, path, rule and ruled (its verdict); null where no rule fits. For lists of rules that fit a query."""
    host, path = host_and_path(F.col("url").cast("string"))
    found = urls.withColumns({"host": host, "path": path})
    fit = None
    for n, rule in enumerate(sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))):
        inside = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        hit = inside & F.startswith(F.col("path"), F.lit(rule.path))
        answer = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("ruled"))
        fit = F.when(hit, answer) if n == 0 else fit.when(hit, answer)
    return found.withColumn("_fit", fit if fit is not None else F.lit(None).cast("struct<rule:string,ruled:string>")).withColumns({"rule": F.col("_fit.rule"), "ruled": F.col("_fit.ruled")}).drop("_fit")


def slots(host: Column, path: Column) -> Column:
    """Distinct slots of the n-grams of host and path."""

    def grams(kind: str, text: Column) -> Column:
        marked = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))

        def of(chars: Column) -> Column:
            def sized(n: int) -> Column:
                at = F.sequence(F.lit(1), F.size(chars) - (n - 1))
                gram = F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), *[F.element_at(chars, i + k) for k in range(n)]), F.lit(SLOTS)).cast("int"))
                return F.when(F.size(chars) >= n, gram).otherwise(F.array().cast("array<int>"))

            return F.concat(*[sized(n) for n in SIZES])

        return let(F.split(marked, ""), of)

    return F.array_distinct(F.concat(grams("host", host), grams("path", path)))


def margin(at: Column, model: Model) -> Column:
    """Log odds of block: the mean weight of the slots times the root of their number, and the shift."""
    weights = F.from_json(F.lit(json.dumps(model.weights[:-1])), "array<double>")
    total = F.aggregate(at, F.lit(0.0), lambda sum_, slot: sum_ + F.get(weights, slot))
    return F.lit(model.weights[-1]) + F.when(F.size(at) > 0, total / F.sqrt(F.size(at))).otherwise(F.lit(0.0))


def probability(at: Column, model: Model) -> Column:
    return 1 / (1 + F.exp(-margin(at, model)))


def fit(labelled: DataFrame, per_class: int = PER_CLASS, steps: int = STEPS) -> Model:
    """labelled: host, path, block (boolean). Learns from at most per_class urls of each label."""
    urls = labelled.where("block IS NOT NULL").groupBy("host", "path").agg(F.min("block").alias("block"), F.max("block").alias("_other")).where("block = _other").drop("_other")
    sample = smallest_hashes(urls, "block", per_class, ["host", "path"])
    rows = written(sample.select("block", slots(F.col("host"), F.col("path")).alias("at")).coalesce(1), "labelled-urls")
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    weights = [0.0] * (SLOTS + 1)
    if len(counts) < 2:
        weights[-1] = 30.0 if True in counts else -30.0
        return Model(tuple(weights))
    total = sum(counts.values())
    mean, spread = [0.0] * len(weights), [0.0] * len(weights)
    for step in range(1, steps + 1):
        error = probability(F.col("at"), Model(tuple(weights))) - F.col("block").cast("double")
        parts = F.concat(F.transform("at", lambda slot: F.struct(slot.alias("slot"), F.lit(False).alias("shift"))), F.array(F.struct(F.lit(SLOTS).alias("slot"), F.lit(True).alias("shift"))))
        each = rows.select(error.alias("error"), F.size("at").alias("n"), F.explode(parts).alias("part"))
        sums = each.groupBy("part.slot").agg(F.sum(F.col("error") / F.when(F.col("part.shift"), 1.0).otherwise(F.sqrt("n"))).alias("sum")).collect()
        slope = [PENALTY * w for w in weights[:-1]] + [0.0]
        for r in sums:
            # Rounded, so that the order in which rows are summed leaves no trace.
            slope[r["slot"]] += round(r["sum"] / total, 12)
        for k, g in enumerate(slope):
            mean[k] = 0.9 * mean[k] + 0.1 * g
            spread[k] = 0.99 * spread[k] + 0.01 * g * g
            weights[k] -= RATE * (mean[k] / (1 - 0.9 ** step)) / (math.sqrt(spread[k] / (1 - 0.99 ** step)) + 1e-6)
    return Model(tuple(round(w, 9) for w in weights))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(host, path, block) of the urls that a rule judges."""
    return judged(pages.select("url"), rules).where("ruled IS NOT NULL").select("host", "path", (F.col("ruled") == "block").alias("block"))


def verdicts(pages: DataFrame, model: Model, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's probability of block, of every row."""
    found = judged(pages.select("page_id", "url"), rules).withColumn("score", probability(slots(F.col("host"), F.col("path")), model))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, per_class: int = PER_CLASS) -> DataFrame:
    """Verdicts of all pages, the model trained from a bounded sample of the urls that the rules judge."""
    return verdicts(pages, fit(labelled_by_rules(pages, rules), per_class), rules)
