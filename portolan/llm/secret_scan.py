"""Secrets: strong patterns stay, weak candidates count only beside their complement.

Parts of a credential have roles: identifiers (access keys, user names), secrets (assigned values,
hex keys, mixed random strings) and endpoints (addresses of services). Assignments, access keys and
long hex strings are always reported. User names, mixed strings and addresses are weak: a user name
needs a secret within reach, a mixed string an identifier or an address, an address both an
identifier and a secret. Reach: at most 200 code points between two parts of one text.

The interval join is a sweep: for each part the furthest end of each role among the parts that
start before it, and the nearest start among those after it, by running windows over the parts of
one text. No pairs are made.

Defined results: a null text is empty; equal rows are linked once and get equal results; an empty
table gives no rows; other columns are not looked at. A task sweeps the parts of one text, which
are no more than the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import written
from portolan.llm.rows import keyed
from portolan.llm.spans import joined, matches, sql_joined, sql_matches

BASE = ("assign", "access", "hex")
WEAK = ("user", "blob", "endpoint")
REACH = 200
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "blob": "secret", "endpoint": "endpoint"}

# The patterns, as plain as they are given; keywords in either case.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("access_key_id", "client_id", "username", "user", "login"))
PATTERNS = {
    "assign": rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "user": rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]+",
    "blob": r"[A-Za-z0-9+/]+",
    "endpoint": r"(?:https?|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
}
#: The same matches with runs that cannot pass left out by their length.
FAST = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+", "blob": r"[A-Za-z0-9+/]{32,}+"}


def _passes(kind: str, x: Column) -> Column:
    m = x["match"]
    if kind == "assign":
        # The value is what follows the first separator after the keyword.
        return F.length(F.regexp_extract(m, rf"^(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?(.*)$", 1)) >= 6
    if kind == "access":
        return F.length(m) >= 20
    if kind == "hex":
        return F.length(m) >= 24
    if kind == "user":
        return F.length(F.regexp_extract(m, rf"^(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?(.*)$", 1)) >= 3
    if kind == "blob":
        return (F.length(m) >= 32) & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return F.lit(True)


def _found(kind: str, text: Column, maybe: Column) -> Column:
    rank = (*BASE, *WEAK).index(kind)
    return F.transform(F.filter(matches(text, FAST[kind], maybe), lambda x: _passes(kind, x)),
                       lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def candidates(docs: DataFrame, row: str = "doc_id") -> DataFrame:
    """(id, tk, one array of spans per kind); weak kinds are only proposals here."""
    here = keyed(docs.select(docs[row].alias("doc_id"), docs["text"]))
    t = F.coalesce(F.col("row.text"), F.lit(""))
    separated = t.rlike("[:=]")
    maybe = {"assign": separated, "user": separated, "access": F.contains(t, F.lit("AKIA")), "hex": t.rlike("[0-9a-f]{24}"), "blob": t.rlike("[A-Za-z0-9+/]{32}"), "endpoint": F.contains(t, F.lit("://"))}
    return here.select("row.doc_id", "id", "tk", *[_found(k, t, maybe[k]).alias(k) for k in (*BASE, *WEAK)])


def linked(found: DataFrame) -> DataFrame:
    """(id, tk, weak spans that stay) of the texts that have any."""
    weak, base = F.concat(*[F.col(k) for k in WEAK]), F.concat(*[F.col(k) for k in BASE])
    some = found.where((F.size(weak) > 0) & (F.size(weak) + F.size(base) > 1)).select("id", "tk", F.concat(base, weak).alias("parts")).dropDuplicates(["id", "tk"])
    parts = some.select("id", "tk", F.explode("parts").alias("p")).select("id", "tk", "p.*")
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    parts = parts.withColumn("role", role).withColumn("base", F.col("kind").isin(*BASE))
    order = [F.col("start"), F.col("rank"), F.col("end")]
    ahead = Window.partitionBy("id", "tk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("id", "tk").orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    marks = {r: F.col("role") == r for r in ("id", "secret", "endpoint")} | {"base": F.col("base")}
    for name, mark in marks.items():
        parts = parts.withColumn(f"last_{name}", F.max(F.when(mark, F.col("end"))).over(ahead))
    for name, mark in marks.items():
        parts = parts.withColumn(f"next_{name}", F.min(F.when(mark, F.col("start"))).over(behind))

    def near(r: str) -> Column:
        return F.coalesce(F.col(f"last_{r}") >= F.col("start") - REACH, F.lit(False)) | F.coalesce(F.col(f"next_{r}") <= F.col("end") + REACH, F.lit(False))

    clear = ~(F.coalesce(F.col("last_base") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_base") < F.col("end"), F.lit(False)))
    stays = ((F.col("kind") == "user") & near("secret")) | ((F.col("kind") == "blob") & (near("id") | near("endpoint"))) | ((F.col("kind") == "endpoint") & near("id") & near("secret"))
    kept = parts.where(~F.col("base") & clear & stays)
    return kept.groupBy("id", "tk").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("weak"))


def scan(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, counts by kind, the digest of the base spans, all spans."""
    found = written(candidates(docs), "secret-spans")
    more = linked(found).select(F.col("id").alias("id_"), F.col("tk").alias("tk_"), "weak")
    met = found.join(more, found["id"].eqNullSafe(F.col("id_")) & (found["tk"].eqNullSafe(F.col("tk_"))), "left")
    base = F.concat(*[F.col(k) for k in BASE])
    weak = F.coalesce("weak", F.slice("user", 1, 0))
    return met.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, weak)).alias("spans"), F.size(weak).cast("long").alias("n_linked"))


def sql() -> str:
    checks = {
        "assign": rf"length(regexp_extract(match, '^(?:{_KEYWORDS})[\"'']?\x20*[:=]\x20*[\"'']?(.*)$', 1)) >= 6", "access": "length(match) >= 20", "hex": "length(match) >= 24",
        "user": rf"length(regexp_extract(match, '^(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?(.*)$', 1)) >= 3",
        "blob": "length(match) >= 32 AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]')", "endpoint": "true",
    }
    found = " UNION ALL ".join(f"SELECT *, '{ROLE[k]}' AS role, {str(k in BASE).lower()} AS base FROM ({sql_matches('d', k, rank, PATTERNS[k])}) WHERE {checks[k]}" for rank, k in enumerate((*BASE, *WEAK)))

    def near(r: str) -> str:
        return (f"EXISTS (SELECT 1 FROM f AS o WHERE o.rid = f.rid AND o.role = '{r}' AND (o.kind, o.start) <> (f.kind, f.start)"
                f" AND o.start <= f.\"end\" + {REACH} AND f.start <= o.\"end\" + {REACH})")

    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
kept AS (
    SELECT * FROM f WHERE base OR (
        NOT EXISTS (SELECT 1 FROM f AS o WHERE o.rid = f.rid AND o.base AND o.start < f."end" AND f.start < o."end")
        AND CASE kind WHEN 'user' THEN {near('secret')} WHEN 'blob' THEN {near('id')} OR {near('endpoint')} ELSE {near('id')} AND {near('secret')} END))
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({sql_joined('WHERE base')}) AS base_sha256, {sql_joined('WHERE kind IS NOT NULL')} AS spans,
    count(*) FILTER (WHERE NOT base) AS n_linked
FROM d LEFT JOIN kept USING (rid) GROUP BY d.rid"""
