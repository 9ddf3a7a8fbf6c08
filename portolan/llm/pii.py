"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Emails, IP addresses, payment cards (Luhn) and phone numbers always stay once their checks
hold. IBANs (mod 97) and bare account numbers are added where their score reaches the
threshold. Scores: a start value by kind, more for a passed checksum, more for a telling word
within 40 code points and no other match between.

Defined results: a null text is empty; rows are judged one by one, so ties and repeated rows get
equal results; an empty table gives no rows; other columns are not looked at.

Patterns are possessive and start only where a run of their characters starts, so long runs
are read once; they give the same matches as the plain forms beside them in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.spans import joined, matches, sql_joined, sql_matches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "account")
THRESHOLD = 0.5

# The patterns of the base kinds, as plain as they are given.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]+",
    "account": r"[0-9]+",
}
PATTERNS = PLAIN | {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]++",
    "account": r"[0-9]++",
}
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Start value, added by a checksum, added by a telling word.
WEIGHTS = {"email": (0.7, 0.0, 0.2), "ip": (0.5, 0.0, 0.2), "card": (0.5, 0.3, 0.2), "phone": (0.5, 0.0, 0.2), "iban": (0.3, 0.5, 0.2), "account": (0.2, 0.0, 0.4)}
WORDS = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|karte|carte|tarjeta", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta", "account": "account|konto|compte|cuenta|passport|customer",
}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(code: Column) -> Column:
    """Whether an IBAN-like code leaves 1 on division by 97, letters read as 10 to 35."""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4))), "")
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _alone(x: Column) -> Column:
    """No letter, digit or underscore right before or after the match."""
    return ~x["before"].rlike("[A-Za-z0-9_]$") & ~x["after"].rlike("^[A-Za-z0-9_]")


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x["match"].rlike(IP_PARTS),
    "card": lambda x: F.length(_digits(x["match"])).between(12, 19) & luhn(_digits(x["match"])),
    "phone": lambda x: F.length(_digits(x["match"])).between(9, 15),
    "iban": lambda x: F.length(x["match"]).between(15, 34) & _alone(x) & mod97(x["match"]),
    "account": lambda x: F.length(x["match"]).between(8, 11) & _alone(x),
}


def _score(kind: str, x: Column) -> Column:
    start, checked, word = WEIGHTS[kind]
    near = F.lower(F.concat_ws(" ", x["before"], x["after"])).rlike(WORDS[kind])
    return F.round(F.lit(start + checked) + F.when(near, F.lit(word)).otherwise(F.lit(0.0)), 2)


def _found(kind: str, rank: int, text: Column, maybe: Column) -> Column:
    found = F.filter(matches(text, PATTERNS[kind], maybe), CHECKS[kind])
    scored = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), _score(kind, x).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= THRESHOLD)


def personal_spans(docs: DataFrame, text: str = "text", row: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Row columns and one array per kind: (start, rank, end, kind, score), in code points."""
    t = F.coalesce(docs[text], F.lit(""))
    # What a kind cannot do without; texts that lack it are not searched.
    numbers = t.rlike("[0-9]{4}|[0-9][ .-][0-9]")
    maybe = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+")), "iban": t.rlike("[A-Z]{2}[0-9]{2}")}
    return docs.select(*[docs[c] for c in row], *[_found(kind, rank, t, maybe.get(kind, numbers)).alias(kind) for rank, kind in enumerate((*BASE, *ADDED))])


def digest(found: DataFrame, row: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their scores."""
    base = F.concat(*[F.col(k) for k in BASE])
    every = F.concat(*[F.col(k) for k in (*BASE, *ADDED)])
    return found.select(
        *row, *[F.size(k).cast("long").alias(f"n_{k}") for k in (*BASE, *ADDED)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
        F.array_join(F.transform(F.sort_array(every), lambda s: s["score"].cast("decimal(4,2)").cast("string")), ",").alias("scores"))


def _sql_checks() -> dict[str, str]:
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    luhn_sum = f"(SELECT sum(CASE WHEN (length({digits}) - p) % 2 = 0 THEN v WHEN v * 2 > 9 THEN v * 2 - 9 ELSE v * 2 END) FROM (SELECT unnest(range(1, length({digits}) + 1)) AS p, unnest(list_transform(string_split({digits}, ''), lambda x: CAST(x AS INTEGER))) AS v))"
    alone = "NOT regexp_matches(before, '[A-Za-z0-9_]$') AND NOT regexp_matches(after, '^[A-Za-z0-9_]')"
    turned = "string_split(substr(match, 5) || left(match, 4), '')"
    rest = f"list_reduce(list_prepend(0, list_transform({turned}, lambda c: ascii(c) - CASE WHEN c BETWEEN '0' AND '9' THEN 48 ELSE 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    return {
        "email": "true", "ip": f"regexp_matches(match, '{IP_PARTS}')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn_sum} % 10 = 0", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length(match) BETWEEN 15 AND 34 AND {alone} AND {rest} = 1", "account": f"length(match) BETWEEN 8 AND 11 AND {alone}",
    }


def sql() -> str:
    kinds = (*BASE, *ADDED)
    checks = _sql_checks()
    found = " UNION ALL ".join(
        f"SELECT *, round({sum(WEIGHTS[k][:2])} + CASE WHEN regexp_matches(lower(concat_ws(' ', before, after)), '{WORDS[k]}') THEN {WEIGHTS[k][2]} ELSE 0 END, 2) AS score "
        f"FROM ({sql_matches('d', k, rank, PLAIN[k])}) WHERE {checks[k]}" for rank, k in enumerate(kinds))
    base = ", ".join(f"'{k}'" for k in BASE)
    base_joined = sql_joined(f"WHERE kind IN ({base})")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    all_joined = sql_joined("WHERE kind IS NOT NULL")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT * FROM ({found}) WHERE kind IN ({base}) OR score >= {THRESHOLD})
SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({base_joined}) AS base_sha256, {all_joined} AS spans,
    coalesce(string_agg(CAST(CAST(score AS DECIMAL(4, 2)) AS VARCHAR), ',' ORDER BY start, rank, "end") FILTER (WHERE kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN f USING (rid) GROUP BY d.rid"""
