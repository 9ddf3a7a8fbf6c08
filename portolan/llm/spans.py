"""Where patterns match in a text, in code points, with Spark functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.llm.common import let

#: Code points on each side of a match that its surroundings are judged by.
AROUND = 40


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running_sums(numbers: Column) -> Column:
    """Sums up to and including each element: block sums, then sums inside a block."""
    def blocked(x: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1), lambda b: _sum(F.slice(x, b * width + 1, width)))
        return let(blocks, lambda sums: let(
            F.transform(sums, lambda _, b: _sum(F.slice(sums, 1, b))),
            lambda before: F.transform(x, lambda _, i: F.get(before, F.floor(i / width).cast("int")) + _sum(F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width + 1)))))

    empty = F.expr("cast(array() as array<bigint>)")
    return F.when(F.size(numbers) == 0, empty).otherwise(
        let(numbers, lambda x: let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: blocked(x, width))))


def matches(text: Column, pattern: str, maybe: Column) -> Column:
    """Leftmost non-overlapping matches: array of (match, start, end, before, after).

    before and after are the text next to the match, as far as the neighbouring matches or
    AROUND code points. Texts for which `maybe` is false are known to have none. The pattern
    must not match the empty string.
    """
    kind = "array<struct<match: string, start: bigint, end: bigint, before: string, after: string>>"

    def placed(pieces: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        return let(running_sums(lengths), lambda ends: F.transform(found, lambda m, i: F.struct(
            m.alias("match"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"),
            F.right(F.get(pieces, i), F.lit(AROUND)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AROUND)).alias("after"))))

    def located(found: Column) -> Column:
        return F.when(F.size(found) == 0, F.expr(f"cast(array() as {kind})")).otherwise(let(F.split(text, pattern), lambda pieces: placed(pieces, found)))

    return F.when(maybe, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)).otherwise(F.expr(f"cast(array() as {kind})"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans (start, rank, end, kind), in that order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sql_matches(source: str, kind: str, rank: int, pattern: str) -> str:
    """The same matches as SQL rows (rid, kind, rank, match, start, end, before, after); source has rid and text."""
    quoted = pattern.replace("'", "''")
    return f"""
SELECT rid, '{kind}' AS kind, {rank} AS rank, found[i] AS match, stop - length(found[i]) AS start, stop AS "end",
    right(pieces[i], {AROUND}) AS before, left(pieces[i + 1], {AROUND}) AS after
FROM (
    SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))) AS BIGINT) AS stop
    FROM (
        SELECT *, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT rid, regexp_extract_all(text, '{quoted}') AS found, string_split_regex(text, '{quoted}') AS pieces FROM {source})
    )
)"""


def sql_joined(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank, \"end\") FILTER ({where}), '')"
