"""Fixed-window rate limit per key, exact for keys of any size.

A window opens at a key's first event and lasts ``window`` seconds; the first
event after it opens the next one. Events beyond ``limit`` in a window are
rejected. Which event opens a window depends on the window before, so a plain
grouped run would put all events of a key into one task. Time is cut into slices
longer than the window instead:

1. every (key, slice) says which window is open at its end, for each way an
   earlier window may reach into it - a few steps, since windows that open close
   together soon fall on the same event;
2. the slices of a key, one small row each, are followed in time order, which
   gives the window open at the start of every slice;
3. every (key, slice) decides its own events.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
STEPS = "chave {k}, fatia bigint, n bigint, ate array<bigint>, abertura array<bigint>, vistos array<bigint>"
ENTRIES = "chave {k}, fatia bigint, aberta bigint, vistos bigint"
DECISIONS = "chave {k}, id {i}, t bigint, aberta bigint, ordem bigint"


def _following(ts: np.ndarray, window: int) -> np.ndarray:
    """Index of the event that opens the window after one opened at each event."""
    return np.searchsorted(ts, ts + window, side="right")


def _steps(window: int, length: int):
    def run(group: pa.Table) -> pa.Table:
        ts = np.sort(group["t"].to_numpy())
        slice_no = group["fatia"][0].as_py()
        count, begin = len(ts), slice_no * length
        here = np.arange(count)
        follow = _following(ts, window)
        last = np.where(follow < count, follow, here)
        for _ in range(int(length // window + 1).bit_length()):
            last = last[last]
        # An earlier window ends before begin + window, so the first event it
        # leaves for a new window is one of these.
        reach = min(int(np.searchsorted(ts, begin + window - 1, side="right")), count - 1)
        ends = last[: reach + 1]
        edges = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
        return pa.table({
            "chave": group["chave"].slice(0, 1), "fatia": [slice_no], "n": [count], "ate": [ts[edges].tolist()],
            "abertura": [ts[ends[edges]].tolist()], "vistos": [(count - ends[edges]).tolist()],
        })

    return run


def _follow(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("fatia")
        opened, seen, at_start, seen_before = None, 0, [], []
        for n, upto, opening, inside in zip(*(group[c].to_pylist() for c in ("n", "ate", "abertura", "vistos"))):
            at_start.append(0 if opened is None else opened)
            seen_before.append(seen)
            step = 0 if opened is None else int(np.searchsorted(np.asarray(upto), opened + window, side="right"))
            if step < len(upto):
                opened, seen = opening[step], inside[step]
            else:
                seen += n
        return pa.table({"chave": group["chave"], "fatia": group["fatia"], "aberta": at_start, "vistos": seen_before})

    return run


def _decide(window: int):
    def run(events: pa.Table, entry: pa.Table) -> pa.Table:
        events = events.sort_by([("t", "ascending"), ("id", "ascending")])
        ts = events["t"].to_numpy()
        count = len(ts)
        opened, order = np.empty(count, dtype="int64"), np.empty(count, dtype="int64")
        at, seen = entry["aberta"][0].as_py(), entry["vistos"][0].as_py()
        first = 0 if seen == 0 else int(np.searchsorted(ts, at + window, side="right"))
        opened[:first], order[:first] = at, seen + np.arange(1, first + 1)
        follow = _following(ts, window)
        while first < count:
            after = int(follow[first])
            opened[first:after], order[first:after] = ts[first], np.arange(1, after - first + 1)
            first = after
        return pa.table({"chave": events["chave"], "id": events["id"], "t": events["t"], "aberta": opened, "ordem": order})

    return run


def rate_limit(events: DataFrame, key: str, time: str, event_id: str, limit: int = 100, window: int = 60,
               slice_seconds: int | None = None) -> DataFrame:
    """Every event with the opening of its window, its order in it and whether it is accepted.

    Slices are an hour or ten windows, whichever is longer, unless given. Events without a time belong
    to no window: they come back with null in its columns and in ``accepted``.
    """
    span = window * MICRO
    length = (slice_seconds or max(3600, 10 * window)) * MICRO
    if length <= span:
        raise ValueError("a slice must be longer than the window")
    kinds = {"k": events.schema[key].dataType.simpleString(), "i": events.schema[event_id].dataType.simpleString()}
    moment = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(key).alias("chave"), F.col(event_id).alias("id"), moment.alias("t")).withColumn(
        "fatia", F.floor(F.col("t") / length).cast("bigint"))
    placed = rows.where("t IS NOT NULL")
    groups = placed.groupBy("chave", "fatia")
    steps = groups.applyInArrow(_steps(span, length), STEPS.format(**kinds))
    entries = steps.groupBy("chave").applyInArrow(_follow(span), ENTRIES.format(**kinds))
    decided = groups.cogroup(entries.groupBy("chave", "fatia")).applyInArrow(_decide(span), DECISIONS.format(**kinds))
    timeless = rows.where("t IS NULL").select("chave", "id", "t", F.lit(None).cast("bigint").alias("aberta"), F.lit(None).cast("bigint").alias("ordem"))
    return decided.unionByName(timeless).select(
        F.col("chave").alias(key), F.col("id").alias(event_id), F.timestamp_micros("t").alias(time),
        F.timestamp_micros("aberta").alias("window_start"), F.col("ordem").alias("position"), (F.col("ordem") <= limit).alias("accepted"))
