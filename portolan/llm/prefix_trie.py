"""Conversation prefix trie by truncation peeling.

A conversation is a path of turn digests; each distinct prefix is a node. Paths are sorted and cut
into ranges. Inside a range all members of a node lie side by side, so the trie is peeled there from
the deepest level up: at each depth the conversations that end there join the nodes left over from
the depth below, equal prefixes are merged into nodes with their counts and subtree sums, and these
lose their last turn and go on as the next depth's survivors. One pass finds the nodes and their
figures.

Only prefixes of a range's first and last path may have members in other ranges. They stay open: what
the range knows of them goes on, as two paths with sums at each depth, to a round of the same peeling
over those paths, until one range holds all. A first turn that a third of all conversations share is
thus spread over many ranges; no node is a group of any task.

Ids of conversations that end at one node are read in order; those of an open node are hashed from
the pieces of text that the ranges made of them.

Defined results: rows without conv_id are left out; turns of one number are ordered by a digest of
role and text; repeated turns all count; without conversations there are no nodes. A task holds the
digests of whole conversations (40 bytes a turn), the longest of which bounds it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.common import mix, written

#: Conversations of a group, and how many first turns they may share at most, plus one.
GROUP, HEAD = 5, 9
#: Bytes of a turn's digest in a path.
TURN = 16
#: Turns of one range, and the least paths that a range has, so that every round leaves fewer.
RANGE_TURNS, RANGE_PATHS = 1 << 20, 64
#: Conversation ids in one piece of text.
PIECE_IDS = 1 << 15
#: Turns of a path that decide the task it is sorted in.
KEY_TURNS = 64
NO_END = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max


def _digest(role: Column, text: Column) -> Column:
    """Tells (role, text) apart; the role's length keeps the two from running together."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (digest, bytes)) of every conversation, its first turns replaced by its group's.

    Conversation c takes the first h original turns of conversation c - c % 5 and its own after its
    first h, where h is crc32 of c in decimal, modulo 9. The five of a group meet in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv_id = F.col("conv_id").cast("long")
    rows = conversations.where(conv_id.isNotNull()).select(
        conv_id.alias("conv_id"), (conv_id - conv_id % GROUP).alias("first"),
        F.struct(F.col("turn").cast("long").alias("turn"), _digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("one"))
    # One exchange by group serves both the conversations and the window over them.
    own = rows.repartition("first").groupBy("first", "conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("first"), F.slice("turns", 1, HEAD))).over(Window.partitionBy("first"))
    known = own.select("conv_id", "turns", F.coalesce(head, F.slice("turns", 1, 0)).alias("head"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int").alias("h"))
    whole = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return known.select("conv_id", F.transform(whole, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


# --- one range ---------------------------------------------------------------------------------

#: What tasks write: nodes, open paths, and pieces of the ids that end at an open node.
ROW = ("kind string, depth int, conv_id long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long,"
       " saved_tokens long, ends_sha256 string, path binary, sizes binary, sums binary, piece string")
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_COLUMNS = {c.split()[0]: _KINDS[c.split()[1]] for c in ROW.split(",")}


def _batch(kind: str, **columns) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    values = {"kind": [kind] * count} | columns
    return pa.RecordBatch.from_arrays([pa.array(values[c], t) if c in values else pa.nulls(count, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))


class Range:
    """Sorted paths (equal ones allowed), and a hash of each of their prefixes."""

    def __init__(self, paths: list[bytes], sizes: list[bytes]):
        self.paths, self.raw_sizes = paths, sizes
        self.length = np.array([len(p) // TURN for p in paths], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.sizes = np.frombuffer(b"".join(sizes), ">i8")
        digests = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
        place = (np.arange(len(digests)) - np.repeat(self.at[:-1], self.length)).astype(np.uint64)
        marked = mix(digests ^ mix(place[:, None] * np.uint64(2) + np.array([1, 2], np.uint64)))
        sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(marked, axis=0, dtype=np.uint64)])
        self._sums, self._base = sums, sums[self.at[:-1]]

    def prefix(self, path: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """128-bit hashes of the first `depth` turns of paths that long."""
        return self._sums[self.at[path] + depth] - self._base[path]

    def keys(self, path: np.ndarray, depth: int | np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in self.prefix(path, depth)]


class Peeling:
    """The trie of one range, from its deepest level up.

    entries: rows (path, depth, members, smallest id, children, leaves, saved) that come in at a depth of
    a path: a conversation that ends there, or what another range knows of an open prefix. `levels` are
    the closed nodes by depth. `open` holds, for the first path and then for the last path's turns
    beyond what it shares with the first, the sums at each depth. With `whole` nothing is open.
    """

    def __init__(self, range_: Range, entries: np.ndarray, whole: bool):
        self.range, self.levels = range_, []
        ends = np.array([0, len(range_.paths) - 1])
        shared = 0
        while shared < range_.length[ends].min() and (range_.prefix(ends[:1], shared + 1) == range_.prefix(ends[1:], shared + 1)).all():
            shared += 1
        # Chains of open prefixes: (path, first depth).
        chains = [] if whole else [(0, 0)] if shared == range_.length[ends[1]] else [(0, 0), (int(ends[1]), shared + 1)]
        self.chains = chains
        self.open = [np.tile(np.array([0, FAR, 0, 0, 0], np.int64), (int(range_.length[p]) + 1, 1)) for p, _ in chains]
        entries = entries[np.argsort(-entries[:, 1], kind="stable")]
        survivors, waiting, at = np.zeros((0, 7), np.int64), None, 0
        for depth in range(int(entries[0, 1]), -1, -1):
            to = at + int(np.searchsorted(-entries[at:, 1], -depth, "right"))
            items = np.concatenate([survivors, entries[at:to]])
            order = np.argsort(items[:, 0], kind="stable")
            items, at = items[order], to
            heads = self._heads(items[:, 0], depth)
            node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(items))))
            path = items[heads, 0]
            n, children, leaves, saved = (np.add.reduceat(x, heads) if len(heads) else np.zeros(0, np.int64) for x in (items[:, 2], items[:, 4] + (order < len(survivors)), items[:, 5], items[:, 6]))
            smallest = np.minimum.reduceat(items[:, 3], heads) if len(heads) else np.zeros(0, np.int64)
            chain = self._chain_of(path, depth)
            for k in np.flatnonzero(chain >= 0):
                self.open[chain[k]][depth] = n[k], smallest[k], children[k], leaves[k], saved[k]
            if waiting is not None:
                # The nodes one level down learn their parent's smallest id, or which chain it is on.
                parent = np.empty(len(order), np.int64)
                parent[order] = node
                parent = parent[:len(survivors)]
                waiting |= {"parent": smallest[parent], "parent_chain": chain[parent]}
                self.levels.append(waiting)
            closed = chain < 0
            path, n, smallest, children = path[closed], n[closed], smallest[closed], children[closed]
            size = range_.sizes[range_.at[path] + depth - 1] if depth else np.zeros(len(path), np.int64)
            leaves, saved = np.where(children == 0, 1, leaves[closed]), saved[closed] + (n - 1) * size
            waiting = {"depth": depth, "path": path, "n": n, "smallest": smallest, "children": children, "leaves": leaves, "saved": saved}
            survivors = np.stack([path, np.full(len(path), depth), n, smallest, np.zeros_like(n), leaves, saved], axis=1)
        if len(waiting["path"]):
            self.levels.append(waiting | {"parent": np.full(1, FAR), "parent_chain": np.full(1, -1)})

    def _heads(self, path: np.ndarray, depth: int) -> np.ndarray:
        """First of each run of items that share a prefix; in sorted order they lie side by side."""
        if not len(path):
            return np.zeros(0, np.int64)
        prefix = self.range.prefix(path, depth)
        return np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))

    def on_chain(self, path: np.ndarray) -> np.ndarray:
        """Whether whole paths are open prefixes."""
        out, length = np.zeros(len(path), bool), self.range.length[path]
        for end, _ in self.chains:
            some = np.flatnonzero(length <= self.range.length[end])
            out[some] |= (self.range.prefix(path[some], length[some]) == self.range.prefix(np.full(len(some), end), length[some])).all(axis=1)
        return out

    def _chain_of(self, path: np.ndarray, depth: int) -> np.ndarray:
        """Number of the chain that a node is on, or -1."""
        out = np.full(len(path), -1)
        for k, (end, first) in enumerate(self.chains):
            if first <= depth <= self.range.length[end] and len(path):
                same = self.range.prefix(path, depth) == self.range.prefix(np.array([end]), depth)
                out[same.all(axis=1)] = k
        return out

    def node_rows(self, ends: dict[int, str] | None) -> Iterator[pa.RecordBatch]:
        """Closed nodes; ends: the hash of the ids that end at the whole of a path, or None where those come from elsewhere."""
        chain_keys = [self.range.keys(np.full(len(sums), end), np.arange(len(sums))) for (end, _), sums in zip(self.chains, self.open)]
        for level in self.levels:
            depth, path = level["depth"], level["path"]
            if not len(path):
                continue
            over = level["parent_chain"]
            columns = {
                "depth": np.full(len(path), depth, np.int32), "conv_id": level["smallest"], "parent_conv_id": [None if c >= 0 or depth == 0 else p for p, c in zip(level["parent"].tolist(), over.tolist())],
                "parent_key": [chain_keys[c][depth - 1] if c >= 0 else None for c in over.tolist()], "n_convs": level["n"], "n_children": level["children"], "n_leaves": level["leaves"], "saved_tokens": level["saved"]}
            if ends is None:
                columns["key"] = self.range.keys(path, depth)
            else:
                whole = self.range.length[path] == depth
                columns["ends_sha256"] = [ends[p] if w else NO_END for p, w in zip(path.tolist(), whole.tolist())]
            yield _batch("node", **columns)

    def open_rows(self) -> Iterator[pa.RecordBatch]:
        if self.chains:
            at = [end for end, _ in self.chains]
            yield _batch("open", path=[self.range.paths[e] for e in at], sizes=[self.range.raw_sizes[e] for e in at], sums=[s.tobytes() for s in self.open])


def _ranges(batches: Iterator[pa.RecordBatch], most_turns: float, least_paths: int) -> Iterator[tuple[list, list, list]]:
    """Rows (path, sizes, third column) cut into ranges of bounded size."""
    paths, sizes, third, turns = [], [], [], 0
    for batch in batches:
        for path, size, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
            paths.append(path)
            sizes.append(size)
            third.append(value)
            turns += len(path) // TURN + 1
            if turns >= most_turns and len(paths) >= least_paths:
                yield paths, sizes, third
                paths, sizes, third, turns = [], [], [], 0
    if paths:
        yield paths, sizes, third


def _first_round(most_turns: int, least_paths: int):
    """Sorted (path, sizes, conv_id) to closed nodes, open paths, and pieces of the ids that end at an open node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, sizes, ids in _ranges(batches, most_turns, least_paths):
            range_ = Range(paths, sizes)
            zeros = np.zeros(len(paths), np.int64)
            peeling = Peeling(range_, np.stack([np.arange(len(paths)), range_.length, zeros + 1, np.array(ids, np.int64), zeros, zeros, zeros], axis=1), False)
            heads = [0, *[k for k in range(1, len(paths)) if paths[k] != paths[k - 1]], len(paths)]
            ends, unfinished = {}, peeling.on_chain(np.array(heads[:-1]))
            for lo, hi, open_ in zip(heads[:-1], heads[1:], unfinished.tolist()):
                if not open_:
                    ends[lo] = hashlib.sha256(",".join(map(str, ids[lo:hi])).encode()).hexdigest()
                    continue
                firsts = range(lo, hi, PIECE_IDS)
                key = range_.keys(np.array([lo]), int(range_.length[lo]))
                yield _batch("piece", key=key * len(firsts), conv_id=[ids[f] for f in firsts], piece=[",".join(map(str, ids[f:min(f + PIECE_IDS, hi)])) for f in firsts])
            yield from peeling.node_rows(ends)
            yield from peeling.open_rows()

    return work


def _later_round(most_turns: float, least_paths: int, whole: bool):
    """Sorted open paths (path, sizes, sums) to closed nodes and fewer open paths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, sizes, sums in _ranges(batches, math.inf if whole else most_turns, least_paths):
            entries = []
            for path, packed in enumerate(sums):
                known = np.frombuffer(packed, np.int64).reshape(-1, 5)
                depth = np.flatnonzero(known[:, 0])
                entries.append(np.column_stack([np.full(len(depth), path), depth, known[depth]]))
            peeling = Peeling(Range(paths, sizes), np.concatenate(entries), whole)
            yield from peeling.node_rows(None)
            yield from peeling.open_rows()

    return work


# --- all rounds --------------------------------------------------------------------------------

def _in_order(rows: DataFrame, third: str) -> DataFrame:
    """Rows in order of their path, over tasks.

    Tasks are dealt out by the first KEY_TURNS turns and, among equal paths no longer than that, by
    the third column, so that a conversation repeated without end is spread too.
    """
    key = F.substring("path", 1, KEY_TURNS * TURN)
    spread = F.when(F.length("path") <= KEY_TURNS * TURN, F.col(third))
    return rows.select("path", "sizes", third).repartitionByRange(key.asc(), spread.asc_nulls_last()).sortWithinPartitions("path", third)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key and first id, each key's hashed one after another."""
    now, state = None, None
    for batch in batches:
        keys, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    found.append(state.hexdigest())
                now, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["end_key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["end_key", "ends"])


def nodes(conversations: DataFrame, range_turns: int = RANGE_TURNS, range_paths: int = RANGE_PATHS) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turns: array of (digest: 32 hex digits, bytes))."""
    size = F.transform("turns", lambda t: F.lpad(F.hex(t["bytes"]), 16, "0"))
    paths = conversations.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.unhex(F.array_join(size, "")).alias("sizes"))
    peeled = written(_in_order(written(paths, "trie-paths"), "conv_id").mapInArrow(_first_round(range_turns, range_paths), ROW), "trie-round")
    rounds, most = [peeled], range_turns
    while True:
        rest = rounds[-1].where("kind = 'open'").select("path", "sizes", "sums")
        turns = rest.agg(F.sum(F.length("path") / TURN + 1).alias("turns")).first()["turns"]
        if turns is None:
            break
        whole = turns <= most
        ordered = rest.repartition(1) if whole else rest.repartitionByRange(F.substring("path", 1, KEY_TURNS * TURN))
        ordered = ordered.sortWithinPartitions("path")
        # Each round leaves two paths of a range at most; the bound doubles, so that rounds end at any depth.
        rounds.append(written(ordered.mapInArrow(_later_round(most, range_paths, whole), ROW), "trie-round"))
        most *= 2
    columns = ["conv_id", "depth", "parent_conv_id", "parent_key", "key", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    first = peeled.where("kind = 'node'").select(*columns)
    if len(rounds) == 1:
        return _result(first)
    pieces = peeled.where("kind = 'piece'").select("key", "piece", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").select("key", "piece")
    ends = pieces.mapInArrow(_hash_pieces, "end_key binary, ends string")
    later = rounds[1]
    for found in rounds[2:]:
        later = later.unionByName(found)
    later = later.where("kind = 'node'").select(*columns)
    # Prefixes that were open: two paths a range, whatever the number of conversations.
    named = later.select(F.col("key").alias("open_key"), F.col("conv_id").alias("open_conv_id"))
    later = later.join(ends, F.col("key") == F.col("end_key"), "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_END))).select(*columns)
    every = first.unionByName(later)
    under_open = every.where("parent_key IS NOT NULL").join(named, F.col("parent_key") == F.col("open_key"), "left").withColumn("parent_conv_id", F.col("open_conv_id"))
    return _result(every.where("parent_key IS NULL")).unionByName(_result(under_open))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sql() -> str:
    """The nodes by plain grouping of all prefixes, with crc32 spelled out bit by bit."""
    return f"""
WITH turns AS (
    SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes, turn
    FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM turns),
ids AS (
    SELECT conv_id, conv_id - conv_id % {GROUP} AS first, xor(list_reduce(
        list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda crc, x: CASE WHEN x > 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384::UBIGINT * (crc & 1)) END), 4294967295::UBIGINT) % {HEAD} AS h
    FROM (SELECT DISTINCT conv_id FROM numbered)),
built AS (
    SELECT ids.conv_id, n.i, n.digest, n.bytes FROM ids JOIN numbered n ON n.conv_id = ids.first AND n.i <= ids.h
    UNION ALL
    SELECT ids.conv_id, n.i, n.digest, n.bytes FROM ids JOIN numbered n USING (conv_id) WHERE n.i > ids.h),
placed AS (SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM built),
prefixes AS (
    SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM placed
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
lengths AS (SELECT conv_id, max(depth) AS length FROM prefixes GROUP BY conv_id),
grouped AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '') AS ends
    FROM prefixes JOIN lengths USING (conv_id) GROUP BY prefix, depth),
linked AS (
    SELECT g.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM grouped c WHERE c.depth = g.depth + 1 AND c.prefix[:32 * g.depth] = g.prefix) AS n_children
    FROM grouped g LEFT JOIN grouped p ON p.depth = g.depth - 1 AND p.prefix = g.prefix[:32 * (g.depth - 1)])
SELECT top.conv_id, top.depth::BIGINT AS depth, top.parent_conv_id, top.n AS n_convs, top.n_children, sum((below.n_children = 0)::INT)::BIGINT AS n_leaves,
    sum((below.n - 1) * below.bytes)::BIGINT AS saved_tokens, sha256(any_value(top.ends)) AS ends_sha256
FROM linked top JOIN linked below ON below.depth >= top.depth AND below.prefix[:32 * top.depth] = top.prefix
GROUP BY top.prefix, top.conv_id, top.depth, top.parent_conv_id, top.n, top.n_children
"""
