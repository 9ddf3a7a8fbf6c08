"""Prefix trie, whitening and URL filter against brute force, on odd cases and on the given tables."""

import math

import numpy as np
import pytest

from portolan.llm import catalog, prefix_trie, symmetric, url_filter, whitening
from portolan.llm.common import read
from tests.llm import plain

QUERIES = catalog.QUERIES
SF = "/root/testdata/sf0.01"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def tuples(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def test_prefix_trie(spark, edge, talks):
    assert tuples(QUERIES["op11_prefix_trie"](spark, edge), *NODE) == sorted(plain.trie(talks), key=repr)


@pytest.mark.parametrize(("turns", "paths"), [(1, 2), (40, 3), (150, 2)])
def test_prefix_trie_over_many_ranges(spark, edge, talks, monkeypatch, turns, paths):
    """Ranges of a few paths: nearly every node is open at first, and several rounds follow."""
    built = prefix_trie.rebuilt(read(spark, edge, "conversations"))
    assert tuples(prefix_trie.nodes(built, turns, paths), *NODE) == sorted(plain.trie(talks), key=repr)


def test_prefix_trie_of_one_conversation_without_turns(spark):
    # crc32 of 5 leaves 7 turns of its own group's first; conversation 6 loses its only turn to an absent group.
    rows = [(6, 0, "user", "gone")] if plain.zlib.crc32(b"6") % 9 else [(7, 0, "user", "gone")]
    got = prefix_trie.nodes(prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert tuples(got, *NODE) == sorted(plain.trie(rows), key=repr) and got.count() == 1


def _check_whitening(rows, got, length):
    kept = plain.grid_vectors(rows, length)
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    mean = sums / n
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(kept) * len(values)
    want = [(i, sum((n * c - int(s)) ** 2 for c, s in zip(x, sums)), (np.array(x) - mean) @ axes / np.sqrt(values)) for i, x in kept]
    for k in range(len(values)):
        mine = np.array([found[i, d][k + 1][0].whitened for i, d, _ in want])
        theirs = np.array([w[k] for *_, w in want])
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-7
        one = found[want[0][:2]][k + 1][0]
        assert math.isclose(one.explained, values[k] / np.trace((fit - mean).T @ (fit - mean) / n), rel_tol=1e-9)
        assert one.n == n and one.identity_error <= 1e-9


def test_whitening(spark, edge, vectors):
    rows = [(r.vec_id, r.embedding) for r in read(spark, edge, "embeddings").collect()]
    assert len(rows) == len(vectors)
    _check_whitening(rows, QUERIES["op12_whitening"](spark, edge).collect(), 20)


def test_whitening_of_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    _check_whitening(rows, QUERIES["op12_whitening"](spark, SF).collect(), 64)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_whitening_without_spread_gives_no_rows(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_huge_entries(spark):
    rows = [(i, [3e38 if i % 2 else -3e38, float(i)]) for i in range(6)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # 2**40 steps are the furthest; n * x - S is 6 * 2**40 then, whose square is beyond 64 bits. Beside that
    # spread the second component is rounding.
    assert len(got) == 6 and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in got)


def _matrices():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    x = rng.normal(size=(300, 40))
    near = [5.0] * 4 + [4 + 1e-13 * k for k in range(8)] + [1.0] * 28
    wilkinson = np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    return {"covariance": np.cov(x.T), "equal": 3 * np.eye(30), "rank one": np.ones((20, 20)), "clusters": (q * near) @ q.T, "graded": (q * 10.0 ** -np.arange(40)) @ q.T,
            "blocks": np.kron(np.eye(4), np.cov(x[:, :8].T)), "pairs": wilkinson, "two": np.array([[2.0, 1], [1, 2]]), "one": np.array([[2.0]]), "zero": np.zeros((5, 5)), "diagonal": np.diag(np.arange(9.0))}


@pytest.mark.parametrize("name", sorted(_matrices()))
def test_leading_eigenvectors(name):
    a = _matrices()[name]
    values, vectors = symmetric.leading(a, 16)
    size = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12


def _rules():
    return [(r.host, r.path, r.verdict) for r in url_filter.RULES]


def test_url_filter(spark, edge, urls):
    pages = read(spark, edge, "pages")
    model = url_filter.fit(url_filter.labelled_by_rules(pages))
    got = QUERIES["op13_url_filter"](spark, edge).collect()
    want = []
    for i, url in urls:
        host, path = plain.host_and_path(url)
        rule, verdict = plain.rule_of(host, path, _rules())
        score = plain.url_score(host, path, model.weights)
        want.append((i, host, path, rule, verdict or ("block" if score >= 0.5 else "allow"), round(score, 9)))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 9)) for r in got), key=repr) == sorted(want, key=repr)


def test_url_weights_are_those_of_plain_descent(spark, edge):
    labelled = url_filter.labelled_by_rules(read(spark, edge, "pages"))
    model = url_filter.fit(labelled, steps=3)
    rows = [(plain.url_slots(r.host, r.path, url_filter.SLOTS), r.block) for r in labelled.distinct().collect()]
    weights, mean, spread = np.zeros(url_filter.SLOTS + 1), 0, 0
    for step in (1, 2, 3):
        slope = url_filter.PENALTY * weights
        slope[-1] = 0
        for at, block in rows:
            error = 1 / (1 + math.exp(-(weights[-1] + sum(weights[k] for k in at) / math.sqrt(len(at))))) - block
            slope[-1] += error / len(rows)
            slope[list(at)] += error / math.sqrt(len(at)) / len(rows)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
        weights = weights - url_filter.RATE * mean / (1 - 0.9 ** step) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-6)
    assert np.abs(weights - np.array(model.weights)).max() < 1e-6


def test_url_model_is_right_on_urls_it_has_not_seen(spark):
    pages = read(spark, "/root/testdata/sf0.1", "pages")
    labelled = url_filter.labelled_by_rules(pages).distinct().withColumn("part", url_filter.F.expr("xxhash64(host, path) % 2 = 0"))
    model = url_filter.fit(labelled.where("part").drop("part"))
    unseen = labelled.where("NOT part").withColumn("p", url_filter.probability(url_filter.slots(url_filter.F.col("host"), url_filter.F.col("path")), model)).collect()
    assert sum((r.p >= 0.5) == r.block for r in unseen) >= 0.97 * len(unseen)


def test_longer_rules_and_longer_hosts_win(spark):
    rules = [url_filter.Rule("a.com", "/", "allow"), url_filter.Rule("com", "/xy", "block"), url_filter.Rule("com", "/x", "block")]
    pages = spark.createDataFrame([(1, "http://a.com/xyz"), (2, "http://b.com/xyz"), (3, "http://b.com/z"), (4, "http://b.a.com/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.ruled) for r in url_filter.judged(pages, rules).collect()}
    # a.com/ and com/xy are equally long; the longer host wins.
    assert got == {1: ("a.com/", "allow"), 2: ("com/xy", "block"), 3: (None, None), 4: ("a.com/", "allow")}
    bare = url_filter.judged(pages, [])
    assert bare.where("rule IS NULL").count() == 4


@pytest.mark.parametrize(("blocked", "verdict"), [([True], "block"), ([False], "allow"), ([], "allow"), ([None], "allow"), ([True, False], "allow")])
def test_url_model_without_two_labels(spark, blocked, verdict):
    labelled = spark.createDataFrame([("a.org", "/", b) for b in blocked], "host string, path string, block boolean")
    pages = spark.createDataFrame([(1, "http://b.org/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.verdicts(pages, url_filter.fit(labelled)).collect()] == [verdict]


def test_url_filter_runs_no_python(spark):
    plan = QUERIES["op13_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
