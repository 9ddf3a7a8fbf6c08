"""Models of operators 1, 5, 6, 8 and 9 against plain forward passes, plain raking and a plain reading of the rules."""

import collections
import math
import re
import tracemalloc

import numpy as np
import pytest

from portolan.llm import byte_cnn, catalog, lang_bloom, mixing, quality_rules, toxicity
from portolan.llm.common import read
from tests.llm import plain

SF = "/root/testdata/sf0.01"
QUERIES = catalog.QUERIES


def by_text(spark, folder, frame, *columns):
    """Rows of a query beside the text of their id; ids that come once only."""
    docs = read(spark, folder, "documents").where("doc_id IS NOT NULL").select("doc_id", "text").collect()
    once = {i for i, n in collections.Counter(r.doc_id for r in docs).items() if n == 1}
    text = {r.doc_id: r.text for r in docs if r.doc_id in once}
    return [(text[r.doc_id], *[r[c] for c in columns]) for r in frame.collect() if r.doc_id in once]


@pytest.fixture(scope="module")
def net():
    """A network of a few steps; its weights are no longer those it began with."""
    texts = [b"a plain line of words and more", b"##!! ###", b"words of a plain line", b"!!## $$"] * 4
    return byte_cnn.train(texts, np.array([1, 0] * 8, np.float32), 0.7, steps=20, batch=8)


def test_byte_network_is_a_plain_forward_pass(spark, edge, net):
    docs = read(spark, edge, "documents").select("doc_id", "text")
    for text, score in by_text(spark, edge, byte_cnn.scores(docs, net), "score"):
        if len(text or "") < 4000:
            assert math.isclose(score, plain.cnn_score(net, text, byte_cnn.WIDTH, byte_cnn.HALF), rel_tol=1e-4, abs_tol=1e-5)


def test_byte_network_sees_one_text_at_a_time(net):
    """The score of a text does not depend on the texts beside it."""
    text, others = b"a plain line of words", [b"##!!##", b"zzzzzz", b"", b"\xff" * 400]
    alone = byte_cnn.probability(net, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    for other in others:
        for both, place in (([text, other], 0), ([other, text], 1)):
            p = byte_cnn.probability(net, np.frombuffer(b"".join(both), np.uint8), np.cumsum([0, *map(len, both)]))
            assert p[place] == pytest.approx(alone, rel=1e-6)


def test_languages_are_counted_gram_by_gram(spark, edge):
    filter_ = lang_bloom.fit(read(spark, edge, "documents").select("doc_id", "text", "lang"))
    for text, pred, score in by_text(spark, edge, QUERIES["op9_language_bloom"](spark, edge), "lang_pred", "score"):
        if not re.search(r"[^\W\d_]", text or ""):
            assert pred == "und" and score == 0
        elif len(text) < 3000:
            counts = plain.language_counts(filter_, text, lang_bloom.SIZES, lang_bloom.TABLE_BITS, lang_bloom.PLACES)
            best = max(range(len(counts)), key=lambda n: (counts[n], -n)) if sum(counts) else filter_.common
            assert pred == filter_.languages[best]
            assert math.isclose(score, counts[best] / sum(counts) if sum(counts) else 0, rel_tol=1e-9, abs_tol=1e-12)


def test_toxicity_chain_is_a_plain_forward_pass(spark, edge):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    chain = toxicity.fit(docs, labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic"))
    names = {int(t): k for k, t in enumerate(chain.terms)}

    def hash_of(word):
        """Hashes of one word and of its beginnings, by the length they have; the whole word last."""
        data = np.frombuffer(word, np.uint8)
        found, _, _ = toxicity.terms_of(data, np.array([0, len(word)]))
        return found.tolist()

    known = {}
    scored = toxicity.scores(read(spark, edge, "documents").select("doc_id", "text"), chain)
    for text, low, toxic in by_text(spark, edge, scored, "p_low_quality", "p_toxic"):
        if len(text or "") > 5000:
            continue
        words = [w.encode() for w in plain.PLAIN_WORDS.findall((text or "").translate(plain.LOWER))]
        times = [0] * len(chain.terms)
        for w in words:
            for h in known.setdefault(w, hash_of(w)):
                if h in names:
                    times[names[h]] += 1
        want = plain.chain_scores(chain, times, len(words))
        assert math.isclose(low, want[0], rel_tol=1e-4, abs_tol=1e-6) and math.isclose(toxic, want[1], rel_tol=1e-4, abs_tol=1e-6)


def test_mixing_is_plain_raking(spark, edge):
    docs = read(spark, edge, "documents")
    targets = {"lang": {"en": 0.5, "de": 0.3}, "source": {"s0": 0.2}}
    got = mixing.calibrated(docs, targets=targets).collect()
    rows = []
    for r in docs.collect():
        topic = next((name for name, pattern in mixing.TOPICS.items() if re.search(pattern, r.text or "")), "general")
        rows.append((r.doc_id, (r.source, r.lang, topic), len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))))
    cells = collections.Counter()
    for _, cell, tokens in rows:
        cells[cell] += tokens
    wanted = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = collections.Counter()
        for cell, tokens in cells.items():
            if tokens:
                sums[cell[d]] += tokens
        if name in targets:
            named = {v: t for v, t in targets[name].items() if v in sums}
            others = sum(t for v, t in sums.items() if v not in named)
            raw = {v: named[v] if v in named else t / others * (1 - sum(named.values())) for v, t in sums.items()}
        else:
            raw = {v: t ** mixing.FLATTEN[name] for v, t in sums.items()}
        wanted.append({v: r / sum(raw.values()) for v, r in raw.items()})
    weight = plain.raked(cells, wanted)
    top = max(w / cells[c] for c, w in weight.items())
    mine = sorted(((r.id, r.source, r.lang, r.topic, r.tokens) for r in got), key=repr)
    assert mine == sorted(((i, *c, t) for i, c, t in rows), key=repr)
    for r in got:
        cell = (r.source, r.lang, r.topic)
        p = weight[cell] / cells[cell] / top if cells[cell] else 1.0
        assert math.isclose(r.probability, p, rel_tol=1e-3, abs_tol=1e-5) and r.sampled == (r.draw < r.probability)


FEATURES = {
    "mean_word": lambda t, w, x: sum(map(len, w)) / max(len(w), 1), "symbol_share": lambda t, w, x: x[2] / max(len(w), 1),
    "bang_share": lambda t, w, x: sum(c in "!?" for c in t) / max(len(w), 1), "upper_share": lambda t, w, x: sum("A" <= c <= "Z" for c in t) / max(x[1], 1),
    "digit_share": lambda t, w, x: sum("0" <= c <= "9" for c in t) / max(x[1], 1),
    "dup_line_share": lambda t, w, x: x[3] / max(sum(bool(plain.BLANK_WORDS.search(line)) for line in t.split("\n")), 1),
    "repeat_share": lambda t, w, x: x[4] / max(len(w), 1), "distinct_share": lambda t, w, x: len(set(w)) / max(len(w), 1), "n_words": lambda t, w, x: len(w),
}


def test_verdicts_are_those_of_the_rules_read_in_order(spark):
    """Features by plain Python, and the first rule of the learned list whose conditions all hold."""
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    measured = quality_rules.statistics(docs.select("doc_id", "text"))
    rules = quality_rules._learn_from(measured, labels).rules
    assert rules
    rejected = collections.Counter()
    for text, failed, kept, rule in by_text(spark, SF, QUERIES["op1_quality_rules"](spark, SF), "base_failed", "kept", "rule"):
        t = text or ""
        counts, words = plain.base_counts(t), plain.BLANK_WORDS.findall(t)
        values = {name: f(t, words, counts) for name, f in FEATURES.items()}
        first = next((r for r in rules if all((values[c.feature] >= c.threshold) == c.at_least for c in r)), None)
        assert rule == (" and ".join(map(str, first)) if first else None) and kept == (not failed and first is None)
        rejected[first] += 1
    assert all(rejected[r] for r in rules)


def test_covering_is_greedy_by_gain(spark):
    """The first condition of the first rule is the best single cut of the rows to grow on, by plain counting."""
    rows = [(i, int(i % 4 == 0), float(i % 4 == 0) * 5 + i % 3, float(i % 7)) for i in range(300)]
    names = quality_rules.FEATURES
    frame = spark.createDataFrame([(str(i), low, a, b) for i, low, a, b in rows], "id string, low int, a double, b double")
    columns = {c: frame[("a", "b")[k]] if k < 2 else quality_rules.F.lit(0.0) for k, c in enumerate(names)}
    given = frame.select("id", "low", *[v.alias(c) for c, v in columns.items()])
    rules = quality_rules.learn(given).rules
    part = {r.id: r.p for r in given.select("id", quality_rules.F.expr("pmod(xxhash64(id), 3) = 0").alias("p")).collect()}
    grow = [(low, (a, b)) for i, low, a, b in rows if not part[str(i)]]
    p0, n0 = sum(low for low, _ in grow), sum(1 - low for low, _ in grow)

    def gain(test):
        p, n = sum(low for low, x in grow if test(x)), sum(1 - low for low, x in grow if test(x))
        return p * (math.log2((p + 0.5) / (p + n + 1)) - math.log2((p0 + 0.5) / (p0 + n0 + 1))) if p else 0.0

    best = max(gain(lambda x, f=f, m=m, up=up: (x[f] >= m) == up) for f in (0, 1) for m in {x[f] for _, x in grow} for up in (True, False))
    first = rules[0][0]
    f = names.index(first.feature)
    assert gain(lambda x: (x[f] >= first.threshold) == first.at_least) == pytest.approx(best)


def test_a_long_text_is_counted_in_slices(monkeypatch):
    """Counts do not depend on where a text is cut, and 20 MB take a bounded step."""
    filter_ = lang_bloom.build({"a": np.array([(3 << 24) | (97 << 16) | (98 << 8) | 32, (4 << 32) | (32 << 24) | (97 << 16) | (98 << 8) | 32], np.uint64)}, "a")
    text = "".join(np.random.default_rng(5).choice(list("ab  é\n"), 3000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = lang_bloom.coverage(filter_, data, np.array([0, len(text)]))
    for size in (1, 2, 7, 500):
        monkeypatch.setattr(lang_bloom, "SLICE", size)
        assert (lang_bloom.coverage(filter_, data, np.array([0, len(text)])) == whole).all()
        two = lang_bloom.coverage(filter_, np.concatenate([data, data]), np.array([0, len(text), 2 * len(text)]))
        assert (two == whole).all()
    monkeypatch.undo()
    long = np.tile(data, 20_000_000 // len(data))
    tracemalloc.start()
    lang_bloom.coverage(filter_, long, np.array([0, len(long)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000


def test_a_long_text_leaves_nothing_behind():
    """Words of 20 MB: a step takes some 60 bytes a byte while it runs, and the worker keeps tables of a step's size only."""
    from portolan.llm import common

    long = np.tile(np.frombuffer(b"some words of a long text ", np.uint8), 800_000)
    tracemalloc.start()
    common.words_of(long, np.array([0, len(long)]), common.PLAIN_WORDS)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60 * len(long) and kept < 40_000_000
