"""The queries against brute force, on a fixture of odd cases: nulls, empty and long texts, repeated rows, missing ids, clashing columns."""

import hashlib
import zlib

import pytest

from portolan.llm import catalog, minhash, token_files, winnow
from tests.llm import plain

QUERIES = catalog.QUERIES
KEY = {"key": lambda r: tuple((x is not None, x) for x in r)}


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), **KEY)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_rules(spark, edge, texts):
    got = QUERIES["op1_quality_rules"](spark, edge)
    want = sorted(((i, *plain.base_counts(t)) for i, t in texts[0]), **KEY)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r.kept for r in got.collect() if r.base_failed)


@pytest.mark.parametrize(("name", "kinds"), [("op2_personal_data", plain.PERSONAL), ("op3_secret_scan", plain.SECRET)])
def test_base_spans(spark, edge, texts, name, kinds):
    got = QUERIES[name](spark, edge)
    want = []
    for i, t in texts[0]:
        spans = plain.base_spans(t, kinds)
        want.append((i, *[sum(s.startswith(k + ":") for s in spans) for k in kinds], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert rows(got, "doc_id", *[f"n_{k}" for k in kinds], "base_sha256") == sorted(want, **KEY)


def test_added_spans(spark, edge, texts):
    text = dict(texts[0])
    cut = {r.doc_id: [(p.split(":")[0], text[r.doc_id][slice(*map(int, p.split(":")[1:]))]) for p in r.spans.split(",") if p] for q in ("op2_personal_data", "op3_secret_scan") for r in QUERIES[q](spark, edge).where("doc_id IN (20, 22, 23, 24)").collect() if r.spans}
    assert [s for s in cut[20] if s[0] in ("iban", "account")] == [("iban", "GB82WEST12345698765432"), ("account", "123456789")] if 20 in cut else False
    kinds = [k for k, _ in cut[22]]
    assert "blob" in kinds and "endpoint" in kinds and "user" in kinds
    assert 23 not in cut and 24 not in cut


def test_winnowing(spark, edge, texts):
    got = QUERIES["op4_winnowing"](spark, edge)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(plain.contamination(*texts), **KEY)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, edge, texts, size):
    got = minhash.near_duplicates(spark.read.parquet(f"{edge}/documents.parquet"), size=size)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(plain.components(texts[0], size), **KEY)


def test_large_near_groups_are_joined_in_blocks(spark, monkeypatch):
    """A chain of drifting copies, and parts so small that every two blocks meet in a task of their own."""
    monkeypatch.setattr(minhash, "COMPARED_SHINGLES", 300)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(40):
        texts.append((i, " ".join(words)))
        words = words[:]
        words[(7 * i) % 60] = f"new{i}"
        words[(11 * i + 3) % 60] = f"more{i}"
    got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), size=2)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(plain.components(texts, 2), **KEY)


def test_blocks_give_a_forest_of_labels():
    """600 sets that all link and bear different labels give 599 edges, and two groups stay two."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sets = [np.arange(100)] * 400 + [np.arange(1000, 1100)] * 200
    sets = [np.unique(np.concatenate([s[:-2], rng.integers(10_000, 2**50, 2)])) for s in sets]
    labels = rng.permutation(600) + 5
    found = minhash._label_links(pa.table({"label": pa.array(labels), "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))}), 80).to_pydict()
    assert len(found["a"]) == 598
    group = {}
    for a, b in zip(found["a"], found["b"]):
        group.setdefault(b, {b}).add(a)
    assert sorted(group.values(), key=len) == sorted([set(labels[:400].tolist()), set(labels[400:].tolist())], key=len)


def test_one_of_each(spark, edge, texts):
    kept = minhash.one_of_each(spark.read.parquet(f"{edge}/documents.parquet"), size=2)
    assert kept.columns[:2] == ["doc_id", "text"] and "tk" in kept.columns
    want = {c for i, n, c in plain.components(texts[0], 2) if n and i == c and i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert want <= set(got) and got.count(2) == 0 and got.count(1) == 1 and {5, 6, 7} <= set(got)


def test_one_of_each_keeps_different_texts_under_one_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    near = a.replace("a39", "other")
    docs = [(1, a), (1, near), (1, b), (2, b), (3, a), (None, c), (None, c), (None, c + " more"), (None, d), (None, b), (None, None), (None, ""), (None, "!"), (4, None), (4, None)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, source string").repartition(3)
    kept = minhash.one_of_each(frame, size=2)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == frame.columns
    # One of each group: a with its near copy, b under its smallest id, c with its near copy, d, "!".
    assert sum(x in got for x in [(1, a), (1, near)]) == 1 and [x for x in got if x[1] == b] == [(1, b)]
    assert sum(x[1] in (c, c + " more") for x in got) == 1 and got.count((None, d)) == 1 and got.count((None, "!")) == 1
    assert got.count((None, None)) == 1 and got.count((None, "")) == 1 and got.count((4, None)) == 2 and len(got) == 9


def test_clean_keeps_columns(spark, edge, texts):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    kept = winnow.clean(docs, spark.read.parquet(f"{edge}/benchmark.parquet"))
    bad = {i for i, *_, hit in plain.contamination(*texts) if hit}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id} == {i for i, _ in texts[0] if i} - bad


def test_items_without_an_id_are_hits(spark):
    long, other = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, "x " + long), (2, other), (3, "short item here"), (4, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, long), (7, other), (None, other), (None, "short item")], "item_id long, text string")
    got = rows(winnow.contamination(docs, items), "doc_id", "n_hit", "item_ids", "contaminated")
    assert got == [(1, 30, [], True), (2, 30, ["7"], True), (3, 2, [], True), (4, 0, [], False)]
    assert [r.doc_id for r in winnow.clean(docs, items).collect()] == [4]


def test_token_files(spark, edge, texts, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_vocabulary())
    got = rows(QUERIES["op10_token_files"](spark, edge), "doc_id", "start", "n_tokens", "ids_crc32")
    assert [r[0] for r in got] == sorted((i for i, _ in texts[0]), key=lambda x: (x is not None, x or 0))
    assert {(r[0], r[2], r[3]) for r in got} == {(r[0], r[2], r[3]) for r in plain.token_rows(texts[0], whole)}
    end = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == end
        end += r[2]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.read.parquet(f"{edge}/documents.parquet"), path, shard_ids=500)
    found = token_files.lookup(spark, path, [2, 13, 27, 999]).collect()
    text = dict(texts[0])
    assert sorted(r.doc_id for r in found) == [2, 2, 13, 27]
    assert all(r.ids == [*whole.encode(text[r.doc_id], add_special_tokens=False).ids, 2] for r in found)


def test_pieces_give_the_ids_of_whole_texts():
    """Random strings of what the cuts look at: stops, Latin-1 letters and signs, blanks of all kinds, the special token."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "a", "word", "Straße", "é", "à", "×", "÷", "ÿ", "日本", "д", "1", "23", ".", ",", ";", ":", "!", "?", ")", "(", "'", "'s", "n't", "<|endoftext|>", "|>", "_", "\x00", "\x85", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(8000)]
    with open(token_files.default_vocabulary(), encoding="utf-8") as file:
        coder = token_files.PieceEncoder(file.read())
    whole = Tokenizer.from_file(token_files.default_vocabulary())
    data = [t.encode() for t in texts]
    for lo in range(0, len(texts), 1000):
        part = data[lo:lo + 1000]
        ids, first = coder.encode(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in part])]))
        for k in range(len(part)):
            assert ids[first[k]:first[k + 1]].tolist() == [*whole.encode(texts[lo + k], add_special_tokens=False).ids, token_files.END_ID], texts[lo + k]
    assert coder.cuts


def test_other_pre_tokenizers_get_whole_texts():
    import json

    import numpy as np
    from tokenizers import Tokenizer

    with open(token_files.default_vocabulary(), encoding="utf-8") as file:
        described = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
                   {"added_tokens": [{**described["added_tokens"][0], "content": "a. b"}]}):
        vocabulary = json.dumps({**described, **change})
        coder, whole = token_files.PieceEncoder(vocabulary), Tokenizer.from_str(vocabulary)
        texts = ["One a. b two, three.\nfour", "", "x"]
        data = [t.encode() for t in texts]
        ids, first = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
        assert not coder.cuts
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]


def test_perfect_hash_turns_foreign_keys_away():
    import numpy as np

    keys = np.sort(np.random.default_rng(3).integers(-2**62, 2**62, 5000))
    index = token_files.Index(token_files.build_index(keys, np.arange(5001)))
    first, count = index.find(keys)
    assert (first == np.arange(5000)).all() and (count == 1).all()
    _, count = index.find(np.random.default_rng(4).integers(-2**62, 2**62, 5000))
    assert count.sum() <= 1


@pytest.mark.parametrize("name", ["op5_toxicity_chain", "op6_mixing", "op8_byte_cnn", "op9_language_bloom"])
def test_one_row_per_document(spark, edge, texts, name):
    got = QUERIES[name](spark, edge).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0)) == sorted((i for i, _ in texts[0]), key=lambda x: (x is not None, x or 0))
    for r in got:
        if "held_out" in r:
            assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1
        if "predicted" in r:
            assert r.predicted == int(r.score >= 0.7)
        if "lang_pred" in r:
            assert (r.lang_pred == "und") == (r.doc_id in (5, 6, 7, 16, 31)) or r.lang_pred in ("en", "de")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_items_of_one_passage_meet_a_text_as_one(spark):
    """40 items around one passage of 400 words, some 130 kept hashes: a text meets all of them as one but at the ends, and all 40 are reported."""
    passage = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, "before " + passage + " after"), (2, passage), (3, "w1 w2 w3 only")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a{i} b{i} {passage} c{i}") for i in range(40)] + [(99, "w1 w2 w3 only")], "item_id long, text string")
    _, runs, members = winnow.hit_runs(docs, items)
    assert runs.count() < 1000 and members.count() >= 41
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in winnow.contamination(docs, items).collect()}
    want = plain.contamination([(1, "before " + passage + " after"), (2, passage), (3, "w1 w2 w3 only")], [(i, f"a{i} b{i} {passage} c{i}") for i in range(40)] + [(99, "w1 w2 w3 only")])
    assert {i: (n, len(x)) for i, (n, x) in got.items()} == {i: (n, m) for i, _, n, m, *_ in want}
