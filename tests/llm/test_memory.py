"""What a Python worker holds at once is bounded in bytes, whatever the number and length of texts."""

import pyarrow as pa

from portolan.llm import token_files
from portolan.llm.common import BATCH_BYTES, BATCH_SETTING, text_steps, written


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])


def test_rows_reach_python_in_batches_of_bounded_bytes(spark):
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id % 10 AS string), 100000) AS text")
    sizes = [r.size for r in written(texts.mapInArrow(_sizes, "size long"), "sizes").collect()]
    assert sum(sizes) >= 40_000_000 and max(sizes) <= BATCH_BYTES + 200_000
    assert spark.conf.get(BATCH_SETTING, None) is None


def test_a_bound_of_the_session_is_left_alone(spark):
    texts = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 100000) AS text")
    spark.conf.set(BATCH_SETTING, 1_000_000)
    try:
        sizes = [r.size for r in written(texts.mapInArrow(_sizes, "size long"), "sizes").collect()]
        assert max(sizes) <= 1_200_000 and spark.conf.get(BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(BATCH_SETTING)


class _Watched:
    """A tokenizer that notes how many texts and line breaks one call gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.most = max(self.most, sum(1 + t.count("\n") for t in texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_pieces_are_encoded_in_calls_of_bounded_size(monkeypatch):
    monkeypatch.setattr(token_files, "JOINED_PIECES", 16)
    monkeypatch.setattr(token_files, "CACHE_PIECES", 100)
    with open(token_files.default_vocabulary(), encoding="utf-8") as file:
        coder = token_files.PieceEncoder(file.read())
    tokenizer = coder.tokenizer
    coder.tokenizer = _Watched(tokenizer)
    texts = [f"word{i} 日本{i} текст{i}" for i in range(200)] + ["日" * i for i in range(1, 80)]
    got = []
    for _, _, data, offsets in text_steps(pa.array(texts), 500, 50):
        ids, first = coder.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert 1 < coder.tokenizer.most <= 16


def test_shards_are_taken_from_a_batch_one_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"a", None, b"ccc"], pa.binary())], names=["seq", "ids"])
    rows = token_files._rows(batch)
    assert next(rows) == {"seq": 1, "ids": b"a"} and list(rows) == batch.to_pylist()[1:]
