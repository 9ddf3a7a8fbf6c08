"""Quality classifier: a byte-level convolutional network in numpy.

Filters look at runs of bytes; their answers are max-pooled inside overlapping chunks that cover
the whole text (a chunk is two neighbouring halves), then the chunk values are pooled over the text
(largest, mean, smallest) and combined into one probability. Filters and weights are trained by
gradient descent, the gradient passing through the pooled places.

Trained on at most `per_class` labelled rows of each class and `sample_bytes` of their text, which
go to the driver whole; of rows in order of a hash, those that no longer fit are passed over.
Training and scoring read every byte.

Defined results: null and empty texts get the score of no evidence; rows are scored one by one, so
ties and repeated rows get equal scores; an id with two different labels is not learned from, nor is
a label without a document; if the labelled documents found do not bear both labels, every score is
the share of label 1 among them, or 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import held_out, text_steps, written
from portolan.llm.sampling import agreed, labelled_sample

WIDTH, FILTERS, HALF = 6, 16, 192
PAD = 256
#: Bytes whose filter answers are held at once.
STEP = 1 << 18


@dataclass
class Network:
    taps: np.ndarray     # (width, 257, filters): what each byte adds at each place
    bias: np.ndarray     # (filters,)
    weights: np.ndarray  # (3 * filters,)
    shift: np.ndarray    # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.weights, self.shift]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts set apart by padding: (codes, first code of each text with the total last)."""
    docs = len(offsets) - 1
    starts = offsets + np.arange(docs + 1) * (WIDTH - 1)
    codes = np.full(starts[-1] + WIDTH, PAD, np.int64)
    codes[np.arange(len(data)) + np.repeat(np.arange(docs) * (WIDTH - 1), np.diff(offsets))] = data
    return codes, starts


def answers(net: Network, codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Filter answers at places lo..hi; a place between texts has none, so that no text sees its neighbour."""
    out = net.taps[0][codes[lo:hi]]
    for w in range(1, WIDTH):
        out += net.taps[w][codes[lo + w:hi + w]]
    out[codes[lo:hi] == PAD] = -np.inf
    return out


def halves_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each half chunk, first half of each text with the total last); every text has one at least."""
    sizes = np.maximum(-(-(np.diff(starts) - (WIDTH - 1)) // HALF), 1)
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return starts[owner] + (np.arange(first[-1]) - first[owner]) * HALF, first


def pooled_halves(net: Network, codes: np.ndarray, places: np.ndarray, end: int) -> np.ndarray:
    """Largest answer of each filter in each half chunk."""
    out = np.empty((len(places), len(net.bias)), np.float32)
    at = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(places, places[at] + STEP)))
        stop = int(places[to]) if to < len(places) else end
        out[at:to] = np.maximum.reduceat(answers(net, codes, int(places[at]), stop), places[at:to] - places[at], axis=0)
        at = to
    return out


def pooled_places(net: Network, codes: np.ndarray, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each half chunk, and the first place that gives it."""
    k = len(net.bias)
    out, where = np.empty((len(places), k), np.float32), np.empty((len(places), k), np.int64)
    lo = 0
    while lo < len(places):
        to = max(lo + 1, int(np.searchsorted(places, places[lo] + STEP)))
        begin, stop = int(places[lo]), int(places[to]) if to < len(places) else end
        found = answers(net, codes, begin, stop)
        heads = places[lo:to] - begin
        out[lo:to] = np.maximum.reduceat(found, heads, axis=0)
        half = np.repeat(np.arange(lo, to), np.diff(np.concatenate([heads, [stop - begin]])))
        at, f = np.nonzero(found == out[half])
        lead = np.unique(half[at] * k + f, return_index=True)[1]
        where[lo:to] = (at[lead] + begin).reshape(to - lo, k)
        lo = to
    return out, where


def chunk_values(net: Network, halves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves (one for a text of one half): (values, first chunk of each text with the total last)."""
    sizes = np.diff(first)
    chunks = np.maximum(sizes - 1, 1)
    begin = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(len(sizes)), chunks)
    left = first[owner] + np.arange(begin[-1]) - begin[owner]
    right = np.minimum(left + 1, first[owner + 1] - 1)
    return np.tanh(np.maximum(halves[left], halves[right]) + net.bias), begin


def features(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    heads = begin[:-1]
    mean = np.add.reduceat(values, heads, axis=0) / np.diff(begin)[:, None]
    return np.concatenate([np.maximum.reduceat(values, heads, axis=0), mean, np.minimum.reduceat(values, heads, axis=0)], axis=1)


def probability(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    codes, starts = padded(data, offsets)
    places, first = halves_of(starts)
    values, begin = chunk_values(net, pooled_halves(net, codes, places, int(starts[-1])), first)
    empty = np.diff(offsets) == 0
    rows = np.where(empty[:, None], 0, features(values, begin))
    return 1 / (1 + np.exp(-(rows @ net.weights + net.shift[0]).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, share: float, steps: int = 700, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Network:
    """Fit filters and weights. share: the share of label 1 outside the sample, which the score is shifted to."""
    rng = np.random.default_rng(seed)
    taps = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
    taps[:, PAD] = 0
    net = Network(taps, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), np.zeros(1, np.float32))
    whole = [np.frombuffer(text, np.uint8) for text in texts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    epochs, step = max(1, -(-steps * batch // len(whole))), 0
    for epoch in range(epochs):
        order = rng.permutation(len(whole))
        for lo in range(0, len(order), batch):
            ids = order[lo:lo + batch]
            offsets = np.concatenate([[0], np.cumsum([len(whole[i]) for i in ids])])
            grads = _gradients(net, np.concatenate([whole[i] for i in ids]), offsets, labels[ids])
            step += 1
            pace = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
            for p, g, (m, v) in zip(net.parameters(), grads, moments):
                g = g + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            net.taps[:, PAD] = 0
    ones = labels.mean()
    net.shift += np.float32(np.log(share / (1 - share)) - np.log(ones / (1 - ones)))
    return net


def _gradients(net: Network, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    codes, starts = padded(data, offsets)
    places, first = halves_of(starts)
    tops, at = pooled_places(net, codes, places, int(starts[-1]))
    values, begin = chunk_values(net, tops, first)
    rows = np.where((np.diff(offsets) == 0)[:, None], np.float32(0), features(values, begin))
    p = 1 / (1 + np.exp(-(rows @ net.weights + net.shift[0])))
    error = ((p - labels) / len(labels)).astype(np.float32)
    d_rows = error[:, None] * net.weights
    sizes, owner, k = np.diff(begin), np.repeat(np.arange(len(labels)), np.diff(begin)), FILTERS
    d_values = (values == rows[owner, :k]) * d_rows[owner, :k] + d_rows[owner, k:2 * k] / sizes[owner][:, None] + (values == rows[owner, 2 * k:]) * d_rows[owner, 2 * k:]
    d_chunk = d_values * (1 - values * values)
    # Through each chunk to the half, and to the place in it, that gave the largest answer.
    half_counts = np.diff(first)
    left = first[owner] + np.arange(begin[-1]) - begin[owner]
    right = np.minimum(left + 1, first[owner + 1] - 1)
    source = np.where(tops[right] > tops[left], right[:, None], left[:, None])
    d_half = np.zeros_like(tops)
    np.add.at(d_half, (source, np.arange(k)[None, :]), d_chunk)
    d_taps = np.zeros_like(net.taps)
    for w in range(WIDTH):
        d_taps[w] = np.bincount((codes[at + w] * k + np.arange(k)).ravel(), d_half.ravel(), 257 * k).reshape(257, k)
    assert len(half_counts) == len(labels)
    return [d_taps, d_chunk.sum(0), rows.T @ error, np.array([error.sum()], np.float32)]


def constant(share: float) -> Network:
    """The network that gives every text one score."""
    edge = min(max(share, 1e-9), 1 - 1e-9)
    return Network(np.zeros((WIDTH, 257, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS, np.float32), np.array([np.log(edge / (1 - edge))], np.float32))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, sample_bytes: int = 1 << 28) -> Network:
    """Train on a bounded sample of labelled rows that are not held out."""
    learn = agreed(labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality"))
    counts = {r[0]: r[1] for r in learn.groupBy("quality").count().collect()}
    sample = labelled_sample(docs, learn, "quality", per_class)
    # Rows of one order, whatever the layout of the tables.
    sample = written(sample.select("quality", F.xxhash64("doc_id").alias("at"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")), "labelled")
    left, wanted = sample_bytes, []
    for at, size in sample.select("at", F.octet_length("text")).orderBy("at").collect():
        if size <= left:
            left -= size
            wanted.append(at)
    rows = sample.where(F.col("at").isin(wanted)).orderBy("at").collect() if wanted else []
    found = np.array([r["quality"] for r in rows], np.float32)
    if not 0 < found.sum() < len(found):
        return constant(float(found.mean()) if len(found) else 0.5)
    return train([bytes(r["text"]) for r in rows], found, counts[1] / sum(counts.values()))


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(probability(sent.value, data, offsets))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = scores(docs, fit(docs, labels, per_class))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
