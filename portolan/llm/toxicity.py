"""Toxicity with a classifier chain.

Categories are predicted one after another by linear models over the words of a text; each later
model also sees the probabilities of the earlier ones. While training, those probabilities come from
models that had not seen the row (out of fold), so later models learn from what they will meet.

Features are words and the beginnings of words (3 to 6 bytes), so inflected and compound forms of a
telling stem count too; each stands for its presence and for its share of the words. Trained on at
most `per_class` labelled rows of each combination of categories. Terms are kept where their document
frequency tells the categories apart by more than chance; the weights carry an L2 penalty.

Defined results: null and empty texts have no words and get the score of no evidence; rows are
scored one by one, so ties and repeated rows get equal scores; an id whose rows disagree on a label is
not learned from, nor is a label without a document; a category with one label value only gets its
share; an empty table gives no rows. Probabilities are those of the sample, in which rare
combinations weigh more than in the corpus; the threshold is set for them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import PLAIN_WORDS, mix, text_steps, words_of, written
from portolan.llm.sampling import labelled_sample

#: The chain's order. The tables label two: junk (no quality) first, then abuse.
CATEGORIES = ("low_quality", "toxic")
FOLDS, KEPT, LEAST_Z, LEAST_TEXTS = 5, 1500, 4.0, 5
BEGINNINGS = (3, 4, 5, 6)


@dataclass
class Chain:
    terms: np.ndarray            # sorted hashes of the kept terms
    weights: list[np.ndarray]    # by category: presence and share of each term, earlier categories, shift


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and their beginnings: (hashes, text of each, words of each text)."""
    start, end, hashes, first = words_of(data, offsets, PLAIN_WORDS)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    found, of = [hashes], [owner]
    packed = np.zeros(len(start), np.uint64)
    for size in range(1, max(BEGINNINGS) + 1):
        longer = end - start > size
        at = np.minimum(start + size - 1, len(data) - 1)
        packed = packed << np.uint64(8) | (PLAIN_WORDS[data[at]] - np.uint16(1)).astype(np.uint64) if len(data) else packed
        if size in BEGINNINGS:
            found.append(mix(packed[longer] | np.uint64(size << 56)))
            of.append(owner[longer])
    return np.concatenate(found), np.concatenate(of), counts


def values_of(terms: np.ndarray, hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Presence, then share in hundredths on a log scale, by text and kept term."""
    docs, kept = len(counts), len(terms)
    if not kept:
        return np.zeros((docs, 0), np.float32)
    at = np.minimum(np.searchsorted(terms, hashes), kept - 1)
    hit = terms[at] == hashes
    times = np.bincount(owner[hit] * kept + at[hit], minlength=docs * kept).reshape(docs, kept)
    return np.concatenate([times > 0, np.log1p(100 * times / np.maximum(counts, 20)[:, None])], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 150) -> np.ndarray:
    """Logistic regression with a shift, by accelerated gradient steps."""
    rows = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1, dtype=np.float32)
    y = y.astype(np.float32)
    if not 0 < y.mean() < 1:
        return np.concatenate([np.zeros(x.shape[1]), _logit(np.array([y.mean() if len(y) else 0.0]))])
    bound = np.ones(rows.shape[1], np.float32)
    for _ in range(12):
        bound = rows.T @ (rows @ bound)
        bound /= np.linalg.norm(bound)
    step = np.float32(1 / (0.25 * np.linalg.norm(rows @ bound) ** 2 + penalty))
    held = np.full(rows.shape[1], penalty, np.float32)
    held[-1] = 0
    w = ahead = np.zeros(rows.shape[1], np.float32)
    pace = 1.0
    for _ in range(rounds):
        new = ahead - step * (rows.T @ (_sigmoid(rows @ ahead) - y) + held * ahead)
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + np.float32((pace - 1) / next_pace) * (new - w), new, next_pace
    return w


def train(terms: np.ndarray, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
    """x: term values; labels: (rows, categories); fold: a fold number by row."""
    weights, earlier = [], np.zeros((len(x), 0), np.float32)
    for c in range(labels.shape[1]):
        rows = np.concatenate([x, earlier], axis=1)
        weights.append(_fit_linear(rows, labels[:, c]))
        unseen = np.zeros(len(x))
        for f in np.unique(fold):
            w = _fit_linear(rows[fold != f], labels[fold != f, c])
            unseen[fold == f] = rows[fold == f] @ w[:-1] + w[-1]
        earlier = np.concatenate([earlier, _logit(_sigmoid(unseen))[:, None].astype(np.float32)], axis=1)
    return Chain(terms, weights)


def probabilities(chain: Chain, x: np.ndarray) -> np.ndarray:
    out, earlier = [], np.zeros((len(x), 0))
    for w in chain.weights:
        p = _sigmoid(np.concatenate([x, earlier], axis=1) @ w[:-1] + w[-1])
        out.append(p)
        earlier = np.concatenate([earlier, _logit(p)[:, None]], axis=1)
    return np.stack(out, axis=1)


def telling_terms(sample: DataFrame, categories: Sequence[str]) -> np.ndarray:
    """Terms whose document frequency differs between the values of a category by more than chance: KEPT at most."""
    n = len(categories)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.stack([np.asarray(batch.column(1 + k)) for k in range(n)]) == 1
            for lo, hi, data, offsets in text_steps(batch.column(n + 1)):
                hashes, owner, _ = terms_of(data, offsets)
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[new], owner[new]
                if len(hashes):
                    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                    yes = [np.add.reduceat(labels[k, lo:hi][owner].astype(np.int64), heads) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(hashes)))), *map(pa.array, yes)], names=["term", "texts", *[f"yes{k}" for k in range(n)]])

    schema = ", ".join(["term long", "texts long", *[f"yes{k} long" for k in range(n)]])
    sums = sample.mapInArrow(work, schema).groupBy("term").agg(F.sum("texts").alias("texts"), *[F.sum(f"yes{k}").alias(f"yes{k}") for k in range(n)]).where(F.col("texts") >= LEAST_TEXTS)
    totals = sample.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast("long")).alias(c) for c in categories]).first()
    z = F.lit(0.0)
    for k, c in enumerate(categories):
        ones, zeros = totals[c] or 0, totals["rows"] - (totals[c] or 0)
        if ones and zeros:
            both = F.col("texts") / float(totals["rows"])
            gap = F.abs(F.col(f"yes{k}") / float(ones) - (F.col("texts") - F.col(f"yes{k}")) / float(zeros))
            z = F.greatest(z, gap / F.sqrt(both * (1 - both) * (1 / ones + 1 / zeros) + 1e-12))
    best = sums.select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(KEPT).collect()
    return np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, per_class: int = 1500) -> Chain:
    """labels: doc_id and one 0/1 column per category; rows with a null among them are left out."""
    n = len(categories)
    known = labels.where(" AND ".join(f"{c} IN (0, 1)" for c in categories)).withColumn("combination", F.concat_ws("-", *categories))
    sample = labelled_sample(docs, known.select("doc_id", *categories, "combination"), "combination", per_class)
    sample = written(sample.select(F.col("doc_id").cast("long"), *[F.col(c).cast("int").alias(c) for c in categories], F.col("text").cast("string").alias("text")), "labelled")
    terms = telling_terms(sample, categories)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(n + 1)):
                values = values_of(terms, *terms_of(data, offsets))
                # Packed, so that the driver holds bytes and no objects for the values of a row.
                some = [np.flatnonzero(row).astype("<i4") for row in values]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(k).slice(lo, hi - lo) for k in range(n + 1)], pa.array([at.tobytes() for at in some], pa.binary()),
                    pa.array([row[at].astype("<f4").tobytes() for row, at in zip(values, some)], pa.binary())], names=["doc_id", *categories, "at", "value"])

    schema = ", ".join(["doc_id long", *[f"{c} int" for c in categories], "at binary", "value binary"])
    rows = sample.mapInArrow(work, schema).withColumn("order", F.xxhash64("doc_id")).orderBy("order").collect()
    if not rows:
        return Chain(np.zeros(0, np.uint64), [np.array([0.0] * k + [-9.0]) for k in range(n)])
    x = np.zeros((len(rows), 2 * len(terms)), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<i4")] = np.frombuffer(r["value"], "<f4")
    return train(terms, x, np.array([[r[c] for c in categories] for r in rows], np.float64), np.array([r["order"] % FOLDS for r in rows]))


def scores(docs: DataFrame, chain: Chain, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """doc_id and the probability of each category, p_<category>."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{c}" for c in categories]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                found = probabilities(known, values_of(known.terms, *terms_of(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(p.astype(np.float64)) for p in found.T]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, ", ".join([f"{names[0]} long", *[f"{n} double" for n in names[1:]]]))


def toxic_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.4, per_class: int = 1500) -> DataFrame:
    """doc_id, the chain's probabilities and `toxic` of every row."""
    given = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return scores(docs, fit(docs, given, CATEGORIES, per_class)).withColumn("toxic", F.col("p_toxic") >= threshold)
