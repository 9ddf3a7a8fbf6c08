"""Language ID with language-bitmask n-gram filters.

Each learned language has a set of its most frequent byte n-grams. All sets share one table of
bitmasks, a bit-sliced Bloom filter: an n-gram sets its language's bit at a few hashed places, and
the AND of those places gives all languages that contain the n-gram in one look-up. A text is
decided by counting, per language, its n-grams with that bit set, after taking out the false
positives that the fill of the language's bit plane leads one to expect.

N-grams are counted on a bounded sample: at most `per_language` rows of each language, each with its
own text, equal rows once. More than 64 languages take more planes of 64 bits.

Defined results: `und` for a null text or one without a letter; rows are decided one by one, so
ties and repeated rows get equal results, and between equal languages the first by name wins; a
text without any known n-gram gets the commonest learned language with score 0; a language whose
sampled texts have no n-gram is not learned; without learned languages everything is `und`; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import held_out, mix, text_steps
from portolan.llm.sampling import row_sample

SIZES = (3, 4)
#: Bytes of one text whose n-grams are held at once.
SLICE = 1 << 20
TABLE_BITS, PLACES = 18, 3
KEPT = 4000

#: Bytes: A-Z in lower case; whatever is neither letter nor beyond ASCII is a space.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint64)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray   # (planes, 2**TABLE_BITS)
    chance: np.ndarray  # of a false positive, by language
    common: int         # the commonest language


def grams_of(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams, text of each) of texts set between two spaces; runs of spaces give no n-gram inside them."""
    docs = len(offsets) - 1
    codes = np.full(len(data) + 2 * docs, 32, np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    codes[np.arange(len(data)) + 2 * owner + 1] = FOLDED[data]
    of = np.repeat(np.arange(docs), np.diff(offsets) + 2)
    keys, good = _packed(codes, size)
    good &= of[:len(keys)] == of[len(of) - len(keys):]
    return keys[good], of[:len(good)][good]


def _packed(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of `size` codes as a number, and whether it neither begins nor ends with two spaces."""
    count = max(len(codes) - size + 1, 0)
    keys = np.full(count, np.uint64(size))
    for k in range(size):
        keys = keys << np.uint64(8) | codes[k:k + count]
    blank = codes == 32
    return keys, ~(blank[:count] & blank[1:count + 1]) & ~(blank[size - 2:size - 2 + count] & blank[size - 1:size - 1 + count])


def _grams_in_slices(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of a step; a single text longer than SLICE comes in slices that overlap by all but one byte of an n-gram."""
    if len(offsets) > 2 or len(data) <= SLICE:
        yield grams_of(data, offsets, size)
        return
    for lo in range(0, len(data) + 2, SLICE):
        # Places lo.. of the text between its two spaces.
        hi = min(lo + SLICE + size - 1, len(data) + 2)
        codes = FOLDED[data[max(lo - 1, 0):max(hi - 1, 0)]]
        if lo == 0:
            codes = np.concatenate([np.array([32], np.uint64), codes])
        if hi == len(data) + 2:
            codes = np.append(codes, np.uint64(32))
        keys, good = _packed(codes[:hi - lo], size)
        yield keys[good], np.zeros(int(good.sum()), np.int64)


def places(keys: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(PLACES):
        yield (mix(keys ^ np.uint64(k + 1 << 56)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def build(sets: dict[str, np.ndarray], common: str | None) -> Filter:
    """The filter of sets of n-grams by language; common is one of them."""
    languages = sorted(sets)
    masks = np.zeros((-(-len(languages) // 64), 1 << TABLE_BITS), np.uint64)
    chance = np.zeros(len(languages))
    for n, language in enumerate(languages):
        plane, bit = masks[n // 64], np.uint64(1 << n % 64)
        for at in places(sets[language]):
            plane[at] |= bit
        chance[n] = np.mean((plane & bit) != 0) ** PLACES
    return Filter(languages, masks, chance, languages.index(common) if languages else 0)


def coverage(filter_: Filter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Corrected counts of n-grams by text and language."""
    docs = len(offsets) - 1
    hits, totals = np.zeros((docs, len(filter_.languages))), np.zeros(docs)
    for size in SIZES:
        for keys, of in _grams_in_slices(data, offsets, size):
            totals += np.bincount(of, minlength=docs)
            where = list(places(keys))
            for p, plane in enumerate(filter_.masks):
                found = plane[where[0]]
                for at in where[1:]:
                    found = found & plane[at]
                for n in range(p * 64, min(p * 64 + 64, len(filter_.languages))):
                    hits[:, n] += np.bincount(of, (found >> np.uint64(n % 64) & np.uint64(1)).astype(np.float64), docs)
    return np.maximum(hits - totals[:, None] * filter_.chance, 0) / (1 - filter_.chance)


def fit(docs: DataFrame, per_language: int = 400) -> Filter:
    """Learn n-gram sets from rows with a language that are not held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = row_sample(known, "lang", per_language)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                for size in SIZES:
                    for keys, of in _grams_in_slices(data, offsets, size):
                        for language in dict.fromkeys(languages[lo:hi]):
                            found, counts = np.unique(keys[languages[lo:hi][of] == language], return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array([language] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    grams = sample.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.groupBy("lang").agg(F.expr(f"slice(sort_array(collect_list(struct(-n AS n, gram))), 1, {KEPT})").alias("kept"), F.sum("n").alias("all"))
    rows = best.select("lang", "kept.gram").collect()
    sets = {r["lang"]: np.array(r["gram"], np.int64).view(np.uint64) for r in rows}
    common = known.where(F.col("lang").isin(list(sets))).groupBy("lang").count().orderBy(F.desc("count"), "lang").first() if sets else None
    return build(sets, common[0] if common else None)


def predictions(docs: DataFrame, filter_: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        names = np.array([*known.languages, "und"], object)
        for batch in batches:
            letters = np.asarray(batch.column(2))
            for lo, hi, data, offsets in text_steps(batch.column(1)):
                if known.languages:
                    counts = coverage(known, data, offsets)
                    best, total = counts.argmax(axis=1), counts.sum(axis=1)
                    top = counts[np.arange(hi - lo), best]
                    score = np.divide(top, total, out=np.zeros(hi - lo), where=total > 0)
                    best = np.where(total > 0, best, known.common)
                else:
                    best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                best, score = np.where(letters[lo:hi], best, -1), np.where(letters[lo:hi], score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(work, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return predictions(docs, fit(docs, per_language)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
