"""Keyword, vector and hybrid search; every score is exact."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.numbers import format_fixed, similarity
from portolan.functions.text import occurrences

# Constant of the reciprocal-rank sum.
RANK_CONSTANT = 60

# Letters of a word by which tokens are looked up.
ANCHOR = 6

# Vectors and queries of one tile, and how many of them meet in one product.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 17, 1 << 14
ROW_STEP, TILE_STEP = 1 << 13, 1 << 9

# Word counts of one tile of texts, and words of one tile of queries.
WORD_BLOCK = 1 << 20
# Bytes of text that stand for one of those counts, bytes of tokens that are searched at once, and pairs of text and word that are added up at once.
COUNT_BYTES, TOKEN_STEP, PAIR_STEP = 8, 1 << 20, 1 << 21

# Bytes of words by whose fingerprints the places where longer words may begin are narrowed down.
BEGINNINGS = (4, 8, 16)

# A fingerprint of letters: their values times powers of an odd number, by which it can be divided again.
LETTER = np.random.default_rng(6).integers(0, 1 << 63, 256, "uint64") * np.uint64(2) + np.uint64(1)
POWER = 0x9E3779B97F4A7C15

# The same set of blanks for Python and for Spark: ASCII blanks and separators, and Unicode spaces.
SPLIT = "\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Between words and between tokens: ASCII blanks and separators, and Unicode spaces.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def keyword_score(text: Column, query: str) -> Column:
    """Occurrences of the query's words, as substrings; a repeated word counts again."""
    words = [w for w in re.split(f"[{SPLIT}]+", query.lower()) if w]

    def total(lowered: Column) -> Column:
        return reduce(lambda a, w: a + occurrences(lowered, F.lit(w)), words, F.lit(0).cast("bigint"))

    return F.element_at(F.transform(F.array(F.lower(text)), total), 1)  # lowered once


def keyword_search(docs: DataFrame, query: str, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Top documents for one query; add ``where`` before it to filter by metadata."""
    # A generated column: the filter stays above it, so a score is worked out once.
    scored = docs.select("*", F.explode(F.array(keyword_score(F.col(text), query))).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def keyword_search_many(docs: DataFrame, queries: DataFrame, k: int = 5, key: str = "doc_id", text: str = "text",
                        query_key: str = "query_id", query: str = "query") -> DataFrame:
    """Top documents for every query of a table. A text moves once, as it is, to meet the queries' words."""
    words = query_words(queries, query_key, query)
    size = docs.agg(F.sum(F.octet_length(text)) / COUNT_BYTES).scalar()
    texts = docs.select(F.col(key).alias(key), F.regexp_replace(F.lower(text), BLANKS, " ").alias("texto")).where("texto IS NOT NULL")
    return keyword_best(texts, size, words, key, query_key, k)


def query_words(queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """(query_key, palavra, vezes): the words of every query and how often it names them."""
    words = queries.select(query_key, F.explode(F.split(F.lower(query), BLANKS)).alias("palavra")).where("palavra <> ''")
    return words.groupBy(query_key, "palavra").agg(F.count(F.lit(1)).alias("vezes"))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf): the tokens of every text, parted by blanks."""
    tokens = docs.select(key, F.explode(F.split(F.lower(text), BLANKS)).alias("token")).where("token <> ''")
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def token_pieces(tokens: DataFrame, lengths: Column) -> DataFrame:
    """(token, pedaco): the distinct pieces of the given lengths of every token."""
    sized = tokens.select("token", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("token"))
    cut = sized.select("token", "n", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)).alias("i"))
    return cut.select("token", F.col("token").substr(F.col("i"), F.col("n")).alias("pedaco")).distinct()


def word_anchor(word: Column) -> Column:
    """The piece of a word by which its tokens are looked up."""
    return F.substring(word, 1, ANCHOR)


def tokens_with_words(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(token, palavra, n): tokens that hold a word, and how often. Only tokens that hold its anchor are compared with it."""
    wanted = words.select("palavra").distinct().withColumn("pedaco", word_anchor(F.col("palavra")))
    met = pieces.join(wanted, "pedaco").where(F.contains("token", F.col("palavra")))
    return met.select("token", "palavra", occurrences(F.col("token"), F.col("palavra")).alias("n"))


def word_counts(tokens: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, palavra, n): how often a text holds a word."""
    return tokens.join(held, "token").groupBy(key, "palavra").agg(F.sum(F.col("tf") * F.col("n")).alias("n"))


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order, null first, and the place of every entry among them."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), "int64")
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


def _letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and where each begins and ends."""
    strings = strings.cast(pa.large_string())
    if not len(strings):
        return np.zeros(0, "uint8"), np.zeros(1, "int64")
    ends = np.frombuffer(strings.buffers()[1], "int64")[strings.offset:strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", "uint8")[ends[0]:ends[-1]], ends - ends[0]


def _prints(data: np.ndarray):
    """A function from places and a length to the fingerprints of the letters there."""
    up = np.cumprod(np.full(len(data), POWER, "uint64"))
    down = np.cumprod(np.full(len(data), pow(POWER, -1, 1 << 64), "uint64"))
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(LETTER[data] * up)])
    return lambda place, length: (sums[place + length] - sums[place]) * down[place]


def _apart(word: np.ndarray, place: np.ndarray, token: np.ndarray, length: int) -> np.ndarray:
    """Which finds of words of one length remain, from left to right, when none may overlap the one before; finds are in order of word and place."""
    kept, near = np.ones(len(word), bool), np.zeros(len(word), bool)
    near[1:] = (word[1:] == word[:-1]) & (token[1:] == token[:-1]) & (place[1:] - place[:-1] < length)
    last = 0
    for i in np.flatnonzero(near):
        last = last if near[i - 1] else place[i - 1]
        kept[i] = place[i] - last >= length
        last = place[i] if kept[i] else last
    return kept


def _held(tokens: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, word, n): how often every token holds every word. Only pieces with the fingerprint of a word are compared with it."""
    spelled, own = _letters(words)
    named, sizes = _prints(spelled), np.diff(own)
    kinds, begun = [], {}
    for length in BEGINNINGS:
        prints = named(own[:-1][sizes >= length], length)
        begun[length] = np.zeros(1 << 20, bool)
        begun[length][prints >> np.uint64(44)] = True
    for length in np.unique(sizes):
        mine = np.flatnonzero(sizes == length)
        prints = named(own[mine], length)
        order = np.argsort(prints)
        seen = np.zeros(1 << 16, bool)
        seen[prints >> np.uint64(48)] = True
        kinds.append((int(length), mine[order], prints[order], seen))
    letters, all_ends = _letters(tokens)
    found, start = [(np.zeros(0, "int64"),) * 3], 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(all_ends, all_ends[start] + TOKEN_STEP, "right")) - 1)
        data, ends = letters[all_ends[start]:all_ends[stop]], all_ends[start:stop + 1] - all_ends[start]
        token, at = np.repeat(np.arange(stop - start), np.diff(ends)), _prints(data)
        place = np.arange(len(data))
        room = ends[token + 1] - place
        last = 0
        for length, mine, prints, seen in kinds:
            for beginning in (b for b in BEGINNINGS if last < b <= length):
                place = place[room[place] >= beginning]
                place = place[begun[beginning][at(place, beginning) >> np.uint64(44)]]
            last = length
            place = place[room[place] >= length]
            if not len(place):
                break
            wanted = at(place, length)
            maybe = np.flatnonzero(seen[wanted >> np.uint64(48)])
            first, wanted = np.searchsorted(prints, wanted[maybe]), wanted[maybe]
            times = np.searchsorted(prints, wanted, "right") - first
            here, word = np.repeat(place[maybe], times), mine[_spans(first, times)]
            same = np.ones(len(here), bool)
            for j in range(length):
                same &= data[here + j] == spelled[own[word] + j]
            here, word = here[same], word[same]
            order = np.argsort(word, kind="stable")
            here, word = here[order], word[order]
            kept = _apart(word, here, token[here], length)
            pair, n = np.unique(token[here[kept]] * len(words) + word[kept], return_counts=True)
            found.append((pair // len(words) + start, pair % len(words), n))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def _spans(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many times, one after another."""
    return np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)


def _summed(pair: np.ndarray, amount: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below a bound, and the sum of each."""
    if bound <= 8 * len(pair):
        sums = np.bincount(pair, amount, bound)  # whole numbers, exact in a double
        return (at := np.flatnonzero(sums)), sums[at].astype("int64")
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
    return pair[first], np.add.reduceat(amount[order], first) if len(first) else amount


def _token_steps(texts: pa.Table):
    """(text, token, tf, tokens) of bounded parts of a tile: the tokens of its texts, or those that it names with their counts."""
    if "texto" not in texts.column_names:
        for start in range(0, len(texts), WORD_BLOCK):
            some = texts.slice(start, WORD_BLOCK)
            coded = some["token"].combine_chunks().dictionary_encode()
            yield start + np.arange(len(some)), coded.indices.to_numpy(), some["tf"].to_numpy(), coded.dictionary
        return
    ends = np.cumsum(pc.binary_length(texts["texto"]).to_numpy().astype("int64"))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORD_BLOCK * COUNT_BYTES, "right")))
        split = pc.split_pattern(texts["texto"].slice(start, stop - start).combine_chunks().cast(pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        text = start + np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
        token, tf = np.unique(text * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
        yield token // len(coded.dictionary), token % len(coded.dictionary), tf, coded.dictionary
        start = stop


def _text_words(texts: pa.Table, place: np.ndarray, spelled: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, n): how often every text of a tile holds every word, word after word; place numbers the text of each row."""
    found = []
    for row, token, tf, tokens in _token_steps(texts):
        order = np.argsort(place[row], kind="stable")
        text, token, tf = place[row][order], token[order], tf[order]
        at, word, n = _held(tokens, spelled)
        order = np.argsort(at, kind="stable")
        word, n = word[order], n[order]
        edges = np.searchsorted(at[order], np.arange(len(tokens) + 1))
        times = np.diff(edges)[token]
        upto, start = np.cumsum(times), 0
        while start < len(token):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIR_STEP, "right")))
            some = slice(start, stop)
            here, low = _spans(edges[token[some]], times[some]), int(text[start])
            mine = np.repeat(text[some] - low, times[some])
            pair, total = _summed(mine * len(spelled) + word[here], n[here] * np.repeat(tf[some], times[some]), (int(text[stop - 1]) - low + 1) * len(spelled))
            found.append((pair // len(spelled) + low, pair % len(spelled), total))
            start = stop
    text, word, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "int64"),) * 3
    if len(found) < 2:
        order = np.argsort(word, kind="stable")
        return text[order], word[order], n[order]
    size = int(place.max()) + 1
    pair, n = _summed(word * size + text, n, size * len(spelled))  # a step may end inside a text
    return pair % size, pair // size, n


def _word_hits(k: int, key: str, query_key: str):
    """Best texts of each query inside one tile, word after word; one score per text of the tile is held."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not len(texts) or not len(words):
            return pa.table({query_key: words[query_key].slice(0, 0), key: texts[key].slice(0, 0), "score": pa.array([], pa.int64())})
        keys, place = _numbered(texts[key])
        names, query = _numbered(words[query_key])
        coded = words["termo"].combine_chunks().dictionary_encode()
        spelled, asked = coded.dictionary, coded.indices.to_numpy()
        text, word, n = _text_words(texts, place, spelled)
        bounds = np.searchsorted(word, np.arange(len(spelled) + 1))
        times, by_query = words["vezes"].to_numpy(), np.argsort(query, kind="stable")
        edges = np.searchsorted(query[by_query], np.arange(len(names) + 1))
        found = [(np.zeros(0, "int64"),) * 3]
        for q in range(len(names)):
            score = np.zeros(len(keys), "int64")
            for i in by_query[edges[q]:edges[q + 1]]:
                here = slice(bounds[asked[i]], bounds[asked[i] + 1])
                score[text[here]] += n[here] * times[i]  # a text is named once for each word
            hit = np.flatnonzero(score)
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
            hit = hit[np.lexsort((hit, -score[hit]))][:k]
            found.append((np.full(len(hit), q), hit, score[hit]))
        query, text, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({query_key: names.take(pa.array(query)), key: keys.take(pa.array(text)), "score": score})

    return run


def keyword_best(texts: DataFrame, size: Column, words: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """Best k texts for every query, of queries' words and of texts (key, texto), in lower case and with single spaces between tokens, or of their tokens (key, token, tf).

    A query word holds no white space, so each of its occurrences lies inside one token of a text. Queries
    and texts of common words meet in all pairs, and nearly every token holds some word, so neither pairs
    nor counts are rows: texts and queries are dealt into parts of bounded size, a tile is one part of
    each, finds the words in its distinct tokens and sends on k rows per query.
    `size` is the number of tokens of the texts, or a bound of it, so that texts are worked out once.
    """
    kinds = {"k": texts.schema[key].dataType.simpleString(), "q": words.schema[query_key].dataType.simpleString()}
    text_parts, query_parts = (F.greatest(F.ceil(n / WORD_BLOCK), F.lit(1)).cast("int") for n in (F.coalesce(size, F.lit(0)), words.agg(F.count(F.lit(1))).scalar()))
    dealt = texts.select("*", F.pmod(F.xxhash64(key), text_parts).cast("int").alias("parte"), F.explode(F.sequence(F.lit(0), query_parts - 1)).alias("bloco"))
    named = words.select(F.col(query_key).alias(query_key), F.col("palavra").alias("termo"), F.col("vezes").alias("vezes"))
    queries = named.select("*", F.pmod(F.xxhash64(query_key), query_parts).cast("int").alias("bloco"), F.explode(F.sequence(F.lit(0), text_parts - 1)).alias("parte"))
    tile = ["parte", "bloco"]
    hits = dealt.groupBy(*tile).cogroup(queries.groupBy(*tile)).applyInArrow(_word_hits(k, key, query_key), f"{query_key} {kinds['q']}, {key} {kinds['k']}, score bigint")
    return _best(hits, query_key, F.desc("score"), key, k)


def _word_counts(docs, words, key, text) -> DataFrame:
    """Counts of the queries' words in every text that holds them, by equality joins.

    A query word holds no white space, so each of its occurrences lies inside one token of a text. The
    distinct tokens are cut into pieces as long as the words' anchors, and pieces meet anchors by
    equality; only then is a token searched for the word.
    """
    tokens = token_counts(docs, key, text)
    lengths = words.agg(F.collect_set(F.least(F.length("palavra"), F.lit(ANCHOR)))).scalar()
    pieces = token_pieces(tokens.select("token").distinct(), lengths)
    return word_counts(tokens, tokens_with_words(pieces, words), key)


def _keyword_join(docs, queries, key, text, query_key, query) -> DataFrame:
    """Scores of all matching pairs."""
    words = query_words(queries, query_key, query)
    counts = _word_counts(docs, words, key, text)
    return counts.join(words, "palavra").groupBy(query_key, key).agg(F.sum(F.col("n") * F.col("vezes")).alias("score"))


def _best(scores: DataFrame, query_key: str, order: Column, key: str, k: int) -> DataFrame:
    """Best k per query; the limit is applied before the shuffle as well as after it."""
    ranked = scores.withColumn("posicao", F.row_number().over(Window.partitionBy(query_key).orderBy(order, key)))
    return ranked.where(F.col("posicao") <= k)


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda total, x: total + x)


def vector_search(vectors: DataFrame, query: Column, k: int = 5, metric: str = "inner", max_distance: float = 0.0,
                  key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top vectors for one query vector (a literal array or a scalar subquery).

    ``inner`` ranks by inner product, ``l2`` by squared distance with its similarity;
    a positive ``max_distance`` drops the hits of the top k beyond it.
    """
    paired = vectors.withColumn("_query", query)
    if metric == "inner":
        scored = paired.withColumn("score", inner_product(F.col(vector), F.col("_query"))).drop("_query")
        return scored.orderBy(F.desc("score"), key).limit(k)
    scored = paired.withColumn("score", squared_distance(F.col(vector), F.col("_query"))).drop("_query")
    hits = scored.orderBy("score", key).limit(k)
    hits = hits.where(F.col("score") <= max_distance) if max_distance > 0 else hits
    return hits.withColumn("similarity", similarity("score"))


def usable_vector(vector: Column) -> Column:
    """Whether a vector is there and holds nothing null."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull()), F.lit(False)) & (F.size(vector) > 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _near_distances(rows: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Squared distances of the k nearest rows of each query by difference; infinite for the rest.

    A product of matrices finds them: its rounding error is bounded by the sizes of the vectors, and
    all rows within twice that bound of the k-th are measured again.
    """
    sizes, wanted = (rows**2).sum(1), (queries**2).sum(1)
    rough = sizes[:, None] + wanted[None, :] - 2 * (rows @ queries.T)
    error = 8 * rows.shape[1] * np.finfo(float).eps * (sizes.max() + wanted)
    last = min(k, len(rows)) - 1
    i, j = np.nonzero(rough <= np.partition(rough, last, axis=0)[last] + 2 * error)
    out = np.full(rough.shape, np.inf)
    out[i, j] = ((rows[i] - queries[j]) ** 2).sum(1)
    return out


def _costs(rows: np.ndarray, queries: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, cost) of every pair that may be among the k cheapest of its query, equal costs included."""
    if metric == "l2":
        cost = _near_distances(rows, queries, k)
        i, j = np.nonzero(np.isfinite(cost))
    else:
        cost, last = -(rows @ queries.T), min(k, len(rows)) - 1
        i, j = np.nonzero(cost <= np.partition(cost, last, axis=0)[last])
    return i, j, cost[i, j]


def _cheapest(row: np.ndarray, query: np.ndarray, cost: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k cheapest entries of each query; equal costs go by the rank of the row's key."""
    order = np.lexsort((rank[row], cost, query))
    ordered = query[order]
    first = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - first < k]


def _tile_hits(k: int, metric: str, names: tuple[str, str]):
    """Best hits inside one tile: a bounded number of vectors against a bounded number of queries."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return pa.table({names[0]: queries["nome"].slice(0, 0), names[1]: vectors["chave"].slice(0, 0), "custo": pa.array([], pa.float64())})
        rows, wanted = _matrix(vectors["vetor"]), _matrix(queries["vetor"])
        rank = np.empty(len(rows), "int64")
        rank[pc.sort_indices(vectors["chave"], null_placement="at_start").to_numpy()] = np.arange(len(rows))
        found = []
        for q in range(0, len(wanted), TILE_STEP):
            best = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
            for r in range(0, len(rows), ROW_STEP):
                i, j, cost = _costs(rows[r:r + ROW_STEP], wanted[q:q + TILE_STEP], k, metric)
                best = tuple(np.concatenate([x, y]) for x, y in zip(best, (i + r, j, cost)))
                kept = _cheapest(*best, rank, k)
                best = tuple(x[kept] for x in best)
            found.append((best[0], best[1] + q, best[2]))
        row, query, cost = (np.concatenate(x) for x in zip(*found))
        return pa.table({names[0]: queries["nome"].take(pa.array(query)), names[1]: vectors["chave"].take(pa.array(row)), "custo": cost})

    return run


def _dealt(rows: DataFrame, group: Sequence[str], size: int, number: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of a part of their group, parts of `size` rows or so; and how many parts each group has.

    Rows are dealt out in turn as they lie, so a group of any size, or equal rows, fill parts alike.
    """
    counts = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
    sizes = counts.select(*[F.col(g).alias(f"_{g}") for g in group], "n")
    met = rows.join(sizes, reduce(lambda a, b: a & b, [F.col(g) == F.col(f"_{g}") for g in group]))
    return met.withColumn(number, F.pmod(F.monotonically_increasing_id(), F.col("n")).cast("int")).select(*rows.columns, number), counts


def tile_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str, key: str, query_key: str) -> DataFrame:
    """Best k per query, of vectors (celula, chave, vetor) and queries (celula, nome, vetor) of one cell.

    Vectors and queries of a cell are dealt into parts of bounded size. A tile is one part of each; the
    tasks hold one tile and send on k rows per query. Vectors travel once per part of queries, queries
    once per part of vectors; nothing passes through the driver.
    """
    group = ["celula", "tamanho"]
    vectors, queries = (f.where(usable_vector(F.col("vetor"))).withColumn("tamanho", F.size("vetor")) for f in (vectors, queries))
    kinds = {"q": queries.schema["nome"].dataType.simpleString(), "v": vectors.schema["chave"].dataType.simpleString()}
    vectors, vector_parts = _dealt(vectors, group, VECTOR_BLOCK, "parte")
    queries, query_parts = _dealt(queries, group, QUERY_BLOCK, "bloco")
    # Each side is repeated for the parts of the other; a side whose cell the other lacks goes.
    rows = vectors.join(query_parts, group).withColumn("bloco", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*group, "parte", "bloco", "chave", "vetor")
    wanted = queries.join(vector_parts, group).withColumn("parte", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*group, "parte", "bloco", "nome", "vetor")
    tile = [*group, "parte", "bloco"]
    hits = rows.groupBy(*tile).cogroup(wanted.groupBy(*tile)).applyInArrow(
        _tile_hits(k, metric, (query_key, key)), f"{query_key} {kinds['q']}, {key} {kinds['v']}, custo double")
    best = _best(hits, query_key, F.asc("custo"), key, k)
    if metric == "inner":
        return best.select(query_key, key, (-F.col("custo")).alias("score"), "posicao")
    return best.select(query_key, key, F.col("custo").alias("score"), similarity("custo").alias("similarity"), "posicao")


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", key: str = "vec_id",
                       vector: str = "embedding", query_key: str = "query_id", query: str = "query") -> DataFrame:
    """Top vectors for every query vector, exact.

    Vectors that are null or hold a null are no hits and ask for none; vectors of another length than
    the query's are no hits. Equal scores go by the key, a null key first.
    """
    whole = F.lit(0).alias("celula")
    return tile_search(vectors.select(whole, F.col(key).alias("chave"), F.col(vector).alias("vetor")),
                       queries.select(whole, F.col(query_key).alias("nome"), F.col(query).alias("vetor")), k, metric, key, query_key)


def fuse_rankings(rankings: Sequence[DataFrame], k: int = 5, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists with a ``posicao`` column."""
    parts = [r.select(query_key, key, (F.lit(1.0) / (F.lit(RANK_CONSTANT) + F.col("posicao"))).alias("s")) for r in rankings]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    scores = merged.groupBy(query_key, key).agg(F.sum("s").alias("score"))
    return _best(scores, query_key, F.desc("score"), key, k)


def assemble_context(hits: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                     query_key: str = "query_id") -> DataFrame:
    """One text per query from its few ranked hits, and the names of their sources."""
    found = hits.select(query_key, key, "posicao", "similarity").join(docs.select(key, text, source), key)
    entry = F.concat(
        F.format_string("[Documento %d]\nConteúdo:\n%s\n", F.col("posicao"), F.col(text)),
        F.coalesce(F.format_string("Fonte: %s\n", F.col(source)), F.lit("")),
        F.lit("Relevância: "), format_fixed("similarity", 2), F.lit("\n\n"))
    per_query = found.select(query_key, "posicao", entry.alias("bloco"), F.col(source).alias("fonte")).groupBy(query_key).agg(
        F.sort_array(F.collect_list(F.struct("posicao", "bloco"))).alias("blocos"),
        F.concat_ws(", ", F.sort_array(F.collect_set("fonte"))).alias("fontes"))
    return per_query.select(query_key, F.array_join(F.transform("blocos", lambda b: b["bloco"]), "").alias("contexto"), "fontes")


def index_statistics(chunks: DataFrame, vectors: DataFrame, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Documents, chunks, indexed vectors and their dimension."""
    stats = vectors.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d"))).scalar()
    return chunks.agg(F.count_distinct(key).alias("documentos"), F.count(F.lit(1)).alias("chunks")).select(
        "documentos", "chunks", stats["n"].alias("vetores"), stats["d"].alias("dimensao"))
