"""Language identification with a linear-chain conditional random field over words.

Every word of a text carries a language; neighbouring words mostly share one. A word's emission adds
weights of its features: byte n-grams, among them those that touch a word border (its affixes), and the
word itself (the lexicon), each hashed into one of ``BUCKETS`` rows of weights. Transitions are learned
with them. Forward-backward gives each word's language probabilities; a document's score for a language
is their mean over its words, so code-switched texts get a mixture.

Training takes a bounded sample: about ``PER_LANGUAGE`` labelled rows of each language by a hash of their
id. Labelled texts hold one language each, so chains are spliced from pieces of several texts, which
gives transitions between languages something to learn from. Weights start from log odds of counts and
are refined by gradient steps on the chains' likelihood.

Chains are cut into blocks of ``BLOCK`` words. Products of their transition matrices carry messages from
block to block, so a long text costs no long loop, and no word is left out.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language
that sorts first; rows are independent, so null or repeated doc_ids pass through (a null doc_id is not
held out and not learned from); with no labelled row at all every text is ``und``; an empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dischargelab.llm.common import map_batches, table
from dischargelab.llm.words import runs, split_words

PER_LANGUAGE = 150  # labelled texts of each language to learn from
LEARNED_CHARS = 20_000  # a longer sampled text gives pieces from all over it, this much in total
BITS, BLOCK, STEPS, RATE = 16, 32, 12, 0.3
BUCKETS = 1 << BITS
SLICE = 1 << 20  # bytes of text that are worked on at a time; the arrays take some fifty times as much
UNKNOWN = "und"
MIN_SCORE = 0.3  # below it a document has no language of its own

# Word bytes: ASCII letters and everything beyond ASCII; the rest separates words.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[97:123] = False
NOT_LETTER[128:] = False
FIRST, LAST = 1, 2  # word borders; no text byte that counts as a letter


@dataclass
class Features:
    grams: list[np.ndarray]  # for each n, the bucket at each place of the padded words; 0 where none begins
    begin: np.ndarray  # place of each word's border
    word: np.ndarray  # bucket of the word itself
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    ascii_letter: np.ndarray  # whether a text has an ASCII letter


def _bucket(code: np.ndarray, odd: int) -> np.ndarray:
    """One of BUCKETS - 1 rows; row 0 stands for no feature."""
    return np.maximum((code * np.uint32(odd)) >> np.uint32(32 - BITS), 1).astype(np.int32)


def features(column: pa.Array) -> Features:
    w = split_words(column, NOT_LETTER)
    sizes = w.end - w.start + 2  # with both borders
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    padded = np.full(n + 3, LAST, np.uint8)
    inside = np.ones(n, bool)
    inside[begin] = inside[begin + sizes - 1] = False
    padded[:n][inside] = w.data[~NOT_LETTER[w.data]]
    padded[begin] = FIRST
    # Capitals of the two-byte Latin letters: C3 80 to C3 9E, but for C3 97.
    at = np.flatnonzero(padded[:-1] == 0xC3) + 1
    padded[at] += np.uint8(32) * ((padded[at] <= 0x9E) & (padded[at] != 0x97))
    wide = padded.astype(np.uint32)
    pairs = wide[:-1] | wide[1:] << np.uint32(8)
    triples = pairs[:n] | wide[2: n + 2] << np.uint32(16)
    two, three = _bucket(pairs[:n], 0x9E3779B1), _bucket(triples, 0x85EBCA77)
    stop = begin + sizes
    two[stop - 1] = three[stop - 1] = three[stop - 2] = 0
    # The word itself: exact up to six letters, else by its ends and length.
    word = (triples[begin] | wide[begin + 3] << np.uint32(24)) * np.uint32(0xC2B2AE3D)
    word ^= (triples[stop - 3] | wide[np.maximum(stop - 4, 0)] << np.uint32(24)) * np.uint32(0x27D4EB2F)
    letters = np.r_[0, np.cumsum((w.data >= 97) & (w.data < 123))]
    lexicon = _bucket(word ^ sizes.astype(np.uint32), 0x165667B1)
    return Features([two, three], begin, lexicon, w.first, np.diff(letters[w.bounds]) > 0)


def emissions(f: Features, weights: np.ndarray) -> np.ndarray:
    """Scores of every word in every language."""
    if not len(f.begin):
        return np.zeros((0, weights.shape[1]))
    places = np.take(weights, f.grams[0], axis=0, mode="clip")
    for g in f.grams[1:]:
        places += np.take(weights, g, axis=0, mode="clip")
    return (np.add.reduceat(places, f.begin, axis=0) + weights[f.word]).astype(np.float64)


def _shares(x: np.ndarray) -> np.ndarray:
    return x / (x @ np.ones((x.shape[1], 1)))


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities, and (if asked for) expected transitions summed over all chains.

    Values of one step of all blocks lie together; blocks are ordered by their length, so that a step
    takes a prefix of them. Emissions are at most 1 and at least one of each word's is, so a block needs
    no scaling inside.
    """
    n, k = scores.shape
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    nb = int(blocks.sum())
    if not nb:
        return np.zeros((0, k)), np.zeros((k, k))
    block0 = np.cumsum(blocks) - blocks
    nth = np.arange(nb) - np.repeat(block0, blocks)
    fill = np.minimum(np.repeat(lengths, blocks) - nth * BLOCK, BLOCK)
    order = np.argsort(-fill, kind="stable")
    rank = np.empty(nb, np.int64)
    rank[order] = np.arange(nb)
    active = np.searchsorted(-fill[order], -np.arange(1, BLOCK + 1), side="right")
    word = np.arange(n) - np.repeat(first[:-1] - block0 * BLOCK, lengths)  # place among all blocks' places
    place = word % BLOCK * nb + rank[word // BLOCK]
    e = np.ones((BLOCK * nb, k))
    best = scores[:, 0].copy()
    for j in range(1, k):
        np.maximum(best, scores[:, j], out=best)
    e[place] = np.exp(scores - best[:, None])
    e = e.reshape(BLOCK, nb, k)
    a = np.exp(transitions - transitions.max())
    # rows[i] is row i of every block's product of transition matrices.
    rows = [np.tile(np.eye(k)[i], (nb, 1)) for i in range(k)]
    for j, m in enumerate(active):
        for r in rows:
            r[:m] = (r[:m] @ a) * e[j, :m]
    product = np.stack(rows, axis=1)
    by_nth = np.split(rank[np.argsort(nth, kind="stable")], np.cumsum(np.bincount(nth))[:-1])
    before = np.empty(nb, np.int64)  # rank of the block before, in the same chain
    before[rank[1:]] = rank[:-1]
    enter, leave = np.full((nb, k), 1.0 / k), np.ones((nb, k))
    for at in by_nth[1:]:
        enter[at] = _shares(np.einsum("bi,bij->bj", enter[before[at]], product[before[at]]))
    for at in by_nth[:0:-1]:
        leave[before[at]] = _shares(np.einsum("bij,bj->bi", product[at], leave[at]))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    x = enter
    for j, m in enumerate(active):
        x = (x[:m] @ a) * e[j, :m]
        alpha[j, :m] = x
    x = leave.copy()
    for j in range(BLOCK - 1, -1, -1):
        m = active[j]
        beta[j, :m] = x[:m]
        x[:m] = (x[:m] * e[j, :m]) @ a.T
    alpha, beta, e = (v.reshape(-1, k)[place] for v in (alpha, beta, e))
    marginals = _shares(alpha * beta)
    if not expect:
        return marginals, np.zeros((k, k))
    inner = np.ones(n, bool)
    inner[first[:-1][lengths > 0]] = False  # words with a word before them
    now = np.flatnonzero(inner)
    left, right = alpha[now - 1], beta[now] * e[now]
    norm = ((left @ a) * right) @ np.ones((k, 1))
    return marginals, a * ((left / norm).T @ right)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        f = features(column)
        sizes = np.diff(f.first)
        marginals, _ = forward_backward(emissions(f, self.weights), f.first, self.transitions, expect=False)
        summed = np.vstack([np.zeros((1, len(self.languages))), np.cumsum(marginals, axis=0)])
        mean = np.diff(summed[f.first], axis=0) / np.maximum(sizes, 1)[:, None]
        lettered = f.ascii_letter.copy()
        for i in np.flatnonzero((sizes > 0) & ~lettered):  # beyond ASCII a word's bytes may hold no letter
            lettered[i] = any(map(str.isalpha, column[int(i)].as_py()))
        best = mean.argmax(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, np.minimum(mean.max(axis=1), 1.0), 0.0)


def _pieces(texts: list[str], labels: list[int], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Texts as they are; of a very long one, windows from all over it."""
    own, of = [], []
    for text, label in zip(texts, labels, strict=True):
        n = 1 if len(text) <= LEARNED_CHARS else 10
        size = min(len(text), LEARNED_CHARS) // n
        for at in [0] if n == 1 else rng.integers(0, len(text) - size, n):
            own.append(text[at: at + size])
            of.append(label)
    return own, of


def _chains(first: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word order and bounds of chains spliced from pieces of all texts."""
    cuts = [np.unique(np.r_[np.cumsum(rng.integers(8, 160, (b - a) // 40 + 2)), b - a].clip(max=b - a)) + a for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
    ends = np.concatenate(cuts)
    starts = np.r_[first[0], ends[:-1]]
    mixed = rng.permutation(len(ends))
    sizes = (ends - starts)[mixed]
    bounds = np.r_[0, np.cumsum(sizes)]
    return runs(starts[mixed], sizes), bounds[np.unique(np.r_[np.arange(0, len(bounds), 6), len(bounds) - 1])]


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model of the labels that occur, from texts of one language each."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    own, of = _pieces(texts, [languages.index(x) for x in labels], rng)
    f = features(pa.array(own, pa.string()))
    n_words = len(f.begin)
    weights, transitions = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    if k < 2 or not n_words:
        return Model(languages, weights, transitions)
    gold = np.repeat(np.array(of), np.diff(f.first))
    of_place = np.repeat(np.arange(n_words), np.diff(np.r_[f.begin, len(f.grams[0])]))
    listed = [(g, of_place) for g in f.grams] + [(f.word, np.arange(n_words))]

    def summed(per_word: np.ndarray) -> np.ndarray:
        out = np.stack([sum(np.bincount(b, per_word[w, j], BUCKETS) for b, w in listed) for j in range(k)], axis=1)
        out[0] = 0  # the row of no feature
        return out

    target = np.eye(k)[gold]
    counts = summed(target)
    odds = np.log((counts + 0.5) / (counts.sum(axis=0) + 1))
    weights = (0.1 * (odds - odds.mean(axis=1, keepdims=True)) * (counts.sum(axis=1, keepdims=True) > 0)).astype(np.float32)
    order, bounds = _chains(f.first, rng)
    inner = np.setdiff1d(np.arange(len(order)), bounds)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[order[inner - 1]], gold[order[inner]]), 1)
    squares, squares_t = np.full(weights.shape, 1e-2), np.full((k, k), 1e-2)
    for _ in range(STEPS):
        marginals, expected = forward_backward(emissions(f, weights)[order], bounds, transitions)
        missing = np.empty_like(target)
        missing[order] = target[order] - marginals
        step, step_t = summed(missing), seen - expected
        squares += step**2
        squares_t += step_t**2
        weights += (RATE * step / np.sqrt(squares)).astype(np.float32)
        transitions = transitions + RATE * step_t / np.sqrt(squares_t)
    return Model(languages, weights, transitions)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Trained on about ``per_language`` rows of each language, never more than twice as many in all."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    sample = rows.where((draw < share) & F.col("text").isNotNull()).limit(2 * per_language * len(sizes)).toPandas().sort_values(["doc_id", "text"])
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of weights, whatever the input

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = sent.value.predict(batch.column("text"))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    slimmed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(slimmed, kernel, "doc_id long, lang_pred string, score double", limit=SLICE)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, all columns kept, whose text has letters and one language with at least ``min_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = sent.value.predict(batch.column(place))
        return batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return map_batches(docs, kernel, docs.schema, place, SLICE)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
