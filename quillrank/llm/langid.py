"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public SentencePiece vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are learned by expectation maximisation: forward-backward gives each piece's expected count in each
language. Single characters outside the vocabulary share one unknown piece. The dynamic programme runs in numpy over
all distinct words of a slice at once, one step for each start and length.

Words are lower-cased runs between white space with the vocabulary's word mark in front, of any length: a run of more than
SHORT characters goes through the same recurrence in logarithms, position by position, so all its segmentations are summed
too. The vocabulary's pieces are lower-cased as the words are.

Learning takes a bounded sample: of each language SAMPLE_ROWS rows by hash, up to SAMPLE_BYTES of text (a long text counts
like any other and is never cut). The prediction is the language with the greatest likelihood (ties: the least name); the score
is its share after the likelihoods are tempered by the square root of the number of words, as neighbouring words aren't
independent. The model takes 8 bytes for each piece and language, however many languages there are.

Nulls: a text that is null or has no letter (a character of Unicode's letter categories) is `und` with score 0. Rows with
a null language teach nothing; with nothing learned every text is `und`. Repeated rows teach each and come out repeated;
equal texts have equal predictions. Empty tables give empty results; columns other than the named ones are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import byte_texts, cached_in_worker, keep_rows, map_arrow, mix, slices, within_budget

#: The training sample's bound: rows of each language, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 4 << 20
#: Characters, mark included, of words that are scored many at a time; cells (words x characters) of long ones at a time, and
#: positions.
SHORT, CELLS, STRETCH = 24, 40_000, 4_096
ROUNDS, PRIOR = 3, 0.05
#: Words that a worker keeps with their likelihoods, and the longest that it keeps.
CACHE_ITEMS, CACHE_CHARS = 250_000, 64
MARK, BASE = "▁", 0x100000001B3
_letters = re.compile(r"[^\W\d_]").finditer


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; the pattern alone would also take other numbers."""
    return any(m[0].isalpha() for m in _letters(text))


class Pieces:
    """Lower-cased pieces, numbered from 1 (0 is the unknown piece), in a table keyed by a rolling hash of their code points.
    Pieces whose slot is taken go to a second table."""

    def __init__(self, names: list[str]):
        self.names, self.size, self.longest = names, len(names) + 1, max(map(len, names), default=1)
        self.known = np.array([0] + [self.hash_of(x) for x in names], np.uint64)
        self.shifts = [np.uint64(44), np.uint64(46)]
        self.first, self.second = np.zeros(1 << 20, np.int32), np.zeros(1 << 18, np.int32)
        rest = []
        for k, slot in enumerate(self.slot(self.known, 0).tolist()):
            if k and self.first[slot]:
                rest.append(k)
            elif k:
                self.first[slot] = k
        for k in rest:
            slot = int(self.slot(self.known[k : k + 1], 1)[0])
            if self.second[slot]:
                raise ValueError("two pieces need one slot of the second table")
            self.second[slot] = k

    @staticmethod
    def hash_of(x: str) -> int:
        h = 0
        for c in x:
            h = (h * BASE + ord(c)) % (1 << 64)
        return h

    def slot(self, h: np.ndarray, table: int) -> np.ndarray:
        return mix(h + np.uint64(table)) >> self.shifts[table]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces' numbers, 0 for none."""
        k = self.first[self.slot(h, 0)]
        out = np.where(self.known[k] == h, k, 0)
        miss = np.flatnonzero((out == 0) & (k > 0))
        if len(miss):
            k = self.second[self.slot(h[miss], 1)]
            out[miss] = np.where(self.known[k] == h[miss], k, 0)
        return out


@cached_in_worker
@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = (sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return Pieces(sorted({x.lower() for x in own if x}))


def lattice(names: list[str], pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """names: of up to SHORT characters. For each (start, end): the words that have a piece there and the pieces' numbers; by
    start, then end."""
    n = len(names)
    c = np.zeros((SHORT, n), np.uint64)
    lens = np.array([len(w) for w in names])
    flat = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    at = np.repeat(np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    c[np.arange(len(flat)) - at, np.repeat(np.arange(n), lens)] = flat
    found, h = {}, np.zeros((SHORT, n), np.uint64)
    longest = int(lens.max(initial=0))
    for size in range(1, min(pieces.longest, longest) + 1):
        h = h[: longest - size + 1] * np.uint64(BASE) + c[size - 1 : longest]
        ends = np.arange(size, longest + 1)[:, None] <= lens[None, :]
        start, word = np.nonzero(ends)
        got = pieces.find(h[start, word])
        if size > 1:
            hit = got > 0
            start, word, got = start[hit], word[hit], got[hit]
        edges = np.searchsorted(start, np.arange(longest - size + 2))
        for i in range(longest - size + 1):
            if edges[i] < edges[i + 1]:
                found[i, i + size] = (word[edges[i] : edges[i + 1]], got[edges[i] : edges[i + 1]])
    return [(i, j, *x) for (i, j), x in sorted(found.items())]


def forward(arcs, n_words: int, prob: np.ndarray) -> np.ndarray:
    """prob: pieces x languages. The alphas, (SHORT + 1) x words x languages."""
    alpha = np.zeros((SHORT + 1, n_words, prob.shape[1]))
    alpha[0] = 1
    for i, j, w, p in arcs:  # a word has one arc at most from i to j
        alpha[j, w] += alpha[i, w] * prob[p]
    return alpha


def codes(names: list[str]) -> np.ndarray:
    """Code points, positions x words; 0 after a word's end."""
    c = np.zeros((max(map(len, names)), len(names)), np.uint64)
    for k, w in enumerate(names):
        c[: len(w), k] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    return c


def spans(c: np.ndarray, pieces: Pieces) -> np.ndarray:
    """c: codes(). positions x sizes x words: the piece of each size that ends at a position; pieces.size for none. Single
    characters outside the vocabulary are piece 0."""
    most = min(pieces.longest, len(c))
    out, h = np.full((len(c), most, c.shape[1]), pieces.size, np.int32), np.zeros_like(c)
    for size in range(1, most + 1):
        h = h[: len(c) - size + 1] * np.uint64(BASE) + c[size - 1 :]
        got = pieces.find(h.ravel()).reshape(h.shape)
        out[size - 1 :, size - 1] = got if size == 1 else np.where(got > 0, got, pieces.size)
    return out


def steps(la: np.ndarray, at: np.ndarray, log_prob: np.ndarray, first: int) -> None:
    """The forward recurrence in logarithms: fills la[first:], whose pieces are at, from the rows before."""
    for j in range(first, len(la)):
        m = min(at.shape[1], j)
        la[j] = np.logaddexp.reduce(la[j - m : j][::-1] + log_prob[at[j - first, :m]], axis=0)


def long_scores(names: list[str], pieces: Pieces, log_prob: np.ndarray) -> np.ndarray:
    """Log-probabilities of words of any length: the last alphas are carried from one stretch of STRETCH positions to the
    next, so memory doesn't grow with them."""
    c, lens = codes(names), np.array([len(w) for w in names])
    most = min(pieces.longest, len(c))
    carry = np.full((most, len(names), log_prob.shape[1]), -np.inf)
    carry[-1] = 0
    out = np.empty(carry.shape[1:])
    for a in range(0, len(c), STRETCH):
        low = max(0, a - most + 1)
        part = c[low : a + STRETCH]
        at = spans(part, pieces)[a - low :]
        if at.shape[1] < most:
            at = np.pad(at, ((0, 0), (0, most - at.shape[1]), (0, 0)), constant_values=pieces.size)
        la = np.concatenate((carry, np.full((len(at), *carry.shape[1:]), -np.inf)))
        steps(la, at, log_prob, most)
        done = np.flatnonzero((lens > a) & (lens <= a + len(at)))
        out[done] = la[most + lens[done] - a - 1, done]
        carry = la[-most:]
    return out


def long_expected(names: list[str], weight: np.ndarray, pieces: Pieces, log_prob: np.ndarray, expected: np.ndarray) -> None:
    """Adds the pieces' expected counts in words of any length, weighted by word and language: forward and backward."""
    at, lens, rows = spans(codes(names), pieces), np.array([len(w) for w in names]), np.arange(len(names))
    n = len(at)
    la = np.full((n + 1, len(names), log_prob.shape[1]), -np.inf)
    lb = la.copy()
    la[0], lb[lens, rows] = 0, 0
    steps(la, at, log_prob, 1)
    for i in range(n - 1, -1, -1):
        m = min(at.shape[1], n - i)
        ends = lb[i + 1 : i + 1 + m] + log_prob[at[np.arange(i, i + m), np.arange(m)]]
        lb[i] = np.logaddexp(lb[i], np.logaddexp.reduce(ends, axis=0))
    total, inside = la[lens, rows], np.arange(1, n + 1)[:, None] <= lens
    for s in range(at.shape[1]):  # pieces of s + 1 characters
        p = at[s:, s]
        pos, word = np.nonzero((p < len(expected)) & inside[s:])
        k = p[pos, word]
        got = np.exp(la[pos, word] + log_prob[k] + lb[pos + s + 1, word] - total[word]) * weight[word]
        for lang in range(expected.shape[1]):
            expected[:, lang] += np.bincount(k, got[:, lang], len(expected))


def with_none(prob: np.ndarray) -> np.ndarray:
    """Log-probabilities with a last row for no piece."""
    return np.vstack((np.log(prob), np.full(prob.shape[1], -np.inf)))


def long_batches(names: list[str]):
    """Positions of words by length, so many at a time that words x the longest's characters stay within CELLS."""
    order = sorted(range(len(names)), key=lambda k: len(names[k]))
    batch: list[int] = []
    for k in order:
        if batch and (len(batch) + 1) * len(names[k]) > CELLS:
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def likelihoods(names: list[str], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word (mark included) in each language, all its segmentations summed."""
    lens, out = np.array([len(w) for w in names]), np.empty((len(names), prob.shape[1]))
    short, long = np.flatnonzero(lens <= SHORT), np.flatnonzero(lens > SHORT)
    if len(short):
        alpha = forward(lattice([names[k] for k in short], pieces), len(short), prob)
        out[short] = np.log(alpha[lens[short], np.arange(len(short))] + 1e-300)
    if len(long):
        lp, own = with_none(prob), [names[k] for k in long]
        for b in long_batches(own):
            out[long[b]] = long_scores([own[k] for k in b], pieces, lp)
    return out


def learn(counts: list[Counter], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """counts: words of each language. Piece probabilities, pieces x languages."""
    size, n = pieces.size, len(counts)
    every = sorted(set().union(*counts))
    names, long = [w for w in every if len(w) <= SHORT], [w for w in every if len(w) > SHORT]
    weigh = lambda some: np.array([[c[w] for c in counts] for w in some], np.float64).reshape(len(some), n)
    weight = weigh(names)
    prob = np.full((size, n), 1.0 / size)
    parts = [(names[a : a + 20_000], weight[a : a + 20_000]) for a in range(0, len(names), 20_000)]
    arcs = [lattice(x, pieces) for x, _ in parts]
    for _ in range(rounds):
        expected, lp = np.zeros((size, n)), with_none(prob)
        for b in long_batches(long):
            some = [long[k] for k in b]
            long_expected(some, weigh(some), pieces, lp, expected)
        for (x, wt), own in zip(parts, arcs, strict=True):
            lens, rows = np.array([len(w) for w in x]), np.arange(len(x))
            alpha = forward(own, len(x), prob)
            beta = np.zeros_like(alpha)
            beta[lens, rows] = 1
            for i, j, w, p in reversed(own):
                beta[i, w] += beta[j, w] * prob[p]
            scale = wt / (alpha[lens, rows] + 1e-300)
            for i, j, w, p in own:
                got = alpha[i, w] * prob[p] * beta[j, w] * scale[w]
                for k in range(n):
                    expected[:, k] += np.bincount(p, got[:, k], size)
        prob = (expected + PRIOR) / (expected.sum(0) + PRIOR * size)
    return prob


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray
    model_file: str

    def __post_init__(self):
        self.cache: dict[str, tuple[float, ...]] = {}

    def __reduce__(self):
        return Model, (self.languages, self.prob, self.model_file)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        pieces, n = vocabulary(self.model_file), len(self.languages)
        if not n:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.cache) > CACHE_ITEMS:
            self.cache.clear()
        words = [t.lower().split() if has_letter(t) else [] for t in texts]
        new = list(set().union(*words).difference(self.cache))
        extra: dict[str, bytes] = {}
        for a in range(0, len(new), 8_000):
            part = new[a : a + 8_000]
            for w, x in zip(part, likelihoods([MARK + w for w in part], pieces, self.prob).astype(np.float32), strict=True):
                (self.cache if len(w) <= CACHE_CHARS else extra)[w] = x.tobytes()
        get = self.cache.__getitem__ if not extra else lambda w: extra[w] if len(w) > CACHE_CHARS else self.cache[w]
        langs, scores = [], []
        for x in words:
            if not x:
                langs.append("und")
                scores.append(0.0)
                continue
            total = np.frombuffer(b"".join(map(get, x)), np.float32).reshape(-1, n).sum(0, dtype=np.float64)
            k = int(total.argmax())
            langs.append(self.languages[k])
            scores.append(float(1 / np.exp((total - total[k]) / np.sqrt(len(x))).sum()))
        return langs, scores


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn_from: Column, model_file: str) -> Model:
    """Learns from a bounded sample of the rows that learn_from marks: of each language the SAMPLE_ROWS rows with the
    least hash of their id and text, up to SAMPLE_BYTES of text. The table is read twice, whatever the number of languages: for the
    languages' sizes, and for the rows below each one's cut."""
    rows = docs.filter(learn_from & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), F.col(lang_col).alias("_l"))
    size = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(size)
    counts = {x: Counter() for x in languages}
    if languages:
        # about 1.5 SAMPLE_ROWS rows of each language by hash, then the least hashes of them exactly
        h = F.xxhash64("_id", "_t").bitwiseAND(F.lit((1 << 63) - 1))
        cut = [(x, min((1 << 63) - 1, (1 << 63) * (3 * SAMPLE_ROWS // 2 + 100) // n)) for x, n in size.items()]
        cuts = F.broadcast(rows.sparkSession.createDataFrame(cut, "_l string, _cut long"))  # a row for each language
        near = rows.withColumn("_h", h).join(cuts, "_l").filter("_h <= _cut")
        got = within_budget(near, "_l", [F.col("_h"), F.col("_id"), F.col("_t")], "_t", SAMPLE_ROWS, SAMPLE_BYTES)
        for r in got.select("_l", "_t").toLocalIterator():
            counts[r["_l"]].update(MARK + w for w in r["_t"].lower().split())
    counts = [counts[x] for x in languages]
    return Model(languages, learn(counts, vocabulary(model_file)) if languages else np.zeros((1, 0)), model_file)


def predict(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Per row: id_col, lang_pred, score (0 to 1). The model's size is the vocabulary's times the
    number of languages."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch, 1):
                langs, scores = m.predict([t.decode() for t in byte_texts(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified(df: DataFrame, text_col: str, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of df whose language is found with a score of least or more, all columns as they are."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def keep(texts):
            langs, scores = held.value.predict(texts)
            return [x != "und" and s >= least for x, s in zip(langs, scores, strict=True)]

        return keep

    return keep_rows(df, text_col, make)
