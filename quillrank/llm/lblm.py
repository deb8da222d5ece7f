"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

The model predicts a token from the two before it: the context's vector is c1 * r[w-1] + c2 * r[w-2], a token's score its
product with q[w] plus a bias. Training tells tokens from noise drawn by their counts (noise samples shared by a
mini-batch, so that all is matrix products); every task trains on all its tokens from one start, and the parameters are
averaged, weighted by tokens. Since scores are sums over the two positions, the normaliser of every context is one
entry of one matrix product, so log-probabilities are exactly normalised.

The softmax is factored twice. First by classes: the end of text and the TOP most frequent words (ties: the least word) are
classes of their own, all other words are hashed into classes whose number grows with the vocabulary (class_count()). Then
within a hashed class (Fine): every word with at least least_count() training tokens has a target and a context vector of
its own, and the class's rarer words are one more entry. This second model is log-bilinear too, over the words' own vectors,
trained by noise drawn from the class, and its normaliser is the sum over the class's entries. A rare word's probability is
its entry's times its smoothed share of the class's rare tokens. All words' probabilities, those never seen included, add up
to one. So the parameters grow with the corpus: least_count() follows the square root of the training tokens, hence at most
100 * sqrt(tokens) words have vectors of their own (17 thousand of 0.36 million at sf0.1, 81 thousand of 3.2 million at 0.5 GB).
They go to every worker, 150 bytes each; should they be more than MOST_OWN, the count doubles until they aren't.

Counts cover all training tokens. Words are counted in blocks of texts (one for each shuffle partition, more if one would
exceed BLOCK_BYTES): a block sends each distinct word once and gets back the counts of its own words only, so neither a
task nor the driver ever holds the whole vocabulary. Words with vectors of their own are known by a 64-bit hash; two of them
with one hash count as rare. A worker holds three tables (scores by each context token, normalisers) of (TOP + classes)^2
entries of 4 bytes. Training follows the input's splits: other splits give slightly other parameters.

Nulls: a null text is empty and holds the end of text only. Without training texts every base score is 0. Repeated rows
count and come back repeated; a null id is in fold 0. Empty tables give empty results; only the two named columns are
read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import blocks_of, map_arrow, slices
from quillrank.runtime import materialise

TOP, DIM, BATCH, NOISE, RATE = 1500, 16, 2048, 64, 0.08
END, WORD0 = 0, 1
SLICE, BLOCK_BYTES, STRIPE, MERGE = 2 << 20, 64 << 20, 256, 8
#: Noise words a class and learning rate of the model within classes; words with vectors of their own at most (600 MB).
FINE_NOISE, FINE_RATE, MOST_OWN = 24, 0.15, 4_000_000
HASH_SEED = 42  # of Spark's xxhash64


def class_count(distinct: int) -> int:
    """Classes of the words beyond TOP, by the number of distinct training words: 330 for 353,883, 840 for 3.6 million."""
    return max(1, int(2 * max(1, distinct) ** 0.4))


def least_count(tokens: int) -> int:
    """Training tokens that a word needs for vectors of its own: 17 of 3.2 million, 104 of 108 million tokens."""
    return max(5, int(tokens**0.5 / 100))


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased, split at ASCII white space), each token's number among them, words per text."""
    flat = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lens = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    every = flat.flatten()
    full = pc.not_equal(every, "").to_numpy(zero_copy_only=False)
    if not full.all():
        own = np.repeat(np.arange(len(lens)), lens)[full]
        lens, every = np.bincount(own, minlength=len(lens)), every.filter(pa.array(full))
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lens.astype(np.int64)


def block_counts(docs: DataFrame) -> DataFrame:
    """docs: block, learn, id, text. Per block and distinct word: word, block, n (its training tokens)."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches):
        parts: list[pa.Table] = []
        block = None
        for batch in batches:
            for part in slices(batch, 3, budget=SLICE):
                block = part.column(0)[0].as_py()
                names, codes, lens = tokenised(part.column(3))
                learn = np.repeat(part.column(1).to_numpy(zero_copy_only=False), lens)
                n = np.bincount(codes, learn, len(names)).astype(np.int64)
                parts.append(pa.table({"word": names, "n": n}))
                if len(parts) == MERGE:
                    parts = [merged(parts)]
        if parts:
            for batch in merged(parts).to_batches(max_chunksize=50_000):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), block, np.int32)), batch.column(1)], names=["word", "block", "n"])

    return map_arrow(docs, run, "word string, block int, n bigint")


@dataclass
class Fine:
    """The words within hashed classes. A class's rows are offs[g] (its rare words) and those after it, up to offs[g + 1].
    The last number of a target vector is its bias, where that of a context is one."""

    least: int
    keys: np.ndarray  # sorted hashes of the words with vectors of their own
    row: np.ndarray  # their rows of q; row + shift is their context's of r
    offs: np.ndarray
    shift: int
    r: np.ndarray  # contexts: END, words, classes (rare words) and the start, then one for each row of q
    q: np.ndarray
    rare: np.ndarray  # smoothed tokens of each class's rare words
    c: tuple = (1.0, 0.5)

    def find(self, names: list[bytes], group: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Each word's row, given its class: its own or the class's first (0 for a negative class). Words whose counts are
        known to be too small aren't looked up."""
        out = np.where(group >= 0, self.offs[group], 0)
        ask = np.flatnonzero(group >= 0 if counts is None else (group >= 0) & (counts >= self.least))
        if len(ask) and len(self.keys):
            h = np.fromiter(map(xxhash.xxh64_intdigest, map(names.__getitem__, ask.tolist()), repeat(HASH_SEED)), np.uint64, len(ask))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            out[ask[hit]] = self.row[at[hit]]
        return out

    def hidden(self, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        h, far = self.r.take(f1, 0), self.r.take(f2, 0)
        h *= np.float32(self.c[0])
        far *= np.float32(self.c[1])
        h += far
        h[:, -1] = 1
        return h

    def log_probs(self, row: np.ndarray, group: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the rows within their classes."""
        order = np.argsort(group)
        h, t = self.hidden(f1[order], f2[order]), row[order]
        z = np.empty(len(h), np.float32)
        for g, a, e in groups(group[order]):
            x = h[a:e] @ self.q[self.offs[g] : self.offs[g + 1]].T
            top = x.max(1)
            x -= top[:, None]
            z[a:e] = np.log(np.exp(x, out=x).sum(1)) + top
        out = np.empty(len(h))
        out[order] = np.einsum("ij,ij->i", h, self.q.take(t, 0)) - z
        return out


def groups(own: np.ndarray):
    """(value, start, end) of each run of a sorted array."""
    at = np.flatnonzero(np.diff(own, prepend=-1, append=-1)) if len(own) else np.zeros(1, np.int64)
    return zip(own[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


def fine(keys: np.ndarray, group: np.ndarray, counts: np.ndarray, size: np.ndarray, least: int, start: int, seed: int = 12) -> Fine:
    """keys, group, counts: hash, class and training tokens of the words with vectors of their own. size: smoothed tokens of
    each class; start: the number of the context before a text."""
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    once = first[times == 1]  # in the order of the hashes
    keys, group, counts = keys[once], group[once], counts[once]
    by_class = np.argsort(group, kind="stable")
    many = np.bincount(group, minlength=len(size))
    offs = np.concatenate(([0], np.cumsum(many + 1))).astype(np.int64)
    row = np.empty(len(keys), np.int64)
    row[by_class] = np.arange(len(keys)) + group[by_class] + 1
    rng, rows = np.random.default_rng(seed), int(offs[-1])
    rare = np.maximum(size - np.bincount(group, counts + 0.5, len(size)), 0.5)
    q = rng.normal(0, 0.05, (rows, DIM)).astype(np.float32)
    q[offs[:-1], -1] = np.log(rare / size)
    q[row, -1] = np.log((counts + 0.5) / size[group])
    return Fine(least, keys, row, offs, start + 1, rng.normal(0, 0.05, (start + 1 + rows, DIM)).astype(np.float32), q, rare)


@dataclass
class Model:
    words: list[str]
    counts: np.ndarray  # of END, words and classes, in training
    kinds: np.ndarray  # distinct training words of each class
    r: np.ndarray  # context vectors of END, words, classes and the start
    q: np.ndarray  # target vectors of END, words and classes
    b: np.ndarray
    c: np.ndarray  # 2 x DIM
    total: int = 0  # training tokens
    distinct: int = 0
    fine: Fine | None = field(default=None, repr=False)
    tables: tuple | None = field(default=None, repr=False)

    def __reduce__(self):
        return Model, (self.words, self.counts, self.kinds, self.r, self.q, self.b, self.c, self.total, self.distinct, self.fine)

    @property
    def start(self) -> int:
        return len(self.b)

    def number(self) -> dict[bytes, int]:
        return {w.encode(): i + WORD0 for i, w in enumerate(self.words)}

    def numbers(self, names: list[bytes], number: dict[bytes, int]) -> np.ndarray:
        """Each word's class: its own, or the one that it is hashed into."""
        own = np.fromiter(map(number.get, names, repeat(-1)), np.int64, len(names))
        hashed = np.fromiter(map(crc32, names), np.int64, len(names)) % len(self.kinds)
        return np.where(own >= 0, own, hashed + WORD0 + len(self.words))

    def lookup(self):
        """Scores by the last and the last but one token, the bias, every context's log-normaliser, and the words' numbers.
        The normalisers are made for STRIPE contexts at a time."""
        if self.tables is None:
            near, far = (np.clip((self.r * c) @ self.q.T, -25, 25).astype(np.float32) for c in self.c)
            right, scale = np.exp(far).T, np.exp(self.b).astype(np.float32)
            z = np.empty((len(near), len(far)), np.float32)
            for a in range(0, len(near), STRIPE):
                np.log((np.exp(near[a : a + STRIPE]) * scale) @ right, out=z[a : a + STRIPE])
            self.tables = near, far, self.b, z, self.number()
        return self.tables

    def log_probs(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the tokens after the contexts."""
        near, far, b, z, _ = self.lookup()
        return near[w1, w].astype(np.float64) + far[w2, w] + b[w] - z[w1, w2]

    def finer(self, names: list[bytes], ids: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each word's row within its class, and its number as a context."""
        first, f = WORD0 + len(self.words), self.fine
        row = f.find(names, np.where(ids >= first, ids - first, -1), counts)
        own = (ids >= first) & (row > f.offs[np.maximum(ids - first, 0)])
        return row, np.where(own, row + f.shift, ids)


def contexts(ids: np.ndarray, lens: np.ndarray, start: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, their two predecessors (start before a text), and where each text ends."""
    ends = np.cumsum(lens + 1) - 1
    w = np.empty(len(ids) + len(lens), np.int64)
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside], w[ends] = ids, end
    first = ends - lens
    w1, w2 = np.empty_like(w), np.empty_like(w)
    w1[1:], w2[2:] = w[:-1], w[:-2]
    w1[first] = start
    w2[first] = start
    second = (first + 1)[lens > 0]
    w2[second] = start
    return w, w1, w2, ends


def initial(words: list[str], counts: np.ndarray, kinds: np.ndarray, total: int, distinct: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    n = len(counts)
    p = (counts + 0.5) / (counts + 0.5).sum()
    return Model(words, counts, kinds, rng.normal(0, 0.1, (n + 1, DIM)), rng.normal(0, 0.1, (n, DIM)), np.log(p), np.array([np.ones(DIM), np.full(DIM, 0.5)]), total, distinct)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Trainer:
    """Adagrad on the noise-contrastive objective."""

    def __init__(self, m: Model, seed: int):
        self.m = Model(m.words, m.counts, m.kinds, *(x.astype(np.float32) for x in (m.r, m.q, m.b, m.c)))
        self.rng, self.seen = np.random.default_rng(seed), 0
        self.noise = np.exp(m.b - np.logaddexp.reduce(m.b))
        self.cum = np.cumsum(self.noise)
        self.shift = np.log(NOISE * self.noise).astype(np.float32)
        self.acc = [np.full_like(x, 0.05, np.float32) for x in (m.r, m.q, m.b, m.c)]
        if m.fine is not None:
            f = m.fine
            self.fine = Fine(f.least, f.keys, f.row, f.offs, f.shift, f.r.copy(), f.q.copy(), f.rare, f.c)
            self.fine_shift = f.q[:, -1] + np.float32(np.log(FINE_NOISE))
            share = np.exp(f.q[:, -1].astype(np.float64))
            self.fine_cum = np.cumsum(share)
            self.fine_acc = [np.full(len(x), 0.05, np.float32) for x in (f.r, f.q)]
            self.touched = [np.zeros(len(x), np.float32) for x in (f.r, f.q)]

    def learn_fine(self, row: np.ndarray, group: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> None:
        """One step on the rows within their classes; a class's tokens share its noise."""
        f = self.fine
        order = np.argsort(group)
        row, group, f1, f2 = row[order], group[order], f1[order], f2[order]
        h = f.hidden(f1, f2)
        qt = f.q.take(row, 0)
        up = sigmoid(self.fine_shift[row] - np.einsum("ij,ij->i", h, qt))
        gh, gq = up[:, None] * qt, up[:, None] * h
        runs = list(groups(group))
        low, high = (f.offs[np.fromiter((g + k for g, _, _ in runs), np.int64, len(runs))] for k in (0, 1))
        under = np.where(low > 0, self.fine_cum[low - 1], 0.0)
        drawn = under[:, None] + self.rng.random((len(runs), FINE_NOISE)) * (self.fine_cum[high - 1] - under)[:, None]
        k = np.clip(np.searchsorted(self.fine_cum, drawn.ravel()).reshape(drawn.shape), low[:, None], high[:, None] - 1)
        qk, sk, gk = f.q[k], self.fine_shift[k], np.empty((*k.shape, DIM), np.float32)
        for i, (_, a, e) in enumerate(runs):
            down = sigmoid(h[a:e] @ qk[i].T - sk[i])
            gh[a:e] -= down @ qk[i]
            gk[i] = -(down.T @ h[a:e])
        gh[:, -1], gq[:, -1], gk[..., -1] = 0, 0, 0  # biases stay logarithms of frequencies
        self.descend(1, f.q, np.concatenate((row, k.ravel())), np.concatenate((gq, gk.reshape(-1, DIM))))
        self.descend(0, f.r, np.concatenate((f1, f2)), np.concatenate((np.float32(f.c[0]) * gh, np.float32(f.c[1]) * gh)))

    def descend(self, which: int, x: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad on the rows that have gradients, with one rate a row."""
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        rows, n = at[first], np.diff(first, append=len(at)).astype(np.float32)
        g = np.add.reduceat(grad.take(order, 0), first, axis=0) / np.sqrt(n)[:, None]
        self.fine_acc[which][rows] += np.einsum("ij,ij->i", g, g) / DIM
        x[rows] += np.float32(FINE_RATE) * g / np.sqrt(self.fine_acc[which][rows])[:, None]
        self.touched[which][rows] += n

    def add(self, x: np.ndarray, which: int, grad: np.ndarray) -> None:
        grad = grad.astype(np.float32)
        self.acc[which] += grad**2
        x += np.float32(RATE) * grad / np.sqrt(self.acc[which])

    def step(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        m, n = self.m, len(self.m.b)
        r1, r2, qw = m.r.take(w1, 0), m.r.take(w2, 0), m.q.take(w, 0)
        h = r1 * m.c[0] + r2 * m.c[1]
        own = np.einsum("ij,ij->i", h, qw) + m.b[w] - self.shift[w]
        up = sigmoid(-own)
        k = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), n - 1)
        down = h @ m.q[k].T
        down += m.b[k] - self.shift[k]
        down = -sigmoid(down)
        gh = up[:, None] * qw + down @ m.q[k]
        cols = np.arange(DIM)
        scatter = lambda at, g, size: np.bincount((at[:, None] * DIM + cols).ravel(), g.ravel(), size * DIM).reshape(size, DIM)
        gq = scatter(np.concatenate((w, k)), np.concatenate((up[:, None] * h, down.T @ h)), n)
        gr = scatter(np.concatenate((w1, w2)), np.concatenate((gh * m.c[0], gh * m.c[1])), n + 1)
        gb = np.bincount(w, up, n) + np.bincount(k, down.sum(0), n)
        gc = np.stack([(gh * r1).sum(0), (gh * r2).sum(0)])
        scale = 1 / np.sqrt(len(w))
        self.add(m.r, 0, gr * scale)
        self.add(m.q, 1, gq * scale)
        self.add(m.b, 2, gb * scale)
        self.add(m.c, 3, gc * scale / 10)
        self.seen += len(w)

    def learn(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> None:
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            pick = order[at : at + BATCH]
            self.step(w[pick], w1[pick], w2[pick])


def trained(docs: DataFrame, start: Model) -> Model:
    """docs: id and text of the training texts. Every task trains on all its tokens; the parameters' weighted means."""
    held = docs.sparkSession.sparkContext.broadcast(start)

    def run(batches):
        m = held.value
        t, number = Trainer(m, 5), m.number()
        for batch in batches:
            for part in slices(batch, 0, budget=SLICE):
                names, codes, lens = tokenised(part.column(0))
                every = names.cast(pa.binary()).to_pylist()
                ids = m.numbers(every, number)
                row, as_context = m.finer(every, ids)
                ids, as_context = np.append(ids, (END, m.start)), np.append(as_context, (END, m.start))
                w, w1, w2, _ = contexts(codes, lens, len(every) + 1, len(every))
                of = ids[w]
                t.learn(of, ids[w1], ids[w2])
                hashed = np.flatnonzero(of >= first)
                if len(hashed):
                    t.learn_fine(row[w[hashed]], of[hashed] - first, as_context[w1[hashed]], as_context[w2[hashed]])
        if t.seen:
            x = t.m
            rows = np.concatenate((x.r, x.q, np.pad(x.b[:, None], ((0, 0), (0, DIM - 1))), x.c))
            yield from parts(0, np.arange(len(rows)), np.full(len(rows), t.seen), rows)
            for which, y in ((1, t.fine.r), (2, t.fine.q)):
                at = np.flatnonzero(t.touched[which - 1])
                yield from parts(which, at, t.touched[which - 1][at], y[at])

    def parts(which, at, weight, rows):
        for a in range(0, len(at), 20_000):
            cut = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[cut]), which, np.int32)), pa.array(at[cut].astype(np.int32)), pa.array(weight[cut].astype(np.float64))] + [pa.array(rows[cut, k].astype(np.float32)) for k in range(DIM)], names=["which", "row", "weight", *(f"v{k}" for k in range(DIM))])

    first = WORD0 + len(start.words)
    schema = "which int, row int, weight double, " + ", ".join(f"v{k} float" for k in range(DIM))
    means = [(F.sum(F.col(f"v{k}") * F.col("weight")) / F.sum("weight")).cast("float").alias(f"v{k}") for k in range(DIM)]
    got = map_arrow(docs.select("text"), run, schema).groupBy("which", "row").agg(*means).toArrow()
    held.unpersist()
    if not got.num_rows:
        return start
    which, row = (got[k].to_numpy() for k in ("which", "row"))
    every = np.stack([got[f"v{k}"].to_numpy() for k in range(DIM)], 1)
    v, n, f = np.empty((3 * len(start.b) + 3, DIM)), len(start.b), start.fine
    v[row[which == 0]] = every[which == 0]
    r, q = f.r.copy(), f.q.copy()  # rows that no task has met stay as they were
    r[row[which == 1]], q[row[which == 2]] = every[which == 1], every[which == 2]
    return Model(start.words, start.counts, start.kinds, v[: n + 1], v[n + 1 : 2 * n + 1], v[2 * n + 1 : 3 * n + 1, 0], v[3 * n + 1 :], start.total, start.distinct, Fine(f.least, f.keys, f.row, f.offs, f.shift, r, q, f.rare, f.c))


def score(df: DataFrame, id_col: str, text_col: str, learn_from: Column, top: int = TOP) -> DataFrame:
    """Per row: id_col, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (the model's), both
    log10 probabilities of the whole text. learn_from marks the training rows."""
    spark = df.sparkSession
    blocks = blocks_of(df, text_col, BLOCK_BYTES)
    block = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(F.col(text_col))), F.lit(blocks)).cast("int")
    own = df.select(block.alias("block"), learn_from.alias("learn"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = block_counts(own.repartitionById(blocks, F.col("block")))
    words = materialise(counted.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("block").alias("blocks")), "words")
    totals = words.agg(F.sum("c").alias("tokens"), F.sum((F.col("c") > 0).cast("long")).alias("known")).first()
    ends = own.filter("learn").count()
    total, distinct = (totals["tokens"] or 0) + ends, (totals["known"] or 0) + (ends > 0)
    best = words.filter("c > 0").orderBy(F.desc("c"), "word").limit(top).select("word", "c").collect()
    classes = class_count(distinct)
    own_class = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(classes)).cast("int")
    rest, kinds = np.zeros(classes), np.zeros(classes)
    for r in words.filter("c > 0").groupBy(own_class.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for each class
        rest[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    for r in best:  # words with a class of their own
        k = crc32(r["word"].encode()) % classes
        rest[k], kinds[k] = rest[k] - r["c"], kinds[k] - 1
    start = initial([r["word"] for r in best], np.array([ends, *(r["c"] for r in best), *rest], np.float64), kinds, total, distinct)
    least = least_count(total)
    named = words.filter(~F.col("word").isin([r["word"] for r in best])) if best else words
    while named.filter(F.col("c") >= least).count() > MOST_OWN:
        least *= 2
    got = named.filter(F.col("c") >= least).select(F.xxhash64("word").alias("h"), own_class.alias("k"), "c").toArrow()  # MOST_OWN rows at most
    smoothed = start.counts[WORD0 + len(best) :] + 0.5 * (kinds + 1)  # half a count for each word and for those never seen
    start.fine = fine(got["h"].to_numpy().view(np.uint64), got["k"].to_numpy().astype(np.int64), got["c"].to_numpy().astype(np.float64), smoothed, least, start.start)
    held = spark.sparkContext.broadcast(trained(own.filter("learn").select("text"), start))
    kind = dict(own.dtypes)["id"]
    none = lambda t: F.lit(None).cast(t)
    back = words.filter("c > 0").select(F.explode("blocks").alias("block"), F.lit(0).alias("kind"), F.col("word").alias("text"), "c", none(kind).alias("id"))
    texts = own.select("block", F.lit(1).alias("kind"), "text", none("bigint").alias("c"), "id")
    dealt = back.union(texts).repartitionById(blocks, F.col("block")).sortWithinPartitions("kind")

    def run(batches):
        m = held.value
        first = WORD0 + len(m.words)
        base_of = lambda c: np.log10((c + 0.5) / (m.total + 0.5 * (m.distinct + 1)))
        fine_of = m.fine
        count: dict[bytes, int] = {}
        for batch in batches:
            for part in slices(batch, 2, budget=SLICE):
                kinds = part.column(1).to_numpy(zero_copy_only=False)
                split = int(np.searchsorted(kinds, 1))
                if split:
                    count.update(zip(part.column(2)[:split].cast(pa.binary()).to_pylist(), part.column(3)[:split].to_pylist(), strict=True))
                part = part.slice(split)
                if not part.num_rows:
                    continue
                names, codes, lens = tokenised(part.column(2))
                every = names.cast(pa.binary()).to_pylist()
                c_of = np.fromiter(map(count.get, every, repeat(0)), np.float64, len(every))
                id_of = m.numbers(every, m.lookup()[4])
                row, as_context = m.finer(every, id_of, c_of)
                share, rare = np.zeros(len(every) + 1), np.flatnonzero((id_of >= first) & (as_context == id_of))
                share[rare] = np.log10((c_of[rare] + 0.5) / fine_of.rare[id_of[rare] - first])
                c_of, ids, as_context = np.append(c_of, m.counts[END]), np.append(id_of, (END, m.start)), np.append(as_context, (END, m.start))
                t, t1, t2, _ = contexts(codes, lens, len(every) + 1, len(every))
                w, w1, w2, extra = ids[t], ids[t1], ids[t2], share[t]
                at = np.flatnonzero(w >= first)
                extra[at] += fine_of.log_probs(row[t[at]], w[at] - first, as_context[t1[at]], as_context[t2[at]]) / np.log(10)
                of = np.repeat(np.arange(len(lens)), lens + 1)
                summed = lambda x: np.bincount(of, x, len(lens))
                yield pa.RecordBatch.from_arrays([part.column(4), pa.array(lens + 1), pa.array(summed((c_of > 0)[t]).astype(np.int64)), pa.array(np.full(len(lens), m.total, np.int64)), pa.array(summed(base_of(c_of)[t])), pa.array(summed(m.log_probs(w, w1, w2) / np.log(10) + extra))], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = map_arrow(dealt, run, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
