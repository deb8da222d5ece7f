"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams; a window of WIDTH words is the mean of its words;
a softmax over two classes scores it. A text's score is that of its highest window, so that a few words count as much
in a long text as in a short one; training picks each text's highest window anew in each pass (and random ones), with
the classes weighted evenly. Words are also trained in altered spellings, so misspellings share n-grams with them.

Since the softmax is linear in the mean, a word's share of the class difference is one number: scoring looks words up
and takes sliding sums. Training uses a bounded sample of labelled rows: of each label SAMPLE_ROWS ids by hash, and of
their rows the first in the same order up to SAMPLE_ROWS and SAMPLE_BYTES of text (a long text counts like any other).
Every text is scored whole, a run of more than LONGEST characters in overlapping parts as its words.

Nulls: a null text is empty; an empty text scores as the training texts' share of positives would have it (a neutral
low score). Rows with a null label or id teach nothing; an id with both labels teaches both. Without any positive or
negative example all scores are 0. Ties and repeated rows: equal texts have equal scores, repeated rows come out
repeated; rows that share a labelled id all teach, within the bounds. Empty tables give empty results; columns other than
the named ones are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import byte_texts, keep_rows, map_arrow, mix, slices, within_budget

#: The training sample's bound: rows of each label, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 12 << 20
BUCKETS, DIM, WIDTH, PASSES = 1 << 15, 12, 5, 14
NGRAMS = (3, 4, 5)
CACHE_ITEMS = 150_000
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_find = re.compile(r"[^\W_]+(?:[@$!'*]+[^\W_]+)*").findall
_runs = re.compile(r"(.)\1{2,}").sub
#: Characters of a word at most; a longer run is scored in parts of PART characters, one every STEP. The base of the
#: rolling hash.
LONGEST, PART, STEP, P = 80, 20, 10, np.uint64(0x100000001B3)


def tokens(text: str) -> list[str]:
    """Words of a text in lower case; signs inside a word stay, those around it go. A longer run than LONGEST gives its
    overlapping parts as words."""
    found = _find(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [x for w in found for x in (parts(w) if len(w) > LONGEST else (w,))]


def parts(word: str) -> list[str]:
    """The word as spelt for its n-grams, whole or in parts that hold each of its characters; every n-gram, and every
    stretch of PART - STEP characters, is in one part."""
    word = spelt(word)
    return [word] if len(word) <= LONGEST else [word[i : i + PART] for i in range(0, len(word) - PART + STEP, STEP)]


def normal(word: str) -> str:
    """A word that isn't all letters: lookalikes become letters if it has any letter, other signs go."""
    if any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKES)
    return "".join(c for c in word if c.isalnum())


def spelt(word: str) -> str:
    """The characters that a word's n-grams come from: runs of a character count as two at most."""
    return _runs(r"\1\1", word if word.isalpha() else normal(word))


def gram_ids(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each <word> and of the word itself, and the word's number for each; grouped by word."""
    text = "><".join(map(spelt, names))
    c = np.frombuffer(f"<{text}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(c == ord("<"))
    word = np.cumsum(c == ord("<")) - 1
    with np.errstate(over="ignore"):
        place = np.arange(len(c)) - starts[word]
        power = np.cumprod(np.full(place.max() + 1, P, np.uint64))
        ids = [np.add.reduceat(c * power[place], starts)]
        of = [np.arange(len(starts))]
        for n in NGRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * P + c[k : len(c) - n + 1 + k]
            inside = word[: len(h)] == word[n - 1 :]
            ids.append(h[inside])
            of.append(word[: len(h)][inside])
        got, of = (mix(np.concatenate(ids)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return got[order], of[order]


@dataclass
class Model:
    embeddings: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    scale: float = 1.0  # with offset: from the class difference to the score's logit
    offset: float = 0.0

    def __post_init__(self):
        self.gain = (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)
        self.shift = float(self.bias[1] - self.bias[0])
        self.cache: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.embeddings, self.weights, self.bias, self.scale, self.offset)

    def learn(self, names: list[str]) -> None:
        """Puts the words' shares of the class difference into the cache."""
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            ids, of = gram_ids(part)
            n = np.bincount(of, minlength=len(part))
            self.cache.update(zip(part, (np.bincount(of, self.gain[ids], len(part)) / n).tolist(), strict=True))

    def differences(self, texts: list[str]) -> np.ndarray:
        """Class 1 against class 0 for each whole text."""
        if len(self.cache) > CACHE_ITEMS:
            self.cache.clear()
        split = [tokens(t) for t in texts]
        self.learn(list(set().union(*split).difference(self.cache)))
        get = self.cache.__getitem__
        return np.array([highest(np.fromiter(map(get, x), np.float64, len(x)))[1] if x else 0.0 for x in split]) + self.shift

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.differences(texts) + self.offset, -30, 30)))


def highest(gains: np.ndarray) -> tuple[int, float]:
    """The start and mean of the window with the highest mean."""
    if len(gains) <= WIDTH:
        return 0, gains.mean()
    c = np.concatenate(([0.0], np.cumsum(gains)))
    m = (c[WIDTH:] - c[:-WIDTH]) / WIDTH
    return int(m.argmax()), float(m.max())


def altered(word: str, rng: np.random.Generator) -> str:
    """The word with one character dropped, doubled, swapped or replaced."""
    if len(word) < 4:
        return word
    k, i = rng.integers(4), int(rng.integers(1, len(word) - 1))
    if k == 0:
        return word[:i] + word[i + 1 :]
    if k == 1:
        return word[:i] + word[i] + word[i:]
    if k == 2:
        return word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]
    return word[:i] + "abcdefghijklmnopqrstuvwxyz*"[rng.integers(27)] + word[i + 1 :]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Embeddings and softmax, jointly, by Adagrad over mini-batches of windows."""
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    b = np.zeros(2, np.float32)
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros_like(emb), np.zeros_like(w), b, 0.0, -30.0)
    vocab: dict[str, int] = {}
    names: list[str] = []
    grams: list[np.ndarray] = []

    def number(word: str) -> int:
        if (i := vocab.get(word)) is None:
            i = vocab[word] = len(names)
            names.append(word)
            grams.append(gram_ids([word])[0])
        return i

    docs = [np.fromiter(map(number, tokens(t)), np.int64) for t in texts]
    base = len(names)
    use = [i for i, d in enumerate(docs) if len(d)]
    acc_e, acc_w = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32)
    balance = np.array([0.5 / max(1e-9, (y[use] == k).mean()) for k in (0, 1)], np.float32)
    rate = 0.25
    for step in range(PASSES):
        lens = np.array([len(g) for g in grams[:base]])
        gain = np.add.reduceat((emb @ (w[:, 1] - w[:, 0]))[np.concatenate(grams[:base])], np.concatenate(([0], np.cumsum(lens)[:-1]))) / lens
        windows: list[tuple[np.ndarray, int]] = []
        for i in use:
            d = docs[i]
            picks = [highest(gain[d])[0]] if step else []
            picks += rng.integers(0, max(1, len(d) - WIDTH + 1), (6 if step < 2 else 1) if y[i] == 0 or step < 2 else 0).tolist()
            for p in picks:
                x = d[p : p + WIDTH]
                windows.append((x, int(y[i])))
                if step and y[i] and p == picks[0]:
                    best = int(gain[x].argmax())
                    z = x.copy()
                    z[best] = number(altered(names[x[best]], rng))
                    windows.append((z, 1))
        rng.shuffle(windows)
        for at in range(0, len(windows), 256):
            part = windows[at : at + 256]
            ids = [grams[j] for x, _ in part for j in x]
            n_gram = np.array([len(g) for g in ids])
            n_word = np.array([len(x) for x, _ in part])
            owner = np.repeat(np.arange(len(part)), n_word)
            flat, share = np.concatenate(ids), np.repeat(1.0 / (n_gram * n_word[owner]), n_gram).astype(np.float32)
            of = np.repeat(owner, n_gram)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
            h = np.add.reduceat(emb[flat] * share[:, None], starts, axis=0)
            z = h @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            t = np.array([lab for _, lab in part])
            p[np.arange(len(t)), t] -= 1
            p *= balance[t][:, None]
            gw, gh = h.T @ p / len(t) + 1e-5 * w, p @ w.T / len(t)
            acc_w += gw**2
            w -= rate * gw / np.sqrt(acc_w)
            b -= 0.1 * p.mean(0)
            order = np.argsort(flat, kind="stable")
            rows, first = np.unique(flat[order], return_index=True)
            ge = np.add.reduceat((gh[of] * share[:, None])[order], first, axis=0)
            acc_e[rows] += (ge**2).mean(1)
            emb[rows] -= (rate * ge / np.sqrt(acc_e[rows])[:, None]).astype(np.float32)
    return Model(emb, w, b)


def calibrated(texts: list[str], labels: list[int]) -> Model:
    """Trains on four fifths, then fits a logistic scale and offset to the rest, positives weighing twice."""
    last = np.arange(len(texts)) % 5 == 4
    model = train([t for t, x in zip(texts, last, strict=True) if not x], [y for y, x in zip(labels, last, strict=True) if not x])
    y = np.asarray(labels)[last]
    if not len(y) or y.min() == y.max():
        return model
    d = model.differences([t for t, x in zip(texts, last, strict=True) if x])
    mid, wide = d.mean(), d.std() + 1e-9
    x = np.column_stack([(d - mid) / wide, np.ones(len(d))])
    a, c = np.zeros(2), 1.0 + y
    for _ in range(50):  # Newton's steps with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a += np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (c * (y - p)) - 0.05 * a)
    model.scale, model.offset = float(max(a[0], 1e-3) / wide), float(a[1] - max(a[0], 1e-3) * mid / wide)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """Trains on a bounded sample: of each label the SAMPLE_ROWS ids with the least hash, and of their rows SAMPLE_ROWS and
    SAMPLE_BYTES of text at most."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    marked = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null").distinct()
    order = [F.xxhash64("_id"), F.col("_id")]
    picks = [marked.filter(F.col("_y") == k).orderBy(*order).limit(SAMPLE_ROWS) for k in (0, 1)]
    found = rows.join(F.broadcast(picks[0].union(picks[1])), "_id")  # 2 * SAMPLE_ROWS ids at most
    first = [found.filter(F.col("_y") == k).orderBy(*order, "_t").limit(SAMPLE_ROWS) for k in (0, 1)]
    kept = within_budget(first[0].union(first[1]), "_y", [*order, F.col("_t")], "_t", SAMPLE_ROWS, SAMPLE_BYTES)
    got = kept.select("_id", "_t", "_y").toPandas().sort_values(["_id", "_t", "_y"], kind="stable")
    return calibrated(got["_t"].tolist(), got["_y"].tolist())


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """Per row: id_col and score, 0 to 1. The model has a fixed size and goes to the executors with the task."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.scores([t.decode() for t in byte_texts(part.column(1))]), pa.float64())], names=["id", "score"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """The rows of df that score below 0.5, all columns as they are."""
    held = df.sparkSession.sparkContext.broadcast(model)
    return keep_rows(df, text_col, lambda: lambda texts: held.value.scores(texts) < 0.5)
