"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. On each level runs of one symbol become one element; deterministic coin tossing gives
each element a small label from the lowest bit in which its name and its left neighbour's differ, repeated on the labels
until they are below eight; an element starts a phrase where its label is a local maximum. A phrase's name is a hash of
its elements' names, and names are the symbols of the next level. Where a phrase starts depends on a few neighbours
only, so equal substrings get equal phrases in their interior, at whatever offset they stand.

The fingerprint is the text's root name and a bottom-k sketch of its phrase names of LEVELS; equal texts have equal
fingerprints. Likeness estimates the share of phrases that two texts have in common.

Nulls: a null text is empty. Two empty texts are alike (1), an empty and another are not (0). Rows with equal ids are
ordered by their texts; null ids come last. Ids are whole numbers; others raise an error. Repeated rows come out
repeated, texts of any length are parsed whole, and of equal phrases' names the sketch keeps one. Empty tables give empty
results; only the two named columns are read, whatever the others' names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import GOLD, blocks_of, byte_texts, map_arrow, mix, slices

#: Levels whose phrases are sketched (a phrase of level k has about 3.3^k characters), and names that a sketch holds.
LEVELS, SKETCH = (2, 3), 64
#: Bytes of text of a block of neighbouring ids.
BLOCK_BYTES = 64 << 20
CHUNK_CHARS = 1 << 19
_one = np.uint64(1)
_debruijn = np.uint64(0x03F79D71B4CB0A89)
_lowest = np.zeros(64, np.uint8)
_lowest[((_one << np.arange(64, dtype=np.uint64)) * _debruijn) >> np.uint64(58)] = np.arange(64)
_lowest8 = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_char_names = mix(np.arange(1 << 16, dtype=np.uint64) + GOLD)


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing: a label below 8 for each name. first: positions that have no left neighbour."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    x = names ^ left
    k = _lowest[((x & (~x + _one)) * _debruijn) >> np.uint64(58)]
    lab = ((k << 1) | ((names >> k.astype(np.uint64)) & _one).astype(np.uint8)).astype(np.uint8)
    for _ in range(2):
        near = np.empty_like(lab)
        near[1:] = lab[:-1]
        near[first] = ~lab[first]
        k = _lowest8[lab ^ near]
        lab = (k << 1) | ((lab >> k) & 1)
    return lab


def phrases(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of parsing: the phrases' names and their documents. doc: the documents' numbers, ascending."""
    change = np.empty(len(names), bool)
    change[0] = True
    change[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    if len(at) < len(names):
        run = np.diff(at, append=len(names)).astype(np.uint64)
        names, doc = names[at], doc[at]
        long = run > 1
        names[long] = mix(names[long] + run[long] * GOLD)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    lab = labels(names, first)
    start = np.zeros(len(names), bool)
    start[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] >= lab[2:])
    start[first[1:] - 1] = False  # a document's last element starts no phrase
    start[first] = True
    at = np.flatnonzero(start)
    place = (np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))).astype(np.uint64)
    return mix(np.add.reduceat(mix(names + place * GOLD), at)), doc[at]


def char_names(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _char_names[c] if not len(c) or c.max() < 1 << 16 else mix(c.astype(np.uint64) + GOLD)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text, 16 hex digits of the root and 8 for each name of the sketch."""
    out, start = [], 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        out += _fingerprints(texts[start:stop])
        start = stop
    return out


def _fingerprints(texts: list[str]) -> list[str]:
    n = len(texts)
    lens = np.array([len(t) for t in texts])
    doc = np.repeat(np.arange(n), lens)
    root = mix(lens.astype(np.uint64))
    if not len(doc):
        return [f"{r:016x}" for r in root.tolist()]
    names, level, kept, of = char_names("".join(texts)), 0, [], []
    while len(names):
        names, doc = phrases(names, doc)
        level += 1
        if level in LEVELS:
            kept.append(mix(names ^ np.uint64(level)) >> np.uint64(32))
            of.append(doc)
        if level >= max(LEVELS):  # a text that is one phrase has its root
            alone = np.bincount(doc, minlength=n)[doc] == 1
            root[doc[alone]] = mix(root[doc[alone]] + names[alone])
            names, doc = names[~alone], doc[~alone]
    names, of = np.concatenate(kept), np.concatenate(of)
    both = np.unique((of.astype(np.uint64) << np.uint64(32)) | names)
    of, names = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
    edges = np.searchsorted(of, np.arange(n + 1)).tolist()
    hexed = names.astype(">u4").tobytes().hex()
    return [f"{r:016x}{hexed[8 * a : 8 * min(b, a + SKETCH)]}" for r, a, b in zip(root.tolist(), edges, edges[1:], strict=False)]


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: the share of common phrases among the SKETCH least of both texts together; 1 if equal."""
    if a == b:
        return 1.0
    x, y = {a[i : i + 8] for i in range(16, len(a), 8)}, {b[i : i + 8] for i in range(16, len(b), 8)}
    least = sorted(x | y)[:SKETCH]
    return sum(p in x and p in y for p in least) / len(least) if x and y else 0.0


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in blocks of neighbouring ids for a pass in descending order: id, text, block, tail. A block's tail rows are
    copies of the next block's first rows (of the first block's, after the last). Ids are read once to cut the blocks
    at existing ids, one for each shuffle partition, more if one would exceed BLOCK_BYTES; each text is shuffled once.
    Ids are whole numbers."""
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = blocks_of(own, "text", BLOCK_BYTES)
    shares = F.array(*[F.lit((k + 1) / parts) for k in range(parts)])
    cuts = own.agg(F.percentile_approx("id", shares, 20 * parts).alias("q"), F.max("id").alias("m")).first()
    tops = sorted({*(cuts["q"] or ()), cuts["m"]} - {None}, reverse=True)  # the first id of each block
    last = max(0, len(tops) - 1)
    down = -np.array(tops, np.int64)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            value = np.asarray(ids.fill_null(0)).astype(np.int64)
            block = np.searchsorted(down, -value, "right") - 1
            block = np.where(known, block, last).clip(0)
            yield batch.append_column("block", pa.array(block, pa.int32())).append_column("tail", pa.array(np.zeros(len(block), bool)))
            if len(tops):
                copy = np.flatnonzero(known & np.isin(value, np.array(tops, np.int64)))
                if len(copy):
                    to = np.where(block[copy] > 0, block[copy] - 1, last)
                    yield batch.take(pa.array(copy)).append_column("block", pa.array(to, pa.int32())).append_column("tail", pa.array(np.ones(len(copy), bool)))

    kind = dict(own.dtypes)["id"]
    dealt = map_arrow(own, run, f"id {kind}, text string, block int, tail boolean").repartitionById(max(1, len(tops)), F.col("block"))
    return dealt.sortWithinPartitions("block", "tail", F.desc_nulls_last("id"), F.coalesce("text", F.lit("")))


def edit_comparison(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last third (rounded down) replaced by as many characters of the next document, by descending id."""

    def compare(ids: pa.Array, texts: list[str], after: list[str]):
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, after, strict=True)]
        prints, others = fingerprints(texts), fingerprints(edited)
        nexts = prints[1:] + fingerprints(after[-1:])
        return pa.RecordBatch.from_pydict({
            "id": ids, "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": prints, "edited_fingerprint": others, "near_edited": pa.array(map(likeness, prints, others), pa.float64()), "near_next": pa.array(map(likeness, prints, nexts), pa.float64()),
        })

    def run(batches):
        block, waits, ended, first = None, [], False, ""  # the block's last row so far; whether its successor was met
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts, at, tail = part.column(0), [t.decode() for t in byte_texts(part.column(1))], part.column(2).to_pylist(), part.column(3).to_pylist()
                rows = list(zip(ids, texts, at, tail, strict=True))
                start = 0
                while start < len(rows):
                    if rows[start][2] != block:
                        block, waits, ended, first = rows[start][2], [], False, rows[start][1]
                    stop = start
                    while stop < len(rows) and rows[stop][2] == block and not rows[stop][3]:
                        stop += 1
                    body = waits + [(i, t) for i, t, _, _ in rows[start:stop]]
                    if stop < len(rows) and rows[stop][2] == block:  # the first tail row follows the last one
                        if body and not ended:
                            yield compare(pa.array([i.as_py() for i, _ in body], ids.type), [t for _, t in body], [t for _, t in body[1:]] + [rows[stop][1]])
                        waits, ended = [], True
                        while stop < len(rows) and rows[stop][2] == block and rows[stop][3]:
                            stop += 1
                    else:
                        if len(body) > 1:
                            yield compare(pa.array([i.as_py() for i, _ in body[:-1]], ids.type), [t for _, t in body[:-1]], [t for _, t in body[1:]])
                        waits = body[-1:]
                    start = stop
        # without any known id there is one block without a tail: its first row follows its last
        if waits and not ended:
            yield compare(pa.array([waits[0][0].as_py()], waits[0][0].type), [waits[0][1]], [first])

    kind = dict(df.dtypes)[id_col]
    out = map_arrow(with_next(df, id_col, text_col), run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
