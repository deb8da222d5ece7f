"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Seeds are the shared windows of MATCH words: a rolling Karp-Rabin
hash over the word numbers of a whole text is looked up among the windows of the benchmark's items, and every hit is
confirmed word by word. Seeds of one diagonal join into maximal matches; tiling then marks the longest match whose words are all free in both texts, again
and again, cutting what is partly taken, until none of MATCH words is left. The share of an item's words under tiles is
its coverage; order doesn't matter, so reordered passages count in full. Items of fewer words than MATCH are compared by
a window of their own length.

The benchmark is a query set held against all rows in blocks: at most BLOCK_BYTES of its texts are broadcast at a time,
and a further block makes a further pass, so a benchmark of any size is used whole. A pass's result is written and its
broadcast destroyed before the next block is read.

Nulls: a null or wordless text or item shares nothing. Repeated rows give repeated results, repeated items count
separately. Ties: of equally long matches the one that comes first in the item, then in the text, is marked first. Texts
of any length are read whole, SEEDS seeds at a time at most are expanded for texts that together make more, and a
repetitive text's seeds join as arrays. Empty tables give empty results; other columns are never read (contaminated) or
come along as they are (decontaminated), whatever their names.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm._common import byte_texts, keep_rows, map_arrow, mix, slices
from quillrank.runtime import discard, materialise

MATCH, COVERAGE = 4, 0.5
BLOCK_BYTES, SEEDS = 8 << 20, 1 << 20
_words = re.compile(r"[^\W_]+").findall
_base = np.uint64(0x100000001B3)


def tokens(text: str) -> list[str]:
    return _words(text.lower())


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of size numbers."""
    n = max(0, len(ids) - size + 1)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _base + ids[k : k + n]
    return mix(h)


def matches(p: np.ndarray, t: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (-length, pattern position, text position) that seeds of size words at (p, t) join into: those of one
    diagonal at neighbouring positions."""
    if not len(p):
        return []
    order = np.lexsort((p, t - p))
    p, d = p[order], (t - p)[order]
    first = np.ones(len(p), bool)
    first[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
    start = np.flatnonzero(first)
    last = np.append(start[1:], len(p)) - 1
    return list(zip((-(p[last] - p[start] + size)).tolist(), p[start].tolist(), (p[start] + d[start]).tolist(), strict=True))


def tiles(heap: list[tuple[int, int, int]], match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern position, text position, length) of the tiles; longest first, then by position.
    heap: all maximal matches of match words or more."""
    heapq.heapify(heap)
    used_p, used_t, out = set(), set(), []
    while heap:
        n, p, t = heapq.heappop(heap)
        n = -n
        free = [p + k not in used_p and t + k not in used_t for k in range(n)]
        if all(free):
            used_p.update(range(p, p + n))
            used_t.update(range(t, t + n))
            out.append((p, t, n))
            continue
        k = 0
        while k < n:  # the free parts go back
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= match:
                    heapq.heappush(heap, (-(e - k), p + k, t + k))
                k = e
            k += 1
    return out


class Index:
    """A block of the benchmark: word numbers, and each window's items and positions by its hash."""

    def __init__(self, items: list[tuple[int, str]], match: int):
        self.match = match
        self.items = [(i, w) for i, t in items if (w := tokens(t))]
        self.vocab: dict[str, int] = {}
        numbers = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint64) for _, w in self.items]
        self.lens = np.array([len(w) for w in numbers], np.int64)
        self.at = np.cumsum(self.lens) - self.lens  # where an item's words start among all
        self.words = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted(set(np.minimum(match, self.lens).tolist())):
            own = [k for k in range(len(numbers)) if min(match, len(numbers[k])) == size]
            hashes = [rolling(numbers[k], size) for k in own]
            h = np.concatenate(hashes)
            item = np.repeat(own, [len(x) for x in hashes])
            pos = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.lexsort((pos, item, h))
            known, start = np.unique(h[order], return_index=True)
            self.windows[size] = known, np.append(start, len(h)), item[order], pos[order]

    def __reduce__(self):
        return _index, ([(i, " ".join(w)) for i, w in self.items], self.match)

    def hits(self, texts: list[str], coverage: float):
        """(text's number, item's id, item's words, covered words, tiles) for each pair with enough coverage."""
        split = [tokens(t) for t in texts]
        get = self.vocab.get
        lens = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter((y for x in split for y in map(get, x, _zeros(len(x)))), np.uint64, int(lens.sum()))
        ends = np.cumsum(lens)
        for size, (known, start, item, pos) in self.windows.items():
            h = rolling(ids, size)
            if not len(h):
                continue
            ok = ids[: len(h)] > 0
            for k in range(1, size):
                ok &= ids[k : k + len(h)] > 0
            at = np.flatnonzero(ok)
            row = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            doc = np.searchsorted(ends, at, "right")
            real = (known[row] == h[at]) & (at + size <= ends[doc])
            at, row, doc = at[real], row[real], doc[real]
            many = start[row + 1] - start[row]
            # whole texts at a time: one, or as many as make SEEDS seeds together
            edges, total = np.flatnonzero(np.diff(doc, prepend=-1)), np.concatenate(([0], np.cumsum(many)))
            a = 0
            while a < len(edges):
                b = a + 1
                while b < len(edges) and total[edges[b + 1] if b + 1 < len(edges) else len(at)] - total[edges[a]] <= SEEDS:
                    b += 1
                part = slice(edges[a], edges[b] if b < len(edges) else len(at))
                yield from self._tiled(ids, size, at[part], start[row[part]], many[part], doc[part], item, pos, ends - lens, coverage)
                a = b

    def _tiled(self, ids, size, at, first, many, doc, item, pos, begins, coverage):
        t = np.repeat(at, many)
        w = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(t))
        d, k, p = np.repeat(doc, many), item[w], pos[w]
        same = np.ones(len(t), bool)
        for j in range(size):  # equal hashes are confirmed
            same &= ids[t + j] == self.words[self.at[k] + p + j]
        t, d, k, p = t[same], d[same], k[same], p[same]
        order = np.lexsort((t, p, k, d))
        t, d, k, p = t[order], d[order], k[order], p[order]
        cuts = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(k, prepend=-1) != 0)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
            own, number = p[a:b], int(k[a])
            n = int(self.lens[number])
            reach = np.zeros(n + 1, np.int64)
            np.add.at(reach, own, 1)
            np.add.at(reach, own + size, -1)
            if (np.cumsum(reach)[:n] > 0).sum() < coverage * n:  # tiles lie within the seeds
                continue
            got = tiles(matches(own, t[a:b] - begins[d[a]], size), size)
            covered = sum(x for _, _, x in got)
            if covered >= coverage * n:
                yield int(d[a]), self.items[number][0], n, covered, len(got)


def _zeros(n: int):
    return (0 for _ in range(n))


def _index(items, match) -> Index:
    return Index(items, match)


def blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text) of BLOCK_BYTES at most (or a single item), one after another."""
    own = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").orderBy("i", "t")
    block, size = [], 0
    for r in own.toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item of whose words it holds the share coverage or more: id_col, item_col,
    n_words (of the item), covered, n_tiles (long), coverage (double)."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    item_type = benchmark.select(F.col(item_col).alias("x")).limit(0).toArrow().schema.field("x").type
    out = None
    for block in blocks(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(Index(block, match))

        def run(batches, held=held):
            index = held.value
            for batch in batches:
                for part in slices(batch, 1):
                    rows = list(index.hits([t.decode() for t in byte_texts(part.column(1))], coverage))
                    d, item, n, covered, parts = zip(*rows, strict=True) if rows else ((),) * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), pa.array(item, item_type), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(parts, pa.int64())], names=["id", "item", "n_words", "covered", "n_tiles"])

        found = materialise(map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), run, f"id {kind}, item {item_kind}, n_words bigint, covered bigint, n_tiles bigint"), "hits")
        held.destroy()
        out = found if out is None else out.union(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_words", "covered", "n_tiles", (F.col("covered") / F.col("n_words")).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no item of the benchmark to the share coverage, all columns as they are. Rows left by a
    block are written, unless it is the only one."""
    held, passes = None, 0
    for block in blocks(benchmark, item_col, item_text_col):
        if held is not None:
            left = materialise(docs, "clean")
            held.destroy()
            if passes > 1:
                discard(before)
            docs = before = left
        passes += 1
        held = docs.sparkSession.sparkContext.broadcast(Index(block, match))

        def make(held=held):
            def keep(texts):
                hit = {d for d, *_ in held.value.hits(texts, coverage)}
                return [i not in hit for i in range(len(texts))]

            return keep

        docs = keep_rows(docs, text_col, make)
    return docs
