"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of all the pre-tokens at hand form one linked list, cut between pre-tokens. Each adjacent pair whose joined
bytes have a rank lies in that rank's bucket of left positions. A bitmap of three levels says which buckets hold
entries: find-first-set on each level gives the least rank, however long the list. A bucket's positions are merged from
left to right; an entry is stale if its position was merged away or now starts a pair of another rank, and is skipped.
If a merge makes a pair of a lesser rank, that bucket comes first and the rest of this one waits. So a pre-token of n
bytes takes O(n log n) at most, not O(n^2), and many short ones share the queue's cost.

Texts: null is empty (no ids, empty bytes). Rows are independent: ties, repeated rows and empty tables need nothing
special; only the two named columns are read.
"""

from __future__ import annotations

import base64
import gc
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from quillrank.llm._common import byte_texts, cached_in_worker, map_arrow, slices

#: Pre-tokens that a worker keeps with their ids (and as many older ones), and the longest that it keeps; characters of
#: new pre-tokens that share a queue.
CACHE_ITEMS, CACHE_CHARS, MERGE_CHARS = 400_000, 48, 6_000
WORD = 64
#: Bits of an id in a pair's key, and the symbol between pre-tokens, which is in no pair.
SHIFT = 18
GAP, GAP_BYTE = (1 << SHIFT) - 1, b"\0"


class RankQueue:
    """Buckets of positions by rank; the least rank's bucket comes first."""

    def __init__(self, n: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (n // WORD + 1)
        self.mid = [0] * (n // WORD**2 + 1)
        self.top = 0

    def push(self, rank: int, at: list[int]) -> None:
        found = self.buckets.get(rank)
        if found is not None:
            found += at
            return
        self.buckets[rank] = at
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions in order; the bucket is empty then."""
        top = self.top
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = (b << 6) + (mid & -mid).bit_length() - 1
        low = self.low[a]
        rank = (a << 6) + (low & -low).bit_length() - 1
        self.low[a] = low = low & (low - 1)
        if not low:
            self.mid[b] = mid = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        at = self.buckets.pop(rank)
        at.sort()
        return rank, at


class Codec:
    """Encoder and decoder for one file of ranks and one pre-tokenisation pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        fs, at = pafs.FileSystem.from_uri(ranks_path) if "://" in ranks_path else (pafs.LocalFileSystem(), ranks_path)
        with fs.open_input_stream(at) as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        if self.size > GAP:
            raise ValueError(f"more than {GAP} ranks")
        get = self.ranks.get
        self.pairs: dict[int, int] = {}  # by both parts' ids, however a token splits in two
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    self.pairs[a << SHIFT | b] = rank
        self.byte_ids = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.byte_pairs = np.array([get(bytes([k >> 8, k & 255]), -1) for k in range(1 << 16)], np.int64)
        self.findall = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as 32-bit integers in a row) of each pre-token; none may be empty."""
        data = np.frombuffer(GAP_BYTE.join([b"", *pieces, b""]), np.uint8).astype(np.int64)
        gaps = np.concatenate(([0], np.cumsum([len(x) + 1 for x in pieces])))
        token = self.byte_ids[data]
        token[gaps] = GAP
        n, get = len(data), self.pairs.get
        kinds = np.full(n, -1, np.int64)  # of two bytes
        kinds[:-1] = self.byte_pairs[data[:-1] << 8 | data[1:]]
        kinds[gaps] = -1
        kinds[gaps[1:] - 1] = -1
        sym, pair, after, before = token.tolist(), kinds.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue(self.size)
        at = np.flatnonzero(kinds >= 0)
        at = at[np.argsort(kinds[at], kind="stable")]
        for group in np.split(at, np.flatnonzero(np.diff(kinds[at])) + 1) if len(at) else ():
            queue.push(int(kinds[group[0]]), group.tolist())
        push, bucket = queue.push, queue.buckets.get
        while queue.top:
            r, at = queue.pop()
            high, less = r << SHIFT, False
            for k, i in enumerate(at):
                if pair[i] != r:
                    continue
                gone = after[i]
                after[i] = end = after[gone]
                before[end] = i
                pair[gone] = -1
                sym[i] = r
                pair[i] = new = get(high | sym[end], -1)
                if new >= 0:
                    if (found := bucket(new)) is None:
                        push(new, [i])
                    else:
                        found.append(i)
                    less = new < r
                p = before[i]
                new = get(sym[p] << SHIFT | r, -1)
                if new != pair[p]:
                    pair[p] = new
                    if new >= 0:
                        if (found := bucket(new)) is None:
                            push(new, [p])
                        else:
                            found.append(p)
                        less = less or new < r
                if less:
                    if rest := [j for j in at[k + 1 :] if pair[j] == r]:
                        push(r, rest)
                    break
        out = []
        for i in gaps[:-1].tolist():
            ids, i = [], i + 1
            while (x := sym[i]) != GAP:
                ids.append(x)
                i = after[i]
            out.append(array("i", ids).tobytes())
        return out

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that the cache doesn't hold; those that are too long for it come back."""
        new, older, ranks = [], self.older.get, self.ranks.get
        for p in pieces:
            if (ids := older(p)) is not None:
                self.cache[p] = ids
            elif (whole := ranks(p.encode())) is not None:
                self.cache[p] = array("i", (whole,)).tobytes()
            else:
                new.append(p)
        extra = {}
        start, size = 0, 0
        for k, p in enumerate(new):
            size += len(p)
            if size >= MERGE_CHARS or k == len(new) - 1:
                for q, ids in zip(new[start : k + 1], self.merge([q.encode() for q in new[start : k + 1]]), strict=True):
                    (self.cache if len(q) <= CACHE_CHARS else extra)[q] = ids
                start, size = k + 1, 0
        return extra

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(self.findall, texts))
        if len(self.cache) >= CACHE_ITEMS:
            self.older, self.cache = self.cache, {}
        extra = self.learn(set().union(*split).difference(self.cache))
        self.cache.update(extra)  # while these texts need them
        get = self.cache.__getitem__
        out = [np.frombuffer(b"".join(map(get, x)), np.int32) for x in split]
        for p in extra:
            del self.cache[p]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def columns(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids of each text, and the bytes that they stand for."""
        ids = self.encode_all(texts)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        return pa.ListArray.from_arrays(starts, flat), pa.array([self.decode(x.tolist()) for x in ids], pa.binary())


@cached_in_worker
@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_decode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: id_col, ids (array<int>) of the whole text, and decoded (binary): those ids decoded again.
    A null text is empty: no ids, empty bytes. An empty table gives an empty one."""

    def run(batches):
        c = codec(ranks_path, pattern)
        gc.disable()  # nothing here makes cycles, and the collector would go through the cache again and again
        try:
            for batch in batches:
                for part in slices(batch, 1):
                    ids, decoded = c.columns([t.decode() for t in byte_texts(part.column(1))])
                    yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=["id", "ids", "decoded"])
        finally:
            gc.enable()

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, text_col), run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: id_col and decoded (binary) of an array of ids; a null array is empty. An id outside the vocabulary
    raises an error."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "decoded"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.select(id_col, ids_col), run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)
