"""Helpers of the corpus operators: Arrow batches in bounded slices, byte words, hashes and the crc32 folds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.runtime import ship

#: Bytes of text that a worker handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
GOLD = np.uint64(0x9E3779B97F4A7C15)


_last: list[str] = []
_caches: list[Callable] = []


def cached_in_worker(cached):
    """Marks a function with a cache (functools.lru_cache) that lasts as long as a worker runs tasks of one module."""
    _caches.append(cached.cache_clear)
    return cached


def entered(module: str) -> None:
    """A worker outlives its tasks: when one of another module begins, what the former modules kept goes, back to the system
    too, so that a chain of operators takes the memory of its largest and not of all."""
    if _last and _last[0] != module:
        for clear in _caches:
            clear()
        gc.collect()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _last[:] = [module]


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: an iterator of pyarrow batches to another; the package is sent to the executors first."""
    ship(df.sparkSession)
    module = fn.__module__

    def run(batches):
        entered(module)
        yield from fn(batches)

    return df.mapInArrow(run, schema)


def plain(a: pa.Array) -> pa.Array:
    """Text columns with 32-bit offsets, whichever of Arrow's string types comes."""
    return a.cast(pa.binary()) if not pa.types.is_binary(a.type) else a


def slices(batch: pa.RecordBatch, *texts: int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batch whose columns numbered texts hold about budget bytes at most, or a single row."""
    n = batch.num_rows
    if not n:
        return
    total = np.zeros(n, np.int64)
    for k in texts:
        total += pc.fill_null(pc.binary_length(plain(batch.column(k))), 0).to_numpy(zero_copy_only=False)
    cum, start = np.cumsum(total), 0
    while start < n:
        base = cum[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(cum, base + budget, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_texts(a: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in plain(a).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of bytes other than space and 0x09-0x0D."""
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


def within_budget(rows: DataFrame, by: str, order: list[Column], text: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Of each value of by the first rows in the given order: most_rows at most, and none that starts after most_bytes of
    their texts. No row is refused for its own length. rows is small already: a bounded sample's candidates."""
    w = W.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum(F.octet_length(text)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_at", F.row_number().over(w)).withColumn("_before", before).filter((F.col("_at") <= most_rows) & (F.col("_before") < most_bytes)).drop("_before")


def blocks_of(df: DataFrame, text_col: str, block_bytes: int) -> int:
    """Blocks to deal texts into: one for each shuffle partition, or more if they would exceed block_bytes."""
    size = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % n


def keep_rows(df: DataFrame, text_col: str, make_keep) -> DataFrame:
    """The rows of df whose text a predicate keeps, all columns as they are, without a shuffle. make_keep() is called
    once a task and gives a function from a list of texts (null: empty) to a list of booleans."""
    at, module = df.columns.index(text_col), make_keep.__module__

    def run(batches):
        entered(module)
        keep = make_keep()
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(keep([t.decode() for t in byte_texts(part.column(at))]), pa.bool_()))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)
