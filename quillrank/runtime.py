"""Session plumbing shared by every subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python, unless the session says otherwise: rows can be long texts, so a
#: number of rows alone doesn't bound memory.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
PACKAGE_DIR = Path(__file__).resolve().parent
_shipped: set[str] = set()


def one_blas_thread() -> None:
    """numpy's OpenBLAS in this process runs on one thread: the driver shares its cores with Spark, and OpenBLAS' own
    threads can wait for each other forever in a process that has started a JVM."""
    for lib in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        with suppress(OSError):
            h = ctypes.CDLL(str(lib))
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(h, name):
                    getattr(h, name)(1)


one_blas_thread()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that functions run there can import it, and bounds
    the session's Arrow batches."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillrank-"), "quillrank_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE_DIR.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE_DIR.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local folder serves only if
    driver and executors are one process (local mode, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "quillrank-shared")
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later jobs don't repeat what made it, and losing
    an executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, df._written_at
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
