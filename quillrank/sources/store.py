"""Saving and loading: datasets, splits, models and results as Parquet folders with a JSON side table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SIDE = "_values"


def save(folder: str, tables: dict[str, DataFrame], values: dict | None = None) -> None:
    """Writes each table as folder/name and the plain values as one JSON text (its keys become strings)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    names = json.dumps({"tables": sorted(tables), "values": values or {}})
    spark.createDataFrame([(names,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{SIDE}")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    said = json.loads(spark.read.text(f"{folder}/{SIDE}").first()["value"])
    return {n: spark.read.parquet(f"{folder}/{n}") for n in said["tables"]}, said["values"]


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{SIDE}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def published_or_made(spark: SparkSession, published: dict[str, str], read: Callable[[str], DataFrame], make: Callable[[], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """The parts of a split that its authors published, read from their files if all are there, else those that make()
    gives; and whether they are the published ones."""
    if published and all(there(spark, p) for p in published.values()):
        return {name: read(p) for name, p in published.items()}, True
    return make(), False


def load_or_build(spark: SparkSession, folder: str, build: Callable[[], tuple[dict[str, DataFrame], dict]]) -> tuple[dict[str, DataFrame], dict]:
    """The saved copy if there is one, else builds, saves and loads it."""
    if not exists(spark, folder):
        save(folder, *build())
    return load(spark, folder)
