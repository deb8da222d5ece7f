"""Consistency checks: each returns a frame that is empty, or a one-row frame of flags, never a collected table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def implicit(urm: DataFrame) -> DataFrame:
    return urm.agg((F.min("rating") == 1).alias("a"), (F.max("rating") == 1).alias("b")).select(F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("implicit"))


def parts(split: DataFrame, names: list[str], col: str = "split", value: str = "rating") -> DataFrame:
    """A row for each named part: its interactions (an empty part has 0), whether all are 1, and values that aren't finite."""
    own = split.groupBy(F.col(col).alias("part")).agg(F.count("*").alias("n"), ((F.min(value) == 1) & (F.max(value) == 1)).alias("implicit"), F.count(F.when(F.isnan(value) | F.col(value).isin(float("inf"), float("-inf")) | F.col(value).isNull(), 1)).alias("not_finite"))
    all_ = split.sparkSession.createDataFrame([(n,) for n in names], "part string")
    return all_.join(own, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), "implicit", F.coalesce("not_finite", F.lit(0)).alias("not_finite"))


def overlaps(parts: dict[str, DataFrame]) -> DataFrame:
    """Pairs of user and item that stand in several of the parts; empty if they are disjoint."""
    all_ = reduce(DataFrame.union, [p.select("user_id", "item_id").distinct() for p in parts.values()])
    return all_.groupBy("user_id", "item_id").agg(F.count("*").alias("n_parts")).filter("n_parts > 1")


def mapper_faults(mapper: DataFrame, n: int) -> DataFrame:
    """One row: sizes of a mapper and whether it maps n originals one to one to 0..n-1."""
    a = mapper.agg(F.count("*").alias("rows"), F.count_distinct("original").alias("originals"), F.count_distinct("idx").alias("indices"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return a.withColumn("consistent", (F.col("rows") == n) & (F.col("originals") == n) & (F.col("indices") == n) & (F.col("lo") == 0) & (F.col("hi") == n - 1))


def unknown_ids(facts: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """Ids of facts that the dimension lacks."""
    return facts.select(col).distinct().join(dim.select(col), col, "left_anti")


def not_finite(df: DataFrame, col: str, non_negative: bool = False) -> DataFrame:
    bad = F.isnan(col) | F.col(col).isin(float("inf"), float("-inf")) | F.col(col).isNull()
    return df.filter(bad | (F.col(col) < 0) if non_negative else bad)


def cold(dim: DataFrame, facts: DataFrame, col: str) -> DataFrame:
    """Ids of the dimension without a fact."""
    return dim.select(col).join(facts.select(col).distinct(), col, "left_anti")


def negative_statistics(test: DataFrame, neg: DataFrame) -> DataFrame:
    """One row: users with test items and with negatives, users of one kind only, least and greatest number of negatives
    of a user, and pairs that are both."""
    t, n = test.groupBy("user_id").agg(F.count("*").alias("t")), neg.groupBy("user_id").agg(F.count("*").alias("n"))
    per = t.join(n, "user_id", "full").agg(
        F.count("t").alias("test_users"), F.count("n").alias("negative_users"), F.sum(F.col("n").isNull().cast("long")).alias("test_only"), F.sum(F.col("t").isNull().cast("long")).alias("negative_only"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    both = test.join(neg, ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("both"))
    return per.join(both)


def without_cold_test_items(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.join(train.select("item_id").distinct(), "item_id", "left_semi")
