"""Data preparation that wrapped neural models need; the models plug in as tables of scores or factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators import splits
from quillrank.runtime import materialise, ship


def pointwise_samples(urm: DataFrame, n_items: int, per_positive: int, seed: int = 0) -> DataFrame:
    """user_id, item_id, label: the interactions as 1 and per_positive unseen items for each as 0."""
    pos = urm.select("user_id", "item_id", F.lit(1).alias("label"))
    neg = splits.with_negatives(urm.select("user_id", "item_id", F.lit("test").alias("split")), n_items, per_positive, seed)
    return pos.union(neg.withColumn("label", F.lit(0)))


def pairwise_samples(urm: DataFrame, n_items: int, seed: int = 0) -> DataFrame:
    """user_id, positive, negative: one unseen item for each interaction, by position."""
    pos = urm.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy("item_id")))
    neg = splits.with_negatives(urm.select("user_id", "item_id", F.lit("test").alias("split")), n_items, 1, seed)
    neg = neg.select("user_id", F.col("item_id").alias("negative")).withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy("negative")))
    return pos.join(neg, ["user_id", "_r"]).select("user_id", F.col("item_id").alias("positive"), "negative")


def item_neighbourhood(urm: DataFrame, most: int) -> DataFrame:
    """item_id, users: the first `most` users of each item, by id."""
    r = F.row_number().over(W.partitionBy("item_id").orderBy("user_id"))
    return urm.withColumn("_r", r).filter(F.col("_r") <= most).groupBy("item_id").agg(F.sort_array(F.collect_list("user_id")).alias("users"))


def bipartite_laplacian(urm: DataFrame) -> DataFrame:
    """src, dst, value of I - D^-1/2 A D^-1/2 of the user-item graph without the diagonal; nodes are u<id> and i<id>."""
    du = urm.groupBy("user_id").agg(F.count("*").alias("du"))
    di = urm.groupBy("item_id").agg(F.count("*").alias("di"))
    e = urm.join(du, "user_id").join(di, "item_id").select(F.concat(F.lit("u"), "user_id").alias("u"), F.concat(F.lit("i"), "item_id").alias("i"), (-1 / F.sqrt(F.col("du") * F.col("di"))).alias("value"))
    return e.select(F.col("u").alias("src"), F.col("i").alias("dst"), "value").union(e.select("i", "u", "value"))


def meta_paths(urm: DataFrame, similar_users: DataFrame, least: float, per_pair: int) -> DataFrame:
    """Paths user - item - user - item over neighbours (src, dst, weight) of weight > least: user_id, via_item, via_user,
    item_id, the per_pair best of each (user_id, item_id). A user's profile and those of the neighbours meet in one task;
    no path is shuffled."""
    spark, kinds = urm.sparkSession, dict(urm.dtypes)
    ship(spark)
    own = materialise(urm.filter("user_id is not null and item_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "profiles")
    near = similar_users.filter(F.col("weight") > least).select(F.col("src").alias("user_id"), F.col("dst").alias("via_user"), F.round("weight", 9).alias("weight"))
    rows = near.join(own.withColumnRenamed("user_id", "via_user"), "via_user").select("user_id", "weight", "via_user", "items")
    rows = rows.union(own.select("user_id", F.lit(None), F.lit(None), "items"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", F.col("weight").desc_nulls_first(), "via_user")
    names = ("user_id", "via_item", "via_user", "item_id")
    types = (kinds["user_id"], kinds["item_id"], kinds["user_id"], kinds["item_id"])

    def run(batches):
        user, mine, taken = None, frozenset(), {}
        for batch in batches:
            arrow = [batch.schema.field(0).type, batch.schema.field(3).type.value_type]
            out = [], [], [], []
            items, ends = batch.column(3).flatten().to_pylist(), np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False)).tolist()
            at = 0
            for one, via_user, end in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), ends, strict=True):
                listed, at = items[at:end], end
                if via_user is None:  # a user's own profile comes first
                    user, mine, taken = one, frozenset(listed), {}
                    continue
                shared = [x for x in listed if x in mine] if one == user else []
                for item in listed if shared else ():
                    left = per_pair - taken.get(item, 0)
                    if left > 0:
                        via = [x for x in shared[: left + 1] if x != item][:left]
                        if via:
                            taken[item] = per_pair - left + len(via)
                            out[1].extend(via)
                            out[2].extend([via_user] * len(via))
                            out[3].extend([item] * len(via))
                            out[0].extend([one] * len(via))
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (arrow * 2), strict=True)], names=list(names))
                    out = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (arrow * 2), strict=True)], names=list(names))

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def permuted_factors(factors: DataFrame, order: list[int]) -> DataFrame:
    """id, factors with their dimensions in another order."""
    return factors.withColumn("factors", F.array(*[F.col("factors")[k] for k in order]))


def outer_product(users: DataFrame, items: DataFrame, pairs: DataFrame, part: str = "all_map") -> DataFrame:
    """user_id, item_id, map: the outer product of both factor vectors, flattened; part: all_map, main_diagonal or
    off_diagonal (the rest 0)."""
    u = users.select(F.col("id").alias("user_id"), F.col("factors").alias("fu"))
    i = items.select(F.col("id").alias("item_id"), F.col("factors").alias("fi"))
    cell = {"all_map": lambda a, b, x, y: a * b, "main_diagonal": lambda a, b, x, y: F.when(x == y, a * b).otherwise(0.0), "off_diagonal": lambda a, b, x, y: F.when(x != y, a * b).otherwise(0.0)}[part]
    flat = F.flatten(F.transform("fu", lambda a, x: F.transform("fi", lambda b, y: cell(a, b, x, y))))
    return pairs.join(u, "user_id").join(i, "item_id").select("user_id", "item_id", flat.alias("map"))
