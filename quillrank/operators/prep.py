"""Construction, projection, filtering and set operations on triple tables (row, column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.functions.text import tag_filter
from quillrank.runtime import materialise


def build(df: DataFrame, row: str = "user_id", col: str = "item_id", value: str = "rating") -> DataFrame:
    """Triples with repeated coordinates summed and zeros left out."""
    return df.groupBy(row, col).agg(F.sum(value).alias(value)).filter(F.col(value) != 0)


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """original (the distinct values), idx 0, 1, ... in their order. Each range partition numbers its own rows and adds
    the counts of those before it, so no single task sorts all."""
    ranged = df.select(F.col(col).alias("original")).filter("original is not null").distinct().repartitionByRange("original")
    rows = materialise(ranged.select("original", F.spark_partition_id().alias("part")), "index")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    at = F.row_number().over(W.partitionBy("part").orderBy("original"))
    return rows.withColumn("at", at).join(before, "part").select("original", (F.col("offset") + F.col("at") - 1).cast("long").alias("idx"))


def to_index(df: DataFrame, col: str, mapper: DataFrame, new: str = "ignore") -> DataFrame:
    """Replaces col by its index. Values that mapper lacks are dropped ('ignore') or numbered after the rest ('add')."""
    if new == "add":
        top = mapper.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("m")).first()["m"]
        fresh = df.join(mapper, df[col] == mapper["original"], "left_anti")
        mapper = mapper.unionByName(dense_index(fresh, col).withColumn("idx", F.col("idx") + top + 1))
    return df.join(mapper, df[col] == mapper["original"]).drop(col, "original").withColumnRenamed("idx", col)


def reconcile_index(mapper: DataFrame, removed: DataFrame, col: str) -> DataFrame:
    """The mapper without the removed indices, numbered anew in the old order: original, idx."""
    left = mapper.join(removed.select(F.col(col).alias("idx")), "idx", "left_anti")
    again = dense_index(left, "idx").select(F.col("original").alias("idx"), F.col("idx").alias("new"))
    return left.join(again, "idx").select("original", F.col("new").alias("idx"))


def invert_index(mapper: DataFrame) -> DataFrame:
    """idx, original; an error unless the mapper is one to one."""
    if not mapper.groupBy("idx").count().filter("count > 1").isEmpty():
        raise ValueError("the mapper isn't one to one")
    return mapper.select("idx", "original")


def remove_empty(urm: DataFrame, users: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Users and items with an interaction, and those without."""
    u, i = urm.select("user_id").distinct(), urm.select("item_id").distinct()
    return users.join(u, "user_id", "left_semi"), items.join(i, "item_id", "left_semi"), users.join(u, "user_id", "left_anti"), items.join(i, "item_id", "left_anti")


def degree_filter(urm: DataFrame, user_min: int, item_min: int) -> DataFrame:
    """Users with user_min interactions or more, then items with item_min among theirs; one pass, not a k-core."""
    u = urm.groupBy("user_id").count().filter(F.col("count") >= user_min).select("user_id")
    kept = urm.join(u, "user_id", "left_semi")
    i = kept.groupBy("item_id").count().filter(F.col("count") >= item_min).select("item_id")
    return kept.join(i, "item_id", "left_semi")


def prune_features(icm: DataFrame, n_items: int, least: int = 5, most_share: float = 0.30) -> DataFrame:
    """Features that at least `least` items and at most n_items * most_share have."""
    f = icm.groupBy("feature").agg(F.count("*").alias("df")).filter((F.col("df") >= least) & (F.col("df") <= n_items * most_share))
    return icm.join(f.select("feature"), "feature", "left_semi")


def remove_ids(facts: DataFrame, removed: DataFrame, col: str) -> DataFrame:
    return facts.join(removed.select(col).distinct(), col, "left_anti")


def union_features(first: DataFrame, second: DataFrame, n_first: int) -> DataFrame:
    """Two feature tables (item_id, feature_id, value) side by side: the second's features follow the first's n_first."""
    return first.select("item_id", "feature_id", "value").union(second.select("item_id", (F.col("feature_id") + n_first).alias("feature_id"), "value"))


def binarised(df: DataFrame, value: str = "rating") -> DataFrame:
    return df.withColumn(value, F.lit(1.0))


def implicit_from(urm: DataFrame, least: float) -> DataFrame:
    return binarised(urm.filter(F.col("rating") >= least))


def density(urm: DataFrame, n_users: int, n_items: int) -> DataFrame:
    cells = float(n_users) * n_items
    return urm.agg(F.count("*").alias("nnz")).select("nnz", (F.col("nnz") / cells if cells else F.lit(0.0)).alias("density"))


def column_parts(df: DataFrame, n_cols: int, parts: int, col: str = "item_id") -> DataFrame:
    """Adds part: parts equal ranges of columns, the last with the rest."""
    return df.withColumn("part", F.least(F.floor(F.col(col) / max(1, n_cols // parts)), F.lit(parts - 1)).cast("int"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Coordinates whose values differ (absent counts as 0): empty for equal matrices."""
    j = a.select("user_id", "item_id", F.col("rating").alias("x")).join(b.select("user_id", "item_id", F.col("rating").alias("y")), ["user_id", "item_id"], "full")
    return j.filter(F.coalesce("x", F.lit(0.0)) != F.coalesce("y", F.lit(0.0)))


def top_popular(urm: DataFrame, items: DataFrame, share: float = 0.2) -> DataFrame:
    """item_id of the int(n_items * share) items with the greatest sum of ratings (ties: least id)."""
    pop = items.join(urm.groupBy("item_id").agg(F.sum("rating").alias("s")), "item_id", "left").select("item_id", F.coalesce("s", F.lit(0.0)).alias("s"))
    return pop.orderBy(F.desc("s"), "item_id").limit(int(items.count() * share)).select("item_id")


#: Prime steps of a walk over a matrix's cells.
CELL_STEPS = (1000003, 1000033, 1000037)


def zero_samples(urm: DataFrame, n_users: int, n_items: int, wanted: int, seed: int = 42) -> DataFrame:
    """wanted pairs that the matrix lacks, or all if there are fewer: user_id, item_id, rating 0. They are the first of a
    walk over all cells by a step coprime to their number, of which wanted plus the filled cells are enough."""
    cells = n_users * n_items
    step = next((p for p in CELL_STEPS if cells % p), 1) if cells else 1
    tries = min(cells, wanted + urm.count())
    cell = F.pmod(F.col("id") * step + F.lit(seed), F.lit(max(1, cells)))
    drawn = urm.sparkSession.range(tries).select("id", F.floor(cell / n_items).alias("user_id"), F.pmod(cell, F.lit(n_items)).alias("item_id"))
    return drawn.join(urm.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").orderBy("id").limit(wanted).select("user_id", "item_id", F.lit(0.0).alias("rating"))


def top_k(df: DataFrame, k: int, by: str, weight: str, tie: str, out: str | None = None) -> DataFrame:
    """The k largest non-zero weights of each `by`; ties: least `tie`. Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(weight), tie))
    got = df.filter(F.col(weight) != 0).withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return got.withColumnRenamed("_rank", out) if out else got.drop("_rank")


def tokens_of(df: DataFrame, id_col: str, text: Column, distinct: bool = True) -> DataFrame:
    """item_id, feature, value: filtered tokens of a text column (see functions.text.tag_filter)."""
    t = tag_filter(text)
    rows = df.select(F.col(id_col).alias("item_id"), F.explode(F.array_distinct(t) if distinct else t).alias("feature"))
    return rows.groupBy("item_id", "feature").agg(F.count("*").cast("double").alias("value"))


def rank_weighted_sum(values: DataFrame, col: str) -> DataFrame:
    """n, total, weighted = sum of i * x_i over values in ascending order, i from 1. Equal values share one row, so the
    ordered pass is over distinct values only."""
    groups = values.groupBy(F.col(col).alias("x")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1))
    g = groups.withColumn("s", F.coalesce(before, F.lit(0)))
    ranks = F.col("m") * F.col("s") + F.col("m") * (F.col("m") + 1) / 2
    return g.agg(F.sum("m").alias("n"), F.sum(F.col("x") * F.col("m")).alias("total"), F.sum(F.col("x") * ranks).alias("weighted"))


def gini(values: DataFrame, col: str) -> DataFrame:
    """Gini index of non-negative values, each raised by 1e-7."""
    r = rank_weighted_sum(values.select((F.col(col) + F.lit(1e-7)).alias("x")), "x")
    return r.select(((2 * F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))).alias("gini"))


def statistics(urm: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """One row: interactions, density, and the least, mean and greatest profile of users and items; users without any
    count as 0."""
    per = lambda c, n: urm.groupBy(c).agg(F.count("*").alias("k")).agg(F.when(F.count("*") < n, 0).otherwise(F.min("k")).alias(f"{c[:4]}_min"), (F.sum("k") / n).alias(f"{c[:4]}_avg"), F.max("k").alias(f"{c[:4]}_max"))
    return density(urm, n_users, n_items).join(per("user_id", n_users)).join(per("item_id", n_items))
