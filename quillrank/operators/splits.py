"""Train, validation and test splits. Random ones draw by a key of user, item and seed, so a split is a pure function of
its rows; splits return the interactions with a column split (train, validation, test)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIME, SPAN = 7919, 104729
#: Primes; a walk over a catalogue goes by those that don't divide its size.
STEPS = (10007, 20011, 30011, 40009, 50021, 60013, 70001, 80021)


def key(user: Column, item: Column, seed: int = 0) -> Column:
    """An order in which a user's items fall as if shuffled; any engine computes the same."""
    return F.pmod(user * 1000003 + item * PRIME + seed * 611953, F.lit(SPAN))


def user_key(user: Column, seed: int = 0) -> Column:
    return F.pmod(user * 15485863 + seed * 611953 + 12345, F.lit(SPAN))


def _ranked(urm: DataFrame, *order: Column) -> DataFrame:
    return urm.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(*order)))


def _named(first: Column, second: Column) -> Column:
    return F.when(first, "test").when(second, "validation").otherwise("train").alias("split")


def leave_k_out(urm: DataFrame, k: int = 1, by: str = "hash", seed: int = 0, validation: bool = True, lose_gap: bool = False) -> DataFrame:
    """Of each user k interactions to test, the next k to validation, the rest to train. by: 'hash' (shuffled) or
    'rating' (greatest first, then item). lose_gap: without validation, drop the k interactions that would be in it."""
    order = [key(F.col("user_id"), F.col("item_id"), seed), F.col("item_id")] if by == "hash" else [F.desc("rating"), F.col("item_id")]
    r = _ranked(urm, *order)
    if not validation and lose_gap:
        r = r.filter((F.col("_r") <= k) | (F.col("_r") > 2 * k))
    return r.withColumn("split", _named(F.col("_r") <= k, F.lit(validation) & (F.col("_r") <= 2 * k))).drop("_r")


def with_long_profiles(urm: DataFrame, least: int) -> DataFrame:
    u = urm.groupBy("user_id").count().filter(F.col("count") >= least).select("user_id")
    return urm.join(u, "user_id", "left_semi")


def leave_k_out_checked(urm: DataFrame, k: int, splits: int = 3, **how) -> DataFrame:
    """leave_k_out over users with at least (splits - 1) * k + 1 interactions."""
    return leave_k_out(with_long_profiles(urm, (splits - 1) * k + 1), k, validation=splits > 2, **how)


def user_percentage(urm: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Of each user the share (rounded half to even) to train, never all of two or more; the rest to test."""
    n = F.count("*").over(W.partitionBy("user_id"))
    r = _ranked(urm.withColumn("_n", n), key(F.col("user_id"), F.col("item_id"), seed), F.col("item_id"))
    cut = F.bround(F.col("_n") * share)
    cut = F.when((cut == F.col("_n")) & (F.col("_n") > 1), cut - 1).otherwise(cut)
    return r.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("test")).drop("_r", "_n")


def leave_one_out_if(urm: DataFrame, least_train: int, seed: int = 0) -> DataFrame:
    """One interaction to test from users with more than least_train."""
    n = F.count("*").over(W.partitionBy("user_id"))
    r = _ranked(urm.withColumn("_n", n), key(F.col("user_id"), F.col("item_id"), seed), F.col("item_id"))
    return r.withColumn("split", F.when((F.col("_r") == 1) & (F.col("_n") > least_train), "test").otherwise("train")).drop("_r", "_n")


def timestamp(urm: DataFrame) -> DataFrame:
    """The newest interaction to test, the next to validation (ties: least item); users with fewer than three go."""
    ranked = _ranked(urm.filter("user_id is not null"), F.desc("ts"), F.col("item_id"))
    long = ranked.withColumn("_n", F.count("*").over(W.partitionBy("user_id"))).filter("_n >= 3")  # not by a join, which would make urm twice
    return long.withColumn("split", _named(F.col("_r") == 1, F.col("_r") == 2)).drop("_r", "_n")


def holdout(urm: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each interaction to train with probability share, whatever its user."""
    return urm.withColumn("split", F.when(key(F.col("user_id"), F.col("item_id"), seed) < share * SPAN, "train").otherwise("test"))


def cold_start(urm: DataFrame, cold_items: int, share: float, seed: int = 0) -> DataFrame:
    """Users with at most cold_items interactions, and round(n * share) of the others, are all train; of the rest
    cold_items interactions are train and the others test."""
    sizes = urm.groupBy("user_id").agg(F.count("*").alias("_n"))
    warm = sizes.filter(F.col("_n") > cold_items)
    n_train = F.bround(F.lit(warm.count()) * share)
    # the users' order among all: by value of the key first, then exactly within it
    keyed = warm.withColumn("_k", user_key(F.col("user_id"), seed))
    by_key = keyed.groupBy("_k").agg(F.count("*").alias("_m"))  # SPAN rows at most
    before = by_key.select("_k", (F.sum("_m").over(W.orderBy("_k")) - F.col("_m")).alias("_before"))
    at = keyed.join(before, "_k").withColumn("_at", F.col("_before") + F.row_number().over(W.partitionBy("_k").orderBy("user_id")))
    held = at.filter(F.col("_at") > n_train).select("user_id", F.lit(True).alias("_held"))
    r = _ranked(urm, key(F.col("user_id"), F.col("item_id"), seed), F.col("item_id")).join(held, "user_id", "left")
    return r.withColumn("split", F.when(F.coalesce("_held", F.lit(False)) & (F.col("_r") > cold_items), "test").otherwise("train")).drop("_r", "_held")


def repeats(urm: DataFrame, n: int, share: float = 0.8) -> DataFrame:
    """n independent user-wise splits, numbered by fold."""
    out = None
    for fold in range(n):
        one = user_percentage(urm, share, seed=fold + 1).withColumn("fold", F.lit(fold))
        out = one if out is None else out.unionByName(one)
    return out


def user_disjoint(urm: DataFrame, least: int, held_share: float, hidden_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Strong generalisation: of users with `least` interactions, shares of held_share by key are test and validation
    users. Their items are limited to those of train users, and int(hidden_share * n) of a profile are the part to
    predict. Columns: split and part (fold_in or hidden; null in train)."""
    urm = with_long_profiles(urm, least)
    k = user_key(F.col("user_id"), seed) / SPAN
    urm = urm.withColumn("split", _named(k < held_share, k < 2 * held_share))
    train = urm.filter("split = 'train'")
    held = urm.filter("split <> 'train'").join(train.select("item_id").distinct(), "item_id", "left_semi")
    n = F.count("*").over(W.partitionBy("user_id"))
    r = _ranked(held.withColumn("_n", n), key(F.col("user_id"), F.col("item_id"), seed), F.col("item_id"))
    part = F.when(F.col("_r") <= F.floor(F.col("_n") * hidden_share), "hidden").otherwise("fold_in")
    return train.withColumn("part", F.lit(None).cast("string")).unionByName(r.withColumn("part", part).drop("_r", "_n"))


def walked(urm: DataFrame, users: DataFrame, n_items: int, n: int, seed: int = 0) -> DataFrame:
    """user_id, item_id, rank 1..n: the first n unseen items of each user's walk over the whole catalogue, from a start and
    by a step of the user's own that is coprime to the catalogue's size, so that a walk meets every item once. n plus the
    profile's size of its items are enough, so no user meets all items."""
    sizes = users.select("user_id").distinct().join(urm.groupBy("user_id").agg(F.count("*").alias("_n")), "user_id", "left")
    tries = F.least(F.lit(n_items), F.lit(n) + F.coalesce("_n", F.lit(0)))
    walk = sizes.filter(F.lit(n_items > 0)).select("user_id", F.explode(F.sequence(F.lit(0), tries - 1)).alias("_at"))
    steps = [p for p in STEPS if n_items and n_items % p]
    step = F.element_at(F.array(*map(F.lit, steps or [1])), (F.pmod(F.col("user_id"), F.lit(max(1, len(steps)))) + 1).cast("int"))
    item = F.pmod(F.col("user_id") * PRIME + F.lit(seed * 31) + F.col("_at").cast("bigint") * step, F.lit(n_items))
    left = walk.select("user_id", "_at", item.alias("item_id")).join(urm.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy("_at"))).filter(F.col("rank") <= n).select("user_id", "item_id", "rank")


def negatives(urm: DataFrame, users: DataFrame, n_items: int, n: int, seed: int = 0) -> DataFrame:
    """Up to n items that a user has no interaction with, for each user: user_id, item_id."""
    return walked(urm, users, n_items, n, seed).drop("rank")


def with_negatives(split: DataFrame, n_items: int, per_positive: int, seed: int = 0) -> DataFrame:
    """Negatives of the users with test interactions, per_positive for each of them: user_id, item_id."""
    wanted = split.filter("split = 'test'").groupBy("user_id").agg((F.count("*") * per_positive).alias("_want"))
    most = wanted.agg(F.max("_want").alias("m")).first()["m"] or 0
    return walked(split, wanted, n_items, most, seed).join(wanted, "user_id").filter(F.col("rank") <= F.col("_want")).select("user_id", "item_id")


def two_level(urm: DataFrame, train_share: float = 0.8, kept_share: float = 0.9, seed: int = 0) -> DataFrame:
    """User-wise train_share to train, the rest to test; of train, user-wise again, kept_share stays and the rest is
    validation."""
    first = user_percentage(urm, train_share, seed)
    second = user_percentage(first.filter("split = 'train'").drop("split"), kept_share, seed + 1)
    second = second.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise(F.col("split")))
    return second.unionByName(first.filter("split = 'test'"))


def drop_overlap(neg: DataFrame, pos: DataFrame) -> DataFrame:
    return neg.join(pos.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
