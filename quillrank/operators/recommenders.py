"""Recommenders whose fit is a relational plan; each returns a model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import hybrid, prep, similarity, splits, walks, weighting


def top_pop(urm: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, score: number of interactions."""
    return items.join(urm.groupBy("item_id").agg(F.count("*").alias("score")), "item_id", "left").select("item_id", F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def global_effects(urm: DataFrame, lambda_item: float = 25.0, lambda_user: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """mu; item_id, score (the item's bias, which alone ranks); user_id, bias."""
    mu = urm.agg(F.avg("rating").alias("mu"))
    centred = urm.join(F.broadcast(mu)).withColumn("d", F.col("rating") - F.col("mu"))  # one row
    item = centred.groupBy("item_id").agg((F.sum("d") / (F.count("*") + lambda_item)).alias("score"))
    user = centred.join(item, "item_id").groupBy("user_id").agg((F.sum(F.col("d") - F.col("score")) / (F.count("*") + lambda_user)).alias("bias"))
    return mu, item, user


def random_lists(seen: DataFrame, users: DataFrame, n_items: int, n: int, seed: int = 42) -> DataFrame:
    """user_id, rank, item_id: each user's first n unseen items in an order of the whole catalogue that is the user's own,
    as scores drawn for every pair would give, but without every pair."""
    return splits.walked(seen, users, n_items, n, seed).select("user_id", "rank", "item_id")


def _by_item(urm: DataFrame) -> DataFrame:
    return urm.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))


def _by_user(urm: DataFrame) -> DataFrame:
    return urm.select(F.col("item_id").alias("row"), F.col("user_id").alias("col"), F.col("rating").alias("value"))


def item_knn_cf(urm: DataFrame, n_items: int, k: int = 50, shrink: float = 100, kind: str = "cosine", normalise: bool = True, feature_weighting: str = "none", **how) -> tuple[DataFrame, DataFrame]:
    """The weights, and the profile to score with (weighted as the fit saw it; items are the documents)."""
    p = weighting.weighted(urm, feature_weighting, n_items, "item_id", "user_id", "rating").filter("rating <> 0").select("user_id", "item_id", "rating")
    return similarity.similarity(_by_item(p), kind, k, shrink, normalise, **how), p


def user_knn_cf(urm: DataFrame, n_users: int, k: int = 50, shrink: float = 100, kind: str = "cosine", normalise: bool = True, feature_weighting: str = "none", **how) -> tuple[DataFrame, DataFrame]:
    p = weighting.weighted(urm, feature_weighting, n_users, "user_id", "item_id", "rating").filter("rating <> 0").select("user_id", "item_id", "rating")
    return similarity.similarity(_by_user(p), kind, k, shrink, normalise, **how), p


def knn_cbf(features: DataFrame, n: int, k: int = 50, shrink: float = 100, kind: str = "cosine", normalise: bool = True, feature_weighting: str = "none", **how) -> DataFrame:
    """Weights between ids by their features (id, feature, value). Features that many ids share are multiplied in blocks."""
    f = weighting.weighted(features, feature_weighting, n, "id", "feature", "value").filter("value <> 0")
    return similarity.similarity(f.select(F.col("feature").alias("row"), F.col("id").alias("col"), "value"), kind, k, shrink, normalise, **{"dense": True} | how)


def item_knn_hybrid(urm: DataFrame, icm: DataFrame, n_items: int, icm_weight: float = 1.0, **how) -> DataFrame:
    return _hybrid(icm.select(F.col("item_id").alias("id"), "feature", "value"), icm_weight, urm.select(F.col("item_id").alias("id"), F.col("user_id").alias("feature"), F.col("rating").alias("value")), n_items, how)


def user_knn_hybrid(urm: DataFrame, ucm: DataFrame, n_users: int, ucm_weight: float = 1.0, **how) -> DataFrame:
    return _hybrid(ucm.select(F.col("user_id").alias("id"), "feature", "value"), ucm_weight, urm.select(F.col("user_id").alias("id"), F.col("item_id").alias("feature"), F.col("rating").alias("value")), n_users, how)


def _hybrid(content: DataFrame, weight: float, shared: DataFrame, n: int, how: dict) -> DataFrame:
    """Plain cosines of whole-numbered ids without negative values go by classes of equal content (hybrid.py), all else by
    knn_cbf() over both side by side."""
    plain = {"kind": "cosine", "normalise": True, "feature_weighting": "none", "k": 50, "shrink": 100} | how
    if len(plain) == 5 and plain["k"] is not None and (plain["kind"], plain["normalise"], plain["feature_weighting"]) == ("cosine", True, "none") and all(dict(m.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") for m in (content, shared)):
        w = hybrid.cosines(content.withColumn("value", F.col("value") * weight), shared, plain["k"], plain["shrink"])
        if w is not None:
            return w
    return knn_cbf(weighting.side_by_side(content, weight, shared), n, **how)


def custom_similarity(w: DataFrame, k: int | None = None) -> DataFrame:
    """A given table src, dst, weight, limited to the k heaviest src of each dst."""
    return w if k is None else prep.top_k(w, k, "dst", "weight", "src")


def p3alpha(urm: DataFrame, k: int = 100, alpha: float = 1.0, min_rating: float = 0.0, implicit: bool = False, normalise: bool = False, beta: float | None = None) -> DataFrame:
    """Random walk item - user - item: transition probabilities to the power alpha, zero diagonal, the k heaviest dst of
    each src; with beta, dst is discounted by degree^-beta (RP3beta); optionally rows scaled to sum 1; then the k heaviest src of
    each dst. Whole-numbered ids meet their products in blocks (walks.py), others in a join."""
    if _whole(urm):
        s = walks.steps(urm, alpha, min_rating, implicit, beta)
        w = walks.columns(s, walks.row_ends(s, k, normalise), k, True)
        return w.select(*(F.col(c).cast(dict(urm.dtypes)["item_id"]).alias(c) for c in ("src", "dst")), "weight")
    if min_rating > 0:
        urm = urm.filter(F.col("rating") >= min_rating)
        urm = prep.binarised(urm) if implicit else urm
    pui = weighting.normalised(urm.select("user_id", "item_id", "rating"), "user_id", "rating", "l1").select("user_id", F.col("item_id").alias("dst"), F.pow("rating", F.lit(alpha)).alias("p"))
    piu = weighting.normalised(prep.binarised(urm).select("user_id", "item_id", "rating"), "item_id", "rating", "l1").select("user_id", F.col("item_id").alias("src"), F.pow("rating", F.lit(alpha)).alias("q"))
    w = piu.join(pui, "user_id").filter("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("weight"))
    if beta is not None:
        degree = urm.groupBy(F.col("item_id").alias("dst")).agg(F.pow(F.count("*").cast("double"), F.lit(-beta)).alias("_d"))
        w = w.join(degree, "dst").select("src", "dst", (F.col("weight") * F.col("_d")).alias("weight"))
    w = prep.top_k(w, k, "src", "weight", "dst")
    if normalise:
        w = weighting.normalised(w, "src", "weight", "l1").select("src", "dst", "weight")
    return prep.top_k(w, k, "dst", "weight", "src")


def p3alpha_lists(urm: DataFrame, users: DataFrame, n_items: int, n: int, k: int = 100, alpha: float = 1.0, min_rating: float = 0.0, implicit: bool = False, normalise: bool = False, beta: float | None = None) -> DataFrame:
    """user_id, rank, item_id, score: ranking.top_n_weighted() of the profiles over p3alpha()'s weights, which are never written
    (up to k an item). Whole-numbered ids only."""
    return walks.lists(walks.steps(urm, alpha, min_rating, implicit, beta), k, normalise, urm, users, n_items, n, urm)


def _whole(urm: DataFrame) -> bool:
    return all(dict(urm.dtypes)[c] in ("tinyint", "smallint", "int", "bigint") for c in ("user_id", "item_id"))
