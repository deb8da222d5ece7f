"""Ranking metrics as associative aggregates.

recs: user_id, rank (1..), item_id; test: user_id, item_id, rating. A user is evaluated if they have min_test test items
or more and aren't ignored. Metrics are computed for several cutoffs from one ranking; results are long: cutoff, metric,
value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.prep import rank_weighted_sum

#: The names of the metrics, in reporting order.
METRICS = "ROC_AUC PRECISION PRECISION_RECALL_MIN_DEN RECALL MAP MRR NDCG F1 HIT_RATE ARHR NOVELTY AVERAGE_POPULARITY DIVERSITY_MEAN_INTER_LIST DIVERSITY_HERFINDAHL COVERAGE_ITEM COVERAGE_USER DIVERSITY_GINI SHANNON_ENTROPY DIVERSITY_SIMILARITY".split()


def eligible(test: DataFrame, min_test: int = 1, ignore_users: DataFrame | None = None, ignore_items: DataFrame | None = None) -> DataFrame:
    """user_id of users to evaluate. Ignored items don't count here; they still count as relevant (as documented)."""
    t = test if ignore_items is None else test.join(ignore_items.select("item_id"), "item_id", "left_anti")
    u = t.groupBy("user_id").count().filter(F.col("count") >= min_test).select("user_id")
    return u if ignore_users is None else u.join(ignore_users.select("user_id"), "user_id", "left_anti")


def at_cutoffs(recs: DataFrame, cutoffs: list[int]) -> DataFrame:
    """One copy of a list for each cutoff that it reaches into."""
    cuts = F.array(*[F.lit(c) for c in cutoffs])
    return recs.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: c >= F.col("rank"))))


def per_user(recs: DataFrame, test: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """cutoff, user_id and the parts of every accuracy metric; users without a list have zeros."""
    ideal = test.withColumn("_r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("rating"), "item_id")))
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    relevant = ideal.groupBy("user_id").agg(F.count("*").alias("n_test"), F.sum(gain(F.col("rating")) / F.log(F.col("_r") + 1)).alias("idcg"))
    marked = recs.join(users, "user_id", "left_semi").join(test.select("user_id", "item_id", F.col("rating").alias("rel")), ["user_id", "item_id"], "left")
    w = W.partitionBy("user_id").orderBy("rank")
    marked = marked.withColumn("hit", F.col("rel").isNotNull().cast("int")).withColumn("hits", F.sum("hit").over(w))
    cut = at_cutoffs(marked.select("user_id", "rank", "rel", "hit", "hits"), cutoffs)
    hit = F.col("hit") == 1
    got = cut.groupBy("cutoff", "user_id").agg(
        F.count("*").alias("length"),
        F.sum("hit").alias("n_hits"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("prec_sum"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(hit, 1 / F.col("rank")).otherwise(0.0)).alias("arhr"),
        F.sum(F.when(hit, gain(F.col("rel")) / F.log(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(~hit, F.col("hits")).otherwise(0)).alias("pairs_won"),
    )
    grid = users.select("user_id", F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff")).join(relevant, "user_id")
    zero = {c: 0 for c in ("length", "n_hits", "prec_sum", "arhr", "dcg", "pairs_won")}
    return grid.join(got, ["cutoff", "user_id"], "left").na.fill(zero)


def accuracy_columns() -> dict[str, Column]:
    """Of a row of per_user()."""
    n, hits, rel = F.col("length"), F.col("n_hits"), F.col("n_test")
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    misses = n - hits
    return {
        "ROC_AUC": F.when(misses == 0, F.when(n == 0, 0.0).otherwise(1.0)).when(hits == 0, 0.0).otherwise(F.col("pairs_won") / (hits * misses)),
        "PRECISION": safe(hits, n),
        "PRECISION_RECALL_MIN_DEN": safe(hits, F.least(rel, n)),
        "RECALL": safe(hits, rel),
        "MAP": safe(F.col("prec_sum"), F.least(rel, n)),
        "MRR": F.coalesce(1 / F.col("first_hit"), F.lit(0.0)),
        "NDCG": safe(F.col("dcg"), F.col("idcg")),
        "HIT_RATE": hits.cast("double"),
        "ARHR": F.col("arhr"),
    }


def accuracy(recs: DataFrame, test: DataFrame, users: DataFrame, cutoffs: list[int]) -> DataFrame:
    """cutoff and one column for each accuracy metric, means over users; F1 of the mean precision and recall."""
    cols = accuracy_columns()
    got = per_user(recs, test, users, cutoffs).groupBy("cutoff").agg(F.count("*").alias("n_users"), *[F.avg(c).alias(k) for k, c in cols.items()])
    p, r = F.col("PRECISION"), F.col("RECALL")
    return got.withColumn("F1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def recommended_counts(recs: DataFrame, items: DataFrame, cutoffs: list[int], ignore_items: DataFrame | None = None) -> DataFrame:
    """cutoff, item_id, n: lists that hold an item, for every item that isn't ignored."""
    dim = items if ignore_items is None else items.join(ignore_items.select("item_id"), "item_id", "left_anti")
    grid = dim.select("item_id", F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"))
    c = at_cutoffs(recs, cutoffs).groupBy("cutoff", "item_id").agg(F.count("*").alias("n"))
    return grid.join(c, ["cutoff", "item_id"], "left").na.fill(0, ["n"])


def beyond_accuracy(recs: DataFrame, train: DataFrame, items: DataFrame, users: DataFrame, n_users_total: int, cutoffs: list[int], ignore_items: DataFrame | None = None, n_ignored_users: int = 0) -> DataFrame:
    """cutoff and one column for each metric of novelty, diversity and coverage."""
    counts = recommended_counts(recs, items, cutoffs, ignore_items)
    n_items = items.count()
    parts = []
    for c in cutoffs:
        own = counts.filter(F.col("cutoff") == c)
        total = own.agg(F.sum("n").alias("t"))
        dist = own.join(F.broadcast(total)).agg(  # one row
            F.lit(c).alias("cutoff"),
            F.avg((F.col("n") > 0).cast("double")).alias("COVERAGE_ITEM"),
            (1 - F.sum(F.pow(F.col("n") / F.col("t"), F.lit(2.0)))).alias("DIVERSITY_HERFINDAHL"),
            (-F.sum(F.when(F.col("n") > 0, F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t"))).otherwise(0.0))).alias("SHANNON_ENTROPY"),
            F.sum(F.pow(F.col("n").cast("double"), F.lit(2.0))).alias("_sq"),
        )
        r = rank_weighted_sum(own, "n")
        gini = r.select((2 * ((F.col("n") + 1) * F.col("total") - F.col("weighted")) / (F.col("n") + 1) / F.col("total")).alias("DIVERSITY_GINI"))
        parts.append(dist.join(gini))
    dist = parts[0]
    for p in parts[1:]:
        dist = dist.unionByName(p)
    pop = train.groupBy("item_id").agg(F.count("*").alias("pop"))
    stats = pop.agg(F.sum("pop").alias("nnz"), F.max("pop").alias("top"))
    rows = at_cutoffs(recs.join(users, "user_id", "left_semi"), cutoffs).join(pop, "item_id", "left").join(F.broadcast(stats))  # one row
    each = rows.groupBy("cutoff", "user_id").agg(
        (F.sum(F.when(F.col("pop").isNull(), 0.0).otherwise(-F.log2(F.col("pop") / F.col("nnz")))) / n_items).alias("nov"),
        F.avg(F.coalesce("pop", F.lit(0)) / F.col("top")).alias("avgpop"),
    )
    n_eval = users.count()
    means = each.groupBy("cutoff").agg((F.sum("nov") / n_eval).alias("NOVELTY"), (F.sum("avgpop") / n_eval).alias("AVERAGE_POPULARITY"), F.count("*").alias("_listed"))
    u = F.lit(float(n_eval))
    inter = F.when(u == 0, 1.0).otherwise((u * u - u - (F.col("_sq") / F.col("cutoff") - u)) / (u * u - u))
    out = dist.join(means, "cutoff").withColumn("DIVERSITY_MEAN_INTER_LIST", inter).withColumn("COVERAGE_USER", F.col("_listed") / float(max(1, n_users_total - n_ignored_users)))
    return out.drop("_sq", "_listed")


def correct_coverage(recs: DataFrame, test: DataFrame, items: DataFrame, n_users: int, cutoffs: list[int]) -> DataFrame:
    """cutoff, COVERAGE_TEST_CORRECT (items that are a hit somewhere) and COVERAGE_USER_CORRECT (users with a hit)."""
    hits = at_cutoffs(recs.join(test.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"), cutoffs)
    return hits.groupBy("cutoff").agg((F.count_distinct("item_id") / items.count()).alias("COVERAGE_TEST_CORRECT"), (F.count_distinct("user_id") / n_users).alias("COVERAGE_USER_CORRECT"))


def similarity_diversity(recs: DataFrame, w: DataFrame, cutoff: int) -> DataFrame:
    """DIVERSITY_SIMILARITY: over users, 1 - similarity summed for all items of a list but the last against the others,
    divided by n (n - 1). w: src, dst, weight; a missing pair is 0. Lists of one item give null."""
    top = recs.filter(F.col("rank") <= cutoff).select("user_id", "rank", "item_id")
    n = top.groupBy("user_id").agg(F.count("*").alias("n"))
    a = top.join(n, "user_id").filter(F.col("rank") < F.col("n"))
    b = top.select("user_id", F.col("item_id").alias("dst"), F.col("rank").alias("rank_b"))
    pairs = a.join(b, "user_id").filter("rank <> rank_b").join(w.withColumnRenamed("src", "item_id"), ["item_id", "dst"], "left")
    each = pairs.groupBy("user_id", "n").agg(F.sum(1 - F.coalesce("weight", F.lit(0.0))).alias("s"))
    return each.agg(F.avg(F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("DIVERSITY_SIMILARITY"))


def rmse(predicted: DataFrame, test: DataFrame, least: float, most: float) -> DataFrame:
    """Predictions (user_id, item_id, score) are clipped to the ratings' range."""
    p = F.least(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(least)), F.lit(most))
    return test.join(predicted.select("user_id", "item_id", "score"), ["user_id", "item_id"], "left").agg(F.sqrt(F.avg(F.pow(F.col("rating") - p, F.lit(2.0)))).alias("RMSE"))


def binary_ndcg(recs: DataFrame, test: DataFrame, cutoff: int) -> DataFrame:
    """Of users with one test item: HR (a hit within the cutoff) and NDCG ln 2 / ln(rank + 1), as means."""
    hit = recs.filter(F.col("rank") <= cutoff).join(test.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").agg(F.min("rank").alias("r"))
    all_ = test.select("user_id").distinct().join(hit, "user_id", "left")
    return all_.agg(F.avg(F.col("r").isNotNull().cast("double")).alias("HR"), F.avg(F.coalesce(F.log(F.lit(2.0)) / F.log(F.col("r") + 1), F.lit(0.0))).alias("NDCG"))


def truncated(recs: DataFrame, test: DataFrame, users: DataFrame, cutoff: int) -> DataFrame:
    """Means of recall / min(cutoff, relevant) and of binary NDCG whose ideal is truncated at the cutoff."""
    rel = test.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.least(F.count("*"), F.lit(cutoff)).alias("m"))
    hit = recs.filter(F.col("rank") <= cutoff).join(test.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    j = rel.join(hit, "user_id", "left")
    return j.agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("m")).alias("RECALL_MIN"), F.avg(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("NDCG_TRUNCATED"))


def recall_of_all(recs: DataFrame, train: DataFrame, test: DataFrame, cutoff: int) -> DataFrame:
    """Recall that counts train and test interactions as relevant."""
    rel = train.select("user_id", "item_id").union(test.select("user_id", "item_id")).distinct()
    n = rel.groupBy("user_id").agg(F.count("*").alias("n")).join(test.select("user_id").distinct(), "user_id", "left_semi")
    hit = recs.filter(F.col("rank") <= cutoff).join(rel, ["user_id", "item_id"], "left_semi").groupBy("user_id").agg(F.count("*").alias("h"))
    return n.join(hit, "user_id", "left").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("RECALL_ALL"))


def long_form(wide: DataFrame) -> DataFrame:
    """cutoff, metric, value."""
    names = [c for c in wide.columns if c in METRICS]
    return wide.select("cutoff", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric", "value"))


def result_string(wide: DataFrame) -> str:
    """CUTOFF: k - NAME: value, ... one line for each cutoff (a handful of rows)."""
    lines = []
    for r in wide.orderBy("cutoff").collect():
        lines.append(f"CUTOFF: {r['cutoff']} - " + ", ".join(f"{m}: {r[m]:.7f}" for m in METRICS if m in r.asDict() and r[m] is not None))
    return "\n".join(lines) + "\n"
