"""Scoring and top-N ranking.

Lists rank all candidate items by score, then item id. An item without a score counts as 0 and may be recommended. Users
never meet all items: a user's scored items are few, and the zeros that fill a list up are the least item ids that are
neither seen nor scored, of which the first N + |seen| + |scored| ids always hold enough.

Factor models rank every item: items with their factors go to the tasks in blocks of bounded size, a block's items in boxes of
similar factors. A task scores groups of similar users by the boxes whose bound (the greatest score that a point of the box
could have) reaches the N best found so far; the rest can't be listed. Only each user's N best of a block leave a task. A weight matrix scores what a user's profile leads to:
those weights go to the user's task (products.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillrank.operators.products import PASS_ENTRIES, block_products
from quillrank.runtime import materialise, ship

#: Numbers of an item block (8 bytes each) and of the scores that a task holds at once.
BLOCK_CELLS, SCORE_CELLS = 4_000_000, 4_000_000
#: Items of a box, users of a group.
BOX, GROUP = 64, 128
#: Digits by which scores are compared: products may add in another order.
DIGITS = 9


def item_scores(profile: DataFrame, w: DataFrame) -> DataFrame:
    """user_id, item_id, score = sum of rating(user, src) * weight(src, item)."""
    x = profile.select("user_id", F.col("item_id").alias("src"), "rating")
    return x.join(w, "src").groupBy("user_id", F.col("dst").alias("item_id")).agg(F.sum(F.col("rating") * F.col("weight")).alias("score"))


def user_scores(profile: DataFrame, w: DataFrame) -> DataFrame:
    """user_id, item_id, score = sum over neighbours v of weight(user, v) * rating(v, item). W[u] holds the weights in
    the row of u: src is u."""
    x = profile.select(F.col("user_id").alias("dst"), "item_id", "rating")
    return w.join(x, "dst").groupBy(F.col("src").alias("user_id"), "item_id").agg(F.sum(F.col("rating") * F.col("weight")).alias("score"))


def factor_scores(users: DataFrame, items: DataFrame, candidates: DataFrame, mu: float = 0.0) -> DataFrame:
    """users, items: id, factors, bias. Scores of the candidate pairs (user_id, item_id)."""
    u = users.select(F.col("id").alias("user_id"), F.col("factors").alias("fu"), F.col("bias").alias("bu"))
    i = items.select(F.col("id").alias("item_id"), F.col("factors").alias("fi"), F.col("bias").alias("bi"))
    dot = F.aggregate(F.zip_with("fu", "fi", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return candidates.join(u, "user_id").join(i, "item_id").select("user_id", "item_id", (dot + F.col("bu") + F.col("bi") + mu).alias("score"))


def item_blocks(items: DataFrame, width: int, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids in order, factors and biases of one part of the items after another, each of about cells numbers."""
    held = materialise(items.select("id", "factors", "bias"), "items")
    n = max(1, -(-held.count() * (width + 2) // cells))
    for k in range(n):
        part = held if n == 1 else held.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        got = part.toArrow().sort_by("id")
        if got.num_rows:
            factors = got["factors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, width)
            yield got["id"].to_numpy(), factors.astype(np.float64), got["bias"].to_numpy().astype(np.float64)


def best_of(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n largest of each row (ties: least column); -inf never counts."""
    rows, cols = [], []
    at = scores.shape[1] - n
    least = np.partition(scores, at, axis=1)[:, at] if at > 0 else np.full(len(scores), -np.inf)
    for r, (x, low) in enumerate(zip(scores, least, strict=True)):
        c = np.flatnonzero((x >= low) & (x > -np.inf))
        if len(c) > n:
            c = c[np.argsort(-x[c], kind="stable")[:n]]
        rows.append(np.full(len(c), r))
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def in_cells(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of x's rows and the starts in it of cells of at most `most` similar rows (halved at the widest column)."""
    order, todo, starts = np.arange(len(x)), [(0, len(x))], []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            starts.append(a)
            continue
        part = x[order[a:b]]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(np.ptp(part, axis=0))], half)]
        todo += [(a, a + half), (a + half, b)]
    return order, np.sort(np.array(starts, np.int64))


def boxed(ids: np.ndarray, v: np.ndarray, bias: np.ndarray) -> dict:
    """Items (ids in order) box by box, with the bounds of each box."""
    order, starts = in_cells(np.column_stack((v, bias)), BOX)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    got = {"known": ids, "place": place, "ids": ids[order], "v": v[order], "bias": bias[order], "ends": np.append(starts, len(ids))}
    bounds = {"low": np.minimum.reduceat(got["v"], starts), "high": np.maximum.reduceat(got["v"], starts), "most": np.maximum.reduceat(got["bias"], starts), "least": np.minimum.reduceat(got["ids"], starts)}
    return got | bounds


def best_in_boxes(b: dict, u: np.ndarray, bias: np.ndarray, seen: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item id and rounded score of each row's n best items outside its seen ones (ties: least id)."""
    out = []
    at = np.minimum(np.searchsorted(b["known"], seen), len(b["known"]) - 1)
    at = np.where(b["known"][at] == seen, b["place"][at], -1)
    col = np.full(len(b["ids"]) + 1, -1)  # place of an item among those scored; the last is for -1
    norm = np.sqrt((u * u).sum(1))
    order, starts = in_cells(u / np.where(norm > 0, norm, 1)[:, None], GROUP)

    def scores(rows, items):
        s = np.round(u[rows] @ b["v"][items].T + bias[rows][:, None] + b["bias"][items], DIGITS) + 0.0
        many = ends[rows + 1] - ends[rows]
        hidden = at[np.repeat(ends[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        col[items] = np.arange(len(items))
        c = col[hidden]
        s[np.repeat(np.arange(len(rows)), many)[c >= 0], c[c >= 0]] = -np.inf
        col[items] = -1
        return s

    for rows in np.split(order, starts[1:]):
        up, down = np.maximum(u[rows], 0), np.minimum(u[rows], 0)
        bound = up @ b["high"].T + down @ b["low"].T + b["most"] + bias[rows][:, None]
        size = np.abs(u[rows]) @ np.maximum(np.abs(b["high"]), np.abs(b["low"])).max(0) + np.abs(bias[rows]) + np.abs(b["bias"]).max()
        bound = np.round(bound + 1e-12 * size[:, None], DIGITS)
        best, item = np.full((len(rows), n), -np.inf), np.full((len(rows), n), -1)
        # the least ids bound what can be listed if many scores are equal; their boxes come in their turn
        head = b["place"][: n + min(100, int((ends[rows + 1] - ends[rows]).max()))]
        first = scores(rows, head)
        floor, last = np.full(len(rows), -np.inf), np.full(len(rows), -1)
        if len(head) >= n:
            floor = np.partition(first, len(head) - n, axis=1)[:, len(head) - n]
            last = np.where(floor > -np.inf, b["ids"][head].max(), -1)
        boxes, many = np.arange(len(b["least"])), 8
        while True:
            need = (bound > floor[:, None]) | ((bound == floor[:, None]) & (b["least"][boxes] <= last[:, None]))
            some = np.flatnonzero(need.any(0))
            if not len(some):
                break
            need, bound, boxes = need[:, some], bound[:, some], boxes[some]
            gain = np.where(need, bound, -np.inf).max(0)
            take = min(len(boxes), many, max(1, SCORE_CELLS // (BOX * len(rows))))
            now = np.argpartition(-gain, take - 1)[:take]
            who = np.flatnonzero(need[:, now].any(1))
            items = np.concatenate([np.arange(b["ends"][x], b["ends"][x + 1]) for x in boxes[now]])
            s = np.concatenate((best[who], scores(rows[who], items)), axis=1)
            named = np.concatenate((item[who], np.broadcast_to(b["ids"][items], (len(who), len(items)))), axis=1)
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            keep = (s > least[:, None]) | ((s == least[:, None]) & (s > -np.inf))
            exact = keep.sum(1) == n
            r, c = np.nonzero(keep & exact[:, None])
            best[who[exact]], item[who[exact]] = s[r, c].reshape(-1, n), named[r, c].reshape(-1, n)
            for r in np.flatnonzero(~exact):
                c = np.flatnonzero(keep[r])
                c = c[np.lexsort((named[r, c], -s[r, c]))[:n]]
                best[who[r]], item[who[r]] = -np.inf, -1
                best[who[r], : len(c)], item[who[r], : len(c)] = s[r, c], named[r, c]
            low = best.min(1)
            end = np.where(best == low[:, None], item, -1).max(1)
            better = (low > floor) | ((low == floor) & (low > -np.inf) & (end < last))
            floor, last = np.where(better, low, floor), np.where(better, end, last)
            left = np.ones(len(boxes), bool)
            left[now] = False
            bound, boxes, many = bound[:, left], boxes[left], 2 * many
        r, c = np.nonzero(best > -np.inf)
        out.append((rows[r], item[r, c], best[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_n_factors(users: DataFrame, items: DataFrame, n: int, seen: DataFrame | None = None, mu: float = 0.0, cells: int = BLOCK_CELLS) -> DataFrame:
    """user_id, rank, item_id, score: for each of users (id, factors, bias) the n best of items (id, factors, bias) outside
    seen. Scores are rounded to DIGITS digits. The items' blocks are one pass over the users each; a block's result is
    written before the next block is sent."""
    spark = users.sparkSession
    own = users.select(F.col("id").alias("user_id"), "factors", "bias")
    if seen is None:
        rows = own.withColumn("seen", F.lit(None).cast("array<bigint>"))
    else:
        lists = seen.groupBy("user_id").agg(F.collect_set(F.col("item_id").cast("bigint")).alias("seen"))
        rows = own.join(lists, "user_id", "left")
    first = rows.select(F.size("factors").alias("k")).first()
    if first is None:
        return own.limit(0).select("user_id", F.lit(1).alias("rank"), F.col("user_id").alias("item_id"), F.lit(0.0).alias("score"))
    rows, out = materialise(rows, "profiles"), None
    kind = dict(rows.dtypes)["user_id"]
    ship(spark)
    for block in item_blocks(items, first["k"], cells):
        held = spark.sparkContext.broadcast(boxed(*block))

        def run(batches, held=held, width=first["k"]):
            for batch in batches:
                if batch.num_rows:
                    u = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                    gone = batch.column(3).fill_null([]) if batch.column(3).null_count else batch.column(3)
                    seen_items, ends = gone.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(gone.value_lengths().to_numpy(zero_copy_only=False))))
                    r, i, x = best_in_boxes(held.value, u, batch.column(2).to_numpy(zero_copy_only=False) + mu, seen_items, ends, n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(x)], names=["user_id", "item_id", "score"])

        found = materialise(rows.mapInArrow(run, f"user_id {kind}, item_id bigint, score double"), "lists")
        held.destroy()
        out = found if out is None else out.union(found)
    return ranked(out, n) if out is not None else ranked(own.limit(0).select("user_id", F.col("user_id").alias("item_id"), F.lit(0.0).alias("score")), n)


def numbered(users: DataFrame, seen: DataFrame | None):
    """For targets of block_products(): user_id of a table as a whole number `target`, only users'; those users with q 0 and
    their lists of seen items; and the way back from target, item_id, score."""
    ids = users.select("user_id").distinct()
    kind, numbers = dict(ids.dtypes)["user_id"], None
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        numbers = materialise(ids.select("user_id", F.monotonically_increasing_id().alias("target")), "numbers")
        named = lambda df: df.join(numbers, "user_id").drop("user_id")
    else:
        named = lambda df: df.join(ids.hint("shuffle_hash"), "user_id", "left_semi").withColumnRenamed("user_id", "target")
    own = named(ids).withColumn("q", F.lit(0.0))
    if seen is None:
        own = own.withColumn("seen", F.lit(None).cast("array<bigint>"))
    else:
        own = own.join(named(seen.select("user_id", "item_id")).groupBy("target").agg(F.collect_set(F.col("item_id").cast("bigint")).alias("seen")), "target", "left")

    def back(out):
        out = out.join(numbers, "target").drop("target") if numbers is not None else out.withColumnRenamed("target", "user_id")
        return out.select(F.col("user_id").cast(kind).alias("user_id"), "item_id", "score")

    return named, own, back


def listed(n_items: int, n: int):
    """finish() of block_products() for top_n_weighted(): the n best of each target by score, zeros included."""

    def finish(ids, q, seen, d, s, sq, dot):
        score = np.round(dot, DIGITS) + 0.0
        some = np.flatnonzero((score != 0) & (s >= 0) & (s < n_items))
        d, s, score = d[some], s[some], score[some]
        gone, many = seen.flatten().to_numpy(zero_copy_only=False), seen.value_lengths().to_numpy(zero_copy_only=False)
        bounds, upto = np.searchsorted(d, np.arange(len(ids) + 1)), np.cumsum(many)
        at, item, value = [], [], []
        for u in range(len(ids)):
            c, x, hidden = s[bounds[u] : bounds[u + 1]], score[bounds[u] : bounds[u + 1]], gone[upto[u] - many[u] : upto[u]]
            taken = c
            if len(hidden) and len(c):
                at_hidden = np.minimum(np.searchsorted(c, hidden), len(c) - 1)  # products come in the order of their columns
                free = np.ones(len(c), bool)
                free[at_hidden[c[at_hidden] == hidden]] = False
                c, x = c[free], x[free]
            if np.count_nonzero(x > 0) < n:  # zeros fill up, above what is negative
                zeros = np.ones(min(n_items, n + len(taken) + len(hidden)), bool)
                zeros[taken[taken < len(zeros)]] = False
                zeros[hidden[(hidden >= 0) & (hidden < len(zeros))]] = False
                zeros = np.flatnonzero(zeros)[:n]
                c, x = np.concatenate((c, zeros)), np.concatenate((x, np.zeros(len(zeros))))
            elif len(x) > n:
                best = x >= np.partition(x, len(x) - n)[len(x) - n]
                c, x = c[best], x[best]
            o = np.lexsort((c, -x))[:n]
            at.append(np.full(len(o), u))
            item.append(c[o])
            value.append(x[o])
        return pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(at)]), pa.array(np.concatenate(item), pa.int64()), pa.array(np.concatenate(value))], names=["target", "item_id", "score"])

    return finish


def top_n_weighted(profile: DataFrame, w: DataFrame, users: DataFrame, n_items: int, n: int, seen: DataFrame | None = None, entries: int = PASS_ENTRIES) -> DataFrame:
    """user_id, rank, item_id, score for each of users: the n best of items 0..n_items-1 outside seen by the sum of
    rating(user, src) * weight(src, item) over the profile (user_id, item_id as src, rating); items without a score count as
    0. Scores are rounded to DIGITS digits. A task sums all scores of some users from the weights that their profiles name
    (products.py; entries: weights that a pass ships) and only each user's n best leave it."""
    spark, (named, own, back) = users.sparkSession, numbered(users, seen)
    left = named(profile.select("user_id", "item_id", "rating")).select("target", F.col("item_id").alias("via"), F.col("rating").alias("x"))
    right = w.filter((F.col("dst") >= 0) & (F.col("dst") < n_items)).select(F.col("src").alias("via"), F.col("dst").alias("col"), F.col("weight").alias("y"), F.lit(0.0).alias("q"))
    out = block_products(left, right, own, listed(n_items, n), "target bigint, item_id bigint, score double", "lists", entries)
    if out is None:
        out = spark.createDataFrame([], "target bigint, item_id bigint, score double")
    return ranked(back(out), n)


def neighbour_profiles(w: DataFrame) -> DataFrame:
    """A user similarity as profiles of neighbours, for top_n_weighted() with the ratings as weights."""
    return w.select(F.col("src").alias("user_id"), F.col("dst").alias("item_id"), F.col("weight").alias("rating"))


def rating_weights(ratings: DataFrame) -> DataFrame:
    return ratings.select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"), F.col("rating").alias("weight"))


def top_n(scores: DataFrame, seen: DataFrame | None, users: DataFrame, n_items: int, n: int, ignore: DataFrame | None = None, only: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """user_id, rank, item_id, score for each of users. Item ids are 0..n_items-1. seen: pairs to leave out; ignore:
    items to leave out; only: candidate pairs. Lists may be shorter than n."""
    s = scores.join(users.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id", F.col("score").cast("double").alias("score"))
    if only is not None:
        c = only.select("user_id", "item_id").distinct()
        s = c.join(users.select("user_id").distinct(), "user_id", "left_semi").join(s, ["user_id", "item_id"], "left").select("user_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"))
        fill = False
    out = seen.select("user_id", "item_id") if seen is not None else None
    if out is not None:
        s = s.join(out, ["user_id", "item_id"], "left_anti")
    if ignore is not None:
        s = s.join(ignore.select("item_id"), "item_id", "left_anti")
    if fill:
        taken = s.filter("score <> 0").select("user_id", "item_id")
        blocked = taken if out is None else taken.union(out)
        sizes = users.select("user_id").distinct().join(blocked.groupBy("user_id").agg(F.count("*").alias("_k")), "user_id", "left")
        positive = s.filter("score > 0").groupBy("user_id").agg(F.count("*").alias("_p"))
        sizes = sizes.join(positive, "user_id", "left").filter(F.coalesce("_p", F.lit(0)) < n)
        extra = ignore.count() if ignore is not None else 0
        last = F.least(F.lit(n_items), F.lit(n + extra) + F.coalesce("_k", F.lit(0))) - 1
        zeros = sizes.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("item_id")).join(blocked, ["user_id", "item_id"], "left_anti")
        if ignore is not None:
            zeros = zeros.join(ignore.select("item_id"), "item_id", "left_anti").select("user_id", "item_id")
        s = s.filter("score <> 0").union(zeros.withColumn("score", F.lit(0.0)))
    return ranked(s, n)


def ranked(scores: DataFrame, n: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    return scores.withColumn("rank", r).filter(F.col("rank") <= n).select("user_id", "rank", "item_id", "score")


def top_n_global(order: DataFrame, seen: DataFrame | None, users: DataFrame, n: int) -> DataFrame:
    """One list for all (item_id, score), without what each user has seen: of the first n + |seen| items the first n. The
    common list is numbered once by a sorted limit."""
    users = users.select("user_id").distinct()
    sizes = users.withColumn("_k", F.lit(0)) if seen is None else users.join(seen.groupBy("user_id").agg(F.count("*").alias("_k")), "user_id", "left").na.fill(0, ["_k"])
    most = n + (sizes.agg(F.max("_k").alias("m")).first()["m"] or 0)
    head = order.orderBy(F.desc("score"), "item_id").limit(most)  # n + the longest profile
    at = head.withColumn("_at", F.row_number().over(W.orderBy(F.desc("score"), "item_id")))
    walk = sizes.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(n) + F.col("_k"))).alias("_at")).join(at, "_at")
    if seen is not None:
        walk = walk.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return ranked(walk.select("user_id", "item_id", F.col("score").cast("double").alias("score")), n)
