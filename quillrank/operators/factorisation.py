"""Models that iterate: linear item models and matrix factorisation.

Users are the large side and stay distributed, one row of profiles each; items are the small side, whose parameters go to
the tasks and come back as sums or means per item. ITEM_CELLS bounds items * width (or items^2) before anything is sent; a
larger catalogue raises an error that names the distributed alternative (ALS, P3alpha, item KNN).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import prep, similarity, weighting
from quillrank.runtime import discard, materialise, ship
from quillrank.sources import store

#: Numbers of a dense item table that a task or the driver may hold (800 MB).
ITEM_CELLS = 100_000_000
EPS = 1e-12


def bounded(n_items: int, width: int, instead: str = "ALS") -> None:
    if n_items * width > ITEM_CELLS:
        raise ValueError(f"{n_items} items x {width} don't fit a task; use {instead}")


def profiles(urm: DataFrame) -> DataFrame:
    """user_id, items, ratings (in item order): a user's profile is at most the catalogue."""
    got = urm.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "rating"))).alias("p"))
    return got.select("user_id", F.col("p.item_id").alias("items"), F.col("p.rating").alias("ratings"))


def gram(urm: DataFrame, n_items: int) -> np.ndarray:
    """Dense item-item dot products."""
    bounded(n_items, n_items, "item KNN")
    m = urm.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))
    g = np.zeros((n_items, n_items))
    d = similarity.pair_dots(m).toPandas()
    g[d["i"], d["j"]] = g[d["j"], d["i"]] = d["dot"]
    q = similarity.squares(m).toPandas()
    g[q["col"], q["col"]] = q["q"]
    return g


def as_weights(spark, w: np.ndarray, k: int | None = None) -> DataFrame:
    """src, dst, weight of a dense matrix's non-zero entries; with k the heaviest src of each dst."""
    src, dst = np.nonzero(w)
    df = spark.createDataFrame(pd.DataFrame({"src": src.astype("int64"), "dst": dst.astype("int64"), "weight": w[src, dst].astype(float)}), "src long, dst long, weight double")
    return df if k is None else prep.top_k(df, k, "dst", "weight", "src")


def ease(urm: DataFrame, n_items: int, l2: float = 1e3, k: int | None = None, normalise: bool = False) -> DataFrame:
    """EASE: B = P / -diag P, P the inverse Gram matrix whose diagonal is the items' interaction counts plus l2. normalise:
    ratings are divided by their user's and then by their item's Euclidean norm."""
    if normalise:
        own = urm.select("user_id", "item_id", "rating")
        urm = materialise(weighting.normalised(weighting.normalised(own, "user_id", "rating", "l2"), "item_id", "rating", "l2"), "normalised")
    g = gram(urm, n_items)
    counts = urm.groupBy("item_id").agg(F.count("*").alias("n")).toPandas()
    diag = np.full(n_items, float(l2))
    diag[counts["item_id"]] += counts["n"]
    g[np.arange(n_items), np.arange(n_items)] = diag
    p = np.linalg.inv(g)
    b = p / -np.diag(p)
    np.fill_diagonal(b, 0)
    return as_weights(urm.sparkSession, b, k)


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def _rows(batch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _item_sums(df: DataFrame, fn: Callable, n_items: int, width: int, mean: bool = False) -> np.ndarray:
    """fn turns a task's rows, which it gets one after another, into an items x width array; those are summed (or averaged)
    over tasks per item."""

    def run(batches):
        rows = (r for b in batches for r in _rows(b))
        if (first := next(rows, None)) is not None:
            out = fn(chain((first,), rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_items)), pa.array(list(out), pa.list_(pa.float64()))], names=["i", "v"])

    parts = _mapped(df, run, "i long, v array<double>").select("i", F.posexplode("v").alias("k", "x"))
    agg = F.avg("x") if mean else F.sum("x")
    got = parts.groupBy("i", "k").agg(agg.alias("x")).toPandas()
    out = np.zeros((n_items, width))
    out[got["i"], got["k"]] = got["x"]
    return out


def pure_svd(urm: DataFrame, n_items: int, factors: int = 20, rounds: int = 6, seed: int = 42) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Truncated SVD by subspace iteration: user factors U*S (id, factors, bias 0), item factors V, singular values.
    A round is one pass: each user adds its rating-weighted projection to its items."""
    width = min(n_items, factors + 8)
    bounded(n_items, width)
    p = materialise(profiles(urm), "profiles")
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_items, width)))[0]
    values = np.zeros(width)
    for _ in range(rounds):
        held = urm.sparkSession.sparkContext.broadcast(v)

        def project(rows, held=held):
            q, out = held.value, np.zeros((n_items, width))
            for _, items, ratings in rows:
                r = np.array(ratings)
                out[items] += r[:, None] * (r @ q[items])
            return out

        z = _item_sums(p, project, n_items, width)
        held.destroy()
        v, r = np.linalg.qr(z)
        _, values, vt = np.linalg.svd(r @ r.T)
        values = values**0.25
    # Rayleigh-Ritz on the subspace
    held = urm.sparkSession.sparkContext.broadcast(v)

    def small(rows):
        q, out = held.value, np.zeros((width, width))
        for _, items, ratings in rows:
            y = np.array(ratings) @ q[items]
            out += np.outer(y, y)
        full = np.zeros((n_items, width))
        full[:width] = out
        return full

    e, vec = np.linalg.eigh(_item_sums(p, small, n_items, width)[:width])
    held.destroy()
    order = np.argsort(-e)[:factors]
    v, values = v @ vec[:, order], np.sqrt(np.maximum(e[order], 0))
    flip = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    v = v * np.where(flip == 0, 1, flip)
    return fold_in(p, v), v, values


def fold_in(p: DataFrame, v: np.ndarray, scale: bool = False) -> DataFrame:
    """User factors from profiles and item factors: sum of rating * v, over sqrt(profile) with scale."""
    held = p.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        for b in batches:
            q = held.value
            rows = _rows(b)
            f = [(np.array(r) @ q[i] / (np.sqrt(len(i)) if scale else 1.0)).tolist() for _, i, r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64())), pa.array(np.zeros(len(rows)))], names=["id", "factors", "bias"])

    return _mapped(p.select("user_id", "items", "ratings"), run, "id long, factors array<double>, bias double")


def item_table(spark, v: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "factors": [x.tolist() for x in v], "bias": np.zeros(len(v)) if bias is None else bias}), "id long, factors array<double>, bias double")


def item_similarity_of(spark, v: np.ndarray, k: int) -> DataFrame:
    """W = V V' with its diagonal, the k heaviest src of each dst, block by block of columns."""
    rows = []
    for at in range(0, len(v), 512):
        w = v @ v[at : at + 512].T
        top = np.argsort(-w, axis=0, kind="stable")[:k]
        for c in range(w.shape[1]):
            rows.append(pd.DataFrame({"src": top[:, c], "dst": at + c, "weight": w[top[:, c], c]}))
    return spark.createDataFrame(pd.concat(rows), "src long, dst long, weight double").filter("weight <> 0")


def implicit_als(urm: DataFrame, factors: int = 10, reg: float = 0.1, alpha: float = 1.0, epsilon: float | None = None, rounds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Implicit ALS: confidence 1 + alpha * r, or 1 + alpha * ln(1 + r / epsilon). User and item tables id, factors,
    bias; users and items without interactions have no row. Both sides stay distributed."""
    r = F.log(1 + F.col("rating") / epsilon) if epsilon else F.col("rating")
    data = urm.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), r.cast("float").alias("rating"))
    m = ALS(rank=factors, maxIter=rounds, regParam=reg, alpha=alpha, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="rating", seed=seed).fit(data)
    shape = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("factors"), F.lit(0.0).alias("bias"))
    return shape(m.userFactors), shape(m.itemFactors)


def nmf(urm: DataFrame, n_items: int, factors: int = 10, rounds: int = 15, seed: int = 42, loss: str = "frobenius") -> tuple[DataFrame, np.ndarray]:
    """Non-negative factors by multiplicative updates for the squared error ('frobenius') or the Kullback-Leibler divergence
    ('kullback-leibler'), without penalties: user table, item factors."""
    divergence = {"frobenius": False, "kullback-leibler": True}[loss]
    bounded(n_items, factors)
    spark = urm.sparkSession
    h = np.random.default_rng(seed).random((n_items, factors)) + 0.1
    state = profiles(urm).withColumn("w", F.transform(F.sequence(F.lit(1), F.lit(factors)), lambda k: F.pmod(F.xxhash64("user_id", k, F.lit(seed)), F.lit(1000)) / 1000.0 + 0.1))
    state = materialise(state, "nmf")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((h, h.sum(0) if divergence else h.T @ h))

        def update(batches, held=held):
            for b in batches:
                x, hh = held.value
                out = []
                for _, items, ratings, w in _rows(b):
                    w = np.array(w)
                    if divergence:
                        out.append((w * ((np.array(ratings) / (x[items] @ w + EPS)) @ x[items]) / (hh + EPS)).tolist())
                    else:
                        out.append((w * (np.array(ratings) @ x[items]) / (w @ hh + EPS)).tolist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["user_id", "items", "ratings", "w"])

        state = materialise(_mapped(state.select("user_id", "items", "ratings", "w"), update, "user_id long, items array<long>, ratings array<double>, w array<double>"), "nmf")

        tall = max(n_items, factors)

        def sums(rows, held=held):
            x, _ = held.value
            top, ww = np.zeros((tall, factors)), np.zeros((tall, factors))
            for _, items, ratings, w in rows:
                w = np.array(w)
                if divergence:
                    top[items] += np.outer(np.array(ratings) / (x[items] @ w + EPS), w)
                    ww[0] += w
                else:
                    top[items] += np.outer(ratings, w)
                    ww[:factors] += np.outer(w, w)
            return np.hstack((top, ww))

        both = _item_sums(state, sums, tall, 2 * factors)
        held.destroy()
        below = both[0, factors:] if divergence else h @ both[:factors, factors:]
        h = h * both[:n_items, :factors] / (below + EPS)
    return state.select(F.col("user_id").alias("id"), F.col("w").alias("factors"), F.lit(0.0).alias("bias")), h


def elastic_net_item(g: np.ndarray, item: int, l1: float, l2: float, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Non-negative elastic-net weights of the other items for one, by coordinate descent on the Gram matrix."""
    w, near = np.zeros(len(g)), g[item].copy()  # near: X'(y - Xw)
    use = [j for j in np.flatnonzero(g[item]) if j != item]
    scale = tol * max(g[item, item], EPS)
    for _ in range(rounds):
        most = 0.0
        for j in use:
            old = w[j]
            new = max(0.0, near[j] + g[j, j] * old - l1) / (g[j, j] + l2)
            if new != old:
                near -= g[j] * (new - old)
                w[j] = new
                most = max(most, (new - old) ** 2 * g[j, j])
        if most <= scale:
            break
    return w


def slim_elastic_net(urm: DataFrame, n_items: int, n_users: int, alpha: float = 1e-3, l1_ratio: float = 0.1, k: int = 100) -> DataFrame:
    """SLIM: items are dealt to tasks, each solved on the shared Gram matrix. Keeps the min(nnz - 1, k) largest weights,
    as documented."""
    g = gram(urm, n_items)
    held = urm.sparkSession.sparkContext.broadcast(g)
    l1, l2 = alpha * l1_ratio * n_users, alpha * (1 - l1_ratio) * n_users

    def run(batches):
        for b in batches:
            src, dst, weight = [], [], []
            for item in b.column(0).to_pylist():
                w = elastic_net_item(held.value, item, l1, l2)
                nz = np.flatnonzero(w)
                top = nz[np.argsort(-w[nz], kind="stable")][: max(0, min(len(nz) - 1, k))]
                src += top.tolist()
                dst += [item] * len(top)
                weight += w[top].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(weight, pa.float64())], names=["src", "dst", "weight"])

    return _mapped(urm.sparkSession.range(n_items), run, "src long, dst long, weight double")


class Optimiser:
    """Step sizes of sgd, adagrad, rmsprop or adam for one array of parameters."""

    def __init__(self, how: str, shape, rate: float, beta1: float = 0.9, beta2: float = 0.999, gamma: float = 0.995):
        self.how, self.rate, self.beta1, self.beta2, self.gamma, self.t = how, rate, beta1, beta2, gamma, 0
        self.m, self.v = np.zeros(shape), np.zeros(shape)

    def step(self, at, grad: np.ndarray) -> np.ndarray:
        """What to add to the parameters at `at`; grad is of the objective to maximise."""
        if self.how == "sgd":
            return self.rate * grad
        if self.how == "adagrad":
            self.v[at] += grad**2
            return self.rate * grad / (np.sqrt(self.v[at]) + 1e-8)
        if self.how == "rmsprop":
            self.v[at] = self.gamma * self.v[at] + (1 - self.gamma) * grad**2
            return self.rate * grad / (np.sqrt(self.v[at]) + 1e-8)
        self.t += 1
        self.m[at] = self.beta1 * self.m[at] + (1 - self.beta1) * grad
        self.v[at] = self.beta2 * self.v[at] + (1 - self.beta2) * grad**2
        m, v = self.m[at] / (1 - self.beta1**self.t), self.v[at] / (1 - self.beta2**self.t)
        return self.rate * m / (np.sqrt(v) + 1e-8)


def negative_item(rng: np.random.Generator, seen: set, n_items: int) -> int | None:
    """A random item outside seen, or None if there is none."""
    if len(seen) >= n_items:
        return None
    while (j := int(rng.integers(n_items))) in seen:
        pass
    return j


def sgd_factors(urm: DataFrame, n_items: int, model: str, factors: int = 8, epochs: int = 5, **how) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """The model after so many epochs of sgd_epochs()."""
    return next(islice(sgd_epochs(urm, n_items, model, factors, **how), epochs - 1, None))


def sgd_epochs(urm: DataFrame, n_items: int, model: str, factors: int = 8, rate: float = 0.05, reg: float = 0.01, how: str = "sgd", negatives: float = 0.0, seed: int = 42, parts: int = 16) -> Iterator[tuple[DataFrame, np.ndarray, np.ndarray, float]]:
    """model: 'funk' (squared error with biases, negatives: zero samples per interaction), 'bpr' (pairs), or 'asy' (the
    user's vector is the mean-scaled sum of its items' own vectors). An epoch is a pass in which every part of the users runs
    SGD from the same item parameters, which are then averaged over parts. Users are dealt into parts by a hash of their id
    and go in the order of their ids, so a result depends on parts and seed but not on the cluster. how: the step rule of all
    parameters; users keep their own accumulators from epoch to epoch, items' start anew. Yields, after each epoch, the user
    table, item factors (for asy: the scoring ones), item biases and the mean; ends never."""
    width = 2 * factors + 1
    bounded(n_items, width)
    spark = urm.sparkSession
    mu = float(urm.agg(F.avg("rating").alias("m")).first()["m"] or 0.0) if model != "bpr" else 0.0
    rng = np.random.default_rng(seed)
    params = np.hstack((rng.normal(0, 0.1, (n_items, 2 * factors)), np.zeros((n_items, 1))))
    start = F.transform(F.sequence(F.lit(0), F.lit(factors)), lambda k: F.when(k == factors, 0.0).otherwise(F.pmod(F.xxhash64("user_id", k, F.lit(seed)), F.lit(2001)) / 10000.0 - 0.1))
    first = F.array_repeat(F.lit(0.0), 2 * (factors + 1) + 1)
    state = materialise(profiles(urm).withColumn("u", start).withColumn("acc", first), "sgd")
    for epoch in count():
        held = spark.sparkContext.broadcast(params)
        dealt = state.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
        dealt = dealt.sortWithinPartitions("user_id").select("user_id", "items", "ratings", "u", "acc")

        def run(batches, held=held, epoch=epoch):
            x, local = held.value.copy(), np.random.default_rng(seed + epoch)
            opt = Optimiser(how, x.shape, rate)
            ids, out, kept, touched, vector = [], [], [], 0, slice(0, factors)
            for b in batches:
                for user, items, ratings, u, acc in _rows(b):
                    touched += 1
                    u, seen = np.array(u), set(items)
                    own = Optimiser(how, factors + 1, rate)
                    own.m, own.v, own.t = np.array(acc[: factors + 1]), np.array(acc[factors + 1 : -1]), int(acc[-1])
                    for t in local.permutation(len(items)):
                        i, r = items[t], ratings[t]
                        if model == "bpr":
                            j = negative_item(local, seen, n_items)
                            if j is None:
                                continue
                            d = x[i, :factors] - x[j, :factors]
                            s = 1 / (1 + np.exp(np.clip(u[:-1] @ d, -30, 30)))
                            old = u[:-1].copy()
                            u[:-1] += own.step(vector, s * d - reg * u[:-1])
                            x[i, :factors] += opt.step((i, slice(0, factors)), s * old - reg * x[i, :factors])
                            x[j, :factors] += opt.step((j, slice(0, factors)), -s * old - reg * x[j, :factors])
                            continue
                        todo = [(i, r)]
                        if negatives and local.random() < negatives and (j := negative_item(local, seen, n_items)) is not None:
                            todo.append((j, 0.0))
                        for item, value in todo:
                            vec = x[items, factors : 2 * factors].T @ (np.array(ratings) / np.sqrt(len(items))) if model == "asy" else u[:-1]
                            e = value - (mu + x[item, -1] + u[-1] + vec @ x[item, :factors])
                            gi = e * vec - reg * x[item, :factors]
                            if model == "asy":
                                scale = (np.array(ratings) / np.sqrt(len(items)))[:, None]
                                mine = (items, slice(factors, 2 * factors))
                                x[mine] += opt.step(mine, (e * scale * x[item, :factors] - reg * x[mine]) / len(items))
                            else:
                                u[:-1] += own.step(vector, e * x[item, :factors] - reg * u[:-1])
                            x[item, :factors] += opt.step((item, slice(0, factors)), gi)
                            x[item, -1] += opt.step((item, width - 1), e - reg * x[item, -1])
                            u[-1] += own.step(factors, e - reg * u[-1])
                    ids.append(user)
                    out.append(u.tolist())
                    kept.append([*own.m.tolist(), *own.v.tolist(), float(own.t)])
            if touched:
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids + list(range(n_items)), pa.int64()), pa.array([True] * len(ids) + [False] * n_items), pa.array(out + x.tolist(), kind), pa.array([1.0] * len(ids) + [float(touched)] * n_items), pa.array(kept + [None] * n_items, kind)], names=["id", "is_user", "v", "weight", "acc"])

        both = materialise(_mapped(dealt, run, "id long, is_user boolean, v array<double>, weight double, acc array<double>"), "sgd")
        held.destroy()
        cells = both.filter("not is_user").select("id", "weight", F.posexplode("v").alias("k", "x")).groupBy("id", "k").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x")).toPandas()
        params = params.copy()
        params[cells["id"], cells["k"]] = cells["x"]
        old = state
        state = materialise(state.drop("u", "acc").join(both.filter("is_user").select(F.col("id").alias("user_id"), F.col("v").alias("u"), "acc"), "user_id"), "sgd")
        discard(both)
        if epoch == 0:
            discard(old)  # later states may still be read as a yielded user table
        if model == "asy":
            users = fold_in(state, params[:, factors : 2 * factors], scale=True)
        else:
            users = state.select(F.col("user_id").alias("id"), F.slice("u", 1, factors).alias("factors"), F.element_at("u", -1).alias("bias"))
        yield users, params[:, :factors], params[:, -1], mu


def cold_user_model(train: DataFrame, profiles_of: DataFrame, v: np.ndarray, how: str = "mean", k: int = 100) -> DataFrame:
    """Scores (user_id, item_id, score) of users that the factorisation never saw, from their profiles (user_id, item_id,
    rating) and the item factors: 'mean' scores with the sum of rating * v over the square root of the profile's length;
    'knn' with the k heaviest entries of V V' for each item."""
    spark = train.sparkSession
    if how == "knn":
        w = item_similarity_of(spark, v, k)
        seen = profiles_of.join(train.select("item_id").distinct(), "item_id", "left_semi")
        return seen.join(w, seen["item_id"] == w["src"]).groupBy("user_id", F.col("dst").alias("item_id")).agg(F.sum(F.col("rating") * F.col("weight")).alias("score"))
    users = fold_in(profiles(profiles_of), v, scale=True)
    table = item_table(spark, v).select(F.col("id").alias("item_id"), F.col("factors").alias("fi"))
    warm = train.select("item_id").distinct().join(table, "item_id")
    pairs = users.select(F.col("id").alias("user_id"), F.posexplode("factors").alias("d", "x")).join(warm.select("item_id", F.posexplode("fi").alias("d", "y")), "d")
    return pairs.groupBy("user_id", "item_id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def save_model(folder: str, users: DataFrame, v: np.ndarray, bias: np.ndarray | None = None, mu: float = 0.0) -> None:
    """A factor model as tables of users and items and its mean."""
    store.save(folder, {"users": users, "items": item_table(users.sparkSession, v, bias)}, {"mu": mu})


def load_model(spark, folder: str) -> tuple[DataFrame, DataFrame, float]:
    """User table, item table and mean of a saved model, as ranking.top_n_factors() takes them."""
    tables, values = store.load(spark, folder)
    return tables["users"], tables["items"], values["mu"]


def slim_bpr(urm: DataFrame, n_items: int, epochs: int = 3, rate: float = 0.05, reg: float = 0.001, k: int = 100, symmetric: bool = True, seed: int = 42) -> DataFrame:
    """Item weights learned from pairs: x_ui = sum of s[i, seen]. Dense items x items in each task, averaged per epoch."""
    bounded(n_items, n_items, "item KNN")
    p, s = materialise(profiles(urm), "profiles"), np.zeros((n_items, n_items))
    for epoch in range(epochs):
        held = urm.sparkSession.sparkContext.broadcast(s)

        def learn(rows, held=held, epoch=epoch):
            x, rng = held.value.copy(), np.random.default_rng(seed + epoch)
            for _, items, _ in rows:
                seen, at = set(items), np.array(items)
                for i in items:
                    j = negative_item(rng, seen, n_items)
                    if j is None:
                        continue
                    g = 1 / (1 + np.exp(np.clip(x[i, at].sum() - x[j, at].sum(), -30, 30)))
                    x[i, at] += rate * (g - reg * x[i, at])
                    x[j, at] -= rate * (g + reg * x[j, at])
                    x[i, i] = 0
            return x

        s = _item_sums(p, learn, n_items, n_items, mean=True)
        held.destroy()
        if symmetric:
            s = (s + s.T) / 2
        np.fill_diagonal(s, 0)
    return as_weights(urm.sparkSession, s.T, k)


def early_stopping(step: Callable[[int], object], evaluate: Callable[[object], float], most: int, every: int = 5, least: int = 0, patience: int = 5) -> tuple[object, int, float]:
    """Runs step(epoch) and evaluates each `every` epochs; ends after `patience` evaluations without a better value once
    `least` epochs ran, or on a value that isn't finite. The best model, its epoch (from 1) and value."""
    best, best_at, best_value, worse, model = None, 0, -np.inf, 0, None
    for epoch in range(1, most + 1):
        model = step(epoch)
        if epoch % every:
            continue
        value = evaluate(model)
        if not np.isfinite(value):
            raise FloatingPointError(f"epoch {epoch}: the metric isn't finite")
        if value > best_value:
            best, best_at, best_value, worse = model, epoch, value, 0
        else:
            worse += 1
            if worse >= patience and epoch >= least:
                break
    return (model, most, np.nan) if best is None else (best, best_at, best_value)
