"""Golden cases: small matrices and lists with known answers."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.functions.text import porter, tag_filter, tag_filter_stem
from quillrank.operators import evaluation, factorisation, hybrid, neural_data, prep, products, ranking, recommenders, similarity, splits, statistics, walks, weighting
from quillrank.plans import report, tune
from quillrank.sources import readers, store
from quillrank.streaming import ingest

G1 = np.array([[1, 1, 0, 1], [0, 1, 1, 1], [1, 0, 1, 0]], float)
G3 = np.array([[1, 2, 0, 1], [0, 1, 4, 1], [1, 3, 1, 0]], float)


def triples(spark, a):
    r, c = np.nonzero(a)
    return spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "value": a[r, c]}), "row long, col long, value double")


def dense(w, n):
    out = np.zeros((n, n))
    for r in w.collect():
        out[r["src"], r["dst"]] = r["weight"]
    return out


def lists(spark, ranked, test):
    recs = spark.createDataFrame([(u, k + 1, i) for u, items in ranked.items() for k, i in enumerate(items)], "user_id long, rank int, item_id long")
    t = spark.createDataFrame([(u, i, float(r)) for u, d in test.items() for i, r in d.items()], "user_id long, item_id long, rating double")
    return recs, t


def test_plain_dot(spark):
    want = G1.T @ G1
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(similarity.similarity(triples(spark, G1), "cosine", 4, normalise=False), 4), want)


def test_cosine_and_jaccard(spark):
    n = np.sqrt((G3**2).sum(0))
    want = G3.T @ G3 / np.outer(n, n)
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(similarity.similarity(triples(spark, G3), "cosine", 4), 4), want, atol=1e-4)
    b = (G3 > 0).astype(float)
    both = b.T @ b
    q = b.sum(0)
    want = both / (q[:, None] + q[None, :] - both)
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(similarity.similarity(triples(spark, G3), "jaccard", 4), 4), want, atol=1e-4)
    assert np.allclose(dense(similarity.similarity(triples(spark, G3), "dice", 4), 4), np.where(np.eye(4), 0, both / (q[:, None] + q[None, :])), atol=1e-4)


@pytest.mark.parametrize("kind,axis", [("adjusted", 1), ("pearson", 0)])
def test_centred(spark, kind, axis):
    m = np.where(G3 != 0, G3, np.nan)
    c = np.nan_to_num(m - np.nanmean(m, axis=axis, keepdims=True))
    n = np.sqrt((c**2).sum(0))
    want = c.T @ c / (np.outer(n, n) + 1e-6)
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(similarity.similarity(triples(spark, G3), kind, 4), 4), want, atol=1e-4)


def test_row_weights(spark):
    a = np.array([[1, 2, 0, 1], [0, 1, 4, 1], [3, 0, 1, 0]], float).T
    w = np.array([2, 3, 0, 4], float)
    got = similarity.similarity(triples(spark, a), "cosine", 3, normalise=False, row_weights=spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "row long, weight double"))
    want = a.T @ np.diag(w) @ a
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(got, 3), want, atol=1e-4)


def test_negative_weights_rank_below_zeros(spark):
    w = spark.createDataFrame([(1, 0, 0.5), (2, 0, -0.1)], "src long, dst long, weight double")
    assert similarity.heaviest(w, 2, n_cols=4).count() == 1
    assert similarity.heaviest(w, 4, n_cols=4).count() == 2


def test_euclidean(spark):
    a = np.array([[0.12, 0, 0.87, 1.0], [0.28, 0.8, 1.0, 0.69], [0, 0.37, 1.0, 0.01]])
    d = np.sqrt(((a.T[:, None] - a.T[None]) ** 2).sum(2))
    want = 1 / (d + 1e-9)
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(similarity.euclidean(triples(spark, a), spark.range(4).toDF("col"), 4), 4), want, rtol=1e-5)


def test_metrics_of_known_lists(spark):
    rel = {2: 5, 4: 4, 5: 3, 10: 2}
    recs, test = lists(spark, {0: [1, 2, 3, 4, 5], 1: [10, 5, 2, 4, 3], 2: [1, 3, 6, 7, 8]}, {u: rel for u in range(3)})
    per = evaluation.per_user(recs, test, test.select("user_id").distinct(), [5])
    got = {r["user_id"]: r for r in per.select("user_id", *[c.alias(k) for k, c in evaluation.accuracy_columns().items()]).collect()}
    assert [got[u]["RECALL"] for u in range(3)] == [0.75, 1, 0] and [got[u]["PRECISION"] for u in range(3)] == [0.6, 0.8, 0]
    assert [got[u]["MRR"] for u in range(3)] == [0.5, 1, 0]
    assert np.allclose([got[u]["MAP"] for u in range(3)], [(1 / 2 + 2 / 4 + 3 / 5) / 4, 1, 0])
    ln = np.log
    ideal = 31 / ln(2) + 15 / ln(3) + 7 / ln(4) + 3 / ln(5)
    assert np.allclose([got[u]["NDCG"] for u in range(3)], [(31 / ln(3) + 15 / ln(5) + 7 / ln(6)) / ideal, (3 / ln(2) + 7 / ln(3) + 31 / ln(4) + 15 / ln(5)) / ideal, 0])


def test_auc(spark):
    recs, test = lists(spark, {0: [1, 2, 3, 4, 5]}, {0: {2: 1, 4: 1}})
    assert np.isclose(evaluation.accuracy(recs, test, test.select("user_id").distinct(), [5]).first()["ROC_AUC"], (2 / 3 + 1 / 3) / 2)


def test_gini_and_entropy(spark):
    items = spark.range(1000).toDF("item_id")
    even, _ = lists(spark, {u: [u] for u in range(1000)}, {0: {0: 1}})
    got = evaluation.beyond_accuracy(even, even, items, even.select("user_id"), 1000, [1]).first()
    assert np.isclose(got["DIVERSITY_GINI"], 1, atol=1e-2) and np.isclose(got["SHANNON_ENTROPY"], 9.966, atol=1e-2)


def test_mean_inter_list(spark):
    rng = np.random.default_rng(0)
    ranked = {u: rng.permutation(20)[:5].tolist() for u in range(12)}
    recs, _ = lists(spark, ranked, {0: {0: 1}})
    got = evaluation.beyond_accuracy(recs, recs, spark.range(20).toDF("item_id"), recs.select("user_id").distinct(), 12, [5]).first()["DIVERSITY_MEAN_INTER_LIST"]
    over = [1 - len(set(ranked[a]) & set(ranked[b])) / 5 for a in ranked for b in ranked if a != b]
    assert np.isclose(got, np.mean(over))


def test_top_n_fills_with_unseen_zeros(spark):
    scores = spark.createDataFrame([(0, 3, 2.0), (0, 1, -1.0)], "user_id long, item_id long, score double")
    seen = spark.createDataFrame([(0, 0), (1, 2)], "user_id long, item_id long")
    users = spark.range(2).toDF("user_id")
    got = ranking.top_n(scores, seen, users, 5, 4).orderBy("user_id", "rank").collect()
    assert [r["item_id"] for r in got if r["user_id"] == 0] == [3, 2, 4, 1] and [r["item_id"] for r in got if r["user_id"] == 1] == [0, 1, 3, 4]
    only = spark.createDataFrame([(0, 1), (0, 4)], "user_id long, item_id long")
    assert [r["item_id"] for r in ranking.top_n(scores, seen, users, 5, 4, only=only).orderBy("rank").collect()] == [4, 1]


def test_splits_are_disjoint_and_whole(spark):
    urm = spark.createDataFrame([(u, i, 1.0 + i) for u in range(20) for i in range(u + 1)], "user_id long, item_id long, rating double")
    s = splits.leave_k_out(urm, 2)
    assert s.count() == urm.count() and s.select("user_id", "item_id").distinct().count() == urm.count()
    assert splits.leave_k_out(urm, 2, validation=False, lose_gap=True).filter("user_id = 19").count() == 18
    n = splits.negatives(urm, urm.select("user_id").distinct(), 20, 5)
    assert n.join(urm, ["user_id", "item_id"]).count() == 0 and n.filter("user_id = 18").count() == 1


def test_ease_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((30, 6)) < 0.4).astype(float)
    r, c = np.nonzero(a)
    urm = spark.createDataFrame(pd.DataFrame({"user_id": r, "item_id": c, "rating": a[r, c]}), "user_id long, item_id long, rating double")
    p = np.linalg.inv(a.T @ a + 5 * np.eye(6))
    want = p / -np.diag(p)
    np.fill_diagonal(want, 0)
    assert np.allclose(dense(factorisation.ease(urm, 6, 5.0), 6), want)
    users, v, s = factorisation.pure_svd(urm, 6, 3, rounds=30)
    assert np.allclose(s, np.linalg.svd(a)[1][:3], rtol=1e-3)
    assert users.count() == len(set(r))


def test_elastic_net_is_optimal():
    rng = np.random.default_rng(2)
    x = rng.random((50, 4))
    g = x.T @ x
    w = factorisation.elastic_net_item(g, 0, 0.1, 0.5, 1000, 1e-12)
    f = lambda w: 0.5 * ((x[:, 0] - x[:, 1:] @ w) ** 2).sum() + 0.1 * np.abs(w).sum() + 0.25 * (w**2).sum()
    for _ in range(200):
        assert f(w[1:]) <= f(np.maximum(0, w[1:] + rng.normal(0, 0.05, 3))) + 1e-9


def test_optimisers_and_early_stopping():
    for how in ("sgd", "adagrad", "rmsprop", "adam"):
        o, x = factorisation.Optimiser(how, 1, 0.1), np.array([3.0])
        for _ in range(500):
            x[0] += o.step(0, -2 * (x[0] - 1))
        assert abs(x[0] - 1) < 0.6
    values = iter([0.1, 0.3, 0.2, 0.2, 0.9])
    assert factorisation.early_stopping(lambda e: e, lambda m: next(values), 50, every=2, patience=2)[1:] == (4, 0.3)


def test_significance():
    a, b = [0.1, 0.2, 0.3, 0.25, 0.15], [0.2, 0.3, 0.45, 0.35, 0.2]
    got = statistics.significance(a, b)
    assert got["superior"] == "second" and got["significant"]
    d = np.array([0.5, 0.2, 0.9, 0.1])
    t = d.mean() / (d.std(ddof=1) / 2) / np.sqrt(3)
    assert np.isclose(statistics.paired_t([1, 2, 3, 4], [1.5, 2.2, 3.9, 4.1]), 1 - 2 / np.pi * (t / (1 + t * t) + np.arctan(t)))
    assert np.isclose(statistics.wilcoxon([1, 2, 3, 4, 5], [2, 4, 6, 8, 10.0]), 0.0625)
    assert np.isnan(statistics.significance(a, a)["p_value"])
    assert statistics.shapiro([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])[0] == pytest.approx(0.79, abs=0.01)


def test_text(spark):
    for a, b in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adjustment": "adjust", "generalizations": "gener", "sky": "sky"}.items():
        assert porter(a) == b
    df = spark.createDataFrame([("The cats, and running dogs!",)], "t string")
    assert df.select(tag_filter(F.col("t"))).first()[0] == ["The", "cats", "running", "dogs", ""]
    assert df.select(tag_filter_stem(F.col("t"))).first()[0] == ["cat", "run", "dog", ""]


def test_readers(spark, tmp_path):
    p = tmp_path / "r.dat"
    p.write_text("1::10::5::100\n1::10::3::200\n2::11::0::300\n2::12::4::400\nbroken\n")
    got = readers.read_interactions(spark, readers.spec("movielens_1m", str(p), repeats="last")).orderBy("user_id").collect()
    assert [(r["user_id"], r["item_id"], r["rating"]) for r in got] == [("1", "10", 3.0), ("2", "12", 4.0)]
    with pytest.raises(ValueError):
        readers.read_interactions(spark, readers.spec("movielens_1m", str(p)))
    b = tmp_path / "b.txt"
    b.write_text("7:\n1,5,2004-01-02\n2,3,2004-01-03\n8:\n1,4,2004-02-01\n")
    assert [(r["user_id"], r["item_id"]) for r in readers.read_blocks(spark, str(b)).orderBy("item_id", "user_id").collect()] == [("1", "7"), ("2", "7"), ("1", "8")]
    f = tmp_path / "f.libsvm"
    f.write_text("1 5:1 9:1\n-1 6:1 9:1\n")
    assert [tuple(r) for r in readers.read_labelled_pairs(spark, str(f)).collect()] == [("5", "9", 1.0)]
    j = tmp_path / "m.json"
    j.write_text('{"asin": "a", "title": "Big Box", "categories": [["x", "y"]]}\n')
    assert readers.read_json_metadata(spark, str(j)).first()["text"].split() == ["Big", "Box", "x", "y"]


def test_store(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"urm": spark.range(3).toDF("user_id")}, {"k": 5}

    for _ in range(2):
        tables, values = store.load_or_build(spark, str(tmp_path / "s"), build)
    assert tables["urm"].count() == 3 and values == {"k": 5} and built == [1]


def test_search():
    s = tune.Search(lambda x: x, lambda m: -((m - 0.3) ** 2), {"x": tune.Real(0, 1)})
    assert abs(s.bayesian(14, 4).params["x"] - 0.3) < 0.15
    bad = tune.Search(lambda x: 1 / 0, lambda m: 0, {"x": tune.Real(0, 1)})
    assert bad.random(2).exception


def test_reports(spark):
    r = spark.createDataFrame([("a", 5, "MAP", 0.5), ("b", 5, "MAP", 0.7)], "algorithm string, cutoff int, metric string, value double")
    assert report.latex(r.orderBy("algorithm"), ["MAP"], [5], ["a"]) == "a & 0.5000 \\\\\nb & \\textbf{0.7000} \\\\"
    assert report.biggest_unit(7200) == (2, "hour") and report.rounded(0.12345, 0.01) == "0.12 ± 0.01"
    assert report.marked_best(r, ["a"]).filter("beats").first()["algorithm"] == "b"


def test_empty_tables(spark):
    urm = spark.createDataFrame([], "user_id long, item_id long, rating double, ts timestamp")
    assert splits.timestamp(urm).count() == 0 and prep.degree_filter(urm, 1, 1).count() == 0
    assert similarity.similarity(urm.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))).count() == 0
    assert prep.density(urm, 0, 0).first()["density"] == 0.0


def test_outer_product(spark):
    f = spark.createDataFrame([(0, [1.0, 2.0], 0.0)], "id long, factors array<double>, bias double")
    pairs = spark.createDataFrame([(0, 0)], "user_id long, item_id long")
    assert neural_data.outer_product(f, f, pairs, "off_diagonal").first()["map"] == [0.0, 2.0, 2.0, 0.0]
    assert neural_data.permuted_factors(f, [1, 0]).first()["factors"] == [2.0, 1.0]


def test_stream(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "ts")
    q = ingest.append_to(ingest.windowed_interactions(events), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.schema("window_start timestamp, user_id long, item_id long, rating double, ts timestamp").parquet(str(tmp_path / "out")).count() > 0


@pytest.mark.parametrize("cells", [4_000_000, 30])
def test_blocked_factor_lists_equal_the_whole_grid(spark, cells, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    monkeypatch.setattr(ranking, "SCORE_CELLS", 7)
    schema = "id long, factors array<double>, bias double"
    users = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)], 0.5) for i in (4, 9, 2)]
    items = [(int(i), [float(x) for x in rng.integers(-2, 3, 3)], float(rng.integers(2))) for i in rng.permutation(40)]
    seen = [(4, 3), (4, 39), (9, 0), (7, 1)]
    got = ranking.top_n_factors(spark.createDataFrame(users, schema), spark.createDataFrame(items, schema), 6, spark.createDataFrame(seen, "user_id long, item_id long"), 1.5, cells)
    want = []
    for u, f, b in users:
        best = sorted((-(float(np.dot(f, g)) + b + c + 1.5), i) for i, g, c in items if (u, i) not in seen)[:6]
        want += [(u, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert ranking.top_n_factors(spark.createDataFrame([], schema), spark.createDataFrame(items, schema), 6).count() == 0
    assert ranking.top_n_factors(spark.createDataFrame(users, schema), spark.createDataFrame([], schema), 6).count() == 0


def test_factor_models_and_their_options(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.integers(1, 5))) for u in range(30) for i in rng.permutation(12)[: 3 + u % 4].tolist()]
    urm = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    dense_urm = np.zeros((30, 12))
    for u, i, r in rows:
        dense_urm[u, i] = r

    def matrix(users, v):
        w = np.array([r["factors"] for r in users.orderBy("id").collect()])
        return w @ v.T

    seen = dense_urm > 0
    divergence = lambda x: (dense_urm[seen] * np.log(dense_urm[seen] / x[seen])).sum() - dense_urm.sum() + x.sum()
    square = lambda x: ((dense_urm - x) ** 2).sum()
    for loss, of in (("frobenius", square), ("kullback-leibler", divergence)):
        values = [of(matrix(*factorisation.nmf(urm, 12, 4, n, loss=loss))) for n in (1, 4, 9)]
        assert values[0] > values[1] > values[2]
    x = dense_urm / np.linalg.norm(dense_urm, axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=0, keepdims=True)
    g = x.T @ x
    np.fill_diagonal(g, (x > 0).sum(0) + 5.0)
    p = np.linalg.inv(g)
    want = p / -np.diag(p)
    np.fill_diagonal(want, 0)
    got = np.zeros((12, 12))
    for r in factorisation.ease(urm, 12, 5.0, normalise=True).collect():
        got[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(got, want)
    for how in ("sgd", "adagrad", "rmsprop", "adam"):
        errors = []
        for k, (users, v, b, mu) in zip(range(3), factorisation.sgd_epochs(urm, 12, "funk", 3, 0.02, how=how, parts=3), strict=False):
            own = {r["id"]: r for r in users.collect()}
            errors.append(sum((r - mu - b[i] - own[u]["bias"] - np.dot(own[u]["factors"], v[i])) ** 2 for u, i, r in rows))
        assert errors[2] < errors[0]
    a, b = (factorisation.sgd_factors(x, 12, "bpr", 3, 2, parts=3)[1] for x in (urm, urm.repartition(5)))
    assert np.allclose(a, b)  # whichever way the rows come
    users, v, _ = factorisation.pure_svd(urm, 12, 3)
    factorisation.save_model(str(tmp_path / "svd"), users, v, mu=0.5)
    u2, i2, mu = factorisation.load_model(spark, str(tmp_path / "svd"))
    assert mu == 0.5 and ranking.top_n_factors(u2, i2, 4).count() == 120
    cold = spark.createDataFrame([(99, 0, 2.0), (99, 3, 1.0)], "user_id long, item_id long, rating double")
    got = {r["item_id"]: r["score"] for r in factorisation.cold_user_model(urm, cold, v).collect()}
    vec = (2 * v[0] + v[3]) / np.sqrt(2)
    assert len(got) == 12 and all(np.isclose(got[i], vec @ v[i]) for i in got)
    knn = {r["item_id"]: r["score"] for r in factorisation.cold_user_model(urm, cold, v, "knn", 12).collect()}
    assert all(np.isclose(knn[i], 2 * v[0] @ v[i] + v[3] @ v[i]) for i in knn)


def test_search_drivers_fit_every_model(spark):
    from quillrank.plans import drivers

    rng = np.random.default_rng(6)
    rows = [(u, i, 1.0) for u in range(20) for i in rng.permutation(8)[:4].tolist()]
    urm = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    split = splits.leave_k_out(urm, 1, validation=False)
    train, held = (split.filter(f"split = '{x}'").drop("split") for x in ("train", "test"))
    feature = lambda c: urm.select(c, (F.col(c) % 3).cast("string").alias("feature"), F.lit(1.0).alias("value")).distinct()
    s = drivers.Setting(train, urm.select("user_id").distinct(), 20, 8, feature("item_id"), feature("user_id"), n=3, epochs=1)
    params = {"k": 5, "shrink": 0, "factors": 2, "alpha": 0.5, "beta": 0.3, "l2": 10.0, "weight": 2.0, "l1_ratio": 0.1, "epsilon": 1.0, "reg": 0.01, "rate": 0.05, "how": "adam", "negatives": 0.2, "normalise": True, "feature_weighting": "TF-IDF", "symmetric": True}
    for model in [*drivers.COLLABORATIVE, *drivers.NEIGHBOURS]:
        own = {k: params[k] for k in drivers.space_of(model)}
        assert drivers.fits(s, model)(**own).select("user_id").distinct().count() == 20, model
    found = drivers.search(s, held, "p3alpha", cases=3, starts=2)
    assert len(found.cases) == 3 and found.best().value >= 0 and all(c.exception is None for c in found.cases)
    best, at, value = drivers.trained_until(s, held, "bpr", most=4, every=2, factors=2)
    assert at in (2, 4) and 0 <= value <= 1 and len(best) == 4


def test_published_splits_are_read_if_all_are_there(spark, tmp_path):
    df = spark.range(3)
    for name in ("train", "test"):
        df.write.parquet(str(tmp_path / name))
    paths = {n: str(tmp_path / n) for n in ("train", "test")}
    got, theirs = store.published_or_made(spark, paths, spark.read.parquet, lambda: {})
    assert theirs and got["train"].count() == 3
    got, theirs = store.published_or_made(spark, paths | {"validation": str(tmp_path / "none")}, spark.read.parquet, lambda: {"train": df})
    assert not theirs and list(got) == ["train"]


def test_blocks_keep_their_headers_across_splits(spark, tmp_path):
    lines = [x for i in range(40) for x in (f"{i}:", *(f"{u},{u % 5}.0,2001-02-03" for u in range(i % 7)))]
    (tmp_path / "blocks.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        got = readers.read_blocks(spark, str(tmp_path / "blocks.txt"))
        assert sorted((int(r["item_id"]), int(r["user_id"])) for r in got.collect()) == [(i, u) for i in range(40) for u in range(i % 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("entries,cells", [(4_000_000, 4_000_000), (20, 9)])
def test_weighted_lists_equal_the_relational_ones(spark, entries, cells, monkeypatch):
    monkeypatch.setattr(ranking, "SCORE_CELLS", cells)
    rng = np.random.default_rng(8)
    train = [(u, int(i), float(rng.integers(1, 5))) for u in range(12) for i in rng.permutation(15)[: u % 5]]
    w = [(int(a), int(b), float(rng.integers(-3, 4))) for a in range(15) for b in rng.permutation(15)[:4]]
    urm = spark.createDataFrame(train, "user_id long, item_id long, rating double")
    weights = spark.createDataFrame(w, "src long, dst long, weight double")
    users = spark.range(14).withColumnRenamed("id", "user_id")
    want = ranking.top_n(ranking.item_scores(urm, weights), urm, users, 15, 6)
    got = ranking.top_n_weighted(urm, weights, users, 15, 6, urm, entries)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert ranking.top_n_weighted(urm, weights.filter("false"), users, 15, 2).count() == 28
    assert ranking.top_n_weighted(urm, weights, users.filter("false"), 15, 2).count() == 0


@pytest.mark.parametrize("rows,cells", [(512, 4_000_000), (3, 60), (0, 60)])
def test_blocked_similarity_equals_the_join(spark, rows, cells, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(similarity, "DENSE_ROWS", rows)
    monkeypatch.setattr(similarity, "BLOCK_CELLS", cells)
    monkeypatch.setattr(similarity, "PAIR_CELLS", 11)
    data = [(f"f{r}", int(c) * 3, float(rng.integers(-1, 4))) for r in range(8) for c in range(30) if rng.random() < (0.9 if r < 2 else 0.15)]
    data += [("only", 1000, 2.0), (None, 3, 1.0), ("f1", None, 1.0), ("f2", 3, 2.0), ("f2", 3, 1.0)]
    m = spark.createDataFrame(data, "row string, col int, value double")
    for how in (dict(kind="cosine", shrink=2), dict(kind="tversky", alpha=0.2), dict(kind="cosine", normalise=False, start_col=6, end_col=50)):
        got, want = ({(r["dst"], r["src"]): round(round(r["weight"], 12), 8) for r in similarity.similarity(m, k=60, dense=d, **how).collect()} for d in (True, False))
        assert got == want and len(got) > 20, how
        few = similarity.similarity(m, k=4, dense=True, **how).collect()
        for dst in {r["dst"] for r in few}:
            best = sorted((-w, s) for (t, s), w in want.items() if t == dst)[:4]
            assert sorted((-round(round(r["weight"], 12), 8), r["src"]) for r in few if r["dst"] == dst) == best
    empty = similarity.similarity(m.limit(0), k=4, dense=True)
    assert empty.count() == 0 and empty.dtypes == [("src", "int"), ("dst", "int"), ("weight", "double")]


@pytest.mark.parametrize("pairs,entries,chunk,cells", [(4_000_000, 4_000_000, 250_000, 40), (40, 30, 7, 0)])
def test_similarity_writes_no_pairs(spark, pairs, entries, chunk, cells, monkeypatch):
    from quillrank.operators import products

    def joined(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(similarity, "pair_dots", joined)
    for name, value in (("BLOCK_PAIRS", pairs), ("CHUNK", chunk), ("CELLS_A_PAIR", cells)):
        monkeypatch.setattr(products, name, value)
    monkeypatch.setattr(products.block_products, "__defaults__", ("products", entries))
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, (12, 20)) * (rng.random((12, 20)) < 0.4).astype(float)
    a[:, 7] = a[2] = 2.0
    by_row = np.arange(12) % 3 + 1.0
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(by_row)], "row long, weight double")
    for how, g in (({}, a.T @ a), ({"row_weights": rows}, a.T @ (a * by_row[:, None])), ({"start_col": 5, "end_col": 9}, a.T @ a)):
        want = g / (np.sqrt(np.outer((a**2).sum(0), (a**2).sum(0))) + 2 + 1e-6)
        got = similarity.similarity(triples(spark, a), "cosine", 4, 2, **how).collect()
        for dst in range(how.get("start_col", 0), how.get("end_col", 20)):
            best = sorted((-round(want[s, dst], 9), s) for s in range(20) if s != dst and want[s, dst] > 0)[:4]
            assert sorted((-round(r["weight"], 9), r["src"]) for r in got if r["dst"] == dst) == best
        assert {r["dst"] for r in got} <= set(range(how.get("start_col", 0), how.get("end_col", 20)))


def test_weighted_lists_without_a_cell_for_each_item(spark, monkeypatch):
    def wide(*_):
        raise AssertionError("every item was scored")

    monkeypatch.setattr(ranking, "best_of", wide)
    urm = spark.createDataFrame([("a", 3, 2.0), ("a", 900_000, 1.0), ("b", 3, 1.0)], "user_id string, item_id long, rating double")
    w = spark.createDataFrame([(3, 999_999, 2.0), (3, 0, -1.0), (900_000, 5, 7.0), (900_000, 2_000_000, 9.0)], "src long, dst long, weight double")
    users = spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string")
    got = ranking.top_n_weighted(urm, w, users, 1_000_000, 3, urm).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["item_id"], r["score"]) for r in got] == [("a", 5, 7.0), ("a", 999_999, 4.0), ("a", 1, 0.0), ("b", 999_999, 2.0), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 0, 0.0), ("c", 1, 0.0), ("c", 2, 0.0)]


@pytest.mark.parametrize("k", [1, 4, 40])
def test_equal_columns_share_a_list(spark, k, monkeypatch):
    counted, by_blocks = [], similarity._by_blocks
    monkeypatch.setattr(similarity, "_by_blocks", lambda m, *a, **how: counted.append(m.select("col").distinct().count()) or by_blocks(m, *a, **how))
    kinds = [("a", "x"), ("a", "y"), ("b", "x"), ("c",), ("a", "x", "z")]
    m = spark.createDataFrame([(f, c, 1.0) for c in range(60) for f in kinds[c * 7 % 11 % 5]], "row string, col long, value double")
    for how in (dict(kind="cosine", shrink=1), dict(kind="cosine", normalise=False), dict(kind="jaccard", start_col=3, end_col=20)):
        got, want = ([(r["dst"], r["src"], round(r["weight"], 9)) for r in similarity.similarity(m, k=k, dense=d, **how).collect()] for d in (True, False))
        assert sorted(got) == sorted(want)
    assert counted == [5, 5, 5]


def test_meta_paths_shuffle_no_path(spark):
    """The best paths of each pair as a search over all of them finds them; users, not paths, are shuffled."""
    rng = np.random.default_rng(5)
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 12, 70), rng.integers(0, 9, 70), strict=True)})
    near = [(int(a), int(b), float(x)) for a in range(12) for b, x in zip(rng.choice(12, 4, replace=False), rng.integers(0, 4, 4) / 4, strict=True) if a != b]
    urm, w = spark.createDataFrame(seen, "user_id long, item_id long"), spark.createDataFrame(near, "src long, dst long, weight double")
    for per_pair in (1, 2, 50):
        best = {}
        for a, b, x in near:
            if x > 0.1:
                for via in {i for u, i in seen if u == a} & {i for u, i in seen if u == b}:
                    for item in (i for u, i in seen if u == b and i != via):
                        best.setdefault((a, item), []).append((-x, b, via))
        want = {(u, via, b, i) for (u, i), found in best.items() for _, b, via in sorted(found)[:per_pair]}
        got = neural_data.meta_paths(urm, w, 0.1, per_pair)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", [{}, {"alpha": 0.8, "beta": 0.6, "normalise": True}])
def test_walk_lists_write_no_weights(spark, monkeypatch, how):
    """Lists over a walk whose weights are cut by row and by column, in small blocks that keep few weights, equal those over
    the table of weights, which equals the plain matrices; what is written doesn't grow with k."""
    rng = np.random.default_rng(3)
    a = (rng.random((30, 25)) < 0.25) * rng.integers(1, 6, (30, 25)).astype(float)
    r, c = np.nonzero(a)
    urm = spark.createDataFrame(pd.DataFrame({"user_id": r, "item_id": c, "rating": a[r, c]}), "user_id long, item_id long, rating double")
    alpha, k = how.get("alpha", 1.0), 4
    w = ((a > 0) / (a > 0).sum(0)).T ** alpha @ (a / a.sum(1, keepdims=True)) ** alpha
    w *= (a > 0).sum(0) ** -how.get("beta", 0.0)
    np.fill_diagonal(w, 0)

    def cut(x):  # the k largest of each row; ties: the least column
        out = np.zeros_like(x)
        for i, o in enumerate(np.argsort(-np.round(x, 12), axis=1, kind="stable")[:, :k]):
            out[i, o] = x[i, o]
        return out

    w = cut(w)
    w = cut((w / w.sum(1, keepdims=True) if how else w).T).T
    got = recommenders.p3alpha(urm, k, **how)
    assert np.allclose(dense(got, 25), w)
    want = ranking.top_n_weighted(urm, got, urm, 25, 6, urm).collect()
    written, write = [], walks.materialise
    monkeypatch.setattr(walks, "materialise", lambda df, name: written.append(df.columns) or write(df, name))
    for name, size in (("BLOCK_ENTRIES", 40), ("NEED_ENTRIES", 60), ("KEPT_WEIGHTS", 10)):
        monkeypatch.setattr(walks, name, size)
    lists_ = recommenders.p3alpha_lists(urm, urm, 25, 6, k, **how).collect()
    assert sorted((x[0], x[1], x[2], round(x[3], 8)) for x in lists_) == sorted((x[0], x[1], x[2], round(x[3], 8)) for x in want)
    assert written and not any("weight" in columns for columns in written)


def test_weighted_lists_of_the_users_of_the_profile_itself(spark):
    """Profiles, seen items and users of one table, all dealt by user: a target still meets its entries."""
    urm = spark.createDataFrame(pd.DataFrame([(u, u * i % 25, 1.0) for u in range(1, 25) for i in (1, 2, 3)], columns=["user_id", "item_id", "rating"]), "user_id long, item_id long, rating double")
    w = spark.createDataFrame([(i, (i + 5) % 25, 1.0 + i) for i in range(25)], "src long, dst long, weight double")
    want = ranking.top_n(ranking.item_scores(urm, w), urm, urm, 25, 4)
    assert sorted(map(tuple, ranking.top_n_weighted(urm, w, urm, 25, 4, urm).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", [{"alpha": 0.8}, {"beta": 0.6, "normalise": True}])
def test_walks_over_whole_ids_equal_the_join(spark, how):
    """P3alpha and RP3beta in blocks, whose columns carry three numbers each, equal the join that other ids take."""
    urm = spark.createDataFrame([(u, u * i % 7, 1.0 + (u + i) % 3) for u in range(9) for i in range(1, 4) if u * i % 7], "user_id long, item_id long, rating double").distinct()
    urm = urm.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))
    named = urm.withColumn("user_id", F.col("user_id").cast("string")).withColumn("item_id", F.col("item_id").cast("string"))
    got, want = (sorted((int(r["src"]), int(r["dst"]), round(r["weight"], 9)) for r in recommenders.p3alpha(m, 3, **how).collect()) for m in (urm, named))
    assert got and got == want


@pytest.mark.parametrize("flat", [False, True])
def test_factor_lists_score_few_items(monkeypatch, flat):
    """Boxes of items give the lists of the whole grid, also among equal scores, and most items are never scored."""
    rng = np.random.default_rng(8)
    v, u = rng.normal(size=(20000, 5)), rng.normal(size=(300, 5))
    if flat:
        u[:100], u[100:200], v = 1e-12, 0.0, np.round(v)
    ids, bias = np.sort(rng.choice(10**6, len(v), replace=False)), np.zeros(len(v))
    whole = np.round(u @ v.T, ranking.DIGITS) + 0.0
    seen = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    whole[np.arange(300)[:, None], seen] = -np.inf
    want = np.argsort(-whole, axis=1, kind="stable")[:, :7]
    monkeypatch.setattr(ranking, "GROUP", 8)
    scored, boxed_round = [], np.round
    monkeypatch.setattr(ranking.np, "round", lambda x, *a: scored.append(x.size) or boxed_round(x, *a))
    r, i, x = ranking.best_in_boxes(ranking.boxed(ids, v, bias), u, np.zeros(300), ids[seen].ravel(), np.arange(0, 901, 3), 7)
    monkeypatch.undo()
    o = np.lexsort((i, -x, r))
    assert (i[o].reshape(300, 7) == ids[want]).all() and np.allclose(x[o].reshape(300, 7), np.take_along_axis(whole, want, 1))
    assert sum(scored) < whole.size / 2


@pytest.mark.parametrize("k", [2, 7, 80])
def test_hybrid_meets_few_pairs(spark, k, monkeypatch):
    """Cosines over content and interactions by classes of equal content equal those by all pairs; no pair is joined."""
    rng = np.random.default_rng(k)
    content = [(i, f, 1.0) for i in range(60) if i % 9 for f in (f"a{i % 4}", f"b{i * 7 % 5}", f"c{i % 2}")]
    seen = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 150), rng.integers(3, 64, 150), strict=True)})
    urm = spark.createDataFrame([(u, i, float(r)) for (u, i), r in zip(seen, rng.integers(1, 9, len(seen)), strict=True)], "user_id long, item_id long, rating double")
    icm = spark.createDataFrame(content, "item_id long, feature string, value double")
    both = weighting.side_by_side(icm.withColumnRenamed("item_id", "id"), 2.0, urm.select(F.col("item_id").alias("id"), F.col("user_id").alias("feature"), F.col("rating").alias("value")))
    want = recommenders.knn_cbf(both, 64, k, 3.0, dense=False).collect()
    monkeypatch.setattr(similarity, "pair_dots", None)
    monkeypatch.setattr(similarity, "_by_blocks", None)
    got = recommenders.item_knn_hybrid(urm, icm, 64, 2.0, k=k, shrink=3.0).collect()
    assert sorted((r["dst"], r["src"], round(r["weight"], 9)) for r in got) == sorted((r["dst"], r["src"], round(r["weight"], 9)) for r in want)


def test_hybrid_spreads_its_classes_over_tasks(spark, monkeypatch):
    """What takes the time for a column are all the classes, so few small columns are still dealt to several tasks."""
    files, write = {}, hybrid.materialise

    def noted(df, name):
        out = write(df, name)
        files[name] = out.select(F.input_file_name()).distinct().count()
        return out

    monkeypatch.setattr(hybrid, "materialise", noted)
    monkeypatch.setattr(hybrid, "TOGETHER_CELLS", 100)
    urm = spark.createDataFrame([(u, u * i % 41, 1.0 + u % 3) for u in range(1, 30) for i in (1, 2)], "user_id long, item_id long, rating double")
    icm = spark.createDataFrame([(i, f"a{i % 11}", 1.0) for i in range(41)] + [(i, f"b{i % 4}", 1.0) for i in range(41)], "item_id long, feature string, value double")
    assert recommenders.item_knn_hybrid(urm, icm, 41, k=3, shrink=1.0).count() == 41 * 3
    assert files["lone"] > 1


def test_content_classes_are_compared_by_several_tasks(spark, monkeypatch):
    """Few small rows of classes, which take long, aren't left to one task; the lists are those of the join."""
    files, write = [], similarity.materialise

    def noted(df, name):
        out = write(df, name)
        if name == "weights":
            files.append(out.select(F.input_file_name()).distinct().count())
        return out

    monkeypatch.setattr(similarity, "materialise", noted)
    m = spark.createDataFrame([(f, c, 1.0) for c in range(120) for f in (f"a{c % 5}", f"b{c % 6}")], "row string, col long, value double").coalesce(1)
    got, want = ([(r["dst"], r["src"], round(r["weight"], 9)) for r in similarity.similarity(m, k=4, shrink=1, dense=d).collect()] for d in (True, False))
    assert sorted(got) == sorted(want) and len(files) == 1 and files[0] > 1


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_stay_whole_across_batches(size):
    key = [1, 1, 1, 1, 2, 3, 3, 5, 5, 5, 5, 5, 5, 5, 8]
    rows = pa.record_batch({"k": pa.array(key, pa.int64()), "v": pa.array(range(len(key)))})
    got = list(products._whole_groups(rows.slice(a, size) for a in range(0, len(key), size)))
    assert [v for t in got for v in t["v"].to_pylist()] == list(range(len(key)))
    assert sum(len(set(t["k"].to_pylist())) for t in got) == len(set(key))
