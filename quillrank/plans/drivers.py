"""Search drivers: every model of tune.SPACES and tune.knn_space fitted with a case's parameters, ranked for the users to
evaluate and measured. fits() gives, for a training matrix, a function from parameters to top-N lists; search() tunes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators import evaluation, factorisation, ranking, recommenders
from quillrank.plans import tune


@dataclass(frozen=True)
class Setting:
    """A training matrix and its universe; features (item_id or user_id, feature, value) for content and hybrid models."""

    train: DataFrame
    users: DataFrame
    n_users: int
    n_items: int
    icm: DataFrame | None = None
    ucm: DataFrame | None = None
    n: int = 10
    epochs: int = 10


def _by_items(s: Setting, profile: DataFrame, w: DataFrame) -> DataFrame:
    return ranking.top_n_weighted(profile, w, s.users, s.n_items, s.n, s.train)


def _by_users(s: Setting, ratings: DataFrame, w: DataFrame) -> DataFrame:
    return _by_items(s, ranking.neighbour_profiles(w), ranking.rating_weights(ratings))


def _factors(s: Setting, users: DataFrame, items: DataFrame, mu: float = 0.0) -> DataFrame:
    wanted = users.join(s.users.select(F.col("user_id").alias("id")), "id", "left_semi")
    return ranking.top_n_factors(wanted, items, s.n, s.train.select("user_id", "item_id"), mu)


def _sgd(s: Setting, model: str, **p) -> DataFrame:
    users, v, bias, mu = next(islice(factorisation.sgd_epochs(s.train, s.n_items, model, **p), s.epochs - 1, None))
    return _factors(s, users, factorisation.item_table(s.train.sparkSession, v, bias), mu)


def _item_knn(s: Setting, kind: str, **p) -> DataFrame:
    w, profile = recommenders.item_knn_cf(s.train, s.n_items, kind=kind, **p)
    return _by_items(s, profile, w)


def _user_knn(s: Setting, kind: str, **p) -> DataFrame:
    w, profile = recommenders.user_knn_cf(s.train, s.n_users, kind=kind, **p)
    return _by_users(s, profile, w)


def _svd(s: Setting, factors: int) -> DataFrame:
    users, v, _ = factorisation.pure_svd(s.train, s.n_items, factors)
    return _factors(s, users, factorisation.item_table(s.train.sparkSession, v))


def _nmf(s: Setting, **p) -> DataFrame:
    users, h = factorisation.nmf(s.train, s.n_items, **p)
    return _factors(s, users, factorisation.item_table(s.train.sparkSession, h))


#: A function of a setting and a case's parameters for each collaborative model.
COLLABORATIVE: dict[str, Callable[..., DataFrame]] = {
    "p3alpha": lambda s, **p: _by_items(s, s.train, recommenders.p3alpha(s.train, **p)),
    "rp3beta": lambda s, **p: _by_items(s, s.train, recommenders.p3alpha(s.train, **p)),
    "funk": lambda s, **p: _sgd(s, "funk", **p),
    "asy": lambda s, **p: _sgd(s, "asy", **p),
    "bpr": lambda s, **p: _sgd(s, "bpr", **p),
    "als": lambda s, **p: _factors(s, *factorisation.implicit_als(s.train, rounds=s.epochs, **p)),
    "svd": _svd,
    "nmf": _nmf,
    "slim_bpr": lambda s, **p: _by_items(s, s.train, factorisation.slim_bpr(s.train, s.n_items, s.epochs, **p)),
    "slim": lambda s, **p: _by_items(s, s.train, factorisation.slim_elastic_net(s.train, s.n_items, s.n_users, **p)),
    "ease": lambda s, **p: _by_items(s, s.train, factorisation.ease(s.train, s.n_items, **p)),
}


def _item_content(s: Setting, kind: str, **p) -> DataFrame:
    return _by_items(s, s.train, recommenders.knn_cbf(s.icm.withColumnRenamed("item_id", "id"), s.n_items, kind=kind, **p))


def _user_content(s: Setting, kind: str, **p) -> DataFrame:
    return _by_users(s, s.train, recommenders.knn_cbf(s.ucm.withColumnRenamed("user_id", "id"), s.n_users, kind=kind, **p))


def _item_hybrid(s: Setting, kind: str, weight: float, **p) -> DataFrame:
    return _by_items(s, s.train, recommenders.item_knn_hybrid(s.train, s.icm, s.n_items, weight, kind=kind, **p))


def _user_hybrid(s: Setting, kind: str, weight: float, **p) -> DataFrame:
    return _by_users(s, s.train, recommenders.user_knn_hybrid(s.train, s.ucm, s.n_users, weight, kind=kind, **p))


#: Neighbourhood models, which take a similarity's kind too.
NEIGHBOURS = {"itemknn": _item_knn, "userknn": _user_knn, "itemknn_content": _item_content, "userknn_content": _user_content, "itemknn_hybrid": _item_hybrid, "userknn_hybrid": _user_hybrid}


def space_of(model: str, kind: str = "cosine") -> dict:
    if model in COLLABORATIVE:
        return tune.SPACES[model]
    return tune.knn_space(kind) | ({"weight": tune.CONTENT_WEIGHT} if model.endswith("hybrid") else {})


def fits(s: Setting, model: str, kind: str = "cosine") -> Callable[..., DataFrame]:
    """From parameters to lists (user_id, rank, item_id, score)."""
    if model in COLLABORATIVE:
        return lambda **p: COLLABORATIVE[model](s, **p)
    return lambda **p: NEIGHBOURS[model](s, kind, **p)


def search(s: Setting, validation: DataFrame, model: str, kind: str = "cosine", metric: str = "MAP", cases: int = 35, starts: int = 5, seed: int = 0) -> tune.Search:
    """Bayesian search of a model's space by a metric at cutoff s.n on the validation interactions (user_id, item_id,
    rating)."""
    users = s.users.join(evaluation.eligible(validation), "user_id", "left_semi")

    def measured(lists: DataFrame) -> float:
        return evaluation.accuracy(lists, validation, users, [s.n]).first()[metric]

    found = tune.Search(fits(s, model, kind), measured, space_of(model, kind))
    found.bayesian(cases, starts, seed)
    return found


def trained_until(s: Setting, validation: DataFrame, model: str, metric: str = "MAP", most: int = 100, every: int = 5, least: int = 0, patience: int = 5, **params) -> tuple[tuple, int, float]:
    """An SGD model ('funk', 'asy' or 'bpr') trained with early stopping on the validation interactions: the best model as
    sgd_epochs() yields it, its epoch and value."""
    users, epochs = s.users.join(evaluation.eligible(validation), "user_id", "left_semi"), factorisation.sgd_epochs(s.train, s.n_items, model, **params)

    def measured(m) -> float:
        lists = _factors(s, m[0], factorisation.item_table(s.train.sparkSession, m[1], m[2]), m[3])
        return evaluation.accuracy(lists, validation, users, [s.n]).first()[metric]

    return factorisation.early_stopping(lambda _: next(epochs), measured, most, every, least, patience)
