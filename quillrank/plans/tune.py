"""Hyperparameter search: random starts, then a Gaussian process that picks by expected improvement. Cases run one after
another on the driver; each fits and evaluates by Spark jobs. A failing case counts as the worst."""

from __future__ import annotations

import json
import math
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from quillrank.operators.statistics import normal_cdf

WORST = float(np.finfo(np.float16).max)


@dataclass(frozen=True)
class Integer:
    low: int
    high: int

    def at(self, u: float) -> int:
        return min(self.high, self.low + int(u * (self.high - self.low + 1)))


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def at(self, u: float) -> float:
        return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low))) if self.log else self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Choice:
    values: tuple

    def at(self, u: float):
        return self.values[min(len(self.values) - 1, int(u * len(self.values)))]


def knn_space(kind: str, weighting: bool = True) -> dict:
    space = {"k": Integer(5, 1000), "shrink": Integer(0, 1000), "normalise": Choice((True, False))}
    if kind == "asymmetric":
        space |= {"alpha": Real(0, 2), "normalise": Choice((True,))}
    elif kind == "tversky":
        space |= {"alpha": Real(0, 2), "beta": Real(0, 2), "normalise": Choice((True,))}
    if weighting and kind in ("cosine", "asymmetric"):
        space["feature_weighting"] = Choice(("none", "BM25", "TF-IDF"))
    return space


#: Search spaces of the collaborative models.
SPACES = {
    "p3alpha": {"k": Integer(5, 1000), "alpha": Real(0, 2), "normalise": Choice((True, False))},
    "rp3beta": {"k": Integer(5, 1000), "alpha": Real(0, 2), "beta": Real(0, 2), "normalise": Choice((True, False))},
    "funk": {"how": Choice(("sgd", "adagrad", "adam")), "factors": Integer(1, 200), "reg": Real(1e-5, 1e-2, True), "rate": Real(1e-4, 1e-1, True), "negatives": Real(0, 0.5)},
    "asy": {"how": Choice(("sgd", "adagrad", "adam")), "factors": Integer(1, 200), "reg": Real(1e-5, 1e-2, True), "rate": Real(1e-4, 1e-1, True)},
    "bpr": {"how": Choice(("sgd", "adagrad", "adam")), "factors": Integer(1, 200), "reg": Real(1e-5, 1e-2, True), "rate": Real(1e-4, 1e-1, True)},
    "als": {"factors": Integer(1, 200), "alpha": Real(1e-3, 50, True), "reg": Real(1e-5, 1e-2, True), "epsilon": Real(1e-3, 10, True)},
    "svd": {"factors": Integer(1, 350)},
    "nmf": {"factors": Integer(1, 350)},
    "slim_bpr": {"k": Integer(5, 1000), "symmetric": Choice((True, False)), "rate": Real(1e-4, 1e-1, True), "reg": Real(1e-5, 1e-2, True)},
    "slim": {"k": Integer(5, 1000), "l1_ratio": Real(1e-5, 1.0, True), "alpha": Real(1e-3, 1.0)},
    "ease": {"l2": Real(1, 1e7, True)},
}
CONTENT_WEIGHT = Real(1e-2, 1e2, True)


@dataclass
class Case:
    number: int
    params: dict
    value: float
    train_s: float
    evaluate_s: float
    exception: str | None = None


@dataclass
class Search:
    """fit(**params) gives a model, evaluate(model) the metric to maximise. A list of cases that ran before resumes."""

    fit: Callable
    evaluate: Callable
    space: dict
    cases: list[Case] = field(default_factory=list)
    best_model: object = None

    def run_case(self, params: dict) -> Case:
        began = time.time()
        try:
            model = self.fit(**params)
            mid = time.time()
            value = float(self.evaluate(model))
            if not math.isfinite(value):
                raise FloatingPointError("the metric isn't finite")
            case = Case(len(self.cases), params, value, mid - began, time.time() - mid)
            if all(value > c.value for c in self.cases if c.exception is None):
                self.best_model = model
        except Exception:  # a case that can't be fitted is a bad case
            case = Case(len(self.cases), params, -WORST, time.time() - began, 0.0, traceback.format_exc(limit=2))
        self.cases.append(case)
        return case

    def single(self, params: dict) -> Case:
        return self.run_case(params)

    def random(self, n: int, seed: int = 0) -> Case:
        rng = np.random.default_rng(seed)
        points = rng.random((n, len(self.space)))
        for u in points[len(self.cases) :]:
            self.run_case({k: s.at(float(x)) for (k, s), x in zip(self.space.items(), u, strict=True)})
        return self.best()

    def bayesian(self, n: int = 35, starts: int = 5, seed: int = 0) -> Case:
        """starts random cases, then n - starts by expected improvement of a Gaussian process (squared exponential
        kernel over the unit cube, noise 1e-5)."""
        rng = np.random.default_rng(seed)
        names, points = list(self.space), []
        while len(points) < n:
            if len(points) < starts:
                u = rng.random(len(names))
            else:
                x, y = np.array(points), np.array([max(c.value, -1e3) for c in self.cases[: len(points)]])
                y = (y - y.mean()) / (y.std() or 1.0)
                kernel = lambda a, b: np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(2) / (2 * 0.3**2))
                low = np.linalg.cholesky(kernel(x, x) + 1e-5 * np.eye(len(x)))
                c = rng.random((512, len(names)))
                kc = kernel(c, x)
                mean = kc @ np.linalg.solve(low.T, np.linalg.solve(low, y))
                sd = np.sqrt(np.maximum(1e-12, 1 - (np.linalg.solve(low, kc.T) ** 2).sum(0)))
                z = (mean - y.max()) / sd
                gain = sd * (z * np.array([normal_cdf(v) for v in z]) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
                u = c[int(gain.argmax())]
            points.append(u)
            if len(points) > len(self.cases):  # cases that ran before are drawn again but not run
                self.run_case({k: self.space[k].at(float(v)) for k, v in zip(names, u, strict=True)})
        return self.best()

    def best(self) -> Case:
        return max(self.cases, key=lambda c: c.value)

    def metadata(self) -> str:
        return json.dumps([c.__dict__ for c in self.cases])

    def refit(self, fit_on_all: Callable):
        """The best case's parameters, fitted on train and validation together."""
        return fit_on_all(**self.best().params)
