"""Gaussian discriminants: class moments by one grouped pass, small inverses on the driver, quadratic forms in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quefrency.functions import columns
from quefrency.operators import moments


def vector(features: list[str] | str) -> Column:
    """The features as one array column: of many columns, or an array already."""
    return F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*(F.col(f"`{c}`").cast("double") for c in features))


def by_class(b):
    for y, rows in b.groupby("y").groups.items():
        yield (y,), moments.stacked(b.loc[rows, "s"])


@dataclass
class ClassMoments:
    """Mean and population deviation of the features; count, mean and sample covariance of each class, standardised."""

    features: list[str] | str
    mean: np.ndarray
    std: np.ndarray
    classes: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, frame: DataFrame, y: str, features: list[str] | str) -> ClassMoments:
        own = frame.select(F.col(y).alias("y"), vector(features).alias("s"))
        return cls.of(moments.grouped(own, {"y": own.schema["y"].dataType.simpleString()}, by_class), features)

    @classmethod
    def of(cls, parts: dict[tuple, tuple], features: list[str] | str = "s") -> ClassMoments:
        """From the moments of each class, whose name ends its key."""
        parts = dict(sorted(((k[-1], v) for k, v in parts.items()), key=lambda kv: kv[0]))
        total = None
        for p in parts.values():
            total = moments.merged(total, p) if total else p
        mean, std = total[1], moments.deviation(*total)
        return cls(features, mean, std, {c: (k, (m - mean) / std, q / np.outer(std, std) / max(k - 1, 1)) for c, (k, m, q) in parts.items()})

    def part(self, at: list[int]) -> ClassMoments:
        """Moments of some of the features: entries and principal submatrices, no pass over rows."""
        sub = np.ix_(at, at)
        return ClassMoments(self.features, self.mean[at], self.std[at], {c: (k, mu[at], cov[sub]) for c, (k, mu, cov) in self.classes.items()})

    @property
    def size(self) -> int:
        return sum(k for k, _, _ in self.classes.values())

    # A form is (mean, inverse, factor, constant) of each class: factor (z - mean)' inverse (z - mean) + constant.

    def ridge_forms(self, ridge: float = 1e-2) -> list[tuple]:
        return [(mu, np.linalg.inv(cov + ridge * np.eye(len(mu))), 1.0, 0.0) for _, mu, cov in self.classes.values()]

    def gaussian(self, n: int, mu: np.ndarray, sigma: np.ndarray) -> tuple:
        """Log density and log prior of a class, but for a constant."""
        return mu, np.linalg.inv(sigma), -0.5, float(np.log(n / self.size) - 0.5 * np.linalg.slogdet(sigma)[1])

    def qda_forms(self, reg: float = 0.05) -> list[tuple]:
        return [self.gaussian(n, mu, (1 - reg) * s + reg * np.eye(len(mu))) for n, mu, s in self.classes.values()]

    def rda_forms(self, lam: float, gam: float) -> list[tuple]:
        """Covariances shrunk to the pooled one, then to a multiple of the identity."""
        pooled = sum((k - 1) * s for k, _, s in self.classes.values()) / (self.size - len(self.classes))

        def sigma(s):
            m = (1 - lam) * s + lam * pooled
            return (1 - gam) * m + gam * np.trace(m) / len(m) * np.eye(len(m))

        return [self.gaussian(k, mu, sigma(s)) for k, mu, s in self.classes.values()]

    def diagonal_forms(self, smoothing: float = 1e-9) -> list[tuple]:
        """Naive Bayes with Gaussian features; variances are population ones, smoothed by a share of the largest, which is 1."""
        return [self.gaussian(k, mu, np.diag(np.diag(s) * (k - 1) / k + smoothing)) for k, mu, s in self.classes.values()]

    def kernel(self, forms: list[tuple], logs: bool = False):
        """Rows of features -> rows of one score a class."""
        mean, std, size = self.mean, self.std, len(forms)
        try:  # inverse = turn turn', so that a form is a sum of squares, and those of all classes are one product
            turns = [np.linalg.cholesky(inverse) for _, inverse, _, _ in forms]
        except np.linalg.LinAlgError:
            turns = []
        turn = np.concatenate(turns, axis=1).T.copy() if turns else None
        shift = np.concatenate([mu @ t for (mu, *_), t in zip(forms, turns, strict=True)])[:, None] if turns else None
        factor, constant = (np.array([f[i] for f in forms])[:, None] for i in (2, 3))

        def run(s: np.ndarray) -> np.ndarray:
            z = (s - mean) / std
            if turns:
                v = turn @ z.T
                v -= shift
                v *= v
                q = v.reshape(size, -1, len(z)).sum(axis=1)
            else:
                q = np.stack([(((z - mu) @ inverse) * (z - mu)).sum(axis=1) for mu, inverse, _, _ in forms])
            return np.ascontiguousarray((np.log(q + 1e-9) if logs else factor * q + constant).T)

        return run

    def scores(self, frame: DataFrame, keys: list[str], forms: list[tuple], logs: bool = False) -> DataFrame:
        """keys, class, score."""
        wide = frame.select(*keys, columns.rows(self.kernel(forms, logs))(vector(self.features)).alias("__s"))
        return wide.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, self.classes)), F.col("__s"))).alias("class", "score"))

    def mahalanobis(self, frame: DataFrame, keys: list[str], ridge: float = 1e-2, logs: bool = False) -> DataFrame:
        """Squared distances to each class, or ln(distance + 1e-9)."""
        return self.scores(frame, keys, self.ridge_forms(ridge), logs)

    def qda(self, frame: DataFrame, keys: list[str], reg: float = 0.05) -> DataFrame:
        return self.scores(frame, keys, self.qda_forms(reg))

    def rda(self, frame: DataFrame, keys: list[str], lam: float, gam: float) -> DataFrame:
        return self.scores(frame, keys, self.rda_forms(lam, gam))

    def diagonal(self, frame: DataFrame, keys: list[str], smoothing: float = 1e-9) -> DataFrame:
        return self.scores(frame, keys, self.diagonal_forms(smoothing))

    def conditioning(self, ridge: float = 1e-2, warn: float = 1e6) -> list[tuple]:
        """class, 2-norm condition of its regularised covariance, whether that is too large."""
        out = [(c, float(np.linalg.cond(cov + ridge * np.eye(len(mu))))) for c, (_, mu, cov) in self.classes.items()]
        return [(c, k, k > warn) for c, k in out]


def nearest(scores: DataFrame, keys: list[str], smallest: bool = False) -> DataFrame:
    """The class with the largest (smallest) score, ties to the first class."""
    s = F.col("score") if smallest else -F.col("score")
    return scores.groupBy(*keys).agg(F.min_by("class", F.struct(s, F.col("class"))).alias("p"))


LAMBDAS, GAMMAS = (0.0, 0.25, 0.5, 0.75, 1.0), (0.0, 0.1, 0.25, 0.5)


def rda_grid(inner: DataFrame, val: DataFrame, y: str, features: list[str] | str, lams=LAMBDAS, gams=GAMMAS) -> DataFrame:
    """lam, gam, macro_f1, accuracy of each pair on val: moments once, and all pairs scored in one pass. Singular pairs are left out."""
    from quefrency.operators.metrics import macro_f1

    m, pairs = ClassMoments.fit(inner, y, features), []
    for lam in lams:
        for gam in gams:
            try:
                pairs.append((lam, gam, m.kernel(m.rda_forms(lam, gam))))
            except np.linalg.LinAlgError:
                continue
    kernels = [k for *_, k in pairs]
    best = columns.rows(lambda s: np.column_stack([k(s).argmax(axis=1) for k in kernels]).astype(float))
    each = val.select(F.col(y).alias("y"), F.posexplode(best(vector(features))).alias("pair", "at"))
    named = each.select("y", F.array(*map(F.lit, m.classes))[F.col("at").cast("int")].alias("p"), *(F.array(*(F.lit(float(p[i])) for p in pairs))[F.col("pair")].alias(n) for i, n in enumerate(("lam", "gam"))))
    return macro_f1(named, ["lam", "gam"])


def tune_rda(inner: DataFrame, val: DataFrame, y: str, features: list[str] | str, lams=LAMBDAS, gams=GAMMAS) -> tuple[float, float]:
    """The first best pair by macro-F1 on val."""
    best = rda_grid(inner, val, y, features, lams, gams).orderBy(F.desc("macro_f1"), "lam", "gam").first()
    return best["lam"], best["gam"]
