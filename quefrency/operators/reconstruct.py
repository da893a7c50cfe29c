"""Per-class reconstruction from a basis: moments by one grouped pass, a small solve on the driver, scores as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.functions.basis import TensorBasis, basis


def moments(values: DataFrame, y: str, targets: list[str], phi: list) -> DataFrame:
    """Class sizes, means, and population covariances of basis columns with each other (f_i_j) and with the targets (b_i_t)."""
    x = values.select(y, *targets, *(c.alias(f"p{i}") for i, c in enumerate(phi)))
    n = len(phi)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(t).alias(f"m_{t}") for t in targets), *(F.avg(f"p{i}").alias(f"m{i}") for i in range(n))]
    aggs += [F.covar_pop(f"p{i}", f"p{j}").alias(f"f_{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.covar_pop(f"p{i}", t).alias(f"b_{i}_{t}") for i in range(n) for t in targets]
    return x.groupBy(y).agg(*aggs)


@dataclass
class Reconstructor:
    """log mean squared error of each class's reconstruction, for every sample. One row a class meets on the driver."""

    basis: str = "fractional"
    n: int = 3
    alpha: float | None = None
    ridge: float = 0.01
    eps: float = 1e-8
    models: dict = field(default_factory=dict)

    def phi(self, dims: list[str]) -> list:
        if len(dims) == 1:
            return basis(self.basis, F.col(dims[0]), self.n, self.alpha)
        return TensorBasis(self.basis, self.n, len(dims), self.alpha).columns([F.col(d) for d in dims])

    def fit(self, values: DataFrame, y: str, dims: list[str]) -> Reconstructor:
        """values: one row a component (one dim) or an observation (more dims)."""
        phi = self.phi(dims)
        for r in moments(values, y, dims, phi).collect():
            if r["n"] < 2:
                raise ValueError(f"class {r[y]} has fewer than two values")
            f = np.array([[r[f"f_{min(i, j)}_{max(i, j)}"] for j in range(len(phi))] for i in range(len(phi))]) + self.ridge * np.eye(len(phi))
            b = np.array([[r[f"b_{i}_{t}"] for t in dims] for i in range(len(phi))])
            k = np.linalg.solve(f, b)
            k0 = np.array([r[f"m_{t}"] for t in dims]) - k.T @ np.array([r[f"m{i}"] for i in range(len(phi))])
            self.models[r[y]] = (k0, k, float(np.linalg.cond(f)))
        return self

    def transform(self, values: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
        """keys, class, log_msed: one grouped pass over all classes."""
        phi = [c.alias(f"p{i}") for i, c in enumerate(self.phi(dims))]
        x = values.select(*keys, *dims, *phi)
        out = []
        for c in sorted(self.models):
            k0, k, _ = self.models[c]
            err = F.lit(0.0)
            for t, d in enumerate(dims):
                hat = F.lit(float(k0[t]))
                for i in range(len(phi)):
                    hat = hat + F.lit(float(k[i, t])) * F.col(f"p{i}")
                err = err + F.pow(F.col(d) - hat, F.lit(2.0))
            out.append(F.ln(F.avg(err / len(dims)) + self.eps).alias(f"c{c}"))
        wide = x.groupBy(*keys).agg(*out)
        pairs = F.map_from_arrays(F.array(*(F.lit(c) for c in sorted(self.models))), F.array(*(F.col(f"c{c}") for c in sorted(self.models))))
        return wide.select(*keys, F.explode(pairs).alias("class", "log_msed"))

    def conditioning(self, warn: float = 1e6) -> list[tuple]:
        return [(c, m[2], m[2] > warn) for c, m in sorted(self.models.items())]


def boundary(best: float, margin: float = 0.05) -> bool:
    """Whether a best alpha lies at the end of the range (strictly within margin)."""
    return best < margin or best > 1 - margin
