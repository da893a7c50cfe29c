"""Classifier heads over feature columns: pyspark.ml where it has them, Arrow-batched numpy inside groups where not."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quefrency.functions import columns
from quefrency.operators import moments


def pop_scaled(frame: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Features less their mean, by their population deviation; constant ones by 1."""
    stats = (fit_on if fit_on is not None else frame).agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return frame.withColumns({c: (F.col(c) - float(stats[f"m_{c}"] or 0)) / float(stats[f"s_{c}"] or 1) for c in features})


def assembled(frame: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(frame)


@dataclass
class Softmax:
    """One model of grouped_logistic(): labels, scaling, weights (bias last; one row for two labels, a row a label for more)."""

    labels: list
    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    best: np.ndarray | None = None
    step: np.ndarray | None = None
    value: float = np.inf
    done: bool = False
    curve: np.ndarray | None = None  # curvature of the last step that had its own
    bent: bool = True  # whether the next step needs one of its own

    def design(self, s: np.ndarray) -> np.ndarray:
        return np.column_stack([(s - self.mean) / self.std, np.ones(len(s))])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities but for a number that a row's labels share."""
        z = x @ self.w.T
        z = np.column_stack([np.zeros(len(x)), z]) if len(self.labels) <= 2 else z
        return z[:, : len(self.labels)]

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        z = self.margins(x)
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)

    def derivatives(self, s: np.ndarray, y: np.ndarray, curve: bool = True) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Loss of rows with label numbers y, its gradient and (if asked for) its Hessian, by the weights in order."""
        x, k = self.design(s), len(self.w)
        z = self.margins(x)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        total = p.sum(axis=1, keepdims=True)
        p /= total
        free = p[:, -k:]
        error = free - (y[:, None] == np.arange(len(self.labels))[-k:])
        loss, g = float((np.log(total[:, 0]) - z[np.arange(len(y)), y]).sum()), (error.T @ x).ravel()
        if not curve:
            return loss, g, None
        d = x.shape[1]
        wide = (np.ascontiguousarray(free.T)[:, None] * np.ascontiguousarray(x.T)).reshape(k * d, len(x))
        h = -(wide @ wide.T).reshape(k, d, k, d)  # of one matrix with itself, half the work
        h[np.arange(k), :, np.arange(k)] += (wide @ x).reshape(k, d, d)
        return loss, g, h.reshape(k * d, k * d)

    def move(self, loss: float, g: np.ndarray, h: np.ndarray | None, c: float, tol: float) -> None:
        """A Newton step on c loss + |w|^2 / 2 without the bias, halved while it does not help. Where each label has a bias, the
        same number added to all of them changes nothing: curvature is added in that direction, in which the gradient is but
        rounding, so that steps do not drift along it for ever. h: None for the curvature of the step before, which is as good
        where steps are short; while they do not get shorter fast, the next one asks for its own."""
        free = np.ones(self.w.shape)
        free[:, -1] = 0
        value = c * loss + float((free * self.w**2).sum()) / 2
        before = np.abs(self.step).max() if self.step is not None else np.inf
        if self.best is not None and value > self.value + 1e-10 * abs(self.value):
            self.step, self.bent = self.step / 2, True
            self.done = bool(np.abs(self.step).max() < tol)
            self.w = self.best if self.done else self.best + self.step
            return
        self.best, self.value = self.w, value
        if h is not None:
            h = c * h + np.diag((free + 1e-9 * (1 - free)).ravel())
            if len(self.w) > 2:
                bias = np.ix_(*2 * [np.flatnonzero(free.ravel() == 0)])
                h[bias] += np.trace(h[bias]) / len(self.w)
            self.curve = h
        self.step = -np.linalg.solve(self.curve, c * g + (free * self.w).ravel()).reshape(self.w.shape)
        size = np.abs(self.step).max()
        self.done, self.bent = bool(size < tol), bool(size > 0.1 or size > before / 8)
        self.w = self.best + self.step


#: What models see in rows of a key: a model's name, the function that makes its features, and the part its rows are in (None: all).
Views = Callable[[str], list[tuple]]


def _as_it_is(key: str) -> list[tuple]:
    return [(key, lambda s: s, None)]


def _viewed(batch: pa.RecordBatch, views: Views, want=None) -> Iterator[tuple[str, np.ndarray, list, np.ndarray]]:
    """Each model with rows in a batch (key, y, s, and parts where views name any): its name, their features, labels of the
    batch, and the rows' places among them. Features are made once a model, and rows are taken once a part."""
    k, y, x = batch.column("key").dictionary_encode(), batch.column("y").dictionary_encode(), columns.Lists(batch.column("s"))
    code, label = (d.indices.fill_null(-1).to_numpy(zero_copy_only=False) for d in (k, y))
    labels, fine = y.dictionary.to_pylist(), (label >= 0) & (x.size >= 0)
    if "parts" in batch.schema.names:
        p = columns.Lists(batch.column("parts"))
        of, row = p.values.astype(np.int32), np.repeat(np.arange(batch.num_rows), np.maximum(p.size, 0))
    for i, name in enumerate(k.dictionary.to_pylist()):
        own, seen = np.flatnonzero(fine & (code == i)), [v for v in views(name) if want is None or v[0] in want]
        if not len(own) or not seen:
            continue
        m, at = x.matrix(own), label[own]
        taken: dict = {None: (m, at)}
        if any(part is not None for _, _, part in seen):
            place = np.full(batch.num_rows, -1)
            place[own] = np.arange(len(own))
            r = place[row]
            rows, split = r[r >= 0], of[r >= 0]
            order = np.argsort(split, kind="stable")
            rows, split = rows[order], split[order]
        for model, f, part in seen:
            if part not in taken:
                some = rows[np.searchsorted(split, part) : np.searchsorted(split, part, "right")]
                taken = {None: taken[None], part: (m[some], at[some])}
            s, y_ = taken[part]
            if len(y_):
                yield model, f(s), labels, y_


def view_moments(own: DataFrame, views: Views = _as_it_is) -> dict[str, dict[tuple, tuple]]:
    """name -> (label,) -> (n, mean, scatter) of the features that each model sees."""

    def each(b: pa.RecordBatch):
        for name, s, labels, at in _viewed(b, views):
            order = np.argsort(at, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                yield (name, labels[at[rows[0]]]), s[rows]

    out: dict[str, dict[tuple, tuple]] = {}
    for (name, y), part in moments.grouped(own, {"key": "string", "y": own.schema["y"].dataType.simpleString()}, each, arrow=True).items():
        out.setdefault(name, {})[(y,)] = part
    return out


def fit_logistic(own: DataFrame, views: Views = _as_it_is, c: float = 1.0, steps: int = 60, tol: float = 1e-6, start: dict[str, np.ndarray] | None = None) -> dict[str, Softmax]:
    """Models by name, of rows (key string, y, s array<double>), over features scaled to the rows' mean and population
    deviation. The objective is that of C = c, with free intercepts.

    views: the models that rows of a key belong to, each with the features that it sees in them: by default one, named like
    the key. Features of many models are made inside the tasks, so rows are read once for all of them. A view that names a
    part takes the rows whose column parts (array<int>) holds it: a row that many models learn from is not copied for them.

    All models take their Newton steps together: a step is one pass that sums gradients, and Hessians of models whose steps are
    long, by model. What meets on the driver is one row a model. start: weights to begin with, by name; the optimum is the same, as there is but one.
    """
    models = {}
    for name, parts in view_moments(own, views).items():
        labels, total = sorted(y for (y,) in parts), None
        for v in labels:
            total = moments.merged(total, parts[(v,)]) if total else parts[(v,)]
        mean, std = total[1], moments.deviation(*total)
        w, near = np.zeros((1 if len(labels) <= 2 else len(labels), len(mean) + 1)), (start or {}).get(name)
        models[name] = Softmax(labels, mean, std, near if near is not None and near.shape == w.shape else w, done=len(labels) < 2)

    for _ in range(steps):
        open_ = {k: m for k, m in models.items() if not m.done}
        if not open_:
            break

        def each(b: pa.RecordBatch, now=open_):
            for name, s, labels, at in _viewed(b, views, now):
                place = {v: i for i, v in enumerate(now[name].labels)}
                f, g, h = now[name].derivatives(s, np.array([place.get(v, 0) for v in labels])[at], now[name].bent)
                yield (name,), np.concatenate([[f], g, h[np.triu_indices(len(g))] if h is not None else []])  # a Hessian is symmetric: half of it is sent

        for (name,), v in moments.summed(own, {"key": "string"}, each, arrow=True).items():
            n, h = open_[name].w.size, None
            if open_[name].bent:
                h = np.zeros((n, n))
                h[np.triu_indices(n)] = v[n + 1 :]
                h = np.triu(h, 1).T + h
            open_[name].move(float(v[0]), v[1 : n + 1], h, c, tol)
    return models


def fit_splits(own: DataFrame, views: Views) -> dict[str, Softmax]:
    """fit_logistic() of views that name parts, for models (`key:part`) of parts that have most rows in common: those of part 0
    come first, and the others begin with their weights."""
    of = lambda first: lambda key: [v for v in views(key) if (v[2] == 0) == first]
    near = fit_logistic(own, of(True))
    begin = {m: near[f"{key}:0"].w for key in {k.rpartition(":")[0] for k in near} for m, _, _ in views(key)}
    return near | fit_logistic(own, of(False), start=begin)


def logistic_scores(test: DataFrame, key: str, s: str, kind: DataType, models: dict[str, Softmax], features: dict[str, Callable] | None = None) -> DataFrame:
    """test with p, and probability by label in their order, by the model that the column `key` names; null without one.
    kind: of the labels; features: what a model sees in s."""
    label = to_arrow_type(kind)

    def each(name: str, x: np.ndarray) -> list[pa.Array] | None:
        m = models.get(name)
        if m is None:
            return None
        p = np.exp(m.log_probability(m.design(features[name](x) if features else x)))
        return [pa.array(m.labels, label).take(pa.array(p.argmax(axis=1))), columns.packed(p)]

    def score(k: pa.Array, x: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(columns.by_key(k, x, [label, columns.VECTOR], each), ["p", "probability"])

    scored = F.arrow_udf(score, f"p {kind.simpleString()}, probability array<double>")
    return test.withColumn("__r", scored(F.col(key), F.col(s).cast("array<double>"))).select(*test.columns, "__r.p", "__r.probability")


def grouped_logistic(train: DataFrame, test: DataFrame, key: str, y: str, s: str = "s", c: float = 1.0, steps: int = 60, tol: float = 1e-6) -> DataFrame:
    """test with p, and probability by label in their order: a model of fit_logistic() for each value of the string column `key`."""
    own = train.select(F.col(key).alias("key"), F.col(y).alias("y"), F.col(s).cast("array<double>").alias("s"))
    return logistic_scores(test, key, s, own.schema["y"].dataType, fit_logistic(own, c=c, steps=steps, tol=tol))


def logistic(train: DataFrame, test: DataFrame, y: str, features: list[str]) -> DataFrame:
    """test with p and probability by label: one model of grouped_logistic() over feature columns."""
    wide = lambda d: d.withColumn("__key", F.lit("all")).withColumn("__s", F.array(*(F.col(f"`{c}`").cast("double") for c in features)))
    return grouped_logistic(wide(train), wide(test), "__key", y, "__s").drop("__key", "__s")


def fourier_svm(train: DataFrame, test: DataFrame, y: str, features: list[str], c: float = 10.0, width: int = 128, seed: int = 2026) -> DataFrame:
    """test with p. An approximation of a Gaussian-kernel machine: random Fourier features and linear machines, one against the rest."""
    var = train.agg(*(F.var_pop(f).alias(f) for f in features)).first()
    gamma = 1 / (len(features) * max(float(np.mean([var[f] for f in features])), 1e-12))
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(len(features), width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, width)

    @F.pandas_udf("array<double>")
    def lift(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in cols])
        return pd.Series(list(np.sqrt(2 / width) * np.cos(x @ w + b)))

    up = lambda d: d.withColumn("features", array_to_vector(lift(*features)))
    svm = OneVsRest(classifier=LinearSVC(regParam=1 / (c * max(train.count(), 1)), maxIter=50), labelCol=y)
    model = svm.fit(up(train.withColumn(y, F.col(y).cast("double"))))
    return model.transform(up(test)).withColumn("p", F.col("prediction").cast("int")).drop("features", "rawPrediction", "prediction")


@dataclass
class Scale:
    """Mean and population deviation of a key's features, and the moments of its classes."""

    mean: np.ndarray
    std: np.ndarray
    classes: dict

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return (s - self.mean) / self.std


def _keyed(train: DataFrame, key: str, y: str, s: str) -> tuple[DataFrame, str, dict[str, Scale]]:
    """Rows as key, y, s; the type of y; and each key's scale."""
    own = train.select(F.col(key).alias("key"), F.col(y).alias("y"), F.col(s).cast("array<double>").alias("s"))
    kind = own.schema["y"].dataType.simpleString()

    by_key: dict[str, dict] = {}
    for (k, c), part in moments.grouped(own, {"key": "string", "y": kind}, lambda b: moments.by_groups(b, ["key", "y"]), arrow=True).items():
        by_key.setdefault(k, {})[c] = part
    scales = {}
    for k, parts in by_key.items():
        parts = dict(sorted(parts.items(), key=lambda kv: kv[0]))
        total = None
        for p in parts.values():
            total = moments.merged(total, p) if total else p
        scales[k] = Scale(total[1], moments.deviation(*total), parts)
    return own, kind, scales


def _scored(test: DataFrame, key: str, s: str, kind: str, scales: dict[str, Scale], best: Callable[[str, np.ndarray], np.ndarray]) -> DataFrame:
    """test with p, from each key's place of the best class for scaled rows; null for keys without a model."""

    def run(k: pd.Series, v: pd.Series) -> pd.Series:
        out: list = [None] * len(k)
        for name, rows in k.reset_index(drop=True).groupby(k.to_numpy()).groups.items():
            if name in scales:
                classes = list(scales[name].classes)
                for i, c in zip(rows, best(name, scales[name](moments.stacked(v.iloc[rows]))), strict=True):
                    out[i] = classes[int(c)]
        return pd.Series(out, dtype=object)

    return test.withColumn("p", F.pandas_udf(run, kind)(F.col(key), F.col(s).cast("array<double>")))


def _log_parts(x: np.ndarray, model: tuple) -> np.ndarray:
    w, m, v = model
    return np.log(w) - 0.5 * (((x[:, None] - m) ** 2 / v).sum(axis=2) + np.log(2 * np.pi * v).sum(axis=1))


def fit_mixtures(own: DataFrame, kind: str, scales: dict[str, Scale], parts: int = 2, reg: float = 1e-3, steps: int = 50, tol: float = 1e-4, seed: int = 2026) -> dict[tuple, tuple]:
    """(key, class) -> weights, means and variances of a diagonal mixture over scaled features. A step of EM is one pass that
    sums responsibilities, first and second moments for all mixtures together; those whose means stand still are done."""
    models = {}
    for k, scale in scales.items():
        for i, (c, (n, mean, scatter)) in enumerate(scale.classes.items()):
            m, v = scale(mean), np.diag(scatter) / n / scale.std**2 + reg
            models[k, c] = np.full(parts, 1 / parts), m + np.random.default_rng([seed, i]).normal(size=(parts, len(m))) * np.sqrt(v) / 2, np.tile(v, (parts, 1))
    open_ = set(models)
    for _ in range(steps):
        if not open_:
            break

        def each(b: pa.RecordBatch, now={u: models[u] for u in open_}):  # noqa: B006
            for u, s in moments.by_groups(b, ["key", "y"]):
                if u in now:
                    x = scales[u[0]](s)
                    lp = _log_parts(x, now[u])
                    r = np.exp(lp - np.logaddexp.reduce(lp, axis=1, keepdims=True))
                    yield u, np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), (r.T @ x**2).ravel()])

        for u, v in moments.summed(own, {"key": "string", "y": kind}, each, arrow=True).items():
            n, d = np.maximum(v[:parts], 1e-9), len(scales[u[0]].mean)
            first, second = v[parts : parts + parts * d].reshape(parts, d), v[parts + parts * d :].reshape(parts, d)
            mean = first / n[:, None]
            still = np.abs(mean - models[u][1]).max() < tol
            models[u] = n / n.sum(), mean, np.maximum(second / n[:, None] - mean**2, 0) + reg
            if still:
                open_.discard(u)
    return models


def grouped_mixture(train: DataFrame, test: DataFrame, key: str, y: str, s: str = "s", parts: int = 2, reg: float = 1e-3, steps: int = 50, seed: int = 2026) -> DataFrame:
    """test with p: for each value of the string column `key`, the class whose mixture of fit_mixtures() is the likeliest."""
    own, kind, scales = _keyed(train, key, y, s)
    models = fit_mixtures(own, kind, scales, parts, reg, steps, seed=seed)
    best = lambda k, x: np.column_stack([np.logaddexp.reduce(_log_parts(x, models[k, c]), axis=1) for c in scales[k].classes]).argmax(axis=1)
    return _scored(test, key, s, kind, scales, best)


def _single(f, train: DataFrame, test: DataFrame, y: str, features: list[str], **options) -> DataFrame:
    wide = lambda d: d.withColumn("__key", F.lit("all")).withColumn("__s", F.array(*(F.col(f"`{c}`").cast("double") for c in features)))
    a = wide(train).persist()  # read again by every step of the fit
    out = f(a, wide(test), "__key", y, "__s", **options).drop("__key", "__s")
    a.unpersist()
    return out


def gaussian_mixture(train: DataFrame, test: DataFrame, y: str, features: list[str], **options) -> DataFrame:
    """test with p: one model of grouped_mixture() over feature columns."""
    return _single(grouped_mixture, train, test, y, features, **options)


@dataclass
class Landmarks:
    """A key's Nystrom features of the Gaussian kernel: products of two rows' features are about their kernel."""

    rows: np.ndarray
    gamma: float
    turn: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, spread: float) -> Landmarks:
        """spread: the mean variance of the scaled features."""
        gamma = 1 / (rows.shape[1] * max(spread, 1e-12))
        at = cls(rows, gamma, np.eye(len(rows)))
        e, u = np.linalg.eigh(at.kernel(rows))
        held = e > 1e-8 * e.max()
        return cls(rows, gamma, u[:, held] / np.sqrt(e[held]))

    def kernel(self, x: np.ndarray) -> np.ndarray:
        d2 = (x**2).sum(axis=1)[:, None] + (self.rows**2).sum(axis=1) - 2 * x @ self.rows.T
        return np.exp(-self.gamma * np.maximum(d2, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.kernel(x) @ self.turn, np.ones(len(x))])


def _landmarks(own: DataFrame, scales: dict[str, Scale], width: int) -> dict[str, Landmarks]:
    """At most `width` rows of each key, the first distinct ones by a hash: what meets on the driver has that bound."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("s"), "s")
    few = own.select("key", "s").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= width).collect()
    held: dict[str, list] = {}
    for r in sorted(few, key=lambda r: (r["key"], r["n"])):
        held.setdefault(r["key"], []).append(r["s"])
    out = {}
    for k, rows in held.items():
        total = sum(n for n, _, _ in scales[k].classes.values())
        mean = sum(n * scales[k](m) for n, m, _ in scales[k].classes.values()) / total
        var = sum(np.diag(q) / scales[k].std**2 + n * (scales[k](m) - mean) ** 2 for n, m, q in scales[k].classes.values()) / total
        out[k] = Landmarks.of(scales[k](np.array(rows, float)), float(var.mean()))
    return out


def fit_machines(own: DataFrame, kind: str, scales: dict[str, Scale], marks: dict[str, Landmarks], c: float = 10.0, steps: int = 80, tol: float = 1e-3) -> dict[str, np.ndarray]:
    """key -> weights of one machine for each pair of classes (pairs in order; bias last): the least |w|^2 / 2 + c times the
    squared hinge losses of the pair's rows.

    A step is one pass that sums the gradients of all machines of all keys. Curvature is bounded by that of all rows of both
    classes, known from one pass of moments, so that every step helps; steps are accelerated.
    """

    def second(b: pd.DataFrame):
        for (k, y), rows in b.groupby(["key", "y"]).groups.items():
            z = marks[k](scales[k](moments.stacked(b.loc[rows, "s"])))
            yield (k, y), (z.T @ z).ravel()

    square = moments.summed(own, {"key": "string", "y": kind}, second)
    pairs, bound, w = {}, {}, {}
    for k, scale in scales.items():
        classes = list(scale.classes)
        pairs[k] = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
        size = marks[k].turn.shape[1] + 1
        free = np.eye(size)
        free[-1, -1] = 1e-9
        bound[k] = [np.linalg.inv(free + 2 * c * (square[k, classes[i]] + square[k, classes[j]]).reshape(size, size)) for i, j in pairs[k]]
        w[k] = np.zeros((len(pairs[k]), size))
    ahead, pace, open_ = {k: v.copy() for k, v in w.items()}, dict.fromkeys(w, 1.0), {k for k in w if len(pairs[k])}
    for _ in range(steps):
        if not open_:
            break

        def each(b: pd.DataFrame, now={k: ahead[k] for k in open_}):  # noqa: B006
            for k, rows in b.groupby("key").groups.items():
                if k in now:
                    place = {v: i for i, v in enumerate(scales[k].classes)}
                    z = marks[k](scales[k](moments.stacked(b.loc[rows, "s"])))
                    y, f = b.loc[rows, "y"].map(place).to_numpy(int), z @ now[k].T
                    sign = np.zeros(f.shape)
                    for n, (i, j) in enumerate(pairs[k]):
                        sign[y == i, n], sign[y == j, n] = 1, -1
                    short = np.where(sign != 0, np.maximum(1 - sign * f, 0), 0)
                    yield (k,), (-2 * c * (sign * short).T @ z).ravel()

        for (k,), g in moments.summed(own, {"key": "string"}, each).items():
            held = ahead[k].copy()
            held[:, -1] *= 1e-9
            g = g.reshape(ahead[k].shape) + held
            new = ahead[k] - np.stack([p @ row for p, row in zip(bound[k], g, strict=True)])
            turned = ((ahead[k] - new) * (new - w[k])).sum() > 0  # momentum led away: begin it anew
            after = 1.0 if turned else (1 + np.sqrt(1 + 4 * pace[k] ** 2)) / 2
            ahead[k] = new + (0.0 if turned else (pace[k] - 1) / after) * (new - w[k])
            if np.abs(new - w[k]).max() < tol * max(np.abs(new).max(), 1e-12):
                open_.discard(k)
            w[k], pace[k] = new, after
    return w


def grouped_machines(train: DataFrame, test: DataFrame, key: str, y: str, s: str = "s", c: float = 10.0, width: int = 64, steps: int = 80, tol: float = 1e-3) -> DataFrame:
    """test with p: for each value of the string column `key`, kernel machines of every pair of classes; the class with the
    most votes, the first of ties. The Gaussian kernel, scaled by the number and variance of the features, is approximated
    by `width` landmarks, and the hinge loss is squared."""
    own, kind, scales = _keyed(train, key, y, s)
    marks = _landmarks(own, scales, width)
    w = fit_machines(own, kind, scales, marks, c, steps, tol)

    def best(k: str, x: np.ndarray) -> np.ndarray:
        n = len(scales[k].classes)
        f, votes = marks[k](x) @ w[k].T, np.zeros((len(x), n))
        for col, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, n)):
            votes[:, i] += f[:, col] > 0
            votes[:, j] += f[:, col] <= 0
        return votes.argmax(axis=1)

    return _scored(test, key, s, kind, scales, best)


def pair_machines(train: DataFrame, test: DataFrame, y: str, features: list[str], **options) -> DataFrame:
    """test with p: one model of grouped_machines() over feature columns."""
    return _single(grouped_machines, train, test, y, features, **options)


def spline_columns(x, lo: float, hi: float, knots: int = 5, degree: int = 3) -> list:
    """Cubic B-splines over uniform knots on [lo, hi], clipped to the range, without the last one (no bias): Cox-de Boor as columns."""
    step = (hi - lo) / (knots - 1) or 1.0
    t = [lo + step * i for i in range(-degree, knots + degree)]
    x = F.least(F.greatest(x, F.lit(lo)), F.lit(hi - 1e-12 * step))
    b = [F.when((x >= t[i]) & (x < t[i + 1]), 1.0).otherwise(0.0) for i in range(len(t) - 1)]
    for p in range(1, degree + 1):
        b = [(x - t[i]) / (t[i + p] - t[i]) * b[i] + (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return b[:-1]


def splines(x: np.ndarray, lo: float, hi: float, knots: int = 5, degree: int = 3) -> np.ndarray:
    """The columns of spline_columns() for an array of values."""
    step = (hi - lo) / (knots - 1) or 1.0
    t = [lo + step * i for i in range(-degree, knots + degree)]
    x = np.minimum(np.maximum(x, lo), hi - 1e-12 * step)
    b = [((x >= t[i]) & (x < t[i + 1])).astype(float) for i in range(len(t) - 1)]
    for p in range(1, degree + 1):
        b = [(x - t[i]) / (t[i + p] - t[i]) * b[i] + (t[i + p + 1] - x) / (t[i + p + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return np.column_stack(b[:-1])


def principal(frame: DataFrame, features: list[str], k: int = 20) -> DataFrame:
    """frame with pc: the first k principal components of z-scored features."""
    z = assembled(pop_scaled(frame, features), features)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(z).transform(z).drop("features")
