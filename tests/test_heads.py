"""Mixtures and kernel machines of many keys, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quefrency.operators import heads


@pytest.fixture(scope="module")
def rows():
    """Two keys: rings that no line parts, and three clouds; one column is constant."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(240):
        y, turn = i % 2, rng.uniform(0, 2 * np.pi)
        r = (1 if y else 3) + rng.normal(scale=0.2)
        out.append((i, "rings", y, [r * np.cos(turn), r * np.sin(turn), 7.0]))
    for i in range(240, 480):
        y = 1 + i % 3
        out.append((i, "clouds", y, [*(rng.normal(size=2) * [1, 2] + [3 * y, -2 * y if i % 2 else 2 * y]), 1.0]))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, k, y, [float(v) for v in s]) for i, k, y, s in rows], "id int, k string, y int, s array<double>").repartition(5).persist()


def of(rows, key):
    x, y = np.array([r[3] for r in rows if r[1] == key]), np.array([r[2] for r in rows if r[1] == key])
    std = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(std > 0, std, 1), y


def test_mixtures_are_those_of_plain_em(frame, rows):
    steps = 12
    got = {(r.k, r.id): r.p for r in heads.grouped_mixture(frame, frame, "k", "y", "s", steps=steps).collect()}
    for key in ("rings", "clouds"):
        x, y = of(rows, key)
        scores = []
        for i, c in enumerate(np.unique(y)):
            v = x[y == c]
            var = v.var(axis=0) + 1e-3
            w, m, s = np.full(2, 0.5), v.mean(axis=0) + np.random.default_rng([2026, i]).normal(size=(2, 3)) * np.sqrt(var) / 2, np.tile(var, (2, 1))
            logs = lambda x, w, m, s: np.log(w) + np.stack([-0.5 * ((x - m[k]) ** 2 / s[k] + np.log(2 * np.pi * s[k])).sum(axis=1) for k in range(2)], axis=1)
            for _ in range(steps):
                r = np.exp(logs(v, w, m, s))
                r /= r.sum(axis=1, keepdims=True)
                n, old = r.sum(axis=0), m
                m = (r.T @ v) / n[:, None]
                w, s = n / len(v), np.stack([(r[:, k, None] * (v - m[k]) ** 2).sum(axis=0) / n[k] for k in range(2)]) + 1e-3
                if np.abs(m - old).max() < 1e-4:
                    break
            scores.append(np.logaddexp.reduce(logs(x, w, m, s), axis=1))
        want = np.unique(y)[np.argmax(scores, axis=0)]
        assert [got[key, r[0]] for r in rows if r[1] == key] == want.tolist()


def test_machines_reach_the_least_objective(frame, rows):
    own, kind, scales = heads._keyed(frame, "k", "y", "s")
    marks = heads._landmarks(own, scales, 40)
    w = heads.fit_machines(own, kind, scales, marks, c=10.0, steps=400, tol=1e-6)
    for key in ("rings", "clouds"):
        x, y = of(rows, key)
        z, classes = marks[key](x), np.unique(y)
        far = z[:, :-1] @ z[:, :-1].T - np.exp(-marks[key].gamma * ((x[:, None] - x) ** 2).sum(axis=2))
        assert np.abs(far).mean() < 0.02
        for n, (i, j) in enumerate((i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))):
            at = (y == classes[i]) | (y == classes[j])
            t, u = np.where(y[at] == classes[i], 1.0, -1.0), z[at]
            value = lambda v: v[:-1] @ v[:-1] / 2 + 10 * (np.maximum(1 - t * (u @ v), 0) ** 2).sum()  # noqa: B023, E731
            best = np.zeros(u.shape[1])
            for _ in range(50):  # Newton on the rows inside the margin
                inside = t * (u @ best) < 1
                free = np.diag([1.0] * (len(best) - 1) + [1e-9])
                best = np.linalg.solve(free + 20 * u[inside].T @ u[inside], 20 * u[inside].T @ t[inside])
            assert value(w[key][n]) == pytest.approx(value(best), rel=1e-3)


def test_machines_part_rings(frame):
    got = heads.grouped_machines(frame, frame, "k", "y", "s")
    assert got.where("k = 'rings' and p = y").count() >= 236 and got.where("k = 'clouds' and p = y").count() >= 190


def test_keys_without_a_model_get_none(spark, frame):
    other = spark.createDataFrame([(1, "none", 0, [0.0, 0.0, 0.0])], "id int, k string, y int, s array<double>")
    for f in (heads.grouped_machines, heads.grouped_mixture):
        assert f(frame.where("k = 'clouds'"), other, "k", "y", "s").first().p is None
    one = frame.where("k = 'clouds' and y = 2")
    assert {r.p for r in heads.grouped_machines(one, one, "k", "y", "s").collect()} == {2}


def test_newton_steps_end_with_many_labels():
    """The same number in all biases changes nothing; its rounding must not keep the steps going."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 10, 20000)
    s = np.log(rng.chisquare(8, size=(len(y), 10)) + 0.1)
    s[np.arange(len(y)), y] -= 0.1
    m = heads.Softmax(list(range(10)), s.mean(axis=0), s.std(axis=0), np.zeros((10, 11)))
    for _ in range(10):
        if not m.done:
            m.move(*m.derivatives(s, y), 1.0, 1e-6)
    assert m.done
    x = m.design(s)
    error = np.exp(m.log_probability(x)) - np.eye(10)[y]
    assert np.abs((error.T @ x + m.w * ([1] * 10 + [0]))).max() < 1e-4


def test_rows_of_several_parts_are_learned_from_without_copies(spark):
    """Models whose rows are named by an array of parts are those of fits on copies of the rows, and a step sends a row a model and task."""
    rng = np.random.default_rng(8)
    rows = [("all", int(rng.integers(3)), rng.normal(size=4).tolist(), [k for k in range(3) if rng.random() < 0.6]) for _ in range(300)]
    d = spark.createDataFrame(rows, "key string, y int, s array<double>, parts array<int>")
    got = heads.fit_logistic(d, lambda key: [(f"{key}:{k}", lambda s: s, k) for k in range(3)])
    copies = d.withColumn("part", F.explode("parts")).select(F.col("part").cast("string").alias("key"), "y", "s")
    want = heads.fit_logistic(copies)
    assert len(got) == len(want) == 3
    for k, m in want.items():
        assert np.allclose(got[f"all:{k}"].w, m.w, atol=1e-8) and got[f"all:{k}"].labels == m.labels


def test_splines_of_arrays_are_those_of_columns(spark):
    x = [-1.0, 0.0, 0.3, 1.7, 2.0, 5.0]
    want = spark.createDataFrame([(v,) for v in x], "x double").select(F.array(*heads.spline_columns(F.col("x"), 0.0, 2.0)).alias("b")).collect()
    assert np.allclose(heads.splines(np.array(x), 0.0, 2.0), [r.b for r in want])


def test_splits_begin_near_and_reuse_curvature(spark, monkeypatch):
    """Models of splits of the same rows have the weights of fits by themselves, and the last passes send no Hessian."""
    rng = np.random.default_rng(3)
    rows = [("a", int(k % 3), (rng.normal(size=2) + k % 3).tolist(), sorted(rng.choice(4, 3, replace=False).tolist())) for k in range(240)]
    own = spark.createDataFrame(rows, "key string, y int, s array<double>, parts array<int>").persist()
    moves, move = [], heads.Softmax.move
    monkeypatch.setattr(heads.Softmax, "move", lambda m, loss, g, h, *rest: (moves.append(h is None), move(m, loss, g, h, *rest))[1])
    views = lambda key: [(f"{key}:{k}", lambda s: s, k) for k in range(4)]
    got = heads.fit_splits(own, views)
    assert set(got) == {f"a:{k}" for k in range(4)} and moves[0] is False and moves[-1] is True
    for k in range(4):
        mine = [(y, s) for _, y, s, parts in rows if k in parts]
        y, x = np.array([a for a, _ in mine]), np.array([b for _, b in mine])
        m = got[f"a:{k}"]
        d = m.design(x)
        p = np.exp(m.log_probability(d))
        gradient = (p - np.eye(3)[y]).T @ d + m.w * [1, 1, 0]
        assert np.abs(gradient).max() < 1e-4  # a row's gradient is about 1
