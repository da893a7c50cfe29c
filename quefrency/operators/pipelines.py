"""Whole classifications as plans: reconstruction features of many bases in one pass, heads fitted together, compared and judged.

Samples are rows (id, y, x) with x an array. A configuration is a basis with its size and alpha; all configurations are
columns of the same passes, so that a sweep costs no more jobs than one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quefrency.functions import basis, columns
from quefrency.operators import discriminant, heads, metrics, moments, splits, stats

EPS, RIDGE = 1e-8, 0.01


@dataclass(frozen=True)
class Config:
    basis: str
    alpha: float | None = None
    n: int = 3

    @property
    def name(self) -> str:
        return self.basis if self.alpha is None else f"{self.basis}:{self.alpha:g}"


DISCRETE = [Config(b) for b in ("polynomial", "fractional", "robust")]
COMPARED = [Config(b) for b in ("polynomial", "fractional", "trigonometric", "robust")]


def sweep(steps: int = 20) -> list[Config]:
    """PATP with alpha from 0 to 1."""
    return [Config("patp", i / steps) for i in range(steps + 1)]


def standardised(train: DataFrame, *frames: DataFrame, x: str = "x") -> list[DataFrame]:
    """The frames with x less the training rows' mean, by their population deviation where there is any; train comes first."""
    n, mean, scatter = moments.grouped(train.select(F.lit(0).alias("k"), F.col(x).cast("array<double>").alias("s")), {"k": "int"}, lambda b: moments.by_groups(b, ["k"]), arrow=True)[(0,)]
    std = np.sqrt(np.diag(scatter) / n)
    scale = columns.rows(partial(_scaled, mean=mean, std=np.where(std > 0, std, 1.0)))
    return [f.withColumn(x, scale(F.col(x).cast("array<double>"))) for f in (train, *frames)]


def _scaled(m, mean, std):
    return (m - mean) / std


@dataclass
class Reconstructions:
    """For each configuration and class the reconstruction of a sample's elements from their basis functions; a sample's
    features are the log mean squared errors of all classes."""

    configs: list[Config]
    ridge: float = RIDGE
    models: dict = field(default_factory=dict)  # config name -> class -> (constant, weights, condition)

    def fit(self, frame: DataFrame, y: str = "y", x: str = "x") -> Reconstructions:
        configs = self.configs

        def each(b):
            for (c,), m in moments.by_groups(b, ["y"], "x"):
                v = m.ravel()
                for g in configs:
                    yield (g.name, c), np.column_stack([basis.arrays(g.basis, v, g.n, g.alpha), v])

        own = frame.select(F.col(y).alias("y"), F.col(x).cast("array<double>").alias("x"))
        for (g, c), (n, mean, scatter) in moments.grouped(own, {"config": "string", "y": own.schema["y"].dataType.simpleString()}, each, arrow=True).items():
            if n < 2:
                raise ValueError(f"class {c} has fewer than two values")
            cov, k = scatter / n, len(mean) - 1
            f = cov[:k, :k] + self.ridge * np.eye(k)
            w = np.linalg.solve(f, cov[:k, k])
            self.models.setdefault(g, {})[c] = (mean[k] - w @ mean[:k], w, float(np.linalg.cond(f)))
        self.models = {g: dict(sorted(m.items(), key=lambda t: t[0])) for g, m in self.models.items()}
        return self

    def errors(self) -> Callable[[np.ndarray], np.ndarray]:
        """Samples -> (samples, configurations, classes) of features."""
        models, configs = self.models, self.configs

        def run(m: np.ndarray) -> np.ndarray:
            out = []
            for g in configs:
                phi = basis.arrays(g.basis, m, g.n, g.alpha)
                out.append(np.column_stack([np.log(((m - k0 - phi @ w) ** 2).mean(axis=1) + EPS) for k0, w, _ in models[g.name].values()]))
            return np.stack(out, axis=1)

        return run

    def features(self, frame: DataFrame, x: str = "x") -> DataFrame:
        """frame with key (a configuration's name) and s (a feature a class) instead of x: one pass for all configurations."""
        configs = self.configs
        made = frame.withColumn("__f", columns.frames(self.errors(), 1)(F.col(x).cast("array<double>"))).drop(x)
        each = made.select(*(c for c in frame.columns if c != x), F.posexplode("__f").alias("__i", "s"))
        return each.withColumn("key", F.array(*(F.lit(g.name) for g in configs))[F.col("__i")]).drop("__i")

    def conditions(self) -> dict[str, float]:
        """The worst condition of any class, by configuration."""
        return {g: max(k for *_, k in m.values()) for g, m in self.models.items()}

    def conditioning(self, spark, warn: float = 1e6) -> DataFrame:
        """config, y, cond, ill: one row a configuration and class."""
        rows = [(g, str(c), k, k > warn) for g, m in self.models.items() for c, (*_, k) in m.items()]
        return spark.createDataFrame(rows, "config string, y string, cond double, ill boolean")


def nearest_feature(train: DataFrame, test: DataFrame) -> DataFrame:
    """test with p: the class whose reconstruction errs least, ties to the first; needs no training rows but their labels."""
    labels = sorted(r[0] for r in train.select("y").distinct().collect())
    return test.withColumn("p", F.array(*map(F.lit, labels))[(F.array_position("s", F.array_min("s")) - 1).cast("int")])


def logistic_head(train: DataFrame, test: DataFrame) -> DataFrame:
    a = moments.spread_by(train, "key").persist()  # read again by every step of the fit
    out = heads.grouped_logistic(a, test, "key", "y").drop("probability")
    a.unpersist()
    return out


def _logistic_of_all(a: DataFrame, test: DataFrame, r: Reconstructions, hybrid: str | None) -> DataFrame:
    """test (key, s, and others) with p, by a logistic model for each configuration. A training row is kept once, with the features
    of all configurations side by side, and the models see their own."""
    errors, names, width = r.errors(), [g.name for g in r.configs], {g: len(m) for g, m in r.models.items()}
    size = width[names[0]]
    wide = columns.rows(lambda m: errors(m).reshape(len(m), -1))(F.col("x").cast("array<double>"))
    s = F.concat(wide, F.col(hybrid).cast("array<double>")) if hybrid else wide
    own = moments.dealt(a).select(F.lit("all").alias("key"), "y", s.alias("s")).persist()
    end = size * len(names)
    see = lambda i: lambda m: np.column_stack([m[:, i * size : (i + 1) * size], m[:, end:]])
    models = heads.fit_logistic(own, lambda key: [(g, see(i), None) for i, g in enumerate(names)])
    own.unpersist()
    return heads.logistic_scores(test, "key", "s", a.schema["y"].dataType, models).drop("probability")


def classify(train: DataFrame, test: DataFrame, configs: list[Config], head: Callable = logistic_head, ridge: float = RIDGE, standardize: bool = True, hybrid: str | None = None) -> tuple[DataFrame, Reconstructions]:
    """Test rows (key, their columns, p) under every configuration, and the fitted reconstructions. Rows: y, x, and others.

    hybrid: an array column of further features, put behind the reconstructions'.
    """
    a, b = standardised(train, test) if standardize else (train, test)
    r = Reconstructions(configs, ridge).fit(a)
    join = lambda f: f.withColumn("s", F.concat("s", F.col(hybrid).cast("array<double>"))) if hybrid else f
    tested = join(r.features(b)).drop(*([hybrid] if hybrid else []))
    if head is logistic_head:
        return _logistic_of_all(a, tested, r, hybrid).drop("s"), r
    return head(join(r.features(a)).select("key", "y", "s"), tested).drop("s"), r


def summary(pred: DataFrame, r: Reconstructions, hybrid_size: int = 0, y: str = "y") -> DataFrame:
    """basis, alpha, feature_dim, accuracy, macro_f1 (rounded to four places) and max_cond_F (to one), a row a configuration."""
    spark, cond = pred.sparkSession, r.conditions()
    rows = [(g.name, g.basis, g.alpha, len(r.models[g.name]) + hybrid_size, round(cond[g.name], 1)) for g in r.configs]
    info = spark.createDataFrame(rows, "key string, basis string, alpha double, feature_dim int, max_cond_F double")
    m = metrics.macro_f1(pred, ["key"], y)
    return info.join(m, "key").select("key", "basis", "alpha", "feature_dim", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"), "max_cond_F")


def run(train: DataFrame, test: DataFrame, main: Config = Config("fractional"), compared: list[Config] = (), hybrid: str | None = None, hybrid_size: int = 0, **options) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Predictions of the main configuration and the ones to compare, and their summary. A configuration listed twice runs once."""
    pred, r = classify(train, test, list(dict.fromkeys([main, *compared])), hybrid=hybrid, **options)
    return pred, summary(pred, r, hybrid_size)


def alpha_sweep(train: DataFrame, test: DataFrame, alphas: list[Config] | None = None, **options) -> DataFrame:
    """alpha, macro_f1, accuracy, best (largest macro-F1, the first of ties), at_boundary (within 0.05 of an end): one pass for all alphas."""
    configs = alphas or sweep()
    pred, _ = classify(train, test, configs, **options)
    of = pred.sparkSession.createDataFrame([(g.name, float(g.alpha)) for g in configs], "key string, alpha double")
    m = metrics.macro_f1(pred, ["key"]).join(of, "key")
    top = m.agg(F.min_by("alpha", F.struct(-F.col("macro_f1"), F.col("alpha"))).alias("top"))
    edge = (F.col("alpha") < 0.05) | (F.col("alpha") > 0.95)
    return m.crossJoin(F.broadcast(top)).select("alpha", "macro_f1", "accuracy", (F.col("alpha") == F.col("top")).alias("best"), edge.alias("at_boundary"))


def select_basis(train: DataFrame, group: str, seed: int = 2026, alphas: list[Config] | None = None, **options) -> Config:
    """The best of three bases on an inner grouped split, or a PATP that is strictly better. All candidates are one fit."""
    split = splits.grouped_split(train, group, 0.25, seed + 10)
    inner, val = split.where("role = 'train'").select("y", "x"), split.where("role = 'test'").select("y", "x")
    configs = [*DISCRETE, *(alphas or sweep(10))]
    pred, _ = classify(inner, val, configs, **options)
    f1 = {r["key"]: r["macro_f1"] for r in metrics.macro_f1(pred, ["key"]).collect()}  # one row a configuration
    score = lambda g: f1.get(g.name, -1.0)
    best = max(DISCRETE, key=score)
    patp = max(configs[len(DISCRETE) :], key=score)
    return patp if score(patp) > score(best) else best


def per_channel(train: DataFrame, test: DataFrame, config: Config, channels: list[str], ridge: float = RIDGE) -> tuple[DataFrame, DataFrame, dict]:
    """Both frames with s, the reconstruction features of each channel (an array column) end to end, and conditions by channel."""
    conds, out = {}, [train, test]
    for i, c in enumerate(channels):
        a, b = standardised(out[0], out[1], x=c)
        r = Reconstructions([config], ridge).fit(a, "y", c)
        conds[c] = {k: v[2] for k, v in r.models[config.name].items()}
        out = [r.features(f, c).withColumnRenamed("s", f"__s{i}").drop("key") for f in (a, b)]
    s = F.concat(*(F.col(f"__s{i}") for i in range(len(channels)))).alias("s")
    keep = [c for c in train.columns if c not in channels]
    return out[0].select(*keep, s), out[1].select(*keep, s), conds


# --- heads over descriptors, side by side ----------------------------------------------------------------------------


def splined(train: DataFrame, *frames: DataFrame, knots: int = 5) -> list[DataFrame]:
    """The frames with s replaced by cubic splines of each element over the training rows' range."""
    n = len(train.first()["s"])
    ends = train.agg(*(f(F.col("s")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    f = columns.rows(partial(_splines, ends=[(float(ends[f"lo{i}"]), float(ends[f"hi{i}"])) for i in range(n)], knots=knots))
    return [d.withColumn("s", f("s")) for d in frames]


def _splines(m: np.ndarray, ends: list[tuple[float, float]], knots: int) -> np.ndarray:
    return np.column_stack([heads.splines(m[:, i], lo, hi, knots) for i, (lo, hi) in enumerate(ends)])


def baseline_pack(train: DataFrame, test: DataFrame, key: str, seed: int = 2026) -> tuple[DataFrame, tuple[float, float]]:
    """method, the test rows' columns without s, p of four baselines at once (the nearest class, regularised discriminants, their
    diagonal form, additive splines of distances), and the tuned pair. Rows: key, y, s. One set of moments serves all."""
    inner = splits.stratified_inner(train, "y", key, seed=seed)
    best = discriminant.tune_rda(inner.where("role = 'inner'"), inner.where("role = 'val'"), "y", "s")
    m = discriminant.ClassMoments.fit(train, "y", "s")
    forms = {"C0_fixed_rule": [(mu, inv, -1.0, 0.0) for mu, inv, *_ in m.ridge_forms()], "RDA": m.rda_forms(*best), "diag_QDA": m.diagonal_forms()}
    kernels = [m.kernel(f) for f in forms.values()]
    most = columns.rows(lambda s: np.column_stack([k(s).argmax(axis=1) for k in kernels]).astype(float))
    keep = [c for c in test.columns if c != "s"]
    each = test.select(*keep, F.posexplode(most("s")).alias("__m", "__c"))
    first = each.select(F.array(*map(F.lit, forms))[F.col("__m")].alias("method"), *keep, F.array(*map(F.lit, m.classes))[F.col("__c").cast("int")].alias("p"))
    d2 = columns.rows(m.kernel(m.ridge_forms()))
    a, b = train.withColumn("s", d2("s")), test.withColumn("s", d2("s"))
    a = a.persist()
    a_, b_ = splined(a, a, b)
    gam = _headed(a_, b_, "Ghosh_GAM", keep)
    a.unpersist()
    return first.unionByName(gam), best


def _headed(train: DataFrame, test: DataFrame, method: str, keep: list[str]) -> DataFrame:
    own = lambda d: d.withColumn("key", F.lit(method))
    return logistic_head(own(train).select("key", "y", "s"), own(test)).select(F.lit(method).alias("method"), *keep, "p")


def compare_heads(train: DataFrame, test: DataFrame, key: str, group: str, seed: int = 2026) -> DataFrame:
    """method, the test rows' columns without s, p: eight ways to classify the same descriptors s."""
    keep = [c for c in test.columns if c != "s"]
    m = discriminant.ClassMoments.fit(train, "y", "s")
    labels, most = F.array(*map(F.lit, m.classes)), columns.rows(lambda s, k=m.kernel(m.qda_forms()): k(s).argmax(axis=1)[:, None].astype(float))
    qda = test.withColumn("p", labels[most("s")[0].cast("int")]).select(F.lit("QDA_stats").alias("method"), *keep, "p")
    # Descriptors and their log distances: two models that see the same rows, fitted together.
    sees = {"LR_stats": lambda s: s, "C2_log_distances": m.kernel(m.ridge_forms(), logs=True)}
    own = moments.dealt(train.select(F.lit("all").alias("key"), "y", F.col("s").cast("array<double>").alias("s"))).persist()
    models = heads.fit_logistic(own, lambda k: [(name, f, None) for name, f in sees.items()])
    own.unpersist()
    each = test.withColumn("method", F.explode(F.array(*map(F.lit, sees))))
    direct = heads.logistic_scores(each, "method", "s", train.schema["y"].dataType, models, sees).select("method", *keep, "p")
    as_x = lambda d: d.withColumnRenamed("s", "x")
    config = select_basis(as_x(train), group, seed)
    c1, _ = classify(as_x(train), as_x(test), [config])
    c1 = c1.select(F.lit("C1_reconstruction").alias("method"), *keep, "p")
    pack, _ = baseline_pack(train, test, key, seed)
    pack = pack.withColumn("method", F.concat(F.lit("pack_"), "method"))
    return reduce(DataFrame.unionByName, (direct, qda, c1, pack))


PAIRS = [("LR_stats", "C1_reconstruction"), ("LR_stats", "C2_log_distances"), ("QDA_stats", "C2_log_distances")] + [p for k in ("C0_fixed_rule", "RDA", "diag_QDA", "Ghosh_GAM") for p in (("LR_stats", f"pack_{k}"), (f"pack_{k}", "C2_log_distances"))]


def compare_pairs(pred: DataFrame, key: str, pairs: list[tuple[str, str]] = PAIRS, repeats: int = 1000, seed: int = 2026) -> DataFrame:
    """baseline, challenger, delta, p_value, ci_low, ci_high, significant of each pair of methods: paired bootstraps of
    macro-F1, all from one count of the rows' predictions."""
    wide = pred.groupBy(key).agg(F.first("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("method", "p"))).alias("__p"))
    each = wide.select("y", "__p", F.inline(F.array(*(F.struct(F.lit(a).alias("baseline"), F.lit(b).alias("challenger")) for a, b in pairs))))
    both = each.select("baseline", "challenger", "y", F.col("__p")[F.col("baseline")].alias("a"), F.col("__p")[F.col("challenger")].alias("b"))
    by = ["baseline", "challenger"]
    cells = stats.paired_cells(both, by).persist()  # at most classes^3 rows a pair, read twice
    return stats.paired_bootstrap(cells, stats.multinomial_resamples(cells, repeats, seed, by), keys=by)


# --- reports ---------------------------------------------------------------------------------------------------------


def checks(facts: DataFrame) -> DataFrame:
    """label, passed, detail of the checks that a one-row table of facts allows; a null fact leaves its check out.

    facts, any of: accuracy_alone, accuracy_baseline, accuracy_hybrid, p_value, ci_low, ci_high, significant, best_basis,
    best_f1, alpha_at_boundary, best_alpha, worst_cond.
    """
    has = set(facts.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None)
    text = lambda fmt, *c: F.format_string(fmt, *(col(x).cast("double") for x in c))

    def one(label: str, needs: list[str], passed: Column, detail: Column) -> Column:
        known = F.lit(True)
        for c in needs:
            known = known & col(c).isNotNull()
        return F.when(known, F.struct(F.lit(label).alias("label"), passed.cast("boolean").alias("passed"), detail.cast("string").alias("detail")))

    num = lambda c: col(c).cast("double")
    every = [
        one("features alone beat a coin", ["accuracy_alone", "accuracy_baseline"], num("accuracy_alone") > 0.5 + 1e-6, text("accuracy %.3f", "accuracy_alone")),
        one("hybrid beats the baseline", ["accuracy_hybrid", "accuracy_baseline"], num("accuracy_hybrid") > num("accuracy_baseline"), text("%.3f against %.3f", "accuracy_hybrid", "accuracy_baseline")),
        one("bootstrap p under 0.05", ["significant"], col("significant"), text("p %.4f, interval %+.4f to %+.4f", "p_value", "ci_low", "ci_high")),
        one("a basis is worth something", ["best_f1"], num("best_f1") > 0.5, F.concat(col("best_basis").cast("string"), text(", macro-F1 %.3f", "best_f1"))),
        one("best alpha is inside the range", ["alpha_at_boundary"], ~col("alpha_at_boundary").cast("boolean"), text("alpha %.2f", "best_alpha")),
        one("matrices are well-conditioned", ["worst_cond"], num("worst_cond") <= 1e6, text("condition %.3g", "worst_cond")),
    ]
    return facts.select(F.inline(F.filter(F.array(*every), lambda c: c.isNotNull())))


def report(facts: DataFrame) -> DataFrame:
    """One row: passed and total of checks(), and their lines in order."""
    c = checks(facts)
    line = F.concat(F.when(F.col("passed"), "[PASS] ").otherwise("[FAIL] "), "label", F.coalesce(F.concat(F.lit(": "), "detail"), F.lit("")))
    return c.agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"), F.collect_list(line).alias("lines"))
