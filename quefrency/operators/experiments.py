"""Experiments as plans: representations x splits x channel severities, scored, compared and judged.

Windows are rows (window_id, y, grp, x). Training features are computed once and shared by all splits; test windows are
distorted by a channel of their own for each split and severity, drawn from a hash of those keys, so that results do not
depend on partitioning. Representation and split are columns: the models of all of them are fitted in the same passes,
with one row a model and class on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quefrency.functions import columns, signal
from quefrency.operators import compat, heads, metrics, moments, ranking, representations, spectra, stats
from quefrency.operators.discriminant import ClassMoments
from quefrency.operators.representations import Frames, Step

Representation = Callable[[DataFrame], DataFrame]  # those of this module are chains of kernels (Frames), made in one pass
IDS = ["split", "severity", "window_id", "frame_id", "y"]


@dataclass(frozen=True)
class Design:
    splits: int = 15
    severities: tuple[int, ...] = (1, 2, 3, 5, 8, 12)
    test_size: float = 0.3
    seed: int = 2026
    ridge: float = 1e-2
    head: str = "logistic"
    rng: str = "hash"  # or compat: the draws of published runs


def design_roles(windows: DataFrame, design: Design) -> DataFrame:
    """split, grp, role of a design."""
    if design.rng not in ("hash", "compat"):
        raise ValueError(f"unknown rng {design.rng!r}")
    return (compat.split_roles if design.rng == "compat" else split_roles)(windows, "grp", design.splits, design.test_size, design.seed)


# --- splits and channels ---------------------------------------------------------------------------------------------


def split_roles(windows: DataFrame, group: str, splits: int, test_size: float = 0.3, seed: int = 2026) -> DataFrame:
    """split, group, role of every split; the number of test groups is rounded half to even, one at least."""
    g = windows.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    g = ranking.by_hash(g, ["split"], F.md5(F.concat_ws(":", (F.col("split") + seed).cast("string"), F.col(group).cast("string"))), [group])
    cut = F.greatest(F.lit(1), F.bround(F.lit(test_size) * F.col("total")))
    return g.select("split", group, F.when(F.col("before") < cut, "test").otherwise("train").alias("role"))


def parts(roles: DataFrame, role: str, out: str = "parts") -> DataFrame:
    """grp, and the splits in which it has a role, as an array: a row a group."""
    return roles.where(F.col("role") == role).groupBy("grp").agg(F.array_sort(F.collect_list("split")).alias(out))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def taps(length: Column, *key: Column, decay: float = 0.7, scaled: bool = True) -> Column:
    """A channel of unit energy: tap 0 is 1 and tap k normal times exp(-decay k), before scaling. Scaling by columns draws all taps
    anew for each tap, since they are an expression inside its lambda: for many rows, leave it to _unit()."""

    def draw(k):
        far = F.sqrt(-2 * F.ln(uniform(*key, k, F.lit(0)))) * F.cos(2 * np.pi * uniform(*key, k, F.lit(1)))
        return F.when(k == 0, 1.0).otherwise(F.exp(-decay * k) * far)

    h = F.transform(F.sequence(F.lit(0), length - 1), draw)
    if not scaled:
        return h
    norm = F.sqrt(F.aggregate(h, F.lit(0.0), lambda a, e: a + e * e))
    return F.transform(h, lambda e: e / norm)


def _unit(h: np.ndarray) -> np.ndarray:
    """Rows of unit energy. Squares are summed in their order, as taps() does, so that results are equal to the last bit."""
    total = np.zeros(len(h))
    for c in h.T:
        total += c * c
    return h / np.sqrt(total)[:, None]


def _polar(k: Column, *key: Column, decay: float) -> tuple[Column, Column]:
    """Size and turn of tap k of a complex channel, before scaling."""
    size = F.sqrt(-2 * F.ln(uniform(*key, k, F.lit(0)))) * F.exp(-decay * k)
    return F.when(k == 0, 1.0).otherwise(size), F.when(k == 0, 0.0).otherwise(2 * np.pi * uniform(*key, k, F.lit(1)))


def complex_taps(length: Column, *key: Column, decay: float = 0.7) -> Column:
    """As taps(), with taps whose real and imaginary parts are normal each, so that an echo has twice the power of a real one:
    an array of (re, im) whose squares sum to 1; one tap is 1. As there, draws are an expression inside the scaling's lambda: for
    many rows, leave the scaling to _unit_complex()."""

    def draw(k):
        size, turn = _polar(k, *key, decay=decay)
        return F.struct((size * F.cos(turn)).alias("re"), (size * F.sin(turn)).alias("im"))

    h = F.transform(F.sequence(F.lit(0), length - 1), draw)
    norm = F.sqrt(F.aggregate(h, F.lit(0.0), lambda a, e: a + e["re"] * e["re"] + e["im"] * e["im"]))
    return F.transform(h, lambda e: F.struct((e["re"] / norm).alias("re"), (e["im"] / norm).alias("im")))


def _drawn_taps(length: Column, *key: Column, decay: float = 0.7) -> Column:
    """Size and turn of each tap of complex_taps(), one after the other: every tap is drawn once."""
    return F.flatten(F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.array(*_polar(k, *key, decay=decay))))


def _paired(h: np.ndarray) -> np.ndarray:
    """Rows of complex numbers from their parts, one after the other."""
    return h[:, ::2] + 1j * h[:, 1::2]


def _unit_complex(h: np.ndarray) -> np.ndarray:
    """Channels of unit energy, from sizes and turns of their taps."""
    re, im = h[:, ::2] * np.cos(h[:, 1::2]), h[:, ::2] * np.sin(h[:, 1::2])
    total = np.zeros(len(h))
    for a, b in zip(re.T, im.T, strict=True):
        total += a * a + b * b
    return (re + 1j * im) / np.sqrt(total)[:, None]


def _through(x: pa.Array, h: pa.Array) -> pa.Array:
    """Windows by the lengths of window and channel, an array of rows a pair of lengths; null where either is null."""
    a, b = columns.Lists(x), columns.Lists(h)
    place, made, n = np.full(len(x), -1), [pa.array([], columns.VECTOR)], 0
    code = np.where((a.size >= 0) & (b.size >= 0), a.size.astype(np.int64) << 32 | b.size, -1)
    for size in np.unique(code[code >= 0]):
        at = np.flatnonzero(code == size)
        made.append(columns.packed(signal.causal_fir(a.matrix(at), b.matrix(at).T[:, :, None])))
        place[at] = n + np.arange(len(at))
        n += len(at)
    return pa.concat_arrays(made).take(pa.array(place, mask=place < 0))


def through_channel(x: str, h: str) -> Column:
    """Each window through its own causal channel with zero history."""
    return F.arrow_udf(_through, "array<double>")(F.col(x).cast("array<double>"), h)


def _through_complex(re: pa.Array, im: pa.Array, h: pa.Array, taps_of: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """As _through(), of windows in two parts; null where a part is, or where they differ in length. taps_of: rows of h -> channels."""
    a, b, c = columns.Lists(re), columns.Lists(im), columns.Lists(h)
    place, made, n = np.full(len(re), -1), [[pa.array([], columns.VECTOR)] for _ in range(2)], 0
    code = np.where((a.size >= 0) & (a.size == b.size) & (c.size >= 0), a.size.astype(np.int64) << 32 | c.size, -1)
    for size in np.unique(code[code >= 0]):
        at = np.flatnonzero(code == size)
        z = signal.causal_fir(a.matrix(at) + 1j * b.matrix(at), taps_of(c.matrix(at)).T[:, :, None])
        for own, part in zip(made, (z.real, z.imag), strict=True):
            own.append(columns.packed(part))
        place[at] = n + np.arange(len(at))
        n += len(at)
    take = pa.array(place, mask=place < 0)
    return pa.StructArray.from_arrays([pa.concat_arrays(own).take(take) for own in made], ["re", "im"])


def _complex_channel(re: str, im: str, h: Column, taps_of: Callable[[np.ndarray], np.ndarray]) -> Column:
    run = F.arrow_udf(lambda a, b, c: _through_complex(a, b, c, taps_of), "re array<double>, im array<double>")
    return run(F.col(re).cast("array<double>"), F.col(im).cast("array<double>"), h)


def through_complex_channel(re: str, im: str, h: str) -> Column:
    """Each complex window through its own causal channel, an array of (re, im), with zero history: (re, im)."""
    return _complex_channel(re, im, F.flatten(F.transform(h, lambda e: F.array(e["re"], e["im"]))), _paired)


def _tested(windows: DataFrame, roles: DataFrame, design: Design, draw) -> DataFrame:
    """Every split's test windows at each severity, with a channel of their own as the column h; a complex one that is drawn from
    a hash is there as _drawn_taps()."""
    if design.rng == "compat":
        test = windows.join(roles.where("role = 'test'"), "grp")
        h = compat.channels(test, design.severities, design.seed, complex_=draw is complex_taps)
        return moments.spread(test.join(h, ["split", "window_id"]))
    # Windows are dealt out before they are repeated, so that a window is shuffled once for all splits and severities.
    own = moments.spread(windows.join(parts(roles, "test", "__splits"), "grp"))
    each = own.withColumn("split", F.explode("__splits")).drop("__splits").withColumn("severity", F.explode(F.array(*map(F.lit, design.severities))))
    key = F.col("severity"), F.lit(design.seed + 7), F.col("split"), F.col("severity"), F.col("window_id")
    h = columns.rows(_unit)(taps(*key, scaled=False)) if draw is taps else _drawn_taps(*key)
    # The channel is a column of its own before the kernel takes it, so that it is drawn once.
    return each.withColumn("h", h)


def distorted(windows: DataFrame, roles: DataFrame, design: Design) -> DataFrame:
    """split, severity, window_id, y, x of every split's test windows; severity 1 is clean."""
    return _tested(windows, roles, design, taps).withColumn("x", through_channel("x", "h")).select("split", "severity", "window_id", "y", "x")


def distorted_complex(windows: DataFrame, roles: DataFrame, design: Design) -> DataFrame:
    """split, severity, window_id, y, re, im: as distorted(), of complex windows through complex channels."""
    z = through_complex_channel("re", "im", "h") if design.rng == "compat" else _complex_channel("re", "im", F.col("h"), _unit_complex)
    bent = _tested(windows, roles, design, complex_taps).withColumn("z", z)
    return bent.select("split", "severity", "window_id", "y", "z.re", "z.im")


# --- representations -------------------------------------------------------------------------------------------------


def _profile(n_fft, hop, window="hann") -> Frames:
    return Frames((Step.of(signal.log_profile, n_fft=n_fft, hop=hop, window=window),), n_fft)


def _cepstrum(n_fft, hop, window="hann", eps=signal.EPS_MAG) -> Frames:
    return Frames((Step.of(signal.full_cepstrum, n_fft=n_fft, hop=hop, window=window, eps=eps),), n_fft)


_SHAPE = Step.of(representations.shape)


def _spectral(n_fft, hop, window="hann") -> Frames:
    return _profile(n_fft, hop, window).then(_SHAPE)


def _cepstral(n_fft, hop, lo, window="hann", eps=signal.EPS_MAG) -> Frames:
    return _cepstrum(n_fft, hop, window, eps).then(Step.of(representations.cut, lo=max(1, lo))).then(_SHAPE)


def branches(lifters=(1, 2, 3, 4, 6, 8), n_fft=256, hop=128) -> dict[str, Representation]:
    """The spectral branch, and the cepstral one by lifter."""
    return {"spectral": _spectral(n_fft, hop)} | {f"cepstral_{k}": _cepstral(n_fft, hop, k) for k in lifters}


def controls(fs=12000.0, n_fft=256, hop=128, n_mels=26, keep=11) -> dict[str, Representation]:
    """Normalised spectra and mel coefficients."""
    after = {"cmvn": signal.cmvn, "detrend": signal.detrended, "rasta": signal.rasta}
    mfcc = Frames((Step.of(signal.mfcc, fs=fs, n_fft=n_fft, hop=hop, n_mels=n_mels, keep=keep),), n_fft)
    return {m: _profile(n_fft, hop).then(Step.of(f)).then(_SHAPE) for m, f in after.items()} | {"mfcc": mfcc}


def lifter_families(specs: dict[str, tuple[str, int, int | None]], n_fft=256, hop=128) -> dict[str, Representation]:
    return {name: _cepstrum(n_fft, hop).then(Step.of(representations.lifted, family=f, lo=lo, hi=hi or n_fft // 2)).then(_SHAPE) for name, (f, lo, hi) in specs.items()}


def sensitivity(configs: dict[str, dict], lifter: int = 3) -> dict[str, Representation]:
    """spectral and cepstral under each named configuration of n_fft, hop, window and eps."""
    out: dict[str, Representation] = {}
    for name, c in configs.items():
        stft = {k: v for k, v in c.items() if k != "eps"}
        out |= {f"{name}:spectral": _spectral(**stft), f"{name}:cepstral": _cepstral(lo=lifter, **c)}
    return out


def occupied(lifter: int = 3, n_fft=256, hop=128, least=0.8) -> dict[str, Representation]:
    """Both branches of complex windows (re, im), over the frames that the distorted signal itself occupies."""
    mask = (*_profile(n_fft, hop).steps, Step.of(representations.deviates_surely, least=least))
    of = lambda f: replace(f, mask=mask, parts=("re", "im"))
    return {"spectral": of(_spectral(n_fft, hop)), f"cepstral_{lifter}": of(_cepstral(n_fft, hop, lifter))}


def _subset(w, base, keep):
    return base(w).withColumn("s", F.array(*(F.col("s")[i] for i in keep)))


def only(base: Representation, keep) -> Representation:
    """Some of a representation's descriptors."""
    return base.then(Step.of(representations.taken, at=tuple(keep))) if isinstance(base, Frames) else partial(_subset, base=base, keep=list(keep))


def drop_one(base: Representation, names: list[str]) -> dict[str, Representation]:
    """All descriptors, and all but each one."""
    n = range(len(names))
    return {"full": base} | {f"without_{names[j]}": only(base, [i for i in n if i != j]) for j in n}


def _masked(w, base, n_fft, hop, least):
    keep = spectra.energy_mask(spectra.log_profiles(w, n_fft, hop), least)
    keys = [c for c in keep.columns if c in IDS and c != "y"]
    return base(w).join(keep.select(*keys), keys, "left_semi")


def masked(reps: dict[str, Representation], n_fft=256, hop=128, least=0.8) -> dict[str, Representation]:
    """Only frames whose own (distorted) profile deviates enough, the same ones in each representation."""
    mask = (*_profile(n_fft, hop).steps, Step.of(representations.deviates, least=least))
    return {k: replace(f, mask=mask) if isinstance(f, Frames) and not f.mask else partial(_masked, base=f, n_fft=n_fft, hop=hop, least=least) for k, f in reps.items()}


# --- heads and scores ------------------------------------------------------------------------------------------------


def _by_key(kernels: dict, names: dict[str, list]):
    """(key, s) -> the named class with the least score of each row by the kernel of its key, as a column."""

    def run(k: pd.Series, s: pd.Series) -> pd.Series:
        out: list = [None] * len(k)
        for name, rows in k.reset_index(drop=True).groupby(k.to_numpy()).groups.items():
            if name in kernels:
                x = kernels[name](moments.stacked(s.iloc[rows]))
                for i, row in zip(rows, x, strict=True):
                    out[i] = names[name][int(row.argmin())]
        return pd.Series(out, dtype=object)

    return run


def _of_splits(splits: int) -> heads.Views:
    """A model for each split of a representation, which learns from the rows that have the split among their parts."""
    return lambda rep: [(f"{rep}:{k}", lambda s: s, k) for k in range(splits)]


def _models(own: DataFrame, views: heads.Views) -> dict[str, ClassMoments]:
    """Class moments by model: one pass for all models."""
    return {k: ClassMoments.of(m) for k, m in heads.view_moments(own, views).items()}


def predict(train: DataFrame, test: DataFrame, design: Design) -> DataFrame:
    """test with p (and probability by class for the logistic head). train: key (a representation), y, s, and parts, the splits
    that a frame is learned from; test: key (a representation and a split, `rep:split`) and s. A model for each such pair, all
    fitted together; frames are not copied for the splits, but for the heads svm and gmm."""
    kind, views = train.schema["y"].dataType, _of_splits(design.splits)
    if design.head in ("nearest", "logistic"):
        own = moments.spread_by(train.select("key", "y", "s", "parts"), "key").persist()
        m = _models(own, views)
        kernels = {k: v.kernel(v.ridge_forms(design.ridge), logs=design.head == "logistic") for k, v in m.items()}
        if design.head == "nearest":
            best = F.pandas_udf(_by_key(kernels, {k: list(v.classes) for k, v in m.items()}), kind)
            out = test.withColumn("p", best("key", "s"))
        else:
            models = heads.fit_splits(own, lambda rep: [(k, kernels[k], part) for k, _, part in views(rep) if k in kernels])
            out = heads.logistic_scores(test, "key", "s", kind, models, kernels)
        own.unpersist()
        return out
    if design.head not in ("svm", "gmm"):
        raise ValueError(f"unknown head {design.head!r}")
    f = heads.grouped_machines if design.head == "svm" else heads.grouped_mixture
    each = train.withColumn("split", F.explode("parts")).select(F.concat_ws(":", "key", "split").alias("key"), "y", "s")
    own = moments.spread_by(each, "key").persist()
    out = f(own, test, "key", "y")
    own.unpersist()
    return out


def _together(reps: dict[str, Representation]) -> bool:
    """Whether all representations are chains of kernels over the same columns."""
    return all(isinstance(f, Frames) for f in reps.values()) and len({f.parts for f in reps.values()}) == 1


def _described(windows: DataFrame, reps: dict[str, Representation]) -> DataFrame:
    """The windows' other columns, key (a representation), frame_id, s."""
    if _together(reps):
        return representations.described(windows, reps)
    rest = [F.col(c) for c in windows.columns if c not in ("x", "re", "im")]
    return reduce(DataFrame.unionByName, (f(windows).select(*rest, F.lit(n).alias("key"), "frame_id", "s") for n, f in reps.items()))


def _frames(windows: DataFrame, reps: dict[str, Representation], roles: DataFrame) -> DataFrame:
    """key (a representation), y, s, parts of every window's frames: a frame once, whatever the number of splits."""
    return _described(windows.join(parts(roles, "train"), "grp"), reps).select("key", "y", "s", "parts")


def conditioning(windows: DataFrame, reps: dict[str, Representation], design: Design, ridges: tuple[float, ...] = (1e-2,)) -> DataFrame:
    """rep, split, ridge, y, cond: condition of each class's regularised covariance over clean training frames."""
    m = _models(_frames(windows, reps, design_roles(windows, design)), _of_splits(design.splits))
    rows = [(k.rpartition(":")[0], int(k.rpartition(":")[2]), r, c, cond) for k, v in m.items() for r in ridges for c, cond, _ in v.conditioning(r)]
    return windows.sparkSession.createDataFrame(rows, f"rep string, split int, ridge double, y {windows.schema['y'].dataType.simpleString()}, cond double")


def predictions(windows: DataFrame, reps: dict[str, Representation], design: Design, distort=distorted) -> DataFrame:
    """rep, split, severity, window_id, frame_id, y, p of every test frame. All splits of all representations are one fit.
    distort: distorted, or distorted_complex for windows of re and im."""
    roles = design_roles(windows, design)
    bent = distort(windows, roles, design)
    test = _described(bent, reps).select(F.col("key").alias("rep"), *IDS, "s")
    return predict(_frames(windows, reps, roles), test.select(F.concat_ws(":", "rep", "split").alias("key"), "*"), design).drop("key", "s")


def _fitted(windows: DataFrame, reps: dict[str, Frames], roles: DataFrame, design: Design) -> dict[str, representations.Head]:
    """The logistic or nearest head of each representation and split, by `rep:split`."""
    own = moments.spread_by(_frames(windows, reps, roles), "key").persist()
    m, views = _models(own, _of_splits(design.splits)), _of_splits(design.splits)
    kernels = {k: v.kernel(v.ridge_forms(design.ridge), logs=design.head == "logistic") for k, v in m.items()}
    if design.head == "nearest":
        out = {k: (partial(_nearness, f), list(m[k].classes)) for k, f in kernels.items()}
    else:
        models = heads.fit_splits(own, lambda rep: [(k, kernels[k], part) for k, _, part in views(rep) if k in kernels])
        out = {k: (partial(_margins, kernels[k], v), v.labels) for k, v in models.items()}
    own.unpersist()
    return out


def _nearness(kernel, s: np.ndarray) -> np.ndarray:
    return -kernel(s)


def _margins(kernel, model: heads.Softmax, s: np.ndarray) -> np.ndarray:
    return model.margins(model.design(kernel(s)))


def outcomes(windows: DataFrame, reps: dict[str, Representation], design: Design, distort=distorted, by_level: bool = False) -> DataFrame:
    """rep, level, split, severity, y, p, n: how often test frames of label y got p; by_level: votes and mean probabilities of
    windows as well. Test windows are distorted once for all representations, and scored and counted inside the tasks: no frame
    leaves them. Representations that are equal are fitted and scored once."""
    roles = design_roles(windows, design)
    own = {f: n for n, f in reversed(reps.items())}
    first = {n: f for f, n in own.items()}
    heads_ = _fitted(windows, first, roles, design)
    counts = representations.outcomes(distort(windows, roles, design), first, heads_, windows.schema["y"].dataType, by_level)
    same: dict[str, list[str]] = {n: [] for n in first}
    for n, f in reps.items():
        same[own[f]].append(n)
    if len(first) == len(reps):
        return counts
    names = F.create_map(*(c for n, all_ in same.items() for c in (F.lit(n), F.array(*map(F.lit, all_)))))
    return counts.withColumn("rep", F.explode(names[F.col("rep")]))


def _counted(reps: dict[str, Representation], design: Design) -> bool:
    return design.head in ("nearest", "logistic") and _together(reps)


def run(windows: DataFrame, reps: dict[str, Representation], design: Design = Design(), distort=distorted) -> DataFrame:  # noqa: B008
    """rep, split, severity, f1, accuracy."""
    keys = ["rep", "split", "severity"]
    if _counted(reps, design):
        return metrics.macro_f1(outcomes(windows, reps, design, distort), keys, weight="n").withColumnRenamed("macro_f1", "f1")
    return metrics.macro_f1(predictions(windows, reps, design, distort), keys).withColumnRenamed("macro_f1", "f1")


def levels(pred: DataFrame) -> DataFrame:
    """level (frame, vote, prob), rep, split, severity, f1: single frames, votes of a window, and its mean probabilities."""
    keys, pred = ["rep", "split", "severity"], pred.persist()  # read three times
    unit = F.struct(*keys, "window_id", "y").alias("unit")
    back = lambda f: f.select("unit.*", "p")
    prob = pred.select(unit, F.posexplode("probability").alias("label", "prob"))
    forms = {"frame": pred, "vote": back(metrics.vote(pred.select(unit, "p"), "unit")), "prob": back(metrics.mean_probability(prob, "unit"))}
    return reduce(DataFrame.unionByName, (metrics.macro_f1(f, keys).select(F.lit(n).alias("level"), *keys, F.col("macro_f1").alias("f1")) for n, f in forms.items()))


def run_levels(windows: DataFrame, reps: dict[str, Representation], design: Design = Design(), distort=distorted) -> DataFrame:  # noqa: B008
    """levels() of predictions(). All frames of a distorted window are in one row, so its votes and mean probabilities are found
    where it is scored, and counts alone leave the tasks."""
    if not _counted(reps, design) or design.head != "logistic":
        return levels(predictions(windows, reps, design, distort))
    keys = ["level", "rep", "split", "severity"]
    return metrics.macro_f1(outcomes(windows, reps, design, distort, by_level=True), keys, weight="n").select(*keys, F.col("macro_f1").alias("f1"))


# --- judgements ------------------------------------------------------------------------------------------------------


def summary(scores: DataFrame, keys: list[str] = ["rep"], least: int = 3) -> DataFrame:  # noqa: B006
    """Mean and population deviation over splits of the clean score and of the mean at severities from `least` on."""
    u = metrics.under_fir(scores, ["split", *keys], least)
    return u.groupBy(*keys).agg(F.count(F.lit(1)).alias("splits"), *(f(c).alias(f"{c}{n}") for c in ("clean", "under") for n, f in (("", F.avg), ("_std", F.stddev_pop), ("_min", F.min), ("_max", F.max))))


def gap(scores: DataFrame, incumbent: str, challenger: str, repeats: int = 2000, seed: int = 2125, least: int = 3) -> DataFrame:
    """One row: mean, deviation and least of the gap by split, wins, its interval, one-sided exact p, verdict, sign_stable.

    p counts subset sums of ranks for untied differences, and is the normal approximation's for tied ones.
    """
    d = gaps(scores, incumbent, challenger, least).withColumnRenamed("gap", "d").withColumn("all", F.lit(0))
    d = d.withColumn("i", (F.row_number().over(Window.partitionBy("all").orderBy("split")) - 1).cast("long")).persist()  # one row a split
    w = stats.wilcoxon_w(d, "d", ["all"]).first()
    p = stats.wilcoxon_p(w["w_plus"], w["n"], w["ties"]) if w else 1.0
    ci = stats.bootstrap_means(d, "d", repeats, seed, ["all"]).agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))
    s = d.agg(F.avg("d").alias("gap"), F.stddev_pop("d").alias("gap_std"), F.min("d").alias("gap_min"), F.sum((F.col("d") > 0).cast("long")).alias("wins"), F.count(F.lit(1)).alias("splits"))
    out = s.crossJoin(F.broadcast(ci)).withColumn("p_value", F.lit(p))
    return out.withColumn("confirmed", (F.col("p_value") < 0.05) & (F.col("lo") > 0)).withColumn("sign_stable", F.col("gap_min") > 0)


def curve(scores: DataFrame, by: list[str] = ["rep"]) -> DataFrame:  # noqa: B006
    """by, severity, splits, f1, f1_std: what a curve over severities is drawn from."""
    return scores.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("splits"), F.avg("f1").alias("f1"), F.stddev_pop("f1").alias("f1_std"))


def gaps(scores: DataFrame, incumbent: str, challenger: str, least: int = 3, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, split, gap: a bar for each split, the challenger's mean score under distortion less the incumbent's."""
    u = metrics.under_fir(scores.where(F.col("rep").isin(incumbent, challenger)), [*by, "split", "rep"], least)
    return u.groupBy(*by, "split").agg(F.sum(F.when(F.col("rep") == challenger, F.col("under")).otherwise(-F.col("under"))).alias("gap"))


def domains(scores: DataFrame, incumbent: str, challenger: str, by: str = "domain", repeats: int = 2000, seed: int = 2125, least: int = 3) -> DataFrame:
    """A bar with its error for each domain: by, splits, wins, gap, and the ends lo and hi of its mean's 95 percent interval."""
    d = gaps(scores, incumbent, challenger, least, [by])
    d = d.withColumn("i", (F.row_number().over(Window.partitionBy(by).orderBy("split")) - 1).cast("long"))  # one row a split
    ci = stats.bootstrap_means(d, "gap", repeats, seed, [by]).groupBy(by).agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("splits"), F.sum((F.col("gap") > 0).cast("long")).alias("wins"), F.avg("gap").alias("gap")).join(ci, by)


def methods(scores: DataFrame, labels: dict[str, str], least: int = 3) -> DataFrame:
    """Bars of the named representations in their order: place, label, clean and under."""
    names = scores.sparkSession.createDataFrame([(rep, i, label) for i, (rep, label) in enumerate(labels.items())], "rep string, place int, label string")
    return summary(scores, least=least).join(F.broadcast(names), "rep").select("place", "label", "clean", "under")


def tradeoff(scores: DataFrame, reference: str, least: int = 3) -> DataFrame:
    """summary() of each representation, and whether its score under distortion beats the reference's."""
    s = summary(scores, least=least)
    ref = s.where(F.col("rep") == reference).select(F.col("under").alias("__u"))
    return s.crossJoin(F.broadcast(ref)).withColumn("beats", F.col("under") > F.col("__u")).drop("__u")


def candidates(summary_: DataFrame, reference: str, margin: float = 0.02) -> DataFrame:
    """summary_ with candidate: better under distortion than the reference, and clean within the margin."""
    # The reference is found among the rows (one a representation): a join would run the whole experiment once more for it.
    mine, every = F.col("rep") == reference, Window.partitionBy(F.lit(0))
    of = lambda c: F.max(F.when(mine, c)).over(every)
    x = summary_.select("*", of(F.col("under")).alias("__u"), of(F.col("clean")).alias("__c"), of(F.lit(1)).alias("__r")).where("__r = 1")
    ok = (F.col("under") > F.col("__u")) & (F.col("clean") >= F.col("__c") - margin) & (F.col("rep") != reference)
    return x.withColumn("candidate", ok).drop("__u", "__c", "__r")


# --- random windows --------------------------------------------------------------------------------------------------


def random_starts(recordings: DataFrame, rec: str, n_samples: str, size: int, n_windows: int, blocks: int = 20, seed: int = 2026) -> DataFrame:
    """rec, block, draw, start: max(1, n_windows div blocks) windows at random places of each of equal blocks longer than one."""
    per = F.expr(f"{n_samples} div {blocks}")
    x = recordings.select(rec, per.alias("__per")).where(F.col("__per") > size)
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select("*", F.explode(F.sequence(F.lit(0), F.lit(max(1, n_windows // blocks) - 1))).alias("draw"))
    at = F.floor(uniform(F.lit(seed), F.col(rec), F.col("block"), F.col("draw")) * (F.col("__per") - size + 1)).cast("long")
    return x.select(rec, "block", "draw", (F.col("block") * F.col("__per") + at).alias("start"))


def cap_frames(windows: DataFrame, y: str, order: list[str], n_frames: str, cap: int) -> DataFrame:
    """Windows of each class, in order, while the frames before them number less than cap; the last one may overshoot."""
    return ranking.by_value(windows, [y], order, F.col(n_frames)).where(F.col("before") < cap).select(*windows.columns)
