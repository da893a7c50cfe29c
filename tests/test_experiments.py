"""Experiments against brute force on a small corpus of windows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quefrency.functions import signal
from quefrency.operators import compat, experiments, metrics, spectra, subsets

DESIGN = experiments.Design(splits=2, severities=(1, 3), head="nearest")


@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(48):
        y, x = i % 3, rng.normal(size=64)
        for _ in range(y):
            x = np.convolve(x, [1, 0.8])[:64]
        rows.append((i, y, i // 4, x.tolist()))
    return spark.createDataFrame(rows, "window_id long, y int, grp long, x array<double>").persist()


def brute(windows, split, severity):
    """Macro-F1 of the nearest class, from the channels and roles that the operators draw."""
    role = {r.grp: r.role for r in experiments.split_roles(windows, "grp", 2).where(F.col("split") == split).collect()}
    rows = {r.window_id: r for r in windows.collect()}
    h = windows.select("window_id", experiments.taps(F.lit(severity), F.lit(2033), F.lit(split), F.lit(severity), F.col("window_id")).alias("h"))
    h = {r.window_id: r.h for r in h.collect()}
    describe = lambda x: signal.shape_descriptors(signal.znorm(signal.log_profile(np.array(x)[None], 16, 8)[0]))
    train = [(r.y, s) for r in rows.values() if role[r.grp] == "train" for s in describe(r.x)]
    test = [(r.y, s) for r in rows.values() if role[r.grp] == "test" for s in describe(np.convolve(r.x, h[r.window_id])[:64])]
    y, s = np.array([a for a, _ in train]), np.array([b for _, b in train])
    mean, std = s.mean(axis=0), s.std(axis=0)
    z, t, true = (s - mean) / std, (np.array([b for _, b in test]) - mean) / std, np.array([a for a, _ in test])
    d2 = []
    for c in range(3):
        inv = np.linalg.inv(np.cov(z[y == c].T) + 1e-2 * np.eye(11))
        d2.append(np.einsum("ni,ij,nj->n", t - z[y == c].mean(axis=0), inv, t - z[y == c].mean(axis=0)))
    p = np.argmin(d2, axis=0)
    return np.mean([2 * ((p == c) & (true == c)).sum() / max((p == c).sum() + (true == c).sum(), 1) for c in range(3)])


def test_scores_match_brute_force(windows):
    scores = experiments.run(windows, experiments.branches((2,), 16, 8), DESIGN).where("rep = 'spectral'").collect()
    assert len(scores) == 4
    for r in scores:
        assert r.f1 == pytest.approx(brute(windows, r.split, r.severity), abs=1e-9)


def test_channels(spark):
    k = [F.lit(2033), F.col("id")]
    h = [r.h for r in spark.range(200).select(experiments.taps(F.lit(5), *k).alias("h")).collect()]
    assert np.allclose(np.square(h).sum(axis=1), 1) and np.unique(h, axis=0).shape[0] == 200
    assert spark.range(1).select(experiments.taps(F.lit(1), *k).alias("h")).first().h == [1.0]
    x = spark.createDataFrame([([1.0, 0.0, 0.0], [1.0, 0.5]), ([2.0, 1.0], [3.0]), ([0.0, 1.0, 0.0], [1.0, 0.5])], "x array<double>, h array<double>")
    assert [list(r[0]) for r in x.select(experiments.through_channel("x", "h")).collect()] == [[1, 0.5, 0], [6, 3], [0, 1, 0.5]]


def test_gap_and_candidates(spark):
    rows = [(rep, s, sev, 0.5 + 0.01 * s * (rep == "b") + 0.1 * (rep == "b")) for rep in ("a", "b") for s in range(15) for sev in (1, 3, 5)]
    scores = spark.createDataFrame(rows, "rep string, split int, severity int, f1 double")
    g = experiments.gap(scores, "a", "b", 200).first()
    assert (g.wins, g.splits, g.confirmed, g.sign_stable) == (15, 15, True, True) and g.p_value == 2.0**-15
    assert g.gap == pytest.approx(0.17) and g.lo < g.gap < g.hi
    got = experiments.candidates(experiments.summary(scores), "a").collect()
    assert {r.rep: r.candidate for r in got} == {"a": False, "b": True}


def test_levels_votes_and_masks(windows):
    pred = experiments.predictions(windows, experiments.masked(experiments.branches((), 16, 8), 16, 8, 0.1), experiments.Design(splits=1, severities=(1,)))
    got = {r.level: r.f1 for r in experiments.levels(pred).collect()}
    assert set(got) == {"frame", "vote", "prob"} and min(got.values()) > 1 / 3
    assert got["frame"] == pytest.approx(metrics.macro_f1(pred).first().macro_f1)


@pytest.mark.parametrize("head", ["nearest", "logistic"])
def test_subsets_are_as_if_refitted(windows, head):
    design = experiments.Design(splits=2, severities=(1, 3), head=head)
    base, names = experiments.only(experiments.branches((), 16, 8)["spectral"], [0, 9, 4]), ["a", "b", "c"]
    got = {(r.rep, r.split, r.severity): (r.f1, r.accuracy) for r in subsets.ablation(windows, base, names, design).collect()}
    want = {(r.rep, r.split, r.severity): (r.f1, r.accuracy) for r in experiments.run(windows, experiments.drop_one(base, names), design).collect()}
    assert got.keys() == want.keys() and len(got) == 16 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("head", ["nearest", "logistic"])
def test_forward_takes_the_most_helpful(windows, head):
    design = experiments.Design(splits=2, severities=(1, 3), head=head)
    base, names = experiments.only(experiments.branches((), 16, 8)["spectral"], [0, 9, 4]), ["a", "b", "c"]
    got = {(r.split, r.step): (r.descriptor, r.under) for r in subsets.forward(windows, base, names, design).collect()}
    chosen = {0: [], 1: []}
    for step in (1, 2, 3):
        for split, at in chosen.items():
            reps = {str(j): experiments.only(base, [*at, j]) for j in range(3) if j not in at}
            under = {r.rep: r.f1 for r in experiments.run(windows, reps, design).where(f"split = {split} and severity = 3").collect()}
            best = max(under, key=lambda j: (under[j], -int(j)))
            assert got[split, step] == (names[int(best)], pytest.approx(under[best], abs=1e-9))
            at.append(int(best))


def test_complex_channels(spark):
    k = [F.lit(2033), F.col("id")]
    h = np.array([[complex(e.re, e.im) for e in r.h] for r in spark.range(4000).select(experiments.complex_taps(F.lit(3), *k).alias("h")).collect()])
    assert np.allclose((np.abs(h) ** 2).sum(axis=1), 1) and (h[:, 0].imag == 0).all() and (h[:, 0].real > 0).all()
    # Mean energy of each tap, against draws of a direct path of 1 and echoes whose parts are both standard normal.
    rng = np.random.default_rng(1)
    g = np.exp(-0.7 * np.arange(3)) * (rng.standard_normal((4000, 3)) + 1j * rng.standard_normal((4000, 3)))
    g[:, 0] = 1
    g /= np.sqrt((np.abs(g) ** 2).sum(axis=1, keepdims=True))
    assert (np.abs(h) ** 2).mean(axis=0) == pytest.approx((np.abs(g) ** 2).mean(axis=0), abs=0.02)
    assert spark.range(1).select(experiments.complex_taps(F.lit(1), *k).alias("h")).first().h == [(1.0, 0.0)]


@pytest.fixture(scope="module")
def rf(windows):
    return windows.select("window_id", "y", "grp", F.slice("x", 1, 32).alias("re"), F.slice("x", 33, 32).alias("im"))


def test_complex_windows_and_their_occupied_frames(rf):
    design = experiments.Design(splits=2, severities=(1, 3))
    roles = experiments.split_roles(rf, "grp", 2)
    bent = experiments.distorted_complex(rf, roles, design)
    held = {r.window_id: np.array(r.re) + 1j * np.array(r.im) for r in rf.collect()}
    draw = rf.join(roles.where("role = 'test'"), "grp").select("split", "window_id", experiments.complex_taps(F.lit(3), F.lit(2033), F.col("split"), F.lit(3), F.col("window_id")).alias("h"))
    taps = {(r.split, r.window_id): np.array([complex(e.re, e.im) for e in r.h]) for r in draw.collect()}
    want = {}
    for r in bent.collect():
        z = held[r.window_id] if r.severity == 1 else np.convolve(held[r.window_id], taps[r.split, r.window_id])[:32]
        assert np.allclose(r.re, z.real) and np.allclose(r.im, z.imag)
        want[r.split, r.severity, r.window_id] = z
    least = 1.0
    both = {form: {(r.split, r.severity, r.window_id, r.frame_id): r.v for r in spectra.occupied_frames(bent, form, 16, 8, 3, least).collect()} for form in ("spectral", "cepstral")}
    assert both["spectral"].keys() == both["cepstral"].keys() and 0 < len(both["spectral"]) < 3 * len(want)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
    for key, z in want.items():
        for f in range(3):
            m = np.abs(np.fft.fft(z[8 * f : 8 * f + 16] * w)) / w.sum()
            p = np.log(m[1:] ** 2 + 1e-12)
            assert ((*key, f) in both["spectral"]) == (p.std() >= least)
            if p.std() >= least:
                assert np.allclose(both["spectral"][*key, f], p - p.mean()) and np.allclose(both["cepstral"][*key, f], np.fft.ifft(np.log(m + 1e-8)).real[3:8])


def test_complex_windows_that_do_not_fit(spark):
    rows = [(1, [1.0] * 16, [0.5] * 16), (2, None, [1.0] * 16), (3, [1.0] * 16, [1.0] * 15), (4, [1.0], [2.0])]
    got = spectra.complex_log_profiles(spark.createDataFrame(rows, "id int, re array<double>, im array<double>"), 16, 8).collect()
    assert [(r.id, r.frame_id, len(r.v)) for r in got] == [(1, 0, 15)]


def test_complex_experiment(rf):
    scores = experiments.run(rf, experiments.occupied(3, 16, 8), experiments.Design(splits=2, severities=(1, 3), head="nearest"), experiments.distorted_complex).collect()
    assert {(r.rep, r.split, r.severity) for r in scores} == {(n, s, v) for n in ("spectral", "cepstral_3") for s in (0, 1) for v in (1, 3)}


@pytest.mark.parametrize("which", ["real", "complex"])
def test_draws_of_published_runs(windows, rf, which):
    """Splits and channels, drawn one by one from numpy's generators as those runs did."""
    frame, seed = (windows, rf)[which == "complex"], 2026
    design = experiments.Design(splits=2, severities=(1, 2, 5), rng="compat")
    roles = experiments.design_roles(frame, design)
    held = {r.window_id: r for r in frame.collect()}
    bent = (experiments.distorted, experiments.distorted_complex)[which == "complex"](frame, roles, design).collect()
    got = {(r.split, r.severity, r.window_id): r for r in bent}
    role, n = {(r.split, r.grp): r.role for r in roles.collect()}, 0
    for split in (0, 1):
        groups = np.unique([r.grp for r in held.values()])
        np.random.default_rng(seed + split).shuffle(groups)
        test = set(groups[: max(1, round(0.3 * len(groups)))].tolist())
        assert all(role[split, g] == ("test" if g in test else "train") for g in groups.tolist())
        rng = np.random.default_rng(seed + split + 7)
        for taps in (1, 2, 5):
            for i in sorted(k for k, r in held.items() if r.grp in test):
                if taps == 1:
                    h = np.ones(1)
                elif which == "real":
                    h = np.exp(-0.7 * np.arange(taps)) * rng.standard_normal(taps)
                else:
                    h = np.exp(-0.7 * np.arange(taps)) * (rng.standard_normal(taps) + 1j * rng.standard_normal(taps))
                h[0] = 1
                h = h / np.sqrt((np.abs(h) ** 2).sum())
                r, n = got[split, taps, i], n + 1
                if which == "real":
                    assert np.allclose(r.x, np.convolve(held[i].x, h)[:64])
                else:
                    z = np.convolve(np.array(held[i].re) + 1j * np.array(held[i].im), h)[:32]
                    assert np.allclose(r.re, z.real) and np.allclose(r.im, z.imag)
    assert n == len(got)
    fold = {r.grp: r.fold for r in compat.grouped_kfold(frame, "grp", 5, 3).select("grp", "fold").distinct().collect()}
    groups = np.arange(12)
    np.random.default_rng(3).shuffle(groups)
    assert fold == {int(g): min(k // 2, 4) for k, g in enumerate(groups)}


def test_random_starts_and_caps(spark):
    r = spark.createDataFrame([(1, 100), (2, 1000)], "rec int, n int")
    got = experiments.random_starts(r, "rec", "n", 40, 8, 4).collect()
    assert {x.rec for x in got} == {2} and len(got) == 8
    assert all(250 * x.block <= x.start <= 250 * (x.block + 1) - 40 for x in got)
    w = spark.createDataFrame([("a", i, 4) for i in range(5)], "y string, i int, n int")
    assert sorted(x.i for x in experiments.cap_frames(w, "y", ["i"], "n", 9).collect()) == [0, 1, 2]


def test_channels_are_drawn_once(spark):
    w = spark.createDataFrame([(i, i % 3, i // 2, [float(i % 5), 1.0, -2.0, float(i), 0.5, 0.0]) for i in range(24)], "window_id long, y int, grp long, x array<double>")
    design = experiments.Design(splits=2, severities=(1, 3, 12))
    bent = experiments.distorted(w, experiments.design_roles(w, design), design)
    plan = bent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") == 1  # inside a lambda of its own scaling it would be drawn again for each tap
    h = experiments.taps(F.col("n"), F.lit(7), F.col("n"))
    raw = experiments.taps(F.col("n"), F.lit(7), F.col("n"), scaled=False)
    for r in spark.range(1, 13).select(F.col("id").cast("int").alias("n")).select(h.alias("h"), raw.alias("raw")).collect():
        assert experiments._unit(np.array([r.raw]))[0].tolist() == r.h


def test_representations_share_one_pass(windows):
    """Test windows are distorted once for all representations, and counts of outcomes are those of single frames."""
    configs = {"base": {"n_fft": 16, "hop": 8}, "short": {"n_fft": 12, "hop": 6}, "eps6": {"n_fft": 16, "hop": 8, "eps": 1e-6}}
    reps, design = experiments.sensitivity(configs), experiments.Design(splits=2, severities=(1, 3))
    scores = experiments.run(windows, reps, design)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") == 1  # channels were drawn anew for each representation
    got = {(r.rep, r.split, r.severity): (r.f1, r.accuracy) for r in scores.collect()}
    want = metrics.macro_f1(experiments.predictions(windows, reps, design), ["rep", "split", "severity"]).collect()
    assert len(got) == len(want) == 24 and all(got[r.rep, r.split, r.severity] == pytest.approx((r.macro_f1, r.accuracy), abs=1e-12) for r in want)


def test_kernels_of_odd_windows(spark):
    """Windows that are null, short, or of other lengths, a class that no training window has, and one of a null label."""
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, i // 2, rng.normal(size=24 if i % 5 else 40).tolist()) for i in range(40)]
    rows += [(40, 0, 20, None), (41, 1, 20, [1.0] * 5), (42, None, 21, rng.normal(size=24).tolist())]
    w = spark.createDataFrame(rows, "window_id long, y int, grp long, x array<double>")
    reps, design = experiments.branches((2, 8), 16, 8), experiments.Design(splits=3, severities=(1, 2))
    got = {(r.rep, r.split, r.severity): (r.f1, r.accuracy) for r in experiments.run(w, reps, design).collect()}
    want = metrics.macro_f1(experiments.predictions(w, reps, design), ["rep", "split", "severity"]).collect()
    assert len(got) == len(want) and all(got[r.rep, r.split, r.severity] == pytest.approx((r.macro_f1, r.accuracy), abs=1e-12) for r in want)
    assert {k[0] for k in got} == {"spectral", "cepstral_2", "cepstral_8"}  # quefrencies end at 7, so that the last one has no descriptors


def test_complex_channels_are_drawn_once(rf):
    design = experiments.Design(splits=2, severities=(1, 3, 12))
    scores = experiments.run(rf, experiments.occupied(3, 16, 8), replace(design, head="nearest"), experiments.distorted_complex)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("ln(") == 1  # a size for each tap; it was drawn again for each part, for each tap's scaling, and each representation
    bent = experiments.distorted_complex(rf, experiments.design_roles(rf, design), design).collect()
    key = F.col("severity"), F.lit(2033), F.col("split"), F.col("severity"), F.col("window_id")
    drawn = rf.crossJoin(experiments.design_roles(rf, design).where("role = 'test'").withColumnRenamed("grp", "g")).where("g = grp")
    each = drawn.withColumn("severity", F.explode(F.array(F.lit(1), F.lit(3), F.lit(12)))).withColumn("h", experiments.complex_taps(*key))
    want = {(r.split, r.severity, r.window_id): np.convolve(np.array(r.re) + 1j * np.array(r.im), [complex(e.re, e.im) for e in r.h])[:32] for r in each.collect()}
    assert len(bent) == len(want) and all(np.allclose(np.array(r.re) + 1j * np.array(r.im), want[r.split, r.severity, r.window_id], atol=1e-12) for r in bent)


def test_complex_windows_whose_parts_differ(spark):
    rows = [([1.0, 0.0, 2.0], [0.0, 1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    x = spark.createDataFrame(rows, "re array<double>, im array<double>").withColumn("h", F.array(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), F.struct(F.lit(0.0).alias("re"), F.lit(1.0).alias("im"))))
    got = [r[0] for r in x.select(experiments.through_complex_channel("re", "im", "h")).collect()]
    assert (got[0].re, got[0].im) == ([1.0, 0.0, 1.0], [0.0, 2.0, 0.0]) and [r.re for r in got[1:]] == [None, None]


def test_forward_selection_has_the_whole_design(spark, monkeypatch):
    from quefrency.plans import registry

    asked = []
    monkeypatch.setattr(registry, "_grp", lambda *_: None)
    monkeypatch.setattr(subsets, "forward", lambda windows, base, names, design, steps=None: asked.append((design, steps, names)))
    registry.QUERIES["forward_select"](spark, "")
    assert asked == [(experiments.Design(), None, registry.SHAPE)] and asked[0][0].splits == 15


def test_levels_are_counted_inside_the_tasks(windows):
    reps, design = experiments.masked(experiments.branches((3,), 16, 8), 16, 8, 2.0), experiments.Design(splits=2, severities=(1, 3))
    scores = experiments.run_levels(windows, reps, design)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "probability" not in plan and plan.count("MapInArrow") == 1  # predictions of all frames were kept and read three times
    got = {(r.level, r.rep, r.split, r.severity): r.f1 for r in scores.collect()}
    pred = experiments.predictions(windows, reps, design)
    want = {(r.level, r.rep, r.split, r.severity): r.f1 for r in experiments.levels(pred).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 24
    per = pred.groupBy("rep", "split", "severity", "window_id").count().select("count").distinct().collect()
    assert len(per) > 1  # the mask takes frames of some windows only


def test_candidates_read_the_scores_once(spark):
    scores = spark.createDataFrame([(r, s, v, 0.5 + 0.1 * (r == "b")) for r in "ab" for s in range(2) for v in (1, 3)], "rep string, split int, severity int, f1 double")
    got = experiments.candidates(experiments.summary(scores), "a")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the reference was a second run of the experiment
    assert {r.rep: r.candidate for r in got.collect()} == {"a": False, "b": True} and experiments.candidates(experiments.summary(scores), "c").count() == 0
