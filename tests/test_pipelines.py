"""Grouped fits, whole classifications, bootstraps, datasets and rankings against brute force on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quefrency.functions import basis, columns, signal
from quefrency.operators import datasets, experiments, heads, metrics, moments, pipelines, ranking, reconstruct, spectra, stats, tiling
from quefrency.plans import registry
from quefrency.sources import classes, synthetic

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for i in range(90):
        y = i % 3
        rows.append((i, y, i // 5, (RNG.normal(y, 0.5 + y, 12)).tolist()))
    return spark.createDataFrame(rows, "id long, y int, grp long, x array<double>").repartition(3).persist()


def sides(d):
    return d.where("grp % 3 > 0"), d.where("grp % 3 = 0")


def test_moments_do_not_hang_on_partitions(spark, samples):
    each = lambda b: [((int(y),), moments.stacked(b.loc[r, "x"])) for y, r in b.groupby("y").groups.items()]
    rows = samples.collect()
    for n in (1, 7):
        got = moments.grouped(samples.repartition(n), {"y": "int"}, each)
        for y in range(3):
            m = np.array([r.x for r in rows if r.y == y])
            k, mean, scatter = got[(y,)]
            assert k == len(m) and np.allclose(mean, m.mean(axis=0)) and np.allclose(scatter, np.cov(m.T, bias=True) * k)


@pytest.mark.parametrize("labels", [2, 3])
def test_grouped_logistic_is_at_the_optimum(spark, labels):
    """Gradients of the objective vanish at each model's weights; models of two keys are as if fitted alone."""
    rng = np.random.default_rng(labels)
    rows = [(k, int(y), (rng.normal(size=4) + y * (1 + (k == "b"))).tolist()) for k in ("a", "b") for y in rng.integers(0, labels, 60)]
    d = spark.createDataFrame(rows, "key string, y int, s array<double>").repartition(2)
    got = heads.grouped_logistic(d, d, "key", "y").collect()
    for key in ("a", "b"):
        own = [r for r in got if r.key == key]
        x, y, p = np.array([r.s for r in own]), np.array([r.y for r in own]), np.array([r.probability for r in own])
        assert np.allclose(p.sum(axis=1), 1) and all(r.p == int(np.argmax(r.probability)) for r in own)
        z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
        # Log odds are linear in z: their weights, from the probabilities, must balance the penalty.
        w = np.linalg.lstsq(z, np.log(p) - np.log(p).mean(axis=1, keepdims=True), rcond=None)[0]
        error = p - np.eye(labels)[y]
        g = z.T @ error
        if labels == 2:
            w = w[:, 1] - w[:, 0]
            assert np.allclose(g[:-1, 1] + w[:-1], 0, atol=1e-4) and abs(g[-1, 1]) < 1e-4
        else:
            assert np.allclose(g[:-1] + w[:-1], 0, atol=1e-4) and np.abs(g[-1]).max() < 1e-4


def test_bases_as_arrays_are_those_of_columns(spark):
    x = np.linspace(-3, 3, 13)
    d = spark.createDataFrame([(float(v),) for v in x], "v double")
    for name, alpha in ((*((b, None) for b in basis.BASES), ("patp", 0.3))):
        cols = [c.alias(f"b{i}") for i, c in enumerate(basis.basis(name, F.col("v"), 4, alpha))]
        want = np.array([list(r) for r in d.select(*cols).collect()])
        assert np.allclose(basis.arrays(name, x, 4, alpha), want)
    with pytest.raises(ValueError):
        basis.arrays("patp", x)


def test_reconstructions_are_those_of_the_column_form(spark, samples):
    r = pipelines.Reconstructions([pipelines.Config("fractional"), pipelines.Config("patp", 0.2)]).fit(samples)
    long = samples.select("id", "y", F.explode("x").alias("v"))
    for c in r.configs:
        one = reconstruct.Reconstructor(c.basis, 3, c.alpha).fit(long, "y", ["v"])
        want = {(w.id, w["class"]): w.log_msed for w in one.transform(long, ["id"], ["v"]).collect()}
        for g in r.features(samples).where(F.col("key") == c.name).collect():
            assert [want[g.id, k] for k in (0, 1, 2)] == pytest.approx(list(g.s))
        assert [k for _, k, _ in one.conditioning()] == pytest.approx([m[2] for m in r.models[c.name].values()])
    assert r.conditioning(spark).count() == 6
    with pytest.raises(ValueError):
        pipelines.Reconstructions([pipelines.Config("log")]).fit(samples.limit(1).withColumn("x", F.slice("x", 1, 1)))


def test_run_compares_and_joins_further_features(spark, samples):
    a, b = sides(samples)
    add = lambda f: f.withColumn("more", F.array(F.col("y") * 3.0))
    pred, table = pipelines.run(add(a), add(b), pipelines.Config("fractional"), pipelines.COMPARED, "more", 1)
    rows = {r.key: r for r in table.collect()}
    assert set(rows) == {c.basis for c in pipelines.COMPARED} and {r.feature_dim for r in rows.values()} == {4}
    assert all(r.accuracy == 1.0 for r in rows.values())  # the further feature gives the class away
    alone = pipelines.run(a, b)[1].first()
    assert alone.macro_f1 > 0.6 and alone.feature_dim == 3


def test_sweep_and_selection(spark, samples):
    a, b = sides(samples)
    head = {"head": pipelines.nearest_feature}
    rows = pipelines.alpha_sweep(a, b, pipelines.sweep(4), **head).collect()
    top = max(rows, key=lambda r: (r.macro_f1, -r.alpha))
    assert [r.alpha for r in rows if r.best] == [top.alpha] and {r.alpha for r in rows if r.at_boundary} == {0.0, 1.0}
    split = [pipelines.splits.grouped_split(a, "grp", 0.25, 2036).where(f"role = '{r}'") for r in ("train", "test")]
    score = {c: metrics.macro_f1(pipelines.classify(*(x.select("y", "x") for x in split), [c], **head)[0]).first().macro_f1 for c in (*pipelines.DISCRETE, *pipelines.sweep(4))}
    best = max(pipelines.DISCRETE, key=score.get)
    patp = max(pipelines.sweep(4), key=score.get)
    assert pipelines.select_basis(a, "grp", alphas=pipelines.sweep(4), **head) == (patp if score[patp] > score[best] else best)


def test_channels_are_reconstructed_one_by_one(spark, samples):
    two = samples.select("id", "y", F.slice("x", 1, 6).alias("a"), F.slice("x", 7, 6).alias("b"))
    left, right, conds = pipelines.per_channel(two, two, pipelines.Config("robust"), ["a", "b"])
    assert left.columns == ["id", "y", "s"] and {len(r.s) for r in right.collect()} == {6} and set(conds) == {"a", "b"}
    only, _, _ = pipelines.per_channel(two.drop("b"), two.drop("b"), pipelines.Config("robust"), ["a"])
    want = {r.id: list(r.s) for r in only.collect()}
    assert all(list(r.s)[:3] == pytest.approx(want[r.id]) for r in left.collect())


def test_eight_heads_and_their_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, i // 6, rng.normal(1.5 * (i % 3), 1 + (i % 3) / 2, 6).tolist()) for i in range(240)]
    d = spark.createDataFrame(rows, "id long, y int, grp long, s array<double>")
    a, b = sides(d)
    p = pipelines.compare_heads(a, b, "id", "grp").persist()
    f1 = {r.method: r.macro_f1 for r in metrics.macro_f1(p, ["method"]).collect()}
    assert len(f1) == 8 and min(f1.values()) > 0.4 and all(v > 0.5 for k, v in f1.items() if k != "C1_reconstruction")
    pairs = {(r.baseline, r.challenger): r for r in pipelines.compare_pairs(p, "id", repeats=60).collect()}
    assert set(pairs) == set(pipelines.PAIRS)
    for (x, y), r in pairs.items():
        assert r.delta == pytest.approx(f1[y] - f1[x]) and r.ci_low <= r.ci_high and 0 <= r.p_value <= 2


def macro(y, p):
    out = []
    for c in set(y) | set(p):
        tp = sum(a == b == c for a, b in zip(y, p, strict=True))
        out.append(2 * tp / (sum(a == c for a in y) + sum(b == c for b in p)))
    return np.mean(out)


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 4, 80)
    a, b = np.where(rng.random(80) < 0.5, y, rng.integers(0, 4, 80)), np.where(rng.random(80) < 0.8, y, rng.integers(0, 4, 80))
    d = spark.createDataFrame([(i, int(u), int(v), int(w)) for i, (u, v, w) in enumerate(zip(y, a, b, strict=True))], "id long, y int, a int, b int").repartition(3)
    cells = stats.paired_cells(d)
    got = stats.paired_bootstrap(cells, stats.hashed_resamples(d, "id", 40, 7)).first()
    from hashlib import md5

    deltas = []
    for r in range(40):
        i = [int(md5(f"7:{r}:{j}".encode()).hexdigest()[:8], 16) % 80 for j in range(80)]
        deltas.append(macro(y[i], b[i]) - macro(y[i], a[i]))
    assert got.delta == pytest.approx(macro(y, b) - macro(y, a))
    assert (got.ci_low, got.ci_high) == pytest.approx(tuple(np.percentile(deltas, [2.5, 97.5])))
    assert got.p_value == pytest.approx(2 * min(np.mean(np.array(deltas) <= 0), np.mean(np.array(deltas) >= 0))) and got.significant
    drawn = stats.multinomial_resamples(cells, 30, 7)
    assert {r["sum(n)"] for r in drawn.groupBy("r").agg(F.sum("n")).collect()} == {80}
    m = stats.paired_bootstrap(cells, drawn, "accuracy").first()
    assert m.delta == pytest.approx(np.mean(b == y) - np.mean(a == y)) and m.ci_low < m.delta < m.ci_high
    with pytest.raises(ValueError):
        stats.paired_bootstrap(cells, drawn, "other")


def test_checks_follow_the_facts(spark):
    facts = spark.createDataFrame([(0.7, 0.6, 0.65, 0.01, 0.02, 0.1, True, "log", 0.4, False, 0.5, 1e7)], "accuracy_alone double, accuracy_baseline double, accuracy_hybrid double, p_value double, ci_low double, ci_high double, significant boolean, best_basis string, best_f1 double, alpha_at_boundary boolean, best_alpha double, worst_cond double")
    got = [r.passed for r in pipelines.checks(facts).collect()]
    assert got == [True, True, True, False, True, False]
    r = pipelines.report(facts).first()
    assert (r.passed, r.total) == (4, 6) and r.lines[3].startswith("[FAIL] a basis")
    assert pipelines.checks(facts.select("best_f1", "best_basis")).count() == 1


def test_wilcoxon_with_ties(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 1, -1, 2, 3, 0, 4)], "d double")
    w = stats.wilcoxon_w(d.withColumn("k", F.lit(1)), "d", ["k"]).first()
    assert (w.w_plus, w.n, w.ties) == (19.0, 6, 24.0)
    assert stats.wilcoxon_p(w.w_plus, w.n, w.ties) == pytest.approx(stats.normal_sf((19 - 10.5) / np.sqrt((6 * 7 * 13 - 12) / 24)))
    assert stats.wilcoxon_p(120, 15) == 2.0**-15 and stats.wilcoxon_p(0, 0) == 1.0


def test_kruskal_tail(spark):
    rows = [(0, v) for v in (1.0, 2.0, 3.0, 4.0)] + [(1, v) for v in (5.0, 6.0, 7.0, 8.0)]
    r = stats.kruskal(spark.createDataFrame(rows, "y int, v double").withColumn("g", F.lit(1)), "y", "v", ["g"]).first()
    assert r.h == pytest.approx(16 / 3) and r.p == pytest.approx(stats.chi2_p(16 / 3, 1))


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(v), int(i), int(w)) for i, (k, v, w) in enumerate(zip(rng.integers(0, 3, 200), np.round(rng.normal(size=200), 1), rng.integers(1, 5, 200), strict=True))]
    d = spark.createDataFrame([*rows, (None, 1.0, 900, 2), (0, None, 901, 3)], "k int, v double, i int, w int").repartition(4)
    got = {r.i: (r.before, r.total) for r in ranking.by_value(d, ["k"], ["v", "i"], F.col("w")).collect()}
    every = [*rows, (None, 1.0, 900, 2), (0, None, 901, 3)]
    place = lambda r: (r[1] is not None, r[1] or 0.0, r[2])
    for r in every:
        own = [q for q in every if q[0] == r[0]]
        assert got[r[2]] == (sum(q[3] for q in own if place(q) < place(r)), sum(q[3] for q in own))
    words = spark.createDataFrame([(w,) for w in ("b", "aa", "ab", "a", "", "ba")], "w string")
    assert [r.w for r in ranking.by_value(words, [], ["w"]).orderBy("before").collect()] == ["", "a", "aa", "ab", "b", "ba"]


def test_channel_windows(spark):
    rows = [("s", i, float(i % 7), None if i == 24 else float(i)) for i in range(37)] + [("t", i, 1.0, float("nan") if i == 3 else 2.0) for i in range(9)]
    d = spark.createDataFrame(rows, "well string, i int, a double, b double").repartition(3)
    got = datasets.channel_windows(d, "well", ["i"], ["a", "b"], 4, 2, 3).orderBy("well", "block", "k").collect()
    assert [(r.well, r.block, r.k, r.start, r.end) for r in got] == [("s", 0, 0, 0, 4), ("s", 0, 1, 4, 8), ("s", 1, 0, 11, 15), ("s", 1, 1, 15, 19), ("s", 2, 1, 26, 30), ("s", 3, 0, 33, 37), ("t", 0, 1, 4, 8)]
    first = np.array([0.0, 1, 2, 3])
    assert got[0].a == pytest.approx(((first - 1.5) / first.std()).tolist()) and got[-1].a == [0, 0, 0, 0]
    s = datasets.channel_descriptors(datasets.channel_windows(d, "well", ["i"], ["a", "b"], 4, 2, 3), ["a", "b"])
    assert {len(r.s) for r in s.collect()} == {22} and len(datasets.descriptor_names(["a", "b"])) == 22
    m = datasets.group_means(s.withColumn("y", F.col("k")), ["well", "block"], "y", ["k"]).collect()
    own = np.array([r.s for r in s.where("well = 's' and block = 0").collect()])
    r = next(r for r in m if (r.well, r.block) == ("s", 0))
    assert r.n == 2 and r.y == 0 and list(r.s) == pytest.approx(own.mean(axis=0).tolist())


def test_random_windows_of_recordings(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n in ("DJI_phantom_4_2G.bin", "Yuneec_typhoon_h_2G_1of2.bin", "Yuneec_typhoon_h_2G_2of2.bin"):
        rng.integers(-3000, 3000, 2 * 4000).astype("<i2").tofile(tmp_path / n)
    f = datasets.random_window_frames(spark, str(tmp_path), size=128, n_windows=8, blocks=4, n_fft=32, hop=16, least=0.1)
    rows = f.collect()
    assert {(r.rec_id, r.class_id) for r in rows} == {(0, 0), (1, 1), (2, 1)} and {len(r.v) for r in rows} == {31}
    r = rows[0]
    raw = np.fromfile(tmp_path / "DJI_phantom_4_2G.bin", "<i2").reshape(-1, 2)[r.start : r.start + 128] / 32768 if r.rec_id == 0 else None
    if raw is not None:
        want = signal.log_profile((raw[:, 0] + 1j * raw[:, 1])[None], 32, 16)[0, r.frame_id]
        assert np.allclose(r.v, want, atol=1e-5)
    capped = datasets.random_window_frames(spark, str(tmp_path), size=128, n_windows=8, blocks=4, n_fft=32, hop=16, least=0.1, cap=10)
    n = {r.class_id: r["count"] for r in capped.groupBy("class_id").count().collect()}
    assert all(10 <= k < 10 + 7 for k in n.values())


def test_mel_corners_by_hand():
    want = np.zeros((6, 9))
    for m, b, w in ((0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1), (4, 4, 1 / 2), (5, 4, 1 / 2), (5, 5, 1), (5, 6, 2 / 3), (5, 7, 1 / 3)):
        want[m, b] = w
    assert np.allclose(signal.mel_filters(6, 16, 12000.0), want)
    assert signal.mel_filters(26, 256, 12000.0).shape == (26, 129)


def test_amplitudes_follow_their_parameters():
    n, rng = 512, np.random.default_rng(9)
    for y in range(4):
        a = np.array([synthetic.amplitude(y, rng, n) for _ in range(60)])
        assert a.shape == (60, n) and (a >= synthetic.LEAST).all()
        if y == 0:
            assert 0.75 < a.mean(axis=1).min() and a.mean(axis=1).max() < 1.25
        elif y == 1:
            assert (a.max(axis=1) > 3.5).all() and (a > 1).sum(axis=1).max() <= 18 and abs(np.median(a) - 0.02) < 0.005
        elif y == 2:
            assert 0.8 < a.max(axis=1).min() and abs(np.median(a) - 0.05) < 0.02
        else:
            assert (a[:, :5].mean(axis=1) > a[:, 200:].mean(axis=1) * 5).all()


def test_sweeps_take_every_channel_or_none(spark, monkeypatch):
    w = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "window_id long, x array<double>")
    many = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(100)], "severity int, taps array<double>")
    got = {r.severity: list(r.x) for r in spectra.fir_sweep(w, many).collect()}
    assert len(got) == 100 and got[50] == pytest.approx([1.0, 2.5, 4.0])
    monkeypatch.setattr(spectra, "MOST_CHANNELS", 99)
    with pytest.raises(ValueError):
        spectra.fir_sweep(w, many)


def test_classes_of_files(spark):
    names = spark.createDataFrame([("/x/97.mat",), ("/x/237.mat",), ("/x/12.mat",), ("/x/a.mat",)], "path string")
    got = {r.file_no: (r.class_label, r.class_id) for r in classes.labelled(names, classes.file_number(F.col("path"))).collect()}
    assert got == {97: ("Normal", 0), 237: ("OR021", 9)} and classes.bearing_classes(spark).count() == 40


def test_conditioning_by_split(spark):
    rng = np.random.default_rng(2)
    w = spark.createDataFrame([(i, i % 2, i // 4, rng.normal(size=64).tolist()) for i in range(40)], "window_id long, y int, grp long, x array<double>")
    design = experiments.Design(splits=2)
    got = experiments.conditioning(w, experiments.branches((2,), 16, 8), design, (0.01, 1.0)).collect()
    assert len(got) == 2 * 2 * 2 * 2 and all(r.cond >= 1 for r in got)
    role = {r.grp: r.role for r in experiments.split_roles(w, "grp", 2).where("split = 1").collect()}
    s = np.array([(f.y, *f.s) for f in experiments.branches((2,), 16, 8)["spectral"](w).collect() if role[f.grp] == "train"])
    z = (s[:, 1:] - s[:, 1:].mean(axis=0)) / s[:, 1:].std(axis=0)
    want = np.linalg.cond(np.cov(z[s[:, 0] == 1].T) + 0.01 * np.eye(11))
    assert next(r.cond for r in got if (r.rep, r.split, r.ridge, r.y) == ("spectral", 1, 0.01, 1)) == pytest.approx(want)


def test_multivariate_reconstruction(spark):
    rng = np.random.default_rng(12)
    rows = [(i, i % 2, float(a), float(b)) for i in range(30) for a, b in rng.normal(i % 2, 1, (8, 2))]
    d = spark.createDataFrame(rows, "id long, y int, a double, b double")
    m = reconstruct.Reconstructor().fit(d, "y", ["a", "b"])
    got = {(r.id, r["class"]): r.log_msed for r in m.transform(d, ["id"], ["a", "b"]).collect()}
    x = np.array([(r[2], r[3]) for r in rows])
    one = [np.column_stack([np.ones(len(x)), basis.arrays("fractional", x[:, j])]) for j in (0, 1)]
    phi = np.column_stack([one[0][:, i] * one[1][:, j] for i in range(4) for j in range(4) if i + j])
    y, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for c in (0, 1):
        p, t = phi[y == c], x[y == c]
        f = np.cov(p.T, bias=True) + 0.01 * np.eye(15)
        k = np.linalg.solve(f, (p - p.mean(axis=0)).T @ (t - t.mean(axis=0)) / len(p))
        err = ((x - (t.mean(axis=0) - p.mean(axis=0) @ k) - phi @ k) ** 2).mean(axis=1)
        for i in (0, 7, 29):
            assert got[i, c] == pytest.approx(np.log(err[ids == i].mean() + 1e-8))


def test_group_ids():
    assert tiling.group_id(3, 4, 20) == 64 and registry.QUERIES.keys() >= registry.ORACLE.keys()


def test_resynthesised_signals_keep_their_amplitudes(spark):
    x = RNG.normal(size=(3, 64))
    d = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "window_id long, y int, x array<double>")
    for r in synthetic.resynthesised(d, "window_id", "y", "x", snr_db=200.0).collect():
        a, b = np.abs(np.fft.fft(np.array(r.re) + 1j * np.array(r.im))), np.abs(np.fft.fft(x[r.signal_id]))
        assert np.allclose(a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-5) and r.y == r.signal_id


def test_group_means_make_descriptors_once(spark):
    rows = [("a", 2, 1, [1.0, 4.0]), ("a", 1, 0, [3.0, 0.0]), ("a", 3, 1, None), ("b", 1, 1, [5.0, 6.0]), ("c", 1, 0, None)]
    d = spark.createDataFrame(rows, "g string, k int, y int, s array<double>").withColumn("s", columns.rows(lambda m: m + 1)("s"))
    out = datasets.group_means(d, ["g"], "y", ["k"])
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [("a", 0, 3, [3.0, 3.0]), ("b", 1, 1, [6.0, 7.0])]


def test_per_channel_reconstruction_reads_its_windows_once(spark, monkeypatch):
    """Whatever the number of passes that fit the models, samples are made into windows once."""
    rng, made = np.random.default_rng(5), spark.sparkContext.accumulator(0)
    rows = [(i % 8, i // 8, 0, *(list(map(float, rng.normal(size=24) * (1 + i % 2 * (j + 1)))) for j in range(3))) for i in range(48)]
    w = spark.createDataFrame(rows, "well long, block long, k int, rpm array<double>, torque array<double>, rop array<double>")

    def counted(s):
        made.add(len(s))
        return s

    counting = F.pandas_udf(counted, "array<double>")
    monkeypatch.setattr(registry, "_telemetry", lambda spark, d: w.withColumn("rpm", counting("rpm")))
    got = registry.per_channel_reconstruction(spark, "").collect()
    assert {r.p for r in got} <= {0, 1} and 0 < len(got) < 48
    assert made.value == 48
