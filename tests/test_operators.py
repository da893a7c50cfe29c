"""Small, hand-checkable cases of the signal operators and sources."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quefrency.functions import basis, signal
from quefrency.operators import discriminant, heads, reconstruct, splits, stats
from quefrency.sources import artifacts, recordings, synthetic, telemetry
from quefrency.streaming import tiler


def test_impulse_and_sine():
    x = np.zeros((1, 16))
    x[0, 0] = 1
    assert np.allclose(signal.cepstrum(x, 16, 16, "boxcar"), 0, atol=1e-12)
    tone = np.cos(2 * np.pi * 3 * np.arange(16) / 16)[None]
    m = signal.two_sided(signal.half_spectrum(tone, 16, 16, "boxcar"), 16)[0, 0]
    assert set(np.argsort(m)[-2:]) == {3, 13}


def test_fir_keeps_to_its_window():
    x = np.zeros((2, 6))
    x[0, 5] = x[1, 0] = 1
    y = signal.causal_fir(x, np.array([1, 0.5]))
    assert y.tolist() == [[0, 0, 0, 0, 0, 1], [1, 0.5, 0, 0, 0, 0]]


def test_constant_frame():
    d = dict(zip(("skew", "kurt", "max", "min", "p05", "p95", "iqr", "mad", "zcr", "ar1", "rng"), signal.shape_descriptors(np.full((1, 9), 2.0))[0], strict=True))
    assert (d["skew"], d["kurt"], d["ar1"], d["rng"]) == (0, -3, 0, 0)


def test_dct_and_lifters():
    m = signal.dct_matrix(8)
    assert np.allclose(m @ m.T, np.eye(8))
    x = np.random.default_rng(0).normal(size=(3, 64))
    assert np.allclose(signal.liftered(x, "lb", 3, None, 16, 8), signal.cepstrum(x, 16, 8, lo=1)[:, :, 2:])
    with pytest.raises(ValueError):
        signal.lifter_weights("other", 1, 4)


def test_patp():
    for alpha, want in ((0, (1 / 2, 1 / 3, 1 / 4)), (0.5, (1, 1, 1)), (1, (2, 3, 4))):
        assert np.allclose([basis.patp_power(i, alpha) for i in (2, 3, 4)], want)
    with pytest.raises(ValueError):
        basis.basis("nothing", None)
    t = basis.TensorBasis("fractional", 3, 2)
    assert t.dim == 15 and [t.is_cross_term(k) for k in (0, 4)] == [False, True]


def test_wilcoxon_and_chi2():
    assert stats.wilcoxon_exact_p(120, 15) == 2.0**-15
    assert abs(stats.chi2_p(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_p(2.0, 2) - np.exp(-1)) < 1e-12


def test_split_sizes(spark):
    d = spark.createDataFrame([(i, f"g{i // 3}") for i in range(15)], "i int, g string")
    s = splits.grouped_split(d, "g", 0.5)
    assert s.where("role = 'test'").select("g").distinct().count() == 2  # 2.5 rounds to even
    assert splits.leakage_audit(s, ["g"]).first()["overlap"] == 0
    seven = spark.createDataFrame([(i,) for i in range(7)], "g int")
    assert sorted(r["count"] for r in splits.grouped_kfold(seven, "g", 3).groupBy("fold").count().collect()) == [2, 2, 3]
    for bad in (0, 1):
        with pytest.raises(ValueError):
            splits.grouped_split(d, "g", bad)
    with pytest.raises(ValueError):
        splits.day_split(d, "g", ["a"], ["a"])
    with pytest.raises(ValueError):
        splits.receiver_split(d, "g", train=["a"])


def test_touching_spans_do_not_overlap(spark):
    d = spark.createDataFrame([(1, 0, 10, "train"), (1, 10, 20, "test"), (1, 5, 3000, "test"), (2, 0, 5, "test")], "series int, start long, end long, role string")
    assert [tuple(r) for r in splits.raw_overlap(d).collect()] == [(1, 1)]


def blobs(spark, n=40):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, i % 3, *(float(v) for v in rng.normal(3 * (i % 3), 1, 4))) for i in range(3 * n)], "i int, y int, a double, b double, c double, d double")


def test_every_head_beats_chance(spark):
    d = blobs(spark)
    xs = ["a", "b", "c", "d"]
    m = discriminant.ClassMoments.fit(d, "y", xs)
    for s, least in ((m.qda(d, ["i", "y"]), False), (m.rda(d, ["i", "y"], 0.5, 0.1), False), (m.diagonal(d, ["i", "y"]), False), (m.mahalanobis(d, ["i", "y"]), True)):
        p = discriminant.nearest(s, ["i", "y"], least)
        assert p.where("p = y").count() > 100
    inner = splits.stratified_inner(d, "y", "i")
    assert len(discriminant.tune_rda(inner.where("role = 'inner'"), inner.where("role = 'val'"), "y", xs, (0.0, 1.0), (0.0, 0.5))) == 2
    for f in (heads.logistic, heads.gaussian_mixture):
        assert f(d, d, "y", xs).where("p = y").count() > 100


def test_reconstruction_prefers_its_class(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(v)) for i in range(60) for v in rng.normal(0 if i % 2 else 4, 0.3, 10)]
    d = spark.createDataFrame(rows, "i int, y int, v double")
    m = reconstruct.Reconstructor().fit(d, "y", ["v"])
    s = m.transform(d, ["i", "y"], ["v"])
    assert s.count() == 120 and all(c > 0 for _, c, _ in m.conditioning())
    assert reconstruct.boundary(0.04) and not reconstruct.boundary(0.05)
    with pytest.raises(ValueError):
        reconstruct.Reconstructor().fit(d.limit(1), "y", ["v"])


def test_iq_files(spark, tmp_path):
    x = np.arange(10, dtype="<i2")
    for n in ("DJI_phantom_4_2G.bin", "Parrot_mambo_control_2G.bin", "Yuneec_typhoon_h_2G_1of2.bin"):
        (tmp_path / n).write_bytes(x.tobytes()[:20])
    (tmp_path / "DJI_torn_2G.bin").write_bytes(x.tobytes()[:19])  # no whole number of samples: left out
    got = {r.class_label: r for r in recordings.discover(spark, str(tmp_path)).collect()}
    assert set(got) == {"DJI_phantom_4", "Parrot_mambo_control", "Yuneec_typhoon_h"}
    y = got["Yuneec_typhoon_h"]
    assert (y.part, y.total_parts, y.n_samples, y.fs) == (1, 2, 5, 120e6)
    r = recordings.read_iq(spark, str(tmp_path), block=3, glob="DJI_phantom*").orderBy("start").collect()
    assert [(b.start, len(b.re)) for b in r] == [(0, 3), (3, 2)] and abs(r[1].im[0] - 7 / 32768) < 1e-9
    w = spark.createDataFrame([(str(tmp_path / "DJI_phantom_4_2G.bin"), 1, 3)], "path string, start long, count int")
    assert recordings.read_iq_windows(w).first().re == pytest.approx([2 / 32768, 4 / 32768, 6 / 32768])
    for bad in ((-1, 2), (0, 0), (3, 9)):
        with pytest.raises(Exception, match="windows start|ends before"):
            recordings.read_iq_windows(w.select("path", F.lit(bad[0]).alias("start"), F.lit(bad[1]).alias("count"))).collect()
    n = recordings.numbered(recordings.discover(spark, str(tmp_path))).orderBy("rec_id").collect()
    assert [(r.rec_id, r.class_id) for r in n] == [(0, 0), (1, 1), (2, 2)]
    names = spark.createDataFrame([("A_b_9G.bin",)], "n string")
    with pytest.raises(Exception, match="unknown band"):
        names.select(recordings.parse_name(names["n"])["band"]).collect()


def mat5(name, values, packed):
    tag = lambda kind, data: struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    body = tag(6, struct.pack("<II", 6, 0)) + tag(5, struct.pack("<ii", len(values), 1)) + tag(1, name.encode()) + tag(9, np.array(values, "<f8").tobytes())
    data = tag(14, body)
    if packed:
        z = zlib.compress(data)
        data = struct.pack("<II", 15, len(z)) + z
    return b" " * 124 + struct.pack("<H", 0x0100) + b"IM" + data


def test_mat_files(spark, tmp_path):
    (tmp_path / "97.mat").write_bytes(mat5("X097_DE_time", [1, 2.5, 3], True))
    (tmp_path / "98.mat").write_bytes(mat5("X098_DE_time", [4], False))
    assert sorted(list(r.x) for r in recordings.read_mat(spark, str(tmp_path)).collect()) == [[1, 2.5, 3], [4]]


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Rotary Speed (rpm),Surface Torque (KPa),ROP(1 m),Depth (m),Other\n20,5,3,100,x\n20,,3,101,x\n20,bad,3,102,x\n5,5,3,103,x\n30,1,2,104,x\n")
    assert [r.depth for r in telemetry.read_csv_telemetry(spark, str(tmp_path / "w.csv")).orderBy("depth").collect()] == [100, 104]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1.5, "b": 2}')
    assert {r.path: r.value for r in artifacts.read_leaves(spark, str(tmp_path)).select("path", "value").collect()} == {"a": "1.5", "b": "2"}
    got = spark.createDataFrame([("a", 1.0)], "k string, value double")
    want = spark.createDataFrame([("a", 1.001, 0.01), ("b", 0.0, 1.0)], "k string, value double, tolerance double")
    assert {r.k: r.ok for r in artifacts.check(got, want, ["k"]).collect()} == {"a": True, "b": False}


def test_synthetic_signals_do_not_depend_on_partitions(spark):
    ids = spark.range(8)
    a, b = (synthetic.signals(x, "id", 128).orderBy("signal_id").collect() for x in (ids, ids.repartition(3)))
    assert a == b and [r.y for r in a] == [0, 1, 2, 3] * 2


def test_stream_of_tiles(spark, tmp_path):
    rows = [(u, e, float(e)) for u in (1, 2) for e in range(30)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, event_id long, value double").parquet(str(tmp_path / "in"))
    q = tiler.tile_stream(s, 4, 2, 4).writeStream.format("memory").queryName("tiles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("tiles").where("user_id = 1" if "user_id" in spark.table("tiles").columns else "series = 1").orderBy("block", "k").collect()
    assert [(r.block, r.k, r.x[0]) for r in got] == [(0, 0, 0.0), (0, 1, 4.0), (1, 0, 12.0), (1, 1, 16.0), (2, 0, 24.0)]
