"""Running sums, tiling, overlaps and resamples that no single task carries, against plain Python."""

import random
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from quefrency.operators import ranking, splits, stats, tiling
from quefrency.streaming import tiler


def test_running_places_under_heavy_tails(spark):
    rng = random.Random(1)
    rows = [("a", rng.lognormvariate(0, 3)) for _ in range(9000)] + [("a", 1e12), ("a", -1e12), ("a", None), ("a", float("nan"))] + [("b", 5.0)] * 300 + [(None, float(i)) for i in range(40)]
    d = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i int, k string, v double").repartition(5)
    got = {r.i: (r.before, r.total) for r in ranking.by_value(d, ["k"], ["v", "i"]).collect()}
    assert len(got) == len(rows)
    order = lambda r: (r[1][1] is not None, np.isnan(r[1][1] or 0), r[1][1] if r[1][1] is not None and not np.isnan(r[1][1]) else 0, r[0])
    for key in ("a", "b", None):
        own = sorted(((i, r) for i, r in enumerate(rows) if r[0] == key), key=order)
        assert [got[i] for i, _ in own] == [(n, len(own)) for n in range(len(own))]


def test_ranges_hold_about_as_many_rows_each(spark):
    d = spark.range(60000).select((F.when(F.col("id") == 7, 1e12).otherwise(F.exp(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0) + F.col("id") / 1e6)).alias("v"))
    ends = ranking.splitters(d, [], F.col("v"), ["v"]).first()[0]
    share = np.histogram([r.v for r in d.collect()], [-np.inf, *np.unique(ends), np.inf])[0] / 60000
    assert len(ends) == ranking.RANGES - 1 and share.max() < 5 / ranking.RANGES
    # Ranges come out the same on another partitioning.
    assert ranking.splitters(d.repartition(7), [], F.col("v"), ["v"]).first()[0] == ends


def test_ranks_of_dates_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "2024-01-02"), (2, "2023-05-01"), (3, None), (4, "2024-01-02")], "i int, t string").withColumn("t", F.to_date("t"))
    assert [r.i for r in ranking.by_value(d, [], ["t", "i"]).orderBy("before").collect()] == [3, 2, 1, 4]
    assert ranking.by_value(d.limit(0), ["i"], ["t"]).count() == 0


def test_tiles_of_a_long_series(spark):
    d = spark.range(3000).select((F.col("id") % 2).alias("s"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("t"), "id")
    rows = d.collect()
    for part in (False, True):
        got = {(r.s, r.block, r.k, r.offset): r.id for r in tiling.tile(d, "s", ["t", "id"], 8, 3, 5, part).collect()}
        want = {}
        for s in (0, 1):
            own = sorted((r.t, r.id) for r in rows if r.s == s)
            for pos, (_, i) in enumerate(own):
                block, at = divmod(pos, 29)
                if at < 24 and block * 29 + ((at // 8 + 1) * 8 if part else 24) <= len(own):
                    want[s, block, at // 8, at % 8] = i
        assert got == want


def test_overlaps_of_long_and_dense_spans(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        start = rng.choice([rng.randrange(50), rng.randrange(10**12)])
        rows.append((rng.choice(["x", "y", None]), start, start + rng.choice([0, 1, 5, 10**9, 10**12]), rng.choice(["train", "test", "other"])))
    rows += [("z", 0, 10, "train"), ("z", 10, 20, "test"), ("z", 5, 5, "test")]
    got = {r.series: r.overlaps for r in splits.raw_overlap(spark.createDataFrame(rows, "series string, start long, end long, role string")).collect()}
    want = {}
    for s, a, b, r in rows:
        for t, c, d, q in rows:
            if s == t and r == "train" and q == "test" and max(a, c) < min(b, d):
                want[s] = want.get(s, 0) + 1
    assert got == want and "z" not in got and len(got) == 3


def test_a_disordered_stream_gives_the_tiles_of_the_batch(spark, tmp_path):
    """Samples come up to 40 seconds out of order, over batches; a last one moves the watermark past all others."""
    rng = random.Random(5)
    rows = [(i % 3, i, 1_700_000_000 + i, float(rng.randrange(100))) for i in range(360)]
    rows.sort(key=lambda r: r[2] + rng.uniform(-20, 20))
    schema = "user_id long, event_id long, s long, value double"
    for n in range(6):
        spark.createDataFrame(rows[60 * n : 60 * n + 60], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    last = [(9, 10**6, 1_700_000_000 + 10**5, 0.0)]
    spark.createDataFrame(last, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("s"))
    q = tiler.tile_disordered(stream, 4, 2, 3, delay="60 seconds").writeStream.format("memory").queryName("disordered").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    got = {(r.series, r.block, r.k): list(r.x) for r in spark.table("disordered").collect()}
    batch = tiling.tile(spark.createDataFrame(rows, schema), "user_id", ["event_id"], 4, 2, 3, True)
    want = {(r.user_id, r.block, r.k): list(r.x) for r in tiling.windows(batch, ["user_id", "block", "k"], "value", 4).collect()}
    assert got == want and len(want) > 60


def test_weighted_resamples(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 50, y, y if rng.random() < 0.7 else 1 - y, y if rng.random() < 0.8 else 1 - y) for i in range(500) for y in [i % 2]]
    d = spark.createDataFrame(rows, "id long, y long, a long, b long").repartition(3)
    got = {(r.r, r.y, r.a, r.b): r.n for r in stats.weighted_resamples(d, "id", 30, 9).collect()}
    w = stats.poisson_weights(np.array([r[0] for r in rows]), 30, 9)
    want = {}
    for (_, *cell), own in zip(rows, w, strict=True):
        for r, n in enumerate(own.tolist()):
            if n:
                want[r, *cell] = want.get((r, *cell), 0) + n
    assert got == want
    # Counts with mean and variance 1, independent of each other by row and by resample.
    w = stats.poisson_weights(np.arange(20000), 50, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and np.abs(np.corrcoef(w.T) - np.eye(50)).max() < 0.05
    assert np.abs(np.corrcoef(w[:200]) - np.eye(200)).max() < 0.75
    a = stats.paired_bootstrap(stats.paired_cells(d), stats.weighted_resamples(d, "id", 400, 1)).first()
    b = stats.paired_bootstrap(stats.paired_cells(d), stats.multinomial_resamples(stats.paired_cells(d), 400, 1)).first()
    assert a.delta == b.delta and abs(a.ci_low - b.ci_low) < 0.03 and abs(a.ci_high - b.ci_high) < 0.03


def test_ranges_of_large_keys_alone(spark, monkeypatch):
    """Large keys in ranges and small ones without give the places that one order gives; rows are not joined with their sums."""
    monkeypatch.setattr(ranking, "ALONE", 500)
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 1), float(rng.randrange(5))]), rng.randrange(3)) for k, n in (("a", 3000), ("b", 400), (None, 700)) for _ in range(n)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, v double, w int").repartition(5)
    out = ranking.by_value(d, ["k"], ["v", "i"], F.col("w"))
    assert out.columns == ["i", "k", "v", "w", "total", "before"]
    assert ranking.splitters(d, ["k"], F.col("v"), ["v", "i"], over=500).count() == 2
    got = {r.i: (r.before, r.total) for r in out.collect()}
    for key in ("a", "b", None):
        own, before = sorted((r[1], i, r[2]) for i, r in enumerate(rows) if r[0] == key), 0
        for _, i, w in own:
            assert got[i] == (before, sum(r[2] for r in own))
            before += w
    assert "Join" not in ranking.by_hash(d, ["k"], F.md5(F.col("i").cast("string")))._jdf.queryExecution().optimizedPlan().toString()


def test_group_means_are_the_same_on_any_partitioning(spark):
    from quefrency.operators import datasets

    rng = random.Random(6)
    rows = [(g, k, g % 2, [rng.choice([0.1, 0.7, 1e6, 1 / 3]) for _ in range(3)]) for g in range(60) for k in range(9)]
    d = spark.createDataFrame(rows, "g int, k int, y int, s array<double>")
    plain = lambda v: reduce(lambda a, b: a + b, v, 0.0)  # noqa: E731 (sum() corrects for rounding)
    want = {g: [plain(r[3][i] for r in rows if r[0] == g) / 9 for i in range(3)] for g in range(60)}
    for n in (1, 3, 7):
        got = datasets.group_means(d.repartition(n, F.xxhash64("k", F.lit(n))), ["g"], "y", ["k"]).collect()
        assert {r.g: list(r.s) for r in got} == want and all((r.n, r.y) == (9, r.g % 2) for r in got)
