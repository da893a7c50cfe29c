"""Queries by name over the given tables, and the SQL that must give the same rows.

Signal windows are rows of `embeddings` (64 samples; 16-point frames, hop 8); telemetry is `events` by user and `lineitem`;
groups are four consecutive windows.
"""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.functions import basis as B
from quefrency.functions import columns, signal
from quefrency.operators import datasets, discriminant, estimators, experiments, heads, metrics, pipelines, ranking, reconstruct, spectra, splits, stats, subsets, tiling
from quefrency.plans import sql
from quefrency.plans.sql import BASE, SMP, r6
from quefrency.schema import SHAPE, SPECTRAL5, SPECTRAL11
from quefrency.sources import artifacts, classes, synthetic, telemetry

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLE[name or f.__name__] = oracle
        return f

    return put


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def windows(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def q6(c, name: str):
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def spread(frame: DataFrame, names: list[str], keys: list[str], v: str) -> DataFrame:
    return frame.select(*keys, *columns.named(v, names, 6))


# --- bases -----------------------------------------------------------------------------------------------------------

X = "((p_size - 25) / 10.0)"
_PART = {
    "polynomial": [sql.sign_pow(X, p) for p in (2.0, 3.0, 4.0)],
    "fractional": [sql.sign_pow(X, 1 / p) for p in (2, 3, 4)],
    "trigonometric": [f"sin({k} * {X})" for k in (1, 2, 3)],
    "robust": [f"tanh({X})", f"(1 / (1 + exp(-least(greatest({X}, -50), 50))))", f"atan({X})"],
    "log": [f"(sign({X}) * ln(1 + pow(abs({X}), {k})))" for k in (1, 2, 3)],
    "patp": [sql.sign_pow(X, B.patp_power(k, 0.3)) for k in (2, 3, 4)],
}


def _basis(name, spark, d):
    x = (F.col("p_size") - 25) / F.lit(10.0)
    return table(spark, d, "part").select("p_partkey", *(q6(c, f"b{i}") for i, c in enumerate(B.basis(name, x, 3, 0.3 if name == "patp" else None))))


for _n, _c in _PART.items():
    query(f"SELECT p_partkey, {', '.join(f'{r6(e)} AS b{i}' for i, e in enumerate(_c))} FROM part", f"basis_{_n}")(partial(_basis, _n))

_T = [["1.0", *(sql.sign_pow(x, 1 / p) for p in (2, 3, 4))] for x in (X, "(p_retailprice / 1000.0)")]


@query("SELECT p_partkey, " + ", ".join(f"{r6(f'{_T[0][i]} * {_T[1][j]}')} AS t{i}{j}" for i in range(4) for j in range(4) if i + j) + " FROM part")
def basis_tensor(spark, d):
    t = B.TensorBasis("fractional", 3, 2)
    c = t.columns([(F.col("p_size") - 25) / F.lit(10.0), F.col("p_retailprice") / 1000])
    return table(spark, d, "part").select("p_partkey", *(q6(x, "t" + "".join(map(str, m))) for x, m in zip(c, t.indices, strict=True)))


# --- descriptors -----------------------------------------------------------------------------------------------------

_SMP = f"WITH {SMP}, src AS (SELECT window_id, y, n AS pos, v FROM smp), "


@query(_SMP + sql.shape("src", "window_id, y") + " SELECT * FROM shp")
def shape_descriptors(spark, d):
    return spread(spectra.describe(windows(spark, d), v="x"), SHAPE, ["window_id", "y"], "s")


@query(_SMP + sql.shape("src", "window_id, y", False) + ", raw AS (SELECT * FROM shp) SELECT y, count(*) AS n, " + ", ".join(f'round(avg("{c}"), 5) + 0.0 AS "{c}"' for c in SHAPE) + " FROM raw GROUP BY y")
def class_descriptor_means(spark, d):
    s = spread(spectra.describe(windows(spark, d), znorm=False, v="x"), SHAPE, ["window_id", "y"], "s")
    return s.groupBy("y").agg(F.count("*").alias("n"), *((F.round(F.avg(c), 5) + F.lit(0.0)).alias(c) for c in SHAPE))


@query(f"WITH {SMP} SELECT window_id, n, {r6('(v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-9 THEN stddev_pop(v) OVER w ELSE 1 END')} AS z FROM smp WINDOW w AS (PARTITION BY window_id)")
def zscore_windows(spark, d):
    long = windows(spark, d).select("window_id", F.posexplode("x").alias("n", "v"))
    return tiling.zscore(long, "v", ["window_id"]).select("window_id", F.col("n").cast("long").alias("n"), q6(F.col("z"), "z"))


_STATS = """, one AS (SELECT window_id, y, frame_id, pos, v, exp(v) AS g, exp(v) / sum(exp(v)) OVER w AS pm, avg(v) OVER w AS m, CASE WHEN var_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1e-6 END AS sd, row_number() OVER (PARTITION BY window_id, frame_id ORDER BY v) AS r FROM prf WINDOW w AS (PARTITION BY window_id, frame_id))"""
_S5 = [f"{r6(e)} AS {n}" for e, n in (("exp(avg(ln(g + 1e-12))) / avg(g)", "flatness"), ("-sum(pm * ln(pm + 1e-12)) / ln(15)", "entropy"), ("sum(pm * pos / 14.0)", "centroid"), ("avg(pow((v - m) / sd, 3))", "skew"), ("avg(pow((v - m) / sd, 4)) - 3", "kurt"))]
_S6 = [f"{r6(e)} AS {n}" for e, n in (("max(v) - avg(v)", "crest"), ("quantile_cont(v, 0.05)", "p05"), ("quantile_cont(v, 0.5)", "p50"), ("quantile_cont(v, 0.95)", "p95"), ("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", "iqr"), ("max(v) - min(v)", "gap"))]


@query(BASE + _STATS + f" SELECT window_id, frame_id, {', '.join(_S5)} FROM one GROUP BY window_id, frame_id")
def spectral_stats5(spark, d):
    return spread(spectra.spectral_statistics(spectra.log_profiles(windows(spark, d), 16, 8), 5), SPECTRAL5, ["window_id", F.col("frame_id").cast("long").alias("frame_id")], "s")


@query(BASE + _STATS + f" SELECT window_id, frame_id, {', '.join(_S5 + _S6)} FROM one GROUP BY window_id, frame_id")
def spectral_stats11(spark, d):
    return spread(spectra.spectral_statistics(spectra.log_profiles(windows(spark, d), 16, 8)), SPECTRAL11, ["window_id", F.col("frame_id").cast("long").alias("frame_id")], "s")


@query(BASE + _STATS + f", f AS (SELECT y, {', '.join(e.replace('round(', '(', 1).replace(', 6) + 0.0', ')') for e in _S5)} FROM one GROUP BY window_id, frame_id, y) " + " UNION ALL ".join(f"SELECT y, {i} AS stat, {r6(f'avg({n})')} AS mean, {r6(f'stddev_pop({n})')} AS std FROM f GROUP BY y" for i, n in enumerate(SPECTRAL5)))
def class_moment_summary(spark, d):
    s = spectra.class_moment_summary(spectra.spectral_statistics(spectra.log_profiles(windows(spark, d), 16, 8), 5))
    return s.select("y", "stat", q6(F.col("mean"), "mean"), q6(F.col("std"), "std"))


# --- spectra ---------------------------------------------------------------------------------------------------------


def _cells(frame: DataFrame, lo: int, hi: int, shift: int = 0) -> DataFrame:
    return frame.select("window_id", F.col("frame_id").cast("long").alias("frame_id"), *columns.named("v", [f"c{p}" for p in range(lo, hi)], 6))


@query(BASE + " " + sql.cells("prf", 0, 15))
def stft_profile(spark, d):
    return _cells(spectra.log_profiles(windows(spark, d), 16, 8), 0, 15)


@query(BASE + " " + sql.cells("cep", 1, 8))
def cepstrum(spark, d):
    return _cells(spectra.cepstra(windows(spark, d), 16, 8), 1, 8)


@query(BASE + " " + sql.cells("cep", 0, 8))
def full_cepstrum(spark, d):
    return _cells(spectra.full_cepstra(windows(spark, d), 16, 8), 0, 8)


@query(f"WITH {SMP}, {sql.fft(share=0.54)}, {sql.MIRROR}, {sql.PROFILE} " + sql.cells("prf", 0, 15))
def hamming_profile(spark, d):
    return _cells(spectra.log_profiles(windows(spark, d), 16, 8, "hamming"), 0, 15)


@query(BASE + ", lif AS (SELECT window_id, y, frame_id, lifter, pos, v FROM cep, (SELECT unnest([1, 2, 3, 4]) AS lifter) WHERE pos >= lifter), " + sql.shape("lif", "window_id, y, frame_id, lifter") + " SELECT * FROM shp")
def cepstrum_lifters(spark, d):
    s = spectra.describe(spectra.all_lifters(windows(spark, d), (1, 2, 3, 4), 16, 8))
    return spread(s, SHAPE, ["window_id", "y", F.col("frame_id").cast("long").alias("frame_id"), "lifter"], "s")


def _lifter_sql(lo, hi, weights):
    w = ", ".join(f"({lo + i}, {float(x)!r})" for i, x in enumerate(weights))
    return BASE + f", lif AS (SELECT window_id, y, frame_id, c.pos, v * w AS v FROM cep c JOIN (VALUES {w}) AS t(pos, w) ON c.pos = t.pos), " + sql.shape("lif", "window_id, y, frame_id") + " SELECT * FROM shp"


def _lifter(family, lo, hi, spark, d):
    s = spectra.describe(spectra.liftered(windows(spark, d), family, lo, hi, 16, 8))
    return spread(s, SHAPE, ["window_id", "y", F.col("frame_id").cast("long").alias("frame_id")], "s")


# Weights written out by hand for the SQL: ones; a symmetric Tukey of six points, half tapered; 1 + 3 sin(pi q / 6).
query(_lifter_sql(2, 8, [1, 1, 1, 1, 1, 1]), "lifter_bandpass")(partial(_lifter, "bp", 2, 8))
query(_lifter_sql(2, 8, [0, 0.9045084971874737, 1, 1, 0.9045084971874737, 0]), "lifter_tukey")(partial(_lifter, "bp_tukey", 2, 8))
query(_lifter_sql(2, 8, [2.5, 3.598076211353316, 4, 3.598076211353316, 2.5, 1.0000000000000004]), "lifter_juang")(partial(_lifter, "juang", 2, 8))


@query(BASE + ", dev AS (SELECT window_id, frame_id FROM prf GROUP BY window_id, frame_id HAVING stddev_pop(v) >= 0.8) SELECT y, count(*) AS n_frames, count(DISTINCT window_id) AS n_windows FROM (SELECT DISTINCT window_id, y, frame_id FROM prf) JOIN dev USING (window_id, frame_id) GROUP BY y")
def energy_mask(spark, d):
    return spectra.energy_mask(spectra.log_profiles(windows(spark, d), 16, 8)).groupBy("y").agg(F.count("*").alias("n_frames"), F.countDistinct("window_id").alias("n_windows"))


@query(BASE + ", nrm AS (SELECT window_id, y, frame_id, pos, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS v FROM prf WINDOW w AS (PARTITION BY window_id, pos)) " + sql.cells("nrm", 0, 15))
def cmvn(spark, d):
    return _cells(spectra.normalised(windows(spark, d), "cmvn", 16, 8), 0, 15)


# Orthogonal polynomials on 15 points -1 .. 1: 1, t, t^2 - a, t^3 - c t, with a and c their least-squares values.
_POLY = """, pt AS (SELECT pos, -1 + 2.0 * pos / 14 AS t FROM (SELECT unnest(range(15)) AS pos)),
mo AS (SELECT avg(t * t) AS a, sum(pow(t, 4)) / sum(t * t) AS c FROM pt),
ob AS (SELECT pos, 1.0 AS e0, t AS e1, t * t - a AS e2, pow(t, 3) - c * t AS e3 FROM pt, mo),
nn AS (SELECT sum(e0 * e0) AS n0, sum(e1 * e1) AS n1, sum(e2 * e2) AS n2, sum(e3 * e3) AS n3 FROM ob),
co AS (SELECT window_id, frame_id, sum(v * e0) / any_value(n0) AS k0, sum(v * e1) / any_value(n1) AS k1, sum(v * e2) / any_value(n2) AS k2, sum(v * e3) / any_value(n3) AS k3 FROM prf JOIN ob USING (pos), nn GROUP BY window_id, frame_id),
nrm AS (SELECT window_id, y, frame_id, pos, v - k0 * e0 - k1 * e1 - k2 * e2 - k3 * e3 AS v FROM prf JOIN co USING (window_id, frame_id) JOIN ob USING (pos)) """


@query(BASE + _POLY + sql.cells("nrm", 0, 15))
def detrend(spark, d):
    return _cells(spectra.normalised(windows(spark, d), "detrend", 16, 8), 0, 15)


@query(BASE + """, dr AS (SELECT window_id, y, frame_id, pos, 0.1 * (2 * v + coalesce(lag(v, 1) OVER w, 0) - coalesce(lag(v, 3) OVER w, 0) - 2 * coalesce(lag(v, 4) OVER w, 0)) AS u FROM prf WINDOW w AS (PARTITION BY window_id, pos ORDER BY frame_id)),
nrm AS (SELECT a.window_id, a.y, a.frame_id, a.pos, sum(pow(0.94, a.frame_id - b.frame_id) * b.u) AS v FROM dr a JOIN dr b ON a.window_id = b.window_id AND a.pos = b.pos AND b.frame_id <= a.frame_id GROUP BY ALL) """ + sql.cells("nrm", 0, 15))
def rasta(spark, d):
    return _cells(spectra.normalised(windows(spark, d), "rasta", 16, 8), 0, 15)


# Six triangles over nine bins of 750 Hz, worked out by hand: eight mel-spaced frequencies from 0 to 6000 Hz (0, 266.6, 634.7,
# 1143.0, 1844.8, 2814.0, 4152.2, 6000) fall into bins 0, 0, 0, 1, 2, 3, 5, 8, and a triangle's sides are one bin wide at least.
_MEL = "(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 4, 1.0 / 2), (5, 4, 1.0 / 2), (5, 5, 1.0), (5, 6, 2.0 / 3), (5, 7, 1.0 / 3)"


@query(BASE + f""", fb AS (SELECT * FROM (VALUES {_MEL}) AS t(m, b, w)),
me AS (SELECT window_id, y, frame_id, m, ln(sum(w * p2) + 1e-8) AS e FROM pow2 JOIN fb USING (b) GROUP BY ALL),
cc AS (SELECT window_id, y, frame_id, k AS pos, sum(e * cos(pi() * k * (2 * m + 1) / 12)) * sqrt(2.0 / 6) AS v FROM me, (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL) """ + sql.cells("cc", 1, 6))
def mfcc(spark, d):
    return _cells(spectra.mfcc(windows(spark, d), 12000.0, 16, 8, 6, 5), 1, 6)


@query(f"WITH {SMP}, t AS (SELECT * FROM (VALUES (0, 1.0), (1, 0.5), (2, -0.25)) AS t(k, h)), o AS (SELECT s.window_id, s.n, sum(coalesce(l.v, 0) * h) AS v FROM smp s CROSS JOIN t LEFT JOIN smp l ON l.window_id = s.window_id AND l.n = s.n - t.k GROUP BY ALL) SELECT window_id, {r6('sum(v * v)')} AS energy, {r6('max(CASE WHEN n = 63 THEN v END)')} AS last_value FROM o GROUP BY window_id")
def fir_apply(spark, d):
    x = spectra.fir(windows(spark, d), [1.0, 0.5, -0.25])
    return x.select("window_id", q6(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e), "energy"), q6(F.col("x")[63], "last_value"))


_TAPS = {n: [(-0.5) ** k for k in range(n)] for n in (1, 2, 3, 5)}


@query(f"WITH {SMP}, t AS (SELECT * FROM (VALUES {', '.join(f'({n}, {k}, {h!r})' for n, hs in _TAPS.items() for k, h in enumerate(hs))}) AS t(severity, k, h)), o AS (SELECT s.window_id, severity, s.n, sum(coalesce(l.v, 0) * h) AS v FROM smp s CROSS JOIN t LEFT JOIN smp l ON l.window_id = s.window_id AND l.n = s.n - t.k GROUP BY ALL) SELECT severity, window_id, {r6('sum(v * v)')} AS energy FROM o GROUP BY severity, window_id")
def fir_sweep(spark, d):
    taps = spark.createDataFrame(list(_TAPS.items()), "severity int, taps array<double>")
    return spectra.fir_sweep(windows(spark, d), taps).select("severity", "window_id", q6(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e), "energy"))


# --- tiling and telemetry --------------------------------------------------------------------------------------------

_EV = "ev AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), tl AS (SELECT user_id, event_id, value, pos, n, pos // 24 AS block, (pos % 24) // 8 AS k, (pos % 24) % 8 AS o FROM ev WHERE pos % 24 < 16)"


def _tiles(spark, d, partial_blocks):
    return tiling.tile(table(spark, d, "events"), "user_id", ["ts", "event_id"], 8, 2, 8, partial_blocks)


@query(f"WITH {_EV} SELECT user_id, block, k, count(*) AS n, {r6('avg(value)')} AS mean FROM tl WHERE (block * 24 + 16) <= n GROUP BY user_id, block, k")
def tile_blocks(spark, d):
    return _tiles(spark, d, False).groupBy("user_id", "block", "k").agg(F.count("*").alias("n"), q6(F.avg("value"), "mean"))


@query(f"WITH {_EV} SELECT user_id, block, k, {r6('max(CASE WHEN o = 0 THEN value END)')} AS first_value, {r6('stddev_pop(value)')} AS sd FROM tl WHERE (block * 24 + (k + 1) * 8) <= n GROUP BY user_id, block, k")
def tile_guard(spark, d):
    w = tiling.windows(_tiles(spark, d, True), ["user_id", "block", "k"], "value", 8)
    mean = F.aggregate("x", F.lit(0.0), lambda a, e: a + e) / 8
    return w.select("user_id", "block", "k", q6(F.col("x")[0], "first_value"), q6(F.sqrt(F.aggregate(F.transform("x", lambda e: F.pow(e - mean, F.lit(2.0))), F.lit(0.0), lambda a, e: a + e) / 8), "sd"))


@query(f"WITH {_EV}, w AS (SELECT user_id, block, k, row_number() OVER (PARTITION BY user_id % 5 ORDER BY user_id, block, k) AS r FROM tl WHERE o = 0 AND block * 24 + 16 <= n) SELECT user_id % 5 AS y, user_id, block, k FROM w WHERE r <= 40")
def tile_cap(spark, d):
    w = _tiles(spark, d, False).where("offset = 0").withColumn("y", F.col("user_id") % 5)
    return tiling.cap_by_class(w, "y", ["user_id", "block", "k"], 40).select("y", "user_id", "block", "k")


@query("WITH g AS (SELECT vec_id // 4 AS grp, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT grp, n, coalesce(sum(n) OVER (ORDER BY md5('2026:' || grp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT vec_id, vec_id // 4 AS grp FROM embeddings WHERE vec_id // 4 IN (SELECT grp FROM o WHERE before < 150)")
def balance_groups(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("grp"))
    return tiling.balance_by_groups(e, "grp", 150).select("vec_id", "grp")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) WHERE r % 2 = 1")
def decimate(spark, d):
    return tiling.decimate(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["ts", "event_id"], 2, ["user_id"]).select("user_id", "event_id")


@query("SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_torque FROM lineitem WHERE l_quantity > 10 AND l_discount * 100 > 1 AND l_extendedprice > 0 GROUP BY 1")
def on_bottom_filter(spark, d):
    raw = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("string").alias("q"), (F.col("l_discount") * 100).alias("r"), F.col("l_extendedprice").alias("t"))
    x = raw.select("l_returnflag", F.expr("try_cast(q as double)").alias("rpm"), F.col("r").alias("rop"), F.col("t").alias("torque")).na.drop()
    return telemetry.on_bottom(x).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg("torque"), 4).alias("mean_torque"))


# --- reconstruction and discriminants --------------------------------------------------------------------------------

_PH = [sql.sign_pow("v", 1 / k) for k in (2, 3, 4)]
_MOM = f"WITH {SMP}, ph AS (SELECT window_id, y, v, {', '.join(f'{e} AS p{i}' for i, e in enumerate(_PH))} FROM smp), mo AS (SELECT y, count(*) AS n, avg(v) AS m, {', '.join(f'avg(p{i}) AS m{i}' for i in range(3))}, {', '.join(f'covar_pop(p{i}, p{j}) + {0.01 if i == j else 0} AS f{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'covar_pop(p{i}, v) AS b{i}' for i in range(3))} FROM ph GROUP BY y)"
_INV, _DET = sql.adjugate("f")
_K = ", ".join("(" + " + ".join(f"{_INV[min(i, j), max(i, j)]} * b{j}" for j in range(3)) + f") AS k{i}" for i in range(3))
_COEF = _MOM + f", kk AS (SELECT y, m, m0, m1, m2, {_K} FROM mo), ks AS (SELECT y, m - k0 * m0 - k1 * m1 - k2 * m2 AS c, k0, k1, k2 FROM kk)"


def _long(spark, d):
    return windows(spark, d).select("window_id", "y", F.explode("x").alias("v"))


@query(_MOM + f" SELECT y, n, {r6('m')} AS m, {', '.join(r6(f'm{i}') + f' AS m{i}' for i in range(3))}, {', '.join(r6(f'f{i}{j} - {0.01 if i == j else 0}') + f' AS f{i}{j}' for i in range(3) for j in range(i, 3))} FROM mo")
def recon_moments(spark, d):
    m = reconstruct.moments(_long(spark, d), "y", ["v"], B.fractional(F.col("v")))
    return m.select("y", "n", q6(F.col("m_v"), "m"), *(q6(F.col(f"m{i}"), f"m{i}") for i in range(3)), *(q6(F.col(f"f_{i}_{j}"), f"f{i}{j}") for i in range(3) for j in range(i, 3)))


@query(_COEF + f" SELECT y, {r6('c')} AS k0, {r6('k0')} AS k1, {r6('k1')} AS k2, {r6('k2')} AS k3 FROM ks")
def recon_coeffs(spark, d):
    m = reconstruct.Reconstructor().fit(_long(spark, d), "y", ["v"])
    rows = [(c, *map(float, (k0[0], *k[:, 0]))) for c, (k0, k, _) in m.models.items()]
    return spark.createDataFrame(rows, "y int, k0 double, k1 double, k2 double, k3 double").select("y", *(q6(F.col(f"k{i}"), f"k{i}") for i in range(4)))


@query(_COEF + f" SELECT window_id, ph.y, ks.y AS class, {r6('ln(avg(pow(v - c - k0 * p0 - k1 * p1 - k2 * p2, 2)) + 1e-8)')} AS log_msed FROM ph, ks GROUP BY window_id, ph.y, ks.y")
def recon_logmsed(spark, d):
    x = _long(spark, d)
    s = reconstruct.Reconstructor().fit(x, "y", ["v"]).transform(x, ["window_id", "y"], ["v"])
    return s.select("window_id", "y", "class", q6(F.col("log_msed"), "log_msed"))


# Two dimensions: the halves of a window, side by side. Products of both bases and 1 as rows, their covariances inverted by sweeps.
_TWO = [[sql.sign_pow(x, 1 / k) for k in (2, 3, 4)] for x in "ab"]
_PRODUCTS = ", ".join(f"{u} * {v}" for i, u in enumerate(["1.0", *_TWO[0]]) for j, v in enumerate(["1.0", *_TWO[1]]) if i or j)
_TENSOR = f"""WITH RECURSIVE {SMP}, ob AS (SELECT l.window_id, l.y, l.n AS pos, l.v AS a, r.v AS b FROM smp l JOIN smp r ON l.window_id = r.window_id AND r.n = l.n + 32),
pw AS (SELECT window_id, y AS class, pos, a, b, unnest([{_PRODUCTS}]) AS p, unnest(range(15)) AS i FROM ob),
fm AS (SELECT s.class, s.i, t.i AS j, covar_pop(s.p, t.p) + CASE WHEN s.i = t.i THEN 0.01 ELSE 0 END AS v FROM pw s JOIN pw t USING (window_id, pos) GROUP BY s.class, s.i, t.i), {sql.sweep('fm', 15)},
bt AS (SELECT class, i, avg(p) AS m, covar_pop(p, a) AS ca, covar_pop(p, b) AS cb, avg(a) AS ma, avg(b) AS mb FROM pw GROUP BY class, i),
kk AS (SELECT inv.class, inv.i, sum(g * ca) AS ka, sum(g * cb) AS kb FROM inv JOIN bt ON inv.class = bt.class AND inv.j = bt.i GROUP BY inv.class, inv.i),
k0 AS (SELECT class, any_value(ma) - sum(ka * m) AS ka0, any_value(mb) - sum(kb * m) AS kb0 FROM kk JOIN bt USING (class, i) GROUP BY class),
er AS (SELECT window_id, pw.class AS y, kk.class, pos, (pow(any_value(a) - any_value(ka0) - sum(ka * p), 2) + pow(any_value(b) - any_value(kb0) - sum(kb * p), 2)) / 2 AS e FROM pw JOIN kk USING (i) JOIN k0 ON k0.class = kk.class GROUP BY ALL)"""


@query(_TENSOR + f" SELECT window_id, y, class, {r6('ln(avg(e) + 1e-8)')} AS log_msed FROM er GROUP BY window_id, y, class")
def recon_multivariate(spark, d):
    x = windows(spark, d).select("window_id", "y", F.explode(F.arrays_zip(F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))).alias("o")).select("window_id", "y", "o.a", "o.b")
    s = reconstruct.Reconstructor().fit(x, "y", ["a", "b"]).transform(x, ["window_id", "y"], ["a", "b"])
    return s.select("window_id", "y", "class", q6(F.col("log_msed"), "log_msed"))


# Eigenvalues of a symmetric 3 x 3 matrix in closed form: q + 2 p cos(phi) and its turn by a third.
_EIG = _MOM + ", e0 AS (SELECT *, (f00 + f11 + f22) / 3 AS q FROM mo), e1 AS (SELECT *, sqrt((pow(f00 - q, 2) + pow(f11 - q, 2) + pow(f22 - q, 2) + 2 * (f01 * f01 + f02 * f02 + f12 * f12)) / 6) AS p FROM e0), e2 AS (SELECT *, acos(greatest(-1, least(1, ((f00 - q) * ((f11 - q) * (f22 - q) - f12 * f12) - f01 * (f01 * (f22 - q) - f12 * f02) + f02 * (f01 * f12 - (f11 - q) * f02)) / pow(p, 3) / 2))) / 3 AS phi FROM e1), e3 AS (SELECT y, (q + 2 * p * cos(phi)) / (q + 2 * p * cos(phi + 2 * pi() / 3)) AS cond FROM e2)"


@query(_EIG + " SELECT y, round(cond, 4) + 0.0 AS cond, cond > 1e6 AS ill FROM e3")
def recon_cond(spark, d):
    rows = [(int(c), float(k), bool(w)) for c, k, w in reconstruct.Reconstructor().fit(_long(spark, d), "y", ["v"]).conditioning()]
    return spark.createDataFrame(rows, "y int, cond double, ill boolean").select("y", (F.round("cond", 4) + F.lit(0.0)).alias("cond"), "ill")


# Discriminants over all 64 samples of a window: standardised values, class means and covariances as rows, inverses by sweeps.
_Z = f"WITH RECURSIVE {SMP}, z AS (SELECT window_id, y, n AS i, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM smp WINDOW w AS (PARTITION BY n)), cm AS (SELECT y AS class, i, avg(z) AS u, count(*) AS n FROM z GROUP BY y, i), dz AS (SELECT window_id, y, z.i, z - u AS d FROM z JOIN cm ON z.y = cm.class AND z.i = cm.i), cv AS (SELECT a.y AS class, a.i, b.i AS j, sum(a.d * b.d) / (count(*) - 1) AS s, count(*) AS n FROM dz a JOIN dz b USING (window_id) GROUP BY ALL)"
_FORM = ", pr AS (SELECT class, max(n) AS n FROM cm GROUP BY class), ds AS (SELECT window_id, class, z.i, z - u AS d FROM z JOIN cm ON z.i = cm.i), hq AS (SELECT window_id, ds.class, inv.i, sum(g * d) AS h FROM ds JOIN inv ON inv.class = ds.class AND inv.j = ds.i GROUP BY ALL), q AS (SELECT window_id, ds.class, sum(h * d) AS q FROM hq JOIN ds USING (window_id, class, i) GROUP BY ALL), ld AS (SELECT class, any_value(logdet) AS logdet FROM inv GROUP BY class), sc AS (SELECT window_id, class, q, -0.5 * q - 0.5 * logdet + ln(n / (SELECT sum(n) FROM pr)) AS score FROM q JOIN ld USING (class) JOIN pr USING (class))"


def _forms(entry: str, source: str = "cv") -> str:
    return f"{_Z}{_POOL if source == 'pl' else ''}, fm AS (SELECT class, i, j, {entry} AS v FROM {source}), {sql.sweep('fm', 64)}{_FORM}"


_POOL = ", po AS (SELECT i, j, sum((n - 1) * s) / (sum(n) - count(*)) AS p FROM cv GROUP BY i, j), pl AS (SELECT class, i, j, 0.5 * s + 0.5 * p AS s, sum(CASE WHEN i = j THEN 0.5 * s + 0.5 * p END) OVER (PARTITION BY class) / 64 AS t FROM cv JOIN po USING (i, j))"
_ONE = "CASE WHEN i = j THEN {} ELSE 0 END"
_RIDGE, _QDA = _forms(f"s + {_ONE.format('0.01')}"), _forms(f"0.95 * s + {_ONE.format('0.05')}")
_DIAG, _RDA = _forms(_ONE.format("s * (n - 1) / n + 1e-9")), _forms(f"0.9 * s + {_ONE.format('0.1 * t')}", "pl")


def _r4(e: str) -> str:
    return f"round({e}, 4) + 0.0"


def _fit(spark, d):
    x = windows(spark, d)
    return x, discriminant.ClassMoments.fit(x, "y", "x")


def _scores(s, digits: int = 4):
    return s.select("window_id", "class", (F.round("score", digits) + F.lit(0.0)).alias("score"))


@query(_RIDGE + f" SELECT window_id, class, {_r4('q')} AS score FROM q")
def mahalanobis_d2(spark, d):
    x, m = _fit(spark, d)
    return _scores(m.mahalanobis(x, ["window_id"]))


@query(_RIDGE + f" SELECT window_id, class, {r6('ln(q + 1e-9)')} AS score FROM q")
def c2_logd2(spark, d):
    x, m = _fit(spark, d)
    return _scores(m.mahalanobis(x, ["window_id"], logs=True), 6)


@query(_RIDGE + " SELECT window_id, arg_min(class, q) AS p FROM q GROUP BY window_id")
def c0_fixed_rule(spark, d):
    x, m = _fit(spark, d)
    return discriminant.nearest(m.mahalanobis(x, ["window_id"]), ["window_id"], smallest=True)


@query(_QDA + f" SELECT window_id, class, {_r4('score')} AS score FROM sc")
def qda(spark, d):
    x, m = _fit(spark, d)
    return _scores(m.qda(x, ["window_id"]))


@query(_DIAG + f" SELECT window_id, class, {_r4('score')} AS score FROM sc")
def diag_qda(spark, d):
    x, m = _fit(spark, d)
    return _scores(m.diagonal(x, ["window_id"]))


@query(_RDA + f" SELECT window_id, class, {_r4('score')} AS score FROM sc")
def rda_score(spark, d):
    x, m = _fit(spark, d)
    return _scores(m.rda(x, ["window_id"], 0.5, 0.1))


@query()
def rda_grid(spark, d):
    x = splits.stratified_inner(windows(spark, d), "y", "window_id")
    return discriminant.rda_grid(x.where("role = 'inner'"), x.where("role = 'val'"), "y", "x")


# --- splits ----------------------------------------------------------------------------------------------------------

_GRP = "g AS (SELECT DISTINCT vec_id // 4 AS grp FROM embeddings), rk AS (SELECT grp, row_number() OVER (ORDER BY md5('2026:' || grp), grp) AS r, count(*) OVER () AS n FROM g)"
_ROLE = f"{_GRP}, ro AS (SELECT grp, CASE WHEN r <= greatest(1, round_even(0.3 * n, 0)) THEN 'test' ELSE 'train' END AS role FROM rk)"


def _grouped(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.expr("vec_id div 4").alias("grp"))


@query(f"WITH {_ROLE} SELECT vec_id, grp, role FROM (SELECT vec_id, vec_id // 4 AS grp FROM embeddings) JOIN ro USING (grp)")
def grouped_split(spark, d):
    return splits.grouped_split(_grouped(spark, d), "grp").select("vec_id", "grp", "role")


@query(f"WITH {_GRP} SELECT vec_id, grp, CAST(least((r - 1) // greatest(n // 5, 1), 4) AS INTEGER) AS fold FROM (SELECT vec_id, vec_id // 4 AS grp FROM embeddings) JOIN rk USING (grp)")
def kfold(spark, d):
    return splits.grouped_kfold(_grouped(spark, d), "grp").select("vec_id", "grp", "fold")


@query("WITH dd AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events), rk AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM dd) SELECT event_id, CASE WHEN r <= greatest(1, n // 2) THEN 'train' ELSE 'test' END AS role FROM events JOIN rk ON day = CAST(CAST(ts AS DATE) AS VARCHAR)")
def day_split(spark, d):
    return splits.day_split(table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")), "day").select("event_id", "role")


@query("WITH g AS (SELECT DISTINCT event_type AS t FROM events), rk AS (SELECT t, row_number() OVER (ORDER BY md5('2026:' || t), t) AS r, count(*) OVER () AS n FROM g) SELECT event_id, event_type, CASE WHEN r <= greatest(1, round_even(0.5 * n, 0)) THEN 'test' ELSE 'train' END AS role FROM events JOIN rk ON t = event_type")
def receiver_split(spark, d):
    return splits.receiver_split(table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "event_type", "role")


_SIDE = "(SELECT CAST({c} AS VARCHAR) AS v, max(CASE WHEN role = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS te FROM sp GROUP BY 1)"


@query(f"WITH {_ROLE}, sp AS (SELECT vec_id, label, vec_id // 4 AS grp, role FROM embeddings JOIN ro ON grp = vec_id // 4) " + " UNION ALL ".join(f"SELECT '{c}' AS axis, CAST(sum(tr) AS BIGINT) AS train_values, CAST(sum(te) AS BIGINT) AS test_values, count(*) FILTER (tr = 1 AND te = 1) AS overlap, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM {_SIDE.format(c=c)} WHERE tr = 1 AND te = 1 ORDER BY v LIMIT 10)), '') AS first FROM {_SIDE.format(c=c)}" for c in ("grp", "label")))
def leakage_audit(spark, d):
    return splits.leakage_audit(splits.grouped_split(_grouped(spark, d), "grp"), ["grp", "label"])


@query("WITH sp AS (SELECT o_custkey % 50 AS series, CAST(o_totalprice AS BIGINT) AS s, CAST(o_totalprice AS BIGINT) + 50 + o_orderkey % 100 AS e, o_orderkey % 3 = 0 AS te FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)) SELECT a.series, count(*) AS overlaps FROM sp a JOIN sp b ON a.series = b.series AND NOT a.te AND b.te AND a.s < b.e AND b.s < a.e GROUP BY a.series")
def raw_overlap(spark, d):
    o = table(spark, d, "orders")
    s = F.floor("o_totalprice").cast("long")
    return splits.raw_overlap(o.select((F.col("o_custkey") % 50).alias("series"), s.alias("start"), (s + 50 + F.col("o_orderkey") % 100).alias("end"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("role")))


@query("SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('2026:' || vec_id), vec_id) <= greatest(1, floor(0.75 * count(*) OVER (PARTITION BY label))) THEN 'inner' ELSE 'val' END AS role FROM embeddings")
def stratified_inner(spark, d):
    return splits.stratified_inner(_grouped(spark, d), "label", "vec_id").select("vec_id", "label", "role")


# --- metrics and tests -----------------------------------------------------------------------------------------------


def _pred(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 4").alias("grp"), F.col("label").cast("long").alias("y"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long").alias("p"))


_PR = "pr AS (SELECT vec_id, vec_id // 4 AS grp, CAST(label AS BIGINT) AS y, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS p FROM embeddings)"
_REP = f"WITH {_PR}, lb AS (SELECT DISTINCT y AS label FROM pr UNION SELECT p FROM pr), rp AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (p = label) AS np, count(*) FILTER (y = label) AS ny FROM lb, pr GROUP BY label)"


@query(f"WITH {_PR} SELECT y, p, count(*) AS n FROM pr GROUP BY y, p")
def confusion(spark, d):
    return metrics.confusion(_pred(spark, d))


@query(_REP + f" SELECT label, {r6('CASE WHEN np > 0 THEN tp / np ELSE 0 END')} AS precision, {r6('CASE WHEN ny > 0 THEN tp / ny ELSE 0 END')} AS recall, {r6('CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END')} AS f1, ny AS support FROM rp")
def class_report(spark, d):
    return metrics.class_report(_pred(spark, d)).select("label", *(q6(F.col(c), c) for c in ("precision", "recall", "f1")), "support")


@query(_REP + f" SELECT {r6('avg(CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END)')} AS macro_f1, {r6('(SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM pr)')} AS accuracy FROM rp")
def macro_f1(spark, d):
    return metrics.macro_f1(_pred(spark, d)).select(q6(F.col("macro_f1"), "macro_f1"), q6(F.col("accuracy"), "accuracy"))


@query(f"WITH {_PR}, c AS (SELECT grp, p, count(*) AS n FROM pr GROUP BY grp, p) SELECT grp, p FROM (SELECT grp, p, row_number() OVER (PARTITION BY grp ORDER BY n DESC, p) AS r FROM c) WHERE r = 1")
def vote_window(spark, d):
    return metrics.vote(_pred(spark, d), "grp")


@query(f"WITH {SMP}, e AS (SELECT window_id, n, exp(v) / sum(exp(v)) OVER (PARTITION BY window_id) AS p FROM smp), m AS (SELECT window_id // 4 AS grp, n AS label, avg(p) AS m FROM e GROUP BY ALL) SELECT grp, label AS p FROM (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY m DESC, label) AS r FROM m) WHERE r = 1")
def prob_window(spark, d):
    e = F.transform("x", lambda v: F.exp(v))
    share = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    x = windows(spark, d).select(F.expr("window_id div 4").alias("grp"), F.posexplode(share).alias("label", "prob"))
    return metrics.mean_probability(x, "grp").select("grp", F.col("p").cast("long").alias("p"))


_SEV = "sv AS (SELECT user_id % 7 AS split, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 1 ELSE 3 END AS severity, avg(value) AS f1 FROM events GROUP BY ALL)"


@query(f"WITH {_SEV}, u AS (SELECT split, max(f1) FILTER (severity = 1) AS clean, avg(f1) FILTER (severity >= 3) AS under FROM sv GROUP BY split) SELECT split, {r6('clean')} AS clean, {r6('under')} AS under, {r6('under / greatest(clean, 1e-9)')} AS retention, under / greatest(clean, 1e-9) >= 0.85 AS kept FROM u")
def retention(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("first"))
    s = e.crossJoin(F.broadcast(first)).groupBy((F.col("user_id") % 7).alias("split"), F.when(F.col("event_type") == F.col("first"), 1).otherwise(3).alias("severity")).agg(F.avg("value").alias("f1"))
    return metrics.under_fir(s, ["split"]).select("split", *(q6(F.col(c), c) for c in ("clean", "under", "retention")), "kept")


@query("WITH s AS (SELECT user_id AS split, event_type AS choice, avg(value) AS score FROM events GROUP BY ALL) SELECT split, choice, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY score DESC, choice) AS r FROM s) WHERE r = 1")
def best_choice(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("split"), F.col("event_type").alias("choice")).agg(F.avg("value").alias("score"))
    return metrics.best_per_split(s, "split", "choice", "choice", "score").withColumn("score", F.round("score", 6))


_RANK = f"WITH {SMP}, rk AS (SELECT n AS feature, y, v, rank() OVER (PARTITION BY n ORDER BY v) + (count(*) OVER (PARTITION BY n, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY n, v) AS t FROM smp)"
_H = _RANK + ", hh AS (SELECT feature, sum(rs * rs / ni) AS q, sum(ni) AS n, count(*) AS k FROM (SELECT feature, y, sum(r) AS rs, count(*) AS ni FROM rk GROUP BY feature, y) GROUP BY feature), tt AS (SELECT feature, sum(t * t * t - t) AS t FROM (SELECT DISTINCT feature, v, CAST(t AS DOUBLE) AS t FROM rk) GROUP BY feature), h2 AS (SELECT feature, n, k, (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - t / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM hh JOIN tt USING (feature))"


def _features_long(spark, d):
    return windows(spark, d).select("y", F.posexplode("x").alias("feature", "v")).withColumn("feature", F.col("feature").cast("long"))


@query(_H + f" SELECT feature, {r6('h')} AS h, {r6('(h - k + 1) / (n - k)')} AS eta2 FROM h2")
def kruskal_h(spark, d):
    return stats.kruskal(_features_long(spark, d), "y", "v", ["feature"]).select("feature", q6(F.col("h"), "h"), q6(F.col("eta2"), "eta2"))


_AN = f"WITH {SMP}, c AS (SELECT n AS feature, y, count(*) AS ni, avg(v) AS m, var_pop(v) AS vr FROM smp GROUP BY n, y), gm AS (SELECT feature, sum(ni * m) / sum(ni) AS g FROM c GROUP BY feature), s AS (SELECT feature, sum(ni * pow(m - g, 2)) AS ssb, sum(ni * vr) AS ssw, sum(ni) AS n, count(*) AS k FROM c JOIN gm USING (feature) GROUP BY feature), f AS (SELECT feature, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta2 FROM s)"


def _anova(spark, d):
    return stats.anova(_features_long(spark, d), "y", "v", ["feature"])


@query(_AN + f" SELECT feature, {r6('f')} AS f, {r6('eta2')} AS eta2 FROM f")
def anova_f(spark, d):
    return _anova(spark, d).select("feature", q6(F.col("f"), "f"), q6(F.col("eta2"), "eta2"))


@query(_AN + f" SELECT feature, {r6('f')} AS f FROM f ORDER BY f.f DESC, feature LIMIT 10")
def anova_topk(spark, d):
    return _anova(spark, d).orderBy(F.desc("f"), "feature").limit(10).select("feature", q6(F.col("f"), "f"))


@query(f"WITH {SMP}, dd AS (SELECT a.y, a.v - b.v AS d FROM smp a JOIN smp b ON a.window_id = b.window_id AND a.n = 0 AND b.n = 1 WHERE a.v <> b.v), r AS (SELECT y, d, rank() OVER (PARTITION BY y ORDER BY abs(d)) + (count(*) OVER (PARTITION BY y, abs(d)) - 1) / 2.0 AS r FROM dd) SELECT y, {r6('sum(CASE WHEN d > 0 THEN r ELSE 0 END)')} AS w_plus, count(*) AS n FROM r GROUP BY y")
def wilcoxon_w(spark, d):
    x = windows(spark, d).select("y", (F.col("x")[0] - F.col("x")[1]).alias("d"))
    return stats.wilcoxon_w(x, "d", ["y"]).select("y", q6(F.col("w_plus"), "w_plus"), "n")


@query(f"WITH {SMP}, s AS (SELECT y, avg(v) AS v FROM smp GROUP BY y), v AS (SELECT v, row_number() OVER (ORDER BY y) - 1 AS i, count(*) OVER () AS n FROM s), dr AS (SELECT r, CAST(concat('0x', substr(md5('2125:' || r || ':' || j), 1, 8)) AS BIGINT) % (SELECT count(*) FROM s) AS i FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range((SELECT count(*) FROM s))) AS j)), m AS (SELECT r, avg(v) AS mean FROM dr JOIN v USING (i) GROUP BY r) SELECT {r6('quantile_cont(mean, 0.025)')} AS lo, {r6('quantile_cont(mean, 0.975)')} AS hi, {r6('avg(mean)')} AS mean FROM m")
def bootstrap_ci(spark, d):
    s = _long(spark, d).groupBy("y").agg(F.avg("v").alias("v"))
    s = ranking.by_value(s, [], ["y"]).select("v", F.col("before").cast("long").alias("i"), F.lit(0).alias("all"))
    m = stats.bootstrap_means(s, "v", 200, 2125, ["all"])
    return m.agg(q6(F.percentile("mean", 0.025), "lo"), q6(F.percentile("mean", 0.975), "hi"), q6(F.avg("mean"), "mean"))


_AB = "pr2 AS (SELECT vec_id, CAST(label AS BIGINT) AS y, CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS a, CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 2) % 10 ELSE label END AS BIGINT) AS b, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)"
_F1 = "ct AS (SELECT r, side, y, p, count(*) AS n FROM {source} GROUP BY ALL), lb AS (SELECT r, side, y AS label, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp, 0 AS np, sum(n) AS ny FROM ct GROUP BY ALL UNION ALL SELECT r, side, p, 0, sum(n), 0 FROM ct GROUP BY ALL), f1 AS (SELECT r, side, avg(f) AS f FROM (SELECT r, side, label, 2 * sum(tp) / (sum(np) + sum(ny)) AS f FROM lb GROUP BY ALL) GROUP BY ALL), de AS (SELECT r, sum(CASE WHEN side = 'b' THEN f ELSE -f END) AS d FROM f1 GROUP BY r)"


@query(f"WITH {_AB}, dr AS (SELECT r, CAST(concat('0x', substr(md5('42:' || r || ':' || i), 1, 8)) AS BIGINT) % n AS i FROM pr2, (SELECT unnest(range(100)) AS r)), bo AS (SELECT r, y, a, b FROM dr JOIN pr2 USING (i) UNION ALL SELECT -1, y, a, b FROM pr2), sd AS (SELECT r, 'a' AS side, y, a AS p FROM bo UNION ALL SELECT r, 'b', y, b FROM bo), {_F1.format(source='sd')} SELECT {r6('max(CASE WHEN r < 0 THEN d END)')} AS delta, {r6('2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END) FILTER (r >= 0), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0 END) FILTER (r >= 0))')} AS p_value, {r6('quantile_cont(d, 0.025) FILTER (r >= 0)')} AS ci_low, {r6('quantile_cont(d, 0.975) FILTER (r >= 0)')} AS ci_high FROM de")
def paired_bootstrap(spark, d):
    wrong = lambda k, by: F.when(F.col("vec_id") % k == 0, (F.col("label") + by) % 10).otherwise(F.col("label")).cast("long")
    pred = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("y"), wrong(3, 1).alias("a"), wrong(5, 2).alias("b"))
    r = stats.paired_bootstrap(stats.paired_cells(pred), stats.hashed_resamples(pred, "vec_id", 100, 42))
    return r.select(*(q6(F.col(c), c) for c in ("delta", "p_value", "ci_low", "ci_high")))


def _mixed_sql(x: str) -> str:
    """A 32-bit finaliser over whole numbers below 2^32."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        x = f"CAST(CAST(xor({x}, ({x}) // {1 << shift}) AS HUGEINT) * {factor} % 4294967296 AS BIGINT)"
    return x


_POISSON = " + ".join(f"CASE WHEN u / 4294967296.0 >= {float(p)!r} THEN 1 ELSE 0 END" for p in stats.POISSON)
_WEIGHTS = f"m0 AS (SELECT vec_id, y, a, b, xor(vec_id, 42) AS h FROM pr2), m1 AS (SELECT *, {_mixed_sql('h')} AS m FROM m0), m2 AS (SELECT r, y, a, b, xor(m, (r + 1) * 2654435769 % 4294967296) AS h FROM m1, (SELECT unnest(range(100)) AS r)), m3 AS (SELECT r, y, a, b, {_mixed_sql('h')} AS u FROM m2), m4 AS (SELECT r, y, a, b, {_POISSON} AS k FROM m3), bo AS (SELECT r, y, a, b, sum(k) AS k FROM m4 GROUP BY ALL HAVING sum(k) > 0 UNION ALL SELECT -1, y, a, b, count(*) FROM pr2 GROUP BY ALL), sd AS (SELECT r, 'a' AS side, y, a AS p, k FROM bo UNION ALL SELECT r, 'b', y, b, k FROM bo)"


@query(f"WITH {_AB}, {_WEIGHTS}, {_F1.format(source='sd').replace('count(*) AS n', 'sum(k) AS n')} SELECT {r6('max(CASE WHEN r < 0 THEN d END)')} AS delta, {r6('2 * least(avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END) FILTER (r >= 0), avg(CASE WHEN d >= 0 THEN 1.0 ELSE 0 END) FILTER (r >= 0))')} AS p_value, {r6('quantile_cont(d, 0.025) FILTER (r >= 0)')} AS ci_low, {r6('quantile_cont(d, 0.975) FILTER (r >= 0)')} AS ci_high FROM de")
def weighted_bootstrap(spark, d):
    """The paired bootstrap by weights: one pass over the rows for all resamples."""
    wrong = lambda k, by: F.when(F.col("vec_id") % k == 0, (F.col("label") + by) % 10).otherwise(F.col("label")).cast("long")
    pred = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("y"), wrong(3, 1).alias("a"), wrong(5, 2).alias("b"))
    r = stats.paired_bootstrap(stats.paired_cells(pred), stats.weighted_resamples(pred, "vec_id", 100, 42))
    return r.select(*(q6(F.col(c), c) for c in ("delta", "p_value", "ci_low", "ci_high")))


# --- learned heads, sources: rows only -------------------------------------------------------------------------------


def _described(spark, d):
    """window_id, y, grp, s: the eleven shape descriptors of each window."""
    return spectra.describe(_grp(spark, d), v="x")


def _sides(spark, d):
    s = splits.grouped_split(_described(spark, d), "grp")
    return s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")


def _head(f, spark, d):
    a, b = (x.select("window_id", "y", *columns.named("s", SHAPE)) for x in _sides(spark, d))
    a, b = heads.pop_scaled(a, SHAPE), heads.pop_scaled(b, SHAPE, a)
    return f(a, b, "y", SHAPE).select("window_id", "y", "p")


for _n, _f in (("lr_head", heads.logistic), ("rff_svm", heads.fourier_svm), ("gmm_head", heads.gaussian_mixture), ("pair_machines", heads.pair_machines)):
    query(None, _n)(partial(_head, _f))


@query()
def gam_head(spark, d):
    return baseline_pack(spark, d).where("method = 'Ghosh_GAM'").drop("method")


@query()
def baseline_pack(spark, d):
    a, b = _sides(spark, d)
    return pipelines.baseline_pack(a, b, "window_id")[0].select("method", "window_id", "y", "p")


@query()
def pca20(spark, d):
    from pyspark.ml.functions import vector_to_array

    xs = [f"x{i}" for i in range(64)]
    return heads.principal(windows(spark, d).select("window_id", "y", *columns.named("x", xs)), xs, 20).select("window_id", "y", vector_to_array("pc").alias("pc"))


@query()
def synthetic_dataset(spark, d):
    s = synthetic.resynthesised(windows(spark, d), "window_id", "y", "x", 12000.0, 20.0, 50.0)
    return s.select("signal_id", "y", F.size("re").alias("n"), F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, e: a + e).alias("energy"))


_CFO = f"WITH {SMP}, ri AS (SELECT a.window_id, a.n AS k, a.v AS re, b.v AS im, 2 * pi() * 1500.0 / 12000.0 * a.n AS t FROM smp a JOIN smp b ON a.window_id = b.window_id AND b.n = a.n + 32 WHERE a.n < 32)"


@query(_CFO + f" SELECT window_id, k, {r6('re * cos(t) - im * sin(t)')} AS re, {r6('re * sin(t) + im * cos(t)')} AS im FROM ri")
def carrier_offset(spark, d):
    x = windows(spark, d).select("window_id", F.slice("x", 1, 32).alias("re"), F.slice("x", 33, 32).alias("im"))
    re, im = synthetic.rotated("re", "im", 12000.0, 1500.0)
    both = x.select("window_id", F.posexplode(F.arrays_zip(re.alias("re"), im.alias("im"))).alias("k", "z"))
    return both.select("window_id", F.col("k").cast("long").alias("k"), q6(F.col("z.re"), "re"), q6(F.col("z.im"), "im"))


@query(f"SELECT p_partkey, class_label, class_id FROM part JOIN (VALUES {', '.join(f'({n}, {chr(39)}{k}{chr(39)}, {i})' for i, (k, f) in enumerate(classes.FILES.items()) for n in f)}) AS t(file_no, class_label, class_id) ON p_partkey % 240 = file_no")
def class_dimension(spark, d):
    return classes.labelled(table(spark, d, "part").select("p_partkey"), (F.col("p_partkey") % 240).cast("int")).select("p_partkey", "class_label", "class_id")


# --- experiments -----------------------------------------------------------------------------------------------------


def _grp(spark, d):
    return windows(spark, d).withColumn("grp", F.expr("window_id div 4"))


_U = "((CAST(concat('0x', substr(md5(concat_ws(':', {parts})), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)"
_ROLES = "g AS (SELECT DISTINCT vec_id // 4 AS grp FROM embeddings), rl AS (SELECT split, grp, CASE WHEN row_number() OVER (PARTITION BY split ORDER BY md5((split + 2026) || ':' || grp), grp) <= greatest(1, round_even(0.3 * count(*) OVER (PARTITION BY split), 0)) THEN 'test' ELSE 'train' END AS role FROM g, (SELECT CAST(unnest(range(3)) AS INTEGER) AS split))"


@query(f"WITH {_ROLES} SELECT split, grp, role FROM rl")
def repeated_splits(spark, d):
    return experiments.split_roles(_grp(spark, d), "grp", 3)


_TAP = "CASE WHEN k = 0 THEN 1.0 ELSE exp(-0.7 * k) * sqrt(-2 * ln({})) * cos(2 * pi() * {}) END".format(*(_U.format(parts=f"2033, split, severity, window_id, k, {i}") for i in (0, 1)))
_CHANNELS = f"{_ROLES}, ky AS (SELECT split, severity, window_id, k FROM win JOIN rl ON grp = window_id // 4 AND role = 'test', (SELECT unnest([1, 2, 3, 5]) AS severity), (SELECT unnest(range(5)) AS k) WHERE k < severity), tp AS (SELECT *, {_TAP} AS t FROM ky), ch AS (SELECT split, severity, window_id, k, t / sqrt(sum(t * t) OVER (PARTITION BY split, severity, window_id)) AS h FROM tp)"


@query(f"WITH {SMP}, {_CHANNELS}, o AS (SELECT split, severity, s.window_id, s.n, sum(coalesce(l.v, 0) * h) AS v FROM smp s JOIN ch USING (window_id) LEFT JOIN smp l ON l.window_id = s.window_id AND l.n = s.n - ch.k GROUP BY ALL) SELECT split, severity, window_id, {r6('sum(v * v)')} AS energy, {r6('max(CASE WHEN n = 63 THEN v END)')} AS last_value FROM o GROUP BY ALL")
def split_channels(spark, d):
    w = _grp(spark, d)
    x = experiments.distorted(w, experiments.split_roles(w, "grp", 3), experiments.Design(splits=3, severities=(1, 2, 3, 5)))
    return x.select("split", "severity", "window_id", q6(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e), "energy"), q6(F.col("x")[63], "last_value"))


@query(f"SELECT p_partkey AS rec, block, draw, block * per + CAST(floor({_U.format(parts='2026, p_partkey, block, draw')} * (per - 63)) AS BIGINT) AS start FROM (SELECT p_partkey, p_size * 100 // 5 AS per FROM part), (SELECT unnest(range(5)) AS block), (SELECT unnest(range(2)) AS draw) WHERE per > 64")
def random_starts(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("rec"), (F.col("p_size") * 100).alias("n_samples"))
    return experiments.random_starts(r, "rec", "n_samples", 64, 10, 5).select("rec", *(F.col(c).cast("long").alias(c) for c in ("block", "draw", "start")))


@query(BASE + ", kf AS (SELECT window_id, y, count(*) AS n FROM (SELECT window_id, y, frame_id FROM prf GROUP BY ALL HAVING stddev_pop(v) >= 0.8) GROUP BY ALL), rs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY y ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM kf) SELECT y, window_id, n FROM rs WHERE before < 60")
def frame_cap(spark, d):
    kept = spectra.energy_mask(spectra.log_profiles(windows(spark, d), 16, 8)).groupBy("window_id", "y").agg(F.count(F.lit(1)).alias("n"))
    return experiments.cap_frames(kept, "y", ["window_id"], "n", 60).select("y", "window_id", "n")


#: The whole design: 15 splits, six severities, the logistic head over log distances. Windows of the tables have 64 samples,
#: so that frames have 16 and quefrencies end at 7.
_DESIGN = experiments.Design()
_LIFTERS = (1, 2, 3, 4, 6)
_SPECS = {"lb2": ("lb", 2, None), "lb3": ("lb", 3, None), "lb4": ("lb", 4, None), "bp_2_6": ("bp", 2, 6), "bp_3_7": ("bp", 3, 7), "tukey_2_8": ("bp_tukey", 2, 8), "tukey_1_7": ("bp_tukey", 1, 7), "juang_2_8": ("juang", 2, 8), "juang_1_8": ("juang", 1, 8)}


@query()
def compat_channels(spark, d):
    """Energy and last sample of each test window under the splits and channels of published runs."""
    design = replace(_DESIGN, rng="compat")
    x = experiments.distorted(_grp(spark, d), experiments.design_roles(_grp(spark, d), design), design)
    return x.select("split", "severity", "window_id", q6(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e), "energy"), q6(F.col("x")[63], "last_value"))


@query()
def experiment_scores(spark, d):
    return experiments.run(_grp(spark, d), experiments.branches(_LIFTERS, 16, 8), _DESIGN)


@query()
def experiment_controls(spark, d):
    return experiments.summary(experiments.run(_grp(spark, d), experiments.controls(n_fft=16, hop=8, n_mels=6, keep=5), _DESIGN))


@query()
def experiment_mfcc_heads(spark, d):
    """Mel coefficients under each head: log distances, kernel machines of pairs, mixtures. All splits of a head are one fit."""
    mfcc = {"mfcc": experiments.controls(n_fft=16, hop=8, n_mels=6, keep=5)["mfcc"]}
    each = [experiments.summary(experiments.run(_grp(spark, d), mfcc, replace(_DESIGN, head=h))).withColumn("head", F.lit(h)) for h in ("logistic", "svm", "gmm")]
    return reduce(DataFrame.unionByName, each)


@query()
def experiment_lifters(spark, d):
    return experiments.candidates(experiments.summary(experiments.run(_grp(spark, d), experiments.lifter_families(_SPECS, 16, 8), _DESIGN)), "lb3")


@query()
def experiment_ablation(spark, d):
    return experiments.summary(subsets.ablation(_grp(spark, d), experiments.branches((3,), 16, 8)["cepstral_3"], SHAPE, _DESIGN))


@query()
def forward_select(spark, d):
    """The order in which descriptors are chosen on each of the design's splits, and the score under distortion that each step
    reaches."""
    return subsets.forward(_grp(spark, d), experiments.branches((3,), 16, 8)["cepstral_3"], SHAPE, _DESIGN)


@query()
def experiment_gap(spark, d):
    return experiments.gap(experiments.run(_grp(spark, d), experiments.branches((3,), 16, 8), _DESIGN), "spectral", "cepstral_3")


@query()
def experiment_levels(spark, d):
    return experiments.run_levels(_grp(spark, d), experiments.masked(experiments.branches((3,), 16, 8), 16, 8), _DESIGN)


@query()
def experiment_sensitivity(spark, d):
    configs = {"base": {"n_fft": 16, "hop": 8}, "hamming": {"n_fft": 16, "hop": 8, "window": "hamming"}, "dense": {"n_fft": 16, "hop": 4}, "short": {"n_fft": 12, "hop": 6}, "long": {"n_fft": 32, "hop": 16}, "eps6": {"n_fft": 16, "hop": 8, "eps": 1e-6}, "eps10": {"n_fft": 16, "hop": 8, "eps": 1e-10}}
    return experiments.summary(experiments.run(_grp(spark, d), experiments.sensitivity(configs), _DESIGN))


@query()
def experiment_conditioning(spark, d):
    return experiments.conditioning(_grp(spark, d), experiments.branches((3,), 16, 8), _DESIGN, (1e-3, 1e-2, 1e-1))


# Scores of representations by split and severity, as tables behind figures are made from: mean values by event type.
_SCORES = "es AS (SELECT CAST(user_id % 7 AS INTEGER) AS split, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS rep, list_extract([1, 3, 5], CAST(event_id // 2 % 3 + 1 AS INTEGER)) AS severity, avg(value) / 500 AS f1 FROM events GROUP BY ALL)"
_UNDER = f"WITH {_SCORES}, un AS (SELECT split, rep, max(f1) FILTER (severity = 1) AS clean, avg(f1) FILTER (severity >= 3) AS under FROM es GROUP BY split, rep)"


def _score_table(spark, d):
    e = table(spark, d, "events")
    severity = F.array(F.lit(1), F.lit(3), F.lit(5))[(F.expr("event_id div 2") % 3).cast("int")]
    return e.groupBy((F.col("user_id") % 7).cast("int").alias("split"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("rep"), severity.alias("severity")).agg((F.avg("value") / 500).alias("f1"))


@query(f"WITH {_SCORES} SELECT rep, severity, count(*) AS splits, {r6('avg(f1)')} AS f1, {r6('stddev_pop(f1)')} AS f1_std FROM es GROUP BY rep, severity")
def figure_curve(spark, d):
    return experiments.curve(_score_table(spark, d)).select("rep", "severity", "splits", q6(F.col("f1"), "f1"), q6(F.col("f1_std"), "f1_std"))


@query(_UNDER + f" SELECT split, {r6('sum(CASE WHEN rep = ' + chr(39) + 'b' + chr(39) + ' THEN under ELSE -under END)')} AS gap FROM un GROUP BY split")
def figure_gaps(spark, d):
    return experiments.gaps(_score_table(spark, d), "a", "b").select("split", q6(F.col("gap"), "gap"))


@query(_UNDER + ", su AS (SELECT rep, count(*) AS splits, avg(clean) AS clean, stddev_pop(clean) AS clean_std, min(clean) AS clean_min, max(clean) AS clean_max, avg(under) AS under, stddev_pop(under) AS under_std, min(under) AS under_min, max(under) AS under_max FROM un GROUP BY rep) SELECT rep, splits, " + ", ".join(f"{r6(c)} AS {c}" for c in ("clean", "clean_std", "clean_min", "clean_max", "under", "under_std", "under_min", "under_max")) + ", under > (SELECT under FROM su WHERE rep = 'a') AS beats FROM su")
def figure_tradeoff(spark, d):
    t = experiments.tradeoff(_score_table(spark, d), "a")
    return t.select("rep", "splits", *(q6(F.col(c), c) for c in ("clean", "clean_std", "clean_min", "clean_max", "under", "under_std", "under_min", "under_max")), "beats")


@query(_UNDER + f" SELECT CASE WHEN rep = 'b' THEN 0 ELSE 1 END AS place, CASE WHEN rep = 'b' THEN 'challenger' ELSE 'incumbent' END AS label, {r6('avg(clean)')} AS clean, {r6('avg(under)')} AS under FROM un GROUP BY rep")
def figure_methods(spark, d):
    return experiments.methods(_score_table(spark, d), {"b": "challenger", "a": "incumbent"}).select("place", "label", q6(F.col("clean"), "clean"), q6(F.col("under"), "under"))


@query(f"""WITH es AS (SELECT event_type AS domain, CAST(user_id % 7 AS INTEGER) AS split, event_id % 2 = 0 AS a, avg(value) / 500 AS f1 FROM events WHERE event_id // 2 % 3 > 0 GROUP BY event_type, user_id % 7, event_id % 2, event_id // 2 % 3),
gp AS (SELECT domain, split, sum(CASE WHEN a THEN -u ELSE u END) AS gap FROM (SELECT domain, split, a, avg(f1) AS u FROM es GROUP BY ALL) GROUP BY domain, split), nb AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY split) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n FROM gp),
dr AS (SELECT domain, r, CAST(concat('0x', substr(md5('2125:' || r || ':' || i), 1, 8)) AS BIGINT) % n AS i FROM nb, (SELECT unnest(range(200)) AS r)), mn AS (SELECT domain, r, avg(gap) AS m FROM dr JOIN nb USING (domain, i) GROUP BY ALL), ci AS (SELECT domain, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY domain)
SELECT domain, count(*) AS splits, count(*) FILTER (gap > 0) AS wins, {r6('avg(gap)')} AS gap, {r6('any_value(lo)')} AS lo, {r6('any_value(hi)')} AS hi FROM gp JOIN ci USING (domain) GROUP BY domain""")
def figure_domains(spark, d):
    e = table(spark, d, "events")
    severity = F.array(F.lit(1), F.lit(3), F.lit(5))[(F.expr("event_id div 2") % 3).cast("int")]
    s = e.groupBy(F.col("event_type").alias("domain"), (F.col("user_id") % 7).cast("int").alias("split"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("rep"), severity.alias("severity")).agg((F.avg("value") / 500).alias("f1"))
    return experiments.domains(s, "a", "b", repeats=200).select("domain", "splits", "wins", *(q6(F.col(c), c) for c in ("gap", "lo", "hi")))


# Result documents: one an event, with its own properties inside.
def _events_json(spark, d):
    text = F.concat(F.lit('{"config": {"user": '), "user_id", F.lit(', "kind": "'), "event_type", F.lit('"}, "parts": ['), "props", F.lit(', {"id": '), "event_id", F.lit("}]}"))
    return table(spark, d, "events").select("event_id", artifacts.leaves(text).alias("l"))


_LEAF = "SELECT event_id, '{}' AS path, {} AS value FROM events"
_LEAVES = " UNION ALL ".join(_LEAF.format(p, e) for p, e in (("config.user", "CAST(user_id AS VARCHAR)"), ("config.kind", "concat('\"', event_type, '\"')"), ("parts[0].k", "CAST(json_extract(props, '$.k') AS VARCHAR)"), ("parts[1].id", "CAST(event_id AS VARCHAR)")))


@query(_LEAVES)
def json_leaves(spark, d):
    return _events_json(spark, d).select("event_id", F.inline("l"))


@query("""SELECT event_id, concat('{"config": {"kind": "', event_type, '", "user": ', user_id, '}, "parts": [{"k": ', json_extract(props, '$.k'), '}, {"id": ', event_id, '}]}') AS text FROM events""")
def json_documents(spark, d):
    return artifacts.documents(_events_json(spark, d).select("event_id", F.inline("l")), "event_id")


@query(_UNDER + f", rt AS (SELECT split, max(CASE WHEN rep = 'a' THEN under / greatest(clean, 1e-9) END) AS a, max(CASE WHEN rep = 'b' THEN under / greatest(clean, 1e-9) END) AS b FROM un GROUP BY split) SELECT split, {r6('a')} AS incumbent, {r6('b')} AS challenger, b >= 0.85 AND b - a >= 0.1 AS passed FROM rt")
def retention_advantage(spark, d):
    return metrics.advantage(_score_table(spark, d), "a", "b").select("split", q6(F.col("incumbent"), "incumbent"), q6(F.col("challenger"), "challenger"), "passed")


def _complex_sql(keys: str, draw: str) -> str:
    """ct: taps (k, hr, hi) of ky(keys, k). Echo k is exp(-0.7 k) times a normal real and a normal imaginary part, by the polar
    form of two normals; tap 0 is 1; then all are scaled to unit energy."""
    u = [_U.format(parts=f"{draw}, k, {i}") for i in (0, 1)]
    part = lambda f, first: f"CASE WHEN k = 0 THEN {first} ELSE exp(-0.7 * k) * sqrt(-2 * ln({u[0]})) * {f}(2 * pi() * {u[1]}) END"
    return f"cx AS (SELECT {keys}, k, {part('cos', '1.0')} AS a, {part('sin', '0.0')} AS b FROM ky), ct AS (SELECT {keys}, k, a / sqrt(sum(a * a + b * b) OVER w) AS hr, b / sqrt(sum(a * a + b * b) OVER w) AS hi FROM cx WINDOW w AS (PARTITION BY {keys}))"


@query(f"WITH {_ROLES}, ky AS (SELECT split, grp, k FROM rl, (SELECT unnest(range(5)) AS k) WHERE role = 'test'), {_complex_sql('split, grp', '7, split, grp')} SELECT split, grp, k, {r6('hr')} AS re, {r6('hi')} AS im FROM ct")
def complex_channels(spark, d):
    r = experiments.split_roles(_grp(spark, d), "grp", 3).where("role = 'test'")
    h = experiments.complex_taps(F.lit(5), F.lit(7), F.col("split"), F.col("grp"))
    x = r.select("split", "grp", F.posexplode(h).alias("k", "h"))
    return x.select("split", "grp", F.col("k").cast("long").alias("k"), q6(F.col("h.re"), "re"), q6(F.col("h.im"), "im"))


def _rf(spark, d):
    """Complex windows of 32 samples: the first half of each vector is the real part, the second the imaginary one."""
    w = _grp(spark, d)
    return w.select("window_id", "y", "grp", F.slice("x", 1, 32).alias("re"), F.slice("x", 33, 32).alias("im"))


_RF = f"""WITH {SMP}, {_ROLES}, zs AS (SELECT a.window_id, a.n, a.v AS xr, b.v AS xi FROM smp a JOIN smp b ON a.window_id = b.window_id AND b.n = a.n + 32 WHERE a.n < 32),
ky AS (SELECT split, severity, window_id, k FROM win JOIN rl ON grp = window_id // 4 AND role = 'test', (SELECT unnest([1, 2, 3, 5]) AS severity), (SELECT unnest(range(5)) AS k) WHERE k < severity), {_complex_sql('split, severity, window_id', '2033, split, severity, window_id')},
oz AS (SELECT split, severity, window_id, s.n + k AS n, sum(hr * xr - hi * xi) AS re, sum(hr * xi + hi * xr) AS im FROM zs s JOIN ct USING (window_id) WHERE s.n + k < 32 GROUP BY ALL)"""


@query(_RF + f" SELECT split, severity, window_id, {r6('sum(re * re + im * im)')} AS energy, {r6('max(CASE WHEN n = 31 THEN re END)')} AS last_re, {r6('max(CASE WHEN n = 31 THEN im END)')} AS last_im FROM oz GROUP BY ALL")
def rf_channels(spark, d):
    """Complex test windows through complex channels of their own."""
    w = _rf(spark, d)
    x = experiments.distorted_complex(w, experiments.split_roles(w, "grp", 3), experiments.Design(splits=3, severities=(1, 2, 3, 5)))
    energy = F.aggregate(F.zip_with("re", "im", lambda a, b: a * a + b * b), F.lit(0.0), lambda a, e: a + e)
    return x.select("split", "severity", "window_id", q6(energy, "energy"), q6(F.col("re")[31], "last_re"), q6(F.col("im")[31], "last_im"))


_RF_PROFILE = _RF + """, fz AS (SELECT split, severity, window_id, f AS frame_id, n - 8 * f AS k, re * (0.5 - 0.5 * cos(2 * pi() * (n - 8 * f) / 16)) AS a, im * (0.5 - 0.5 * cos(2 * pi() * (n - 8 * f) / 16)) AS b FROM oz JOIN (SELECT unnest(range(3)) AS f) ON n >= 8 * f AND n < 8 * f + 16),
sz AS (SELECT split, severity, window_id, frame_id, q, pow(sum(a * cos(2 * pi() * k * q / 16) + b * sin(2 * pi() * k * q / 16)), 2) + pow(sum(b * cos(2 * pi() * k * q / 16) - a * sin(2 * pi() * k * q / 16)), 2) AS p FROM fz, (SELECT unnest(range(16)) AS q) GROUP BY ALL),
oc AS (SELECT split, severity, window_id, frame_id FROM sz WHERE q > 0 GROUP BY ALL HAVING stddev_pop(ln(p / 64 + 1e-12)) >= 0.8)"""


@query(_RF_PROFILE + f", cz AS (SELECT split, severity, window_id, frame_id, r, sum(ln(sqrt(p) / 8 + 1e-8) * cos(2 * pi() * q * r / 16)) / 16 AS c FROM sz JOIN oc USING (split, severity, window_id, frame_id), (SELECT unnest(range(3, 8)) AS r) GROUP BY ALL) SELECT split, severity, window_id, frame_id, " + ", ".join(f"{r6(f'max(CASE WHEN r = {r} THEN c END)')} AS c{r}" for r in range(3, 8)) + " FROM cz GROUP BY ALL")
def rf_occupied_cepstra(spark, d):
    """Cepstra of the frames that the distorted complex signal occupies."""
    w = _rf(spark, d)
    x = experiments.distorted_complex(w, experiments.split_roles(w, "grp", 3), experiments.Design(splits=3, severities=(1, 2, 3, 5)))
    return spread(spectra.occupied_frames(x, "cepstral", 16, 8), [f"c{r}" for r in range(3, 8)], ["split", "severity", "window_id", F.col("frame_id").cast("long").alias("frame_id")], "v")


@query()
def experiment_rf(spark, d):
    """The second domain: complex windows, complex channels, occupied frames; the whole design and its verdict."""
    return experiments.gap(experiments.run(_rf(spark, d), experiments.occupied(3, 16, 8), _DESIGN, experiments.distorted_complex), "spectral", "cepstral_3")


# --- whole classifications -------------------------------------------------------------------------------------------


def _split_windows(spark, d):
    s = splits.grouped_split(_grp(spark, d), "grp")
    return s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")


def _basis_sql(name: str, v: str = "v") -> list[str]:
    return [e.replace(X, v) for e in _PART[name]]


def _nearest_sql(name: str) -> str:
    """One row: accuracy and macro-F1 of the nearest reconstruction in one basis, fitted on training windows."""
    inv, det = sql.adjugate("f")
    k = ", ".join("(" + " + ".join(f"{inv[min(i, j), max(i, j)]} * b{j}" for j in range(3)) + f") AS k{i}" for i in range(3))
    return f"""(WITH ph AS (SELECT window_id, y, role, v, {', '.join(f'{e} AS p{i}' for i, e in enumerate(_basis_sql(name)))} FROM st),
mo AS (SELECT y, avg(v) AS m, {', '.join(f'avg(p{i}) AS m{i}' for i in range(3))}, {', '.join(f'covar_pop(p{i}, p{j}) + {0.01 if i == j else 0} AS f{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'covar_pop(p{i}, v) AS b{i}' for i in range(3))} FROM ph WHERE role = 'train' GROUP BY y),
kk AS (SELECT y, m, m0, m1, m2, {k} FROM mo), ms AS (SELECT window_id, ph.y, kk.y AS class, avg(pow(v - (m - k0 * m0 - k1 * m1 - k2 * m2) - k0 * p0 - k1 * p1 - k2 * p2, 2)) AS e FROM ph, kk WHERE role = 'test' GROUP BY ALL),
pr AS (SELECT window_id, any_value(y) AS y, arg_min(class, e) AS p FROM ms GROUP BY window_id),
lb AS (SELECT y AS label, count(*) FILTER (y = p) AS tp, 0 AS np, count(*) AS ny FROM pr GROUP BY y UNION ALL SELECT p, 0, count(*), 0 FROM pr GROUP BY p)
SELECT '{name}' AS basis, {r6("(SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM pr)")} AS accuracy, {r6('avg(f)')} AS macro_f1 FROM (SELECT label, 2 * sum(tp) / (sum(np) + sum(ny)) AS f FROM lb GROUP BY label))"""


_STD = f"WITH {SMP}, {_ROLE}, wr AS (SELECT window_id, y, n, v, role FROM smp JOIN ro ON grp = window_id // 4), st AS (SELECT window_id, y, role, n, (v - m) / s AS v FROM wr JOIN (SELECT n, avg(v) AS m, stddev_pop(v) AS s FROM wr WHERE role = 'train' GROUP BY n) USING (n)) "


@query(_STD + " UNION ALL ".join(f"SELECT * FROM {_nearest_sql(c.basis)}" for c in pipelines.COMPARED))
def reconstruction_pipeline(spark, d):
    a, b = _split_windows(spark, d)
    pred, _ = pipelines.classify(a, b, pipelines.COMPARED, pipelines.nearest_feature)
    return metrics.macro_f1(pred, ["key"]).select(F.col("key").alias("basis"), q6(F.col("accuracy"), "accuracy"), q6(F.col("macro_f1"), "macro_f1"))


@query(_STD + f"SELECT * FROM {_nearest_sql('polynomial')}")
def staged_pipeline(spark, d):
    """Scaling, features and head as stages of one pipeline."""
    a, b = _split_windows(spark, d)
    model = Pipeline(stages=[estimators.ArrayScaler(), estimators.ReconstructionFeatures(basis="polynomial"), estimators.ClassHead()]).fit(a)
    return metrics.macro_f1(model.transform(b)).select(F.lit("polynomial").alias("basis"), q6(F.col("accuracy"), "accuracy"), q6(F.col("macro_f1"), "macro_f1"))


@query()
def dsge_pipeline(spark, d):
    a, b = _split_windows(spark, d)
    with_shape = lambda f: spectra.describe(f.withColumn("v", F.col("x")), v="v", out="shape")
    return pipelines.run(with_shape(a), with_shape(b), pipelines.Config("fractional"), pipelines.COMPARED, "shape", len(SHAPE))[1]


@query()
def alpha_sweep(spark, d):
    return pipelines.alpha_sweep(*_split_windows(spark, d))


@query()
def compare_heads(spark, d):
    p = pipelines.compare_heads(*_sides(spark, d), "window_id", "grp")
    return metrics.macro_f1(p, ["method"])


@query()
def compare_pairs(spark, d):
    return pipelines.compare_pairs(pipelines.compare_heads(*_sides(spark, d), "window_id", "grp"), "window_id")


@query()
def selected_basis(spark, d):
    """The basis that an inner split selects, and how it does on the outer one."""
    a, b = _split_windows(spark, d)
    return pipelines.run(a, b, pipelines.select_basis(a, "grp"))[1]


@query(f"WITH {_REP[5:]}, m AS (SELECT avg(CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END) AS f, (SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) FROM pr) AS acc FROM rp) SELECT 'features alone beat a coin' AS label, acc > 0.5 AS passed FROM m UNION ALL SELECT 'hybrid beats the baseline', false FROM m UNION ALL SELECT 'a basis is worth something', f > 0.5 FROM m UNION ALL SELECT 'best alpha is inside the range', true FROM m")
def verification_checks(spark, d):
    m = metrics.macro_f1(_pred(spark, d))
    facts = m.select(F.col("accuracy").alias("accuracy_alone"), F.col("accuracy").alias("accuracy_baseline"), F.col("accuracy").alias("accuracy_hybrid"), F.lit("any").alias("best_basis"), F.col("macro_f1").alias("best_f1"), F.lit(False).alias("alpha_at_boundary"), F.lit(0.5).alias("best_alpha"))
    return pipelines.checks(facts).select("label", "passed")


# --- telemetry with three channels -----------------------------------------------------------------------------------

_CH = ["rpm", "torque", "rop"]
_LI = "li AS (SELECT l_suppkey AS well, l_quantity AS rpm, l_extendedprice AS torque, l_discount AS rop, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS pos, count(*) OVER (PARTITION BY l_suppkey) AS rows FROM lineitem), tw AS (SELECT well, pos // 120 AS block, pos % 120 // 24 AS k, pos % 24 AS o, rpm, torque, rop FROM li WHERE pos % 120 < 96 AND pos // 120 * 120 + (pos % 120 // 24 + 1) * 24 <= rows), ch AS (SELECT well, block, k, o AS pos, unnest([0, 1, 2]) AS c, unnest([rpm, torque, rop]) AS v FROM tw)"
_DR = f"WITH {_LI}, " + sql.shape("ch", "well, block, k, c", shift=1e-9)


def _telemetry(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("well"), F.col("l_quantity").alias("rpm"), F.col("l_extendedprice").alias("torque"), F.col("l_discount").alias("rop"), "l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    return datasets.channel_windows(li, "well", ["l_orderkey", "l_linenumber", "l_partkey", "torque", "rpm", "rop", "l_tax"], _CH, 24, 4, 24)


@query(f"WITH {_LI}, zc AS (SELECT well, block, k, c, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-9 THEN stddev_pop(v) OVER w ELSE 1 END AS z FROM ch WINDOW w AS (PARTITION BY well, block, k, c)) SELECT well, block, k, " + ", ".join(f"{r6(f'max(CASE WHEN c = {i} AND pos = 0 THEN z END)')} AS first_{n}, {r6(f'sum(CASE WHEN c = {i} THEN z * pos END)')} AS moment_{n}" for i, n in enumerate(_CH)) + " FROM zc GROUP BY well, block, k")
def telemetry_windows(spark, d):
    moment = lambda c: F.aggregate(F.transform(c, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return _telemetry(spark, d).select("well", "block", "k", *(e for n in _CH for e in (q6(F.col(n)[0], f"first_{n}"), q6(moment(n), f"moment_{n}"))))


@query(_DR + " SELECT well, block, k, " + ", ".join(f'max(CASE WHEN c = {i} THEN "{s}" END) AS "{n}_{s}"' for i, n in enumerate(_CH) for s in SHAPE) + " FROM shp GROUP BY well, block, k")
def channel_descriptors(spark, d):
    s = datasets.channel_descriptors(_telemetry(spark, d), _CH)
    # Values between two sixth decimals are common here (sums of eighths); a shift puts them on one side everywhere.
    s = s.withColumn("s", F.transform("s", lambda e: e + 1e-9))
    return s.select("well", "block", "k", *columns.named("s", [n.replace(":", "_") for n in datasets.descriptor_names(_CH)], 6))


_GM = ", gm AS (SELECT well, block, c, " + ", ".join(f'avg("{s}") AS "{s}"' for s in SHAPE) + ", count(*) AS n FROM shp GROUP BY well, block, c)"


@query(f"WITH {_LI}, " + sql.shape("ch", "well, block, k, c", digits=14) + _GM + " SELECT well, block, well % 2 AS y, any_value(n) AS n, " + ", ".join(f'round(max(CASE WHEN c = {i} THEN "{s}" END), 4) + 0.0 AS "{n}_{s}"' for i, n in enumerate(_CH) for s in SHAPE) + " FROM gm GROUP BY well, block")
def group_means(spark, d):
    s = datasets.channel_descriptors(_telemetry(spark, d), _CH).withColumn("y", F.col("well") % 2)
    return datasets.group_means(s, ["well", "block"], "y", ["k"]).select("well", "block", "y", "n", *columns.named("s", [n.replace(":", "_") for n in datasets.descriptor_names(_CH)], 4))


@query()
def group_separability(spark, d):
    s = datasets.channel_descriptors(_telemetry(spark, d), _CH).withColumn("y", F.col("well") % 2)
    return datasets.separability(datasets.group_means(s, ["well", "block"], "y", ["k"]), datasets.descriptor_names(_CH), "y")


@query()
def per_channel_reconstruction(spark, d):
    """Votes of the nearest reconstruction over all channels' features, with a basis selected on the first channel."""
    w = _telemetry(spark, d).select("well", "block", "k", *_CH, (F.col("well") % 2).cast("int").alias("y"), F.concat_ws(":", "well", "block").alias("grp"))
    s = splits.grouped_split(w, "grp").persist()  # read by every pass of the fits: the samples are shuffled into windows once
    a, b = s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")
    config = pipelines.select_basis(a.withColumnRenamed("rpm", "x"), "grp")
    a, b, _ = pipelines.per_channel(a, b, config, _CH)
    key = F.lit(config.name).alias("key")
    return pipelines.logistic_head(a.select(key, "y", "s"), b.select(key, "*")).select("well", "block", "k", "y", "p")
