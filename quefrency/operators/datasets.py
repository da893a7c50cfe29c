"""Datasets of windows: random windows of recordings, and windows of telemetry with several channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quefrency.functions import columns, signal
from quefrency.operators import experiments, spectra, tiling
from quefrency.schema import SHAPE
from quefrency.sources import recordings


def random_window_frames(spark: SparkSession, folder: str, band: str = "2G", size: int = 65536, n_windows: int = 40, blocks: int = 20, n_fft: int = 256, hop: int = 128, least: float = 0.8, cap: int | None = None, seed: int = 2026) -> DataFrame:
    """rec_id, class_id, class_label, grp (recording and block), start, frame_id, v: log profiles of random windows' frames that
    deviate enough. cap: windows of a class are taken in order while their frames before number less."""
    rec = recordings.numbered(recordings.discover(spark, folder, band))
    starts = experiments.random_starts(rec, "rec_id", "n_samples", size, n_windows, blocks, seed)
    windows = starts.join(F.broadcast(rec.select("rec_id", "path", "class_id", "class_label")), "rec_id").withColumn("count", F.lit(size))
    read = recordings.read_iq_windows(windows.repartition("path", "block", "draw")).drop("count", "path")
    kept = spectra.energy_mask(spectra.complex_log_profiles(read, n_fft, hop), least).withColumn("grp", tiling.group_id(F.col("rec_id"), F.col("block"), blocks))
    if cap is not None:
        of = ["class_id", "rec_id", "block", "draw"]
        n = kept.groupBy(*of).agg(F.count(F.lit(1)).alias("__n"))
        kept = kept.join(experiments.cap_frames(n, "class_id", of[1:], "__n", cap).select(*of), of, "left_semi")
    return kept.select("rec_id", "class_id", "class_label", "grp", "start", "frame_id", "v")


def channel_windows(samples: DataFrame, series: str, order: list[str], channels: list[str], window: int = 120, per_block: int = 8, guard: int = 120) -> DataFrame:
    """series, block, k, start, end (rows of the series), and each channel as an array less its mean, by its population
    deviation where that is not tiny. The last block may be partial; windows with a null or non-finite value in any channel go."""
    t = tiling.tile(samples, series, order, window, per_block, guard, partial_blocks=True)
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = fine(channels[0])
    for c in channels[1:]:
        ok = ok & fine(c)
    row = F.when(ok, F.struct("offset", *(F.col(c).cast("double").alias(c) for c in channels)))
    w = t.groupBy(series, "block", "k").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(row)).alias("__r")).where(F.size("__r") == window)
    field = lambda c: F.transform("__r", lambda e: e[c])
    whole = w.select(series, "block", "k", "start", (F.col("start") + window).alias("end"), *(field(c).alias(c) for c in channels))
    return whole.withColumns({c: columns.rows(signal.znorm)(c) for c in channels})


def channel_descriptors(windows: DataFrame, channels: list[str], out: str = "s") -> DataFrame:
    """windows with s, the shape descriptors of each channel end to end, instead of the channels."""
    x = windows
    for i, c in enumerate(channels):
        x = spectra.describe(x, znorm=False, v=c, out=f"__s{i}")
    return x.withColumn(out, F.concat(*(F.col(f"__s{i}") for i in range(len(channels))))).drop(*(f"__s{i}" for i in range(len(channels))))


def descriptor_names(channels: list[str]) -> list[str]:
    return [f"{c}:{s}" for c in channels for s in SHAPE]


def group_means(frame: DataFrame, groups: list[str], y: str, order: list[str], s: str = "s") -> DataFrame:
    """groups, y (of each group's first row), n, s: the mean of each descriptor over the group."""
    first = F.struct(F.struct(*order).alias("order"), F.col(y).alias("y"))
    # Rows are read, and descriptors made, once; rows of a group meet before they become a row a descriptor. They are added in
    # their order, so that means are the same to the last bit, and tie with the same others, on any partitioning.
    each = frame.select(*groups, first.alias("__f"), s).repartition(*groups).sortWithinPartitions(*groups, "__f").select(*groups, "__f", F.posexplode_outer(s).alias("__i", "__v"))
    each = each.groupBy(*groups, "__i").agg(F.avg("__v").alias("__m"), F.min("__f").alias("__f"), F.count(F.lit(1)).alias("__n"))
    rows = F.sum(F.when(F.coalesce("__i", F.lit(0)) == 0, F.col("__n")))
    mean = F.array_sort(F.collect_list(F.when(F.col("__i").isNotNull(), F.struct("__i", "__m"))))
    out = each.groupBy(*groups).agg(F.min("__f")["y"].alias(y), rows.alias("n"), mean.alias("__s")).where(F.size("__s") > 0)
    return out.select(*groups, y, "n", F.transform("__s", lambda e: e["__m"]).alias(s))


def separability(means: DataFrame, names: list[str], y: str, s: str = "s") -> DataFrame:
    """descriptor, h, p, eta_sq (between over total sum of squares) of group means by class."""
    from quefrency.operators import stats

    long = means.select(y, F.posexplode(s).alias("__i", "v")).withColumn("descriptor", F.array(*map(F.lit, names))[F.col("__i")]).persist()  # read several times, and small beside the windows
    k = stats.kruskal(long, y, "v", ["descriptor"]).select("descriptor", "h", "p")
    return k.join(stats.anova(long, y, "v", ["descriptor"]).select("descriptor", F.col("eta2").alias("eta_sq")), "descriptor")
