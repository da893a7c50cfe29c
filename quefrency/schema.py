"""Declared schemas; nothing is inferred."""

WINDOWS = "window_id long, y int, x array<double>"
FRAMES = "window_id long, y int, frame_id int, v array<double>"
RECORDING = "path string, class_label string, band string, part int, total_parts int, n_samples long, fs double, fc double"
IQ_BLOCK = "path string, start long, re array<float>, im array<float>"
TELEMETRY = "rpm double, torque double, rop double, depth double"
#: Names of the eleven shape descriptors, in order.
SHAPE = ["skew", "kurt", "max", "min", "p05", "p95", "iqr", "mad_diff", "zcr", "ar1", "rng"]
#: Names of the five and the six more spectral statistics, in order.
SPECTRAL5 = ["flatness", "entropy", "centroid", "skew", "kurt"]
SPECTRAL11 = [*SPECTRAL5, "crest", "p05", "p50", "p95", "iqr", "gap"]
