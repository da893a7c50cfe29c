"""DuckDB SQL pieces that queries' expected rows are stated with."""

from __future__ import annotations

WIN = "win AS (SELECT vec_id AS window_id, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
SMP = WIN + ", smp AS (SELECT window_id, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS n FROM win)"


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def fft(source: str = "smp", share: float = 0.5) -> str:
    """frm, pow2: squared magnitudes of 16-point frames, hop 8, bins 0 to 8. share: of the window's constant part (0.5 is Hann, 0.54 Hamming)."""
    return f"""frm AS (SELECT window_id, y, f AS frame_id, n - 8 * f AS k, v * ({share} - {round(1 - share, 6)} * cos(2 * pi() * (n - 8 * f) / 16)) AS u
  FROM {source} JOIN (SELECT unnest(range(7)) AS f) ON n >= 8 * f AND n < 8 * f + 16),
pow2 AS (SELECT window_id, y, frame_id, b, pow(sum(u * cos(2 * pi() * k * b / 16)) / {16 * share}, 2) + pow(sum(u * sin(2 * pi() * k * b / 16)) / {16 * share}, 2) AS p2
  FROM frm, (SELECT unnest(range(9)) AS b) GROUP BY ALL)"""


MIRROR = "mir AS (SELECT window_id, y, frame_id, b, p2 FROM pow2 UNION ALL SELECT window_id, y, frame_id, 16 - b, p2 FROM pow2 WHERE b BETWEEN 1 AND 7)"
PROFILE = "prf AS (SELECT window_id, y, frame_id, b - 1 AS pos, ln(p2 + 1e-12) - avg(ln(p2 + 1e-12)) OVER (PARTITION BY window_id, frame_id) AS v FROM mir WHERE b > 0)"
CEPSTRUM = "cep AS (SELECT window_id, y, frame_id, q AS pos, sum(ln(sqrt(p2) + 1e-8) * cos(2 * pi() * q * b / 16)) / 16 AS v FROM mir, (SELECT unnest(range(8)) AS q) GROUP BY ALL)"
BASE = f"WITH {SMP}, {fft()}, {MIRROR}, {PROFILE}, {CEPSTRUM}"


def shape(source: str, keys: str, znorm: bool = True, digits: int = 6, shift: float = 0.0) -> str:
    """CTEs ending in `shp`: the eleven descriptors of each key of source(keys, pos, v)."""
    z = f"zn AS (SELECT {keys}, pos, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 1e-9 THEN stddev_pop(v) OVER w ELSE 1 END AS v FROM {source} WINDOW w AS (PARTITION BY {keys}))" if znorm else f"zn AS (SELECT {keys}, pos, v FROM {source})"
    rd = lambda e: f"round({e} + {shift!r}, {digits}) + 0.0"
    return f"""{z},
qt AS (SELECT {keys}, avg(v) AS m, var_pop(v) AS vr, max(v) AS mx, min(v) AS mn, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95 FROM zn GROUP BY {keys}),
st AS (SELECT {keys}, v, m, CASE WHEN vr > 1e-12 THEN sqrt(vr) ELSE 1 END AS sd, vr, mx, mn, p05, p25, p75, p95, sign(v - p50) AS sg, lead(v) OVER o AS nv, lead(sign(v - p50)) OVER o AS ns FROM zn JOIN qt USING ({keys}) WINDOW o AS (PARTITION BY {keys} ORDER BY pos)),
shp AS (SELECT {keys}, {rd('avg(pow((v - m) / sd, 3))')} AS skew, {rd('avg(pow((v - m) / sd, 4)) - 3')} AS kurt, {rd('any_value(mx)')} AS "max", {rd('any_value(mn)')} AS "min", {rd('any_value(p05)')} AS p05, {rd('any_value(p95)')} AS p95,
  {rd('any_value(p75 - p25)')} AS iqr, {rd('avg(abs(nv - v))')} AS mad_diff, {rd('avg(abs(ns - sg)) / 2')} AS zcr, {rd('CASE WHEN any_value(sqrt(vr)) > 1e-9 THEN coalesce(corr(v, nv), 0) ELSE 0 END')} AS ar1, {rd('any_value(mx - mn)')} AS rng FROM st GROUP BY {keys})"""


def cells(source: str, lo: int, hi: int, names: str = "c") -> str:
    """window_id, frame_id and one rounded column for each pos in lo .. hi."""
    cols = ", ".join(f"{r6(f'max(CASE WHEN pos = {p} THEN v END)')} AS {names}{p}" for p in range(lo, hi))
    return f"SELECT window_id, frame_id, {cols} FROM {source} GROUP BY window_id, frame_id"


def sign_pow(x: str, p: float) -> str:
    return f"(sign({x}) * pow(abs({x}), {p!r}))"


def adjugate(m: str) -> tuple[dict[tuple[int, int], str], str]:
    """Entries of the inverse of a symmetric 3 x 3 matrix with columns {m}ij (i <= j), and its determinant."""
    e = lambda i, j: f"{m}{min(i, j)}{max(i, j)}"
    det = f"({e(0, 0)}*({e(1, 1)}*{e(2, 2)}-{e(1, 2)}*{e(1, 2)}) - {e(0, 1)}*({e(0, 1)}*{e(2, 2)}-{e(1, 2)}*{e(0, 2)}) + {e(0, 2)}*({e(0, 1)}*{e(1, 2)}-{e(1, 1)}*{e(0, 2)}))"
    inv = {}
    for i in range(3):
        for j in range(i, 3):
            a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
            s = "" if (i + j) % 2 == 0 else "-"
            inv[i, j] = f"({s}({e(a[0], b[0])}*{e(a[1], b[1])}-{e(a[0], b[1])}*{e(a[1], b[0])})/{det})"
    return inv, det


def sweep(source: str, size: int, keys: str = "class") -> str:
    """CTE inv(class, i, j, g, logdet): inverses of symmetric matrices source(class, i, j, v), i and j below size, by sweeping each diagonal element."""
    return f"""sw AS (SELECT 0 AS k, {keys}, i, j, CAST(v AS DOUBLE) AS v, CAST(0.0 AS DOUBLE) AS logdet FROM {source} UNION ALL
SELECT k + 1, {keys}, i, j, CASE WHEN i = k AND j = k THEN -1 / p WHEN i = k THEN r / p WHEN j = k THEN c / p ELSE v - c * r / p END, logdet + ln(p)
FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY {keys}) AS p, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY {keys}, i) AS c, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY {keys}, j) AS r FROM sw WHERE k < {size})),
inv AS (SELECT {keys}, i, j, -v AS g, logdet FROM sw WHERE k = {size})"""
