"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors get a coordinate that gives all the same length, so that the largest inner product is the smallest distance. Each
table hashes them to floor((a.x + b) / w) for several normal a. A query visits buckets whose perturbed hash values have the
least summed squared distance to its own projections, which is the order of estimated success; tables' candidates merge,
and are ranked by the exact product in double precision.

The number of projections grows with the logarithm of the number of vectors, so that the share of them that a query meets
falls. Buckets are dealt to groups of about BLOCK rows over all tables, and a query goes to a group once with all the
buckets that it visits there, not once a bucket. Larger buckets are split over groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quefrency.llm.scratch import keep


@dataclass(frozen=True)
class Params:
    """tables, projections of each, width in standard deviations of a projection, buckets visited in each table."""

    tables: int = 8
    projections: int = 12
    width: float = 2.5
    probes: int = 300
    seed: int = 7

    @classmethod
    def for_rows(cls, n: int) -> Params:
        """Projections by the number of vectors: four times as many rows stand in buckets of half their share."""
        m = round(4.5 + np.log2(max(n, 1)) / 2)
        return cls(projections=m, probes=25 * m)


#: Rows of a group that one task compares queries with at once.
BLOCK = 4096
#: Distinct vectors that a task holds before it sends them on.
HELD_VECTORS = 1 << 15
#: Levels of length, each half of the one before; the last one takes all that is shorter.
LEVELS = 12
#: One-step moves of a projection's hash value.
STEPS = (-1, 1, -2, 2)


def move_costs(place: np.ndarray) -> np.ndarray:
    """Squared distance of each projection (last axis) to the hash values that STEPS away from its own begin: by projection, then step."""
    part = place - np.floor(place)
    return np.stack([part, 1 - part, 1 + part, 2 - part], axis=-1).reshape(*place.shape[:-1], -1) ** 2


@lru_cache(maxsize=8)
def perturbations(m: int, size: int) -> np.ndarray:
    """Sets of places in the sorted costs of m projections' moves, in the order of their expected sums; -1 fills a row."""
    usual = np.append(np.sort(move_costs(np.random.default_rng(m).random((4096, m))), axis=1).mean(axis=0), np.inf)
    out, heap = [()], [(float(usual[0]), (0,))]
    while heap and len(out) < size:
        cost, s = heappop(heap)
        out.append(s)
        more = float(usual[s[-1] + 1])
        if more < np.inf:  # a set grows by the next move or shifts its last one
            heappush(heap, (cost + more, (*s, s[-1] + 1)))
            heappush(heap, (cost - float(usual[s[-1]]) + more, (*s[:-1], s[-1] + 1)))
    wide = max(map(len, out))
    return np.array([(*s, *[-1] * (wide - len(s))) for s in out], np.int64).reshape(len(out), wide)


class Hasher:
    def __init__(self, dim: int, top: float, params: Params):
        rng = np.random.default_rng(params.seed)
        self.p, self.top = params, top
        self.a = rng.normal(size=(dim + 1, params.tables * params.projections))
        self.b = rng.uniform(0, 1, params.tables * params.projections)
        self.w = params.width * top  # a projection of a vector of length `top` has that standard deviation

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of the width. A query is scaled to the common length, which changes no order."""
        norm = np.sqrt((x * x).sum(axis=1))
        x = x * (self.top / norm)[:, None] if query else x
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - norm**2, 0))
        return np.column_stack([x, last]) @ self.a / self.w + self.b

    def levels(self, x: np.ndarray) -> np.ndarray:
        """How often a vector's length can be doubled and still be no longer than the longest; none more than LEVELS - 1 times.

        Vectors are hashed as if doubled so often, each level in buckets of its own: a few long vectors do not push all
        others into the same buckets."""
        norm = np.sqrt((x * x).sum(axis=1))
        return np.clip(np.floor(np.log2(self.top / norm)), 0, LEVELS - 1).astype(np.int64)

    def keys(self, cells: np.ndarray, table: int, level: int | np.ndarray = 0) -> np.ndarray:
        """One 64-bit key for each row (last axis) of a table's integer hash values at a level."""
        h = (np.full(cells.shape[:-1], table + 1, np.uint64) + np.asarray(level).astype(np.uint64) * np.uint64(self.p.tables)) * np.uint64(0xD1B54A32D192ED03)
        for j in range(cells.shape[-1]):
            h = (h ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def table(self, places: np.ndarray, t: int) -> np.ndarray:
        return places[:, t * self.p.projections : (t + 1) * self.p.projections]

    def visits(self, place: np.ndarray) -> np.ndarray:
        """Hash values (queries, probes, projections) of the buckets that queries visit in one table, likeliest first.

        Of four times as many sets of moves as are wanted, in the order of their expected cost, those with the least cost
        for the query itself. Two moves of one projection are alternatives, so sets with both are left out.
        """
        m = place.shape[1]
        sets = perturbations(m, 4 * self.p.probes)
        cost = move_costs(place)
        order = np.argsort(cost, axis=1)
        none = np.concatenate([np.take_along_axis(cost, order, 1), np.zeros((len(place), 1))], axis=1)
        which = np.concatenate([order, np.full((len(place), 1), 4 * m)], axis=1)[:, sets]  # -1 takes the last column
        total = none[:, sets].sum(axis=2)
        of = np.sort(np.where(which < 4 * m, which // 4, m + np.arange(sets.shape[1])), axis=2)
        total[(of[:, :, 1:] == of[:, :, :-1]).any(axis=2)] = np.inf
        best = np.argsort(total, axis=1, kind="stable")[:, : self.p.probes]
        fine = np.isfinite(np.take_along_axis(total, best, 1))
        out = np.repeat(np.floor(place).astype(np.int64)[:, None], best.shape[1], axis=1)
        picked = np.take_along_axis(which, best[:, :, None], 1)
        step = np.append(np.tile(STEPS, m), 0)
        rows, probe = np.indices(best.shape)
        for j in range(picked.shape[2]):
            out[rows, probe, np.minimum(picked[:, :, j] // 4, m - 1)] += step[picked[:, :, j]]
        out[~fine] = np.repeat(np.floor(place).astype(np.int64)[:, None], best.shape[1], axis=1)[~fine]  # there are no more: its own again
        return out


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vec (float64 bytes), ids (the k + 1 smallest ids of equal vectors, sorted), of vectors that take part."""

    def send(seen: dict[bytes, set[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([sorted(x)[: k + 1] for x in seen.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, set[int]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(v, np.float64) + 0.0
                seen.setdefault(x.tobytes(), set()).add(i)
            if len(seen) >= HELD_VECTORS:
                yield send(seen)
                seen = {}
        yield send(seen)

    one = rows.mapInArrow(run, "vec binary, ids array<long>").groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return one.select("vec", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, params: Params | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates found with the largest inner product, ties to the smaller id.

    Vectors and queries that are null, zero, or hold null or non-finite components, that have a null id, or another number
    of components than most, take no part. Equal vectors are compared once and each returned by id. Repeated ids with
    equal vectors count once. A query is no candidate of its own id. Queries that find fewer than k are compared with
    all vectors, so they get all there are. Empty tables give no rows; other columns are ignored. params: by the number of
    distinct vectors, unless given.
    """
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fine)
    norm2 = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    stats = pick(vectors).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm2).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not stats:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, top = stats[0]["dim"], float(np.sqrt(stats[0]["top"]))
    base = keep(distinct_vectors(pick(vectors).where(F.size("v") == dim), k)).withColumn("vid", F.col("ids")[0])
    asked = keep(distinct_vectors(pick(queries).where(F.size("v") == dim), 1 << 30)).withColumn("qid", F.col("ids")[0])
    n = base.count()
    params = params or Params.for_rows(n)
    h = Hasher(dim, top, params)
    groups = -(-n * params.tables // BLOCK)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = {int(x) for b in batches if b.num_rows for x in np.unique(h.levels(_matrix(b.column(0).to_pylist())))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(some), pa.int32())], ["level"])

    levels = sorted(r["level"] for r in base.select("vec").mapInArrow(found, "level int").distinct().collect())  # LEVELS at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1).to_pylist())
            level = h.levels(x)
            cell = np.floor(h.places(x * 2.0 ** level[:, None], False))
            for t in range(params.tables):
                yield pa.RecordBatch.from_arrays([pa.array(h.keys(h.table(cell, t), t, level)), batch.column(0), batch.column(1)], ["key", "vid", "vec"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group, with the buckets that it visits there."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                place = h.places(_matrix(part.column(1).to_pylist()), True)
                visits = [h.visits(h.table(place, t)) for t in range(params.tables)]
                keys = np.concatenate([h.keys(v, t, level) for level in levels for t, v in enumerate(visits)], axis=1)
                for i in range(part.num_rows):
                    own = np.unique(keys[i])
                    group = own.view(np.uint64) % np.uint64(groups)
                    order = np.argsort(group, kind="stable")
                    g, first = np.unique(group[order], return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(own[order]))
                    same = pa.array(np.full(len(g), i))
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), part.column(0).take(same), part.column(1).take(same), lists], ["g", "qid", "qvec", "keys"])

    def batched(f):
        """Fewer, larger record batches."""

        def run(batches):
            held = []
            for b in f(batches):
                held.append(b)
                if len(held) == 64:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        return run

    def visit(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """Each query's best among the group's rows in the buckets that it visits."""
        out: tuple[list, list, list] = ([], [], [])
        if len(q) and len(x):
            vid, of = np.unique(x["vid"].to_numpy(), return_inverse=True)  # a row may stand in buckets of several tables
            m = np.empty((len(vid), dim))
            m[of] = _matrix(x["vec"].tolist())
            key = x["key"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, of = key[order], of[order]
            own = np.concatenate([np.asarray(k) for k in q["keys"]])
            a, b = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
            ends = np.cumsum([len(k) for k in q["keys"]])
            sizes = b - a
            rows = of[np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
            cut = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])]
            for i, v in enumerate(_matrix(q["qvec"].tolist())):
                met = np.unique(rows[cut[i] : cut[i + 1]])
                s = m[met] @ v
                if len(met) > k + 1:  # ties at the end all stay
                    top_ = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    met, s = met[top_], s[top_]
                if len(met):
                    for o, v in zip(out, (q["qid"].iloc[i], vid[met], s), strict=True):
                        o.append(v)
        return pd.DataFrame({"qid": pd.Series(out[0], dtype="int64"), "vids": pd.Series(out[1], dtype=object), "scores": pd.Series(out[2], dtype=object)})

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        """A query's nearest over all groups."""
        vid, s = np.concatenate(rows["vids"].to_list()), np.concatenate(rows["scores"].to_list())
        order = np.lexsort((-s, vid))
        vid, s = vid[order], s[order]
        one = np.append(True, vid[1:] != vid[:-1])
        vid, s = vid[one], s[one]
        order = np.lexsort((vid, -s))[: k + 1]
        return pd.DataFrame({"qid": np.full(len(order), rows["qid"].iloc[0]), "vid": vid[order], "score": s[order]})

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": np.empty(0, np.int64), "vid": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(q) or not len(x):
            return empty
        vid = x["vid"].to_numpy()
        order = np.argsort(vid)
        vid, m = vid[order], _matrix(x["vec"].tolist())[order]
        out = []
        for at in range(0, len(q), 1024):
            part = q.iloc[at : at + 1024]
            s = _matrix(part["qvec"].tolist()) @ m.T
            best = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            out.append(pd.DataFrame({"qid": np.repeat(part["qid"].to_numpy(), best.shape[1]), "vid": vid[best.ravel()], "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out)

    rows = base.select("vid", "vec").mapInArrow(index, "key long, vid long, vec binary")
    # Buckets of more than a block: at most as many as there are blocks, usually none.
    large = keep(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")))
    probes = keep(asked.select("qid", F.col("vec").alias("qvec")).mapInArrow(batched(probe), "g long, qid long, qvec binary, keys array<long>"))
    unsigned = F.pmod(F.pmod(F.shiftrightunsigned("key", 1), F.lit(groups)) * 2 + F.col("key").bitwiseAND(1), F.lit(groups))
    dealt = rows.withColumn("g", unsigned)
    if large.limit(1).count():
        split = dealt.join(large, "key", "left")
        salt = F.pmod(F.xxhash64("vid"), F.coalesce("parts", F.lit(1)))
        dealt = split.withColumn("g", F.when(F.col("parts").isNull(), F.col("g")).otherwise(groups + F.pmod(F.xxhash64("key", salt), F.lit(1 << 60)))).drop("parts")
        more = probes.select("qid", "qvec", F.explode("keys").alias("key")).join(large, "key").select("qid", "qvec", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<long>")).alias("salt"))
        more = more.select((groups + F.pmod(F.xxhash64("key", "salt"), F.lit(1 << 60))).alias("g"), "qid", "qvec", F.array("key").alias("keys"))
        probes = probes.select("g", "qid", "qvec", "keys").unionByName(more)
    found = probes.groupBy("g").cogroup(dealt.groupBy("g")).applyInPandas(visit, "qid long, vids array<long>, scores array<double>")
    found = keep(found.groupBy("qid").applyInPandas(best, "qid long, vid long, score double"))
    # Queries that found too few go against everything, in blocks.
    few = asked.join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k + 1)
    if n > k and few.limit(1).count():
        blocks = -(-n // BLOCK)
        a = few.select("qid", F.col("vec").alias("qvec"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("salt"))
        b = base.select("vid", "vec", F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("salt"))
        rest = _best(a.groupBy("salt").cogroup(b.groupBy("salt")).applyInPandas(compare, "qid long, vid long, score double"), k + 1)
        found = found.join(few.select("qid"), "qid", "left_anti").unionByName(rest)
    elif n <= k:
        a = asked.select("qid", F.col("vec").alias("qvec"), F.lit(0).alias("salt"))
        found = a.groupBy("salt").cogroup(base.select("vid", "vec", F.lit(0).alias("salt")).groupBy("salt")).applyInPandas(compare, "qid long, vid long, score double")
    each = found.join(asked.select("qid", F.explode("ids").alias("query_id")), "qid").join(base.select("vid", "ids"), "vid").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("qid", "vid").agg(F.max("score").alias("score"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vid"))).where(F.col("r") <= k).drop("r")
