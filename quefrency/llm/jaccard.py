"""Exact set-similarity join of word shingles by vertical partitioning of the global shingle order.

Texts with equal shingle sets are one class. The order of shingle hashes is cut into fragments; what two classes share is
counted for each fragment by itself and summed per pair. Before that, three exact filters find the few classes and pairs
that can reach the threshold:

1. Coverage, by fragment: a class needs most of its shingles in other classes. Counted over small classes' whole sets and a
   fixed range of the hash order of larger ones, where the number that may be missing is the same.
2. Rarest-first prefixes of what is left, as of then by exact frequency; unique shingles count but are not stored.
3. For a pair with sizes a and b, t(a+b)/(100+t) shingles must be shared, which bounds sizes, shared counts and places.

Pairs are proposed in two rounds: each prefix shingle's most typical class with all others, then, for classes that are not
connected yet, all partners outside their component. So a group of near copies costs its size, and no link that changes a
component is missed. Where a shingle has many such pairs, its classes are compared with one of its largest component first.
Near copies of that one which are not linked to it must share with a partner half of what the partner differs in, and meet by
the rarest of these differences. The others (texts made of the same few templates) meet by the contents of fragments: a pair
that may differ in k shingles, cut into k + 2 fragments, agrees in two at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quefrency.llm.components import components
from quefrency.llm.kernels import flat, mix, shingle_sets, slices
from quefrency.llm.scratch import keep
from quefrency.llm.sketch import buckets_for

#: Words of a shingle, and percent of the union that two linked texts share at least.
SHINGLE, PERCENT = 5, 75
#: Classes up to this size show all their shingles to the coverage filter; larger ones those in this share of the hash order.
SMALL, SHARE = 96, 0.4
#: Shingles that a task holds before it deals them out.
HELD_KEYS = 1 << 19
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 8
#: Rows of a prefix shingle times those outside its largest component, up to which its classes meet one by one; with more,
#: differences and contents of fragments decide.
CROWD = 128
#: Share of its size by which a class differs from one of its shingle's largest component at most, to be compared by these differences.
NEAR = 0.6
#: Words of 64 bits of a class's parities, which differ in no more bits than the classes do in shingles.
PARITIES = 8
#: Sizes up to which intervals of sizes are set out (no text has as many words).
MOST_WORDS = 1 << 31
#: Class ids (8 bytes each) up to which the set of classes to read again is broadcast.
BROADCAST_IDS = 1 << 20


def _signature(x: np.ndarray) -> int:
    """Of a set of shingle hashes; sets with equal signature and size are one class."""
    return int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _shown(x: np.ndarray) -> np.ndarray:
    return x if len(x) <= SMALL else x[: np.searchsorted(x, np.uint64(int(SHARE * 2**64)))]


def shingle_table(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (shingles), m (of them, ones that any partner shows too), sig (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(*flat(part.column(1)), SHINGLE)
                n = [len(x) for x in sets]
                m = [k if 100 * k <= percent * SMALL else int(np.searchsorted(x, np.uint64(int(SHARE * 2**64)))) for k, x in zip(n, sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array([_signature(x) if len(x) else None for x in sets], pa.int64())], ["doc_id", "n", "m", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, m long, sig long")


def shared_counts(docs: DataFrame) -> DataFrame:
    """node, c: how many of the shingles that a class shows are in another class too (or a few more, never fewer)."""
    buckets = buckets_for(docs)
    shift = np.uint64(65 - buckets.bit_length())

    def deal(held: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A gram met in several classes of this task is settled here: they are credited, and the gram goes on once, without them."""
        g, v = np.concatenate(held), np.concatenate(nodes)
        order = np.argsort(g, kind="stable")
        g, v = g[order], v[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(g)))
        many = np.repeat(size > 1, size)
        credit, count = np.unique(v[many], return_counts=True)
        one, first = ~many, g[new][size > 1]
        cuts = lambda x: np.searchsorted(x >> shift, np.arange(buckets + 1, dtype=np.uint64))
        a, b, c = cuts(g[one]), cuts(first), cuts(credit.view(np.uint64))
        credit = credit[o := np.argsort(credit.view(np.uint64))]
        count = count[o].astype(np.int32)
        c = cuts(credit.view(np.uint64))
        part = lambda x, at: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), part(g[one], a), part(v[one], a), part(first, b), part(credit, c), part(count, c)], ["bucket", "grams", "nodes", "many", "credit", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, size, seen = [], [], 0, set()
        for batch in batches:
            for part in slices(batch, 0):
                for x in shingle_sets(*flat(part.column(0)), SHINGLE):
                    if len(x) and (sig := _signature(x)) not in seen:
                        seen.add(sig)
                        held.append(_shown(x))
                        nodes.append(np.full(len(held[-1]), sig, np.int64))
                        size += len(held[-1])
                if size >= HELD_KEYS:
                    yield from deal(held, nodes)
                    held, nodes, size, seen = [], [], 0, set()
        if size:
            yield from deal(held, nodes)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        g, v = np.frombuffer(b"".join(rows["grams"]), np.uint64), np.frombuffer(b"".join(rows["nodes"]), np.int64)
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        own = np.ones(len(g), bool)
        own[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
        g, v = g[own], v[own]
        same = g[1:] == g[:-1]
        shared = np.zeros(len(g), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared |= np.isin(g, np.frombuffer(b"".join(rows["many"]), np.uint64))
        nodes = np.concatenate([v[shared], np.frombuffer(b"".join(rows["credit"]), np.int64)])
        n = np.concatenate([np.ones(int(shared.sum()), np.int64), np.frombuffer(b"".join(rows["count"]), np.int32)])
        u, at = np.unique(nodes, return_inverse=True)
        return pd.DataFrame({"node": u, "c": np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)})

    dealt = docs.select("text").mapInArrow(run, "bucket int, grams binary, nodes binary, many binary, credit binary, count binary")
    return dealt.groupBy("bucket").applyInPandas(count, "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))


def fragment_table(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n, frag, grams: each class's sorted shingles, cut by FRAGMENTS equal ranges of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = (np.arange(1, FRAGMENTS) * (2**64 // FRAGMENTS)).astype(np.uint64) if FRAGMENTS > 1 else np.empty(0, np.uint64)
        for batch in batches:
            for part in slices(batch, 0):
                out = []
                for x, sig in zip(shingle_sets(*flat(part.column(0)), SHINGLE), part.column(1).to_pylist(), strict=True):
                    if len(x) and _signature(x) == sig:  # another text may have the same id
                        out += [(sig, len(x), k, y.view(np.int64)) for k, y in enumerate(np.split(x, np.searchsorted(x, pivots))) if len(y)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["node", "n", "frag", "grams"])

    want = classes.select(F.col("rep").alias("__rep"), F.col("sig").alias("__sig"))
    want = F.broadcast(want) if classes.count() <= BROADCAST_IDS else want
    own = docs.join(want, F.col("doc_id") == F.col("__rep")).select("text", "__sig")
    return own.mapInArrow(run, "node long, n long, frag int, grams array<long>").dropDuplicates(["node", "frag"])


def _need(a: Column, b: Column, percent: int) -> Column:
    """Shingles that classes of sizes a and b must share."""
    return F.ceil(percent * (a + b) / (100 + percent))


def prefixes(fragments: DataFrame, percent: int) -> DataFrame:
    """s, node, n, c, pos, own: rarest-first prefix of each class, without unique shingles. c: its shingles in other classes; pos: place
    in the order; own: the share of its shingles that is its own, where one in df classes counts as 1 / df."""
    each = fragments.select("node", "n", F.explode("grams").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(often, "s").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    dead = F.col("n") - F.size("x")
    own_ = F.aggregate("x", dead.cast("double"), lambda a, e: a + 1 / e["df"]) / F.col("n")
    own = own.where(F.size("x") >= least).select("node", "n", F.size("x").cast("long").alias("c"), dead.alias("dead"), own_.alias("own"), F.slice("x", F.lit(1), F.greatest(F.col("n") - least + 1 - dead, F.lit(0)).cast("int")).alias("x"))
    return own.select("node", "n", "c", "own", "dead", F.posexplode("x").alias("i", "e")).select("e.s", "node", "n", "c", (F.col("dead") + F.col("i")).alias("pos"), "own")


def _feasible(x: str, y: str, percent: int) -> Column:
    c = lambda t, k: F.col(f"{t}.{k}")
    room = F.least(c(x, "c"), c(y, "c"), c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return _need(c(x, "n"), c(y, "n"), percent) <= room


def verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: overlaps counted by fragment, summed per pair."""
    x = fragments.select(F.col("node").alias("a"), F.col("n").alias("na"), "frag", F.col("grams").alias("ga"))
    y = fragments.select(F.col("node").alias("b"), F.col("n").alias("nb"), "frag", F.col("grams").alias("gb"))
    part = pairs.join(x, "a").join(y, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _differ(total: int | Column, percent: int) -> int | Column:
    """Shingles by which two linked classes of so many in total differ at most."""
    return total * (100 - percent) // (100 + percent) if isinstance(total, int) else F.floor(total * (100 - percent) / (100 + percent))


def size_intervals(percent: int) -> list[int]:
    """First sizes of intervals, such that linked classes are in the same one or in neighbouring ones."""
    out = [1]
    while out[-1] < MOST_WORDS:
        out.append(out[-1] * 100 // min(percent, 95) + 1)
    return out


def content_signatures(fragments: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """s, node, n, comp, pos, b0, b1, ...: for classes `nodes` (node, n, comp) the signatures by which all linked ones meet,
    and each class's parities.

    Two neighbouring intervals of sizes make a scheme, which cuts the order into k + 2 fragments where two of its classes
    differ in k shingles at most. The content of a fragment is one signature, an empty one included. Linked classes agree in
    all but k, so the rarest k + 1 of each have one in common; empty fragments count as the most frequent ones.
    """
    first = size_intervals(percent)
    parts = [_differ(b + c - 2, percent) + 2 for b, c in zip(first[1:], first[2:], strict=False)]
    starts, cuts = (F.array(*(F.lit(x).cast("long") for x in v)) for v in (first, parts))
    at = F.size(F.filter(starts, lambda x: x <= F.col("n")))  # the interval, from 1
    up = _differ(F.col("n") + F.floor(F.col("n") * 100 / percent), percent)
    down = _differ(F.col("n") + F.element_at(starts, F.col("at")) - 1, percent)
    mine = nodes.withColumn("at", at).select("node", "comp", F.explode(F.array(F.struct(F.col("at").alias("scheme"), up.alias("k")), F.struct((F.col("at") - 1).alias("scheme"), down.alias("k")))).alias("e"))
    mine = mine.where("e.scheme > 0").select("node", "comp", "e.scheme", "e.k", F.element_at(cuts, F.col("e.scheme")).alias("parts"))
    key = ["node", "n", "comp", "scheme", "k", "parts"]
    each = fragments.join(mine, "node").select(*key, F.explode("grams").alias("s"))
    each = each.groupBy(*key, F.pmod("s", "parts").alias("j")).agg(F.bit_xor(F.xxhash64("s")).alias("x")).select(*key, "j", F.xxhash64("scheme", "j", "x").alias("s"))
    each = keep(each)
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(s, 8), 64) as int))")
    parity = fragments.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("grams").alias("s")).groupBy("node")
    parity = parity.agg(*(F.bit_xor(F.when(F.pmod("s", F.lit(PARITIES)) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(PARITIES)))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    entry = F.struct(F.coalesce("df", F.lit(1)).cast("long").alias("df"), "s")
    own = each.join(often, "s", "left").groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("x"), F.collect_list("j").alias("js"))
    empty = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), "js")
    empty = F.transform(empty, lambda j: F.struct(F.lit(2).cast("long").alias("df"), F.xxhash64(F.col("scheme"), j, F.lit(0).cast("long")).alias("s")))
    some = F.slice(F.concat("x", F.when(F.size("x") > F.col("k"), F.slice(empty, 1, 0)).otherwise(empty)), F.lit(1), (F.col("k") + 1).cast("int"))
    own = own.select("node", "n", "comp", F.posexplode(some).alias("pos", "e")).where("e.df > 1")
    return own.join(parity, "node").select("e.s", "node", "n", "comp", "pos", *parity.columns[1:])


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether classes that meet in a signature may be linked, by their sizes, its places, and their parities."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    need = _need(a, b, percent)
    odd = sum((F.bit_count(F.col(f"{x}.b{w}").bitwiseXOR(F.col(f"{y}.b{w}"))) for w in range(PARITIES)), F.lit(0))
    return (need <= F.least(a, b)) & (F.greatest(f"{x}.pos", f"{y}.pos") <= a + b - 2 * need) & (odd <= a + b - 2 * need)


def _outside(r: DataFrame) -> DataFrame:
    """Rows of r (s, node, comp, ...) whose s is in several components, with `lead`, its largest one (of equal ones, that of the
    largest number), the number of rows outside, and of all rows."""
    each = r.groupBy("s", "comp").agg(F.count("*").alias("rows"))
    size = F.sum("rows").alias("rows")
    apart = each.groupBy("s").agg(F.max_by("comp", F.struct("rows", "comp")).alias("lead"), (F.sum("rows") - F.max("rows")).alias("outside"), size).where("outside > 0")
    return r.join(apart, "s")


def differences(fragments: DataFrame, r: DataFrame) -> DataFrame:
    """lead, pivot, np, node, n, comp, d, e: for each class of r (node, n, own, comp, lead) and its lead, the d shingles e that only one
    of the class and the pivot has, which is the lead's class with the least share of shingles of its own; np is the pivot's size."""
    pivot = r.where("comp = lead").groupBy("lead").agg(F.min(F.struct("own", "node", "n")).alias("l")).select("lead", F.col("l.node").alias("pivot"), F.col("l.n").alias("np"))
    key = ["lead", "pivot", "np", "node", "n", "comp"]
    each = r.select("lead", "node", "n", "comp").distinct().join(pivot, "lead").withColumn("frag", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    x, y = (fragments.select(F.col("node").alias(k), "frag", F.col("grams").alias(f"g{k}")) for k in ("node", "pivot"))
    a, b = (F.coalesce(f"g{k}", F.array().cast("array<long>")) for k in ("node", "pivot"))
    each = each.join(x, ["node", "frag"], "left").join(y, ["pivot", "frag"], "left").select(*key, F.concat(F.array_except(a, b), F.array_except(b, a)).alias("e"))
    return each.groupBy(*key).agg(F.flatten(F.collect_list("e")).alias("e")).select(*key, F.size("e").cast("long").alias("d"), "e")


def _most(a: Column, b: Column, percent: int) -> Column:
    """Shingles by which linked classes of sizes a and b differ at most."""
    return a + b - 2 * _need(a, b, percent)


def near_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components to verify, of classes compared with the same pivot, one of them near it.

    Links to the pivot itself are known from d. If x is not linked to it, x differs by more than q (size of x + np), with
    q = (100 - percent) / (100 + percent). Where x and y are linked, both share over (d of y - q (size of y - np)) / 2 of their
    differences, which is one at least: one of them is among as many of the rarest that y has.
    """
    q = (100 - percent) / (100 + percent)
    wide = (NEAR + q * (1 + 100 / percent)) * 100 / percent  # what a partner of a near class differs by at most, by its size
    held = apart.where((F.col("d") > 0) & (F.col("d") <= wide * F.col("n")))
    direct = held.where((F.col("comp") != F.col("lead")) & (F.col("d") <= _most(F.col("n"), F.col("np"), percent))).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    key = ["pivot", "np", "lead", "node", "n", "comp", "d"]
    each = held.select(*key, F.explode("e").alias("s"))
    often = each.groupBy("pivot", "s").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(often, ["pivot", "s"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    least = F.floor((F.col("d") - q * (F.col("n") - F.col("np")) - 1e-9 * F.col("n")) / 2)  # a little less: no rounding may cut
    own = own.withColumn("dead", F.col("d") - F.size("x")).withColumn("front", F.greatest(F.col("d") - F.greatest(least, F.lit(0)) - F.col("dead"), F.lit(0)).cast("int"))
    place = lambda f, x: f.select(*key, "dead", F.posexplode(x).alias("i", "e")).select(*key, "e.s", (F.col("dead") + F.col("i")).alias("pos"))
    loose = place(own.where((F.col("comp") != F.col("lead")) & (F.col("d") > _most(F.col("n"), F.col("np"), percent))), F.col("x"))
    front = place(own, F.slice("x", F.lit(1), F.col("front")))
    c = lambda t, k: F.col(f"{t}.{k}")
    shared = (c("x", "d") + c("y", "d") - _most(c("x", "n"), c("y", "n"), percent)) / 2
    ok = (shared <= F.least(c("x", "d") - c("x", "pos"), c("y", "d") - c("y", "pos"))) & (_need(c("x", "n"), c("y", "n"), percent) <= F.least(c("x", "n"), c("y", "n")))
    ok = ok & (c("x", "comp") != c("y", "comp")) & ((c("x", "d") <= NEAR * c("x", "n")) | (c("y", "d") <= NEAR * c("y", "n")))
    met = loose.alias("x").join(front.alias("y"), ["pivot", "s"]).where(ok)
    return direct.union(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))


def _across(r: DataFrame, ok: Column) -> DataFrame:
    """Pairs (a, b) of different components that meet in an s of r; rows of the largest component do not meet each other."""
    new = (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.lead")) | (F.col("x.node") < F.col("y.node")))
    pairs = r.where("comp <> lead").alias("x").join(r.alias("y"), "s").where(new & ok)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def links(fragments: DataFrame, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between classes that connect the same classes as all links do."""
    r = keep(prefixes(fragments, percent))
    # The class with the least share of shingles of its own leads: of a group of near copies, the one most like all others.
    lead = r.groupBy("s").agg(F.min(F.struct("own", "node", "n", "c", "pos")).alias("l"), F.count("*").alias("size")).where("size > 1").select("s", "l.node", "l.n", "l.c", "l.pos")
    star = r.alias("x").join(lead.alias("y"), "s").where((F.col("x.node") != F.col("y.node")) & _feasible("x", "y", percent))
    star = keep(star.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    first = keep(verified(star, fragments, percent))
    comp = components(first).withColumnRenamed("node", "k")
    r = r.join(comp, F.col("node") == F.col("k"), "left").select("s", "node", "n", "c", "pos", "own", F.coalesce("comp", "node").alias("comp"))
    r = keep(_outside(r))
    many = F.col("outside") * F.col("rows") > crowd
    cross = _across(r.where(~many), _feasible("x", "y", percent))
    crowded = r.where(many)
    if not crowded.isEmpty():
        apart = keep(differences(fragments, crowded))
        cross = cross.union(near_pairs(apart, percent))
        far = keep(apart.where(F.col("d") > NEAR * F.col("n")).select("node", "n", "comp").distinct())
        if not far.isEmpty():
            met = keep(_outside(content_signatures(fragments, far, percent)))
            cross = cross.union(_across(met, _alike("x", "y", percent)))
    cross = cross.distinct().join(star, ["a", "b"], "left_anti")
    return first.union(verified(keep(cross), fragments, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links of at least `percent` similarity), for each row.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing; fewer words than a
    shingle are one shingle. Repeated ids are rows of their own; rows with a null id get a null component and link
    nothing. An empty table gives none; texts are read whole; other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = keep(shingle_table(own, percent))
    classes = table.where("sig is not null and doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.max("m").alias("m"))
    counts = shared_counts(own.where("doc_id is not null"))
    slack = F.floor((100 - percent) * F.col("n") / 100)
    kept = classes.join(counts, F.col("sig") == F.col("node"), "left").where(F.coalesce("c", F.lit(0)) >= F.col("m") - slack)
    kept = keep(kept.select("sig", "rep"))
    comp = components(links(keep(fragment_table(own, kept)), percent))
    smallest = comp.join(kept, F.col("node") == F.col("sig")).groupBy("comp").agg(F.min("rep").alias("smallest"))
    moved = comp.join(smallest, "comp").select("node", "smallest")
    final = classes.join(moved, F.col("sig") == F.col("node"), "left").select("sig", "n", F.coalesce("smallest", "rep").alias("component_id"))
    out = table.join(final, ["sig", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (null last). Rows are told apart by a hash of id and text,
    so those that share an id but not their text stay, and copies go whatever their ids. Columns of any name are carried
    along in a struct of their own."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.withColumn("h", F.xxhash64("id", "text"))
    parts = near_duplicates(own.select("h", "text"), percent, "h").groupBy(F.col("doc_id").alias("h")).agg(F.min("component_id").alias("component"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    first = own.select("h", "id").distinct().join(parts, "h").groupBy("component").agg(best.alias("best")).select(F.col("best.h").alias("h"))
    kept = own.select("h", "row").join(first, "h", "left_semi")
    one = kept.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("h"))).where("nth = 1")
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns))
