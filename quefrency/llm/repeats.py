"""Exact removal of repeated fixed-length windows, of bytes or of words, from whole documents.

Shared by suffix-array and FM-index dedup, which differ in how a shard tells repeated windows apart.

1. Each window is represented by its rarest k-gram: frequency class by a corpus-wide sketch, then hash, leftmost.
   Equal windows have it at the same offset, so what follows depends on content alone.
2. Windows with the same anchor whose offsets lie in the same range of `cut` form a run. All share a core, whose hash is
   the run's key. Keys that occur once can't hold a repeated window: a bit table of keys met twice drops most of them.
3. Runs that stay go, with the text that their windows span, to the shard of their key, equal ones counted by each task
   first; the shard's index decides for each window whether it starts anywhere else.
4. Decisions join back to the documents' runs, and covered symbols are removed.

A hot passage meets as few rows (tasks dedupe runs, and windows that stick out of it have rarer anchors than its own);
decisions join by key and content, a join whose hot keys Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quefrency.llm.kernels import BYTE, MULT, flat, grams, mix, powers, slices, sliding_min, span_hashes, words
from quefrency.llm.scratch import keep
from quefrency.llm.sketch import SKETCH_BITS, frequency_classes, maybe_twice, twice_seen

#: Bits that an anchor's place takes in the packed order, and windows that one pass takes of a very long text.
PLACE, PASS = np.uint64(26), 1 << 25
#: Symbols of the runs that a shard indexes at once (whole keys, so possibly more).
SHARD_SYMBOLS = 1 << 19
#: Bytes of runs that a task holds for counting before it sends them on.
HELD_BYTES = 1 << 24


@dataclass(frozen=True)
class Kind:
    """Windows of `window` symbols, anchored by `gram`-grams; runs of at most `cut` windows, which divides window - gram + 1."""

    name: str
    window: int
    gram: int
    cut: int

    def __post_init__(self):
        if (self.window - self.gram + 1) % self.cut:
            raise ValueError("cut must divide the number of grams in a window")

    def symbols(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value for each symbol of the texts, and each text's first symbol."""
        data, offsets = flat(column)
        if self.name == "bytes":
            return BYTE[data], offsets
        starts, ends, first = words(data, offsets)
        return span_hashes(data, starts, ends), first

    def stretches(self, column: pa.Array, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The texts' own bytes from symbol `begin` to before symbol `end`."""
        data, offsets = flat(column)
        if self.name != "bytes":
            starts, ends, _ = words(data, offsets)
            begin, end = starts[begin], ends[end - 1]
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def exact(self, stretches: list[bytes]) -> np.ndarray:
        """A number for each symbol of the stretches end to end, the same for equal symbols only: the byte, or the word's
        place in a dictionary of the words themselves."""
        if self.name == "bytes":
            return np.frombuffer(b"".join(stretches), np.uint8)
        split = pc.ascii_split_whitespace(pa.array(stretches, pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
        return split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)

    def runs(self, h: np.ndarray, first: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, start, windows, core hash and content hash of every run."""
        w, n = self.window - self.gram + 1, len(h) - self.window + 1
        parts: list[tuple[np.ndarray, ...]] = []
        ok = np.diff(first) >= self.window
        if n <= 0 or not ok.any():
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        g = grams(h, self.gram)
        order = (classes[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (((g >> np.uint64(8)) & np.uint64((1 << 32) - 1)) << PLACE)
        up, down = powers(len(h) + 1)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        inside = np.zeros(n + 1, np.int8)  # windows that cross into the next text are none
        np.add.at(inside, first[:-1][ok], 1)
        np.add.at(inside, first[1:][ok] - self.window + 1, -1)
        inside = np.cumsum(inside, dtype=np.int8)[:n].astype(bool)
        for base in range(0, n, PASS):
            m = min(PASS, n - base)
            place = base + (sliding_min(order[base : base + m + w - 1] | np.arange(m + w - 1, dtype=np.uint64), w) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
            here = inside[base : base + m]
            offset = (place - np.arange(base, base + m)) // self.cut
            tag = place * (w // self.cut) + offset
            edge = np.flatnonzero(np.diff(tag) | np.diff(here.view(np.int8)) != 0) + 1
            a = np.concatenate([[0], edge])
            b = np.concatenate([edge, [m]])
            own = here[a]
            a, b = a[own], b[own]
            p, o = place[a], offset[a]
            parts.append((base + a, b - a, p - o * self.cut, p - (o + 1) * self.cut + 1 + self.window))
        start, size, core_a, core_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        text = np.searchsorted(first, start, "right") - 1
        # A run that a text's end splits from another text's is cut there: equal tags never span two texts, since an anchor lies inside.
        core = mix((total[core_b] - total[core_a]) * down[core_a])
        end = start + size - 1 + self.window
        content = mix((total[end] - total[start]) * down[start] * MULT + size.astype(np.uint64))
        return text, start - first[text], size, core, content


def _parts(batch: pa.RecordBatch, kind: Kind) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, 0):
        yield part, *kind.symbols(part.column(0))


def repeated_runs(docs: DataFrame, kind: Kind, decide: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, text_hash, runs (array of start, size, hit): for each text with repeated windows, packed bits of which of the
    windows start .. start + size are repeated. docs has text, doc_id, text_hash."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs.select("text"), lambda b: (grams(h, kind.gram) for _, h, _ in _parts(b, kind))))
    core = lambda b: (kind.runs(h, first, classes.value)[3] for _, h, first in _parts(b, kind))
    table = spark.sparkContext.broadcast(twice_seen(docs.select("text"), core))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "start", "size", "core", "content", "n", "cells"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        count: dict[tuple[int, int], list] = {}
        held = 0

        def flush():
            rows = [(None, None, None, v[1], *k, v[0], v[2]) for k, v in count.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            count.clear()

        for batch in batches:
            for part, h, first in _parts(batch, kind):
                text, start, size, key, content = kind.runs(h, first, classes.value)
                at = np.flatnonzero(maybe_twice(table.value, key))
                if not len(at):
                    continue
                text, start, size, key, content = (x[at] for x in (text, start, size, key.view(np.int64), content.view(np.int64)))
                own = [part.column(c).take(pa.array(text)) for c in (1, 2)]
                none = lambda t: pa.nulls(len(at), t)
                yield pa.RecordBatch.from_arrays([*own, pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(key), pa.array(content), none(pa.int32()), none(pa.binary())], names)
                fresh = []
                for i, k in enumerate(zip(key.tolist(), content.tolist(), strict=True)):
                    if (v := count.get(k)) is not None:
                        v[0] += 1
                    else:
                        count[k] = [1, int(size[i]), b""]
                        fresh.append((i, k))
                new = np.array([i for i, _ in fresh], np.int64)
                begin = first[text[new]] + start[new]
                for (_, k), x in zip(fresh, kind.stretches(part.column(0), begin, begin + size[new] - 1 + kind.window), strict=True):
                    count[k][2] = x
                    held += len(x)
                if held >= HELD_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    schema = "doc_id long, text_hash long, start int, size int, core long, content long, n int, cells binary"
    found = keep(docs.select("text", "doc_id", "text_hash").mapInArrow(run, schema))
    shards = found.where("cells is not null").select("core", "content", "size", "n", "cells").repartition("core").sortWithinPartitions("core", "content")
    hits = shards.mapInArrow(lambda batches: _decided(batches, kind, decide), "core long, content long, hit binary")
    runs = found.where("cells is null").select("doc_id", "text_hash", "start", "size", "core", "content")
    own = runs.join(hits, ["core", "content"])
    return own.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "size", "hit")).alias("runs"))


def _decided(batches: Iterator[pa.RecordBatch], kind: Kind, decide) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by core and content; whole cores are decided together, about SHARD_SYMBOLS at a time."""
    core: list[int] = []
    content: list[int] = []
    times: list[int] = []
    cells: list[bytes] = []
    sizes: list[int] = []
    held = 0

    def flush():
        n = np.array(times)
        key = np.array(core, np.int64)
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        alone = np.bincount(group, weights=n)[group] < 2  # an unlucky bit of the table
        live = np.flatnonzero(~alone)
        if len(live):
            size = np.array([sizes[i] for i in live])
            hit = decide(kind.exact([cells[i] for i in live]), size, group[live], n[live])
            ends = np.cumsum(size)
            out = [(core[i], content[i], np.packbits(hit[b - s : b]).tobytes()) for i, s, b in zip(live.tolist(), size.tolist(), ends.tolist(), strict=True) if hit[b - s : b].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["core", "content", "hit"])
        for x in (core, content, times, cells, sizes):
            x.clear()

    for batch in batches:
        for k, c, z, n, x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if core and core[-1] == k and content[-1] == c:
                times[-1] += n
                continue
            if held >= SHARD_SYMBOLS and core[-1] != k:
                yield from flush()
                held = 0
            core.append(k)
            content.append(c)
            times.append(n)
            cells.append(x)
            sizes.append(z)
            held += z - 1 + kind.window
    if core:
        yield from flush()


def removed_mask(n: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """Which of n symbols the repeated windows cover."""
    if not runs:
        return np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int64)
    for r in runs:
        i = r["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(r["hit"], np.uint8))[: r["size"]])
        np.add.at(delta, i, 1)
        np.add.at(delta, i + window, -1)
    return np.cumsum(delta)[:n] > 0


def cleaned(docs: DataFrame, kind: Kind, decide, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept (binary), kept_sha256: each row's text without covered symbols, as joined bytes or
    words. carry: with the row itself, as a struct `row`."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(None).cast("boolean")
    own = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), row.alias("row"))
    found = repeated_runs(own, kind, decide)
    both = own.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left").select("d.doc_id", "d.text", "f.runs", "d.row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for key, text, runs in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                    data = (text.as_py() or "").encode()
                    if kind.name == "bytes":
                        n, cut = len(data), removed_mask(len(data), runs, kind.window)
                        kept = np.frombuffer(data, np.uint8)[~cut].tobytes() if runs else data
                    else:
                        own = data.split()  # at ASCII white space, as words() does
                        n, cut = len(own), removed_mask(len(own), runs, kind.window)
                        kept = b" ".join(compress(own, (~cut).tolist()) if runs else own)
                    spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n and runs else 0
                    out.append((key, n, int(cut.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
                cells = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*cells, part.column(3)], [*names, "row"])

    names = ["doc_id", "n", "n_removed", "n_spans", "kept", "kept_sha256"]
    kinds = [LongType()] * 4 + [BinaryType(), StringType()]
    schema = StructType([*(StructField(n, t) for n, t in zip(names, kinds, strict=True)), StructField("row", both.schema["row"].dataType)])
    out = both.mapInArrow(run, schema)
    return out if carry else out.drop("row")


def rewritten(docs: DataFrame, kind: Kind, decide, id_col: str, text_col: str, length_col: str | None = None) -> DataFrame:
    """The rows with their text after removal, and its length in characters in length_col. Untouched texts stay as they
    are; rows that removal leaves without text go."""
    x = cleaned(docs, kind, decide, id_col, text_col, carry=True).where("n_removed = 0 or n_removed < n")
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("row")[text_col])
    own = {text_col: text} | ({length_col: F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row")[length_col]).cast(docs.schema[length_col].dataType)} if length_col else {})
    return x.select(*(own.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
