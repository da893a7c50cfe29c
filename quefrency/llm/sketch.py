"""Corpus-wide tables of bounded size that tasks look hashes up in: frequency classes, and which keys occur twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the frequency sketch and of one of its blocks, as powers of two.
SKETCH_BITS, BLOCK_BITS = 20, 14
#: Bits of a twice-seen table at most, as a power of two (16 MB): a larger corpus only filters less.
TABLE_BITS = 27
#: Keys that a task holds before it deals them out.
HELD_KEYS = 1 << 22


def frequency_classes(docs: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """For each value of a hash's first SKETCH_BITS bits a class: 0 for common background, k where the bits hold about 2**k
    times four mean loads. Every hash of the corpus is counted; the table has the same size for every corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for h in hashes(batch):
                count += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(count))
        if count.any():
            rows = count.astype(np.uint32).reshape(-1, 1 << BLOCK_BITS)
            z = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([z.compress(r.tobytes()) for r in rows], pa.binary())], ["block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor().decompress
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(unzip(x), np.uint32)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "counts": [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]})

    sums = docs.mapInArrow(run, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary")
    total = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for r in sums.collect():  # 64 rows of bounded size
        total[r["block"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.int64)
    total = total.ravel()
    return np.log2(np.maximum(total / (4 * max(1.0, total.mean())), 1)).astype(np.uint8)


def buckets_for(frame: DataFrame) -> int:
    """Key ranges to deal out: a power of two that grows with the cluster's number of shuffle partitions."""
    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(5, (2 * n - 1).bit_length())


class Dealer:
    """Collects a task's keys and deals them out by key range: one row a range, with the keys met once and those met again."""

    def __init__(self, buckets: int):
        self.shift, self.buckets, self.held, self.size = np.uint64(65 - buckets.bit_length()), buckets, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.size += len(keys)
        if self.size >= HELD_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, n = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        cut = np.searchsorted(keys >> self.shift, np.arange(self.buckets + 1, dtype=np.uint64))
        once = [keys[a:b][n[a:b] == 1].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        again = [keys[a:b][n[a:b] > 1].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(self.buckets), pa.int32()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["bucket", "once", "again"])


def twice_seen(docs: DataFrame, keys: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """A bit table that holds every key (by its first bits) that occurs at least twice in the corpus, and few others."""
    buckets = buckets_for(docs)
    own = max(10, TABLE_BITS - (buckets.bit_length() - 1))  # bits of a bucket's share, as a power of two
    own = min(own, 18)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for batch in batches:
            for k in keys(batch):
                yield from dealer.add(k)
        yield from dealer.flush()

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        all_ = np.sort(np.frombuffer(b"".join(rows["once"]) + b"".join(a := rows["again"]) + b"".join(a), np.uint64))
        found = all_[1:][all_[1:] == all_[:-1]]
        bits = np.zeros(1 << own, np.uint8)
        bits[table_index(found, buckets, own) & ((1 << own) - 1)] = 1
        return pd.DataFrame({"bucket": [int(rows["bucket"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((buckets, (1 << own) // 8), np.uint8)
    for r in docs.mapInArrow(run, "bucket int, once binary, again binary").groupBy("bucket").applyInPandas(mark, "bucket int, bits binary").toLocalIterator():
        table[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)  # 2**TABLE_BITS bits in all, or 1 KB a bucket
    return table


def table_index(keys: np.ndarray, buckets: int, own: int) -> np.ndarray:
    """Bit of each key: its first bits, of which the bucket's come first."""
    return (keys >> np.uint64(64 - own - (buckets.bit_length() - 1))).astype(np.int64)


def maybe_twice(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that occur once."""
    at = table_index(keys, table.shape[0], (table.shape[1] * 8).bit_length() - 1)
    return (table.reshape(-1)[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
