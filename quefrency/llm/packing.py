"""Packing of documents into training sequences: vector bin packing by dot products.

A sequence holds at most `max_tokens` tokens, `max_segments` pieces and `max_loss` loss-bearing tokens. Each task packs
its own partition, in blocks: it always adds the piece whose demand has the largest dot product with what the open
sequence has left, and when no piece fits whole, it cuts one to fill the sequence. A sequence that another limit closes
before it is full, and what is left at the end of a partition, is cut at powers of two, so that none needs padding. No
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.tokens import MEMO_PIECES, crc, encoded

#: Pieces from which the next one is chosen.
BLOCK = 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


class Packer:
    """The open sequence and the waiting pieces of one task. `emit` gets (document, start, length, sequence, offset, loss)."""

    def __init__(self, limits: tuple[int, int, int], emit, first: int = 0):
        self.limits, self.emit, self.sequence = np.array(limits, np.int64), emit, first
        self.doc, self.start = [None] * (2 * BLOCK), np.zeros(2 * BLOCK, np.int64)
        self.need = np.zeros((2 * BLOCK, 3), np.int64)  # tokens, segments, loss of what is left of a piece
        self.skip = np.zeros(2 * BLOCK, np.int64)  # ids of the piece before its first loss-bearing one
        self.n, self.left, self.held = 0, self.limits.copy(), []

    def add(self, doc, start: int, length: int, skip: int) -> None:
        """Put ids start .. start + length of a document, of which the first `skip` bear no loss; full sequences go at once."""
        while length:
            take = int(min(length, self.limits[0], skip + self.limits[2]))
            if take < length or take == self.limits[0]:
                self.emit(doc, start, take, self.sequence, 0, max(0, take - skip))
                self.sequence += 1
            else:
                i, self.n = self.n, self.n + 1
                self.doc[i], self.start[i], self.skip[i], self.need[i] = doc, start, skip, (take, 1, max(0, take - skip))
            start, length, skip = start + take, length - take, max(0, skip - take)
        if self.n >= BLOCK:
            self.run(BLOCK // 2)

    def run(self, until: int) -> None:
        while self.n > until:
            need = self.need[: self.n]
            score = need @ (self.left / self.limits.astype(float) ** 2)
            fits = (need <= self.left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(need[i, 0])
            elif self.left[1] and (room := np.minimum(np.minimum(self.left[0], self.skip[: self.n] + self.left[2]), need[:, 0])).max():
                i = int(np.argmax(np.where(room > 0, score, -1.0)))
                take = int(room[i])
            else:
                self.close_short()
                continue
            loss = max(0, take - int(self.skip[i]))
            self.held.append((self.doc[i], int(self.start[i]), take, loss))
            self.left -= (take, 1, loss)
            if take == need[i, 0]:
                self.n -= 1
                last = self.n
                self.doc[i], self.start[i], self.skip[i], self.need[i] = self.doc[last], self.start[last], self.skip[last], self.need[last]
            else:
                self.start[i] += take
                self.skip[i] = max(0, self.skip[i] - take)
                self.need[i, 0] -= take
                self.need[i, 2] -= loss
            if not self.left[0]:
                self.close()

    def close(self, cuts: tuple[int, ...] = ()) -> None:
        """End the open sequence; with `cuts`, as sequences of those lengths."""
        room, at = list(cuts) or [int(self.limits[0])], 0
        for doc, start, length, loss in self.held:
            while length:
                take = min(length, room[0] - at)
                own = max(0, take - (length - loss))
                self.emit(doc, start, take, self.sequence, at, own)
                start, length, loss, at = start + take, length - take, loss - own, at + take
                if at == room[0] and len(room) > 1:
                    room, at, self.sequence = room[1:], 0, self.sequence + 1
        self.sequence += bool(self.held)
        self.held, self.left = [], self.limits.copy()

    def close_short(self) -> None:
        """End an open sequence that is not full, as sequences of powers of two."""
        used = int(self.limits[0] - self.left[0])
        self.close(tuple(1 << k for k in reversed(range(used.bit_length())) if used >> k & 1))

    def finish(self) -> None:
        self.run(0)
        self.close_short()


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, max_segments: int = 128, max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_tokens_col: str | None = None, with_ids: bool = False, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens (and ids, if asked for).

    The first `prompt_tokens_col` ids of a document bear no loss (null or no column: all bear loss). Null text is empty
    and packs as the end id alone; null ids stay null; repeated rows are packed each; an empty table gives no rows. Texts
    of any length are cut freely, and each id lies in exactly one piece. Other columns are ignored, whatever their names.
    A limit under 1 is an error, since nothing could be packed; without `max_loss` there is no limit on loss-bearing tokens.
    memo_pieces: encoded pieces that a worker remembers (twice that at most); it changes time and memory, not results.
    """
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("limits of a sequence must be at least 1")
    columns = COLUMNS + ["ids"] * with_ids
    types = [pa.int64()] * len(COLUMNS) + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def emit(doc, start, length, sequence, offset, loss):
            key, ids = doc
            part = ids[4 * start : 4 * (start + length)]
            rows.append((key, start, length, crc(part), len(ids) // 4, sequence, offset, loss, part)[: len(columns)])

        packer = Packer(limits, emit, (TaskContext.get().partitionId() << 36))
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)
        for part, ids in encoded(batches, tokenizer, memo_pieces):
            for key, prompt, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), ids, strict=True):
                packer.add((key, own), 0, len(own) // 4, min(max(prompt or 0, 0), len(own) // 4))
            if rows:
                yield out()
                rows.clear()
        packer.finish()
        if rows:
            yield out()

    prompt = F.col(prompt_tokens_col).cast("long") if prompt_tokens_col else F.lit(0).cast("long")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt"))
    return picked.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)
