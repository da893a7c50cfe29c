"""Ranked lexical search by pipelined term partitioning: each item's bundle passes the owners of its terms one after the
other and carries a sparse accumulator of document scores along.

Documents lie in blocks of bounded size, each with an inverted list for each term. Terms belong to owners by how many
documents hold them, the rarest first. A stage is one cogroup by block: the bundles meet the lists of that stage's owner,
which adds integer contributions. A bundle then drops documents that can no longer reach a place among the first `k` of
their block: the k-th best score so far, against a document's score and the most that all later owners could add. What
is dropped has k better documents, so the result is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quefrency.llm.decontamination import words_of
from quefrency.llm.kernels import slices
from quefrency.llm.licenses import WORD
from quefrency.llm.scratch import keep

#: Documents and postings at which a block is full; one more document may be in it.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 22
#: Distinct item terms and their bytes up to which they are sent to the tasks that read documents; beyond, lists of all terms are written and joined with the items' terms.
SENT_TERMS, SENT_BYTES = 1 << 17, 1 << 22
#: Terms of items that meet a block at once, on average.
PART_TERMS = 1 << 16
#: No document earns as much for one unit of a term's weight.
UNIT = 10**6
INDEX = "block long, term string, slots array<int>, counts array<int>, ids array<long>, docs long, words long"
BUNDLE = "block long, part int, q long, item_id {kind}, terms array<string>, gains array<long>, owners array<int>, slots array<int>, scores array<long>"


def _lists(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    a = column.combine_chunks()
    values, at = a.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), a.offsets.to_numpy()
    return np.split(values, at[1:-1] - at[0]) if len(a) else []


def _ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else [], kind))


def block_index(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of documents: for each term of a block, slots (places of the documents in it) and counts; and a row without
    a term, whose counts are the documents' terms with repeats and whose ids their ids. Only `terms`, if they are given."""
    sent = None if terms is None else sorted(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, postings = (TaskContext.get().partitionId() << 32), 0, 0
        fixed = None if sent is None else {w: n for n, w in enumerate(sent)}
        ids, sizes, found = [], [], []
        known = fixed

        def flush() -> pa.RecordBatch:
            names = sent if sent is not None else list(known)
            # By term, then document: one number each, and how often it comes.
            at, counts = np.unique(np.concatenate(found), return_counts=True)
            term, slot = at // (1 << 24), at % (1 << 24)
            cut = np.flatnonzero(np.diff(term, prepend=-1))
            held = [names[t].decode("utf-8", "replace") for t in term[cut].tolist()]
            ends = np.append(cut, len(at)).astype(np.int32)
            n, none = len(held), pa.nulls(1, pa.list_(pa.int64()))
            listed = lambda x: pa.concat_arrays([pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())), pa.array([None], pa.list_(pa.int32()))])
            counted = pa.concat_arrays([pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())), pa.array([sizes], pa.list_(pa.int32()))])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, first + made)), pa.array([*held, None], pa.string()), listed(slot), counted, pa.concat_arrays([pa.nulls(n, none.type), pa.array([ids], none.type)]),
                 pa.array([0] * n + [sum(x > 0 for x in sizes)], pa.int64()), pa.array([0] * n + [sum(sizes)], pa.int64())],
                ["block", "term", "slots", "counts", "ids", "docs", "words"],
            )

        for batch in batches:
            for part in slices(batch, 1, 1 << 22):
                for key, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1).cast(pa.large_binary()), b"").to_pylist(), strict=True):
                    if known is None:
                        known = defaultdict(lambda: len(known))
                    own = text.translate(WORD).split()
                    number = np.fromiter(map(known.get, own, (-1,) * len(own)) if fixed is not None else map(known.__getitem__, own), np.int64, len(own))
                    found.append(number[number >= 0] * (1 << 24) + len(ids))
                    postings += len(found[-1])
                    ids.append(key)
                    sizes.append(len(own))
                    if len(ids) >= block_docs or postings >= BLOCK_POSTINGS:
                        yield flush()
                        made, known, postings = made + 1, fixed, 0
                        ids.clear(), sizes.clear(), found.clear()
        if ids:
            yield flush()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, INDEX)


def _visit(owner: int, k: int, n_docs: int, n_words: int, carried: pa.Schema, top: pa.Schema | None):
    """What an owner does with the bundles of a block; the last one returns their best documents, in the form of `top`."""
    empty = (top or carried).empty_table()

    def run(bundles: pa.Table, lists: pa.Table) -> pa.Table:
        names = lists.column("term").to_pylist()
        if not bundles.num_rows or None not in names:
            return empty
        head = names.index(None)
        ids, slots, counts = lists.column("ids")[head].as_py(), _lists(lists.column("slots"), np.int64), _lists(lists.column("counts"), np.int64)
        # As whole numbers of any size, since terms x documents may pass 64 bits on the way.
        m = np.array([25 + 75 * n * n_docs // n_words for n in counts[head].tolist()], np.int64)
        units = {t: (s, 10**9 * c // (1000 * c + 8 * m[s])) for t, s, c in zip(names, slots, counts, strict=True) if t is not None}
        score, out = np.zeros(len(ids), np.int64), []
        held = zip(bundles.column("q").to_pylist(), bundles.column("item_id").to_pylist(), bundles.column("terms").to_pylist(), _lists(bundles.column("gains"), np.int64), _lists(bundles.column("owners"), np.int64), _lists(bundles.column("slots"), np.int64), _lists(bundles.column("scores"), np.int64), strict=True)
        for q, item, terms, gains, owners, places, scores in held:
            score[:] = 0
            score[places] = scores
            for n in np.flatnonzero(owners == owner).tolist():
                if terms[n] in units:
                    at, unit = units[terms[n]]
                    score[at] += gains[n] * unit
            later = owners > owner
            at = np.flatnonzero(score)
            if len(at) > k:
                now = score[at]
                at = at[now + UNIT * int(gains[later].sum()) >= np.partition(now, len(at) - k)[len(at) - k]]
            if top:
                # The best k by score, then id; null ids come last.
                best = sorted(at.tolist(), key=lambda i: (-score[i], ids[i] is None, ids[i] or 0))[:k]
                out += [(q, item, ids[i], int(score[i])) for i in best]
            else:
                out.append((q, item, [t for t, x in zip(terms, later.tolist(), strict=True) if x], gains[later], owners[later], at, score[at]))
        if not out:
            return empty
        cells = list(zip(*out, strict=True))
        if top:
            return pa.table([pa.array(c, f.type) for c, f in zip(cells, top, strict=True)], schema=top)
        same = [pa.array([bundles.column(c)[0].as_py()] * len(out), carried.field(c).type) for c in ("block", "part")]
        plain = [pa.array(c, carried.field(f).type) for c, f in zip(cells[:3], ("q", "item_id", "terms"), strict=True)]
        ragged = [_ragged(list(c), carried.field(f).type.value_type) for c, f in zip(cells[3:], ("gains", "owners", "slots", "scores"), strict=True)]
        return pa.table([*same, *plain, *ragged], schema=carried)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, owners: int = 4, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS, sent_terms: int = SENT_TERMS, part_terms: int = PART_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each row of items, best first and
    ties by id (null last).

    Null and empty texts have no terms: such documents are never found and do not count, such items find nothing. Each
    row counts for itself, repeated ones too; rows of items that share an id are searched each and rank from 1 each. An
    empty table on either side gives no rows. Whole texts count, whatever their length. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = items.select(F.col(f"`{item_col}`").alias("item_id"), words_of(F.col(f"`{item_text_col}`")).alias("w")).where(F.size("w") > 0)
    own = keep(own.withColumn("q", F.monotonically_increasing_id()))
    asked = own.select("q", "item_id", F.explode("w").alias("term")).groupBy("q", "item_id", "term").agg(F.count("*").alias("times"))
    size = asked.agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    kind = own.schema["item_id"].dataType.simpleString()
    result = f"item_id {kind}, rank int, doc_id long, score long"
    if not size["n"]:
        return spark.createDataFrame([], result)
    few = size["terms"] <= sent_terms and size["bytes"] <= SENT_BYTES
    known = {r["term"].encode() for r in asked.select("term").distinct().collect()} if few else None
    index = keep(block_index(docs, known, id_col, text_col, block_docs))
    total = index.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = int(total["docs"] or 0), int(total["words"] or 0)
    if not n_docs:
        return spark.createDataFrame([], result)
    wanted = asked.select("term").distinct()
    lists = index.where("term is not null").join(F.broadcast(wanted) if few else wanted, "term")
    df = lists.groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    # Owners by eighths: the last one has the terms that over an eighth of all documents hold, the one before those of over a 64th, and so on.
    rarity = F.floor(F.log(8.0, F.lit(float(n_docs)) / F.col("df")))
    terms = keep(df.select("term", w.alias("w"), F.greatest(F.lit(0), F.lit(owners - 1) - rarity).cast("int").alias("owner")))
    parts = -(-size["n"] // part_terms)
    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")
    held = asked.join(terms, "term").groupBy("q", "item_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("w")).alias("gain"), "owner")).alias("t"))
    none = lambda t: F.array().cast(f"array<{t}>")
    bundles = held.select(part.alias("part"), "q", "item_id", F.col("t.term").alias("terms"), F.col("t.gain").alias("gains"), F.col("t.owner").alias("owners"), none("int").alias("slots"), none("long").alias("scores"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    heads = index.where("term is null")
    columns = [f.split()[0] for f in BUNDLE.split(", ")]
    flow = heads.select(F.col("block").alias("block"), every).join(bundles, "part").select(*columns)
    marked = lists.join(F.broadcast(terms) if few else terms, "term")
    long, item = pa.int64(), own.select("item_id").limit(0).toArrow().schema.field(0).type
    kinds = [long, pa.int32(), long, item, pa.list_(pa.string()), pa.list_(long), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(long)]
    carried, top = pa.schema(list(zip(columns, kinds, strict=True))), pa.schema([("q", long), ("item_id", item), ("doc_id", long), ("score", long)])
    for owner in range(owners):
        mine = marked.where(F.col("owner") == owner).select("block", "term", "slots", "counts", "ids").union(heads.select("block", "term", F.coalesce("slots", none("int")), "counts", "ids"))
        right = mine.select(F.col("block").alias("block"), every, "term", "slots", "counts", "ids")
        last = owner == owners - 1
        visit = _visit(owner, k, n_docs, n_words, carried, top if last else None)
        flow = flow.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(visit, f"q long, item_id {kind}, doc_id long, score long" if last else BUNDLE.format(kind=kind))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return flow.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
