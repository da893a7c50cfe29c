"""Benchmark decontamination with DataFrame operations only: a hash set of the test items' normalised word windows is
joined with the word windows of whole training texts; each hit is verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quefrency.llm.scratch import keep

#: Words of a window.
WINDOW = 10
#: Distinct windows up to which the test side is broadcast (about 150 bytes each); beyond it hashes are shuffled instead.
BROADCAST_WINDOWS = 200_000
#: Everything between words, after A-Z became a-z: ASCII but for digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case. Null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, GAP), "")


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: size, hash, gram (its words) and items (sorted ids that hold it)."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    size = F.least(F.size("w"), F.lit(width))
    each = w.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    each = each.select("item", "size", F.expr("slice(w, at, size)").alias("gram"))
    return each.groupBy("size", "gram").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("gram"))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row for each document row: doc_id, n_words, hits (array of start, size, sorted by start), items (sorted ids), and row, a struct of the columns in `carry`.

    Null and empty texts have no words and no hits; repeated rows and null ids keep a row each; items without words or
    without an id have no windows; repeated items count once by id; an empty table of items hits nothing. Columns of the
    documents other than id and text are ignored, so clashing names do no harm. Texts of any length are scanned whole.
    """
    grams = item_windows(items, item_col, item_text_col, width)
    # At most `width` sizes, and a count: two small actions on the test side, which decide how the join is done.
    seen = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sizes = sorted(seen) or [width]
    small = sum(seen.values()) <= BROADCAST_WINDOWS
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("carry")).withColumn("row", F.monotonically_increasing_id())
    # The shuffled way reads the rows twice, so their numbers are written down first.
    d = (d if small else keep(d)).withColumn("w", words_of(F.col("text")))
    # A null word behind the last one stands for the row itself, so that rows without hits stay.
    x = d.select("row", "doc_id", "w", "carry", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "word")).drop("word")
    if len(sizes) == 1:
        x = x.withColumn("n", F.lit(sizes[0]))
    else:
        x = x.withColumn("n", F.explode(F.array(*map(F.lit, sizes))))
    whole = F.col("pos") + F.col("n") <= F.size("w")
    x = x.withColumn("h", F.when(whole, F.xxhash64(F.expr("slice(w, pos + 1, n)"))))
    g = grams.select("size", "hash", "gram", F.array_sort("items").alias("found"))
    same = (F.col("h") == F.col("hash")) & (F.col("n") == F.col("size"))
    if small:
        hit = x.join(F.broadcast(g), same & (F.expr("slice(w, pos + 1, n)") == F.col("gram")), "left").where(F.col("found").isNotNull() | (F.col("pos") == F.size("w")))
        hit = hit.select("row", "doc_id", F.size("w").alias("n_words"), F.when(F.col("found").isNotNull(), F.struct(F.col("pos").alias("start"), F.col("n").alias("size"))).alias("hit"), "found", F.when(F.col("pos") == F.size("w"), F.col("carry")).alias("carry"))
        # All rows of a document are in one task already, so this meets in the map-side half of the aggregation.
        out = hit.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.collect_set("found").alias("found"), F.first("carry", ignorenulls=True).alias("carry"))
    else:
        # Only numbers are shuffled for each place; the words of the few that meet a hash are verified at the row.
        met = x.where("h is not null").select("row", "pos", "n", "h").join(g, same).groupBy("row").agg(F.collect_list(F.struct(F.col("pos").alias("start"), F.col("n").alias("size"), "gram", "found")).alias("met"))
        true = F.filter("met", lambda m: F.slice("w", m["start"] + 1, m["size"]) == m["gram"])
        some = lambda f: F.coalesce(F.transform(true, f), F.array())
        out = d.join(met, "row", "left").select("doc_id", F.size("w").alias("n_words"), some(lambda m: F.struct(m["start"].alias("start"), m["size"].alias("size"))).alias("hits"), some(lambda m: m["found"]).alias("found"), "carry")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.array_sort("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten("found"))).alias("items"), *([F.col("carry").alias("row")] if carry else []))


def spans(hits: Column) -> Column:
    """Sorted hits merged into maximal, disjoint (start, end) word spans."""
    start = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc, h):
        last = F.element_at(acc, -1)
        end = h["start"] + h["size"]
        open_ = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        joins = (F.size(acc) > 0) & (h["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(open_))).otherwise(F.concat(acc, F.array(F.struct(h["start"].alias("start"), end.alias("end")))))

    # element_at fails on an empty array under ANSI rules, so the first hit is put in by hand.
    first = F.element_at(hits, 1)
    begin = F.array(F.struct(first["start"].alias("start"), (first["start"] + first["size"]).alias("end")))
    return F.when(F.size(hits) == 0, start).otherwise(F.aggregate(F.slice(hits, 2, F.greatest(F.size(hits), F.lit(1))), begin, merge))


def covered(hits: Column) -> Column:
    """Words inside any hit; hits are sorted by start."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, h):
        end = h["start"] + h["size"]
        more = F.greatest(end - F.greatest(acc["end"], h["start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(hits, state, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """find_hits() with n_hit, n_items and contaminated."""
    x = find_hits(docs, items, **columns)
    return x.select("*", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "document", **columns) -> DataFrame:
    """The documents without contamination: `document` drops contaminated ones; `span` cuts hit words and joins the rest by blanks.

    All columns of docs stay. Each row is judged by its own text, so ids may be null or repeated. Span mode writes the
    normalised words of documents that were hit and leaves others untouched.
    """
    x = find_hits(docs, items, id_col=id_col, text_col=text_col, carry=docs.columns, **columns)
    if mode == "document":
        return x.where(F.size("hits") == 0).select(*(F.col("row")[c].alias(c) for c in docs.columns))
    x = x.withColumn("spans", spans(F.col("hits")))
    text = F.col("row")[text_col]
    kept = F.filter(words_of(text), lambda w, i: ~F.exists(F.col("spans"), lambda s: (i >= s["start"]) & (i < s["end"])))
    cut = F.when(F.size("hits") == 0, text).otherwise(F.array_join(kept, " "))
    return x.select(*((cut if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
