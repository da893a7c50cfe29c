"""Language ID by error-correcting output codes.

Each language gets a codeword; each bit has a binary classifier over hashed byte n-grams (log-odds of the languages whose
bit is 1 against the rest), so that training is one grouped count over all labelled text. Decoding weights each bit's
logistic loss by the training separation of its classifier (the distance of its two sides' mean margins in standard
deviations), takes the nearest codeword, and flags a near tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.kernels import flat, slices

#: Hash buckets of the n-grams, as a power of two, and bytes of an n-gram.
BITS, SIZE = 14, 3
#: Share of the loss between the two nearest codewords below which a prediction is ambiguous.
AMBIGUOUS = 0.02
#: Deviations of its nearest language's training texts by which a text's n-grams must be rarer to be in no learned language.
FAR = 10.0
UNKNOWN = "und"
#: Letters by Unicode category: numerals such as fractions or Roman ones are none.
_LETTER = regex.compile(r"\p{L}")
#: Bucket of n-grams without letters, which tell nothing of a language.
_BLANK = int(np.uint32(0x202020 * 2654435761 & 0xFFFFFFFF) >> np.uint32(32 - BITS))
#: ASCII that is no letter counts as a blank.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte of the lower-cased texts, and each text's first byte. N-grams that reach into the next text count as blank."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    x = np.concatenate([_FOLD[data], np.full(SIZE - 1, 32, np.uint32)])
    code = np.zeros(len(data), np.uint32)
    for j in range(SIZE):
        code = code << np.uint32(8) | x[j : j + len(data)]
    for j in range(1, SIZE):
        cross = offsets[1:] - j
        code[cross[(cross >= 0) & (cross >= offsets[:-1])]] = 0x202020
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), offsets


def log_rates(counts: np.ndarray) -> np.ndarray:
    """Log of each language's rate of each bucket but the blank one, which is 0."""
    c = counts.astype(float)
    c[..., _BLANK] = 0
    out = np.log((c + 0.5) / (c.sum(axis=-1, keepdims=True) + 0.5 * (1 << BITS)))
    out[..., _BLANK] = 0
    return out


def rarity(column: pa.Array, of: np.ndarray, rates: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How far the mean log-rate of each text's n-grams is below what is usual in its language `of`, scaled by length as margins are; 0 without n-grams."""
    bucket, offsets = gram_buckets(column)
    size = np.diff(offsets)
    told = bucket != _BLANK
    total, n = np.zeros(len(bucket) + 1), np.zeros(len(bucket) + 1)
    np.cumsum(rates[np.repeat(of, size), bucket], out=total[1:])
    np.cumsum(told, out=n[1:])
    n = n[offsets[1:]] - n[offsets[:-1]]
    mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
    return (usual[of] - mean) * np.sqrt(np.minimum(n, 400))


def codewords(n: int) -> np.ndarray:
    """A codeword of +1 and -1 for each of n languages: one bit a language, and the bits of a shuffled numbering both ways, so that words differ in several places."""
    one = 2 * np.eye(n, dtype=int) - 1
    rng, extra = np.random.default_rng(n), []
    for _ in range(max(3, 2 * int(np.ceil(np.log2(max(n, 2)))))):
        row = np.where(rng.permutation(n) < n / 2, 1, -1)
        if abs(row.sum()) < n:
            extra.append(row)
    return np.column_stack([one, *extra]) if n > 1 else one


@dataclass
class Model:
    """languages; code (languages x bits); weights (buckets x bits); trust in each bit's vote, of sum 1;
    log-rates (languages x buckets); usual mean log-rate and limit of rarity() of each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    rates: np.ndarray
    usual: np.ndarray
    limit: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """Mean log-odds of each text's n-grams, for each bit."""
        bucket, offsets = gram_buckets(column)
        total = np.zeros((len(bucket) + 1, self.code.shape[1]), np.float64)
        np.cumsum(self.weights[bucket], axis=0, out=total[1:])
        size = np.maximum(np.diff(offsets), 1)[:, None]
        return (total[offsets[1:]] - total[offsets[:-1]]) / size * np.sqrt(np.minimum(size, 400))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, score, and whether the second nearest is nearly as near."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        if loss.shape[1] == 1:
            return best, p[:, 0], np.zeros(len(best), bool)
        two = np.sort(loss, axis=1)[:, :2]
        return best, p[np.arange(len(best)), best], two[:, 1] - two[:, 0] < AMBIGUOUS * (two[:, 1] + 1e-12)

    def near(self, column: pa.Array) -> np.ndarray:
        """Whether each text's n-grams are common enough in its nearest language, whatever the number of languages."""
        best = self.decode(self.margins(column))[0]
        return rarity(column, best, self.rates, self.usual) <= self.limit[best]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with text and a language. Only counts by language and bucket, and sums by language, leave the tasks.

    A text's rarity in its own language is judged by the other half of the texts (halves by content), so that the limits
    also hold for texts that were not learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                bucket, offsets = gram_buckets(part.column(0))
                names, of = np.unique(np.array(part.column(1).to_pylist(), dtype=str), return_inverse=True)
                of = of * 2 + part.column(2).to_numpy()
                own = np.bincount(np.repeat(of, np.diff(offsets)) << BITS | bucket, minlength=2 * len(names) << BITS).reshape(2 * len(names), -1)
                for i, c in enumerate(own):
                    key = names[i // 2], i % 2
                    count[key] = count.get(key, 0) + c
        for (name, half), c in count.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at), pa.string()), pa.array([half] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "half", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("half", F.xxhash64("text").bitwiseAND(1).cast("int"))
    model = rows.mapInArrow(run, "lang string, half int, bucket int, n long").groupBy("lang", "half", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(model["lang"].unique())
    halves = np.zeros((2, len(languages), 1 << BITS))
    halves[model["half"].to_numpy(int), model["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), model["bucket"].to_numpy(int)] = model["n"]
    counts = halves.sum(axis=0)
    rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS)) if languages else counts
    code = codewords(len(languages)) if languages else np.zeros((0, 1), int)
    weights = np.zeros((1 << BITS, code.shape[1]))
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        weights[:, b] = np.log(rates[code[:, b] > 0].mean(axis=0)) - np.log(rates[code[:, b] < 0].mean(axis=0))
    other = log_rates(halves[::-1])
    told = np.delete(counts, _BLANK, axis=1).sum(axis=1)
    usual = (halves * other).sum(axis=(0, 2)) / np.maximum(told, 1)
    out = Model(languages, code, weights, np.full(code.shape[1], 1 / code.shape[1]), log_rates(counts), usual, np.full(len(languages), np.inf))
    return _measured(rows, out, other) if languages else out


def _measured(rows: DataFrame, model: Model, other: np.ndarray) -> Model:
    """The model with what one more grouped aggregation over its training texts tells: trust in each bit and the limit of rarity."""
    shared = rows.sparkSession.sparkContext.broadcast((model, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, by_half = shared.value
        at = {x: i for i, x in enumerate(m.languages)}
        bits = m.code.shape[1]
        n, total, squares = np.zeros(len(at)), np.zeros((len(at), bits + 1)), np.zeros((len(at), bits + 1))
        for batch in batches:
            for part in slices(batch, 0):
                of, half = np.array([at[x] for x in part.column(1).to_pylist()], int), part.column(2).to_numpy()
                # The two halves' rates of a language are languages of their own here.
                far = rarity(part.column(0), half * len(at) + of, np.concatenate(by_half), np.tile(m.usual, 2))
                n += np.bincount(of, minlength=len(at))
                for b, x in enumerate([*m.margins(part.column(0)).T, far]):
                    total[:, b] += np.bincount(of, x, len(at))
                    squares[:, b] += np.bincount(of, x * x, len(at))
        names, cells = ["of", "bit", "n", "total", "squares"], np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*cells, np.repeat(n, bits + 1), total.ravel(), squares.ravel())], names)

    sums = rows.mapInArrow(run, "of int, bit int, n double, total double, squares double").groupBy("of", "bit").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).toPandas().sort_values(["of", "bit"])
    n, total, squares = (sums[c].to_numpy().reshape(len(model.languages), -1) for c in ("n", "total", "squares"))
    # Sums hang on the order of tasks in their last digits only.
    limit = np.round(FAR * np.sqrt(squares[:, -1] / n[:, -1]), 6)
    return replace(model, limit=limit, trust=np.round(separation(model.code, total[:, :-1] / n[:, :-1], squares[:, :-1] / n[:, :-1]), 6))


def separation(code: np.ndarray, mean: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Each bit's share of the distances between its sides' mean margins, in standard deviations within a language; languages count alike."""
    sides = [np.where(code == s, mean, 0).sum(axis=0) / np.maximum((code == s).sum(axis=0), 1) for s in (1, -1)]
    within = np.sqrt(np.maximum(square - mean**2, 0).mean(axis=0))
    apart = np.maximum(sides[0] - sides[1], 0) / (within + 1e-9)
    return apart / apart.sum() if apart.sum() > 0 else np.full(code.shape[1], 1 / code.shape[1])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous, for each row.

    `und` with score 0 where text is null or has no letters, or where nothing was learned. Repeated rows and null ids keep
    a row each; an empty table gives none; texts are read whole; other columns are ignored. A text in an unlearned language
    gets the nearest learned one; accepted() rejects it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1)
                known = np.array([bool(m.languages) and x is not None and _LETTER.search(x) is not None for x in texts.to_pylist()])
                if m.languages:
                    best, score, close = m.decode(m.margins(texts))
                    names = [m.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score, close = np.where(known, score, 0.0), close & known
                else:
                    names, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is known, with all their columns: those without letters go, and those whose
    n-grams are far rarer than is usual in the nearest learned language. Texts too short for an n-gram stay. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at)
                known = np.array([x is not None and _LETTER.search(x) is not None for x in texts.to_pylist()])
                if m.languages and known.any():
                    known &= m.near(texts)
                if known.any():
                    yield part.filter(pa.array(known))

    return docs.mapInArrow(run, docs.schema)
