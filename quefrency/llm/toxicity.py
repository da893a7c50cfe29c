"""Toxicity by a counterfactual-regularised linear classifier.

Word weights are fitted to labelled documents, with a penalty on the change of a document's score when its identity terms
are swapped for others of their kind, so that naming a group does not raise a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.llm.kernels import slices

#: Labelled rows that a fit uses at most: those with the smallest hash of their id. A documented bound of the training sample.
TRAIN_ROWS = 12_000
#: Words that become features, and documents of the sample that must hold one.
FEATURES, LEAST_DOCS = 768, 5
#: Strength of the penalty on counterfactual score changes, and of the plain one on weights.
SWAP, RIDGE = 10.0, 2e-5
#: Identity terms by kind. Terms of a kind are swapped for each other.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres", "transgender", "nonbinary"),
    ("muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "arab", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("disabled", "blind", "deaf", "old", "young", "elderly"),
    ("german", "french", "spanish", "english", "deutsche", "français", "españoles", "immigrant", "immigrants", "refugee", "refugees"),
)
_WORD = re.compile(r"[^\W\d_]+")
_PAIR = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY for i, t in enumerate(kind)}


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def swapped(counts: Counter) -> Counter | None:
    """The counts after each identity term became the next of its kind; None if there is none."""
    if not any(t in counts for t in _PAIR):
        return None
    out: Counter = Counter()
    for w, n in counts.items():
        out[_PAIR.get(w, w)] += n
    return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def vector(self, counts: Counter) -> tuple[list[int], list[float]]:
        """Features: log of one more than the count of each known word."""
        at = [(self.vocabulary[w], n) for w, n in counts.items() if w in self.vocabulary]
        return [i for i, _ in at], [float(np.log1p(n)) for _, n in at]

    def score(self, text: str | None) -> float:
        z = self.bias
        for w, n in word_counts(text).items():
            i = self.vocabulary.get(w)
            if i is not None:
                z += self.weights[i] * np.log1p(n)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most `limit` labelled documents. Labels other than 0 and 1 count as none; ids without a label or
    with contradicting ones are left out; of rows that share an id, one text counts."""
    own = F.col(label_col).cast("double")
    one = labels.where(F.col(id_col).isNotNull() & own.isin(0.0, 1.0)).groupBy(F.col(id_col).alias("__id")).agg(F.min(own).cast("int").alias("toxic"), F.max(own).cast("int").alias("most"))
    some = one.where("toxic = most").drop("most").orderBy(F.xxhash64("__id"), "__id").limit(limit)
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(some), "__id")
    return met.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(rows: DataFrame, penalty: float = SWAP) -> Model:
    """Fit text and toxic rows, of which there are few by training_rows(). Words are counted and chosen in Spark; what meets on the driver is the chosen words' counts of the bounded sample."""

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in set(_WORD.findall((text or "").lower())):
                    n.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], ["word", "clean", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, np.zeros(0), 4.0 if n1 else -4.0)
    found = rows.mapInArrow(presence, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= LEAST_DOCS)
    a, b = (F.col("t") + 0.5) / (n1 + 1.0), (F.col("c") + 0.5) / (n0 + 1.0)
    pull = F.abs(a - b) / F.sqrt((F.col("t") + F.col("c") + 1.0) * (n0 + n1 + 2.0 - F.col("t") - F.col("c")))  # two proportions' z, but for a factor
    chosen = [r["word"] for r in found.orderBy(F.desc(pull), "word").limit(FEATURES).collect()]
    model = Model({w: i for i, w in enumerate([*chosen, *(t for t in _PAIR if t not in set(chosen))])}, np.zeros(0), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out: list[tuple] = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = word_counts(text)
                s = swapped(c)
                out.append((toxic, *m.vector(c), *(m.vector(s) if s else ([], []))))
            kinds = (pa.int32(), *(pa.list_(pa.int32()), pa.list_(pa.float64())) * 2)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["toxic", "i", "x", "j", "z"])

    sample = rows.mapInArrow(design, "toxic int, i array<int>, x array<double>, j array<int>, z array<double>").toPandas()
    width = len(model.vocabulary)

    def dense(i, x):
        m = np.zeros((len(i), width), np.float32)
        for r, (a, b) in enumerate(zip(i, x, strict=True)):
            m[r, a] = b
        return m

    x, y = dense(sample["i"], sample["x"]), sample["toxic"].to_numpy(float)
    swaps = sample[sample["j"].map(len) > 0]
    change = dense(swaps["i"], swaps["x"]) - dense(swaps["j"], swaps["z"])
    # Besides swaps in the documents themselves, each pair of terms in an otherwise empty sentence.
    template = np.zeros((len(_PAIR), width), np.float32)
    for r, (t, u) in enumerate(_PAIR.items()):
        template[r, model.vocabulary[t]], template[r, model.vocabulary[u]] = 1, -1
    change = np.concatenate([change, template])
    model.weights, model.bias = train(x, y, change, penalty)
    return model


def train(x: np.ndarray, y: np.ndarray, change: np.ndarray, penalty: float = SWAP, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton steps on logistic loss + RIDGE |w|^2 / 2 + penalty mean((change w)^2) / 2. Labels weigh as they are."""
    xb = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float64)
    d = xb.shape[1]
    fixed = np.zeros((d, d))
    fixed[:-1, :-1] = penalty * change.T.astype(float) @ change / max(1, len(change))
    fixed[np.arange(d - 1), np.arange(d - 1)] += RIDGE
    fixed[-1, -1] = 1e-9
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        g = xb.T @ (p - y) / len(y) + fixed @ w
        h = (xb * (p * (1 - p) + 1e-6)[:, None]).T @ xb / len(y) + fixed
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), for each row.

    Null and empty texts get the score of no evidence; repeated rows and null ids keep a row each; an empty table gives
    none; texts are read whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = m.vocabulary.keys()
        for batch in batches:
            for part in slices(batch, 1):
                s = []
                for text in part.column(1).to_pylist():
                    c = Counter(w for w in _WORD.findall((text or "").lower()) if w in known)
                    z = m.bias + sum(m.weights[m.vocabulary[w]] * np.log1p(n) for w, n in c.items())
                    s.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
