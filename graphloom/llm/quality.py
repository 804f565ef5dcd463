"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader, scored as sparse dot products.

Features of a text are its words and its word shapes (letters, digits and signs, runs squeezed), each as unigrams and bigrams, hashed
to 2**bits weights; the value of a feature is its share of the text's features. Scores need no labels; training takes at most
`max_train` labelled documents, those of smallest xxhash64(doc_id), so it is bounded and repeatable.

Defined cases: null and empty texts score as the bias alone; null labels and repeated labels of one document count once, the lowest
known one; without labelled rows of both kinds every score is the share of good labels (0.5 without any); an empty table gives no rows;
further columns are ignored by `score` and kept by `filter_quality`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Words, blocks, keep, mix, range_hashes, tidy

BITS = 18
MAX_TRAIN = 6000
THRESHOLD = 0.7
#: A text's features have values that sum to this.
_SCALE = 8.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weights that the features of each text hit, and where each text's begin."""
    w = Words(texts, lower=False)
    lowered = _LOWER[w.data]
    words = range_hashes(lowered, w.starts, w.ends)
    shape = _SHAPE[w.data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[w.starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    shapes = range_hashes(shape[keep], at[w.starts], at[w.ends])
    n = len(words)
    first = np.zeros(n, dtype=bool)
    first[w.first[:-1][np.diff(w.first) > 0]] = True
    before = lambda h: np.where(first, np.uint64(1), np.concatenate((h[:0] if not n else h[-1:], h[:-1])))
    out = np.empty((n, 4), dtype=np.uint64)
    for k, (h, salt) in enumerate(((words, 11), (mix(before(words)) + words, 13), (shapes, 17), (mix(before(shapes)) + shapes, 19))):
        out[:, k] = mix(h + np.uint64(salt)) >> np.uint64(64 - bits)
    return out.astype(np.int64), w.first


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, label: int) -> float:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g
        return float(p)


def fit(examples: list[tuple[bytes, int]], bits: int = BITS, passes: int = 3) -> np.ndarray:
    """2**bits weights and the bias, from (text, label) in the order given."""
    labels = [y for _, y in examples]
    model = Ftrl(bits)
    if not labels or len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        out = np.zeros((1 << bits) + 1, dtype=np.float32)
        out[-1] = np.log(share / (1 - share))
        return out
    rows = []
    for text, y in examples:
        f, _ = features([text], bits)
        i, c = np.unique(f, return_counts=True)
        rows.append((np.append(i, 1 << bits), np.append(c * (_SCALE / max(1, f.size)), 1.0), y))
    for _ in range(passes):
        for i, x, y in rows:
            model.update(i, x, y)
    return model.weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, bits: int = BITS, held_out: bool = True) -> np.ndarray:
    """The weights, fitted in one task on a bounded sample. held_out: leave out documents whose crc32(doc_id) mod 4 is 2."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        y = y.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    y = y.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id")  # at most max_train rows of 12 bytes

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keep("quality", tidy)
        group = group.sort_values(["h", "doc_id", "text"])
        weights = fit([((t or "").encode(), int(v)) for t, v in zip(group["text"], group["y"], strict=True)], bits)
        return pd.DataFrame({"weights": [weights.tobytes()]})

    one = chosen.withColumn("h", F.xxhash64("doc_id")).groupBy(F.lit(0).alias("g")).applyInPandas(run, "weights binary").collect()
    return np.frombuffer(one[0]["weights"], dtype=np.float32) if one else fit([], bits)


def with_score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1. The weights (at most 4 MB) go along as a broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in docs.columns if c != column]
    schema = docs.select(rest).schema.add(column, "double")

    def run(batches):
        keep("quality", tidy)
        w = shared.value.astype(np.float64)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out = np.full(len(texts), w[-1])
            for at, block in blocks(texts):
                f, first = features(block, bits)
                total = np.concatenate(([0.0], np.cumsum(w[f].sum(1))))
                n = np.diff(first)
                out[at : at + len(block)] += (total[first[1:]] - total[first[:-1]]) * (_SCALE / np.maximum(1, 4 * n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=[*batch.schema.names, column])

    return docs.select(*rest).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    weights = train(docs, labels)
    scored = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), weights)
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with."""
    name = "score"
    while name in docs.columns:
        name = "_" + name
    return with_score(docs, train(docs, labels, held_out=False), column=name).where(F.col(name) >= threshold).drop(name)
