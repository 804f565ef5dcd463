"""Coarse cells of vectors: centroids from a bounded sample, assignment and radii over all rows, blocks of whole matrices.

What lies within radius r of a centroid c is at least |q - c| - r away from q, so whole cells can be passed over without looking at
their vectors. Radii are taken over every member, so a poor sample costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192  # vectors that centroids are fitted on
MOST = 2048  # cells; their centroids are all that goes to every task
BLOCK = 1024  # vectors of one matrix


def as_unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors, dtype=float), where=norm > 0)


def fit(rows: np.ndarray, cells: int, steps: int = 6) -> np.ndarray:
    """Centroids of at most `cells` groups of the rows, by Lloyd's steps from evenly spaced rows; empty groups go."""
    rows = np.unique(rows, axis=0)
    c = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)] if len(rows) else rows
    for _ in range(steps):
        of = nearest(rows, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, rows)
        c = total[n > 0] / n[n > 0, None]
    return c


def nearest(rows: np.ndarray, centroids: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """The nearest centroid of every row."""
    half = (centroids**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - rows[a : a + at_once] @ centroids.T).argmin(1) for a in range(0, len(rows), at_once))])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column])


def sampled(vectors: DataFrame, column: str, id_column: str = "id", n: int = SAMPLE) -> np.ndarray:
    """At most n vectors, those of smallest hash of their id, of the dimension that most of these have."""
    held = vectors.orderBy(F.xxhash64(id_column), id_column).select(column).limit(n).toArrow().column(column)
    sizes = np.asarray(held.combine_chunks().value_lengths().to_numpy(zero_copy_only=False), dtype=int) if len(held) else np.zeros(0, int)
    if not len(sizes):
        return np.zeros((0, 0))
    main = int(np.bincount(sizes).argmax())
    flat = held.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1][sizes == main]
    return flat[begin[:, None] + np.arange(main)]


def with_cell(vectors: DataFrame, centroids: np.ndarray, column: str) -> DataFrame:
    """vectors with cell: the nearest centroid, -1 for vectors of another dimension. The centroids (at most MOST) go along."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        c = shared.value
        out = np.full(len(v), -1, dtype=np.int32)
        fits = np.array([len(x) == c.shape[1] for x in v], dtype=bool) if len(c) else np.zeros(len(v), bool)
        if fits.any():
            out[fits] = nearest(matrix(v[fits]), c)
        return pd.Series(out)

    return vectors.withColumn("cell", cell(column))


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(cell, id, ...) with sub: every cell is dealt by a hash of id into subs of about block rows, so no cell is too large for a task."""
    subs = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_subs"))  # at most MOST + 1 rows
    return rows.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("_subs")).cast("int")).drop("_subs")


def block_schema(kind: str) -> str:
    return f"cell int, sub int, dims int, ids array<{kind}>, vectors binary, center array<double>, radius double"


def blocks(rows: DataFrame, column: str) -> DataFrame:
    """cell, sub, dims, ids, vectors (doubles, row by row), center, radius of rows(cell, sub, id, column): a row for each block and dimension."""
    kind = rows.schema["id"].dataType.simpleString()

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        m = matrix(frame[column])
        center = m.mean(0)
        radius = float(np.sqrt(((m - center) ** 2).sum(1).max()))
        return pd.DataFrame({"cell": [int(frame["cell"].iloc[0])], "sub": [int(frame["sub"].iloc[0])], "dims": [m.shape[1]], "ids": [frame["id"].tolist()], "vectors": [m.tobytes()], "center": [center.tolist()], "radius": [radius]})

    held = rows.select("cell", "sub", "id", column).withColumn("dims", F.size(column))
    return held.groupBy("cell", "sub", "dims").applyInPandas(gather, block_schema(kind))


def heads(stored: DataFrame) -> DataFrame:
    """cell, dims, n, center, radius of every cell from its blocks: the mean center, and a radius that holds all of their members."""

    def head(frame: pd.DataFrame) -> pd.DataFrame:
        m = matrix(frame["center"])
        center = m.mean(0)
        radius = float((np.sqrt(((m - center) ** 2).sum(1)) + frame["radius"]).max())
        return pd.DataFrame({"cell": [int(frame["cell"].iloc[0])], "dims": [m.shape[1]], "n": [int(frame["n"].sum())], "center": [center.tolist()], "radius": [radius]})

    return stored.select("cell", "dims", "center", "radius", F.size("ids").cast("long").alias("n")).groupBy("cell", "dims").applyInPandas(head, "cell int, dims int, n long, center array<double>, radius double")


def in_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            yield f
