"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 lattice points, neighbouring cells probed, cosine verified.

Equal vectors are brought together first and go on as one with a weight. Every table projects the unit vectors to 8 dimensions, one E8
block at every input size, and decodes them to the nearest lattice point; a vector is stored in its cell and asks the neighbouring
cells that it is nearest to. Cells that only one vector touches are dropped before any vector is moved. A cell of many vectors is split
into blocks, and every pair of blocks is one task's work, so no group is held whole; tasks return per vector its number of verified
links and one pointer that joins it to its class, never pairs. A pair that meets more than once counts where it meets first.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their row; vectors of
different length don't link; repeated vec_ids: equal rows are one vector with one row each, a vec_id with different vectors is linked by
each of them and has the row of the smallest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, mix, shuffle_partitions

TABLES, PROBES, WIDTH = 9, 8, 1.0
BLOCK = 1024
BLOCKS = 1  # of E8 a table; a pair must agree in all of them, so more of them lose links


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: signed pairs of ones, and halves with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    signs = np.array([[1 - 2 * (m >> i & 1) for i in range(8)] for m in range(256) if m.bit_count() % 2 == 0])
    return np.concatenate([out, signs / 2])


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point whose coordinates are whole numbers with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        d = x[odd] - r[odd]
        k = np.abs(d).argmax(1)
        row = np.arange(len(odd))
        r[odd, k] += np.where(d[row, k] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row: the better of D8 and D8 shifted by halves."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _keys(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of every lattice point (last axis)."""
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    out = np.full(points.shape[:-1], salt, dtype=np.uint64)
    for i in range(points.shape[-1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + whole[..., i])
    return out


def cells(unit: np.ndarray, blocks: int, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the own cell (n, tables) and of the probed neighbours (n, tables, probes)."""
    n, dims = unit.shape
    own, near = np.empty((n, tables), np.uint64), np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        x = unit @ np.random.default_rng([seed, t, dims]).standard_normal((dims, 8 * blocks)) / width
        parts = [nearest_e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        point = np.concatenate(parts, axis=1)
        own[:, t] = _keys(point, t)
        # The neighbours nearest to x: in each block the roots that point along what decoding left over.
        gain = np.concatenate([(x[:, 8 * b : 8 * b + 8] - parts[b]) @ ROOTS.T for b in range(blocks)], axis=1)
        pick = np.argpartition(-gain, probes, axis=1)[:, :probes]
        moved = np.repeat(point[:, None, :], probes, axis=1)
        row, col = np.indices(pick.shape)
        for d in range(8):
            moved[row, col, pick // 240 * 8 + d] += ROOTS[pick % 240, d]
        near[:, t] = _keys(moved, t)
    return own, near


def _unit(column) -> np.ndarray:
    m = column if isinstance(column, np.ndarray) and column.ndim == 2 else np.array([np.asarray(v, dtype=np.float64) for v in column])
    m = m / np.abs(m).max(1)[:, None]
    return m / np.linalg.norm(m, axis=1)[:, None]


def _whole_groups(batches, rows: int = 20_000):
    """Tables of about that many rows of a stream sorted by (cell, i, j), cut only between groups."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held)
        new = np.flatnonzero(_starts(table))
        if len(new) > 1:
            yield table.slice(0, int(new[-1]))
            held = [table.slice(int(new[-1]))]
        else:
            held = [table]
    if held:
        yield pa.concat_tables(held)


def _starts(table: pa.Table) -> np.ndarray:
    """Which rows begin a group."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (table.column(n).to_numpy() for n in ("cell", "i", "j"))], axis=0)
    return new


def _close(unit: np.ndarray, begin: np.ndarray, apart: np.ndarray, part: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows x < y of one group whose vectors are that close; in groups of two different blocks only pairs across them."""
    xs, ys = [], []
    size = np.diff(begin)
    small = size <= 48
    row_group = np.repeat(np.arange(len(size)), size)
    rest = np.where(small[row_group], begin[1:][row_group] - np.arange(len(unit)) - 1, 0)
    at = 0
    while at < len(unit):  # pairs of small groups, some hundred thousand at a time
        stop = max(at + 1, int(np.searchsorted(np.cumsum(rest[at:]), 300_000)) + at)
        x = np.repeat(np.arange(at, stop), rest[at:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(rest[at:stop]) - rest[at:stop], rest[at:stop])
        near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
        xs.append(x[near])
        ys.append(y[near])
        at = stop
    for g in np.flatnonzero(~small):
        a, b = int(begin[g]), int(begin[g + 1])
        x, y = np.nonzero(unit[a:b] @ unit[a:b].T >= cosine)
        keep = x < y
        xs.append(x[keep] + a)
        ys.append(y[keep] + a)
    x, y = np.concatenate(xs), np.concatenate(ys)
    keep = ~apart[row_group[x]] | (part[x] != part[y])
    return x[keep], y[keep]


def _class_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of each class of 0..n-1 under the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(table: pa.Table, size: int, blocks: int, cosine: float, tables: int, probes: int, width: float) -> pa.RecordBatch | None:
    """Per vector of whole groups: links that count here, and a pointer to the smallest vector of its class here."""
    begin = np.append(np.flatnonzero(_starts(table)), table.num_rows)
    cell, rep, weight, part = (table.column(n).to_numpy() for n in ("cell", "rep", "weight", "part"))
    apart = (table.column("i").to_numpy() != table.column("j").to_numpy())[begin[:-1]]
    unit = _unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size))
    x, y = _close(unit, begin, apart, part, cosine)
    keep = rep[x] != rep[y]
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    # Keys of the cells of all vectors that link; u gives their rows in own and near.
    vectors, first, back = np.unique(rep[np.concatenate([x, y])], return_index=True, return_inverse=True)
    own, near = cells(unit[np.concatenate([x, y])[first]], blocks, tables, probes, width)
    u, v = back[: len(x)], back[len(x) :]
    here = cell[x].view(np.uint64)
    met = np.zeros((len(x), tables), dtype=bool)
    for w in (u, v):
        met |= (own[w] == here[:, None]) | (near[w] == here[:, None, None]).any(2)
    t = met.argmax(1)
    at_x, at_y = own[u, t] == here, own[v, t] == here
    # A link counts where the two meet first: in the first table, and there in the cell of the smaller vector if in both own cells.
    seen = ~(at_x | at_y)
    for s in range(tables):
        together = (own[u, s] == own[v, s]) | (near[u, s] == own[v, s, None]).any(1) | (near[v, s] == own[u, s, None]).any(1)
        seen |= together & (s < t)
    other_own = np.where(at_x, own[v, t], own[u, t])
    asks = np.where(at_x[:, None], near[u, t], near[v, t])
    twice = ~(at_x & at_y) & (asks == other_own[:, None]).any(1)
    seen |= twice & (at_x != (rep[x] < rep[y]))
    links = np.bincount(u[~seen], weight[y[~seen]], len(vectors)) + np.bincount(v[~seen], weight[x[~seen]], len(vectors))
    root = _class_roots(len(vectors), u, v)
    some = (links > 0) | (root != np.arange(len(vectors)))
    return pa.RecordBatch.from_arrays([pa.array(vectors[some]), pa.array(links[some].astype(np.int64)), pa.array(vectors[root[some]])], names=["rep", "links", "root"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    every = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    apart = materialize(every.where("sound").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("rep is not null"), "vectors")

    def hashed(frames):
        for frame in frames:
            for _, part in frame.groupby(frame["v"].map(len)):
                own, near = cells(_unit(part["v"]), BLOCKS, tables, probes, width)
                rep = part["rep"].to_numpy()
                key = np.concatenate([own.reshape(-1), near.reshape(-1)]).view(np.int64)
                yield pd.DataFrame({"cell": key, "rep": np.concatenate([np.repeat(rep, tables), np.repeat(rep, tables * probes)]), "stored": np.arange(len(key)) < own.size})

    rows = apart.select("rep", "v").mapInPandas(hashed, "cell long, rep long, stored boolean")
    rows = materialize(rows, "cells")
    busy = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("stored").cast("long")).alias("own")).where("n > 1 and own > 0")
    busy = busy.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).select("cell", "parts")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    met = rows.join(busy, "cell").withColumn("part", part)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    met = met.withColumn("p", F.explode(pairs)).select("cell", "p.i", "p.j", "rep", "part")
    met = met.join(apart, "rep").select("cell", "i", "j", "rep", "part", "weight", "v")

    def verify(batches):
        for table in _whole_groups(batches):
            lengths = np.diff(table.column("v").combine_chunks().offsets.to_numpy())
            for size in np.unique(lengths):
                part = table.filter(pa.array(lengths == size))
                out = _links(part, int(size), BLOCKS, cosine, tables, probes, width)
                if out is not None:
                    yield out

    n_parts = shuffle_partitions(spark)
    dealt = met.repartition(n_parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "rep")
    found = materialize(dealt.mapInArrow(verify, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of = apart.join(links, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    alone = every.where("not sound or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = every.where("sound and vec_id is not null").join(of, "v").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
