"""Exact top-k inner products: vectors by descending length, partial sums in a rotated basis, Cauchy-Schwarz bounds on the rest.

Components are turned into integers first, so scores are exact. Vectors fall into bands of length; a query goes only to bands whose
longest vector can still beat its threshold, which comes from the longest vectors of all (a bounded head). Inside a block the vectors
stand in descending order of length, in chunks; a chunk ends the search when the longest vector left can't enter, and a vector is
scored exactly only if its partial sum over the first rotated dimensions plus the product of the remaining lengths reaches the bar.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as query nor candidate; shorter vectors
count as filled with zeros; ties go to the smaller vec_id, repeated vec_ids are ranked each; a query with fewer candidates than k returns
all of them; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_HEAD = 2048  # longest vectors that set the first thresholds
_CANDIDATES, _QUERIES = 8192, 1024  # rows of a block
_CHUNK = 1024
_OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (whole numbers as doubles, exact below 2**53), norm; only vectors that take part."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    out = vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the stacked vectors, strongest first, from their Gram matrix; partitions send dims * dims sums each, added before and after the shuffle."""

    def gram(frames):
        total = np.zeros((dims, dims))
        for frame in frames:
            m = _matrix(frame["v"], dims)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dims * dims), "x": total.ravel()})

    rows = vectors.select("v").mapInPandas(gram, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(dims * dims)
    total[rows["i"]] = rows["x"]
    _, basis = np.linalg.eigh(total.reshape(dims, dims))
    return basis[:, ::-1]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number products; through integers where doubles could round (sums wrap at 64 bits as a long does)."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(q_ids, q, q_bar, c_ids, c, k: int, basis: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Rows (query_id, vec_id, score) of each query's best in this block that reach its bar, and how many pairs were scored exactly."""
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c, c_ids = c[order], c_ids[order]
    head = max(1, c.shape[1] // 4)
    rc, rq = c @ basis, q @ basis
    length, q_length = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    tail, q_tail = np.linalg.norm(rc[:, head:], axis=1), np.linalg.norm(rq[:, head:], axis=1)
    bar = q_bar.astype(float).copy()
    held: list[tuple[np.ndarray, np.ndarray]] = [(c_ids[:0], np.zeros(0, np.int64))] * len(q_ids)
    scored = 0
    for at in range(0, len(c), _CHUNK):
        stop = at + _CHUNK
        slack = 1e-6 + 1e-9 * q_length * length[at]
        live = np.flatnonzero(q_length * length[at] + slack >= bar)
        if not len(live):
            break
        bound = rq[live, :head] @ rc[at:stop, :head].T
        bound += np.outer(q_tail[live], tail[at:stop])
        hit_q, hit_c = np.nonzero(bound + slack[live, None] >= bar[live, None])
        edges = np.searchsorted(hit_q, np.arange(len(live) + 1))
        for i, x in enumerate(live):
            near = at + hit_c[edges[i] : edges[i + 1]]
            near = near[c_ids[near] != q_ids[x]]
            if not len(near):
                continue
            scored += len(near)
            got = _dot(q[x : x + 1], c[near])[0]
            ids, scores = np.concatenate([held[x][0], c_ids[near]]), np.concatenate([held[x][1], got])
            best = _best(ids, scores, k)
            held[x] = ids[best], scores[best]
            if len(best) == k:
                bar[x] = max(bar[x], scores[best[-1]])
    return [np.column_stack([np.full(len(i), qid), i, s]) for qid, (i, s) in zip(q_ids, held, strict=True) if len(i)], scored


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of every query with all vectors of another vec_id."""
    spark = vectors.sparkSession
    c = materialize(quantised(vectors, scale), "vectors")
    q = quantised(queries, scale)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bands = c.groupBy(F.floor(F.log(F.greatest("norm", F.lit(1e-3))) * 8).cast("int").alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(F.size("v")).alias("dims")).collect()
    if not bands:
        return empty
    dims = max(1, *(b["dims"] for b in bands))
    basis = rotation(c, dims)
    head = c.orderBy(F.desc("norm"), "vec_id").limit(_HEAD).toPandas()
    head_ids, head_v = head["vec_id"].to_numpy(), _matrix(head["v"], dims)
    shared = spark.sparkContext.broadcast((head_ids, head_v, basis))

    def bars(frames):
        ids, m, _ = shared.value
        for frame in frames:
            s = _dot(_matrix(frame["v"], dims), m).astype(float)
            s[frame["vec_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            bar = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(frame), -np.inf)
            yield frame.assign(bar=bar)

    # A band has n / _CANDIDATES blocks; a query goes to those of every band that can reach its bar. There are a few hundred bands at most.
    blocks, base = [], 0
    for b in sorted(bands, key=lambda b: -b["top"]):
        n = -(-b["n"] // _CANDIDATES)
        blocks.append((b["band"], base, n, b["top"]))
        base += n
    barred = materialize(q.mapInPandas(bars, "vec_id long, v array<double>, norm double, bar double"), "queries")
    # Queries stand in groups by the length that a candidate needs, so that a band is sent only to the groups that it can serve.
    need = F.when((F.col("norm") > 0) & (F.col("bar") > 1e-6), (F.col("bar") - 1e-6) / F.col("norm")).otherwise(0.0)
    step = F.floor(F.log(F.greatest(need, F.lit(1e-3))) * 8).cast("int")
    steps = barred.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min(need).alias("low")).orderBy("step").collect()  # a few hundred at most
    if not steps:
        return empty
    groups, asked = [], 0
    for x in steps:
        n = -(-x["n"] // _QUERIES)
        groups.append((x["step"], asked, n, x["low"]))
        asked += n
    served = lambda top: sum(n for _, _, n, low in groups if low <= top * (1 + 1e-6) + 1e-6)
    as_table = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")
    table = as_table([{"band": a, "base": b, "n": n, "top": t, "served": served(t)} for a, b, n, t in blocks], "band:int,base:long,n:int,top:double,served:long")
    places = as_table([{"step": a, "base": b, "n": n} for a, b, n, _ in groups], "step:int,base:long,n:int")
    reach = F.filter(table, lambda t: F.col("norm") * t["top"] * (1 + 1e-9) + 1e-6 >= F.col("bar"))
    to = F.flatten(F.transform(reach, lambda t: F.sequence(t["base"], t["base"] + t["n"] - 1)))
    own = F.element_at(F.filter(places, lambda t: t["step"] == step), 1)
    left = barred.select(F.col("vec_id").alias("id"), "v", "bar", (own["base"] + F.pmod(F.xxhash64("vec_id", "v"), own["n"])).alias("qb"), F.explode(to).alias("cb"))
    mine = F.element_at(F.filter(table, lambda t: t["band"] == F.floor(F.log(F.greatest("norm", F.lit(1e-3))) * 8).cast("int")), 1)
    right = c.select("vec_id", "v", mine.alias("m")).where("m.served > 0")
    right = right.select("vec_id", "v", (F.col("m.base") + F.pmod(F.xxhash64("vec_id", "v"), F.col("m.n"))).alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.served") - 1)).alias("qb"))

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        rows, _ = _search(a["id"].to_numpy(), _matrix(a["v"], dims), a["bar"].to_numpy(), b["vec_id"].to_numpy(), _matrix(b["v"], dims), k, shared.value[2])
        return pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 3), np.int64), columns=["query_id", "vec_id", "score"])

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(both, _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
