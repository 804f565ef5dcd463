"""Communities of entities by average-linkage clustering of their vectors, in three levels."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells as C

#: Cosine distance under which clusters of each level merge.
LEVELS = {2: 0.25, 1: 0.35, 0: 0.75}
MOST = 6000  # clusters that one task merges; larger inputs merge in rounds first
BLOCK = 1024
GROUP = 16_000_000  # bytes of vectors on one side of a task
TASKS = 3  # for each core, where there are enough vectors
CELLS = 4_000_000  # products at once


def written(rows: DataFrame) -> DataFrame:
    """rows as a table in the checkpoint folder. Unlike a checkpoint it runs the plan once and forgets the size that the plan was thought to
    have, which multiplies with every join of a round."""
    spark = rows.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors, dtype=float), where=norm > 0)


def average_linkage(vectors: np.ndarray, threshold: float, size: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers (by first member) when the nearest clusters merge as long as their mean cosine distance is under the threshold.

    Nearest-neighbour chain: average linkage of unit vectors needs only the sums of each cluster's vectors. With size, vectors are
    such sums of clusters of that many vectors.
    """
    n = len(vectors)
    if not n:
        return np.zeros(0, dtype=np.int64)
    sums = _unit(vectors) if size is None else vectors.copy()
    size, alive, up = np.ones(n) if size is None else size.astype(float), np.ones(n, dtype=bool), np.arange(n)
    chain: list[int] = []
    while alive.any():
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        d = 1 - sums @ sums[a] / (size * size[a])
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
        if not np.isfinite(d[b]) or d[b] >= threshold:
            # Nothing nearer comes later: with average linkage a merge elsewhere can't bring a closer cluster.
            alive[a] = False
            chain.pop()
        elif len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            keep, gone = min(a, b), max(a, b)
            sums[keep] += sums[gone]
            size[keep] += size[gone]
            alive[gone] = False
            up[gone] = keep
        else:
            chain.append(b)
    while (up[up] != up).any():
        up = up[up]
    return up


def _both(best: np.ndarray, near: np.ndarray, at: np.ndarray, low: np.ndarray, to: np.ndarray) -> None:
    """Keeps, at rows `at`, the lower of a known and a new distance; ties to the smaller place."""
    better = (low < best[at]) | ((low == best[at]) & (to < near[at]))
    best[at[better]], near[at[better]] = low[better], to[better]


def _nearest(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """id, near, d: the nearest of the others, under the threshold, for the rows of one group of blocks among themselves or of two groups
    across; ties to the smaller id. part has a row for each block: grp, ids, vectors, center, radius."""
    part = part.reset_index(drop=True)
    ids = np.concatenate([np.asarray(x) for x in part["ids"]])
    of, rows = np.repeat(np.arange(len(part)), [len(x) for x in part["ids"]]), np.concatenate([np.frombuffer(v).reshape(len(i), -1) for v, i in zip(part["vectors"], part["ids"], strict=True)])
    order = np.argsort(ids, kind="stable")  # places in the order of ids, so the first of equals is the smallest
    ids, of, rows = ids[order], of[order], rows[order]
    center, radius, group = C.matrix(part["center"]), part["radius"].to_numpy(), part["grp"].to_numpy()
    size = np.linalg.norm(center, axis=1)
    across = group[0] != group[-1] or len(set(group.tolist())) > 1
    best, near = np.full(len(ids), np.inf), np.full(len(ids), len(ids))
    for i in np.flatnonzero(group == group.min()) if across else range(len(part)):
        most = center @ center[i] + radius * size[i] + radius[i] * size + radius * radius[i]
        meets = (most > 1 - threshold - 1e-9) & ((group != group[i]) if across else (np.arange(len(part)) >= i))
        right = np.flatnonzero(meets[of])
        left = np.flatnonzero(of == i)
        if not len(right):
            continue
        other = rows[right].T
        step = max(1, CELLS // len(right))
        for mine in (left[x : x + step] for x in range(0, len(left), step)):
            # Both sides' distances come from the same products, so two clusters see each other at the same distance.
            d = 1 - rows[mine] @ other
            if not across:
                d[mine[:, None] == right[None, :]] = np.inf
            some, those = np.flatnonzero(d.min(1) < threshold + 1e-9), np.flatnonzero(d.min(0) < threshold + 1e-9)
            if len(some):
                d = np.round(d[np.ix_(some, those)], 12)
                _both(best, near, mine[some], d.min(1), right[those[d.argmin(1)]])
                _both(best, near, right[those], d.min(0), mine[some[d.argmin(0)]])
    found = np.flatnonzero(best < threshold)
    return pd.DataFrame({"id": ids[found], "near": ids[near[found]], "d": best[found]})


def reachable(heads: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """i, j of the cells, i no later than j, of which two members can be nearer than the threshold: with centers a, b and radii r, s the
    product of two members is at most ab + r|b| + s|a| + rs."""
    center, radius, cell = C.matrix(heads["center"]), heads["radius"].to_numpy(), heads["cell"].to_numpy()
    size = np.linalg.norm(center, axis=1)
    out = []
    for i in range(len(cell)):
        most = center @ center[i] + radius * size[i] + radius[i] * size + radius * radius[i]
        j = np.flatnonzero((most > 1 - threshold - 1e-9) & (cell >= cell[i]))
        out.append(np.column_stack((np.full(len(j), cell[i]), cell[j])))
    return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2)), columns=["i", "j"]).astype("int32")


def laid(live: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, pd.DataFrame]:
    """(blocks of the clusters' means by cell, the cells' centers and radii): at most cells.MOST of the latter, so they fit anywhere."""
    means = live.select("id", F.transform("s", lambda x: x / F.col("m")).alias("mean"))
    blocks = written(C.blocks(C.dealt(C.with_cell(means, centroids, "mean"), BLOCK), "mean"))
    return blocks, C.heads(blocks).toPandas()


def grouped(heads: pd.DataFrame, threshold: float, cores: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(cell, sub, grp of every block, grp, task of every group in every task): groups of about GROUP bytes of near cells, or smaller ones
    where there would be too few tasks; a task for each pair of groups in which two members can be nearer than the threshold."""
    center, n, cell = C.matrix(heads["center"]), heads["n"].to_numpy(), heads["cell"].to_numpy()
    axis = np.linalg.eigh(np.cov(center.T).reshape(center.shape[1], -1))[1][:, -1] if len(cell) > 1 else np.ones(center.shape[1])
    order = np.argsort(center @ axis, kind="stable")
    begin = np.empty(len(n))
    begin[order] = np.cumsum(n[order]) - n[order]
    total = int(n.sum())
    wanted = min(max(1, total // 256), max(-(-total * 8 * center.shape[1] // GROUP), int(np.ceil((2 * TASKS * cores) ** 0.5))))
    subs = -(-n // BLOCK)
    of = np.repeat(np.arange(len(n)), subs)
    sub = np.concatenate([np.arange(x) for x in subs])
    grp = ((begin[of] + sub * (n / subs)[of]) * wanted // total).astype(int)
    place = {int(c): x for x, c in enumerate(cell)}
    near = np.zeros((len(n), len(n)), dtype=np.float32)
    met = reachable(heads, threshold)
    i, j = (np.array([place[c] for c in met[k].tolist()], dtype=int) for k in ("i", "j"))
    near[i, j] = near[j, i] = 1
    held = np.zeros((wanted, len(n)), dtype=np.float32)
    held[grp, of] = 1
    g, h = np.nonzero(np.triu(held @ near @ held.T > 0))
    task = np.arange(len(g))
    tasks = pd.DataFrame({"grp": np.concatenate((g, h[g != h])), "task": np.concatenate((task, task[g != h]))})
    return pd.DataFrame({"cell": cell[of], "sub": sub, "grp": grp}), tasks


def nearest(blocks: DataFrame, heads: pd.DataFrame, threshold: float, kind: str) -> DataFrame:
    """id, near, d of every cluster with one nearer than the threshold: only blocks of cells that can hold it meet.

    A task gets whole groups of blocks, so a block is copied once for each group that its own can reach, not once for each block.
    """
    spark = blocks.sparkSession
    of, tasks = grouped(heads, threshold, spark.sparkContext.defaultParallelism)
    of = F.broadcast(spark.createDataFrame(of, "cell int, sub int, grp int"))  # a row for each block
    tasks = F.broadcast(spark.createDataFrame(tasks, "grp int, task int"))  # at most the groups squared
    met = blocks.join(of, ["cell", "sub"]).join(tasks, "grp").select("task", "grp", "ids", "vectors", "center", "radius")
    found = met.groupBy("task").applyInPandas(lambda part: _nearest(part, threshold), f"id {kind}, near {kind}, d double")
    return found.groupBy("id").agg(F.min(F.struct("d", "near")).alias("x")).select("id", "x.near", "x.d")


def compared(vectors: DataFrame, threshold: float, cells: int | None = None) -> tuple[int, int]:
    """(pairs of vectors(id, v) that the first round compares at most, all pairs): how much the cells pass over."""
    rows = vectors.select("id", F.col("v").alias("s"), F.lit(1.0).alias("m"))
    n = rows.count()
    _, heads = laid(rows, C.fit(C.sampled(rows, "s"), cells or int(min(C.MOST, max(1, n // 32)))))
    size = dict(zip(heads["cell"], heads["n"], strict=True))
    return int(sum(size[i] * size[j] / (1 + (i == j)) for i, j in reachable(heads, threshold).itertuples(index=False))), n * n // 2


def cluster(vectors: DataFrame, threshold: float) -> DataFrame:
    """id, cluster for vectors(id, v): cluster is the smallest id in it. Exact at every size.

    Up to MOST clusters merge in one task. More merge in rounds first: all pairs that are each other's nearest merge at once, which gives
    average linkage's own clusters, as a merge never brings a third cluster nearer; clusters with none under the threshold are done.
    A round compares only blocks of cells whose centers and radii let two clusters be under the threshold.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def unit(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "u": list(np.round(_unit(np.array([np.asarray(x, float) for x in f["v"]])), 12) + 0.0)})

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        root = average_linkage(np.stack(frame["s"].to_numpy()), threshold, frame["m"].to_numpy())
        return pd.DataFrame({"id": frame["id"], "up": frame["id"].to_numpy()[root]})

    # Equal directions are at distance 0 and merge before all others; vectors of zeros are near nothing.
    alone = F.when(F.exists("u", lambda x: x != 0), F.lit("")).otherwise(F.col("id").cast("string"))
    rows = written(vectors.select("id", "v").mapInPandas(unit, f"id {kind}, u array<double>").withColumn("alone", alone))
    reps = written(rows.groupBy("u", "alone").agg(F.min("id").alias("cluster"), F.count("*").cast("double").alias("m")))
    # A direction that very many share is looked up in every task, so its rows don't meet in one.
    total = rows.count()
    hot = F.broadcast(reps.where(F.col("m") > total / 1024).select("u", "alone", F.col("cluster").alias("known")))  # fewer than 1,024
    often = rows.join(hot, ["u", "alone"], "left")
    rare = often.where("known is null").drop("known").join(reps.select("u", "alone", "cluster"), ["u", "alone"]).select("id", "cluster")
    of = written(often.where("known is not null").select("id", F.col("known").alias("cluster")).unionByName(rare))
    live = reps.select(F.col("cluster").alias("id"), F.transform("u", lambda x: x * F.col("m")).alias("s"), "m")
    n, centroids = live.count(), None
    while n > MOST:
        if centroids is None:
            centroids = C.fit(C.sampled(live.select("id", F.transform("s", lambda x: x / F.col("m")).alias("mean")), "mean"), int(min(C.MOST, max(1, n // 32))))
        blocks, heads = laid(live, centroids)
        near = written(nearest(blocks, heads, threshold, kind))
        if near.isEmpty():
            return of
        back = near.select(F.col("id").alias("near"), F.col("near").alias("id"))
        pairs = written(near.where("id < near").join(back, ["id", "near"]).select(F.col("id").alias("low"), F.col("near").alias("high")))
        if pairs.isEmpty():  # ties that rounding parts
            pairs = written(near.orderBy("d", F.least("id", "near"), F.greatest("id", "near")).limit(1).select(F.least("id", "near").alias("low"), F.greatest("id", "near").alias("high")))
        # Those left, each under the smaller id of its pair.
        left = live.join(near.select("id"), "id", "left_semi")
        gone = left.join(pairs.withColumnRenamed("high", "id"), "id").select(F.col("low").alias("id"), F.col("s").alias("s2"), F.col("m").alias("m2"))
        left = left.join(pairs.select(F.col("high").alias("id")), "id", "left_anti").join(gone, "id", "left")
        live = written(left.select("id", F.when(F.col("m2").isNull(), F.col("s")).otherwise(F.zip_with("s", "s2", lambda x, y: x + y)).alias("s"), (F.col("m") + F.coalesce("m2", F.lit(0.0))).alias("m")))
        of = written(of.join(pairs.withColumnRenamed("high", "cluster"), "cluster", "left").select("id", F.coalesce("low", "cluster").alias("cluster")))
        n = live.count()
    last = live.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(finish, f"id {kind}, up {kind}").withColumnRenamed("id", "cluster")
    return of.join(last, "cluster", "left").select("id", F.coalesce("up", "cluster").alias("cluster"))


def hierarchy(vectors: DataFrame, thresholds: dict[int, float] = LEVELS) -> DataFrame:
    """node_id, community_id, level: clusters of level 2 of entities, of level 1 of those, of level 0 of those. Clusters of one child are no community; what isn't in one is left out above."""
    members, current, out = vectors.select(F.col("id").alias("node_id"), F.col("id").alias("child")), vectors, None
    for level, threshold in thresholds.items():
        found = cluster(current, threshold)
        big = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        found = found.join(big, "cluster")
        members = members.join(found.select(F.col("id").alias("child"), "cluster"), "child").select("node_id", F.col("cluster").alias("child"))
        rows = members.select("node_id", F.concat(F.lit(f"community_l{level}_"), F.col("child").cast("string")).alias("community_id"), F.lit(level).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        summed = found.join(current, "id").select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        current = summed.groupBy(F.col("cluster").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return out


def sizes(member: DataFrame) -> DataFrame:
    per = member.groupBy("level", "community_id").agg(F.count("*").alias("n"))
    return per.groupBy("level").agg(F.count("*").alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"))


def named(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """community_id, level, name, member_count with names made of the first members' names."""
    from ..functions import text as T

    rows = member.join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id", "left")
    per = rows.groupBy("community_id", "level").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 3).alias("names"), F.countDistinct("node_id").alias("member_count"))
    return per.select("community_id", "level", T.fallback_name(F.col("names")).alias("name"), "member_count")
