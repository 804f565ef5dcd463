"""A stored index for exact vector search: only cells that can hold a hit are read, their vectors multiplied as matrices.

Defined cases: vectors that are null, or hold nulls or values that aren't finite, take no part, as queries or as vectors; a vector of
zeros has cosine 0 with all; only vectors of a query's dimension are compared; ties go to the smaller id; of a repeated id every row counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from .tables import Store

#: Queries and bytes of vectors that meet in one task.
BATCH, GROUP = 4096, 8 << 20
#: Queries that are multiplied at once, and rows that a task makes before it hands them on.
ROWS, PAIRS = 256, 4096
_SLACK = 1e-5  # scores are rounded to six places
_ROUNDED = 1e-6  # rounding makes no more of a score


def _usable(rows: DataFrame, column: str) -> DataFrame:
    """rows whose vector is whole, as doubles of length 1."""
    whole = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))

    @F.pandas_udf("array<double>")
    def unit(v: pd.Series) -> pd.Series:
        return pd.Series([C.as_unit(np.asarray(x, dtype=float)[None, :])[0] for x in v])

    return rows.where(whole).withColumn(column, unit(F.col(column).cast("array<double>")))


def build(store: Store, vectors: DataFrame, name: str = "vectors", cells: int | None = None) -> VectorIndex:
    """Writes the index of vectors(vec_id, embedding): cells of about the root of their number, fitted on cells.SAMPLE vectors, holding all."""
    rows = _usable(vectors.select(F.col("vec_id").alias("id"), "embedding"), "embedding")
    store.commit(f"{name}_units", rows)
    rows = store.read(f"{name}_units")
    n = rows.count()
    wanted = cells or int(min(C.MOST, max(1, n**0.5)))
    placed = C.dealt(C.with_cell(rows, C.fit(C.sampled(rows, "embedding"), wanted), "embedding"))
    store.commit(f"{name}_blocks", C.blocks(placed, "embedding"), partition_by=["cell"])
    store.commit(f"{name}_cells", C.heads(store.read(f"{name}_blocks", C.block_schema(rows.schema["id"].dataType.simpleString()))))
    return VectorIndex(store, name)


class VectorIndex:
    """A written index. The cells' centroids and radii (at most cells.MOST and one for each further dimension) are read here, the blocks by searches."""

    def __init__(self, store: Store, name: str = "vectors"):
        self.store, self.name = store, name
        self.kind = store.read(f"{name}_units").schema["id"].dataType.simpleString()
        heads = store.read(f"{name}_cells").toPandas()
        self.cells = {int(d): (g["cell"].to_numpy(), g["n"].to_numpy(), C.matrix(g["center"]), g["radius"].to_numpy()) for d, g in heads.groupby("dims")}

    def _groups(self) -> list[tuple[int, int, int]]:
        """cell, grp, parts: cells that go together, about GROUP bytes of them, and into how many parts a large one goes."""
        size: dict[int, int] = {}
        for dims, (cell, n, *_) in self.cells.items():
            for c, m in zip(cell.tolist(), n.tolist(), strict=True):
                size[c] = size.get(c, 0) + 8 * dims * m
        of, grp, held = [], 0, 0
        for c in sorted(size):  # at most cells.MOST and one for each further dimension
            if held and held + size[c] > GROUP:
                grp, held = grp + 1, 0
            of.append((c, grp, max(1, -(-size[c] // GROUP))))
            held += size[c]
        return of

    def reached(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """grp, qid, q, bar, cells for queries(qid, q, bar) and the cells that they have to read, a row for each group of cells: at first the
        nearest ones that hold k vectors, after that all others in which a vector can reach the bar."""
        shared = queries.sparkSession.sparkContext.broadcast((self.cells, {c: g for c, g, _ in self._groups()}))
        qid = queries.schema["qid"].dataType.simpleString()

        def run(frames):
            cells, group = shared.value
            for f in C.in_batches(frames):
                out = []
                for i, q, bar in zip(f["qid"], f["q"], f["bar"], strict=True):
                    if len(q) not in cells:
                        continue
                    cell, n, center, radius = cells[len(q)]
                    away = np.sqrt(np.maximum(0, ((center - np.asarray(q)) ** 2).sum(1)))
                    best = 1 - np.maximum(0, away - radius) ** 2 / 2
                    order = np.argsort(away, kind="stable")
                    near = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                    mine = near if first else np.setdiff1d(np.flatnonzero(best >= bar - _SLACK), near)
                    own: dict[int, list[int]] = {}
                    for c in cell[mine[best[mine] >= bar - _SLACK]].tolist():
                        own.setdefault(group[c], []).append(c)
                    out += [(g, i, np.asarray(q).tobytes(), bar, x) for g, x in own.items()]
                    if len(out) >= PAIRS:
                        yield pd.DataFrame(out, columns=["grp", "qid", "q", "bar", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["grp", "qid", "q", "bar", "cells"])

        return queries.select("qid", "q", "bar").mapInPandas(run, f"grp int, qid {qid}, q binary, bar double, cells array<int>")

    def _products(self, pairs: DataFrame, k: int) -> DataFrame:
        """qid, vec_id, score of the k best hits of every query and group of cells, of pairs(grp, qid, q, bar, cells), a written table; or of
        pairs(cell, qid, q, bar).

        Cells go together in groups of about GROUP bytes, large ones in parts; a query is copied to a group once, whatever number of its cells it reaches."""
        spark, qid, of = pairs.sparkSession, pairs.schema["qid"].dataType.simpleString(), self._groups()
        if "cell" in pairs.columns:
            pairs = pairs.join(F.broadcast(spark.createDataFrame([x[:2] for x in of], "cell int, grp int")), "cell").groupBy("grp", "qid", "q", "bar").agg(F.collect_list("cell").alias("cells"))
        counts = pairs.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("qid") / BATCH).cast("int")).alias("batches")).collect()  # a row for each group
        # Only groups that are asked for are read.
        parts = {g: max(p for _, x, p in of if x == g) for g in {r["grp"] for r in counts}}
        groups = F.broadcast(spark.createDataFrame([(c, g, parts[g]) for c, g, _ in of if g in parts], "cell int, grp int, parts int"))
        batches = lambda: F.broadcast(spark.createDataFrame([(*r, parts[r["grp"]]) for r in counts], "grp int, batches int, asked_parts int"))  # noqa: E731 - a frame for each side of the cogroup
        asked = pairs.join(batches(), "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1))).select("grp", "part", F.pmod(F.xxhash64("qid"), F.col("batches")).cast("int").alias("batch"), "qid", "q", "bar", "cells")
        blocks = self.store.read(f"{self.name}_blocks", C.block_schema(self.kind)).join(groups, "cell").join(batches(), "grp")
        blocks = blocks.select("grp", F.pmod("sub", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"), "cell", "dims", "ids", "vectors", "center", "radius")

        def run(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            by_cell: dict[tuple, list[int]] = {}
            for i, (q, own) in enumerate(zip(asked["q"], asked["cells"], strict=True)):
                for c in own:  # a query that came twice reaches its cells twice
                    by_cell.setdefault((c, len(q) // 8), []).append(i)
            bars, found = asked["bar"].to_numpy(dtype=float).copy(), []

            def best() -> pd.DataFrame:
                """The k best so far of every query; from now on only what reaches the last of k counts."""
                hits = pd.DataFrame({c: np.concatenate([x[j] for x in found]) for j, c in enumerate(("i", "vec_id", "score"))} if found else {"i": [], "vec_id": [], "score": []})
                hits = hits.sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i").head(k)
                full = hits.groupby("i")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                at = full.index.to_numpy(dtype=int)
                bars[at] = np.maximum(bars[at], full["min"].to_numpy(dtype=float))
                found[:] = [(hits["i"].to_numpy(dtype=int), hits["vec_id"].to_numpy(), hits["score"].to_numpy(dtype=float))] if len(hits) else []
                return hits

            for cell, dims, ids, vectors, center, radius in zip(*(blocks[c] for c in ("cell", "dims", "ids", "vectors", "center", "radius")), strict=True):
                mine = np.array(by_cell.get((cell, dims), ()), dtype=int)
                held, ids = np.frombuffer(vectors).reshape(len(ids), dims).T, np.asarray(ids)
                for a in range(0, len(mine), ROWS):
                    some = mine[a : a + ROWS]
                    q = np.stack([np.frombuffer(x) for x in asked["q"].iloc[some]])
                    away = np.sqrt(((q - np.asarray(center)) ** 2).sum(1))
                    can = np.flatnonzero(1 - np.maximum(0, away - radius) ** 2 / 2 >= bars[some] - _SLACK)
                    if not len(can):
                        continue
                    score = q[can] @ held
                    least = bars[some[can]] - _ROUNDED
                    if score.shape[1] > k and np.count_nonzero(score >= least[:, None]) > 4 * k * len(can):
                        least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k] - _ROUNDED)
                    row, col = np.nonzero(score >= least[:, None])
                    value = np.round(score[row, col], 6) + 0.0
                    good = value >= bars[some[can]][row]
                    row, col, value = row[good], col[good], value[good]
                    order = np.lexsort((-value, row))  # ids ascend, so a stable sort leaves ties to the smaller
                    row, col, value = row[order], col[order], value[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    found.append((some[can[row[kept]]], ids[col[kept]], value[kept]))
                if sum(len(x[0]) for x in found) > 2 * k * max(ROWS, len(asked)):
                    best()
            hits = best()
            return pd.DataFrame({"qid": asked["qid"].iloc[hits["i"].astype(int)].to_numpy(), "vec_id": hits["vec_id"].to_numpy(), "score": hits["score"].to_numpy(dtype=float)})

        keys = ["grp", "part", "batch"]
        return asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(run, f"qid {qid}, vec_id {self.kind}, score double")

    def search(self, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
        """qid, vec_id, score, rank: the k best by cosine, of at least `least`, for every query(qid, embedding)."""
        spark = queries.sparkSession
        q = _usable(queries.select("qid", "embedding"), "embedding").select("qid", F.col("embedding").alias("q"), F.lit(-1.0 if least is None else float(least)).alias("bar"))
        step = Store(spark, self.store.path, f"{self.store.slug}/searches")
        step.commit(f"{self.name}_queries", q)
        q = step.read(f"{self.name}_queries")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
        ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        def hits(queries: DataFrame, first: bool) -> DataFrame:
            name = f"{self.name}_pairs{int(first)}"
            step.commit(name, self.reached(queries, k, first))
            return self._products(step.read(name), k)

        step.commit(f"{self.name}_first", ranked(hits(q, True)))
        first = step.read(f"{self.name}_first")
        # A query that has k hits needs only what reaches its last one.
        last = first.where(F.col("rank") == k).groupBy("qid").agg(F.max("score").alias("kth"))
        bars = q.join(last, "qid", "left").select("qid", "q", F.greatest("bar", F.coalesce("kth", "bar")).alias("bar"))
        return ranked(first.select("qid", "vec_id", "score").unionByName(hits(bars, False))).select("qid", "vec_id", "score", "rank")

    def counts(self, queries: DataFrame, k: int, least: float | None = None) -> dict[str, int]:
        """How many pairs of a query and a cell a search reads at most when `least` is the only bar, and how many there are."""
        q = _usable(queries.select("qid", "embedding"), "embedding").select("qid", F.col("embedding").alias("q"), F.lit(-1.0 if least is None else float(least)).alias("bar"))
        read = sum(self.reached(q, k, first).agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0] for first in (True, False))
        return {"read": read, "all": q.count() * sum(len(c) for c, *_ in self.cells.values())}
