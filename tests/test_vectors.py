"""The stored vector index: equal to brute force, cells passed over, odd vectors."""

import numpy as np
import pytest

from graphloom.operators import cells, tables, vectors


def brute(rows, queries, k, least):
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    out = set()
    for q, qv in queries:
        if good(qv):
            s = sorted((-(round(float(unit(qv) @ unit(v)), 6) + 0.0), i) for i, v in rows if good(v) and len(v) == len(qv))
            s = [(i, -x) for x, i in s if least is None or -x >= least][:k]
            out |= {(q, i, x, n + 1) for n, (i, x) in enumerate(s)}
    return out


@pytest.mark.parametrize(("k", "least"), [(5, None), (3, 0.4), (200, 0.0), (1, 0.99)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, k, least):
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(vectors, "BATCH", 4)
    r = np.random.default_rng(k)
    base = r.standard_normal((7, 6))
    rows = [(i, [float(np.float32(x)) for x in base[i % 7] + 0.2 * r.standard_normal(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, None), (301, []), (302, [0.0] * 6), (303, [float("nan")] * 6), (304, [None, 1.0]), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    queries = [(f"q{i}", rows[i][1]) for i in range(0, 60, 3)] + [("z", [0.0] * 6), ("two", [1.0, 2.0]), ("no", None), ("bad", [float("inf")] * 6), ("three", [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, qid string, rank int")
    qs = spark.createDataFrame([(q, v, 5) for q, v in queries], "qid string, embedding array<double>, vec_id int")
    index = vectors.build(tables.Store(spark, str(tmp_path)), df)
    assert {(x["qid"], x["vec_id"], x["score"], x["rank"]) for x in index.search(qs, k, least).collect()} == brute(rows, queries, k, least)
    assert index.search(qs.limit(0), k, least).count() == 0


def test_cells_that_cannot_hold_a_hit_are_passed_over(spark, tmp_path):
    r = np.random.default_rng(5)
    base = r.standard_normal((30, 24))
    rows = [(i, (base[i % 30] + 0.1 * r.standard_normal(24)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vectors.build(tables.Store(spark, str(tmp_path)), df)
    queries = df.where("vec_id < 30").withColumnRenamed("vec_id", "qid")
    seen = index.counts(queries, 10, 0.8)
    assert seen["all"] == 30 * 30 and seen["read"] < 0.2 * seen["all"]
    hits = index.search(queries, 10, 0.8)
    assert {(x["qid"], x["vec_id"], x["score"], x["rank"]) for x in hits.collect()} == brute(rows, rows[:30], 10, 0.8)
    # One question reads the folders of its own cells only.
    index.search(queries.limit(1), 10, 0.8).count()
    one = index._products(spark.createDataFrame([(0, 1, b"", 0.0)], "cell int, qid long, q binary, bar double"), 5)
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString() and "cell#" in one._jdf.queryExecution().toString()


def test_an_index_without_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vectors.build(tables.Store(spark, str(tmp_path)), none)
    assert index.search(spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>"), 3).count() == 0


def test_linkage_compares_few_of_all_pairs(spark):
    """Compared pairs grow clearly slower than the square: ten times the vectors of as many more groups."""
    from graphloom.operators import communities

    counts = []
    for n in (3_000, 30_000):
        r = np.random.default_rng(n)
        base = r.standard_normal((n // 100, 24))
        v = base[np.arange(n) % (n // 100)] + 0.1 * r.standard_normal((n, 24))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        counts.append(communities.compared(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"), 0.25))
    assert counts[0][0] < 0.3 * counts[0][1] and counts[1][0] < 0.1 * counts[1][1]
    assert counts[1][0] / counts[0][0] < 50  # all pairs: 100
