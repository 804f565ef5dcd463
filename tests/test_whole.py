"""Operators do the whole job: cases in which a cutoff or a switch by size would lose rows."""

import numpy as np
import pytest

from graphloom.operators import communities, layout, search


@pytest.mark.parametrize("threshold", [0.25, 0.75])
def test_clusters_of_many_vectors_are_exact(spark, monkeypatch, threshold):
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 16))
    v = np.concatenate([base[r.integers(0, 60, 600)] + 0.5 * r.standard_normal((600, 16)), np.zeros((2, 16))])
    v[100:140] = v[0]
    v[140:150] = 3 * v[1]
    want = communities.average_linkage(v, threshold)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(communities, "MOST", 50)
    monkeypatch.setattr(communities, "BLOCK", 128, raising=False)
    got = {x["id"]: x["cluster"] for x in communities.cluster(df, threshold).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()


def test_merge_of_all_hits_has_no_limit(spark, tmp_path):
    from graphloom.catalog import vector_multi_merge

    df = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
    assert search.vector_top_k(df, [1.0, 0.0], None, None).count() == 6
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vector_multi_merge(spark, str(tmp_path))
    assert {r["name"]: r["hits"] for r in got.collect()} == {"name0": 3, "name1": 3}
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_spring_layout_against_plain_loops():
    """The vectorised layout does what nested loops over pairs and edges do."""
    import hashlib
    import math

    ids, pairs = [f"n{i}" for i in range(9)], [("n0", "n1"), ("n1", "n2"), ("n3", "n4"), ("n5", "n5"), ("n6", "x")]
    k, gravity, heat = 220.0, 0.02, 220.0
    pos = {x: [(int(hashlib.md5(x.encode()).hexdigest()[j : j + 6], 16) / 0xFFFFFF - 0.5) * k * 2 for j in (0, 6, 12)] for x in ids}
    for _ in range(5):
        move = {x: [-gravity * v for v in pos[x]] for x in ids}
        for a in ids:
            for b in ids:
                d = [p - q for p, q in zip(pos[a], pos[b], strict=True)]
                r = max(math.sqrt(sum(v * v for v in d)), 0.01)
                move[a] = [m + v / r * (k * k / r) for m, v in zip(move[a], d, strict=True)]
        for a, b in pairs:
            if a in pos and b in pos and a != b:
                d = [p - q for p, q in zip(pos[a], pos[b], strict=True)]
                r = max(math.sqrt(sum(v * v for v in d)), 0.01)
                move[a] = [m - v / r * (r * r / k) for m, v in zip(move[a], d, strict=True)]
                move[b] = [m + v / r * (r * r / k) for m, v in zip(move[b], d, strict=True)]
        for x in ids:
            size = max(math.sqrt(sum(v * v for v in move[x])), 1e-9)
            pos[x] = [p + m / size * min(size, heat) for p, m in zip(pos[x], move[x], strict=True)]
        heat *= 0.95
    got = layout.spring(ids, pairs, steps=5)
    assert all(abs(g - w) < 1e-6 for row, x in zip(got, ids, strict=True) for g, w in zip(row, pos[x], strict=True))


def test_average_linkage_against_a_plain_loop():
    """Merging the two nearest clusters by the mean of all their pairs' distances, as long as it is under the threshold."""
    r = np.random.default_rng(11)
    v = r.standard_normal((6, 12))[r.integers(0, 6, 60)] + 0.35 * r.standard_normal((60, 12))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for threshold in (0.25, 0.35, 0.75):
        parts = [[i] for i in range(60)]
        while True:
            best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j), default=(2, 0, 0))
            if best[0] >= threshold:
                break
            parts[best[1]] += parts.pop(best[2])
        got = communities.average_linkage(v, threshold)
        assert sorted(sorted(p) for p in parts) == sorted(np.flatnonzero(got == g).tolist() for g in np.unique(got))


def test_ordinals_on_a_sphere_follow_the_order(spark):
    rows = spark.range(5000).selectExpr("concat('k', id) as id")
    got = layout.on_sphere(rows, 1.0).select("id", "pos.y").toPandas().sort_values("id")["y"].to_numpy()
    assert np.allclose(got, 1 - np.arange(5000) / 4999 * 2)
