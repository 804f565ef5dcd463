"""Substring search through pieces and paths that meet in the middle, against plain loops."""

import itertools
import random

import pytest

from graphloom.operators import graph, names, tables

NODE = "id string, kind string, name string, type string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    r = random.Random(3)
    parts = ["ada", "xada", "Lee", "lee jr", "sr", "o'neil", "100%", "a_b", "Émile", "\U0001f600 fun", "i", "ab"]
    held = [(f"n{i}", r.choice(["indexable", "note"]), " ".join(r.choices(parts, k=r.randint(1, 3))), "t") for i in range(300)]
    held += [("c", "community", "ada", "t"), (None, "indexable", "ada", "t"), ("x", "indexable", None, "t"), ("e", "indexable", "", "t"), ("long", "indexable", "ada " * 5000, None), held[0]]
    nodes = spark.createDataFrame(held, NODE)
    return nodes, held, names.build(tables.Store(spark, str(tmp_path_factory.mktemp("names"))), nodes)


@pytest.mark.parametrize("width", [2048, 7])
def test_fuzzy_equals_the_scan(spark, people, monkeypatch, width):
    monkeypatch.setattr(graph, "WIDTH", width)
    _, held, index = people
    wanted = ["ada", " ADA ", "a", "ad", "", "a_b", "0%", "\U0001f600", "\U0001f600 f", "lee j", "none such", "xad", "ada ada ada ada ada", "émi", None]
    got = rows(index.fuzzy(spark.createDataFrame([(w, 1) for w in wanted], "pattern string, key int"), None), "matched", "id", "name")
    low = {w.lower().strip() for w in wanted if w is not None}
    good = {(i, n) for i, k, n, _ in held if k in ("indexable", "note") and i is not None and n is not None}
    assert got == sorted((w, i, n) for w in low for i, n in good if w in n.lower())


def test_fuzzy_keeps_the_first_of_each(spark, people):
    nodes, _, index = people
    got = index.fuzzy(spark.createDataFrame([("ada",), ("lee",)], "pattern string"), 5)
    want = [graph.match_fuzzy(nodes, [w], 5) for w in ("ada", "lee")]
    assert rows(got, "matched", "id") == sorted(rows(want[0], "matched", "id") + rows(want[1], "matched", "id"))


def test_variants_equal_those_of_one_base(spark, people):
    nodes, _, index = people
    got = index.variants(spark.createDataFrame([("Ada",), ("lee",), ("sr",), ("",), (None,), ("lee jr",)], "base string"))
    assert rows(got, "base", "id", "name") == sorted((b, *r) for b in ("ada", "lee", "sr", "lee jr") for r in rows(graph.variants(nodes, b), "id", "name"))


def test_an_index_without_names(spark, tmp_path):
    index = names.build(tables.Store(spark, str(tmp_path)), spark.createDataFrame([], NODE))
    assert index.fuzzy(spark.createDataFrame([("a",), ("abcd",)], "pattern string")).count() == 0


def plain_paths(ids, edges, hops, least):
    both = {(a, b, t, c) for s, d, t, k in edges if s != d and (c := 0.8 if k is None else k) >= least for a, b in ((s, d), (d, s))}
    out = []

    def walk(path, types, weights):
        if len(path) > 1 and path[-1] in ids and path[0] < path[-1]:
            out.append((len(types), tuple(path), tuple(types), tuple(weights)))
        if len(types) < hops:
            for a, b, t, c in both:
                if a == path[-1] and b not in path:
                    walk([*path, b], [*types, t], [*weights, c])

    for i in ids:
        walk([i], [], [])
    return sorted(out)


@pytest.mark.parametrize(("hops", "width"), [(1, 2048), (3, 2048), (4, 3)])
def test_paths_equal_the_plain_walk(spark, monkeypatch, hops, width):
    monkeypatch.setattr(graph, "WIDTH", width)
    r = random.Random(hops)
    edges = [(f"v{r.randrange(9)}", f"v{r.randrange(9)}", r.choice("ab"), r.choice([None, 0.4, 0.9])) for _ in range(11)]
    edges += [("hub", f"v{i}", "h", 0.7) for i in range(7)] + [edges[0]]
    ids = {f"v{i}" for i in range(5)} | {"alone"}
    got = graph.paths_between(spark.createDataFrame([(i,) for i in [*ids, "v1", None]], "id string"), spark.createDataFrame(edges, "src string, dst string, rel_type string, confidence double"), hops, limit=None)
    assert sorted((x["length"], tuple(x["path"]), tuple(x["rel_path"]), tuple(x["confidence_path"])) for x in got.collect()) == plain_paths(ids, edges, hops, 0.5)
    assert all(x["src"] == x["path"][0] and x["dst"] == x["path"][-1] for x in got.collect())


def test_walks_go_half_the_way(spark):
    edges = [(f"a{i}", "hub", "t", 1.0) for i in range(30)] + [("hub", f"b{i}", "t", 1.0) for i in range(30)]
    e = spark.createDataFrame(edges, "src string, dst string, rel_type string, confidence double")
    ids = spark.createDataFrame([("a0",), ("b0",)], "id string")
    assert graph.half_walks(ids, e, 2, 0.5).count() == 4 and graph.k_hop(ids, e, 2, 0.5).count() == 120
    assert rows(graph.paths_between(ids, e, 2), "path") == [(["a0", "hub", "b0"],)]


def test_hub_join_is_a_join(spark):
    a = [(k, i) for k, n in (("x", 40), ("y", 3), ("z", 1), (None, 2)) for i in range(n)]
    b = [(k, i) for k, n in (("x", 17), ("y", 25), ("w", 9), (None, 2)) for i in range(n)] + [("y", 0)]
    got = graph.hub_join(spark.createDataFrame(a, "k string, l int"), spark.createDataFrame(b, "k string, r int"), "k", 5)
    assert rows(got, "k", "l", "r") == sorted((k, i, j) for (k, i), (o, j) in itertools.product(a, b) if k is not None and k == o)
