import datetime as dt
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import communities, fold, graph, layout, search, tables
from graphloom.plans import ingest, quality, retrieval

DAY = dt.datetime(2024, 1, 1)


def said(*rows):
    return [{"event_id": i, "ts": DAY + dt.timedelta(hours=i), "src": s, "dst": t, "rel_type": k, "confidence": float(c)} for i, (s, t, k, c) in enumerate(rows)]


def test_fold_states():
    edges, done = fold.fold(said(("a", "b", "knows", 3), ("a", "b", "knows", 5), ("a", "b", "friends_with", 4), ("a", "b", "hates", 4), ("a", "c", "hates", 1), ("a", "c", "learning", 1), ("x", None, "knows", 1)))
    assert [d["action"] for d in done] == ["created", "reinforced", "evolved", "rejected", "created", "created_parallel", "failed"]
    assert edges["a", "b", "knows"]["mention_count"] == 2 and edges["a", "b", "knows"]["confidence"] == 5 and edges["a", "b", "knows"]["evolved_to"] == "friends_with"
    assert edges["a", "b", "friends_with"]["invalidated_by"] == "hates"  # the old one ends, the new one is still refused
    assert edges["b", "a", "friends_with"]["strength"] is None and ("a", "b", "hates") not in edges


def test_self_loop_counts_twice():
    edges, _ = fold.fold(said(("a", "a", "knows", 3)))
    assert edges["a", "a", "knows"]["mention_count"] == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("ab"), st.sampled_from(["knows", "friends_with", "hates", "learning", "works_with"]), st.integers(1, 9)), max_size=12), st.integers(0, 12))
def test_fold_in_two_parts_is_the_same(rows, cut):
    rows = said(*rows)
    whole, _ = fold.fold(rows)
    part, _ = fold.fold(rows[:cut])
    part, _ = fold.fold(rows[cut:], part)
    assert whole == part


def test_fold_as_tables(spark):
    rows = said(*(("a", f"k{i % 5}", k, i % 9 + 1) for i, k in enumerate(["knows", "friends_with", "hates", "learning", "works_with"] * 8)))
    df = spark.createDataFrame(rows)
    first = fold.fold_edges(df.where("event_id < 17"))
    got = {(r["src"], r["dst"], r["rel_type"]): (r["mention_count"], r["confidence"], r["valid_to"]) for r in fold.fold_edges(df.where("event_id >= 17"), first).collect()}
    want, _ = fold.fold(rows)
    assert got == {k: (e["mention_count"], e["confidence"], e["valid_to"]) for k, e in want.items()}


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("n1", "indexable", "ada lovelace", "person"), ("n2", "indexable", "ada", "person"), ("n3", "indexable", "ada jr", "person"), ("n4", "indexable", "engine", "thing"), ("o1", "note", None, None)], "id string, kind string, name string, type string")
    edges = spark.createDataFrame([("n1", "n4", "built", 9.0), ("n4", "n1", "by", 3.0), ("n2", "n1", "knows", None), ("n3", "n4", "sold", 2.0)], "src string, dst string, rel_type string, confidence double")
    return nodes, edges


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_names(small):
    nodes, _ = small
    assert rows(graph.match_fuzzy(nodes, ["ADA "]), "id") == [("n1",), ("n2",), ("n3",)]
    assert rows(graph.match_exact(nodes, ["Ada"]), "id") == [("n2",)]
    assert rows(graph.variants(nodes, "Ada"), "id") == [("n1",)]
    assert rows(retrieval.autocomplete(nodes, "ad"), "id") == [("n1",), ("n2",), ("n3",)] and retrieval.autocomplete(nodes, "a").count() == 0


def test_one_hop_prefers_outgoing(spark, small):
    nodes, edges = small
    got = rows(graph.one_hop(nodes.where("id = 'n1'"), edges, nodes), "node_id", "rel_type", "direction")
    assert got == [("n2", "knows", "incoming"), ("n4", "built", "outgoing")]


def test_paths(spark, small):
    nodes, edges = small
    got = rows(graph.k_hop(nodes.where("id = 'n2'"), edges, 2), "node_id", "depth", "rel_path")
    assert got == [("n1", 1, ["knows"]), ("n4", 2, ["knows", "built"]), ("n4", 2, ["knows", "by"])]
    assert rows(graph.k_hop(nodes.where("id = 'n2'"), edges, 2, least=0.5), "node_id") == []  # a missing confidence counts 0 here
    between = graph.paths_between(nodes.where("id in ('n2', 'n3')"), edges, 3)
    assert rows(between, "length") == [(3,), (3,)]


def test_delete_note(spark):
    ref = spark.createDataFrame([("o1", "a"), ("o1", "b"), ("o2", "b")], "note_id string, node_id string")
    nodes = spark.createDataFrame([("a",), ("b",), ("o1",)], "id string")
    left = tables.delete_note("o1", {"notes": nodes.where("id = 'o1'"), "nodes": nodes, "ref": ref, "rel": spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")})
    assert rows(left["nodes"], "id") == [("b",)] and rows(left["rel"], "src") == [("b",)] and left["notes"].count() == 0


def test_upserts_and_store(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 6.0)], "id int, name string, v double")
    assert rows(tables.upsert(old, new, ["id"]), "id", "name", "v") == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 6.0)]
    assert rows(tables.update(old, new, ["id"]), "id") == [(1,), (2,)]
    store = tables.Store(spark, str(tmp_path), "kb")
    assert not store.exists("t")
    assert (store.commit("t", old), store.commit("t", new, tag="b1"), store.version("t"), store.read("t").count()) == (0, 1, 1, 2)
    store.drop()
    assert not store.exists("t")
    with pytest.raises(ValueError, match="default"):
        tables.Store(spark, str(tmp_path)).drop()


def test_average_linkage_against_greedy():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((24, 4))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(24)]
    while True:
        d, a, b = min((1 - np.mean([u[x] @ u[y] for x in g for y in h]), i, j) for (i, g), (j, h) in itertools.combinations(enumerate(groups), 2))
        if d >= 0.6:
            break
        groups[a] += groups.pop(b)
    root = communities.average_linkage(v, 0.6)
    assert sorted(map(sorted, groups)) == sorted([i for i in range(24) if root[i] == r] for r in set(root.tolist()))


def test_hierarchy_and_vote(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((3, 8))
    v = [(f"e{i:02d}", [float(x) for x in base[i % 3] + 0.05 * rng.standard_normal(8)]) for i in range(12)]
    m = communities.hierarchy(spark.createDataFrame(v, "id string, v array<double>"))
    assert rows(m.where("level = 2").select("community_id").distinct(), "community_id") == [("community_l2_e00",), ("community_l2_e01",), ("community_l2_e02",)]


def test_layout_is_the_same_twice():
    a, b = (layout.spring(["a", "b", "c"], [("a", "b")]) for _ in range(2))
    assert (a == b).all() and np.linalg.norm(a[0] - a[1]) < np.linalg.norm(a[0] - a[2]) * 3


def test_merge_hits(spark):
    h = spark.createDataFrame([("A", 0.5, 0, "core", "x"), ("a", 0.9, 2, "more", None), ("a", 0.4, 2, "cor", None), ("B", 0.1, 1, "", "")], "name string, score double, origin int, text string, type string")
    assert rows(search.merge_hits(h), "name", "score", "summary", "type") == [("a", 0.9, "core more", "x"), ("b", 0.1, "", "")]


def test_ingest_and_answer(spark):
    notes = spark.createDataFrame([("o1", "Ada Lovelace wrote to Charles Babbage. Paris is far.", DAY), ("o2", "Charles Babbage built an Engine.", DAY), ("o3", None, DAY)], "id string, content string, ts timestamp")
    got = ingest.ingest(notes)
    assert {"ada lovelace", "charles babbage", "paris"} <= {r["name"] for r in got["nodes"].collect()}
    assert got["rel"].count() > 0 and got["ref"].where("note_id = 'o3'").count() == 0
    again = ingest.ingest(notes, {"nodes": got["nodes"], "contexts": got["contexts"]})
    assert again["nodes"].count() == got["nodes"].count() and again["contexts"].count() == got["contexts"].count()
    docs = spark.createDataFrame([("o1", "Ada", "note", "Ada Lovelace wrote notes. She liked Paris.", ""), ("o2", "Babbage", "note", "Charles Babbage built an engine.", "")], "node_id string, name string, type string, isolated_contexts string, relationship_natural_language string")
    nodes = docs.select(F.col("node_id").alias("id"), F.lit("indexable").alias("kind"), F.lower("name").alias("name"), "type")
    index = search.text_index(docs)
    out = retrieval.answer(spark, spark.createDataFrame([("q", "Who built an engine?")], "qid string, question string"), lambda q: retrieval.hybrid_search(q, nodes, docs, index)).first()
    assert "built an engine" in out["answer"] and out["rounds"] == 2


def test_mentions_and_metrics(spark):
    assert retrieval.tag_mentions("New York City is in New York", ["New York", "New York City"]) == [(0, 13, "New York City"), (20, 28, "New York")]
    r = spark.createDataFrame([("Paris", "Paris", 1.0, 0.5, 10.0, None), ("Rome", "x", 0.0, 0.5, 30.0, None), ("a", "b", 0.0, 0.0, 99.0, "timeout")], "expected string, actual string, precision double, recall double, total_time_ms double, error string")
    s = quality.summary(quality.answer_metrics(r)).first()
    assert (s["questions"], s["errors"], s["exact_match"], s["precision"], s["mean_ms"]) == (3, 1, 0.5, 0.5, 20.0)
    gold = spark.createDataFrame([("t", "Rome"), ("t", "Paris")], "test_id string, title string")
    got = quality.retrieval_metrics(gold, spark.createDataFrame([("t", "rome (city)"), ("t", "x")], "test_id string, title string")).first()
    assert (got["precision"], got["recall"]) == (0.5, 0.5)
