"""What the findings of round 4 name."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import graph, mentions, phrases, tables, vectors
from graphloom.operators.textindex import TextIndex


def test_layout_has_every_edge(spark):
    """edges after the first 5,000 were dropped."""
    edges = spark.range(6000).selectExpr("concat('a', id) AS src", "concat('b', id) AS dst")
    member = spark.range(50).selectExpr("concat('a', id) AS node_id", "'g' AS community_id")
    drawn = graph.layout_edges(edges.union(edges.limit(10)), member)
    assert drawn.count() == drawn.distinct().count() == 6050


@pytest.mark.parametrize(("characters", "compared"), [(1 << 20, 1 << 20), (7, 5)])
def test_phrases_are_found_as_by_a_plain_loop(monkeypatch, characters, compared):
    """every place where a name lies whole, over windows of a long text too, and what is kept where they overlap."""
    monkeypatch.setattr(phrases, "CHARACTERS", characters)
    monkeypatch.setattr(phrases, "COMPARED", compared)
    r = random.Random(11)
    pieces = ["a", "b", "ab", " ", " ", "-", "+", "é", "_", "\U0001f600", "\u0130", "\n", "я", "\0"]
    names = sorted({"".join(r.choices(pieces, k=r.randint(1, 7))) for _ in range(150)} | {"a b a b a b a b"})
    texts = ["".join(r.choices(pieces, k=r.choice([1, 3, 40, 200]))) for _ in range(60)] + ["a b " * 30]
    held, got = phrases.Phrases(pa.array(names)), []
    for first, some in enumerate(phrases.parcels(pa.array(texts))):
        at = sum(len(x) for x in list(phrases.parcels(pa.array(texts)))[:first])
        of, a, b, name = held.find(some)
        for longest in (True, False):
            kept = phrases.apart(of, a, b, longest, mentions.apart)
            for i in range(len(some)):
                spans = list(zip(a[of == i].tolist(), b[of == i].tolist(), strict=True))
                assert list(zip(a[kept & (of == i)].tolist(), b[kept & (of == i)].tolist(), strict=True)) == mentions.apart(spans, longest)
        got += list(zip((of + at).tolist(), a.tolist(), b.tolist(), held.names(name), strict=True))
    inside = lambda t, i: 0 <= i < len(t) and (t[i].isalnum() or t[i] == "_")
    want = [(i, a, a + len(n), n) for i, t in enumerate(texts) for a in range(len(t)) for n in names if t.startswith(n, a) and not inside(t, a - 1) and not inside(t, a + len(n))]
    assert got == sorted(want) and len(got) > 300


@pytest.mark.parametrize("held", [None, 0])
def test_mentions_are_found_where_the_texts_are_read(spark, monkeypatch, held):
    """texts were cut for every slot of names and shuffled, and so were mentions; a dictionary too large for that still is dealt to shards."""
    if held is not None:
        monkeypatch.setattr(mentions, "HELD", held)
    texts = spark.createDataFrame([(1, "Ada met ada Lovelace; ADA, b"), (2, "none"), (None, "ada"), (3, "b-b ada")], "id long, text string")
    names = spark.createDataFrame([("ada",), ("Ada Lovelace",), ("b",), ("b-b",)], "name string")
    tags, counts = mentions.tag(texts, names), mentions.counts(texts, names)
    assert sorted(map(tuple, tags.collect())) == [(1, 0, 3, "Ada"), (1, 8, 20, "ada Lovelace"), (1, 22, 25, "ADA"), (1, 27, 28, "b"), (3, 0, 3, "b-b"), (3, 4, 7, "ada")]
    assert sorted(map(tuple, counts.collect())) == [(1, "ada", 2), (1, "ada lovelace", 1), (1, "b", 1), (3, "ada", 1), (3, "b-b", 1)]
    assert sorted(map(tuple, mentions.hits(texts.where("id = 3"), names).collect())) == [(3, 0, 1), (3, 0, 3), (3, 2, 3), (3, 4, 7)]
    assert ("Exchange" in tags._jdf.queryExecution().executedPlan().toString()) == (held == 0)


def test_a_query_is_not_copied_to_every_cell(spark, monkeypatch, tmp_path):
    """a task held a row with the query's vector for each pair of a query and a cell, and all hits of all blocks."""
    for name, value in (("ROWS", 3), ("PAIRS", 5), ("GROUP", 4096)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(3)
    v = np.round(r.standard_normal((300, 6)), 1)
    v[200:] = v[:100]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = vectors.build(tables.Store(spark, str(tmp_path)), rows, cells=20)
    asked = rows.where("vec_id % 7 = 0").withColumnRenamed("vec_id", "qid")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for q in range(0, 300, 7):
        score = np.round(unit @ unit[q], 6) + 0.0
        want += [(q, int(i), float(score[i]), n + 1) for n, i in enumerate(np.lexsort((np.arange(300), -score))[:4])]
    assert sorted(map(tuple, index.search(asked, 4, -1.0).select("qid", "vec_id", "score", "rank").collect())) == sorted(want)
    q = asked.selectExpr("qid", "embedding as q", "-1.0D as bar")
    pairs, cells = index.reached(q, 4, False), len({g for _, g, _ in index._groups()})
    assert pairs.count() <= 43 * cells < index.counts(asked, 4)["all"] / 2
    assert "q" in pairs.columns and pairs.selectExpr("max(size(cells))").first()[0] > 1


def test_superseded_segments_and_read_changes_go(spark, tmp_path):
    """every segment that a merge had made needless stayed on disk, and so did every file of changes that the stream had read."""
    index = TextIndex(tables.Store(spark, str(tmp_path)), {"body": 1.0}, "id", buckets=2, keep=1)
    for batch in range(4):
        index.upsert(spark.createDataFrame([(i, f"ada w{batch}") for i in range(batch, 6)], "id long, body string"), batch)
        named = {s["path"] for s in index._segments()}
        assert {f"{tmp_path}/default/text_segments/{x}" for x in os.listdir(f"{tmp_path}/default/text_segments")} == named
    assert {(r["id"], r["body"]) for r in index.documents().collect()} == {(i, f"ada w{min(i, 3)}") for i in range(6)}
    assert index.search(spark.createDataFrame([("q", "w3")], "qid string, term string"), 9).count() == 3
    kept = TextIndex(tables.Store(spark, str(tmp_path)), {"body": 1.0}, "id", table="other", buckets=2)
    for batch in range(3):
        kept.upsert(spark.createDataFrame([(1, f"w{batch}")], "id long, body string"), batch)
    assert len(os.listdir(f"{tmp_path}/default/other_segments")) > len(kept._segments())  # readers of old manifests may go on


def test_the_stream_of_changes_leaves_no_read_files(spark, monkeypatch, tmp_path):
    from graphloom import catalog_texts

    monkeypatch.setattr(catalog_texts, "shared_path", lambda spark, name: str(tmp_path / name))
    rows = catalog_texts.text_index_stream(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    assert spark.read.parquet(f"{tmp_path}/changes/in").selectExpr("min(at)").first()[0] == 2  # a batch's files go as the next one begins
    assert len(os.listdir(f"{tmp_path}/changes/store/default/text_segments")) == len(TextIndex(tables.Store(spark, f"{tmp_path}/changes/store"))._segments())
