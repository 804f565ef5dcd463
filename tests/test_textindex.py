"""A text index under changes, against one that is built anew and against plain loops."""

import glob
import math
import os
import random
import re

import pytest

from graphloom.operators import search, tables
from graphloom.operators.textindex import TextIndex

FIELDS = {"name": 3.0, "body": 1.0}
DOC = "id string, name string, body string, level int"
WORDS = ["ada", "Bee", "c3", "größe", "the", "x", "of"]


def plain(docs: dict, queries: dict, k1=1.2, b=0.75) -> list:
    cut = {i: {f: None if d[f] is None else re.findall(r"[^\W_]+", d[f].lower()) for f in FIELDS} for i, d in docs.items()}
    out = []
    for q, terms in queries.items():
        for i in cut:
            score, hit = 0.0, False
            for f, w in FIELDS.items():
                known = [c[f] for c in cut.values() if c[f] is not None]
                mean = sum(map(len, known)) / len(known) if known else 0
                for t in {x.lower() for x in terms}:
                    tf, df = (cut[i][f] or []).count(t), sum(t in c for c in known)
                    if tf:
                        hit = True
                        score += w * math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(cut[i][f]) / (mean or 1)))
            if hit:
                out.append((q, i, round(score, 5)))
    return sorted(out)


def found(index: TextIndex, spark, queries: dict) -> list:
    terms = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid string, term string")
    return sorted((r["qid"], r["id"], round(r["score"], 5)) for r in index.search(terms, 10**6).collect())


def held(index: TextIndex) -> dict:
    rows = index.documents().collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r.asDict() for r in rows}


def close(a: list, b: list) -> bool:
    return [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 2e-5 for x, y in zip(a, b, strict=True))


QUERIES = {"a": ["ADA", "the", "none"], "b": ["größe", "c3", "c3"], "c": ["absent"]}


def doc(r: random.Random, i: str) -> tuple:
    text = lambda n: r.choice([None, "", " ".join(r.choices(WORDS, k=r.randint(1, n)))])
    return (i, text(3), text(12), r.randint(0, 9))


@pytest.mark.parametrize("merge_at", [None, 4.0])
def test_changes_equal_plain_loops(spark, tmp_path, merge_at):
    r = random.Random(5)
    index = TextIndex(tables.Store(spark, str(tmp_path)), FIELDS, "id", buckets=4, merge_at=merge_at)
    first = [doc(r, f"d{i}") for i in range(40)]
    index.upsert(spark.createDataFrame([*first, first[0], (None, "ada", "ada", 1)], DOC))
    want = {d[0]: dict(zip(("id", "name", "body", "level"), d, strict=True)) for d in first}
    for step in range(6):
        some = r.sample(range(50), 4)
        if step % 3 == 0:
            rows = [doc(r, f"d{i}") for i in some]
            index.upsert(spark.createDataFrame([(*x, 7) for x in rows], DOC + ", other int"))
            want |= {d[0]: dict(zip(("id", "name", "body", "level"), d, strict=True)) for d in rows}
        elif step % 3 == 1:
            index.delete(spark.createDataFrame([(f"d{i}",) for i in some] + [("no",), (None,), (f"d{some[0]}",)], "id string"))
            want = {k: v for k, v in want.items() if k not in {f"d{i}" for i in some}}
        else:
            rows = [(f"d{i}", r.choice([None, "the ada new"]), i) for i in some]
            index.update(spark.createDataFrame(rows, "id string, name string, level int"))
            for k, name, level in rows:
                if k in want:
                    want[k] = want[k] | {"level": level} | ({} if name is None else {"name": name})
        if step in (2, 5):
            assert held(index) == want
            assert close(found(index, spark, QUERIES), plain(want, QUERIES))
    segments = index._segments()
    assert len(segments) == 7 if merge_at is None else len(segments) < 5
    anew = search.text_lengths(spark.createDataFrame([tuple(d.values()) for d in want.values()], DOC), FIELDS)
    assert index.lengths() == pytest.approx(anew)
    before = found(index, spark, QUERIES)
    assert index.merge() == len(segments) and len(index._segments()) == 1
    assert held(index) == want and found(index, spark, QUERIES) == before
    assert index.vacuum(keep=1) >= len(segments) and found(index, spark, QUERIES) == before


def test_changes_leave_old_segments_alone(spark, tmp_path):
    index = TextIndex(tables.Store(spark, str(tmp_path)), {"body": 1.0}, "id", buckets=4)
    index.upsert(spark.createDataFrame([(i, f"ada w{i % 7}") for i in range(200)], "id long, body string"))
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/default/text_segments/**/*.parquet", recursive=True)}
    index.upsert(spark.createDataFrame([(3, "bee"), (500, "ada")], "id long, body string"))
    index.delete(spark.createDataFrame([(4,), (5,)], "id long"))
    assert {f: os.stat(f).st_mtime_ns for f in files} == files
    segments = index._segments()
    assert segments[0]["docs"] == 200 and sum(s["docs"] for s in segments[1:]) == 2 and sum(s["gone"] for s in segments[1:]) == 3
    got = {x[1] for x in found(index, spark, {"q": ["ada"]})}
    assert got == {i for i in range(200) if i not in (3, 4, 5)} | {500}
    index.upsert(spark.createDataFrame([(4, "ada again")], "id long, body string"))  # one that went comes back
    assert 4 in {x[1] for x in found(index, spark, {"q": ["ada"]})}


def test_a_search_prunes_the_buckets_of_its_terms(spark, tmp_path):
    index = TextIndex(tables.Store(spark, str(tmp_path)), {"body": 1.0}, "id", buckets=16)
    index.upsert(spark.createDataFrame([(i, f"w{i % 100} common") for i in range(300)], "id long, body string"))
    read = index.postings(spark.createDataFrame([("common",)], "term string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+|PartitionFilters: \[[^\]]*bucket#\d+ IN \(\d+\)", plan), plan
    assert read.count() == 300


def test_empty_index_and_batches_that_come_again(spark, tmp_path):
    index = TextIndex(tables.Store(spark, str(tmp_path)), {"body": 1.0}, "id", buckets=2)
    index.delete(spark.createDataFrame([(1,)], "id long"))
    assert not index.store.exists("text")
    index.upsert(spark.createDataFrame([], "id long, body string"))
    assert found(index, spark, {"q": ["a"]}) == [] and held(index) == {}
    changes = spark.createDataFrame([(1, "a", 1, False), (1, "a b", 2, None), (2, "a", 1, False), (2, None, 2, True), (3, "a", 1, True)], "id long, body string, at long, deleted boolean")
    for _ in range(2):
        index.apply(changes, ["at"], batch=0)
    assert {i: d["body"] for i, d in held(index).items()} == {1: "a b"}
    index.update(spark.createDataFrame([(9, "a new one"), (1, None)], "id long, body string"), create=True, batch=1)
    index.delete(spark.createDataFrame([(1,)], "id long"), batch=1)  # came before
    assert {i: d["body"] for i, d in held(index).items()} == {1: "a b", 9: "a new one"}
    assert len(found(index, spark, {"q": ["a"]})) == 2


def test_neither_texts_nor_postings_are_shuffled(spark, tmp_path):
    """Texts and a row for each posting went through a shuffle for every segment and merge, and batches of different ids through a maximum of whole rows."""
    index = TextIndex(tables.Store(spark, str(tmp_path)), {"name": 3.0, "body": 1.0}, "id", buckets=2)
    rows = [(i, f"n{i}", " ".join(f"w{j}" for j in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "id long, name string, body string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert index._last(docs, ["name"]) is docs
    twice = index._last(spark.createDataFrame([*rows, (3, "n9", None)], docs.schema), ["name"])
    assert twice.count() == 50 and [r["name"] for r in twice.where("id = 3").collect()] == ["n9"]
    index.upsert(docs)
    index.delete(docs.where("id < 10"))
    held = index._segments()
    posts = index._read(held[:1], "postings", index._posting(held))
    assert 50 < posts.count() <= 50 * (2 + 1)  # a row for each bucket of a text, and one of a name
    assert not [x for df in (index._few(posts), index._cut(held[0]["path"], "long", docs.schema)) for x in plan(df).split("\n") if "Exchange" in x]
    assert "hashpartitioning(id" not in plan(index._few(index._live(posts, held))).split("BroadcastExchange")[0]
    assert {x[1] for x in found(index, spark, {"q": ["w7"]})} == set(range(10, 50))
