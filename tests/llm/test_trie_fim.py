"""The conversation trie and fill-in-middle examples against plain loops, and on odd tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fim, trie


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        made[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {p: sum(q[:-1] == p for q in members if len(q) == len(p) + 1) for p in members}
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ended = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out[(min(m), len(p))] = (min(members[p[:-1]]) if p else None, len(m), kids[p], sum(kids[q] == 0 for q in below), sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(ended.encode()).hexdigest())
    return out


def check_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    got = trie.nodes(df).collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(got) == len(found)
    assert found == plain_trie(rows)


def test_trie_against_plain_loops(spark):
    r = np.random.default_rng(3)
    rows = []
    for c in [*range(40), *range(100, 130), 250, 251, 399, -5, -105]:
        for t in range(int(r.integers(0, 12))):
            rows.append((c, t, "user" if t % 2 else None, f"é{int(r.integers(0, 2))}" if r.random() < 0.9 else None))
    rows += [(7, 3, "user", "again")] * 3 + [(8, None, "z", "late"), (8, None, None, None), (None, 1, "user", "lost"), (300, 0, "user", "only one"), (301, 0, "a", "b")]
    check_trie(spark, rows)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 16)
    rows = [(1, t, "user", f"t{t % 3}") for t in range(150)] + [(c, t, "user", f"t{t % 3}") for c in range(2, 30) for t in range(70 + c % 2)]
    check_trie(spark, rows)


def test_trie_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(empty).count() == 0
    assert trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], empty.schema)).count() == 0


TEXTS = ["a\nb\nc", "one line", "\n", "\n\n", "a\n", "\na", "", None, "x <P> y\nz", "x\n<S>", "<\nP>\n<S\n>", "é😀\n漢字\r\nend\n", "<\n<\nP\n>", "w  x\ty ", " lead 12ab3é😀!", "x" * 50_000 + "\n" + "y\n" * 2000]


@pytest.mark.parametrize("grammar", list(fim.GRAMMARS))
def test_units_are_those_of_the_grammar(spark, grammar):
    texts = [t for t in TEXTS if t is not None] + ["".join(np.random.default_rng(i).choice(list("ab1 \n\té😀.\x0b \x85\r"), 30)) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (t, u) in df.select("t", fim.units(F.col("t"), grammar).alias("u")).collect():
        assert u == re.findall(fim.GRAMMARS[grammar][0].replace(r"\x{", "{"), t)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (100, 0)])
def test_examples(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc\n"), (3, "twice\nthe id")]
    df = spark.createDataFrame([(i, t, "p", "o", 1) for i, t in rows], "doc_id long, text string, prefix string, _f string, n int")
    made = fim.transform(df, rate=rate, spm=spm)
    got = sorted(made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect(), key=str)
    want = []
    for i, t in rows:
        t = t or ""
        u = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(x in t for x in fim.SENTINELS) or h3 % 100 >= rate:
            want.append((i, len(u), "plain", None, None, t))
        elif h4 % 100 < spm:
            want.append((i, len(u), "spm", p, m, f"<S>{s}<P>{p}<M>{m}"))
        else:
            want.append((i, len(u), "psm", p, m, f"<P>{p}<S>{s}<M>{m}"))
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["back"] == (r["text"] or "") and r["_f"] == "o" for r in got)


def test_example_digests(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in fim.examples(df).collect():
        assert r["restored_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
        assert (r["prefix_chars"] is None) == (r["form"] == "plain")
    assert fim.examples(df.limit(0)).count() == 0
