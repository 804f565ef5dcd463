"""The toxicity classifier: its kernel against brute force, held-out documents, disguised insults, odd tables."""

import itertools
import zlib

import numpy as np
import pytest

from graphloom.llm import toxicity as X

INSULTS = ["idiot", "moron", "scumbag", "loweigen", "loweistra"]


def words(seed: int, n: int) -> list[str]:
    r = np.random.default_rng(seed)
    return ["".join(r.choice(["th", "er", "on", "an", "ti", "éa", "wh", "le"], int(r.integers(1, 4)))) for _ in range(n)]


def said(i: int, toxic: bool) -> str:
    r = np.random.default_rng(10_000 + i)
    w = words(i, int(r.integers(6, 120)))
    for _ in range(int(r.integers(1, 4)) if toxic else 0):
        w.insert(int(r.integers(0, len(w))), INSULTS[int(r.integers(0, len(INSULTS)))])
    return " ".join(x + ("." if k % 11 == 10 else "") for k, x in enumerate(w))


def plain_kernel(a: str, b: str) -> float:
    def features(w):
        c, out = ["^", *w, "$"], {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i < X.SPAN:
                key = (c[i], c[j], c[k])
                out[key] = out.get(key, 0) + X.GAP ** (k - i - 2)
        return out

    f, g = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    return (dot(f, g) / (dot(f, f) * dot(g, g)) ** 0.5) ** X.POWER if f and g else 0.0


def test_kernel_against_all_subsequences():
    texts = ["idiot", "i.d.iot", "idxiot", "moronoron", "a", "ab", "aaaaaa", "thanererth"]
    s = X.Sentences([" ".join(texts)])
    k = X.Kernel([s.chars[s.begin[i] : s.begin[i + 1]].tobytes() for i in range(len(texts))])
    got = k.rows(s.chars, s.begin, at_once=20)
    assert got == pytest.approx(np.array([[plain_kernel(a, b) for b in texts] for a in texts]), abs=1e-5)
    assert X.Kernel([]).rows(s.chars, s.begin).shape == (len(texts), 0)


def test_sentences_and_words():
    s = X.Sentences(["One, two! three\nfour id.iot ... $$$ five", "", "  ", "s c u m here. x y", "z " * 3, "q " + "w " * 100])
    assert s.of_text[s.sentence[:6]].tolist() == [0] * 6 and s.sentence[:6].tolist() == [0, 0, 1, 2, 2, 3]
    letters = {bytes(s.chars[a:b]) for a, b in itertools.pairwise(s.begin.tolist())}
    assert X.Sentences(["scum"]).chars.tobytes() in letters and X.Sentences(["zzz"]).chars.tobytes() in letters and X.Sentences(["one"]).chars.tobytes() in letters
    assert X.Sentences(["zzzq"]).chars.tobytes() not in letters
    assert np.bincount(s.sentence[s.of_text[s.sentence] == 5]).max() <= X.SENTENCE + 1
    assert len(X.Sentences([""]).hashes) == len(X.Sentences([]).hashes) == 0
    assert "".join(X.pieces("ab " * 700_000)) == "ab " * 700_000


def test_svm_is_the_least_loss():
    r = np.random.default_rng(1)
    x, y = r.standard_normal((80, 3)), r.integers(0, 2, 80)

    def loss(w, b):
        e = np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ w + b)) ** 2
        return w @ w / 2 + 0.05 * 80 / 2 * (e[y > 0].mean() / 2 + e[y == 0].mean() / 2)

    w, b = X.svm(x, y, cost=0.05)
    assert all(loss(w, b) <= loss(w + d[:3], b + d[3]) + 1e-6 for d in 0.01 * r.standard_normal((60, 4)))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, said(i, i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    return rows, spark.createDataFrame([(i, t, "x", 9.9, "h") for i, t, _ in rows], "doc_id long, text string, lang string, score double, highest string"), spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int")


def test_held_out_documents(spark, table):
    rows, docs, labels = table
    got = {r["doc_id"]: r for r in X.classify(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 150 and all(g["held_out"] for g, _ in held) and sum(g["held_out"] for g in got.values()) == len(held)
    right = sum((g["predicted"] == 1) == (y == 1) for g, y in held) / len(held)
    assert right > 0.95 and all(0 <= g["score"] <= 1 for g in got.values())


def test_disguised_insults_and_long_texts(spark, table):
    _, docs, labels = table
    model = X.fit(docs, labels)
    clean = " ".join(words(77, 30))
    hidden = [f"{clean} {x} {clean}" for x in ("idiot", "id-iot", "ididot", "i.diot", "i d i o t", "IDIOT!!", "idiot, moron", "loweixyz loweiqq")]
    rows = [(i, t) for i, t in enumerate([*hidden, clean, None, "", " " * 50, clean * 3, (clean + " ") * 9000 + "idiot. moron scumbag", "x" * 1_200_000])]
    out = {r["doc_id"]: r for r in X.with_score(spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, highest string, score int"), model).collect()}
    score = [out[i]["score"] for i in range(len(rows))]
    n = len(hidden)
    assert min(score[:n]) > max(score[n : n + 5]) and score[n + 5] > 0.7 and score[n + 6] < 0.7
    assert score[n + 1] == score[n + 2] == score[n + 3] and out[0]["highest"] == "k"


def test_odd_tables(spark, table):
    rows, docs, labels = table
    none = labels.limit(0)
    assert {r["score"] for r in X.classify(docs, none).collect()} == {0.5}
    assert X.classify(docs.limit(0), labels).count() == 0
    only = labels.where("toxic = 0")
    assert all(r["score"] < 0.01 for r in X.classify(docs, only).collect())
    odd = labels.unionByName(spark.createDataFrame([(3, 0, 0), (None, 1, 0), (4, None, 0), (99_999, 1, 0)], labels.schema))
    twice = docs.unionByName(docs.limit(20)).unionByName(spark.createDataFrame([(None, "idiot", "x", 0.0, "h"), (6, None, "x", 0.0, "h")], docs.schema))
    got = X.classify(twice, odd).collect()
    assert len(got) == len(rows) + 22 and all(r["held_out"] is not None for r in got if r["doc_id"] is not None)
    assert X.sample(twice, odd, each=10).count() == 20
