"""Operators against independent implementations, and on nulls, empties, repeats, long texts and very many hits."""

import itertools
import math
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, encoding, jaccard, lattice, lm, packing, quality, secret_scan, spm, topk, wavelet

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon".split()


def words(seed, n, of=400):
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, of, n))


# --- shared parts


def test_spread_join_of_a_hot_key(spark):
    rows = spark.range(6000).selectExpr("id", "cast(if(id < 5000, 7, id) as long) as k")
    groups = common.materialize(rows.groupBy("k").agg(F.count("*").alias("m")), "groups")
    got = common.spread_join(rows, groups, ["k"], "id")
    assert got.count() == 6000 and got.where("k = 7").agg(F.min("m"), F.count("*")).first() == (5000, 5000)
    none = common.materialize(groups.limit(0), "groups")
    assert common.spread_join(rows, none, ["k"], "id").count() == 0


def test_long_words_of_any_make_hash_apart():
    """Thue-Morse words and their complements collide under every polynomial modulo 2**64."""
    t = "a"
    for _ in range(12):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    h = common.Words([t.encode(), other.encode(), t.encode(), b"x" * 256, b"x" * 257]).hashes
    assert h[0] == h[2] != h[1] and len(set(h.tolist())) == 4


# --- 1, 5


def test_top_k_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.5, 0.5]), (50, [1.0, 0.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id = 50"), df).orderBy("rank").collect()
    assert [r["vec_id"] for r in got][0] == 2 and got[0]["score"] == 512 * 256 and 50 not in {r["vec_id"] for r in got}
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_lattice_with_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (3, [0.0, 0.0, 1.0]), (None, a), (5, None)], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["component_id"]) for r in lattice.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (5, 5)]


# --- 2


def test_wavelet_select_over_many_samples():
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(0, 3, 50_000), r.integers(0, 40_000, 20_000)])
    m, *_ = wavelet.open_file(np.frombuffer(wavelet.to_bytes(wavelet.WaveletMatrix.build(v), np.zeros(1), np.ones(1), np.array([len(v)])), np.uint8))
    for x in (0, 1, 2, int(v[60_000])):
        where = np.flatnonzero(v == x)
        for k in {0, len(where) // 3, 4095, 4096, 8192, len(where) - 1}:
            assert m.select(x, k) == (where[k] if k < len(where) else -1)
        assert m.count(x, 1000, 61_000) == (v[1000:61_000] == x).sum()
    assert all(m.access(i) == v[i] for i in range(0, len(v), 997))


# --- 3


def brute_spans(t):
    assign = re.compile(secret_scan.ASSIGN, re.A)
    return sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{14,}", t)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", t)])


def test_redaction_of_very_many_and_overlapping_hits(spark):
    r = np.random.default_rng(3)
    key = lambda n: "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))
    many = " é ".join(f"{key(17)}x" for _ in range(3000))
    mixed = " ".join(f"token={key(20)} a{key(16)}api_key: {key(12)} 漢{key(16)}{'z' * int(n)}" for n in r.integers(0, 6000, 40))
    rows = [(1, many), (2, mixed), (3, None), (4, ""), (5, "plain " * 30_000), (5, f"secret={key(14)}"), (6, key(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    none = [-1.0] * (len(secret_scan.ALPHABET) + 1) ** 2  # no run counts as random
    got = sorted(((x["doc_id"], x["text"]) for x in secret_scan.redact(df, table=none).collect()), key=repr)
    want = []
    for i, t in rows:
        out, at = [], 0
        for a, _, b in brute_spans(t or ""):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        want.append((i, None if t is None else "".join(out) + t[at:]))
    assert got == sorted(want, key=repr)
    scanned = {(x["doc_id"], x["n_hex"], x["n_assign"]) for x in secret_scan.scan(df, none).collect()}
    assert scanned == {(i, sum(k == 2 for _, k, _ in brute_spans(t or "")), sum(k == 0 for _, k, _ in brute_spans(t or ""))) for i, t in rows}


def test_markov_models_on_held_out_strings(spark):
    """Random strings of kinds that training has not seen, and identifiers made of words that it has not seen."""
    r = np.random.default_rng(8)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    random = ["".join(letters[r.integers(0, 62, int(n))]) for n in r.integers(20, 44, 300)]
    parts = "account archive balance buffer cache channel client cluster column commit connection container context cursor database default delete device driver element engine error event factory filter format gateway handler header history image import input instance interface layout library listener logger manager memory module monitor network notification operation option output package parser password_reset payment pipeline platform policy printer profile project provider queue record region register release resource router sample scheduler schema session signal socket storage stream string table template thread timeout transaction transfer update validation vector version viewer window worker".split()
    plain = ["_".join(parts[i] for i in r.integers(0, len(parts), 4)) for _ in range(150)] + ["".join(parts[i].title() for i in r.integers(0, len(parts), 4)) for _ in range(150)]
    learn = spark.createDataFrame([(i, words(i, 60)) for i in range(50)], "doc_id long, text string")
    table = secret_scan.train(secret_scan.samples(learn))
    df = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(random + plain)], "doc_id long, text string")
    hit = {x["doc_id"] for x in secret_scan.scan(df, table).where("n_markov > 0").collect()}
    found, false = sum(i < 300 for i in hit), sum(i >= 300 for i in hit)
    print("recall", found / 300, "precision", found / max(1, found + false))
    assert found / 300 > 0.95 and found / (found + false) > 0.97


# --- 4


def test_ftrl_against_a_plain_loop():
    examples = [(words(i, 5 + i % 20, 30).encode(), i % 2) for i in range(60)] + [(b"", 1), (b"one two " * 500, 0)]
    got = quality.fit(examples, bits=12)
    z, n = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 1e-4

    def weight(i):
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    rows = []
    for t, y in examples:
        hit = quality.features([t], 12)[0].ravel().tolist()
        x = {4096: 1.0}
        for i in hit:
            x[i] = x.get(i, 0.0) + 8.0 / len(hit)
        rows.append((x, y))
    for _ in range(3):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert all(abs(got[i] - weight(i)) < 1e-4 for i in set(z) | {0, 1, 2})


# --- 6


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.public_path("word_bpe_49k.json"))
    rows = [(1, words(1, 3000)), (2, None), (3, ""), (4, "one <|endoftext|> two"), (4, "one <|endoftext|> two"), (None, "lost"), (5, "é 漢字 😀  x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    got = [tuple(r)[:5] for r in packing.pack(df).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_prices_are_the_best_multiset():
    r = np.random.default_rng(2)
    for _ in range(20):
        sizes = np.unique(r.integers(1, 12, 5))
        values = r.random(len(sizes)) * sizes
        got, pattern = packing.price(values, sizes, np.full(len(sizes), 20), 20)
        best = max(sum(c * v for c, v in zip(counts, values, strict=True)) for counts in itertools.product(*(range(20 // s + 1) for s in sizes)) if sum(c * s for c, s in zip(counts, sizes, strict=True)) <= 20)
        assert got == pytest.approx(best) and (pattern * sizes).sum() <= 20 and (pattern * values).sum() == pytest.approx(best)


# --- 7


def varint(n):
    out = b""
    while True:
        b, n = n & 127, n >> 7
        if not n:
            return out + bytes([b])
        out += bytes([b | 128])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_with_a_normaliser(tmp_path, fallback):
    """A model written here: unigram scores, the NFKC character map, white space squeezed, a dummy prefix."""
    import sentencepiece

    norm = dict(spm._fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    r = np.random.default_rng(1)
    names = ["alpha", "beta", "ga", "mma", "ta", "al", "pha", "be", *"ealphbtgm", "▁", "▁al", "▁be", "▁gamma", "fi", "é", "1", "2"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256 * fallback)), *((w, -float(x) * 8 - 1, 1) for w, x in zip(dict.fromkeys(names), r.random(40), strict=False))]
    data = b"".join(field(1, field(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for t, s, k in pieces)
    data += field(2, varint(3 << 3) + varint(1) + (varint(35 << 3) + varint(1)) * fallback) + field(3, norm)
    (tmp_path / "m.model").write_bytes(data)
    b = spm.Backend(str(tmp_path / "m.model"))
    texts = ["alpha beta gamma", "  alpha   beta ", "ﬁ beta é １２", "x y z 漢字 😀", "", "   ", "a\tb\nc", "alphabetagamma", "▁alpha ▁ beta", "é beta alpha " * 300]
    flat, begin = b.encode(texts)
    assert all(b.parity(texts, flat, begin))
    assert not all(b.parity(texts[1:] + texts[:1], flat, begin))


# --- 8


def test_language_model_on_a_long_text(spark):
    long = words(4, 60_000, 50)
    df = spark.createDataFrame([(1, long), (2, words(5, 50, 50)), (4, None), (100, words(5, 50, 50) + " never seen")], "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm.score_documents(df).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in got}
    train = [w for i, t in ((r["doc_id"], r["text"]) for r in df.collect()) if not held[i] for w in [*(t or "").lower().split(), None]]
    count = {w: train.count(w) for w in set(train)}
    for r in df.collect():
        tokens = [*(r["text"] or "").lower().split(), None]
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(tokens), sum(w in count for w in tokens), len(train))
        assert x["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (len(train) + len(count) + 1)) for w in tokens))
        assert math.isfinite(x["score"]) and x["score"] < 0


def test_counts_above_32_bits():
    n = np.array([1, 254, 255, 256, 1 << 40, 3])
    c = lm.Counts({k: np.frombuffer(v, np.uint8) for k, v in lm.Counts.encode(n).items()})
    assert c[np.arange(6)].tolist() == n.tolist()


# --- 9


def test_jaccard_with_long_and_hot_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 500)
    hot = words(77, 40)
    rows = [(i, hot + f" x{i}") for i in range(60)] + [(100, words(6, 9000, 10**6)), (101, words(6, 9000, 10**6) + " more words"), (102, words(7, 9000, 10**6)), (103, None), (104, " ")]
    rows += [(200 + i, words(200 + i, 20, 10**6) + " " + words(78, 30)) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert all(got[i] == 0 for i in range(60)) and got[101] == 100 and all(got[i] == i for i in (102, 103, 104, *range(200, 280)))


# --- pipeline


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, labels):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_pipeline_on_odd_tables(spark, tables):
    import corpus_pipeline

    some = [(1, words(1, 60), "en", "s", 0, 0.1), (None, words(2, 60), "en", "s", 0, None), (None, words(2, 60), "en", "s", 0, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, 0.2), (5, words(5, 20_000), "en", "s", 0, 0.3)]
    for rows, labels in (([], []), (some, []), (some, [(1, 1, 0), (4, 0, 0), (None, None, None), (4, 1, 0)]), ([], [(1, 1, 0)])):
        path = tables(rows, labels)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.materialize(stage(spark, docs, path), name)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
        out = corpus_pipeline.run(spark, path)
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
        assert (out.count() == 0) == (docs.count() == 0)
