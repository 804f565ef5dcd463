"""Each operator does the whole job: cases in which a cutoff or a switch by size would lose rows."""

import zlib

import numpy as np

from graphloom.llm import html_text, jaccard, lattice


# --- 5


def test_near_duplicates_of_many_vectors(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(11)
    n, planted = 101_000, 1000
    v = r.standard_normal((n, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    away = r.standard_normal((planted, 64))
    away -= (away * v[:planted]).sum(1)[:, None] * v[:planted]
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = np.repeat([0.901, 0.91, 0.93, 0.95], planted // 4)
    v[-planted:] = cosine[:, None] * v[:planted] + np.sqrt(1 - cosine**2)[:, None] * away
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(v)}), tmp_path / "v.parquet", row_group_size=30_000)
    got = lattice.near_duplicates(spark.read.parquet(str(tmp_path / "v.parquet"))).where("n_links > 0").toPandas()
    linked = np.isin(np.arange(planted), got["component_id"])
    recall = [float(linked[cosine == c].mean()) for c in (0.901, 0.91, 0.93, 0.95)]
    print("recall", recall)
    assert min(recall) > 0.92 and recall[2] > 0.97 and len(got) == 2 * linked.sum()


# --- 8


def test_op8_credits_passages_of_one_document(spark, tmp_path):
    from graphloom.llm import queries

    def words(seed):
        return np.random.default_rng(seed).permutation([f"w{i}" for i in range(200)]).tolist()

    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, " ".join(words(i))) for i in range(12) if i not in held]
    passage = next(t for _, t in rows)
    rows += [(held[0], passage), (held[1], " ".join(words(999)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_lm(spark, str(tmp_path)).collect()}
    assert got[held[0]]["held_out"] and got[held[1]]["held_out"]
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.5 * len(passage.split())


# --- 10


def prose(tag, n, size):
    return "".join(f"<p>{tag}{i} {'word ' * (size // 5)}</p>" for i in range(n))


def test_html_keeps_sections_title_and_lead():
    title, lead = "A title of some forty characters in all", "lead " * 40
    inner = f"<h1>{title}</h1><div><p>{lead}</p></div><section>{prose('a', 10, 300)}</section><section>{prose('b', 3, 300)}</section><section>{prose('c', 6, 120)}</section>"
    links = "<div>" + "".join(f'<a href="/{i}">Another page {i}</a> ' for i in range(12)) + "</div>"
    for page in (f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f"<article>{inner}{links}</article>", f"<div id=x><div>{inner}</div></div>"):
        got = html_text.extract(f"<body><nav>Home</nav>{page}<footer>End</footer></body>").split("\n")
        assert got[:2] == [title, lead.strip()] and [g.split()[0] for g in got[2:]] == [f"{t}{i}" for t, n in (("a", 10), ("b", 3), ("c", 6)) for i in range(n)]


# --- pipeline


def test_one_row_of_each_class_stays(spark):
    def words(seed):
        return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(0, 10**6, 60))

    rows = [(None, words(1)), (None, words(1)), (None, words(1) + " more"), (7, words(2)), (7, words(2)), (None, words(2)), (9, words(3)), (9, words(4)), (5, words(4)), (None, ""), (4, None), (2, words(5)), (3, words(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.one_of_each(df).collect()]
    plain = [x for x in got if x[1]]
    assert sorted((x for x in plain if x[0] is not None)) == sorted([(7, words(2)), (9, words(3)), (5, words(4)), (2, words(5))])
    assert len([x for x in plain if x[0] is None]) == 1 and {x for x in got if not x[1]} == {(None, ""), (4, None)}
    assert jaccard.one_of_each(df).columns == df.columns and jaccard.one_of_each(df.limit(0)).count() == 0
    alone = df.where("doc_id < 5")
    assert {r["doc_id"] for r in jaccard.one_of_each(alone).collect()} == {2, 4}
