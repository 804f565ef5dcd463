import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from graphloom.operators import fold, tables
from graphloom.sources import files
from graphloom.streaming import assertions as streams

DAY = dt.datetime(2024, 1, 1)


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [(i, DAY + dt.timedelta(hours=i), f"u{i % 3}", f"k{i % 2}", k, float(i % 9 + 1)) for i, k in enumerate(["knows", "friends_with", "hates", "learning"] * 6)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, src string, dst string, rel_type string, confidence double")
    for i in range(3):
        df.where(f"event_id >= {8 * i} and event_id < {8 * i + 8}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = tables.Store(spark, str(tmp_path / "kb"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.fold_stream(source, store, str(tmp_path / "cp")).awaitTermination(120)
    key = lambda t: sorted((r["src"], r["dst"], r["rel_type"], r["mention_count"]) for r in t.collect())
    assert key(streams.folded(store)) == key(fold.fold_edges(df))
    assert len(store.versions("rel")) == 3


ASSERTED = "event_id long, ts timestamp, src string, dst string, rel_type string, confidence double, note_id string"


def test_first_told(spark):
    rows = [(1, DAY, "a", "b", "knows", 1.0, "n1"), (2, DAY, "a", "b", "knows", 2.0, "n1"), (3, DAY, "a", "b", "knows", 3.0, "n2"), (4, DAY, "a", "b", None, 3.0, "n1"), (5, DAY, None, "b", "knows", 3.0, "n1"), (6, DAY, "a", "b", "knows", 1.0, None), (7, DAY, "a", "b", "knows", 1.0, None)]
    df = spark.createDataFrame(rows, ASSERTED)
    ids = lambda t: sorted(r["event_id"] for r in t.collect())
    assert ids(fold.first_told(df)) == [1, 3, 4, 5, 6, 7]
    ledger = df.where("event_id in (2, 5)").select(*fold.TOLD)
    assert ids(fold.first_told(df, ledger)) == [3, 4, 6, 7]
    assert ids(fold.first_told(df, ledger.limit(0))) == [1, 3, 4, 5, 6, 7]


def test_stream_counts_a_repeated_note_once_over_a_failed_batch(spark, tmp_path, monkeypatch):
    import pytest
    from pyspark.errors import StreamingQueryException

    kinds = ["knows", "friends_with", "works_with"]
    rows = [(i, DAY + dt.timedelta(hours=i), f"u{i % 3}", f"k{i % 2}", kinds[i % 3], float(i % 9 + 1), f"n{0 if i % 2 else i}") for i in range(24)]
    df = spark.createDataFrame(rows, ASSERTED)
    want = fold.fold_edges(fold.first_told(df))
    key = lambda t: sorted((r["src"], r["dst"], r["rel_type"], r["mention_count"]) for r in t.collect())
    for again in range(2):  # the second delivery repeats the first
        for i in range(2):
            df.where(f"event_id >= {12 * i} and event_id < {12 * i + 12}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = tables.Store(spark, str(tmp_path / "kb"))
    whole, calls = tables.Store.commit_parts, []

    def failing(self, table, rows, tag):
        calls.append(tag)
        if calls.count("b1") == 1 and tag == "b1":
            raise RuntimeError("lost after the ledger was written")
        return whole(self, table, rows, tag)

    monkeypatch.setattr(tables.Store, "commit_parts", failing)
    start = lambda: streams.fold_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp"), once=True)
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert calls.count("b1") == 2
    assert key(streams.folded(store)) == key(want)
    assert sum(x[3] for x in key(want)) < sum(x[3] for x in key(fold.fold_edges(df)))


def test_ingest_with_a_ledger(spark):
    from graphloom.plans import ingest

    notes = spark.createDataFrame([("o1", "Ada Lovelace met Charles Babbage.", DAY), ("o2", "Ada Lovelace met Charles Babbage. Paris is far.", DAY)], "id string, content string, ts timestamp")
    count = lambda t: sum(r["mention_count"] for r in t["rel"].collect())
    first = ingest.ingest(notes, {"ledger": None})
    stored = {k: first[k] for k in ("nodes", "contexts", "rel", "ledger")}
    again = ingest.ingest(notes, stored)
    assert count(first) == count(again) and again["ledger"].count() == first["ledger"].count() > 0
    assert count(ingest.ingest(notes, {k: v for k, v in stored.items() if k != "ledger"})) == 2 * count(first)


def test_idle_sessions_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, DAY), (1, DAY + dt.timedelta(seconds=60)), (1, DAY + dt.timedelta(seconds=400)), (2, DAY)], "user_id long, ts timestamp")
    got = sorted((r["user_id"], r["n"]) for r in streams.idle_sessions(e).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_note_folder_and_attachments(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "My_Note.md").write_text("# T\n\n\n\nBody\n")
    r = files.note_folder(spark, str(tmp_path / "notes")).first()
    assert (r["id"], r["title"], r["content"]) == ("My_Note.md", "My Note", "# T\n\nBody")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "att").mkdir()
    (tmp_path / "att" / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "att" / "b.csv").write_text("x,,y\n,,\n1,2,3\n")
    (tmp_path / "att" / "c.zzz").write_bytes(b"1")
    (tmp_path / "att" / "d.docx").write_bytes(b"broken")
    got = {r["name"]: r["text"] for r in files.attachments(spark, str(tmp_path / "att")).collect()}
    assert got == {"a.docx": "Hello\na | b", "b.csv": "x\ty\n1\t2\t3", "c.zzz": "[unsupported file type: .zzz]", "d.docx": files.EMPTY}
    assert sorted(r["line"] for r in files.spreadsheet_rows(spark, str(tmp_path / "att" / "b.csv")).collect()) == ["1\t2\t3", "x\ty"]


def test_web_search_is_empty_offline(spark):
    assert files.web_search(spark, "x").where(F.lit(True)).count() == 0


def test_knowledge_bases(spark, tmp_path):
    import pytest

    from graphloom.sources import bases

    path = str(tmp_path / "kbs")
    store = bases.create(spark, path, "My Notes")
    store.commit("nodes", spark.range(3))
    with pytest.raises(ValueError, match="my_notes"):
        bases.create(spark, path, "my notes")
    bases.rename(spark, path, "my_notes", "Ours")
    assert sorted((r["slug"], r["name"]) for r in bases.listed(spark, path).collect()) == [("default", "Default"), ("my_notes", "Ours")]
    bases.reset(store, "nodes")
    assert store.read("nodes").count() == 0
    bases.delete(spark, path, "my_notes")
    assert bases.listed(spark, path).count() == 1


def test_uuid5(spark):
    import uuid

    from graphloom.functions import scores

    names = [f"node_{i}" for i in range(40)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scores.uuid5(F.col("n")).alias("u")).collect()
    assert {r["n"]: r["u"] for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names}
