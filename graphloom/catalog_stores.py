"""Registered queries on stores, ids, layout and retrieval steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scores as S
from .functions import text as T
from .operators import communities, graph, layout, names, search, tables
from .plans import ingest, quality, retrieval
from .registry import MEMBER, NODE, NOTE, REF, REL, query
from .sources import bases, files
from .sources import tables as src
from .streaming import assertions as streams
from .streaming import rebuilds


def shared_path(spark, name: str) -> str:
    """A new path below the folder that driver and executors share; in local mode without one a temporary folder."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(base)
    return f"{str(base).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex[:12]}"


def once_path(spark, name: str, folder: str) -> str:
    """The same path for every call of this application on one folder of tables."""
    import hashlib

    files = sorted(x for t in ("documents", "benchmark") for x in src.read(spark, folder, t).inputFiles())
    key = hashlib.md5("\n".join(files).encode()).hexdigest()[:12]
    paths = spark.sparkContext.__dict__.setdefault("_graphloom_once", {})
    return paths.setdefault((name, key), shared_path(spark, f"{name}-{key}"))


def ensure_checkpoints(spark) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_path(spark, "checkpoints"))


def _customers(spark, d):
    return src.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))


# --- scans -----------------------------------------------------------------------------------------


@query(f"WITH {NODE} SELECT id, name, type FROM node WHERE kind IN ('indexable', 'note') AND id IS NOT NULL AND name IS NOT NULL")
def nodes_by_kind(spark, d):
    return graph.by_kind(src.nodes(spark, d), "indexable", "note").select("id", "name", "type")


@query(f"WITH {NODE} SELECT type, count(*) AS n, min(name) AS first_name FROM node WHERE kind = 'indexable' AND name LIKE '%1%' GROUP BY type")
def sql_by_parameters(spark, d):
    sql = "SELECT type, count(*) AS n, min(name) AS first_name FROM {nodes} WHERE kind = :kind AND name LIKE :like GROUP BY type"
    return tables.execute(spark, sql, {"kind": "indexable", "like": "%1%"}, nodes=src.nodes(spark, d))


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5) AND vec_id % 2 = 1")
def vector_payload_scan(spark, d):
    e = src.read(spark, d, "embeddings").withColumn("odd", F.col("vec_id") % 2 == 1)
    return tables.matching(e, label=[1, 3, 5], odd=True, missing=None).select("vec_id", "label")


@query(f"""WITH {MEMBER}, {NODE}, core AS (SELECT DISTINCT community_id AS id, 'community' AS type, level, 'Theme ' || community_id AS name FROM member UNION ALL SELECT id, type, NULL, name FROM node)
SELECT id, level, name FROM core WHERE type = 'community'""")
def community_payloads(spark, d):
    m = src.members(spark, d).select(F.col("community_id").alias("id"), F.lit("community").alias("type"), "level", F.concat(F.lit("Theme "), "community_id").alias("name")).distinct()
    core = m.unionByName(src.nodes(spark, d).select("id", "type", "name"), allowMissingColumns=True)
    return tables.matching(core, type="community").select("id", "level", "name")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT c_custkey * 3 FROM customer)")
def vector_retrieve(spark, d):
    ids = src.read(spark, d, "customer").select((F.col("c_custkey") * 3).alias("vec_id"))
    return tables.retrieve(src.read(spark, d, "embeddings"), ids, "vec_id").select("vec_id", "label")


@query("""WITH h AS (SELECT p_partkey AS id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || ('p' || p_partkey)::BLOB) AS h FROM part)
SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(('0x' || h[17])::INTEGER % 4) + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def point_ids(spark, d):
    return src.read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.uuid5(src.key("p", "p_partkey")).alias("uuid"))


@query("SELECT * FROM (VALUES ('nation', true), ('nobody', false)) t(name, there)")
def store_probes(spark, d):
    store = tables.Store(spark, shared_path(spark, "store"))
    store.commit("nation", src.read(spark, d, "nation"))
    return spark.createDataFrame([(t, store.exists(t)) for t in ("nation", "nobody")], "name string, there boolean")


@query("SELECT * FROM (VALUES ('default', 'Default'), ('my_notes', 'Renamed')) t(slug, name)")
def base_registry(spark, d):
    path = shared_path(spark, "bases")
    for name in ("My Notes", "Old Ones"):
        bases.create(spark, path, name).commit("nation", src.read(spark, d, "nation"))
    bases.rename(spark, path, "my_notes", "Renamed")
    bases.delete(spark, path, "old_ones")
    return bases.listed(spark, path).select("slug", "name")


@query("SELECT count(*) AS before, 0::BIGINT AS after, 1 AS version FROM nation")
def base_reset(spark, d):
    store = tables.Store(spark, shared_path(spark, "store"), "one")
    store.commit("nation", src.read(spark, d, "nation"))
    before = store.read("nation")
    bases.reset(store, "nation")
    after = store.read("nation").agg(F.count("*").alias("after"))
    return before.agg(F.count("*").alias("before")).crossJoin(after).withColumn("version", F.lit(store.version("nation")))  # two single rows


# --- files -----------------------------------------------------------------------------------------


def put_files(spark, folder: str, named: dict[str, bytes]) -> str:
    """Writes small files through Hadoop's file systems, so that any shared folder will do."""
    jvm = spark._jvm
    for name, data in named.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
        out.write(bytearray(data))
        out.close()
    return folder


def _zip(parts: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@query("""SELECT 'n' || n_nationkey || '.' || k AS name, CASE k WHEN 'docx' THEN n_name || chr(10) || 'key | ' || n_nationkey WHEN 'xlsx' THEN '=== Sheet: One ===' || chr(10) || n_name || chr(9) || n_nationkey WHEN 'csv' THEN n_name || chr(9) || 'x' WHEN 'png' THEN '[image n' || n_nationkey || '.png, 3 bytes]'
 WHEN 'mp3' THEN '[audio n' || n_nationkey || '.mp3, 4 bytes]' WHEN 'pdf' THEN '[no extractable text]' ELSE '[unsupported file type: .zzz]' END AS text FROM nation, (SELECT unnest(['docx', 'xlsx', 'csv', 'png', 'mp3', 'pdf', 'zzz']) AS k) WHERE n_nationkey < 5""")
def attachment_texts(spark, d):
    w, m = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    named = {}
    for r in src.read(spark, d, "nation").where("n_nationkey < 5").collect():  # five rows make the files
        k, n = r["n_nationkey"], r["n_name"]
        cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
        named[f"n{k}.docx"] = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{n}</w:t></w:r></w:p><w:tbl><w:tr>{cell("key")}{cell(k)}</w:tr></w:tbl></w:body></w:document>'})
        sheet = f'<worksheet xmlns="{m}"><sheetData><row><c t="s"><v>0</v></c><c/><c><v>{k}</v></c></row></sheetData></worksheet>'
        named[f"n{k}.xlsx"] = _zip({"xl/workbook.xml": f'<workbook xmlns="{m}"><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>{n}</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
        named |= {f"n{k}.csv": f"{n},,x\n,,\n".encode(), f"n{k}.png": b"abc", f"n{k}.mp3": b"abcd", f"n{k}.pdf": b"%PDF-", f"n{k}.zzz": b"1"}
    return files.attachments(spark, put_files(spark, shared_path(spark, "attachments"), named)).select("name", "text")


@query("SELECT 'Nation_' || n_nationkey || '.md' AS id, 'Nation ' || n_nationkey AS title, '# ' || n_name || chr(10) || chr(10) || 'Body' AS content, (24 - n_nationkey)::INTEGER AS place FROM nation WHERE n_nationkey % 2 = 0")
def notes_from_folder(spark, d):
    import json

    names = src.read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows make the files
    named = {f"Nation_{r['n_nationkey']}.md": f"---\nt: x\n---\n# {r['n_name']}\n\n\n\nBody\n\n[Next](b.md)\n".encode() for r in names}
    order = [f"Nation_{k}.md" for k in range(24, -1, -1)]
    cases = [{"notes": [x if i % 2 == 0 else order[0] for i, x in enumerate(order)]}, {"notes": order[:3:2]}]
    folder = put_files(spark, shared_path(spark, "notes"), named | {"manifest.json": json.dumps({"test_cases": cases}).encode()})
    return files.note_folder(spark, folder, f"{folder}/manifest.json").select("id", "title", "content", F.col("ord.n").alias("place"))


@query("SELECT n_name || chr(9) || n_nationkey AS line FROM nation")
def sheet_lines(spark, d):
    path = shared_path(spark, "sheets")
    n = src.read(spark, d, "nation")
    n.select("n_name", F.lit(None).cast("string").alias("x"), F.col("n_nationkey").cast("string").alias("k")).write.option("sep", "\t").csv(path)
    return files.spreadsheet_rows(spark, path, "\t")


# --- streams ---------------------------------------------------------------------------------------


@query("SELECT 'u' || user_id AS src, count(*) AS mentions FROM events GROUP BY user_id")
def assertion_stream(spark, d):
    """Assertions of one type folded batch by batch from a stream: mentions add up as in one go."""
    path = shared_path(spark, "stream")
    a = src.assertions(spark, d).withColumn("rel_type", F.lit("mentions")).withColumn("dst", F.lit("k"))
    a.repartition(3, "event_id").write.parquet(f"{path}/in")
    source = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    store = tables.Store(spark, f"{path}/kb")
    streams.fold_stream(source, store, f"{path}/checkpoint", parts=8).awaitTermination()
    return streams.folded(store).groupBy("src").agg(F.sum("mention_count").alias("mentions"))


@query("SELECT 'u' || user_id AS src, count(DISTINCT event_id % 40) AS mentions FROM events GROUP BY user_id")
def assertions_once_stream(spark, d):
    """Notes that come again, in the same batch, in a later one and after a restart, count what they told once."""
    path = shared_path(spark, "stream")
    a = src.assertions(spark, d).withColumn("rel_type", F.lit("mentions")).withColumn("dst", F.lit("k")).withColumn("note_id", F.concat(F.lit("n"), (F.col("event_id") % 40).cast("string")))
    store = tables.Store(spark, f"{path}/kb")
    for _ in range(2):
        a.repartition(2, "event_id").write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        streams.fold_stream(source, store, f"{path}/checkpoint", parts=8, once=True).awaitTermination()
    return streams.folded(store).groupBy("src").agg(F.sum("mention_count").alias("mentions"))


@query("SELECT user_id AS id, arg_max(event_type, ts) AS status FROM events GROUP BY user_id")
def status_stream(spark, d):
    changes = src.read(spark, d, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_type").alias("status"))
    return streams.latest_status(changes).select("id", "status")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS node_id, max(ts) + INTERVAL 12 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, k""")
def recompute_sessions(spark, d):
    return streams.recompute_queue(src.read(spark, d, "events").select(F.col("user_id").alias("node_id"), "ts"), gap="12 hours").select("node_id", "end", "n")


@query("SELECT DISTINCT event_type AS kb, user_id::VARCHAR AS node_id FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL")
def idle_trigger_stream(spark, d):
    """The stream of all events, a knowledge base for each type: once nothing is being ingested any more, each changed node comes out once."""
    import time

    path = shared_path(spark, "idle")
    e = src.read(spark, d, "events").select(F.col("event_type").alias("kb"), F.lit("node").alias("kind"), F.col("user_id").cast("string").alias("node_id")).where("kb is not null and node_id is not null")
    marks = e.select("kb").distinct().select("kb", F.explode(F.array(F.lit("begin"), F.lit("end"))).alias("kind"), F.lit(None).cast("string").alias("node_id"))
    e.unionByName(marks).write.parquet(f"{path}/in")
    bases = marks.select("kb").distinct().count()
    store, key = tables.Store(spark, f"{path}/kb"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, rebuilds.PROVIDER)
    try:
        source = spark.readStream.schema(e.schema).parquet(f"{path}/in")
        q = rebuilds.queue_rebuilds(rebuilds.idle_trigger(source, 1000), store, f"{path}/checkpoint", processingTime="1 second")
        while q.isActive and bases and (not store.exists("pending") or rebuilds.queued(store).select("kb").distinct().count() < bases):
            time.sleep(1)
        q.stop()
    finally:
        spark.conf.set(key, before)
    if q.exception():
        raise q.exception()
    return rebuilds.queued(store).select("kb", "node_id")


# --- sinks -----------------------------------------------------------------------------------------


@query(f"WITH {NOTE} SELECT id, title FROM note WHERE id % 2 = 0 UNION ALL SELECT id, 'new' FROM note WHERE id % 3 = 0 AND id % 2 <> 0")
def note_insert(spark, d):
    n = src.notes(spark, d).select("id", "title")
    return tables.insert_absent(n.where("id % 2 = 0"), n.where("id % 3 = 0").withColumn("title", F.lit("new")), ["id"])


@query(f"WITH {NOTE} SELECT id, CASE WHEN id % 5 = 0 THEN title || '!' ELSE title END AS title FROM note WHERE id % 2 = 0")
def note_update(spark, d):
    n = src.notes(spark, d).select("id", "title")
    return tables.update(n.where("id % 2 = 0"), n.where("id % 5 = 0").withColumn("title", F.concat("title", F.lit("!"))), ["id"])


@query(f"WITH {NOTE} SELECT id, CASE WHEN id % 4 = 0 THEN false ELSE processed END AS processed, CASE WHEN id % 4 = 0 THEN true ELSE failed END AS failed FROM note")
def notes_mark_failed(spark, d):
    n = src.notes(spark, d)
    return tables.set_status(n, n.where("id % 4 = 0"), processed=False, failed=True).select("id", "processed", "failed")


@query("SELECT user_id AS node_id, event_type AS content, event_id AS seq FROM events WHERE user_id % 4 <> 0 UNION ALL SELECT user_id, 'fresh', min(event_id) FROM events WHERE user_id % 4 = 0 GROUP BY user_id")
def children_replace(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    new = e.where("node_id % 4 = 0").groupBy("node_id").agg(F.lit("fresh").alias("content"), F.min("seq").alias("seq"))
    return tables.replace_children(e, new, "node_id")


@query("SELECT user_id AS node_id, count(*) + (user_id % 4 = 0)::INTEGER AS n FROM events GROUP BY user_id")
def children_append(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("content"), F.col("event_id").alias("seq"))
    new = e.where("node_id % 4 = 0").groupBy("node_id").agg(F.lit("fresh").alias("content"), F.min("seq").alias("seq"))
    return tables.append_children(e, new).groupBy("node_id").agg(F.count("*").alias("n"))


@query(f"""WITH {NODE}, {MEMBER}, {REL} SELECT 'node' AS t, id FROM node UNION ALL SELECT 'sentence', 'r' || src || dst || rel_type FROM rel UNION ALL SELECT DISTINCT 'old', community_id FROM member""")
def communities_clear(spark, d):
    m = src.members(spark, d)
    nodes = src.nodes(spark, d).select("id", "kind").unionByName(m.select(F.col("community_id").alias("id"), F.lit("community").alias("kind")).distinct())
    said = src.relations(spark, d).select(F.concat(F.lit("r"), "src", "dst", "rel_type").alias("id"), F.lit(None).cast("boolean").alias("is_community_rel"))
    said = said.unionByName(m.select(F.concat(F.lit("m"), "node_id").alias("id"), F.lit(True).alias("is_community_rel")))
    left, kept, old = tables.clear_communities(nodes, said)
    return left.select(F.lit("node").alias("t"), "id").unionByName(kept.select(F.lit("sentence").alias("t"), "id")).unionByName(old.select(F.lit("old").alias("t"), "id"))


@query(f"WITH {NODE}, {REL}, gone AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 7 = 0) SELECT 'core' AS t, count(*) AS n FROM node WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'context', count(*) FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'sentence', count(*) FROM rel")
def node_delete(spark, d):
    """The node's vectors go, the sentences of its relationships stay."""
    c = src.read(spark, d, "customer").select(src.key("c", "c_custkey").alias("id"), "c_custkey")
    gone = c.where("c_custkey % 7 = 0")
    core, contexts = tables.delete(src.nodes(spark, d), gone, "id"), tables.delete(c, gone, "id")
    one = lambda t, df: df.agg(F.lit(t).alias("t"), F.count("*").alias("n"))
    return one("core", core).unionByName(one("context", contexts)).unionByName(one("sentence", src.relations(spark, d)))


@query(f"WITH {NOTE} SELECT id, CASE WHEN id % 3 = 0 THEN 'about ' || kb_id ELSE title END AS name, CASE WHEN id % 3 = 0 THEN 'c' || (id % 4) END AS community FROM note")
def text_partial_update(spark, d):
    """Known documents get a community and a name, unknown ids are ignored."""
    n = src.notes(spark, d)
    docs = n.select("id", F.col("title").alias("name"), F.lit(None).cast("string").alias("community"))
    change = n.where("id % 3 = 0").select("id", F.concat(F.lit("about "), "kb_id").alias("name"), F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("community"))
    return tables.update(docs, change.unionByName(spark.createDataFrame([(-1, "x", "y")], "id long, name string, community string")), ["id"])


@query(f"WITH {NOTE} SELECT id, title FROM note WHERE id % 3 <> 0")
def text_delete(spark, d):
    n = src.notes(spark, d).select("id", "title")
    return tables.delete(n, n.where("id % 3 = 0").select("id").union(spark.createDataFrame([(-1,)], "id long")), "id")


@query(f"WITH {NODE} SELECT id, CASE WHEN type = 'person' THEN 'human' ELSE type END AS type, 'indexable' AS kind FROM node WHERE type IN ('person', 'place') UNION ALL SELECT id, type, 'new' FROM node WHERE type = 'organization'")
def node_merge(spark, d):
    """Kind is set once, when a node appears; name and type change."""
    n = src.nodes(spark, d).select("id", "kind", "type")
    new = n.where("type = 'person'").withColumn("type", F.lit("human")).unionByName(n.where("type = 'organization'")).withColumn("kind", F.lit("new"))
    return tables.upsert(n.where("type in ('person', 'place')"), new, ["id"], keep=["kind"]).select("id", "type", "kind")


@query("SELECT count(*) AS saved, round(avg((item_id % 3 = 0)::INTEGER), 6) AS exact_match FROM benchmark")
def result_sink(spark, d):
    path = shared_path(spark, "results")
    b = src.read(spark, d, "benchmark")
    say = F.concat(F.lit("Answer "), F.col("item_id").cast("string"))
    r = b.select(F.col("item_id").alias("test_id"), say.alias("expected"), F.when(F.col("item_id") % 3 == 0, say).otherwise("no").alias("actual"), F.lit(0.5).alias("precision"), F.lit(0.5).alias("recall"), F.lit(1.0).alias("total_time_ms"), F.lit(None).cast("string").alias("error"))
    quality.save(quality.answer_metrics(r), path)
    saved = spark.read.json(f"{path}/questions").agg(F.count("*").alias("saved"))
    return saved.crossJoin(spark.read.json(f"{path}/summary").select(F.round("exact_match", 6).alias("exact_match")))  # two single rows


# --- graph steps -----------------------------------------------------------------------------------


@query("""WITH core AS (SELECT c_custkey AS id, 'balance ' || c_nationkey AS description FROM customer WHERE c_custkey % 2 = 0), x AS (SELECT o_custkey AS id, list(o_orderpriority ORDER BY o_orderkey) AS c FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, description, coalesce(len(c), 0)::INTEGER AS contexts, array_to_string(c[1:2], ' / ') AS first_two FROM customer LEFT JOIN core ON core.id = c_custkey LEFT JOIN x ON x.id = c_custkey""")
def node_contents(spark, d):
    c = src.read(spark, d, "customer")
    core = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("balance "), F.col("c_nationkey").cast("string")).alias("description"))
    x = src.read(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("content"))
    out = graph.contents(c.select(F.col("c_custkey").alias("id")), core, x)
    return out.select("id", "description", F.coalesce(F.size("isolated_contexts"), F.lit(0)).alias("contexts"), F.array_join(F.slice("isolated_contexts", 1, 2), " / ").alias("first_two"))


_ENDS = """r AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'Customer#' || lpad((user_id % 400)::VARCHAR, 9, '0') END AS a, CASE WHEN event_id % 7 = 0 THEN 'new ' || (event_id % 3) ELSE 'Supplier#' || lpad((event_id % 40)::VARCHAR, 9, '0') END AS b FROM events),
own AS (SELECT * FROM (VALUES ('new 0', 'x0'), ('new 1', 'x1')) t(name, id)), stored AS (SELECT lower(c_name) AS name, 'c' || c_custkey AS id FROM customer UNION ALL SELECT lower(s_name), 's' || s_suppkey FROM supplier),
e AS (SELECT event_id, trim(a) = '' AS blank, coalesce(la.id, sa.id) AS src, coalesce(lb.id, sb.id) AS dst FROM r LEFT JOIN own la ON la.name = lower(trim(a)) LEFT JOIN stored sa ON sa.name = lower(trim(a)) LEFT JOIN own lb ON lb.name = lower(trim(b)) LEFT JOIN stored sb ON sb.name = lower(trim(b))),
k AS (SELECT event_id, src, dst, CASE WHEN blank THEN 'no_name' WHEN src IS NULL THEN 'no_source' WHEN dst IS NULL THEN 'no_target' END AS skip FROM e)"""


def _ends(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    number = lambda x: F.lpad(x.cast("string"), 9, "0")
    a = F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit("Customer#"), number(u % 400)))
    b = F.when(i % 7 == 0, F.concat(F.lit("new "), (i % 3).cast("string"))).otherwise(F.concat(F.lit("Supplier#"), number(i % 40)))
    rels = src.read(spark, d, "events").select("event_id", a.alias("source_name"), b.alias("target_name"))
    own = spark.createDataFrame([("New 0", "x0"), (" new 1", "x1")], "name string, id string")
    stored = src.nodes(spark, d).where("type in ('person', 'organization')").select("name", "id")
    return graph.resolve_endpoints(rels, own, stored)


@query(f"WITH {_ENDS} SELECT event_id, src, dst, skip FROM k")
def relationship_endpoints(spark, d):
    return _ends(spark, d).select("event_id", "src", "dst", "skip")


@query(f"WITH {_ENDS} SELECT skip, count(*) AS n FROM k WHERE skip IS NOT NULL GROUP BY skip")
def skip_counts(spark, d):
    return _ends(spark, d).where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))


@query(f"WITH {NODE}, {REF} SELECT DISTINCT id, name, type FROM node JOIN ref ON node_id = id WHERE note_id = 'o1' AND kind = 'indexable'")
def note_neighbours(spark, d):
    return graph.neighbours_of_note("o1", src.references(spark, d), src.relations(spark, d), src.nodes(spark, d))


@query(f"WITH {MEMBER} SELECT node_id, string_agg(community_id, '>' ORDER BY level DESC) AS communities FROM member GROUP BY node_id")
def membership_order(spark, d):
    return graph.memberships(src.members(spark, d)).select("node_id", F.array_join("communities", ">").alias("communities"))


@query(f"""WITH {NODE}, b AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS base FROM part UNION SELECT 'nobody jr'), m AS (SELECT base, id, name, type FROM b, node WHERE name IS NOT NULL AND list_contains(string_split(lower(name), ' '), split_part(base, ' ', 1))
 AND (starts_with(lower(name), base || ' ') OR (contains(lower(name), base) AND length(name) > length(base) + 2))), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY length(name), name, id) AS r FROM m) SELECT base, id, name, type FROM r WHERE r <= 5""")
def name_variants_batch(spark, d):
    b = src.read(spark, d, "part").select(F.split("p_name", " ")[0].alias("base")).union(spark.createDataFrame([("Nobody Jr",)], "base string"))
    return graph.variants_each(b, src.nodes(spark, d))


def _name_index(spark, d):
    """The index of all names, built once an application."""
    store = tables.Store(spark, once_path(spark, "names", d))
    return names.NameIndex(store) if store.exists("name_pieces") else names.build(store, src.nodes(spark, d))


@query(f"""WITH {NODE}, q AS (SELECT trim(substr(lower(p_name), 3, 5)) AS matched FROM part UNION SELECT right(lower(s_name), 3) FROM supplier UNION SELECT right(lower(n_name), 2) FROM nation),
h AS (SELECT DISTINCT matched, id, name, type FROM node, q WHERE kind IN ('indexable', 'note') AND id IS NOT NULL AND name IS NOT NULL AND contains(lower(name), matched)),
r AS (SELECT *, row_number() OVER (PARTITION BY matched ORDER BY length(name), name, id) AS r FROM h) SELECT matched, id, name, type FROM r WHERE r <= 50""")
def name_match_batch(spark, d):
    p = src.read(spark, d, "part").select(F.substring("p_name", 3, 5).alias("pattern"))
    for table, column, n in (("supplier", "s_name", 3), ("nation", "n_name", 2)):
        p = p.union(src.read(spark, d, table).select(F.right(column, F.lit(n))))
    return _name_index(spark, d).fuzzy(p)


@query(f"""WITH {NODE}, b AS (SELECT DISTINCT trim(substr(lower(p_name), 2, 6)) AS base FROM part UNION SELECT 'nation_1'), m AS (SELECT DISTINCT base, id, name, type FROM b, node WHERE id IS NOT NULL AND name IS NOT NULL
 AND (starts_with(lower(name), base || ' ') OR (contains(lower(name), base) AND length(name) > length(base) + 2))), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY length(name), name, id) AS r FROM m) SELECT base, id, name, type FROM r WHERE r <= 5""")
def name_variants_index(spark, d):
    b = src.read(spark, d, "part").select(F.substring("p_name", 2, 6).alias("base")).union(src.read(spark, d, "nation").where("n_nationkey = 1").select("n_name"))
    return _name_index(spark, d).variants(b)


@query(f"""WITH RECURSIVE {REL}, {NODE}, e AS (SELECT DISTINCT src, dst, rel_type, confidence FROM (SELECT src, dst, rel_type, confidence FROM rel WHERE rel_type = 'located_in' UNION ALL SELECT dst, src, rel_type, confidence FROM rel WHERE rel_type = 'located_in') WHERE src <> dst AND confidence >= 0.5),
ids AS (SELECT DISTINCT id FROM node WHERE kind IN ('indexable', 'note') AND (contains(lower(name), 'nation_1') OR contains(lower(name), 'supplier#00000001'))), w AS (SELECT id AS seed, id AS node_id, 0 AS depth, [id] AS path FROM ids
 UNION ALL SELECT seed, dst, depth + 1, list_append(path, dst) FROM w JOIN e ON node_id = src WHERE depth < 4 AND NOT list_contains(path, dst))
SELECT seed AS src, node_id AS dst, depth AS length, array_to_string(path, '>') AS path FROM w WHERE depth > 0 AND seed < node_id AND node_id IN (SELECT id FROM ids)""")
def paths_named(spark, d):
    ensure_checkpoints(spark)
    e = src.relations(spark, d).where("rel_type = 'located_in'")
    return _name_index(spark, d).paths(["Nation_1", "SUPPLIER#00000001"], e, 4, limit=None).select("src", "dst", "length", F.array_join("path", ">").alias("path"))


@query(f"WITH {MEMBER}, s AS (SELECT level, community_id, count(*) AS n FROM member GROUP BY ALL) SELECT level, count(*) AS communities, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean FROM s GROUP BY level")
def community_sizes(spark, d):
    return communities.sizes(src.members(spark, d))


@query(f"WITH {NODE}, w AS (SELECT lower(c_name) AS name FROM customer UNION ALL SELECT 'stranger ' || (c_custkey % 5) FROM customer), e AS (SELECT DISTINCT name FROM w) SELECT node.id IS NULL AS is_new, count(*) AS n FROM e LEFT JOIN node ON node.name = e.name GROUP BY ALL")
def new_and_known(spark, d):
    c = src.read(spark, d, "customer")
    rows = c.select(F.lower("c_name").alias("name"), "c_custkey").unionByName(c.select(F.concat(F.lit("stranger "), (F.col("c_custkey") % 5).cast("string")).alias("name"), "c_custkey"))
    e = rows.select("name", F.col("c_custkey").cast("string").alias("note_id"), F.lit(0).alias("seq"), F.lit("thing").alias("type"))
    return ingest.resolve(e, src.nodes(spark, d).where("name is not null").select("id", "name", "type")).groupBy("is_new").agg(F.count("*").alias("n"))


# --- layout ----------------------------------------------------------------------------------------

_BYTE = "(('0x' || substr(md5({0}), {1}, 2))::INTEGER / 255.0::DOUBLE - 0.5) * 8"
_POINT = """cos(t) * sqrt(greatest(1.0::DOUBLE - y * y, 0)) * r AS px, y * r AS py, sin(t) * sqrt(greatest(1.0::DOUBLE - y * y, 0)) * r AS pz"""
_ANGLE = "1.0::DOUBLE - i::DOUBLE / greatest(n - 1, 1) * 2.0::DOUBLE AS y, i * (pi() * (sqrt(5.0::DOUBLE) - 1.0::DOUBLE)) AS t"


@query(f"""WITH {NODE}, {MEMBER}, c0 AS (SELECT community_id, row_number() OVER (ORDER BY community_id) - 1 AS i, count(*) OVER () AS n, 400.0::DOUBLE AS r FROM (SELECT DISTINCT community_id FROM member)),
c AS (SELECT community_id, {_POINT} FROM (SELECT *, {_ANGLE} FROM c0)), f AS (SELECT node_id, arg_max(community_id, level) AS community_id FROM member GROUP BY node_id),
m0 AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY node_id) - 1 AS i, count(*) OVER (PARTITION BY community_id) AS n FROM f), m AS (SELECT node_id, community_id, {_POINT} FROM (SELECT *, least(18.0::DOUBLE * sqrt(n), 160.0::DOUBLE) AS r, {_ANGLE} FROM m0)),
p AS (SELECT node_id, c.px + m.px AS x, c.py + m.py AS y, c.pz + m.pz AS z FROM m JOIN c USING (community_id))
SELECT id, round(coalesce(x, 0) + {_BYTE.format("id", 31)}, 4) AS x, round(coalesce(y, 0) + {_BYTE.format("id", 29)}, 4) AS y, round(coalesce(z, 0) + {_BYTE.format("id", 27)}, 4) AS z FROM node LEFT JOIN p ON id = node_id WHERE kind = 'indexable'""")
def flat_positions(spark, d):
    at = layout.flat_positions(src.nodes(spark, d).where("kind = 'indexable'"), src.members(spark, d))
    return at.select("id", *(F.round(a, 4).alias(a) for a in "xyz"))


_PART = "(('0x' || substr(md5(id), {0}, 4))::INTEGER / 65535.0::DOUBLE)"
_VOTE = """v{0} AS (SELECT child, parent FROM (SELECT c.community_id AS child, p.community_id AS parent, row_number() OVER (PARTITION BY c.community_id ORDER BY count(*) DESC, p.community_id) AS k FROM member c JOIN member p ON c.node_id = p.node_id AND c.level = {0} AND p.level = {1} GROUP BY c.community_id, p.community_id) WHERE k = 1)"""


@query(f"""WITH {NODE}, {MEMBER}, {_VOTE.format(1, 0)}, {_VOTE.format(2, 1)},
a0 AS (SELECT id, {_POINT} FROM (SELECT *, 600.0::DOUBLE AS r, {_ANGLE} FROM (SELECT community_id AS id, row_number() OVER (ORDER BY community_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT community_id FROM member WHERE level = 0)))),
b1 AS (SELECT id, parent, {_POINT} FROM (SELECT *, least(90.0::DOUBLE * sqrt(n), 360.0::DOUBLE) AS r, {_ANGLE} FROM (SELECT child AS id, parent, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM v1))),
a1 AS (SELECT b1.id, b1.px + a0.px AS px, b1.py + a0.py AS py, b1.pz + a0.pz AS pz FROM b1 JOIN a0 ON a0.id = parent),
b2 AS (SELECT id, parent, {_POINT} FROM (SELECT *, least(35.0::DOUBLE * sqrt(n), 140.0::DOUBLE) AS r, {_ANGLE} FROM (SELECT child AS id, parent, row_number() OVER (PARTITION BY parent ORDER BY child) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM v2))),
a2 AS (SELECT b2.id, b2.px + a1.px AS px, b2.py + a1.py AS py, b2.pz + a1.pz AS pz FROM b2 JOIN a1 ON a1.id = parent),
f AS (SELECT node_id AS id, arg_max(community_id, level) AS parent FROM member GROUP BY node_id),
b3 AS (SELECT id, parent, {_POINT} FROM (SELECT *, least(12.5::DOUBLE * sqrt(n), 100.0::DOUBLE) AS r, {_ANGLE} FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM f))),
a3 AS (SELECT b3.id, b3.px + a2.px AS px, b3.py + a2.py AS py, b3.pz + a2.pz AS pz FROM b3 JOIN a2 ON a2.id = parent),
a4 AS (SELECT id, r * sin(phi) * cos(theta) AS px, r * sin(phi) * sin(theta) AS py, r * cos(phi) AS pz FROM (SELECT id, {_PART.format(29)} * 2 * pi() AS theta, acos(1 - 2 * {_PART.format(25)}) AS phi, cbrt(900.0::DOUBLE ** 3 + {_PART.format(21)} * (1200.0::DOUBLE ** 3 - 900.0::DOUBLE ** 3)) AS r FROM node WHERE kind = 'indexable' AND id NOT IN (SELECT node_id FROM member))),
u AS (SELECT *, 0 AS tier FROM a0 UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3 UNION ALL SELECT *, 4 FROM a4) SELECT id, tier, round(px, 4) AS x, round(py, 4) AS y, round(pz, 4) AS z FROM u""")
def solar_positions(spark, d):
    at = layout.solar_positions(src.nodes(spark, d), src.members(spark, d))
    return at.select("id", "tier", *(F.round(a, 4).alias(a) for a in "xyz"))


@query(f"""WITH {MEMBER}, p AS (SELECT p_partkey, 'p' || p_partkey AS id, {_BYTE.format("'p' || p_partkey", 31)} AS x, {_BYTE.format("'p' || p_partkey", 29)} AS y FROM part)
SELECT community_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM member JOIN p ON id = node_id GROUP BY community_id""")
def community_centroids(spark, d):
    at = src.read(spark, d, "part").select(src.key("p", "p_partkey").alias("id")).withColumn("j", S.jitter(F.col("id"), 4.0)).select("id", "j.*")
    return layout.centroids(at, src.members(spark, d)).select("community_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_NEAR = "(('0x' || substr(md5('p' || p_partkey), {0}, 2))::INTEGER / 255.0::DOUBLE - 0.5) * 200"


@query(f"""WITH p AS (SELECT 'p' || p_partkey AS id, {_NEAR.format(31)} AS x, {_NEAR.format(29)} AS y, {_NEAR.format(27)} AS z FROM part), d AS (SELECT b.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM p a, p b WHERE a.id = 'p1' AND b.id <> 'p1')
SELECT id, distance FROM d WHERE distance <= 90 ORDER BY distance, id LIMIT 12""")
def nearest_nodes(spark, d):
    at = src.read(spark, d, "part").select(src.key("p", "p_partkey").alias("id")).withColumn("j", S.jitter(F.col("id"), 100.0)).select("id", "j.*")
    return layout.nearest(at, "p1", 90.0, 12)


@query("SELECT id, round(least(18.0 * sqrt(id), 160.0), 6) AS radius FROM (SELECT p_partkey AS id FROM part)")
def ring_radius(spark, d):
    return src.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(S.ring(18.0, F.col("p_partkey"), 160.0), 6).alias("radius"))


@query("SELECT 'n' || n_nationkey AS id, true AS placed FROM nation")
def spring_layout(spark, d):
    """Force-directed places of each region's nations; compared with plain loops in the tests, here only that all have one."""
    n = src.read(spark, d, "nation").select(F.col("n_regionkey").alias("group"), src.key("n", "n_nationkey").alias("id"))
    e = n.withColumnRenamed("id", "src").join(n.withColumnRenamed("id", "dst"), "group").where("src < dst")
    at = layout.spring_positions(n, e)
    return at.select("id", F.forall(F.array("x", "y", "z"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e6)).alias("placed"))


# --- retrieval steps -------------------------------------------------------------------------------


def stop_words() -> str:
    from .models import STOP

    return "[" + ", ".join(f"'{w}'" for w in sorted(STOP)) + "]"


def words_sql(text: str) -> str:
    """The words of the offline models in SQL."""
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({stop_words()}, w))"


@query(f"""WITH a AS (SELECT item_id::VARCHAR AS qid, list_filter(regexp_extract_all(text, '[A-Z][\\p{{L}}\\p{{N}}_''.-]*(?:\\s+[A-Z][\\p{{L}}\\p{{N}}_''.-]*)*'), lambda n: NOT list_contains({stop_words()}, lower(n))) AS e, {words_sql("text")} AS k FROM benchmark)
SELECT qid, len(e)::INTEGER AS entities, array_to_string(e[1:3], '|') AS first_entities, len(k)::INTEGER AS keywords, array_to_string(k[1:5], '|') AS first_keywords FROM a""")
def query_analysis(spark, d):
    q = src.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))
    a = retrieval.analyse(q)
    return a.select("qid", F.size("entities").alias("entities"), F.array_join(F.slice("entities", 1, 3), "|").alias("first_entities"), F.size("keywords").alias("keywords"), F.array_join(F.slice("keywords", 1, 5), "|").alias("first_keywords"))


@query("""WITH t AS (SELECT event_id, 'Who did ' || event_type || ' ' || user_id AS q, [event_type, 'extra', upper(event_type), 'more ' || user_id] AS k, ['extra', 'who'] AS c FROM events)
SELECT event_id, array_to_string(list_filter(list_concat(list_filter(k, lambda x: x <> 'extra'), [] ), lambda x: NOT contains(lower(q), lower(x))), '|') AS others, list_contains(list_filter(list_concat(k, c), lambda x: NOT contains(lower(q), lower(x))), 'extra') AS extra FROM t""")
def extra_terms(spark, d):
    e = src.read(spark, d, "events")
    u = F.col("user_id").cast("string")
    q = F.concat(F.lit("Who did "), "event_type", F.lit(" "), u)
    x = retrieval.extra_terms(q, F.array("event_type", F.lit("extra"), F.upper("event_type"), F.concat(F.lit("more "), u)), F.array(F.lit("extra"), F.lit("who")))
    return e.select("event_id", F.array_join(F.filter(x, lambda t: t != "extra"), "|").alias("others"), F.array_contains(x, "extra").alias("extra"))


@query("""SELECT event_id, 'Who is it?' || CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN ' [' || event_type || ']' WHEN event_id % 3 = 0 THEN ' [' || event_type || '; type: person, place]' WHEN event_id % 2 = 0 THEN '' ELSE ' [type: person, place]' END AS hint,
 'Who is it?' || CASE WHEN event_id % 3 = 0 THEN ' ' || event_type ELSE '' END || ' one two' AS enriched FROM events""")
def question_forms(spark, d):
    attribute = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("")
    types = F.when(F.col("event_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("person"), F.lit("place")))
    q = F.lit("Who is it?")
    return src.read(spark, d, "events").select("event_id", retrieval.rerank_hint(q, attribute, types).alias("hint"), retrieval.enriched_query(q, attribute, F.array(F.lit("one"), F.lit("two"))).alias("enriched"))


_RERANK = f"""c AS (SELECT q.item_id AS qid, q.text AS question, p.item_id AS ord, p.text[1:1500] AS text FROM benchmark q JOIN benchmark p ON p.item_id BETWEEN q.item_id AND q.item_id + 14),
s AS (SELECT qid, ord, len(list_intersect(list_distinct({words_sql("question")}), list_distinct({words_sql("text")}))) / greatest(1, len(list_distinct({words_sql("question")})))::DOUBLE AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord)::INTEGER AS place FROM s)"""


@query(f"WITH {_RERANK} SELECT qid, ord, place, round(score, 6) AS rerank_score FROM r WHERE place <= 10 AND score >= 0.05")
def rerank_top(spark, d):
    b = src.read(spark, d, "benchmark")
    p = b.select(F.col("item_id").alias("ord"), "text")
    q = b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    c = q.withColumn("ord", F.explode(F.sequence("qid", F.col("qid") + 14))).join(p, "ord")  # by equal ids, not all pairs
    return retrieval.rerank(c).select("qid", "ord", "place", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {NODE}, {REL}, found AS (SELECT 'q' || (s_suppkey % 3) AS qid, 's' || s_suppkey AS id FROM supplier), seeds AS (SELECT DISTINCT id FROM found),
e AS (SELECT src, dst, rel_type, coalesce(confidence, 1.0) AS confidence FROM rel), o AS (SELECT DISTINCT s.id AS seed, dst AS node_id, rel_type, confidence, 'outgoing' AS direction FROM e JOIN seeds s ON src = s.id),
i AS (SELECT DISTINCT s.id AS seed, src AS node_id, rel_type, confidence, 'incoming' AS direction FROM e JOIN seeds s ON dst = s.id), h AS (SELECT * FROM o UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.seed = i.seed AND o.node_id = i.node_id)),
x AS (SELECT qid, f.id, h.node_id, n.name, n.type, rel_type, confidence, direction FROM found f JOIN h ON seed = f.id JOIN node n ON n.id = h.node_id WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.qid = f.qid AND g.id = h.node_id)),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, node_id ORDER BY confidence DESC, id, rel_type) AS o FROM x) WHERE o = 1), z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY confidence DESC, name, node_id) AS r FROM y) WHERE r <= 10),
l AS (SELECT z.qid, z.id, r, n.name AS own, n.type AS kind, CASE WHEN direction = 'outgoing' AND rel_type = 'supplies' THEN 'delivers' ELSE replace(rel_type, '_', ' ') END AS nl, z.name AS other, z.type AS other_kind, direction FROM z JOIN node n ON n.id = z.id)
SELECT qid, id, own AS name, own || ' is a ' || kind || '.' || chr(10) || string_agg(CASE WHEN direction = 'incoming' THEN other || ' ' || nl || ' ' || own || '.' ELSE own || ' ' || nl || ' ' || other || '.' END || chr(10) || other || ' is a ' || other_kind || '.', chr(10) ORDER BY r) AS block FROM l GROUP BY qid, id, own, kind""")
def graph_expansion(spark, d):
    found = src.read(spark, d, "supplier").select(F.concat(F.lit("q"), (F.col("s_suppkey") % 3).cast("string")).alias("qid"), src.key("s", "s_suppkey").alias("id"))
    rel = src.relations(spark, d, counted=False)
    said = rel.where("rel_type = 'supplies'").select("src", "dst", F.lit("r1").alias("relationship_id"), F.lit("delivers").alias("natural_language"))
    return retrieval.expand(found, rel, src.nodes(spark, d), said)


_CHAT = """c AS (SELECT 'q' || (o_custkey % 20) AS qid, lower(o_orderpriority) AS name, o_orderkey AS ord, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS score, 'text ' || o_orderkey AS text, 'n' || (o_orderkey % 4) AS note FROM orders),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, name ORDER BY coalesce(score, 0) DESC, ord) AS n FROM c) WHERE n = 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, ord) AS r FROM u) WHERE r <= 3)"""


@query(f"""WITH {_CHAT} SELECT qid, 'yes' AS answer, string_agg(text, '|' ORDER BY r) AS context, coalesce((SELECT string_agg('- [Note](/notes/' || note || ')', chr(10) ORDER BY note) FROM (SELECT DISTINCT note FROM t s WHERE s.qid = t.qid AND score IS NOT NULL)), '') AS refs FROM t GROUP BY qid""")
def chat_assembly(spark, d):
    o = src.read(spark, d, "orders")
    qid = F.concat(F.lit("q"), (F.col("o_custkey") % 20).cast("string"))
    note = F.struct(F.concat(F.lit("n"), (F.col("o_orderkey") % 4).cast("string")).alias("id"), F.lit("Note").alias("title"))
    c = o.select(qid.alias("qid"), F.upper("o_orderpriority").alias("name"), F.lit("x").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("rerank_score"), F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("text"), F.array(note).alias("linked_notes"))
    answers = c.select("qid").distinct().withColumn("answer", F.lit("yes"))
    return retrieval.chat(answers, c, k=3).select("qid", "answer", F.array_join("context", "|").alias("context"), F.col("references").alias("refs"))


@query("SELECT 'q' || (o_custkey % 5) AS qid, lower(o_orderstatus) AS kind, count(*) AS n FROM orders GROUP BY ALL")
def hits_by_kind(spark, d):
    o = src.read(spark, d, "orders")
    return search.counts_by_kind(o.select(F.concat(F.lit("q"), (F.col("o_custkey") % 5).cast("string")).alias("qid"), F.lower("o_orderstatus").alias("kind")))


@query("""WITH r AS (SELECT item_id, item_id * 10.0::DOUBLE AS ms FROM benchmark WHERE item_id % 10 <> 9) SELECT round(quantile_cont(ms, 0.25), 6) AS p25, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.75), 6) AS p75, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95,
 round(avg((item_id % 3 < 2)::INTEGER), 6) AS contains_answer FROM r""")
def latency_percentiles(spark, d):
    b = src.read(spark, d, "benchmark")
    say = F.concat(F.lit("word"), F.col("item_id").cast("string"))
    actual = F.when(F.col("item_id") % 3 == 0, say).when(F.col("item_id") % 3 == 1, F.concat(F.lit("It is "), say)).otherwise("nothing")
    r = b.select(say.alias("expected"), actual.alias("actual"), F.lit(0.5).alias("precision"), F.lit(0.5).alias("recall"), (F.col("item_id") * 10.0).alias("total_time_ms"), F.when(F.col("item_id") % 10 == 9, "timeout").alias("error"))
    s = quality.summary(quality.answer_metrics(r))
    return s.select(*(F.round(F.col("quantiles_ms")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p95"))), F.round("contains_answer", 6).alias("contains_answer"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(l_tax * 10 - l_discount * 10)), 6) AS p FROM lineitem")
def yes_score(spark, d):
    return src.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.yes_probability(F.col("l_discount") * 10, F.col("l_tax") * 10), 6).alias("p"))


@query(f"""WITH a AS (SELECT 'p' || p_partkey AS id FROM part) SELECT id, round(r * sin(phi) * cos(theta), 4) AS x, round(r * cos(phi), 4) AS z FROM (SELECT id, {_PART.format(29)} * 2 * pi() AS theta, acos(1 - 2 * {_PART.format(25)}) AS phi, cbrt(900.0::DOUBLE ** 3 + {_PART.format(21)} * (1200.0::DOUBLE ** 3 - 900.0::DOUBLE ** 3)) AS r FROM a)""")
def asteroid_places(spark, d):
    at = src.read(spark, d, "part").select(src.key("p", "p_partkey").alias("id")).withColumn("a", layout.asteroid(F.col("id")))
    return at.select("id", F.round("a.x", 4).alias("x"), F.round("a.z", 4).alias("z"))


@query("""SELECT o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderstatus || ' ' || o_orderpriority END AS text FROM orders WHERE o_orderkey % 7 <> 0""")
def node_passages(spark, d):
    o = src.read(spark, d, "orders")
    k = F.col("o_orderkey")
    some = k % 7 != 0
    summary = F.when(some & (k % 3 == 0), F.concat(F.lit("s"), k.cast("string"))).otherwise("")
    description = F.when(some & (k % 3 == 1), F.col("o_orderpriority"))
    contexts = F.when(some & (k % 3 == 2), F.array("o_orderstatus", F.lit(""), "o_orderpriority"))
    return o.select(F.col("o_custkey").alias("id"), T.node_text(summary, description, contexts).alias("text")).where("text is not null")
