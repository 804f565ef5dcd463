"""Registered queries on text functions, the relationship fold, full-text search, communities and answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_stores import ensure_checkpoints, once_path, shared_path, stop_words, words_sql
from .functions import extraction as X
from .functions import rules
from .functions import text as T
from .models import Offline
from .operators import communities, fold, mentions, search, tables
from .operators.textindex import TextIndex
from .operators.vectors import VectorIndex, build
from .plans import ingest, retrieval
from .registry import ASSERTED, query
from .session import evened
from .sources import tables as src
from .streaming.indexing import index_stream


def _lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _event(spark, d):
    return src.read(spark, d, "events"), F.col("event_type"), F.col("user_id").cast("string")


# --- names and predicates --------------------------------------------------------------------------


@query("SELECT event_id, lower(event_type) || ' ' || user_id AS key, 'node_' || md5(lower(event_type) || ' ' || user_id) AS id FROM events")
def entity_keys(spark, d):
    e, t, u = _event(spark, d)
    name = F.concat(F.lit("## "), F.upper(t), F.lit(" "), u, F.lit("  "))
    return e.select("event_id", T.entity_key(name).alias("key"), T.node_id(name).alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'relates_to' ELSE event_type || '_by_' || user_id END AS kind, CASE WHEN event_id % 3 = 0 THEN 'thing' ELSE event_type END AS type, event_type || ' happened' AS plain, replace(event_type || '_of_' || user_id, '_', ' ') AS said FROM events")
def predicate_forms(spark, d):
    e, t, u = _event(spark, d)
    described = F.when(F.col("event_id") % 4 == 0, " !? ").otherwise(F.concat(F.initcap(t), F.lit("  by: "), u, F.lit("!")))
    return e.select(
        "event_id", T.described_type(described).alias("kind"), T.or_default(F.when(F.col("event_id") % 3 == 0, "  ").otherwise(t), "thing").alias("type"),
        T.without_facts_prefix(F.concat(F.lit(" FACTS: "), t, F.lit(" happened"))).alias("plain"), T.spoken(F.concat(t, F.lit("_of_"), u)).alias("said"),
    )


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'went to see' WHEN 1 THEN 'met' ELSE 'User ' || user_id END AS predicate FROM events")
def predicate_of_sentence(spark, d):
    e, t, u = _event(spark, d)
    name, k = F.concat(F.lit("User "), u), F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.upper(name), F.lit(" went to see "), t, F.lit(". "))).when(k == 1, F.concat(F.lit("met "), F.initcap(t))).otherwise(name)
    return e.select("event_id", T.predicate_text(said, name, t).alias("predicate"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Ann is a person. likes ' || event_type WHEN 1 THEN 'Ann. likes ' || event_type WHEN 2 THEN 'Ann was ' || user_id ELSE 'Ann' END ||
 CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Ann knows Bob.' || chr(10) || 'Bob is a man. tall' ELSE chr(10) || 'Bob knows Ann.' || chr(10) || 'Bob. tall' END AS block FROM events""")
def node_blocks(spark, d):
    e, t, u = _event(spark, d)
    k = F.col("event_id") % 4
    text = F.when(k < 2, F.concat(F.lit("likes "), t)).when(k == 2, F.concat(F.lit("Ann was "), u)).otherwise("")
    even = F.col("event_id") % 2 == 0
    rel = F.struct(F.lit("knows. ").alias("nl"), F.lit("Bob").alias("name"), F.when(even, "man").otherwise("").alias("type"), F.lit("tall").alias("context"), (~even).alias("incoming"))
    return e.select("event_id", T.node_block(F.lit("Ann"), F.when(k == 0, "person"), text, F.array(rel)).alias("block"))


@query(f"""WITH n AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Isolated  Nodes' WHEN 1 THEN 'Community L2-' || user_id WHEN 2 THEN 'community of ' || event_type WHEN 3 THEN 'A provisional ' || event_type WHEN 4 THEN event_type || ' nodes' WHEN 5 THEN ' ' WHEN 6 THEN NULL WHEN 7 THEN 'silent echoes, shadows' ELSE event_type || ' habits' END AS name FROM events),
m AS (SELECT event_id, lower(regexp_replace(trim(coalesce(name, '')), '\\s+', ' ', 'g')) AS n FROM n), w AS (SELECT *, list_filter(string_split_regex(n, '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM m)
SELECT event_id, n = '' OR regexp_matches(n, '^community\\s+l\\d+[-\\s]?\\d+$') OR starts_with(n, 'community ') OR len(list_filter({_lit(T.GENERIC_PHRASES)}, lambda p: contains(n, p))) > 0 OR (len(ws) > 0 AND len(list_filter(ws, lambda x: NOT list_contains({_lit(T.GENERIC_WORDS)}, x))) = 0) AS generic FROM w""")
def generic_names(spark, d):
    e, t, u = _event(spark, d)
    k = F.col("event_id") % 9
    name = F.when(k == 0, "Isolated  Nodes").when(k == 1, F.concat(F.lit("Community L2-"), u)).when(k == 2, F.concat(F.lit("community of "), t)).when(k == 3, F.concat(F.lit("A provisional "), t)).when(k == 4, F.concat(t, F.lit(" nodes")))
    name = name.when(k == 5, " ").when(k == 6, F.lit(None)).when(k == 7, "silent echoes, shadows").otherwise(F.concat(t, F.lit(" habits")))
    return e.select("event_id", T.generic_name(name).alias("generic"))


@query("""SELECT doc_id, lower(trim(n)) NOT IN ('untitled', 'none', 'unknown', '') AND length(trim(n)) > 2 AND length(trim(n)) <= 80 AS fine FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Untitled ' WHEN 1 THEN 'ab' WHEN 2 THEN text[1:81] || 'x' ELSE string_split(text, ' ')[1] END AS n FROM documents) WHERE n IS NOT NULL""")
def rename_acceptance(spark, d):
    k = F.col("doc_id") % 5
    n = F.when(k == 0, " Untitled ").when(k == 1, "ab").when(k == 2, F.concat(F.substring("text", 1, 81), F.lit("x"))).otherwise(F.split("text", " ")[0])
    return src.read(spark, d, "documents").select("doc_id", n.alias("n")).where("n is not null").select("doc_id", T.acceptable_rename(F.col("n")).alias("fine"))


@query("""WITH e AS (SELECT doc_id::VARCHAR AS note_id, text, unnest([{'seq': 0, 'name': '# ' || string_split(text, ' ')[1], 'type': 'person', 'context': ' said so '}, {'seq': 1, 'name': CASE doc_id % 3 WHEN 0 THEN 'Untitled' WHEN 1 THEN ' none ' ELSE 'Ann' END, 'type': ' ', 'context': ''}]) AS n FROM documents)
SELECT note_id, n.seq AS seq, lower(trim(regexp_replace(n.name, '^#+', ''))) AS name, coalesce(nullif(trim(n.type), ''), 'thing') AS type, length(coalesce(nullif(trim(n.context), ''), text)) AS context FROM e WHERE lower(trim(regexp_replace(n.name, '^#+', ''))) NOT IN ('untitled', 'none', 'unknown', '')""")
def entity_rows(spark, d):
    one = lambda name, kind, context: F.struct(name.alias("name"), F.lit(kind).alias("type"), F.lit(context).alias("isolated_context"))
    other = F.when(F.col("doc_id") % 3 == 0, "Untitled").when(F.col("doc_id") % 3 == 1, " none ").otherwise("Ann")
    x = src.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.array(one(F.concat(F.lit("# "), F.split("text", " ")[0]), "person", " said so "), one(other, " ", "")).alias("nodes"))
    return ingest.entity_rows(x).select("note_id", "seq", "name", "type", F.length("context").alias("context"))


# --- texts that models write -----------------------------------------------------------------------


@query("SELECT event_id, 'Tom & <Jerry> \"' || event_type || '\" ''' || user_id || ''' &lt;' AS title FROM events")
def titles_unescaped(spark, d):
    e, t, u = _event(spark, d)
    return e.select("event_id", T.unescaped(F.concat(F.lit("Tom &amp; &lt;Jerry&gt; &quot;"), t, F.lit("&quot; &#39;"), u, F.lit("&#x27; &amp;lt;"))).alias("title"))


@query("""SELECT event_id, '{"a": "' || event_type || '", "b": [1, ' || user_id || ']}' AS json FROM events""")
def json_repair(spark, d):
    e, t, u = _event(spark, d)
    return e.select("event_id", T.json_text(F.concat(F.lit('```json\n{“a”: "'), t, F.lit('\x07", "b": [1, '), u, F.lit(",],}\n```"))).alias("json"))


@query("""SELECT event_id, 'because of ' || event_type AS reasoning, CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR END AS answer, CASE WHEN event_id % 3 = 0 THEN 'who else?' END AS next_query, event_id % 3 > 0 AS can_answer, CASE WHEN event_id % 2 = 0 THEN 'deep' END AS thought FROM events""")
def model_sections(spark, d):
    e, t, u = _event(spark, d)
    k = F.col("event_id") % 3
    said = F.concat(F.lit("**REASONING:** because of "), t, F.when(k == 0, F.lit("\nANSWER: none\nNEXT_QUERY: who else?\nNEXT_QUERY: no")).when(k == 1, F.concat(F.lit("\n\n**ANSWER**: "), u)).otherwise(F.concat(F.lit("\nFINDING: "), u)))
    thought = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<think> deep </think>"), said)).otherwise(said)
    plain = T.without_thinking(thought)
    step = retrieval.parsed_step(plain)
    return e.select("event_id", T.section(plain, "REASONING").alias("reasoning"), step["answer"].alias("answer"), T.section(plain, "NEXT_QUERY").alias("next_query"), step["can_answer"].alias("can_answer"), T.thinking(thought).alias("thought"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type || ' club' END AS name, 'it meets on ' || user_id || ' days' AS summary, CASE WHEN event_id % 2 = 0 THEN 'Untitled Note' ELSE event_type END AS title FROM events")
def names_and_titles(spark, d):
    e, t, u = _event(spark, d)
    said = F.concat(F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("Name:  "), t, F.lit(" club"))).otherwise("no name here"), F.lit("\nSUMMARY: it meets on\n "), u, F.lit(" days\n"))
    x = T.name_and_summary(said)
    return e.select("event_id", x["name"].alias("name"), x["summary"].alias("summary"), T.title_of(F.when(F.col("event_id") % 2 == 0, ' "" ').otherwise(F.concat(F.lit('"'), t, F.lit('" ')))).alias("title"))


@query("""SELECT event_id, '- Ann (person): likes ' || event_type || ' | tall' || chr(10) || '- Bob (' || event_type || ')' AS lines, 'Ann is a member of ' || event_type || '.' AS sentence, event_type || '_of_' || user_id AS slug,
 '- [' || event_type || '](/notes/' || user_id || ')' AS reference, 'see [' || event_type || '](/entities/' || user_id || ') now' AS linked FROM events""")
def small_renderings(spark, d):
    e, t, u = _event(spark, d)
    members = F.array(F.struct(F.lit("Ann").alias("name"), F.lit("person").alias("label"), F.array(F.concat(F.lit("likes "), t), F.lit("tall")).alias("contexts")), F.struct(F.lit("Bob").alias("name"), t.alias("label"), F.array().cast("array<string>").alias("contexts")))
    return e.select(
        "event_id", T.member_context(members).alias("lines"), T.membership_sentence(F.lit("Ann"), t).alias("sentence"), T.slug(F.concat(F.lit(" "), F.initcap(t), F.lit(" Of "), u, F.lit(" "))).alias("slug"),
        T.reference_line(t, u).alias("reference"), T.linked_mentions(F.concat(F.lit("see [["), t, F.lit("|"), u, F.lit("]] now"))).alias("linked"),
    )


@query("""SELECT event_id, [2, 1, 1, 0, 1][(event_id % 5) + 1]::BIGINT AS nodes, [0, 1, 1, 0, 0][(event_id % 5) + 1]::BIGINT AS relationships, CASE event_id % 5 WHEN 0 THEN 'thing' WHEN 1 THEN 'person' WHEN 2 THEN 'thing' WHEN 4 THEN 'place' ELSE '' END AS type,
 CASE event_id % 5 WHEN 1 THEN event_type || '_with' WHEN 2 THEN 'knows' ELSE '' END AS rel_type, CASE event_id % 5 WHEN 1 THEN 8.0 WHEN 2 THEN 5.0 ELSE 0.0 END::DOUBLE AS confidence FROM events""")
def json_coerce(spark, d):
    """Five shapes of answers: nested and fenced, other names, two lists, none, cut off."""

    def run(frames):
        for f in frames:
            got = [X.coerce(t) for t in f["j"]]
            rel = [(x["relationships"] or [{"relationship_type": "", "confidence": 0.0}])[0] for x in got]
            yield f.assign(nodes=[len(x["nodes"]) for x in got], relationships=[len(x["relationships"]) for x in got], type=[(x["nodes"] or [{"type": ""}])[0]["type"] for x in got], rel_type=[r["relationship_type"] for r in rel], confidence=[float(r["confidence"]) for r in rel])[["event_id", "nodes", "relationships", "type", "rel_type", "confidence"]]

    e, t, _ = _event(spark, d)
    k = F.col("event_id") % 5
    j = F.when(k == 0, F.concat(F.lit('```json\n{"data": {"nodes": [{"trait": "'), t, F.lit('", "evidence_quote": "x"}, "plain",], "relations": []}')))
    j = j.when(k == 1, F.concat(F.lit('{"entities": [{"name": "A", "type": "person"}], "edges": [{"from": "A", "to": "B", "description": "'), F.initcap(t), F.lit(' With!", "confidence": " High "}]}')))
    j = j.when(k == 2, F.concat(F.lit('[[{"name": "'), t, F.lit('"}], [{"source": "X", "target": "Y", "type": "knows", "confidence": 0.5}]]'))).when(k == 3, t).otherwise(F.concat(F.lit('so: {"nodes": [{"name": "'), t, F.lit('", "type": "place"')))
    return e.select("event_id", j.alias("j")).mapInPandas(run, "event_id long, nodes long, relationships long, type string, rel_type string, confidence double")


@query("""WITH w AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)', 1), regexp_extract_all(text, '([A-Z][a-z]{3,})', 1))) AS m FROM documents),
n AS (SELECT lower(coalesce(regexp_extract_all(text, '([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)', 1)[1], regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)[1])) AS name, 'm' || min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 HAVING name IS NOT NULL), s AS (SELECT doc_id AS id, unnest(m) AS mention FROM w)
SELECT s.id, mention, n.id AS node_id FROM s JOIN n ON n.name = lower(mention)""")
def mention_scan(spark, d):
    docs = src.read(spark, d, "documents")
    first = docs.where("doc_id % 2 = 0").select("doc_id", F.lower(F.try_element_at(T.capitalised_spans(F.col("text")), F.lit(1))).alias("name")).where("name is not null")
    nodes = first.groupBy("name").agg(F.concat(F.lit("m"), F.min("doc_id").cast("string")).alias("id")).withColumn("kind", F.lit("indexable"))
    return retrieval.scan_mentions(docs.select(F.col("doc_id").alias("id"), "text"), nodes)


@query("""WITH w AS (SELECT DISTINCT lower(string_split(text, ' ')[3]) AS name FROM documents UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) FROM part), n AS (SELECT name FROM w WHERE regexp_full_match(name, '[a-z0-9]+')),
t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS mention FROM documents) SELECT id, mention, count(*) AS n FROM t JOIN n ON name = mention GROUP BY id, mention""")
def mention_counts(spark, d):
    docs = src.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    words = docs.select(F.get(F.split("text", " "), 2).alias("name")).union(src.read(spark, d, "part").select(F.split("p_name", " ")[1])).where(F.lower("name").rlike("^[a-z0-9]+$"))
    return mentions.counts(evened(docs), words)


@query()
def mention_tags(spark, d):
    """Mentions of names of one to three words, the longest first; names are the capitalised spans and the first words of all texts."""
    docs = src.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    first = docs.select(F.explode(F.array(*(F.array_join(F.slice(F.split("text", " "), 2, n), " ") for n in (2, 3)))).alias("name"))
    spans = docs.select(F.explode(T.capitalised_spans(F.col("text"))).alias("name"))
    return mentions.tag(evened(docs), first.union(spans).distinct())


# --- the relationship fold -------------------------------------------------------------------------


def _cases(table: dict, missing: str) -> str:
    return "CASE {0} " + " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in table.items() if v or missing == "NULL") + f" ELSE {missing} END"


_STATE = "STRUCT(f BOOLEAN, t VARCHAR, c DOUBLE, m BIGINT, i TIMESTAMP, v TIMESTAMP, ef VARCHAR, et VARCHAR, ib VARCHAR)[]"
_NEW = "struct_pack(f := {f}, t := kind, c := conf, m := 1::BIGINT, i := ts, v := NULL::TIMESTAMP, ef := {ef}, et := NULL::VARCHAR, ib := NULL::VARCHAR)"
_SET = "struct_pack(f := x.f, t := x.t, c := {c}, m := {m}, i := x.i, v := {v}, ef := x.ef, et := {et}, ib := {ib})"


def _set(**more: str) -> str:
    return _SET.format(**({"c": "x.c", "m": "x.m", "v": "x.v", "et": "x.et", "ib": "x.ib"} | more))


# One step an assertion: the state of a pair is the list of its edges, f telling those from src to dst.
_FOLD = f"""{ASSERTED}, usable AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts, event_id) AS n FROM asserted WHERE src IS NOT NULL AND dst IS NOT NULL AND rel_type <> ''),
steps AS (SELECT src, dst, 0::BIGINT AS n, []::{_STATE} AS e, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS action, false AS inverse, 0::BIGINT AS invalidated FROM (SELECT DISTINCT src, dst FROM usable)
 UNION ALL SELECT src, dst, n, CASE WHEN NOT twoway OR action = 'rejected' THEN e2 WHEN len(list_filter(e2, lambda x: NOT x.f AND x.t = kind)) > 0 THEN list_transform(e2, lambda x: CASE WHEN NOT x.f AND x.t = kind THEN {_set(m="x.m + 1")} ELSE x END) ELSE list_append(e2, {_NEW.format(f="false", ef="NULL::VARCHAR")}) END,
  event_id, kind, action, twoway AND action <> 'rejected', invalidated FROM (
 SELECT *, CASE action WHEN 'rejected' THEN e1 WHEN 'reinforced' THEN list_transform(e1, lambda x: CASE WHEN x.f AND x.t = kind THEN {_set(m="x.m + 1", c="greatest(x.c, conf)")} ELSE x END)
  WHEN 'evolved' THEN list_append(list_transform(e1, lambda x: CASE WHEN x.f AND x.t = cur THEN {_set(v="ts", et="kind")} ELSE x END), {_NEW.format(f="true", ef="cur")}) ELSE list_append(e1, {_NEW.format(f="true", ef="NULL::VARCHAR")}) END AS e2 FROM (
 SELECT *, CASE WHEN len(list_filter(e1, lambda x: x.f AND x.t = kind)) > 0 THEN 'reinforced' WHEN cur IS NULL THEN 'created' WHEN later IS NULL THEN 'created_parallel' WHEN list_contains(later, kind) THEN 'evolved' ELSE 'rejected' END AS action FROM (
 SELECT *, {_cases(rules.EVOLVE, "NULL").format("cur")} AS later FROM (
 SELECT *, list_sort(list_transform(list_filter(e1, lambda x: x.f), lambda x: struct_pack(i := x.i, t := x.t)))[1].t AS cur FROM (
 SELECT *, list_transform(e, lambda x: CASE WHEN x.f AND list_contains(against, x.t) THEN {_set(v="ts", ib="kind")} ELSE x END) AS e1, len(list_filter(e, lambda x: x.f AND list_contains(against, x.t) AND x.v IS NULL)) AS invalidated FROM (
 SELECT s.src, s.dst, o.n, s.e, o.event_id, o.rel_type AS kind, o.confidence AS conf, o.ts, {_cases(rules.CONTRADICT, "[]::VARCHAR[]").format("o.rel_type")} AS against, list_contains({_lit(rules.BIDIRECTIONAL)}, o.rel_type) AS twoway FROM steps s JOIN usable o ON o.src = s.src AND o.dst = s.dst AND o.n = s.n + 1)))))))"""


@query(f"""WITH RECURSIVE {_FOLD}, last AS (SELECT src, dst, unnest(arg_max(e, n)) AS x FROM steps GROUP BY src, dst)
SELECT CASE WHEN x.f THEN src ELSE dst END AS src, CASE WHEN x.f THEN dst ELSE src END AS dst, x.t AS rel_type, x.c AS confidence, x.m AS mention_count, x.v AS valid_to, x.ef AS evolved_from, x.et AS evolved_to, x.ib AS invalidated_by FROM last""")
def rel_fold(spark, d):
    return fold.fold_edges(src.assertions(spark, d)).select("src", "dst", "rel_type", "confidence", "mention_count", "valid_to", "evolved_from", "evolved_to", "invalidated_by")


@query(f"""WITH RECURSIVE {_FOLD} SELECT event_id, src, dst, kind AS rel_type, action, inverse, invalidated::INTEGER AS invalidated FROM steps WHERE n > 0
UNION ALL SELECT event_id, src, dst, rel_type, 'failed', false, 0 FROM asserted WHERE src IS NULL OR dst IS NULL OR coalesce(rel_type, '') = ''""")
def rel_actions(spark, d):
    return fold.fold_actions(src.assertions(spark, d))


@query(f"""WITH RECURSIVE {_FOLD}, last AS (SELECT src, dst, unnest(arg_max(e, n)) AS x FROM steps GROUP BY src, dst) SELECT x.f AS forward, count(*) AS edges, sum(x.m)::BIGINT AS mentions, count(x.v) AS ended FROM last GROUP BY x.f""")
def rel_fold_resumed(spark, d):
    """The same edges come out where the first half was stored before: the fold goes on from stored edges."""
    a = src.assertions(spark, d)
    middle = a.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    store = tables.Store(spark, shared_path(spark, "store"))
    store.commit("rel", fold.fold_edges(a.where(F.unix_micros(F.col("ts").cast("timestamp")) <= middle)))
    edges = fold.fold_edges(a.where(F.unix_micros(F.col("ts").cast("timestamp")) > middle), store.read("rel"))
    return edges.groupBy(F.startswith("src", F.lit("u")).alias("forward")).agg(F.count("*").alias("edges"), F.sum("mention_count").alias("mentions"), F.count("valid_to").alias("ended"))


# --- full-text search ------------------------------------------------------------------------------

_BASE = """t0 AS (SELECT doc_id AS id, 'name' AS field, 3.0 AS weight, array_to_string(string_split(text, ' ')[1:3], ' ') AS text FROM documents UNION ALL SELECT doc_id, 'type', 2.0, source FROM documents
 UNION ALL SELECT doc_id, 'isolated_contexts', 1.0, text FROM documents UNION ALL SELECT doc_id, 'relationship_natural_language', 1.0, 'written in ' || lang FROM documents),"""
_POST = """t1 AS (SELECT id, field, weight, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS ts FROM t0), mean AS (SELECT field, avg(len(ts)) AS mean, count(*) AS total FROM t1 GROUP BY field),
post AS (SELECT id, field, weight, dl, term, count(*) AS tf FROM (SELECT id, field, weight, len(ts) AS dl, unnest(ts) AS term FROM t1) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
hits AS (SELECT qid, id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * weight), 6) AS score FROM q JOIN post USING (term) JOIN df USING (term, field) JOIN mean USING (field) GROUP BY qid, id)"""
_FIELD = f"{_BASE}\n{_POST}"
_WORDS = "(VALUES ('a', 'the'), ('a', 'thand'), ('b', 'und'), ('b', 'de'), ('b', 'written')) v(qid, term)"


@query(f"WITH q AS (SELECT * FROM {_WORDS}), {_FIELD} SELECT qid, id, score, rank, n - rank + 1 AS rank_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank, least(20, count(*) OVER (PARTITION BY qid)) AS n FROM hits) WHERE rank <= 20")
def bm25_weighted_fields(spark, d):
    docs = src.text_documents(spark, d)
    terms = _terms(spark)
    return search.best_each(search.bm25(search.text_index(docs, terms=terms), docs, terms), 20)


def _terms(spark):
    return spark.createDataFrame([("a", "the"), ("a", "thand"), ("b", "und"), ("b", "de"), ("b", "written")], "qid string, term string")


@query(f"WITH q AS (SELECT * FROM {_WORDS}), {_FIELD} SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hits) WHERE r <= 5")
def text_index_stored(spark, d):
    """The index is written once; searches read only the postings of their terms."""
    store = tables.Store(spark, shared_path(spark, "store"))
    search.store_index(store, src.text_documents(spark, d))
    index, lengths = search.stored_index(store)
    return search.best_each(search.bm25(index, None, _terms(spark), lengths=lengths), 5).select("qid", "id", "score")


_CHANGED = """t0 AS (SELECT doc_id AS id, 'name' AS field, 3.0 AS weight, CASE WHEN doc_id % 5 = 1 THEN 'thand' ELSE array_to_string(string_split(text, ' ')[1:3], ' ') END AS text FROM documents
 UNION ALL SELECT doc_id, 'type', 2.0, source FROM documents UNION ALL SELECT doc_id, 'isolated_contexts', 1.0, CASE WHEN doc_id % 5 = 1 THEN 'the ' ELSE '' END || text FROM documents
 UNION ALL SELECT doc_id, 'relationship_natural_language', 1.0, CASE WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 3 = 0 THEN 'the und ' || lang ELSE 'written in ' || lang END FROM documents),
""" + _POST.replace("FROM t0)", "FROM t0 WHERE id % 7 <> 2)", 1)
_FIRST = "SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hits) WHERE r <= 50"


def _replacing(docs):
    """A fifth of the documents anew, without a sentence."""
    return docs.where("node_id % 5 = 1").withColumn("name", F.lit("thand")).withColumn("isolated_contexts", F.concat(F.lit("the "), "isolated_contexts")).withColumn("relationship_natural_language", F.lit(None).cast("string"))


def _refreshed(docs):
    """New sentences for a third of the documents."""
    return docs.where("node_id % 3 = 0").withColumn("relationship_natural_language", F.concat(F.lit("the und "), F.substring("relationship_natural_language", 12, 100)))


@query(f"WITH q AS (SELECT * FROM {_WORDS}), {_CHANGED} {_FIRST}")
def text_index_changed(spark, d):
    """Documents are changed in part, replaced and deleted as segments of the stored index; searches see what is live."""
    docs = src.text_documents(spark, d)
    index = TextIndex(tables.Store(spark, shared_path(spark, "store")), keep=1)
    index.upsert(docs)
    index.update(_refreshed(docs).select("node_id", "relationship_natural_language").unionByName(spark.createDataFrame([(-1, "the")], "node_id long, relationship_natural_language string")))
    index.upsert(_replacing(docs))
    index.delete(docs.where("node_id % 7 = 2"))
    return index.search(_terms(spark), 50).select("qid", "id", "score")


@query(f"WITH q AS (SELECT * FROM {_WORDS}), {_CHANGED} {_FIRST}")
def text_index_stream(spark, d):
    """The same changes as a stream that stops and goes on from its checkpoint; every batch is one segment."""
    ensure_checkpoints(spark)
    docs, base = src.text_documents(spark, d), shared_path(spark, "changes")
    index = TextIndex(tables.Store(spark, f"{base}/store"), keep=1)
    refreshed = _refreshed(docs)
    for n, some in enumerate([docs, refreshed, _replacing(docs).unionByName(docs.where("node_id % 7 = 2"))]):
        gone = (F.col("node_id") % 7 == 2) & F.lit(n == 2)
        some.withColumn("at", F.lit(n) + gone.cast("int")).withColumn("deleted", gone).select(*docs.columns, "at", "deleted").write.mode("append").parquet(f"{base}/in")
        changes = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("cleanSource", "delete").parquet(f"{base}/in")
        index_stream(changes, index, ["at"], f"{base}/checkpoint").awaitTermination()
    return index.search(_terms(spark), 50).select("qid", "id", "score")


# --- communities -----------------------------------------------------------------------------------


def clustered_vectors(spark, d):
    """Vectors that do cluster: a common part by pairs of labels, one by label, one by a third of a label, and a little noise."""
    label, third = F.col("label"), F.col("vec_id") % 3
    i = lambda j, of: F.when(of == j, 1.0).otherwise(0.0)
    noise = lambda j: ((F.col("vec_id") * 7919 + j * 31) % 100) * 0.0005
    parts = [i(j, label) for j in range(10)] + [i(j, F.floor(label / 2)) * 0.9 for j in range(5)] + [i(j, label * 3 + third) * 0.88 for j in range(30)]
    return src.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*(p + noise(j) for j, p in enumerate(parts))).alias("v"))


_GROUPS = "g AS (SELECT vec_id, label, label // 2 AS pair, min(vec_id) OVER (PARTITION BY label, vec_id % 3) AS c2, count(*) OVER (PARTITION BY label, vec_id % 3) AS n2 FROM embeddings)"


@query(f"WITH {_GROUPS} SELECT vec_id AS id, c2 AS cluster FROM g")
def cluster_l2(spark, d):
    ensure_checkpoints(spark)
    return communities.cluster(clustered_vectors(spark, d), 0.25)


@query(f"""WITH {_GROUPS}, a AS (SELECT *, min(c2) OVER (PARTITION BY label) AS c1, min(c2) OVER (PARTITION BY label) <> max(c2) OVER (PARTITION BY label) AS grown FROM g WHERE n2 > 1), b AS (SELECT *, min(c1) OVER (PARTITION BY pair) AS c0, min(c1) OVER (PARTITION BY pair) <> max(c1) OVER (PARTITION BY pair) AS pairs FROM a WHERE grown)
SELECT vec_id AS node_id, 'community_l2_' || c2 AS community_id, 2 AS level FROM a UNION ALL SELECT vec_id, 'community_l1_' || c1, 1 FROM b UNION ALL SELECT vec_id, 'community_l0_' || c0, 0 FROM b WHERE pairs""")
def community_hierarchy(spark, d):
    ensure_checkpoints(spark)
    return communities.hierarchy(clustered_vectors(spark, d))


@query("""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS s FROM v),
c AS (SELECT 0 AS step, id, s, 1.0::DOUBLE AS m, [id] AS ids FROM u
 UNION ALL SELECT step + 1, id, CASE WHEN id = low THEN list_transform(list_zip(s, s2), lambda p: p[1] + p[2]) ELSE s END, CASE WHEN id = low THEN m + m2 ELSE m END, CASE WHEN id = low THEN list_concat(ids, ids2) ELSE ids END
 FROM c, (SELECT a.id AS low, b.id AS high, b.s AS s2, b.m AS m2, b.ids AS ids2 FROM c a JOIN c b ON a.id < b.id WHERE 1 - list_inner_product(a.s, b.s) / (a.m * b.m) < 0.35 ORDER BY round(1 - list_inner_product(a.s, b.s) / (a.m * b.m), 12), a.id, b.id LIMIT 1) WHERE id <> high)
SELECT unnest(ids) AS id, id AS cluster FROM c WHERE step = (SELECT max(step) FROM c)""")
def cluster_embeddings(spark, d):
    """Average linkage of the embeddings themselves; the SQL merges the nearest two clusters again and again."""
    ensure_checkpoints(spark)
    return communities.cluster(src.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 0.35)


# --- ingestion -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, doc_id::VARCHAR AS note_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*')) AS names FROM documents), e AS (SELECT DISTINCT lower(trim(unnest(names))) AS name FROM s)
SELECT name, 'node_' || md5(name) AS id, 'thing' AS type, true AS is_new FROM e WHERE name NOT IN ('untitled', 'none', 'unknown', '')""")
def ingest_notes(spark, d):
    notes = src.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.timestamp_seconds(F.col("doc_id")).alias("ts"))
    return ingest.resolve(ingest.entity_rows(ingest.extract(notes))).select("name", "id", "type", "is_new")


# --- answering -------------------------------------------------------------------------------------


def _questions(spark, d):
    return src.read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"))


def _search(spark, d):
    """Documents are embedded and indexed once for a folder and application; later searches read what was stored."""
    docs = evened(src.text_documents(spark, d))
    nodes = docs.select(F.col("node_id").cast("string").alias("id"), F.lit("indexable").alias("kind"), "name", "type")
    store = tables.Store(spark, once_path(spark, "search", d))
    if not store.exists("ready"):
        search.store_index(store, docs)
        vectors = retrieval.embedded(docs.select(F.col("node_id").cast("string").alias("vec_id"), "isolated_contexts"), "isolated_contexts", Offline())
        build(store, vectors)
        store.commit("ready", spark.range(1))
    index, lengths = search.stored_index(store)
    return lambda q, k=retrieval.TOP: retrieval.hybrid_search(q, nodes, docs, index, vectors=VectorIndex(store), lengths=lengths, k=k)


_VECTOR = """(SELECT {1} AS id, b, sum(s)::DOUBLE AS x FROM (SELECT {1}, ('0x' || h[1:6])::INTEGER % 256 AS b, CASE WHEN ('0x' || h[7])::INTEGER >= 8 THEN 1 ELSE -1 END AS s FROM (SELECT {1}, md5(unnest({2})) AS h FROM {0})) GROUP BY ALL)"""

_HYBRID = f"""docs AS (SELECT doc_id, doc_id::VARCHAR AS id, array_to_string(string_split(text, ' ')[1:3], ' ') AS name, source AS type, text AS body FROM documents), ask AS (SELECT item_id::VARCHAR AS qid, text AS question FROM benchmark),
ents AS (SELECT DISTINCT qid, lower(trim(unnest(list_filter(regexp_extract_all(question, '[A-Z][\\p{{L}}\\p{{N}}_''.-]*(?:\\s+[A-Z][\\p{{L}}\\p{{N}}_''.-]*)*'), lambda n: NOT list_contains({stop_words()}, lower(n)))))) AS entity FROM ask),
em AS (SELECT qid, id, name, type, max(CASE WHEN lower(name) = entity THEN 1.0 ELSE 0.8 END)::DOUBLE AS score FROM ents JOIN docs ON string_split(entity, ' ')[1] = string_split(lower(name), ' ')[1] WHERE lower(name) = entity OR starts_with(lower(name), entity || ' ') OR starts_with(entity, lower(name) || ' ') GROUP BY ALL),
em50 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, id) AS r FROM em) WHERE r <= 50),
q AS (SELECT DISTINCT qid, unnest(list_filter(string_split_regex(lower(question), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM ask), {_FIELD},
tm AS (SELECT qid, docs.id, name, type, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hits) h JOIN docs ON doc_id = h.id WHERE r <= 100),
dw AS (SELECT id, {words_sql("body")} AS ws FROM docs), qw AS (SELECT qid, {words_sql("question")} AS ws FROM ask), dv AS {_VECTOR.format("dw", "id", "ws")}, qv AS {_VECTOR.format("qw", "qid", "ws")},
dn AS (SELECT id, sqrt(sum(x * x)) AS n FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id),
cs AS (SELECT qid, id, round(dot / (dn.n * qn.n), 6) AS score FROM (SELECT qv.id AS qid, dv.id AS id, sum(qv.x * dv.x) AS dot FROM qv JOIN dv USING (b) GROUP BY ALL) JOIN dn USING (id) JOIN qn ON qn.id = qid),
vm AS (SELECT qid, docs.id, name, type, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM cs WHERE score >= 0.45) JOIN docs USING (id) WHERE r <= 50),
u AS (SELECT qid, id, name, type, score, 0 AS source, 'entity_match' AS kind FROM em50 UNION ALL SELECT *, 1, 'text_match' FROM tm UNION ALL SELECT *, 2, 'vector_match' FROM vm),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(name) ORDER BY source, score DESC, name, id) AS n FROM u) WHERE n = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source, score DESC, name, id) AS ord FROM one),
full_ AS (SELECT r.qid, r.id, r.name, r.kind, ord, question, r.name || ' is a ' || r.type || '.' || CASE WHEN body <> '' THEN ' ' || body ELSE '' END AS text FROM ranked r JOIN docs USING (id) JOIN ask USING (qid)),
rated AS (SELECT *, len(list_intersect(list_distinct({words_sql("question")}), list_distinct({words_sql("substring(text, 1, 1500)")}))) / greatest(1, len(list_distinct({words_sql("question")})))::DOUBLE AS rerank_score FROM full_),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, ord)::INTEGER AS place FROM rated) WHERE place <= 10 AND rerank_score >= 0.05)"""


@query(f"WITH {_HYBRID} SELECT qid, id, name, kind, place, round(rerank_score, 6) AS rerank_score FROM top")
def hybrid_search(spark, d):
    return _search(spark, d)(_questions(spark, d)).select("qid", "id", "name", "kind", "place", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {_HYBRID}, best AS (SELECT qid, question, text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(list_intersect(list_distinct({words_sql("question")}), list_distinct({words_sql("text")}))) DESC, rerank_score DESC, text) AS r FROM top) WHERE r = 1),
lines AS (SELECT qid, question, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS ls FROM best), each AS (SELECT qid, question, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines),
said AS (SELECT qid, arg_min(line, (-len(list_intersect(list_distinct({words_sql("question")}), list_distinct({words_sql("line")}))), i)) AS line FROM each GROUP BY qid)
SELECT qid, coalesce(trim(line), 'No answer was found.') AS answer, CASE WHEN line IS NULL THEN 10 ELSE 2 END AS rounds FROM ask LEFT JOIN said USING (qid)""")
def answer_questions(spark, d):
    ensure_checkpoints(spark)
    return retrieval.answer(spark, _questions(spark, d), _search(spark, d)).select("qid", "answer", "rounds")
