"""Answering questions: hybrid search, expansion over the graph, reranking and the loop of steps. All operators take many questions at once (qid)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import ModelHub, Offline
from ..operators import graph as G
from ..operators import search as R
from ..operators.vectors import VectorIndex

TOP, EXPANDED, CONTEXT, ROUNDS, LEAST = 10, 10, 6, 10, 0.05
RERANKED = 1500  # characters of a text that the reranker reads


def analyse(questions: DataFrame, models: ModelHub | None = None) -> DataFrame:
    """qid, question with entities, keywords, concepts, types and attribute."""
    models = models or Offline()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = [models.analyze(q) for q in f["question"]]
            yield f.assign(entities=[x["entities"] for x in a], keywords=[x["keywords"] for x in a], concepts=[x["concepts"] for x in a], types=[x.get("expected_entity_types") or x.get("entity_types") or [] for x in a], attribute=[x.get("question_attribute") for x in a])

    return questions.select("qid", "question").mapInPandas(run, "qid string, question string, entities array<string>, keywords array<string>, concepts array<string>, types array<string>, attribute string")


def enriched_query(question: Column, attribute: Column, concepts: Column) -> Column:
    return F.concat_ws(" ", question, F.nullif(attribute, F.lit("")), F.array_join(concepts, " "))


def rerank_hint(question: Column, attribute: Column, types: Column) -> Column:
    hint = F.concat_ws("; ", F.nullif(attribute, F.lit("")), F.when(F.size(types) > 0, F.concat(F.lit("type: "), F.array_join(types, ", "))))
    return F.when(hint == "", question).otherwise(F.concat(question, F.lit(" ["), hint, F.lit("]")))


def extra_terms(question: Column, keywords: Column, concepts: Column) -> Column:
    """Keywords and concepts that the question doesn't hold."""
    return F.filter(F.array_distinct(F.concat(keywords, concepts)), lambda t: ~F.contains(F.lower(question), F.lower(t)))


def match_entities(analysed: DataFrame, nodes: DataFrame, per_query: int = 50) -> DataFrame:
    """qid, id, name, type, score of nodes named like an entity of the question: equal names, then names that begin with it.

    The names are looked up by their first word, an equi-join, so nodes aren't paired with every question.
    """
    wanted = analysed.select("qid", F.explode("entities").alias("entity")).select("qid", F.lower(F.trim("entity")).alias("entity")).where("entity <> ''").distinct()
    named = G.by_kind(nodes, "indexable", "note").select("id", F.lower("name").alias("n"), "name", "type")
    first = lambda c: F.split(c, " ")[0]
    hit = wanted.withColumn("w", first(F.col("entity"))).join(named.withColumn("w", first(F.col("n"))), "w").where((F.col("n") == F.col("entity")) | F.startswith(F.col("n"), F.concat("entity", F.lit(" "))) | F.startswith(F.col("entity"), F.concat("n", F.lit(" "))))
    best = hit.groupBy("qid", "id", "name", "type").agg(F.max(F.when(F.col("n") == F.col("entity"), 1.0).otherwise(0.8)).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "name", "id")
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_query).drop("_r")


def match_keywords(analysed: DataFrame, index: DataFrame, docs: DataFrame, per_query: int = 100, lengths: dict[str, float] | None = None) -> DataFrame:
    """qid, id, score by BM25 of the question's words and further terms."""
    terms = analysed.select("qid", F.explode(F.array_distinct(F.concat(R.tokens(F.col("question")), F.flatten(F.transform(extra_terms(F.col("question"), F.col("keywords"), F.col("concepts")), R.tokens))))).alias("term"))
    return R.bm25_best(index, docs, terms, per_query, lengths=lengths)


def embedded(rows: DataFrame, column: str, models: ModelHub | None = None, query: bool = False) -> DataFrame:
    """rows with the embedding of a text column instead of it."""
    models = models or Offline()

    @F.pandas_udf("array<double>")
    def embed(t: pd.Series) -> pd.Series:
        return pd.Series([v.tolist() for v in models.embed(list(t.fillna("")), query=query)])

    return rows.withColumn("embedding", embed(column)).drop(column)


def best_neighbours(found: DataFrame, edges: DataFrame, nodes: DataFrame, per_node: int = EXPANDED) -> DataFrame:
    """qid, id, node_id, name, type, rel_type, incoming, place: the best neighbours of found nodes (qid, id) that weren't found themselves, each once
    a question, with its best edge. Repeated edges count once; an incoming one counts only where none goes out to that neighbour.

    Edges meet by question and neighbour in one shuffle and one sort, and leave it as one row, before names, found nodes and places are looked at.
    """
    asked = found.select("qid", "id").where("id is not null").distinct()
    near = G.ends(edges.where("src is not null and dst is not null")).join(asked.withColumnRenamed("id", "seed"), "seed").withColumnRenamed("seed", "id")
    near = G.dealt(near.select("qid", "node_id", "id", (F.col("direction") == "incoming").alias("incoming"), "rel_type", "confidence"), "qid", "node_id")
    # In this order the first edge of a pair is its best outgoing one, or its best incoming one where none goes out.
    pair = Window.partitionBy("node_id", "qid").orderBy("id", "incoming", F.desc("confidence"), "rel_type")
    first = near.withColumn("_before", F.lag("id").over(pair)).where("_before is null or _before <> id")
    less = F.when(~F.isnan("confidence"), -F.col("confidence")).alias("less")  # smallest where confidence is greatest; null, before all, where it is no number
    one = first.groupBy("node_id", "qid").agg(F.min(F.struct(less, "id", "rel_type", "incoming")).alias("w"))
    one = one.select("qid", "node_id", "w.id", "w.rel_type", "w.incoming", F.coalesce(-F.col("w.less"), F.lit(float("nan"))).alias("confidence"))
    rows = one.join(asked.withColumnRenamed("id", "node_id"), ["qid", "node_id"], "left_anti").join(nodes.select(F.col("id").alias("node_id"), "name", "type"), "node_id")
    once = Window.partitionBy("node_id", "qid").orderBy("name", "type")  # a node may be listed twice
    best = Window.partitionBy("id", "qid").orderBy(F.desc("confidence"), "name", "node_id")
    rows = rows.withColumn("_o", F.row_number().over(once)).where("_o = 1").withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_node)
    return rows.select("qid", "id", "node_id", "name", "type", "rel_type", "incoming", "place")


def expand(found: DataFrame, edges: DataFrame, nodes: DataFrame, sentences: DataFrame, per_node: int = EXPANDED) -> DataFrame:
    """qid, id, name, block: found nodes (qid, id) with the sentences of their best neighbours that weren't found themselves; each neighbour once a question.

    The neighbours, at most per_node rows a found node, are written (`checkpoint`), as sentences are narrowed to theirs before they are grouped.
    """
    incoming = F.col("incoming")
    rows = best_neighbours(found, edges, nodes, per_node).withColumn("src", F.when(incoming, F.col("node_id")).otherwise(F.col("id"))).withColumn("dst", F.when(incoming, F.col("id")).otherwise(F.col("node_id"))).checkpoint()
    told = sentences.join(rows.select("src", "dst").distinct().hint("shuffle_hash"), ["src", "dst"], "left_semi")
    said = told.groupBy("src", "dst").agg(F.max_by("natural_language", "relationship_id").alias("nl"))
    rows = rows.join(said, ["src", "dst"], "left").withColumn("nl", F.coalesce("nl", T.spoken(F.col("rel_type"))))
    rel = F.struct(F.col("place").alias("r"), "nl", "name", "type", F.lit("").alias("context"), "incoming")
    lists = rows.groupBy("qid", "id").agg(F.array_sort(F.collect_list(rel)).alias("rels"))
    named = lists.join(nodes.select("id", "name", "type"), "id")
    return named.select("qid", "id", "name", T.node_block(F.col("name"), F.col("type"), F.lit(None).cast("string"), F.col("rels"), brief=True).alias("block"))


def rerank(candidates: DataFrame, models: ModelHub | None = None, k: int = TOP, least: float = LEAST, characters: int = RERANKED) -> DataFrame:
    """The k best candidates(qid, question, text, ord) of every question by the reranker, then those that reach the bar.

    The reranker reads the first characters of a text, as many as it has room for; it gets all of a batch's texts of one question at once.
    """
    models = models or Offline()

    @F.pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        out, texts = pd.Series(0.0, index=question.index), text.fillna("").str.slice(0, characters)
        for q, part in texts.groupby(question):
            out[part.index] = models.rerank(q, list(part))
        return out

    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "ord")
    out = candidates.withColumn("rerank_score", score("question", "text")).withColumn("place", F.row_number().over(order))
    return out.where((F.col("place") <= k) & (F.col("rerank_score") >= least))


def hybrid_search(questions: DataFrame, nodes: DataFrame, docs: DataFrame, index: DataFrame, ref: DataFrame | None = None, notes: DataFrame | None = None, vectors: VectorIndex | list[VectorIndex] | None = None, models: ModelHub | None = None, k: int = TOP, lengths: dict[str, float] | None = None) -> DataFrame:
    """Candidates of every question: entity matches, then text hits, then vector hits; each name once; reranked; with up to two notes each."""
    models = models or Offline()
    analysed = analyse(questions, models)
    entity = match_entities(analysed, nodes).select("qid", "id", "name", F.col("type"), "score", F.lit("entity_match").alias("kind"))
    text = match_keywords(analysed, index, docs, lengths=lengths).join(docs.select(F.col("node_id").alias("id"), "name", "type"), "id").select("qid", F.col("id").cast("string").alias("id"), "name", "type", "score", F.lit("text_match").alias("kind"))
    sources = [entity, text]
    if vectors is not None:
        q = embedded(analysed.select("qid", enriched_query(F.col("question"), F.col("attribute"), F.col("concepts")).alias("q")), "q", models, query=True)
        hits = None  # several collections: each gives its best, a node counts with its best hit
        for collection in vectors if isinstance(vectors, list) else [vectors]:
            some = collection.search(q, 50, 0.45).select("qid", "vec_id", "score")
            hits = some if hits is None else hits.unionByName(some).groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
        sources.append(hits.join(nodes.select(F.col("id").alias("vec_id"), "name", "type"), "vec_id").select("qid", F.col("vec_id").alias("id"), "name", "type", "score", F.when(F.col("type") == "community", "community_summary").otherwise("vector_match").alias("kind")))
    fused = R.fuse(*sources)
    body = docs.select(F.col("node_id").cast("string").alias("id"), F.col("isolated_contexts").alias("body"))
    full = fused.join(body, "id", "left").join(analysed.select("qid", rerank_hint(F.col("question"), F.col("attribute"), F.col("types")).alias("question")), "qid")
    full = full.withColumn("text", T.node_block(F.col("name"), F.col("type"), F.col("body"), None)).where("text <> ''").drop("body")
    out = rerank(full, models, k)
    if ref is None or notes is None:
        return out
    linked = G.evidence(ref, notes).groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("note_id").alias("id"), "title"))).alias("linked_notes"))
    return out.join(linked, "id", "left")


def parsed_step(answer: Column) -> Column:
    """struct<can_answer, answer, finding, next_query> of a model's step."""
    answered = F.nullif(T.section(answer, "ANSWER"), F.lit(""))
    real = F.when(F.upper(answered).isin("NONE", "N/A", "UNKNOWN", "NULL", "NO ANSWER"), F.lit(None)).otherwise(answered)
    finding = F.coalesce(T.section(answer, "FINDING"), T.section(answer, "FULL_ANSWER"))
    following = T.section(answer, "NEXT_QUERY")
    final = F.when(real.isNotNull(), real).when(following.isNull(), finding)
    return F.struct(final.isNotNull().alias("can_answer"), final.alias("answer"), finding.alias("finding"), following.alias("next_query"))


def answer(spark: SparkSession, questions: DataFrame, search, models: ModelHub | None = None, rounds: int = ROUNDS) -> DataFrame:
    """qid, answer, rounds, thinking. search(questions) gives candidates(qid, text, id, rerank_score) for the open questions' current queries.

    The driver only counts rounds; the state of all questions is one table, written after every round.
    """
    models = models or Offline()

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(said=[models.step(q, [t for t in (d if d is not None else []) if t], [{"full_answer": x} for x in (s if s is not None else [])]) for q, d, s in zip(f["question"], f["texts"], f["findings"], strict=True)])

    columns = "qid string, question string, query string, texts array<string>, findings array<string>, answer string, done boolean, round int"
    state = questions.select("qid", "question", F.lit(None).cast("string").alias("query"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<string>").alias("findings"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("done"), F.lit(0).alias("round"))
    for n in range(1, rounds + 1):
        live = state.where("not done")
        if n > 1:
            found = search(live.select("qid", F.col("query").alias("question"))).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("rerank_score")).alias("s"), "text"))).alias("f"))
            live = live.join(found, "qid", "left").withColumn("texts", F.array_union("texts", F.coalesce(F.transform("f", lambda x: x["text"]), F.array().cast("array<string>")))).drop("f")
        said = live.mapInPandas(step, columns + ", said string").withColumn("p", parsed_step(F.col("said")))
        new = said.select("qid", "question", F.coalesce("p.next_query", "query").alias("query"), "texts", F.array_compact(F.concat("findings", F.array("p.finding"))).alias("findings"), F.col("p.answer").alias("answer"), (F.col("p.can_answer") | F.col("p.next_query").isNull()).alias("done"), F.lit(n).alias("round"))
        state = state.where("done").unionByName(new).checkpoint()
        if state.where("not done").isEmpty():
            break
    last = F.try_element_at("findings", F.lit(-1))
    return state.select("qid", F.coalesce("answer", last, F.lit("No answer was found.")).alias("answer"), F.col("round").alias("rounds"), F.array_join("findings", "\n").alias("thinking"))


def chat(answers: DataFrame, candidates: DataFrame, k: int = CONTEXT) -> DataFrame:
    """qid, answer, context, references: the k best different candidates and the notes of those that have a score."""
    rows = candidates.withColumn("_key", F.coalesce(F.lower("name"), "id", "text"))
    once = Window.partitionBy("qid", "_key").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "ord")
    best = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "ord")
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    notes = F.when(F.col("rerank_score").isNull(), F.array().cast("array<struct<id:string,title:string>>")).otherwise(F.coalesce("linked_notes", F.array().cast("array<struct<id:string,title:string>>")))
    per = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_r", "text"))).alias("c"), F.array_distinct(F.flatten(F.collect_list(notes))).alias("n"))
    lines = F.array_join(F.transform(F.array_sort("n"), lambda x: T.reference_line(x["title"], x["id"])), "\n")
    return answers.join(per, "qid", "left").select("qid", "answer", F.transform("c", lambda x: x["text"]).alias("context"), lines.alias("references"))


def scan_mentions(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, mention, node_id: capitalised spans of texts(id, text) that are a node's name, the smallest node of each name."""
    spans = texts.select("id", F.explode(T.capitalised_spans(F.col("text"))).alias("mention")).withColumn("name", F.lower("mention"))
    return spans.join(G.canonical_ids(nodes).withColumnRenamed("id", "node_id"), "name").select("id", "mention", "node_id")


def tag_mentions(text: str, names: list[str], longest_first: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, name) of names in a text that don't overlap: the longest first, or from left to right."""
    import re

    hits = [(m.start(), m.end(), n) for n in names if n for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.I)]
    hits.sort(key=lambda h: (h[0] - h[1], h[0]) if longest_first else (h[0], h[0] - h[1]))
    kept: list[tuple[int, int, str]] = []
    for h in hits:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return sorted(kept)


def autocomplete(nodes: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Nodes whose name holds two or more typed characters, those that begin with them first; notes and communities aren't offered."""
    q = prefix.lower().strip()
    rows = nodes.where(F.col("kind") == "indexable").where(~F.coalesce(F.col("type"), F.lit("")).isin("note", "community"))
    if len(q) < 2:
        return rows.select("id", "name", "type").limit(0)
    n = F.lower("name")
    return rows.where(F.contains(n, F.lit(q))).orderBy(F.desc(n.startswith(q)), "name", "id").select("id", "name", "type").limit(limit)
