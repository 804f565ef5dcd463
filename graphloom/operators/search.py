"""Vector search, full-text search and the merge of their hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .tables import Store
from .vectors import build

#: Fields of a text document and their weights.
FIELDS = {"name": 3.0, "type": 2.0, "isolated_contexts": 1.0, "relationship_natural_language": 1.0}

BATCH = 256  # questions that meet a document at once
ROWS = 512  # documents that a task multiplies at once


def with_unit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with `unit`; stored once, cosine is a product of two such columns."""
    return vectors.withColumn("unit", S.unit(F.col(column)))


def vector_top_k(vectors: DataFrame, query: list[float], k: int | None = 500, least: float | None = 0.45, where: Column | None = None, id_column: str = "vec_id") -> DataFrame:
    """The k best by cosine with one query that is a parameter; ties to the smaller id. Each task keeps k rows, so nothing else is moved. Without k all, in no order."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = (vectors if where is None else vectors.where(where)).withColumn("score", F.round(S.cosine(F.col("embedding"), q), 6))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored if k is None else scored.orderBy(F.desc("score"), id_column).limit(k)


def vector_top_k_each(vectors: DataFrame, queries: DataFrame, k: int, store: Store, least: float | None = None) -> DataFrame:
    """qid, vec_id, score, rank for every query(qid, embedding), through an index that is written to store; searches again go to `vectors.VectorIndex`."""
    return build(store, vectors.select("vec_id", "embedding")).search(queries, k, least)


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per lower-cased name of hits(name, score, origin, text, type): best score, summary and texts.

    origin 0 cores, 1 relationships, 2 contexts. The summary is that of the best core or relationship hit, then come the contexts by
    score that it doesn't hold yet.
    """
    same = hits.groupBy(F.lower("name").alias("key"), "origin", "text", "type").agg(F.max("score").alias("score"))  # repeats go before anything is gathered
    rows = same.groupBy("key").agg(
        F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.struct(F.col("origin").alias("o"), (-F.col("score")).alias("s"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("type", F.lit("")).alias("k")))).alias("h"),
    )
    heads = F.array_sort(F.transform(F.filter("h", lambda x: (x["o"] < 2) & (x["t"] != "")), lambda x: F.struct(x["s"], x["o"], x["t"])))
    first = F.coalesce(F.try_element_at(heads, F.lit(1))["t"], F.lit(""))
    contexts = F.transform(F.filter("h", lambda x: x["o"] == 2), lambda x: x["t"])
    text = F.aggregate(contexts, first, lambda a, c: F.when(F.contains(a, c), a).otherwise(F.trim(F.concat(a, F.lit(" "), c))))
    kind = F.coalesce(F.try_element_at(F.transform(F.filter("h", lambda x: x["k"] != ""), lambda x: x["k"]), F.lit(1)), F.lit(""))
    return rows.select(F.col("key").alias("name"), "score", text.alias("summary"), kind.alias("type"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _length(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+"))


def text_index(docs: DataFrame, fields: dict[str, float] = FIELDS, id_column: str = "node_id", terms: DataFrame | None = None) -> DataFrame:
    """Postings term, field, id, tf, len: one pass over the texts, one combined count before the shuffle. With terms(term) only theirs."""
    out = None
    for field in fields:
        # The length is taken before the tokens are exploded, so no row carries the whole list.
        cut = docs.select(F.col(id_column).alias("id"), tokens(F.col(field)).alias("t")).select("id", F.size("t").alias("len"), "t")
        rows = cut.select("id", F.lit(field).alias("field"), "len", F.explode("t").alias("term"))
        if terms is not None:
            rows = rows.join(terms.select(F.lower("term").alias("term")).distinct(), "term", "left_semi")
        rows = rows.groupBy("term", "field", "id", "len").agg(F.count("*").alias("tf"))
        out = rows if out is None else out.unionByName(rows)
    return out


def text_lengths(docs: DataFrame, fields: dict[str, float] = FIELDS) -> dict[str, float]:
    """The mean number of tokens of every field, and docs, the number of documents: one row."""
    return docs.select(*(F.avg(_length(F.col(f))).alias(f) for f in fields), F.count("*").alias("docs")).first().asDict()


def store_index(store, docs: DataFrame, fields: dict[str, float] = FIELDS, buckets: int = 64) -> None:
    """Writes postings, dealt by a hash of their term, and the fields' lengths. A search reads only the buckets of its terms."""
    # Texts are dealt by id in place of their tokens, which are then counted where they are.
    posts = text_index(docs.repartition(F.col("node_id")), fields).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    store.commit("postings", posts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term"), partition_by=["bucket"])
    rows = [(k, float(v or 0)) for k, v in text_lengths(docs, fields).items()]
    store.commit("lengths", docs.sparkSession.createDataFrame([(*r, buckets) for r in rows], "field string, mean double, buckets int"))


def stored_index(store) -> tuple[DataFrame, dict[str, float]]:
    """(postings, lengths) of a stored index, as `bm25` takes them."""
    rows = store.read("lengths").collect()  # a row for each field
    return store.read("postings"), {r["field"]: r["mean"] for r in rows} | {"buckets": rows[0]["buckets"]}


def _parts(index: DataFrame, docs: DataFrame | None, wanted: DataFrame, fields: dict[str, float], k1: float, b: float, lengths: dict[str, float] | None) -> DataFrame:
    """id, term, part: what every posting of wanted(term) adds to the score of its document."""
    lengths = lengths or text_lengths(docs, fields)
    total = lengths["docs"]
    mean = F.create_map(*(x for f in fields for x in (F.lit(f), F.lit(float(lengths[f] or 1)))))
    weight = F.create_map(*(x for f, w in fields.items() for x in (F.lit(f), F.lit(float(w)))))
    keys = wanted.select("term").distinct()
    if "bucket" in index.columns:  # so that the scan prunes the buckets
        keys = keys.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(int(lengths["buckets"]))).cast("int"))
    posts = index.join(keys, keys.columns, "left_semi")
    df = posts.groupBy("term", "field").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean[F.col("field")])) * weight[F.col("field")]
    return posts.join(df, ["term", "field"]).select("id", "term", part.alias("part"))


def bm25(index: DataFrame, docs: DataFrame | None, terms: DataFrame, fields: dict[str, float] = FIELDS, k1: float = 1.2, b: float = 0.75, lengths: dict[str, float] | None = None) -> DataFrame:
    """qid, id, score for terms(qid, term): the weighted sum over fields of BM25. The terms' side is the small one; only their postings are read.

    lengths are those of a stored index; without them they are counted over docs.
    """
    wanted = terms.select("qid", F.lower("term").alias("term")).distinct()
    return _parts(index, docs, wanted, fields, k1, b, lengths).join(wanted, "term").groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_best(index: DataFrame, docs: DataFrame | None, terms: DataFrame, k: int, fields: dict[str, float] = FIELDS, k1: float = 1.2, b: float = 0.75, lengths: dict[str, float] | None = None) -> DataFrame:
    """qid, id, score: the k best of `bm25` for every qid, ties to the smaller id. No row is made for a pair of a document and a question.

    Postings are dealt by document and BATCH questions, whose terms go along; a task multiplies rows of documents by its questions' terms
    and keeps k documents a question.
    """
    asked = terms.select("qid", F.lower("term").alias("term")).distinct()
    batches = F.broadcast(asked.agg(F.ceil(F.count_distinct("qid") / BATCH).cast("int").alias("_b")))  # a row
    asked = asked.crossJoin(batches).withColumn("batch", F.pmod(F.xxhash64("qid"), F.greatest("_b", F.lit(1))).cast("int")).select("batch", "qid", "term")
    parts = _parts(index, docs, asked, fields, k1, b, lengths).groupBy("id", "term").agg(F.sum("part").alias("part"))
    dealt = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.join(F.broadcast(asked.select("batch", "term").distinct()), "term").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(dealt)).cast("int"))
    each = rows.groupBy("batch", "slice", "id").agg(F.collect_list("term").alias("terms"), F.collect_list("part").alias("parts"))
    asked = asked.groupBy("batch", "qid").agg(F.collect_list("term").alias("terms")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, id {index.schema['id'].dataType.simpleString()}, score double"

    def best(part: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(questions):
            return pd.DataFrame({"qid": questions["qid"].iloc[:0], "id": part["id"].iloc[:0], "score": np.zeros(0)})
        names = {t: i for i, t in enumerate(sorted({t for x in questions["terms"] for t in x}))}
        holds = np.zeros((len(names), len(questions)))
        for q, x in enumerate(questions["terms"]):
            holds[[names[t] for t in x], q] = 1
        part = part.sort_values("id", key=lambda s: s.map(lambda x: x.encode()) if s.dtype == object else s).reset_index(drop=True)
        at, top = np.full((len(questions), 0), -1), np.zeros((len(questions), 0))
        for a in range(0, len(part), ROWS):
            some = part.iloc[a : a + ROWS]
            held = np.zeros((len(some), len(names)))
            for row, (t, x) in enumerate(zip(some["terms"], some["parts"], strict=True)):
                held[row, [names[w] for w in t]] = x
            # Every posting adds more than nothing, so 0 is no hit. Documents ascend: a stable sort leaves ties to the smaller.
            raw = (held @ holds).T
            score = np.concatenate((top, np.where(raw > 0, np.round(raw, 6), -1.0)), axis=1)
            place = np.concatenate((at, np.broadcast_to(np.arange(a, a + len(some)), raw.shape)), axis=1)
            kept = np.argsort(-score, axis=1, kind="stable")[:, :k]
            at, top = np.take_along_axis(place, kept, 1), np.take_along_axis(score, kept, 1)
        q, n = np.nonzero(top >= 0)
        return pd.DataFrame({"qid": questions["qid"].to_numpy()[q], "id": part["id"].to_numpy()[at[q, n]], "score": top[q, n]})

    key = ["batch", "slice"]
    hits = each.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(best, schema)
    return best_each(hits, k).select("qid", "id", "score")


def best_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best of every qid with rank and rank_score (rows of the query minus place)."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.withColumn("rank_score", F.count("*").over(Window.partitionBy("qid")) - F.col("rank") + 1)


def counts_by_kind(hits: DataFrame) -> DataFrame:
    """How many hits of each kind every query has."""
    return hits.groupBy("qid", "kind").agg(F.count("*").alias("n"))


def fuse(*sources: DataFrame) -> DataFrame:
    """Hits(qid, name, score, ...) of several sources, those of the first source first; each name once a query. ord tells the place."""
    out = None
    for i, s in enumerate(sources):
        rows = s.withColumn("source", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    ties = ["name", "id"] if "id" in out.columns else ["name"]
    first = Window.partitionBy("qid", F.lower("name")).orderBy("source", F.desc("score"), *ties)
    kept = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("source", F.desc("score"), *ties)))
