"""Graph, note and vector tables as views over the star-schema tables of a folder, and readers of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, type."""
    parts = (("region", "r", "r_regionkey", "r_name", "place"), ("nation", "n", "n_nationkey", "n_name", "place"), ("supplier", "s", "s_suppkey", "s_name", "organization"), ("customer", "c", "c_custkey", "c_name", "person"), ("part", "p", "p_partkey", "p_name", "thing"))
    out = read(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("id"), F.lit("note").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"))
    for table, prefix, k, name, kind in parts:
        out = read(spark, sf_dir, table).select(key(prefix, k).alias("id"), F.lit("indexable").alias("kind"), F.lower(name).alias("name"), F.lit(kind).alias("type")).unionByName(out)
    return out


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("mention_count"))


def relations(spark: SparkSession, sf_dir: str, counted: bool = True) -> DataFrame:
    """src, dst, rel_type, confidence, mention_count. Not counted: an edge comes as often as the tables mention it, each time as one mention, for
    readers to whom repeats don't matter; then nothing is grouped."""
    each = _counted if counted else lambda rows, *keys: rows.select(*keys, F.lit(1).cast("long").alias("mention_count"))
    fixed = lambda t, a, ka, b, kb: read(spark, sf_dir, t).select(key(a, ka).alias("src"), key(b, kb).alias("dst"), F.lit("located_in").alias("rel_type"), F.lit(9.0).alias("confidence"), F.lit(1).cast("long").alias("mention_count"))
    score = lambda x, y: 1 + F.pmod(F.col(x) + F.col(y), F.lit(10)) * F.lit(0.9)
    supplies = each(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst"), F.lit("supplies").alias("rel_type"), score("l_suppkey", "l_partkey").alias("confidence"), "mention_count")
    bought = each(read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_suppkey")
    buys = bought.select(key("c", "o_custkey").alias("src"), key("s", "l_suppkey").alias("dst"), F.lit("buys_from").alias("rel_type"), score("o_custkey", "l_suppkey").alias("confidence"), "mention_count")
    return fixed("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(fixed("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(fixed("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(supplies).unionByName(buys)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, node_id."""
    line = read(spark, sf_dir, "lineitem")
    return (
        line.select(key("o", "l_orderkey").alias("note_id"), key("p", "l_partkey").alias("node_id")).distinct()
        .unionByName(line.select(key("o", "l_orderkey").alias("note_id"), key("s", "l_suppkey").alias("node_id")).distinct())
        .unionByName(read(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("note_id"), key("c", "o_custkey").alias("node_id")))
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, community_id, level: parts by brand (2), type (1) and size band (0)."""
    part = read(spark, sf_dir, "part")
    rows = lambda c, level: part.select(key("p", "p_partkey").alias("node_id"), c.alias("community_id"), F.lit(level).alias("level"))
    return rows(F.concat(F.lit("community_l2_"), "p_brand"), 2).unionByName(rows(F.concat(F.lit("community_l1_"), "p_type"), 1)).unionByName(rows(F.concat(F.lit("community_l0_"), F.floor(F.col("p_size") / 10).cast("string")), 0))


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, src, dst, rel_type, confidence: relationship assertions in time."""
    types = F.create_map(*(F.lit(x) for x in ("signup", "knows", "view", "learning", "click", "works_with", "purchase", "friends_with", "error", "hates")))
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select("event_id", "ts", key("u", "user_id").alias("src"), F.concat(F.lit("k"), F.pmod(k, F.lit(10)).cast("string")).alias("dst"), types[F.col("event_type")].alias("rel_type"), F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.col("value") / 10)).alias("confidence"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content, processed, failed, kb_id: documents as notes, their flags from labels."""
    d, y = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    title = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return d.join(y, "doc_id", "left").select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("content"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("processed"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("failed"), F.col("lang").alias("kb_id"))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, name, type, isolated_contexts, relationship_natural_language."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"), F.col("source").alias("type"), F.col("text").alias("isolated_contexts"), F.concat(F.lit("written in "), "lang").alias("relationship_natural_language"))
