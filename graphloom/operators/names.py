"""Substring search over names through a stored index of their short pieces, for any number of patterns at once.

Every different lower-cased name has postings under each of its pieces of one to three characters, and under the empty piece. A pattern of
up to three characters is a piece itself; a longer one is looked up by the piece of three that the fewest names hold, and verified. So
patterns and names meet by equality, and a piece that very many names hold is dealt to many tasks (`graph.hub_join`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from .tables import Store

PIECE = 3  # characters of the longest pieces
BUCKETS = 16


def _runs(characters: Column, n: int) -> Column:
    """All runs of n elements, joined; null runs reach over the end and go."""
    return F.array_compact(F.transform(characters, lambda x, i: F.concat(*(F.get(characters, i + k) for k in range(n)))))


def pieces(text: Column, least: int = 0) -> Column:
    """The different pieces of a text of least to PIECE characters, counted in code points."""

    def cut(c: Column) -> Column:
        runs = [_runs(c, n) for n in range(max(least, 1), PIECE + 1)]
        return F.array_distinct(F.concat(*([F.array(F.lit("")), *runs] if least == 0 else runs)))

    # The characters are bound as a lambda's variable, so that they are taken once a text, not once a piece.
    return F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), cut)[0]


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def build(store: Store, nodes: DataFrame) -> NameIndex:
    """Writes the index of nodes(id, kind, name, type): entities and notes with an id and a name; repeated nodes count once.

    Three tables, each dealt by a hash: names (key, id, name, type), postings (piece, key) and pieces (piece, names); a fourth without rows
    keeps the columns of names, which folders by bucket don't show where there are no names.
    """
    named = G.by_kind(nodes, "indexable", "note").select(F.lower("name").alias("key"), "id", "name", "type").distinct().withColumn("bucket", _bucket("key"))
    store.commit("name_columns", named.limit(0))
    store.commit("names", named.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))), partition_by=["bucket"])
    keys = _names(store).select("key").distinct()
    posts = keys.select("key", F.explode(pieces(F.col("key"))).alias("piece")).withColumn("bucket", _bucket("piece"))
    # A piece of many names goes to several files, so that no task writes it alone.
    store.commit("name_postings", posts.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("bucket", "piece"), partition_by=["bucket"])
    held = store.read("name_postings", "key string, piece string, bucket int")
    store.commit("name_pieces", held.groupBy("piece").agg(F.count("*").alias("names")))
    return NameIndex(store)


def _names(store: Store) -> DataFrame:
    """The stored names. An index that was built before their columns were kept has names to show them."""
    return store.read("names", store.read("name_columns").schema if store.exists("name_columns") else None)


class NameIndex:
    """Reads of a stored index. Patterns are compared lower-cased and without spaces around them; null ones match nothing, empty ones
    every name. Names hold a pattern as characters, so `_`, `%` and the like mean themselves."""

    def __init__(self, store: Store):
        self.store = store

    def keys(self, patterns: DataFrame) -> DataFrame:
        """pattern, key: every different lower-cased name that holds a pattern of patterns(pattern)."""
        p = patterns.select(F.lower(F.trim("pattern")).alias("pattern")).where("pattern is not null").distinct()
        short = F.char_length("pattern") < PIECE
        own = p.where(short).select("pattern", F.col("pattern").alias("piece"))
        cut = p.where(~short).select("pattern", F.explode(pieces(F.col("pattern"), PIECE)).alias("piece"))
        counted = cut.join(self.store.read("name_pieces"), "piece", "left").withColumn("names", F.coalesce("names", F.lit(0)))
        rare = counted.groupBy("pattern").agg(F.min(F.struct("names", "piece")).alias("r")).where("r.names > 0").select("pattern", "r.piece")
        wanted = own.unionByName(rare).withColumn("bucket", _bucket("piece"))
        posts = self.store.read("name_postings", "key string, piece string, bucket int")
        posts = posts.join(wanted.select("piece", "bucket").distinct(), ["bucket", "piece"], "left_semi")
        met = G.hub_join(wanted.drop("bucket"), posts.drop("bucket"), "piece")
        return met.where(F.contains("key", F.col("pattern"))).select("pattern", "key")

    def fuzzy(self, patterns: DataFrame, per: int | None = 50) -> DataFrame:
        """matched, id, name, type of nodes whose name holds a pattern; the first `per` of each by length and name, None: all."""
        hit = self._nodes(self.keys(patterns)).withColumnRenamed("pattern", "matched")
        if per is None:
            return hit.select("matched", "id", "name", "type")
        order = Window.partitionBy("matched").orderBy(F.length("name"), "name", "id")
        return hit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).select("matched", "id", "name", "type")

    def variants(self, bases: DataFrame, per: int | None = 5) -> DataFrame:
        """base, id, name, type: other forms of bases(base), as `graph.variants` has them for one."""
        b = bases.select(F.col("base").alias("pattern")).where(F.trim("base") != "")
        hit = self._nodes(self.keys(b).where(G.is_variant(F.col("key"), F.col("pattern")))).withColumnRenamed("pattern", "base")
        if per is None:
            return hit.select("base", "id", "name", "type")
        order = Window.partitionBy("base").orderBy(F.length("name"), "name", "id")
        return hit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).select("base", "id", "name", "type")

    def paths(self, names: Sequence[str], edges: DataFrame, hops: int = 3, least: float = 0.5, limit: int | None = 20) -> DataFrame:
        """Paths between all nodes whose names hold one of the names (`graph.paths_between`)."""
        spark = self.store.spark
        ids = self.fuzzy(spark.createDataFrame([(n,) for n in names], "pattern string"), None).select("id").distinct()
        return G.paths_between(ids, edges, hops, least, limit)

    def _nodes(self, hits: DataFrame) -> DataFrame:
        n = _names(self.store).select("key", "id", "name", "type")
        return G.hub_join(hits, n, "key")
