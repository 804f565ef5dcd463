"""Changes of stored tables: upserts, replacements, deletions, and versioned storage that readers see whole.

Parquet has no MERGE, so a change gives the new table as a plan; `commit` writes it beside the old one and then moves the pointer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key: one combined maximum, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """stored with new: absent keys are added, present ones get new's values where these aren't null; columns in keep stay as stored. new has a key once."""
    rest = [c for c in stored.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest if c in new.columns))
    value = lambda c: F.col(c) if c not in new.columns else F.coalesce(c, f"_{c}") if c in keep else F.coalesce(f"_{c}", c)
    return stored.join(n, list(keys), "full").select(*keys, *(value(c).alias(c) for c in rest))


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in new are replaced by new's."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update(stored: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only present keys change; unknown ones are ignored."""
    return upsert(stored, changes.join(stored.select(*keys).distinct(), list(keys), "left_semi"), keys)


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def set_status(notes: DataFrame, ids: DataFrame, processed: bool | None = None, failed: bool | None = None) -> DataFrame:
    """processed sets failed to false; failed alone leaves processed; a reset is processed = false."""
    hit = notes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    on = F.coalesce("_hit", F.lit(False))
    p = F.when(on & F.lit(processed is not None), F.lit(bool(processed))).otherwise(F.col("processed"))
    f = F.when(on & F.lit(bool(processed)), F.lit(False)).when(on & F.lit(failed is not None), F.lit(bool(failed))).otherwise(F.col("failed"))
    return hit.select(*(p.alias(c) if c == "processed" else f.alias(c) if c == "failed" else F.col(c) for c in notes.columns))


def append_children(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Only adds, even what is there already."""
    return stored.unionByName(new, allowMissingColumns=True)


def matching(rows: DataFrame, **payload) -> DataFrame:
    """Rows whose fields equal the given values, or are among them where a list is given; a None asks for nothing."""
    for name, value in payload.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(*value) if isinstance(value, list | tuple | set) else F.col(name) == F.lit(value))
    return rows


def retrieve(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some ids; unknown ids give none."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def execute(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """A parameterised SQL query over some tables, each named {like_this} in it."""
    return spark.sql(sql, args=args or {}, **views)


def status(processed: Column, failed: Column) -> Column:
    return F.when(processed, "completed").when(failed, "failed").otherwise("processing")


def delete_note(note_id: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without a note and without the entities that only it refers to; shared ones stay.

    tables: notes(id), ref(note_id, node_id), nodes(id), and any of rel(src, dst), member(node_id), core(node_id), contexts(node_id), text(node_id).
    """
    from .graph import referenced_only_by

    gone = referenced_only_by(tables["ref"], note_id).select(F.col("node_id").alias("id"))
    out = dict(tables)
    out["notes"], out["ref"] = tables["notes"].where(F.col("id") != note_id), tables["ref"].where(F.col("note_id") != note_id)
    out["nodes"] = tables["nodes"].where(F.col("id") != note_id).join(gone, "id", "left_anti")
    if "rel" in tables:
        r = tables["rel"]
        out["rel"] = r.join(gone, r["src"] == gone["id"], "left_anti").join(gone, r["dst"] == gone["id"], "left_anti")
    for name in ("member", "core", "contexts", "text"):
        if name in tables:
            out[name] = delete(tables[name], gone.select(F.col("id").alias("node_id")), "node_id")
    return out


def clear_communities(nodes: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relationship sentences, old community ids) without communities."""
    return nodes.where("kind <> 'community'"), sentences.where("not coalesce(is_community_rel, false)"), nodes.where("kind = 'community'").select("id")


def accumulate(stored: DataFrame, new: DataFrame) -> DataFrame:
    """contexts(node_id, content, seq) with the new ones that their node doesn't have yet, by trimmed text; first seen first."""
    fresh = new.withColumn("content", F.trim("content")).where("content <> ''").groupBy("node_id", "content").agg(F.min("seq").alias("seq"))
    return stored.unionByName(fresh.join(stored.select("node_id", F.trim("content").alias("content")).distinct(), ["node_id", "content"], "left_anti").select("node_id", "content", "seq"))


def merged_contexts(contexts: DataFrame) -> DataFrame:
    """node_id, n, merged: the contexts of a node in order, joined by spaces."""
    lists = contexts.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c"))
    return lists.select("node_id", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: x["content"]), " ").alias("merged"))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return rows.withColumn(f"{value}_so_far", F.sum(value).over(Window.partitionBy(*keys).orderBy(*order)))


class Store:
    """Tables of one knowledge base below a folder; every commit is a new version that readers see whole or not at all.

    A version is a folder v<number>[-<tag>]; it counts once its _SUCCESS file is there, the last thing that a write leaves.
    """

    def __init__(self, spark: SparkSession, path: str, slug: str = "default"):
        self.spark, self.path, self.slug = spark, path.rstrip("/"), slug

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def versions(self, table: str) -> list[tuple[int, str]]:
        """(number, tag) of every whole version, oldest first."""
        fs, p = self._fs(f"{self.path}/{self.slug}/{table}")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.path}/{self.slug}/{table}/{n}/_SUCCESS")[1])]
        return sorted((int(n[1:].partition("-")[0]), n.partition("-")[2]) for n in done)

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def version(self, table: str) -> int:
        return max((n for n, _ in self.versions(table)), default=-1)

    def read(self, table: str, schema: str | StructType | None = None) -> DataFrame:
        """The last version. A table written in folders by value needs its schema where it may have no rows."""
        n, tag = self.versions(table)[-1]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{self.slug}/{table}/v{n}{'-' + tag if tag else ''}")

    def commit(self, table: str, rows: DataFrame, partition_by: Sequence[str] = (), tag: str = "") -> int:
        """Writes the next version. A lost executor costs its tasks; a lost driver leaves the version before."""
        n = self.version(table) + 1
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{self.slug}/{table}/v{n}{'-' + tag if tag else ''}")
        return n

    def commit_parts(self, table: str, rows: DataFrame, tag: str) -> int:
        """Replaces only the parts (column part) that rows hold. The next version lists the folder of every part; data that a repeated
        call writes again has the same name."""
        path = f"{self.path}/{self.slug}/{table}_parts/{tag}"
        rows.write.mode("overwrite").partitionBy("part").parquet(path)
        new = self.spark.read.parquet(path).select("part").distinct().select("part", F.lit(path).alias("path"))
        if self.exists(table):
            new = new.unionByName(self.read(table).join(new.select("part"), "part", "left_anti"))
        return self.commit(table, new.coalesce(1), tag=tag)

    def read_parts(self, table: str, schema: str, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of all or some parts, with their part."""
        listed = self.read(table).collect() if self.exists(table) else []  # a row for each part
        wanted = [r for r in listed if parts is None or r["part"] in set(parts)]
        if not wanted:
            return self.spark.createDataFrame([], f"{schema}, part int")
        folders: dict[str, list[int]] = {}
        for r in wanted:
            folders.setdefault(r["path"], []).append(r["part"])
        out = None
        for path, own in sorted(folders.items()):
            rows = self.spark.read.schema(f"{schema}, part int").parquet(path).where(F.col("part").isin(*own))
            out = rows if out is None else out.unionByName(rows)
        return out

    def drop(self) -> None:
        if self.slug == "default":
            raise ValueError("the default knowledge base stays")
        fs, p = self._fs(f"{self.path}/{self.slug}")
        fs.delete(p, True)
