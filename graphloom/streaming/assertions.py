"""Streams: relationship assertions folded as they come, idle sessions that ask for a rebuild, and note states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fold, tables

IDLE = "120 seconds"


def idle_sessions(events: DataFrame, key: str = "user_id", gap: str = IDLE, late: str | None = None) -> DataFrame:
    """key, start, end, n of runs of events without a gap of that length; in a stream a session closes when the watermark passes its end."""
    e = events if late is None else events.withWatermark("ts", late)
    s = e.groupBy(F.col(key), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


PARTS = 64  # of the stored edges, by pair of entities


def fold_stream(assertions: DataFrame, store: tables.Store, checkpoint: str, table: str = "rel", parts: int = PARTS, once: bool = False, **trigger) -> StreamingQuery:
    """Folds each micro-batch into the stored edges, of which it reads and rewrites only the parts that its pairs belong to.

    A batch that runs again is skipped: its number is part of the version that it made. A note that comes again reinforces its edges
    again, unless `once` is set: then a ledger tells which note told what (`told_once`).
    """
    part = F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(parts)).cast("int")

    def batch(rows: DataFrame, number: int) -> None:
        if any(tag == f"b{number}" for _, tag in store.versions(table)):
            return
        rows = rows.where("src is not null and dst is not null")
        if once:
            rows = told_once(rows, store, table, number, parts)
        touched = [r[0] for r in rows.select(part).distinct().collect()]  # at most parts numbers
        if touched:
            old = store.read_parts(table, fold.EDGE, touched).drop("part")
            store.commit_parts(table, fold.fold_edges(rows, old).withColumn("part", part), tag=f"b{number}")

    return assertions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def told_once(rows: DataFrame, store: tables.Store, table: str, number: int, parts: int = PARTS) -> DataFrame:
    """Assertions of a batch that no batch before brought, after they were put into the ledger <table>_ledger.

    The ledger gets a batch's lines before its edges are written. What a batch that fails in between has put there bears its number, and
    the same batch, run again, doesn't take it for told; lines that it writes twice say the same. Only the parts of the batch's notes are read.
    """
    spark, path = rows.sparkSession, f"{store.path}/{store.slug}/{table}_ledger"
    place = F.pmod(F.xxhash64("note_id"), F.lit(parts)).cast("int")
    touched = [r[0] for r in rows.where("note_id is not null").select(place).distinct().collect()]  # at most parts numbers
    fs, folder = store._fs(path)
    ledger = None
    if fs.exists(folder):
        ledger = spark.read.schema(f"{fold.LEDGER}, part int").parquet(path).where(F.col("part").isin(touched) & (F.col("batch") != number))
    fresh = fold.first_told(rows, ledger)
    lines = fresh.where("note_id is not null").select(*fold.TOLD, F.lit(number).cast("long").alias("batch"), place.alias("part"))
    lines.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    return fresh


def folded(store: tables.Store, table: str = "rel") -> DataFrame:
    """The edges that a stream has folded so far."""
    return store.read_parts(table, fold.EDGE).drop("part")


def latest_status(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """id with the status of its last change(id, ts, status)."""
    return changes.withWatermark("ts", late).groupBy("id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


def recompute_queue(changes: DataFrame, gap: str = IDLE, late: str = "1 minute") -> DataFrame:
    """node_id, start, end, n: a node's changes without an idle time between them, to be rebuilt at its end. Nodes are keys, so no list of all is held."""
    s = changes.withWatermark("ts", late).groupBy("node_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("node_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
