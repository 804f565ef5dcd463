"""When communities are rebuilt: an idle trigger with state and a timer, and rebuilds of which only the newest may publish.

The trigger is one stateful stream, keyed by knowledge base. Its state holds how many notes are being ingested and the nodes that they
changed; a timer of processing time is set when the last one ends and unset by the next that begins, and when it fires the nodes go out
once and the state is emptied. The nodes are a list state of many nodes an entry, to which a batch adds its own with a few calls; nodes
that came in several batches are taken out when the list may hold each twice, and when the timer fires. `lanes` deals the nodes of one
base to several keys where one task can't hold them; begins and ends of a note then go to every lane.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.tables import Store

IDLE_MS = 120_000
ENTRY = 1000  # nodes of an entry of the list
ROOM = 100_000  # nodes that are added before a short list is looked through for repeated ones
FRAME = 10_000  # nodes that go out at once
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IdleTrigger(StatefulProcessor):
    """Events (kb, kind, node_id): begin and end of a note's ingestion, node for each entity that it changed."""

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "n long")
        self.epoch = handle.getValueState("epoch", "n long")
        self.pending = handle.getListState("pending", "nodes array<string>")
        self.held = handle.getValueState("held", "n long, distinct long")

    def _number(self, state) -> int:
        return int(state.get()[0]) if state.exists() else 0

    def _entries(self, nodes: list[str]) -> list[tuple]:
        return [(nodes[a : a + ENTRY],) for a in range(0, len(nodes), ENTRY)]

    def _nodes(self) -> list[str]:
        """Each held node once."""
        return list(dict.fromkeys(n for entry in self.pending.get() for n in entry[0])) if self.pending.exists() else []

    def _add(self, nodes: list[str]) -> None:
        n, distinct = self.held.get() if self.held.exists() else (0, 0)
        self.pending.appendList(self._entries(nodes))
        n += len(nodes)
        if n > 2 * distinct + ROOM:
            nodes = self._nodes()
            self.pending.put(self._entries(nodes))
            n = distinct = len(nodes)
        self.held.update((n, distinct))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        active = self._number(self.active)
        new: dict[str, None] = {}
        for f in rows:
            active += int((f["kind"] == "begin").sum()) - int((f["kind"] == "end").sum())
            new.update(dict.fromkeys(f.loc[f["kind"] == "node", "node_id"].dropna().unique().tolist()))
        if new:
            self._add(list(new))
        active = max(0, active)  # an end without a begin counts for nothing
        self.active.update((active,))
        for timer in list(self.handle.listTimers()):  # each batch of events puts the rebuild off
            self.handle.deleteTimer(timer)
        if active == 0 and self.pending.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        epoch = self._number(self.epoch) + 1
        nodes = self._nodes()
        self.pending.clear()
        self.held.clear()
        self.epoch.update((epoch,))
        for a in range(0, len(nodes), FRAME):
            yield pd.DataFrame({"kb": key[0], "epoch": epoch, "node_id": nodes[a : a + FRAME]})

    def close(self) -> None:
        pass


def laned(events: DataFrame, lanes: int) -> DataFrame:
    """events with lane: a node's own lane, all lanes for begins and ends."""
    own = F.array(F.pmod(F.xxhash64("node_id"), F.lit(lanes)).cast("int"))
    return events.withColumn("lane", F.explode(F.when(F.col("kind") == "node", own).otherwise(F.sequence(F.lit(0), F.lit(lanes - 1)))))


def idle_trigger(events: DataFrame, idle_ms: int = IDLE_MS, lanes: int = 1) -> DataFrame:
    """kb, epoch, node_id: the nodes to rebuild of stream events(kb, kind, node_id), each once, idle_ms after the last ingestion ended.

    The session needs spark.sql.streaming.stateStore.providerClass = PROVIDER.
    """
    keyed = laned(events.select("kb", "kind", F.col("node_id").cast("string").alias("node_id")), lanes)
    return keyed.groupBy("kb", "lane").transformWithStateInPandas(IdleTrigger(idle_ms), "kb string, epoch long, node_id string", "update", "ProcessingTime")


def queue_rebuilds(triggered: DataFrame, store: Store, checkpoint: str, table: str = "pending", **trigger) -> StreamingQuery:
    """Writes the nodes of every fired trigger as a version of `table`; a batch that runs again is skipped."""

    def batch(rows: DataFrame, number: int) -> None:
        if not any(tag == f"b{number}" for _, tag in store.versions(table)) and not rows.isEmpty():
            store.commit(table, rows, tag=f"b{number}")

    return triggered.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def queued(store: Store, table: str = "pending") -> DataFrame:
    """kb, epoch, node_id of every trigger that has fired."""
    paths = [f"{store.path}/{store.slug}/{table}/v{n}-{tag}" for n, tag in store.versions(table)]
    schema = "kb string, epoch long, node_id string"
    return store.spark.read.schema(schema).parquet(*paths) if paths else store.spark.createDataFrame([], schema)


class Superseded(RuntimeError):
    """A newer request for the same knowledge base has come."""


class Rebuild:
    """One rebuild of one knowledge base. The newest request wins: it stops the jobs of those before it, and only it may publish.

    A request writes the next epoch to the store. An older run notices between its steps, or by its jobs being stopped, and puts its nodes
    back as pending. `publish` names the epoch in the version that it writes and readers take the highest epoch, so even a run that
    passes its last look too late can't hide a newer one's result.
    """

    def __init__(self, store: Store, nodes: DataFrame, name: str = "rebuild"):
        self.store, self.spark, self.name = store, store.spark, name
        self.nodes = nodes
        before = self.newest(store, name)
        self.epoch = before + 1
        self.tag = f"{name}-{store.slug}-{self.epoch}"
        store.commit(f"{name}_epochs", self.spark.createDataFrame([(self.epoch,)], "epoch long"), tag=f"e{self.epoch}-{uuid.uuid4().hex[:6]}")
        if before:
            self.spark.sparkContext.cancelJobsWithTag(f"{name}-{store.slug}-{before}")

    @staticmethod
    def newest(store: Store, name: str = "rebuild") -> int:
        return max((int(tag[1:].partition("-")[0]) for _, tag in store.versions(f"{name}_epochs")), default=0)

    def check(self) -> None:
        if self.newest(self.store, self.name) != self.epoch:
            raise Superseded(self.tag)

    def run(self, steps: list[Callable[[DataFrame | None], DataFrame]], table: str) -> bool:
        """Runs the steps, each on what the one before wrote, and publishes the last one's rows. False, with the nodes pending again, where a newer request came."""
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            rows = None
            for i, step in enumerate(steps):
                self.check()
                written = f"{self.name}_work/{self.epoch}/{i}"
                self.store.commit(written, step(rows))
                rows = self.store.read(written)
            self.check()
            self.store.commit(table, rows, tag=f"e{self.epoch}")
            return True
        except Exception:
            if self.newest(self.store, self.name) == self.epoch:
                raise  # a fault of its own
            sc.removeJobTag(self.tag)
            self.store.commit("pending_again", self.nodes.select("node_id").distinct().withColumn("epoch", F.lit(self.epoch).cast("long")), tag=f"e{self.epoch}")
            return False
        finally:
            sc.removeJobTag(self.tag)


def published(store: Store, table: str) -> DataFrame:
    """The rows of the highest epoch that was published."""
    n, tag = max(((n, t) for n, t in store.versions(table)), key=lambda v: (int(v[1][1:]), v[0]))
    return store.spark.read.parquet(f"{store.path}/{store.slug}/{table}/v{n}-{tag}")


def to_rebuild(store: Store, spark: SparkSession, after: int = 0) -> DataFrame:
    """node_id of what superseded runs gave back, for the next request to take along; after is the last epoch whose nodes were taken along before."""
    out = None
    for n, tag in store.versions("pending_again"):
        if int(tag[1:]) <= after:
            continue
        rows = spark.read.parquet(f"{store.path}/{store.slug}/pending_again/v{n}-{tag}").select("node_id")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "node_id string") if out is None else out.distinct()
