"""The idle trigger over a restart, and rebuilds of which the newest wins."""

import threading
import time

import pytest

from graphloom.operators import tables
from graphloom.streaming import rebuilds


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, rebuilds.PROVIDER)
    yield
    spark.conf.set(key, before)


def test_idle_trigger_gives_each_node_once_over_a_restart(spark, tmp_path, rocks):
    schema, n = "kb string, kind string, node_id string", iter(range(100))
    store = tables.Store(spark, str(tmp_path / "kb"))

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream(seconds):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = rebuilds.queue_rebuilds(rebuilds.idle_trigger(source, 2000, lanes=2), store, str(tmp_path / "cp"), processingTime="1 second")
        time.sleep(seconds)
        q.stop()
        if q.exception():
            raise q.exception()

    def out():
        found = []
        for v, tag in store.versions("pending"):
            found += [(r["kb"], r["node_id"]) for r in spark.read.parquet(f"{tmp_path}/kb/default/pending/v{v}-{tag}").collect()]
        return sorted(found)

    next(n)
    feed(("a", "begin", None), ("a", "node", "x"), ("a", "node", "y"), ("b", "begin", None), ("b", "node", "x"), ("b", "end", None))
    stream(14)
    assert out() == [("b", "x")]  # a is still being ingested
    feed(("a", "node", "x"), ("a", "node", "z"), ("a", "end", None))
    stream(14)
    assert out() == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]


def test_only_the_newest_rebuild_is_published(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    nodes = spark.createDataFrame([("x",), ("y",)], "node_id string")
    started, done = threading.Event(), {}

    def slow(_):
        started.set()

        def wait(frames):
            for f in frames:
                time.sleep(60)
                yield f

        return nodes.mapInPandas(wait, "node_id string")

    first = rebuilds.Rebuild(store, nodes)
    t = threading.Thread(target=lambda: done.update(first=first.run([slow], "communities")))
    t.start()
    started.wait(20)
    time.sleep(4)
    began = time.time()
    second = rebuilds.Rebuild(store, nodes)
    assert second.run([lambda _: nodes.selectExpr("node_id", "'new' as made"), lambda rows: rows.where("node_id = 'x'")], "communities")
    t.join(45)
    assert done == {"first": False} and time.time() - began < 45
    assert [tuple(r) for r in rebuilds.published(store, "communities").collect()] == [("x", "new")]
    assert sorted(r["node_id"] for r in rebuilds.to_rebuild(store, spark).collect()) == ["x", "y"]
    assert rebuilds.to_rebuild(store, spark, after=1).count() == 0


def test_a_fault_of_its_own_is_raised(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    with pytest.raises(ZeroDivisionError):
        rebuilds.Rebuild(store, spark.createDataFrame([("x",)], "node_id string")).run([lambda _: 1 / 0], "t")
    assert rebuilds.to_rebuild(store, spark).count() == 0
