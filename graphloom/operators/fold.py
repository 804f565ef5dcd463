"""The relationship upsert as an ordered fold over the assertions of one pair of entities.

Edges carry when they began and ended, what they came from and turned into. All that an assertion reads or writes belongs to its two
entities, so the fold goes by unordered pair; the same function serves batches and streams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import BIDIRECTIONAL, CONTRADICT, EVOLVE

EDGE = (
    "src string, dst string, rel_type string, confidence double, strength double, relevance double, edge_weight double, mention_count long, relationship_id string, "
    "ingested_at timestamp_ntz, last_updated timestamp_ntz, valid_to timestamp_ntz, note_id string, evolved_from string, evolved_to string, invalidated_by string, invalidation_note_id string, evolution_note_id string"
)
COLUMNS = [c.strip().split()[0] for c in EDGE.split(",")]
ACTIONS = "event_id long, src string, dst string, rel_type string, action string, inverse boolean, invalidated int"


def _edge(src, dst, kind, a, **more) -> dict:
    edge = dict.fromkeys(COLUMNS)
    return edge | {"src": src, "dst": dst, "rel_type": kind, "confidence": a["confidence"], "mention_count": 1, "ingested_at": a["ts"], "last_updated": a["ts"], "note_id": a.get("note_id")} | more


def apply(edges: dict[tuple[str, str, str], dict], a: dict) -> dict:
    """Applies one assertion to the edges {(src, dst, type): edge}; tells what was done."""
    s, t, kind, now = a["src"], a["dst"], a["rel_type"], a["ts"]
    out = {"event_id": a.get("event_id"), "src": s, "dst": t, "rel_type": kind, "inverse": False, "invalidated": 0}
    if s is None or t is None or not kind:
        return out | {"action": "failed"}
    for old in CONTRADICT.get(kind, ()):
        if e := edges.get((s, t, old)):
            out["invalidated"] += e["valid_to"] is None
            e.update(valid_to=now, invalidated_by=kind, invalidation_note_id=a.get("note_id"))
    facts = {k: a.get(k) for k in ("strength", "relevance", "edge_weight", "relationship_id")}
    if e := edges.get((s, t, kind)):
        e.update(last_updated=now, mention_count=e["mention_count"] + 1, confidence=max(e["confidence"] or 0, a["confidence"] or 0))
        e.update({k: v for k, v in facts.items() if e[k] is None})
        action = "reinforced"
    else:
        others = [e for (x, y, _), e in edges.items() if (x, y) == (s, t)]
        if others:
            current = min(others, key=lambda e: (e["ingested_at"], e["rel_type"]))
            later = EVOLVE.get(current["rel_type"])
            if later is not None and kind not in later:
                return out | {"action": "rejected"}
            if later is None:
                action, edges[s, t, kind] = "created_parallel", _edge(s, t, kind, a, **facts)
            else:
                current.update(valid_to=now, evolved_to=kind, evolution_note_id=a.get("note_id"))
                action, edges[s, t, kind] = "evolved", _edge(s, t, kind, a, evolved_from=current["rel_type"], **facts)
        else:
            action, edges[s, t, kind] = "created", _edge(s, t, kind, a, **facts)
    if kind in BIDIRECTIONAL:
        out["inverse"] = True
        if e := edges.get((t, s, kind)):
            e.update(last_updated=now, mention_count=e["mention_count"] + 1, note_id=a.get("note_id"))
        else:
            edges[t, s, kind] = _edge(t, s, kind, a)
    return out | {"action": action}


def fold(assertions: Iterable[dict], edges: dict | None = None) -> tuple[dict, list[dict]]:
    edges = {} if edges is None else edges
    return edges, [apply(edges, a) for a in assertions]


ALWAYS = ("_a", "_b", "_new", "src", "dst", "rel_type", "ts", "confidence")  # what every row has, null or not


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows without the columns that hold nothing in this batch, as most of an edge's do for assertions. Columns become lists as wholes."""
    held = [(name, c) for name, c in zip(batch.schema.names, batch.columns, strict=True) if name in ALWAYS or c.null_count < len(c)]
    names = [name for name, _ in held]
    for values in zip(*(c.to_pylist() for _, c in held), strict=True):
        yield dict(zip(names, values, strict=True))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a pair of entities next to each other, stored edges first, then assertions in time."""
    spark = rows.sparkSession
    keyed = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_a", "_b").sortWithinPartitions("_a", "_b", "_new", "ts", "event_id")


def _folded(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[dict]:
    """Edges or actions of all pairs of a partition; only one pair's edges are held at a time."""
    pair, edges = None, {}
    for batch in batches:
        for row in _rows(batch):
            if (row["_a"], row["_b"]) != pair:
                if out == "edges":
                    yield from edges.values()
                pair, edges = (row["_a"], row["_b"]), {}
            if row["_new"]:
                done = apply(edges, row)
                if out == "actions":
                    yield done
            else:
                edges[row["src"], row["dst"], row["rel_type"]] = {c: row.get(c) for c in COLUMNS}
    if out == "edges":
        yield from edges.values()


def _run(rows: DataFrame, out: str, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        held = []
        for x in _folded(batches, out):
            held.append(x)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_pylist(held, schema=target)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    return _ordered(rows).mapInArrow(run, schema)


def fold_edges(assertions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The edges after all assertions(event_id, ts, src, dst, rel_type, confidence[, note_id, ...]), beginning from the stored ones.

    A pair's assertions must come in order, so a task takes them one after another from its sorted partition; it never holds more than
    the edges of one pair.
    """
    rows = assertions.withColumn("_new", F.lit(True))
    if stored is not None:
        rows = rows.unionByName(stored.select(*COLUMNS).withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return _run(rows, "edges", EDGE)


def fold_actions(assertions: DataFrame) -> DataFrame:
    """What the fold did with each assertion: event_id, action, inverse, invalidated."""
    return _run(assertions.withColumn("_new", F.lit(True)), "actions", ACTIONS)


TOLD = ["note_id", "src", "dst", "rel_type"]  # what a ledger knows an assertion by
LEDGER = ", ".join(f"{c} string" for c in TOLD) + ", batch long"


def first_told(assertions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Assertions whose note didn't tell the same before: not in the ledger, and the first (ts, event_id) of several that come now.

    Those without a note can't be known again, so each of them counts.
    """
    known = F.col("note_id").isNotNull()
    same = lambda c: F.coalesce(c, F.lit("")).alias(c) if c != "note_id" else F.col(c)
    named, rest = assertions.where(known), [c for c in assertions.columns if c not in TOLD]
    if ledger is not None:
        keys = ledger.select(*(same(c).alias(f"_{c}") for c in TOLD)).distinct()
        match = [(F.coalesce(F.col(c), F.lit("")) if c != "note_id" else F.col(c)) == F.col(f"_{c}") for c in TOLD]
        named = named.join(keys, match, "left_anti")
    once = named.groupBy(*TOLD).agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_r")).select(*TOLD, *(F.col(f"_r.{c}").alias(c) for c in rest))
    return once.select(*assertions.columns).unionByName(assertions.where(~known))


def contradictions(assertions: DataFrame) -> DataFrame:
    """event_id, old_event: earlier assertions of a pair that a later one contradicts."""
    from ..functions import rules

    a = assertions.select("event_id", "ts", "src", "dst", F.explode(rules.contradicting(F.col("rel_type"))).alias("rel_type"))
    b = assertions.select(F.col("event_id").alias("old_event"), F.col("ts").alias("old_ts"), "src", "dst", "rel_type")
    return a.join(b, ["src", "dst", "rel_type"]).where("old_ts < ts").select("event_id", "old_event")
