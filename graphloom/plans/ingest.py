"""From notes to the graph: extraction, clean-up, entity resolution, relationship fold, contexts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extraction as X
from ..functions import scores as S
from ..functions import text as T
from ..models import ModelHub, Offline
from ..operators import fold, graph, tables

NOTES = 50  # notes whose extractions a worker holds at a time; a frame of Spark's has up to 10,000


def read_notes(frames: Iterator[pd.DataFrame], models: ModelHub, attempts: int = 3) -> Iterator[pd.DataFrame]:
    """What `extract` gives for frames of notes, in frames of at most NOTES notes."""
    for f in (whole.iloc[a : a + NOTES] for whole in frames for a in range(0, len(whole), NOTES)):
        rows = []
        for content in f["content"]:
            for _ in range(attempts):
                got = X.coerce(models.extract(content or ""))
                if got["nodes"] or not content:
                    break
            rows.append(got)
        yield f.assign(nodes=[r["nodes"] for r in rows], relationships=[r["relationships"] for r in rows], title=[r["title"] for r in rows], failed=[bool(c) and not r["nodes"] for r, c in zip(rows, f["content"], strict=True)])


def extract(notes: DataFrame, models: ModelHub | None = None, attempts: int = 3) -> DataFrame:
    """id, content, ts, nodes, relationships, title of notes(id, content, ts); a note whose answer can't be read after some attempts has empty lists and failed."""
    models = models or Offline()
    fields = X.SCHEMA.replace("sentiment string, ", "")
    return notes.select("id", "content", "ts").mapInPandas(lambda frames: read_notes(frames, models, attempts), f"id string, content string, ts timestamp, {fields}, failed boolean")


def entity_rows(extracted: DataFrame) -> DataFrame:
    """note_id, seq, name, type, context of every usable entity; placeholders without context go, an empty context is the whole note."""
    rows = extracted.select(F.col("id").alias("note_id"), "content", F.posexplode("nodes").alias("seq", "n"))
    name = T.entity_key(F.col("n.name"))
    context = F.coalesce(F.nullif(F.trim("n.isolated_context"), F.lit("")), F.col("content"))
    good = ~name.isin(*T.PLACEHOLDERS)
    return rows.where(good).select("note_id", "seq", name.alias("name"), T.or_default(F.col("n.type"), "thing").alias("type"), context.alias("context"))


def resolve(entities: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """name, id, type, is_new: one node per name. A stored node keeps id and type; else the id is made of the name and the first type counts."""
    first = tables.first_of_each(entities.select("name", "note_id", "seq", "type"), ["name"], ["note_id", "seq"]).select("name", "type")
    if stored is None:
        return first.select("name", T.node_id(F.col("name")).alias("id"), "type", F.lit(True).alias("is_new"))
    known = stored.groupBy(F.lower("name").alias("name")).agg(F.min(F.struct("id", "type")).alias("s"))
    out = first.join(known, "name", "left")
    return out.select("name", F.coalesce("s.id", T.node_id(F.col("name"))).alias("id"), F.coalesce("s.type", "type").alias("type"), F.col("s").isNull().alias("is_new"))


def relationship_rows(extracted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Assertions event_id, ts, src, dst, rel_type, scores, note_id, natural_language and skip."""
    rows = extracted.select(F.col("id").alias("note_id"), "ts", F.posexplode("relationships").alias("seq", "r")).select("note_id", "ts", "seq", "r.*")
    ended = graph.resolve_endpoints(rows, resolved.select("name", "id").limit(0), resolved.select("name", "id"))
    kind = T.sanitise_type(T.clean_predicate(T.or_default(F.col("relationship_type"), "relates_to"), F.col("source_name"), F.col("target_name")))
    said = F.coalesce(F.nullif(F.trim("natural_language"), F.lit("")), T.spoken(kind))
    out = ended.select("note_id", "ts", "seq", "src", "dst", kind.alias("rel_type"), "confidence", "strength", "relevance", S.edge_weight(F.col("strength"), F.col("confidence"), F.col("relevance")).alias("edge_weight"), said.alias("natural_language"), "skip")
    ident = F.xxhash64("note_id", "seq")
    return out.withColumn("event_id", ident).withColumn("relationship_id", F.concat(F.lit("rel_"), F.hex(ident)))


def ingest(notes: DataFrame, stored: dict[str, DataFrame] | None = None, models: ModelHub | None = None) -> dict[str, DataFrame]:
    """The tables after some notes(id, content, ts): nodes, ref, rel, contexts, sentences, skipped; stored has those before.

    A note that comes again adds no contexts and reinforces its edges again. Where stored has a ledger (`fold.TOLD`, or None for a new
    one), what a note told before counts no more, and the ledger after these notes is among the tables.
    """
    stored = stored or {}
    extracted = extract(notes, models).checkpoint()  # models run once
    entities = entity_rows(extracted)
    nodes = resolve(entities, stored.get("nodes"))
    ref = entities.join(nodes, "name").select("note_id", F.col("id").alias("node_id")).distinct()
    rels = relationship_rows(extracted, nodes)
    good = rels.where("skip is null").select("event_id", "ts", "src", "dst", "rel_type", "confidence", "strength", "relevance", "edge_weight", "relationship_id", "note_id")
    told = {}
    if "ledger" in stored:
        good = fold.first_told(good, stored["ledger"])
        keys = good.select(*fold.TOLD)
        told = {"ledger": keys if stored["ledger"] is None else stored["ledger"].select(*fold.TOLD).unionByName(keys)}
    edges = fold.fold_edges(good, stored.get("rel"))
    actions = fold.fold_actions(good)
    spoken = rels.join(actions.where("action in ('created', 'evolved')").select("event_id"), "event_id", "left_semi").select("relationship_id", "src", "dst", "natural_language")
    contexts = entities.join(nodes.select("name", "id"), "name").select(F.col("id").alias("node_id"), F.col("context").alias("content"), "seq")
    spark = notes.sparkSession
    before = stored.get("contexts", spark.createDataFrame([], "node_id string, content string, seq int"))
    old = stored.get("nodes")
    return {
        "nodes": nodes.select("id", F.lit("indexable").alias("kind"), "name", "type") if old is None else tables.insert_absent(old, nodes.select("id", F.lit("indexable").alias("kind"), "name", "type"), ["id"]),
        "ref": ref if "ref" not in stored else tables.insert_absent(stored["ref"], ref, ["note_id", "node_id"]),
        "rel": edges,
        "contexts": tables.accumulate(before, contexts),
        "sentences": spoken if "sentences" not in stored else tables.upsert(stored["sentences"], spoken, ["relationship_id"]),
        "skipped": rels.where("skip is not null").groupBy("skip").agg(F.count("*").alias("n")),
        "failed": extracted.where("failed").select("id"),
        **told,
    }
