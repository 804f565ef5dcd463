"""Reads of the property graph: name matching, expansion, paths, evidence, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIX = r".* (sr\.?|jr\.?|senior|junior|i|ii|iii|iv|v|vi)$"
WIDTH = 2048  # rows of a key that one task joins with as many of the other side


def by_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("name").isNotNull())


def all_edges(rel: DataFrame, ref: DataFrame) -> DataFrame:
    """Both kinds of edges: src, dst, rel_type, confidence (null for references)."""
    r = ref.select(F.col("note_id").alias("src"), F.col("node_id").alias("dst"), F.lit("REFERENCES").alias("rel_type"), F.lit(None).cast("double").alias("confidence"))
    return rel.select("src", "dst", "rel_type", "confidence").unionByName(r)


def match_fuzzy(nodes: DataFrame, names: Sequence[str], limit: int = 50) -> DataFrame:
    """Nodes whose name holds one of the names: id, name, type, matched. The names are a parameter, so the scan needs no join."""
    queries = F.array(*(F.lit(n.lower().strip()) for n in names)) if names else F.array().cast("array<string>")
    hit = F.explode(F.filter(F.array_distinct(queries), lambda q: F.contains(F.lower("name"), q)))
    return by_kind(nodes, "indexable", "note").select("id", "name", "type", hit.alias("matched")).distinct().orderBy("matched", F.length("name"), "name", "id").limit(limit)


def match_exact(nodes: DataFrame, names: Sequence[str], limit: int = 50) -> DataFrame:
    return by_kind(nodes, "indexable", "note").where(F.lower("name").isin(*(n.lower().strip() for n in names))).select("id", "name", "type").distinct().orderBy("name", "id").limit(limit)


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """name, id: the smallest id of every name."""
    return by_kind(nodes, "indexable").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))


def names_to_ids(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(name) with id, null where unknown."""
    return names.join(canonical_ids(nodes), "name", "left")


def is_variant(name: Column, base: Column) -> Column:
    """Whether a lower-cased name goes on after the base, or holds it and is longer by three; generations aren't mixed."""
    same = F.startswith(name, F.concat(base, F.lit(" "))) | (F.contains(name, base) & (F.length(name) > F.length(base) + 2))
    mixed = (F.contains(name, F.lit(" sr")) & F.contains(base, F.lit(" jr"))) | (F.contains(name, F.lit(" jr")) & F.contains(base, F.lit(" sr"))) | (name.rlike(SUFFIX) != base.rlike(SUFFIX))
    return same & ~mixed


def variants(nodes: DataFrame, base: str, limit: int = 5) -> DataFrame:
    """Other forms of a name: what goes on after it, or holds it and is longer; generations aren't mixed."""
    base = base.lower().strip()
    return by_kind(nodes, "indexable", "note").where(is_variant(F.lower("name"), F.lit(base))).select("id", "name", "type").distinct().orderBy(F.length("name"), "name", "id").limit(limit)


def variants_each(bases: DataFrame, nodes: DataFrame, per: int = 5) -> DataFrame:
    """base, id, name, type: other forms of many names(base) at once, as `variants` has them, among names that hold the base's first word."""
    b = bases.select(F.lower(F.trim("base")).alias("base")).where("base <> ''").distinct()
    n = by_kind(nodes, "indexable", "note").select("id", "name", "type").distinct()
    words = n.select("*", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("w"))
    met = b.withColumn("w", F.split("base", " ")[0]).join(words, "w").drop("w")
    order = Window.partitionBy("base").orderBy(F.length("name"), "name", "id")
    return met.where(is_variant(F.lower("name"), F.col("base"))).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per).drop("_r")


def memberships(member: DataFrame) -> DataFrame:
    """node_id, communities: those of every node, the highest level first."""
    per = member.groupBy("node_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("level")).alias("l"), "community_id"))).alias("m"))
    return per.select("node_id", F.transform("m", lambda x: x["community_id"]).alias("communities"))


def _valid(edges: DataFrame, as_of: str | None) -> DataFrame:
    """Edges valid at a time, where a time is given; else all, ended ones too."""
    return edges if as_of is None else edges.where((F.col("valid_to").isNull()) | (F.col("valid_to") > F.lit(as_of).cast("timestamp")))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by the keys to all shuffle partitions, which are not joined to fewer."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def different(rows: DataFrame, *keys: str) -> DataFrame:
    """rows without repeats. They are dealt by the keys to all shuffle partitions before equal ones are sought, so a task holds its share
    of them, however many the task before it made and however many partitions would be joined to one."""
    return dealt(rows, *keys).distinct()


def ends(edges: DataFrame, least: float = 0.0, as_of: str | None = None) -> DataFrame:
    """Edges as each of their ends has them: seed, node_id, direction, rel_type, confidence (1.0 where missing). They are read once for both directions."""
    e = _valid(edges, as_of).withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).where(F.col("confidence") >= least)
    way = lambda seed, other, name: F.struct(F.col(seed).alias("seed"), F.col(other).alias("node_id"), F.lit(name).alias("direction"))
    return e.select(F.explode(F.array(way("src", "dst", "outgoing"), way("dst", "src", "incoming"))).alias("w"), "rel_type", "confidence").select("w.*", "rel_type", "confidence")


def one_hop(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, least: float = 0.0, as_of: str | None = None) -> DataFrame:
    """Neighbours of seeds(id): seed, node_id, name, type, rel_type, confidence, direction; an incoming neighbour counts only where it isn't an outgoing one."""
    s = seeds.select(F.col("id").alias("seed")).where("seed is not null").distinct()
    # Edges are dealt once, by neighbours; the seeds go first: only their edges are made different.
    met = different(ends(edges, least, as_of).join(s, "seed", "left_semi"), "seed", "node_id")
    found = met.withColumn("_last", F.max("direction").over(Window.partitionBy("seed", "node_id"))).where("direction = _last").drop("_last")
    return found.join(nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("node_id"), "name", "type"), "node_id").select("seed", "node_id", "name", "type", "rel_type", "confidence", "direction")


def _both_ways(edges: DataFrame, least: float | None, missing: float) -> DataFrame:
    """Different edges in both directions, without loops and those under the bar."""
    e = edges.select("src", "dst", "rel_type", F.coalesce("confidence", F.lit(missing)).alias("confidence"))
    if least is not None:
        e = e.where(F.col("confidence") >= least)
    return different(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "confidence")).where("src <> dst"), "src", "dst")


def _standing(seeds: DataFrame) -> DataFrame:
    """Walks of no edges, one for each of seeds(id)."""
    return seeds.select(F.col("id").alias("seed"), F.col("id").alias("node_id"), F.array("id").alias("path"), F.array().cast("array<string>").alias("rel_path"), F.array().cast("array<double>").alias("confidence_path")).distinct()


def _extended(step: DataFrame) -> DataFrame:
    """Walks with one more edge, of walks joined with the edges of their last node; no node comes twice."""
    step = step.where(~F.array_contains("path", F.col("dst")))
    return step.select("seed", F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"), F.concat("rel_path", F.array("rel_type")).alias("rel_path"), F.concat("confidence_path", F.array("confidence")).alias("confidence_path"))


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int, least: float | None = None, missing: float = 0.0, limit: int | None = None) -> DataFrame:
    """Simple undirected paths of 1 to hops edges from seeds(id): seed, node_id, depth, path, rel_path, confidence_path.

    A hop is one join; edges under the bar go before it, as a path with one such edge is dropped as a whole.
    """
    both = _both_ways(edges, least, missing)
    front, found = _standing(seeds), None
    for depth in range(1, hops + 1):
        front = _extended(front.join(both, front["node_id"] == both["src"]))
        here = front.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
    found = found.select("seed", "node_id", "depth", "path", "rel_path", "confidence_path")
    return found if limit is None else found.orderBy("depth", "seed", "path", "rel_path", "confidence_path").limit(limit)


def hub_join(left: DataFrame, right: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """The inner join by key, where a key of n and m rows is dealt into blocks of about width by width rows (WIDTH).

    Rows go to blocks by a hash of all their columns, so a task that runs again deals them alike. Keys of up to width rows a side stay whole;
    the others' rows are copied n * m / width times, against n * m rows that come out.
    """
    width = width or WIDTH
    sizes = left.groupBy(key).agg(F.count("*").alias("_n"), F.lit(0).cast("long").alias("_m")).unionByName(right.groupBy(key).agg(F.lit(0).cast("long").alias("_n"), F.count("*").alias("_m")))
    hubs = sizes.groupBy(key).agg(F.sum("_n").alias("_n"), F.sum("_m").alias("_m")).where(f"_n > 0 and _m > 0 and (_n > {width} or _m > {width})")
    hubs = hubs.select(key, F.ceil(F.col("_n") / width).cast("int").alias("_ns"), F.ceil(F.col("_m") / width).cast("int").alias("_ms"))

    def dealt(rows: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        out = rows.join(hubs, key, "left").withColumn(own, F.pmod(F.xxhash64(*rows.columns), F.coalesce(parts, F.lit(1))).cast("int"))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1))).drop("_ns", "_ms")

    return dealt(left, "_i", "_ns", "_j", "_ms").join(dealt(right, "_j", "_ms", "_i", "_ns"), [key, "_i", "_j"]).drop("_i", "_j")


def half_walks(ids: DataFrame, edges: DataFrame, hops: int, least: float, missing: float = 0.8) -> DataFrame:
    """Simple walks of up to half the hops (rounded up) from ids(id): seed, node_id, n edges, path, rel_path, confidence_path.

    The walks of each hop are written (`checkpoint`), as the next hop, the sizes of hubs and both sides of the meeting read them.
    """
    both = _both_ways(edges, least, missing).withColumnRenamed("src", "node_id")
    front = _standing(ids.where("id is not null")).checkpoint()
    found = front.withColumn("n", F.lit(0))
    for n in range(1, (hops + 1) // 2 + 1):
        front = _extended(hub_join(front, both, "node_id")).checkpoint()
        found = found.unionByName(front.withColumn("n", F.lit(n)))
    return found


def paths_between(ids: DataFrame, edges: DataFrame, hops: int = 3, least: float = 0.5, limit: int | None = 20) -> DataFrame:
    """Simple paths between any two of ids(id), the smaller end first, shortest first. A missing confidence counts 0.8.

    Walks of half the length from both ends meet in the middle: a path of L edges is one walk of ceil(L / 2) from its smaller end and one
    of floor(L / 2) from its larger end, so no walk goes further than half the hops. Hubs are dealt to several tasks (`hub_join`).
    """
    walks = half_walks(ids, edges, hops, least)
    ends = walks.select(F.col("seed").alias("_end"), "node_id", F.col("n").alias("_n"), F.col("path").alias("_path"), F.col("rel_path").alias("_rels"), F.col("confidence_path").alias("_confs"))
    met = hub_join(walks.where("n > 0"), ends, "node_id").where((F.col("seed") < F.col("_end")) & (F.col("n") - F.col("_n")).isin(0, 1) & (F.col("n") + F.col("_n") <= hops))
    met = met.where(F.size(F.array_intersect("path", "_path")) == 1)  # the middle alone is on both
    back = lambda c: F.reverse(F.col(c))
    path = F.concat("path", F.slice(back("_path"), 2, F.col("_n")))
    out = met.select(F.col("seed").alias("src"), F.col("_end").alias("dst"), (F.col("n") + F.col("_n")).alias("length"), path.alias("path"), F.concat("rel_path", back("_rels")).alias("rel_path"), F.concat("confidence_path", back("_confs")).alias("confidence_path"))
    return out if limit is None else out.orderBy("length", "path", "rel_path", "confidence_path").limit(limit)


def all_hops_at_least(path: Column, least: float) -> Column:
    return F.forall(path, lambda c: c >= least)


def evidence(ref: DataFrame, notes: DataFrame, per_node: int = 2) -> DataFrame:
    """node_id, note_id, title, n of the first notes of every node (by note_id). Ranks are per node; a node of any degree keeps only per_node rows a task before the shuffle's sort."""
    rows = ref.select("note_id", "node_id").distinct().join(notes.select(F.col("id").alias("note_id"), "title"), "note_id", "left")
    order = Window.partitionBy("node_id").orderBy("note_id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_node).select("node_id", "note_id", F.coalesce("title", F.lit("Untitled Note")).alias("title"), "n")


def contents(nodes: DataFrame, core: DataFrame, contexts: DataFrame) -> DataFrame:
    """nodes(id) with description and the list of contexts in order; null where there is none."""
    lists = contexts.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("c")).select("node_id", F.transform("c", lambda x: x["content"]).alias("isolated_contexts"))
    return nodes.join(core.select(F.col("node_id").alias("id"), "description"), "id", "left").join(lists.withColumnRenamed("node_id", "id"), "id", "left")


def relation_sentences(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """pairs(src, dst) with the sentence of that pair, else of the turned pair (reverse = true); of several the last by relationship_id."""
    one = sentences.groupBy("src", "dst").agg(F.max_by("natural_language", "relationship_id").alias("nl"))
    back = one.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("nl").alias("back"))
    out = pairs.join(one, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    return out.select(*pairs.columns, F.coalesce("nl", "back").alias("nl"), (F.col("nl").isNull() & F.col("back").isNotNull()).alias("reverse"))


def relations_of(ids: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that touch ids(id), each text once (the smallest relationship_id)."""
    k = ids.select("id").distinct()
    hit = sentences.join(k, sentences["src"] == k["id"], "left_semi").unionByName(sentences.join(k, sentences["dst"] == k["id"], "left_semi"))
    return hit.groupBy("natural_language").agg(F.min_by(F.struct("relationship_id", "src", "dst"), "relationship_id").alias("r")).select("r.relationship_id", "r.src", "r.dst", "natural_language")


def resolve_endpoints(rels: DataFrame, local: DataFrame, stored: DataFrame) -> DataFrame:
    """rels(source_name, target_name) with src, dst and skip: ids from the note's own names first, then from the store."""
    out = rels
    for end, name in (("src", "source_name"), ("dst", "target_name")):
        a = local.select(F.lower(F.trim("name")).alias(f"_{end}"), F.col("id").alias(f"_{end}_local"))
        b = stored.select(F.lower(F.trim("name")).alias(f"_{end}"), F.col("id").alias(f"_{end}_stored"))
        out = out.withColumn(f"_{end}", F.lower(F.trim(name))).join(a, f"_{end}", "left").join(b, f"_{end}", "left").withColumn(end, F.coalesce(f"_{end}_local", f"_{end}_stored"))
    blank = (F.coalesce(F.trim("source_name"), F.lit("")) == "") | (F.coalesce(F.trim("target_name"), F.lit("")) == "")
    return out.select(*rels.columns, "src", "dst", F.when(blank, "no_name").when(F.col("src").isNull(), "no_source").when(F.col("dst").isNull(), "no_target").alias("skip"))


def community_edges(edges: DataFrame, member: DataFrame, community: str, limit: int | None = 500) -> DataFrame:
    """Different edges inside one community."""
    m = member.where(F.col("community_id") == community).select("node_id").distinct()
    out = edges.join(m, edges["src"] == m["node_id"], "left_semi").join(m.withColumnRenamed("node_id", "other"), F.col("dst") == F.col("other"), "left_semi").select("src", "dst", "rel_type").distinct()
    return out if limit is None else out.orderBy("src", "dst", "rel_type").limit(limit)


def edges_within_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """community_id, edges: edges with both ends in the same community, counted for all communities at once."""
    a, b = member.select(F.col("node_id").alias("src"), F.col("community_id")).distinct(), member.select(F.col("node_id").alias("dst"), F.col("community_id").alias("other")).distinct()
    return edges.select("src", "dst", "rel_type").distinct().join(a, "src").join(b, "dst").where("community_id = other").groupBy("community_id").agg(F.count("*").alias("edges"))


def orphans(nodes: DataFrame, member: DataFrame) -> DataFrame:
    return by_kind(nodes, "indexable").join(member.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti").select("id", "name", "type")


def orphan_edges(edges: DataFrame, member: DataFrame, limit: int | None = 1000) -> DataFrame:
    m = member.select("node_id").distinct()
    out = edges.join(m, edges["src"] == m["node_id"], "left_anti").join(m, edges["dst"] == m["node_id"], "left_anti").select("src", "dst", "rel_type").distinct()
    return out if limit is None else out.orderBy("src", "dst", "rel_type").limit(limit)


def referenced_only_by(ref: DataFrame, note_id: str | None = None) -> DataFrame:
    """note_id, node_id of entities that a single note refers to."""
    one = ref.groupBy("node_id").agg(F.min("note_id").alias("note_id"), F.max("note_id").alias("last")).where("note_id = last").select("note_id", "node_id")
    return one if note_id is None else one.where(F.col("note_id") == note_id)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    k = nodes.where("id is not null").select("id").distinct()
    return edges.where("src is not null and dst is not null").join(k, edges["src"] == k["id"], "left_semi").join(k, edges["dst"] == k["id"], "left_semi")


def undirected_pairs(edges: DataFrame) -> DataFrame:
    return different(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "a", "b")


def layout_edges(edges: DataFrame, member: DataFrame, limit: int | None = None) -> DataFrame:
    """src, dst: each edge once, and each member with its community; all of them, unless a limit is given."""
    out = different(edges.select("src", "dst").union(member.select("node_id", "community_id")), "src", "dst")
    return out if limit is None else out.orderBy("src", "dst").limit(limit)


def neighbours_of_note(note_id: str, ref: DataFrame, rel: DataFrame, nodes: DataFrame) -> DataFrame:
    e = all_edges(rel, ref)
    k = e.where(F.col("src") == note_id).select(F.col("dst").alias("id")).union(e.where(F.col("dst") == note_id).select(F.col("src").alias("id"))).distinct()
    return by_kind(nodes, "indexable").join(k, "id", "left_semi").select("id", "name", "type")


def roll_up(member: DataFrame) -> DataFrame:
    """node_id, community_id of the highest level (smallest id of several) and levels: level to community."""
    per = member.groupBy("node_id", "level").agg(F.min("community_id").alias("community_id"))
    return per.groupBy("node_id").agg(F.max_by("community_id", "level").alias("community_id"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "community_id")))).alias("levels"))


def parents_by_vote(member: DataFrame, child: int, parent: int) -> DataFrame:
    """child, parent, votes: for each community of a level the one of another level that holds most of its members (ties: smaller id)."""
    c = member.where(F.col("level") == child).select("node_id", F.col("community_id").alias("child")).distinct()
    p = member.where(F.col("level") == parent).select("node_id", F.col("community_id").alias("parent")).distinct()
    votes = c.join(p, "node_id").groupBy("child", "parent").agg(F.count("*").alias("votes"))
    return votes.groupBy("child").agg(F.min(F.struct((-F.col("votes")).alias("less"), "parent")).alias("best")).select("child", "best.parent", (-F.col("best.less")).alias("votes"))


def community_overview(member: DataFrame, level: int) -> DataFrame:
    return member.where(F.col("level") == level).groupBy("community_id").agg(F.countDistinct("node_id").alias("member_count"))


def statistics(rel: DataFrame) -> DataFrame:
    """rel_type, edges, mentions, mean confidence."""
    return rel.groupBy("rel_type").agg(F.count("*").alias("edges"), F.sum("mention_count").alias("mentions"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
