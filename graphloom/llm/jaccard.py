"""Exact Jaccard self-join of documents on word n-grams by T-occurrence search, given as connected classes.

Documents with the same set go on as one. The rest comes in three steps, none of which lists the pairs of a group:

1. Documents with the same smallest (or greatest) shingle hash meet in groups, large ones split at random; in each group the inverted
   lists of the shingles are searched for partners with DivideSkip: the short lists are merged in document order, the longest are only probed, and
   pairs already in one class are passed over. This joins most of what belongs together.
2. A linked pair shares a shingle of both prefixes (n - ceil(t * n) + 1 shingles, rarest first), and its prefixes share as many as leave
   the rest able to reach the overlap. Only pairs from different classes of step 1 are counted, over short lists by a join, over long
   ones block by block; what reaches the count is a candidate.
3. Every candidate is verified by T-occurrence search over the whole sets.

So no link between classes is missed: step 1 only saves work. Rarity is an order known to every task: shingles that repeat often within
the parts of the corpus come last, by their counts; it changes the work, never the result.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; fewer than k words are one shingle;
rows with one doc_id are one document; a null doc_id has a null class; repeated rows keep one row each; an empty table gives no rows;
further columns are ignored by `link_documents` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, Words, blocks, components, keep, materialize, mix, shingle_hashes, shuffle_partitions, spread_join, tidy

FREQUENT, MOST_FREQUENT = 48, 400_000  # repeats that make a shingle come late in the order; how many such are kept at most
GROUP, LONG, BLOCK = 384, 48, 256
GROUP_SHINGLES = 1 << 20  # a group that is searched together holds about so many hashes at most, besides one document
_WINDOW = 1_000_000
_PROBED = 64  # long lists that are probed at once
_SLICE = 1024  # rows of an Arrow batch that are worked on at once


def overlap(nx, ny, percent: int):
    """The least common shingles of two linked sets: 100 * common >= percent * (nx + ny - common)."""
    return -(-percent * (nx + ny) // (100 + percent))


def document_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of every text."""
    for _, block in blocks(texts):
        h, begin = shingle_hashes(Words(block), k)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


class Lists:
    """Inverted lists of some sets, and T-occurrence search over them."""

    MU = 0.0085  # weight of probing against merging when the lists are divided

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.lexsort((doc, flat))
        self.doc, sorted_flat = doc[order], flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = sorted_flat[1:] != sorted_flat[:-1]
        self.begin = np.append(np.flatnonzero(new), len(flat))
        self.keys = sorted_flat[new]
        self.places = (np.cumsum(new) - 1) * len(sets) + self.doc

    def search(self, query: np.ndarray, least: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets among the allowed that share at least `least` elements with the query, and how many each shares."""
        at = np.searchsorted(self.keys, query)
        at = at[(at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == query)]
        length = self.begin[at + 1] - self.begin[at]
        if len(at) < least or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = at[np.argsort(length, kind="stable")]
        longest = int(length.max())
        aside = min(least - 1, int(least / (self.MU * math.log2(longest + 1) + 1)), len(at) - 1)
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        # Merge the short lists, each sorted by document, into one order; a document's run tells how many of them hold it.
        size = self.begin[short + 1] - self.begin[short]
        ends = np.cumsum(size)
        merged = np.sort(self.doc[np.repeat(self.begin[short] - ends + size, size) + np.arange(ends[-1])], kind="stable")
        new = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        near, count = merged[new], np.diff(np.append(new, len(merged)))
        keep = (count >= max(1, least - aside)) & allowed[near]
        near, count = near[keep], count[keep]
        # Probe the long lists by bisection for what is left, some lists at a time: (list, document) pairs stand in one sorted array.
        for i in range(0, len(long), _PROBED):
            if not len(near):
                break
            part = long[i : i + _PROBED]
            wanted = (part[:, None] * len(self.sizes) + near).ravel()
            p = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            count = count + (self.places[p] == wanted).reshape(len(part), -1).sum(0)
            keep = count >= least - (len(long) - i - len(part))
            near, count = near[keep], count[keep]
        keep = count >= least
        return near[keep], count[keep]


def linked_classes(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pointers (member, root) of the classes of linked sets."""
    lists, union = Lists(sets), UnionFind(len(sets))
    root = np.arange(len(sets))
    for x in np.argsort(-lists.sizes, kind="stable").tolist():
        n = int(lists.sizes[x])
        if not n:
            continue
        allowed = (lists.sizes <= n) & (100 * lists.sizes >= percent * n) & (root != root[x])
        if not allowed.any():
            continue
        near, count = lists.search(sets[x], -(-percent * n // 100), allowed)
        for y in near[count >= overlap(n, lists.sizes[near], percent)].tolist():
            if union.link(x, y):
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
    return [(i, int(r)) for i, r in enumerate(root) if i != r]


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat often and their counts: at most MOST_FREQUENT, those above the least power of two that leaves so few."""

    def count(batches):
        keep("jaccard", tidy)
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], names=["h", "n"])

        for batch in _slices(batches):
            for s in document_sets(batch.column("text").cast(pa.binary()).to_pylist(), k):
                held.append(s)
                n += len(s)
                if n >= _WINDOW:
                    yield flush()
                    n = 0
        if held:
            yield flush()
        tidy()

    counts = materialize(docs.select(F.col("text").cast("string")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    least, left = 1 << 62, MOST_FREQUENT
    for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).orderBy(F.desc("b")).collect():  # at most 63 rows
        if r["c"] > left:
            break
        least, left = 1 << int(r["b"]), left - r["c"]
    rows = counts.where(F.col("n") >= least).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


_SETS = "doc_id long, n long, s1 long, s2 long, low long, high long, prefix array<long>"


def _profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document its set's size, two sums that tell sets apart, its smallest and greatest hash, and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))  # at most 16 bytes each of MOST_FREQUENT
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), *((c, pa.int64()) for c in ("s1", "s2", "low", "high")), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        keep("jaccard", tidy)
        often, times = shared.value
        for batch in _slices(batches):
            rows, prefixes = np.zeros((batch.num_rows, 5), dtype=np.int64), []
            for i, s in enumerate(document_sets(batch.column("text").cast(pa.binary()).to_pylist(), k)):
                n = len(s)
                if not n:
                    prefixes.append(s)
                    continue
                rows[i] = n, mix(s).sum().view(np.int64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64), *s[[0, -1]].view(np.int64)
                p = n - -(-percent * n // 100) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = np.where(often[at] == s, times[at], 0)
                    s = s[np.argsort(rank, kind="stable")[:p]]
                prefixes.append(s[:p].copy())
            edges = np.concatenate(([0], np.cumsum([len(x) for x in prefixes]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, c]) for c in range(5)), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], schema=schema)
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SETS)


def _groups(batches, keys: tuple[str, ...]):
    """Groups of a stream that is sorted by keys: (key, its rows as a table). One group is held at a time, besides a batch."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            mine = tuple(int(c[a]) for c in columns)
            if mine != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = mine, []
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _meet(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Pointers (a, b) between linked documents that share (g, part) in rows(g, part, doc_id)."""
    n = shuffle_partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Always by a shuffle of both sides: the ids grow with the documents, and the plan is then the same at every size.
    met = rows.join(texts.hint("merge"), "doc_id").repartition(n, "g", "part").sortWithinPartitions("g", "part")

    def run(batches):
        keep("jaccard", tidy)
        for _, table in _groups(batches, ("g", "part")):
            ids = table.column("doc_id").to_pylist()
            if len(ids) < 2:
                continue
            out = linked_classes(list(document_sets(table.column("text").cast(pa.binary()).to_pylist(), k)), percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in out], pa.int64()), pa.array([ids[b] for _, b in out], pa.int64())], schema=_EDGE)
        tidy()

    return met.select("g", "part", "doc_id", "text").mapInArrow(run, "a long, b long")


def _split(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """rows(g, doc_id, n) with a part, about size rows and GROUP_SHINGLES hashes of a g each; without groups of one."""
    many = materialize(rows.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1"), "groups")
    parts = F.greatest(F.ceil(F.col("m") / size), F.ceil(F.col("s") / GROUP_SHINGLES))
    return spread_join(rows, many, ["g"], "doc_id").select("g", F.pmod(F.xxhash64("doc_id", F.lit(salt)), parts).alias("part"), "doc_id")


def _candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n of b) of documents of different classes whose prefixes share enough. reps: doc_id, n, class, prefix."""
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    posts = reps.select("doc_id", "n", p.alias("p"), "class", F.explode("prefix").alias("h"))
    busy = materialize(posts.groupBy("h").agg(F.count("*").alias("m"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("m > 1 and lo <> hi").select("h", "m"), "busy")
    rows = materialize(spread_join(posts, busy, ["h"], "doc_id"), "postings")
    long = rows.where(F.col("m") > LONG)
    tally = long.groupBy("doc_id").agg(F.count("*").alias("longs"))
    need = lambda nx, px, ny, py: F.ceil(percent * (nx + ny) / (100 + percent) - 1e-9) - F.greatest(nx - px, ny - py)

    one = rows.where(F.col("m") <= LONG).join(tally, "doc_id", "left").fillna(0, ["longs"]).select("h", "doc_id", "n", "p", "class", "longs")
    x, y = (one.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "p", "class", "longs"))) for s in "xy")
    near = (F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("class_x") != F.col("class_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    pairs = x.join(y, "h").where(near).groupBy("doc_id_x", "doc_id_y", "n_x", "n_y", "p_x", "p_y", "longs_x", "longs_y").agg(F.count("*").alias("c"))
    pairs = pairs.where(F.col("c") >= need(F.col("n_x"), F.col("p_x"), F.col("n_y"), F.col("p_y")) - F.least("longs_x", "longs_y"))
    found = pairs.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"), F.col("n_y").alias("n"))
    if long.isEmpty():
        return found

    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    each = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(mine, i).alias("i"), F.greatest(mine, i).alias("j")))
    met = long.select("h", "doc_id", "n", "p", "class", mine.alias("part"), F.explode(each).alias("pair")).select("h", "pair.i", "pair.j", "doc_id", "n", "p", "class", "part")
    met = met.join(reps.select("doc_id", "prefix"), "doc_id").repartition(shuffle_partitions(reps.sparkSession), "h", "i", "j").sortWithinPartitions("h", "i", "j")

    def block(batches):
        keep("jaccard", tidy)
        for (_, i, j), table in _groups(batches, ("h", "i", "j")):
            ids, n, p, own, part = (table.column(c).to_numpy() for c in ("doc_id", "n", "p", "class", "part"))
            if len(np.unique(own)) < 2:
                continue
            sets = [np.sort(s.values.to_numpy().view(np.uint64)) for s in table.column("prefix")]
            lists = Lists(sets)
            a, b, size = [], [], []
            for q in range(len(ids)):
                if part[q] != i:
                    continue
                allowed = (own != own[q]) & (100 * np.minimum(n, n[q]) >= percent * np.maximum(n, n[q])) & (part == j)
                if i == j:
                    allowed &= ids > ids[q]
                if not allowed.any():
                    continue
                least = np.maximum(1, overlap(n, n[q], percent) - np.maximum(n - p, n[q] - p[q]))
                near, count = lists.search(sets[q], int(least[allowed].min()), allowed)
                near = near[count >= least[near]]
                a += np.minimum(ids[near], ids[q]).tolist()
                b += np.maximum(ids[near], ids[q]).tolist()
                size += np.where(ids[near] > ids[q], n[near], n[q]).tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, size)], names=["a", "b", "n"])
        tidy()

    return found.unionByName(met.mapInArrow(block, "a long, b long, n long")).distinct()


def link_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = materialize(_profiles(docs, k, percent), "sets")
    key = ("n", "s1", "s2")
    whole = sets.where("n > 0 and doc_id is not null")
    reps = materialize(whole.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("prefix").alias("prefix")), "reps")
    ids = reps.select(F.col("rep").alias("doc_id"), "n", "low", "high")
    first = _split(ids.select(F.col("low").alias("g"), "doc_id", "n"), GROUP, 1)
    second = _split(ids.select(F.col("high").alias("g"), "doc_id", "n"), GROUP, 2).withColumn("part", -1 - F.col("part"))
    early = components(_meet(docs, first.unionByName(second), k, percent))
    named = reps.join(early.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("rep").alias("doc_id"), "n", F.coalesce("component", "rep").alias("class"), "prefix")
    named = materialize(named, "classes")
    pairs = materialize(_candidates(named, percent), "candidates")
    # Every candidate is verified in a group of its first document, which stands in each part with some of its partners.
    parts = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("k"))
    dealt = pairs.join(parts, "a").select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("k")).alias("part"), "b")
    rows = dealt.select("g", "part", F.col("b").alias("doc_id")).unionByName(dealt.select("g", "part", F.col("g").alias("doc_id")).distinct())
    late = _meet(docs, rows, k, percent)
    of = named.select(F.col("doc_id").alias("id"), "class")
    joined = late.join(of.withColumnRenamed("id", "a").withColumnRenamed("class", "ca"), "a").join(of.withColumnRenamed("id", "b").withColumnRenamed("class", "cb"), "b")
    last = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = of.join(last.withColumnRenamed("node", "class"), "class", "left").select(F.col("id").alias("rep"), F.coalesce("component", "class").alias("component_id"))
    classes = materialize(reps.select(*key, "m", "rep").join(final, "rep").select(*key, "m", "component_id"), "final")
    linked = spread_join(whole.select("doc_id", *key), classes, list(key), "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their class (smallest doc_id) and those that link with nothing, with all their columns.

    Rows with a null or repeated doc_id take part under keys of their own, so one row of each class stays; a null doc_id only where the
    class has no other.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    odd = docs.where("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi"))
    key, own = "_graphloom_key", "_graphloom_own"
    odd = materialize(odd.select(*docs.columns, F.monotonically_increasing_id().alias(own)), "odd")
    if odd.isEmpty():
        out = link_documents(docs, k, percent).where("component_id is null or doc_id = component_id").select("doc_id")
        return docs.join(out.distinct(), "doc_id", "left_semi")
    plain = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti")
    # Keys that no document has: above the largest doc_id, or below the smallest where there is no room.
    ends = docs.agg(F.max(F.col("doc_id").cast("long")).alias("high"), F.min(F.col("doc_id").cast("long")).alias("low")).first()
    last = odd.agg(F.max(own)).first()[0]
    high, low = ends["high"] or 0, ends["low"] or 0
    if high + last + 1 < 1 << 63:
        odd = odd.withColumn(key, F.lit(high + 1) + F.col(own))
    elif low - last - 1 >= -(1 << 63):
        odd = odd.withColumn(key, F.lit(low - 1) - F.col(own))
    else:
        raise ValueError("doc_id leaves no room for keys of null and repeated ids")
    rows = plain.select(F.col("doc_id").cast("long"), "text").unionByName(odd.select(F.col(key).alias("doc_id"), "text"))
    linked = materialize(link_documents(rows, k, percent), "linked").withColumnRenamed("doc_id", key)
    ids = linked.join(odd.select(key, F.col("doc_id").cast("long").alias("id"), F.lit(True).alias("is_odd")), key, "left")
    order = F.struct(F.when(F.col("is_odd"), F.col("id").isNull()).otherwise(False).alias("lost"), F.when(F.col("is_odd"), F.col("id")).otherwise(F.col(key)).alias("id"), F.col(key).alias("key"))
    kept = materialize(ids.groupBy("component_id").agg(F.min(order).alias("least")).select(F.col("least.key").alias(key)), "kept")
    some = plain.join(kept.select(F.col(key).alias("doc_id")), "doc_id", "left_semi").select(*docs.columns)
    return some.unionByName(odd.join(kept, key, "left_semi").select(*docs.columns))
