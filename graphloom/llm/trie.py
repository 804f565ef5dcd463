"""The prefix trie of conversations by prefix doubling: dense names of power-of-two blocks of turns, joined in a logarithmic number of rounds.

A turn's content (role, text) is one dense name. The name of an aligned block of 2**(j + 1) turns is the dense name of the pair of its halves'
names. A prefix of d turns is cut as the binary digits of d say, into aligned blocks, so its name is that of the prefix without the last
block, paired with that block. Equal names of prefixes of one depth mean equal sequences of turns, and the trie is a grouping of prefixes
by (depth, name). Only whole numbers are shuffled after the first grouping; texts take part in the sort of turns and as SHA-256 digests.

Sums over subtrees need no walk over the tree: every node belongs to its smallest conversation, and the nodes that one conversation owns
are the last ones on its path. So a node's subtree sum is the sum, over the members of the node, of what each member owns from there on.

Defined cases: null roles and texts are empty; rows without conv_id take no part; null turns come first, equal turns are ordered by role,
then text, so repeated rows are repeated turns; a conversation may lose all its turns (it has h of them and no base) and is a member of
the root alone; an empty table gives no rows, not even a root; further columns are ignored. A conversation of very many turns is ranked
and summed in blocks, a turn, block or prefix that very many conversations share is joined in several tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, spread_join

#: A conversation takes the first turns of that numbered by its hundreds, h of 0 to TAKEN - 1.
GROUP, TAKEN = 100, 6
#: Depths that one window sums, conversations whose ids one string joins.
SPAN = 4096
_ROW = (1 << 33) - 1


def taken(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % TAKEN


def ranked(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), content (SHA-256), chars. One sort of all turns; a conversation that spans several tasks is numbered through."""
    n = shuffle_partitions(turns.sparkSession)
    clean = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    laid = clean.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", F.unhex(content).alias("content"), F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    laid = materialize(laid, "turns")
    runs = laid.groupBy("conv_id", "part").agg(F.count("*").alias("m"))
    several = runs.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")  # at most one for each border of two tasks
    before = runs.join(F.broadcast(several), "conv_id").withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("conv_id", "part", "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("at")) - 1
    return laid.withColumn("pos", inside).join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "content", "chars")


def rebuilt(rows: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation: the first h of conversation c - c % 100, then its own after its first h."""
    convs = rows.select("conv_id").distinct().select("conv_id", taken(F.col("conv_id")).alias("h"))
    first = rows.where(F.col("pos") < TAKEN - 1).withColumnRenamed("conv_id", "base")
    given = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(first, "base").where("pos < h").select("conv_id", "pos", "content", "chars")
    # Its own turns go on where the base's end: at h, or before that where the base is shorter.
    length = given.groupBy("conv_id").agg(F.count("*").alias("got"))
    shift = convs.join(length, "conv_id", "left").where(F.coalesce("got", F.lit(0)) < F.col("h")).select("conv_id", (F.col("h") - F.coalesce("got", F.lit(0))).alias("less"))
    own = rows.where(F.col("pos") >= taken(F.col("conv_id")))
    own = spread_join(own, materialize(own.groupBy("conv_id").agg(F.count("*").alias("m")).join(shift, "conv_id", "left"), "shift"), ["conv_id"], "pos")
    return given.unionByName(own.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "content", "chars"))


def named(rows: DataFrame, keys: list[str], by: str, extra: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with name, the names): a dense number from 1 for every different combination of keys.

    The groups are written once with the place of each in its file; a file's first number follows from the row counts of those before.
    """
    groups = rows.groupBy(*keys).agg(F.count("*").alias("m"), *((c.alias(n)) for n, c in (extra or {}).items())).withColumn("_at", F.monotonically_increasing_id())
    groups = materialize(groups, "names")
    files = groups.groupBy(F.shiftright("_at", 33).alias("_file")).agg(F.count("*").alias("_n"))  # a row for each task that wrote
    files = files.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    names = groups.withColumn("_file", F.shiftright("_at", 33)).join(F.broadcast(files), "_file")
    names = names.withColumn("name", F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW)) + 1).drop("_file", "_before", "_at")
    return spread_join(rows, names, keys, by).drop("m"), names


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name of every prefix of at least one turn of turns(conv_id, pos, content), and chars of its last turn."""
    blocks, names = named(turns.select("conv_id", "pos", "content", "chars"), ["content"], "conv_id")
    level = materialize(blocks.select("conv_id", F.col("pos").alias("k"), "name", "chars"), "blocks0")
    chars = level.select("conv_id", (F.col("k") + 1).alias("depth"), "chars")
    levels, level = [level.select("conv_id", "k", "name")], level.select("conv_id", "k", "name")
    while True:
        half = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv_id", F.shiftright("k", 1).alias("k2")).agg(half(0).alias("left"), half(1).alias("right")).where("right is not null").withColumnRenamed("k2", "k")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break
        level = materialize(named(pairs, ["left", "right"], "conv_id")[0].select("conv_id", "k", "name"), f"blocks{len(levels)}")
        levels.append(level)
    # Depth 2**j is the first block of level j; a depth with more ones takes the block that its lowest one stands for.
    found = None
    for j, b in enumerate(levels):
        one = b.where("k = 0").select("conv_id", F.lit(1 << j).cast("long").alias("depth"), "name")
        found = one if found is None else found.unionByName(one)
    last = None
    for j, b in enumerate(levels):
        some = b.where("k > 0 and k % 2 = 0").select("conv_id", F.shiftleft(F.col("k"), j).alias("base"), F.shiftleft(F.col("k") + 1, j).alias("depth"), F.col("name").alias("right"), F.bit_count("k").alias("ones"))
        last = some if last is None else last.unionByName(some)
    last = materialize(last, "last")
    front, ones = materialize(found, "prefixes"), 1
    out = front
    while len(levels) > 1:
        step = last.where(F.col("ones") == ones).join(front.select("conv_id", F.col("depth").alias("base"), F.col("name").alias("left")), ["conv_id", "base"])
        step = materialize(step.select("conv_id", "depth", "left", "right"), "steps")
        if step.isEmpty():
            break
        front = materialize(named(step, ["depth", "left", "right"], "conv_id")[0].select("conv_id", "depth", "name"), "prefixes")
        out, ones = out.unionByName(front), ones + 1
    return out.join(chars, ["conv_id", "depth"])


def suffix_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows(conv_id, depth, ...) with each value summed from its depth to the end of the conversation, SPAN depths a window."""
    span = rows.withColumn("_span", F.floor(F.col("depth") / SPAN))
    later = Window.partitionBy("conv_id", "_span").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    here = span.select("*", *(F.sum(v).over(later).alias(f"_{v}") for v in values))
    total = span.groupBy("conv_id", "_span").agg(*(F.sum(v).alias(f"_t{v}") for v in values))
    many = total.groupBy("conv_id").agg(F.max("_span").alias("last")).where("last > 0").select("conv_id")
    after = Window.partitionBy("conv_id").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    rest = total.join(many, "conv_id", "left_semi").select("conv_id", "_span", *(F.sum(f"_t{v}").over(after).alias(f"_r{v}") for v in values))
    both = here.join(rest, ["conv_id", "_span"], "left")
    return both.select(*rows.columns, *((F.col(f"_{v}") + F.coalesce(f"_r{v}", F.lit(0))).alias(f"{v}_after") for v in values))


def ends(members: DataFrame) -> DataFrame:
    """depth, name, ends_sha256 of the nodes where conversations(conv_id, depth, name) end.

    The ids of a node are joined by runs of SPAN numbers, in parallel; the digest then reads these strings in order, one at a time.
    """
    run = F.floor(F.col("conv_id") / SPAN)
    pieces = members.groupBy("depth", "name", run.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    n = shuffle_partitions(members.sparkSession)

    def digest(batches):
        node, state = None, None
        for batch in batches:
            keys = list(zip(batch.column("depth").to_pylist(), batch.column("name").to_pylist(), strict=True))
            out = []
            for key, ids in zip(keys, batch.column("ids").to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["depth", "name", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["depth", "name", "ends_sha256"])

    return pieces.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "run").select("depth", "name", "ids").mapInArrow(digest, "depth long, name long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over rebuilt conversations, one row each: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    rows = materialize(ranked(conversations), "ranked")
    convs = rows.select("conv_id").distinct()
    paths = prefixes(materialize(rebuilt(rows), "rebuilt"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"))
    paths = materialize(paths.select("conv_id", "depth", "name", "chars").unionByName(root), "paths")
    groups = materialize(paths.groupBy("depth", "name").agg(F.min("conv_id").alias("owner"), F.count("*").alias("m"), F.max("chars").alias("chars")), "nodes")
    # A node's parent is the prefix before it on its owner's path.
    step = groups.where("depth > 0").select(F.col("owner").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("name").alias("child"))
    step = step.join(paths.select("conv_id", "depth", "name"), ["conv_id", "depth"])
    above = materialize(step.select((F.col("depth") + 1).alias("depth"), F.col("child").alias("name"), F.col("name").alias("parent")), "parents")
    children = above.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    counted = groups.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = materialize(counted.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("m") - 1) * F.col("chars")), "counted")
    # Each owner holds its nodes' values on its path; sums from there on, then over members.
    own = paths.select("conv_id", "depth", "name").join(counted.select(F.col("owner").alias("conv_id"), "depth", "leaf", "saved"), ["conv_id", "depth"], "left")
    summed = suffix_sums(own.select("conv_id", "depth", "name", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("saved", F.lit(0)).alias("saved")), ["leaf", "saved"])
    below = summed.groupBy("depth", "name").agg(F.sum("leaf_after").alias("n_leaves"), F.sum("saved_after").alias("saved_tokens"))
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("depth", "name"), "depth").alias("x")).select("conv_id", "x.depth", "x.name")
    owners = groups.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("owner").alias("parent_conv_id"), F.col("m"))
    # Very many nodes may have one parent, so that join is spread as the others.
    fathers = materialize(owners.join(children.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), "n_children"), ["depth", "parent"]).drop("m").withColumnRenamed("n_children", "m"), "fathers")
    parents = spread_join(above, fathers, ["depth", "parent"], "name").select("depth", "name", "parent_conv_id")
    full = counted.join(below, ["depth", "name"]).join(parents, ["depth", "name"], "left").join(ends(last), ["depth", "name"], "left")
    return full.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("m").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
