"""Parts shared by the operators of this package: shared storage, word hashing on byte arrays, connected components."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one where that is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(sc, "_graphloom_shared", None)
        if base is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="graphloom-")
            sc._graphloom_shared = base
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. It lives until the folder is cleared, so lost executors can reread it."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and runs what is above it once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store(path: str):
    """(file system, path in it) of a path or URI, for files that tasks write and read themselves."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def put(path: str, data: bytes, attempt: int) -> None:
    """Writes a file whole: under a name of this attempt first, then renamed, so that a repeated task does no harm."""
    system, at = store(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/_{name}.{attempt}") as f:
        f.write(data)
    system.move(f"{folder}/_{name}.{attempt}", at)


def mapped(path: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where the file system is local or mounted, else read."""
    from pyarrow import fs

    system, at = store(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(at, dtype=np.uint8, mode="r")
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- memory of a worker process --------------------------------------------------------------------

_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, forget: Callable[[], None]) -> None:
    """Says that owner now holds a store in this worker, and empties those of all others: workers are used again by later stages."""
    for name in [x for x in _KEPT if x != owner]:
        _KEPT.pop(name)()
    if owner not in _KEPT:
        _KEPT[owner] = forget
        tidy()


def tidy() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str, fan: int = 64) -> DataFrame:
    """rows joined with groups(keys, m, ...), of which each has m of the rows; groups must be a written table.

    Keys with more than a 1,024th of all rows, so fewer than 1,024 keys, are dealt to fan tasks by a hash of the rows' column `by`.
    """
    total = groups.agg(F.sum("m").alias("n")).first()["n"] or 0
    hot = F.broadcast(groups.where(F.col("m") > total / 1024).select(*keys, F.lit(True).alias("_hot")))  # fewer than 1,024 keys
    left = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(fan)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(fan - 1))).otherwise(F.array(F.lit(0)))
    right = groups.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


# --- words ---------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
LONG_RANGE = 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 20, 1 << int(n + 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] for every range, through one prefix sum of a polynomial modulo 2**64.

    Strings of about a thousand bytes can be made that collide under any such polynomial; ranges above LONG_RANGE bytes take BLAKE2b.
    """
    power, inverse = _powers(len(data))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    out = mix((prefix[ends] - prefix[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG_RANGE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of texts, A-Z lowered if asked for.

    hashes: a 64-bit hash per word. first: for document i its words are first[i]:first[i + 1].
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, dtype=np.uint8)
        space = _IS_SPACE[data]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.data = _LOWER[data] if lower else data
        begin = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.first = np.searchsorted(self.starts, begin)
        self.hashes = range_hashes(self.data, self.starts, self.ends)


def blocks(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about size bytes, each with the place of its first; null counts as empty."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and n + len(t) > size:
            yield at, held
            at, held, n = i, [], 0
        held.append(t)
        n += len(t) + 1
    if held:
        yield at, held


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words inside one document, and where each document's runs begin.

    A document of fewer words has one run, all its words; one without words has none.
    """
    h, first = words.hashes, words.first
    n = np.diff(first)
    runs = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(first[:-1] - begin[:-1], runs) + np.arange(begin[-1])
    out = np.zeros(begin[-1], dtype=np.uint64)
    last = np.repeat(first[1:], runs)
    for j in range(k):
        inside = at + j < last
        word = h[np.minimum(at + j, len(h) - 1)] if len(h) else h
        out = np.where(inside, mix(out * np.uint64(_BASE) + word), out)
    return mix(out), begin


# --- connected components --------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node in edges(a, b): the smallest node of its connected component.

    Every round hooks each node to its smallest neighbour, follows that pointer to its end for two steps and contracts the edges,
    so that the edges at least halve; each round is one Parquet table in the shared folder. Groups are only ever minima, which are
    combined before the shuffle, so a node of any degree is safe. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    live = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        hook = materialize(hook, "hook")
        for _ in range(2):
            up = hook.select(F.col("node").alias("k"), F.col("up").alias("upper"))
            hook = hook.join(up, hook["up"] == up["k"], "left").select("node", F.least(F.coalesce("upper", "up"), "up").alias("up"))
        hook = materialize(hook, "jump")
        m = lambda end: hook.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))
        live = materialize(live.join(m("a"), "a").join(m("b"), "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("node").alias("k"), F.col("up").alias("upper"))
            found = found.join(up, found["up"] == up["k"], "left").select("node", F.coalesce("upper", "up").alias("up"))
    else:
        raise RuntimeError("components: more rounds than a graph of 2**64 nodes needs")
    if found is None:
        kind = edges.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return found.withColumnRenamed("up", "component")


class UnionFind:
    """Classes of 0..n-1 with the smallest member as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
