"""Packing of documents into token sequences by cutting-stock column generation.

Lengths fall into classes (multiples of a step). A linear program chooses how often to use each pattern of classes that fits a sequence;
new patterns come from a knapsack whose prices are the program's duals. The counts are rounded down, what is left (a number bounded by
the classes, not by the data) is packed best-fit, and the patterns are then dealt to the pieces by their rank within their class.

Defined cases: null text counts as empty and has the end id alone; equal rows are packed once each; an empty table gives no rows;
further columns are ignored; a document longer than a sequence is cut at multiples of the capacity.
"""

from __future__ import annotations

import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .encoding import ENTRIES, encoder, public_path

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece; row numbers tell equal doc_ids apart through `key`."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def cut(batches):
        encode = encoder(kind, tokenizer, entries)
        for batch in batches:
            rows, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                flat, begin = encode([t or "" for t in texts.slice(at, 256).to_pylist()])
                n = np.diff(begin) + 1
                whole = memoryview(np.insert(flat, begin[1:], end_id).astype("<u4")).cast("B")
                base = np.cumsum(n) - n
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                a = base[doc] + start
                crc = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.slice(at, 256).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, limits: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of classes of greatest value that fits room units (each class at most limits times), by dynamic programming.

    A class that is worth no more than a smaller one is never needed, so few classes are left for the table.
    """
    useful = np.flatnonzero((values > 1e-12) & (limits > 0) & (sizes <= room))
    order = useful[np.argsort(sizes[useful], kind="stable")]
    best_smaller = np.maximum.accumulate(np.concatenate(([0.0], values[order])))[:-1]
    fits = order[values[order] > best_smaller + 1e-15]
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    value, size = values[fits], sizes[fits]
    upto = np.searchsorted(size, np.arange(room + 1), "right")
    for u in range(1, room + 1):
        n = upto[u]
        best[u] = best[u - 1]
        if n:
            gain = best[u - size[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[u] + 1e-15:
                best[u], took[u] = gain[k], fits[k]
    pattern, u = np.zeros(len(values), dtype=np.int64), room
    while u > 0:
        if took[u] < 0:
            u -= 1
        else:
            pattern[took[u]] += 1
            u -= sizes[took[u]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, tolerance: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional counts of the linear program min sum(x), sum(pattern * x) = demand, x >= 0: the revised simplex method.

    The basis starts with one pattern per class, as often as it fits; every step prices a pattern by knapsack and pivots it in. It ends
    when no pattern is worth more than 1, or when the bound that every pricing gives (the program's value over the best pattern's) shows
    that less than half a sequence or a 100,000th can still be gained.
    """
    m = len(sizes)
    columns = [np.zeros(m, dtype=np.int64) for _ in range(m)]
    for i in range(m):
        columns[i][i] = room // sizes[i]
    inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
    x = inverse @ demand
    basis = list(columns)
    lower = 0.0
    for step in count():
        dual = inverse.sum(0)
        value, pattern = price(dual, sizes, np.full(m, room), room)
        lower = max(lower, float(x.sum()) / max(value, 1.0))
        if value <= 1 + tolerance or float(x.sum()) - lower <= max(0.5, 1e-5 * lower):
            break
        d = inverse @ pattern
        up = d > 1e-9
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        r = int(ratio.argmin())
        t = max(0.0, ratio[r])
        x = np.maximum(x - t * d, 0)
        x[r] = t
        inverse[r] /= d[r]
        other = np.arange(m) != r
        inverse[other] -= np.outer(d[other], inverse[r])
        basis[r] = pattern
        if step % 200 == 199:
            inverse = np.linalg.inv(np.array(basis, dtype=float).T)
            x = np.maximum(inverse @ demand, 0)
    return list(zip(basis, x, strict=True))


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns {class size: times} and how often each is used, which hold every piece of the histogram exactly once."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    out = []
    for pattern, x in sorted(column_generation(sizes, left.astype(float), room), key=lambda p: -p[1]):
        used = np.flatnonzero(pattern)
        n = min(int(x + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            left[used] -= n * pattern[used]
            out.append(({int(sizes[i]): int(pattern[i]) for i in used}, n))
    while left.any():  # fewer than a pattern per class is left
        took, free = np.zeros(len(sizes), dtype=np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            k = min(int(left[i]), free // int(sizes[i]))
            took[i], free = k, free - k * int(sizes[i])
        times = int((left[took > 0] // took[took > 0]).min())
        left -= took * times
        out.append(({int(sizes[i]): int(took[i]) for i in np.flatnonzero(took)}, times))
    return out


def _layout(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, times in the pattern, first sequence, first slot) of every class of every pattern."""
    rows, rank, sequence = [], {}, 0
    for pattern, n in patterns:
        slot = 0
        for size in sorted(pattern, reverse=True):
            k, lo = pattern[size], rank.get(size, 0)
            rows.append((size, lo, lo + k * n, k, sequence, slot))
            rank[size], slot = lo + k * n, slot + k
        sequence += n
    return rows


def assign(cut: DataFrame, capacity: int = CAPACITY, step: int = 8) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, start, length, ...). cut is read three times, so pass a written table.

    To the driver come only the histogram over capacity / step classes and the rows per class and salt group; ranks within a class are
    numbered inside salt groups, as many as the class's share asks for, so that one length may hold any share of all pieces.
    """
    spark = cut.sparkSession
    sized = cut.withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    histogram = {r["class"]: r["n"] for r in sized.groupBy("class").agg(F.count("*").alias("n")).collect()}
    rows = _layout(plan(histogram, capacity // step))
    if not rows:
        return cut.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    layout = F.broadcast(spark.createDataFrame(rows, "class int, lo long, hi long, times long, sequence long, slot long"))
    size = max(32, sum(histogram.values()) // (8 * shuffle_partitions(spark)))  # rows of a salt group
    salts = F.create_map(*(F.lit(x) for c, n in histogram.items() for x in (c, -(-n // size))))  # an entry for each class
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), salts[F.col("class")]).cast("int"))
    per = salted.groupBy("class", "salt").agg(F.count("*").alias("n"))
    before = per.select("class", "salt", (F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(inner) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(layout, [ranked["class"] == layout["class"], F.col("rank") >= F.col("lo"), F.col("rank") < F.col("hi")]).drop(layout["class"])
    at = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(at / F.col("times"))).withColumn("in_slot", F.col("slot") + at % F.col("times"))
    order = Window.partitionBy("sequence_id").orderBy("in_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*cut.columns, F.col("sequence_id").cast("long"), F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, step: int = 8, entries: int = ENTRIES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. entries bounds the encoder's memory."""
    return assign(materialize(pieces(docs, tokenizer or public_path("word_bpe_49k.json"), kind, end_id, capacity, entries), "pieces"), capacity, step)
