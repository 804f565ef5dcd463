"""Language-model scores from an Elias-Fano n-gram trie built over the whole training corpus.

Tokens are words with A-Z lowered and one end per text. Level 1 holds the words (as sorted 63-bit hashes), level k the n-grams of k words
that occur at least `least` times, each as (node of its first k - 1 words, place of its last word among the words that follow the
middle), so that a successor is searched relative to its context. A level is cut into shards by ranges of that key; a shard is one file
with its keys and the pointers from contexts to first children as Elias-Fano blocks, and quantised log-probabilities and back-off
weights. Files lie in the shared folder and are memory-mapped; a search decodes only the blocks that it touches.

Probabilities: level 1 (c + 1) / (N + V + 1), which leaves one share for unknown words; above, absolute discounting with the rest going to
the next shorter context. Counts are gathered over all training texts level by level; no n-gram table is held by the driver or one task.

Defined cases: null and empty texts have the end alone; words in no training text count as unknown, contexts that hold one are cut;
repeated rows count each; without training texts N is 0 and V is 0, and every token has log10(1 / 1); an empty table gives no rows;
further columns are ignored. A null doc_id is not held out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, keep, mapped, materialize, mix, new_path, put, shuffle_partitions, tidy

ORDER, LEAST, DISCOUNT = 3, 1, 0.75
_MASK = np.uint64((1 << 63) - 1)
END = mix(np.array([0xE0D], dtype=np.uint64)) & _MASK
_WINDOW = 600_000
BLOCK = 8
_BLOCKS = 32768  # blocks that are decoded at once
BINS = 256
SHARD = 3_000_000  # tokens of training text for a shard of a level
SAMPLE = 1 << 17  # tokens whose n-grams tell where a level is cut into shards


# --- Elias-Fano sequences --------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of whole numbers below 2**63 in blocks of BLOCK: whole low bytes, and the rest in unary with two bits a value.

    Blocks with as many low bytes have one size and lie together, so that any set of blocks is decoded at once; a search decodes only
    the blocks that it touches, whatever the length of the sequence.
    """

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        blocks = -(-n // BLOCK)
        v = np.concatenate([values, np.full(blocks * BLOCK - n, values[-1] if n else 0, np.uint64)]).reshape(blocks, BLOCK)
        rest = v - v[:, :1]
        spread = rest[:, -1] // np.uint64(BLOCK) if n else np.zeros(0, np.uint64)
        low = sum((spread >= np.uint64(1 << 8 * k)).astype(np.uint8) for k in range(8)) if n else np.zeros(0, np.uint8)
        place, groups, body = np.zeros(blocks, "<u4"), [], []
        for w in range(9):
            mine = np.flatnonzero(low == w)
            groups.append(len(mine))
            if len(mine):
                place[mine] = np.arange(len(mine))
                high = (rest[mine] >> np.uint64(8 * w)).astype(np.int64) if w < 8 else np.zeros((len(mine), BLOCK), np.int64)
                bits = np.zeros((len(mine), 2 * BLOCK), dtype=np.uint8)
                np.put_along_axis(bits, high + np.arange(BLOCK), 1, 1)
                lows = rest[mine].view(np.uint8).reshape(len(mine), BLOCK, 8)[:, :, :w].reshape(len(mine), -1)
                body.append(np.concatenate([lows, np.packbits(bits, axis=1)], axis=1).tobytes())
        parts = [v[:, 0].astype("<u8").tobytes(), np.array(groups, "<i8").tobytes(), low.tobytes() + b"\0" * (-blocks % 8), place.tobytes()]
        return struct.pack("<qq", n, blocks) + b"".join(parts) + b"".join(body)

    def __init__(self, data: np.ndarray):
        self.n, blocks = struct.unpack("<qq", data[:16].tobytes())
        at = 16 + 8 * blocks
        self.first = data[16:at].view("<u8")
        groups, at = data[at : at + 72].view("<i8"), at + 72
        self.low, at = data[at : at + blocks], at + blocks + -blocks % 8
        self.place, at = data[at : at + 4 * blocks].view("<u4"), at + 4 * blocks
        self.groups = []
        for w, m in enumerate(groups.tolist()):
            size = BLOCK * w + BLOCK // 4
            self.groups.append(data[at : at + m * size].reshape(m, size))
            at += m * size

    def blocks(self, b: np.ndarray) -> np.ndarray:
        """The values of some blocks, a row for each; the last block of all is filled up with its last value."""
        out = np.zeros((len(b), BLOCK), dtype=np.uint64)
        low, place = self.low[b], self.place[b]
        for w in np.unique(low).tolist():
            mine = np.flatnonzero(low == w)
            raw = self.groups[w][place[mine]]
            values = np.zeros((len(mine), BLOCK, 8), dtype=np.uint8)
            values[:, :, :w] = raw[:, : BLOCK * w].reshape(len(mine), BLOCK, w)
            values = values.view(np.uint64)[:, :, 0]
            if w < 8:
                ones = np.flatnonzero(np.unpackbits(raw[:, BLOCK * w :], axis=1)).reshape(len(mine), BLOCK)
                high = (ones % (2 * BLOCK) - np.arange(BLOCK)).astype(np.uint64)
                values = values + (high << np.uint64(8 * w))
            out[mine] = values
        return out + self.first[b][:, None]

    def all(self) -> np.ndarray:
        m = len(self.first)
        parts = [self.blocks(np.arange(a, min(m, a + _BLOCKS))).ravel() for a in range(0, m, _BLOCKS)]
        return np.concatenate([np.zeros(0, np.uint64), *parts])[: self.n]

    def _touched(self, block: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of a sorted array of block numbers: runs, the row of each in the values, and the values of the run's different blocks."""
        new = np.ones(len(block), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        row = np.cumsum(new) - 1
        firsts = np.flatnonzero(new)
        for r in range(0, len(firsts), _BLOCKS):
            lo, hi = int(firsts[r]), int(firsts[r + _BLOCKS]) if r + _BLOCKS < len(firsts) else len(block)
            yield slice(lo, hi), row[lo:hi] - r, self.blocks(block[firsts[r : r + _BLOCKS]])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at sorted places."""
        out = np.zeros(len(places), dtype=np.uint64)
        for run, row, values in self._touched(places // BLOCK):
            out[run] = values[row, places[run] % BLOCK]
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted values: the place of the first element that is not smaller, and whether it is equal. The elements all differ."""
        place, equal = np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        block = np.searchsorted(self.first, wanted, "right") - 1
        start = int((block < 0).sum())
        block = block[start:]
        for run, row, values in self._touched(block):
            mine, flat = slice(run.start + start, run.stop + start), values.ravel()
            p = np.searchsorted(flat, wanted[mine])
            inside = np.minimum(p - row * BLOCK, BLOCK)
            equal[mine] = (inside < BLOCK) & (flat[np.minimum(p, len(flat) - 1)] == wanted[mine])
            place[mine] = np.minimum(block[run] * BLOCK + inside, self.n)
        return place, equal


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, code book) of values: BINS bins of equal width, so that frequent and rare n-grams err alike, each with the mean of its values."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    low, high = float(x.min()), float(x.max())
    code = np.minimum((x - low) * (BINS / (high - low)), BINS - 1).astype(np.uint8) if high > low else np.zeros(len(x), np.uint8)
    n = np.bincount(code, minlength=BINS)
    return code, (np.bincount(code, x, BINS) / np.maximum(1, n)).astype(np.float32)


# --- files of a level ------------------------------------------------------------------------------


def _pack(head: dict, parts: dict[str, bytes]) -> bytes:
    """Parts start at multiples of 8, as arrays that are mapped need."""
    parts = {k: v + b"\0" * (-len(v) % 8) for k, v in parts.items()}
    head = head | {"parts": {k: len(v) for k, v in parts.items()}}
    raw = json.dumps(head).encode()
    raw += b" " * (-len(raw) % 8)
    return struct.pack("<q", len(raw)) + raw + b"".join(parts.values())


def _unpack(data: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    (n,) = struct.unpack("<q", data[:8].tobytes())
    head, at, parts = json.loads(data[8 : 8 + n].tobytes()), 8 + n, {}
    for k, size in head["parts"].items():
        parts[k] = data[at : at + size]
        at += size
    return head, parts


class Counts:
    """Counts by place: a byte each, and the greater ones in a sorted list."""

    @staticmethod
    def encode(n: np.ndarray) -> dict[str, bytes]:
        more = np.flatnonzero(n >= 255)
        return {"counts": np.minimum(n, 255).astype(np.uint8).tobytes(), "more": more.astype("<i8").tobytes(), "more_counts": n[more].astype("<i8").tobytes()}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.small, self.more, self.more_counts = parts["counts"], parts["more"].view("<i8"), parts["more_counts"].view("<i8")

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        out = self.small[places].astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.more_counts[np.searchsorted(self.more, places[big])]
        return out


class Level:
    """One level of the trie over its shards. shards: dicts with file, lo (first key), base (nodes before), n, and bits of a child."""

    def __init__(self, directory: str, shards: list[dict], bits: int = 0):
        self.directory, self.shards, self.bits = directory, shards, bits
        self.lo = np.array([s["lo"] for s in shards], dtype=np.uint64)
        self.base = np.array([s["base"] for s in shards], dtype=np.int64)
        self.n = shards[-1]["base"] + shards[-1]["n"] if shards else 0
        self._open: dict[tuple[int, str], tuple] = {}

    def _shard(self, i: int, kind: str):
        if (i, kind) not in self._open:
            head, parts = _unpack(mapped(f"{self.directory}/{self.shards[i]['file']}.{kind}"))
            if kind == "keys":
                self._open[i, kind] = EliasFano(parts["keys"]), EliasFano(parts["pointers"]) if "pointers" in parts else None, Counts(parts), head
            else:
                self._open[i, kind] = parts["codes"], parts["book"].view("<f4"), parts["rest_codes"], parts["rest_book"].view("<f4")
        return self._open[i, kind]

    def _runs(self, shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if len(shard):
            cut = np.flatnonzero(np.diff(shard)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
                yield int(shard[a]), a, b

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Nodes of sorted keys, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        shard = np.searchsorted(self.lo, keys, "right") - 1
        for i, a, b in self._runs(shard):
            if i >= 0:
                place, equal = self._shard(i, "keys")[0].successor(keys[a:b])
                out[a:b] = np.where(equal, place + self.base[i], -1)
        return out

    def _holder(self, contexts: np.ndarray) -> np.ndarray:
        """The first shard that may hold children of each context: the last that begins before them, or the next if that one ends before."""
        key = contexts.astype(np.uint64) << np.uint64(self.bits)
        i = np.maximum(np.searchsorted(self.lo, key, "left") - 1, 0)
        last = np.array([s["last"] for s in self.shards], dtype=np.uint64)
        return np.where((last[i] < contexts.astype(np.uint64)) & (i + 1 < len(self.shards)), i + 1, i)

    def first_child(self, contexts: np.ndarray) -> np.ndarray:
        """The first child of each of the sorted contexts, through the pointers; for a context without children where it would be."""
        out = np.zeros(len(contexts), dtype=np.int64)
        if self.shards:
            for i, a, b in self._runs(self._holder(contexts)):
                _, pointers, _, head = self._shard(i, "keys")
                place = np.clip(contexts[a:b] - head["first"], 0, pointers.n - 1)
                out[a:b] = pointers.at(place).astype(np.int64) + self.base[i]
        return out

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the weight that each of the sorted contexts leaves to the shorter one."""
        out = np.zeros(len(contexts))
        if self.shards:
            for i, a, b in self._runs(self._holder(contexts)):
                _, _, codes, book = self._shard(i, "values")
                head = self._shard(i, "keys")[3]
                place = contexts[a:b] - head["first"]
                inside = (place >= 0) & (place < head["contexts"])
                out[a:b] = np.where(inside, book[codes[np.clip(place, 0, head["contexts"] - 1)]], 0)
        return out

    def _gather(self, nodes: np.ndarray, f) -> np.ndarray:
        out = np.zeros(len(nodes))
        for i, a, b in self._runs(np.searchsorted(self.base, nodes, "right") - 1):
            out[a:b] = f(i, nodes[a:b] - self.base[i])
        return out

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        return self._gather(nodes, lambda i, p: self._shard(i, "keys")[2][p])

    def scores(self, nodes: np.ndarray) -> np.ndarray:
        """log10 probabilities of sorted nodes."""
        return self._gather(nodes, lambda i, p: self._shard(i, "values")[1][self._shard(i, "values")[0][p]])

    def keys(self, nodes: np.ndarray) -> np.ndarray:
        """Keys of sorted nodes."""
        out = np.zeros(len(nodes), dtype=np.uint64)
        for i, a, b in self._runs(np.searchsorted(self.base, nodes, "right") - 1):
            out[a:b] = self._shard(i, "keys")[0].at(nodes[a:b] - self.base[i])
        return out


def _sorted_unique(x: np.ndarray, f) -> np.ndarray:
    """f on the sorted different values of x, dealt back to all."""
    u, back = np.unique(x, return_inverse=True)
    return f(u)[back]


# --- walking texts ---------------------------------------------------------------------------------


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all tokens, ends included, and where each text's begin."""
    w = Words(texts)
    h = np.insert(w.hashes & _MASK, w.first[1:], END[0])
    return h, w.first + np.arange(len(w.first))


def _windows(batches, size: int = _WINDOW) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts) of about size tokens, at some 6 bytes each."""
    keep("lm", _OPEN.clear)
    ids, texts, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                t = t or b""
                ids.append(i)
                texts.append(t)
                n += len(t) // 6 + 1
                if n >= size:
                    yield ids, texts
                    ids, texts, n = [], [], 0
    if ids:
        yield ids, texts
    tidy()


class _Grams:
    """What a level knows of the n-grams that end at each place: node (-1 where there is none), and as asked for its count, score, the
    weight that it leaves as a context and its first child."""

    def __init__(self, n: int):
        self.node = np.full(n, -1, dtype=np.int64)
        self.count = self.score = self.rest = self.first = None


def _look_up(levels: list[Level], k: int, keys: np.ndarray, ok: np.ndarray, n: int, values: bool) -> _Grams:
    """Level k's n-grams with the given keys, which end at places ok of n. Every different key is looked up once; nodes come in the order of keys."""
    out, level = _Grams(n), levels[k - 1]
    u, back = np.unique(keys, return_inverse=True)
    node = level.find(u)
    some = node >= 0
    sorted_nodes = node[some]

    def spread(x: np.ndarray) -> np.ndarray:
        of_key = np.zeros(len(u), dtype=x.dtype)
        of_key[some] = x
        full = np.zeros(n, dtype=x.dtype)
        full[ok] = of_key[back]
        return full

    out.node[ok] = node[back]
    if len(levels) > k:
        if k + 1 < len(levels) or not values:
            out.first = spread(levels[k].first_child(sorted_nodes))
        if values:
            out.rest = spread(levels[k].rest(sorted_nodes))
    if values:
        out.score = spread(level.scores(sorted_nodes))
        if k == 1:
            out.count = spread(level.counts(sorted_nodes))
    return out


def _walk(levels: list[Level], h: np.ndarray, begin: np.ndarray, upto: int, values: bool) -> list[_Grams]:
    """For k = 1..upto the n-grams of k tokens that end at each place."""
    n = len(h)
    out = [_look_up(levels, 1, h, np.arange(n), n, values)]
    depth = _depth(begin, n)
    for k in range(2, upto + 1):
        ok = _extendable(out, depth, k)
        out.append(_look_up(levels, k, _child_keys(out, ok, k, levels[k - 1].bits), ok, n, values) if len(ok) and levels[k - 1].n else _Grams(n))
    return out


def _depth(begin: np.ndarray, n: int) -> np.ndarray:
    return np.arange(n) - np.repeat(begin[:-1], np.diff(begin))


def _extendable(grams: list[_Grams], depth: np.ndarray, k: int) -> np.ndarray:
    """Places where an n-gram of k tokens may end: both of its parts of k - 1 tokens are nodes."""
    last = grams[k - 2].node
    ok = np.flatnonzero((depth >= k - 1) & (last >= 0))
    return ok[last[ok - 1] >= 0] if len(ok) else ok


def _child_keys(grams: list[_Grams], ok: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Key (context, relative successor) of the n-grams of k tokens that end at places ok.

    For k = 2 the successor is the word; above, its place among the children of the context without its first word.
    """
    context = grams[k - 2].node[ok - 1].astype(np.uint64) << np.uint64(bits)
    child = grams[k - 2].node[ok]
    return context | (child if k == 2 else child - grams[k - 3].first[ok - 1]).astype(np.uint64)


# --- counting --------------------------------------------------------------------------------------


def _squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes under zstd, without the planes above the greatest."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8")[:, 0]


def _seats(spark, n: int) -> list[int]:
    """n numbers that hash partitioning deals to n different partitions, by partition."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, 64 + 40 * n, 1, 1).groupBy(part.alias("p")).agg(F.min("id").alias("id")).collect()  # at most n rows
    seats = {r["p"]: r["id"] for r in found}
    rest = iter(range(64 + 40 * n, 64 + 41 * n))
    return [seats.get(p, None) if p in seats else next(rest) for p in range(n)]


def _cuts(docs: DataFrame, keys, n: int, total: int) -> np.ndarray:
    """Up to n - 1 keys that part a level into shards of about one size, from the n-grams of about SAMPLE of its total tokens."""
    rate = min(1.0, SAMPLE / max(1, total))
    # Whole documents are drawn, by a hash of their text, and of those a share of the n-grams; it decides sizes of files only.
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, 16 * rate) * (1 << 20)) + 1)
    every = max(1, int(min(1.0, 16 * rate) / rate))

    def draw(batches):
        for _, texts in _windows(batches):
            key = np.unique(keys(texts))
            key = key[mix(key) % np.uint64(every) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    drawn = np.sort(some.mapInArrow(draw, "key long").toArrow().column("key").to_numpy().view(np.uint64))  # about SAMPLE numbers
    return np.unique(drawn[np.arange(1, n) * len(drawn) // n]) if len(drawn) else np.zeros(0, np.uint64)


_SHARD = "part int, file string, lo long, first long, last long, n long, widest long, first_n long, last_n long, first_sum double, last_sum double, total long"
_SHARD_SCHEMA = pa.schema([(f.split()[0], {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in _SHARD.split(", ")])


def _build(docs: DataFrame, keys, least: int, cuts: np.ndarray, directory: str, k: int, bits: int) -> list[dict]:
    """Counts the keys of all texts, writes the key files of level k and returns its shards, a row for each.

    keys(texts) gives all keys of some texts. Every window counts its own and sends them, sorted and packed, as one row for each shard;
    one shuffle brings them together. A task folds the rows of a shard by merging sorted runs and writes its file.
    """
    spark = docs.sparkSession
    n = len(cuts) + 1
    seats = _seats(spark, max(n, shuffle_partitions(spark)))[:n]
    number = {seat: i for i, seat in enumerate(seats)}
    schema = pa.schema([("seat", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def send(batches):
        for _, texts in _windows(batches):
            key, count = np.unique(keys(texts), return_counts=True)
            edges = [0, *np.searchsorted(key, cuts).tolist(), len(key)]
            rows = []
            for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    rows.append({"seat": seats[i], "base": int(key[a]), "keys": _squeeze(np.diff(key[a:b])), "counts": _squeeze(count[a:b].astype(np.uint64))})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def gather(batches):
        from pyspark import TaskContext

        keep("lm", _OPEN.clear)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list] = {}

        def fold(seat):
            parts = waiting.pop(seat) + ([held.pop(seat)] if seat in held else [])
            key, count = np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts])
            order = np.argsort(key, kind="stable")  # merges the sorted runs
            key, count = key[order], count[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            held[seat] = key[first], np.add.reduceat(count, first)

        for batch in batches:
            for row in batch.to_pylist():
                key = np.concatenate(([np.uint64(0)], np.cumsum(_expand(row["keys"])))) + np.uint64(row["base"])
                waiting.setdefault(row["seat"], []).append((key, _expand(row["counts"]).astype(np.int64)))
                if sum(len(x) for x, _ in waiting[row["seat"]]) > max(400_000, len(held[row["seat"]][0]) if row["seat"] in held else 0):
                    fold(row["seat"])
        for seat in list(waiting):
            fold(seat)
        rows = []
        for seat in sorted(held):
            key, count = held.pop(seat)
            key, count = key[count >= least], count[count >= least]
            if not len(key):
                continue
            part = number[seat]
            file = f"level{k}-{part:06d}"
            parts, head = {"keys": EliasFano.encode(key), **Counts.encode(count)}, {"n": len(key)}
            row = dict.fromkeys(("first", "last", "widest", "first_n", "last_n"), 0) | {"first_sum": 0.0, "last_sum": 0.0}
            if k > 1:
                context = (key >> np.uint64(bits)).astype(np.int64)
                lo, hi = int(context[0]), int(context[-1])
                per = np.bincount(context - lo, minlength=hi - lo + 1)
                parts["pointers"] = EliasFano.encode(np.concatenate(([0], np.cumsum(per))))
                kept = np.bincount(context - lo, count - DISCOUNT, hi - lo + 1)
                head |= {"first": lo, "contexts": hi - lo + 1}
                row = {"first": lo, "last": hi, "widest": int(per.max()), "first_n": int(per[0]), "last_n": int(per[-1]), "first_sum": float(kept[0]), "last_sum": float(kept[-1])}
            put(f"{directory}/{file}.keys", _pack(head, parts), TaskContext.get().taskAttemptId())
            rows.append({"part": part, "file": file, "lo": int(key[0]), "n": len(key), "total": int(count.sum()), **row})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SHARD_SCHEMA)
        tidy()

    sent = docs.mapInArrow(send, "seat int, base long, keys binary, counts binary")
    met = sent.repartition(max(n, shuffle_partitions(spark)), "seat")
    shards = [r.asDict() for r in materialize(met.mapInArrow(gather, _SHARD), f"level{k}").orderBy("part").collect()]  # a row for each file
    base = 0
    for s in shards:
        s["base"] = base
        base += s["n"]
    # A context may go on over several shards; its sums are those of all of them.
    sums: dict[int, float] = {}
    children: dict[int, int] = {}
    for s in shards:
        for c in {s["first"], s["last"]}:
            sums[c] = sums.get(c, 0.0) + (s["first_sum"] if c == s["first"] else s["last_sum"])
            children[c] = children.get(c, 0) + (s["first_n"] if c == s["first"] else s["last_n"])
    for s in shards:
        s["first_sum"], s["last_sum"] = sums[s["first"]], sums[s["last"]]
        s["widest"] = max(s["widest"], children[s["first"]], children[s["last"]])
    return shards


def _write_values(spark, directory: str, levels: list[tuple[list[dict], int]], k: int, total: int) -> None:
    """Writes the value files of level k, a task for each shard; the levels before have theirs."""

    def write(batches):
        from pyspark import TaskContext

        below = [Level(directory, *x) for x in levels]
        level = below[k - 1]
        for batch in batches:
            for i in batch.column("shard").to_pylist():
                keys, _, counts, head = level._shard(i, "keys")
                n = counts[np.arange(keys.n)].astype(np.float64)
                if k == 1:
                    score, rest = np.log10((n + 1) / (total + level.n + 1)), np.zeros(1)
                else:
                    key = keys.all()
                    context = (key >> np.uint64(level.bits)).astype(np.int64) - head["first"]
                    child = (key & np.uint64((1 << level.bits) - 1)).astype(np.int64)
                    every = np.arange(head["first"], head["first"] + head["contexts"])
                    kept = np.bincount(context, n - DISCOUNT, head["contexts"])
                    kept[0], kept[-1] = level.shards[i]["first_sum"], level.shards[i]["last_sum"]
                    seen = below[k - 2].counts(every)
                    left = np.clip(1 - kept / np.maximum(1, seen), 1e-9, 1)
                    if k > 2:  # the same word after the shorter context
                        middle = (below[k - 2].keys(every) & np.uint64((1 << below[k - 2].bits) - 1)).astype(np.int64)
                        child = child + _sorted_unique(middle, below[k - 2].first_child)[context]
                    lower = 10 ** _sorted_unique(child, below[k - 2].scores)
                    score, rest = np.log10((n - DISCOUNT) / seen[context] + left[context] * lower), np.log10(left)
                codes, book = quantise(score)
                rest_codes, rest_book = quantise(rest)
                put(f"{directory}/{level.shards[i]['file']}.values", _pack({}, {"codes": codes.tobytes(), "book": book.astype("<f4").tobytes(), "rest_codes": rest_codes.tobytes(), "rest_book": rest_book.astype("<f4").tobytes()}), TaskContext.get().taskAttemptId())
            yield batch

    n = len(levels[k - 1][0])
    if n:
        materialize(spark.range(0, n, 1, n).withColumnRenamed("id", "shard").mapInArrow(write, "shard long"), "values")


def train(docs: DataFrame, order: int = ORDER, least: int = LEAST, directory: str | None = None) -> dict:
    """Builds the trie over docs(doc_id, text); returns what `score` needs: directory, levels, train_tokens."""
    if order not in (1, 2, 3):
        raise ValueError("order 1, 2 or 3")
    spark = docs.sparkSession
    directory = directory or new_path(spark, "trie")
    docs = docs.select("doc_id", F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = lambda tokens, each: max(1, min(shuffle_partitions(spark), -(-tokens // each)))
    n = shards(size // 6, 4 * SHARD)  # words repeat more than longer n-grams
    even = np.array([i * (1 << 63) // n for i in range(1, n)], dtype=np.uint64)  # words have hashes of 63 bits
    words = _build(docs, lambda texts: token_hashes(texts)[0], 1, even, directory, 1, 0)
    total, levels = sum(s["total"] for s in words), [(words, 0)]
    _write_values(spark, directory, levels, 1, total)
    for k in range(2, order + 1):
        before = levels[-1][0]
        nodes = sum(s["n"] for s in before)
        widest = nodes if k == 2 else max((s["widest"] for s in before), default=1)
        bits = max(1, int(widest).bit_length())
        if nodes.bit_length() + bits > 63:
            raise ValueError("keys of this level need more than 63 bits")

        def keys(texts, levels=tuple(levels), k=k, bits=bits):
            opened = _opened(directory, list(levels))
            h, begin = token_hashes(texts)
            grams = _walk(opened, h, begin, k - 1, False)
            ok = _extendable(grams, _depth(begin, len(h)), k)
            return _child_keys(grams, ok, k, bits) if len(ok) else np.zeros(0, np.uint64)

        levels.append((_build(docs, keys, least, _cuts(docs, keys, shards(total, SHARD), total), directory, k, bits), bits))
        _write_values(spark, directory, levels, k, total)
    return {"directory": directory, "levels": levels, "train_tokens": total}


_OPEN: dict[tuple[str, int], list[Level]] = {}


def _opened(directory: str, levels: list) -> list[Level]:
    if (directory, len(levels)) not in _OPEN:
        _OPEN.clear()
        _OPEN[directory, len(levels)] = [Level(directory, *x) for x in levels]
    return _OPEN[directory, len(levels)]


def score_texts(levels: list[Level], total: int, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of every text."""
    h, begin = token_hashes(texts)
    grams = _walk(levels, h, begin, len(levels), True)
    size = total + levels[0].n + 1
    known = grams[0].node >= 0
    base = np.log10((np.where(known, grams[0].count, 0) + 1) / size)
    score = np.where(known, grams[0].score, base)
    depth = _depth(begin, len(h))
    for k in range(2, len(levels) + 1):
        before, here = grams[k - 2], grams[k - 1]
        context = np.zeros(len(h), dtype=bool)
        context[1:] = before.node[:-1] >= 0
        context &= depth >= k - 1
        found = here.node >= 0
        cut = np.flatnonzero(context & ~found)
        if len(cut) and before.rest is not None:
            score[cut] += before.rest[cut - 1]
        if found.any():
            score[found] = here.score[found]
    add = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[begin])
    return np.diff(begin), add(known).astype(np.int64), add(base), add(score)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of docs(doc_id, text)."""
    directory, total = model["directory"], model["train_tokens"]
    levels = docs.sparkSession.sparkContext.broadcast(model["levels"])  # a row for each file
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def run(batches):
        opened = _opened(directory, levels.value)
        for ids, texts in _windows(batches):
            n, known, base, own = score_texts(opened, total, texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(own)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """Trains on the documents that aren't held out (crc32(doc_id) mod 7 is 2) and scores all."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    model = train(docs.where(~held), order, least)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
