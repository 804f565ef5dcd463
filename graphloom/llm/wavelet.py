"""Token-id files as wavelet matrices: encode documents, write one compressed file per shard, read tokens back from the files.

A file holds the ids of some consecutive documents as bit-planes, most significant bit first, each plane in the order that a stable
sort by the planes above leaves. Rank and select on the planes give access to any token, counts of a token in any range, and the
places where it occurs, without decoding the rest: ranks of every 512 bits and samples for select are stored beside each plane, and files
are memory-mapped.

Defined cases: a null or empty text has only the end id; equal doc_ids are ordered by text and keep one row each; a null doc_id comes
first; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, materialize, new_path, put, shuffle_partitions
from .encoding import encoder, public_path

MAGIC = b"GLWM2\0\0\0"
_WORD = 512  # bits between two stored ranks
_SAMPLE = 4096  # ones, or zeros, between two stored samples


class WaveletMatrix:
    """Succinct sequence of whole numbers: access, rank, select, count, occurrences, decode.

    The planes hold codes: the values that occur, most frequent first. So high planes are nearly empty, and no plane stands for values
    that a file doesn't have.
    """

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], symbols: np.ndarray, ranks: list[np.ndarray] | None = None, selects: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.n, self.planes, self.zeros, self.symbols = n, planes, zeros, symbols
        self.ranks = [self._directory(p) for p in planes] if ranks is None else ranks
        self.selects = [self._samples(r, n) for r in self.ranks] if selects is None else selects
        self._codes: dict[int, int] | None = None

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """The ones before every _WORD bits of a plane, and all of them."""
        padded = np.zeros(-(-len(plane) * 8 // _WORD) * (_WORD // 8), dtype=np.uint8)
        padded[: len(plane)] = plane
        each = np.bitwise_count(padded).reshape(-1, _WORD // 8).sum(1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(each))).astype("<u4")

    @staticmethod
    def _samples(rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a plane in which its zeros, and its ones, number 0, _SAMPLE, 2 * _SAMPLE ... stand."""
        ones = rank.astype(np.int64)
        before = (np.minimum(np.arange(len(ones)) * _WORD, n) - ones, ones)
        return tuple((np.searchsorted(x, np.arange(0, x[-1], _SAMPLE), "right") - 1).astype("<u4") for x in before)

    def code(self, value: int) -> int:
        """The code of a value, -1 where it doesn't occur."""
        if self._codes is None:
            self._codes = {int(v): i for i, v in enumerate(self.symbols)}
        return self._codes.get(value, -1)

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        values = np.asarray(values, dtype=np.uint32)
        count = np.bincount(values) if len(values) else np.zeros(1, np.int64)
        symbols = np.argsort(-count, kind="stable")[: np.count_nonzero(count)].astype(np.uint32)
        codes = np.zeros(len(count), dtype=np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        codes[symbols] = np.arange(len(symbols))
        rest = codes[values]
        other = np.empty_like(rest)
        planes, zeros = [], []
        for level in range(max(0, len(symbols) - 1).bit_length() - 1, -1, -1):
            bit = (rest & rest.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit))
            ones = int(np.count_nonzero(bit))
            zeros.append(len(rest) - ones)
            if level and ones:
                np.compress(~bit, rest, out=other[: zeros[-1]])
                np.compress(bit, rest, out=other[zeros[-1] :])
                rest, other = other, rest
        return cls(len(values), planes, zeros, symbols)

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane: a stored rank and the bits of one word."""
        block, byte = i // _WORD, i // 8
        plane = self.planes[level]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(plane[block * (_WORD // 8) : byte]).sum())
        return ones + (int(plane[byte]) >> (8 - i % 8)).bit_count() if i % 8 else ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.symbols[value])

    def _span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """The range of the last order that holds value's occurrences among places lo:hi."""
        value = self.code(value)
        if value < 0:
            return 0, 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before place i."""
        lo, hi = self._span(value, 0, min(i, self.n))
        return hi - lo

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._span(value, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane: bisection between two stored samples."""
        words = self.selects[level][bit]
        lo = int(words[k // _SAMPLE]) * _WORD
        hi = min(self.n, (int(words[k // _SAMPLE + 1]) + 1) * _WORD) if k // _SAMPLE + 1 < len(words) else self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value; -1 if there are fewer."""
        lo, hi = self._span(value, 0, self.n)
        if k >= hi - lo:
            return -1
        i, code = lo + k, self.code(value)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = code >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All values in order, plane by plane from the last."""
        out = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            z = self.zeros[level]
            if z == self.n:
                continue
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty_like(out)
            back[~bit] = out[:z]
            back[bit] = out[z:] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = back
        return self.symbols[out] if self.n else np.zeros(0, np.uint32)


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """One file: a header, the document table under zstd, then the planes with their ranks and samples as they are, so that a mapped file
    answers from the pages that a question touches."""
    table = zstandard.ZstdCompressor(level=1).compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + known.astype(np.uint8).tobytes())
    parts = [table, matrix.symbols.astype("<u4").tobytes()]
    for plane, rank, (zeros, ones) in zip(matrix.planes, matrix.ranks, matrix.selects, strict=True):
        parts += [plane.tobytes(), rank.astype("<u4").tobytes(), zeros.astype("<u4").tobytes(), ones.astype("<u4").tobytes()]
    head = json.dumps({"n": matrix.n, "docs": len(lengths), "zeros": matrix.zeros, "sizes": [len(p) for p in parts]}).encode()
    head += b" " * (-len(head) % 8)
    return MAGIC + struct.pack("<q", len(head)) + head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)


def open_file(data: np.ndarray) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, doc_ids, whether each is known, tokens of each) of a file's bytes; of the planes nothing is read or copied."""
    if data[:8].tobytes() != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack("<q", data[8:16].tobytes())
    head, at, parts = json.loads(data[16 : 16 + size].tobytes()), 16 + size, []
    for n in head["sizes"]:
        parts.append(data[at : at + n])
        at += n + -n % 8
    table, docs = zstandard.ZstdDecompressor().decompress(parts[0].tobytes()), head["docs"]
    ids, lengths, known = np.frombuffer(table, "<i8", docs), np.frombuffer(table, "<i8", docs, 8 * docs), np.frombuffer(table, np.uint8, docs, 16 * docs).astype(bool)
    of = [parts[i : i + 4] for i in range(2, len(parts), 4)]
    matrix = WaveletMatrix(head["n"], [p[0] for p in of], head["zeros"], parts[1].view("<u4"), [p[1].view("<u4") for p in of], [(p[2].view("<u4"), p[3].view("<u4")) for p in of])
    return matrix, ids, known, lengths


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, kind: str = "byte", end_id: int = 0, file_tokens: int = 2_000_000) -> DataFrame:
    """Encodes docs(doc_id, text) in doc_id order and writes the files; returns the manifest (part, seq, file, docs, tokens), already run.

    A partition of the range sort writes its files one after another, so a file holds about file_tokens ids and memory stays bounded
    by it and by the longest document. A task that runs again writes the same bytes to the same names.
    """

    def write(batches):
        from pyspark import TaskContext

        part, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        encode = encoder(kind, tokenizer)
        ids, doc_ids, known, lengths, held = [], [], [], [], 0

        def flush():
            matrix = WaveletMatrix.build(np.concatenate(ids))
            name = f"{part:06d}-{seq:05d}.wm"
            data = to_bytes(matrix, np.array(doc_ids, dtype=np.int64), np.array(known), np.concatenate(lengths))
            put(f"{directory}/{name}", data, attempt)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "docs": len(doc_ids), "tokens": matrix.n}], schema=_MANIFEST)

        for batch in batches:
            rows = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for at in range(0, len(rows), 256):
                part_ids = rows[at : at + 256]
                flat, begin = encode([t or "" for t in texts.slice(at, 256).to_pylist()])
                whole = np.insert(flat, begin[1:], end_id).astype(np.uint32)
                ids.append(whole)
                lengths.append(np.diff(begin) + 1)
                doc_ids += [d or 0 for d in part_ids]
                known += [d is not None for d in part_ids]
                held += len(whole)
                if held >= file_tokens:
                    yield flush()
                    ids, doc_ids, known, lengths, held, seq = [], [], [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "part int, seq int, file string, docs long, tokens long"), "manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def with_starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """Adds base: the ids in all files before. Two prefix sums, over files in a group of parts and over groups, so no window holds all files."""
    grouped = manifest.withColumn("g", F.floor(F.col("part") / group))
    sums = grouped.groupBy("g").agg(F.sum("tokens").alias("all"))
    before = sums.select("g", F.coalesce(F.sum("all").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g_base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("g").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("inside", inside).join(before, "g").select(*manifest.columns, (F.col("g_base") + F.col("inside")).alias("base"))


def read_token_files(manifest: DataFrame, directory: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. manifest has base."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix, doc_ids, known, lengths = open_file(mapped(f"{directory}/{row['file']}"))
                data = memoryview(matrix.decode().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~known), pa.array(ends - lengths + row["base"]), pa.array(lengths), pa.array(crc, pa.int64())], schema=schema)

    n = shuffle_partitions(manifest.sparkSession)
    return manifest.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str | None = None, kind: str = "byte", end_id: int = 0, directory: str | None = None) -> DataFrame:
    """Writes docs to token files and returns what the files hold per document."""
    directory = directory or new_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, directory, tokenizer or public_path("byte_bpe_50k.json"), kind, end_id)
    return read_token_files(with_starts(manifest), directory)
