"""SentencePiece models on the tokenizers library: read the model protobuf, rebuild the tokenizer, encode, decode, verify.

Rebuilt are the normaliser (its compiled character map, white-space squeezing, the dummy prefix), the metaspace marker, the unigram scores
or the BPE merges that the scores imply, user-defined pieces, and byte fallback. Batches are encoded by the library's threads. `parity`
tells per document whether the sentencepiece library gives the same ids for its whole text.

Defined cases: null and empty texts have no ids and decode to ''; repeated rows keep one row each; an empty table gives none; further
columns are ignored. `round_trip` compares with the text as it stands, so a normaliser that changes a text makes it false.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .encoding import StretchEncoder, in_a_row, public_path

MARK = "▁"
# Kinds of pieces and models as the public protobuf schema numbers them.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def parse_model(path: str) -> dict:
    """pieces [(text, score, kind)], model_type, byte_fallback, add_dummy_prefix, remove_extra_whitespaces, normalizer of a model file."""
    out = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "add_dummy_prefix": True, "remove_extra_whitespaces": True, "normalizer": "", "charsmap": b""}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            out["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            out["model_type"], out["byte_fallback"] = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out |= {"normalizer": spec.get(1, b"").decode(), "charsmap": spec.get(2, b""), "add_dummy_prefix": bool(spec.get(3, 1)), "remove_extra_whitespaces": bool(spec.get(4, 1))}
    return out


def build_tokenizer(model: dict):
    """A tokenizers.Tokenizer for normalised text in which spaces are already metaspace marks."""
    from tokenizers import Tokenizer, decoders, models

    pieces = model["pieces"]
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if model["model_type"] == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in pieces], unknown, model["byte_fallback"])
    elif model["model_type"] == BPE:
        vocab = {t: i for i, (t, _, _) in enumerate(pieces)}
        score = {t: s for t, s, kind in pieces if kind in (NORMAL, USER)}
        merges = [(-s, i, t[:k], t[k:]) for t, s in score.items() for i in [vocab[t]] for k in range(1, len(t)) if t[:k] in score and t[k:] in score]
        merges.sort(key=lambda x: (x[0], x[1], vocab[x[2]], vocab[x[3]]))
        core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model type {model['model_type']}")
    t = Tokenizer(core)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return t


def build_normaliser(model: dict):
    """The function that a model applies to a text before its pieces: character map and white space, without prefix and marks."""
    from tokenizers import normalizers

    charsmap = normalizers.Precompiled(model["charsmap"]) if model["charsmap"] else None
    squeeze = re.compile(" {2,}").sub if model["remove_extra_whitespaces"] else None

    def normalise(text: str) -> str:
        if charsmap is not None:
            text = charsmap.normalize_str(text)
        return squeeze(" ", text).strip(" ") if squeeze else text

    return normalise


class Backend:
    """Encodes and decodes batches, and tells whether the sentencepiece library encodes whole texts alike."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = parse_model(path)
        self.prefix = MARK if self.model["add_dummy_prefix"] else ""
        self.normalise = build_normaliser(self.model)
        self.plain = not self.model["charsmap"] and not self.model["remove_extra_whitespaces"]
        self.tokenizer = build_tokenizer(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = all(MARK not in t.lstrip(MARK) for t, _, _ in self.model["pieces"])  # then no piece holds a mark behind another character
        self.encode = StretchEncoder(self._cut if whole else self._whole, self._learn, lead=MARK)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.surface = [bytes([int(m[1], 16)]) if kind == BYTE and (m := byte.fullmatch(t)) else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else t.replace(MARK, " ").encode() for t, _, kind in self.model["pieces"]]
        self.sizes = np.array([len(s) for s in self.surface])
        self.joined = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def _marked(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK)

    def _whole(self, text: str) -> list:
        text = self.normalise(text)
        return [(self._marked(text),)] if text else []

    def _cut(self, text: str) -> list:
        if not self.plain:
            text = self.normalise(text)
        if not text:
            return []
        if "  " in text or text[0] == " " or not self.prefix or MARK in text:
            return [(s,) for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", self._marked(text))]
        return text.split(" ")

    def _learn(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        return in_a_row([e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)])

    def parity(self, texts: list[str], flat: np.ndarray, begin: np.ndarray) -> list[bool]:
        """Whether the other library gives these ids for each whole text."""
        ids, other = in_a_row(self.other.encode(texts, num_threads=1))
        return [bool(n - m == y - x and (ids[m:n] == flat[x:y]).all()) for m, n, x, y in zip(other[:-1].tolist(), other[1:].tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids as UTF-8, without the space of the dummy prefix."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = self.joined[np.repeat(self.begin[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


_OPEN: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    keep("sentencepiece", _OPEN.clear)
    if path not in _OPEN:
        _OPEN[path] = Backend(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoded text equals the text), parity[, ids]."""
    model = model or public_path("piece_bpe_32k.model")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)

    def run(batches):
        b = backend(model)
        for batch in batches:
            rows, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                flat, begin = b.encode(part)
                raw = memoryview(flat.astype("<u4")).cast("B")
                edges = begin.tolist()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edges, edges[1:], strict=False)]
                same = [b.decode(flat[x:y]) == t.encode() for x, y, t in zip(edges, edges[1:], part, strict=False)]
                columns = [rows.slice(at, 256), pa.array(np.diff(begin)), pa.array(crc, pa.int64()), pa.array(same), pa.array(b.parity(part, flat, begin))]
                if with_ids:
                    columns.append(pa.array([flat[x:y].astype(np.int32) for x, y in zip(edges, edges[1:], strict=False)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids)
