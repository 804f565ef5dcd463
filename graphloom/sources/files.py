"""Readers of note folders, attachments, spreadsheets and knowledge-base registries."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EMPTY = "[no extractable text]"


def note_folder(spark: SparkSession, path: str, manifest: str | None = None) -> DataFrame:
    """id, title, content of the Markdown notes of a folder, cleaned; with a manifest only those that it names, in its order (ord)."""
    raw = spark.read.text(f"{path}/*.md", wholetext=True).select(F.col("value"), F.input_file_name().alias("path"))
    out = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), T.file_title(F.col("path")).alias("title"), T.clean_note(F.col("value")).alias("content"))
    if manifest is None:
        return out
    cases = spark.read.json(manifest, multiLine=True).select(F.posexplode("test_cases").alias("c", "case"))
    names = cases.select("c", F.posexplode("case.notes").alias("n", "id")).groupBy("id").agg(F.min(F.struct("c", "n")).alias("ord"))
    return out.join(names, "id")


def _docx(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    line = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    paragraphs = [x for p in body.findall(f"{w}p") if (x := line(p))]
    rows = [" | ".join(line(c) for c in r.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")]
    return "\n".join([*paragraphs, *(r for r in rows if r.strip(" |"))])


def _xlsx(data: bytes) -> str:
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")]
    files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for name, file in zip(names, files, strict=False):
        out.append(f"=== Sheet: {name} ===")
        for row in ElementTree.fromstring(z.read(file)).iter(f"{m}row"):
            cells = []
            for c in row.iter(f"{m}c"):
                v = c.find(f"{m}v")
                text = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if text.strip():
                    cells.append(text.strip())
            if cells:
                out.append("\t".join(cells))
    return "\n".join(out)


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    return "\n".join(f"--- Page {i} ---\n{t}" for i, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1) if (t := (p.extract_text() or "").strip()))


def _delimited(data: bytes, sign: str) -> str:
    import csv

    rows = ([c.strip() for c in r if c.strip()] for r in csv.reader(io.StringIO(data.decode("utf-8", "replace")), delimiter=sign))
    return "\n".join("\t".join(r) for r in rows if r)


READERS = {"docx": _docx, "xlsx": _xlsx, "pdf": _pdf, "csv": lambda d: _delimited(d, ","), "tsv": lambda d: _delimited(d, "\t"), "txt": lambda d: d.decode("utf-8", "replace"), "md": lambda d: d.decode("utf-8", "replace")}


def file_text(name: str, data: bytes | None) -> str:
    """The text of a document; a fixed message where there is none or the kind isn't supported."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        return f"[unsupported file type: .{kind}]"
    try:
        return READERS[kind](data or b"").strip() or EMPTY
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeError, IndexError, ValueError):
        return EMPTY


def attachments(spark: SparkSession, path: str, describe=None, transcribe=None) -> DataFrame:
    """path, name, text of every file below a path. describe and transcribe take (name, bytes) of images and audio; without them a stub stands in."""

    def run(frames):
        for frame in frames:
            texts = []
            for p, data in zip(frame["path"], frame["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower()
                if kind in ("png", "jpg", "jpeg", "gif", "webp", "bmp"):
                    texts.append(describe(name, data) if describe else f"[image {name}, {len(data)} bytes]")
                elif kind in ("mp3", "m4a", "wav", "ogg", "webm", "flac", "aac"):
                    texts.append(transcribe(name, data) if transcribe else f"[audio {name}, {len(data)} bytes]")
                else:
                    texts.append(file_text(name, data))
            yield pd.DataFrame({"path": frame["path"], "name": [p.rsplit("/", 1)[-1] for p in frame["path"]], "text": texts})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, name string, text string")


def spreadsheet_rows(spark: SparkSession, path: str, sign: str = ",") -> DataFrame:
    """line: the non-empty cells of each row of delimited files, joined by tabs."""
    table = spark.read.option("header", "false").option("sep", sign).csv(path)
    cells = F.filter(F.array(*(F.trim(F.col(c)) for c in table.columns)), lambda x: x.isNotNull() & (x != ""))
    return table.select(F.array_join(cells, "\t").alias("line")).where("line <> ''")


def web_search(spark: SparkSession, query: str, max_results: int = 5) -> DataFrame:
    """The shape of web results; without a network there are none."""
    return spark.createDataFrame([], "text string, type string, title string, url string, rerank_score double")


def registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, name, slug, created_at of the knowledge bases of a registry file, and the default one before them."""
    default = spark.createDataFrame([("default", "Default", "default", None)], "id string, name string, slug string, created_at string")
    return default if path is None else default.unionByName(spark.read.schema(default.schema).json(path, multiLine=True))
