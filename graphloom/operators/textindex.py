"""A full-text index that changes without being rewritten.

Every change is a new segment: the changed documents, their postings, and the ids whose earlier postings it supersedes. A manifest, a
table with a row for each segment, moves the readers on; it also holds the sums of lengths, so a search counts nothing over documents.
A search reads from each segment only the buckets of its terms and leaves out what a later segment supersedes. Segments are merged from
the newest back as soon as one isn't much larger than all newer ones together, so their number grows with the logarithm of the input and
a document is rewritten as often at most; merging copies live postings and never cuts a text again.

Postings are stored as a row for each document, field and bucket, with the terms and their counts as arrays. Tasks write to all folders
what they read, so neither texts nor postings are shuffled; they read as few at once that a segment has a bounded number of files.

One writer at a time; readers see whole segments. What a lost writer leaves is named in no manifest, and `vacuum` removes it. With `keep`
every change ends with that, so that no more than the live segments and those of one merge are stored at any time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .search import FIELDS, _length, best_each, bm25, tokens
from .tables import Store, latest

BUCKETS = 32  # folders of postings by term and of documents by id; more for larger input
WRITERS = 4  # tasks that write a segment: a fourth of the shuffle partitions, and at least all cores
LOOKUP = 1_000_000  # ids that go to every task, in place of the texts or postings going to the ids
CODEC = "zstd"  # of segments, which are stored for long
MERGE_AT = 4.0  # a segment merges with the newer ones where it has at most so many times their rows
MANIFEST = "seg long, path string, docs long, gone long, batch long, buckets int, schema string, totals array<struct<docs:long,tokens:long>>"


def _bucket(column: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _runs(words: Column) -> Column:
    """array<struct<term, tf>> of sorted words: one for each run of equal ones."""

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        cut = lambda s: F.transform(s, lambda x, k: F.struct(F.get(w, x - 1).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w) + 1) - x).alias("tf")))
        return _bound(starts, cut)

    return _bound(F.when(F.size(words) > 0, words), of)


def _by_bucket(runs: Column, buckets: int) -> Column:
    """array<struct<bucket, terms, tfs>> of runs of terms: one for each bucket that they reach."""

    def of(r: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (i == 1) | (F.get(r, i - 1)["bucket"] != F.get(r, i - 2)["bucket"]))

        def cut(s: Column) -> Column:
            part = lambda x, k: F.slice(r, x, F.coalesce(F.get(s, k + 1), F.size(r) + 1) - x)
            return F.transform(s, lambda x, k: F.struct(F.get(r, x - 1)["bucket"].alias("bucket"), part(x, k)["term"].alias("terms"), part(x, k)["tf"].alias("tfs")))

        return _bound(starts, cut)

    return _bound(F.sort_array(F.transform(runs, lambda r: F.struct(_bucket(r["term"], buckets).alias("bucket"), r["term"].alias("term"), r["tf"].alias("tf")))), of)


def _bound(value: Column, use) -> Column:
    """use(value), with the value bound as a lambda's variable, so that it is taken once and not for each element; null stays null."""
    return F.get(F.transform(F.filter(F.array(value), lambda v: v.isNotNull()), use), F.lit(0))


class TextIndex:
    """Documents by id_column with text fields that have weights.

    Rows without an id take no part. The columns of the first documents are the index's: of later ones further columns are left out and
    missing ones are null. Empty and null fields have no postings; null ones don't count for a field's mean length.
    """

    def __init__(self, store: Store, fields: dict[str, float] = FIELDS, id_column: str = "node_id", table: str = "text", buckets: int = BUCKETS, merge_at: float | None = MERGE_AT, keep: int | None = None):
        """keep: after each change only segments that so many manifests name stay, for readers that don't last longer; without it all, until `vacuum`."""
        self.store, self.fields, self.id, self.table, self.merge_at, self.keep = store, fields, id_column, table, merge_at, keep
        held = self._segments()
        self.buckets = held[0]["buckets"] if held else buckets

    # --- reads ---

    def _segments(self) -> list[dict]:
        """The manifest's rows, oldest first; few, as segments merge."""
        return sorted((r.asDict(recursive=True) for r in self.store.read(self.table).collect()), key=lambda r: r["seg"]) if self.store.exists(self.table) else []

    def _schema(self, held: list[dict]) -> StructType:
        import json

        return StructType.fromJson(json.loads(held[0]["schema"]))

    def _read(self, held: list[dict], what: str, schema: str, where: Column | None = None) -> DataFrame:
        """The rows of one kind of all given segments, with the segment's number."""
        out = None
        for s in held:
            rows = self.store.spark.read.schema(schema).parquet(f"{s['path']}/{what}")
            rows = (rows if where is None else rows.where(where)).withColumn("seg", F.lit(s["seg"]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _id_type(self, held: list[dict]) -> str:
        return self._schema(held)[self.id].dataType.simpleString()

    def _live(self, rows: DataFrame, held: list[dict]) -> DataFrame:
        """rows(id, seg) that no later one of the segments supersedes."""
        later = [s for s in held if s["gone"]]
        if not later:
            return rows
        last = self._looked_up(self._read(later, "gone", f"id {self._id_type(held)}").groupBy("id").agg(F.max("seg").alias("_last")), sum(s["gone"] for s in later))
        return rows.join(last, "id", "left").where("_last is null or seg >= _last").drop("_last")

    def _looked_up(self, ids: DataFrame, n: int) -> DataFrame:
        """ids, of which there are at most n, as the small side of a join where they are few enough."""
        return F.broadcast(ids) if n <= LOOKUP else ids

    def _documents(self, held: list[dict], ids: DataFrame | None) -> DataFrame:
        """id, bucket, lens, doc, seg of live documents; with ids(id) only theirs, read from their buckets."""
        full, where = [s for s in held if s["docs"]] or held[:1], None
        if ids is not None:
            ids = ids.select("id", _bucket("id", self.buckets).alias("bucket")).distinct()
            count = ids.groupBy("bucket").count().collect()  # at most as many rows as buckets
            where, ids = F.col("bucket").isin([r[0] for r in count]), self._looked_up(ids, sum(r[1] for r in count))
        rows = self._read(full, "docs", f"id {self._id_type(held)}, lens array<int>, doc {self._schema(held).simpleString()}, bucket int", where)
        return self._live(rows if ids is None else rows.join(ids, ["bucket", "id"], "left_semi"), held)

    def documents(self) -> DataFrame:
        """The documents as they are now."""
        return self._documents(self._segments(), None).select("doc.*")

    def lengths(self) -> dict[str, float]:
        """What `search.bm25` needs to know of all documents, from the manifest alone."""
        totals = [s["totals"] for s in self._segments()]
        of = [(sum(t[i]["docs"] for t in totals), sum(t[i]["tokens"] for t in totals)) for i in range(len(self.fields) + 1)]
        return {f: tokens / docs if docs else 0.0 for f, (docs, tokens) in zip(self.fields, of, strict=False)} | {"docs": of[-1][0]}

    def postings(self, terms: DataFrame) -> DataFrame:
        """term, field, id, tf, len of live postings of terms(term)."""
        held = self._segments()
        if not held:
            raise ValueError(f"nothing was written to the index {self.table} yet")
        keys = terms.select(F.lower("term").alias("term")).where("term is not null").distinct().withColumn("bucket", _bucket("term", self.buckets))
        where = F.col("bucket").isin([r[0] for r in keys.select("bucket").distinct().collect()])
        rows = self._read([s for s in held if s["docs"]] or held[:1], "postings", self._posting(held), where)
        rows = rows.select("*", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("id", "seg", "field", "len", "bucket", "p.terms", F.col("p.tfs").cast("long").alias("tf")).withColumnRenamed("terms", "term")
        return self._live(rows.join(keys, ["bucket", "term"], "left_semi"), held).select("term", "field", "id", "tf", "len")

    def search(self, terms: DataFrame, k: int) -> DataFrame:
        """The k best documents of every query of terms(qid, term) by BM25: qid, id, score, rank, rank_score."""
        return best_each(bm25(self.postings(terms), None, terms, self.fields, lengths=self.lengths()), k)

    def _posting(self, held: list[dict]) -> str:
        return f"id {self._id_type(held)}, field string, len int, terms array<string>, tfs array<int>, bucket int"

    # --- changes ---

    def upsert(self, docs: DataFrame, batch: int | None = None) -> None:
        """Adds documents, or puts them in the place of those with the same id. Of rows of one id that with the greatest hash of its columns counts."""
        rows = docs.where(F.col(self.id).isNotNull())
        self._write(self._last(rows, [F.xxhash64(*rows.columns)]), rows.select(F.col(self.id).alias("id")), batch)

    def _last(self, rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
        """The last row of every id. Only texts whose id comes more than once are moved; which these are, the ids alone tell."""
        several = rows.groupBy(self.id).count().where("count > 1").select(self.id)
        n = several.count()
        if not n:
            return rows
        if n > LOOKUP:
            return latest(rows, [self.id], order)
        several = F.broadcast(several)
        return rows.join(several, self.id, "left_anti").unionByName(latest(rows.join(several, self.id, "left_semi"), [self.id], order))

    def update(self, changes: DataFrame, create: bool = False, batch: int | None = None) -> None:
        """Changes the fields that aren't null in changes; unknown ids are ignored, or with create made. Rows of one id as in `upsert`."""
        rows = changes.where(F.col(self.id).isNotNull())
        new = latest(rows, [self.id], [F.xxhash64(*rows.columns)]).select(F.col(self.id).alias("id"), F.struct(*rows.columns).alias("new"))
        held = self._segments()
        if not held:
            return self.upsert(changes, batch) if create else None
        old = self._documents(held, new.select("id")).select("id", "doc")
        value = lambda f: F.coalesce(f"new.{f.name}", f"doc.{f.name}") if f.name in rows.columns else F.col(f"doc.{f.name}")
        merged = new.join(old, "id", "left" if create else "inner")
        self._write(merged.select(*(value(f).alias(f.name) for f in self._schema(held))), new.select("id"), batch)

    def delete(self, ids: DataFrame, batch: int | None = None) -> None:
        """Removes the documents of ids(id_column); unknown ones are ignored."""
        self._write(None, ids.select(F.col(self.id).alias("id")).where("id is not null"), batch)

    def apply(self, changes: DataFrame, order: Sequence[str], deleted: str = "deleted", batch: int | None = None) -> None:
        """Upserts and deletions in one segment: of an id's changes the last by the order counts; where deleted is true it goes."""
        last = self._last(changes.where(F.col(self.id).isNotNull()), order)
        gone = F.coalesce(deleted, F.lit(False))
        self._write(last.where(~gone).drop(deleted), last.select(F.col(self.id).alias("id")), batch)

    def _write(self, docs: DataFrame | None, ids: DataFrame, batch: int | None) -> None:
        """A segment of docs (an id once) that supersedes the live documents of ids. A batch that was written before is left out."""
        held = self._segments()
        if batch is not None and any(s["batch"] is not None and s["batch"] >= batch for s in held):
            return
        if docs is None and not held:
            return
        path = f"{self.store.path}/{self.store.slug}/{self.table}_segments/{uuid.uuid4().hex}"
        schema = self._schema(held) if held else docs.schema
        kind = schema[self.id].dataType.simpleString()
        totals, written, gone = self._totals(None), 0, 0
        if held:  # with the lengths that go, so that the lookup is made once
            self._documents(held, ids.select(F.col("id").cast(kind))).select("id", "lens").write.parquet(f"{path}/gone")
            gone, totals = self._counted(f"{path}/gone", kind, -1)
        if docs is not None:
            self._write_documents(path, docs.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)))
            written, more = self._counted(f"{path}/docs", kind, 1)
            totals = [{k: a[k] + b[k] for k in a} for a, b in zip(totals, more, strict=True)]
            if written or not held:
                self._write_postings(path, self._cut(path, kind, schema))
        seg = {"seg": held[-1]["seg"] + 1 if held else 0, "path": path, "docs": written, "gone": gone, "batch": batch, "buckets": self.buckets, "schema": schema.json(), "totals": totals}
        self._commit([*held, seg])
        if self.merge_at is not None:
            self.merge(self.merge_at)
        if self.keep is not None:
            self.vacuum(self.keep)

    def _totals(self, row) -> list[dict]:
        """Documents and tokens of every field, then documents as such."""
        return [{"docs": int(row[f"n{i}"] or 0) if row else 0, "tokens": int(row[f"t{i}"] or 0) if row else 0} for i in range(len(self.fields) + 1)]

    def _counted(self, path: str, kind: str, sign: int) -> tuple[int, list[dict]]:
        rows, n = self.store.spark.read.schema(f"id {kind}, lens array<int>").parquet(path), len(self.fields)
        each = [x for i in range(n) for x in (F.count(F.col("lens")[i]).alias(f"n{i}"), F.sum(F.col("lens")[i]).alias(f"t{i}"))]
        row = rows.agg(*each, F.count("*").alias(f"n{n}"), F.lit(0).alias(f"t{n}")).first()
        return row[f"n{n}"], [{k: sign * v for k, v in t.items()} for t in self._totals(row)]

    def _write_documents(self, path: str, docs: DataFrame) -> None:
        lens = F.array(*(_length(F.col(f)).cast("int") for f in self.fields))
        rows = docs.select(F.col(self.id).alias("id"), lens.alias("lens"), F.struct(*docs.columns).alias("doc")).withColumn("bucket", _bucket("id", self.buckets))
        self._few(rows).write.option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/docs")

    def _few(self, rows: DataFrame) -> DataFrame:
        """rows in fewer partitions, without a shuffle, as each task writes a file to the folder of every bucket."""
        spark = self.store.spark
        return rows.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // WRITERS))

    def _cut(self, path: str, kind: str, schema: StructType) -> DataFrame:
        """Postings of a segment's documents. A document is there once, so its tokens are counted within its row: sorted, then by runs."""
        docs = self.store.spark.read.schema(f"id {kind}, lens array<int>, doc {schema.simpleString()}").parquet(f"{path}/docs")

        def of(i: int, field: str) -> Column:
            runs = _by_bucket(_runs(F.sort_array(tokens(F.col(f"doc.{field}")))), self.buckets)
            return F.transform(runs, lambda r: F.struct(F.lit(field).alias("field"), F.col("lens")[i].alias("len"), r["terms"].alias("terms"), r["tfs"].alias("tfs"), r["bucket"].alias("bucket")))

        all_fields = [of(i, field) for i, field in enumerate(self.fields)]
        # All fields in one pass, so that the longest one's work is dealt as the documents are.
        return docs.select("id", F.explode(F.flatten(F.filter(F.array(*all_fields), lambda x: x.isNotNull()))).alias("r")).select("id", "r.*")

    def _write_postings(self, path: str, posts: DataFrame) -> None:
        self._few(posts).write.option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/postings")

    def _commit(self, held: list[dict]) -> None:
        self.store.commit(self.table, self.store.spark.createDataFrame(held, MANIFEST).coalesce(1))

    def merge(self, at: float = float("inf")) -> int:
        """Makes one segment of the newest ones, as far back as a segment has at most `at` times the rows of all newer ones; without a
        limit of all. Gives how many were merged."""
        held = self._segments()
        size = [s["docs"] + s["gone"] for s in held]
        first = max(0, len(held) - 1)
        while first > 0 and size[first - 1] <= at * max(1, sum(size[first:])):
            first -= 1
        if len(held) - first < 2:
            return 0
        some, kept, kind = held[first:], held[:first], self._id_type(held)
        path = f"{self.store.path}/{self.store.slug}/{self.table}_segments/{uuid.uuid4().hex}"
        self._few(self._documents(some, None).drop("seg")).write.option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/docs")
        docs, _ = self._counted(f"{path}/docs", kind, 1)
        posts = self._read([s for s in some if s["docs"]], "postings", self._posting(held)) if any(s["docs"] for s in some) else None
        if posts is not None or not kept:
            self._write_postings(path, (self._read(some[:1], "postings", self._posting(held)) if posts is None else self._live(posts, some)).drop("seg"))
        gone = 0
        if kept and any(s["gone"] for s in some):  # what the merged ones supersede in those before them
            self._read([s for s in some if s["gone"]], "gone", f"id {kind}").select("id").distinct().write.parquet(f"{path}/gone")
            gone = self.store.spark.read.schema(f"id {kind}").parquet(f"{path}/gone").count()
        totals = [{k: sum(s["totals"][i][k] for s in some) for k in ("docs", "tokens")} for i in range(len(self.fields) + 1)]
        batch = max((s["batch"] for s in some if s["batch"] is not None), default=None)
        self._commit([*kept, some[-1] | {"path": path, "docs": docs, "gone": gone, "batch": batch, "totals": totals}])
        return len(some)

    def vacuum(self, keep: int = 2) -> int:
        """Removes segments that none of the last manifests names; gives their number. Readers of older manifests must have ended."""
        root = f"{self.store.path}/{self.store.slug}"
        fs, p = self.store._fs(f"{root}/{self.table}_segments")
        if not fs.exists(p):
            return 0
        named = set()
        for n, tag in self.store.versions(self.table)[-keep:]:
            named |= {r["path"].rsplit("/", 1)[-1] for r in self.store.spark.read.parquet(f"{root}/{self.table}/v{n}{'-' + tag if tag else ''}").select("path").collect()}
        old = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName() not in named]
        for path in old:
            fs.delete(path, True)
        return len(old)
