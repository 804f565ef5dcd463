"""Secret scans in DataFrame functions only: fixed patterns plus character Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns. Beside them, every long run of identifier characters is scored by the mean log-likelihood ratio of
its character pairs under two Markov models, trained from labelled samples: random strings are the base secrets of the sample documents
and digests of numbers in hex and base64; ordinary identifiers are the other, shorter words of the sample documents and a fixed list. The tables hold one number
per pair of characters, so they are bounded by the alphabet.

Defined cases: null and empty texts have no spans; runs of any length are scored whole; repeated rows keep one row each; an empty table
gives no rows (and models trained on the digests alone); further columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of spans and their patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_=-]{16,}"
LEAST_VALUE = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Ordinary words that count as labelled samples beside those of the documents, so that small tables have some.
ORDINARY = (
    "the of and to in is that it for was on are as with they be at this have from or had by word but not what all were when your can said there use each which "
    "their time will way about many then them write would like these long make thing see look more day could come number sound people over know water than call "
    "first who may down side been now find user name value index count first_name last_name user_id created_at updated_at get_item set_value page_size total_count "
    "return import default public private string integer boolean object function class method parameter argument result response request message service controller "
    "repository configuration international organisation information development environment application management administration representative responsibility "
    "der die das und ist nicht mit sich auf eine auch werden nach wird aber noch einen durch wenn nur einer über diese les des est que pour dans qui par sur avec "
    "plus être comme cette ses mais fait tout elle deux même leur aux los las una por con para más como pero sus este entre cuando muy sin sobre también hasta donde"
)
SAMPLE_DOCS = 400
SYNTHETIC = 2000
#: Mean log-likelihood ratio a pair of characters, in nats, from which a run counts as random.
THRESHOLD = 1.0

_CHUNK = 4096
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _before(values: Column, op, zero: Column) -> Column:
    """For every place of an int array what op has made of the values before it.

    A fold that grows an array copies it at each step, so long arrays are folded in blocks of about the square root of their length.
    """

    def fold(block: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, first, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(v: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v)))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda k: F.slice(v, k * size + 1, size))
        begins = lambda b: fold(F.transform(b, lambda x: F.aggregate(x, zero, op)), zero)
        return F.when(F.size(v) > 0, _let(blocks, lambda b: F.flatten(F.zip_with(b, begins(b), fold)))).otherwise(F.array().cast("array<int>"))

    return _let(values, whole)


def _sum(a: Column, x: Column) -> Column:
    return (a + x).cast("int")


def _spans(text: Column, pattern: str, kind: int, value_at_least: int = 0, value_group: int = 0) -> Column:
    """Spans of the leftmost matches that don't overlap, found from what stands between them; only where there is a match at all."""
    none = F.array().cast(_SPAN)
    p = F.lit(pattern)
    rows = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("hit"), F.transform(F.regexp_extract_all(text, p, F.lit(value_group)), F.length).alias("value"))

    def placed(x: Column) -> Column:
        at = _before(F.transform(x, lambda r: (r["gap"] + F.coalesce(r["hit"], F.lit(0))).cast("int")), _sum, F.lit(0))
        good = F.filter(F.zip_with(x, at, lambda r, a: F.struct(r["hit"].alias("hit"), r["value"].alias("value"), (a + r["gap"]).cast("int").alias("start"))), lambda r: r["hit"].isNotNull() & (r["value"] >= value_at_least))
        return F.transform(good, lambda r: F.struct(r["start"].alias("start"), F.lit(kind).alias("kind"), (r["start"] + r["hit"]).cast("int").alias("end")))

    return F.when(text.rlike(pattern), _let(rows, placed)).otherwise(none)


def _runs(text: Column) -> Column:
    """array<struct<start, s>> of the runs that stand apart from assignments and hold no hex or access key."""
    kind = "array<struct<start:int,s:string>>"
    gaps = F.split(text, ASSIGN, -1)
    hits = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), F.length)

    def of_gap(g: Column) -> Column:
        strings = F.regexp_extract_all(g["s"], F.lit(RUN), F.lit(0))
        x = F.zip_with(_spans(g["s"], RUN, 3), strings, lambda span, s: F.struct((span["start"] + g["start"]).cast("int").alias("start"), s.alias("s")))
        return F.filter(x, lambda r: ~r["s"].rlike(f"{HEX}|{ACCESS}"))

    def of_text(x: Column) -> Column:
        at = _before(F.transform(x, lambda r: (F.length(r["gap"]) + F.coalesce(r["hit"], F.lit(0))).cast("int")), _sum, F.lit(0))
        parts = F.filter(F.zip_with(x, at, lambda r, a: F.struct(a.alias("start"), r["gap"].alias("s"))), lambda g: g["s"].rlike(RUN))
        return F.flatten(F.transform(parts, of_gap))

    return F.when(text.rlike(RUN), _let(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), of_text)).otherwise(F.array().cast(kind)).cast(kind)


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _text (null as empty), _assign, _access and _hex."""
    out = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    t = F.col("_text")
    return out.withColumns({"_assign": _spans(t, ASSIGN, 0, LEAST_VALUE, 2), "_access": _spans(t, ACCESS, 1), "_hex": _spans(t, HEX, 2)})


def _pairs(strings: DataFrame) -> DataFrame:
    """(label, a, b, n): how often character b follows a in the strings (label, s)."""
    chars = F.split("s", "")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.struct(F.position(F.element_at("c", i), F.lit(ALPHABET)).alias("a"), F.position(F.element_at("c", i + 1), F.lit(ALPHABET)).alias("b"))))
    return strings.where(F.length("s") > 1).select("label", "s", chars.alias("c")).select("label", pair.alias("p")).groupBy("label", "p.a", "p.b").agg(F.count("*").alias("n"))


def samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, synthetic: int = SYNTHETIC) -> DataFrame:
    """Labelled strings (label, s): 1 random, 0 ordinary. Documents are those of smallest xxhash64(doc_id), at most sample_docs ids."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    chosen = with_base(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))  # at most sample_docs numbers
    values = F.concat(F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("_text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("_text", F.lit(ACCESS), F.lit(0)))
    value = chosen.select(F.explode(F.filter(values, lambda v: F.length(v) >= LEAST_VALUE)).alias("s"))
    rest = reduce(lambda t, p: F.regexp_replace(t, p, " "), (ASSIGN, HEX, ACCESS), F.col("_text"))
    # Runs as long as those that are scored don't teach: an unknown secret would count as ordinary.
    word = chosen.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("s")).where(F.length("s") < 16)
    word = word.unionByName(spark.range(1).select(F.explode(F.split(F.lit(ORDINARY), " ")).alias("s")))
    forms = word.select(F.explode(F.array("s", F.lower("s"), F.upper("s"), F.initcap("s"))).alias("s"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(synthetic).select(F.explode(F.array(digest, F.upper(digest), F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[a-z+/=]", ""))).alias("s"))
    return value.unionByName(made).select(F.lit(1).alias("label"), "s").unionByName(forms.select(F.lit(0).alias("label"), "s"))


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters, row by row; place 0 stands for characters outside the alphabet.

    Every pair counts a little more than seen, less so among ordinary words, whose pairs are few.
    """
    n = len(ALPHABET) + 1
    counts = [[0.05] * (n * n), [0.5] * (n * n)]
    for r in _pairs(labelled).collect():  # at most 2 * n * n rows
        counts[r["label"]][r["a"] * n + r["b"]] += r["n"]
    rows = [[sum(c[a * n : a * n + n]) for a in range(n)] for c in counts]
    return [math.log(counts[1][i] / rows[1][i // n]) - math.log(counts[0][i] / rows[0][i // n]) for i in range(n * n)]


def _ratio(string: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a string's pairs."""
    n = len(ALPHABET) + 1
    numbers = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    code = F.transform(F.split(string, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    pair = F.zip_with(F.slice(code, 1, F.length(string) - 1), F.slice(code, 2, F.length(string) - 1), lambda a, b: F.element_at(numbers, a * n + b + 1))
    return F.aggregate(pair, F.lit(0.0), lambda a, x: a + x) / (F.length(string) - 1)


def with_spans(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with _text, _assign, _access, _hex, _markov and _all (all spans by start, then kind)."""
    table = train(samples(docs)) if table is None else table
    base = with_base(docs).withColumn("_base", F.concat("_assign", "_access", "_hex"))
    random = F.filter(_runs(F.col("_text")), lambda r: _ratio(r["s"], table) >= threshold)
    found = F.transform(random, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), (r["start"] + F.length(r["s"])).cast("int").alias("end")))
    return base.withColumn("_markov", found.cast(_SPAN)).withColumn("_all", F.array_sort(F.concat("_base", "_markov")))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    s = with_spans(docs.select("doc_id", "text"), table)
    n = lambda c: F.size(c).cast("long")
    return s.select("doc_id", n("_assign").alias("n_assign"), n("_access").alias("n_access"), n("_hex").alias("n_hex"), F.sha2(_written(F.array_sort("_base")), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"), n("_markov").alias("n_markov"))


def redact(docs: DataFrame, mark: str = "[SECRET]", table: list[float] | None = None) -> DataFrame:
    """docs with every span replaced by mark and n_chars, where there is such a column, counted anew; all columns and rows stay.

    Overlapping spans are replaced as one. A null text stays null.
    """
    s = with_spans(docs, table)
    text = F.col("_text")

    def replaced(x: Column) -> Column:
        """x: spans, the greatest end before each, and the text in chunks, so that no cut begins at the text's start."""

        def between(a: Column, b: Column) -> Column:
            i, j = F.floor(a / _CHUNK).cast("int"), F.floor(b / _CHUNK).cast("int")
            chunk = lambda k: F.coalesce(F.get(x["chunks"], k), F.lit(""))
            cut = F.substring(chunk(i), a % _CHUNK + 1, b - a)
            whole = F.array_join(F.slice(x["chunks"], i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            return F.when(i == j, cut).otherwise(F.concat(F.substring(chunk(i), a % _CHUNK + 1, F.lit(_CHUNK)), whole, F.substring(chunk(j), F.lit(1), b % _CHUNK)))

        pieces = F.zip_with(x["spans"], x["before"], lambda r, at: F.when(r["start"] >= at, F.concat(between(at, r["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.greatest(F.element_at(x["before"], -1), F.element_at(x["spans"], -1)["end"])
        return F.concat(F.array_join(pieces, ""), between(last, x["length"]))

    ends = _before(F.transform("_all", lambda r: r["end"]), lambda a, e: F.greatest(a, e), F.lit(0))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    clean = _let(F.struct(F.col("_all").alias("spans"), ends.alias("before"), chunks.alias("chunks"), F.length(text).alias("length")), replaced)
    out = s.withColumn("text", F.when(F.size("_all") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_all") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
