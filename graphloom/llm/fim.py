"""Fill-in-middle examples by lookaround splitting: JVM columns only.

A unit grammar says between which neighbouring characters one unit ends and the next begins. It is translated to a regex of zero-width
boundaries, a look-behind for the class on the left and a look-ahead for that on the right, so Spark's split cuts there and keeps every
character. The two cuts and the form come from a digest of seed and doc_id, so a repeated task gives the same example.

Defined cases: a null text counts as empty; an empty text has no units and stays plain, as does one that holds a sentinel; a null doc_id
is digested as the empty string, repeated ids get the same digits, each row its own cuts by its own number of units; an empty table
gives no rows; columns named like the results give way to them, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
RATE = 100  # of 100 documents, how many are transformed
SPM = 50  # of 100 transformed ones, how many put the suffix first
SENTINELS = ("<P>", "<S>", "<M>")

_SPACE = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]"
#: The left and right classes of the boundaries of every unit grammar, beside the grammar itself.
GRAMMARS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "line": (r"[^\n]*\n|[^\n]+", [(r"\n", r"[\s\S]")]),
    "word": (rf"{_SOLID}+{_SPACE}*|{_SPACE}+", [(_SPACE, _SOLID)]),
    "run": (r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", [(r"[A-Za-z]", r"[^A-Za-z]"), (r"[0-9]", r"[^0-9]"), (r"[^A-Za-z0-9]", r"[A-Za-z0-9]")]),
    "character": (r"[\s\S]", [(r"[\s\S]", r"[\s\S]")]),
}
#: No boundary lies inside a character that the JVM holds as two.
_WHOLE = r"(?<![\x{D800}-\x{DBFF}](?=[\x{DC00}-\x{DFFF}]))"


def boundary(pairs: list[tuple[str, str]]) -> str:
    """The zero-width regex that matches between a character of a left class and one of its right class."""
    return _WHOLE + "(?:" + "|".join(f"(?<={left})(?={right})" for left, right in pairs) + ")"


def units(text: Column, grammar: str = "line") -> Column:
    """The units of a text, which joined give it again; an empty or null text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar][1]), -1))


def digits(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers from a digest of seed and doc_id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, grammar: str = "line", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (units), form, prefix, middle, suffix (null if plain) and output, the text as a model is to read it."""
    p, s, m = (F.lit(x) for x in sentinels)
    new = ["n", "form", "prefix", "middle", "suffix", "output"]
    kept = [c for c in docs.columns if c not in new]
    hold = "_f"
    while hold in kept:
        hold = "_" + hold
    f = lambda c: F.col(f"{hold}.{c}")
    text, n = F.coalesce(F.col("text").cast("string"), F.lit("")), F.size(f("u"))
    held = docs.select(*kept, F.struct(text.alias("text"), units(text, grammar).alias("u"), *(h.alias(f"h{i}") for i, h in enumerate(digits(F.col("doc_id"), seed), 1))).alias(hold))
    marked = F.contains(f("text"), p) | F.contains(f("text"), s) | F.contains(f("text"), m)
    form = F.when((f("text") == "") | marked | (f("h3") % 100 >= rate), "plain").when(f("h4") % 100 < spm, "spm").otherwise("psm")
    a, b = f("h1") % (n + 1), f("h2") % (n + 1)
    cut = F.struct(f("text").alias("text"), f("u").alias("u"), F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"))
    cut = held.select(*kept, n.cast("long").alias("n"), form.alias("form"), cut.alias(hold))
    part = lambda at, to: F.when(F.col("form") != "plain", F.array_join(F.slice(f("u"), at + 1, to - at), ""))
    parts = cut.select(*kept, "n", "form", hold, part(F.lit(0), f("a")).alias("prefix"), part(f("a"), f("b")).alias("middle"), part(f("b"), F.size(f("u"))).alias("suffix"))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(f("text"))
    return parts.select(*kept, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an example, from output and form alone: no part holds a sentinel, so the first of each is the one that was put in."""
    p, s, m = sentinels

    def between(left: str, right: str | None) -> Column:
        rest = F.substring(output, F.instr(output, left) + len(left), F.length(output))
        return rest if right is None else F.substring_index(rest, right, 1)

    return F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m))).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output)


def examples(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, the lengths of prefix and middle in code points, and digests of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
