"""Scores, vectors, positions and answer metrics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for scores.
SCORE_WORDS = {"very high": 9.0, "high": 8.0, "medium": 6.0, "moderate": 6.0, "low": 4.0, "very low": 2.0}
DEFAULTS = {"confidence": 7.0, "strength": 5.0, "relevance": 5.0}
FILLERS = ("was born earlier", "was born first", "came first", "is the answer", "the answer is", "is correct", "is true", "is false", "was earlier", "was later", "was formed by", "is located in", "is based in")


def coerced(score: Column, field: str) -> Column:
    """A score from 1 to 10 from a number or word as text; 0 to 1 counts as tenths."""
    text, default = F.lower(F.trim(score.cast("string"))), F.lit(DEFAULTS[field])
    number = text.try_cast("double")
    scaled = F.when((number >= 0) & (number <= 1), F.round(number * 10, 1)).otherwise(number)
    out = F.when(number.isNull() | F.isnan(number), default).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(10.0), scaled)))
    for word, value in SCORE_WORDS.items():
        out = F.when(text == word, F.lit(value)).otherwise(out)
    return out


def yes_probability(yes: Column, no: Column) -> Column:
    """The share of yes of a model's two logits."""
    return 1 / (1 + F.exp(no - yes))


def edge_weight(strength: Column, confidence: Column, relevance: Column) -> Column:
    return F.round(0.5 * strength + 0.3 * confidence + 0.2 * relevance, 4)


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v with length 1; a zero vector stays."""
    d = as_doubles(v)
    n = length(d)
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def cosine(a: Column, b: Column) -> Column:
    x, y = as_doubles(a), as_doubles(b)
    n = length(x) * length(y)
    return F.when(n > 0, dot(x, y) / n).otherwise(F.lit(0.0))


def jitter(seed: Column, most: float) -> Column:
    """A small fixed offset struct<x, y, z> from the last bytes of the seed's md5."""
    h = F.md5(seed)
    part = lambda at: (F.conv(F.substring(h, at, 2), 16, 10).cast("double") / 255 - 0.5) * 2 * most
    return F.struct(part(31).alias("x"), part(29).alias("y"), part(27).alias("z"))


def sphere_point(i: Column, n: Column, radius: Column | float) -> Column:
    """Point i of n evenly spread on a sphere."""
    radius = radius if isinstance(radius, Column) else F.lit(float(radius))
    y = 1.0 - i / F.greatest(n - 1, F.lit(1)) * 2.0
    r = F.sqrt(F.greatest(1.0 - y * y, F.lit(0.0)))
    t = i * (math.pi * (math.sqrt(5.0) - 1.0))
    return F.struct((F.cos(t) * r * radius).alias("x"), (y * radius).alias("y"), (F.sin(t) * r * radius).alias("z"))


def ring(base: float, n: Column, most: float) -> Column:
    return F.least(F.lit(float(base)) * F.sqrt(n), F.lit(float(most)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)


def normal_answer(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s]", "")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_f1(predicted: Column, truth: Column) -> Column:
    p, t = words_of(normal_answer(predicted)), words_of(normal_answer(truth))
    common = F.size(F.array_intersect(p, t))
    precision, recall = common / F.size(p), common / F.size(t)
    none = F.when(p == t, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when((F.size(p) == 0) | (F.size(t) == 0), none).when(common == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def first_answer(text: Column) -> Column:
    """The first line of an answer; nothing if its reasoning or references come first."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return F.when(F.startswith(first, F.lit("**Reasoning")) | F.startswith(first, F.lit("### Reference")), F.lit("")).otherwise(first)


def fuzzy_match(expected: Column, actual: Column, threshold: float = 0.6) -> Column:
    """Whether two answers agree, by the first rule that decides."""
    e, a = normal_answer(expected), normal_answer(first_answer(actual))
    c = a
    for phrase in FILLERS:
        c = F.trim(F.replace(c, F.lit(phrase), F.lit("")))
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)))
    ne, na = F.array_sort(numbers(e)), F.array_sort(numbers(c))
    we, wa = F.array_distinct(words_of(e)), F.array_distinct(words_of(c))
    both, either = F.size(F.array_intersect(we, wa)), F.size(F.array_union(we, wa))
    return F.coalesce(
        (e == a)
        | F.contains(a, e)
        | (F.contains(e, a) & (F.length(a) >= F.length(e) * 0.7))
        | F.contains(c, e)
        | (F.contains(e, c) & (F.length(c) >= F.length(e) * 0.5))
        | ((F.size(ne) > 0) & (ne == na) & (F.size(F.array_except(we, ne)) <= 2) & (F.size(F.array_except(wa, na)) <= 2))
        | ((F.size(we) > 0) & (F.size(wa) > 0) & (((both >= 2) & (F.size(we) <= 5) & (both / F.size(we) >= 0.5)) | (both / either >= threshold))),
        F.lit(False),
    )


#: The namespace of ids made from object names.
OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
