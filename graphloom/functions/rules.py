"""Rule tables of relationship types as data, and their look-ups as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The relationship rules.
EVOLVE = {
    "knows": ["friends_with", "works_with", "collaborates_with"],
    "friends_with": ["married_to", "partners_with"],
    "works_with": ["collaborates_with", "reports_to", "mentors"],
    "learning": ["expert_in"],
    "related_to": ["depends_on", "blocks", "prerequisite_for"],
}
BIDIRECTIONAL = ["works_with", "collaborates_with", "friends_with", "married_to", "partners_with", "knows", "related_to"]
CONTRADICT = {
    "friends_with": ["enemies_with", "hates", "dislikes", "avoids"],
    "knows": [],
    "married_to": ["divorced_from", "separated_from"],
    "partners_with": ["separated_from", "ended_partnership"],
    "works_with": ["left_company", "terminated"],
    "reports_to": [],
    "learning": ["expert_in"],
    "depends_on": ["independent_of"],
    "blocks": ["unblocks", "completed"],
    "enemies_with": ["friends_with", "partners_with"],
    "hates": ["friends_with", "loves"],
    "dislikes": ["friends_with", "likes"],
    "divorced_from": ["married_to"],
    "loves": ["hates", "dislikes"],
    "likes": ["hates", "dislikes"],
}
INVERSE = {
    "created_by": "owns",
    "owns": "created_by",
    "manages": "managed_by",
    "reports_to": "has_report",
    "mentors": "mentored_by",
    "teaches": "learning",
    "learning": "teaches",
    "depends_on": "depended_on_by",
    "blocks": "blocked_by",
    "prerequisite_for": "has_prerequisite",
    "contains": "part_of",
    "part_of": "contains",
    "implements": "implemented_by",
    "uses": "used_by",
    "demonstrates": "demonstrated_by",
}


def pairs(spark: SparkSession, table: dict[str, list[str]], names: tuple[str, str]) -> DataFrame:
    """A rule table as rows; a few dozen, whatever the data."""
    return spark.createDataFrame([(a, b) for a, bs in table.items() for b in bs], f"{names[0]} string, {names[1]} string")


def _lookup(key: Column, table: dict[str, list[str]]) -> Column:
    none = F.array().cast("array<string>")
    out = none
    for k, v in table.items():
        if v:
            out = F.when(key == k, F.array(*(F.lit(x) for x in v))).otherwise(out)
    return out


def contradicting(rel_type: Column) -> Column:
    """Types that a new relationship of this type makes invalid; none for unknown types."""
    return _lookup(rel_type, CONTRADICT)


def can_evolve(current: Column, new: Column) -> Column:
    return F.coalesce(F.array_contains(_lookup(current, EVOLVE), new), F.lit(False))


def bidirectional(rel_type: Column) -> Column:
    return F.coalesce(rel_type.isin(*BIDIRECTIONAL), F.lit(False))


def inverse(rel_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in INVERSE.items():
        out = F.when(rel_type == k, F.lit(v)).otherwise(out)
    return out


# Relationship types expected between two kinds of entities.
EXPECTED: dict[tuple[str, str], list[str]] = {
    ("Person", "Person"): ["knows", "friends_with", "married_to", "works_with", "reports_to", "mentors", "collaborates_with", "partners_with"],
    ("Person", "Task"): ["assigned_to", "responsible_for", "owns", "created_by"],
    ("Person", "Entity"): ["works_on", "owns", "manages", "created_by"],
    ("Person", "Concept"): ["expert_in", "learning", "teaches"],
    ("Task", "Task"): ["depends_on", "blocks", "subtask_of", "related_to", "prerequisite_for", "leads_to"],
    ("Task", "Entity"): ["uses", "modifies", "affects", "implements"],
    ("Task", "Concept"): ["implements", "demonstrates", "requires"],
    ("Entity", "Entity"): ["depends_on", "uses", "integrates_with", "part_of", "contains"],
    ("Entity", "Concept"): ["implements", "based_on", "uses", "demonstrates"],
    ("Concept", "Concept"): ["prerequisite_for", "related_to", "contradicts", "part_of", "supports", "enables"],
    ("Concept", "Entity"): ["exemplifies", "implements"],
    ("Event", "Person"): ["involves"],
    ("Event", "Entity"): ["triggered_by", "resulted_in", "involves", "introduced"],
    ("Event", "Concept"): ["demonstrates", "introduced"],
    ("Event", "Task"): ["resulted_in", "triggered_by"],
}


def expected(source: Column, target: Column, table: dict[tuple[str, str], list[str]] | None = None) -> Column:
    """Types usual between two labels, from a table that the caller may extend; none for unknown pairs."""
    out = F.array().cast("array<string>")
    for (a, b), types in (table or EXPECTED).items():
        out = F.when((source == a) & (target == b), F.array(*(F.lit(t) for t in types))).otherwise(out)
    return out
