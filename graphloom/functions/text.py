"""Text functions as columns: names, predicates, note cleaning, attachments, rendering, parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDERS = ("untitled", "none", "unknown", "")
CLIP, MIC = "\U0001f4ce", "\U0001f3a4"

# Words and phrases that make a community's name say nothing.
GENERIC_PHRASES = (
    "isolated conceptual node cluster", "isolated conceptual cluster", "isolated conceptual fragment", "isolated conceptual echo",
    "isolated conceptual echoes", "isolated conceptual anomaly", "isolated conceptual collection", "isolated conceptual core",
    "isolated node community", "isolated node cluster", "isolated core node cluster", "isolated single node community",
    "isolated concept", "potential anomaly", "initial state", "provisional", "minimal connection",
)
GENERIC_WORDS = (
    "isolated", "conceptual", "node", "nodes", "cluster", "community", "core", "collection", "fragment", "echo", "echoes", "anomaly", "pair",
    "transient", "temporal", "reflection", "reflections", "potential", "seeds", "seed", "observation", "observations", "silent", "silence",
    "unresolved", "statistical", "minimal", "interest", "inquiry", "shadow", "shadows", "whisper", "whispers", "remnant", "remnants", "trace",
    "traces", "fleeting", "ephemeral", "abstract", "nascent", "liminal",
)


def entity_key(name: Column) -> Column:
    """Leading # off, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, "^#+", "")))


def node_id(name: Column) -> Column:
    return F.concat(F.lit("node_"), F.md5(entity_key(name)))


def or_default(x: Column, default: str) -> Column:
    """x, or the default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(default))


def name_tokens(*names: Column) -> Column:
    """Tokens of more than one character of some names, split at white space, _ and -."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *names)), r"[\s_\-]+"), lambda t: F.length(t) > 1)


def clean_predicate(rel: Column, source: Column, target: Column) -> Column:
    """rel in lower case without the tokens of both names; relates_to if nothing is left; as it is if empty or the names have no tokens."""
    tokens = name_tokens(F.coalesce(source, F.lit("")), F.coalesce(target, F.lit("")))
    left = F.filter(F.split(F.lower(rel), "_"), lambda t: ~F.array_contains(tokens, t))
    cleaned = F.when(F.size(left) == 0, F.lit("relates_to")).otherwise(F.array_join(left, "_"))
    return F.when(rel.isNull() | (rel == "") | (F.size(tokens) == 0), rel).otherwise(cleaned)


def sanitise_type(rel: Column) -> Column:
    """Signs other than [A-Za-z0-9_] become _; null where nothing is left to store."""
    return F.nullif(F.regexp_replace(F.trim(rel), "[^A-Za-z0-9_]", "_"), F.lit(""))


def described_type(description: Column) -> Column:
    """A relationship type made of a description."""
    kept = F.trim(F.regexp_replace(F.lower(description), "[^a-z0-9 ]", ""))
    return or_default(F.regexp_replace(kept, r"\s+", "_"), "relates_to")


def without_facts_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?s)\s*FACTS:\s*", "")


def spoken(rel: Column) -> Column:
    return F.replace(rel, F.lit("_"), F.lit(" "))


def predicate_text(nl: Column, source: Column, target: Column) -> Column:
    """A stored sentence without the names at its ends; the sentence itself if nothing else is left."""
    text = F.regexp_replace(F.trim(nl), r"[. ]+$", "")
    for name in (source, target):
        n = F.coalesce(name, F.lit(""))
        size = F.length(n)
        text = F.when((size > 0) & F.startswith(F.lower(text), F.lower(n)), F.ltrim(F.substring(text, size + 1, F.length(text)))).otherwise(text)
        text = F.when((size > 0) & F.endswith(F.lower(text), F.lower(n)), F.rtrim(F.substring(text, F.lit(1), F.length(text) - size))).otherwise(text)
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), nl)


def node_text(summary: Column, description: Column, contexts: Column) -> Column:
    """Summary, else description, else the contexts in a row."""
    joined = F.array_join(F.filter(F.coalesce(contexts, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")), " ")
    return F.coalesce(F.nullif(summary, F.lit("")), F.nullif(description, F.lit("")), F.nullif(joined, F.lit("")))


def node_block(name: Column, kind: Column, text: Column, rels: Column, brief: bool = False) -> Column:
    """The text block of a node and its relations (array of struct nl, name, type, context, incoming)."""
    kind, text = F.nullif(kind, F.lit("")), F.nullif(text, F.lit(""))
    typed = F.concat(name, F.lit(" is a "), kind, F.lit("."))
    if brief:
        root = F.coalesce(typed, name)
    else:
        bare = F.when(F.startswith(F.lower(text), F.lower(name)), text).otherwise(F.coalesce(F.concat(name, F.lit(". "), text), name))
        root = F.when(kind.isNotNull(), F.concat_ws(" ", typed, text)).otherwise(bare)

    def line(r):
        nl = F.nullif(F.regexp_replace(F.coalesce(r["nl"], F.lit("")), r"[. ]+$", ""), F.lit(""))
        other, other_kind, context = F.nullif(r["name"], F.lit("")), F.nullif(r["type"], F.lit("")), F.nullif(r["context"], F.lit(""))
        said = F.when(r["incoming"], F.concat(other, F.lit(" "), nl, F.lit(" "), name, F.lit("."))).otherwise(F.concat(name, F.lit(" "), nl, F.lit(" "), other, F.lit(".")))
        about = F.when(other_kind.isNotNull(), F.concat_ws(" ", F.concat(other, F.lit(" is a "), other_kind, F.lit(".")), context)).otherwise(
            F.when(F.startswith(F.lower(context), F.lower(other)), context).otherwise(F.concat(other, F.lit(". "), context))
        )
        return F.when(nl.isNotNull() & other.isNotNull(), F.concat_ws("\n", said, about))

    return F.concat_ws("\n", root, F.transform(F.coalesce(rels, F.array()), line)) if rels is not None else root


def capitalised_spans(text: Column) -> Column:
    """Candidate mentions: runs of capitalised words, then capitalised words of four letters or more, each once."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]{3,})"), F.lit(1))
    return F.array_union(runs, words)


def attachments(text: Column) -> Column:
    """array<struct<kind, name, url, type>> of the attachment links of a note."""
    pattern = F.lit(rf"\[({CLIP}|{MIC}) ([^\]]*)\]\(([^)\s]+)\)")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "mark"), (2, "name"), (3, "url"))))
    return F.transform(parts, lambda p: F.struct(p["mark"].alias("mark"), p["name"].alias("name"), p["url"].alias("url"), attachment_type(p["mark"], p["url"]).alias("type")))


def attachment_type(mark: Column, url: Column) -> Column:
    u = F.lower(url)
    return (
        F.when((mark == MIC) | u.rlike(r"\.(mp3|m4a|wav|ogg|webm|flac|aac)(\?.*)?$"), "audio")
        .when(u.rlike(r"\.pdf(\?.*)?$"), "pdf")
        .when(u.rlike(r"\.docx(\?.*)?$"), "docx")
        .when(u.rlike(r"\.(xlsx|csv|tsv)(\?.*)?$"), "sheet")
        .when(u.rlike(r"\.(png|jpe?g|gif|webp|bmp)(\?.*)?$"), "image")
        .otherwise("unsupported")
    )


def with_extraction(text: Column, title: str, name: Column, extracted: Column) -> Column:
    """The note with one more extraction section."""
    return F.concat(text, F.lit(f"\n\n[{title} ("), name, F.lit(")]: "), extracted)


SECTION = r"\[([A-Z][A-Za-z ]*?) \(([^)\]]*)\)\]: "


def segments(text: Column) -> Column:
    """array<struct<type, label, content>> of a note: its own text, then each extraction section."""
    parts = F.split(text, r"(?=\[[A-Z][A-Za-z ]*? \([^)\]]*\)\]: )")

    def one(p):
        marked = p.rlike("^" + SECTION)
        return F.struct(
            F.when(marked, F.regexp_extract(p, "^" + SECTION, 1)).otherwise("text").alias("type"),
            F.when(marked, F.regexp_extract(p, "^" + SECTION, 2)).alias("label"),
            F.trim(F.regexp_replace(p, "^" + SECTION, "")).alias("content"),
        )

    return F.filter(F.transform(parts, one), lambda s: s["content"] != "")


def clean_note(text: Column) -> Column:
    """Front matter, previous/next links and more than one blank line go; trimmed."""
    t = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    t = F.regexp_replace(t, r"(?im)^\s*\[?(?:previous|next)\b[^\n]*$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def file_title(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.md$", ""), F.lit("_"), F.lit(" "))


def thinking(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)<think>(.*?)</think>", 1)), F.lit(""))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


SECTIONS = ("REASONING", "FINDING", "FULL_ANSWER", "ANSWER", "NEXT_QUERY")


def section(text: Column, name: str) -> Column:
    """The first section of that name of a model's answer, null if there is none; marks may be bold."""
    any_name = "|".join(SECTIONS)
    pattern = rf"(?is)(?:\A|[^A-Z_])\*{{0,3}}{name}\*{{0,3}}\s*:\*{{0,3}}[ \t]*(.*?)(?=\*{{0,3}}(?:{any_name})\*{{0,3}}\s*:|\z)"
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\A\s+|\s+\z", "")), F.lit(""))


def json_text(text: Column) -> Column:
    """A model's JSON without fences and control characters, with straight quotes and without trailing commas."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)\A```[A-Za-z]*\s*", ""), r"(?s)\s*```\s*\z", "")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    t = F.translate(t, "“”‘’", "\"\"''")
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def name_and_summary(text: Column) -> Column:
    """struct<name, summary> of an answer with NAME: and SUMMARY: parts."""
    name = F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\s*NAME\s*:[ \t]*([^\n]*)", 1)), F.lit(""))
    summary = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, r"(?is)(?:\A|\n)\s*SUMMARY\s*:\s*(.*)\z", 1), r"\s*\n\s*", " ")), F.lit(""))
    return F.struct(name.alias("name"), summary.alias("summary"))


def title_of(text: Column) -> Column:
    return or_default(F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", ""), "Untitled Note")


def slug(name: Column) -> Column:
    return F.lower(F.replace(F.trim(name), F.lit(" "), F.lit("_")))


def generic_name(name: Column) -> Column:
    """Whether a community's name says nothing."""
    n = F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "))
    banned = F.exists(F.array(*(F.lit(p) for p in GENERIC_PHRASES)), lambda p: F.contains(n, p))
    words = F.filter(F.split(n, "[^a-z0-9]+"), lambda w: w != "")
    known = F.array(*(F.lit(w) for w in GENERIC_WORDS))
    return (n == "") | n.rlike(r"^community\s+l\d+[-\s]?\d+$") | F.startswith(n, F.lit("community ")) | banned | ((F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w)))


def fallback_name(names: Column) -> Column:
    """A readable name for a community from its members' names in order."""
    n = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    first, second = F.try_element_at(n, F.lit(1)), F.try_element_at(n, F.lit(2))
    return F.when(F.size(n) == 0, "Related knowledge topics").when(F.size(n) == 1, F.concat(F.lit("About "), first)).when(F.size(n) == 2, F.concat(first, F.lit(" and "), second)).otherwise(F.concat(first, F.lit(" and related topics")))


def member_context(members: Column) -> Column:
    """Lines of array<struct<name, label, contexts>> for a summary."""
    return F.array_join(F.transform(members, lambda m: F.concat(F.lit("- "), m["name"], F.lit(" ("), m["label"], F.lit(")"), F.when(F.size(m["contexts"]) > 0, F.concat(F.lit(": "), F.array_join(m["contexts"], " | "))).otherwise(""))), "\n")


def membership_sentence(name: Column, community: Column) -> Column:
    return F.concat(name, F.lit(" is a member of "), community, F.lit("."))


def reference_line(title: Column, note_id: Column) -> Column:
    return F.concat(F.lit("- ["), F.coalesce(title, F.lit("Untitled Note")), F.lit("](/notes/"), note_id, F.lit(")"))


def linked_mentions(text: Column) -> Column:
    """[[name|id]] as a link to the entity."""
    return F.regexp_replace(text, r"\[\[([^|\]]+)\|([^\]]+)\]\]", "[$1](/entities/$2)")


def note_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM d, yyyy")


def parsed_time(text: Column, default: Column) -> Column:
    """ISO first, then a few written forms, then the default; without a zone it is UTC."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in forms), default)


def acceptable_rename(name: Column) -> Column:
    return name.isNotNull() & ~F.lower(F.trim(name)).isin(*PLACEHOLDERS) & (F.length(F.trim(name)) > 2) & (F.length(F.trim(name)) <= 80)


def unescaped(text: Column) -> Column:
    """The five references that titles hold, decoded; the ampersand last."""
    out = text
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out
