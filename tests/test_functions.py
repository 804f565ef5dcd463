import pytest
from pyspark.sql import functions as F

from graphloom.functions import extraction as X
from graphloom.functions import rules
from graphloom.functions import scores as S
from graphloom.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def lit(x):
    return F.lit(x)


def test_names_and_predicates(spark):
    r = one(
        spark,
        key=T.entity_key(lit("##Ada Lovelace ")),
        plays=T.clean_predicate(lit("plays_corliss_archer"), lit("shirley temple"), lit("corliss archer")),
        kept=T.clean_predicate(lit("is_directed_by"), lit("film"), lit("director")),
        gone=T.clean_predicate(lit("Corliss"), lit("corliss"), lit("x")),
        empty=T.clean_predicate(lit(""), lit("a b"), lit("c")),
        no_tokens=T.clean_predicate(lit("Likes_It"), lit("a"), lit("b")),
        sane=T.sanitise_type(lit(" works with! ")),
        none=T.sanitise_type(lit("  ")),
        described=T.described_type(lit("Is Part-of the Team")),
        predicate=T.predicate_text(lit("scott derrickson directed doctor strange."), lit("Scott Derrickson"), lit("Doctor Strange")),
    )
    assert r.asDict() == {"key": "ada lovelace", "plays": "plays", "kept": "is_directed_by", "gone": "relates_to", "empty": "", "no_tokens": "Likes_It", "sane": "works_with_", "none": None, "described": "is_partof_the_team", "predicate": "directed"}


def test_blocks_and_parsing(spark):
    rel = F.array(F.struct(lit("directed").alias("nl"), lit("Dune").alias("name"), lit("film").alias("type"), lit("A film.").alias("context"), lit(False).alias("incoming")), F.struct(lit("knows.").alias("nl"), lit("Bo").alias("name"), lit("").alias("type"), lit("").alias("context"), lit(True).alias("incoming")))
    said = lit("**REASONING:** because\n**FINDING**: it is so\nANSWER: Paris\nNEXT_QUERY: none")
    r = one(
        spark,
        block=T.node_block(lit("Ann"), lit("person"), lit("She works."), rel),
        brief=T.node_block(lit("Ann"), lit(""), lit("Ann works."), F.array().cast("array<struct<nl:string,name:string,type:string,context:string,incoming:boolean>>")),
        answer=T.section(said, "ANSWER"),
        finding=T.section(said, "FINDING"),
        missing=T.section(lit("ANSWER: x"), "REASONING"),
        json=T.json_text(lit('```json\n{"a": [1, 2,],}\n```')),
        think=T.without_thinking(lit("<think>hm</think> yes")),
        note=T.clean_note(lit("---\nt: 1\n---\n# A\n\n\n\n\nB\n[Previous](x)\n")),
        link=T.linked_mentions(lit("see [[Ann|n1]]")),
        slug=T.slug(lit("My Notes")),
    )
    assert r["block"] == "Ann is a person. She works.\nAnn directed Dune.\nDune is a film. A film.\nBo knows Ann."
    assert (r["brief"], r["answer"], r["finding"], r["missing"]) == ("Ann works.", "Paris", "it is so", None)
    assert (r["json"], r["think"], r["note"]) == ('{"a": [1, 2]}', "yes", "# A\n\nB")
    assert (r["link"], r["slug"]) == ("see [Ann](/entities/n1)", "my_notes")


@pytest.mark.parametrize(("name", "generic"), [(None, True), ("  ", True), ("Community L2-3", True), ("community of practice", True), ("Isolated Node Cluster", True), ("Silent Echoes", True), ("Silent Film", False), ("Rome and its roads", False), ("A provisional name", True)])
def test_generic_names(spark, name, generic):
    assert one(spark, g=T.generic_name(F.lit(name).cast("string")))["g"] is generic


def test_rules(spark):
    r = one(spark, c=rules.contradicting(lit("married_to")), u=rules.contradicting(lit("made up")), e=rules.can_evolve(lit("knows"), lit("friends_with")), n=rules.can_evolve(lit("knows"), lit("hates")), b=rules.bidirectional(lit("knows")), i=rules.inverse(lit("mentors")), x=rules.inverse(lit("knows")), p=rules.expected(lit("Person"), lit("Concept")))
    assert r.asDict() == {"c": ["divorced_from", "separated_from"], "u": [], "e": True, "n": False, "b": True, "i": "mentored_by", "x": None, "p": ["expert_in", "learning", "teaches"]}


@pytest.mark.parametrize(("value", "field", "score"), [(None, "confidence", 7.0), (None, "strength", 5.0), ("HIGH ", "confidence", 8.0), ("very low", "relevance", 2.0), ("0.5", "strength", 5.0), ("0", "strength", 1.0), ("12", "strength", 10.0), ("3.5", "strength", 3.5), ("rubbish", "confidence", 7.0)])
def test_scores_agree_in_both_forms(spark, value, field, score):
    assert one(spark, s=S.coerced(F.lit(value).cast("string"), field))["s"] == score
    assert X.score(value, S.DEFAULTS[field]) == score


@pytest.mark.parametrize(
    ("expected", "actual", "same"),
    [("Paris", "paris.", True), ("Paris", "It is Paris, France\n**Reasoning:** x", True), ("Robert Erskine Childers DSC", "Robert Erskine Childers", True), ("3,677 seated", "3,677 seats", True), ("Adeline Virginia Woolf", "Virginia Woolf", True), ("Paris", "**Reasoning:** Paris", False), ("World War II", "The answer is not here", False), ("yes", "no", False)],
)
def test_fuzzy_match(spark, expected, actual, same):
    assert one(spark, f=S.fuzzy_match(lit(expected), lit(actual)))["f"] is same


def test_vectors_and_f1(spark):
    r = one(spark, c=S.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0))), z=S.cosine(F.array(lit(0.0)), F.array(lit(1.0))), f=S.token_f1(lit("the red house"), lit("red house")), e=S.token_f1(lit(""), lit("")), n=S.token_f1(lit("a"), lit("b")))
    assert (round(r["c"], 6), r["z"], round(r["f"], 6), r["e"], r["n"]) == (0.707107, 0.0, 0.8, 1.0, 0.0)


@pytest.mark.parametrize(
    ("text", "nodes", "rels"),
    [
        ('{"nodes": [{"name": "A"}], "relationships": [{"source": "A", "target": "B", "type": "knows"}]}', 1, 1),
        ('[{"trait": "A", "evidence_quote": "q"}, "B"]', 2, 0),
        ('[[{"name": "A"}], [{"from": "A", "to": "B", "relation": "x y"}]]', 1, 1),
        ('```json\n{"data": {"entities": ["A", ""], "edges": [],}}\n```', 1, 0),
        ('{"nodes": [{"name": "A", "relationships": [{"target": "B"}]}', 1, 1),
        ('{“nodes”: [{"name": "A"}', 1, 0),
        ("nothing", 0, 0),
        (None, 0, 0),
    ],
)
def test_extraction_shapes(text, nodes, rels):
    got = X.coerce(text)
    assert (len(got["nodes"]), len(got["relationships"])) == (nodes, rels)
    assert all(r["source_name"] for r in got["relationships"])
