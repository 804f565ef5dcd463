"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fim, html_text, jaccard, lattice, lm, packing, quality, secret_scan, spm, topk, toxicity, trie, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return topk.top_k(e.where("vec_id % 50 = 0"), e, k=5)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_store(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(_table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(_table(spark, sf_dir, "conversations"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.examples(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_tokens, op3_secrets, op4_quality, op5_lattice, op6_packing, op7_sentencepiece, op8_lm, op9_jaccard, op10_html, op11_trie, op12_fim, op13_toxicity)
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op5_lattice": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    embedding IS NOT NULL AND coalesce(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.ok AND b.ok AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < e.b),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m""",
    # crc32 by its table; rank by turn; the prefixes of a conversation as lists; sums over subtrees as the operator has them.
    "op11_trie": """
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) t(i))),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
m AS (SELECT c.conv_id, 0 AS part, pos, said FROM c JOIN t ON t.conv_id = base AND pos < h UNION ALL SELECT c.conv_id, 1, pos, said FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, list(said ORDER BY part, pos) AS said FROM m GROUP BY conv_id UNION ALL SELECT conv_id, [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM m)),
p AS (SELECT conv_id, d, md5(said[1:d]::VARCHAR) AS k, CASE WHEN d = 0 THEN 0 ELSE length(said[d].x) END AS chars, len(said) = d AS ended, CASE WHEN d > 0 THEN md5(said[1:d - 1]::VARCHAR) END AS up FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM s)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(up) AS up, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256 FROM p GROUP BY d, k),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) USING (d, k)),
b AS (SELECT p.d, p.k, sum(coalesce((f.n_children = 0)::INTEGER, 0)) OVER w AS leaves, sum(coalesce((f.n_convs - 1) * f.chars, 0)) OVER w AS saved FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.d = p.d WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.d DESC))
SELECT f.conv_id, f.d AS depth, any_value(g.conv_id) AS parent_conv_id, any_value(f.n_convs) AS n_convs, any_value(f.n_children) AS n_children, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens, any_value(f.ends_sha256) AS ends_sha256
FROM f JOIN b ON b.d = f.d AND b.k = f.k LEFT JOIN f g ON g.d = f.d - 1 AND g.k = f.up GROUP BY f.conv_id, f.d""",
    "op12_fim": """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, list_transform([0, 1, 2, 3], lambda i: ('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
