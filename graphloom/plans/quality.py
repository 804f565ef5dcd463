"""Answer and retrieval quality of question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S


def answer_metrics(results: DataFrame) -> DataFrame:
    """results(expected, actual, ...) with exact_match, fuzzy_match, contains_answer, f1."""
    first = S.first_answer(F.col("actual"))
    e, a = S.normal_answer(F.col("expected")), S.normal_answer(first)
    return results.withColumn("exact_match", e == a).withColumn("fuzzy_match", S.fuzzy_match(F.col("expected"), F.col("actual"))).withColumn("contains_answer", F.contains(S.normal_answer(F.col("actual")), e)).withColumn("f1", S.token_f1(first, F.col("expected")))


def retrieval_metrics(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """test_id, precision, recall: a retrieved title counts for the first gold title that it holds or that holds it, compared within a test."""
    g = gold.select("test_id", F.lower("title").alias("g"))
    r = retrieved.select("test_id", F.lower("title").alias("r")).distinct()
    per = r.groupBy("test_id").agg(F.collect_set("r").alias("rs")).join(g.groupBy("test_id").agg(F.collect_set("g").alias("gs")), "test_id", "full")
    empty = F.array().cast("array<string>")
    rs, gs = F.coalesce("rs", empty), F.coalesce("gs", empty)
    hit = lambda x, ys: F.exists(ys, lambda y: F.contains(x, y) | F.contains(y, x))
    right, found = F.size(F.filter(rs, lambda x: hit(x, gs))), F.size(F.filter(gs, lambda x: hit(x, rs)))
    rate = lambda a, n: F.when(n > 0, a / n).otherwise(0.0)
    return per.select("test_id", rate(right, F.size(rs)).alias("precision"), rate(found, F.size(gs)).alias("recall"))


def summary(results: DataFrame) -> DataFrame:
    """One row over results(exact_match, fuzzy_match, contains_answer, f1, precision, recall, total_time_ms, error); errors count only as such."""
    good = F.col("error").isNull()
    mean = lambda c: F.avg(F.when(good, F.col(c).cast("double")))
    p, r = mean("precision"), mean("recall")
    quantiles = F.percentile(F.when(good, F.col("total_time_ms")), [0.25, 0.5, 0.75, 0.9, 0.95])
    return results.agg(F.count("*").alias("questions"), F.count(F.when(~good, 1)).alias("errors"), mean("exact_match").alias("exact_match"), mean("fuzzy_match").alias("fuzzy_match"), mean("contains_answer").alias("contains_answer"), mean("f1").alias("token_f1"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("retrieval_f1"), mean("total_time_ms").alias("mean_ms"), quantiles.alias("quantiles_ms"))


def save(results: DataFrame, path: str) -> None:
    """Writes the results of each question and their summary as JSON."""
    results.write.mode("overwrite").json(f"{path}/questions")
    summary(results).write.mode("overwrite").json(f"{path}/summary")
