"""Knowledge bases: their registry as a stored table, and what creating, renaming and deleting one does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import Store

SCHEMA = "id string, name string, slug string, created_at timestamp"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """All knowledge bases, the default one always among them."""
    default = spark.createDataFrame([("default", "Default", "default", None)], SCHEMA)
    store = Store(spark, path, "_registry")
    return default.unionByName(store.read("bases")) if store.exists("bases") else default


def _save(spark: SparkSession, path: str, rows: DataFrame) -> None:
    Store(spark, path, "_registry").commit("bases", rows.where("id <> 'default'"))


def create(spark: SparkSession, path: str, name: str) -> Store:
    """A new one; a slug that is taken is refused."""
    new = spark.createDataFrame([(name,)], "name string").select(T.slug(F.col("name")).alias("slug"), "name")
    slug = new.first()["slug"]
    old = listed(spark, path)
    if not old.where(F.col("slug") == slug).isEmpty():
        raise ValueError(f"there is a knowledge base {slug}")
    _save(spark, path, old.unionByName(new.select(F.concat(F.lit("kb_"), F.md5("slug")).alias("id"), "name", "slug", F.current_timestamp().alias("created_at"))))
    return Store(spark, path, slug)


def rename(spark: SparkSession, path: str, slug: str, name: str) -> None:
    """Another name; the slug and with it the tables stay."""
    _save(spark, path, listed(spark, path).withColumn("name", F.when(F.col("slug") == slug, F.lit(name)).otherwise(F.col("name"))))


def delete(spark: SparkSession, path: str, slug: str) -> None:
    """Drops its tables and its entry; the default one is refused."""
    Store(spark, path, slug).drop()
    _save(spark, path, listed(spark, path).where(F.col("slug") != slug))


def reset(store: Store, *tables: str) -> None:
    """Empties tables by a new version without rows."""
    for t in tables:
        if store.exists(t):
            store.commit(t, store.read(t).limit(0))
