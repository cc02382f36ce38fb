"""The external-lookup cache as a table: key, value, created_at, expires_at, access_count, last_accessed, source, size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N


def live(cache: DataFrame, now) -> DataFrame:
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.unionByName(cache.join(rows.select("key"), "key", "left_anti"))


def evict(cache: DataFrame, capacity: int) -> DataFrame:
    """What stays when the least recently used rows go: all if within capacity, else capacity less a tenth."""
    n = cache.count()
    if n <= capacity:
        return cache
    return cache.orderBy(F.desc("last_accessed"), F.desc("created_at"), F.desc("key")).limit(capacity - capacity // 10)


def stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.sum("access_count").alias("hits"))


def audit(cache: DataFrame) -> DataFrame:
    """(key, problem): keys that are not in normal form, names that are not valid, and keys that differ only in form."""
    form = N.normalize_name(F.col("key"))
    w = Window.partitionBy(form)
    d = cache.select("key", form.alias("form"), F.count("*").over(w).alias("same"))
    problem = F.when(~N.is_valid_name(F.col("key")), "invalid").when(F.col("same") > 1, "duplicate").when(F.col("key") != F.col("form"), "not normal")
    return d.withColumn("problem", problem).where("problem is not null").select("key", "problem")
