"""Enrichment of concepts from offline ontology snapshots, and its audits.

A snapshot row: source, ext_id, label, description, categories (array), confidence. No network is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N

ACCEPT = 0.12
# Weights of words that speak for a concept of finance or of mathematics, and against both.
FINANCE = {"investment": 0.9, "portfolio": 0.9, "asset allocation": 0.9, "markowitz": 0.9, "efficient frontier": 0.9, "capital asset pricing model": 0.9, "risk management": 1.0, "value at risk": 0.9, "sharpe ratio": 0.9, "volatility": 0.8, "variance": 0.8, "finance": 0.7, "financial": 0.7, "market": 0.6, "option": 0.7, "return": 0.7}
MATHS = {"optimization": 0.9, "algorithm": 0.7, "statistics": 0.9, "probability": 0.9, "regression": 0.7, "variance": 0.9, "distribution": 0.8, "matrix": 0.6, "standard deviation": 0.9}
AGAINST = {"film": -0.9, "album": -0.9, "song": -0.9, "band": -0.8, "village": -0.8, "footballer": -0.9, "software": -0.6, "novel": -0.8}


def weigh(words: dict, label, description, categories, per: tuple[float, float, float]):
    """Sum over the words of weight times the factors of the fields they occur in."""
    total = F.lit(0.0)
    cats = F.lower(F.array_join(categories, " "))
    for w, v in words.items():
        for field, p in zip((F.lower(label), F.lower(F.coalesce(description, F.lit(""))), cats), per):
            total = total + F.when(F.contains(field, F.lit(w)), v * p).otherwise(0.0)
    return total


def match_score(type_col, label, description, categories, confidence, name):
    finance = weigh(FINANCE, label, description, categories, (0.7, 0.5, 0.3))
    maths = weigh(MATHS, label, description, categories, (0.4, 0.3, 0.2))
    strong = weigh(MATHS, label, description, categories, (0.7, 0.5, 0.3))
    weak = weigh(FINANCE, label, description, categories, (0.3, 0.2, 0.0))
    against = weigh(AGAINST, label, description, categories, (0.8, 0.5, 0.3))
    acronym = F.try_element_at(N.literal_map(N.ACRONYMS), F.lower(name))
    extra = F.when(acronym == F.lower(label), 1.5).otherwise(0.0) + F.when(F.contains(F.lower(label), F.lit("(finance)")), 2.5).otherwise(0.0)
    return F.greatest(F.lit(0.0), confidence + F.when(type_col.isin("method", "metric"), strong + weak).otherwise(finance + maths) + against + extra)


def candidates(concepts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows that share a looked-up term with a concept: its name or its acronym's long form."""
    term = F.explode(F.array_distinct(F.array_compact(F.array(F.lower("name"), F.try_element_at(N.literal_map(N.ACRONYMS), F.lower("name"))))))
    # A label is looked up as a whole and without a disambiguation in brackets.
    keys = F.explode(F.array_distinct(F.array(F.lower("label"), N.strip(F.regexp_replace(F.lower("label"), r"\(.*\)", "")))))
    return concepts.withColumn("k", term).join(snapshot.withColumn("k", keys).withColumnRenamed("confidence", "ext_confidence").withColumnRenamed("description", "ext_description"), "k").drop("k").distinct()


def best_match(concepts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(id, ext_id, source, label, score) of the best accepted match of each concept."""
    c = candidates(concepts.select("id", "name", "type"), snapshot)
    c = c.withColumn("score", F.round(match_score(F.col("type"), F.col("label"), F.col("ext_description"), F.col("categories"), F.col("ext_confidence"), F.col("name")), 6))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "ext_id")
    return c.where(F.col("score") >= ACCEPT).withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "ext_id", "source", "label", "score")


def apply(concepts: DataFrame, matches: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Concepts with casing fixed, descriptions filled, labels joined to the aliases, and confidence raised by .1 where the match is sure."""
    m = matches.join(snapshot.select("ext_id", F.col("description").alias("d"), F.col("confidence").alias("c")), "ext_id").select("id", F.col("ext_id").alias("match_id"), "label", "d", "c")
    j = concepts.join(m, "id", "left")
    return j.select(
        "id", N.fix_casing(F.col("name")).alias("name"), F.coalesce(F.nullif(F.col("description"), F.lit("")), "d").alias("description"),
        F.array_sort(F.array_union("aliases", F.array_compact(F.array("label")))).alias("aliases"),
        F.when(F.col("c") > 0.5, F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")).alias("confidence"), F.col("match_id").alias("ext_id"),
    )


def merge_sources(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, primary, ext_id, other_id): the first source's match, the second's where the first has none, else as an addition."""
    j = first.select("id", F.col("ext_id").alias("x")).join(second.select("id", F.col("ext_id").alias("y")), "id", "full")
    return j.select("id", F.when(F.col("x").isNotNull(), "first").otherwise("second").alias("primary"), F.coalesce("x", "y").alias("ext_id"), F.when(F.col("x").isNotNull(), F.col("y")).alias("other_id"))


def audit(concepts: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, state): missing, incorrect or correct against the expected external ids."""
    j = expected.join(concepts.select("name", "ext_id"), "name", "left")
    return j.select("name", F.when(F.col("ext_id").isNull(), "missing").when(F.col("ext_id") != F.col("expected_id"), "incorrect").otherwise("correct").alias("state"))


def repair(concepts: DataFrame) -> DataFrame:
    """Flags reset where a concept claims enrichment without an external id or from a local source."""
    bad = F.col("enriched") & (F.col("ext_id").isNull() | (F.col("external_source") == "local"))
    return concepts.withColumns({"was_bad": F.coalesce(bad, F.lit(False))}).withColumns({"enriched": F.col("enriched") & ~F.col("was_bad"), "ext_id": F.when(~F.col("was_bad"), F.col("ext_id"))})


def related_filter(related, unwanted: list[str], keep: int = 5, first: int = 10):
    """At most ``keep`` of the first ``first`` related names that hold none of the unwanted words."""
    ok = lambda x: ~F.exists(F.array(*[F.lit(u) for u in unwanted]), lambda u: F.contains(F.lower(x), u))
    return F.slice(F.filter(F.slice(related, 1, first), ok), 1, keep)
