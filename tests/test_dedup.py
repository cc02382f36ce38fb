"""Pairs of concepts by classes and blocks: all of them, against brute force, and many records of one content."""

import time

from pyspark.sql import functions as F

from loomgraph.operators import dedup

FIELDS = "id long, name string, symbol string, description string, definition string, doc_type string"


def test_blocks_give_all_pairs(spark):
    names, more = ["red ring", "Red  ring", "blue ring", "", None], ["x y", "x y z", "", None]
    rows = [(i, names[i % 5], ["s", "", None][i % 3], more[i % 4], more[i // 4 % 4], ["pdf", "html"][i % 2]) for i in range(240)]
    c = spark.createDataFrame(rows, FIELDS)
    for typed in (False, True):
        s = dedup.similarity("a", "b")
        if typed:
            s = F.least(F.lit(1.0), s * F.when(F.col("a.doc_type") == F.col("b.doc_type"), 1.05).otherwise(0.95))
        want = c.alias("a").join(c.alias("b"), F.expr("a.id < b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(s, 6).alias("similarity")).where("similarity >= 0.8")
        got = [tuple(x) for x in dedup.pairs(c, 0.8, typed, block=3).collect()]
        assert len(got) == len(set(got)) and set(got) == {tuple(x) for x in want.collect()} and got


def test_many_records_of_one_content(spark):
    """7,000 records of one content: 24.5 million pairs, of which one is compared."""
    c = spark.range(7000).selectExpr("id", "'red ring' AS name", "cast(null AS string) AS symbol", "'x y' AS description", "'' AS definition", "'pdf' AS doc_type")
    began = time.time()
    assert dedup.pairs(c, 0.8).agg(F.count("*"), F.count_if(F.col("similarity") == 1)).first()[:] == (24_496_500, 24_496_500)
    assert time.time() - began < 45
