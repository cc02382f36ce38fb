"""Composed extraction: the same concepts and relations with gates and linear forms, at one computation each, and in linear time."""

import time

from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M
from loomgraph.operators import compose as C


def rows(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page int, text string")


def test_every_pattern_needs_its_words():
    every = [*C.EQUATIONS, *C.DEFINITIONS, *C.FORMULAS, *C.ASSIGNMENTS, *C.CALLS, *(p for d in (C.RELATIONS, C.SEMANTIC) for ps in d.values() for p in ps), *(p for _, ps in C.FINANCE.values() for p in ps)]
    assert all(C.NEEDS[p] for p in every)


def test_forms_match_in_any_case(spark):
    r = rows(spark, "3x_1 DEPENDS on y. 2b Is Derived From c", "Outlet x\nis A of y", "f(a, b) := c = d : e", "If p THEN q; u extends v, w Is an extension of z", "α_1 Value At Risk, Efficient frontier")
    f = C._pairs(r, "doc_id", C.RELATIONS | C.SEMANTIC | {"call": C.CALLS, "set": C.ASSIGNMENTS}, 0.7, "x")
    got = {(x.doc_id, x.a, x.b.strip(), x.type) for x in f.collect()}
    assert got == {(0, "x_1", "y", "depends_on"), (0, "b", "c", "derives_from"), (2, "f", "a, b", "call"), (2, "c", "d : e", "set"), (3, "p", "q", "implies"), (3, "u", "v", "extends"), (3, "w", "z", "extends")}
    names = {(x.doc_id, x.name, x.type) for x in C.concepts(r).collect()}
    assert {(1, "x", "variable"), (4, "value_at_risk", "metric"), (4, "efficient_frontier", "methodology")} <= names


def test_skipped_sentences_have_no_mathematics(spark):
    """What is not scored could not have counted."""
    t = F.col("text")
    best = "a b c d e f g h i j k l m n o p q r s t é alpha beta return portfolio"
    x = rows(spark, best).select(M.has(t, C.MATHEMATICAL).alias("read"), M.score(t).alias("score")).first()
    assert not x.read and x.score < 5.4


def test_near_counts_pairs(spark):
    words = ["a", "x", "b", "a", *["x"] * 9, "b"]
    known = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (1, 1, "x")], "doc_id long, page int, k string")
    got = {(x.src, x.dst): x.n for x in C.near(rows(spark, " ".join(words)), known, "doc_id", F.split("text", " "), 10).collect()}
    want = {}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if i != j and abs(i - j) <= 10 and {a, b} <= {"a", "b"}:
                want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_long_words_take_linear_time(spark):
    """A word of 200,000 letters in a text and in a sentence with many variables: patterns that begin with a name tried it from each letter."""
    r = rows(spark, "x1 = y2 + z3 * (w4 / v5) - w5 is " + "b" * 200_000 + " c", "risk " + "d" * 200_000)
    began = time.time()
    found = C.concepts(r).drop("complexity", "domain")
    assert found.count() and C.relations(r, found).count() >= 0 and time.time() - began < 60
