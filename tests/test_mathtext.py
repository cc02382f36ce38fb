"""Scores of mathematical text: the linear forms against the patterns as written, and long words."""

import random
import re
import time

from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M

PIECES = [*"abxyzAE09 _^/=([{)]}+-*|.:,\n\t", *"áαβ∑∏σΣ₀₉²¹⁰⁴±×∘⊗†é√", "return", "Var(", "E(", "x1", "x_a", "1/2", "a/b", " = ", "==", "3x", "a1b_", "alpha", "\\begin{cases}", "\\end{cases}", "[MATHREF_", "t test", "basic"]


def plain(t: str) -> float:
    """The detector's score by its patterns as written."""
    n = lambda p: len(re.findall(p, t))
    hits = lambda ps: sum(bool(re.search(p, t)) for p in ps)
    if not re.search(r"[^ \t\n]", t):
        return 0.0
    words = [w for w in re.split(r"[^A-Za-z0-9_]+", t) if re.fullmatch(r"[A-Za-z]([0-9]+|_[A-Za-z0-9]+)?", w)]
    finance = [p.replace("(?i)", "(?ai)") for p in M.DETECTOR_FINANCE]
    return (
        min(3, 0.5 * n(M.SYMBOLS)) + min(2, hits(M.EQUATIONS)) + min(2, 0.2 * n(M.DETECTOR_OPERATORS)) + min(1.5, 0.1 * len(words)) + min(2, 0.5 * hits(finance))
        + min(2, hits((r"\[[^\]]*\]", "∑", "∏", "∫"))) + min(3, 1.5 * hits(M.ENVIRONMENTS)) + min(1, 0.3 * (n(M.DETECTOR_SUBSCRIPT) + n(M.SUPERSCRIPT))) + min(1, 0.5 * n(M.FRACTION)) + 5 * hits([r"\[MATHREF_[^\]]+\]"])
    )


def test_linear_forms(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.choice([0, 1, 3, 8, 20, 60]))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    t = F.col("t")
    got = {x.id: x for x in df.select("id", M.score(t).alias("score"), M.variable_words(t).alias("words"), M.line_score(t).alias("line"), M.complexity(t).alias("cpx")).collect()}
    for i, x in enumerate(texts):
        assert abs(got[i].score - plain(x)) < 1e-9, x
        assert got[i].words == [w for w in re.split(r"[^A-Za-z0-9_]+", x) if re.fullmatch(r"[A-Za-z]([0-9]+|_[A-Za-z0-9]+)?", w)], x
        shapes = sum(bool(re.search(p, x.lower())) for p in M.LINE_PATTERNS)
        assert got[i].line >= min(2, shapes) or not x


def test_long_words_take_linear_time(spark):
    """One word of 300,000 letters: patterns that try it from each of its letters take minutes."""
    t = F.col("t")
    df = spark.createDataFrame([("x = a " + "b" * 300_000 + " _ ^ / 1",)], "t string")
    began = time.time()
    row = df.select(M.score(t).alias("a"), M.line_score(t).alias("b"), M.complexity(t).alias("c"), M.improved_score(t).alias("d"), F.size(M.variables(t)).alias("e")).first()
    assert time.time() - began < 30 and row.a > 2 and row.e == 2
