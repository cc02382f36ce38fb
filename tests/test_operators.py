"""Operators against plain computations on small random inputs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import chunks, dedup, graph


def test_dedup_finds_all_pairs(spark):
    r = random.Random(3)
    say = lambda n: " ".join(r.choice("alpha beta risk rate of the model price curve value".split()) for _ in range(n))
    rows = [(i, r.choice((say(r.randint(1, 8)), None, "")), r.choice((None, "", say(1), say(2))), r.choice((None, say(r.randint(1, 9)))), r.choice((None, say(4))), r.choice(("pdf", "html"))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, name string, symbol string, description string, definition string, doc_type string")
    a, b = df.alias("a"), df.alias("b")
    s = a.join(b, F.expr("a.id < b.id")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), dedup.similarity("a", "b").alias("s"), (F.col("a.doc_type") == F.col("b.doc_type")).alias("same")).collect()
    got = {(x.a, x.b) for x in dedup.pairs(df).collect()}
    assert got == {(x.x, x.y) for x in s if round(x.s, 6) >= 0.85} and len(got) > 20
    typed = {(x.a, x.b) for x in dedup.pairs(df, typed=True).collect()}
    assert typed == {(x.x, x.y) for x in s if round(min(1.0, x.s * (1.05 if x.same else 0.95)), 6) >= 0.85}


def test_strong_components(spark):
    r = random.Random(5)
    edges = list({(r.randrange(14), r.randrange(14)) for _ in range(30)})
    reach = {(v, v) for e in edges for v in e} | set(edges)
    for k, i, j in itertools.product(range(14), repeat=3):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    want = {v: min(w for w in range(14) if (v, w) in reach and (w, v) in reach) for e in edges for v in e}
    got = {x.id: x.component for x in graph.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_nearest_vectors_in_blocks(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    want = sorted((q, j, float(sim[q, j])) for q in range(0, 60, 7) for j in sorted((j for j in range(60) if j != q), key=lambda j: (-sim[q, j], j))[:4])
    for block in (100, 3):
        assert sorted((x.q, x.id, round(x.similarity, 6)) for x in chunks.top_k(df, df.where("id % 7 = 0"), 4, block).collect()) == [(a, b, round(c, 6)) for a, b, c in want]
    assert chunks.top_k(df, df.limit(0), 4).count() == 0


def test_markers_go_before_mathematical_lines(spark):
    import re

    from loomgraph.operators import views

    rows = [(1, "plain words\nx_1 = a + b * c\nmore\n∑ y^2 = z - 1"), (2, "no mathematics here"), (3, "")]
    got = {r.doc_id: r for r in views.with_markers(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1].text.split("\n")[1].startswith("[MATHREF_1_1] @") and got[1].text.split("\n")[3].startswith("[MATHREF_1_3] @") and got[1].n == 2
    assert all(re.sub(r"\[MATHREF_[0-9_]+\] @[a-z_]+: ", "", got[i].text) == t for i, t in rows) and got[2].n == got[3].n == 0
