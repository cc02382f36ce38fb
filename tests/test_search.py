"""Ranked search: rows that tie in all stated orders come by id, however they are dealt."""

from loomgraph.operators import search as S


def test_ties_by_id(spark):
    c = spark.range(2000).selectExpr("(id * 1237) % 2000 AS id", "'blue promo' AS name", "'' AS context", "'x' AS type", "5L AS frequency", "0.5D AS confidence")
    for n in (1, 7):
        assert [r.id for r in S.search(c.repartition(n), "promo", 20).collect()] == list(range(20))
