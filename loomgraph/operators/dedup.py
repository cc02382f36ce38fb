"""Concept deduplication: blocked similarity join, groups, merged records.

Concepts: id, name, symbol, description, definition, doc_type, confidence, source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions.mathtext import bind
from loomgraph.operators import graph
from loomgraph.operators.graph import cut

THRESHOLD = 0.85
WEIGHTS = (("name", 0.4), ("symbol", 0.3), ("description", 0.2), ("definition", 0.1))
PRIORITY = {"pdf": 5, "latex": 4, "docx": 3, "html": 2, "xml": 1}


def similarity(a: str, b: str):
    """1 where name or symbol agree; else the weighted mean of Jaccards over fields that both have."""
    col = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(""))
    both = lambda c: (col(a, c) != "") & (col(b, c) != "")
    same = lambda c: both(c) & (N.squash(col(a, c)) == N.squash(col(b, c)))
    total = sum((F.when(both(c), w * N.jaccard(col(a, c), col(b, c))).otherwise(0.0) for c, w in WEIGHTS), F.lit(0.0))
    weight = sum((F.when(both(c), w).otherwise(0.0) for c, w in WEIGHTS), F.lit(0.0))
    return F.when(same("name") | same("symbol"), 1.0).when(weight > 0, total / weight).otherwise(0.0)


def _read(concepts: DataFrame, *keep: str) -> DataFrame:
    """(keep, a struct a field): whether it has a text, the text squashed, its words; read once a record and not once a pair."""
    one = lambda c: F.struct((F.coalesce(F.col(c), F.lit("")) != "").alias("has"), N.squash(F.col(c)).alias("text"), N.word_set(F.col(c)).alias("words")).alias(c)
    return concepts.select(*keep, *[one(c) for c, _ in WEIGHTS])


def _alike(a: str, b: str):
    """``similarity`` of two rows of ``_read``."""
    both = lambda c: F.col(f"{a}.{c}.has") & F.col(f"{b}.{c}.has")
    equal = lambda c: F.col(f"{a}.{c}.text") == F.col(f"{b}.{c}.text")
    same = lambda c: both(c) & equal(c)

    def jaccard(c: str):
        x, y = F.col(f"{a}.{c}.words"), F.col(f"{b}.{c}.words")
        of = lambda n: n / (F.size(x) + F.size(y) - n)
        return F.when(equal(c), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(bind(F.size(F.array_intersect(x, y)), of))

    total = sum((F.when(both(c), w * jaccard(c)).otherwise(0.0) for c, w in WEIGHTS), F.lit(0.0))
    weight = sum((F.when(both(c), w).otherwise(0.0) for c, w in WEIGHTS), F.lit(0.0))
    return F.when(same("name") | same("symbol"), 1.0).when(weight > 0, total / weight).otherwise(0.0)


def _candidates(concepts: DataFrame, least: float) -> DataFrame:
    """(x, y) of x < y that may have a similarity of ``least``; no other pair has.

    Equal names or symbols meet by their text. Else let f be the heaviest field that both have: with all
    lighter fields equal, the Jaccard of f must still be 1 - (1 - least) W / w, W the weight from f on. Two
    word sets of that Jaccard share one of the rarest words of both (prefixes), so frequent words make no pairs.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    equal = None
    for c in ("name", "symbol"):
        one = concepts.where(text(c) != "").select("id", F.concat(F.lit(f"{c} "), N.squash(F.col(c))).alias("k"))
        equal = one if equal is None else equal.union(one)
    need = {c: 1 - (1 - least) * sum(w for _, w in WEIGHTS[i:]) / WEIGHTS[i][1] for i, (c, _) in enumerate(WEIGHTS)}
    # Fields heavier than f, as bits: two records that both have one of them do not meet by f.
    bits = lambda fields: sum((F.when(text(c) != "", 1 << WEIGHTS.index((c, w))).otherwise(0) for c, w in fields), F.lit(0))
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), N.word_set(F.col(c)).alias("ws"), F.lit(t).alias("t"), bits(WEIGHTS[:i]).alias("has")) for i, (c, t) in enumerate(need.items())])).alias("s")
    words = concepts.select("id", sets).select("id", "s.f", "s.t", "s.has", F.size("s.ws").alias("n"), F.explode("s.ws").alias("w"))
    words = words.join(words.groupBy("f", "w").agg(F.count("*").alias("m")).where("m > 1"), ["f", "w"])
    rank = Window.partitionBy("id", "f").orderBy("m", "w")
    # Words that one record alone has come first in its order, and are not seen here.
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id", "f"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.col("t") - 1e-9) + 1
    words = words.withColumn("at", alone + F.row_number().over(rank)).where(F.col("at") <= prefix).withColumn("k", F.concat("f", F.lit(":"), "w"))
    sized = words.select("id", "k", "n", "t", "has")
    other = sized.select(F.col("id").alias("y"), "k", F.col("n").alias("ny"), F.col("has").alias("also"))
    meet = (F.col("id") < F.col("y")) & (F.least("n", "ny") >= F.greatest("n", "ny") * F.col("t") - 1e-9) & (F.col("has").bitwiseAND(F.col("also")) == 0)
    near = sized.join(other, "k").where(meet).select(F.col("id").alias("x"), "y")
    same = equal.select("k", F.col("id").alias("x")).join(equal.select("k", F.col("id").alias("y")), "k").where("x < y").select("x", "y")
    return near.union(same).distinct()


#: Records of one content that are one row; pairs of records are made from two such rows inside a task.
BLOCK = 1000


def pairs(concepts: DataFrame, threshold: float = THRESHOLD, typed: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of a < b at the threshold or above; all of them.

    Records of equal fields are one class, and classes are compared, not records. A class's ids are dealt into rows of
    about ``block``; each two rows of similar classes meet once and yield their pairs there. So what is compared grows
    with distinct contents, and what is shuffled with them and the pairs' number divided by the block; only the result has
    all pairs. Ids are distinct and never null.
    """
    fields = [c for c, _ in WEIGHTS] + (["doc_type"] if typed else [])
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias("class")
    own = concepts.select("id", *fields, digest)
    classes = cut(own.groupBy(F.col("class").alias("id")).agg(*[F.first(c).alias(c) for c in fields], F.count("*").alias("size")))
    dealt = own.select("id", "class").join(classes.select(F.col("id").alias("class"), "size"), "class")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).alias("part")
    held = cut(dealt.select("id", "class", part).groupBy("class", "part").agg(F.collect_list("id").alias("ids")))
    cand = _candidates(classes, threshold / 1.05 if typed else threshold).union(classes.where("size > 1").select(F.col("id").alias("x"), F.col("id").alias("y")))
    texts = cut(_read(classes, "id", *(["doc_type"] if typed else [])))
    j = cand.join(texts.alias("a"), F.col("x") == F.col("a.id")).join(texts.alias("b"), F.col("y") == F.col("b.id"))
    s = _alike("a", "b")
    if typed:
        s = F.least(F.lit(1.0), s * F.when(F.col("a.doc_type") == F.col("b.doc_type"), 1.05).otherwise(0.95))
    like = j.select("x", "y", F.round(s, 6).alias("similarity")).where(F.col("similarity") >= threshold)
    left = held.select(F.col("class").alias("x"), F.col("part").alias("i"), F.col("ids").alias("p"))
    right = held.select(F.col("class").alias("y"), F.col("part").alias("j"), F.col("ids").alias("q"))
    met = like.join(left, "x").join(right, "y").where("x <> y OR i <= j").repartition("x", "y", "i", "j")
    inner = (F.col("x") == F.col("y")) & (F.col("i") == F.col("j"))  # two ids of one row come twice
    each = met.select("similarity", inner.alias("inner"), "q", F.explode("p").alias("p")).select("similarity", "inner", "p", F.explode("q").alias("q"))
    return each.where("p < q OR (p > q AND NOT inner)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def groups(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, grp): connected components of the links; others are alone."""
    c = graph.components(links, "a", "b")
    return concepts.select("id").join(c, "id", "left").select("id", F.coalesce("component", "id").alias("grp"))


def merge(concepts: DataFrame, placed: DataFrame) -> DataFrame:
    """One record a group: the most complete record's name, longest texts, best confidence, all sources."""
    full = N.completeness(F.col("name"), F.col("description"), F.col("definition"), F.col("symbol"), F.lit(0))
    d = concepts.join(placed, "id").withColumn("full", full)
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("id"))).alias(c)
    return d.groupBy("grp").agg(
        F.max_by("name", F.struct("full", -F.col("id"))).alias("name"), longest("description"), longest("definition"),
        F.max("confidence").alias("confidence"), F.count("*").alias("merged_from"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def best_by_type(concepts: DataFrame, placed: DataFrame) -> DataFrame:
    """(grp, id, doc_type): the base record of each group by type priority, then completeness."""
    full = N.completeness(F.col("name"), F.col("description"), F.col("definition"), F.col("symbol"), F.lit(0))
    rank = F.coalesce(F.try_element_at(N.literal_map(PRIORITY), F.col("doc_type")), F.lit(0))
    w = Window.partitionBy("grp").orderBy(F.desc("rank"), F.desc("full"), "id")
    return concepts.join(placed, "id").withColumns({"rank": rank, "full": full}).withColumn("n", F.row_number().over(w)).where("n = 1").select("grp", "id", "doc_type")
