"""Extraction of equations, concepts, relations and math blocks from text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M
from loomgraph.functions import names as N

WORD = r"[A-Za-z_][A-Za-z0-9_]*"
# Patterns of concepts and relations. One group is a target alone, two are source and target.
EQUATION = rf"({WORD})[ ]*=[ ]*([^=\n]+)"
DEFINITION = rf"(?i)({WORD})[ ]+(?:is|denotes?|represents?)[ ]+(?:the[ ]+)?([^.\n]+)"
FORMULA = rf"(?i)(?:formula|equation|expression)(?:[ ]+for)?[ ]+({WORD})|(?:calculate|compute|determine)[ ]+({WORD})"
LEXICON = {
    "methodology": r"(?i)(portfolio|efficient frontier|mean.variance|markowitz|asset allocation|diversification|risk.return)",
    "metric": r"(?i)(value at risk|expected shortfall|conditional var|volatility|standard deviation|variance|sharpe ratio|information ratio|treynor ratio|alpha|beta|tracking error)",
    "optimization": r"(?i)(optimization|minimize|maximize|objective function|constraint|lagrangian|karush.kuhn.tucker)",
}
RELATIONS = {
    "depends_on": rf"(?i)({WORD})[ ]+(?:depends[ ]+on|(?:is[ ]+)?function[ ]+of)[ ]+({WORD})",
    "derives_from": rf"(?i)({WORD})[ ]+(?:(?:is[ ]+)?derived|follows)[ ]+from[ ]+({WORD})",
    "measures": rf"(?i)({WORD})[ ]+(?:measures|(?:is[ ]+a[ ]+)?measure[ ]+of)[ ]+({WORD})",
    "implies": rf"(?i)({WORD})[ ]+implies[ ]+({WORD})",
    "extends": rf"(?i)({WORD})[ ]+(?:extends|(?:is[ ]+)?(?:an?[ ]+)?extension[ ]+of)[ ]+({WORD})",
    "affects": rf"(?i)({WORD})[ ]+affects?[ ]+({WORD})",
}
UNARY = {"optimizes": rf"(?i)(?:minimize|maximize|optimal)[ ]+({WORD})"}


def pairs(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """(keep, a, b): both groups of every match of a two-group pattern."""
    z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))
    return df.select(*keep, F.explode(z).alias("z")).select(*keep, N.strip(F.col("z.a")).alias("a"), N.strip(F.col("z.b")).alias("b"))


def equations(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return pairs(df, text, EQUATION, *keep)


def lexicon_concepts(df: DataFrame, text: str, lexicon: dict, *keep: str) -> DataFrame:
    """(keep, type, name, n): every hit of the lexicon's patterns, name in lower case with underscores."""
    def typed(k: str):
        return lambda x: F.struct(F.lit(k).alias("type"), F.replace(F.lower(x), F.lit(" "), F.lit("_")).alias("name"))

    every = F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), 1), typed(k)) for k, p in lexicon.items()]))
    return df.select(*keep, F.explode(every).alias("c")).groupBy(*keep, "c.type", "c.name").agg(F.count("*").alias("n"))


def relations(df: DataFrame, text: str, *keep: str, patterns: dict = RELATIONS, unary: dict = UNARY) -> DataFrame:
    """(keep, type, src, dst): stated relations; a unary one has no source."""
    out = None
    for k, p in patterns.items():
        one = pairs(df, text, p, *keep).select(*keep, F.lit(k).alias("type"), F.lower("a").alias("src"), F.lower("b").alias("dst"))
        out = one if out is None else out.union(one)
    for k, p in unary.items():
        one = df.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(p), 1)).alias("b"))
        out = out.union(one.select(*keep, F.lit(k), F.lit(None).cast("string"), F.lower("b")))
    return out


def equation_relations(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, src, dst): the left variable of an equation depends on those of its right side."""
    e = equations(df, text, *keep)
    rhs = F.explode(F.array_distinct(F.regexp_extract_all("b", F.lit(f"({WORD})"), 1)))
    return e.select(*keep, F.col("a").alias("src"), rhs.alias("dst")).where("src <> dst").distinct()


def cooccurrence(df: DataFrame, key: str, text: str, vocabulary: list[str], window: int, least: int = 2) -> DataFrame:
    """(a, b, n, confidence): vocabulary words within ``window`` words, a < b, counted over all texts.

    Words are kept by a literal set before the join; positions are dealt into buckets of the window's
    width, so the range join is an equi-join on (text, bucket) and its neighbour.
    """
    t = df.select(key, F.posexplode(N.tokens(F.col(text))).alias("pos", "w")).where(F.col("w").isin(vocabulary))
    left = t.select(key, F.col("w").alias("a"), F.col("pos").alias("pa"), F.explode(F.expr(f"array(pos div {window}, pos div {window} + 1, pos div {window} - 1)")).alias("k"))
    right = t.select(key, F.col("w").alias("b"), F.col("pos").alias("pb"), F.expr(f"pos div {window}").alias("k"))
    j = left.join(right, [key, "k"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) <= window))
    n = j.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("confidence", F.round(F.least(F.lit(0.6), 0.1 * F.col("n")), 6))


def keep_best(df: DataFrame, key, confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """Per key the first row of the highest confidence, with its own aliases and those of every later row."""
    w = Window.partitionBy("_k").orderBy(F.desc(confidence), seq)
    d = df.withColumn("_k", key).withColumn("_first", F.first(seq).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = d.where(F.col(seq) >= F.col("_first")).groupBy("_k")
    cols = [c for c in df.columns if c not in ("aliases", "_k")]
    return g.agg(F.min_by(F.struct(*cols), seq).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases")).select("r.*", "aliases")


def lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, line, start, body): lines with the code points before them."""
    parts = F.split(text, "\n")
    z = df.select(*keep, F.posexplode(parts).alias("line", "body"))
    w = Window.partitionBy(*keep).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return z.withColumn("start", F.coalesce(F.sum(F.length("body") + 1).over(w), F.lit(0)).cast("long"))


def math_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Lines scored as mathematics, with their offset, the lines around them and their group; all inside the row, no shuffle."""
    d = df.select(*keep, F.split(text, "\n").alias("_l"))
    scored = F.transform("_l", lambda b, i: F.struct(i.alias("line"), b.alias("body"), M.line_score(b).alias("score")))
    d = d.select(*keep, "_l", F.explode(F.filter(scored, lambda x: x["score"] >= 3)).alias("h"))
    i = F.col("h.line")
    start = F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice("_l", F.lit(1), i), "\n")) + 1).cast("long")
    return d.select(*keep, i.alias("line"), F.col("h.body").alias("body"), start.alias("start"), F.get("_l", i - 1).alias("before"), F.get("_l", i + 1).alias("after"), F.col("h.score").alias("score"), M.semantic_group(F.col("h.body")).alias("grp"))


def line_pairs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Neighbouring short lines where the first has a sign and the second a variable: an equation over two lines."""
    w = Window.partitionBy(*keep).orderBy("line")
    d = lines(df, text, *keep).withColumn("next", F.lead("body").over(w))
    return d.where((F.length("body") < 50) & (F.length("next") < 50) & F.regexp_like("body", F.lit("[=+-]")) & F.regexp_like("next", F.lit("[xyrR()]")))


def block_links(blocks: DataFrame) -> DataFrame:
    """(doc_id, a, b): blocks of a document that share a variable or, other than general, a group."""
    v = blocks.select("doc_id", "block", F.explode(M.variables(F.col("body"))).alias("k"))
    g = blocks.where("grp <> 'general_math'").select("doc_id", "block", F.concat(F.lit("#"), "grp").alias("k"))
    u = v.union(g)
    return u.select("doc_id", F.col("block").alias("a"), "k").join(u.select("doc_id", F.col("block").alias("b"), "k"), ["doc_id", "k"]).where("a < b").select("doc_id", "a", "b").distinct()


def strength(total):
    return F.when(total >= 0.9, "very_strong").when(total >= 0.7, "strong").when(total >= 0.5, "moderate").otherwise("weak")


METHODS = {"math": 1.0, "semantic": 0.8, "regex": 0.6, "context": 0.4, "ocr": 0.3}


def score_relations(cand: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Candidates (src, dst, type, confidence, method, context, src_type, dst_type) to scored relations of at least 0.3."""
    g = N.literal_map(groups)
    m = F.try_element_at(N.literal_map(METHODS), F.col("method"))
    maths = F.when(F.col("method") == "math", 0.5).otherwise(0.0) + F.when(F.regexp_like("context", F.lit(r"[=+*/^-]")), 0.3).otherwise(0.0) + F.when(F.regexp_like("context", F.lit("[∑∏∫∂]")), 0.4).otherwise(0.0)
    e = cand.groupBy("src", "dst", "type").agg(F.max("confidence").alias("base"), F.max(m).alias("how"), F.count("*").alias("n"), F.least(F.lit(1.0), F.sum(maths)).alias("maths"), F.min("src_type").alias("st"), F.min("dst_type").alias("dt"))
    near = F.when(F.try_element_at(g, F.col("src")) == F.try_element_at(g, F.col("dst")), 0.8).when(F.col("st") == F.col("dt"), 0.6).otherwise(0.2)
    total = 0.25 * F.col("base") + 0.2 * F.col("how") + 0.15 * F.least(F.lit(1.0), 0.2 * F.col("n")) + 0.2 * near + 0.1 * F.col("maths") + 0.01
    return e.withColumn("total", F.round(total, 6)).where("total >= 0.3").withColumn("strength", strength(F.col("total"))).select("src", "dst", "type", "n", "total", "strength")
