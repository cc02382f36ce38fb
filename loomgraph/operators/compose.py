"""Composed extraction: documents to pages and sentences, to concepts and relations, to rows of a graph.

A page's sentences give concepts (mathematical variables and equations, finance terms, definitions,
formula mentions) in one pass over arrays inside the row; one row per normalised name stays. Relations
are stated, come from equations, or from words near each other, and hold between concepts of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M
from loomgraph.functions import names as N

NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
#: The name that a pattern begins with: the same matches, but one that fails at its first letter is not tried at the others.
LEAD = r"(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_]*+)"
S = r"[ \t\r\n\f]"
# Patterns of equations, definitions, formulas and relations, and finance terms by category.
# White space and word characters are written out, so that every engine reads them alike.
EQUATIONS = (rf"{LEAD}{S}*={S}*([^=\n]+)", rf"{LEAD}{S}*:{S}*([^:\n]+)", rf"(?i)let{S}+{NAME}{S}+(?:be|denote|represent){S}+([^.\n]+)")
DEFINITIONS = (rf"(?i)(?:where|let){S}+{NAME}{S}+(?:is|denotes?|represents?){S}+([^.\n]+)", rf"{LEAD}(?i:{S}+(?:is|denotes?|represents?){S}+(?:the{S}+)?)([^.\n]+)")
FORMULAS = (rf"(?i)(?:formula|equation|expression)(?:{S}+for)?{S}+{NAME}", rf"(?i)(?:calculate|compute|determine){S}+{NAME}")
FINANCE = {
    "portfolio_theory": ("methodology", ("portfolio|efficient frontier|mean.variance|markowitz", "asset allocation|diversification|risk.return")),
    "risk_metrics": ("metric", ("value at risk|var|expected shortfall|conditional var", "volatility|standard deviation|variance")),
    "optimization": ("optimization", ("optimization|minimize|maximize|objective function", "constraint|lagrangian|karush.kuhn.tucker")),
    "performance": ("metric", ("sharpe ratio|information ratio|treynor ratio", "alpha|beta|jensen.alpha|tracking error")),
}
RELATIONS = {
    "depends_on": (rf"{LEAD}(?i:{S}+depends{S}+on{S}+){NAME}", rf"{LEAD}(?i:{S}+(?:is{S}+)?function{S}+of{S}+){NAME}"),
    "derives_from": (rf"{LEAD}(?i:{S}+(?:is{S}+)?derived{S}+from{S}+){NAME}", rf"{LEAD}(?i:{S}+follows{S}+from{S}+){NAME}"),
    "measures": (rf"{LEAD}(?i:{S}+measures{S}+){NAME}", rf"{LEAD}(?i:{S}+(?:is{S}+a{S}+)?measure{S}+of{S}+){NAME}"),
}
ASSIGNMENTS = (rf"{LEAD}{S}*={S}*([^=\n]+)", rf"{LEAD}{S}*:={S}*([^=\n]+)")
CALLS = (rf"{LEAD}{S}*\({S}*([A-Za-z0-9_, \t\r\n\f]*){S}*\)", rf"{LEAD}{S}*={S}*f{S}*\({S}*([A-Za-z0-9_, \t\r\n\f]*){S}*\)")
SEMANTIC = {
    "defines": (rf"{LEAD}(?i:{S}+(?:is{S}+)?defined{S}+as{S}+)([^.]+)", rf"(?i)define{S}+{NAME}{S}+as{S}+([^.]+)"),
    "implies": (rf"{LEAD}(?i:{S}+implies{S}+){NAME}", rf"(?i)if{S}+{NAME}{S}+then{S}+{NAME}"),
    "extends": (rf"{LEAD}(?i:{S}+extends{S}+){NAME}", rf"{LEAD}(?i:{S}+(?:is{S}+)?(?:an?{S}+)?extension{S}+of{S}+){NAME}"),
}
PREREQUISITES = (
    rf"(?i)assumes?{S}+(?:familiarity{S}+with|knowledge{S}+of|understanding{S}+of){S}+([^.,;]+)",
    rf"(?i)requires?{S}+(?:knowledge{S}+of|understanding{S}+of|familiarity{S}+with){S}+([^.,;]+)",
    rf"(?i)builds?{S}+(?:on|upon){S}+([^.,;]+)",
    rf"(?i)based{S}+on{S}+([^.,;]+)",
    rf"(?i)given{S}+(?:knowledge{S}+of|understanding{S}+of){S}+([^.,;]+)",
    rf"(?i)prerequisites?{S}*:{S}*([^.,;]+)",
    rf"(?i)background{S}+in{S}+([^.,;]+)",
)
#: One of these a text must hold in lower case for the pattern to match; with none of them it is not read with it.
NEEDS = dict(zip(EQUATIONS + DEFINITIONS + FORMULAS, (("=",), (":",), ("let",), ("where", "let"), ("is", "denote", "represent"), ("formula", "equation", "expression"), ("calculate", "compute", "determine"))))
NEEDS |= dict(zip((p for ps in RELATIONS.values() for p in ps), (("depends",), ("function",), ("derived",), ("follows",), ("measures",), ("measure",))))
NEEDS |= dict(zip(ASSIGNMENTS + CALLS, (("=",), (":=",), ("(",), ("(",))))
NEEDS |= dict(zip((p for ps in SEMANTIC.values() for p in ps), (("defined",), ("define",), ("implies",), ("then",), ("extends",), ("extension",))))
NEEDS |= {p: tuple(M.literals(p)) for _, ps in FINANCE.values() for p in ps}
#: A sentence without such a character scores at most 2 (variables, a finance term), and 5.4 is needed.
MATHEMATICAL = r"[=+*/^()\[\]{}|\\_\x80-\xBF×÷\u0100-\uFFFF-]"


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, page, text): the pages of each document, from 1."""
    return docs.select(key, F.posexplode(N.pack_pages(F.col(text))).alias("p", "text")).select(key, (F.col("p") + 1).alias("page"), "text")


def _all(c: Column, low: Column, pattern: str, group: int = 1, spelt: str | None = None) -> Column:
    """The group of every match, read only where the pattern can match. low: the text in lower case; spelt: the pattern, where it wraps the one known to NEEDS."""
    none = F.array().cast("array<string>")
    return F.when(M.contains_any(low, NEEDS[pattern]), F.regexp_extract_all(c, F.lit(spelt or pattern), F.lit(group))).otherwise(none)


def _zip(c: Column, low: Column, pattern: str) -> Column:
    """Array of struct(a, b): both groups of every match."""
    return F.arrays_zip(_all(c, low, pattern, 1).alias("a"), _all(c, low, pattern, 2).alias("b"))


def _concept(name: Column, kind: str, confidence, method: str) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), conf.cast("double").alias("confidence"), F.lit(method).alias("method"))


def _each(names: Column, spelt, kind: str, confidence, method: str) -> Column:
    return F.transform(names, lambda v: _concept(spelt(v), kind, confidence, method))


def found_in(s: Column, low: Column, total: Column) -> Column:
    """Concepts of a sentence, its lower case and its score, in the order of the extractors: mathematics, finance, definitions, formulas."""
    sure = M.confidence(total)
    maths = [F.transform(M.variables(s), lambda v: _concept(v, "variable", sure, "math"))]
    maths += [F.transform(_all(s, low, p), lambda v: _concept(v, "equation", sure, "math")) for p in EQUATIONS]
    none = F.array().cast("array<struct<name:string,type:string,confidence:double,method:string>>")
    out = [F.when((total >= 3) & (sure > 0.3), F.concat(*maths)).otherwise(none)]
    for kind, patterns in FINANCE.values():
        for p in patterns:
            out.append(_each(_all(s, low, p, spelt=f"(?i)({p})"), lambda v: F.replace(F.lower(v), F.lit(" "), F.lit("_")), kind, 0.8, "regex"))
    out += [F.transform(_all(s, low, p), lambda v: _concept(v, "variable", 0.7, "semantic")) for p in DEFINITIONS]
    out += [F.transform(_all(s, low, p), lambda v: _concept(v, "formula", 0.6, "regex")) for p in FORMULAS]
    return F.concat(*out)


def concepts(page_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, norm, name, type, confidence, method, n): the best concept of each normalised name of a page, the first of equals.

    Complexity level and domain of the page come with every concept of it; where nobody reads them, they are not computed.
    """
    about = ("complexity", "domain")
    d = page_rows.select(key, "page", "text", M.level(F.col("text")).alias("complexity"), M.domain(F.col("text")).alias("domain"))
    sent = d.select(key, "page", *about, F.posexplode(N.sentences(F.col("text"))).alias("n", "s"))
    total = F.when(M.has(F.col("s"), MATHEMATICAL), M.score(F.col("s"))).otherwise(0.0)
    sent = sent.select(key, "page", *about, "n", "s", F.lower("s").alias("low"), total.alias("total"))
    every = sent.select(key, "page", *about, "n", F.posexplode(found_in(F.col("s"), F.col("low"), F.col("total"))).alias("i", "c"))
    seen = every.select(key, "page", *about, "n", "i", N.normalize_name(F.col("c.name")).alias("norm"), "c.*")
    best = F.min_by(F.struct("name", "type", "confidence", "method"), F.struct(-F.col("confidence"), "n", "i")).alias("c")
    return seen.groupBy(key, "page", "norm").agg(best, F.count("*").alias("n"), *[F.first(x).alias(x) for x in about]).select(key, "page", "norm", "c.*", "n", *about)


def _named(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows (key, page, src, dst, ...) both of whose ends are known (key, page, k), with the known names."""
    for end in ("src", "dst"):
        k = known.select(key, "page", F.col("k").alias(end), F.col("name").alias(f"{end}_name"))
        rows = rows.join(k, [key, "page", end])
    return rows.select(key, "page", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), *[c for c in rows.columns if c not in (key, "page", "src", "dst", "src_name", "dst_name")])


def _pairs(page_rows: DataFrame, key: str, patterns: dict, confidence: float, method: str) -> DataFrame:
    """(key, page, a, b, type, confidence, method) of every match of the two-group patterns, read in one pass."""
    typed = lambda z, k: F.transform(z, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(k).alias("type")))
    every = F.concat(*[typed(_zip(F.col("text"), F.col("low"), p), k) for k, ps in patterns.items() for p in ps])
    d = page_rows.select(key, "page", "text", F.lower("text").alias("low")).select(key, "page", F.explode(every).alias("m"))
    return d.select(key, "page", "m.*", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def near(page_rows: DataFrame, known: DataFrame, key: str, words: Column, window: int) -> DataFrame:
    """(key, page, src, dst, n): pairs of occurrences of known words (key, page, k) within ``window`` words, either order.

    A page's known words come to its row; its other words are dropped and pairs counted there, so that no word is shuffled.
    """
    names = known.groupBy(key, "page").agg(F.collect_set("k").alias("names"))
    placed = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("k"))), lambda x: F.array_contains("names", x["k"]))
    d = page_rows.join(names, [key, "page"]).select(key, "page", placed.alias("at"))

    def around(x: Column, i: Column) -> Column:
        close = F.slice("at", F.greatest(i + 1 - window, F.lit(1)), F.lit(2 * window + 1))
        close = F.filter(close, lambda y: (y["pos"] != x["pos"]) & (F.abs(y["pos"] - x["pos"]) <= window))
        return F.struct(x["k"].alias("src"), F.transform(close, lambda y: y["k"]).alias("close"))

    j = d.select(key, "page", F.explode(F.transform("at", around)).alias("x")).select(key, "page", F.col("x.src").alias("src"), F.explode("x.close").alias("dst"))
    return j.groupBy(key, "page", "src", "dst").agg(F.count("*").alias("n"))


def relations(page_rows: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, src, dst, type, confidence, method): relations between the concepts of a page, the surest of each pair and type."""
    stated = _pairs(page_rows, key, RELATIONS, 0.7, "regex")
    stated = stated.select(key, "page", N.normalize_name(F.col("a")).alias("src"), N.normalize_name(F.col("b")).alias("dst"), "type", "confidence", "method")
    stated = _named(stated, found.select(key, "page", F.col("norm").alias("k"), "name"), key)
    low = found.select(key, "page", F.lower("name").alias("k")).distinct()
    eq = _pairs(page_rows, key, {"depends_on": EQUATIONS}, 0.8, "math")
    eq = eq.select(key, "page", F.explode(M.variables(F.col("a"))).alias("v"), "b", "type", "confidence", "method")
    eq = eq.select(key, "page", "v", F.explode(M.variables(F.col("b"))).alias("w"), "type", "confidence", "method")
    for end in ("v", "w"):
        eq = eq.withColumn("k", F.lower(end)).join(low, [key, "page", "k"], "left_semi").drop("k")
    eq = eq.select(key, "page", F.col("v").alias("src"), F.col("w").alias("dst"), "type", "confidence", "method")
    split = F.array_remove(F.split(F.lower("text"), rf"{S}+"), "")
    context = near(page_rows, low, key, split, 10).select(key, "page", "src", "dst", F.lit("mentions").alias("type"), F.lit(0.3).alias("confidence"), F.lit("context").alias("method"))
    every = stated.unionByName(eq).unionByName(context)
    return every.groupBy(key, "page", F.lower("src").alias("src"), F.lower("dst").alias("dst"), "type").agg(F.max("confidence").alias("confidence"), F.max_by("method", "confidence").alias("method"))


def discover(page_rows: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, src, dst, type, method, confidence, n): further candidates between known names, as written: assignments, calls, semantic phrases, co-occurrence."""
    known = found.select(key, "page", F.col("name").alias("k")).distinct()
    rows = _pairs(page_rows, key, {"depends_on": ASSIGNMENTS}, 0.8, "math").withColumn("self", F.lit(False))
    rows = rows.unionByName(_pairs(page_rows, key, {"depends_on": CALLS}, 0.9, "math").withColumn("self", F.lit(True)))
    rows = rows.unionByName(_pairs(page_rows, key, SEMANTIC, 0.7, "semantic").withColumn("self", F.lit(True)))
    rows = rows.select(key, "page", F.col("a").alias("src"), F.explode(F.regexp_extract_all("b", F.lit(NAME), F.lit(1))).alias("dst"), "type", "confidence", "method", "self")
    for end in ("src", "dst"):
        rows = rows.join(known.withColumnRenamed("k", end), [key, "page", end], "left_semi")
    rows = rows.where(F.col("self") | (F.col("src") != F.col("dst"))).groupBy(key, "page", "src", "dst", "type", "method", "confidence").agg(F.count("*").alias("n"))
    together = near(page_rows, known, key, F.regexp_extract_all(F.lower("text"), F.lit(NAME), F.lit(1)), 20).where("src <> dst and n >= 2")
    together = together.select(key, "page", "src", "dst", F.lit("mentions").alias("type"), F.lit("context").alias("method"), F.round(F.least(F.lit(0.6), 0.1 * F.col("n")), 6).alias("confidence"), "n")
    return rows.select(*together.columns).unionByName(together)


def graph_rows(found: DataFrame, rel: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a graph: ids are name and page; an edge's ends are vertices of its document."""
    ident = lambda name: F.concat_ws("_", N.normalize_name(F.col(name)), F.col("page").cast("string"))
    v = found.groupBy(ident("name").alias("id")).agg(F.min_by("type", F.struct(-F.col("confidence"), key)).alias("type"), F.max("confidence").alias("confidence"), F.countDistinct(key).alias("docs"))
    e = rel.groupBy(ident("src").alias("src"), ident("dst").alias("dst"), "type").agg(F.max("confidence").alias("confidence"), F.countDistinct(key).alias("docs"))
    return v, e


def prerequisites(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phrase): what a text names as prerequisite, distinct."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PREREQUISITES])
    clean = F.transform(every, lambda x: F.regexp_replace(N.strip(x), "[.,;]+$", ""))
    return docs.select(key, F.explode(F.array_distinct(clean)).alias("phrase"))


def map_prerequisites(phrases: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name): each phrase as the known names that contain it or are contained in it, or as it stands.

    Distinct phrases are mapped once. Names inside a phrase are found by an equi-join on runs of its words;
    names that contain the phrase by one on the suffixes of their lower-cased text, cut to the phrase's first word.
    """
    low = known.select("name", F.lower("name").alias("low")).distinct()
    p = phrases.select(F.lower("phrase").alias("phrase")).distinct()
    grams = lambda c, n: F.expr(f"array_distinct(flatten(transform(sequence(1, length({c})), i -> array(substring({c}, i, {n})))))")
    # Containment either way shares the first characters of the shorter one; short ones are compared with all blocks of their length.
    k = 4
    inner = low.where(F.length("low") >= k).select("name", "low", F.substring("low", 1, k).alias("g"))
    one = p.select("phrase", F.explode(grams("phrase", k)).alias("g")).join(inner, "g").where(F.contains("phrase", F.col("low"))).select("phrase", "name")
    outer = low.select("name", "low", F.explode(grams("low", k)).alias("g"))
    two = p.where(F.length("phrase") >= k).withColumn("g", F.substring("phrase", 1, k)).join(outer, "g").where(F.contains("low", F.col("phrase"))).select("phrase", "name")
    short = lambda c, d: d.where((F.length(c) < k) & (F.length(c) > 0))
    pieces = lambda c: F.expr(f"array_distinct(flatten(transform(sequence(1, length({c})), i -> transform(sequence(1, {k - 1}), n -> substring({c}, i, n)))))")
    three = p.where("phrase <> ''").select("phrase", F.explode(pieces("phrase")).alias("low")).join(short("low", low), "low").select("phrase", "name")
    four = short("phrase", p).join(low.where("low <> ''").select("name", F.explode(pieces("low")).alias("phrase")), "phrase").select("phrase", "name")
    hit = one.union(two).union(three).union(four).distinct()
    mapped = phrases.withColumn("low", F.lower("phrase")).join(hit.withColumnRenamed("phrase", "low"), "low", "left")
    return mapped.select(key, F.coalesce("name", "phrase").alias("name")).distinct()
