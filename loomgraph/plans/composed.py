"""Composed extraction over pages, and the graph it makes; the checking SQL writes all patterns out again."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import compose as C
from loomgraph.operators.graph import cut
from loomgraph.plans.common import table

#: A text of statements per supplier, made of few names, so that names meet across documents.
STATED = """concat('x', s_suppkey % 7, ' = y', s_nationkey % 5, ' + z', s_suppkey % 3, ' * (2^3) - q', s_suppkey % 4, '_', s_nationkey % 3, '. The risk of x', s_suppkey % 7, ' is the variance of y', s_nationkey % 5,
 '; value at risk and Alpha matter here. Where z', s_suppkey % 3, ' is the rate of change. Calculate y', s_nationkey % 5, '. x', s_suppkey % 7, ' depends on y', s_nationkey % 5, ' but rate measures Risk. y', s_nationkey % 5,
 ' measures z', s_suppkey % 3, ' and x', s_suppkey % 7, ' implies y', s_nationkey % 5, '! Minimize z', s_suppkey % 3, '. If x', s_suppkey % 7, ' then z', s_suppkey % 3, '. x', s_suppkey % 7, '(y', s_nationkey % 5, ', z', s_suppkey % 3,
 ') := y', s_nationkey % 5, ' - z', s_suppkey % 3, '. Define risk as rate and y', s_nationkey % 5, '. Alpha and risk and alpha. This builds on linear ', CASE WHEN s_suppkey % 2 = 0 THEN 'algebra' ELSE 'maps' END, ', and is based on ', CASE WHEN s_nationkey % 2 = 0 THEN 'green almond parts' ELSE 'x' END, '.')"""


def stated(spark, d):
    few = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").repartition(spark.sparkContext.defaultParallelism)  # a small file of much text
    return few.selectExpr("s_suppkey AS doc_id", f"{STATED} AS text")


def texts(spark, d):
    """Statements and documents together; document ids go on beyond those of the suppliers."""
    return stated(spark, d).union(table(spark, d, "documents").selectExpr("doc_id + 1000000000 AS doc_id", "coalesce(text, '') AS text"))


PAGES_SQL = f"(SELECT s_suppkey AS doc_id, 1 AS page, {STATED} AS text FROM supplier)"
ALL_SQL = f"(SELECT s_suppkey AS doc_id, {STATED} AS text FROM supplier UNION ALL SELECT doc_id + 1000000000, coalesce(text, '') FROM documents)"

SYM = "[αβγδεθλμπρστφωΓΔΘΛΠΣΦΩ∑∏∫∂∇√∞≤≥≠≈±×÷∈→]"
VARS = f"list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace({{c}}, '[^A-Za-z0-9_]+', '  ', 'g'), ' +'), lambda w: regexp_matches(w, '^[A-Za-z]([0-9]+|_[A-Za-z0-9]+)?$')), regexp_extract_all({{c}}, '{SYM}'))))"
#: The detector's formula, written out.
MATHS = rf"""CASE WHEN NOT regexp_matches({{c}}, '[^ \t\n]') THEN 0.0 ELSE least(3.0, 0.5 * len(regexp_extract_all({{c}}, '{SYM}')))
 + least(2.0, (regexp_matches({{c}}, '[a-zA-Z_][A-Za-z0-9_]*[ \t]*=[ \t]*[^= \t]')::INT + regexp_matches({{c}}, '[0-9]+[ \t]*=[ \t]*[^= \t]')::INT + regexp_matches({{c}}, '=[ \t]*[a-zA-Z0-9_]')::INT)::DOUBLE)
 + least(2.0, 0.2 * len(regexp_extract_all({{c}}, '[+*/^()\[\]{{}}|⊗⊕⊙†‖∘-]')))
 + least(1.5, 0.1 * len(list_filter(regexp_split_to_array(regexp_replace({{c}}, '[^A-Za-z0-9_]+', '  ', 'g'), ' +'), lambda w: regexp_matches(w, '^[A-Za-z]([0-9]+|_[A-Za-z0-9]+)?$'))))
 + least(2.0, 0.5 * (regexp_matches(lower({{c}}), '(^|[^a-z0-9_])(return|variance|covariance|correlation|portfolio|sharpe|beta|alpha)($|[^a-z0-9_])')::INT + regexp_matches({{c}}, '(^|[^A-Za-z0-9_])(E|Var|Cov)\([^\n]*?\)[A-Za-z0-9_]')::INT + regexp_matches({{c}}, '(^|[^A-Za-z0-9_])[σμρβα]($|[^A-Za-z0-9_])')::INT))
 + least(2.0, (regexp_matches({{c}}, '\[[^\]]*\]')::INT + contains({{c}}, '∑')::INT + contains({{c}}, '∏')::INT + contains({{c}}, '∫')::INT)::DOUBLE)
 + least(3.0, 1.5 * (regexp_matches({{c}}, '(?s)\\begin\{{align\*?\}}.*?\\end\{{align\*?\}}')::INT + regexp_matches({{c}}, '(?s)\\begin\{{gather\*?\}}.*?\\end\{{gather\*?\}}')::INT + regexp_matches({{c}}, '(?s)\\begin\{{split\}}.*?\\end\{{split\}}')::INT
   + regexp_matches({{c}}, '(?s)\\begin\{{cases\}}.*?\\end\{{cases\}}')::INT + regexp_matches({{c}}, '(?s)\\begin\{{array\}}.*?\\end\{{array\}}')::INT + regexp_matches({{c}}, '(?s)\\begin\{{eqnarray\*?\}}.*?\\end\{{eqnarray\*?\}}')::INT))
 + least(1.0, 0.3 * (len(regexp_extract_all({{c}}, '[A-Za-z_][A-Za-z0-9_]*[_₀₁₂₃₄₅₆₇₈₉]')) + len(regexp_extract_all({{c}}, '[A-Za-z_][A-Za-z0-9_]*[\^⁰¹²³⁴⁵⁶⁷⁸⁹]'))))
 + least(1.0, 0.5 * len(regexp_extract_all({{c}}, '[0-9]+/[0-9]+|[a-zA-Z_][A-Za-z0-9_]*/[a-zA-Z_][A-Za-z0-9_]*')))
 + CASE WHEN regexp_matches({{c}}, '\[MATHREF_[^\]]+\]') THEN 5.0 ELSE 0.0 END END"""


def maths(c: str) -> str:
    return MATHS.replace("{c}", c)


def norm(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[.,;:]+$', '')"


W = r"([A-Za-z_][A-Za-z0-9_]*)"
SP = r"[ \t\r\n\f]"
EQS = [rf"{W}{SP}*={SP}*([^=\n]+)", rf"{W}{SP}*:{SP}*([^:\n]+)", rf"(?i)let{SP}+{W}{SP}+(?:be|denote|represent){SP}+([^.\n]+)"]
TERMS = [
    ("methodology", "portfolio|efficient frontier|mean.variance|markowitz"), ("methodology", "asset allocation|diversification|risk.return"),
    ("metric", "value at risk|var|expected shortfall|conditional var"), ("metric", "volatility|standard deviation|variance"),
    ("optimization", "optimization|minimize|maximize|objective function"), ("optimization", "constraint|lagrangian|karush.kuhn.tucker"),
    ("metric", "sharpe ratio|information ratio|treynor ratio"), ("metric", "alpha|beta|jensen.alpha|tracking error"),
]
SENTENCES = rf"""(SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS x FROM {ALL_SQL}))"""


def branch(i: int, names: str, kind: str, conf: str, method: str, where: str = "true") -> str:
    return f"SELECT doc_id, n, {i} AS i, generate_subscripts(x, 1) AS j, unnest(x) AS name, '{kind}' AS type, conf::DOUBLE AS confidence, '{method}' AS method FROM (SELECT doc_id, n, {names} AS x, {conf} AS conf FROM (SELECT * FROM sent WHERE {where}))"


def _all(p: str, g: int = 1) -> str:
    return f"regexp_extract_all(s, '{p}', {g})"


SURE = "score >= 3 AND least(1.0, score / 18) > 0.3"
FOUND = " UNION ALL ".join(
    [branch(0, VARS.format(c="s"), "variable", "least(1.0, score / 18)", "math", SURE)]
    + [branch(1 + k, _all(p), "equation", "least(1.0, score / 18)", "math", SURE) for k, p in enumerate(EQS)]
    + [branch(4 + k, f"list_transform({_all('(?i)(' + p + ')')}, lambda y: replace(lower(y), ' ', '_'))", t, "0.8", "regex") for k, (t, p) in enumerate(TERMS)]
    + [branch(12, _all(rf"(?i)(?:where|let){SP}+{W}{SP}+(?:is|denotes?|represents?){SP}+([^.\n]+)"), "variable", "0.7", "semantic")]
    + [branch(13, _all(rf"(?i){W}{SP}+(?:is|denotes?|represents?){SP}+(?:the{SP}+)?([^.\n]+)"), "variable", "0.7", "semantic")]
    + [branch(14, _all(rf"(?i)(?:formula|equation|expression)(?:{SP}+for)?{SP}+{W}"), "formula", "0.6", "regex")]
    + [branch(15, _all(rf"(?i)(?:calculate|compute|determine){SP}+{W}"), "formula", "0.6", "regex")]
)
CONCEPTS_SQL = f"""WITH sent AS MATERIALIZED (SELECT doc_id, n, s, {maths('s')} AS score FROM {SENTENCES}), every AS ({FOUND}),
 best AS (SELECT doc_id, {norm('name')} AS norm, arg_min({{'name': name, 'type': type, 'confidence': confidence, 'method': method}}, (-confidence, n, i, j)) AS c, count(*) AS n FROM every GROUP BY 1, 2),
 concepts AS MATERIALIZED (SELECT doc_id, norm, c.name AS name, c.type AS type, c.confidence AS confidence, c.method AS method, n FROM best)"""
RELS = [
    ("depends_on", rf"(?i){W}{SP}+depends{SP}+on{SP}+{W}"), ("depends_on", rf"(?i){W}{SP}+(?:is{SP}+)?function{SP}+of{SP}+{W}"),
    ("derives_from", rf"(?i){W}{SP}+(?:is{SP}+)?derived{SP}+from{SP}+{W}"), ("derives_from", rf"(?i){W}{SP}+follows{SP}+from{SP}+{W}"),
    ("measures", rf"(?i){W}{SP}+measures{SP}+{W}"), ("measures", rf"(?i){W}{SP}+(?:is{SP}+a{SP}+)?measure{SP}+of{SP}+{W}"),
]


def two(p: str, kind: str) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 2)) AS b, '{kind}' AS type FROM pages"


RELATIONS_SQL = f"""{CONCEPTS_SQL}, pages AS (SELECT * FROM {ALL_SQL}), low AS (SELECT DISTINCT doc_id, lower(name) AS k FROM concepts),
 stated AS (SELECT m.doc_id, lower(x.name) AS src, lower(y.name) AS dst, m.type, 0.7 AS confidence, 'regex' AS method FROM ({' UNION ALL '.join(two(p, k) for k, p in RELS)}) m
  JOIN concepts x ON x.doc_id = m.doc_id AND x.norm = {norm('m.a')} JOIN concepts y ON y.doc_id = m.doc_id AND y.norm = {norm('m.b')}),
 eqs AS (SELECT doc_id, v, unnest({VARS.format(c='b')}) AS w FROM (SELECT doc_id, b, unnest({VARS.format(c='a')}) AS v FROM ({' UNION ALL '.join(two(p, 'depends_on') for p in EQS)}))),
 words AS (SELECT doc_id, pos, w FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SP}+'), lambda x: x <> '') AS ws FROM pages)) JOIN low USING (doc_id) WHERE w = k),
 rels AS (SELECT * FROM stated UNION ALL SELECT doc_id, lower(v), lower(w), 'depends_on', 0.8, 'math' FROM eqs WHERE (doc_id, lower(v)) IN (SELECT doc_id, k FROM low) AND (doc_id, lower(w)) IN (SELECT doc_id, k FROM low)
  UNION ALL SELECT a.doc_id, a.w, b.w, 'mentions', 0.3, 'context' FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 10)"""
RELATED = "SELECT doc_id, src, dst, type, max(confidence)::DOUBLE AS confidence, arg_max(method, confidence) AS method FROM rels GROUP BY ALL"
SEM = [
    ("defines", rf"(?i){W}{SP}+(?:is{SP}+)?defined{SP}+as{SP}+([^.]+)"), ("defines", rf"(?i)define{SP}+{W}{SP}+as{SP}+([^.]+)"), ("implies", rf"(?i){W}{SP}+implies{SP}+{W}"), ("implies", rf"(?i)if{SP}+{W}{SP}+then{SP}+{W}"),
    ("extends", rf"(?i){W}{SP}+extends{SP}+{W}"), ("extends", rf"(?i){W}{SP}+(?:is{SP}+)?(?:an?{SP}+)?extension{SP}+of{SP}+{W}"),
]
ASSIGN = [rf"{W}{SP}*={SP}*([^=\n]+)", rf"{W}{SP}*:={SP}*([^=\n]+)"]
CALL = [rf"{W}{SP}*\({SP}*([A-Za-z0-9_, \t\r\n\f]*){SP}*\)", rf"{W}{SP}*={SP}*f{SP}*\({SP}*([A-Za-z0-9_, \t\r\n\f]*){SP}*\)"]
DISCOVER_SQL = f"""{CONCEPTS_SQL}, pages AS (SELECT * FROM {ALL_SQL}), known AS (SELECT DISTINCT doc_id, name AS k FROM concepts),
 pat AS (SELECT *, 0.8 AS confidence, 'math' AS method FROM ({' UNION ALL '.join(two(p, 'depends_on') for p in ASSIGN)}) UNION ALL SELECT *, 0.9, 'call' FROM ({' UNION ALL '.join(two(p, 'depends_on') for p in CALL)}) UNION ALL SELECT *, 0.7, 'semantic' FROM ({' UNION ALL '.join(two(p, k) for k, p in SEM)})),
 ends AS (SELECT doc_id, a AS src, unnest(regexp_extract_all(b, '{W}')) AS dst, type, confidence, method FROM pat),
 hits AS (SELECT doc_id, src, dst, type, CASE method WHEN 'call' THEN 'math' ELSE method END AS method, confidence, count(*) AS n FROM ends WHERE (doc_id, src) IN (SELECT doc_id, k FROM known) AND (doc_id, dst) IN (SELECT doc_id, k FROM known) AND (method <> 'math' OR src <> dst) GROUP BY ALL),
 words AS (SELECT doc_id, pos, w FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS ws FROM pages)) JOIN known USING (doc_id) WHERE w = k),
 co AS (SELECT a.doc_id, a.w AS src, b.w AS dst, count(*) AS n FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.w <> b.w AND abs(a.pos - b.pos) <= 20 GROUP BY ALL HAVING count(*) >= 2)
 SELECT doc_id, src, dst, type, method, confidence::DOUBLE AS confidence, n FROM hits UNION ALL SELECT doc_id, src, dst, 'mentions', 'context', round(least(0.6, 0.1 * n), 6)::DOUBLE, n FROM co"""
PRE = [
    rf"(?i)assumes?{SP}+(?:familiarity{SP}+with|knowledge{SP}+of|understanding{SP}+of){SP}+([^.,;]+)", rf"(?i)requires?{SP}+(?:knowledge{SP}+of|understanding{SP}+of|familiarity{SP}+with){SP}+([^.,;]+)",
    rf"(?i)builds?{SP}+(?:on|upon){SP}+([^.,;]+)", rf"(?i)based{SP}+on{SP}+([^.,;]+)", rf"(?i)given{SP}+(?:knowledge{SP}+of|understanding{SP}+of){SP}+([^.,;]+)", rf"(?i)prerequisites?{SP}*:{SP}*([^.,;]+)", rf"(?i)background{SP}+in{SP}+([^.,;]+)",
]
PHRASES_SQL = "SELECT DISTINCT doc_id, regexp_replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '[.,;]+$', '') AS phrase FROM (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS p FROM {ALL_SQL}" for p in PRE) + ")"
KNOWN_SQL = "(SELECT p_name AS name FROM part UNION SELECT p_type FROM part UNION SELECT 'algebra' UNION SELECT 'parts')"
HIT = "contains(lower(k.name), lower(p.phrase)) OR contains(lower(p.phrase), lower(k.name))"


def concepts(spark, d):
    return C.concepts(C.pages(texts(spark, d)))


def known(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_name").alias("name")).union(p.select("p_type")).union(spark.sql("SELECT explode(array('algebra', 'parts')) AS name")).distinct()


def extracted(spark, d):
    """(pages, concepts, relations) of all texts."""
    pages = C.pages(texts(spark, d))
    found = cut(C.concepts(pages).drop("complexity", "domain"))  # read five times below
    return pages, found, cut(C.relations(pages, found))


def discovered(spark, d):
    pages = C.pages(texts(spark, d))
    return C.discover(pages, cut(C.concepts(pages).drop("complexity", "domain"))).drop("page")


def extracted_concepts(spark, d):
    return concepts(spark, d).select("doc_id", "norm", "name", "type", F.round("confidence", 6).alias("confidence"), "method", "n")


def graph_vertices(spark, d):
    _, found, rel = extracted(spark, d)
    v, _ = C.graph_rows(found, rel)
    return v.select("id", "type", F.round("confidence", 6).alias("confidence"), "docs")


def graph_edges(spark, d):
    _, found, rel = extracted(spark, d)
    _, e = C.graph_rows(found, rel)
    return e


def document_analysis(spark, d):
    """Concepts of a document by type, and its relations."""
    _, found, rel = extracted(spark, d)
    types = found.groupBy("doc_id", "type").agg(F.count("*").alias("concepts"), F.array_join(F.array_sort(F.collect_set("norm")), "|").alias("names"))
    inside = rel.groupBy("doc_id").agg(F.count("*").alias("relations"))
    return types.join(inside, "doc_id", "left").select("doc_id", "type", "concepts", F.md5(F.col("names").cast("binary")).alias("names"), F.coalesce("relations", F.lit(0)).cast("long").alias("relations"))


def document_list(spark, d):
    """Documents with their concepts, most concepts first."""
    c = concepts(spark, d).groupBy("doc_id").agg(F.count("*").alias("concept_count"), F.array_join(F.array_sort(F.collect_list("norm")), "|").alias("concepts"))
    return c.orderBy(F.desc("concept_count"), "doc_id").limit(50)


def home(found):
    """The first document of each name."""
    return found.groupBy("norm").agg(F.min("doc_id").alias("home"), F.countDistinct("doc_id").alias("docs"))


def cross_document(spark, d):
    """Edges between names by whether both began in one document."""
    _, found, rel = extracted(spark, d)
    h = home(found)
    at = lambda end: h.select(F.col("norm").alias(end), F.col("home").alias(f"{end}_home"))
    e = rel.select("src", "dst", "type").distinct().join(at("src"), "src").join(at("dst"), "dst")
    return e.groupBy("type", (F.col("src_home") == F.col("dst_home")).alias("internal")).agg(F.count("*").alias("n"))


def evolution(spark, d):
    """Names with the documents that have them and how surely."""
    f = concepts(spark, d)
    return f.groupBy("norm").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.round(F.max("confidence"), 6).alias("confidence")).where("docs >= 2")


def totals(spark, d):
    """Counts of the whole graph: names, relations, documents, and both by type."""
    _, found, rel = extracted(spark, d)
    one = lambda df, m, k, n: df.select(F.lit(m).alias("metric"), k.alias("value"), n.cast("long").alias("n"))
    every = F.lit("all")
    names = found.select("norm", "type").distinct()
    edges = rel.select("src", "dst", "type").distinct()
    out = one(found.agg(F.countDistinct("norm").alias("n")), "concepts", every, F.col("n"))
    out = out.union(one(edges.agg(F.count("*").alias("n")), "relations", every, F.col("n")))
    out = out.union(one(found.agg(F.countDistinct("doc_id").alias("n")), "documents", every, F.col("n")))
    out = out.union(one(names.groupBy("type").agg(F.count("*").alias("n")), "concept_type", F.col("type"), F.col("n")))
    return out.union(one(edges.groupBy("type").agg(F.count("*").alias("n")), "relation_type", F.col("type"), F.col("n")))


HOME_SQL = "home AS (SELECT norm, min(doc_id) AS home FROM concepts GROUP BY norm)"
PREREQUISITES = (lambda s, d: C.map_prerequisites(C.prerequisites(texts(s, d)), known(s, d)), f"SELECT DISTINCT p.doc_id, coalesce(k.name, p.phrase) AS name FROM ({PHRASES_SQL}) p LEFT JOIN {KNOWN_SQL} k ON {HIT}")

QUERIES = {
    "extracted_concepts": (extracted_concepts, f"{CONCEPTS_SQL} SELECT doc_id, norm, name, type, round(confidence, 6) AS confidence, method, n FROM concepts"),
    "extracted_relations": (lambda s, d: extracted(s, d)[2].drop("page"), f"{RELATIONS_SQL} {RELATED}"),
    "discovered_relations": (discovered, DISCOVER_SQL),
    "extracted_graph_vertices": (graph_vertices, f"{CONCEPTS_SQL} SELECT concat(norm, '_1') AS id, arg_min(type, (-confidence, doc_id)) AS type, round(max(confidence), 6) AS confidence, count(DISTINCT doc_id) AS docs FROM concepts GROUP BY norm"),
    "extracted_graph_edges": (graph_edges, f"{RELATIONS_SQL} SELECT concat({norm('src')}, '_1') AS src, concat({norm('dst')}, '_1') AS dst, type, max(confidence)::DOUBLE AS confidence, count(DISTINCT doc_id) AS docs FROM ({RELATED}) GROUP BY ALL"),
    "prerequisite_phrases": (lambda s, d: C.prerequisites(texts(s, d)), PHRASES_SQL),
    "prerequisite_concepts": PREREQUISITES,
    "document_analysis": (document_analysis, f"{RELATIONS_SQL}, rel AS ({RELATED}) SELECT c.doc_id, c.type, count(*) AS concepts, md5(string_agg(DISTINCT norm, '|' ORDER BY norm)) AS names, coalesce((SELECT count(*) FROM rel r WHERE r.doc_id = c.doc_id), 0) AS relations FROM concepts c GROUP BY c.doc_id, c.type"),
    "document_list": (document_list, f"{CONCEPTS_SQL} SELECT doc_id, count(*) AS concept_count, string_agg(norm, '|' ORDER BY norm) AS concepts FROM concepts GROUP BY doc_id ORDER BY concept_count DESC, doc_id LIMIT 50"),
    "cross_document_relations": (cross_document, f"{RELATIONS_SQL}, {HOME_SQL} SELECT type, x.home = y.home AS internal, count(*) AS n FROM (SELECT DISTINCT src, dst, type FROM ({RELATED})) JOIN home x ON x.norm = src JOIN home y ON y.norm = dst GROUP BY ALL"),
    "concept_documents": (evolution, f"{CONCEPTS_SQL} SELECT norm, count(DISTINCT doc_id) AS docs, min(doc_id) AS first, max(doc_id) AS last, round(max(confidence), 6) AS confidence FROM concepts GROUP BY norm HAVING count(DISTINCT doc_id) >= 2"),
    "graph_totals": (totals, f"""{RELATIONS_SQL}, names AS (SELECT DISTINCT norm, type FROM concepts), edges AS (SELECT DISTINCT src, dst, type FROM ({RELATED}))
 SELECT 'concepts' AS metric, 'all' AS value, count(DISTINCT norm) AS n FROM concepts UNION ALL SELECT 'relations', 'all', count(*) FROM edges UNION ALL SELECT 'documents', 'all', count(DISTINCT doc_id) FROM concepts
 UNION ALL SELECT 'concept_type', type, count(*) FROM names GROUP BY type UNION ALL SELECT 'relation_type', type, count(*) FROM edges GROUP BY type"""),
}
