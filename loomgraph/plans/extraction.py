"""Mathematics in text, concepts and relations from text, and their classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M
from loomgraph.operators import extract as X
from loomgraph.plans.common import frame, table, values
from loomgraph.plans.composed import ALL_SQL, maths, texts

EXPR = values("id, body", [
    (1, "E(R_p) = w μ"), (2, "σ_p = w1 + w2"), (3, "x = 3"), (4, "the portfolio return"), (5, "a/b"), (6, "3/4 of it"), (7, "matrix A"), (8, "∑ x_i"), (9, "12"), (10, "[3]"), (11, "plain words only here"),
    (12, "x1 + y2 = z^2"), (13, "probability p"), (14, "12:30"), (15, "CAPM"), (16, "variance = 2.5"), (17, "growth rate"), (18, ""), (19, "S = A * B + C / D"), (20, "2. Heading words")])
SAID = values("doc_id, text", [
    (1, "Risk depends on variance. Alpha measures skill. Let beta denote slope."), (2, "minimize cost and maximize return. price = base + tax"), (3, "yield is derived from price. CAPM extends theory. calculate duration"),
    (4, "Volatility affects price. formula for drift. x is the weight of an asset."), (5, "Sharpe ratio and alpha, then Sharpe Ratio again; asset allocation with constraint"), (6, "a = b + c1 and gain implies growth"), (7, "nothing")])
CAND = values("src, dst, type, confidence, method, context, src_type, dst_type", [
    ("risk", "variance", "depends_on", 0.8, "math", "risk = variance * 2", "risk", "risk"), ("risk", "variance", "depends_on", 0.6, "regex", "risk depends on variance", "risk", "risk"),
    ("return", "yield", "mentions", 0.3, "context", "return and yield", "return", "metric"), ("alpha", "beta", "measures", 0.9, "semantic", "alpha ∑ beta", "metric", "metric"), ("x", "y", "mentions", 0.1, "ocr", "", "a", "b")])
EXT = values("seq, name, confidence, alias", [(1, "CAPM", 0.5, "a1"), (2, "capm.", 0.9, "a2"), (3, "Capm", 0.9, "a3"), (4, "beta", 0.4, "b1"), (5, "Beta;", 0.3, "b2"), (6, "gamma", 0.2, "g")])
REL = values("seq, src, dst, type, confidence", [(1, "A", "b", "mentions", 0.3), (2, "a", "B", "mentions", 0.7), (3, "a", "b", "mentions", 0.7), (4, "a", "b", "implies", 0.1)])
CLS = values("id, body", [(1, "introduction to basic algebra"), (2, "advanced theoretical research on eigenvalue problems and a rigorous derivation"), (3, "standard market practice, an empirical case study"), (4, "a = b + c"), (5, "regression and correlation, p-value"), (6, ""), (7, "portfolio optimization with a convex constraint"), (8, "gdp and inflation under supply and demand")])


def n(p: str, c: str = "body") -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


def has(p: str, c: str = "body") -> str:
    return f"regexp_matches({c}, '{p}')"


def hits(ps, c: str = "body") -> str:
    return "(" + " + ".join(f"{has(p, c)}::INT" for p in ps) + ")"


def cap(x: str, top: float) -> str:
    return f"least({top}, {x})"


REJECTED = f"({hits(M.REJECT)} > 0 OR length(trim(body)) < 3 OR (length(body) > 10 AND {n('[A-Za-z]')}::DOUBLE / greatest(length(body), 1) > 0.8))"
OPS2 = n(r"[+*/^()\[\]{}|=<>≤≥≠≈±∓×÷∘-]")
IMPROVED = f"CASE WHEN {REJECTED} THEN 0.0 ELSE " + " + ".join([
    cap(f"0.8 * {n(M.SYMBOLS)}", 4), f"CASE WHEN {hits(M.EQUATIONS)} > 0 THEN 2.0 ELSE 0.0 END", f"CASE WHEN {OPS2} >= 2 THEN least(2.0, 0.3 * {OPS2}) ELSE 0.0 END",
    f"CASE WHEN {has(M.FINANCE + '[ ]*[=:]', 'lower(body)')} THEN 1.5 ELSE 0.0 END", f"CASE WHEN {has('[A-Z][ ]*=[ ]*' + chr(92) + '[|[∑∏∫]')} THEN 2.0 ELSE 0.0 END", cap(f"0.5 * ({n(M.SUBSCRIPT)} + {n(M.SUPERSCRIPT)})", 1.5), "CASE WHEN contains(body, chr(10)) THEN 1.0 ELSE 0.0 END"]) + " END"
CHARS = "greatest(length(replace(body, ' ', '')), 1)"
P = hits(M.LINE_PATTERNS, "lower(body)")
ST = "(" + " + ".join(f"contains(body, '{x}')::INT" for x in "=(+-*/^_") + ")"
RATIO = f"(({n(M.SYMBOLS)} + {n('[=+*/^()_0-9-]')})::DOUBLE / {CHARS})"
LINE = f"CASE WHEN length(body) = 0 THEN 0 ELSE least(3, {n(M.SYMBOLS)}) + CASE WHEN {P} >= 2 THEN 2 ELSE {P} END + CASE WHEN {ST} >= 3 THEN 2 WHEN {ST} = 2 THEN 1 ELSE 0 END + CASE WHEN length(body) < 100 AND {has('[xyzijkmnpqr]')} AND {has('[=+*/^(-]')} THEN 2 ELSE 0 END + CASE WHEN {RATIO} > 0.4 THEN 2 WHEN {RATIO} > 0.2 THEN 1 ELSE 0 END END::BIGINT"
GROUP = f"CASE WHEN {has('portfolio|return|variance|covariance|weight', 'lower(body)')} THEN 'portfolio_theory' WHEN {has('^[A-Za-z][ ]*=', 'trim(body)')} THEN 'variable_definition' WHEN {n('=')} = 1 AND {has('[+*/-]')} THEN 'equation' WHEN {has('/|ratio|rate', 'lower(body)')} THEN 'ratio' WHEN {has('[∑∏∫]|matrix', 'lower(body)')} THEN 'matrix_vector' WHEN {has('prob|expected', 'lower(body)')} THEN 'statistics' ELSE 'general_math' END"
VARS = f"list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace(body, '[^A-Za-z0-9_]+', '  ', 'g'), ' +'), lambda w: regexp_matches(w, '^[A-Za-z]([0-9]+|_[A-Za-z0-9]+)?$')), regexp_extract_all(body, '{M.SYMBOLS}'))))"
CPX = f"round(0.5 * {n(M.SYMBOLS)} + 0.3 * {n(M.OPERATORS)} + 0.4 * len({VARS}) + {hits(M.EQUATIONS)} + CASE WHEN {has(M.FRACTION)} THEN 1.0 ELSE 0.0 END + CASE WHEN {has(M.SUBSCRIPT)} THEN 0.5 ELSE 0.0 END + CASE WHEN {has(M.SUPERSCRIPT)} THEN 0.5 ELSE 0.0 END, 2)::DOUBLE"
TWO = "SELECT {k}, regexp_replace(a, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS b FROM (SELECT {k}, unnest(regexp_extract_all({c}, '{p}', 1)) AS a, unnest(regexp_extract_all({c}, '{p}', 2)) AS b FROM {t})"
BIN = "SELECT doc_id, '{k}' AS type, lower(a) AS src, lower(b) AS dst FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 2)) AS b FROM {t})"
RELS = " UNION ALL ".join([BIN.format(k=k, p=p, t=SAID) for k, p in X.RELATIONS.items()] + [f"SELECT doc_id, '{k}', NULL, lower(b) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS b FROM {SAID})" for k, p in X.UNARY.items()])
LEX = {"methodology": "(tion|ment)", "metric": "(the|que)"}
LEXQ = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, replace(lower(unnest(regexp_extract_all(text, '{p}', 1))), ' ', '_') AS name FROM documents" for k, p in LEX.items())
LINES = "(SELECT doc_id, CAST(line AS INT) AS line, body, CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
GAP = r"[ \t\r\n\f]+"
LEVEL_WORDS = {
    "b": [f"introduction{GAP}to|basic|fundamental|elementary|simple", f"primer|overview|getting{GAP}started|basics", f"introductory|elementary|simple{GAP}example"],
    "i": ["intermediate|moderate|standard|typical", "application|practical|implementation", f"case{GAP}study|real.world|empirical"],
    "a": ["advanced|sophisticated|complex|rigorous", f"theoretical|mathematical{GAP}proof|derivation", "research|cutting.edge|state.of.the.art", "phd|doctoral|graduate.level"],
}
LV = {k: " + ".join(n(p, "lower(body)") for p in ps) for k, ps in LEVEL_WORDS.items()}
LSYM = n("[∫∂∑∏√±≤≥≠∞∈∉⊂⊆∪∩]")
LV_A = f"({LV['a']} + 2 * {n(f'∫∫|∭|∂²|∇²|differential{GAP}equation')} + 2 * {n(f'eigenvalue|eigenvector|matrix{GAP}inverse|determinant')} + (length(body) > 2000)::INT + 2 * ({LSYM} > 20)::INT)"
LV_I = f"({LV['i']} + 2 * {n('∫|∂|derivative|integral')} + 2 * {n('∑|∏|summation|product')} + ({LSYM} BETWEEN 6 AND 20)::INT)"
LV_B = f"({LV['b']} + 2 * {n('[+*/=-]|arithmetic|calculation')} + (length(body) < 500)::INT)"
CLASSED = f"(SELECT id, body FROM {CLS} UNION ALL SELECT doc_id + 1000, text FROM {ALL_SQL})"
DOMAIN_WORDS = {
    "mathematics": ["mathematical|theorem|proof|lemma|corollary", "algebra|calculus|statistics|probability|geometry", f"analysis|topology|number{GAP}theory"],
    "finance": ["financial|portfolio|investment|trading|market", "asset|security|bond|stock|option|derivative", f"risk{GAP}management|capital|banking|hedge"],
    "economics": ["economic|economy|econometric|microeconomic|macroeconomic", f"supply|demand|market{GAP}equilibrium|elasticity", "gdp|inflation|monetary|fiscal|policy"],
    "statistics": ["statistical|regression|correlation|hypothesis", "distribution|normal|gaussian|chi.square|t.test", f"confidence{GAP}interval|p.value|significance"],
    "optimization": ["optimization|minimize|maximize|constraint|lagrange", f"linear{GAP}programming|quadratic{GAP}programming|convex", f"objective{GAP}function|feasible{GAP}region|optimal"],
}
DOMAIN = {k: "(" + " + ".join(n(p, "lower(body)") for p in ps) + ")" for k, ps in DOMAIN_WORDS.items()}
WORDS_LEVELS = {"beginner": ("the",), "intermediate": ("tion|ment",), "advanced": ("ung|heit|que",)}
TESTLEX = {"german": ("der|die", "und"), "french": ("les", "que"), "other": ("the",)}
TL = {k: "(" + " + ".join(n(p, "lower(text)") for p in ps) + ")" for k, ps in TESTLEX.items()}


MARKED = values("id, body", [(31, "see [MATHREF_7] there"), (32, "\\begin{align} a &= b \\end{align}\\begin{cases} c \\end{cases}"), (33, "E(x)y and Var(z) of α and the Sharpe return"), (34, "a b c d x1 y_2 é z")])
MATHS_IN = f"(SELECT id, body FROM {EXPR} UNION ALL SELECT id, body FROM {MARKED} UNION ALL SELECT doc_id + 1000, coalesce(text, '') FROM documents)"


def maths_in(s, d):
    """Expressions, marked texts and all documents."""
    return e(s).union(frame(s, MARKED.replace(chr(92), chr(92) * 2))).union(table(s, d, "documents").select(F.col("doc_id") + 1000, F.coalesce("text", F.lit(""))))


def classed(s, d):
    return frame(s, CLS).union(texts(s, d).select(F.col("doc_id") + 1000, "text"))


def blocks(s, d):
    return X.math_lines(table(s, d, "documents"), "text", "doc_id")


def e(s):
    return frame(s, EXPR)


SIM = "CASE WHEN g1 = g2 THEN 0.8 WHEN st = dt THEN 0.6 ELSE 0.2 END"
GROUPS = {"risk": "risk", "variance": "risk", "return": "return", "yield": "return", "alpha": "metric"}
GSQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GROUPS.items()) + " END"
TOTAL = f"round(0.25 * base + 0.2 * how + 0.15 * least(1.0, 0.2 * n) + 0.2 * {SIM} + 0.1 * maths + 0.01, 6)::DOUBLE"

QUERIES = {
    "math_score": (lambda s, d: maths_in(s, d).select("id", M.score(F.col("body")).alias("t")).select("id", F.round("t", 6).alias("score"), F.round(M.confidence(F.col("t")), 6).alias("confidence")), f"SELECT id, round({maths('body')}, 6)::DOUBLE AS score, round(least(1.0, ({maths('body')}) / 18), 6)::DOUBLE AS confidence FROM {MATHS_IN}"),
    "improved_math_score": (lambda s, d: maths_in(s, d).select("id", F.round(M.improved_score(F.col("body")), 6).alias("score"), M.rejected(F.col("body")).alias("rejected")), f"SELECT id, round({IMPROVED}, 6)::DOUBLE AS score, {REJECTED} AS rejected FROM {MATHS_IN}"),
    "pdf_line_score": (lambda s, d: maths_in(s, d).select("id", M.line_score(F.col("body")).alias("score")), f"SELECT id, {LINE} AS score FROM {MATHS_IN}"),
    "semantic_group": (lambda s, d: maths_in(s, d).select("id", M.semantic_group(F.col("body")).alias("grp")), f"SELECT id, {GROUP} AS grp FROM {MATHS_IN}"),
    "semantic_group_counts": (lambda s, d: blocks(s, d).groupBy("grp").agg(F.count("*").alias("n")), f"SELECT {GROUP} AS grp, count(*) AS n FROM {LINES} WHERE {LINE} >= 3 GROUP BY 1"),
    "variables": (lambda s, d: maths_in(s, d).select("id", F.array_join(M.variables(F.col("body")), ",").alias("vars")), f"SELECT id, array_to_string({VARS}, ',') AS vars FROM {MATHS_IN}"),
    "math_complexity": (lambda s, d: maths_in(s, d).select("id", M.complexity(F.col("body")).alias("complexity")), f"SELECT id, {CPX} AS complexity FROM {MATHS_IN}"),
    "latex_convert": (lambda s, d: e(s).select("id", M.to_latex(F.col("body")).alias("latex")), None),
    "equations": (lambda s, d: X.equations(table(s, d, "documents"), "text", "doc_id"), TWO.format(k="doc_id", c="text", p=X.EQUATION, t="documents")),
    "variable_definitions": (lambda s, d: X.pairs(frame(s, SAID), "text", X.DEFINITION, "doc_id"), TWO.format(k="doc_id", c="text", p=X.DEFINITION, t=SAID)),
    "formula_mentions": (lambda s, d: frame(s, SAID).select("doc_id", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(X.FORMULA), 1).alias("a"), F.regexp_extract_all("text", F.lit(X.FORMULA), 2).alias("b"))).alias("z")).select("doc_id", F.concat("z.a", "z.b").alias("name")), f"SELECT doc_id, concat(a, b) AS name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{X.FORMULA}', 1)) AS a, unnest(regexp_extract_all(text, '{X.FORMULA}', 2)) AS b FROM {SAID})"),
    "lexicon_concepts": (lambda s, d: X.lexicon_concepts(table(s, d, "documents"), "text", LEX, "doc_id"), f"SELECT doc_id, type, name, count(*) AS n FROM ({LEXQ}) GROUP BY ALL"),
    "lexicon_finance": (lambda s, d: X.lexicon_concepts(frame(s, SAID), "text", X.LEXICON, "doc_id"), "SELECT doc_id, type, name, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, replace(lower(unnest(regexp_extract_all(text, '{p}', 1))), ' ', '_') AS name FROM {SAID}" for k, p in X.LEXICON.items()) + ") GROUP BY ALL"),
    "explicit_relations": (lambda s, d: X.relations(frame(s, SAID), "text", "doc_id"), RELS),
    "equation_relations": (lambda s, d: X.equation_relations(frame(s, SAID), "text", "doc_id"), f"SELECT DISTINCT doc_id, a AS src, v AS dst FROM (SELECT doc_id, a, unnest(regexp_extract_all(b, '{X.WORD}')) AS v FROM ({TWO.format(k='doc_id', c='text', p=X.EQUATION, t=SAID)})) WHERE a <> v"),
    "relation_scores": (lambda s, d: X.score_relations(frame(s, CAND), GROUPS), f"""WITH c AS (SELECT src, dst, type, max(confidence) AS base, max(CASE method WHEN 'math' THEN 1.0 WHEN 'semantic' THEN 0.8 WHEN 'regex' THEN 0.6 WHEN 'context' THEN 0.4 ELSE 0.3 END) AS how, count(*) AS n,
 least(1.0, sum(CASE WHEN method = 'math' THEN 0.5 ELSE 0.0 END + CASE WHEN {has('[=+*/^-]', 'context')} THEN 0.3 ELSE 0.0 END + CASE WHEN {has('[∑∏∫∂]', 'context')} THEN 0.4 ELSE 0.0 END)) AS maths, min(src_type) AS st, min(dst_type) AS dt, {GSQL.format(c='src')} AS g1, {GSQL.format(c='dst')} AS g2 FROM {CAND} GROUP BY src, dst, type)
SELECT src, dst, type, n, {TOTAL} AS total, CASE WHEN {TOTAL} >= 0.9 THEN 'very_strong' WHEN {TOTAL} >= 0.7 THEN 'strong' WHEN {TOTAL} >= 0.5 THEN 'moderate' ELSE 'weak' END AS strength FROM c WHERE {TOTAL} >= 0.3"""),
    "extracted_dedup": (lambda s, d: X.keep_best(frame(s, EXT).withColumn("aliases", F.array("alias")), F.regexp_replace(F.lower("name"), "[.;]$", "")).select("seq", "name", "confidence", F.array_join("aliases", ",").alias("aliases")), f"WITH k AS (SELECT *, regexp_replace(lower(name), '[.;]$', '') AS k FROM {EXT}), w AS (SELECT k, arg_min(seq, (-confidence, seq)) AS first FROM k GROUP BY k) SELECT x.seq, x.name, x.confidence, (SELECT string_agg(DISTINCT y.alias, ',' ORDER BY y.alias) FROM k y WHERE y.k = x.k AND y.seq >= x.seq) AS aliases FROM k x JOIN w ON x.k = w.k AND x.seq = w.first"),
    "relation_dedup": (lambda s, d: frame(s, REL).groupBy(F.lower("src").alias("src"), F.lower("dst").alias("dst"), "type").agg(F.max("confidence").alias("confidence"), F.max_by("seq", F.struct("confidence", -F.col("seq"))).alias("seq")), f"SELECT lower(src) AS src, lower(dst) AS dst, type, max(confidence) AS confidence, arg_min(seq, (-confidence, seq)) AS seq FROM {REL} GROUP BY 1, 2, 3"),
    "math_blocks": (lambda s, d: blocks(s, d).select("doc_id", "line", "start", "score", "grp", F.length(F.coalesce("before", F.lit(""))).alias("n_before"), F.length(F.coalesce("after", F.lit(""))).alias("n_after")), f"SELECT doc_id, line, start, {LINE} AS score, {GROUP} AS grp, CAST(length(coalesce(before, '')) AS INT) AS n_before, CAST(length(coalesce(after, '')) AS INT) AS n_after FROM (SELECT *, lag(body) OVER (PARTITION BY doc_id ORDER BY line) AS before, lead(body) OVER (PARTITION BY doc_id ORDER BY line) AS after FROM {LINES}) WHERE {LINE} >= 3"),
    "char_offsets": (lambda s, d: X.lines(table(s, d, "documents"), "text", "doc_id").select("doc_id", "line", "start"), f"SELECT doc_id, line, start FROM {LINES}"),
    "line_pairs": (lambda s, d: X.line_pairs(e(s).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda x: x["body"]), "\n").alias("text"), F.lit(1).alias("doc_id")), "text", "doc_id").select("doc_id", "line"), f"SELECT doc_id, line FROM (SELECT *, lead(body) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM (SELECT 1 AS doc_id, CAST(id - 1 AS INT) AS line, body FROM {EXPR})) WHERE length(body) < 50 AND length(nxt) < 50 AND regexp_matches(body, '[=+-]') AND regexp_matches(nxt, '[xyrR()]')"),
    "block_links": (lambda s, d: X.block_links(e(s).select(F.lit(1).alias("doc_id"), F.col("id").alias("block"), "body", M.semantic_group(F.col("body")).alias("grp"))), f"WITH u AS (SELECT id, unnest({VARS}) AS k FROM {EXPR} UNION ALL SELECT id, concat('#', g) FROM (SELECT id, {GROUP} AS g FROM {EXPR}) WHERE g <> 'general_math') SELECT DISTINCT 1 AS doc_id, x.id AS a, y.id AS b FROM u x JOIN u y ON x.k = y.k AND x.id < y.id"),
    "domain_class": (lambda s, d: classed(s, d).select("id", M.domain(F.col("body")).alias("domain")), f"SELECT id, CASE WHEN greatest({', '.join(DOMAIN.values())}) = 0 THEN 'finance' " + " ".join(f"WHEN {v} = greatest({', '.join(DOMAIN.values())}) THEN '{k}'" for k, v in DOMAIN.items()) + f" END AS domain FROM {CLASSED}"),
    "domain_class_documents": (lambda s, d: table(s, d, "documents").select("doc_id", M.domain(F.col("text"), TESTLEX, "none").alias("domain")), f"SELECT doc_id, CASE WHEN greatest({', '.join(TL.values())}) = 0 THEN 'none' " + " ".join(f"WHEN {v} = greatest({', '.join(TL.values())}) THEN '{k}'" for k, v in TL.items()) + " END AS domain FROM documents"),
    "complexity_level": (lambda s, d: classed(s, d).select("id", M.level(F.col("body")).alias("level")), f"SELECT id, CASE WHEN {LV_A} > {LV_B} AND {LV_A} > {LV_I} THEN 'advanced' WHEN {LV_B} > {LV_I} THEN 'beginner' ELSE 'intermediate' END AS level FROM {CLASSED}"),
}
