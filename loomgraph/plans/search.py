"""Names, search, lookup and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.operators import search as S
from loomgraph.plans.common import PARTS_SQL, TOKENS_SQL, frame, parts, table, values

GOLDEN = values("name", [("CAPM",), ("  CAPM  ",), ("Capital  Asset   Pricing",), ("CAPM.",), ("Alpha,",), ("Beta;",), ("Variance:",), ("α (Alpha)",), ("",), (None,), ("   ",), ("Var",), ("cvar",), ("x",), ("Wacc.;",)])
NORM = r"regexp_replace(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[.,;:]+$', '')"
LONG = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.ACRONYMS.items()) + " END"
CASED = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.CASING.items()) + " END"
NAMES_SQL = f"(SELECT name FROM {GOLDEN} UNION ALL SELECT p_name FROM part)"


def names_of(spark, d):
    return frame(spark, GOLDEN).union(table(spark, d, "part").select("p_name"))


def concept_search_topk(spark, d):
    c = S.concepts_of(table(spark, d, "documents")).withColumns({"type": F.lit("concept"), "context": F.lit(""), "confidence": F.least(F.lit(1.0), F.col("n_docs") / 100)})
    return S.search(c, "the", 20).select("name", "frequency", "n_docs", "relevance")


PRE = values("id, name, type, frequency, confidence, complexity, domain, prerequisites", [
    ("c1", "Portfolio Theory", "methodology", 15, 0.95, "advanced", "finance", "linear algebra|probability theory|statistics"),
    ("c2", "Linear Algebra", "concept", 30, 0.9, "intermediate", "mathematics", "arithmetic"),
    ("c3", "Probability Theory", "theory", 22, 0.92, "", "mathematics", "set theory|calculus"),
    ("c4", "Calculus", "concept", 40, 0.9, "intermediate", "mathematics", "arithmetic"),
    ("c5", "Arithmetic", "concept", 50, 0.99, "beginner", "mathematics", ""),
    ("c6", "Sharpe Ratio", "metric", 25, 0.97, "beginner", "", "portfolio theory|statistics"),
    ("c7", "Statistics", "concept", 35, 0.9, None, "statistics", "probability theory"),
    ("c8", "Set Theory", "theory", 5, 0.7, "advanced", "mathematics", "")])


def pre(spark):
    return frame(spark, PRE).withColumn("prerequisites", F.array_remove(F.split("prerequisites", r"\|"), ""))


REL = f"round(least(1.0, CASE WHEN lower(name) = '{{q}}' THEN 1.0 WHEN contains(lower(name), '{{q}}') THEN 0.8 WHEN contains('{{q}}', lower(name)) THEN 0.6 ELSE 0.0 END + CASE WHEN contains(lower(context), '{{q}}') THEN 0.3 ELSE 0.0 END + CASE WHEN contains(lower(type), '{{q}}') THEN 0.2 ELSE 0.0 END + CASE WHEN frequency > 0 THEN least(0.2, frequency / 10000.0) ELSE 0.0 END + 0.1 * confidence), 6)::DOUBLE"
PRE_EX = f"(SELECT id, name, frequency, unnest(list_filter(string_split(prerequisites, '|'), lambda x: x <> '')) AS p FROM {PRE})"
DIRECT = f"SELECT DISTINCT lower(p) AS k FROM {PRE_EX} WHERE lower(name) = 'portfolio theory'"
TRANS = f"""WITH direct AS ({DIRECT}), two AS (SELECT DISTINCT lower(p) AS k FROM {PRE_EX} WHERE lower(name) IN (SELECT k FROM direct))
SELECT id, name, frequency, min(hop) AS hop FROM (SELECT id, name, frequency, 1 AS hop FROM {PRE} WHERE lower(name) IN (SELECT k FROM direct)
 UNION ALL SELECT id, name, frequency, 2 FROM {PRE} WHERE lower(name) IN (SELECT k FROM two)) GROUP BY ALL"""
FILTERED = "SELECT id, name FROM {t} WHERE coalesce(nullif({c}, ''), '{d}') = '{v}' ORDER BY frequency DESC, confidence DESC, id LIMIT 50"
UI = values("id, name, external_source, enriched", [(1, "alpha", "dbpedia", True), (2, "beta", None, True), (3, "gamma", None, False), (4, "delta", "dbpedia", False)])
UI_EDGES = values("src, dst", [(1, 2), (1, 4), (3, 4), (2, 3)])
FIX_C = values("name, description, definition, symbol, parts", [("Black-Scholes Formula", "prices a european call or put option", "C = S N(d1) minus K", "BS", 3), ("x", None, "a b c d e f g", "", 0), (None, "one two three four five", None, "s", 1)])
JAC = values("a, b", [("the quick fox", "The  quick fox"), ("a b c d", "b c d e"), ("", ""), ("", "x"), ("a", "b"), ("x x y", "y x")])
WS = "list_distinct(list_filter(string_split(regexp_replace(lower(trim({c})), '\\s+', ' ', 'g'), ' '), lambda x: x <> ''))"
SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
CLEAN = r"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, ' +', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"

QUERIES = {
    "concept_search_topk": (concept_search_topk, f"SELECT name, frequency, n_docs, {REL.format(q='the')} AS relevance FROM (SELECT name, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs, 'concept' AS type, '' AS context, least(1.0, count(DISTINCT doc_id) / 100.0) AS confidence FROM {TOKENS_SQL} GROUP BY name) WHERE {REL.format(q='the')} >= 0.1 ORDER BY relevance DESC, frequency DESC, name LIMIT 20"),
    "normalize_names": (lambda s, d: names_of(s, d).select("name", N.normalize_name(F.col("name")).alias("norm")), f"SELECT name, {NORM.format(c='name')} AS norm FROM {NAMES_SQL}"),
    "cache_keys": (lambda s, d: names_of(s, d).select(N.cache_key(F.lit("DBpediaConnector"), F.col("name")).alias("key")), f"SELECT concat('dbpediaconnector_', {NORM.format(c='name')}) AS key FROM {NAMES_SQL}"),
    "name_variants": (lambda s, d: names_of(s, d).where("name is not null").select("name", F.array_join(N.name_variants(F.col("name")), "|").alias("variants")), f"SELECT name, array_to_string(list_sort(list_filter(list_distinct([n, upper(name), lower(name), concat(upper(substr(name, 1, 1)), lower(substr(name, 2))), coalesce({LONG.format(c='n')}, '')]), lambda x: x <> '')), '|') AS variants FROM (SELECT name, {NORM.format(c='name')} AS n FROM {NAMES_SQL} WHERE name IS NOT NULL)"),
    "name_validity": (lambda s, d: names_of(s, d).select("name", N.is_valid_name(F.col("name")).alias("valid")), f"SELECT name, coalesce(length(trim(name)) BETWEEN 2 AND 200, false) AS valid FROM {NAMES_SQL}"),
    "acronym_case": (lambda s, d: names_of(s, d).select("name", N.fix_casing(F.col("name")).alias("cased")), f"SELECT name, coalesce({CASED.format(c='lower(trim(name))')}, name) AS cased FROM {NAMES_SQL}"),
    "name_jaccard": (lambda s, d: frame(s, JAC).select("a", "b", F.round(N.jaccard(F.col("a"), F.col("b")), 6).alias("j")), f"SELECT a, b, round(CASE WHEN regexp_replace(lower(trim(a)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(b)), '\\s+', ' ', 'g') THEN 1.0 WHEN len({WS.format(c='a')}) = 0 OR len({WS.format(c='b')}) = 0 THEN 0.0 ELSE len(list_intersect({WS.format(c='a')}, {WS.format(c='b')}))::DOUBLE / len(list_distinct(list_concat({WS.format(c='a')}, {WS.format(c='b')}))) END, 6)::DOUBLE AS j FROM {JAC}"),
    "completeness_score": (lambda s, d: frame(s, FIX_C).select("name", N.completeness(F.col("name"), F.col("description"), F.col("definition"), F.col("symbol"), F.col("parts")).alias("score")), f"SELECT name, CAST(2 * (coalesce(name, '') <> '')::INT + coalesce(len(list_filter(string_split(description, ' '), lambda x: x <> '')), 0) // 5 + coalesce(len(list_filter(string_split(definition, ' '), lambda x: x <> '')), 0) // 3 + (coalesce(symbol, '') <> '')::INT + parts AS BIGINT) AS score FROM {FIX_C}"),
    "pair_keys": (lambda s, d: frame(s, JAC).select("a", "b", N.pair_key(F.col("a"), F.col("b")).alias("key")), f"SELECT a, b, md5(CASE WHEN a < b THEN concat(a, '|', b) ELSE concat(b, '|', a) END) AS key FROM {JAC}"),
    "sentence_split": (lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(N.sentences(F.col("text"))).alias("n", "sentence")), f"SELECT doc_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS n, unnest(x) AS sentence FROM (SELECT doc_id, {SENT} AS x FROM documents)"),
    "clean_text": (lambda s, d: table(s, d, "documents").select("doc_id", F.md5(N.clean_text(F.col("text")).cast("binary")).alias("digest")), f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents"),
    "page_pack": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(N.pack_pages(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("pages"), F.length(F.array_join(N.pack_pages(F.replace("text", F.lit("\n"), F.lit("\n\n"))), "")).alias("chars")), None),
    "concepts_by_type": (lambda s, d: S.by_type(parts(s, d), "ECONOMY").select("id", "name"), f"SELECT id, name FROM {PARTS_SQL} WHERE lower(type) = 'economy'"),
    "type_counts": (lambda s, d: S.type_counts(parts(s, d)), f"SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM {PARTS_SQL} GROUP BY 1"),
    "type_info": (lambda s, d: S.type_info(parts(s, d)), f"SELECT type, count(*) AS n, array_to_string(list_sort(list_distinct(list(nullif(domain, '')))), ',') AS domains, array_to_string(list_sort(list_distinct(list(nullif(complexity, '')))), ',') AS levels FROM {PARTS_SQL} GROUP BY type"),
    "facet_overview": (lambda s, d: parts(s, d).agg(F.count("*").alias("total"), F.count_if(F.expr("complexity = 'beginner'")).alias("beginner"), F.count_if(F.expr("complexity = ''")).alias("unset"), F.countDistinct("type").alias("types"), F.countDistinct("domain").alias("domains")), f"SELECT count(*) AS total, count(*) FILTER (complexity = 'beginner') AS beginner, count(*) FILTER (complexity = '') AS unset, count(DISTINCT type) AS types, count(DISTINCT domain) AS domains FROM {PARTS_SQL}"),
    "concept_by_id": (lambda s, d: parts(s, d).where("id in (1, 17, 99)").select("id", "name", "type"), f"SELECT id, name, type FROM {PARTS_SQL} WHERE id IN (1, 17, 99)"),
    "search_name_desc_alias": (lambda s, d: S.contains_search(parts(s, d), "Brand#2", 25).select("id", "name", "confidence"), f"SELECT id, name, confidence FROM {PARTS_SQL} WHERE contains(name, 'Brand#2') OR contains(description, 'Brand#2') OR contains(alias, 'Brand#2') ORDER BY confidence DESC, id LIMIT 25"),
    "search_filtered": (lambda s, d: parts(s, d).where(F.contains(F.lower("context"), F.lit("promo")) & (F.col("complexity") == "beginner")).agg(F.count("*").alias("total_count"), F.min("id").alias("first")), f"SELECT count(*) AS total_count, min(id) AS first FROM {PARTS_SQL} WHERE contains(lower(context), 'promo') AND complexity = 'beginner'"),
    "search_default_relevance": (lambda s, d: S.search(parts(s, d), "promo", 50).select("id", "name", "relevance"), f"SELECT id, name, {REL.format(q='promo')} AS relevance FROM {PARTS_SQL} WHERE {REL.format(q='promo')} >= 0.1 ORDER BY relevance DESC, frequency DESC, name LIMIT 50"),
    "suggestions": (lambda s, d: S.suggestions(S.concepts_of(table(s, d, "documents")).withColumns({"confidence": F.lit(0.5), "id": F.col("name")}), "th", 8).select("name", "rank", "frequency"), f"SELECT name, CAST(CASE WHEN starts_with(name, 'th') THEN 2 ELSE 1 END AS INT) AS rank, count(*) AS frequency FROM {TOKENS_SQL} WHERE contains(name, 'th') GROUP BY name ORDER BY rank DESC, frequency DESC, name LIMIT 8"),
    "paginate_concepts": (lambda s, d: S.page(parts(s, d), 3, 20).select("id", "name", "frequency"), f"SELECT id, name, frequency FROM {PARTS_SQL} ORDER BY frequency DESC, name, id LIMIT 20 OFFSET 40"),
    "fuzzy_lookup": (lambda s, d: S.fuzzy_lookup(parts(s, d), "lt"), f"SELECT id, hit FROM (SELECT id, name AS hit FROM {PARTS_SQL} UNION ALL SELECT id, alias FROM {PARTS_SQL}) WHERE contains(lower(hit), 'lt') OR (contains('lt', lower(hit)) AND hit <> '')"),
    "exact_lookup": (lambda s, d: table(s, d, "customer").where(F.lower("c_name").isin("customer#000000007", "customer#000000011", "customer#7")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) IN ('customer#000000007', 'customer#000000011', 'customer#7')"),
    "default_fill": (lambda s, d: S.with_defaults(frame(s, PRE), {"complexity": "intermediate", "domain": "finance"}).select("id", "complexity", "domain"), f"SELECT id, coalesce(complexity, 'intermediate') AS complexity, coalesce(domain, 'finance') AS domain FROM {PRE}"),
    "by_complexity": (lambda s, d: S.filtered(frame(s, PRE), "complexity", "intermediate", "intermediate").select("id", "name"), FILTERED.format(t=PRE, c="complexity", d="intermediate", v="intermediate")),
    "by_domain": (lambda s, d: S.filtered(frame(s, PRE), "domain", "finance", "finance").select("id", "name"), FILTERED.format(t=PRE, c="domain", d="finance", v="finance")),
    "prerequisites_direct": (lambda s, d: S.prerequisites(pre(s), "portfolio theory").where("hop = 1").select("id", "name"), f"SELECT id, name FROM {PRE} WHERE lower(name) IN ({DIRECT})"),
    "prerequisites_transitive": (lambda s, d: S.prerequisites(pre(s), "portfolio theory"), TRANS),
    "documents_with_counts": (lambda s, d: S.by_document(table(s, d, "documents")), f"SELECT doc_id, count(DISTINCT name) AS concepts, count(name) AS occurrences FROM (SELECT doc_id FROM documents) LEFT JOIN {TOKENS_SQL} USING (doc_id) GROUP BY doc_id"),
    "document_concepts": (lambda s, d: table(s, d, "documents").where("doc_id in (3, 5, 8)").select("doc_id", F.explode(F.array_distinct(N.tokens(F.col("text")))).alias("name")), f"SELECT DISTINCT doc_id, name FROM {TOKENS_SQL} WHERE doc_id IN (3, 5, 8)"),
    "concept_evolution": (lambda s, d: S.evolution(table(s, d, "documents"), ["the", "and", "der", "que"]), f"SELECT name, source, count(DISTINCT doc_id) AS docs, count(*) AS occurrences FROM {TOKENS_SQL} WHERE name IN ('the', 'and', 'der', 'que') GROUP BY name, source"),
    "combined_search": (lambda s, d: S.search(parts(s, d), "tin", 10).select("name", F.lit("local").alias("source"), "relevance").union(S.search(parts(s, d).withColumn("name", F.concat(F.lit("tin "), "domain")).dropDuplicates(["name"]).withColumns({"context": F.lit(""), "type": F.lit("x"), "frequency": F.lit(0), "confidence": F.lit(0.5)}), "tin", 5).select("name", F.lit("snapshot"), "relevance")), f"(SELECT name, 'local' AS source, {REL.format(q='tin')} AS relevance FROM {PARTS_SQL} WHERE {REL.format(q='tin')} >= 0.1 ORDER BY relevance DESC, frequency DESC, name LIMIT 10) UNION ALL (SELECT DISTINCT concat('tin ', domain) AS name, 'snapshot', 0.85::DOUBLE FROM {PARTS_SQL} ORDER BY name LIMIT 5)"),
    "ui_filter": (lambda s, d: S.visible(frame(s, UI), frame(s, UI_EDGES), S.data_source() != "local").select("src", "dst"), f"SELECT src, dst FROM {UI_EDGES} WHERE src IN (SELECT id FROM {UI} WHERE coalesce(external_source, '') = 'dbpedia' OR enriched) AND dst IN (SELECT id FROM {UI} WHERE coalesce(external_source, '') = 'dbpedia' OR enriched)"),
    "data_source_counts": (lambda s, d: frame(s, UI).groupBy(S.data_source().alias("source")).agg(F.count("*").alias("n")), f"SELECT CASE WHEN external_source = 'dbpedia' THEN 'dbpedia' WHEN enriched THEN 'enriched' ELSE 'local' END AS source, count(*) AS n FROM {UI} GROUP BY 1"),
}
