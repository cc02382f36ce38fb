"""What viewers read, analyses of graphs, and the rest of the page mathematics, over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import mathtext as M
from loomgraph.operators import views as V
from loomgraph.plans.common import EDGES_SQL, VERTICES_SQL, edges, table, vertices
from loomgraph.plans.composed import ALL_SQL, SYM, texts

CONCEPT = """p_partkey AS id, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'equation' WHEN 1 THEN 'metric' WHEN 2 THEN 'risk' WHEN 3 THEN 'theory' ELSE 'algorithm' END AS type, round(p_size / 50.0, 2) AS confidence,
 CASE WHEN p_size % 2 = 0 THEN 'local_document' ELSE 'catalogue' END AS source, p_size % 3 = 0 AS enriched, CASE WHEN p_size % 6 = 0 THEN 'dbpedia' END AS external_source, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END AS description, p_brand AS document"""
CONCEPTS_SQL = f"(SELECT {CONCEPT} FROM part)"
NODES_SQL = f"""(SELECT id, name AS label, type, CASE WHEN enriched THEN '#4CAF50' ELSE '#2196F3' END AS color, CASE WHEN enriched THEN 20 ELSE 15 END AS size, CASE WHEN enriched THEN '#2E7D32' ELSE '#1976D2' END AS border,
 concat('{{"name":"', name, '","type":"', type, '","confidence":"', printf('%.2f', confidence::DOUBLE), '","source":"', source, '"', CASE WHEN enriched THEN concat(',"external_source":"', coalesce(external_source, 'Unknown'), '"') ELSE '' END, '}}') AS tooltip FROM {CONCEPTS_SQL})"""
TYPED_SQL = f"(SELECT *, CASE WHEN confidence > 0.5 THEN 'dbpedia' ELSE 'derived' END AS source_type FROM {EDGES_SQL})"
TITLE = "CASE type WHEN 'part_of' THEN 'Part Of' WHEN 'contains' THEN 'Contains' ELSE 'Depends On' END"
RELATED_SQL = f"(SELECT id, list_filter(string_split(name, ' '), lambda x: x <> '')[1:3] AS r FROM {CONCEPTS_SQL})"
NEAR_SQL = f"(SELECT id AS parent, concat(id, '_related_', i - 1) AS id, r[i] AS name, i FROM (SELECT id, r, unnest(generate_series(1, len(r))) AS i FROM {RELATED_SQL}))"
LINES_SQL = "(SELECT doc_id, line, body, start FROM (SELECT doc_id, line, body, CAST(coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))"


def concepts(s, d):
    table(s, d, "part").createOrReplaceTempView("views_part")
    return s.sql(f"SELECT {CONCEPT} FROM views_part")


def related(s, d):
    return concepts(s, d).withColumn("related", F.array_remove(F.split("name", " "), ""))


def typed_edges(s, d):
    return edges(s, d).withColumn("source_type", F.when(F.col("confidence") > 0.5, "dbpedia").otherwise("derived"))


def metadata(s, d):
    n = concepts(s, d).agg(F.count("*").alias("total"), F.count_if("enriched").alias("enriched"), F.count_if(~F.col("enriched")).alias("local"))
    return n.join(typed_edges(s, d).agg(F.count_if(F.expr("source_type = 'dbpedia'")).alias("external_edges"), F.count_if(F.expr("source_type = 'derived'")).alias("derived_edges")), F.lit(True))


def page_chunks(s, d):
    """Orders as chunks, line items of large quantity as their blocks, in order of line."""
    li = table(s, d, "lineitem").where("l_quantity >= 40")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    blocks = li.groupBy(name.alias("block")).agg(F.min("l_suppkey").alias("block_page"), F.min("l_linenumber").alias("seq"))
    has = li.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set(name).alias("blocks"))
    chunks = table(s, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderkey") % 10 == 0, 7).cast("long").alias("page")).join(has, "chunk", "left")
    return V.chunk_pages(chunks.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>"))), blocks).select("chunk", "page")


def candidate_rows(s, d):
    li = table(s, d, "lineitem")
    method = F.element_at(F.array(*map(F.lit, ("math", "semantic", "regex", "context"))), F.col("l_linenumber") % 4 + 1)
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.col("l_returnflag").alias("dst"), F.lower("l_linestatus").alias("type"), F.col("l_discount").alias("confidence"), method.alias("method"), F.col("l_linenumber").cast("string").alias("context"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))


def search_with_total(s, d):
    """Concepts of one type whose name, description or document contains a word, surest first, with the number of all."""
    hit = [F.contains(F.lower(c), F.lit("promo")) for c in ("name", "description", "document")]
    found = concepts(s, d).where((hit[0] | hit[1] | hit[2]) & (F.lower("type") == "metric"))
    return found.orderBy(F.desc("confidence"), "id").limit(20).join(F.broadcast(found.agg(F.count("*").alias("total_count"))), F.lit(True)).select("id", "name", "confidence", "total_count")


CONF = "((doc_id % 11) / 10.0)"
LOW = "lower(text)"
GREEK_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{g}') THEN '{g}' END" for g in ("alpha", "beta", "gamma", "delta", "sigma", "mu", "lambda"))
STAT = f"SELECT type, count(*) AS n FROM {CONCEPTS_SQL} GROUP BY type"
UND = f"(SELECT src, dst FROM {EDGES_SQL} UNION SELECT dst, src FROM {EDGES_SQL})"

QUERIES = {
    "visual_nodes": (lambda s, d: V.visual_nodes(concepts(s, d)), f"SELECT * FROM {NODES_SQL}"),
    "visual_edges": (lambda s, d: V.visual_edges(typed_edges(s, d)), f"SELECT src AS source, dst AS target, {TITLE} AS label, CASE source_type WHEN 'dbpedia' THEN '#FF9800' ELSE '#666666' END AS color, CASE source_type WHEN 'dbpedia' THEN 3 ELSE 2 END AS width FROM {TYPED_SQL}"),
    "visual_metadata": (metadata, f"SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (enriched) AS enriched, count(*) FILTER (NOT enriched) AS local FROM {CONCEPTS_SQL}), (SELECT count(*) FILTER (source_type = 'dbpedia') AS external_edges, count(*) FILTER (source_type = 'derived') AS derived_edges FROM {TYPED_SQL})"),
    "legend": (lambda s, d: V.legend(concepts(s, d)), f"SELECT DISTINCT type, CASE type WHEN 'equation' THEN '#FF6B6B' WHEN 'metric' THEN '#64B5F6' ELSE '#F06292' END AS color FROM {CONCEPTS_SQL} WHERE type IN ('equation', 'metric', 'risk')"),
    "type_colours": (lambda s, d: concepts(s, d).groupBy("type").agg(F.count("*").alias("n")).select("type", "n", V.colour(F.col("type")).alias("color"), V.ontology_class(F.col("type")).alias("class")), f"SELECT type, n, CASE type WHEN 'equation' THEN '#FF6B6B' WHEN 'metric' THEN '#64B5F6' WHEN 'risk' THEN '#F06292' ELSE '#9E9E9E' END AS color, CASE type WHEN 'equation' THEN 'dbo:Equation' WHEN 'metric' THEN 'dbo:Measurement' WHEN 'algorithm' THEN 'dbo:Algorithm' END AS class FROM ({STAT})"),
    "tooltip_search": (lambda s, d: V.tooltip_search(V.visual_nodes(concepts(s, d)), "DBpedia").select("id", "label", "tooltip"), f"SELECT id, label, tooltip FROM {NODES_SQL} WHERE contains(lower(label), 'dbpedia') OR contains(lower(type), 'dbpedia') OR contains(lower(tooltip), 'dbpedia')"),
    "neighbour_nodes": (lambda s, d: V.expand_neighbours(related(s, d))[0], f"SELECT id, name, 'concept' AS type, 0.7::DOUBLE AS confidence, CAST(parent AS VARCHAR) AS parent FROM {NEAR_SQL}"),
    "neighbour_edges": (lambda s, d: V.expand_neighbours(related(s, d))[1], f"SELECT CAST(parent AS VARCHAR) AS src, id AS dst, 'related_to' AS type, 0.7::DOUBLE AS confidence FROM {NEAR_SQL} UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id), 'semantic_similarity', 0.6 FROM {NEAR_SQL} a JOIN {NEAR_SQL} b ON a.parent = b.parent AND a.i < b.i"),
    "enrichment_view": (lambda s, d: V.enrichment(concepts(s, d)), f"SELECT id, b AS badge, CASE WHEN b <> 'local' THEN concat('http://dbpedia.org/resource/', array_to_string(list_transform(string_split(name, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), '_')) END AS url, coalesce(nullif(description, ''), concat('Concept: ', name)) AS description FROM (SELECT *, CASE WHEN external_source = 'dbpedia' THEN 'dbpedia' WHEN enriched THEN 'enriched' ELSE 'local' END AS b FROM {CONCEPTS_SQL})"),
    "related_by_name": (lambda s, d: V.related_by_name(vertices(s, d).withColumn("confidence", F.length("name") / 100), edges(s, d), "1"), f"WITH f AS (SELECT id FROM {VERTICES_SQL} WHERE contains(name, '1') ORDER BY length(name) DESC, id LIMIT 1) SELECT e.id, v.name, e.direction, e.type, e.confidence FROM (SELECT dst AS id, 'outgoing' AS direction, type, confidence FROM {EDGES_SQL} WHERE src = (SELECT id FROM f) UNION ALL SELECT src, 'incoming', type, confidence FROM {EDGES_SQL} WHERE dst = (SELECT id FROM f) AND src <> (SELECT id FROM f)) e JOIN {VERTICES_SQL} v USING (id)"),
    "concept_detail": (lambda s, d: V.detail(vertices(s, d), edges(s, d), "n3"), f"SELECT o.id, o.name, e.id AS related_id, v.name AS related, e.direction, e.type, e.confidence FROM {VERTICES_SQL} o, (SELECT dst AS id, 'outgoing' AS direction, type, confidence FROM {EDGES_SQL} WHERE src = 'n3' UNION ALL SELECT src, 'incoming', type, confidence FROM {EDGES_SQL} WHERE dst = 'n3' AND src <> 'n3') e JOIN {VERTICES_SQL} v ON v.id = e.id WHERE o.id = 'n3'"),
    "graph_statistics": (lambda s, d: V.statistics(concepts(s, d), edges(s, d), "document"), f"SELECT 'total_concepts' AS metric, 'all' AS value, count(*) AS n FROM {CONCEPTS_SQL} UNION ALL SELECT 'total_relationships', 'all', count(*) FROM {EDGES_SQL} UNION ALL SELECT 'documents', 'all', count(DISTINCT document) FROM {CONCEPTS_SQL} UNION ALL SELECT 'concept_type', type, n FROM ({STAT}) UNION ALL SELECT 'relationship_type', type, count(*) FROM {EDGES_SQL} GROUP BY type"),
    "network_analysis": (lambda s, d: V.network(edges(s, d)), f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {EDGES_SQL}), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), fw(root, id) AS (SELECT id, id FROM v UNION SELECT fw.root, e.dst FROM fw JOIN e ON fw.id = e.src),
 un(root, id) AS (SELECT id, id FROM v UNION SELECT un.root, u.dst FROM un JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) u ON un.id = u.src), m AS (SELECT count(*) AS m, avg(c) AS c FROM (SELECT max(confidence) AS c FROM {EDGES_SQL} GROUP BY src, dst)), n AS (SELECT count(*) AS n FROM v),
 w AS (SELECT count(DISTINCT c) AS weak FROM (SELECT root, min(id) AS c FROM un GROUP BY root)), s AS (SELECT count(DISTINCT c) AS strong FROM (SELECT a.root, min(a.id) AS c FROM fw a JOIN fw b ON a.root = b.id AND a.id = b.root GROUP BY a.root))
 SELECT n, m, round(2.0 * m / n, 6)::DOUBLE AS avg_degree, round(m::DOUBLE / (n * (n - 1)), 9)::DOUBLE AS density, round(c, 6)::DOUBLE AS avg_confidence, weak, strong, weak = 1 AS connected FROM n, m, w, s"""),
    "graph_query": (lambda s, d: V.query(s, vertices(s, d), edges(s, d), "SELECT c.name, count(*) AS n FROM relationships r JOIN concepts c ON c.id = r.dst WHERE r.type = 'part_of' GROUP BY c.name"), f"SELECT c.name, count(*) AS n FROM {EDGES_SQL} r JOIN {VERTICES_SQL} c ON c.id = r.dst WHERE r.type = 'part_of' GROUP BY c.name"),
    "delete_documents": (lambda s, d: V.without_documents(table(s, d, "labels").select("doc_id", "quality"), table(s, d, "documents").where("lang = 'en'")), "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "search_with_total": (search_with_total, f"SELECT id, name, confidence, count(*) OVER () AS total_count FROM {CONCEPTS_SQL} WHERE (contains(lower(name), 'promo') OR contains(lower(description), 'promo') OR contains(lower(document), 'promo')) AND type = 'metric' ORDER BY confidence DESC, id LIMIT 20"),
    "relation_candidates": (lambda s, d: V.candidates(candidate_rows(s, d)), "SELECT src, dst, type, count(*) AS n, max(confidence) AS confidence, max(CASE method WHEN 'math' THEN 1.0 WHEN 'semantic' THEN 0.8 WHEN 'regex' THEN 0.6 ELSE 0.4 END)::DOUBLE AS method_score, string_agg(DISTINCT context, '|' ORDER BY context) AS evidence, arg_min(method, seq) AS provenance FROM (SELECT concat('s', l_suppkey) AS src, l_returnflag AS dst, lower(l_linestatus) AS type, l_discount AS confidence, ['math', 'semantic', 'regex', 'context'][l_linenumber % 4 + 1] AS method, CAST(l_linenumber AS VARCHAR) AS context, l_orderkey * 100 + l_linenumber AS seq FROM lineitem) GROUP BY src, dst, type"),
    "search_all": (lambda s, d: V.search_all({"local": concepts(s, d).select("name", "confidence"), "suppliers": table(s, d, "supplier").selectExpr("s_name AS name", "s_acctbal AS confidence"), "nations": table(s, d, "nation").selectExpr("n_name AS name", "n_regionkey * 1.0D AS confidence")}, "an"), " UNION ALL ".join(f"(SELECT '{k}' AS source, name, confidence::DOUBLE AS confidence FROM {t} WHERE contains(lower(name), 'an') ORDER BY confidence DESC, name LIMIT 5)" for k, t in (("local", CONCEPTS_SQL), ("suppliers", "(SELECT s_name AS name, s_acctbal AS confidence FROM supplier)"), ("nations", "(SELECT n_name AS name, n_regionkey AS confidence FROM nation)")))),
    "chunk_pages": (page_chunks, "SELECT o_orderkey AS chunk, coalesce(CASE WHEN o_orderkey % 10 = 0 THEN 7 END, (SELECT arg_min(p, n) FROM (SELECT l_linenumber AS n, min(l_suppkey) AS p FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 40 GROUP BY l_linenumber))) AS page FROM orders"),
    "pdf_confidence": (lambda s, d: texts(s, d).select("doc_id", F.round(V.pdf_confidence(F.col("text"), M.SYMBOLS), 6).alias("confidence")), f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(least(1.0, least(0.4, 2 * len(regexp_extract_all(text, '{SYM}')) / length(text)) + CASE WHEN regexp_matches(text, '[a-zA-Z][ \\t\\r\\n\\f]*=') OR regexp_matches(text, '[0-9][ \\t\\r\\n\\f]*=') OR regexp_matches(text, '=[ \\t\\r\\n\\f]*[a-zA-Z0-9]') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '+')::INT + contains(text, '-')::INT + contains(text, '*')::INT + contains(text, '/')::INT + contains(text, '^')::INT + contains(text, '(')::INT + contains(text, ')')::INT >= 2 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[xyzRrwEV]') THEN 0.1 ELSE 0 END), 6) END::DOUBLE AS confidence FROM {ALL_SQL}"),
    "gated_group": (lambda s, d: texts(s, d).select("doc_id", V.gated_group(F.col("text"), (F.col("doc_id") % 11) / 10).alias("grp")), f"""SELECT doc_id, CASE WHEN {CONF} > 0.7 AND regexp_matches({LOW}, 'portfolio|return|variance|covariance|weight|sharpe') THEN 'portfolio_theory' WHEN {CONF} > 0.7 AND regexp_matches({LOW}, 'probability|distribution|hypothesis|test|correlation') THEN 'statistics' WHEN {CONF} > 0.7 AND (regexp_matches(text, '[∑∏∫]') OR contains({LOW}, 'matrix')) THEN 'matrix_vector'
 WHEN {CONF} > 0.4 AND regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '^[a-zA-Z][ \\t\\r\\n\\f]*=') THEN 'variable_definition' WHEN {CONF} > 0.4 AND length(text) - length(replace(text, '=', '')) = 1 AND regexp_matches(text, '[+*/-]') THEN 'equation' WHEN {CONF} > 0.4 AND (contains(text, '/') OR contains({LOW}, 'ratio') OR contains({LOW}, 'rate')) THEN 'ratio' ELSE 'general_math' END AS grp FROM {ALL_SQL}"""),
    "linking_variables": (lambda s, d: texts(s, d).select("doc_id", F.array_join(V.linking_variables(F.col("text")), ",").alias("vars")), f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9_]+', '  ', 'g'), ' +'), lambda w: regexp_matches(w, '^[A-Za-z][0-9]*$')), list_filter([{GREEK_SQL}], lambda g: g IS NOT NULL)))), ',') AS vars FROM {ALL_SQL}"),
    "marked_texts": (lambda s, d: V.with_markers(table(s, d, "documents").where("text is not null"), "doc_id", "text").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n"), None),
}
