"""Traversals, metrics and exports over the geography graph and a co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import extract as X
from loomgraph.operators import graph as G
from loomgraph.plans.common import EDGES_SQL, TOKENS_SQL, VERTICES_SQL, edges, frame, table, values, vertices
from loomgraph.sources.files import graphml

VOCAB = ["the", "and", "of", "to", "in", "is"]
CO = "SELECT a.name AS a, b.name AS b, count(*) AS n, round(least(0.6, 0.1 * count(*)), 6)::DOUBLE AS confidence FROM {t} a JOIN {t} b ON a.doc_id = b.doc_id AND a.name < b.name AND abs(a.pos - b.pos) <= {w} WHERE a.name IN ({v}) AND b.name IN ({v}) GROUP BY 1, 2 HAVING count(*) >= 2"
SMALL = values("src, dst, type, confidence", [("a", "b", "part_of", 0.9), ("b", "c", "depends_on", 0.4), ("c", "a", "mentions", 0.3), ("c", "d", "contains", 0.8), ("d", "e", "implies", 0.2), ("e", "d", "mentions", 0.6), ("x", "y", "defines", 0.75), ("a", "d", "mentions", 0.45), ("b", "d", "mentions", 0.55), ("a", "b", "mentions", 0.1)])
UND = f"(SELECT src, dst FROM {EDGES_SQL} UNION SELECT dst, src FROM {EDGES_SQL})"
DEG = "(SELECT id, count(*) AS degree FROM (SELECT src AS id FROM (SELECT DISTINCT src, dst FROM {e}) UNION ALL SELECT dst FROM (SELECT DISTINCT src, dst FROM {e})) GROUP BY id)"
REACH = "WITH RECURSIVE r(root, id, hop) AS (SELECT '{v}', '{v}', 0 UNION SELECT r.root, e.dst, r.hop + 1 FROM r JOIN {e} e ON r.id = e.src WHERE r.hop < {k}) "
COMP = "WITH RECURSIVE u AS (SELECT src, dst FROM {e} UNION SELECT dst, src FROM {e}), r(root, id) AS (SELECT src, src FROM u UNION SELECT r.root, u.dst FROM r JOIN u ON r.id = u.src) SELECT root AS id, min(id) AS component FROM r GROUP BY root"


def root(spark, v):
    return spark.sql(f"select '{v}' as root, '{v}' as id")


def side(types, turned):
    e = f"(SELECT DISTINCT {'dst AS src, src AS dst' if turned else 'src, dst'} FROM {EDGES_SQL} WHERE type IN ({', '.join(repr(t) for t in types)}))"
    return REACH.format(v="n3", e=e, k=3) + "SELECT root, id, min(hop) AS hop FROM r WHERE id <> 'n3' GROUP BY root, id"


def cooccurrence_graph(spark, d):
    c = X.cooccurrence(table(spark, d, "documents"), "doc_id", "text", VOCAB, 10)
    return c.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("mentions").alias("type"), "confidence")


QUERIES = {
    "neighbors": (lambda s, d: G.related(edges(s, d), vertices(s, d), "n3"), f"SELECT e.id, v.name, e.direction, e.type, e.confidence FROM (SELECT dst AS id, 'outgoing' AS direction, type, confidence FROM {EDGES_SQL} WHERE src = 'n3' UNION ALL SELECT src, 'incoming', type, confidence FROM {EDGES_SQL} WHERE dst = 'n3' AND src <> 'n3') e JOIN {VERTICES_SQL} v USING (id)"),
    "related_directed": (lambda s, d: G.related(edges(s, d), vertices(s, d), "r1", "part_of").where("direction = 'incoming'").select("id", "name"), f"SELECT id, name FROM {VERTICES_SQL} JOIN {EDGES_SQL} ON id = src WHERE dst = 'r1' AND type = 'part_of'"),
    "dependency_trace": (lambda s, d: G.related(edges(s, d), vertices(s, d), "n15", "depends_on").select("id", "name", "direction"), f"SELECT id, name, 'outgoing' AS direction FROM {EDGES_SQL} JOIN {VERTICES_SQL} ON id = dst WHERE src = 'n15' AND type = 'depends_on'"),
    "definitions": (lambda s, d: frame(s, SMALL).where("type = 'defines' and contains(dst, 'y')").select("src", "dst"), f"SELECT src, dst FROM {SMALL} WHERE type = 'defines' AND contains(dst, 'y')"),
    "valid_edges": (lambda s, d: G.valid_edges(frame(s, SMALL), s.sql("select explode(array('a', 'b', 'c', 'd')) as id")), f"SELECT * FROM {SMALL} WHERE src IN ('a', 'b', 'c', 'd') AND dst IN ('a', 'b', 'c', 'd')"),
    "merge_edges": (lambda s, d: G.upsert(frame(s, SMALL).dropDuplicates(["src", "dst", "type"]), frame(s, SMALL).where("type = 'mentions'").withColumn("confidence", F.lit(1.0)), ("src", "type", "dst")), f"SELECT src, dst, type, CASE WHEN type = 'mentions' THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM {SMALL}"),
    "hierarchy_depth3": (lambda s, d: G.hierarchy(edges(s, d), root(s, "n3"), 3), f"SELECT root, id, hop, 'ancestor' AS side FROM ({side(G.UP, True)}) UNION ALL SELECT root, id, hop, 'descendant' FROM ({side(G.DOWN, False)})"),
    "k_hop": (lambda s, d: G.k_hop(edges(s, d), root(s, "r2"), 2), REACH.format(v="r2", e=UND, k=2) + "SELECT root, id, min(hop) AS hop FROM r GROUP BY root, id"),
    "shortest_path": (lambda s, d: G.shortest_path(edges(s, d), "n1", "n6"), f"WITH RECURSIVE p(id, path, hops) AS (SELECT 'n1', 'n1', 0 UNION ALL SELECT e.dst, concat(p.path, '>', e.dst), p.hops + 1 FROM p JOIN {UND} e ON p.id = e.src WHERE p.hops < 5 AND NOT contains(concat('>', p.path, '>'), concat('>', e.dst, '>')) AND p.id <> 'n6') SELECT hops, min(path) AS path FROM p WHERE id = 'n6' GROUP BY hops ORDER BY hops LIMIT 1"),
    "degree_centrality": (lambda s, d: G.centrality(edges(s, d)), f"SELECT id, degree, round(degree / ((SELECT count(*) FROM {DEG.format(e=EDGES_SQL)}) - 1.0), 6)::DOUBLE AS centrality FROM {DEG.format(e=EDGES_SQL)} ORDER BY degree DESC, id LIMIT 10"),
    "graph_metrics": (lambda s, d: G.metrics(frame(s, SMALL)), f"SELECT n, m, round(2.0 * m / n, 6)::DOUBLE AS avg_degree, round(m::DOUBLE / (n * (n - 1)), 9)::DOUBLE AS density, round(c, 6)::DOUBLE AS avg_confidence, weak FROM (SELECT count(*) AS n FROM {DEG.format(e=SMALL)}), (SELECT count(*) AS m, avg(c) AS c FROM (SELECT max(confidence) AS c FROM {SMALL} GROUP BY src, dst)), (SELECT count(DISTINCT component) AS weak FROM ({COMP.format(e=SMALL)}))"),
    "components": (lambda s, d: G.components(frame(s, SMALL)), COMP.format(e=SMALL)),
    "strong_components": (lambda s, d: G.strong_components(frame(s, SMALL)), f"WITH RECURSIVE r(root, id) AS (SELECT v, v FROM (SELECT src AS v FROM {SMALL} UNION SELECT dst FROM {SMALL}) UNION SELECT r.root, e.dst FROM r JOIN {SMALL.replace('AS t(', 'AS e(')} ON r.id = e.src) SELECT a.root AS id, min(a.id) AS component FROM r a JOIN r b ON a.root = b.id AND a.id = b.root GROUP BY a.root"),
    "relation_filter": (lambda s, d: G.structural_filter(frame(s, SMALL)), f"SELECT t.* FROM {SMALL} JOIN {DEG.format(e=SMALL)} x ON x.id = src JOIN {DEG.format(e=SMALL)} y ON y.id = dst WHERE confidence >= 0.5 OR (x.degree >= 2 AND y.degree >= 2 AND EXISTS (SELECT 1 FROM {SMALL.replace('AS t(', 'AS p(')} JOIN {SMALL.replace('AS t(', 'AS q(')} ON p.dst = q.dst WHERE p.src = t.src AND q.src = t.dst))"),
    "cooccurrence_w10": (lambda s, d: X.cooccurrence(table(s, d, "documents"), "doc_id", "text", VOCAB, 10), CO.format(t=TOKENS_SQL, w=10, v=", ".join(repr(v) for v in VOCAB))),
    "cooccurrence_w20": (lambda s, d: X.cooccurrence(table(s, d, "documents"), "doc_id", "text", ["der", "die", "und", "les", "que"], 20), CO.format(t=TOKENS_SQL, w=20, v="'der', 'die', 'und', 'les', 'que'")),
    "cooccurrence_degrees": (lambda s, d: G.degrees(cooccurrence_graph(s, d)), f"SELECT id, count(*) AS degree FROM (SELECT unnest([a, b]) AS id FROM ({CO.format(t=TOKENS_SQL, w=10, v=', '.join(repr(v) for v in VOCAB))})) GROUP BY id"),
    "export_cytoscape": (lambda s, d: G.cytoscape_edges(edges(s, d)), f"SELECT concat('edge_', src, '_', row_number() OVER (PARTITION BY src ORDER BY dst, type)) AS id, src AS source, dst AS target, CASE type WHEN 'part_of' THEN 'Part Of' WHEN 'contains' THEN 'Contains' ELSE 'Depends On' END AS label FROM {EDGES_SQL}"),
    "export_nodes": (lambda s, d: G.cytoscape_nodes(vertices(s, d).withColumn("confidence", F.lit(0.5))), f"SELECT id, CASE WHEN length(name) > 15 THEN concat(substr(name, 1, 12), '...') ELSE name END AS label, 650.0::DOUBLE AS size FROM {VERTICES_SQL}"),
    "export_graphml": (lambda s, d: graphml(edges(s, d)), f"SELECT concat('<edge source=\"', src, '\" target=\"', dst, '\" label=\"', type, '\"/>') AS value FROM {EDGES_SQL}"),
    "export_edges_csv": (lambda s, d: edges(s, d).select(F.concat_ws(",", "src", "type", "dst").alias("line")), f"SELECT concat_ws(',', src, type, dst) AS line FROM {EDGES_SQL}"),
    "export_json": (lambda s, d: vertices(s, d).select(F.to_json(F.struct("id", "name")).alias("json")), f"SELECT concat('{{\"id\":\"', id, '\",\"name\":\"', name, '\"}}') AS json FROM {VERTICES_SQL}"),
}
