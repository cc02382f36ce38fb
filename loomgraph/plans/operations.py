"""Deduplication, enrichment, the cache, and file events."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomgraph.operators.graph import shared_folder
from loomgraph.operators import cache as K
from loomgraph.operators import dedup as D
from loomgraph.operators import enrich as J
from loomgraph.plans.common import frame, table, values
from loomgraph.streaming import watch as L

DUP = values("id, name, symbol, description, definition, doc_type, confidence, source", [
    (1, "Black-Scholes Formula", "BS", "prices a european option", "call price", "html", 0.9, "a.html"), (2, "Black-Scholes  formula", "", "prices a european option on a stock with care", "", "xml", 0.8, "b.xml"),
    (3, "Sharpe Ratio", "SR", "return over risk", "", "pdf", 0.7, "c.pdf"), (4, "Ratio of Sharpe", "sr", "excess return over risk", "mean excess return over deviation", "latex", 0.95, "d.tex"),
    (5, "Beta", "", "market risk", "", "pdf", 0.5, "c.pdf"), (6, "alpha beta gamma delta epsilon zeta eta", "", "", "", "pdf", 0.5, "e.pdf"), (7, "alpha beta gamma delta epsilon zeta eta theta", "", "", "", "docx", 0.6, "f.docx")])
ONTO = values("ext_id, source, label, description, categories, confidence", [
    ("d1", "dbpedia", "Capital asset pricing model", "A model of investment risk", "finance|models", 0.6), ("d2", "dbpedia", "Variance", "In statistics, a measure of dispersion", "statistics", 0.5), ("d3", "dbpedia", "Variance (album)", "An album by a band", "music", 0.5),
    ("d4", "dbpedia", "Beta (finance)", "Market risk of an asset", "finance", 0.4), ("d5", "dbpedia", "Beta (village)", "A village", "places", 0.9), ("w1", "wikidata", "CAPM", "financial model", "finance", 0.3), ("d6", "dbpedia", "Gamma", "A film", "films", 0.1)])
CON = values("id, name, type, description, confidence, enriched, ext_id, external_source", [(1, "capm", "model", "", 0.7, False, None, None), (2, "Variance", "metric", "spread", 0.95, True, "x9", "local"), (3, "Beta", "metric", None, 0.5, True, None, "dbpedia"), (4, "Gamma", "metric", "", 0.5, True, "g1", "dbpedia"), (5, "Nothing", "model", "n", 0.4, False, None, None)])
EXPECT = values("name, expected_id", [("capm", "d1"), ("Variance", "d2"), ("Gamma", "g1"), ("Missing", "m")])
OLD = "(SELECT doc_id, text FROM documents WHERE doc_id % 7 <> 0)"
NEW = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"
DIFF = f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'created' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.text <> b.text THEN 'modified' ELSE 'none' END AS change FROM {OLD} a FULL JOIN {NEW} b ON a.doc_id = b.doc_id"
KEYS = values("key", [("capm",), ("CAPM",), ("beta",), ("x",), ("Alpha,",), (" sharpe ratio",)])
ACCESS = "(SELECT user_id AS key, min(epoch_us(ts)) AS created_at, max(epoch_us(ts)) AS last_accessed, count(*) AS access_count, min(event_type) AS source, CAST(sum(length(props)) AS BIGINT) AS size FROM events GROUP BY user_id)"
DEB = """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), r AS (SELECT event_type, event_id, t, n, t AS last, true AS kept FROM e WHERE n = 1
 UNION ALL SELECT e.event_type, e.event_id, e.t, e.n, CASE WHEN e.t - r.last >= 14400000000 THEN e.t ELSE r.last END, e.t - r.last >= 14400000000 FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1) SELECT event_type, event_id FROM r WHERE kept"""
BAT = "SELECT event_type, session, CAST((n - 1) // 10 AS BIGINT) AS batch, count(*) AS n FROM (SELECT event_type, session, row_number() OVER (PARTITION BY event_type, session ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) > INTERVAL 40 MINUTE THEN 1 ELSE 0 END AS new FROM events))) GROUP BY ALL"


def snapshot(s):
    return frame(s, ONTO).withColumn("categories", F.split("categories", r"\|"))


def events(s, d):
    return table(s, d, "events")


def accesses(s, d):
    t = L.micros()
    return events(s, d).groupBy(F.col("user_id").alias("key")).agg(F.min(t).alias("created_at"), F.max(t).alias("last_accessed"), F.count("*").alias("access_count"), F.min("event_type").alias("source"), F.sum(F.length("props")).alias("size"))


def versions(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    return docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


def merged(s):
    c = frame(s, DUP)
    return c, D.groups(c, D.pairs(c, 0.8))


def stream_debounce(s, d):
    """The streaming debouncer run to its end over the event table."""
    schema = events(s, d).schema
    root = shared_folder(s)
    import uuid

    name = f"debounced_{uuid.uuid4().hex}"
    st = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    q = L.stream_debounce(st.withColumn("key", F.col("event_type")), 14400.0).writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("key string, event_id bigint").parquet(f"{root}/{name}").select(F.col("key").alias("event_type"), "event_id")


def stream_upsert(s, d):
    """Two batches of documents, the second replacing some of the first, through the foreachBatch writer."""
    import uuid

    root = shared_folder(s)
    target = f"{root}/upsert_{uuid.uuid4().hex}"
    old, new = versions(s, d)
    run = L.upsert_batch(target, "doc_id")
    run(old, 0)
    run(new, 1)
    return L.current(s, target).select("doc_id", F.length("text").cast("long").alias("n"))


BEST = "(VALUES (1, 'd1'), (2, 'd2'), (3, 'd4')) AS m(id, ext_id)"
#: Parts as concepts; the SQL compares all pairs.
PART_WORDS = "list_distinct(list_filter(string_split(lower({c}), ' '), lambda x: x <> ''))"
PART_JACCARD = "len(list_intersect(a.{c}, b.{c}))::DOUBLE / len(list_distinct(list_concat(a.{c}, b.{c})))"
PART_PAIRS = f"""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS name, {PART_WORDS.format(c='p_name')} AS n, {PART_WORDS.format(c="concat(p_type, ' ', p_brand)")} AS d FROM part),
 s AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.name = b.name THEN 1.0 ELSE (0.4 * {PART_JACCARD.format(c='n')} + 0.2 * {PART_JACCARD.format(c='d')}) / (0.4 + 0.2) END AS x FROM p a JOIN p b ON a.id < b.id) SELECT a, b, round(x, 6)::DOUBLE AS similarity FROM s WHERE round(x, 6) >= 0.7"""


def part_concepts(s, d):
    none = F.lit(None).cast("string")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), none.alias("symbol"), F.concat_ws(" ", "p_type", "p_brand").alias("description"), none.alias("definition"), F.lit("pdf").alias("doc_type"))


QUERIES = {
    "dedup_parts": (lambda s, d: D.pairs(part_concepts(s, d), 0.7), PART_PAIRS),
    "dedup_pairs": (lambda s, d: D.pairs(frame(s, DUP), 0.8), "SELECT * FROM (VALUES (1, 2, 1.0::DOUBLE), (3, 4, 1.0::DOUBLE), (6, 7, 0.875::DOUBLE)) AS t(a, b, similarity)"),
    "dedup_typed": (lambda s, d: D.pairs(frame(s, DUP), 0.85, typed=True), "SELECT * FROM (VALUES (1, 2, 0.95::DOUBLE), (3, 4, 0.95::DOUBLE)) AS t(a, b, similarity)"),
    "dedup_groups": (lambda s, d: merged(s)[1], "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6)) AS t(id, grp)"),
    "dedup_merge": (lambda s, d: D.merge(*merged(s)).select("grp", "name", "confidence", "merged_from", "sources"), "SELECT grp, name, confidence::DOUBLE AS confidence, merged_from::BIGINT AS merged_from, sources FROM (VALUES (1, 'Black-Scholes Formula', 0.9, 2, 'a.html,b.xml'), (3, 'Ratio of Sharpe', 0.95, 2, 'c.pdf,d.tex'), (5, 'Beta', 0.5, 1, 'c.pdf'), (6, 'alpha beta gamma delta epsilon zeta eta', 0.6, 2, 'e.pdf,f.docx')) AS t(grp, name, confidence, merged_from, sources)"),
    "dedup_base": (lambda s, d: D.best_by_type(*merged(s)), "SELECT * FROM (VALUES (1, 1, 'html'), (3, 3, 'pdf'), (5, 5, 'pdf'), (6, 6, 'pdf')) AS t(grp, id, doc_type)"),
    "dedup_documents": (lambda s, d: table(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "enrich_match": (lambda s, d: J.best_match(frame(s, CON), snapshot(s)).select("id", "ext_id"), f"SELECT * FROM {BEST}"),
    "enrich_apply": (lambda s, d: J.apply(frame(s, CON).withColumn("aliases", F.array("name")), J.best_match(frame(s, CON), snapshot(s)), snapshot(s)).select("id", "name", "description", F.array_join("aliases", "|").alias("aliases"), F.round("confidence", 6).alias("confidence")), f"SELECT c.id, CASE lower(c.name) WHEN 'capm' THEN 'CAPM' ELSE c.name END AS name, coalesce(nullif(c.description, ''), o.description) AS description, array_to_string(list_sort(list_distinct(list_filter([c.name, o.label], lambda x: x IS NOT NULL))), '|') AS aliases, round(CASE WHEN o.confidence > 0.5 THEN least(1.0, c.confidence + 0.1) ELSE c.confidence END, 6)::DOUBLE AS confidence FROM (SELECT * FROM {CON}) c LEFT JOIN {BEST} ON m.id = c.id LEFT JOIN (SELECT * FROM {ONTO}) o ON o.ext_id = m.ext_id"),
    "enrich_merge": (lambda s, d: J.merge_sources(J.best_match(frame(s, CON), snapshot(s).where("source = 'dbpedia'")), J.best_match(frame(s, CON), snapshot(s).where("source = 'wikidata'"))), "SELECT * FROM (VALUES (1, 'first', 'd1', 'w1'), (2, 'first', 'd2', NULL), (3, 'first', 'd4', NULL)) AS t(id, \"primary\", ext_id, other_id)"),
    "enrich_audit": (lambda s, d: J.audit(frame(s, CON), frame(s, EXPECT)), f"SELECT e.name, CASE WHEN c.ext_id IS NULL THEN 'missing' WHEN c.ext_id <> e.expected_id THEN 'incorrect' ELSE 'correct' END AS state FROM (SELECT * FROM {EXPECT}) e LEFT JOIN (SELECT * FROM {CON}) c ON c.name = e.name"),
    "enrich_repair": (lambda s, d: J.repair(frame(s, CON)).select("id", "enriched", "ext_id", "was_bad"), f"SELECT id, enriched AND NOT bad AS enriched, CASE WHEN NOT bad THEN ext_id END AS ext_id, bad AS was_bad FROM (SELECT *, coalesce(enriched AND (ext_id IS NULL OR external_source = 'local'), false) AS bad FROM {CON})"),
    "cache_live": (lambda s, d: K.live(accesses(s, d).withColumn("expires_at", F.when(F.col("key") % 3 > 0, F.col("last_accessed") + 86_400_000_000)), F.lit(1706500000000000)).select("key"), f"SELECT key FROM {ACCESS} WHERE key % 3 = 0 OR last_accessed + 86400000000 > 1706500000000000"),
    "cache_lru": (lambda s, d: K.evict(accesses(s, d), 10).select("key"), f"SELECT key FROM {ACCESS} ORDER BY last_accessed DESC, created_at DESC, key DESC LIMIT 9"),
    "cache_stats": (lambda s, d: K.stats(accesses(s, d)), f"SELECT source, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(access_count) AS BIGINT) AS hits FROM {ACCESS} GROUP BY source"),
    "cache_audit": (lambda s, d: K.audit(frame(s, KEYS)), "SELECT * FROM (VALUES ('capm', 'duplicate'), ('CAPM', 'duplicate'), ('x', 'invalid'), ('Alpha,', 'not normal'), (' sharpe ratio', 'not normal')) AS t(key, problem)"),
    "snapshot_diff": (lambda s, d: L.snapshot_diff(*versions(s, d), "doc_id", "text"), DIFF),
    "sync_report": (lambda s, d: L.sync_report(L.snapshot_diff(*versions(s, d), "doc_id", "text")), f"SELECT CASE WHEN change IN ('created', 'modified') THEN 'processed' WHEN change = 'deleted' THEN 'deleted' ELSE 'skipped' END AS action, count(*) AS n FROM ({DIFF}) GROUP BY 1"),
    "skip_existing": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "debounce": (lambda s, d: L.debounce(events(s, d), 14400.0, "event_type"), DEB),
    "write_complete": (lambda s, d: L.write_complete(events(s, d).withColumn("size", F.floor(F.col("value") / 20)), "user_id").select("user_id", "event_id"), "SELECT user_id, event_id FROM (SELECT *, lag(floor(value / 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was = floor(value / 20)"),
    "batch_flush": (lambda s, d: L.batches(events(s, d), "40 minutes", 10, "event_type"), BAT),
    "batch_summary": (lambda s, d: events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("ok"), F.round(F.avg("value"), 6).alias("mean")), "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS ok, round(avg(value), 6) AS mean FROM events GROUP BY event_type"),
    "progress": (lambda s, d: L.progress(events(s, d).select((F.col("value") > 10).alias("ok"), F.lit(0.5).alias("seconds")), 20_000), "SELECT count(*) AS done, count(*) FILTER (NOT value > 10) AS failed, 2.0::DOUBLE AS rate, round(100 * count(*) / 20000.0, 3)::DOUBLE AS percent, round((20000 - count(*)) / 2.0, 3)::DOUBLE AS eta_seconds FROM events"),
    "stream_debounce": (stream_debounce, DEB),
    "stream_upsert": (stream_upsert, f"SELECT doc_id, length(text) AS n FROM {NEW} UNION ALL SELECT doc_id, length(text) FROM {OLD} WHERE doc_id % 11 = 0"),
}
