"""Tables and fixtures of the query plans. A fixture is one VALUES clause that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(columns: str, rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}E0" if "e" not in repr(v) else repr(v)
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def frame(spark: SparkSession, fixture: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + fixture)


#: Concepts as both engines derive them from the part table.
PARTS_SQL = """(SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS domain, CASE WHEN p_size < 15 THEN 'beginner' WHEN p_size < 35 THEN 'intermediate' ELSE '' END AS complexity,
 CAST(p_size * 37 AS BIGINT) AS frequency, round(p_size / 50.0, 6) AS confidence, concat(p_type, ' by ', p_brand) AS context, concat('made as ', p_brand) AS description, upper(p_name) AS alias FROM part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    level = F.when(F.col("p_size") < 15, "beginner").when(F.col("p_size") < 35, "intermediate").otherwise("")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("domain"), level.alias("complexity"),
        (F.col("p_size") * 37).cast("long").alias("frequency"), F.round(F.col("p_size") / 50, 6).alias("confidence"), F.concat("p_type", F.lit(" by "), "p_brand").alias("context"),
        F.concat(F.lit("made as "), "p_brand").alias("description"), F.array(F.upper("p_name")).alias("aliases"),
    )


#: The geography as a typed graph: suppliers and customers in nations, nations in regions; regions contain nations.
EDGES_SQL = """(SELECT concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS dst, 'part_of' AS type, 0.9E0 AS confidence FROM nation
 UNION ALL SELECT concat('r', n_regionkey), concat('n', n_nationkey), 'contains', 0.8E0 FROM nation
 UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'part_of', 0.6E0 FROM supplier
 UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 'depends_on', 0.4E0 FROM supplier)"""
VERTICES_SQL = """(SELECT concat('r', r_regionkey) AS id, r_name AS name FROM region UNION ALL SELECT concat('n', n_nationkey), n_name FROM nation UNION ALL SELECT concat('s', s_suppkey), s_name FROM supplier)"""


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    row = lambda a, b, t, c: (a.alias("src"), b.alias("dst"), F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    nn, rr, ss, sn = _id("n", "n_nationkey"), _id("r", "n_regionkey"), _id("s", "s_suppkey"), _id("n", "s_nationkey")
    return n.select(*row(nn, rr, "part_of", 0.9)).union(n.select(*row(rr, nn, "contains", 0.8))).union(s.select(*row(ss, sn, "part_of", 0.6))).union(s.select(*row(sn, ss, "depends_on", 0.4)))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    return r.select(_id("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")).union(n.select(_id("n", "n_nationkey"), "n_name")).union(s.select(_id("s", "s_suppkey"), "s_name"))


TOKENS_SQL = r"(SELECT doc_id, source, w AS name, pos FROM (SELECT doc_id, source, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS ws FROM documents)))"
