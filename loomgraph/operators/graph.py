"""Graph operators over an edge table (src, dst, type, confidence) and a vertex table (id, name, ...)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UP = ("part_of", "specializes", "derives_from", "depends_on")
DOWN = ("contains", "generalizes", "implies", "produces")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all tasks run in this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def valid_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = concepts.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: Iterable[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def related(edges: DataFrame, concepts: DataFrame, vertex, kind: str | None = None) -> DataFrame:
    """(id, name, direction, type, confidence) of the neighbours; a loop is reported once, as outgoing."""
    e = edges.where(F.col("type") == kind) if kind else edges
    out = e.where(F.col("src") == vertex).select(F.col("dst").alias("id"), F.lit("outgoing").alias("direction"), "type", "confidence")
    inc = e.where((F.col("dst") == vertex) & (F.col("src") != vertex)).select(F.col("src").alias("id"), F.lit("incoming").alias("direction"), "type", "confidence")
    return out.unionByName(inc).join(concepts.select("id", "name"), "id")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, id, hop): vertices within ``depth`` steps along src -> dst of the rows of ``start`` (root, id), with the least hop.

    One join a step; vertices already reached leave the frontier, so dense graphs do not multiply paths.
    """
    seen = start.select("root", "id", F.lit(0).alias("hop"))
    front = seen
    for h in range(1, depth + 1):
        step = front.join(edges.select(F.col("src").alias("id"), "dst"), "id").select("root", F.col("dst").alias("id")).distinct()
        front = cut(step.join(seen, ["root", "id"], "left_anti").withColumn("hop", F.lit(h)))  # else the plan doubles a step
        seen = seen.unionByName(front)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def k_hop(edges: DataFrame, vertex: DataFrame, k: int = 2) -> DataFrame:
    return reach(undirected(edges), vertex, k)


def hierarchy(edges: DataFrame, vertex: DataFrame, depth: int = 3) -> DataFrame:
    """(root, id, hop, side): ancestors come over incoming upward types, descendants over outgoing downward types."""
    up = edges.where(F.col("type").isin(*UP)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = edges.where(F.col("type").isin(*DOWN)).select("src", "dst")
    side = lambda e, name: reach(e.distinct(), vertex, depth).where("hop > 0").withColumn("side", F.lit(name))
    return side(up, "ancestor").unionByName(side(down, "descendant"))


def shortest_path(edges: DataFrame, a, b, limit: int = 5) -> DataFrame:
    """(hops, path): the alphabetically first of the shortest undirected paths of at most ``limit`` steps.

    Breadth first; each vertex keeps one least path, so a step makes at most one row a vertex.
    """
    und = undirected(edges)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    front = spark.range(1).select(F.lit(a).cast(kind).alias("id"), F.lit(a).cast("string").alias("path"), F.lit(0).alias("hops"))
    seen = front
    for h in range(1, limit + 1):
        step = front.join(und.withColumnRenamed("src", "id"), "id").groupBy("dst").agg(F.min(F.concat_ws(">", "path", F.col("dst").cast("string"))).alias("path"))
        front = cut(step.select(F.col("dst").alias("id"), "path", F.lit(h).alias("hops")).join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen.where(F.col("id") == F.lit(b).cast(kind)).select("hops", "path")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) after parallel edges collapse."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count("*").alias("degree"))


def centrality(edges: DataFrame, top: int = 10) -> DataFrame:
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("id", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality")).orderBy(F.desc("degree"), "id").limit(top)


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, component): least vertex reachable, edges taken both ways; min labels with pointer jumping, a checkpoint a round."""
    both = cut(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).union(edges.select(F.col(b), F.col(a))).distinct())
    lab = cut(both.groupBy(F.col("s").alias("id")).agg(F.least(F.col("id"), F.min("d")).alias("c")))
    while True:
        near = both.join(lab.select(F.col("id").alias("d"), F.col("c").alias("n")), "d").groupBy(F.col("s").alias("id")).agg(F.min("n").alias("n"))
        step = lab.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        up = lab.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = cut(step.join(up, "c", "left").select("id", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        if not new.where("old <> c").limit(1).count():
            return new.select("id", F.col("c").alias("component"))
        lab = new.select("id", "c")


def _least_reaching(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, c): the least vertex from which each one can be reached, itself included; labels spread until none changes."""
    lab = cut(vertices.select("id", F.col("id").alias("c")))
    while True:
        near = edges.join(lab.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
        new = cut(lab.join(near, "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c")))
        lab = new.select("id", "c")
        if not new.where("old <> c").limit(1).count():
            return lab


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): vertices that reach each other, named by the least of them.

    Colouring: a vertex takes the least vertex that reaches it as colour; what reaches that vertex back inside
    its colour is its component and leaves, and the rest is coloured again. No pairs of vertices are made.
    """
    rest = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    out = None
    while True:
        colour = _least_reaching(left, rest)
        of = lambda end, name: colour.select(F.col("id").alias(end), F.col("c").alias(name))
        inside = cut(rest.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst"))
        # Turned round, so that the colour's own vertex is the least that reaches.
        back = _least_reaching(left, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("c", "r")
        done = cut(colour.join(back, "id").where("c = r").select("id", F.col("c").alias("component")))
        out = done if out is None else out.union(done)
        left = cut(left.join(done.select("id"), "id", "left_anti"))
        if not left.limit(1).count():
            return out
        rest = cut(inside.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))


def metrics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean degree, density, mean confidence, weak components."""
    d = degrees(edges).agg(F.count("*").alias("n"))
    e = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).agg(F.count("*").alias("m"), F.avg("confidence").alias("confidence"))
    w = components(edges).agg(F.countDistinct("component").alias("weak"))
    return d.crossJoin(e).crossJoin(w).select(
        "n", "m", F.round(2 * F.col("m") / F.col("n"), 6).alias("avg_degree"), F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 9).alias("density"), F.round("confidence", 6).alias("avg_confidence"), "weak"
    )


def structural_filter(edges: DataFrame) -> DataFrame:
    """Edges of confidence .7; of .5; or weaker ones between vertices of degree 2 that share a successor."""
    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    succ = edges.select("src", "dst").distinct()
    pairs = e.where("confidence < 0.5 and ds >= 2 and dd >= 2").select("src", "dst").distinct()
    common = pairs.join(succ.select("src", F.col("dst").alias("s")), "src").join(succ.select(F.col("src").alias("dst"), F.col("dst").alias("s")), ["dst", "s"], "left_semi").select("src", "dst").distinct().withColumn("common", F.lit(True))
    return e.join(common, ["src", "dst"], "left").where((F.col("confidence") >= 0.5) | F.col("common")).select(*edges.columns)


def cytoscape_nodes(concepts: DataFrame) -> DataFrame:
    """(id, label, size): labels cut at 15 characters, size by confidence."""
    label = F.when(F.length("name") > 15, F.concat(F.substring("name", 1, 12), F.lit("..."))).otherwise(F.col("name"))
    return concepts.select("id", label.alias("label"), F.round(300 + 700 * F.col("confidence"), 3).alias("size"))


def cytoscape_edges(edges: DataFrame) -> DataFrame:
    """Edges with a stable number: order of src, dst, type, counted inside sources so that no task sees all rows."""
    w = Window.partitionBy("src").orderBy("dst", "type")
    title = F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))
    return edges.withColumn("n", F.row_number().over(w)).select(F.concat(F.lit("edge_"), F.col("src").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), title.alias("label"))
