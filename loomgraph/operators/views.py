"""What a viewer of the graph reads: nodes, edges, legends, neighbours, tooltips, and analyses of the whole graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.operators import extract, graph

# Colours of concept types, and ontology classes of types.
COLOURS = {
    "equation": "#FF6B6B", "formula": "#4ECDC4", "variable": "#45B7D1", "constant": "#96CEB4", "function": "#FFEAA7", "matrix": "#DDA0DD",
    "portfolio": "#FFB74D", "risk": "#F06292", "return": "#81C784", "optimization": "#BA68C8", "metric": "#64B5F6", "methodology": "#A1887F",
}
OTHER_COLOUR = "#9E9E9E"
CLASSES = {"equation": "dbo:Equation", "formula": "dbo:Formula", "function": "dbo:Function", "theorem": "dbo:Theorem", "algorithm": "dbo:Algorithm", "methodology": "dbo:Method", "metric": "dbo:Measurement", "model": "dbo:Model"}
GREEK = ("alpha", "beta", "gamma", "delta", "sigma", "mu", "lambda")


def colour(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(N.literal_map(COLOURS), kind), F.lit(OTHER_COLOUR))


def ontology_class(kind: Column) -> Column:
    return F.try_element_at(N.literal_map(CLASSES), kind)


def tooltip(external: str = "external_source") -> Column:
    """JSON of what a node's tooltip says; an enriched one names its source."""
    base = [F.col("name"), F.col("type"), F.format_number("confidence", 2).alias("confidence"), F.col("source")]
    return F.to_json(F.struct(*base, F.when(F.col("enriched"), F.coalesce(external, F.lit("Unknown"))).alias("external_source")))


def visual_nodes(concepts: DataFrame) -> DataFrame:
    """(id, label, type, color, size, border, tooltip) of concepts (id, name, type, confidence, source, enriched, external_source)."""
    on = F.col("enriched")
    return concepts.select(
        "id", F.col("name").alias("label"), "type", F.when(on, "#4CAF50").otherwise("#2196F3").alias("color"), F.when(on, 20).otherwise(15).alias("size"),
        F.when(on, "#2E7D32").otherwise("#1976D2").alias("border"), tooltip().alias("tooltip"),
    )


def visual_edges(edges: DataFrame) -> DataFrame:
    """(source, target, label, color, width) of edges with a source_type."""
    external = F.col("source_type") == "dbpedia"
    label = F.initcap(F.replace("type", F.lit("_"), F.lit(" ")))
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), label.alias("label"), F.when(external, "#FF9800").otherwise("#666666").alias("color"), F.when(external, 3).otherwise(2).alias("width"))


def legend(concepts: DataFrame) -> DataFrame:
    """(type, color): the types in use that have a colour."""
    c = F.try_element_at(N.literal_map(COLOURS), F.col("type"))
    return concepts.select("type").distinct().withColumn("color", c).where("color is not null")


def tooltip_search(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose label, type or tooltip contains the query in any case."""
    hit = [F.contains(F.lower(c), F.lit(q.lower())) for c in ("label", "type", "tooltip")]
    return nodes.where(hit[0] | hit[1] | hit[2])


def expand_neighbours(concepts: DataFrame, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that external neighbours add: the first ``limit`` of ``related`` of each concept, tied to it and to each other.

    A parent has at most ``limit`` neighbours, so their pairs are few; they are made inside its row.
    """
    first = F.slice("related", 1, limit)
    near = F.transform(first, lambda n, i: F.struct(F.concat(F.col("id").cast("string"), F.lit("_related_"), i.cast("string")).alias("id"), n.alias("name")))
    d = concepts.where(F.size("related") > 0).select("id", near.alias("near"))
    nodes = d.select(F.col("id").alias("parent"), F.explode("near").alias("n")).select("n.id", "n.name", F.lit("concept").alias("type"), F.lit(0.7).alias("confidence"), F.col("parent").cast("string").alias("parent"))
    tied = F.transform("near", lambda n: F.struct(F.col("id").cast("string").alias("src"), n["id"].alias("dst"), F.lit("related_to").alias("type"), F.lit(0.7).alias("confidence")))
    pairs = F.flatten(
        F.transform(
            "near",
            lambda a, i: F.transform(
                F.slice("near", i + 2, limit),
                lambda b: F.struct(F.least(a["id"], b["id"]).alias("src"), F.greatest(a["id"], b["id"]).alias("dst"), F.lit("semantic_similarity").alias("type"), F.lit(0.6).alias("confidence")),
            ),
        )
    )
    return nodes, d.select(F.explode(F.concat(tied, pairs)).alias("e")).select("e.*")


def enrichment(concepts: DataFrame) -> DataFrame:
    """(id, badge, url, description): what a viewer shows of a concept's enrichment, with fallbacks."""
    source = F.when(F.col("external_source") == "dbpedia", "dbpedia").when(F.col("enriched"), "enriched").otherwise("local")
    page = F.concat(F.lit("http://dbpedia.org/resource/"), F.replace(F.initcap("name"), F.lit(" "), F.lit("_")))
    return concepts.select("id", source.alias("badge"), F.when(source != "local", page).alias("url"), F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Concept: "), "name")).alias("description"))


def related_by_name(concepts: DataFrame, edges: DataFrame, q: str) -> DataFrame:
    """Neighbours of the surest concept whose name contains the query; nothing where none does."""
    first = concepts.where(F.contains("name", F.lit(q))).orderBy(F.desc("confidence"), "id").limit(1).select(F.col("id").alias("vertex"))
    e = edges.join(F.broadcast(first), (F.col("src") == F.col("vertex")) | (F.col("dst") == F.col("vertex")))
    out = F.col("src") == F.col("vertex")
    e = e.select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("id"), F.when(out, "outgoing").otherwise("incoming").alias("direction"), "type", "confidence")
    return e.join(concepts.select("id", "name"), "id")


def detail(concepts: DataFrame, edges: DataFrame, vertex) -> DataFrame:
    """A concept with its related concepts: (id, name, related_id, related, direction, type, confidence)."""
    one = F.broadcast(concepts.where(F.col("id") == vertex).select(F.col("id").alias("own_id"), F.col("name").alias("own")))
    near = graph.related(edges, concepts, vertex).select(F.col("id").alias("related_id"), F.col("name").alias("related"), "direction", "type", "confidence")
    return one.join(near, F.lit(True)).select(F.col("own_id").alias("id"), F.col("own").alias("name"), *near.columns)


def statistics(concepts: DataFrame, edges: DataFrame, document: str) -> DataFrame:
    """(metric, value, n): totals of concepts, relationships and documents, and both by type."""
    row = lambda df, m, v: df.select(F.lit(m).alias("metric"), v.alias("value"), F.col("n").cast("long").alias("n"))
    count, every = F.count("*").alias("n"), F.lit("all")
    out = row(concepts.agg(count), "total_concepts", every).union(row(edges.agg(count), "total_relationships", every))
    out = out.union(row(concepts.agg(F.countDistinct(document).alias("n")), "documents", every))
    out = out.union(row(concepts.groupBy("type").agg(count), "concept_type", F.col("type")))
    return out.union(row(edges.groupBy("type").agg(count), "relationship_type", F.col("type")))


def network(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, mean degree, density, mean confidence, weak and strong components, and whether it hangs together."""
    strong = graph.strong_components(edges).agg(F.countDistinct("component").alias("strong"))
    m = graph.metrics(edges)
    return m.join(F.broadcast(strong), F.lit(True)).withColumn("connected", F.col("weak") == 1)


def query(spark: SparkSession, concepts: DataFrame, edges: DataFrame, sql: str) -> DataFrame:
    """A statement over the views concepts and relationships."""
    concepts.createOrReplaceTempView("concepts")
    edges.createOrReplaceTempView("relationships")
    return spark.sql(sql)


def without_documents(rows: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of documents that still exist: what a deletion event leaves."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def pdf_confidence(c: Column, symbols: str, fonts: bool = False) -> Column:
    """How surely a line of a page is mathematics: symbols, fonts, equation signs, operators, usual variables; at most 1."""
    n = F.length(c)
    yes = lambda b, v: F.when(b, v).otherwise(0.0)
    ops = sum((F.contains(c, F.lit(x)).cast("int") for x in "+-*/^()"), F.lit(0))
    s = F.least(F.lit(0.4), 2 * F.regexp_count(c, F.lit(symbols)) / n) + (0.3 if fonts else 0.0)
    s = s + yes(F.regexp_like(c, F.lit(r"[a-zA-Z][ \t\r\n\f]*=|[0-9][ \t\r\n\f]*=|=[ \t\r\n\f]*[a-zA-Z0-9]")), 0.2) + yes(ops >= 2, 0.2) + yes(F.regexp_like(c, F.lit("[xyzRrwEV]")), 0.1)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), s))


def gated_group(c: Column, confidence: Column) -> Column:
    """Group of a mathematical text; special groups need a sure detection, ordinary ones a fair one."""
    low, sure, fair = F.lower(c), confidence > 0.7, confidence > 0.4
    has = lambda p, t=low: F.regexp_like(t, F.lit(p))
    return (
        F.when(sure & has("portfolio|return|variance|covariance|weight|sharpe"), "portfolio_theory")
        .when(sure & has("probability|distribution|hypothesis|test|correlation"), "statistics")
        .when(sure & (has("[∑∏∫]", c) | has("matrix")), "matrix_vector")
        .when(fair & has(r"^[a-zA-Z][ \t\r\n\f]*=", N.strip(c)), "variable_definition")
        .when(fair & (F.regexp_count(c, F.lit("=")) == 1) & has("[+*/-]", c), "equation")
        .when(fair & has("/|ratio|rate"), "ratio")
        .otherwise("general_math")
    )


def linking_variables(c: Column) -> Column:
    """Single letters, letters with digits, and Greek letters written out, distinct and in order: what links blocks."""
    words = F.filter(F.split(F.regexp_replace(c, "[^A-Za-z0-9_]+", "  "), " +"), lambda w: F.regexp_like(w, F.lit("^[A-Za-z][0-9]*$")))
    greek = F.filter(F.array(*map(F.lit, GREEK)), lambda g: F.contains(F.lower(c), g))
    return F.array_sort(F.array_distinct(F.concat(words, greek)))


def chunk_pages(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks (chunk, page, block ids) with the page of their first mathematical block where they have none of their own."""
    has = chunks.select("chunk", F.explode("blocks").alias("block")).join(blocks, "block").groupBy("chunk").agg(F.min_by("block_page", "seq").alias("first_page"))
    return chunks.join(has, "chunk", "left").withColumn("page", F.coalesce("page", "first_page")).drop("first_page")


def with_markers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n): texts with a reference before each mathematical line; positions are those of the given text."""
    hits = extract.math_lines(df, text, key)
    mark = F.concat(F.lit("[MATHREF_"), F.col(key).cast("string"), F.lit("_"), F.col("line").cast("string"), F.lit("] @"), F.col("grp"), F.lit(": "))
    per = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", mark.alias("mark")))).alias("hits"))
    piece = F.transform("hits", lambda h, i: F.concat(F.substring(F.col("t"), F.when(i == 0, 1).otherwise(F.get("hits", i - 1)["start"] + 1).cast("int"), (h["start"] - F.when(i == 0, 0).otherwise(F.get("hits", i - 1)["start"])).cast("int")), h["mark"]))
    rest = F.expr("substring(t, int(element_at(hits, -1).start) + 1)")
    d = df.select(key, F.col(text).alias("t")).join(per, key, "left")
    return d.select(key, F.when(F.col("hits").isNull(), F.col("t")).otherwise(F.concat(F.array_join(piece, ""), rest)).alias("text"), F.coalesce(F.size("hits"), F.lit(0)).alias("n"))


def candidates(rows: DataFrame) -> DataFrame:
    """(src, dst, type) with n, best confidence, best method score, the evidence in order and the first source."""
    m = F.coalesce(F.try_element_at(N.literal_map(extract.METHODS), F.col("method")), F.lit(0.0))
    return rows.groupBy("src", "dst", "type").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max(m).alias("method_score"), F.array_join(F.array_sort(F.collect_set("context")), "|").alias("evidence"), F.min_by("method", "seq").alias("provenance")
    )


def search_all(sources: dict[str, DataFrame], q: str, limit: int = 5) -> DataFrame:
    """(source, name, confidence): the surest ``limit`` names of each source that contain the query."""
    out = None
    for name, df in sources.items():
        one = df.where(F.contains(F.lower("name"), F.lit(q.lower()))).orderBy(F.desc("confidence"), "name").limit(limit).select(F.lit(name).alias("source"), "name", "confidence")
        out = one if out is None else out.union(one)
    return out
