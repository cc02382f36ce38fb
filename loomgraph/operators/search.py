"""Search, lookup, facets and documents over a concept table (id, name, type, frequency, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as N


def concepts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(name, frequency, n_docs): one row per distinct token; counts combine before the shuffle."""
    per = docs.select(key, F.explode(N.tokens(F.col(text))).alias("name")).groupBy("name", key).agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.sum("n").alias("frequency"), F.count("*").alias("n_docs"))


def search(concepts: DataFrame, q: str, limit: int = 20, floor: float = 0.1) -> DataFrame:
    """Ranked search: relevance, then frequency, then name, then id where there is one; only a top-k leaves each task."""
    score = N.relevance(q, F.col("name"), F.col("context"), F.col("type"), F.col("frequency"), F.col("confidence"))
    hit = concepts.withColumn("relevance", F.round(score, 6)).where(F.col("relevance") >= floor)
    last = ["id"] if "id" in concepts.columns else []
    return hit.orderBy(F.desc("relevance"), F.desc("frequency"), "name", *last).limit(limit)


def by_type(concepts: DataFrame, kind: str) -> DataFrame:
    return concepts.where(F.lower("type") == kind.lower())


def type_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def type_info(concepts: DataFrame) -> DataFrame:
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")
    return concepts.groupBy("type").agg(F.count("*").alias("n"), sets("domain").alias("domains"), sets("complexity").alias("levels"))


def contains_search(concepts: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Case-sensitive containment in name, description or an alias, by confidence."""
    hit = F.contains("name", F.lit(q)) | F.contains("description", F.lit(q)) | F.exists("aliases", lambda a: F.contains(a, F.lit(q)))
    return concepts.where(hit).orderBy(F.desc("confidence"), "id").limit(limit)


def fuzzy_lookup(concepts: DataFrame, q: str) -> DataFrame:
    """(id, hit): name and each alias that contains the query or is contained in it; a concept may come twice."""
    every = concepts.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("hit"))
    low = F.lower("hit")
    return every.where(F.contains(low, F.lit(q.lower())) | (F.contains(F.lit(q.lower()), low) & (low != "")))


def suggestions(concepts: DataFrame, q: str, limit: int = 8) -> DataFrame:
    """Names starting with the query before names containing it; one row per text."""
    low = F.lower("name")
    s = concepts.withColumn("rank", F.when(F.startswith(low, F.lit(q.lower())), 2).when(F.contains(low, F.lit(q.lower())), 1)).where("rank is not null")
    w = Window.partitionBy("name").orderBy(F.desc("rank"), F.desc("frequency"), F.desc("confidence"), "id")
    one = s.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.orderBy(F.desc("rank"), F.desc("frequency"), F.desc("confidence"), "name").limit(limit)


def page(concepts: DataFrame, number: int, size: int) -> DataFrame:
    return concepts.orderBy(F.desc("frequency"), "name", "id").offset((number - 1) * size).limit(size)


def with_defaults(concepts: DataFrame, defaults: dict) -> DataFrame:
    return concepts.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def filtered(concepts: DataFrame, column: str, value: str, default: str, limit: int = 50) -> DataFrame:
    """Rows whose column, or its default where empty, has the value; by frequency, then confidence."""
    got = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))
    return concepts.where(got == value).orderBy(F.desc("frequency"), F.desc("confidence"), "id").limit(limit)


def prerequisites(concepts: DataFrame, target: str) -> DataFrame:
    """(id, name, hop): concepts named as prerequisites of ``target``, and the prerequisites of those."""
    pre = concepts.select("id", "name", "frequency", F.explode("prerequisites").alias("p"))
    direct = pre.where(F.lower("name") == target.lower()).select(F.lower("p").alias("k")).distinct()
    base = concepts.select("id", "name", "frequency", F.lower("name").alias("k"))
    one = base.join(direct, "k").withColumn("hop", F.lit(1))
    two = base.join(pre.join(direct, F.lower("name") == F.col("k"), "left_semi").select(F.lower("p").alias("k")).distinct(), "k").withColumn("hop", F.lit(2))
    return one.union(two).groupBy("id", "name", "frequency").agg(F.min("hop").alias("hop"))


def data_source(external: str = "external_source", enriched: str = "enriched"):
    return F.when(F.col(external) == "dbpedia", "dbpedia").when(F.col(enriched), "enriched").otherwise("local")


def visible(concepts: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """Edges both of whose ends pass the filter ``keep``."""
    ids = concepts.where(keep).select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, concepts, occurrences) of each document, most concepts first in the sense of ``concepts``."""
    return docs.select(key, N.tokens(F.col(text)).alias("t")).select(key, F.size(F.array_distinct("t")).cast("long").alias("concepts"), F.size("t").cast("long").alias("occurrences"))


def evolution(docs: DataFrame, names: list[str]) -> DataFrame:
    """(name, source, docs, occurrences): where the given concepts occur."""
    t = docs.select("doc_id", "source", F.explode(N.tokens(F.col("text"))).alias("name")).where(F.col("name").isin(names))
    return t.groupBy("name", "source").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("occurrences"))
