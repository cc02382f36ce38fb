"""Text chunks and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 500, 50
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, start, end, body): windows of ``size`` code points, each ``overlap`` before the last one's end."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    d = df.select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).where(F.length("_t") > 0)
    start = F.col("chunk") * step
    return d.select(key, "chunk", start.cast("long").alias("start"), F.least(start + size, F.length("_t")).cast("long").alias("end"), F.expr(f"substring(_t, chunk * {step} + 1, {size})").alias("body"))


def split_recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks: cut at the coarsest separator whose pieces fit, pieces merged up to ``size`` with ``overlap`` kept."""
    spans: list[tuple[int, int]] = []

    def pieces(lo: int, hi: int, level: int):
        if hi - lo <= size:
            if hi > lo:
                yield lo, hi
            return
        sep = separators[level]
        if not sep:
            for a in range(lo, hi, size):
                yield a, min(a + size, hi)
            return
        at = lo
        while at < hi:
            cut = text.find(sep, at, hi)
            end = hi if cut < 0 else cut
            yield from pieces(at, end, level + 1)
            at = end + len(sep)

    held: list[tuple[int, int]] = []
    for p in pieces(0, len(text), 0):
        if held and p[1] - held[0][0] > size:
            spans.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or p[1] - held[0][0] > size):
                held.pop(0)
        held.append(p)
    if held:
        spans.append((held[0][0], held[-1][1]))
    return spans


def recursive(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, start, end, body) by ``split_recursive``; batches go through Arrow."""
    kind = df.schema[key].dataType.simpleString()

    def run(it):
        for pdf in it:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(pdf["k"], pdf["t"]) if t for i, (a, b) in enumerate(split_recursive(t))]
            yield pd.DataFrame(rows, columns=["k", "chunk", "start", "end", "body"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk int, start bigint, end bigint, body string").withColumnRenamed("k", key)


MARKER = r"\[MATHREF_([A-Za-z0-9_]+)\](?: @([a-z_]+):)?(?: @confidence:([0-9.]+))?"


def markers(chunks: DataFrame, body: str = "body") -> DataFrame:
    """Chunks with the number, ids and groups of their math markers, each marker read on its own."""
    ids = F.regexp_extract_all(body, F.lit(MARKER), 1)
    groups = F.array_sort(F.array_distinct(F.array_remove(F.regexp_extract_all(body, F.lit(MARKER), 2), "")))
    return chunks.withColumns({"math_block_count": F.size(ids).cast("long"), "math_block_ids": F.array_join(ids, ","), "semantic_groups": F.array_join(groups, ","), "has_math": F.size(ids) > 0})


def embed(df: DataFrame, key: str, text: str, model, dim: int, batch: int = 30) -> DataFrame:
    """(key, embedding): ``model`` maps a list of texts to vectors; a failed batch is tried three times."""
    kind = df.schema[key].dataType.simpleString()

    def run(it):
        for pdf in it:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                for left in (2, 1, 0):
                    try:
                        got = model(list(part["t"]))
                        break
                    except (OSError, TimeoutError):
                        if not left:
                            raise
                yield pd.DataFrame({"k": part["k"], "embedding": [list(map(float, v)) for v in got]})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Queries of one pass over the vectors: with 64 floats each a few MB are broadcast, and a task keeps k results of each.
QUERY_BLOCK = 10_000
#: Similarities that a task holds at once, 8 MB an array; some eight arrays of that size are alive.
CELLS = 1_000_000


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, kind):
    """Arrow batches (id, v) to rows (q, id, similarity): the k best of the task for each query, ties by id."""
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)

    def run(batches):
        sims, names = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), ids.dtype)
        step = max(1, CELLS // max(1, len(ids)))
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, b.num_rows, step):
                v, near = np.array(b.column(1).slice(at, step).to_pylist(), np.float64), own[at : at + step]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim = np.round(unit @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
                sim[ids[:, None] == near[None, :]] = -np.inf
                better = np.flatnonzero((sim >= sims[:, -1:]).any(1))  # others keep their k best; equal ones may have a smaller id
                sim = np.concatenate([sims[better], sim[better]], 1)
                name = np.concatenate([names[better], np.broadcast_to(near, (len(better), len(near)))], 1)
                order = np.lexsort((name, -sim), axis=1)[:, :k]
                sims[better], names[better] = np.take_along_axis(sim, order, 1), np.take_along_axis(name, order, 1)
        ok = np.isfinite(sims)
        at = np.repeat(np.arange(len(ids)), ok.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]).cast(kind), pa.array(names[ok]).cast(kind), pa.array(sims[ok])], names=["q", "id", "similarity"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, id, similarity): the k most similar other vectors of each stated query, by matrix products.

    Queries go in blocks, one pass over the vectors each; a task sends its k best a query, so what is
    shuffled grows with tasks and queries and not with the vectors. Ids are numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema["id"].dataType
    n = max(1, -(-queries.count() // block))
    out = None
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).select("id", "v").toArrow()
        if not rows.num_rows:
            continue
        q = np.array(rows.column("v").to_pylist(), np.float64).reshape(rows.num_rows, -1)
        part = vectors.select("id", "v").mapInArrow(_nearest(rows.column("id").to_numpy(), q, k, to_arrow_type(kind)), f"q {kind.simpleString()}, id {kind.simpleString()}, similarity double")
        out = part if out is None else out.union(part)
    if out is None:  # no query
        return vectors.limit(0).select(F.col("id").alias("q"), "id", F.lit(0.0).alias("similarity"))
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("q", "id", "similarity")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
