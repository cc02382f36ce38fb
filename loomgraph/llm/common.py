"""Shared helpers of the training-data operators: tables, shared storage, components.

Every helper is lazy unless its docstring says that it writes. Intermediate tables go to the
folder named by ``spark.checkpoint.dir`` (all executors see it), so a lost executor costs a
re-read and never the work before it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and tab to carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where none is configured and all tasks run in this process (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch while tables are written: whole texts of a few thousand characters stay within some MB.
BATCH_ROWS = 1000
#: Rows of a batch sent to Python, and of one read from a table.
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def materialise(df: DataFrame, name: str = "t", rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and stops recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _BATCHES}
    for k, v in before.items():
        spark.conf.set(k, str(min(int(v), rows)))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomgraph_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` (call it once nothing lazy refers to it)."""
    path = df.loomgraph_path
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the files of ended exchanges deleted, which executors keep until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(col: str, n: int):
    """crc32 of the id's decimal text, modulo n: the fixed folds of the contracts."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


#: Bits of the id filter: 2^25 bits are 4 MB however many ids there are.
FILTER_BITS = 25


def id_filter(ids: DataFrame, col: str, raw: bool = False) -> np.ndarray:
    """A bitmap (4 MB whatever the input size) of hashed ids (``raw``: of small numbers as they are); false positives only.

    It thins a large side before an exact semi join; once it saturates, the join does all the work.
    """
    h = F.pmod(F.col(col) if raw else F.xxhash64(F.col(col)), F.lit(1 << FILTER_BITS)) + 1  # bitmap positions start at 1
    rows = (
        ids.select(h.alias("h"))
        .groupBy(F.bitmap_bucket_number("h").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
        .collect()
    )
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        out[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, comp): smallest vertex reachable, for every vertex of ``edges``.

    Min-label propagation with pointer jumping. Each round is written to the shared folder, so the
    plan stays short; links and labels never reach the driver, only the count of changed labels does.
    """
    both = materialise(
        edges.select(F.col(a).alias("s"), F.col(b).alias("d"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("s <> d")
        .distinct(),
        "edges",
    )
    lab = materialise(both.groupBy(F.col("s").alias("v")).agg(F.least(F.col("v"), F.min("d")).alias("comp")), "labels")
    while True:
        near = both.join(lab.select(F.col("v").alias("d"), F.col("comp").alias("c")), "d").groupBy(F.col("s").alias("v")).agg(F.min("c").alias("c"))
        step = lab.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        up = lab.select(F.col("v").alias("comp"), F.col("comp").alias("up"))
        new = materialise(
            step.join(up, "comp", "left").select("v", "old", F.least(F.col("comp"), F.coalesce("up", "comp")).alias("comp")),
            "labels",
        )
        changed = new.where("old <> comp").limit(1).count()
        drop(lab)
        lab = new.select("v", "comp")
        lab.loomgraph_path = new.loomgraph_path
        if not changed:
            drop(both)
            return lab


def split_by_filter(df: DataFrame, ids: DataFrame, key: str, inside: bool) -> DataFrame:
    """Rows of ``df`` that the id filter of ``ids`` (a column named as ``key``) lets pass, or surely not in ``ids``.

    A row travels as one struct, so no column can clash with ours.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    bits = df.sparkSession.sparkContext.broadcast(id_filter(ids, key))
    n = len(bits.value) * 8

    def run(batches):
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            hit = (bits.value[h >> 3] >> (h & 7)) & 1 == 1
            yield b.filter(pa.array(hit if inside else ~hit)).select([0])

    d = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.pmod(F.coalesce(F.xxhash64(F.col(f"`{key}`")), F.lit(0)), F.lit(n)).alias("h"))
    return d.mapInArrow(run, StructType([StructField("r", df.schema, False)])).select("r.*")


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``; most others never reach the join's shuffle."""
    return split_by_filter(df, ids, key, True).join(ids.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; only rows that may be in it are shuffled."""
    maybe = split_by_filter(df, ids, key, True).join(ids.select(key).distinct(), key, "left_anti").select(*df.columns)
    return split_by_filter(df, ids, key, False).union(maybe)


def handle(key: str, text: str):
    """A row's handle: equal for repeated rows only, and the same in every scan of the table."""
    name = F.to_json(F.struct(F.col(key).alias("i")))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def scan(docs: DataFrame, handles: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over the Arrow batches of the rows of ``docs`` whose handle h the id filter of ``handles`` lets pass."""
    import pyarrow as pa

    bits = docs.sparkSession.sparkContext.broadcast(id_filter(handles, "h"))

    def run(batches):
        def wanted():
            for b in batches:
                at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                b = b.filter(pa.array((bits.value[at >> 3] >> (at & 7)) & 1 == 1))
                if b.num_rows:
                    yield b.select(list(range(b.num_columns - 1)))

        yield from function(wanted())

    return docs.select("*", F.pmod(F.xxhash64("h"), F.lit(len(bits.value) * 8))).mapInArrow(run, schema)
