"""File events: debouncing, write completion, batches, snapshots, and their streaming forms.

Events: key (a path), ts, size. The batch forms are exact; the streaming debouncer keeps one
timestamp a key and gives the same rows where events arrive in order.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def micros(ts: str = "ts"):
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def _accepted(limit: int):
    """Arrow batches (key, burst, t, seq) in order to the accepted (key, seq); only the last accepted time is held."""

    def run(batches):
        group, last = None, 0
        for b in batches:
            key, burst, t = (b.column(i).to_pylist() for i in range(3))
            ok = []
            for k in zip(key, burst, t):
                take = k[:2] != group or k[2] - last >= limit
                if take:
                    group, last = k[:2], k[2]
                ok.append(take)
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 3])

    return run


def debounce(events: DataFrame, seconds: float, key: str = "key", seq: str = "event_id") -> DataFrame:
    """Events accepted when at least ``seconds`` have passed since the last accepted one of the key.

    The decision of one event depends on the last accepted one, so events are folded in time order as they
    stream by. A gap of that length alone decides that the next event is accepted, so a key is cut there
    and its bursts go to different tasks; nothing of a burst is gathered.
    """
    limit = int(seconds * 1e6)
    w = Window.partitionBy(key).orderBy("t", seq)
    d = events.withColumn("t", micros()).withColumn("burst", F.sum(F.when(F.col("t") - F.lag("t").over(w) < limit, 0).otherwise(1)).over(w))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.select(key, "burst", "t", seq).repartition(n, key, "burst").sortWithinPartitions(key, "burst", "t", seq)
    kind = lambda c: events.schema[c].dataType.simpleString()
    return d.mapInArrow(_accepted(limit), f"`{key}` {kind(key)}, `{seq}` {kind(seq)}")


def write_complete(events: DataFrame, key: str = "key", seq: str = "event_id") -> DataFrame:
    """Events whose size equals the size before: the write has ended."""
    w = Window.partitionBy(key).orderBy("ts", seq)
    return events.withColumn("_was", F.lag("size").over(w)).where("size = _was").drop("_was")


def batches(events: DataFrame, idle: str, most: int, key: str = "key", seq: str = "event_id") -> DataFrame:
    """(key, session, batch, n): flushed after ``most`` events or when idle that long."""
    gap = F.expr(f"ts - lag(ts) over (partition by {key} order by ts, {seq}) > interval {idle}")
    w = Window.partitionBy(key).orderBy("ts", seq)
    s = events.withColumn("_new", F.when(gap, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    n = s.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key, "session").orderBy("ts", seq)) - 1) / most))
    return n.groupBy(key, "session", "batch").agg(F.count("*").alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): created, modified, deleted or none, by sha256 of the content."""
    h = lambda d, n: d.select(key, F.sha2(F.col(content).cast("binary"), 256).alias(n))
    j = h(old, "a").join(h(new, "b"), key, "full")
    return j.select(key, F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified").otherwise("none").alias("change"))


def sync_report(diff: DataFrame) -> DataFrame:
    action = F.when(F.col("change").isin("created", "modified"), "processed").when(F.col("change") == "deleted", "deleted").otherwise("skipped")
    return diff.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def forget(state: DataFrame, directory: str, path: str = "path") -> DataFrame:
    """State without the files directly in the directory."""
    return state.where(F.regexp_replace(path, "/[^/]*$", "") != directory)


def progress(done: DataFrame, total: int) -> DataFrame:
    """(done, failed, rate, percent, eta_seconds) of timed results (ok, seconds)."""
    a = done.agg(F.count("*").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.sum("seconds").alias("s"))
    rate = F.col("done") / F.col("s")
    return a.select("done", "failed", F.round(rate, 6).alias("rate"), F.round(100 * F.col("done") / total, 3).alias("percent"), F.round((total - F.col("done")) / rate, 3).alias("eta_seconds"))


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 3) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_debounce(events: DataFrame, seconds: float, key: str = "key", seq: str = "event_id") -> DataFrame:
    """The debouncer over a stream: one state row a key; a watermark of 10 s bounds lateness."""
    limit = int(seconds * 1e6)

    def run(k, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        # A key's rows of a trigger come in several frames, in no order.
        for t, i in sorted(x for pdf in frames for x in zip(pdf["t"], pdf[seq])):
            if last is None or t - last >= limit:
                last = t
                out.append((k[0], i))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "event_id"])

    d = events.withColumn("t", micros()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 seconds").select(F.col(key).cast("string").alias("key"), F.col(seq).alias(seq), "t")
    return d.groupBy("key").applyInPandasWithState(run, "key string, event_id bigint", "last bigint", "append", "NoTimeout")


def upsert_batch(target: str, key: str):
    """A foreachBatch function: rows of a batch replace the rows of their documents in the Parquet table ``target``.

    The new table is written beside the old one under the batch's number and takes effect by a
    pointer file's rename, so a failed batch is repeated without harm.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, target)
        new = batch if old is None else batch.unionByName(old.join(batch.select(key).distinct(), key, "left_anti"))
        new.write.mode("overwrite").parquet(f"{target}/v{number}")
        _point(spark, target, f"v{number}")
        fs, p, jvm = _fs(spark, f"{target}/v{number - 2}")
        if number > 1 and fs.exists(p):  # the version before stays for those who still read it
            fs.delete(p, True)

    return run


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _point(spark: SparkSession, target: str, version: str) -> None:
    fs, p, jvm = _fs(spark, f"{target}/CURRENT.tmp")
    out = fs.create(p, True)
    out.writeBytes(version)
    out.close()
    to = jvm.org.apache.hadoop.fs.Path(f"{target}/CURRENT")
    # One step: a reader finds the old pointer or the new one, never none.
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(p, to, how)


def current(spark: SparkSession, target: str) -> DataFrame | None:
    fs, p, _ = _fs(spark, f"{target}/CURRENT")
    if not fs.exists(p):
        return None
    version = spark.read.text(f"{target}/CURRENT").first()[0]
    return spark.read.parquet(f"{target}/{version}")
