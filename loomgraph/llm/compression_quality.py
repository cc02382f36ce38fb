"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is compressed once with each dictionary; (bad size - good size) / (bytes + 30) is mapped to a
probability by a logistic curve fitted on training rows that the dictionaries have not seen.

Bounds: at most ``SAMPLE`` labelled rows a class are fitted, those with the smallest hashed id (a
random sample that does not depend on partitions). Everything else covers all rows.

Defined cases: null text counts as empty and gets the score of an empty text; rows without a label
or a document are not learned from; without both classes the score is the share of label 1 (0.5
where there is no label); repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod, table

SAMPLE = 1500
#: Longer texts are scored but not fitted, so that what the driver holds is bounded in bytes, too.
LONGEST = 20_000
DICT_BYTES = 112_640
CHUNK = 400
LEVEL = 3
#: The last part of each class's sample calibrates.
CALIBRATE = 0.2


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their raw content."""
    parts = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstd.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


class Model:
    def __init__(self, good: bytes, bad: bytes, a: float, b: float, prior: float):
        self.good, self.bad, self.a, self.b, self.prior = good, bad, a, b, prior
        self.made = None

    def difference(self, raw: bytes) -> float:
        if self.made is None:
            self.made = []
            for d in (self.good, self.bad):
                dic = zstd.ZstdCompressionDict(d)
                dic.precompute_compress(level=LEVEL)
                self.made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=dic, write_content_size=False))
        good, bad = self.made
        return (len(bad.compress(raw)) - len(good.compress(raw))) / (len(raw) + 30)

    def score(self, raw: bytes) -> float:
        if not self.good:
            return self.prior
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.a * self.difference(raw) + self.b))))

    def __getstate__(self):
        return {**self.__dict__, "made": None}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge on the scaled slope."""
    s = x.std() or 1.0
    z = np.stack([x / s, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-6])
        w = w - np.linalg.solve(h, z.T @ (p - y) + np.array([1e-2, 0]) * w)
    return float(w[0] / s), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of at most ``SAMPLE`` rows a class of ``labels`` (key, label 0/1) with their texts."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null").groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n = counts.get(1, 0), sum(counts.values())
    prior = n1 / n if n else 0.5
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(SAMPLE) for y in (0, 1)]
    chosen = picked[0].union(picked[1])
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") <= LONGEST).join(F.broadcast(chosen), "k").dropDuplicates(["k", "t"]).collect()
    seen: dict = {}
    for r in rows:
        seen[(r["k"], r["t"])] = r["y"]
    order = sorted(seen, key=lambda kt: (hash_of(kt[0]), kt[1]))
    by = {y: [kt[1].encode() for kt in order if seen[kt] == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 5:
        return Model(b"", b"", 0.0, 0.0, prior)
    cut = {y: max(1, int(len(by[y]) * (1 - CALIBRATE))) for y in (0, 1)}
    m = Model(_dictionary(by[1][: cut[1]]), _dictionary(by[0][: cut[0]]), 1.0, 0.0, prior)
    held = [(t, y) for y in (0, 1) for t in by[y][cut[y] :]]
    x = np.array([m.difference(t) for t, _ in held])
    y = np.array([y for _, y in held], float)
    m.a, m.b = _logistic(x, y)
    # The sample is balanced by class, the corpus is not.
    share = y.mean()
    if 0 < prior < 1 and 0 < share < 1:
        m.b += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return m


def hash_of(key) -> int:
    import zlib

    return zlib.crc32(str(key).encode())


def score(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, score) of every row."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = [m.score((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["k", "score"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def op6_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_mod("doc_id", 5)
    model = fit(docs, labels.where(fold != 0))
    out = score(docs, model, "doc_id", "text")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
