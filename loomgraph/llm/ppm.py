"""Scores of texts: a word unigram base and prediction by partial matching over bytes.

The byte model is a context trie of order 3 counted over all training texts, with escape method C
and symbol exclusion: from a context, a symbol seen there costs count / (total + distinct); else the
escape distinct / (total + distinct) is paid and the next shorter context is used without the
symbols already excluded. Below order 0 the unseen bytes share what is left.

Scale: texts are dealt into blocks of bounded size by a hash. Each block sends its distinct words and
4-grams, with their training counts, to hash buckets (one packed row per block and bucket); a bucket
adds up the counts of all blocks and answers each block with values in the order it asked in. So
neither vocabulary nor trie is broadcast or gathered in one task; only counts of contexts of at most
two bytes (2^24 at most, whatever the input) are broadcast.

Defined cases: null text counts as empty, which is the end token alone; repeated rows each get their
row; with no training text every count is 0; an empty table gives an empty result; extra columns are
ignored. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod, materialise, table

BLOCK_CHARS = 12_000_000
SLICE_BYTES = 3_000_000
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never uses: before a text and after it
END_WORD = b" "  # no word has a space


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and the end token."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END_WORD)
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-grams (three bytes of context, one symbol) of texts, and the number of each text's."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    x = np.frombuffer(b"".join(b"\xfe\xfe\xfe" + r + b"\xff" for r in raw), np.uint8).astype(np.uint32)
    code = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:] if len(x) > 3 else np.zeros(0, np.uint32)
    return code[(code & 0xFF) != PAD], np.array([len(r) + 1 for r in raw], np.int64)


def sliced(texts: list, size: int = SLICE_BYTES):
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t or "") > size:
            yield lo, i
            lo, n = i, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(counts[order], at)


def block_words(texts: list, buckets: int) -> list[list[bytes]]:
    """The distinct words of a block by bucket, in order: what it asks for."""
    seen: set[bytes] = set()
    for t in texts:
        seen.update(words(t))
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for w in seen:
        out[crc(w) % buckets].append(w)
    for ws in out:
        ws.sort()
    return out


def gram_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """By context, so that a bucket holds all symbols of a context."""
    return ((((codes >> np.uint32(8)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(to: np.ndarray):
    """(bucket, positions in order) of the buckets in use; one sort, however many buckets there are."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cuts) if len(to) else ():
        yield int(to[at[0]]), at


def block_grams(texts: list) -> np.ndarray:
    parts = [np.unique(grams(texts[lo:hi])[0]) for lo, hi in sliced(texts)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


ASK = "kind string, bucket int, block int, keys binary, counts binary, low int, n bigint"


def asking(buckets: int):
    def run(tab):
        block = tab.column("block")[0].as_py()
        texts, train = tab.column("text").to_pylist(), tab.column("train").to_pylist()
        learn = [t for t, ok in zip(texts, train) if ok]
        rows: list[tuple] = []
        have: dict[bytes, int] = {}
        for t in learn:
            for w in words(t):
                have[w] = have.get(w, 0) + 1
        for k, ws in enumerate(block_words(texts, buckets)):
            if ws:
                rows.append(("w", k, block, b"\n".join(ws), np.array([have.get(w, 0) for w in ws], np.int64).tobytes(), None, None))
        parts = [np.unique(grams(learn[lo:hi])[0], return_counts=True) for lo, hi in sliced(learn)]
        keys, counts = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        asked = block_grams(texts)
        n = np.zeros(len(asked), np.int64)
        n[np.searchsorted(asked, keys)] = counts
        for k, at in by_bucket(gram_bucket(asked, buckets)):
            rows.append(("g", k, block, asked[at].tobytes(), n[at].tobytes(), None, None))
        low, m = add_up(keys & np.uint32(0xFFFFFF), counts)
        rows += [("t", None, block, None, None, int(a), int(b)) for a, b in zip(low, m)]
        cols = list(zip(*rows)) if rows else [[]] * 7
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["kind", "bucket", "block", "keys", "counts", "low", "n"])

    return run


class Low:
    """Counts of contexts of two bytes and fewer, with totals, distinct symbols and exclusions."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.c = [None, None, None]
        self.c[2] = add_up(codes.astype(np.uint32), counts)
        self.c[1] = add_up(self.c[2][0] & np.uint32(0xFFFF), self.c[2][1])
        self.c[0] = add_up(self.c[1][0] & np.uint32(0xFF), self.c[1][1])
        self.ctx = []
        for order in (0, 1, 2):
            k, n = self.c[order]
            ctx = k >> np.uint32(8)
            lower = self.count(order - 1, k & np.uint32((1 << 8 * order) - 1)) if order else np.zeros(len(k), np.int64)
            key, total = add_up(ctx, n)
            self.ctx.append((key, total, add_up(ctx, np.ones(len(k), np.int64))[1], add_up(ctx, lower)[1]))

    @staticmethod
    def _at(keys: np.ndarray, ask: np.ndarray, values) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(ask), np.int64) for _ in values]
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        hit = keys[at] == ask
        return [np.where(hit, v[at], 0) for v in values]

    def count(self, order: int, codes: np.ndarray) -> np.ndarray:
        return self._at(self.c[order][0], codes, self.c[order][1:])[0]

    def context(self, order: int, ctx: np.ndarray) -> list[np.ndarray]:
        return self._at(self.ctx[order][0], ctx, self.ctx[order][1:])

    def rest(self, codes: np.ndarray, lost_n: np.ndarray, lost_q: np.ndarray) -> np.ndarray:
        """log10 probability of 3-byte codes from order 2 down, where symbols with lost_n counts and lost_q kinds are excluded at first."""
        out = np.zeros(len(codes))
        open_ = np.ones(len(codes), bool)
        for order in (2, 1, 0):
            code = codes & np.uint32((1 << 8 * (order + 1)) - 1)
            n = self.count(order, code)
            total, kinds, lower = self.context(order, code >> np.uint32(8))
            known = total > 0
            t, q = total - lost_n, kinds - lost_q
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = open_ & (n > 0)
                out[hit] += np.log10(n[hit] / (t[hit] + q[hit]))
                miss = open_ & ~hit & known & (t + q > 0)
                out[miss] += np.log10(q[miss] / (t[miss] + q[miss]))
            open_ &= ~hit
            lost_n, lost_q = np.where(known, lower, lost_n * 0), np.where(known, kinds, 0)
        left = 256 - (len(self.c[0][0]))
        out[open_] -= math.log10(max(left, 1))
        return out


def answering(low_shared):
    """A bucket's answers: training counts of words; log10 probabilities of 4-grams."""

    def run(key, tab):
        kind = key[0].as_py()
        blocks, keys, counts = (tab.column(c).to_pylist() for c in ("block", "keys", "counts"))
        bucket = tab.column("bucket")[0].as_py()
        rows = []
        if kind == "w":
            asked = [k.split(b"\n") for k in keys]
            total: dict[bytes, int] = {}
            for ws, c in zip(asked, counts):
                for w, n in zip(ws, np.frombuffer(c, np.int64).tolist()):
                    total[w] = total.get(w, 0) + n
            for i, (b, ws) in enumerate(zip(blocks, asked)):
                seen = (sum(total.values()), sum(1 for n in total.values() if n)) if i == 0 else (0, 0)
                rows.append((kind, b, bucket, np.array([total[w] for w in ws], np.int64).tobytes(), *seen))
        else:
            low = low_shared.value
            asked = [np.frombuffer(k, np.uint32) for k in keys]
            codes, n = add_up(np.concatenate(asked), np.concatenate([np.frombuffer(c, np.int64) for c in counts]))
            ctx = codes >> np.uint32(8)
            short = codes & np.uint32(0xFFFFFF)
            seen = n > 0
            at = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            size = np.diff(np.append(at, len(ctx)))
            total, kinds, lower = (np.repeat(np.add.reduceat(v, at), size) for v in (n, seen.astype(np.int64), np.where(seen, low.count(2, short), 0)))
            with np.errstate(divide="ignore", invalid="ignore"):
                first = np.log10(np.where(seen, n, kinds) / (total + kinds))
            score = np.where(total > 0, first, 0.0)
            miss = ~seen
            score[miss] += low.rest(short[miss], lower[miss], kinds[miss])
            for b, a in zip(blocks, asked):
                rows.append((kind, b, bucket, score[np.searchsorted(codes, a)].astype(np.float32).tobytes(), 0, 0))
        kinds_ = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_)], names=["kind", "block", "bucket", "values", "n", "v"])

    return run


class Lookup:
    """Positions of codes in an ordered key array by one multiplicative hash; clashes by binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint32(32 - max(8, min(22, int(len(keys) * 4).bit_length())))
        self.slot = np.zeros(1 << (32 - int(self.shift)), np.int32)
        self.slot[self._hash(keys)] = np.arange(len(keys), dtype=np.int32)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435769)) >> self.shift

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(codes)]
        wrong = np.flatnonzero(self.keys[at] != codes)
        at[wrong] = np.searchsorted(self.keys, codes[wrong])
        return at


def scoring(buckets: int, n_all: int, v_all: int):
    def run(docs, got):
        ids = docs.column("id").combine_chunks() if docs.num_rows else pa.array([], docs.schema.field("id").type)
        texts = docs.column("text").to_pylist()
        n_tokens, n_known, base, score = [], [], [], []
        if texts:
            answer = {(k, b): v for k, b, v in zip(*(got.column(c).to_pylist() for c in ("kind", "bucket", "values")))}
            index: dict[bytes, int] = {}
            counts = []
            for k, ws in enumerate(block_words(texts, buckets)):
                for w in ws:
                    index[w] = len(index)
                if ws:
                    counts.append(np.frombuffer(answer["w", k], np.int64))
            c = np.concatenate(counts)
            log, known = np.log10(c + 0.5), c > 0
            asked = block_grams(texts)
            prob = np.zeros(len(asked), np.float64)
            for k, at in by_bucket(gram_bucket(asked, buckets)):
                prob[at] = np.frombuffer(answer["g", k], np.float32)
            find = Lookup(asked)
            unit = math.log10(n_all + 0.5 * (v_all + 1))
            for lo, hi in sliced(texts):
                codes, size = grams(texts[lo:hi])
                score += np.add.reduceat(prob[find(codes)], np.cumsum(size) - size).tolist()
                for t in texts[lo:hi]:
                    ws = words(t)
                    at = np.fromiter(map(index.__getitem__, ws), np.int32, len(ws))
                    n_tokens.append(len(ws))
                    n_known.append(int(known[at].sum()))
                    base.append(float(log[at].sum()) - len(ws) * unit)
        cols = [ids, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(cols, names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(df: DataFrame, key: str, text: str, train) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; ``train`` is a Column: rows to learn from."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chars = d.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    buckets = 2 * blocks
    d = d.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    asked = materialise(d.select("block", "text", "train").groupBy("block").applyInArrow(asking(buckets), ASK), "asked")
    low_rows = asked.where("kind = 't'").groupBy("low").agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast(Low(low_rows.column("low").to_numpy().astype(np.uint32), low_rows.column("n").to_numpy()))
    answers = materialise(
        asked.where("kind <> 't'").select("kind", "bucket", "block", "keys", "counts").groupBy("kind", "bucket").applyInArrow(answering(low), "kind string, block int, bucket int, values binary, n bigint, v bigint"),
        "answers",
    )
    n_all, v_all = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    out = (
        d.select("block", "id", "text")
        .groupBy("block")
        .cogroup(answers.select("block", "kind", "bucket", "values").groupBy("block"))
        .applyInArrow(scoring(buckets, n_all, v_all), f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return out.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op10_ppm(spark, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 5)
    out = score(table(spark, sf_dir, "documents"), "doc_id", "text", fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
