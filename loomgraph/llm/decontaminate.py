"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact check.

An item of n words is indexed by the 64-bit SimHashes of windows whose size is the largest of a
geometric ladder that leaves room for the stride; documents are fingerprinted in windows of every
size in use, from running sums of word bits. Fingerprints within ``RADIUS`` agree up to
RADIUS // 4 bits in one of four 16-bit blocks, so tables of the blocks' neighbours find all of them.
Each hit is verified by the weighted Jaccard similarity of its five-word shingles with the item's: a
shingle of the item weighs the more the fewer items of the whole benchmark hold it, any other one as
much as a shingle that a single item holds.

Items are handled in blocks of ``ITEM_BLOCK``, so what is broadcast is bounded whatever the benchmark;
weights are the same whatever the blocks, and so are the results.

Defined cases: null or empty texts and items match nothing; an item of fewer than five words is one
shingle; repeated rows each get their rows, repeated items count once in the weights; of equal matches
of an item in a text the first is named; empty tables give empty results; extra columns are ignored.
Whole texts are searched, in slices of whole texts that bound the memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise, table
from loomgraph.llm.ngram_join import CACHE_WORDS, _Hashes, _mix, words

RADIUS = 7
STRIDE = 4
SHINGLE = 5
THRESHOLD = 0.8
LADDER = 1.5
SMALLEST = 8
ITEM_BLOCK = 20_000
SLICE_WORDS = 60_000
_POP = np.array([bin(i).count("1") for i in range(65536)], np.uint8)


def window_size(n: int) -> int:
    """Window for an item of n words: a rung of the ladder that leaves STRIDE starts inside the item."""
    if n < SMALLEST + STRIDE - 1:
        return max(1, n - STRIDE + 1)
    w = SMALLEST
    while (up := int(w * LADDER)) <= n - STRIDE + 1:
        w = up
    return w


def lane(w: int):
    """Type of a bit's counter: wide enough for a window of w words."""
    return np.uint8 if w < 1 << 8 else np.uint16 if w < 1 << 16 else np.uint32


def running_bits(h: np.ndarray, kind) -> np.ndarray:
    """Sums of the 64 bits of word hashes before each position, several counters to a 64-bit number; carries between counters cancel in differences."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(kind, copy=False).view(np.uint64)
    s = np.zeros((len(h) + 1, bits.shape[1]), np.uint64)
    np.cumsum(bits, axis=0, out=s[1:])
    return s


def simhash(s: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    return _majority(s[starts + w] - s[starts], w)


def _majority(c: np.ndarray, w: int) -> np.ndarray:
    return np.packbits(c.view(lane(w)) > w // 2, axis=1).view(np.uint64).ravel()


def simhash_every(s: np.ndarray, w: int, stride: int) -> np.ndarray:
    """``simhash`` at every ``stride``-th start, from slices."""
    return _majority(s[w::stride] - s[: len(s) - w : stride], w)


def hash_words(ws: list[bytes], cache: dict) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray) -> np.ndarray:
    k = min(SHINGLE, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


class Index:
    """Multi-index Hamming tables of one block of items."""

    def __init__(self, items: list[tuple], n_items: int, often: dict[int, int]):
        """``items`` are (id, text) of the block; ``often`` has the items of each shingle that several of the ``n_items`` hold."""
        cache = _Hashes()
        self.ids, self.sizes, self.sets, by = [], [], [], {}
        for item, text in items:
            h = hash_words(words(text), cache)
            if not len(h):
                continue
            w, j = window_size(len(h)), len(self.ids)
            self.ids.append(item)
            self.sizes.append(len(h))
            self.sets.append(shingles(h))
            # Consecutive starts at both ends: whatever the stride's phase, one of each lot is met.
            last = len(h) - w
            starts = sorted({*range(min(STRIDE, last + 1)), *range(max(0, last - STRIDE + 1), last + 1)})
            fp = simhash(running_bits(h, lane(w)), np.array(starts), w)
            by.setdefault(w, []).extend((int(f), j, o) for f, o in zip(fp, starts))
        self.rare = 1 + math.log(max(n_items, 1))
        self.weight = [np.array([self.rare - math.log(often.get(x, 1)) for x in s.tolist()]) for s in self.sets]
        self.mass = [float(w.sum()) for w in self.weight]
        self.tables = {w: self._tables(fps) for w, fps in by.items()}
        self.stride = {w: min([STRIDE, *[self.sizes[j] - w + 1 for _, j, _ in fps]]) for w, fps in by.items()}

    def similarity(self, j: int, got: np.ndarray) -> float:
        """Weighted Jaccard similarity of a set of shingles with item j's."""
        if not len(got):
            return 0.0
        hit = got[np.minimum(np.searchsorted(got, self.sets[j]), len(got) - 1)] == self.sets[j]
        return float(self.weight[j][hit].sum()) / (self.mass[j] + self.rare * (len(got) - int(hit.sum())))

    @staticmethod
    def _tables(fps: list[tuple]):
        f = np.array([x[0] for x in fps], np.uint64)
        item, offset = np.array([x[1] for x in fps]), np.array([x[2] for x in fps])
        flips = [0] + [1 << i for i in range(16)] if RADIUS // 4 else [0]
        blocks = []
        for b in range(4):
            part = ((f >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            key = np.concatenate([part ^ x for x in flips])
            who = np.tile(np.arange(len(f)), len(flips))
            order = np.argsort(key, kind="stable")
            blocks.append((np.searchsorted(key[order], np.arange(65537)), who[order]))
        return f, item, offset, blocks

    def near(self, w: int, fp: np.ndarray):
        """(position in fp, item, offset of the window in the item, distance) of all pairs within RADIUS."""
        f, item, offset, blocks = self.tables[w]
        at_all, who_all = [], []
        for b, (first, who) in enumerate(blocks):
            key = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = first[key + 1] - first[key]
            at = np.flatnonzero(n)
            n = n[at]
            if not len(at):
                continue
            begin = np.repeat(first[key[at]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            cand = who[begin + np.arange(n.sum())]
            at = np.repeat(at, n)
            x = fp[at] ^ f[cand]
            d = _POP[x & np.uint64(0xFFFF)] + _POP[(x >> np.uint64(16)) & np.uint64(0xFFFF)] + _POP[(x >> np.uint64(32)) & np.uint64(0xFFFF)] + _POP[x >> np.uint64(48)]
            ok = d <= RADIUS
            at_all.append(at[ok])
            who_all.append(cand[ok])
        if not at_all:
            z = np.zeros(0, np.int64)
            return z, z, z
        pair = np.unique(np.concatenate(at_all) * len(f) + np.concatenate(who_all))
        at, who = pair // len(f), pair % len(f)
        return at, item[who], offset[who]

    def search(self, hashes: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the best match of each item in each text."""
        size = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes) if len(hashes) else np.zeros(0, np.uint64)
        end = np.cumsum(size)
        if not len(flat):
            return []
        sums = {kind: running_bits(flat, kind) for kind in {lane(w) for w in self.tables}}
        text_of = np.repeat(np.arange(len(size)), size)
        best: dict[tuple[int, int], tuple] = {}
        tried = set()
        for w in self.tables:
            starts = np.arange(0, len(flat) - w + 1, self.stride[w])
            if not len(starts):
                continue
            inside = np.flatnonzero(starts + w <= end[text_of[starts]])
            at, item, offset = self.near(w, simhash_every(sums[lane(w)], w, self.stride[w])[inside])
            starts = starts[inside]
            for t, j, o in zip(starts[at].tolist(), item.tolist(), offset.tolist()):
                k = int(text_of[t])
                lo0, hi0 = int(end[k] - size[k]), int(end[k])
                lo, hi = max(lo0, t - o), min(hi0, t - o + self.sizes[j])
                if (j, lo, hi) in tried:
                    continue
                tried.add((j, lo, hi))
                got = shingles(flat[lo:hi])
                sim = self.similarity(j, got)
                if sim >= THRESHOLD - 1e-12 and sim > best.get((k, j), (0, 0, -1.0))[2]:
                    best[k, j] = (lo - lo0, hi - lo, sim)
        return [(k, j, *v) for (k, j), v in best.items()]


def _slices(texts: list):
    lo, n = 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > SLICE_WORDS:
            yield lo, i
            lo, n = i, 0
        n += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _item_shingles(batches):
    for b in batches:
        cache = _Hashes()
        sets = [shingles(hash_words(words(t), cache)) for t in b.column(1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["i", "s"])


def item_blocks(bench: DataFrame, item: str, text: str):
    """Indexes of the benchmark's items, one block of about ITEM_BLOCK at a time."""
    b = bench.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = b.select("i").distinct().count()
    n = max(1, math.ceil(b.count() / ITEM_BLOCK))
    held = b.mapInArrow(_item_shingles, f"i {b.schema['i'].dataType.simpleString()}, s bigint").distinct()
    often = materialise(held.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "often")
    for k in range(n):
        mine = F.pmod(F.xxhash64("i"), F.lit(n)) == k
        rows = b.where(mine).collect()
        # At most as many as the block's items have shingles.
        df = often.join(held.where(mine).select("s").distinct(), "s", "left_semi").toArrow()
        known = dict(zip(df.column("s").to_numpy().view(np.uint64).tolist(), df.column("n").to_pylist()))
        yield Index([(r["i"], r["t"]) for r in rows], total, known)


def find(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start_word, n_words, similarity) of the best match of each item in each row."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), bench.schema[item].dataType
    d = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    out = None
    for index in item_blocks(bench, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index, cache = shared.value, _Hashes()
            for b in batches:
                hashes = [None] * b.num_rows
                texts = b.column(1).to_pylist()
                for i, t in enumerate(texts):
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    hashes[i] = hash_words(words(t), cache)
                rows = [(lo + k, *r) for lo, hi in _slices(hashes) for k, *r in index.search(hashes[lo:hi])]
                at, it, start, n, sim = zip(*rows) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([index.ids[j] for j in it]).cast(item_type), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(sim, pa.float64())],
                    names=["k", "item_id", "start_word", "n_words", "similarity"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        item_type = to_arrow_type(item_kind)
        part = d.mapInArrow(run, f"k {kind}, item_id {item_kind.simpleString()}, start_word bigint, n_words bigint, similarity double")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("k", key)


def clean(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found; rows stay in their tasks, each as one struct, so that no column clashes with ours."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("t"))
    for index in item_blocks(bench, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index, cache = shared.value, _Hashes()
            for b in batches:
                hashes = []
                for t in b.column(1).to_pylist():
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    hashes.append(hash_words(words(t), cache))
                hit = np.zeros(b.num_rows, bool)
                for lo, hi in _slices(hashes):
                    for k, *_ in index.search(hashes[lo:hi]):
                        hit[lo + k] = True
                yield b.filter(pa.array(~hit))

        d = d.mapInArrow(run, d.schema)
    return d.select("row.*")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text")
