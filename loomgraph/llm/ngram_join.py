"""Jaccard self-join of texts on word shingles by token-combination prefixes, and its components.

A token is a shingle's 64-bit hash; a vertex is a distinct token set. The global order puts tokens
that are frequent in some task's rows last and follows the hash within both classes. Two sets of
Jaccard at least t share a token of their prefixes of n - ceil(t n) + 1 tokens, whatever the order.

* Rare prefix tokens (held by at most ``RARE`` sets) are indexed singly. Their rows carry the set's size and
  a parity signature, so that holders of a token that no other holder can be similar to go at once.
* Sets with a frequent prefix token, and a pair that shares only such tokens consists of two of them,
  are indexed by token combinations: the hash line is cut into cells, more than two similar sets can
  differ in tokens, and a combination is all tokens of one cell. Each differing token spoils one cell
  at most, so similar sets agree in one of the first cells: the prefix is extended until it has one
  cell of several tokens more than tokens can differ. The few cells of small sets are combined with
  those of a second and third deal.
* A key's holders are compared with one lead first (the holder with most shared keys for its size);
  once components are known, only holders of different components are still compared.

Candidates whose parity signatures differ in more bits than similar sets can differ in tokens go,
which is exact; the others are verified on whole sets, made again from the texts.

Defined cases: null text counts as empty; a text without words has no shingle, its own id as its
component and no link; equal sets are one vertex (so ties and repeated rows need no comparison) and
repeated rows each get their row; an id with several texts joins their components; a null id gets a
row and is the component of last resort; texts of any length are compared whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import components, drop, handle, materialise, release, scan, split_by_filter, table

RARE = 128
CACHE_WORDS = 150_000
#: Bits of a set's parity signature, in WIDE columns of 64; sets of more tokens have a second, wider one.
BITS = 512
WIDE = BITS // 64
MARKS = [f"m{i}" for i in range(WIDE)]
#: Tokens held by so many texts of one task are put last in the global order, at most ORDERED of them.
#: The order decides which keys are made, never which pairs are found.
LOCAL = 4
ORDERED = 1 << 18
#: Bits of the signature of a prefix token's row, the least that tell unrelated sets apart; larger sets have none.
SHORT = (128, 256, 512)
#: Parts of all tokens whose prefix rows are exchanged one after the other: disk holds one part's at a time, each part reads the texts again.
PARTS = 2
#: Rows of prefix tokens that are compared at a time.
NEAR_ROWS = 1 << 15
#: Holders of a key are compared across components in blocks of about so many.
BLOCK = 256
#: A key of more holders is hot: a pair is made at one of its hot keys only.
HOT = 64
OUT_ROWS = 1 << 16
#: Pairs of texts in one Arrow batch.
PAIR_ROWS = 200
#: Pairs up to which the handles of their texts are broadcast.
FEW = 100_000


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words: a polynomial of the words' hashes, mixed once."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = h[:n].copy()
    for i in range(1, k):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[i : n + i]
    return _mix(s + np.uint64(k))


def shingle_set(ws: list[bytes], k: int, cache: dict) -> np.ndarray:
    """Ordered distinct hashes of the k-word shingles; fewer words are one shingle together."""
    n = len(ws)
    if not n:
        return np.zeros(0, np.uint64)
    s = shingle_hashes(np.fromiter(map(cache.__getitem__, ws), np.uint64, n), min(n, k))
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def parity_bits(s: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each the parity of the tokens dealt to it: two sets differ in at least as many tokens as their bits do."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bits(s: np.ndarray) -> np.ndarray | None:
    """The signature of a set of more than ``BITS`` tokens in as many bits, to the next power of two; halves fold into half the bits."""
    if len(s) <= BITS:
        return None
    m = 1 << (len(s) - 1).bit_length()
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_apart(m: int, num: int, den: int) -> int:
    """Tokens that a set of m and a similar one of at most m can differ in."""
    return 2 * m * (den - num) // (den + num)


def ladder(apart: int) -> int:
    """Cells of the whole line for sets that differ in so many tokens: 2, 3, 4, 6, 8, 11, 16, ..."""
    g, i = 1, 0
    while g <= apart:
        i += 1
        g = int(2 ** (i / 2) + 0.5)
    return g


@lru_cache(maxsize=100_000)
def grids(n: int, num: int, den: int) -> tuple[tuple[int, int], ...]:
    """(cells of the whole line, tokens that may differ) under which a set of n is indexed: one for every size of a larger similar set.

    Sets of n and m >= n meet in the cells for ``most_apart(m)``. Empty: only equal sets are similar.
    """
    low, high = most_apart(n, num, den), most_apart(den * n // num, num, den)
    return tuple(sorted({ladder(d): d for d in range(max(low, 1), high + 1)}.items()))


def deals(s: np.ndarray, g: int, use: int) -> np.ndarray:
    """Keys of the first ``use`` of g cells, each with each of another two deals (g = 2) or one: for the few cells of small sets."""
    key = np.full(1, g, np.uint64)
    for level in range(3 if g < 3 else 2):
        line = _mix(s ^ np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))
        order = np.argsort(line)
        at = ((line[order] >> np.uint64(32)) * np.uint64(g) >> np.uint64(32)).astype(np.int64)
        run = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(_mix(line[order]), out=run[1:])
        cut = np.searchsorted(at, np.arange(use + 1))
        part = (run[cut[1:]] - run[cut[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(use).astype(np.uint64)
        key = _mix(key[:, None] * np.uint64(0x9E3779B97F4A7C15) + part[None, :]).ravel()
    return key


def cells(s: np.ndarray, g: int, apart: int, strong: int) -> np.ndarray:
    """Keys of the first cells of g, up to ``apart`` + 1 that hold at least ``strong`` tokens: one at least agrees with a similar set's.

    Cells of fewer tokens are passed over, which extends the prefix; where too few are strong, all cells are keys.
    """
    cut = np.searchsorted(s >> np.uint64(32), (np.arange(g + 1).astype(np.uint64) * np.uint64(1 << 32) + np.uint64(g - 1)) // np.uint64(g))
    size = np.diff(cut)
    keep = np.flatnonzero(size >= strong)
    keep = keep[: apart + 1] if len(keep) > apart else np.arange(g)
    run = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_mix(s), out=run[1:])
    return _mix((run[cut[keep + 1]] - run[cut[keep]]) * np.uint64(0x9E3779B97F4A7C15) + keep.astype(np.uint64) + (size[keep].astype(np.uint64) << np.uint64(32)) + np.uint64(g))


def combinations(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the token combinations of a whole set."""
    strong = 2 if num + den >= 12 * (den - num) else 1
    out = [cells(s, g, d, strong) if g > 4 else deals(s, g, d + 1) for g, d in grids(len(s), num, den)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def vertex(s: np.ndarray) -> int | None:
    """Name of a set by its content: 64 bits, so that rows of equal sets need no exchange to agree on it."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def short_bits(s: np.ndarray, num: int, den: int) -> bytes:
    """Size of a set (4 bytes) and its parity signature, folded to the least width of ``SHORT`` that unrelated sets hardly agree in."""
    d, p = most_apart(len(s), num, den), parity_bits(s)
    for w in SHORT:
        if w / 2 - 1.5 * w**0.5 >= d:
            while len(p) * 64 > w:
                p = p[: len(p) // 2] ^ p[len(p) // 2 :]
            return len(s).to_bytes(4, "little") + p.tobytes()
    return len(s).to_bytes(4, "little")


def _sets(texts: pa.Array, k: int, cache: dict):
    for t in texts.to_pylist():
        if len(cache) > CACHE_WORDS:
            cache.clear()
        yield shingle_set(words(t), k, cache)


def _chunks(rows: list[tuple]):
    """Batches (c, v) or (c, v, s) of the keys of each vertex; rows are (vertex, keys) or (vertex, keys, s)."""
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and size < OUT_ROWS:
            size += len(rows[hi][1])
            hi += 1
        part = rows[lo:hi]
        at = pa.array(np.repeat(np.arange(len(part)), [len(r[1]) for r in part]))
        cols = [pa.array(np.concatenate([r[1] for r in part]).view(np.int64)), pa.array([r[0] for r in part], pa.int64()).take(at)]
        if len(part[0]) > 2:
            cols.append(pa.array([r[2] for r in part], pa.binary()).take(at))
        yield pa.RecordBatch.from_arrays(cols, names=["c", "v", "s"][: len(cols)])
        lo = hi


def _sketch(k: int):
    """Of (h, text, id): rows (id, h, v, n, signature) of the texts, and (tok, seen) of tokens that are frequent in the task."""
    names = ["id", "h", "v", "n", *MARKS, "wide", "tok", "seen"]

    def run(batches):
        cache, seen, often, kinds = _Hashes(), np.zeros(1 << 22, np.uint16), np.zeros(0, np.uint64), None
        for b in batches:
            kinds = [b.column(2).type, b.column(0).type]
            vs, ns, bits, wide, hot = [], [], [], [], [often]
            for s in _sets(b.column(1), k, cache):
                vs.append(vertex(s))
                ns.append(len(s))
                bits.append(parity_bits(s))
                wide.append(wide_bits(s))
                at = (s & np.uint64(len(seen) - 1)).astype(np.int64)
                c = seen[at]
                seen[at] = c + (c < 65535)
                hot.append(s[c >= LOCAL - 1])
            often = np.unique(np.concatenate(hot))
            mark = np.array(bits, np.int64).reshape(-1, WIDE)
            none = [pa.nulls(b.num_rows, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(vs, pa.int64()), pa.array(ns, pa.int64()), *[pa.array(mark[:, i].copy()) for i in range(WIDE)], pa.array(wide, pa.list_(pa.int64())), *none], names=names)
        for lo in range(0, len(often), OUT_ROWS):
            t = often[lo : lo + OUT_ROWS]
            n = seen[(t & np.uint64(len(seen) - 1)).astype(np.int64)].astype(np.int64)
            none = [pa.nulls(len(t), kind) for kind in (*kinds, *[pa.int64()] * (2 + WIDE), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(t.view(np.int64)), pa.array(n)], names=names)

    return run


def _keys(k: int, num: int, den: int, last, part: int = 0):
    """Of (h, text): rows (c, v, short signature) of the prefix tokens of each set in ``part`` of PARTS, or (c, v) of its combinations where ``last`` is None."""

    def run(batches):
        cache, done = _Hashes(), set()
        for b in batches:
            rows = []
            for s in _sets(b.column(1), k, cache):
                if not grids(len(s), num, den) or (v := vertex(s)) in done:
                    continue
                done.add(v)
                if last is None:
                    rows.append((v, combinations(s, num, den)))
                    continue
                f = last.value
                late = f[np.minimum(np.searchsorted(f, s), len(f) - 1)] == s if len(f) else np.zeros(len(s), bool)
                prefix = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), num, den)]
                # By the low bits: the prefix is the least hashes.
                rows.append((v, prefix[prefix % np.uint64(PARTS) == part], short_bits(s, num, den)))
            yield from _chunks(rows)

    return run


def _signs(s: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Sizes, words of the short signatures (0: none), and by width in words the signatures folded to it."""
    off = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1].astype(np.int64)
    data = np.frombuffer(s.buffers()[2], np.uint8) if len(s) else np.zeros(0, np.uint8)
    at = lambda i, lo, hi: data[off[i][:, None] + np.arange(lo, hi)]
    n = at(np.arange(len(s)), 0, 4).view(np.uint32).astype(np.int64).ravel()
    words_, fold = (np.diff(off) - 4) // 8, {}
    wider = None
    for w in sorted((b // 64 for b in SHORT), reverse=True):
        f = np.zeros((len(s), w), np.uint64) if wider is None else wider[:, :w] ^ wider[:, w:]
        i = np.flatnonzero(words_ == w)
        f[i] = at(i, 4, 4 + 8 * w).view(np.uint64)
        fold[w] = wider = f
    return n, words_, fold


def _mates(v: np.ndarray, s: pa.Array, left: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows have a row of another set in their group that size and signature let be similar; ``left``: rows of the group that follow."""
    n, width, fold = _signs(s)
    use, i, d = np.zeros(len(v), bool), np.flatnonzero(left), 1
    while len(i):
        x = i[~(use[i] & use[i + d])]
        y = x + d
        ok = (v[x] != v[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        w = np.minimum(width[x], width[y])
        ok = w == 0
        for k, f in fold.items():
            at = np.flatnonzero(w == k)
            bits = np.bitwise_count(f[x[at]] ^ f[y[at]]).sum(1, dtype=np.int64)
            ok[at] = (num + den) * bits <= (den - num) * (n[x[at]] + n[y[at]])
        use[x[ok]] = use[y[ok]] = True
        d += 1
        i = i[left[i] >= d]
    return use


def _near(num: int, den: int, rare: int):
    """Rows (c, v, s) in order of c to rows (c, v, often): holders of a key that another holder may be similar to, and all holders of a key of more than ``rare``."""
    names = ["c", "v", "often"]

    def closed(t: pa.Table, hot):
        """Rows of the whole groups of ``t``; ``hot`` is a frequent key whose first rows went before."""
        c, v = (t.column(i).to_numpy() for i in (0, 1))
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(at, len(c)))
        m = np.repeat(size, size)
        often = (m > rare) | (c == hot if hot is not None else False)
        left = np.repeat(at + size, size) - np.arange(len(c)) - 1
        some = np.flatnonzero((m > 1) & ~often)
        use = often.copy()
        use[some] = _mates(v[some], t.column(2).take(pa.array(some)).combine_chunks(), left[some], num, den)
        return pa.RecordBatch.from_arrays([pa.array(c[use]), pa.array(v[use]), pa.array(often[use])], names=names)

    def run(batches):
        parts, rows, hot = [], 0, None
        for b in batches:
            parts.append(b)
            rows += b.num_rows
            if rows < NEAR_ROWS:
                continue
            t = pa.Table.from_batches(parts)
            c = t.column(0).to_numpy()
            cut = int(np.searchsorted(c, c[-1]))
            # The last group stays open; the rows of a frequent key need not wait for each other.
            if cut < rows - rare:
                cut = rows
            if cut:
                yield closed(t.slice(0, cut), hot)
                hot = c[-1] if cut == rows else None
            parts, rows = (t.slice(cut).to_batches(), rows - cut) if cut < rows else ([], 0)
        if rows:
            yield closed(pa.Table.from_batches(parts), hot)

    return run


def _similar(k: int, num: int, den: int):
    """Rows (a, b, ta, tb) in order of a to the (a, b) whose sets are similar."""

    def run(batches):
        cache, last, one = _Hashes(), None, None
        for b in batches:
            ok = []
            a = b.column(0).to_pylist()
            for i in range(b.num_rows):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                if a[i] != last:
                    last, one = a[i], shingle_set(words(b.column(2)[i].as_py()), k, cache)
                two = shingle_set(words(b.column(3)[i].as_py()), k, cache)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(den * both >= num * (len(one) + len(two) - both))
            yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return run


def _sizes_fit(num: int, den: int):
    return F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")


def _marks_fit(num: int, den: int):
    """Similar sets differ in at most (na + nb) (1 - t) / (1 + t) tokens, and their signatures in no more bits."""
    d = " + ".join(f"bit_count(a{m} ^ b{m})" for m in MARKS)
    return F.expr(f"({num} + {den}) * ({d}) <= ({den} - {num}) * (na + nb)")


def _wide_fit(num: int, den: int):
    """The same of the wide signatures, if both have one; similar sets are of sizes in the same or neighbouring powers of two."""
    fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    d = f"aggregate(zip_with({fold('awide', 'bwide')}, {fold('bwide', 'awide')}, (p, q) -> bit_count(p ^ q)), 0, (s, x) -> s + x)"
    return F.expr(f"awide is null or bwide is null or ({num} + {den}) * {d} <= ({den} - {num}) * (na + nb)")


SIGNS = (*MARKS, "wide")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(F.col("v").alias(side), F.col("n").alias(f"n{side}"), *[F.col(m).alias(side + m) for m in SIGNS])


class Join:
    """The steps of one self-join; ``all`` has a row (id, handle h, v, n) for every row of the input."""

    def __init__(self, df: DataFrame, key: str, text: str, shingle: int, num: int, den: int):
        self.k, self.num, self.den, self.temps = shingle, num, den, []
        h = handle(key, text)
        self.docs = df.select(h.alias("h"), F.col(text).alias("text"), F.col(key).alias("id"))
        schema = f"id {df.schema[key].dataType.simpleString()}, h binary, v bigint, n bigint, {', '.join(f'{m} bigint' for m in MARKS)}, wide array<bigint>, tok bigint, seen bigint"
        self.made = materialise(self.docs.mapInArrow(_sketch(shingle), schema), "sets")
        self.all = materialise(self.made.where("tok is null").select("id", "h", "v", "n"), "all")
        # One row stands for the rows of a set.
        rep = F.min(F.struct("h", *SIGNS)).alias("r")
        self.reps = self._keep(self.made.where("tok is null and n > 0").groupBy("v", "n").agg(rep).select("v", "n", "r.*"), "reps")
        self.marks = self.reps.drop("h")

    def _keep(self, df: DataFrame, name: str, **how) -> DataFrame:
        self.temps.append(materialise(df, name, **how))
        return self.temps[-1]

    def _over(self, *tables: DataFrame) -> None:
        """Delete tables of steps that nothing needs any more, and the files of exchanges that have ended."""
        for t in tables:
            drop(t)
        release(self.docs.sparkSession)

    def close(self) -> None:
        """Delete the tables of the steps; ``all`` stays."""
        for t in self.temps:
            drop(t)
        self.temps = []

    def _scan(self, handles: DataFrame, function, schema: str) -> DataFrame:
        return scan(self.docs.select("h", "text"), handles, function, schema)

    def _late(self):
        """Tokens that come last in the global order, sorted: the most frequent ones by powers of two, at most ORDERED."""
        tok = self._keep(self.made.where("tok is not null").groupBy("tok").agg(F.sum("seen").alias("seen")).where(F.col("seen") > RARE), "often")
        power = F.floor(F.log2("seen")).cast("int")
        least, total = 64, 0
        for r in sorted(tok.groupBy(power.alias("p")).agg(F.count("*").alias("m")).collect(), reverse=True):
            total += r["m"]
            if total > ORDERED:
                break
            least = r["p"]
        t = tok.where(power >= least).select("tok").toArrow().column("tok").to_numpy()
        return self.docs.sparkSession.sparkContext.broadcast(np.sort(t.view(np.uint64)))

    def components(self) -> DataFrame:
        """(v, comp): the component of every vertex that has a link."""
        how = (self.k, self.num, self.den)
        late = self._late()
        self._over(self.made)
        # Rows that nothing can be similar to by their key end in the one exchange of their part; a part's files go before the next part.
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kept = []
        for part in range(PARTS):
            single = self._scan(self.reps, _keys(*how, late, part), "c bigint, v bigint, s binary")
            near = single.repartition(n, "c").sortWithinPartitions("c").mapInArrow(_near(self.num, self.den, RARE), "c bigint, v bigint, often boolean")
            kept.append(self._keep(near, "shared"))
            del single, near
            self._over()
        shared = reduce(DataFrame.union, kept)
        often = shared.where("often").select("v").distinct().join(self.reps.select("v", "h"), "v")
        combos = self._keep(self._scan(often, _keys(*how, None), "c bigint, v bigint"), "combos")
        count = combos.groupBy("c").agg(F.count("*").alias("m")).where("m > 1").select("c")
        held = self._keep(shared.where("not often").select("c", "v").union(combos.join(count, "c").select("c", "v")), "held")
        self._over(*kept, combos)
        # The lead of a key is the holder with most shared keys for its size.
        weight = held.groupBy("v").agg(F.count("*").alias("m")).join(self.reps.select("v", "n"), "v").select("v", (F.col("m") / F.col("n")).alias("w"))
        weight = self._keep(weight, "weight")
        led = held.join(weight, "v").groupBy("c").agg(F.max(F.struct("w", "v")).alias("lead"))
        led = self._keep(led.select("c", F.col("lead.v").alias("lead"), F.col("lead.w").alias("w")), "led")
        self._over(weight)
        stars = held.join(led, "c").where("v <> lead")
        # One star pair a set first, with its best lead; the others only where they still join two components.
        best = stars.groupBy(F.col("v").alias("b")).agg(F.max(F.struct("w", "lead")).alias("l")).select(F.col("l.lead").alias("a"), "b")
        comp = self._components(self._verified(best))
        more = self._apart(stars.select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct(), comp)
        comp = self.merged(comp, self._verified(more))
        self._over(led)
        return self.merged(comp, self._verified(self._across(held, comp)))

    def _components(self, links: DataFrame) -> DataFrame:
        self.temps.append(components(links))
        return self.temps[-1]

    def merged(self, comp: DataFrame, links: DataFrame) -> DataFrame:
        """Components with further links (a, b); only one link between two components counts."""
        at = lambda v, c: comp.select(F.col("v").alias(v), F.col("comp").alias(c))
        ends = links.join(at("a", "ca"), "a", "left").join(at("b", "cb"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        ends = self._keep(ends.where("ca <> cb"), "ends")
        if not ends.take(1):
            return comp
        up = self._components(ends.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
        every = comp.union(ends.select(F.col("a").alias("v"), F.col("ca").alias("comp"))).union(ends.select("b", "cb")).distinct()
        return self._keep(every.join(up.select(F.col("v").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("v", F.coalesce("up", "comp").alias("comp")), "comp")

    def _apart(self, pairs: DataFrame, comp: DataFrame) -> DataFrame:
        at = lambda v, c: comp.select(F.col("v").alias(v), F.col("comp").alias(c))
        return pairs.join(at("a", "ca"), "a", "left").join(at("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def _across(self, held: DataFrame, comp: DataFrame) -> DataFrame:
        """Pairs of holders of one key in different components whose sizes and signatures allow similarity, in blocks."""
        placed = self._keep(held.join(comp, "v", "left").select("c", "v", F.coalesce("comp", "v").alias("comp")), "placed")
        self._over(held)
        mixed = placed.groupBy("c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2")
        parts = F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")
        open_ = self._keep(placed.join(mixed.select("c", "m", parts), "c"), "open")
        self._over(placed)
        # Of the hot keys that a pair shares only the least makes it: a row has its vertex's hot keys below its own.
        hot = open_.where(F.col("m") > HOT).groupBy("v").agg(F.collect_set("c").alias("ks"))
        less = F.when(F.col("m") > HOT, F.filter("ks", lambda k: k < F.col("c")))
        open_ = self._keep(open_.join(self.marks, "v").join(hot, "v", "left").withColumn("less", less).drop("ks", "m"), "open")
        at = lambda s: [F.col("comp").alias("c" + s), F.col("v").alias(s), F.col("n").alias("n" + s), F.col("less").alias("less" + s), *[F.col(m).alias(s + m) for m in SIGNS]]
        x = open_.select("c", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), *at("a"))
        y = open_.select("c", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), *at("b"))
        fit = _sizes_fit(self.num, self.den) & _marks_fit(self.num, self.den) & _wide_fit(self.num, self.den) & F.coalesce(~F.arrays_overlap("lessa", "lessb"), F.lit(True))
        return x.join(y, ["c", "part"]).where("ca < cb").where(fit).select("a", "b").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (a, b); most texts of no pair never reach a shuffle."""
        fit = pairs.join(_side(self.marks, "a"), "a").join(_side(self.marks, "b"), "b")
        fit = fit.where(_sizes_fit(self.num, self.den) & _marks_fit(self.num, self.den) & _wide_fit(self.num, self.den))
        at = lambda v: self.reps.select(F.col("v").alias(v), F.col("h").alias("h" + v))
        fit = self._keep(fit.select("a", "b").join(at("a"), "a").join(at("b"), "b"), "pairs")
        n = fit.count()
        if not n:
            return fit.select("a", "b")
        need = fit.select(F.col("ha").alias("h")).union(fit.select("hb")).distinct()
        docs = self.docs.select("h", "text")
        # Few handles (16 bytes each, at most twice FEW) are known to every task; of more, the id filter is.
        some = docs.join(F.broadcast(need), "h", "left_semi") if n <= FEW else self._scan(need, lambda batches: batches, "h binary, text string")
        got = some.groupBy("h").agg(F.first("text").alias("text"))
        two = fit.join(got.select(F.col("h").alias("hb"), F.col("text").alias("tb")), "hb")
        both = two.join(got.select(F.col("h").alias("ha"), F.col("text").alias("ta")), "ha").select("a", "b", "ta", "tb")
        return self._keep(both.mapInArrow(_similar(self.k, self.num, self.den), "a bigint, b bigint"), "links", rows=PAIR_ROWS)


def join(df: DataFrame, key: str, text: str, shingle: int, num: int, den: int) -> DataFrame:
    """(key, n_shingles, component_id) of every row; links are den * |x & y| >= num * |x | y|."""
    j = Join(df, key, text, shingle, num, den)
    comp = j.components()
    # An id with several texts joins their components.
    has = materialise(j.all.where("n > 0").groupBy("id", "v").agg(F.count("*").alias("m")).select("id", "v"), "has")
    several = has.where("id is not null").groupBy("id").agg(F.min("v").alias("a"), F.max("v").alias("z")).where("a < z").select("id", "a")
    same = has.join(several, "id").where("v <> a").select("a", F.col("v").alias("b"))
    comp = j.merged(comp, same)
    placed = materialise(has.join(comp, "v", "left").select("id", "v", F.coalesce("comp", "v").alias("comp")), "placed")
    name = placed.groupBy("comp").agg(F.min("id").alias("component"))
    name = materialise(placed.select("v", "comp").distinct().join(name, "comp").select("v", "component"), "names")
    j.close()
    for t in (has, placed):
        drop(t)
    out = j.all.where("n > 0").join(name, "v").select("id", "n", F.col("component"))
    out = out.union(j.all.where("n = 0").select("id", "n", F.col("id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(df: DataFrame, key: str, text: str, shingle: int, num: int, den: int) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest key stays.

    Of repeated rows one stays; of an id's several texts those stay that are not near another row that
    stays; rows without an id are rows of their own and stay only where no row with an id is near them.
    Rows without words stay. Rows that surely stay are not shuffled.
    """
    j = Join(df, key, text, shingle, num, den)
    comp = j.components()
    named = materialise(j.all.where("n > 0").join(comp, "v", "left").select("id", "h", F.coalesce("comp", "v").alias("comp")), "named")
    # Ids in order, then rows without one; ties go by the handle.
    best = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("best"), F.count("*").alias("m")).where("m > 1")
    lose = materialise(named.join(best.select("comp", F.col("best.h").alias("stay")), "comp").where("h <> stay").select("h").distinct(), "lose")
    twice = named.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    special = materialise(lose.union(twice).distinct(), "special")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), handle(key, text).alias("h"))
    clear = split_by_filter(rows, special, "h", False).select("row.*")
    checked = split_by_filter(rows, special, "h", True).join(lose, "h", "left_anti")
    # Only rows with words can be repeated here; those without share one handle a key.
    has = F.length(F.translate(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), " \t\n\x0b\x0c\r", "")) > 0
    j.close()
    for t in (named, j.all):
        drop(t)
    return clear.union(checked.where(has).dropDuplicates(["h"]).select("row.*")).union(checked.where(~has).select("row.*"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 85, 100)
