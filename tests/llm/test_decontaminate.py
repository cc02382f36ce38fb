import math
import random
from collections import Counter

import pytest

from loomgraph.llm import decontaminate as dc
from loomgraph.llm.ngram_join import words


def brute(docs, items):
    """Every item-sized region of every text by weighted shingle similarity."""
    cache = dc._Hashes()
    sets = {i: set(dc.shingles(dc.hash_words(words(t), cache)).tolist()) for i, t in items if t is not None}
    df = Counter(x for s in sets.values() for x in s)
    weight = lambda x: 1 + math.log(len(sets)) - math.log(max(df[x], 1))
    out = set()
    for d, t in docs:
        h = dc.hash_words(words(t), cache)
        for i, t in items:
            n = len(words(t))
            for lo in range(0, max(1, len(h) - n + 1)) if n else ():
                got = set(dc.shingles(h[lo : lo + n]).tolist())
                both = sum(weight(x) for x in got & sets[i])
                if got and both / (sum(weight(x) for x in sets[i]) + (1 + math.log(len(sets))) * len(got - sets[i])) >= 0.8:
                    out.add((d, i))
    return out


def test_finds_what_brute_force_finds(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    say = lambda n: [r.choice("a the of in on to".split()) if r.random() < 0.4 else "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    items = [(i, " ".join(say(r.choice((3, 6, 10, 12, 17, 25, 40, 57, 90))))) for i in range(40)] + [(98, None), (99, "")]
    docs = [(0, None), (1, ""), (2, "short")]
    for i in range(60):
        t = say(r.randint(0, 200))
        if i % 3:
            p = items[r.randrange(40)][1].split()
            if i % 3 == 2 and len(p) > 50:
                p[r.randrange(len(p))] = "changed"
            at = r.randint(0, len(t))
            t[at:at] = [w.upper() if r.random() < 0.1 else w for w in p]
        docs.append((10 + i, " ".join(t)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.doc_id, x.item_id) for x in dc.op5_decontaminate(spark, str(tmp_path)).collect()}
    want = brute(docs, items)
    assert got <= want
    assert len(got) >= 0.98 * len(want) and len(want) > 25
    found = sorted(map(tuple, dc.op5_decontaminate(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(dc, "ITEM_BLOCK", 9)
    assert sorted(map(tuple, dc.op5_decontaminate(spark, str(tmp_path)).collect())) == found
    kept = {x.doc_id for x in dc.clean(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_all_fingerprints_within_the_radius():
    import numpy as np

    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, 300, dtype=np.uint64)
    index = dc.Index([], 0, {})
    index.tables = {9: dc.Index._tables([(int(x), i, 0) for i, x in enumerate(f)])}
    probe = f.copy()
    for i in range(len(probe)):
        for b in r.choice(64, r.integers(0, 11), replace=False):
            probe[i] ^= np.uint64(1) << np.uint64(b)
    at, item, _ = index.near(9, probe)
    want = {(i, j) for i in range(300) for j in range(300) if bin(int(probe[i]) ^ int(f[j])).count("1") <= dc.RADIUS}
    assert set(zip(at.tolist(), item.tolist())) == want


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11, 12, 15, 57, 500])
def test_window_leaves_the_stride(n):
    assert 1 <= dc.window_size(n) <= max(1, n - dc.STRIDE + 1)


def test_repeats_ties_clashing_names_and_empty_tables(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"before {passage} after {passage}", "x", "y", 1), (1, f"before {passage} after {passage}", "x", "y", 1), (2, "clean words", "x", "y", 2), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _probe string, row string, t long")
    bench = spark.createDataFrame([(7, passage, 0), (7, passage, 0), (8, None, 0)], "item_id long, text string, extra long")
    assert [tuple(r)[:4] for r in dc.find(docs, bench, "doc_id", "text").collect()][:2] == [(1, 7, 1, 20)] * 2
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert dc.clean(docs, bench.limit(0)).count() == 4 and dc.clean(docs.limit(0), bench).count() == 0
    assert dc.find(docs, bench.limit(0), "doc_id", "text").count() == 0
