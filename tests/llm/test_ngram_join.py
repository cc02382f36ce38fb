import random
import re

import numpy as np
import pytest

from loomgraph.llm import ngram_join


def brute(rows, k=4, num=85):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            if s and r and 100 * len(s & r) >= num * len(s | r):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    rows = [(0, ""), (1, None), (2, "One two"), (3, "one  TWO"), (4, " \t\n"), (5, "a b c d e f g h"), (6, "a b c d e f g h i")]
    passage = [word() for _ in range(60)]
    for base in range(14):
        text = [word() for _ in range(r.choice((6, 9, 12, 20, 30, 60, 150)))]
        for _ in range(r.choice((1, 2, 3, 40))):
            t = list(text)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 4))):
                c = r.random()
                at = r.randrange(len(t))
                if c < 0.4:
                    t[at] = word()
                elif c < 0.7:
                    t = t[at // 8 :]
                else:
                    t.insert(at, word())
            rows.append((len(rows), " ".join(t)))
    for _ in range(40):
        rows.append((len(rows), " ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)])))
    for n in range(5, 45):
        t = [f"w{n}_{i}" for i in range(n)]
        rows += [(len(rows), " ".join(t)), (len(rows) + 1, " ".join(t + ["x"]))]
        rows += [(len(rows) + i, " ".join(t[i:])) for i in range(2)]
    return rows


@pytest.mark.parametrize("seed, rare", [(1, 12), (2, 1)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, seed, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in ngram_join.op4_ngram_join(spark, str(tmp_path)).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("rare", [12, 1])
def test_sets_of_one_frequent_shingle(spark, tmp_path, monkeypatch, rare):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    rows = [(n, " ".join(["la"] * (n + 4))) for n in range(15)] + [(20 + n, " ".join(["la"] * (n + 1))) for n in range(3)] + [(30, "la la la x"), (31, "la la la la x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in ngram_join.op4_ngram_join(spark, str(tmp_path)).collect())
    assert got == brute(rows) and {c for i, _, c in got if i < 15} == {0}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    assert ngram_join.op4_ngram_join(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("num", [80, 85])
def test_similar_sets_share_a_combination(num):
    r, g = random.Random(num), np.random.default_rng(num)
    tried = 0
    while tried < 1500:
        n = r.choice((r.randint(4, 12), r.randint(4, 40), r.randint(40, 400)))
        x = np.unique(g.integers(0, 1 << 64, n, dtype=np.uint64))
        gone, new = r.randint(0, n // 9), r.randint(0, n // 9)
        y = np.unique(np.concatenate([g.permutation(x)[gone:], g.integers(0, 1 << 64, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(x) + len(y) == 2 * both or 100 * both < num * (len(x) + len(y) - both):
            continue
        tried += 1
        assert len(np.intersect1d(ngram_join.combinations(x, num, 100), ngram_join.combinations(y, num, 100)))


def test_unrelated_sets_with_a_common_passage_share_few_combinations():
    g = np.random.default_rng(7)
    common = g.integers(0, 1 << 64, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, g.integers(0, 1 << 64, 70, dtype=np.uint64)])) for _ in range(200)]
    keys = np.concatenate([ngram_join.combinations(s, 85, 100) for s in sets])
    m = np.unique(keys, return_counts=True)[1]
    assert (m * (m - 1) // 2).sum() < 0.1 * 200 * 199 / 2


def test_one_of_each(spark):
    t = [f"w{i}" for i in range(60)]
    near, far = " ".join([*t, "x"]), " ".join(f"v{i}" for i in range(30))
    rows = [(5, " ".join(t), 1), (3, near, 2), (3, near, 3), (3, far, 4), (None, near, 5), (None, "lone text here", 6), (None, "lone text here", 7), (8, "", 8), (8, "", 9), (9, None, 10), (7, far, 11), (6, "A b", 12), (6, "a  B", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long")
    got = sorted(r["h"] for r in ngram_join.one_of_each(df, "doc_id", "text", 5, 80, 100).collect())
    pick = lambda a: len([x for x in got if x in a])
    assert [x for x in got if x in (4, 8, 9, 10)] == [4, 8, 9, 10] and pick((2, 3)) == 1 and pick((6, 7)) == 1 and pick((12, 13)) == 1 and len(got) == 7
    assert ngram_join.one_of_each(df.limit(0), "doc_id", "text", 5, 80, 100).count() == 0


def test_several_texts_null_ids_and_repeats(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(4, a), (4, b), (2, a + " z"), (9, b), (9, b), (None, b + " z"), (None, "only this one"), (1, "word " * 30_000), (0, "word " * 20_000)]
    got = sorted(((r[0], r[2]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 85, 100).collect()), key=str)
    assert got == sorted([(4, 2), (4, 2), (2, 2), (9, 2), (9, 2), (None, 2), (None, None), (1, 0), (0, 0)], key=str)


def near_rows(rows, rare, size):
    import pyarrow as pa

    rows = sorted(rows)
    t = pa.table({"c": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64()), "s": pa.array([r[2] for r in rows], pa.binary())})
    out = [tuple(r.values()) for b in ngram_join._near(85, 100, rare)(t.to_batches(size)) for r in b.to_pylist()]
    return sorted(out)


@pytest.mark.parametrize("wait", [20, 300])
def test_holders_that_nothing_can_be_similar_to_end_at_their_key(monkeypatch, wait):
    """Rows of similar sets stay, whatever batches they come in; chance holders of a token go; frequent keys keep all rows."""
    monkeypatch.setattr(ngram_join, "NEAR_ROWS", wait)
    g, rows, pairs, rare = np.random.default_rng(3), [], [], 8
    for c in range(300):
        n = int(g.choice([20, 100, 250, 500, 1200]))
        sets = [np.unique(g.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(2 + c % 3)]
        if c % 4 == 0:
            twin = np.unique(np.concatenate([sets[0][n // 30 :], g.integers(0, 1 << 64, n // 30, dtype=np.uint64)]))
            pairs += [(c, 10 * c, False), (c, 10 * c + 9, False)]
            rows.append((c, 10 * c + 9, ngram_join.short_bits(twin, 85, 100)))
        rows += [(c, 10 * c + i, ngram_join.short_bits(s, 85, 100)) for i, s in enumerate(sets)]
    hot = [(c, 10_000 * c + i, ngram_join.short_bits(g.integers(0, 1 << 64, 30, dtype=np.uint64), 85, 100)) for c, m in ((500, 9), (501, 45), (502, 8)) for i in range(m)]
    got = near_rows(rows + hot, rare, 7)
    assert [x for x in got if x[0] >= 500] == [(c, v, True) for c, v, _ in hot if c < 502]
    got = [x for x in got if x[0] < 500]
    assert set(pairs) <= set(got) and len(got) < len(pairs) + 0.02 * len(rows)


def test_equal_sets_at_one_key_are_no_mates():
    s = ngram_join.short_bits(np.arange(40, dtype=np.uint64), 85, 100)
    assert near_rows([(1, 5, s), (1, 5, s), (2, 5, s), (2, 6, s)], 128, 10) == [(2, 5, False), (2, 6, False)]


def test_prefix_rows_are_exchanged_in_parts():
    """The parts share no key, hold about as many rows each and all prefix rows together."""
    import types

    import pyarrow as pa

    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(n)) for n in (3, 40, 300, 900, 2500)]
    b = pa.record_batch([pa.array([b""] * len(texts)), pa.array(texts)], names=["h", "text"])
    sets = list(ngram_join._sets(pa.array(texts), 5, ngram_join._Hashes()))
    late = types.SimpleNamespace(value=np.sort(np.concatenate([s[::7] for s in sets])))
    parts = [{(x["c"], x["v"]) for o in ngram_join._keys(5, 80, 100, late, part)([b]) for x in o.to_pylist()} for part in range(ngram_join.PARTS)]
    want = set()
    for s in sets:
        f = np.isin(s, late.value)
        if ngram_join.grids(len(s), 80, 100):
            want |= {(int(t), ngram_join.vertex(s)) for t in np.concatenate([s[~f], s[f]])[: ngram_join.prefix_length(len(s), 80, 100)].view(np.int64)}
    assert sum(map(len, parts)) == len(want) and set().union(*parts) == want
    assert len({c for c, _ in want}) == sum(len({c for c, _ in p}) for p in parts)
    assert max(map(len, parts)) < 0.6 * len(want)
