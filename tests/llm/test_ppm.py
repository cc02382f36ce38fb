import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomgraph.llm import ppm

TEXTS = ["", None, "The cat sat.", "the Cat  sat\ton the mat\n", "é à é 😀", "zzz qqq", "the cat sat on the mat " * 30, "a\x0bb\x0cc", "THE END", "x" * 500] + [f"the word {i} is on mat {i % 3}" for i in range(30)]


def brute(train, text):
    """The model by the book: contexts of order 3 to 0, method C, exclusion by sets."""
    seen = defaultdict(Counter)
    for t in train:
        b = b"\xfe\xfe\xfe" + (t or "").encode() + b"\xff"
        for i in range(3, len(b)):
            for k in range(4):
                seen[b[i - k : i]][b[i]] += 1
    total = 0.0
    b = b"\xfe\xfe\xfe" + (text or "").encode() + b"\xff"
    for i in range(3, len(b)):
        gone: set = set()
        for k in (3, 2, 1, 0):
            have = {s: n for s, n in seen.get(b[i - k : i], {}).items() if s not in gone}
            if not have:
                continue
            n, q = sum(have.values()), len(have)
            if b[i] in have:
                total += math.log10(have[b[i]] / (n + q))
                break
            total += math.log10(q / (n + q))
            gone |= set(have)
        else:
            total -= math.log10(max(256 - len(seen[b""]), 1))
    return total


@pytest.mark.parametrize("block", [12_000_000, 300])
def test_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK_CHARS", block)
    spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[3])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = ppm.op10_ppm(spark, str(tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    train = [t for i, t in pairs if zlib.crc32(str(i).encode()) % 5 != 1]
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [" "]
    c = Counter(w for t in train for w in lower(t))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = TEXTS[r.doc_id]
        ws = lower(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score == pytest.approx(brute(train, t), rel=1e-5)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ppm.op10_ppm(spark, str(tmp_path)).count() == 0
