import hashlib
import re

import pytest

from loomgraph.llm import pii

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in RAW.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = ["", None, "a@b.c_d@e.f @x.y a.b+c@d-e.f.g.", "é 😀 1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4", "4111 1111 1111 1111 x 4111-1111-1111-1112 4111111111111111",
         "+1 (017) 555-7713. +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "x\x01y a@b.cc \x02 z@q.rr", "1" * 3000, "a" * 20000 + "@", "7.7.7.7 " * 700]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pii"))
    texts = TEXTS + [f"card {4000000000000000 + k} end" for k in range(50)]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, TEXTS[2], "y")], "doc_id long, text string, base string").write.parquet(f"{d}/documents.parquet")
    return [(texts[r.doc_id], r) for r in pii.op3_pii(spark, d).collect()]


def test_base_equals_brute_force(rows):
    assert len(rows) == len(TEXTS) + 51
    for text, r in rows:
        want = brute(text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in RAW]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_confident_context_discovers_unseen_identifiers(spark, tmp_path):
    good = [(i, f"words reach +1 (555) 201-{1000 + i} now" if i % 2 else f"words reach 555-201{i:04d} now") for i in range(400)]
    many = [(1000 + i, f"reach +44 20 7946 {1000 + i} now") for i in range(800)]
    spark.createDataFrame(good + many + [(5000, "chapter 12 and 555-0000000 verse")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got[0] == "phone:12:23"
    assert got[5000] == ""


def test_secrets_are_marked_in_confident_contexts_only(spark, tmp_path):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    rows = [(i, f'some words token = "{h}" more') for i, h in enumerate(hexes[:40])] + [(100, 'other token = "k3y_Zz81-ffQqLm0012" end'), (101, 'token = "12" end'), (102, f"commit {hexes[50]} by me"), (103, f'commit {hexes[51]} "{hexes[52]}"')]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.n_spans, r.n_discovered) for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got[0] == ("secret:20:60", 1, 1) and got[100] == ("secret:15:34", 1, 1)
    assert {got[i] for i in (101, 102, 103)} == {("", 0, 0)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op3_pii(spark, str(tmp_path)).count() == 0


def test_redact_keeps_columns_whose_names_are_ours(spark):
    rows = [(1, "write to joe@ab.com now", "x", "y", 1), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, new string, _row long")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "write to [EMAIL] now", "x", "y", 1), (2, None, None, None, None)]
