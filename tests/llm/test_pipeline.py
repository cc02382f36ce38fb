import random

import corpus_pipeline
from loomgraph.llm import decontaminate, ngram_join, pii, quality_rules, sentencepiece_codec


def documents(spark, path):
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 6))) for _ in range(n))
    leak = say(30)
    rows = [(i, say(60), "en", f"s{i % 2}", 0) for i in range(60)]
    rows[7] = (7, rows[3][1], "en", "s1", 0)
    rows[9] = (9, say(20) + " " + leak + " " + say(20), "en", "s1", 0)
    rows[11] = (11, "short", "en", "s1", 0)
    rows[13] = (13, "mail me@site.org or +1 (555) 555-0199 " + say(50), "en", "s1", 0)
    rows += [(60, None, None, None, None), (61, "x y " * 40, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}


def test_every_decision_takes_effect(spark, tmp_path):
    texts = documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality_rules.op7_quality_rules(spark, str(tmp_path)).collect() if r.kept}
    assert set(seen["quality rules"]) == kept and not kept & {11, 60, 61}
    assert set(seen["n-gram Jaccard join"]) == kept - {7}
    assert set(seen["benchmark decontamination"]) == kept - {7, 9}
    assert seen["PII"][13].startswith("mail [EMAIL] or [PHONE] ")
    assert all(seen["PII"][i] == texts[i] for i in seen["PII"] if i != 13)
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    assert {i: r.n_tokens for i, r in last.items()} == {i: len(codec.encode(t)[0]) for i, t in seen["PII"].items()}


def test_repeated_and_missing_ids_leave_one_document_of_a_group(spark, tmp_path):
    r = random.Random(5)
    say = lambda: " ".join("".join(r.choice("aeioubcdfg") for _ in range(5)) for _ in range(60))
    a, b, c, d, e = (say() for _ in range(5))
    rows = [(1, a), (1, a), (1, a + " more"), (2, a), (3, b), (3, c), (4, c), (None, d), (None, d), (None, e), (5, e), (10, d[:0]), (10, None), (20, b + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = sorted((str(x.doc_id), x.text or "") for x in out.collect())
    firsts = [x for x in got if x[0] == "1"]
    assert len(firsts) == 1 and firsts[0][1].startswith(a)
    assert [x for x in got if x[0] != "1"] == sorted([("3", b), ("3", c), ("None", d), ("5", e), ("10", ""), ("10", "")])


def test_clashing_names_repeats_and_empty_tables(spark, tmp_path):
    documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "doc_id AS _h", "'a' AS _probe", "1 AS row", "text AS h", "2 AS _row", "lang AS kept", "3 AS v", "4 AS spans")
    docs = docs.union(docs.where("doc_id = 5"))
    want = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted(r.doc_id for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "quality rules":
            want = got
            assert got.count(5) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0 and want


def test_statistics_are_computed_again_only_where_a_row_may_go(spark, tmp_path, monkeypatch):
    documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id = 3").selectExpr("doc_id", "concat(text, repeat(' same words again and again', 40))", "lang", "source", "n_chars"))
    texts, stats = [], quality_rules.text_stats
    monkeypatch.setattr(quality_rules, "text_stats", lambda d, t: texts.append(d.where(f"{t} is not null").count()) or stats(d, t))
    got = sorted((r.doc_id, len(r.text)) for r in quality_rules.keep_rows(docs).collect())
    assert texts[0] == docs.where("text is not null").count() and texts[1] == texts[0] - len(got)
    want = quality_rules.judge(docs.withColumn("doc_id", docs.doc_id * 10_000 + quality_rules.F.length("text"))).where("kept").collect()
    assert got == sorted(divmod(r.doc_id, 10_000) for r in want)
    assert [i for i, _ in got].count(5) == 2 and [i for i, _ in got].count(3) == 1


def test_the_join_keeps_no_table_longer_than_needed(spark, tmp_path, monkeypatch):
    import os

    documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    write, seen = ngram_join.materialise, []
    folder = write(spark.range(1), "probe").loomgraph_path.removeprefix("file://").rpartition("/")[0]
    there = lambda: set(os.listdir(folder))
    before = there()
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name="t", **how: (seen.append(there() - before) if name == "named" else None) or write(df, name, **how))
    ngram_join.one_of_each(docs, "doc_id", "text", 5, 80, 100).count()
    names = {x.rpartition("-")[0] for x in seen[0]}
    assert "reps" in names and not names & {"sets", "shared", "combos", "held", "weight", "led", "placed"}
