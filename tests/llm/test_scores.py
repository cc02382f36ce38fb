import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import html_crf, language_id, quality_rules
from loomgraph.llm.compression_quality import op6_compression_quality
from loomgraph.llm.language_id import op2_language_id

TEXTS = [None, "", "a b c", "x y z w v " * 4, "one\ntwo\none\n \n", "### $$ a|b <c>\n" * 3, "a b c d e f g a b c d e q r s", "é\t😀\x0bz " * 9] + [f"word{i} and the rest of it number {i * 7} goes on for a while here" for i in range(12)]


def brute(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    many = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(ws) < 10 or 100 * len(rep) > 20 * len(ws))


def write(spark, path):
    rows = [(i, t, None if i % 4 == 0 else "en", "s", i) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(len(TEXTS))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")


def test_rules_equal_brute_force_and_scores_take_nulls(spark, tmp_path):
    write(spark, tmp_path)
    got = {r.doc_id: r for r in quality_rules.op7_quality_rules(spark, str(tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)
    lang = {r.doc_id: r for r in op2_language_id(spark, str(tmp_path)).collect()}
    assert lang[0].lang_pred == lang[1].lang_pred == "und" and lang[12].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in op6_compression_quality(spark, str(tmp_path)).collect())


def test_main_text():
    pages = html_crf.labelled_pages(200, seed=3)
    crf = html_crf.train(pages[:140], rounds=60)
    right = sum(a == b for p, y in pages[140:] for a, b in zip(crf.decode(html_crf.features(html_crf.blocks_of(p))), y))
    assert right / sum(len(y) for _, y in pages[140:]) > 0.97
    assert html_crf.main_text(None, crf)[0] == html_crf.main_text("<!-- x", crf)[0] == ""
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>Some  <b>bo</b>ld text of the page.<p>More of it.</article><footer>&copy; x</footer>"
    assert html_crf.main_text(page, crf)[0] == "A & B Some bold text of the page. More of it."


def test_elements_without_an_end_tag_do_not_swallow_the_page():
    text = lambda page: [b[0] for b in html_crf.blocks_of(page)]
    for tag in ("<svg width=1 />", "<svg/>", "<math/>", '<iframe src="/x"/>', "<object data=x>", "<canvas>", "<select>", "<video muted/>", "<svg>"):
        assert text(f"<p>One.</p>{tag}<p>Two.</p>") == ["One.", "Two."], tag
    assert text("<p>One.</p><svg/><p>Two.</p><svg><path/>no</svg><p>Three.</p>") == ["One.", "Two.", "Three."]
    assert text("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>") == ["So x=1 holds."]
    assert text("<p>One.</p><noscript><p>Two.</p></noscript><object>Three.</object>") == ["One.", "Two.", "Three."]
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert text(f"<p>One.</p><{tag}>no<p>no") == ["One."]
        assert text(f"<p>One.</p><{tag} a=/x/>no</{tag}><p>Two.</p>") == ["One.", "Two."]


def test_quartiles_are_near_exact_and_the_same_however_rows_are_dealt(spark):
    r = random.Random(4)
    rows = [("en" if i % 3 else "de", f"s{i % 2}", 5, *[0.0 if r.random() < 0.3 else r.expovariate(1 / m) for m in (0.02, 0.1, 0.2, 5, 0.3)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "_lang string, _source string, n_words long, " + ", ".join(f"{m} double" for m in quality_rules.METRICS))
    sk = quality_rules.sketches(df, ("_lang", "_source"))
    got = {(x._lang, x._source): x for x in quality_rules.quartiles(sk, "_lang", "_source").collect()}
    for g in itertools.product(("en", "de"), ("s0", "s1")):
        mine = [x for x in rows if x[:2] == g]
        assert got[g].n == len(mine)
        for k, m in enumerate(quality_rules.METRICS):
            v = sorted(x[3 + k] if x[3 + k] >= quality_rules.LEAST else 0.0 for x in mine)
            for q, have in ((0.25, got[g][m].lo), (0.75, got[g][m].hi)):
                exact = v[math.ceil(len(v) * q) - 1]
                assert abs(have - exact) <= quality_rules.ERROR * exact * 1.001
    lim = [sorted(map(tuple, quality_rules.fences(d).collect())) for d in (df.repartition(7), df.orderBy(F.rand(1)).repartition(2))]
    assert lim[0] == lim[1] and len(lim[0]) == 4


def test_rules_of_empty_tables_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g h i j k", None, "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality_rules.judge(docs).count() == 3 and quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.keep_rows(docs).count() in (0, 3)


def test_und_only_without_a_letter(spark, tmp_path):
    write(spark, tmp_path)
    model = language_id.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    texts = ["\u00aa", "\u3005", "\u2115", "K", "\u00b2 12 \u00bd", "\u2460 \u3000", "", "..."]
    assert [x[0] != "und" for x in language_id.label_texts(texts, model)] == [True] * 4 + [False] * 4


def test_viterbi_equals_all_paths():
    g = np.random.default_rng(2)
    per = np.array([3, 1, 5, 4])
    emit = (g.normal(size=(per.sum(), 3)) * 8).astype(np.float32)
    got, lo = language_id.viterbi(emit, per), 0
    for n in per:
        score = lambda p, lo=lo: sum(float(emit[lo + t, k]) - (language_id.SWITCH if t and p[t - 1] != k else 0) for t, k in enumerate(p))
        assert abs(score(got[lo : lo + n].tolist()) - max(map(score, itertools.product(range(3), repeat=int(n))))) < 1e-3
        lo += n


def test_language_spans_repeats_long_texts_and_empty_table(spark, tmp_path):
    r = random.Random(8)
    say = {"aa": lambda n: " ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(n)), "zz": lambda n: " ".join("".join(r.choice("vwxyz") for _ in range(6)) for _ in range(n))}
    rows = [(i, say[k](50), k, 1) for i in range(60) for k in (("aa", "zz")[i % 2],)] + [(100, say["aa"](40) + " " + say["zz"](20), None, 1), (100, say["zz"](60_000), None, 1), (101, "12", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, k long")
    model = language_id.learn(df)
    got = language_id.identify(df, model, "doc_id", "text").collect()
    assert all(x.lang_pred == ("aa", "zz")[x.doc_id % 2] for x in got if x.doc_id < 60)
    mixed, long_ = sorted((x for x in got if x.doc_id == 100), key=lambda x: len(x.spans), reverse=True)
    assert [(s["lang"], s["first_word"], s["words"]) for s in mixed.spans] == [("aa", 0, 40), ("zz", 40, 20)] and mixed.lang_pred == "aa"
    assert long_.lang_pred == "zz" and long_.score == 1
    assert language_id.identify(df.limit(0), language_id.learn(df.limit(0)), "doc_id", "text").count() == 0
    assert language_id.identify(df, language_id.learn(df.limit(0)), "doc_id", "text").select("lang_pred").distinct().collect()[0][0] == "und"


def test_quality_on_held_out_rows(spark, tmp_path):
    r = random.Random(3)
    good = lambda n: " ".join(r.choice(("the river runs", "a house stands", "people walk home", "light falls slowly")) for _ in range(n))
    bad = lambda n: " ".join(r.choice(("CLICK!! $$$", "### buy now", "%%% free &&&", "win!!! ***")) for _ in range(n))
    rows = [(i, (good if i % 2 else bad)(r.randint(3, 60))) for i in range(400)] + [(900, None), (901, ""), (902, good(9000)), (902, bad(3))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op6_compression_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.97 * len(held) and len(held) > 50
    for labels in ([], [(1, 1)], [(1, 1), (3, 1)]):  # no label, one class
        spark.createDataFrame(labels, "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        assert op6_compression_quality(spark, str(tmp_path)).count() == len(rows)
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert op6_compression_quality(spark, str(tmp_path)).count() == 0


def test_pages_as_a_table(spark, tmp_path):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{}</article><footer>x</footer></body></html>"
    long_ = page.format("<p>" + "Plain words of a long page. " * 4000)
    rows = [(1, "u", None, 1), (2, "u", "", 1), (3, None, page.format("<p>Words of the text here.</p>"), 1), (3, None, page.format("<p>Words of the text here.</p>"), 1), (4, "u", long_, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text long").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((x.page_id, x.text, x.n_chars) for x in html_crf.op1_html_crf(spark, str(tmp_path)).collect()))
    assert got[:2] == [(1, "", 0), (2, "", 0)] and got[2] == got[3] and "Words of the text here." in got[2][1] and got[4][2] > 100_000
    assert all(n == len(t) for _, t, n in got)
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert html_crf.op1_html_crf(spark, str(tmp_path)).count() == 0
