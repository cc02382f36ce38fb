"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Per document a few shape metrics are computed inside the row. Mergeable quantile sketches of the
metrics, counts in buckets of fixed relative width, are built per (language, source), merged to
languages and to the whole corpus, and turned into outlier fences. Buckets only ever add up, so a
quantile is within ERROR of the exact one and the same however the rows are dealt or merged; a group too small to trust takes the fence of its language, then of the
corpus. Documents are joined with their group's fences and filtered.

Defined cases: null or empty text has no words and fails the base rule; null lang or source form
groups of their own; repeated rows each get their row; values on a fence stay (ties); texts of any
length are measured whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import FILTER_BITS, WORD_SPLIT, materialise, table

METRICS = ("symbol_ratio", "upper_ratio", "dup_line_ratio", "mean_word", "repeat_ratio")
#: Least width of the box (upper quartile less lower quartile) per metric, so that a group of
#: uniform clean texts does not reject its first deviation.
LEAST_BOX = {"symbol_ratio": 0.02, "upper_ratio": 0.06, "dup_line_ratio": 0.15, "mean_word": 0.75, "repeat_ratio": 0.06}
FENCE = 3.0
#: Relative error of a sketch's quantiles; ratios below LEAST count as zero, which bounds the buckets of a metric to some 1,500.
ERROR = 0.005
LEAST = 1e-4
MIN_GROUP = 100
#: The fences are broadcast up to so many groups (five doubles each); beyond it the join is salted.
BROADCAST_GROUPS = 20_000
SALTS = 32
BLOCK_WORDS = 512


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long).

    Repeated 5-word windows are found inside the row: window hashes, and only where their distinct
    count falls short, a sort of (hash, position). No row leaves its task.
    """
    keep = docs.columns
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_w", F.array_remove(F.split("_t", WORD_SPLIT), ""))
    d = d.withColumn("_l", F.expr("filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    d = d.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("_t", "[A-Z]")) - 1).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "_h",
    )
    d = d.withColumn(
        "_g",
        F.expr("case when size(_h) > 5 then transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i+1], _h[i+2], _h[i+3], _h[i+4])) end"),
    )
    d = d.withColumn("_s", F.expr("case when size(array_distinct(_g)) < size(_g) then sort_array(transform(_g, (h, i) -> struct(h, i))) end"))
    d = d.withColumn(
        "_p",
        F.expr("sort_array(transform(filter(_s, (s, k) -> get(_s, k - 1).h = s.h or get(_s, k + 1).h = s.h), s -> s.i))"),
    )
    return d.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines",
        F.expr("coalesce(aggregate(_p, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + 5 - greatest(a.e, p), 'e', p + 5), a -> a.n), 0L)").alias("n_repeat_words"),
    )


def with_metrics(stats: DataFrame) -> DataFrame:
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / chars,
            "upper_ratio": F.col("n_upper") / chars,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "mean_word": F.col("word_chars") / words,
            "repeat_ratio": F.col("n_repeat_words") / words,
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def bucket(x):
    """Bucket of a value: the power of its relative width that reaches it; null for zero."""
    return F.when(x >= LEAST, F.ceil(F.log(x) / math.log((1 + ERROR) / (1 - ERROR))).cast("int"))


def bucket_value(b):
    """The value within ERROR of all of a bucket's."""
    base = (1 + ERROR) / (1 - ERROR)
    return F.coalesce(F.pow(F.lit(base), b) * (2 / (base + 1)), F.lit(0.0))


def sketches(metrics: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """(groups, metric, bucket, n): the sketches of every group."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("e")
    return metrics.where("n_words > 0").select(*groups, each).select(*groups, "e.*").groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *groups: str) -> DataFrame:
    """One row per group: n, and lower and upper quartile of every metric as struct (lo, hi)."""
    w = Window.partitionBy(*groups, "metric")
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("all", F.sum("n").over(w)).withColumn("value", bucket_value(F.col("bucket")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("value")))
    one = ranked.groupBy(*groups, "metric").agg(F.max("all").alias("n"), F.struct(at(0.25).alias("lo"), at(0.75).alias("hi")).alias("box"))
    return one.groupBy(*groups).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.col("box"))).alias(m) for m in METRICS])


def fences(metrics: DataFrame, groups: tuple[str, str] = ("_lang", "_source")) -> DataFrame:
    """One row per group: the fence of every metric, from the sketch of the smallest trusted level."""
    lang, source = groups
    fine = materialise(sketches(metrics, groups), "sketches")
    total = F.sum("n").alias("n")
    mid = fine.groupBy(lang, "metric", "bucket").agg(total)
    top = mid.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))

    def named(df: DataFrame, p: str, *key: str) -> DataFrame:
        return df.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("n", *METRICS)])

    levels = named(quartiles(fine, lang, source), "f", lang, source).join(named(quartiles(mid, lang), "m", lang), lang)
    j = levels.crossJoin(F.broadcast(named(quartiles(top), "t")))
    out = [F.col(lang), F.col(source)]
    for m in METRICS:
        k = F.when(F.col("f_n") >= MIN_GROUP, F.col(f"f_{m}")).when(F.col("m_n") >= MIN_GROUP, F.col(f"m_{m}")).otherwise(F.col(f"t_{m}"))
        box = F.greatest(k["hi"] - k["lo"], F.lit(LEAST_BOX[m]))
        out += [(k["hi"] + FENCE * box).alias(f"{m}_hi"), (k["lo"] - FENCE * box).alias(f"{m}_lo")]
    return j.select(*out)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", salt: str = "doc_id") -> DataFrame:
    """Every row of (salt, lang, source, text) with its statistics, base_failed and kept.

    The statistics are written once and serve both the sketches and the verdicts.
    """
    d = docs.select(
        F.col(salt),
        F.col(text).alias("_text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("\x00")).alias("_lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("_source"),
    )
    stats = materialise(text_stats(d, "_text").drop("_text"), "stats")
    m = with_metrics(stats)
    lim = materialise(fences(m), "fences")
    return verdict(m, lim, salt)


def verdict(m: DataFrame, lim: DataFrame, salt: str) -> DataFrame:
    """``m`` with kept: inside the fences of its group, and not failed by the base rule."""
    if lim.count() <= BROADCAST_GROUPS:
        j = m.join(F.broadcast(lim), ["_lang", "_source"], "left")
    else:
        salted = lim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = m.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["_lang", "_source", "_salt"], "left")
    inside = F.lit(True)
    for x in METRICS:
        inside = inside & (F.col(x) <= F.col(f"{x}_hi"))
    inside = inside & (F.col("mean_word") >= F.col("mean_word_lo"))
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def _bitmap(numbers: DataFrame, col: str) -> DataFrame:
    """(block, words): a bitmap of numbers below 2^FILTER_BITS, in arrays of BLOCK_WORDS words of 64 bits."""
    word = F.shiftright(col, 6)
    some = numbers.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({col} & 63 as int))")).alias("x"))
    block = some.groupBy(F.expr(f"w div {BLOCK_WORDS}").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"w % {BLOCK_WORDS}"), "x"))).alias("m"))
    return block.select("block", F.expr(f"transform(sequence(0L, {BLOCK_WORDS - 1}L), i -> coalesce(m[i], 0L))").alias("words"))


def keep_rows(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", salt: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept. Only rows that a bitmap (4 MB at most) says may go have their statistics computed a second time; no text is shuffled."""
    cols = docs.columns
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    # A row's number is the same in both scans; rows of equal numbers are judged one by one.
    number = F.pmod(F.xxhash64(F.col(salt), group(lang), group(source), F.col(text)), F.lit(1 << FILTER_BITS))
    names = {"_k": number, "_text": F.col(text), "_lang": group(lang), "_source": group(source)}
    d = docs.select(F.struct(*cols).alias("_row"), *[c.alias(k) for k, c in names.items()])
    first = with_metrics(materialise(text_stats(d.drop("_row"), "_text").drop("_text"), "stats"))
    lim = materialise(fences(first), "fences")
    gone = materialise(_bitmap(verdict(first, lim, "_k").where("not kept"), "_k"), "gone")
    d = d.withColumn("block", F.expr(f"shiftright(_k, 6) div {BLOCK_WORDS}")).join(F.broadcast(gone), "block", "left")
    bit = F.expr(f"coalesce(shiftright(words[cast(shiftright(_k, 6) % {BLOCK_WORDS} as int)], cast(_k & 63 as int)) & 1, 0) = 1")
    d = d.withColumn("_may", bit).drop("block", "words").withColumn("_text", F.when(F.col("_may"), F.col("_text")))
    # The row number holds the filter above the statistics: pushed into them it would repeat their expressions without end.
    stats = text_stats(d, "_text").drop("_text").withColumn("_at", F.monotonically_increasing_id())
    return verdict(with_metrics(stats), lim, "_k").where("(not _may or kept) and _at >= 0").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
