"""Personal data by bootstrapped contextual extraction (native: DataFrame functions only).

Seed entities (four regular expressions with checks, and long hexadecimal strings in quotes that
something is set to: secrets) induce lexical patterns: the word or the two words to the left of an
entity, or the word to its right. Patterns and instances form a bipartite graph whose scores are
iterated; patterns of high confidence then mark further tokens of a fitting shape as identifiers.
Secrets, too, are marked by such patterns only.

Defined cases: null text counts as empty and has no spans; repeated rows each get their row (a row
number, not the id, keys the work); empty tables give empty results; other columns are ignored.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans; the last is never a base span.
ORDER = (*KINDS, "secret")
_SP = r"\x20\x09-\x0D"
#: The contract's expressions, made linear: a match can start only where a run of its first class
#: does (or where the last match ended), and loops that never need to give back are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATES = {"email": "instr(_t, '@') > 0", "ip": r"_t rlike '[0-9]\\.[0-9]'", "card": "_t rlike '[0-9]'", "phone": "instr(_t, '+') > 0"}
CANDIDATE = rf"(?<![^{_SP}])[^{_SP}]*?[0-9@][^{_SP}]*+"
#: Shapes that a discovered identifier of a kind may have, after outer punctuation is cut.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}([.:][0-9A-Fa-f]{1,4}){3,7}$",
    "card": r"^[0-9]{4}([ -]?[0-9]){9,15}$",
    "phone": r"^[(+]?[0-9][0-9().-]{5,17}[0-9]$",
    "secret": r"^[0-9A-Za-z_+/=.-]{16,}$",
}
#: A seed of a secret, and what stands right before it.
SECRET, SECRET_BEFORE = r"^[0-9a-f]{32,}$", r"[=:] ?[\x22\x27]$"
ROUNDS = 3
MIN_CONFIDENCE = 0.6
MIN_SEEDS = 3
SALTS = 16


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(pattern: str, gate: str) -> str:
    """SQL: segments of ``_t``, alternately outside and inside a match (``_t`` holds no \\x01)."""
    return f"case when {gate} then split(regexp_replace(_t, {_quote('(' + pattern + ')')}, '\\u0001$1\\u0001'), '\\u0001') else array(_t) end"


def _spans(segs: str) -> str:
    """SQL: (start, end, text) of the inside segments. Starts are sums of blocks of 128 lengths and a rest, so long texts stay near linear."""
    return f"""transform(filter(sequence(0, size({segs}) - 1), k -> k % 2 = 1), k -> named_struct(
        's', aggregate(slice({segs}_b, 1, k div 128), 0, (a, x) -> a + x) + aggregate(slice({segs}_n, (k div 128) * 128 + 1, k % 128), 0, (a, x) -> a + x),
        'n', {segs}_n[k], 'x', {segs}[k]))"""


def _luhn(x: str) -> str:
    return f"""aggregate(sequence(1, length({x})), 0, (a, i) -> a + case when i % 2 = 1 then int(substr({x}, length({x}) - i + 1, 1))
        else int(substr('0246813579', int(substr({x}, length({x}) - i + 1, 1)) + 1, 1)) end) % 10 = 0"""


_DIGITS = "regexp_replace(m.x, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": r"m.x rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.]|$)){4}$'",
    "card": f"length({_DIGITS}) between 16 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``: array of (o, kind, s, e, x) by kind then start, and ``cands``: (s, e, x, l, r) other tokens with a digit or @."""
    keep = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    for c in ("\x01", "\x02"):
        t = F.replace(t, F.lit(c), F.lit("\x03"))
    d = df.withColumn("_t", t)
    names = (*KINDS, "cand")
    d = d.select(*keep, "_t", *[F.expr(_matches(PATTERNS[k], GATES[k])).alias(f"_{k}") for k in KINDS],
                 F.expr(_matches(CANDIDATE, "_t rlike '[0-9@]'")).alias("_cand"))
    d = d.select("*", *[F.expr(f"transform(_{k}, x -> length(x))").alias(f"_{k}_n") for k in names])
    d = d.select("*", *[F.expr(f"transform(filter(sequence(0, size(_{k}_n) - 1), i -> i % 128 = 0), i -> aggregate(slice(_{k}_n, i + 1, 128), 0, (a, x) -> a + x))").alias(f"_{k}_b") for k in names])
    parts = [
        f"transform(filter({_spans('_' + k)}, m -> {_VALID[k]}), m -> named_struct('o', {i}, 'kind', '{k}', 's', m.s, 'e', m.s + m.n, 'x', lower(m.x)))"
        for i, k in enumerate(KINDS)
    ]
    one = f"concat({', '.join(parts)})"
    cand = f"""transform({_spans("_cand")}, m -> named_struct('s', m.s, 'e', m.s + m.n, 'x', m.x))"""
    d = d.select(*keep, "_t", F.expr(one).alias("base"), F.expr(cand).alias("_c"))
    # Outer punctuation goes from a candidate; one that touches a base span is no candidate.
    trim = """transform(_c, c -> named_struct('s', c.s + length(regexp_extract(c.x, '^[^0-9A-Za-z+(]*', 0)),
        'x', regexp_replace(regexp_replace(c.x, '^[^0-9A-Za-z+(]+', ''), '[^0-9A-Za-z]+$', '')))"""
    d = d.withColumn("_c", F.expr(trim))
    free = "filter(_c, c -> length(c.x) > 0 and not exists(base, b -> c.s < b.e and c.s + length(c.x) > b.s))"
    d = d.withColumn("_c", F.expr(free))
    gap = r"[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]{{0,3}}$"
    before = "lower(substr(_t, greatest(1, {s} - 39), least(40, {s})))"
    left = rf"regexp_extract({before}, '([^\\x20\\x09-\\x0D]+){gap}', 1)"
    two = rf"regexp_extract({before}, '([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+){gap}', 1)"
    right = r"regexp_extract(lower(substr(_t, {e} + 1, 40)), '^[^\\x20\\x09-\\x0D]{{0,3}}[\\x20\\x09-\\x0D]+([^\\x20\\x09-\\x0D]+)', 1)"
    around = lambda s, e: f"'l', {left.format(s=s)}, 'm', {two.format(s=s)}, 'r', {right.format(e=e)}"
    seed = f"case when lower(c.x) rlike {_quote(SECRET)} and substr(_t, greatest(1, c.s - 2), least(3, c.s)) rlike {_quote(SECRET_BEFORE)} then 'secret' end"
    return d.select(
        *keep,
        F.expr(f"transform(base, b -> named_struct('o', b.o, 'kind', b.kind, 's', b.s, 'e', b.e, 'x', b.x, {around('b.s', 'b.e')}))").alias("base"),
        F.expr(f"transform(_c, c -> named_struct('kind', {seed}, 's', c.s, 'e', c.s + length(c.x), 'x', lower(c.x), {around('c.s', '(c.s + length(c.x))')}))").alias("cands"),
    )


def _contexts(row: str) -> str:
    return f"filter(array(concat('L ', {row}.l), concat('M ', {row}.m), concat('R ', {row}.r)), p -> length(p) > 2)"


def score_patterns(found: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that clear both thresholds.

    Edges are counted once per distinct (pattern, instance) before anything iterates; a pattern's
    score is the mean score of its instances (with one doubtful instance added), an instance's the
    best of its patterns; seeds stay at 1.
    """
    seeds = found.select(F.explode("base").alias("b")).select(F.explode(F.expr(_contexts("b"))).alias("p"), F.col("b.x").alias("x"), F.col("b.kind").alias("kind"))
    others = found.select(F.explode("cands").alias("c")).select(F.explode(F.expr(_contexts("c"))).alias("p"), F.col("c.x").alias("x"), F.col("c.kind").alias("kind"))
    edges = materialise(seeds.union(others).groupBy("p", "x").agg(F.max("kind").alias("kind")), "edges")
    # Patterns without a seed can score only through instances they share with others.
    good = materialise(edges.where("kind is not null").select("x", "kind", F.lit(1.0).alias("w")).groupBy("x").agg(F.max("kind").alias("kind"), F.max("w").alias("w")), "inst")
    seeds_of = edges.where("kind is not null").groupBy("p", F.col("kind").alias("k")).agg(F.count("*").alias("seeds"))
    size = edges.groupBy("p").agg(F.count("*").alias("n"))
    for r in range(ROUNDS):
        per = (
            edges.select("p", "x")
            .join(good, "x")
            .groupBy("p", "kind")
            .agg(F.sum("w").alias("w"))
            .join(size, "p")
            .select("p", "kind", (F.col("w") / (F.col("n") + 1)).alias("conf"))
        )
        per = materialise(per, "patterns")
        if r == ROUNDS - 1:
            break
        salted = per.where(F.col("conf") >= MIN_CONFIDENCE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        new = (
            edges.where("kind is null")
            .withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
            .join(salted.withColumnRenamed("kind", "k"), ["p", "salt"])
            .where(_fits("x", "k"))
            .groupBy("x")
            .agg(F.max_by("k", "conf").alias("kind"), F.max("conf").alias("w"))
        )
        good = materialise(good.where("w = 1").union(new.select("x", "kind", "w")).groupBy("x").agg(F.max_by("kind", "w").alias("kind"), F.max("w").alias("w")), "inst")
    return per.join(seeds_of.withColumnRenamed("k", "kind"), ["p", "kind"]).where((F.col("conf") >= MIN_CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS)).select("p", "kind", "conf")


def _fits(x: str, kind: str):
    return F.expr("case " + " ".join(f"when {kind} = '{k}' then {x} rlike {_quote(v)}" for k, v in SHAPES.items()) + " else false end")


def find(df: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    """One row per row of ``df``: the ``carry`` columns, ``base`` and ``spans`` (arrays of (o, kind, s, e))."""
    found = materialise(base_spans(df.select(*carry, F.col(text).alias("_text")), "_text").drop("_text").withColumn("_row", F.monotonically_increasing_id()), "found")
    known = materialise(score_patterns(found.select("base", "cands")), "known").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    occ = (
        found.where("size(cands) > 0")
        .select("_row", F.explode("cands").alias("c"))
        .select("_row", "c.s", "c.e", "c.x", F.explode(F.expr(_contexts("c"))).alias("p"), F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    order = F.expr("case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(ORDER)) + " end")
    new = (
        occ.join(known, ["p", "salt"])
        .where(_fits("x", "kind"))
        .groupBy("_row", "s", "e")
        .agg(F.max_by("kind", "conf").alias("kind"))
        .groupBy("_row")
        .agg(F.collect_list(F.struct(order.alias("o"), "kind", "s", "e")).alias("new"))
    )
    base = F.expr("transform(base, b -> named_struct('o', b.o, 'kind', b.kind, 's', b.s, 'e', b.e))")
    found = found.withColumn("base", base).drop("cands")
    # Written, so that its size is known: the join broadcasts it while that is small, and sorts both sides beyond.
    joined = found.join(materialise(new, "discovered"), "_row", "left")
    return joined.select(*carry, "base", F.array_sort(F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new"))).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by the kind in brackets; overlapping spans go by the first."""
    # The row travels as one struct, so that none of its columns can clash with ours.
    found = find(df.select(F.struct("*").alias("_doc")), f"_doc.`{text}`", ("_doc",))
    t = f"_doc.`{text}`"
    cut = f"""aggregate(array_sort(transform(spans, x -> struct(x.s, x.e, x.kind))), named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, x) -> case when x.s < a.at then named_struct('at', greatest(a.at, x.e), 'out', a.out)
            else named_struct('at', x.e, 'out', concat(a.out, array(substr({t}, a.at + 1, x.s - a.at), concat('[', upper(x.kind), ']')))) end,
        a -> concat(array_join(a.out, ''), substr({t}, a.at + 1)))"""
    new = F.when(F.size("spans") > 0, F.expr(cut)).otherwise(F.col(t))
    return found.select(*[new.alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in df.columns])


def said(spans: str):
    return F.array_join(F.expr(f"transform({spans}, b -> concat(b.kind, ':', b.s, ':', b.e))"), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), "text", ("doc_id",))
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    n_found = F.size("spans").cast("long")
    return found.select("doc_id", *counts, F.sha2(said("base").cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"), n_found.alias("n_spans"), (n_found - F.size("base")).alias("n_discovered"))
