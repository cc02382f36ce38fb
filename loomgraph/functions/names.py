"""Names of concepts: normal form, cache keys, variants, validity, and text similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acronyms with their long forms, and acronyms with their casing.
ACRONYMS = {
    "capm": "capital asset pricing model", "apt": "arbitrage pricing theory", "var": "value at risk", "etf": "exchange traded fund",
    "reit": "real estate investment trust", "ipo": "initial public offering", "roi": "return on investment", "npv": "net present value",
    "irr": "internal rate of return", "wacc": "weighted average cost of capital",
}
CASING = {
    "capm": "CAPM", "var": "VAR", "apt": "APT", "etf": "ETF", "reit": "REIT", "ipo": "IPO", "roi": "ROI", "npv": "NPV", "irr": "IRR",
    "wacc": "WACC", "cvar": "CVaR", "esg": "ESG", "pe": "PE", "pb": "PB", "eps": "EPS",
}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Lower case, white space runs as one blank, outer white space gone; null as ''."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"\s+", " ")


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(squash(c), "[.,;:]+$", "")


def cache_key(connector: Column, name: Column) -> Column:
    return F.concat_ws("_", F.lower(connector), normalize_name(name))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1_000_000)))


def name_variants(c: Column) -> Column:
    """Distinct spellings under which a name may be cached, in alphabetical order."""
    n = normalize_name(c)
    every = F.array(n, F.upper(c), F.lower(c), capitalize(c), F.coalesce(F.try_element_at(literal_map(ACRONYMS), n), F.lit("")))
    return F.array_sort(F.array_remove(F.array_distinct(every), ""))


def is_valid_name(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)).between(2, 200), F.lit(False))


def fix_casing(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CASING), F.lower(strip(c))), c)


def word_set(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(squash(c), " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of white-space word sets: 1 where the squashed texts are equal, 0 where one alone is empty."""
    x, y = word_set(a), word_set(b)
    return (
        F.when(squash(a) == squash(b), 1.0)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    )


def pair_key(a: Column, b: Column) -> Column:
    return F.md5(F.concat_ws("|", F.array_sort(F.array(a, b))).cast("binary"))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")


def sentences(c: Column) -> Column:
    """Trimmed, non-empty pieces between full stops, exclamation and question marks."""
    return F.filter(F.transform(F.split(c, "[.!?]"), strip), lambda s: s != "")


def clean_text(c: Column) -> Column:
    """Blanks squeezed, lines trimmed, empty lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(c, " +", " "), "\n"), strip)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def pack_pages(c: Column, limit: int = 5000) -> Column:
    """Pages of a text: form feeds if any, else triple line breaks, else paragraphs packed until a page passes ``limit`` characters."""
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n\n"), b))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc, p):
        new = join(acc["open"], p)
        full = (F.length(new) > limit) & (acc["open"] != "")
        return F.struct(F.when(full, p).otherwise(new).alias("open"), F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"))

    packed = F.aggregate(F.split(c, "\n\n"), start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return F.when(F.contains(c, F.lit("\f")), F.split(c, "\f")).when(F.contains(c, F.lit("\n\n\n")), F.split(c, "\n\n\n")).otherwise(packed)


def completeness(name: Column, description: Column, definition: Column, symbol: Column, parts: Column) -> Column:
    """How much a concept record says: 2 for a name, a point per 5 words of description, 3 of definition, one for a symbol, and its parts."""
    words = lambda c: F.size(F.array_remove(F.split(squash(c), " "), ""))
    has = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    return (2 * has(name) + F.floor(words(description) / 5) + F.floor(words(definition) / 3) + has(symbol) + parts).cast("long")


def relevance(q: str, name: Column, context: Column, kind: Column, frequency: Column, confidence: Column) -> Column:
    """Search score: name hit, context and type hits, frequency, confidence; at most 1."""
    n, query = F.lower(name), F.lit(q.lower())
    hit = F.when(n == query, 1.0).when(F.contains(n, query), 0.8).when(F.contains(query, n), 0.6).otherwise(0.0)
    more = F.when(F.contains(F.lower(context), query), 0.3).otherwise(0.0) + F.when(F.contains(F.lower(kind), query), 0.2).otherwise(0.0)
    freq = F.when(frequency > 0, F.least(F.lit(0.2), frequency / 10000)).otherwise(0.0)
    return F.least(F.lit(1.0), hit + more + freq + 0.1 * confidence)
