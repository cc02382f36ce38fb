"""Text and metadata of HTML, XML, LaTeX and MathML, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import clean_text

DROPPED = ("script", "style", "nav", "header", "footer", "aside")
# Strings that speak for a type of document.
HTML_SIGNS = ("<!doctype html", "<html", "<head>", "<body>", "<div", "<p>", "<script", "<style", "<meta", "<link")
XML_SIGNS = ("<?xml", "<root", "xmlns:", "xsi:", "<config", "<data")
LATEX_SIGNS = ("\\documentclass", "\\begin{document}", "\\usepackage", "\\section", "\\chapter", "\\title", "\\author", "\\maketitle")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def html_text(c: Column) -> Column:
    """Text without scripts, styles, menus, headers, footers, asides, comments and adverts; a line per block."""
    c = sub(c, r"(?s)<!--.*?-->", "")
    for t in DROPPED:
        c = sub(c, rf"(?is)<{t}[ >].*?</{t}>", "")
    # One of the names must be a whole word of the attribute's list.
    names = "(?:advertisement|ads?|sidebar|navigation|banner)"
    c = sub(c, rf"(?is)<(?:div|section)[ ](?:[^>]*[ ])?(?:class|id)=[\"'](?:[^\"'>]*[ ])?{names}(?:[ ][^\"'>]*)?[\"'][^>]*>.*?</(?:div|section)>", "")
    c = F.coalesce(F.nullif(F.regexp_extract(c, r"(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), c)
    c = sub(sub(c, r"(?i)</(?:p|div|h[1-6]|li)>|<br[^>]*>|<p>", "\n"), r"<[^>]+>", "")
    return clean_text(unescape(c))


def title(c: Column) -> Column:
    return unescape(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def html_lang(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)<html[^>]* lang=.([A-Za-z-]+)", 1)


def meta(c: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(c, rf'(?i)<meta[^>]+(?:name|property)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def headings(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep, level, n, text): the headings of each level in order."""
    def at(i: int):
        return lambda x: F.struct(F.lit(i).alias("level"), x.alias("text"))

    levels = [F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<h{i}[^>]*>(.*?)</h{i}>"), 1), at(i)) for i in range(1, 7)]
    d = df.select(*keep, F.posexplode(F.flatten(F.array(*levels))).alias("n", "h"))
    return d.select(*keep, "h.level", "n", unescape(F.trim(sub(F.col("h.text"), "<[^>]+>", ""))).alias("text"))


def links(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """(keep, href, internal): a link without a host, or to an anchor, is internal."""
    d = df.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]* href="([^"]*)"'), 1)).alias("href"))
    return d.withColumn("internal", ~F.regexp_like("href", F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*://|^//")))


def signs(c: Column, words) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def detect(content: Column, path: Column | None = None, least: int = 2) -> Column:
    """Type by extension, else by leading bytes, else by the most signs (html before xml before latex), else unknown."""
    low = F.lower(F.substring(content, 1, 10_000))
    h, x, t = signs(low, HTML_SIGNS), signs(low, XML_SIGNS), signs(low, LATEX_SIGNS)
    top = F.greatest(h, x, t)
    by_text = F.when(F.startswith(content, F.lit("%PDF")), "pdf").when(F.startswith(content, F.lit("PK\x03\x04")), "zip").when(top < least, "unknown").when(h == top, "html").when(x == top, "xml").otherwise("latex")
    if path is None:
        return by_text
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"htm": "html", "html": "html", "xml": "xml", "tex": "latex", "latex": "latex", "pdf": "pdf", "docx": "docx", "epub": "epub"}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), ext), by_text)


# Commands whose text stays, and headings with the name they get.
LATEX_COMMANDS = [(rf"\\(?:textbf|textit|emph|texttt|underline)\{{([^}}]+)\}}", "$1")] + [(rf"\\{c}\{{([^}}]+)\}}", f"{p}{c.upper()}: $1\n") for c, p in (("title", ""), ("author", ""), ("date", ""), ("chapter", "\n\n"), ("section", "\n\n"), ("subsection", "\n\n"), ("subsubsection", "\n\n"), ("paragraph", "\n\n"))]


def latex_text(c: Column, math: str = "placeholder", cite: str = "expand") -> Column:
    """Body text: comments cut, maths and citations by mode, sections named, other commands dropped, quotes and dashes set."""
    body = F.regexp_extract(c, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    c = F.when(body != "", body).otherwise(c)
    c = sub(c, r"(?m)(?<!\\)%.*$", "")
    if math != "preserve":
        for p, name in ((r"(?s)\\begin\{equation\}.*?\\end\{equation\}", "[EQUATION]"), (r"(?s)\\begin\{align\}.*?\\end\{align\}", "[ALIGNED EQUATIONS]"), (r"(?s)[$][$].*?[$][$]", "[DISPLAY MATH]"), (r"[$][^$]*?[$]", "[MATH]")):
            c = sub(c, p, name if math == "placeholder" else "")
    for k, name in (("cite", "CITE"), ("ref", "REF")):
        c = sub(c, rf"\\{k}\{{([^}}]+)\}}", {"expand": f"[{name}: $1]", "remove": "", "preserve": "$0"}[cite])
    for p, by in LATEX_COMMANDS:
        c = sub(c, p, by)
    c = sub(sub(c, r"\\item", "\n• "), r"\\([&%$#_{}])", "$1")
    c = sub(sub(sub(c, r"\\\\", "\n"), "---", "—"), "--", "–")
    c = sub(sub(sub(c, "``|''", '"'), r"\\[a-zA-Z]+\*?\{([^}]*)\}", "$1"), r"\\[a-zA-Z]+\*?", "")
    return clean_text(sub(sub(c, "[{}]", ""), "~", " "))


def latex_meta(df: DataFrame, text: str, *keep: str) -> DataFrame:
    one = lambda k: F.nullif(F.regexp_extract(text, rf"\\{k}(?:\[[^\]]*\])?\{{([^}}]+)\}}", 1), F.lit(""))
    cites = F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\\cite\{([^}]+)\}"), 1), lambda x: F.split(x, ","))), F.trim)
    packs = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\\usepackage(?:\[[^\]]*\])?\{([^}]+)\}"), 1))), ",")
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return df.select(
        *keep, one("documentclass").alias("document_class"), one("title").alias("title"), one("author").alias("author"), packs.alias("packages"),
        F.size(cites).cast("long").alias("citations"), F.size(F.array_distinct(cites)).cast("long").alias("unique_citations"),
        n(r"\\section\{").alias("sections"), n(r"\\begin\{figure").alias("figures"), n(r"\\begin\{table").alias("tables"), n(r"\\begin\{").alias("environments"),
    )


def xml_text(c: Column) -> Column:
    """Text content with a line per element."""
    c = sub(sub(c, r"(?s)<!--.*?-->|<\?.*?\?>", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return clean_text(unescape(sub(c, "<[^>]+>", "\n")))


def xml_elements(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    d = df.select(*keep, F.explode(F.regexp_extract_all(xml, F.lit(r"<([A-Za-z_][A-Za-z0-9_.:-]*)"), 1)).alias("element"))
    return d.groupBy(*keep, "element").agg(F.count("*").alias("n"))


def mathml_latex(c: Column) -> Column:
    """Fractions, powers and indexes of single elements to LaTeX; other tags dropped."""
    leaf = r"<m[ino]>([^<]*)</m[ino]>"
    c = sub(c, rf"<mfrac>\s*{leaf}\s*{leaf}\s*</mfrac>", r"\\frac{$1}{$2}")
    c = sub(c, rf"<msup>\s*{leaf}\s*{leaf}\s*</msup>", "$1^{$2}")
    c = sub(c, rf"<msub>\s*{leaf}\s*{leaf}\s*</msub>", "$1_{$2}")
    return F.trim(sub(sub(c, "<[^>]+>", " "), " +", " "))


def doi(*fields: Column) -> Column:
    """The DOI of the first field that holds one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(f, r"(10\.[0-9]{4,9}/[A-Za-z0-9._;()/:-]+)", 1), F.lit("")) for f in fields])


def file_title(path: Column) -> Column:
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.trim(F.element_at(F.split(F.replace(base, F.lit("_"), F.lit(" ")), r"\("), 1))


def file_year(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit(""))
