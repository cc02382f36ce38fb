"""Documents of the web and of typesetting, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import chunks as C
from loomgraph.plans.common import frame, table, values
from loomgraph.sources import markup as H

TEX = values("id, text", [
    (1, "\\documentclass{article}\\usepackage{amsmath}\\usepackage[utf8]{inputenc}\\title{On Risk}\\author{A. Author}\\begin{document}\\section{Intro}Some \\textbf{bold} text with $x^2$ and \\cite{a,b}. % note\nNext \\& last -- done.\\end{document}".replace("\\", "~")),
    (2, "\\documentclass[11pt]{book}\\usepackage{b}\\usepackage{a}\\begin{document}\\begin{equation}a=b\\end{equation}\\cite{a}\\begin{figure}x\\end{figure}\\begin{table}y\\end{table}\\end{document}".replace("\\", "~"))])
XML = values("id, text", [(1, "<?xml version=1?><root><concept type=metric><name>Sharpe</name><description>Return &amp; risk</description></concept><!-- c --></root>"), (2, "<data><v>1</v><v>2</v><w>x</w></data>")])
MML = values("id, text", [(1, "<math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>"), (2, "<math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msub><mi>y</mi><mi>i</mi></msub></math>"), (3, "<mi>z</mi>")])
FILES = values("path, title, subject", [("/d/Markowitz_1952 (copy).pdf", "doi:10.1111/j.1540-6261.1952.tb01525.x", ""), ("/d/sub/Sharpe_Ratio_1966.html", "", "see 10.2307/2351741 there"), ("notes.tex", "", ""), ("/x/Old2020Report.docx", "none", "none")])
MARK = values("id, body", [(1, "see [MATHREF_b1] @portfolio_theory: and [MATHREF_b2] @ratio:"), (2, "plain"), (3, "[MATHREF_z9] only")])
TAGS = [r"<!--[\s\S]*?-->", *[rf"(?i)<{t}[ >][\s\S]*?</{t}>" for t in H.DROPPED], r"(?i)<(?:div|section)[ ](?:[^>]*[ ])?(?:class|id)=[\x22\x27](?:[^\x22\x27>]*[ ])?(?:advertisement|ads|ad|sidebar|navigation|banner)(?:[ ][^\x22\x27>]*)?[\x22\x27][^>]*>[\s\S]*?</(?:div|section)>"]


def nested(c: str, subs: list[tuple[str, str]]) -> str:
    for p, by in subs:
        c = f"regexp_replace({c}, '{p}', {by}, 'g')"
    return c


MAIN = nested("html", [(p, "''") for p in TAGS])
BODY = r"coalesce(nullif(regexp_extract(h, '(?is)<(?:main|article)[^>]*>(.*?)</(?:main|article)>', 1), ''), nullif(regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1), ''), h)"
BLOCKS = nested(BODY, [(r"(?i)</(?:p|div|h[1-6]|li)>|<br[^>]*>|<p>", "chr(10)"), ("<[^>]+>", "''")])


def unescape(c: str) -> str:
    for a, b in H.ENTITIES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


HTML = rf"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace({unescape(BLOCKS)}, ' +', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM (SELECT page_id, {MAIN} AS h FROM pages)"
HEADS = " UNION ALL ".join(rf"SELECT page_id, {i} AS level, unnest(regexp_extract_all(html, '(?is)<h{i}[^>]*>(.*?)</h{i}>', 1)) AS t, {i} * 1000 + generate_subscripts(regexp_extract_all(html, '(?is)<h{i}[^>]*>(.*?)</h{i}>', 1), 1) AS o FROM pages" for i in range(1, 7))
LOW = "lower(substr({c}, 1, 10000))"


def sign(c: str, words) -> str:
    return "(" + " + ".join(f"contains({LOW.format(c=c)}, '{w}')::INT" for w in words) + ")"


def kind(c: str) -> str:
    h, x, t = sign(c, H.HTML_SIGNS), sign(c, H.XML_SIGNS), sign(c, H.LATEX_SIGNS)
    return f"CASE WHEN greatest({h}, {x}, {t}) < 2 THEN 'unknown' WHEN {h} = greatest({h}, {x}, {t}) THEN 'html' WHEN {x} = greatest({h}, {x}, {t}) THEN 'xml' ELSE 'latex' END"


COS = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def tex(s):
    return frame(s, TEX).withColumn("text", F.replace("text", F.lit("~"), F.lit("\\")))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


QUERIES = {
    "html_text": (lambda s, d: table(s, d, "pages").select("page_id", H.html_text(F.col("html")).alias("text")), HTML),
    "html_title_lang": (lambda s, d: table(s, d, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.html_lang(F.col("html")).alias("lang")), f"SELECT page_id, {unescape('trim(regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1))')} AS title, regexp_extract(html, '(?i)<html[^>]* lang=.([A-Za-z-]+)', 1) AS lang FROM pages"),
    "html_headings": (lambda s, d: H.headings(table(s, d, "pages"), "html", "page_id"), f"SELECT page_id, level, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INT) AS n, {unescape('trim(regexp_replace(t, ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '))')} AS text FROM ({HEADS})"),
    "html_links": (lambda s, d: H.links(table(s, d, "pages"), "html", "page_id"), "SELECT page_id, href, NOT regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://|^//') AS internal FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]* href=\"([^\"]*)\"', 1)) AS href FROM pages)"),
    "html_meta": (lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("html", '(?i)<meta charset="([^"]*)"', 1).alias("charset"), H.meta(F.col("html"), "description").alias("description")), "SELECT page_id, regexp_extract(html, '(?i)<meta charset=\"([^\"]*)\"', 1) AS charset, nullif(regexp_extract(html, '(?i)<meta[^>]+(?:name|property)=\"description\"[^>]+content=\"([^\"]*)\"', 1), '') AS description FROM pages"),
    "html_type_detect": (lambda s, d: table(s, d, "pages").select("page_id", H.detect(F.col("html")).alias("kind")).union(table(s, d, "documents").select("doc_id", H.detect(F.col("text")))), f"SELECT page_id, {kind('html')} AS kind FROM pages UNION ALL SELECT doc_id, {kind('text')} FROM documents"),
    "type_by_path": (lambda s, d: frame(s, FILES).select("path", H.detect(F.col("title"), F.col("path")).alias("kind")), f"SELECT path, CASE lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'tex' THEN 'latex' WHEN 'docx' THEN 'docx' END AS kind FROM {FILES}"),
    "latex_text": (lambda s, d: tex(s).select("id", H.latex_text(F.col("text")).alias("text")), None),
    "latex_meta": (lambda s, d: H.latex_meta(tex(s), "text", "id"), r"""SELECT id, regexp_extract(text, '~documentclass(?:\[[^\]]*\])?\{([^}]+)\}', 1) AS document_class, nullif(regexp_extract(text, '~title\{([^}]+)\}', 1), '') AS title, nullif(regexp_extract(text, '~author\{([^}]+)\}', 1), '') AS author,
 array_to_string(list_sort(list_distinct(regexp_extract_all(text, '~usepackage(?:\[[^\]]*\])?\{([^}]+)\}', 1))), ',') AS packages, len(string_split(array_to_string(regexp_extract_all(text, '~cite\{([^}]+)\}', 1), ','), ',')) AS citations, len(list_distinct(string_split(array_to_string(regexp_extract_all(text, '~cite\{([^}]+)\}', 1), ','), ','))) AS unique_citations,
 len(regexp_extract_all(text, '~section\{')) AS sections, len(regexp_extract_all(text, '~begin\{figure')) AS figures, len(regexp_extract_all(text, '~begin\{table')) AS tables, len(regexp_extract_all(text, '~begin\{')) AS environments FROM """ + TEX),
    "xml_text": (lambda s, d: frame(s, XML).select("id", H.xml_text(F.col("text")).alias("text")), f"SELECT id, array_to_string(list_filter(string_split({unescape(nested('text', [('(?s)<!--.*?-->|<[?].*?[?]>', chr(39) * 2), ('<[^>]+>', 'chr(10)')]))}, chr(10)), lambda x: x <> ''), chr(10)) AS text FROM {XML}"),
    "xml_element_counts": (lambda s, d: H.xml_elements(frame(s, XML), "text", "id"), f"SELECT id, element, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '<([A-Za-z_][A-Za-z0-9_.:-]*)', 1)) AS element FROM {XML}) GROUP BY ALL"),
    "mathml_latex": (lambda s, d: frame(s, MML).select("id", H.mathml_latex(F.col("text")).alias("latex")), "SELECT id, latex FROM (VALUES (1, '\\frac{a}{b}'), (2, 'x^{2} + y_{i}'), (3, 'z')) AS t(id, latex)"),
    "doi_extract": (lambda s, d: frame(s, FILES).select("path", H.doi(F.col("title"), F.col("subject")).alias("doi")), f"SELECT path, coalesce(nullif(regexp_extract(title, '(10[.][0-9]{{4,9}}/[A-Za-z0-9._;()/:-]+)', 1), ''), nullif(regexp_extract(subject, '(10[.][0-9]{{4,9}}/[A-Za-z0-9._;()/:-]+)', 1), '')) AS doi FROM {FILES}"),
    "title_year": (lambda s, d: frame(s, FILES).select("path", H.file_title(F.col("path")).alias("title"), H.file_year(F.col("path")).alias("year")), f"SELECT path, trim(string_split(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][A-Za-z0-9]+$', ''), '_', ' '), '(')[1]) AS title, nullif(regexp_extract(path, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS year FROM {FILES}"),
    "chunks_fixed": (lambda s, d: C.fixed(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "start", "end", F.md5(F.col("body").cast("binary")).alias("digest")), "SELECT doc_id, CAST(k AS INT) AS chunk, CAST(k * 450 AS BIGINT) AS start, CAST(least(k * 450 + 500, length(text)) AS BIGINT) AS \"end\", md5(substr(text, CAST(k * 450 + 1 AS BIGINT), 500)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS k FROM documents WHERE length(text) > 0)"),
    "chunks_recursive": (lambda s, d: C.recursive(table(s, d, "documents"), "doc_id", "text"), None),
    "chunk_math_meta": (lambda s, d: C.markers(frame(s, MARK)).drop("body"), f"SELECT id, len(regexp_extract_all(body, 'MATHREF_')) AS math_block_count, array_to_string(regexp_extract_all(body, 'MATHREF_([A-Za-z0-9_]+)', 1), ',') AS math_block_ids, array_to_string(list_sort(list_distinct(regexp_extract_all(body, '@([a-z_]+):', 1))), ',') AS semantic_groups, contains(body, 'MATHREF_') AS has_math FROM {MARK}"),
    "vector_topk": (lambda s, d: C.top_k(vectors(s, d), vectors(s, d).where("id % 100 = 0"), 5), f"SELECT q, id, similarity FROM (SELECT q.vec_id AS q, v.vec_id AS id, {COS}::DOUBLE AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.vec_id) AS n FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE n <= 5"),
    "vector_upsert": (lambda s, d: C.upsert(vectors(s, d).select("id", F.lit("old").alias("from")), vectors(s, d).where("id % 3 = 0").select("id", F.lit("new").alias("from"))), "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS \"from\" FROM embeddings"),
}
