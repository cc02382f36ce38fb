"""Parts that no table query reaches: zipped formats, the registry, chunk rules, flattening."""

import io
import zipfile

from loomgraph.functions import mathtext as M
from loomgraph.operators.chunks import embed, split_recursive
from loomgraph.sources import files
from loomgraph.sources.markup import latex_text


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def test_docx_and_epub():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f'<w:document {w}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>next</w:t></w:r></w:p></w:body></w:document>'
    assert files.docx_text(zipped({"word/document.xml": doc})) == "One two\n[PAGE BREAK]next"
    opf = '<package xmlns="o"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>'
    epub = zipped({"META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="x/p.opf"/></rootfiles></container>', "x/p.opf": opf, "x/a.html": "<title>Intro</title><p>Hi  there</p><script>no</script>"})
    assert files.epub_text(epub) == "[CHAPTER 1: Intro]\nIntroHi there"
    assert files.epub_metadata(epub) == {"title": "T", "items": "1", "spine": "1"}


def test_registry(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p><p>y</p>")
    (tmp_path / "b.xml").write_text("<a><b>broken</a>")
    (tmp_path / "c.pdf").write_text("%PDF")
    (tmp_path / "skip.tmp").write_text("no")
    r = files.Registry()
    assert not r.register("html", ("x",), str) and r.find("p/A.HTM") == "html"
    got = {x.path.rpartition("/")[2]: x for x in r.extract(files.collect(spark, str(tmp_path), ignore=("*.tmp",))).collect()}
    assert set(got) == {"a.html", "b.xml", "c.pdf"}
    assert got["a.html"].text == "x\ny" and got["b.xml"].error.startswith("ParseError") and got["c.pdf"].error == "no extractor"


def test_recursive_splitter():
    text = "para one words " * 30 + "\n\n" + "word " * 200
    spans = split_recursive(text)
    assert all(b - a <= 500 for a, b in spans) and len(spans) >= 3
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    assert split_recursive("") == [] and split_recursive("x" * 1200)[-1][1] == 1200


def test_embedding_and_flatten(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(70)], "id long, text string")
    got = {r.id: list(r.embedding) for r in embed(df, "id", "text", lambda ts: [[len(t), 1] for t in ts], 2).collect()}
    assert got[69] == [69.0, 1.0] and len(got) == 70
    f = files.flatten(spark.sql("select struct(1 as x, struct(array('p', 'q') as z) as y) as m, 2 as n"))
    assert f.first().asDict() == {"m_x": 1, "m_y_z": "p,q", "n": 2}


def test_latex(spark):
    df = spark.createDataFrame([("\\begin{document}\\section{Intro}A \\textbf{b} $x$ \\cite{k}. % no\n\nC \\& d -- e~f\\end{document}",)], "t string")
    assert df.select(latex_text(df.t)).first()[0] == "SECTION: Intro\nA b [MATH] [CITE: k].\nC & d – e f"
    assert spark.sql("select 'x1 = α/b' as t").select(M.to_latex(__import__("pyspark").sql.functions.col("t"))).first()[0].startswith("$x_{1} = ")


def test_graph_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"concepts": {"a": {"name": "A", "type": "metric", "confidence": 0.9}}, "relationships": [{"source": "a", "target": "b", "type": "contains", "confidence": 0.9}]}')
    c, e = files.read_graph(spark, str(tmp_path / "g.json"))
    assert c.first().name == "A" and e.first().dst == "b"
