"""File sources and sinks: collection by extension, zipped formats, the extractor registry, graph JSON."""

from __future__ import annotations

import html.parser
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("pdf", "html", "htm", "docx", "xml", "tex", "latex", "epub", "txt")


def glob_regex(pattern: str) -> str:
    """A glob of * and ? as a regular expression over a whole name."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def ignored(path, patterns: tuple[str, ...]):
    """Whether a path, or its last part, fits one of the globs."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(path, F.lit(glob_regex(p))) | F.regexp_like(F.element_at(F.split(path, "/"), -1), F.lit(glob_regex(p)))
    return out


def collect(spark: SparkSession, root: str, extensions=SUPPORTED, max_mb: int = 100, ignore: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of the supported files; sizes are filtered before contents are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return df.where((F.col("length") <= max_mb << 20) & ext.isin(*extensions) & ~ignored(F.col("path"), ignore))


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _tidy(s: str) -> str:
    return "\n".join(x for x in (re.sub(" +", " ", y).strip() for y in s.split("\n")) if x)


def docx_text(raw: bytes) -> str:
    """Paragraphs, tables included, with page breaks marked."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{w}p"):
        text = "".join("[PAGE BREAK]" if n.tag == f"{w}br" and n.get(f"{w}type") == "page" else (n.text or "") for n in p.iter() if n.tag in (f"{w}t", f"{w}br"))
        if text.strip():
            out.append(text)
    return _tidy("\n".join(out))


def epub_text(raw: bytes) -> str:
    """Chapters in spine order, each under its number and title."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        opf = ET.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        package = ET.fromstring(z.read(opf))
        base = opf.rpartition("/")[0]
        href = {i.get("id"): i.get("href") for i in package.iterfind(".//{*}item")}
        parts = []
        for n, ref in enumerate(package.iterfind(".//{*}itemref"), 1):
            page = z.read(f"{base}/{href[ref.get('idref')]}".lstrip("/")).decode("utf-8", "replace")
            t = _Text()
            t.feed(page)
            name = re.search(r"(?is)<title>(.*?)</title>|<h1[^>]*>(.*?)</h1>", page)
            parts.append(f"[CHAPTER {n}: {(name[1] or name[2]).strip() if name else ''}]\n{_tidy(''.join(t.out))}")
    return "\n[CHAPTER BREAK]\n".join(parts)


def epub_metadata(raw: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        opf = ET.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        package = ET.fromstring(z.read(opf))
    meta = {k: e.text for k in ("title", "creator", "language", "publisher", "date", "identifier") if (e := package.find(f".//{{http://purl.org/dc/elements/1.1/}}{k}")) is not None and e.text}
    return {**meta, "items": str(len(package.findall(".//{*}item"))), "spine": str(len(package.findall(".//{*}itemref")))}


def html_plain(raw: bytes) -> str:
    t = _Text()
    t.feed(raw.decode("utf-8", "replace"))
    return _tidy("".join(t.out))


def xml_plain(raw: bytes) -> str:
    return _tidy("\n".join(ET.fromstring(raw).itertext()))


class Registry:
    """Extractors by name; the first that handles an extension is used. Types without a library here (PDF) are plugged in."""

    def __init__(self):
        self.items: dict[str, tuple[tuple[str, ...], Callable[[bytes], str]]] = {}
        for name, exts, f in (("docx", ("docx",), docx_text), ("epub", ("epub",), epub_text), ("html", ("html", "htm"), html_plain), ("xml", ("xml",), xml_plain), ("text", ("txt", "tex", "latex"), lambda b: b.decode("utf-8", "replace"))):
            self.register(name, exts, f)

    def register(self, name: str, extensions: tuple[str, ...], extract: Callable[[bytes], str]) -> bool:
        """False, and no change, where the name is taken."""
        if not callable(extract):
            raise TypeError("an extractor is a function of bytes")
        if name in self.items:
            return False
        self.items[name] = (tuple(e.lower().lstrip(".") for e in extensions), extract)
        return True

    def unregister(self, name: str) -> bool:
        return self.items.pop(name, None) is not None

    def extensions(self) -> list[str]:
        return sorted({e for exts, _ in self.items.values() for e in exts})

    def find(self, path: str) -> str | None:
        ext = path.rpartition(".")[2].lower()
        return next((n for n, (exts, _) in self.items.items() if ext in exts), None)

    def extract(self, files: DataFrame) -> DataFrame:
        """(path, extractor, text, error) of files with content; a file that fails keeps its row and says why."""
        items, find = self.items, self.find

        def run(it):
            for pdf in it:
                rows = []
                for path, content in zip(pdf["path"], pdf["content"]):
                    name = find(path)
                    try:
                        rows.append((path, name, items[name][1](bytes(content)) if name else None, None if name else "no extractor"))
                    except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                        rows.append((path, name, None, f"{type(e).__name__}: {e}"[:300]))
                yield pd.DataFrame(rows, columns=["path", "extractor", "text", "error"])

        return files.select("path", "content").mapInPandas(run, "path string, extractor string, text string, error string")


CONCEPT = "struct<name:string,type:string,description:string,domain:string,complexity_level:string,prerequisites:array<string>,keywords:array<string>,confidence:double,frequency:int,context:string,source_docs:array<string>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(concepts, relationships) of a graph file: an object of concepts by id and an array of edges."""
    schema = f"concepts map<string,{CONCEPT}>, relationships array<struct<source:string,target:string,type:string,confidence:double>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    concepts = raw.select(F.explode("concepts").alias("id", "c")).select("id", "c.*")
    return concepts, raw.select(F.explode("relationships").alias("r")).select(F.col("r.source").alias("src"), F.col("r.target").alias("dst"), "r.type", "r.confidence")


def write_text(df: DataFrame, path: str, text: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, kind: str = "json") -> None:
    """json, csv, parquet, or tab-separated values."""
    w = df.write.mode("overwrite")
    {"json": lambda: w.json(path), "csv": lambda: w.csv(path, header=True), "tsv": lambda: w.csv(path, header=True, sep="\t"), "parquet": lambda: w.parquet(path)}[kind]()


def graphml(edges: DataFrame):
    """One GraphML edge element a row."""
    esc = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return edges.select(F.format_string('<edge source="%s" target="%s" label="%s"/>', esc("src"), esc("dst"), esc("type")).alias("value"))


def unprocessed(files: DataFrame, outputs: DataFrame, key: str = "path") -> DataFrame:
    return files.join(outputs.select(key), key, "left_anti")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays as text."""
    from pyspark.sql import types as T

    def walk(schema, at, name):
        for f in schema.fields:
            c, n = (f"{at}.`{f.name}`" if at else f"`{f.name}`"), (f"{name}{sep}{f.name}" if name else f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, c, n)
            else:
                yield (F.array_join(F.col(c).cast("array<string>"), ",") if isinstance(f.dataType, T.ArrayType) else F.col(c)).alias(n)

    return df.select(*walk(df.schema, "", ""))
