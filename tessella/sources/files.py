"""Document files as rows: plain text, spreadsheets' and word processors' XML, and lists of queries."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.session import ship_package

#: Extensions of documents, and those that are read as plain text.
EXTENSIONS = ["pdf", "doc", "docx", "txt", "md", "markdown", "xlsx", "xls", "csv"]
PLAIN = ["txt", "md", "markdown", "csv"]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def document_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, length, modified) of the documents below a folder, in the order of paths; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", ext.alias("ext"), "length", F.col("modificationTime").alias("modified")).where(F.col("ext").isin(EXTENSIONS)).orderBy("path")


def _paragraph_level(p: ElementTree.Element) -> int:
    style = p.find(f"{W}pPr/{W}pStyle")
    m = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{W}val", "") if style is not None else "")
    return int(m[1]) if m else 0


def _table_rows(table: ElementTree.Element) -> list[str]:
    rows = [["".join(t.text or "" for t in c.iter(f"{W}t")).replace("|", "\\|") for c in r.iter(f"{W}tc")] for r in table.iter(f"{W}tr")]
    width = max((len(r) for r in rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return lines[:1] + ["|" + " --- |" * width] + lines[1:] if lines else []


def docx_text(data: bytes) -> str:
    """Text of a word-processing file: headings with #, tables as Markdown, pages ended by form feeds."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[str] = []
    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            text = "".join(t.text or "" for t in e.iter(f"{W}t")).strip()
            breaks = sum(b.get(f"{W}type") == "page" for b in e.iter(f"{W}br")) + len(list(e.iter(f"{W}lastRenderedPageBreak")))
            if breaks:
                out.append("\f" * breaks)
            if text:
                out.append("#" * _paragraph_level(e) + " " * bool(_paragraph_level(e)) + text)
        elif e.tag == f"{W}tbl":
            out += _table_rows(e)
    return "\n".join(out)


S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_text(data: bytes) -> str:
    """Text of a spreadsheet's first sheet: a line per row that has a value, cells between tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in root.iter(f"{S}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        rows = ElementTree.fromstring(z.read(sheet)).iter(f"{S}row")
        out = []
        for row in rows:
            cells: dict[int, str] = {}
            for i, c in enumerate(row.iter(f"{S}c")):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else i
                v = c.find(f"{S}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif v is not None and v.text:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            if any(x.strip() for x in cells.values()):
                out.append("\t".join(cells.get(i, "") for i in range(max(cells) + 1)))
        return "\n".join(out)


#: Extension to reader of bytes.
READERS = {"docx": docx_text, "xlsx": xlsx_text} | dict.fromkeys(PLAIN, lambda data: data.decode("utf-8", "ignore"))


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, text, error): plain files as UTF-8 without what isn't, word-processing files and spreadsheets by their XML.

    A file that can't be read has a null text and its error; other formats say that a reader is
    missing. Blank documents are dropped.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))

    def load(frames):
        for f in frames:
            out = []
            for path, kind, data in zip(f["path"], f["ext"], f["content"], strict=True):
                try:
                    if kind in READERS:
                        out.append((path, kind, READERS[kind](bytes(data)), None))
                    else:
                        out.append((path, kind, None, f"no reader for {kind}"))
                except Exception as e:  # one damaged file must not end the load
                    out.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "ext", "text", "error"])

    rows = files.select("path", ext.alias("ext"), "content").where(F.col("ext").isin(EXTENSIONS))
    got = rows.mapInPandas(load, "path string, ext string, text string, error string")
    return got.where(F.col("error").isNotNull() | (strip(F.col("text")) != ""))


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, stripped, without blank ones."""
    return spark.read.text(path).select(strip(F.col("value")).alias("query")).where("query <> ''")


def write_answers(rows: DataFrame, path: str) -> None:
    """Batch results as JSON lines where the path ends in .json, else as CSV with a header."""
    (rows.write.json(path) if path.endswith(".json") else rows.write.option("header", "true").csv(path))
