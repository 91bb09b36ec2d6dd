"""Readers of published files: HTML tables, workbooks, archives, delimited and statistical files.

Binary files come in through the binaryFile source, one row a file; each is
parsed where it is read, in Arrow batches, and gives many rows. A file that can't
be read gives one row with its error instead of failing the job.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one unpacked member of an archive, at most; larger ones are reported, not read.
MEMBER_BYTES = 512 * 1024 * 1024


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content and sha256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def kind_of(content: Column) -> Column:
    """pdf, zip, xls, html, xml or text, by the first bytes."""
    head = F.substring(content, 1, 8)
    start = F.lower(F.trim(F.substring(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), 1, 64)))
    return (
        F.when(F.substring(head, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8"), "pdf")
        .when(F.substring(head, 1, 4) == F.unhex(F.lit("504B0304")), "zip")
        .when(head == F.unhex(F.lit("D0CF11E0A1B11AE1")), "xls")
        .when(start.startswith("<!doctype html") | start.startswith("<html"), "html")
        .when(start.startswith("<?xml"), "xml")
        .otherwise("text")
    )


class _Tables(HTMLParser):
    """Tables of a page as rows of cell texts, with spans repeated; a table that holds another one is layout."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.tables: list[dict] = []
        self.links: list[tuple[str, str]] = []
        self.link: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            if self.open:
                self.open[-1]["layout"] = True
            self.open.append({"rows": [], "layout": False, "cell": None})
        elif tag == "a" and a.get("href"):
            self.link = [a["href"], ""]
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            table = self.open[-1]
            if not table["rows"]:
                table["rows"].append([])
            span = a.get("colspan", "1")
            table["cell"] = {"text": "", "span": int(span) if span.isdigit() and 0 < int(span) < 200 else 1, "head": tag == "th"}
            table["rows"][-1].append(table["cell"])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())
        elif tag in ("td", "th") and self.open:
            self.open[-1]["cell"] = None
        elif tag == "a" and self.link:
            self.links.append((self.link[0], " ".join(self.link[1].split())))
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"]["text"] += data
        if self.link:
            self.link[1] += data


def html_cells(page: str, strict: bool = False) -> Iterator[tuple[int, int, int, bool, str]]:
    """(table, row, column, header, text) of all cells of data tables; strict: a nested table is an error."""
    parser = _Tables()
    parser.feed(page)
    parser.close()
    for no, table in enumerate(t for t in [*parser.tables, *parser.open] if not t["layout"] or strict):
        if table["layout"]:
            raise ValueError("nested table")
        for r, row in enumerate(table["rows"]):
            column = 0
            for cell in row:
                for _ in range(cell["span"]):
                    yield no, r, column, cell["head"], " ".join(cell["text"].split())
                    column += 1


def html_links(page: str) -> list[tuple[str, str]]:
    parser = _Tables()
    parser.feed(page)
    return parser.links


_NS = re.compile(r"^\{[^}]*\}")


def _local(tag: str) -> str:
    return _NS.sub("", tag)


# Number formats that workbooks use by number alone.
BUILTIN = {
    "1": "0", "2": "0.00", "3": "#,##0", "4": "#,##0.00", "9": "0%", "10": "0.00%", "11": "0.00E+00", "12": "# ?/?", "13": "# ??/??", "14": "mm-dd-yy", "15": "d-mmm-yy",
    "16": "d-mmm", "17": "mmm-yy", "18": "h:mm AM/PM", "19": "h:mm:ss AM/PM", "20": "h:mm", "21": "h:mm:ss", "22": "m/d/yy h:mm", "37": "#,##0_);(#,##0)", "38": "#,##0_);[Red](#,##0)",
    "39": "#,##0.00_);(#,##0.00)", "40": "#,##0.00_);[Red](#,##0.00)", "45": "mm:ss", "46": "[h]:mm:ss", "47": "mmss.0", "48": "##0.0E+0", "49": "@",
}


def xlsx_cells(content: bytes) -> Iterator[tuple[str, str, str | None, str | None, str | None]]:
    """(sheet, cell, raw, format, formula) of all cells with content, from the parts of the workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())

        def tree(name: str) -> ElementTree.Element:
            return ElementTree.fromstring(book.read(name))

        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in tree("xl/sharedStrings.xml") if _local(item.tag) == "si"]
        formats: list[str] = []
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            codes = {n.get("numFmtId"): n.get("formatCode") for n in styles.iter() if _local(n.tag) == "numFmt"}
            for xfs in styles:
                if _local(xfs.tag) == "cellXfs":
                    formats = [codes.get(x.get("numFmtId")) or BUILTIN.get(x.get("numFmtId") or "0", "General") for x in xfs]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in tree("xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in tree("xl/workbook.xml").iter() if _local(s.tag) == "sheet"):
            ident = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            target = targets.get(ident, "")
            part = target if target.startswith("xl/") else "xl/" + target
            if part not in names:
                continue
            for cell in (c for c in tree(part).iter() if _local(c.tag) == "c"):
                value = formula = inline = None
                for child in cell:
                    if _local(child.tag) == "v":
                        value = child.text
                    elif _local(child.tag) == "f":
                        formula = child.text
                    elif _local(child.tag) == "is":
                        inline = "".join(t.text or "" for t in child.iter() if _local(t.tag) == "t")
                if cell.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                value = inline if inline is not None else value
                if value is not None or formula is not None:
                    style = int(cell.get("s") or 0)
                    yield sheet.get("name") or "", cell.get("r") or "", value, formats[style] if style < len(formats) else "General", formula


def archive_members(content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(name, size, content) of the files of a zip archive; absolute names, '..', links and very large members raise."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            parts = info.filename.replace("\\", "/").split("/")
            if info.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
                raise ValueError(f"unsafe name {info.filename!r}")
            if (info.external_attr >> 16) & 0o170000 == 0o120000:
                raise ValueError(f"link {info.filename!r}")
            if info.file_size > MEMBER_BYTES:
                raise ValueError(f"too large {info.filename!r}")
            yield info.filename, info.file_size, archive.read(info)


def observations(content: bytes) -> Iterator[tuple[str, str]]:
    """(period, value) of the Obs elements of a statistical message."""
    for node in ElementTree.fromstring(content).iter():
        if _local(node.tag) == "Obs":
            yield node.get("TIME_PERIOD") or "", node.get("OBS_VALUE") or ""


def _each(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(path, *row, None) for row in parse(content)]
                except Exception as error:  # noqa: BLE001 - a bad file is a row, not a failure
                    rows.append((path, *[None] * len(names), f"{type(error).__name__}: {error}"[:300]))
            yield pd.DataFrame(rows, columns=["path", *names, "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def html_tables(files: DataFrame, strict: bool = False) -> DataFrame:
    """Cells of all tables of HTML files: path, table_index, row_index, column_index, header, text, error."""

    def parse(content: bytes) -> Iterator[tuple]:
        return html_cells(content.decode("utf-8", "replace"), strict)

    return _each(files, parse, "table_index int, row_index int, column_index int, header boolean, text string", ["table_index", "row_index", "column_index", "header", "text"])


def workbook_cells(files: DataFrame) -> DataFrame:
    return _each(files, xlsx_cells, "sheet string, cell string, raw string, format string, formula string", ["sheet", "cell", "raw", "format", "formula"])


def unpacked(files: DataFrame) -> DataFrame:
    return _each(files, archive_members, "name string, size bigint, member binary", ["name", "size", "member"])


def price_indices(files: DataFrame) -> DataFrame:
    return _each(files, observations, "period string, value string", ["period", "value"])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or plain, with a given schema; broken lines are null rows in _corrupt."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def delimited(spark: SparkSession, path: str, separator: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with header; names folded to plain identifiers, all values text."""
    read = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("mode", "PERMISSIVE").csv(path)
    seen: dict[str, int] = {}
    names = []
    for name in read.columns:
        plain = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "column"
        seen[plain] = seen.get(plain, 0) + 1
        names.append(plain if seen[plain] == 1 else f"{plain}_{seen[plain]}")
    return read.toDF(*names)


def gunzip(content: bytes) -> bytes:
    return gzip.decompress(content)
