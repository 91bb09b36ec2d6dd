"""Writers: versioned tables published by a pointer, idempotent installs, CSV for spreadsheets, workbooks."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centime.functions.scalars import safe_csv


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, root: str) -> str | None:
    """The published version of a table, that of the latest complete pointer; None before the first."""
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return None
    pointers = sorted(s.getPath().getName() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("CURRENT-"))
    return spark.read.text(f"{root}/{pointers[-1]}").first()["value"] if pointers else None


def publish(df: DataFrame, root: str, by: list[str] | None = None, keep: DataFrame | None = None) -> str:
    """Write a new version aside, then a new pointer: readers see the old table or the new one, never a part or none.

    Pointers are numbered; one appears by a rename to a name that is not there yet,
    which fails if another writer was first (then nothing is published).

    keep: rows that the new version must still have; if one is missing (as a
    multiset), nothing is published.
    """
    spark = df.sparkSession
    version = f"{root}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(version)
    if keep is not None and keep.exceptAll(spark.read.parquet(version).select(*keep.columns)).limit(1).count():
        raise ValueError("the new version lacks rows that must be kept")
    fs, path = _files(spark, root)
    before = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.getPath().getName().startswith("CURRENT-")]
    number = max((int(name.split("-")[1]) for name in before), default=0) + 1
    aside, pointer = path(f"{root}/_{uuid.uuid4().hex}"), path(f"{root}/CURRENT-{number:012d}")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(pointer) or not fs.rename(aside, pointer):
        raise RuntimeError("another version was published meanwhile")
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(version)


def install(new: DataFrame, root: str, key: list[str]) -> int:
    """Add rows whose key is not there yet and publish; repeating it changes nothing. Returns the rows added."""
    spark = new.sparkSession
    once = new.dropDuplicates(key)
    if current(spark, root) is None:
        publish(once, root)
        return read_published(spark, root).count()
    old = read_published(spark, root)
    added = once.join(old.select(*key), key, "left_anti")
    count = added.count()
    if count:
        publish(old.unionByName(added), root, keep=old)
    return count


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, a header, and text that looks like a formula made harmless."""
    shown = df.select(*(safe_csv(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
    shown.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def csv_bytes(df: DataFrame, most: int = 100_000) -> bytes:
    """A small result as one CSV with a byte order mark; larger results go to write_csv."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def show(value: object) -> str:
        text = "" if value is None else str(value)
        if isinstance(value, str) and text.lstrip()[:1] in ("=", "+", "-", "@"):
            text = "'" + text
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ';"\n\r') else text

    lines = [";".join(df.columns), *(";".join(show(v) for v in r) for r in rows)]
    return "﻿".encode() + "\r\n".join([*lines, ""]).encode()


def write_ordered_json(df: DataFrame, path: str, order: str) -> None:
    """JSON lines in total order over all files, gzip."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("compression", "gzip").json(path)


def xlsx_bytes(sheets: dict[str, DataFrame], most: int = 100_000) -> bytes:
    """A workbook of small results: numbers as numbers, nulls as blank cells."""
    names = list(sheets)
    out = io.BytesIO()
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    package = "http://schemas.openxmlformats.org/package/2006"

    def cell(value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool) or not isinstance(value, int | float):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        rels = 'ContentType="application/vnd.openxmlformats-package.relationships+xml"'
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" {rels}/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{space}" xmlns:r="{relation}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="r{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{linked}</Relationships>')
        for i, name in enumerate(names, 1):
            rows = sheets[name].limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"more than {most} rows")
            body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in [sheets[name].columns, *rows])
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{space}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
