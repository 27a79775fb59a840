"""Files as tables: discovery, listings, CSV, plain text, word-processor and slide documents.

Discovery and content reads are Spark's `binaryFile` scans, so any file system that Spark reaches will do and
filters on path and length prune before contents are read.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_TYPES, TABULAR_TYPES = ("pdf", "docx", "pptx", "txt", "md"), ("csv", "xlsx", "xls")
#: What an upload may have, and what Spark's binaryFile reads into a row.
MAX_BYTES, ROW_BYTES = 100 * 1024 * 1024, 2_000_000_000


def file_type(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_tabular(kind: Column) -> Column:
    return kind.isin(*TABULAR_TYPES)


def discover(spark: SparkSession, folder: str, types: tuple[str, ...] = DOCUMENT_TYPES + TABULAR_TYPES, content: bool = False) -> DataFrame:
    """id, file_path, file_name, file_type, length, modified, is_tabular and, with content, file_hash and content of all files under a folder.

    No row can hold the content of a file over ROW_BYTES: such a file is listed with a null hash and content.
    """
    glob = "*.{" + ",".join(x for t in types for x in (t, t.upper())) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    path = F.col("path")
    fields = [
        F.substring(F.sha2(path, 256), 1, 32).alias("id"), path.alias("file_path"), F.element_at(F.split(path, "/"), -1).alias("file_name"), file_type(path).alias("file_type"),
        "length", F.col("modificationTime").alias("modified"), is_tabular(file_type(path)).alias("is_tabular"),
    ]
    if not content:
        return rows.select(*fields)
    held = rows.where(F.col("length") <= ROW_BYTES).select(*fields, F.sha2("content", 256).alias("file_hash"), "content")
    return held.unionByName(rows.where(F.col("length") > ROW_BYTES).select(*fields, F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("binary").alias("content")))


def upload_error(name: Column, length: Column) -> Column:
    """Why a file may not be uploaded under a name (its type, `..` in it, over MAX_BYTES); null if it may."""
    known = F.coalesce(file_type(name).isin(*DOCUMENT_TYPES, *TABULAR_TYPES), F.lit(False))
    big = F.lit(f"File too large (max {MAX_BYTES // 1024 // 1024}MB)")
    return F.when(~known, "Unsupported file type").when(name.contains(".."), "Invalid path").when(length > MAX_BYTES, big)


def listing(files: DataFrame, documents: DataFrame, folder: str) -> DataFrame:
    """The entries right under a folder, folders first, then by name without case, with the documents' status."""
    rest = F.substring_index(F.substring("file_path", F.lit(len(folder.rstrip("/")) + 2), F.length("file_path")), "/", 1)
    inside = files.where(F.col("file_path").startswith(folder.rstrip("/") + "/"))
    deep = F.instr(F.substring("file_path", F.lit(len(folder.rstrip("/")) + 2), F.length("file_path")), "/") > 0
    entries = inside.groupBy(rest.alias("name"), deep.alias("is_dir")).agg(F.sum("length").alias("length"), F.min("id").alias("id"))
    status = documents.select("id", "processing_status")
    return entries.join(status, "id", "left").select("name", "is_dir", "length", F.when(~F.col("is_dir"), F.col("processing_status")).alias("processing_status")).orderBy(~F.col("is_dir"), F.lower("name"))


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1", "UTF-16"), rows: int | None = None) -> DataFrame:
    """A CSV file with a header and inferred types, in the first encoding whose sample decodes without replacement signs."""
    for e in encodings:
        df = spark.read.csv(path, header=True, inferSchema=True, encoding=e)
        sample = "".join(df.columns) + "".join(str(r) for r in df.limit(50).collect())
        if "\ufffd" not in sample and "\x00" not in sample:
            break
    return df if rows is None else df.limit(rows)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _table(rows: list[list[str]]) -> str:
    """A pipe table; bars in cells are escaped."""
    rows = [[c.replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in rows if r]
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def docx_markdown(data: bytes) -> str:
    """Body paragraphs and tables in order; heading styles become #, list styles - or 1."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body if body is not None else []:
        if e.tag == f"{_W}tbl":
            out.append(_table([[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]))
        elif e.tag == f"{_W}p" and text(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
            level = re.match(r"heading([1-6])", name)
            mark = "#" * int(level[1]) + " " if level else "# " if name == "title" else "1. " if name.startswith("listnumber") else "- " if name.startswith("list") else ""
            out.append(mark + text(e))
    return "\n\n".join(filter(None, out))


def pptx_markdown(data: bytes) -> str:
    """A section for each slide: its title, paragraphs as bullets, tables, and the speaker's notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    paragraphs = lambda e: [s for p in e.iter(f"{_A}p") if (s := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        root = ElementTree.fromstring(z.read(name))
        title, body = "", []
        for shape in root.iter(f"{_P}sp"):
            kind = shape.find(f".//{_P}nvPr/{_P}ph")
            lines = paragraphs(shape)
            if kind is not None and kind.get("type") in ("title", "ctrTitle") and lines and not title:
                title = " ".join(lines)
            else:
                body += [f"- {x}" for x in lines]
        if not title and body and len(body[0]) < 202:
            title = body.pop(0)[2:]
        tables = [_table([[" ".join(paragraphs(c)) for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")]) for t in root.iter(f"{_A}tbl")]
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        said = paragraphs(ElementTree.fromstring(z.read(notes))) if notes in z.namelist() else []
        out.append("\n\n".join(filter(None, [f"## Slide {number(name)}: {title}".rstrip(": "), "\n".join(body), *tables, "> Notes: " + " ".join(said) if said else ""])))
    return "\n\n".join(out)


def decoded(data: bytes) -> str:
    """The text of bytes with a mark of their encoding, in UTF-8, or else in ISO-8859-1."""
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return data.decode("utf-16")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("iso-8859-1")


def csv_markdown(data: bytes) -> str:
    """All rows as a pipe table."""
    csv.field_size_limit(2**31 - 1)
    return _table(list(csv.reader(io.StringIO(decoded(data), newline=""))))


@dataclass(frozen=True)
class Registry:
    """Readers by file type: content -> markdown."""

    readers: dict[str, Callable[[bytes], str]]

    def supports(self, kind: str) -> bool:
        return kind.lower() in self.readers

    def parse(self, files: DataFrame) -> DataFrame:
        """files (id, file_type, content) -> id, markdown, error; types without a reader and files that fail say so."""
        readers = self.readers

        @F.pandas_udf("struct<markdown:string,error:string>")
        def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
            out = []
            for k, c in zip(kind, content, strict=True):
                if c is None:
                    out.append((None, "no content"))
                    continue
                try:
                    out.append((readers[k](bytes(c)), None) if k in readers else (None, f"no reader for {k}"))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"[:500]))
            return pd.DataFrame(out, columns=["markdown", "error"])

        return files.withColumn("_r", run("file_type", "content")).select("id", "_r.markdown", "_r.error")


def default_registry() -> Registry:
    """Word, slides, CSV and plain text; PDF and spreadsheets need a library of the caller's."""
    plain = lambda b: b.decode("utf-8", "replace")
    readers: dict[str, Callable[[bytes], str]] = {"docx": docx_markdown, "pptx": pptx_markdown, "csv": csv_markdown, "txt": plain, "md": plain}
    try:
        import openpyxl  # noqa: F401

        readers["xlsx"] = lambda b: "\n\n".join(f"## {n}\n\n" + _table([list(map(str, d.columns)), *d.astype(str).values.tolist()]) for n, d in pd.read_excel(io.BytesIO(b), sheet_name=None).items())
    except ImportError:
        pass
    return Registry(readers)
