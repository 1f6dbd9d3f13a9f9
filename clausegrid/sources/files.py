"""Readers: file names to formats, text, DOCX and PDF bytes to paragraphs.

All readers give one row a paragraph: keys, idx, text (normalised), raw, style, list_id, list_lvl,
in_table, tbl, tbl_row, tbl_col. Files that cannot be read give no paragraphs but a row of errors.
"""

from __future__ import annotations

import io
import shutil
import subprocess
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions import text as T

# Suffixes by format, the size of an upload, and the time an extractor may take.
TEXT_SUFFIXES = [".txt", ".md", ".markdown", ""]
MAX_BYTES, PDF_SECONDS = 32 << 20, 60
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPH = "idx int, raw string, style string, list_id int, list_lvl int, in_table boolean, tbl int, tbl_row int, tbl_col int"
_COLUMNS = [f.split()[0] for f in PARAGRAPH.split(", ")]
_PLAIN = {"style": "", "list_id": 0, "list_lvl": 0, "in_table": False, "tbl": 0, "tbl_row": 0, "tbl_col": 0}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def file_format(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".docx", "docx").when(s == ".pdf", "pdf").when(s.isin(TEXT_SUFFIXES), "text").otherwise("unsupported")


def text_paragraphs(docs: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One paragraph a line; blank lines count, but not those at the end."""
    lines = F.split(F.replace(F.coalesce(F.col(content).cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    raw = F.transform(lines, lambda x: F.regexp_replace(x, r"[ \t]+$", ""))
    normal = F.transform(raw, lambda x: F.struct(x.alias("raw"), T.normalize(x).alias("text")))
    # The last line with text is where a document ends.
    full = F.filter(F.transform(normal, lambda x, i: F.when(x["text"] != "", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(full), F.lit(-1))
    rows = docs.select(*keys, F.posexplode(F.slice(normal, F.lit(1), last + 1)).alias("idx", "x"))
    return rows.select(*keys, "idx", "x.text", "x.raw")


class _Cursor:
    """Where in nested tables the parser stands; tables count through the document."""

    def __init__(self) -> None:
        self.tables, self.open = 0, []

    def enter(self, tag: str) -> None:
        if tag == "tbl":
            self.tables += 1
            self.open.append([self.tables, 0, 0])
        elif self.open and tag == "tr":
            self.open[-1][1:] = [self.open[-1][1] + 1, 0]
        elif self.open and tag == "tc":
            self.open[-1][2] += 1

    def leave(self, tag: str) -> None:
        if tag == "tbl" and self.open:
            self.open.pop()

    def place(self) -> tuple[int, int, int]:
        return tuple(self.open[-1]) if self.open else (0, 0, 0)


def docx_paragraphs(data: bytes) -> list[dict]:
    """Paragraphs of a DOCX as they read with all tracked changes accepted."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a DOCX file") from e
    if "word/document.xml" not in archive.namelist():
        raise ValueError("no word/document.xml in the file")
    out: list[dict] = []
    now: dict | None = None
    hidden = 0
    cursor = _Cursor()

    def close() -> None:
        nonlocal now
        if now is not None:
            out.append(now | {"idx": len(out), "raw": now["raw"].strip()})
            now = None

    with archive.open("word/document.xml") as file:
        for event, element in ElementTree.iterparse(file, ("start", "end")):
            if not element.tag.startswith(_W):
                continue
            tag = element.tag[len(_W) :]
            value = lambda name="val": element.get(_W + name)  # noqa: E731, B023
            if event == "start":
                cursor.enter(tag)
                if tag == "p":
                    t, r, c = cursor.place()
                    now = {"raw": "", "style": "", "list_id": 0, "list_lvl": 0, "in_table": t > 0, "tbl": t, "tbl_row": r, "tbl_col": c}
                elif tag in ("del", "instrText", "deleted"):
                    hidden += 1
                elif now is not None and not hidden:
                    if tag == "tab":
                        now["raw"] += "\t"
                    elif tag in ("br", "cr"):
                        now["raw"] += " "
                    elif tag == "pStyle":
                        now["style"] = value() or ""
                    elif tag in ("numId", "ilvl"):
                        now["list_id" if tag == "numId" else "list_lvl"] = int(value() or 0)
            else:
                cursor.leave(tag)
                if tag == "t" and now is not None and not hidden:
                    now["raw"] += element.text or ""
                elif tag in ("del", "instrText", "deleted"):
                    hidden -= 1
                elif tag == "p":
                    close()
                    element.clear()
    close()
    return out


def pdf_text(data: bytes, tool: str = "pdftotext", seconds: int = PDF_SECONDS) -> str:
    """Text of a PDF by an external tool, where one is installed."""
    if not shutil.which(tool):
        raise ValueError(f"{tool} is not installed; install poppler-utils to read PDF files")
    done = subprocess.run([tool, "-layout", "-nopgbrk", "-enc", "UTF-8", "-", "-"], input=data, capture_output=True, timeout=seconds, check=True)
    text = done.stdout.decode("utf-8", "replace")
    if not text.strip():
        raise ValueError("no text in the file: a scan needs OCR first")
    return text


def read_paths(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, format, length) of files; those over ``max_bytes`` are ``oversized`` and come without their content, which is not read."""
    files = spark.read.format("binaryFile").load(path)
    fits = files.where(F.col("length") <= max_bytes).select("path", "content", "length", file_format(F.col("path")).alias("format"))
    return fits.unionByName(files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"), "length", F.lit("oversized").alias("format")))


def paragraphs(docs: DataFrame, keys: list[str], path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(paragraphs, errors) of documents of any format, each read where it lies."""
    kinds = dict(docs.dtypes)
    found = file_format(F.col(path))
    marked = docs.withColumn("_format", F.when(F.col("format") == "oversized", "oversized").otherwise(found) if "format" in docs.columns else found)
    plain = text_paragraphs(marked.where("_format = 'text'"), keys, content)
    blank = [F.lit("").alias("style"), F.lit(0).alias("list_id"), F.lit(0).alias("list_lvl"), F.lit(False).alias("in_table"), F.lit(0).alias("tbl"), F.lit(0).alias("tbl_row"), F.lit(0).alias("tbl_col")]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {PARAGRAPH}, error string"

    kind = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def read(batches):
        for batch in batches:
            fields = [batch.schema.field(k) for k in keys] + [pa.field(n, kind[t]) for n, t in (f.split() for f in PARAGRAPH.split(", "))] + [pa.field("error", pa.string())]
            rows = []
            for record in batch.to_pylist():
                key = {k: record[k] for k in keys}
                try:
                    if record["_format"] == "docx":
                        found = docx_paragraphs(record[content] or b"")
                    elif record["_format"] == "pdf":
                        found = [_PLAIN | {"idx": i, "raw": x.rstrip(" \t")} for i, x in enumerate(pdf_text(record[content] or b"").rstrip().split("\n"))]
                    else:
                        raise ValueError("the file is too large" if record["_format"] == "oversized" else "unsupported file type")
                    rows += [key | p | {"error": None} for p in found]
                except (ValueError, ElementTree.ParseError, subprocess.SubprocessError) as e:
                    rows.append(key | dict.fromkeys(_COLUMNS) | {"error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    other = marked.where("_format <> 'text'").select(*keys, F.col(content).cast("binary").alias(content), "_format").mapInArrow(read, schema)
    good = other.where("error is null").select(*keys, "idx", T.normalize(F.col("raw")).alias("text"), *_COLUMNS[1:])
    return plain.select(*keys, "idx", "text", "raw", *blank).unionByName(good), other.where("error is not null").select(*keys, "error")
