"""Readers of documents in files: Markdown, HTML, DOCX and (where a reader is installed) PDF.

Each gives ``id, path, section, text``: ``id`` is the MD5 of the text, ``section`` the folder relative to the root.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.markup import readable

#: Mean characters per page below which a PDF is images, or a mix.
IMAGE_CHARS, MIXED_CHARS = 50, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _described(files: DataFrame, root: str, text: Column) -> DataFrame:
    base = root.rstrip("/") + "/"
    relative = F.regexp_extract("path", r".*?" + base.replace("/", r"/+") + r"(.*)$", 1)
    folder = F.regexp_replace(relative, r"/?[^/]*$", "")
    return files.withColumn("text", text).filter(F.length(F.trim("text")) > 0).select(F.md5("text").alias("id"), "path", F.when(folder == "", "root").otherwise(folder).alias("section"), "text")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.md`` files under a folder; blank ones are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_v"))
    return _described(files, root, F.col("_v"))


def text_of_docx(data: bytes) -> str:
    """Paragraphs as lines; heading styles as Markdown headings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in tree.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") or "") if style is not None else ""
        level = 1 if name == "Title" else int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
        if text:
            out.append(f"{'#' * min(level, 6)} {text}" if level else text)
    return "\n\n".join(out)


def pages_of_pdf(data: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package on the executors") from e
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def mapped(rows: DataFrame, key: str, column: str, convert: Callable, to: str = "text") -> DataFrame:
    """``<key>, <to>``: a Python function over one column, batch by batch; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if v is None else convert(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], names=[key, to])

    return rows.select(key, column).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, `{to}` string")


def html(spark: SparkSession, root: str) -> DataFrame:
    """All ``*.html`` files under a folder as readable text (see functions.markup)."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_v"))
    return _described(files, root, readable(F.col("_v")))


def docx(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(root).select("path", "content")
    return _described(mapped(files, "path", "content", text_of_docx, "_t"), root, F.col("_t"))


def pdf(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", "content")
    return _described(mapped(files, "path", "content", lambda b: "\n".join(p for p in pages_of_pdf(b) if p.strip()), "_t"), root, F.col("_t"))


def page_kinds(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per file of a table of pages: mean characters, share of pages without text, and ``image``, ``mixed`` or ``text``."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    per = pages.groupBy(key).agg(F.avg(n).alias("mean_chars"), F.avg((n < IMAGE_CHARS).cast("int")).alias("image_share"), F.count(F.lit(1)).alias("n_pages"))
    return per.withColumn("kind", F.when(F.col("mean_chars") < IMAGE_CHARS, "image").when(F.col("mean_chars") < MIXED_CHARS, "mixed").otherwise("text"))


READERS = {"docx": docx, "html": html, "markdown": markdown, "pdf": pdf}


def documents(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Several sources (``{"kind": ..., "root": ...}`` and further columns) in one table."""
    if not sources:
        return spark.createDataFrame([], "id string, path string, section string, text string, kind string")

    def read(s: dict) -> DataFrame:
        extra = {k: F.lit(v) for k, v in s.items() if k != "root"}
        return READERS[s["kind"]](spark, s["root"]).withColumns(extra)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(read, sources))
