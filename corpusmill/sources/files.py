"""Sources: folders of crawled files, inline texts, nested documents, and a registry that picks a reader."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import cache_key, joined_pages, strip

CATEGORIES = ("pages", "pdfs", "pdf-texts", "excel", "images", "other", "external")


def listing(spark: SparkSession, base: str) -> DataFrame:
    """path, category, name, size, modified, cache_key of files in the known folders; hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    category = F.regexp_extract("path", "/(" + "|".join(CATEGORIES) + ")/[^/]+$", 1)
    found = files.select("path", category.alias("category"), name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.filter((F.col("category") != "") & ~F.col("name").startswith(".")).withColumn("cache_key", cache_key(F.col("path"), F.unix_millis("modified"), F.col("size")))


def pdfs(spark: SparkSession, base: str) -> DataFrame:
    """Every PDF below base, whatever the case of its ending."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(base).select("path", "length")


def is_loadable(category: Column, name: Column) -> Column:
    """Texts of pages, external pages and PDFs, and sheets; PDFs come by their texts."""
    return (category.isin("pages", "external", "pdf-texts") & name.endswith(".txt")) | ((category == "excel") & name.rlike(r"\.xlsx?$"))


def text_files(spark: SparkSession, base: str) -> DataFrame:
    """source_id, content, word_count of whole files."""
    return spark.read.text(base, wholetext=True, recursiveFileLookup=True).select(F.concat(F.lit("file://"), F.col("_metadata.file_path")).alias("source_id"), F.col("value").alias("content"), word_count(F.col("value")).alias("word_count"))


def word_count(c: Column) -> Column:
    return F.size(F.split(c, r"\s+"))


def pdf_texts(found: DataFrame, cache: DataFrame, extracted: DataFrame) -> DataFrame:
    """path, content, cached of found files (path, cache_key): the text that cache (cache_key, content) has under the key, else
    the extracted pages (path, pages) as one text. A file without either has the empty text. Where extracted says which state of a
    path it has read (cache_key), it counts for that state alone."""
    state = [c for c in ("path", "cache_key") if c in extracted.columns]
    both = found.select("path", "cache_key").join(cache.select("cache_key", F.col("content").alias("known")), "cache_key", "left").join(extracted.select(*state, "pages"), state, "left")
    return both.select("path", F.coalesce("known", joined_pages(F.col("pages")), F.lit("")).alias("content"), F.col("known").isNotNull().alias("cached"))


def inline(spark: SparkSession, texts: list[tuple[str, str | None]]) -> DataFrame:
    """source_id, content: texts given by the caller; without content the id is the text."""
    return inlined(spark.createDataFrame(texts, "source_id string, content string"))


def inlined(texts: DataFrame) -> DataFrame:
    """inline() of a frame (source_id, content)."""
    return texts.withColumn("content", F.coalesce("content", "source_id"))


Reader = tuple[str, Callable[[Column, Column], Column]]
#: (name, test on id and type), tried in order.
READERS: list[Reader] = [
    ("google_docs", lambda i, t: t == "google-docs"),
    ("pdf", lambda i, t: (t == "pdf") | F.lower(i).endswith(".pdf")),
    ("excel", lambda i, t: (t == "excel") | F.lower(i).rlike(r"\.xlsx?$")),
    ("file", lambda i, t: (t == "file") | i.startswith("file://")),
    ("text", lambda i, t: t == "text"),
]


def register(name: str, test: Callable[[Column, Column], Column]) -> None:
    READERS.append((name, test))


def reader(source_id: Column, kind: Column) -> Column:
    """Name of the first reader that takes a source; null for none."""
    out = F.lit(None).cast("string")
    for name, test in reversed(READERS):
        out = F.when(test(source_id, kind), name).otherwise(out)
    return out


def settled(sources: DataFrame, content: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(usable, failed): sources with content that is not blank, and those with an error."""
    rows = sources.withColumn("content", content).withColumn("error", error)
    return rows.filter(F.col("error").isNull() & (strip(F.coalesce("content", F.lit(""))) != "")), rows.filter("error is not null")


#: Parts of errors that are no fault of a source.
EXPECTED_ERRORS = ("Service account", "not configured", "ENOENT", "no such file or directory", "Error parsing PDF")


def checked(usable: DataFrame, failed: DataFrame) -> DataFrame:
    """usable, unless it is empty and an error stands among failed that was not to be expected: then that is raised."""
    expected = F.lit(False)
    for part in EXPECTED_ERRORS:
        expected = expected | F.contains("error", F.lit(part))
    if usable.isEmpty() and (first := failed.filter(~expected).agg(F.min("error")).first()[0]) is not None:
        raise ValueError(f"no source could be processed: {first}")
    return usable


def flat_text(document: str) -> str:
    """Text of a nested document: runs of a paragraph joined, cells by bars, rows and blocks by line feeds."""

    def block(b: dict) -> str | None:
        if "paragraph" in b:
            return "".join(e.get("textRun", {}).get("content", "") for e in b["paragraph"].get("elements", []))
        if "table" in b:
            return "\n".join(" | ".join(blocks(c.get("content", [])) for c in r.get("tableCells", [])) for r in b["table"].get("tableRows", []))
        return None

    def blocks(content: list[dict]) -> str:
        return "\n".join(x for x in map(block, content) if x)

    import re

    return re.sub(r"\n{3,}", "\n\n", blocks(json.loads(document).get("body", {}).get("content", []))).strip()


@F.pandas_udf(StringType())
def flattened(document: pd.Series) -> pd.Series:
    return document.map(lambda d: None if d is None else flat_text(d))
