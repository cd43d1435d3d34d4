"""Reading folders of files: scan, decode, Markdown sources and the document table."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakequill.functions.text import strip

#: Folder names that are never read, and metadata keys that a file's own metadata can't replace (fixed values).
SKIPPED = ("wiki", "node_modules")
PROTECTED = ("file_path", "file_name", "file_size", "modified_time", "source_dir", "format", "source", "url", "fetch_time")


def scratch(spark: SparkSession) -> str:
    """The shared folder for what jobs write: spark.checkpoint.dir or the context's checkpoint folder. Where neither is
    set, a temporary folder in local mode, and an error elsewhere, as executors would not see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lakequill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """path, relative, doc_id, size, mtime, content (binary) of the files under root with one of the extensions in any
    case, except in folders named in SKIPPED or starting with a dot, and files that start with a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.expr(f"substring_index(path, '/{root.rstrip('/').rsplit('/', 1)[-1]}/', -1)")
    parts = F.split("relative", "/")
    bad = F.exists(parts, lambda x: x.startswith(".") | x.isin(*SKIPPED))
    wanted = F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    named = files.where(wanted).select(path.alias("path"), relative.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return named.where(~bad).withColumn("doc_id", F.substring(F.md5("path"), 1, 16))


def decoded(rows: DataFrame, raw: str = "content", out: str = "text") -> DataFrame:
    """rows with `out`, the text of the bytes in `raw`: UTF-8, else GB18030, else Latin-1; null bytes stay null.

    Valid UTF-8 never leaves the JVM; only what fails goes through Arrow.
    """

    @F.pandas_udf("string")
    def other(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def read(b: bytes | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode("gb18030")
            except UnicodeDecodeError:
                return b.decode("latin-1")

        for s in batches:
            yield s.map(read)

    valid = F.try_validate_utf8(F.col(raw).cast("string"))
    return rows.withColumn("_bad", F.when(valid.isNull(), F.col(raw))).withColumn(out, F.coalesce(valid, other("_bad"))).drop("_bad")


def markdown_source(content: Column) -> Column:
    """A struct (content, title, metadata): `---` front matter of flat `key: value` lines (the last of a key counts) goes
    to metadata; title is the first first-level heading, else the first of any level; metadata's title, if any, stays."""
    parts = F.split(content, "---", 3)
    has = content.startswith("---") & (F.size(parts) >= 3)
    front, body = F.when(has, parts[1]).otherwise(""), strip(F.when(has, parts[2]).otherwise(content))
    line = r"(?m)^([A-Za-z0-9_-]+):[ \t]*(.*)$"
    keys = F.regexp_extract_all(front, F.lit(line), F.lit(1))
    values = F.transform(F.regexp_extract_all(front, F.lit(line), F.lit(2)), lambda v: F.regexp_replace(strip(v), r"""^(["'])(.*)\1$""", "$2"))
    pairs = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), p["key"]))
    head = lambda marks: F.nullif(strip(F.regexp_extract(body, rf"(?m)^{marks}\s+(.+)$", 1)), F.lit(""))
    title = F.coalesce(head("#"), head("#{1,6}"))
    given = F.map_from_entries(pairs)
    named = F.nullif(F.try_element_at(given, F.lit("title")), F.lit(""))
    put = F.when(named.isNull() & title.isNotNull(), F.map_concat(F.map_filter(given, lambda k, _: k != "title"), F.create_map(F.lit("title"), title))).otherwise(given)
    return F.struct(body.alias("content"), title.alias("title"), put.alias("metadata"))


def documents(parsed: DataFrame) -> DataFrame:
    """doc_id, content, metadata from (path, content, title, metadata): blank documents go; a document's own metadata
    replaces what the path gives, except the protected keys."""
    name = F.element_at(F.split("path", "/"), -1)
    from_path = F.create_map(F.lit("file_path"), F.col("path"), F.lit("file_name"), name, F.lit("source_dir"), F.regexp_replace("path", "/[^/]*$", ""), F.lit("format"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    with_title = F.when(F.col("title").isNotNull(), F.map_concat(from_path, F.create_map(F.lit("title"), F.col("title")))).otherwise(from_path)
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*PROTECTED))
    merged = F.map_concat(F.map_filter(with_title, lambda k, _: ~F.map_contains_key(own, k)), own)
    return parsed.where(F.length(strip(F.col("content"))) > 0).select(F.substring(F.md5("path"), 1, 16).alias("doc_id"), strip(F.col("content")).alias("content"), merged.alias("metadata"))
