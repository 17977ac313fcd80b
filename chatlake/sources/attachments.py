"""Attachment bytes: read (``binaryFile``), decode as text (S8), encode as
data URLs (S9).  Bytes stay in a BINARY column; decoding and encoding are
built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DATA_URL
from ..functions.text import col, fill

# File extension → MIME type for attachments read from a folder.
MIME_BY_EXTENSION = {
    "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "mp3": "audio/mpeg", "mp4": "video/mp4", "pdf": "application/pdf",
}


def read_attachments(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Attachment files as ``(event_id, content, mimetype, size)``; the file
    name without extension is the event id.  ``binaryFile`` splits one file
    per row, so the read parallelises over files."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[x for kv in MIME_BY_EXTENSION.items() for x in map(F.lit, kv)]), ext),
                      F.lit("application/octet-stream"))
    return df.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("event_id"), F.col("content"),
                     mime.alias("mimetype"), F.col("length").alias("size"))


def utf8_text(content) -> Column:
    """Strict UTF-8 decode; NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(col(content).cast("string"))


def file_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Keep rows whose bytes decode as non-empty UTF-8 text."""
    t = utf8_text(content)
    return df.withColumn("text", t).where(F.col("text").isNotNull() & (F.col("text") != ""))


def base64_oneline(content) -> Column:
    """Standard base64 without line breaks (Spark's ``base64`` breaks lines
    every 76 characters)."""
    return F.regexp_replace(F.base64(col(content)), r"[\r\n]", "")


def data_url(mimetype, content) -> Column:
    """``data:{type};base64,{payload}``."""
    return fill(DATA_URL, mimetype=col(mimetype), payload=base64_oneline(content))
