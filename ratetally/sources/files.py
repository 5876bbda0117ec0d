"""Stored files: fingerprints and routing to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratetally.functions.text import strip, text


def sniffed_type(content: Column) -> Column:
    """Struct (suffix, mime) by the first bytes; empty texts when they are not known."""
    head = F.hex(F.substring(content, 1, 16))
    head = F.regexp_replace(head, "^(EFBBBF)+", "")
    low = F.lower(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"))
    low = F.regexp_replace(low, "^(ï»¿)+", "")
    html = low.startswith("<!") | low.startswith("<?") | (low.startswith("<") & low.rlike("<html|<!doctype html|<head|<body"))
    kind = (
        F.when(head.startswith("25504446"), F.array(F.lit(".pdf"), F.lit("application/pdf")))
        .when(html, F.array(F.lit(".html"), F.lit("text/html")))
        .when(head.startswith("504B0304"), F.array(F.lit(".xlsx"), F.lit("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")))
        .when(head.startswith("D0CF11E0A1B11AE1"), F.array(F.lit(".xls"), F.lit("application/vnd.ms-excel")))
        .otherwise(F.array(F.lit(""), F.lit("")))
    )
    return F.struct(kind[0].alias("suffix"), kind[1].alias("mime"))


def fingerprint(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds bytes_size, content_sha256, sniffed suffix and MIME type of a BINARY column."""
    t = sniffed_type(F.col(content))
    return df.select(
        "*", F.length(content).cast("long").alias("bytes_size"), F.sha2(F.col(content), 256).alias("content_sha256"),
        t["suffix"].alias("sniffed_suffix"), t["mime"].alias("sniffed_mime"),
    )


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files below ``path`` with size, SHA-256, sniffed type, name and error.

    Files over ``max_bytes`` are rows with the error ``too_large`` and without content: they are not read.
    """
    files = spark.read.format("binaryFile").load(path)
    out = fingerprint(files if max_bytes is None else files.where(F.col("length") <= max_bytes)).withColumn("error", F.lit(None).cast("string"))
    if max_bytes is not None:
        large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", F.col("length").alias("bytes_size"), F.lit("too_large").alias("error"))
        out = out.drop("length").unionByName(large, allowMissingColumns=True)
    return out.select(
        F.col("path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("original_filename"),
        F.col("modificationTime").alias("modified_at"), "bytes_size", "content_sha256", "sniffed_suffix", "sniffed_mime", "content", "error",
    )


def classify_file(df: DataFrame, name: str = "original_filename", mime: str = "mime_type", content: str = "content") -> DataFrame:
    """Adds ``kind``, the reader a file goes to, and ``error``.

    An HTML page under the name of a document is an error; binary office formats are recognised, not read.
    """
    n, m = F.lower(strip(F.col(name))), F.lower(strip(F.col(mime)))
    suffix = sniffed_type(F.col(content))["suffix"]
    low = F.regexp_replace(F.lower(F.decode(F.substring(F.col(content), 1, 600), "ISO-8859-1")), r"^\s+", "")
    page = low.startswith("<!doctype html") | low.startswith("<html") | low.startswith("<!--")
    page_name = n.rlike(r"\.html?$") | m.contains("html")
    kind = (
        F.when(F.length(content) == 0, "empty")
        .when(page & ~page_name, "html_masquerade")
        .when((suffix == ".pdf") | n.endswith(".pdf") | (m == "application/pdf"), "pdf")
        .when(n.endswith(".docx") | m.contains("wordprocessingml"), "docx")
        .when(n.endswith(".xlsx") | n.endswith(".xlsm") | m.contains("spreadsheetml") | (suffix == ".xlsx"), "xlsx")
        .when(n.endswith(".doc") | m.contains("msword"), "legacy_doc")
        .when(n.endswith(".xls") | m.contains("ms-excel") | (suffix == ".xls"), "xls")
        .when(n.endswith(".csv") | m.contains("csv") | (m.startswith("text/") & ~page_name) & ~n.rlike(r"\.(txt|xml|json|log)$"), "delimited")
        .when(n.rlike(r"\.(txt|htm|html|xml|json|log)$") | m.isin("application/json", "application/xml") | page_name, "text_lines")
        .otherwise("generic")
    )
    error = F.when(kind == "empty", "no_rows").when(kind == "html_masquerade", "file is an HTML page").when(
        kind.isin("pdf", "docx", "xlsx", "xls", "legacy_doc"), "no reader for this format"
    )
    return df.withColumn("kind", kind).withColumn("error", error)
