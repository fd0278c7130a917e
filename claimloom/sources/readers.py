"""Readers: Parquet tables, text and binary files, stored JSON reports. Acquisition over the network is outside the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files over this size aren't sources.
MAX_BYTES = 100 * 1024 * 1024


def binary_documents(spark: SparkSession, path: str, magic: bytes | None = b"%PDF-", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, content, accepted) of files: not empty, not over the size cap, and with the magic bytes in the first
    1,024 (``magic`` None: no such test)."""
    files = spark.read.format("binaryFile").load(path)
    ok = (F.col("length") > 0) & (F.col("length") <= max_bytes)
    if magic:
        ok = ok & F.contains(F.substring("content", 1, 1024), F.lit(bytearray(magic)))
    return files.select("path", "length", "content", ok.alias("accepted"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(canonical_id, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.concat(F.lit("local:"), F.input_file_name()).alias("canonical_id"), F.col("value").alias("text"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of stored bibliography reports; unreadable ones have null totals."""
    raw = spark.read.text(path, wholetext=True)
    return report_totals(raw.select(F.input_file_name().alias("path"), F.col("value").alias("report")))


def report_totals(rows: DataFrame, report: str = "report") -> DataFrame:
    """``rows`` with the totals a report states under ``summary``."""
    names = {"references": "total_references_processed", "errors": "total_errors_found", "warnings": "total_warnings_found", "unverified": "total_unverified_refs", "information": "total_info_found"}
    v = F.try_parse_json(F.col(report))
    return rows.select(*[c for c in rows.columns if c != report], *[F.try_variant_get(v, f"$.summary.{n}", "string").alias(k) for k, n in names.items()])
