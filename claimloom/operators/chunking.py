"""Chunks and windows with exact character spans, page spans, and checks of stored spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

CHUNK, CHUNK_OVERLAP = 4000, 600
WINDOW, WINDOW_OVERLAP = 1600, 300


def boundary(text: str, start: int, nominal: int, target: int) -> int:
    """Where a chunk that starts at ``start`` and may reach ``nominal`` ends: in the last two fifths of the target
    after a blank line, else a line end, else a sentence's stop, else before a blank, else at ``nominal``."""
    if nominal >= len(text):
        return len(text)
    lo = min(nominal, start + max(1, int(target * 0.6)))
    if lo >= nominal:
        return nominal
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, lo, nominal)
        if at >= 0:
            return at + len(mark)
    # A line end can't follow here, so only a blank can come after the stop.
    at = max(text.rfind(stop + " ", lo, nominal) for stop in ".?!")
    if at >= 0:
        return at + 1
    at = max(text.rfind(" ", lo, nominal), text.rfind("\t", lo, nominal))
    return at if at >= 0 else nominal


def chunk_spans(text: str, target: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the chunks, stripped; blank ones are left out."""
    if not 0 <= overlap < target:
        raise ValueError("overlap must be at least 0 and less than target")
    out, at, n = [], 0, len(text)
    while at < n:
        end = boundary(text, at, min(at + target, n), target)
        if end <= at:
            end = min(at + target, n)
        piece = text[at:end]
        lead = len(piece) - len(piece.lstrip())
        if lead < len(piece):
            out.append((at + lead, at + len(piece.rstrip())))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def spans_udf(target: int, overlap: int):
    """text -> array of spans, in Arrow batches."""

    @pandas_udf("array<struct<start_char:int,end_char:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [] if t is None else [{"start_char": a, "end_char": b} for a, b in chunk_spans(t, target, overlap)])

    return run


def chunk(docs: DataFrame, key: str, text: str = "text", target: int = CHUNK, overlap: int = CHUNK_OVERLAP, index: str = "chunk_index") -> DataFrame:
    """``docs`` (all columns but the text) with one row per chunk: index from 0, start_char, end_char, chunk_text.

    Null, empty and blank texts give no row. Lengths and positions are code points.
    """
    others = [c for c in docs.columns if c != text and c != key]
    spans = docs.withColumn("_spans", spans_udf(target, overlap)(F.col(text)))
    rows = spans.select(key, *others, F.col(text).alias("_text"), F.posexplode("_spans").alias(index, "_span"))
    return rows.select(key, *others, index, "_span.start_char", "_span.end_char", F.substring("_text", F.col("_span.start_char") + 1, F.col("_span.end_char") - F.col("_span.start_char")).alias("chunk_text"))


def windows(chunks: DataFrame, key: str = "id", text: str = "text", offset: str = "start_char") -> DataFrame:
    """Evidence windows of chunks: (key, window_index, start_char, end_char, quote), positions in the source.

    A chunk without an offset of its own counts from 0.
    """
    w = chunk(chunks.select(key, text, F.coalesce(F.col(offset), F.lit(0)).alias("_off")), key, text, WINDOW, WINDOW_OVERLAP, "window_index")
    return w.select(key, "window_index", (F.col("start_char") + F.col("_off")).alias("start_char"), (F.col("end_char") + F.col("_off")).alias("end_char"), F.col("chunk_text").alias("quote"))


def assemble_pages(pages: DataFrame, doc: str = "paper_id", number: str = "page_number", text: str = "text", order: tuple[str, ...] = ("extracted_at", "page_id")) -> DataFrame:
    """Pages in one document's coordinates: (doc, number, start_char, end_char, text).

    Of a page extracted more than once the last extraction counts. Pages are joined by a blank line; blank ones keep a
    zero-width place. Rows without a document or number are left out.
    """
    last = pages.where(F.col(doc).isNotNull() & F.col(number).isNotNull()).groupBy(doc, number).agg(F.max_by(F.coalesce(F.col(text), F.lit("")), F.struct(*order)).alias(text))
    w = Window.partitionBy(doc).orderBy(number)
    end = F.sum(F.length(text) + 2).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 2
    return last.withColumn("end_char", end.cast("int")).withColumn("start_char", F.col("end_char") - F.length(text)).select(doc, number, "start_char", "end_char", text)


def page_range(spans: DataFrame, pages: DataFrame, key: str = "id", doc: str = "paper_id") -> DataFrame:
    """(key, page_start, page_end) of spans (key, doc, start_char, end_char) over ``assemble_pages``.

    A page counts if it overlaps the span; zero-width pages don't. Spans without such a page have nulls. The join is by
    document; its pages are an array on the page side, so a span never meets another document's pages.
    """
    book = pages.where("start_char < end_char").groupBy(doc).agg(F.collect_list(F.struct(F.col("page_number").alias("n"), F.col("start_char").alias("s"), F.col("end_char").alias("e"))).alias("_pages"))
    hit = F.filter("_pages", lambda p: (F.col("start_char") < p["e"]) & (F.col("end_char") > p["s"]))
    joined = spans.select(key, doc, "start_char", "end_char").join(book, doc, "left").withColumn("_hit", F.transform(hit, lambda p: p["n"]))
    return joined.select(key, F.array_min("_hit").alias("page_start"), F.array_max("_hit").alias("page_end"))


def chunk_checks(chunks: DataFrame) -> DataFrame:
    """Per (paper_id, content_hash): rows, distinct indexes, and what is wrong with the set.

    ``gaps``: indexes missing between 0 and the largest; ``repeated``: rows beyond one per index; ``bad_span``: rows whose
    offsets are missing, negative or don't span the text. The set is valid if all are 0.
    """
    g = chunks.groupBy("paper_id", "content_hash").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("chunk_index").alias("n_indexes"),
        F.max("chunk_index").alias("last_index"),
        F.count_if(~F.coalesce((F.col("start_char") >= 0) & (F.col("end_char") - F.col("start_char") == F.length("text")), F.lit(False))).alias("bad_span"),
    )
    gaps = F.coalesce(F.col("last_index") + 1 - F.col("n_indexes"), F.lit(0))
    return g.select("paper_id", "content_hash", "n_rows", gaps.cast("long").alias("gaps"), (F.col("n_rows") - F.col("n_indexes")).alias("repeated"), "bad_span", ((gaps == 0) & (F.col("n_rows") == F.col("n_indexes")) & (F.col("bad_span") == 0)).alias("valid"))
