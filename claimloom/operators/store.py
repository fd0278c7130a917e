"""The idempotent result store as batch operators: upsert, insert-if-absent, replacement, integrity, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimloom.functions.text import cleaned, squeezed, text_hash


def upsert(existing: DataFrame | None, updates: DataFrame, key: str, fields: list[str], order: list[str], created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """State after ``updates`` were applied in ``order``: per key the last value that isn't null of each field, the first
    ``created``, the last ``updated``. Strings are stripped and blank ones count as null. Rows with a blank key are left out.
    ``existing`` (one row per key, same columns) comes before all updates.
    """
    strings = {f for f, t in updates.dtypes if t == "string"}
    cols = [key, *fields, created, updated]
    tidy = updates.select(F.lit(1).alias("_round"), F.struct(*order).alias("_seq"), cleaned(F.col(key)).alias(key), *[(cleaned(F.col(f)) if f in strings else F.col(f)).alias(f) for f in fields], created, updated).where(F.col(key).isNotNull())
    merged = tidy
    if existing is not None:
        seq_type = dict(tidy.dtypes)["_seq"]
        old = existing.select(F.lit(0).alias("_round"), F.lit(None).cast(seq_type).alias("_seq"), *cols)
        merged = old.unionByName(tidy)
    at = F.struct("_round", "_seq")
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return merged.groupBy(key).agg(*last, F.min_by(created, at).alias(created), F.max_by(updated, at).alias(updated), F.count("*").alias("n_writes"))


def claim_dedup(claims: DataFrame, key: str = "id", text: str = "claim_text") -> DataFrame:
    """Insert-if-absent on the hash of the claim with white space squeezed: (claim_hash, first_id, n). Blank and null
    claims are refused."""
    t = squeezed(F.col(text))
    return claims.select(F.col(key), t.alias("_t")).where(F.length("_t") > 0).groupBy(text_hash(F.col("_t")).alias("claim_hash")).agg(F.min(key).alias("first_id"), F.count("*").alias("n"))


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks, the first of each key."""
    fresh = new.join(existing.select(key), key, "left_anti").dropDuplicates([key])
    return existing.unionByName(fresh.select(existing.columns))


def replace_chunks(existing: DataFrame, delivered: DataFrame, key: list[str], index: str = "chunk_index") -> DataFrame:
    """Chunk sets of ``delivered`` replace those of the same ``key``; others stay. Delivered sets are reindexed from 0."""
    w = Window.partitionBy(*key).orderBy(index)
    fresh = delivered.withColumn(index, (F.row_number().over(w) - 1).cast("int"))
    return existing.join(delivered.select(*key).distinct(), key, "left_anti").unionByName(fresh.select(existing.columns))


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Of chunks delivered again (same paper, hash and index) the last delivery, reindexed from 0:
    (paper_id, content_hash, new_index, id)."""
    last = chunks.groupBy("paper_id", "content_hash", "chunk_index").agg(F.max("id").alias("id"))
    w = Window.partitionBy("paper_id", "content_hash").orderBy("chunk_index")
    return last.select("paper_id", "content_hash", (F.row_number().over(w) - 1).alias("new_index"), "id")


def content_store(texts: DataFrame, text: str = "text") -> DataFrame:
    """Content-addressed texts: (content_hash, n_chars, n_copies); blank ones are refused."""
    return texts.where(cleaned(F.col(text)).isNotNull()).groupBy(text_hash(F.col(text)).alias("content_hash")).agg(F.max(F.length(text)).alias("n_chars"), F.count("*").alias("n_copies"))


def integrity(rows: DataFrame, key: str, text: str = "text", stated: str = "content_hash") -> DataFrame:
    """(key, state): OK, MISMATCH, NO_HASH or NO_TEXT for the stated hash of a stored text."""
    h = F.lower(F.col(stated))
    state = F.when(F.col(text).isNull(), "NO_TEXT").when(~F.coalesce(h.rlike("^[0-9a-f]{64}$"), F.lit(False)), "NO_HASH").when(h == text_hash(F.col(text)), "OK").otherwise("MISMATCH")
    return rows.select(key, state.alias("state"))


def page_sidecar(pages: DataFrame, doc: str = "paper_id") -> DataFrame:
    """(doc, n_pages, blank_pages, bad_number, bad_span, valid) of stored page spans: numbers run from 1 without a gap, spans
    are in bounds and don't overlap. An invalid set counts as a cache miss."""
    w = Window.partitionBy(doc).orderBy("page_number", "start_char", "end_char")
    p = pages.withColumn("_k", F.row_number().over(w)).withColumn("_end", F.lag("end_char").over(w))
    bad_span = ~F.coalesce((F.col("start_char") >= 0) & (F.col("end_char") >= F.col("start_char")) & (F.col("start_char") >= F.coalesce("_end", F.lit(0))), F.lit(False))
    g = p.groupBy(doc).agg(F.count("*").alias("n_pages"), F.count_if(F.col("start_char") == F.col("end_char")).alias("blank_pages"), F.count_if(~F.coalesce(F.col("page_number") == F.col("_k"), F.lit(False))).alias("bad_number"), F.count_if(bad_span).alias("bad_span"))
    return g.withColumn("valid", (F.col("bad_number") == 0) & (F.col("bad_span") == 0))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing; null keys have none to miss."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
