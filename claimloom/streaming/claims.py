"""Claims that arrive as a stream, verified in micro-batches against static chunks. An extension: each micro-batch runs the
batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from claimloom.functions.text import squeezed, text_hash
from claimloom.operators import batch


def verify_stream(claims: DataFrame, chunks: DataFrame, out: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Verdicts for a stream of (claim_id, source_id, claim), appended to the Parquet folder ``out``; one folder for each batch
    id, overwritten if a batch runs again, so a restart writes nothing twice."""

    def one(df: DataFrame, batch_id: int) -> None:
        batch.verify(df, chunks, k).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return claims.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_claims(claims: DataFrame, text: str = "claim_text", time: str = "created_at", late: str = "7 days") -> DataFrame:
    """The stream without claims repeated within the watermark (white space doesn't distinguish them); late rows up to
    ``late`` are still deduplicated, later ones are dropped by the watermark."""
    keyed = claims.withColumn("claim_hash", text_hash(squeezed(F.col(text)))).withWatermark(time, late)
    return keyed.dropDuplicatesWithinWatermark(["claim_hash"])


def counts_by_window(claims: DataFrame, time: str = "created_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, window_end, n_claims) of a stream, late rows within the watermark included."""
    g = claims.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n_claims"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_claims")
