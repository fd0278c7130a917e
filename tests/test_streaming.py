"""Streams of claims give what the batch gives."""

import datetime as dt

from claimloom.operators import batch
from claimloom.streaming import claims as stream


def test_verify_stream(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 10, 0, 0, "Mortality fell by 15% in mice.")], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    claims = spark.createDataFrame([(1, 1, "Mortality fell by 15% in mice"), (2, 1, "Quantum")], "claim_id long, source_id long, claim string")
    claims.write.parquet(str(tmp_path / "in"))
    q = stream.verify_stream(spark.readStream.schema(claims.schema).parquet(str(tmp_path / "in")), chunks, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.verify(claims, chunks).collect()))


def test_windows_and_dedup(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, d, 12)
    rows = spark.createDataFrame([(1, "a  b", t(1)), (2, "a b", t(2)), (3, "c", t(2))], "id long, claim_text string, created_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", stream.counts_by_window(src()), "complete"), ("d", stream.distinct_claims(src()), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["n_claims"] for r in spark.table("w").collect()) == [1, 2]
    assert spark.table("d").count() == 2
