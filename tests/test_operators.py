"""Chunks, pages, retrieval, provenance, policy, store and batches on small rows."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from claimloom.functions.text import TOKEN  # noqa: F401
from claimloom.operators import batch, chunking, nli, policy, provenance, retrieval, skew, store
from claimloom.sources import readers


# -- chunks -----------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\t?é😀", max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_chunk_spans_hold(text, target, overlap):
    overlap = min(overlap, target - 1)
    spans = chunking.chunk_spans(text, target, overlap)
    covered = set()
    for a, b in spans:
        assert 0 <= a < b <= len(text) and b - a <= target and text[a:b] == text[a:b].strip()
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_chunk_edges(spark):
    assert chunking.chunk_spans("") == [] and chunking.chunk_spans(" \n ") == []
    assert chunking.chunk_spans("a" * 500, 100, 99)[-1][1] == 500
    assert chunking.chunk_spans("x" * 70 + "\n\n" + "y" * 70, 100, 0)[0] == (0, 70)
    with pytest.raises(ValueError):
        chunking.chunk_spans("a", 10, 10)
    df = spark.createDataFrame([(1, "one 😀 two"), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in chunking.chunk(df, "id").collect()] == [(1, 0, 0, 9, "one 😀 two")]
    assert chunking.chunk(df.limit(0), "id").count() == 0


def test_pages(spark):
    rows = [(1, 7, 1, "abc", "2024-01-01"), (2, 7, 1, "abcd", "2024-02-01"), (3, 7, 2, "", "2024-01-01"), (4, 7, 3, "xy", "2024-01-01"), (5, None, 1, "q", "2024-01-01"), (6, 8, 1, None, "2024-01-01")]
    pages = spark.createDataFrame(rows, "page_id long, paper_id long, page_number int, text string, extracted_at string")
    got = chunking.assemble_pages(pages)
    assert sorted(map(tuple, got.select("paper_id", "page_number", "start_char", "end_char").collect())) == [(7, 1, 0, 4), (7, 2, 6, 6), (7, 3, 8, 10), (8, 1, 0, 0)]
    spans = spark.createDataFrame([(1, 7, 0, 4), (2, 7, 3, 9), (3, 7, 4, 8), (4, 9, 0, 1), (5, 7, None, None)], "id long, paper_id long, start_char int, end_char int")
    assert sorted(map(tuple, chunking.page_range(spans, got).collect())) == [(1, 1, 1), (2, 1, 3), (3, None, None), (4, None, None), (5, None, None)]


def test_chunk_checks(spark):
    rows = [(1, "h", 0, "abc", 0, 3), (1, "h", 1, "d", 3, 4), (2, "h", 0, "abc", 0, 2), (2, "h", 2, "x", None, 1), (2, "h", 2, "x", 5, 6)]
    c = spark.createDataFrame(rows, "paper_id long, content_hash string, chunk_index int, text string, start_char int, end_char int")
    assert sorted(map(tuple, chunking.chunk_checks(c).collect())) == [(1, "h", 2, 0, 0, 0, True), (2, "h", 3, 1, 1, 2, False)]


# -- retrieval ----------------------------------------------------------------------------------------------------------


def brute_bm25(texts, query):
    docs = {k: t.lower().split() for k, t in texts.items()}
    docs = {k: v for k, v in docs.items() if v}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for v in docs.values() for w in set(v))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = {}
    for k, v in docs.items():
        tf = Counter(v)
        if set(tf) & set(query):
            out[k] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(v) / avg)) for w in query if w in idf)
    return out


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(20)}
    query = ["w1", "w2", "w2", "zz"]
    chunks = spark.createDataFrame([(1, i, i, t) for i, t in texts.items()] + [(2, 100, 0, "..."), (3, 101, 0, "w1")], "source_id long, chunk_id long, chunk_index int, text string")
    q = spark.createDataFrame([(5, 1, " ".join(query)), (5, 2, "w1"), (6, 3, "w1"), (7, 1, "???"), (8, 1, None)], "query_id long, source_id long, query_text string")
    got = retrieval.top_k(q, chunks, 20).collect()
    mine = {r["chunk_id"]: r["score"] for r in got if r["query_id"] == 5}
    want = brute_bm25(texts, query)
    assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-6 for k in want)
    ranked = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == 5), key=lambda r: r["rank"])]
    assert ranked == sorted(want, key=lambda k: (-round(want[k], 9), -len(set(texts[k].split()) & set(query)), k))
    alone = [r for r in got if r["query_id"] == 6]
    assert len(alone) == 1 and alone[0]["score"] < 0 and alone[0]["overlap_ratio"] == 1.0
    assert {r["query_id"] for r in got} == {5, 6}
    with pytest.raises(ValueError):
        retrieval.top_k(q, chunks, 0)


def shuffled(spark, run):
    """Rows that ``run`` writes to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


def test_bm25_of_a_large_source_makes_no_row_for_each_common_term(spark):
    """One source in several parts, and a small one: every query is right, and queries times chunks are nowhere shuffled."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(rng.choices(words, [40 // (j + 1) + 1 for j in range(40)], k=rng.randint(3, 12))) for i in range(1, 1201)}
    texts |= {i: texts[7] for i in range(900, 920)}  # ties end in the chunk's place
    small = {i: t for i, t in texts.items() if i < 31}
    rows = [(1, i, 1200 - i, t) for i, t in texts.items()] + [(2, 5000 + i, i, t) for i, t in small.items()]
    chunks = spark.createDataFrame(rows, "source_id long, chunk_id long, chunk_index int, text string")
    asked = {i: rng.choices(words, k=8) + ["zz"] for i in range(200)} | {200: texts[7].split()}
    q = spark.createDataFrame([(i, s, " ".join(x)) for i, x in asked.items() for s in (1, 2)], "query_id long, source_id long, query_text string")
    got, n = shuffled(spark, lambda: retrieval.top_k(q, chunks, 5).collect())
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault((r["query_id"], r["source_id"]), []).append((r["chunk_id"], r["overlap"], round(r["overlap_ratio"], 9)))
    for i, x in asked.items():
        for s, held, shift, sign in ((1, texts, 0, -1), (2, small, 5000, 1)):
            want = brute_bm25(held, x)
            common = {k: len(set(held[k].split()) & set(x)) for k in want}
            best = sorted(want, key=lambda k: (-round(want[k], 9), -common[k], sign * k))[:5]
            assert mine[i, s] == [(k + shift, common[k], round(common[k] / len(set(x)), 9)) for k in best]
    assert n < len(asked) * len(texts) / 4


# -- provenance ---------------------------------------------------------------------------------------------------------


def test_occurrences(spark):
    cases = [("aaaa", "aa", [0, 1, 2]), ("abc", "c", [2]), ("abc", "x", []), ("a😀b😀", "😀", [1, 3]), ("abc", " ", []), ("ab", "abc", []), (None, "a", None), ("a\\Eb a\\Eb", "\\Eb", [1, 6])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, t string, q string")
    assert [r[1] for r in df.select("i", provenance.occurrences(F.col("t"), F.col("q"))).orderBy("i").collect()] == [c[2] for c in cases]
    one = df.where("i = 0").select(provenance.occurrences(F.col("t"), F.col("q"), F.lit(1), F.lit(3))).first()[0]
    assert one == [1]


def test_quotes_and_spans(spark):
    df = spark.createDataFrame([("abcabc", "ca"), ("abcabc", "bc"), ("abc", "x"), ("abc", " "), ("abc", None)], "t string, q string")
    got = [r[0] for r in df.select(provenance.verify_quote(F.col("t"), F.col("q"))).collect()]
    assert [(g["verified"], g["reason"], g["start_char"]) for g in got] == [(True, "EXACT_MATCH", 2), (False, "AMBIGUOUS_MULTIPLE_OCCURRENCES", None), (False, "QUOTE_NOT_FOUND", None), (False, "INVALID_QUOTE", None), (False, "INVALID_QUOTE", None)]
    sp = spark.createDataFrame([("abc", "bc", 1, 3), ("abc", "bx", 1, 3), ("abc", "b", 2, 1), ("abc", "b", None, 1)], "t string, q string, s int, e int")
    assert [r[0] for r in sp.select(provenance.verify_span(F.col("t"), F.col("q"), F.col("s"), F.col("e"))["reason"]).collect()] == ["EXACT_MATCH", "SPAN_TEXT_MISMATCH", "INVALID_SPAN", "INVALID_SPAN"]


# -- policy -----------------------------------------------------------------------------------------------------------------


CAND = "g int, candidate_id long, bm25_rank int, bm25_score double, chunk_id long, start_char int, contradiction double, entailment double, neutral double, provenance_verified boolean, numeric_match boolean, claim_relevant boolean"


def cand(g, i, con, ent, neu, prov=True, num=True, rel=True, rank=1):
    return (g, i, rank, 0.9, 1, 0, con, ent, neu, prov, num, rel)


def test_decision_table(spark):
    rows = [
        cand(1, 1, 0.01, 0.81, 0.1), *[cand(1, 10 + i, 0.99, 0.0, 0.01) for i in range(8)],
        cand(2, 1, 0.1, 0.8, 0.1), cand(2, 2, 0.1, 0.8, 0.1), *[cand(2, 10 + i, 0.99, 0.0, 0.01) for i in range(4)],
        cand(3, 1, 0.01, 0.92, 0.1), *[cand(3, 10 + i, 0.95, 0.0, 0.05) for i in range(3)],
        cand(4, 1, 0.9, 0.05, 0.05), cand(5, 1, 0.1, 0.8, 0.1), cand(6, 1, 0.1, 0.8, 0.1, num=False), cand(7, 1, 0.2, 0.6, 0.2), cand(8, 1, 0.2, 0.6, 0.2, num=False),
        cand(9, 1, 0.3, 0.3, 0.4), cand(10, 1, 0.9, 0.05, 0.05, rel=False), cand(11, 1, 0.1, 0.9, 0.0, prov=False), (12, 1, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r["g"]: (r["verdict"], r["reason"], r["selected"]) for r in policy.decide(spark.createDataFrame(rows, CAND), "g").collect()}
    assert got[1][:2] == ("ABSTAIN", "CONTRADICTIONS_DOMINATE_ENTAILMENT_SIGNAL")
    assert got[2][:2] == ("WARN", "STRONG_ENTAILMENT_AND_CONTRADICTION")
    assert got[3][0] == "WARN"
    assert got[4] == ("FAIL", "STRONG_CONTRADICTION", 1)
    assert got[5] == ("PASS", "STRONG_ENTAILMENT_WITH_PROVENANCE", 1)
    assert got[6][:2] == ("WARN", "NUMERIC_VALUE_NOT_VERIFIED")
    assert got[7][1] == "MODERATE_ENTAILMENT" and got[8][1] == "MODERATE_ENTAILMENT_NUMERIC_MISMATCH"
    for g in (9, 10, 11, 12):
        assert got[g][:2] == ("ABSTAIN", "NO_SEMANTIC_SCORE_CROSSED_THRESHOLD")


def test_selection_prefers_rank_then_score(spark):
    rows = [cand(1, 1, 0.0, 0.75, 0.2, rank=2), cand(1, 2, 0.0, 0.95, 0.05, rank=3), cand(1, 3, 0.0, 0.71, 0.2, rank=1), cand(1, 4, 0.0, 0.9, 0.1, rank=1)]
    assert policy.decide(spark.createDataFrame(rows, CAND), "g").first()["selected"] == 4


def test_softmax_gate_guards(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (800.0, 0.0, -800.0)], "c double, e double, n double")
    got = [r[0] for r in df.select(policy.softmax(F.col("c"), F.col("e"), F.col("n"))).collect()]
    assert got[0]["label"] == "contradiction" and abs(sum(list(got[0])[:3]) - 1) < 1e-9 and got[1] is None and got[2] is None and got[3]["contradiction"] == 1.0
    g = spark.createDataFrame([("PASS", True), ("PASS", None), ("FAIL", False)], "v string, p boolean")
    assert [r[0] for r in g.select(policy.gate(F.col("v"), F.col("p"))).collect()] == ["PASS", "ABSTAIN", "FAIL"]
    v = spark.createDataFrame([("pass", True, 0.5, 1, 2), ("PASS", False, 0.5, 1, 2), ("no", True, 0.5, 1, 2), ("FAIL", False, 1.5, 1, 2), ("WARN", False, None, 2, 2), (None, True, 0.1, 1, 2)], "v string, p boolean, s double, a int, b int")
    assert [r[0] for r in v.select(policy.verification_violations(F.col("v"), F.col("p"), [F.col("s")], F.col("a"), F.col("b"))).collect()] == [None, "PASS_WITHOUT_PROVENANCE", "INVALID_VERDICT", "SCORE_OUT_OF_RANGE", "END_NOT_AFTER_START", "INVALID_VERDICT"]


# -- store ------------------------------------------------------------------------------------------------------------------


def test_upsert(spark):
    schema = "canonical_id string, doi string, year int, created_at string, updated_at string, id long"
    first = spark.createDataFrame([("a", " d1 ", None, "t1", "t1", 1), ("a", " ", 2001, "t2", "t2", 2), ("b", None, 1, "t3", "t3", 3), (" ", "x", 1, "t", "t", 4)], schema)
    one = store.upsert(None, first, "canonical_id", ["doi", "year"], ["updated_at", "id"])
    assert sorted(map(tuple, one.collect())) == [("a", "d1", 2001, "t1", "t2", 2), ("b", None, 1, "t3", "t3", 1)]
    second = spark.createDataFrame([("a", "d2", None, "t9", "t9", 9)], schema)
    two = store.upsert(one.drop("n_writes"), second, "canonical_id", ["doi", "year"], ["updated_at", "id"])
    assert sorted(map(tuple, two.collect()))[0] == ("a", "d2", 2001, "t1", "t9", 2)


def test_claims_chunks_integrity(spark):
    c = spark.createDataFrame([(1, "a  b"), (2, "a\nb"), (3, " "), (4, None), (5, "a B")], "id long, claim_text string")
    assert sorted(r["n"] for r in store.claim_dedup(c).collect()) == [1, 2]
    old = spark.createDataFrame([(1, "h", 0, "x"), (2, "h", 0, "y")], "paper_id long, content_hash string, chunk_index int, text string")
    new = spark.createDataFrame([(1, "h", 5, "p"), (1, "h", 9, "q")], "paper_id long, content_hash string, chunk_index int, text string")
    assert sorted(map(tuple, store.replace_chunks(old, new, ["paper_id", "content_hash"]).collect())) == [(1, "h", 0, "p"), (1, "h", 1, "q"), (2, "h", 0, "y")]
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    t = spark.createDataFrame([(1, "x", h.upper()), (2, "y", h), (3, None, h), (4, "x", "bad")], "id long, text string, content_hash string")
    assert [r["state"] for r in store.integrity(t, "id").orderBy("id").collect()] == ["OK", "MISMATCH", "NO_TEXT", "NO_HASH"]


def test_lookup_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "i int, k string")
    look = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    got = skew.lookup_join(rows, look, "k", rows.count(), "n")
    assert got.count() == 300 and got.select("i").distinct().count() == 300 and set(got.columns) == {"k", "i", "v"}


# -- batches -------------------------------------------------------------------------------------------------------------------


def test_validate_and_summary(spark):
    items = spark.createDataFrame([(0, " c ", "s"), (1, None, "s"), (2, "c", None), (3, " ", "s"), (4, "c", "\t")], "index int, claim string, source string")
    got = batch.validate(items).orderBy("index").collect()
    assert [(r["ok"], r["reason"]) for r in got] == [(True, None), (False, "claim must be a string."), (False, "source must be a string."), (False, "claim cannot be empty."), (False, "source cannot be empty.")]
    res = spark.createDataFrame([(True, "PASS", "a"), (True, "FAIL", "a"), (False, None, "b")], "ok boolean, verdict string, source string")
    assert tuple(batch.summary(res).first()) == (3, 1, 0, 1, 0, 1, 1)


def test_single_equals_batch(spark):
    chunks = spark.createDataFrame([(1, 10, 0, 0, "Mortality fell by 15% in treated mice."), (1, 11, 1, 40, "Weather was fine."), (2, 12, 0, 0, "Nothing here.")], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    pairs = spark.createDataFrame([(1, 1, "Mortality fell by 15% in mice"), (2, 1, "Mortality fell by 99% in mice"), (3, 2, "Quantum gravity")], "claim_id long, source_id long, claim string")
    together = {r["claim_id"]: r for r in batch.verify(pairs, chunks).collect()}
    for k in (1, 2, 3):
        assert batch.verify(pairs.where(F.col("claim_id") == k), chunks).first() == together[k]
    assert together[1]["verdict"] == "PASS" and together[2]["verdict"] != "PASS" and together[3]["reason"] == "NO_LEXICAL_CANDIDATES"
    assert {r["model"] for r in together.values()} == {"lexical_stub"}


def test_verify_of_a_large_source_shuffles_only_what_it_found(spark):
    """Pairs times chunks of a source are nowhere shuffled, not even once; chunks found are looked for once."""
    words = [f"{a}{b}" for a in ("reef", "coral", "tide", "fish") for b in ("al", "or", "um", "ine", "ost")]
    rng = random.Random(8)
    texts = [" ".join(["the", "of", "in", "and", *rng.choices(words, k=9), f"{i} percent."]) for i in range(1000)]
    chunks = spark.createDataFrame([(1, i, i, 0, t) for i, t in enumerate(texts)], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    pairs = spark.createDataFrame([(i, 1, texts[i]) for i in range(200)] + [(900, 1, "the of in and quantum 5")], "claim_id long, source_id long, claim string")
    got, n = shuffled(spark, lambda: {r["claim_id"]: r for r in batch.verify(pairs, chunks).collect()})
    assert len(got) == 201 and all(got[i]["verdict"] == "PASS" and got[i]["candidate_id"] == 100000 for i in range(200)) and got[900]["verdict"] == "ABSTAIN"
    assert {r["n_windows"] for r in got.values()} == {5}
    assert n < 200 * 1000 / 4
    assert "MapInArrow" not in batch.verify(pairs.limit(3), chunks)._jdf.queryExecution().toString()


def large_batch(spark):
    """200 items and a bad one put to a source of 1,000 chunks."""
    texts = [f"the of in and reef{i % 37} coral{i % 41} tide{i} {i} percent." for i in range(1000)]
    chunks = spark.createDataFrame([(1, i, i, 0, t) for i, t in enumerate(texts)], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    items = spark.createDataFrame([(i, texts[i], "s1") for i in range(200)] + [(200, None, "s1")], "index long, claim string, source string")
    return batch.verify_claims(items, spark.createDataFrame([("s1", 1, None)], "source string, source_id long, error string"), chunks)


def test_results_of_a_large_source_shuffle_only_what_was_found(spark):
    got, n = shuffled(spark, lambda: {r["index"]: r["verdict"] for r in large_batch(spark).collect()})
    assert got == {i: "PASS" for i in range(200)} | {200: None} and n < 200 * 1000 / 4


def test_totals_of_a_large_source_shuffle_only_what_was_found(spark):
    s, n = shuffled(spark, lambda: batch.summary(large_batch(spark)).first())
    assert (s["total"], s["passed"], s["errors"], s["source_loads"]) == (201, 200, 1, 1) and n < 200 * 1000 / 4


def left_on_disk(spark, run):
    """(what ``run`` gives, bytes of checkpoints and shuffle files that it leaves)."""

    def files():
        env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        shuffles = env.blockManager().diskBlockManager().getAllFiles()
        shuffles = [Path(shuffles.apply(i).getPath()) for i in range(shuffles.length())]
        checkpoints = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*")
        return {p: p.stat().st_size for p in [*shuffles, *checkpoints] if p.is_file()}

    before = files()
    got = run()
    return got, sum(n for p, n in files().items() if p not in before)


def long_batch(spark):
    """20 items put to 300 chunks of 2,000 characters, 600 KB of text that hardly compresses."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(60):015x}" for _ in range(125)) for _ in range(300)]
    chunks = spark.createDataFrame([(i % 20, i, i, 0, t) for i, t in enumerate(texts)], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    items = spark.createDataFrame([(i, texts[i][:159], f"s{i}") for i in range(20)], "index long, claim string, source string")
    return batch.verify_claims(items, spark.createDataFrame([(f"s{i}", i, None) for i in range(20)], "source string, source_id long, error string"), chunks)


def test_results_leave_no_texts_on_disk(spark):
    got, n = left_on_disk(spark, lambda: {r["index"]: (r["verdict"], r["loaded"]) for r in long_batch(spark).collect()})
    assert got == {i: ("PASS", i) for i in range(20)} and n < 600_000 / 4


def test_totals_leave_no_texts_on_disk(spark):
    s, n = left_on_disk(spark, lambda: batch.summary(long_batch(spark)).first())
    assert (s["total"], s["passed"], s["source_loads"]) == (20, 20, 20) and n < 600_000 / 4


def test_totals_hold_a_share_of_the_texts_at_a_time(spark, monkeypatch):
    """Where there are many pairs, no more than a round's chunks are on disk together, and each chunk is in one round."""
    held, top_k = [], retrieval.top_k

    def seen(queries, chunks, *args, **more):
        held.append(chunks.count())
        return top_k(queries, chunks, *args, **more)

    monkeypatch.setattr(batch, "ROUND", 5, raising=False)
    monkeypatch.setattr(retrieval, "top_k", seen)
    s = batch.summary(long_batch(spark)).first()
    assert (s["total"], s["passed"], s["source_loads"]) == (20, 20, 20) and sum(held) == 300 and max(held) <= 300 / 2


def test_rounds_change_no_verdict(spark, monkeypatch):
    """A source in parts, small ones, one without chunks and none; ids of pairs and chunks differ in type."""
    texts = [f"the of in and reef{i % 37} coral{i % 41} tide{i} {i} percent." for i in range(1000)]
    chunks = spark.createDataFrame([(1 if i < 700 else 2 + i % 9, i, i, 0, t) for i, t in enumerate(texts)], "source_id int, chunk_id long, chunk_index int, start_char int, text string")
    pairs = spark.createDataFrame([(i, 1 if i < 700 else 2 + i % 9, texts[i]) for i in range(0, 1000, 9)] + [(2000, 99, "reef1"), (2001, None, "reef1"), (2002, 1, "quantum")], "claim_id long, source_id long, claim string")
    once = sorted(batch.verify(pairs, chunks).collect(), key=lambda r: r["claim_id"])
    monkeypatch.setattr(batch, "ROUND", 10, raising=False)
    assert sorted(batch.verify(pairs, chunks).collect(), key=lambda r: r["claim_id"]) == once
    assert len(once) == 115 and {r["verdict"] for r in once[:112]} == {"PASS"} and {r["reason"] for r in once[112:]} == {"NO_LEXICAL_CANDIDATES"}


def test_reports(spark):
    df = spark.createDataFrame([(1, '{"summary": {"total_errors_found": null, "total_warnings_found": 2}}'), (2, '{"summary": {"total_unverified_refs": 1}}'), (3, "{broken"), (4, None)], "id int, report string")
    t = readers.report_totals(df)
    got = t.select("id", *batch.report_summary({k: F.col(k) for k in ("references", "errors", "warnings", "unverified", "information")})).orderBy("id").collect()
    assert [r["citation_health"] for r in got] == ["Fair", "Poor", "Good", "Good"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.pdf").write_bytes(b"")
    got = {r["path"].rpartition("/")[2]: r["accepted"] for r in readers.binary_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}  # Spark gives no row for an empty file


# -- scoring -------------------------------------------------------------------------------------------------------------------


def test_labels_and_length():
    assert nli.resolve_labels({0: "Entailment", 1: "NEUTRAL", 2: "contradiction"}) == [2, 0, 1]
    assert nli.resolve_labels({"0": "nli_entailment", 1: "is-neutral", 2: "Contradiction (strong)", 3: "other", "x": "entailment"}) == [2, 0, 1]
    for bad in ({0: "entailment", 1: "entailment", 2: "neutral"}, {0: "a", 1: "b", 2: "c"}, {0: "entailment", 1: "neutral"}, {0: "entail", 1: "contra", 2: "neutral"}, {0: "entailment", 1: "an entailment", 2: "neutral", 3: "contradiction"}):
        with pytest.raises(ValueError):
            nli.resolve_labels(bad)
    assert nli.max_length(10**30, 400) == 400 and nli.max_length(None, None) == 512 and nli.max_length(9999, None) == 512


def _spans(text):
    return [m.span() for m in re.finditer(r"\S+", text)]


def test_only_the_premise_is_cut():
    assert nli.fitted_pair("a b c d", "x y", _spans, 9, 3) == ("a b c d", False)
    assert nli.fitted_pair("a bb c d", "x y", _spans, 7, 3) == ("a bb", True)
    assert nli.fitted_pair("a b c d", "x y", _spans, 5, 3) == (None, False)


def test_scorer_with_a_limit(spark):
    def factory():
        return (lambda ps, hs: [[float(len(p)), float("nan") if h == "bad" else 0.0, 1.0] for p, h in zip(ps, hs)]), {0: "entailment", 1: "neutral", 2: "contradiction"}, lambda t: [(i, i + 1) for i in range(len(t))]

    df = spark.createDataFrame([(1, "abcdef", "c"), (2, "abcdef", "ccccccc"), (3, "ab", "bad"), (4, None, "c")], "id int, quote string, claim string")
    got = {r["id"]: r for r in nli.score(df, factory, limit=8, special=3).collect()}
    assert got[1]["premise_truncated"] and got[1]["predicted_label"] == "entailment" and got[1]["score_error"] is None
    assert got[2]["score_error"] == "CLAIM_TOO_LONG" and got[2]["entailment"] is None and not got[2]["premise_truncated"]
    assert got[3]["score_error"] == "NOT_FINITE" and got[4]["score_error"] is None and got[4]["entailment"] is None


def test_verify_claims_whole(spark):
    chunks = spark.createDataFrame([(1, 10, 0, 0, "The reef lost 40 percent of its coral cover."), (2, 20, 0, 0, "Nothing of interest.")], "source_id long, chunk_id long, chunk_index int, start_char int, text string")
    sources = spark.createDataFrame([("s1", 1, None), ("s2", 2, None), ("s3", None, "PDFEncryptedError")], "source string, source_id long, error string")
    items = [(0, " The reef lost 40 percent of its coral cover ", "s1"), (1, "The reef lost coral cover", "s2"), (2, "any", "s3"), (3, "any", "s4"), (4, None, "s1"), (5, "x", " "), (6, "The reef lost 40 percent of its coral cover", "s1 ")]
    df = spark.createDataFrame(items, "index long, claim string, source string")
    r = batch.verify_claims(df, sources, chunks)
    got = {x["index"]: (x["ok"], x["source_state"], x["verdict"], x["error_type"]) for x in r.collect()}
    assert got == {
        0: (True, "FULL_TEXT", "PASS", None), 1: (True, "FULL_TEXT", "ABSTAIN", None), 2: (True, "ENCRYPTED_PDF", "ABSTAIN", "PDFEncryptedError"), 3: (True, "SOURCE_UNAVAILABLE", "ABSTAIN", "SourceLoaderError"),
        4: (False, "ERROR", None, "INVALID_INPUT"), 5: (False, "ERROR", None, "INVALID_INPUT"), 6: (True, "FULL_TEXT", "PASS", None),
    }
    s = batch.summary(r).first()
    assert (s["total"], s["passed"], s["abstained"], s["errors"], s["unique_sources"], s["source_loads"], s["bm25_indexes_built"], s["top_k"]) == (7, 2, 3, 2, 4, 2, 2, 5)

    def against():
        return (lambda ps, hs: [[9.0, 0.0, 0.0] for _ in ps]), {0: "contradiction", 1: "neutral", 2: "entailment"}

    m = batch.verify(df.where("index = 0").selectExpr("index AS claim_id", "1L AS source_id", "claim"), chunks, factory=against, model="m")
    assert [(x["verdict"], x["model"]) for x in m.collect()] == [("FAIL", "m")]


def test_scorer(spark):
    def factory():
        return (lambda ps, hs: [[0.0, float(len(p)), 1.0] for p in ps]), {0: "neutral", 1: "entailment", 2: "contradiction"}

    df = spark.createDataFrame([(1, "long evidence", "c"), (2, " ", "c"), (3, None, "c")], "id int, quote string, claim string")
    got = nli.score(df, factory).orderBy("id").collect()
    assert got[0]["predicted_label"] == "entailment" and got[1]["entailment"] is None and got[2]["predicted_label"] is None
