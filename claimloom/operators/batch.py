"""Batch of (claim, source) items: validation, grouping, verification, response rows, summary."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, functions as F

from claimloom.functions.text import content_stems, coverage, hashed, numbers, numbers_match, strip
from claimloom.operators import chunking, nli, policy, retrieval
from claimloom.session import cut, kept

# Source states of failed acquisitions, and what they are called by.
SOURCE_STATES = [
    ("UnsupportedSourceError", "UNSUPPORTED_SOURCE"),
    ("SourceSecurityError", "BLOCKED_SOURCE"),
    ("SourceDownloadError", "SOURCE_UNAVAILABLE"),
    ("SourceCacheError", "CACHE_ERROR"),
    ("PDFEncryptedError", "ENCRYPTED_PDF"),
    ("PDFNoTextError", "NO_EXTRACTABLE_TEXT"),
    ("PDFExtractionError", "EXTRACTION_FAILED"),
]
#: Share of a claim's stems that evidence needs to be about it.
RELEVANT = 0.30
#: Identity of the stand-in scorer; it is lexical and no language inference.
STUB_MODEL = "lexical_stub"
#: Pairs are verified in rounds of about so many, but in at most MOST_ROUNDS rounds: each reads the chunks' table anew.
ROUND, MOST_ROUNDS = 100_000, 4


def validation(claim: Column, source: Column) -> Column:
    """struct(ok, claim, source, reason) of an item; a null stands for a value that is no string."""
    c, s = strip(claim), strip(source)
    reason = F.when(claim.isNull(), "claim must be a string.").when(source.isNull(), "source must be a string.").when(c == "", "claim cannot be empty.").when(s == "", "source cannot be empty.")
    return F.struct(reason.isNull().alias("ok"), c.alias("claim"), s.alias("source"), reason.alias("reason"))


def validate(items: DataFrame) -> DataFrame:
    """items(index, claim, source) -> (index, ok, claim, source, reason, error_type)."""
    v = items.select("index", validation(F.col("claim"), F.col("source")).alias("v"))
    return v.select("index", "v.ok", "v.claim", "v.source", "v.reason", F.when(~F.col("v.ok"), "INVALID_INPUT").alias("error_type"))


def source_state(error: Column) -> Column:
    """The state of a source whose acquisition failed with the named error; unknown errors mean unavailable."""
    out = None
    for name, state in SOURCE_STATES:
        out = F.when(error == name, state) if out is None else out.when(error == name, state)
    return out.otherwise("SOURCE_UNAVAILABLE")


def group_sources(valid: DataFrame) -> DataFrame:
    """(source, first_index, n_claims): sources as spelled, in the order they first came."""
    return valid.groupBy("source").agg(F.min("index").alias("first_index"), F.count("*").alias("n_claims"))


def lexical_scores(cov: Column, numbers_hit: Column) -> list[Column]:
    """Deterministic stand-in for a language-inference model, made of stem coverage and numbers; named STUB_MODEL."""
    ent = F.round(cov * F.when(numbers_hit, 0.9).otherwise(0.6), 6)
    con = F.round(F.when(numbers_hit, 0.05).otherwise(0.3 * cov), 6)
    return [con.alias("contradiction"), ent.alias("entailment"), F.round(1.0 - ent - con, 6).alias("neutral")]


def _verdicts(asked: DataFrame, chunks: DataFrame, k: int, factory: nli.Factory | None, every: int | None) -> DataFrame:
    """``verify`` for pairs that are kept: what ``policy.decide`` says of each, nulls where no candidate was found. ``every``: chunks of all
    rounds."""
    with ExitStack() as steps:
        with kept(retrieval.searchable(chunks)) as corpus:
            hits = retrieval.top_k(asked.select(F.col("claim_id").alias("query_id"), "source_id", F.col("claim").alias("query_text")), corpus, k, every=every)
            hits = steps.enter_context(kept(hits.select(F.col("query_id").alias("claim_id"), "source_id", "rank", "chunk_id", "score")))
        # Stems and numbers are taken once a claim and once a window, before pairs multiply them.
        w = chunking.windows(chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"), "chunk_id")
        quote = [] if factory is None else ["quote"]
        w = steps.enter_context(kept(w.select("chunk_id", "window_index", "start_char", *quote, hashed(content_stems(F.col("quote"))).alias("q_stems"), hashed(numbers(F.col("quote"))).alias("q_numbers"))))
        texts = asked.select("claim_id", "claim").distinct()
        c = texts.select("claim_id", hashed(content_stems(F.col("claim"))).alias("c_stems"), hashed(numbers(F.col("claim"))).alias("c_numbers"))
        rows = hits.join(c, "claim_id").join(w, "chunk_id")
        rows = rows.withColumn("coverage", coverage(F.col("c_stems"), F.col("q_stems"))).withColumn("numbers_hit", numbers_match(F.col("c_numbers"), F.col("q_numbers")))
        scores = lexical_scores(F.col("coverage"), F.col("numbers_hit"))
        if factory is not None:
            rows = nli.score(rows.join(texts, "claim_id"), factory)
            scores = [F.col(x) for x in nli.LABELS]
        ev = rows.select(
            "claim_id", "source_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"), "chunk_id", "start_char",
            (F.col("rank") * 100000 + F.col("window_index")).cast("long").alias("candidate_id"),
            *scores,
            F.lit(True).alias("provenance_verified"),
            F.col("numbers_hit").alias("numeric_match"),
            (F.col("coverage") >= RELEVANT).alias("claim_relevant"),
        )
        # Partial sums would be larger than the rows: few of a pair's windows are in one place before.
        d = policy.decide(ev.repartition("claim_id", "source_id"), "claim_id", "source_id")
        return cut(asked.select("claim_id", "source_id").join(d, ["claim_id", "source_id"], "left"), tidy=True)


def verify(pairs: DataFrame, chunks: DataFrame, k: int = 5, factory: nli.Factory | None = None, model: str = "") -> DataFrame:
    """Verdicts for (claim_id, source_id, claim) over chunks(source_id, chunk_id, chunk_index, start_char, text).

    Retrieve k chunks per pair, cut them into windows, score windows with the model of ``factory`` (named ``model``; without one
    with the stand-in), guard numbers and relevance, decide. Windows that the model can't score decide nothing.
    Quotes are slices of the chunks' own text, so provenance holds by construction. A pair without a lexical candidate
    gets ABSTAIN / NO_LEXICAL_CANDIDATES. Scoring runs after the top-k exchange, on selected chunks only. Stems and numbers meet as
    64-bit hashes, and the scored windows are sent to their pair without text. It is done step by step, when called: pairs, search,
    windows, verdicts. Of each step only its result stays on disk, after the last only the verdicts. Many pairs go through these steps
    in rounds, a share of the sources with all their pairs and chunks in each, so that only a round's share is on disk at a time.
    """
    with kept(pairs.select("claim_id", "source_id", "claim")) as asked:
        rounds = min(MOST_ROUNDS, 1 + asked.count() // ROUND)
        every = None if rounds == 1 else chunks.select("chunk_id").count()
        kind, d = dict(chunks.dtypes)["source_id"], None  # hashes of equal ids differ by type
        for i in range(rounds):
            share = F.pmod(F.xxhash64(F.col("source_id").cast(kind)), F.lit(rounds)) == i
            own = _verdicts(asked.where(share), chunks.where(share), k, factory, every)
            d = own if d is None else d.unionByName(own)
    none = F.col("verdict").isNull()
    return d.select(
        "claim_id", "source_id",
        F.coalesce("verdict", F.lit("ABSTAIN")).alias("verdict"),
        F.coalesce("semantic_class", F.lit("INSUFFICIENT_EVIDENCE")).alias("semantic_class"),
        F.when(none, "NO_LEXICAL_CANDIDATES").otherwise(F.col("reason")).alias("reason"),
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.lit(STUB_MODEL if factory is None else model).alias("model"),
        F.col("selected").alias("candidate_id"),
    )


def verify_claims(items: DataFrame, sources: DataFrame, chunks: DataFrame, k: int = 5, factory: nli.Factory | None = None, model: str = "") -> DataFrame:
    """One result for every item: index, ok, claim, source, source_state, verdict, semantic_class, reason, error_type, loaded.

    items(index, claim, source), index unique; sources(source, source_id, error), one row for each source string whose
    acquisition was tried, ``error`` naming what failed (null: nothing); chunks as in ``verify``. An item that isn't valid is an
    error of its own (ok false, state ERROR, no verdict); one whose source couldn't be had, or was never tried,
    abstains with the state of that failure; neither keeps other items from being verified. Items share a source's chunks and
    postings, which are made once. ``loaded`` is the source's id where one was had. Rows come in no order; ``index`` tells it.
    """
    v = validate(items)
    tried = sources.select("source", "source_id", F.col("error").alias("_error"), F.lit(True).alias("_tried"))
    j = v.where("ok").join(tried, "source", "left")
    had = F.col("_error").isNull() & F.coalesce("_tried", F.lit(False))
    pairs = j.where(had).select(F.col("index").alias("claim_id"), "source_id", "claim")
    got = verify(pairs, chunks, k, factory, model).select(F.col("claim_id").alias("index"), "verdict", "semantic_class", F.col("reason").alias("_why"))
    error = F.coalesce("_error", F.lit("SourceLoaderError"))
    done = j.join(got, "index", "left").select(
        "index", F.lit(True).alias("ok"), "claim", "source", F.when(had, "FULL_TEXT").otherwise(source_state(error)).alias("source_state"),
        F.coalesce("verdict", F.lit("ABSTAIN")).alias("verdict"), F.coalesce("semantic_class", F.lit("INSUFFICIENT_EVIDENCE")).alias("semantic_class"),
        F.when(had, F.col("_why")).otherwise(F.concat(F.lit("Source not available: "), error)).alias("reason"), F.when(~had, error).alias("error_type"), F.when(had, F.col("source_id")).alias("loaded"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    bad = v.where("not ok").select("index", "ok", "claim", "source", F.lit("ERROR").alias("source_state"), none("verdict"), none("semantic_class"), "reason", "error_type", F.lit(None).cast(dict(sources.dtypes)["source_id"]).alias("loaded"))
    return done.unionByName(bad)


def summary(results: DataFrame, k: int = 5) -> DataFrame:
    """One row: counts by verdict, errors, distinct sources; with a column ``loaded`` also the sources had and the indexes
    built for them (one each), and ``top_k``. Input: ok, verdict, source."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    more = []
    if "loaded" in results.columns:
        loads = F.count_distinct("loaded")
        more = [loads.alias("source_loads"), loads.alias("bm25_indexes_built"), F.lit(k).alias("top_k")]
    return results.agg(
        F.count("*").alias("total"), n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), n("ABSTAIN").alias("abstained"),
        F.count_if(~F.col("ok")).alias("errors"), F.count_distinct(F.when(F.col("ok"), F.col("source"))).alias("unique_sources"), *more,
    )


def report_summary(totals: dict[str, Column]) -> list[Column]:
    """Totals of a bibliography report with its health: errors or unverified -> Poor, warnings -> Fair, else Good.
    Missing totals are 0."""
    t = {k: F.coalesce(v.try_cast("int"), F.lit(0)) for k, v in totals.items()}
    health = F.when((t["errors"] > 0) | (t["unverified"] > 0), "Poor").when(t["warnings"] > 0, "Fair").otherwise("Good")
    return [*[v.alias(f"total_{k}") for k, v in t.items()], health.alias("citation_health")]
