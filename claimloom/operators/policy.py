"""From scored evidence to verdicts: softmax, best-of selectors, the decision table, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds of the decision table.
STRONG, MODERATE, DOMINANCE, MARGIN = 0.70, 0.50, 3, 0.15

#: Columns a scored candidate has.
CANDIDATE = ["bm25_rank", "bm25_score", "chunk_id", "chunk_index", "quote", "start_char", "end_char", "contradiction", "entailment", "neutral", "provenance_verified", "numeric_match", "claim_relevant"]


def softmax(contradiction: Column, entailment: Column, neutral: Column) -> Column:
    """struct(contradiction, entailment, neutral, label) of three logits; null unless all are finite. Ties go to the first."""
    top = F.greatest(contradiction, entailment, neutral)
    e = [F.exp(x - top) for x in (contradiction, entailment, neutral)]
    total = e[0] + e[1] + e[2]
    label = F.when(contradiction == top, "contradiction").when(entailment == top, "entailment").otherwise("neutral")
    finite = None
    for x in (contradiction, entailment, neutral):
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        finite = ok if finite is None else finite & ok
    return F.when(finite, F.struct((e[0] / total).alias("contradiction"), (e[1] / total).alias("entailment"), (e[2] / total).alias("neutral"), label.alias("label")))


def _best(keep: Column, score: Column) -> Column:
    """The candidate with the lowest rank, then the highest score, BM25 score and the earliest start; ties by chunk."""
    key = F.struct("bm25_rank", (-score).alias("s"), (-F.col("bm25_score")).alias("b"), "start_char", "chunk_id", "candidate_id")
    return F.min_by(F.when(keep, F.struct("candidate_id", "bm25_rank", "entailment", "contradiction", "start_char", "numeric_match", "provenance_verified")), F.when(keep, key))


def decide(candidates: DataFrame, *by: str) -> DataFrame:
    """One verdict for each group of candidates: verdict, semantic_class, reason, selected candidate_id, n_windows.

    Missing scores count as 0, missing flags as false (relevance as true), missing ranks come last. All ties end in candidate_id, so the
    result doesn't depend on the order of rows. One aggregation with partial sums; no group is gathered.
    """
    big = 2**31 - 1
    c = candidates.select(
        *by,
        F.col("candidate_id").cast("long").alias("candidate_id"),
        F.coalesce("bm25_rank", F.lit(big)).cast("int").alias("bm25_rank"),
        *[F.coalesce(F.col(x), F.lit(0.0)).cast("double").alias(x) for x in ("bm25_score", "contradiction", "entailment", "neutral")],
        F.coalesce("start_char", F.lit(big)).cast("int").alias("start_char"),
        F.coalesce("chunk_id", F.lit(-1)).cast("long").alias("chunk_id"),
        *[F.coalesce(F.col(x), F.lit(d)).alias(x) for x, d in (("provenance_verified", False), ("numeric_match", False), ("claim_relevant", True))],
    )
    ent, con, neu, prov = (F.col(x) for x in ("entailment", "contradiction", "neutral", "provenance_verified"))
    s = (ent >= STRONG) & prov
    k = (con >= STRONG) & prov & F.col("claim_relevant")
    m = prov & (ent >= MODERATE) & (ent > neu) & (ent > con)
    numeric = F.col("numeric_match")
    g = c.groupBy(*by).agg(
        F.count("*").alias("n_windows"),
        F.count_if(s).alias("n_s"),
        F.count_if(k).alias("n_k"),
        F.max(F.when(s, ent)).alias("max_s"),
        F.max(F.when(k, con)).alias("max_k"),
        _best(s, ent).alias("best_s"),
        _best(s & numeric, ent).alias("best_sn"),
        _best(k, con).alias("best_k"),
        _best(m, ent).alias("best_m"),
        _best(m & numeric, ent).alias("best_mn"),
        _best(F.lit(True), neu).alias("best_n"),
    )
    has_s, has_k = F.col("n_s") > 0, F.col("n_k") > 0
    dominated = has_s & has_k & (F.col("n_k") >= DOMINANCE * F.col("n_s")) & (F.col("max_k") > F.col("max_s") + MARGIN)
    strength = lambda b: -F.greatest(F.col(f"{b}.entailment"), F.col(f"{b}.contradiction"))
    order = lambda b, side: F.struct(F.col(f"{b}.bm25_rank"), strength(b), F.col(f"{b}.start_char"), F.lit(side))
    either = F.when(order("best_s", 0) <= order("best_k", 1), F.col("best_s.candidate_id")).otherwise(F.col("best_k.candidate_id"))
    has_m = F.col("best_m").isNotNull()
    row = lambda verdict, kind, reason, chosen: F.struct(F.lit(verdict).alias("verdict"), F.lit(kind).alias("semantic_class"), reason if isinstance(reason, Column) else F.lit(reason).alias("reason"), chosen.alias("selected"))
    moderate = F.when(F.col("best_mn").isNotNull(), "MODERATE_ENTAILMENT").otherwise("MODERATE_ENTAILMENT_NUMERIC_MISMATCH").alias("reason")
    out = (
        F.when(dominated, row("ABSTAIN", "INSUFFICIENT_EVIDENCE", "CONTRADICTIONS_DOMINATE_ENTAILMENT_SIGNAL", F.col("best_n.candidate_id")))
        .when(has_s & has_k, row("WARN", "CONFLICTING_EVIDENCE", "STRONG_ENTAILMENT_AND_CONTRADICTION", either))
        .when(has_k, row("FAIL", "CONTRADICTED", "STRONG_CONTRADICTION", F.col("best_k.candidate_id")))
        .when(F.col("best_sn").isNotNull(), row("PASS", "SUPPORTED", "STRONG_ENTAILMENT_WITH_PROVENANCE", F.col("best_sn.candidate_id")))
        .when(has_s, row("WARN", "PARTIALLY_SUPPORTED", "NUMERIC_VALUE_NOT_VERIFIED", F.col("best_s.candidate_id")))
        .when(has_m, row("WARN", "PARTIALLY_SUPPORTED", moderate, F.coalesce("best_mn.candidate_id", "best_m.candidate_id")))
        .otherwise(row("ABSTAIN", "INSUFFICIENT_EVIDENCE", "NO_SEMANTIC_SCORE_CROSSED_THRESHOLD", F.col("best_n.candidate_id")))
    )
    return g.select(*by, "n_windows", out.alias("d")).select(*by, "n_windows", "d.verdict", "d.semantic_class", "d.reason", "d.selected")


def gate(verdict: Column, provenance: Column) -> Column:
    """Last gate: a PASS whose evidence isn't verified becomes ABSTAIN."""
    return F.when((verdict == "PASS") & ~F.coalesce(provenance, F.lit(False)), "ABSTAIN").otherwise(verdict)


def verification_violations(verdict: Column, provenance: Column, scores: list[Column], start: Column, end: Column) -> Column:
    """Why a verification must not be stored; null if it may be."""
    v = F.upper(F.trim(verdict))
    outside = None
    for s in scores:
        bad = F.coalesce(~s.between(0.0, 1.0), F.lit(False))
        outside = bad if outside is None else outside | bad
    return (
        F.when(~F.coalesce(v.isin("PASS", "WARN", "FAIL", "ABSTAIN"), F.lit(False)), "INVALID_VERDICT")
        .when((v == "PASS") & ~F.coalesce(provenance, F.lit(False)), "PASS_WITHOUT_PROVENANCE")
        .when(outside, "SCORE_OUT_OF_RANGE")
        .when(F.coalesce(end <= start, F.lit(False)), "END_NOT_AFTER_START")
    )
