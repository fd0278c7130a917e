"""Collapsing of formatting copies."""

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from claimloom.llm import dedup

SAME = [
    ["In cohort AB-12, X rose by 1.7% (p > 0.95).", "in  cohort ab-12\tx rose by 1.7% [p > 0.95]", "“In cohort AB-12: X rose, by 1.7 % (p>0.95)...”", "In c\u200bohort АB‐12, X rose by １.7% (p > 0.95)!"],
    ["Cohort: AB; Effect: -5.4; Size: 1,234", "effect=-5.4, size=1234, cohort=AB", '{"Size": "1234", "Cohort": "ab", "Effect": "-5.4"}', '- Effect: "-5.4"\n- Cohort: "AB"\n- Size: "1,234"', "(SIZE = 1234\nCOHORT = AB\nEFFECT = -5.4)", "Size: 1234 | Effect: -5.4 | Cohort: AB"],
    ["Among 45,678 mice", "among 45678 mice."],
]
DIFFERENT = [
    "effect was 5.4", "effect was -5.4", "effect was 54", "effect was 5.4 5", "p < 0.5", "p > 0.5", "A beats B", "B beats A", "café", "cafe", "Cohort: A; Effect: B", "Cohort: B; Effect: A", "x²", "x2", "1 23", "12 3",
]


def test_same_and_different():
    keys = [{dedup.canonical(t) for t in group} for group in SAME]
    assert all(len(k) == 1 for k in keys) and len(set().union(*keys)) == len(SAME)
    assert len({dedup.canonical(t) for t in DIFFERENT}) == len(DIFFERENT)
    assert [dedup.canonical(t) for t in (None, "", " ", "...!", "\u200b")] == [None] * 5


@given(st.text(max_size=60))
def test_canonical_ignores_case_of_ascii_and_outer_space(t):
    assert dedup.canonical(t) == dedup.canonical(" \t" + t + "\n ")


def brute(rows):
    groups = {}
    for i, t in rows:
        k = dedup.canonical(t)
        if k is not None:
            groups.setdefault(k, []).append(i)
    return groups


def test_frames(spark):
    texts = [t for g in SAME for t in g] + DIFFERENT + [None, "", " ", SAME[0][0]] + [SAME[0][0]] * 50 + ["word " * 50_000, "WORD\n" * 50_000]
    rows = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "id long, claim_text string, canon string, n int")
    groups = brute(rows)
    want = sorted((min(v), i) for v in groups.values() for i in v if i != min(v))
    assert sorted(map(tuple, dedup.copies(df).collect())) == want
    got = {r["kept_id"]: (r["copies"], r["variants"]) for r in dedup.collapse(df).collect()}
    assert got == {min(v): (len(v), len({texts[i - 1] for i in v})) for v in groups.values()}
    assert dedup.copies(df.limit(0)).count() == 0 and dedup.collapse(df.where(F.col("claim_text").isNull())).count() == 0
