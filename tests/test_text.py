"""Text functions against tables of (input, output)."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    cases = {
        "a\r\nb\rc\fd": "a\nb\nc\nd", "a\u00a0b\u2007c\u202fd": "a b c d", "a\x00b\x07c": "abc", "a\tb": "a b", "a   b  \n  c": "a b\nc",
        "a\n\n\n\n\nb": "a\n\nb", "  \n a \n ": "a", "cafe\u0301": "café", "": "", "\u2003x\u2003": "x", "ﬁ": "ﬁ",
    }
    assert run(spark, T.normalize_text, list(cases)) == list(cases.values())
    assert run(spark, T.normalize_text, [None]) == [None]


def test_tokens(spark):
    cases = {
        "p < 0.05 and p >= 0.01": ["p", "<", "0.05", "and", "p", ">=", "0.01"], "SARS-CoV-2 mg/kg 92.4%": ["sars-cov-2", "mg/kg", "92.4%"],
        "doi 10.1038/s41467-025-58551-6.": ["doi", "10.1038/s41467-025-58551-6"], "a_b": ["a", "b"], "Straße ﬁne": ["strasse", "fine"], "...": [], "α α": ["α", "α"],
    }
    assert run(spark, T.tokens, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    "word,expected",
    [("cat", "cat"), ("classes", "classss"), ("studies", "studi"), ("dies", "die"), ("glass", "glass"), ("running", "runn"), ("bring", "bring"), ("hallucinate", "hallucin"), ("hallucinated", "hallucinat"),
     ("hallucinations", "hallucinat"), ("ability", "abil"), ("abilities", "abiliti"), ("usefulness", "use"), ("treatment", "treat"), ("repeatedly", "repeat"), ("strengths", "strength"), ("sing", "sing")],
)
def test_stem(spark, word, expected):
    assert run(spark, T.stem, [word]) == [expected]


def test_content_stems_and_coverage(spark):
    df = spark.createDataFrame([("The cats running", "A cat was running fast"), ("the of and", "x y"), ("mice", ""), ("mice", None)], "a string, b string")
    got = [r[0] for r in df.select(T.coverage(T.content_stems(F.col("a")), T.content_stems(F.coalesce("b", F.lit(""))))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.0]


def test_numbers(spark):
    cases = {
        "value is 15.": [], "92.4%.": ["92.4"], "1,234,567": ["1234", "567"], "10-20": ["10", "20"], "3,5": ["35"], "1.2.3": [], "mg15": [], "-5 and +5": ["-5", "5"], "1e10": ["1e10"],
        ".5 up": [".5"], "10.1038/s41467-025-58551-6": ["10.1038", "025", "58551", "6"], "": [],
    }
    assert run(spark, T.numbers, list(cases)) == list(cases.values())


def test_numbers_match(spark):
    df = spark.createDataFrame([("by 15%", "fell 15 percent"), ("by 15%", "fell 16"), ("no number", "x")], "a string, b string")
    assert [r[0] for r in df.select(T.numbers_match(T.numbers(F.col("a")), T.numbers(F.col("b")))).collect()] == [True, False, True]


def test_label_squeeze_clean_compare(spark):
    assert run(spark, T.label, [" Not-Entailment X "]) == ["not_entailment_x"]
    assert run(spark, T.squeezed, ["  a \u2003\n b "]) == ["a b"]
    assert run(spark, T.cleaned, [" ", " x ", None]) == [None, "x", None]
    assert run(spark, T.compared, ["café", "naïve", "A-b_C"]) == ["cafe", "nai ve", "a b c"]
