"""Text functions as column expressions. Python runs only for Unicode normal forms and case folding."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The white space that stripping removes, as the inside of a character class.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_HEAD, _TAIL = f"^[{WS}]+", f"[{WS}]+$"

# Tokens of retrieval, words of relevance, numbers.
TOKEN = r"[\p{L}\p{N}]+(?:[.\-/:][\p{L}\p{N}]+)*%?|<=|>=|<|>|="
WORD = r"[a-zA-Z]+"
NUMBER = r"(?<![\p{L}\p{N}_.])[+-]?(?:[0-9]+(?:[.,][0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?%?(?![\p{L}\p{N}_.])"

# Words that say nothing about the subject of a claim.
STOPWORDS = [
    "a", "about", "above", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "could", "did", "do", "does", "down", "during", "each", "even", "few", "for", "from", "had", "has", "have", "he", "her",
    "here", "him", "his", "i", "if", "in", "into", "is", "it", "its", "just", "may", "me", "might", "more", "most", "must", "my", "no", "not", "now",
    "of", "on", "only", "or", "other", "our", "out", "own", "said", "same", "shall", "she", "should", "so", "some", "such", "than", "that", "the",
    "their", "them", "then", "there", "these", "they", "this", "those", "though", "through", "to", "too", "until", "up", "us", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "whose", "will", "with", "would", "you", "your",
]

# Suffixes of the stemmer; the longest that leaves three letters goes.
SUFFIXES = [
    "izations", "ational", "fulness", "ousness", "iveness", "ization", "alising", "alizing", "alised", "alized", "ements", "alise", "alize", "alism",
    "aliti", "ement", "eness", "ities", "izers", "izer", "ment", "ate", "ify", "ion", "ity",
]
VERB_ENDINGS = ("edly", "ingly", "ing", "ed")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends (all of Unicode's, not just blanks)."""
    return F.regexp_replace(F.regexp_replace(c, _HEAD, ""), _TAIL, "")


@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; ASCII passes untouched."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@pandas_udf(StringType())
def searchable(s: pd.Series) -> pd.Series:
    """NFKC and case folding, for search tokens only."""
    return s.map(lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold())


@pandas_udf(StringType())
def comparable(s: pd.Series) -> pd.Series:
    """NFKD and case folding; combining marks then separate words."""
    return s.map(lambda x: None if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKD", x).casefold())


def normalize_text(c: Column) -> Column:
    """Canonical text: NFC, one kind of line end, plain spaces, no control characters, squeezed lines and gaps."""
    t = nfc(c)
    t = F.regexp_replace(t, r"\r\n|\r|\f", "\n")
    t = F.regexp_replace(t, r"[\x{a0}\x{2007}\x{202f}\t]", " ")
    t = F.regexp_replace(t, r"[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}]", "")
    t = F.regexp_replace(t, r" {2,}", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def tokens(c: Column) -> Column:
    """Search tokens in order, repeats kept."""
    return F.regexp_extract_all(searchable(c), F.lit(TOKEN), F.lit(0))


def squeezed(c: Column) -> Column:
    """All white space runs to one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cleaned(c: Column) -> Column:
    """Stripped, and null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def _without(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def stem(w: Column) -> Column:
    """Light suffix stripping of one lower-case word: plural, then a verb ending, then a derivational suffix."""
    plural = (
        F.when(F.endswith(w, F.lit("sses")), F.concat(_without(w, "es"), F.lit("ss")))
        .when(F.endswith(w, F.lit("ies")) & (F.length(w) > 4), F.concat(_without(w, "ies"), F.lit("i")))
        .when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), _without(w, "s"))
        .otherwise(w)
    )

    def verb(x: Column) -> Column:
        out = None
        for e in VERB_ENDINGS:
            hit = F.endswith(x, F.lit(e)) & (F.length(x) >= len(e) + 3)
            value = F.when(_without(x, e).rlike("[aeiou]"), _without(x, e)).otherwise(x)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out.otherwise(x)

    def derived(x: Column) -> Column:
        out = None
        for s in sorted(SUFFIXES, key=lambda s: (-len(s), s)):
            hit = F.endswith(x, F.lit(s)) & (F.length(x) >= len(s) + 3)
            out = F.when(hit, _without(x, s)) if out is None else out.when(hit, _without(x, s))
        return out.otherwise(x)

    # One-element transforms bind each step's result, so that the next doesn't repeat its expression.
    steps = F.transform(F.transform(F.array(plural), verb), derived)
    return F.when(F.length(w) <= 3, w).otherwise(F.get(steps, F.lit(0)))


def content_stems(c: Column) -> Column:
    """Distinct stems of the content words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(kept, stem))


def hashed(c: Column) -> Column:
    """64-bit hashes of an array's strings: as good as they are for telling which two arrays share, and shorter."""
    return F.transform(c, lambda x: F.xxhash64(x))


def coverage(claim: Column, evidence: Column) -> Column:
    """Share of the claim's stems that the evidence has; 1 without claim stems, 0 without evidence stems."""
    return F.when(F.size(claim) == 0, F.lit(1.0)).when(F.size(evidence) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(claim, evidence)) / F.size(claim))


def numbers(c: Column) -> Column:
    """Numbers written out in a text: commas, a final % and a leading + dropped."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    plain = F.transform(found, lambda n: F.regexp_replace(F.regexp_replace(F.translate(n, ",", ""), "%$", ""), r"^\+", ""))
    return F.filter(plain, lambda n: n != "")


def numbers_match(claim: Column, evidence: Column) -> Column:
    """Every number of the claim is among those of the evidence."""
    return F.size(F.array_except(claim, evidence)) == 0


def label(c: Column) -> Column:
    """A model's label in one spelling."""
    return F.translate(F.lower(strip(c)), "- ", "__")


def compared(c: Column) -> Column:
    """Letter and digit runs in compatibility form, joined by one blank."""
    return F.array_join(F.regexp_extract_all(comparable(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
