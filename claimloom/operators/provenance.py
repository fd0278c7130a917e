"""Exact provenance: where a quote stands in its source, and whether a span holds it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from claimloom.functions.text import strip


def occurrences(text: Column, quote: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """0-based starts of every occurrence, overlapping ones included, case counting, within [lo, hi) if given.

    Null for a null text or quote; empty for a blank quote. Occurrences are counted first; each is then located from the one
    before, so the work follows the number of occurrences, not the square of the text's length.
    """
    lo = F.lit(0) if lo is None else lo
    hi = F.length(text) if hi is None else hi
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    n = F.regexp_count(text, literal)
    step = lambda acc, _: F.concat(acc, F.array(F.call_function("locate", quote, text, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-1)) + 2) - 1))
    every = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.array().cast("array<int>"), step)
    inside = F.filter(every, lambda i: (i >= lo) & (i + F.length(quote) <= hi))
    return F.when(text.isNull() | quote.isNull(), F.lit(None)).when((strip(quote) == "") | ~F.contains(text, quote), F.array().cast("array<int>")).otherwise(inside)


def verify_quote(text: Column, quote: Column, unique: bool = True) -> Column:
    """struct(verified, reason, start_char, end_char, occurrence_count) of a quote in a text."""
    at = occurrences(text, quote)
    n = F.coalesce(F.size(at), F.lit(0))
    n = F.greatest(n, F.lit(0))
    one = n == 1 if unique else n >= 1
    reason = (
        F.when(F.coalesce(strip(quote), F.lit("")) == "", "INVALID_QUOTE").when(n == 0, "QUOTE_NOT_FOUND").when(one, "EXACT_MATCH").otherwise("AMBIGUOUS_MULTIPLE_OCCURRENCES")
    )
    first = F.when(one, F.get(at, F.lit(0)))
    return F.struct(one.alias("verified"), reason.alias("reason"), first.alias("start_char"), (first + F.length(quote)).alias("end_char"), n.alias("occurrence_count"))


def verify_span(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """struct(verified, reason): the slice [start, end) of the text is the quote."""
    valid = (start >= 0) & (start < end) & (end <= F.length(text)) & (strip(quote) != "")
    same = F.substring(text, start + 1, end - start) == quote
    reason = F.when(~F.coalesce(valid, F.lit(False)), "INVALID_SPAN").when(same, "EXACT_MATCH").otherwise("SPAN_TEXT_MISMATCH")
    return F.struct((reason == "EXACT_MATCH").alias("verified"), reason.alias("reason"))
