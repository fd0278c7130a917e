"""Problem 1: records that are identical but for white space, letter case, punctuation, field order or characters.

Method: byte-identical raw rows are collapsed first, with counts; only the distinct survivors are brought to
canonical text; then rows are grouped again on the full canonical text, summing the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from claimloom.llm.lookalike import skeleton
from claimloom.operators.skew import lookup_join
from claimloom.session import cut

_THOUSANDS = re.compile(r"(?<![\d.,])\d{1,3}(?:,\d{3})+(?![\d]|,\d)")
_CONTENT = re.compile(r"(?<![\w.])[+\-−]?(?:\d+(?:\.\d+)?|\.\d+)|[^\W_̀-ͯ]+[̀-ͯ]*|[<>]")
_FIELD = re.compile(r"(?:^|[;,|\n\r{(\[])[\s\-*•§¶({\[\"'“”]*([^\W\d_][^\W_]*(?:[ \t_\-]+[^\W_]+){0,4})[\"'“”]?\s*[:=]\s*")


def content(text: str) -> str:
    """What counts of a piece of prose: letters and digits in order, with signs and decimal points of
    numbers, < and >. White space, case, other punctuation and commas that group thousands are gone; one
    mark remains where two numbers would otherwise run together."""
    text = _THOUSANDS.sub(lambda m: m[0].replace(",", ""), text.casefold())
    out: list[str] = []
    for tok in _CONTENT.findall(text):
        tok = tok.replace("−", "-")
        if out and tok[0] in "0123456789.+" and out[-1][-1].isdigit():
            out.append("_")
        out.append(tok)
    return "".join(out)


def fields(text: str) -> list[tuple[str, str]] | None:
    """Named fields of a list in any of the usual notations (``a: b; ...``, ``a=b, ...``, lines, bars,
    bullets, JSON-like), or None for prose: at least two names, the first at the very start."""
    found = list(_FIELD.finditer(text))
    if len(found) < 2 or re.search(r"[^\W_]", text[: found[0].start(1)]):
        return None
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m[1], text[m.end() : e]) for m, e in zip(found, ends)]


def canonical(text: str | None) -> str | None:
    """The full canonical text; None for a text without a letter or digit."""
    if text is None:
        return None
    text = skeleton(text)
    named = fields(text)
    if named is None:
        body = content(text)
        return "p" + body if any(c.isalnum() for c in body) else None
    return "f" + "\x1e".join(sorted(f"{content(a)}\x1f{content(b)}" for a, b in named))


def _canonical_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(canon=[canonical(t) for t in pdf["text"]])


def canonical_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(text, first_id, n, canon) of each distinct raw text that is a record.

    Null texts and texts without a letter or digit are no records and are left out. ``n`` counts the
    byte-identical rows, ``first_id`` is their smallest key.
    """
    raw = rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(key).cast("long").alias("first_id"), F.count("*").alias("n"))
    return raw.mapInPandas(_canonical_batches, "text string, first_id long, n long, canon string").where("canon is not null")


def collapse(rows: DataFrame, key: str = "id", text: str = "claim_text") -> DataFrame:
    """One row per group of copies: kept_id (smallest key), copies (rows in the group), variants (different
    raw texts), kept_text. Ties can't occur while keys are unique; repeated keys count as further copies."""
    g = canonical_groups(rows, key, text)
    return g.groupBy("canon").agg(F.min("first_id").alias("kept_id"), F.sum("n").alias("copies"), F.count("*").alias("variants"), F.min_by("text", "first_id").alias("kept_text")).drop("canon")


def _digest(c: str) -> Column:
    """SHA-256 of a text: stands for it where rows only look something up, so that texts aren't shuffled again."""
    return F.unhex(F.sha2(c, 256))


def copies(rows: DataFrame, key: str = "id", text: str = "claim_text") -> DataFrame:
    """(kept_id, copy_id): one row for every record that isn't the first of its group.

    Texts are shuffled twice, for the two groupings (raw, then distinct canonical). Raw texts then find their group, and rows their raw
    text, by digest; a group or text with a large part of all is matched in place (see ``lookup_join``), so none is
    gathered in a task.
    """
    g = cut(canonical_groups(rows, key, text).select(_digest("text").alias("raw"), "first_id", "n", "canon"))
    kept = g.groupBy("canon").agg(F.min("first_id").alias("kept_id"), F.sum("n").alias("copies"), F.count("*").alias("variants")).where("copies > 1").select(_digest("canon").alias("group"), "kept_id", "variants")
    size = g.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    lookup = lookup_join(g.select("raw", "n", _digest("canon").alias("group")), kept, "group", size["texts"], "variants").select("raw", "kept_id", "n")
    slim = rows.where(F.col(text).isNotNull()).select(_digest(text).alias("raw"), F.col(key).cast("long").alias("copy_id"))
    return lookup_join(slim, lookup, "raw", size["rows"], "n").where("copy_id <> kept_id").select("kept_id", "copy_id")
