"""Problem 4: oversized items cut at natural boundaries, with overlap.

Method: a hierarchy of separators (section, paragraph, line, sentence, word, character). A span that is too long is
split at its coarsest separators, and a part that is still too long at the next finer ones; consecutive
parts are packed greedily up to the limit, and each piece repeats the tail of the one before.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 4000, 600

# Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("al approx cf ch dr e.g eq eqs etc fig figs i.e mr mrs ms no nos p pp prof ref refs resp sec st tab vol vs".split())

_HEADING = re.compile(r"(?:^|\n)[ \t]*(?=(?:#{1,6} |\\(?:sub)*section\*?\{|(?:\d+\.)*\d+\.? [A-Z][^\n.]{0,80}\r?\n[ \t]*\r?\n))")
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n\s*|\f")
_LINE = re.compile(r"\r\n|\n|\r|[\x85  ]")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+(?=[\"'“‘(\[]*[^\Wa-z_])|[。！？]+")
_WORD = re.compile(r"\s+")
_LAST = re.compile(r"([^\s(\[]+)[.!?…]+[\"'”’)\]]*\s+\Z")
SECTION, PARAGRAPH, LINE, SENTENCE, WORD = range(5)


def cuts(text: str) -> list[list[int]]:
    """Positions where each separator of the hierarchy allows a cut, coarsest first, each list sorted."""
    sections = [m.start() + (text[m.start()] == "\n") for m in _HEADING.finditer(text)]
    sentences = []
    for m in _SENTENCE.finditer(text):
        word = _LAST.search(text[max(0, m.start() - 20) : m.end()])
        last = word[1].rstrip(".").lower() if word else ""
        if not (last in ABBREVIATIONS or len(last) == 1 and last.isalpha() and last != "i"):
            sentences.append(m.end())
    ends = lambda r: [m.end() for m in r.finditer(text)]
    return [sections, ends(_PARAGRAPH), ends(_LINE), sentences, ends(_WORD)]


def _whole(text: str, p: int) -> bool:
    """A cut at ``p`` parts no character from its marks and no line end."""
    ch = text[p] if p < len(text) else " "
    return not (unicodedata.combining(ch) or ch in "\u200d\ufe0f" or text[p - 1] == "\u200d" or text[p - 1 : p + 1] == "\r\n")


def _safe(text: str, at: int, least: int) -> int:
    """The last whole place from ``at`` back to ``least``; ``at`` if there is none near."""
    return next((p for p in range(at, max(least, at - 64), -1) if _whole(text, p)), at)


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the pieces of ``text``: each at most ``limit`` long, covering the text; each next one
    starts at most ``overlap`` before the end of the one before (later where a boundary falls inside)."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    levels, room = cuts(text), limit - overlap
    atoms: list[int] = []  # ends of the parts to pack

    def part(lo: int, hi: int, level: int) -> None:
        if hi - lo <= room:
            atoms.append(hi)
        elif level > WORD:
            while hi - lo > room:
                atoms.append(lo := _safe(text, lo + room, lo))
            if lo < hi:
                atoms.append(hi)
        else:
            at = levels[level]
            for p in at[bisect.bisect_right(at, lo) : bisect.bisect_left(at, hi)]:
                if p - lo:
                    part(lo, p, level + 1)
                    lo = p
            part(lo, hi, level + 1)

    part(0, n, SECTION)
    natural = sorted({p for at in levels[:WORD] for p in at})
    out, start, k = [], 0, 0
    while True:
        end = start
        while k < len(atoms) and atoms[k] - start <= limit:
            end = atoms[k]
            k += 1
        out.append((start, end))
        if end >= n:
            return out
        start = _overlap_start(text, natural, levels[WORD], end, overlap, start + 1)


def _overlap_start(text: str, natural: list[int], words: list[int], end: int, overlap: int, least: int) -> int:
    lo = max(end - overlap, least)
    # A sentence or line that starts in the first half of the overlap, else a word, wherever it starts.
    for at, latest in ((natural, end - overlap // 2), (words, end)):
        k = bisect.bisect_left(at, lo)
        if k < len(at) and at[k] < latest:
            return at[k]
    return next((p for p in range(lo, min(end, lo + 64)) if _whole(text, p)), end)


def _piece_batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"]):
                cut = spans(text, limit, overlap)
                rows += [(key, i, len(cut), a, b, text[a:b]) for i, (a, b) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["key", "piece", "pieces", "rel_start", "rel_end", "piece_text"])

    return run


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, pieces, text, rel_start, rel_end, start_char, end_char, section) of every chunk.

    Input: id (unique), text, start_char, section. Lengths are in code points. Chunks within the limit
    pass as one piece and never leave the JVM. ``start_char``/``end_char`` are in the source and null where the chunk
    has no start_char of its own. Null and empty texts give no piece; a blank text is text. Other columns,
    whatever their names, are ignored.
    """
    c = chunks.select(F.col("id").cast("long").alias("id"), "text", F.col("start_char").cast("int").alias("from_char"), "section").where("length(text) > 0")
    whole = c.where(F.length("text") <= limit).select("id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "text", F.lit(0).alias("rel_start"), F.length("text").alias("rel_end"), "from_char", "section")
    long = c.where(F.length("text") > limit)
    schema = "key struct<id:long,from_char:int,section:string>, piece int, pieces int, rel_start int, rel_end int, piece_text string"
    cut = long.select(F.struct("id", "from_char", "section").alias("key"), "text").mapInPandas(_piece_batches(limit, overlap), schema)
    cut = cut.select("key.id", "piece", "pieces", F.col("piece_text").alias("text"), "rel_start", "rel_end", "key.from_char", "key.section")
    at = lambda name: (F.col("from_char") + F.col(name)).cast("int")
    return whole.unionByName(cut).select("id", "piece", "pieces", "text", "rel_start", "rel_end", at("rel_start").alias("start_char"), at("rel_end").alias("end_char"), "section")
