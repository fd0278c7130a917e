"""Scholarly HTML: the article gate, body text, metadata. Arrow UDFs, since Spark has no HTML parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from claimloom.functions.text import normalize_text

# What the gate goes by.
LEAST_CHARS, LEAST_SECTIONS, MOST_BODIES, MOST_ELEMENTS, MOST_DEPTH = 1200, 2, 20, 50_000, 256
SECTIONS = ("introduction", "methods", "methodology", "results", "discussion", "conclusion", "background")
DROPPED = frozenset(["script", "style", "nav", "footer", "aside", "form", "noscript"])
VOID = frozenset("meta link img br hr input source wbr area base embed param col track".split())
BROKEN = frozenset(["p", "div", "section", "h1", "h2", "h3", "h4"])
_DROP_MARK = re.compile(r"abstract|references|bibliography|related|cookie|advert", re.I)
_BODY_MARK = re.compile(r"article-body|article__body|article-content|fulltext|full-text|body-section", re.I)
_SKIP = re.compile(r"(?:\d+[.\s]*)?(?:abstract|references|bibliography|related articles)")
TITLES = ("h2", "h3", "h4")
_CHARSET = re.compile(r"charset=([\w-]+)", re.I)


class _Body:
    """A candidate for the article: its text and headings, gathered while its element is open."""

    def __init__(self, rank: int, depth: int):
        self.rank, self.depth = rank, depth
        self.parts: list[str] = []
        self.headings: list[str] = []
        self.quiet = False  # within a section that isn't body

    def say(self, text: str) -> None:
        if not self.quiet:
            self.parts.append(text)

    def section(self, words: list[str]) -> None:
        """A heading opens a section; one of those left out silences the body up to the next heading."""
        name = " ".join(words).strip().lower()
        self.quiet = bool(_SKIP.match(name))
        if name and not self.quiet:
            self.headings.append(name)
        for w in words:
            self.say(w)


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    """Elements whose text isn't the page's: dropped tags, hidden ones, and those whose id, class or role marks them."""
    if tag in DROPPED or attrs.get("aria-hidden") == "true":
        return True
    return "hidden" in attrs or any(_DROP_MARK.search(attrs[k]) for k in attrs.keys() & {"id", "class", "role"})


def body_rank(tag: str, attrs: dict[str, str]) -> int | None:
    """How good a candidate an element is, 0 best: a body by its id or class, an article, the main part; None: no candidate."""
    if tag in ("article", "main"):
        return 1 if tag == "article" else 2
    return 0 if any(_BODY_MARK.search(attrs[k]) for k in attrs.keys() & {"id", "class"}) else None


class Article(HTMLParser):
    """One pass over a page, in which no tree is built: open elements know whether they are seen, candidates listen while
    they are open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.bodies: list[_Body] = []
        self.live: list[_Body] = []
        self.meta: dict[str, str] = {}
        self.count = 0
        self.failed = ""
        self.heading: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.count += 1
        if self.count > MOST_ELEMENTS:
            self.failed = self.failed or "ELEMENT_LIMIT"
        if self.failed:
            return
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta[a.get("name", a.get("property", "")).lower()] = a.get("content", "")
        if tag in VOID:
            return
        if len(self.open) >= MOST_DEPTH:
            self.failed = "DEPTH_LIMIT"
            return
        silent = bool(self.open) and self.open[-1][1] or unseen(tag, a)
        self.open.append((tag, silent))
        if silent:
            return
        if tag in BROKEN:
            self._say("\n")
        if tag in TITLES:
            self.heading = []
        if (rank := body_rank(tag, a)) is not None:
            self.live.append(_Body(rank, len(self.open)))
            self.bodies.append(self.live[-1])

    def handle_endtag(self, tag: str) -> None:
        k = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if k < 0 or self.failed:
            return
        while len(self.open) > k:
            name, silent = self.open.pop()
            if not silent and name in TITLES:
                for body in self.live:
                    body.section(self.heading or [])
                self.heading = None
            if not silent and name in BROKEN:
                self._say("\n")
            self.live = [b for b in self.live if b.depth <= len(self.open)]

    def handle_data(self, data: str) -> None:
        if self.failed or (self.open and self.open[-1][1]):
            return
        if self.heading is not None:
            self.heading.append(data)
        else:
            self._say(data)

    def _say(self, text: str) -> None:
        for body in self.live:
            body.say(text)


def read_article(data: bytes, content_type: str | None) -> dict:
    """Raw body text, headings found, whether the page passes the gate, and why not."""
    if not data:
        return {"accepted": False, "reason": "EMPTY", "raw": None, "sections": [], "headings": 0}
    stated = _CHARSET.search(content_type or "")
    try:
        page = data.decode(stated[1] if stated else "utf-8", "replace")
    except LookupError:
        page = data.decode("utf-8", "replace")
    parser = Article()
    parser.feed(page)
    parser.close()
    if parser.failed:
        return {"accepted": False, "reason": parser.failed, "raw": None, "sections": [], "headings": 0}
    best = None
    for body in sorted(parser.bodies, key=lambda b: b.rank)[:MOST_BODIES]:
        raw = " ".join(body.parts)
        sections = sorted(k for k in SECTIONS if any(k in h for h in body.headings))
        row = {"accepted": False, "reason": "INCOMPLETE", "raw": raw, "sections": sections, "headings": len(body.headings)}
        if len(sections) >= LEAST_SECTIONS and len(" ".join(raw.split())) >= LEAST_CHARS:
            return row | {"accepted": True, "reason": "OK"}
        best = best or row
    return best or {"accepted": False, "reason": "NO_BODY", "raw": None, "sections": [], "headings": 0}


def _article_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [read_article(bytes(d) if d is not None else b"", c) for d, c in zip(pdf["data"], pdf["content_type"])]
        yield pd.DataFrame({"key": pdf["key"], "accepted": [r["accepted"] for r in rows], "reason": [r["reason"] for r in rows], "raw": [r["raw"] for r in rows], "sections": [",".join(r["sections"]) for r in rows], "headings": [r["headings"] for r in rows]})


def articles(resources: DataFrame, key: str = "resource_id") -> DataFrame:
    """(key, accepted, reason, text, sections, headings): substantial articles with at least two kinds of sections pass.

    ``text`` is canonical text of the accepted body, else of the best candidate, for inspection. Null and empty data: reason EMPTY.
    """
    raw = resources.select(F.col(key).cast("long").alias("key"), "data", "content_type").mapInPandas(_article_batches, "key long, accepted boolean, reason string, raw string, sections string, headings int")
    return raw.select(F.col("key").alias(key), "accepted", "reason", normalize_text(F.col("raw")).alias("text"), "sections", "headings")


def _meta_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for data in pdf["data"]:
            parser = Article()
            parser.feed(bytes(data).decode("utf-8", "replace") if data is not None else "")
            out.append([{"name": k, "content": v} for k, v in parser.meta.items() if k])
        yield pd.DataFrame({"key": pdf["key"], "meta": out})


def metadata(resources: DataFrame, key: str = "resource_id") -> DataFrame:
    """(key, name, content) of named meta tags; the last of a name counts."""
    m = resources.select(F.col(key).cast("long").alias("key"), "data").mapInPandas(_meta_batches, "key long, meta array<struct<name:string,content:string>>")
    return m.select(F.col("key").alias(key), F.inline("meta"))
