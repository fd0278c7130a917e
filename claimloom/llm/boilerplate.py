"""Problem 3: the main body of web pages, without menus, notices, teasers and footers.

Method: union-free regular expressions inferred per host by iterative alignment. A page is a stream of blocks, a block a
stream of tokens. (1) The streams of a host's pages are aligned at the token runs that enough of its articles share; runs that
running text uses are language and align nothing. What lies between shared runs is a mismatch and becomes a text slot, so each
block has an expression of fixed text and slots. (2) The expressions of a host are aligned with one another, one after the
other: text that only some have becomes an optional group, text that differs becomes a slot, a unit that follows itself a
repeated group. What results are the host's wrapper rows, each a regular expression without alternatives and a mark of how
its block occurs in the page: ``?`` (on some pages) or ``*`` (several times on a page). (3) A page is read through the
wrapper: a block that one of the expressions matches is the site's, all other blocks fall into the wrapper's text slots, and
the slots between title and references are the body. Markup and headings give that region.

All counts cover all pages, and what makes a run fixed is its share outside running text, so behaviour doesn't change with size.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimloom.session import cut

#: Words a paragraph needs; tokens of a run; articles a run or expression needs on its host, or on the hosts together.
LEAST_WORDS, RUN, HOST_ARTICLES, ALL_ARTICLES = 8, 3, 4, 6
#: ... and this share of the pages of its host, or of the hosts together.
SUPPORT = 0.003
#: A run is language, not template, if running text has it more often than this share of its occurrences elsewhere.
LANGUAGE = 0.001
#: Two expressions of one site text share at least this part of the longer one's fixed tokens.
SAME = 0.5
#: Runs and wrappers up to so many rows are given to every task; larger ones meet the pages host by host.
SIDE_ROWS = 2_000_000
#: A host is spread over more tasks when it has at least one page in so many.
HOT = 1000
#: Parts in which the expressions of one family are aligned before they meet.
PARTS = 8
#: Pages whose runs are in memory at once.
PORTION = 250

# Headings that begin or end what isn't body, without numbers and punctuation.
ABSTRACTS = frozenset(["abstract", "summary", "zusammenfassung", "resumen", "résumé"])
ENDS = frozenset(["references", "reference list", "bibliography", "literature cited", "works cited", "literatur", "literaturverzeichnis", "referencias", "bibliografía", "références", "bibliographie"])
SECTIONS = frozenset(["introduction", "background", "related work", "methods", "methodology", "materials and methods", "model", "theory", "data", "experiments", "results", "discussion", "limitations", "conclusions", "conclusion", "einleitung", "methoden", "ergebnisse", "diskussion", "introducción", "métodos", "resultados", "méthodes", "résultats"])

_BLOCK = "p div li ul ol h1 h2 h3 h4 h5 h6 section article main header footer nav aside table thead tbody tr td th blockquote pre figure figcaption dl dt dd form fieldset address button body hr center"
_SITE = frozenset(["nav", "aside", "footer", "form", "button", "header"])
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_BLOCKS = frozenset(_BLOCK.split())
_VOID = frozenset(["hr", "br", "img", "input", "meta", "link"])
_SITE_ATTR = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:nav|menu|cookie|consent|banner|sidebar|footer|related|promo|newsletter|share|complementary|navigation|contentinfo|breadcrumb|advert)", re.I)
_ABSTRACT_ATTR = re.compile(r"(?:class|id)\s*=\s*[\"']?[^\"'>]*\babstract\b", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:\-]+)", re.I)
_SENTENCES = re.compile(r"[.!?](?<![Ff]ig\.)(?<!i\.e\.)(?<!e\.g\.)(?<!\bcf\.)(?<!\bal\.)(?<!\bvs\.)(?=\s+[^\Wa-z]|\s*\Z)")
_ENTRY = re.compile(r"\[?\d{1,4}[.\])]\s")
_CLOSED = re.compile(r"[.!?:;][\"'”’)\]]*\Z")


def decode(data: bytes, content_type: str | None) -> str:
    """Page text: the stated charset, else that of a meta tag, else UTF-8 if it is, else Windows-1252."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    stated = _CHARSET.search(content_type or "") or _CHARSET.search(data[:2048].decode("latin-1"))
    for name in ([stated[1].lower()] if stated else []) + ["utf-8"]:
        try:
            return data.decode("cp1252" if name in ("iso-8859-1", "latin-1", "latin1", "us-ascii") else name)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("cp1252", "replace")


def _heading(text: str) -> str:
    return re.sub(r"^[\W\d_]+|[\W\d_]+$", "", text).lower()


def squeeze(text: str) -> str:
    return " ".join(text.split())


def html_blocks(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(title, [(place, text)]) of a page; place is ``body`` for blocks where the body may be, else ``site``."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    title, buffer, state, home, head_tag = "", [], "pre", -1, ""

    def flush() -> None:
        nonlocal title, state, home
        block = squeeze(html.unescape("".join(buffer)))
        buffer.clear()
        if not block:
            return
        if head_tag:
            name = _heading(block)
            if head_tag == "h1" and not title:
                title, state = block, "byline"
                del stack[: max(0, next((i for i, (t, _) in enumerate(stack) if t in _SITE), len(stack)) - len(stack))]
                home = len(stack) - 2
            elif state in ("byline", "body", "abstract"):
                state = "abstract" if name in ABSTRACTS else "end" if name in ENDS else "body"
            elif state == "end" and name.startswith("appendi"):
                state = "body"
            return
        marks = {m for _, m in stack if m}
        if state == "end" and _ENTRY.match(block):
            return
        place = "body" if state == "body" and not marks else "site" if "site" in marks or state in ("pre", "after", "end", "body") else "none"
        out.append((place, block))

    at = 0
    for m in _MARKUP.finditer(text):
        if m.start() > at:
            buffer.append(text[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag not in _BLOCKS:
            continue
        flush()
        if m[2]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if k >= 0:
                del stack[k:]
                if 0 <= k <= home and state not in ("pre", "after"):
                    state = "after"
            if tag[0] == "h" and tag[1:].isdigit():
                head_tag = ""
        elif tag not in _VOID:
            if tag in ("p", "li", "td", "tr", "h1", "h2", "h3", "h4") and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", tag):
                stack.pop()
            head_tag = tag if tag[0] == "h" and tag[1:].isdigit() else ""
            if tag == "h1" and not title:  # whatever was left open before the title holds no article
                for i, (t, mark) in enumerate(stack):
                    if mark == "site":
                        stack[i] = (t, "")
            attrs = m[4] or ""
            mark = "site" if tag in _SITE or "=" in attrs and _SITE_ATTR.search(attrs) else "abstract" if "=" in attrs and _ABSTRACT_ATTR.search(attrs) else ""
            stack.append((tag, mark))
    buffer.append(text[at:])
    flush()
    return title, out


def line_blocks(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The same for text without markup, where each line is a block and short lines without a stop are headings."""
    out, title, state = [], "", "pre"
    lines = [s for s in (squeeze(x) for x in text.splitlines()) if s]
    for i, line in enumerate(lines):
        words = line.split()
        if len(words) <= 6 and not _CLOSED.search(line):
            name = _heading(line)
            if state == "end" and not name.startswith("appendi"):
                continue
            if name in ABSTRACTS or name in ENDS:
                title = title or (lines[i - 2] if i > 1 else "")
                state = "abstract" if name in ABSTRACTS else "end"
            elif name in SECTIONS or state == "abstract" or (state == "body" and name.startswith("appendi")):
                title = title or (lines[i - 2] if i > 1 else "")
                state = "body"
            continue
        if state != "end" or not _ENTRY.match(line):
            out.append(("body" if state == "body" else "none" if state == "abstract" else "site", line))
    return title, out


#: Codes of a block's ends, and of the kinds that stand for many tokens; other codes are hashes from 8 on.
BEGIN, END = 0, 1
KINDS = {"#": 2, "@": 3, "N": 4}
_GAP, _LETTER, _DIGIT, _SIGN = range(4)
_FACTOR, _TOP = 0x9E3779B97F4A7C15, 0x10000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and whether it is a capital, of each code point below _TOP; all above are signs."""
    chars = [chr(i) for i in range(_TOP)]
    kinds = [_GAP if c.isspace() or c == "_" else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN for c in chars]
    lower = [ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)]
    return np.array([*kinds, _SIGN], dtype=np.uint8), np.array([*lower, _TOP], dtype=np.uint64), np.array([*(c.isupper() for c in chars), False])


_CLASS, _LOWER, _CAPITAL = _tables()
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _FACTOR and of its inverse modulo 2**64, from the 0th on."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.ones(1, dtype=np.uint64), np.full(2 * n, base, dtype=np.uint64)], dtype=np.uint64)
    return _POWERS


def _tokenised(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, code, line) of each token of lines of text. Tokens are words (letters, with apostrophes, hyphens and dots
    between letters), numbers (digits, with dots and commas between digits) and single signs. Numbers, words with dots
    (host names) and, after a line's first token, capitalised words have the code of their kind; case doesn't count."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(a):
        return (np.empty(0, dtype=np.int64),) * 4
    c = np.minimum(a, _TOP)
    kind = _CLASS[c]
    beside = np.zeros(len(a) + 2, dtype=np.uint8)
    beside[1:-1] = kind
    around = np.where(beside[:-2] == beside[2:], beside[2:], 0)
    dot = a == 46
    joins = (around == _LETTER) & (dot | (a == 39) | (a == 0x2019) | (a == 45)) | (around == _DIGIT) & (dot | (a == 44))
    if joins.any():
        kind = np.where(joins, around, kind)
    change = np.ones(len(a) + 1, dtype=bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _SIGN)
    solid = kind != _GAP
    start, end = np.flatnonzero(change[:-1] & solid), np.flatnonzero(change[1:] & solid) + 1
    if not len(start):
        return (np.empty(0, dtype=np.int64),) * 4
    up, down = _powers(len(a))
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[c] + np.uint64(1)) * up[: len(a)], dtype=np.uint64, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    code = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(8)
    line = np.cumsum(a == 10)[start]
    later = np.zeros(len(start), dtype=bool)
    later[1:] = line[1:] == line[:-1]
    word, dots = kind[start] == _LETTER, np.cumsum(dot)
    code[word & later & _CAPITAL[c[start]]] = KINDS["N"]
    code[word & (dots[end - 1] > dots[start]) & (end - start > 3)] = KINDS["@"]
    code[(kind[start] == _DIGIT) | (a[start] == 35)] = KINDS["#"]
    code[a[start] == 64] = KINDS["@"]
    return start, end, code, line


_NAMES = {v: k for k, v in KINDS.items()}


def tokens(blocks: list[str]) -> list[list[str]]:
    """Lower-case words and signs of each block; numbers, host names and, after the first word, capitalised words by kind."""
    text = "\n".join(b.replace("\n", " ") for b in blocks)
    start, end, code, line = _tokenised(text)
    flat = [_NAMES.get(k) or text[i:j].lower() for i, j, k in zip(start.tolist(), end.tolist(), code.tolist())]
    at = np.searchsorted(line, np.arange(len(blocks) + 1)).tolist()
    return [flat[i:j] for i, j in zip(at, at[1:])]


def codes(blocks: list[str]) -> np.ndarray:
    """Token codes of the blocks (without line breaks) one after the other, each between its two ends."""
    _, _, code, line = _tokenised("\n".join(blocks))
    count = np.bincount(line, minlength=len(blocks)) if len(blocks) else np.empty(0, dtype=np.int64)
    out = np.empty(len(code) + 2 * len(blocks), dtype=np.uint32)
    after = np.cumsum(count) + 2 * np.arange(len(blocks))
    out[after - count], out[after + 1] = BEGIN, END
    out[np.arange(len(code)) + 2 * line + 1] = code
    return out


_MIX = [np.uint64(k) for k in (_FACTOR, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def runs_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the RUN tokens from each position, which of them lie within one block); ends count as tokens."""
    n = max(0, len(stream) - RUN + 1)
    t, h, inside = stream.astype(np.uint64), np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for i in range(RUN):
        h = (h ^ ((t[i : i + n] + np.uint64(1)) * _MIX[i % 3])) * _MIX[(i + 1) % 3]
        h ^= h >> np.uint64(31)
        if i < RUN - 1:
            inside &= stream[i : i + n] != END
    return (h >> np.uint64(1)).astype(np.int64), inside


def running(block: str) -> bool:
    """Blocks of several sentences are running text."""
    return len(_SENTENCES.findall(block)) >= 3


def _blocks_of(kind: str, data: object, content_type: str | None) -> tuple[str, list[tuple[str, str]]]:
    if data is None or not len(data):
        return "", []
    return html_blocks(decode(bytes(data), content_type)) if kind == "resource" else line_blocks(data)


PAGE = "kind string, page_key long, host string, article int, inside array<boolean>, running array<boolean>, blocks array<string>, codes binary"


def _page_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, key, host, data, text, ctype in zip(pdf["kind"], pdf["page_key"], pdf["host"], pdf["data"], pdf["text"], pdf["content_type"]):
            title, blocks = _blocks_of(kind, data if kind == "resource" else text, ctype)
            blocks = [(p, b) for p, b in blocks if p != "none" and len(b.split()) >= 4]
            if blocks:
                texts = [b for _, b in blocks]
                rows.append((kind, key, host, xxhash.xxh3_64_intdigest(title or str(key)) & 63, [p == "body" for p, _ in blocks], [p == "body" and running(b) for p, b in blocks], texts, codes(texts).tobytes()))
        yield pd.DataFrame(rows, columns=["kind", "page_key", "host", "article", "inside", "running", "blocks", "codes"])


def pages(resources: DataFrame, sources: DataFrame) -> DataFrame:
    """Every page with blocks, as in PAGE: resources whose answer is a page (status 200, or none stated) and sources of the
    types html_url and doi_html. Null, empty and blank pages give no row."""
    host = lambda url: F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    r = resources.where("data is not null and coalesce(status, 200) = 200").select(F.lit("resource").alias("kind"), F.col("resource_id").cast("long").alias("page_key"), host(F.col("url")).alias("host"), "data", F.lit(None).cast("string").alias("text"), "content_type")
    s = sources.where("text is not null and source_type in ('html_url', 'doi_html')").select(F.lit("source").alias("kind"), F.col("source_id").cast("long").alias("page_key"), host(F.col("canonical_url")).alias("host"), F.lit(None).cast("binary").alias("data"), "text", F.lit(None).cast("string").alias("content_type"))
    return r.unionByName(s).mapInPandas(_page_batches, PAGE)


# -- runs that pages share ------------------------------------------------------------------------------------------------


def _portions(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in portions of pages, so that the arrays of runs stay small."""
    for at in range(0, len(pdf), PORTION):
        yield pdf.iloc[at : at + PORTION]


def _stream(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all pages, block of each code, page of each block)."""
    stream = np.frombuffer(b"".join(part["codes"]), dtype=np.uint32)
    return stream, np.cumsum(stream == BEGIN) - 1, np.repeat(np.arange(len(part)), [len(b) for b in part["blocks"]])


def _merged(host: np.ndarray, run: np.ndarray, articles: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per host and run: its article bits combined, its occurrences summed."""
    if not len(run):
        return host, run, articles, n
    order = np.lexsort((run, host))
    host, run, articles, n = host[order], run[order], articles[order], n[order]
    first = np.flatnonzero(np.r_[True, (host[1:] != host[:-1]) | (run[1:] != run[:-1])])
    return host[first], run[first], np.bitwise_or.reduceat(articles, first), np.add.reduceat(n, first)


#: Stands for the host in the counts of running text.
LANGUAGE_HOST = " "


def _run_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        code, hosts = pd.factorize(pdf["host"].to_numpy(dtype=object))
        pdf = pdf.assign(code=code)
        parts = []
        for part in _portions(pdf):
            stream, block, page = _stream(part)
            h, inside = runs_of(stream)
            at = np.flatnonzero(inside)
            b = block[at]
            language = np.concatenate([np.asarray(x, dtype=bool) for x in part["running"]])[b]
            p = page[b]
            host = np.where(language, -1, part["code"].to_numpy()[p])
            bits = np.where(language, 0, (np.uint64(1) << part["article"].to_numpy().astype(np.uint64)).view(np.int64)[p])
            parts.append(_merged(host, h[at], bits, np.ones(len(at), dtype=np.int64)))
        if parts:
            host, run, articles, n = _merged(*(np.concatenate(x) for x in zip(*parts)))
            yield pd.DataFrame({"host": np.append(hosts, LANGUAGE_HOST)[host], "run": run, "articles": articles, "n": n})


def _seen_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every run each host has, in running text or not."""
    for pdf in batches:
        for host, part in pdf.groupby("host", sort=False):
            h, inside = runs_of(_stream(part)[0])
            yield pd.DataFrame({"host": host, "run": np.unique(h[inside])})


def fixed_runs(blocks: DataFrame) -> DataFrame:
    """(host, run, n): the runs at which the pages of a host are aligned, and how often they stand there; host ``*`` has those of the hosts together (sites share
    platforms).

    A run needs enough different articles and SUPPORT of the pages outside running text, of the host's or of all hosts' pages
    together, and in running text anywhere at most LANGUAGE times as many occurrences as outside it. Articles are counted by the bits of a 64-bit map (of their
    titles' hash), so pages fetched again count once. One shuffle, of one row per batch, host and run.
    """
    # Rows of running text have no article bits. No use of ``seen`` filters anything that could be moved before the exchange,
    # so all share it.
    seen = blocks.mapInPandas(_run_batches, "host string, run long, articles long, n long").where("host is not null and run is not null").repartition("run").groupBy("host", "run").agg(F.bit_or("articles").alias("articles"), F.sum("n").alias("n"))
    outside = F.col("host") != LANGUAGE_HOST
    total = seen.groupBy("run").agg(F.bit_or("articles").alias("every"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_out"), F.sum(F.when(outside, 0).otherwise(F.col("n"))).alias("n_in"))
    template = total.where((F.bit_count("every") >= HOST_ARTICLES) & (F.col("n_in") <= LANGUAGE * F.col("n_out")))
    per_host = blocks.groupBy("host").agg(F.count("*").alias("pages"))
    every = per_host.agg(F.sum("pages")).first()[0] or 0
    common = (F.bit_count("every") >= ALL_ARTICLES) & (F.col("n_out") >= SUPPORT * every)
    shared = template.where(common).select(F.lit("*").alias("host"), "run", F.col("n_out").alias("n"))
    own = seen.where(F.bit_count("articles") >= HOST_ARTICLES).join(template.where(~common).select("run"), "run", "left_semi")
    own = own.join(per_host, "host").where(F.col("n") >= SUPPORT * F.col("pages")).select("host", "run", "n")
    return own.unionByName(shared)


# -- what every page needs of its host ------------------------------------------------------------------------------------


def beside(blocks: DataFrame, side: DataFrame, work, schema: str, seen: DataFrame | None = None) -> DataFrame:
    """``work(rows of the host's side, batch)`` over all pages; ``side`` is (host, run, ...), host ``*`` holding for all.

    Up to SIDE_ROWS rows of ``side`` are handed to every task. Larger ones go to the pages' hosts (``seen``: the runs
    that each host has, which tell what of ``*`` it needs): side rows and pages of a host come into one stream, its side rows
    first, and hosts with a thousandth of all pages are spread over tasks by the pages' keys. Both ways give the same rows.
    """
    columns = [c for c in side.columns if c != "host"]
    if side.count() <= SIDE_ROWS:
        given: dict[str, list] = {}
        for r in side.toLocalIterator():
            given.setdefault(r["host"], []).append(tuple(r[c] for c in columns))
        return blocks.mapInPandas(_given(given, work), schema)
    n = blocks.count()
    hot = F.broadcast(blocks.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") * HOT >= n).select("host", F.ceil(F.col("n") * HOT / n).cast("int").alias("tasks")))
    shared = side.where("host = '*'").drop("host").join(seen.distinct(), "run").select(side.columns)
    own = side.where("host <> '*'").unionByName(shared)
    salts = F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)
    # Neither kind of row leaves a number of the other's null: in pandas a column of whole numbers with gaps would be floats.
    filled = lambda df, names: [F.lit(0).cast(kind).alias(c) for c, kind in df.dtypes if c in names and kind in ("int", "bigint")]
    left = own.join(hot, "host", "left").select("host", F.explode(salts).alias("salt"), F.lit(False).alias("is_page"), *columns, *filled(blocks, {*blocks.columns} - {"host"}))
    right = blocks.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_key"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks").select("*", F.lit(True).alias("is_page"), *filled(side, columns))
    both = right.unionByName(left, allowMissingColumns=True).repartition("host", "salt").sortWithinPartitions("host", "salt", "is_page")
    return both.mapInPandas(_streamed(columns, work), schema)


def _given(given: dict[str, list], work):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict = {}
        for pdf in batches:
            # Hosts without rows of their own are all alike.
            alike = pdf["host"].where(pdf["host"].isin(given), "*")
            for host, part in pdf.groupby(alike, sort=False):
                if host not in made:
                    made[host] = work((given.get(host, []) if host != "*" else []) + given.get("*", []))
                yield from map(made[host], _portions(part.assign(host=host)))

    return run


def _streamed(columns: list[str], work):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, values, made = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["host", "salt"], sort=False):
                if key != at:
                    at, values, made = key, [], None
                mine = part["is_page"].to_numpy(dtype=bool)
                values += list(zip(*(part[c][~mine].tolist() for c in columns)))
                if mine.any():
                    made = made or work(values)
                    yield from map(made, _portions(part[mine]))

    return run


def _holds(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the runs found are known ones (sorted)."""
    if not len(known):
        return np.zeros(len(found), dtype=bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


# -- expressions ------------------------------------------------------------------------------------------------------------

#: Among an expression's tokens, a text slot: no token is a blank.
SLOT = " "
#: Stands for a slot where tokens are written in one line.
NOTHING = "\u2423"
#: ``tokens`` with blanks between them, ``anchors`` with 1 where a fixed run begins, else 0; later ``optional`` likewise.
EXPRESSION = "host string, family long, tokens string, anchors string, articles long, n long, often int"
WRAPPER = EXPRESSION + ", optional string"


def _expression_batches(values: list):
    """Blocks of a host aligned at its fixed runs: their expressions with article bits, pages and most occurrences on a page.
    An expression's family is the most frequent of its runs: there its alignment with others begins."""
    rank = {run: n for run, n in values}
    fixed = np.array(sorted(rank), dtype=np.int64)
    weight = np.array([rank[r] for r in fixed.tolist()], dtype=np.int64)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        stream, block, page = _stream(part)
        h, inside = runs_of(stream)
        flags = np.concatenate([np.asarray(x, dtype=bool) for x in part["running"]])
        hit = inside & _holds(fixed, h) & ~flags[block[: len(h)]]
        cover = np.zeros(len(stream), dtype=bool)
        for i in range(RUN):
            cover[i : i + len(hit)] |= hit
        kept = np.where(cover, stream.astype(np.int64), -1)
        starts = np.r_[hit, np.zeros(min(RUN - 1, len(stream)), dtype=bool)].view(np.uint8)
        begins = np.flatnonzero(stream == BEGIN)
        ends = np.append(begins[1:], len(stream))
        # Of a stretch without fixed text its first code stands for the slot.
        first = cover | np.append(True, cover[:-1]) | (stream == BEGIN)
        texts = [x for b in part["blocks"] for x in b]
        articles, hosts = part["article"].to_numpy(), part["host"].to_numpy()
        rows: dict[tuple, list] = {}
        new: list[tuple[list, int]] = []
        for b in np.unique(block[: len(h)][hit]):
            shape = kept[begins[b] : ends[b]]
            shape = shape[first[begins[b] : ends[b]]]
            row = rows.get(key := (hosts[page[b]], shape.tobytes()))
            if row is None:
                rows[key] = row = [hosts[page[b]], 0, "", "", 0, 0, 0, -1, 0]
                new.append((row, b))
            p = page[b]
            row[4] |= 1 << int(articles[p])
            row[8] = row[8] + 1 if row[7] == p else 1
            row[5] += row[7] != p
            row[6], row[7] = max(row[6], row[8]), p
        for row in rows.values():
            row[4] -= (row[4] >> 63) << 64
        for (row, b), toks in zip(new, tokens([texts[b] for _, b in new])):
            lo, hi = begins[b], ends[b]
            mine, at = cover[lo:hi].tolist(), np.flatnonzero(hit[lo:hi]) + lo
            row[1] = h[at[np.argmax(weight[np.searchsorted(fixed, h[at])])]]
            keep = [m or k == 0 or mine[k - 1] for k, m in enumerate(mine)]
            row[2] = " ".join([t if m else NOTHING for t, m, k in zip(["^", *toks, "$"], mine, keep) if k])
            row[3] = "".join([x for x, k in zip((starts[lo:hi] + 48).tobytes().decode(), keep) if k])
        return pd.DataFrame([r[:7] for r in rows.values()], columns=["host", "family", "tokens", "anchors", "articles", "n", "often"])

    return run


#: (token or slot, whether it is optional, whether a fixed run begins here)
Item = tuple[str, bool, bool]


def may_align(wrapper: list[Item], toks: list[str]) -> bool:
    """Whether enough tokens agree for ``align``, wherever they stand: a quick look before the comparison in order."""
    fixed = [t for t, o, _ in wrapper if t != SLOT and not o]
    mine = [t for t in toks if t != SLOT]
    known = frozenset(fixed)
    return sum(t in known for t in mine) >= max(RUN, SAME * max(len(fixed), len(mine)))


def align(wrapper: list[Item], toks: list[str]) -> list[Item] | None:
    """``wrapper`` generalised so that it also matches ``toks``; None if the two are different texts.

    Text of one side only becomes optional, text that differs a slot; slots take in optional text beside them. Enough
    of the longer one's fixed tokens must agree, a whole fixed run among them."""
    mine = [t for t, _, _ in wrapper]
    out: list[Item] = []
    same = 0
    for op, a, b, c, d in SequenceMatcher(None, mine, toks, autojunk=False).get_opcodes():
        if op == "equal":
            out += [(t, o, x and i + RUN <= b) for i, (t, o, x) in enumerate(wrapper[a:b], a)]
            same += sum(t != SLOT and not o for t, o, _ in wrapper[a:b])
        elif op == "replace" or SLOT in mine[a:b] + toks[c:d]:
            out.append((SLOT, False, False))
        else:
            out += [(t, True, False) for t in mine[a:b] + toks[c:d]]
    longer = max(sum(t != SLOT and not o for t, o, _ in wrapper), sum(t != SLOT for t in toks))
    if same < max(RUN, SAME * longer) or not any(x for _, _, x in out):
        return None
    return _squeezed(out)


def _squeezed(items: list[Item]) -> list[Item]:
    out: list[Item] = []
    for t, o, x in items:
        if t == SLOT:
            while out and (out[-1][1] or out[-1][0] == SLOT):
                out.pop()
            out.append((SLOT, False, False))
        elif not (o and out and out[-1][0] == SLOT):
            out.append((t, o, x))
    return out


def _items(line: str, optional: str, anchors: str) -> list[Item]:
    return [(SLOT if t == NOTHING else t, o == "1", x == "1") for t, o, x in zip(line.split(" "), optional, anchors, strict=True)]


def _lines(items: list[Item]) -> tuple[str, str, str]:
    return " ".join(NOTHING if t == SLOT else t for t, _, _ in items), "".join("01"[o] for _, o, _ in items), "".join("01"[x] for _, _, x in items)


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Expressions of each host and family, in order of support, aligned one after the other."""
    at, found = None, []

    def done() -> pd.DataFrame:
        rows = [(*at[:2], *_lines(w), bits - ((bits >> 63) << 64), n, often) for w, _, bits, n, often in found]
        return pd.DataFrame(rows, columns=["host", "family", "tokens", "optional", "anchors", "articles", "n", "often"])

    for pdf in batches:
        salt = pdf["salt"] if "salt" in pdf else itertools.repeat(0)
        for host, fam, line, optional, anchors, bits, n, often, key in zip(*(pdf[c] for c in ("host", "family", "tokens", "optional", "anchors", "articles", "n", "often")), salt):
            if (host, fam, key) != at:
                if found:
                    yield done()
                at, found = (host, fam, key), []
            # Text that is optional already may stand or not: to another expression it is a slot.
            w = _items(line, optional, anchors)
            if "1" in optional:
                plain = [t for t, _, _ in _squeezed([(SLOT if o else t, False, False) for t, o, _ in w])]
                line = " ".join(NOTHING if t == SLOT else t for t in plain)
            else:
                plain = [t for t, _, _ in w]
            line += " "
            bits &= (1 << 64) - 1
            for i, (other, made, b, m, o) in enumerate(found):
                known = made.fullmatch(line) is not None
                if known or may_align(other, plain) and (got := align(other, plain)) is not None:
                    found[i] = (*((other, made) if known else (got, re.compile(expression(got)))), b | bits, m + n, max(o, often))
                    break
            else:
                found.append((w, re.compile(expression(w)), bits, n, often))
    if found:
        yield done()


def _rule_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        items = [_items(*x) for x in zip(pdf["tokens"], pdf["optional"], pdf["anchors"])]
        yield pd.DataFrame({"host": pdf["host"], "expression": map(expression, items), "occurs": np.where(pdf["often"] > 1, "*", "?"), "pages": pdf["n"], "run": map(key_run, items)})


def key_run(items: list[Item]) -> int:
    """Hash of the first fixed run of an expression; every text it matches has it."""
    i = next(i for i, item in enumerate(items) if item[2])
    stream = [BEGIN if t == "^" and j == 0 else END if t == "$" and j == len(items) - 1 else KINDS.get(t) or int(_tokenised(t)[2][0]) for j, (t, _, _) in enumerate(items[i : i + RUN], i)]
    return int(runs_of(np.array(stream, dtype=np.uint32))[0][0])


def expression(items: list[Item]) -> str:
    """The regular expression, over tokens that each end in a blank: slots, optional groups, and units that follow themselves as
    repeated groups. It has no alternatives."""
    out, i = [], 0
    while i < len(items):
        unit, times = _repeat(items, i)
        if times > 1:
            stop = re.escape(unit[-1][0] + " ")
            out.append("(?:" + "".join(rf"(?:(?!{stop})\S+ )*" if t == SLOT else re.escape(t + " ") for t, _, _ in unit) + ")+")
            i += len(unit) * times
        elif items[i][1]:
            j = i
            while j < len(items) and items[j][1]:
                j += 1
            out.append("(?:" + "".join(re.escape(t + " ") for t, _, _ in items[i:j]) + ")?")
            i = j
        else:
            out.append(r"(?:\S+ )*?" if items[i][0] == SLOT else re.escape(items[i][0] + " "))
            i += 1
    return "".join(out)


def _repeat(items: list[Item], i: int) -> tuple[list[Item], int]:
    """The shortest unit from ``i`` on that ends in fixed text and follows itself, and how often."""
    for size in range(2, 7):
        unit = items[i : i + size]
        if len(unit) < size or unit[-1][0] == SLOT or any(o for _, o, _ in unit):
            continue
        times = 1
        while [x[:2] for x in items[i + times * size : i + (times + 1) * size]] == [x[:2] for x in unit]:
            times += 1
        if times > 1:
            return unit, times
    return items[i : i + 1], 1


def wrappers(expressions: DataFrame, runs: DataFrame) -> DataFrame:
    """(host, expression, occurs, pages, run): the wrapper of each host; host ``*`` has what hosts share, the expressions whose
    family is a run of ``*`` in ``runs`` (as of ``fixed_runs``).

    ``expressions`` are those of all blocks. They are aligned in one stream per host and family, ordered by support and
    text, first within parts by a hash of the text, then together; so the result depends on the data alone, and a task holds
    one family's wrapper rows. What is left needs enough different articles.
    """
    level = runs.where("host = '*'").select(F.col("run").alias("family"), F.lit("*").alias("level"))
    rows = expressions.join(level, "family", "left").withColumn("host", F.coalesce("level", "host"))
    rows = rows.groupBy("host", "family", "tokens", "anchors").agg(F.bit_or("articles").alias("articles"), F.sum("n").alias("n"), F.max("often").alias("often"))
    rows = rows.withColumn("optional", F.translate("anchors", "1", "0")).withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(PARTS)))
    for key in (["host", "family", "salt"], ["host", "family"]):
        rows = rows.repartition(*key).sortWithinPartitions(*key, F.desc("n"), "tokens").mapInPandas(_fold_batches, WRAPPER)
    enough = F.bit_count("articles") >= F.when(F.col("host") == "*", ALL_ARTICLES).otherwise(HOST_ARTICLES)
    return rows.where(enough).mapInPandas(_rule_batches, "host string, expression string, occurs string, pages long, run long")


# -- pages through their wrappers ----------------------------------------------------------------------------------------


def _paragraph_batches(values: list):
    """Blocks of the region that no expression of the host's wrapper matches, each once a page."""
    by_key: dict[int, list[re.Pattern]] = {}
    for text, key in dict.fromkeys(values):
        by_key.setdefault(int(key), []).append(re.compile(text))
    keys = np.array(sorted(by_key), dtype=np.int64)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        stream, block, page = _stream(part)
        h, inside = runs_of(stream)
        at = np.flatnonzero(inside & _holds(keys, h))
        met: dict[int, set[int]] = {}
        asks = np.concatenate([np.asarray(x, dtype=bool) for x in part["inside"]])
        at = at[asks[block[at]]]
        for b, k in zip(block[at].tolist(), h[at].tolist()):
            met.setdefault(b, set()).add(k)
        texts = [x for blocks in part["blocks"] for x in blocks]
        asked = sorted(met)
        site = {b for b, toks in zip(asked, tokens([texts[b] for b in asked])) if any(e.fullmatch(" ".join(["^", *toks, "$", ""])) for k in met[b] for e in by_key[k])}
        rows, b = [], -1
        for kind, key, flags, blocks in zip(part["kind"], part["page_key"], part["inside"], part["blocks"]):
            kept = {}
            for flag, x in zip(flags, blocks):
                b += 1
                if flag and b not in site and len(x.split()) >= LEAST_WORDS:
                    kept[x] = None
            rows += [(kind, key, x) for x in kept]
        return pd.DataFrame(rows, columns=["kind", "page_key", "paragraph"])

    return run


def paragraphs(resources: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, page_key, paragraph): the distinct paragraphs of each page's body, white space squeezed.

    Title, byline, abstract, headings, references and what belongs to the site are left out, as are blocks of under
    LEAST_WORDS words. Repeated pages give their paragraphs each; pages without a body give no row.
    """
    blocks = cut(pages(resources, sources))
    seen = blocks.mapInPandas(_seen_batches, "host string, run long")
    runs = cut(fixed_runs(blocks))
    aligned = beside(blocks, runs, _expression_batches, EXPRESSION, seen)
    wrapper = cut(wrappers(aligned, runs)).select("host", "expression", "run")
    return beside(blocks, wrapper, _paragraph_batches, "kind string, page_key long, paragraph string", seen)
