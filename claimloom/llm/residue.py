"""Problem 8: template residue, filler, error pages and script notices in place of content.

Method: positive-unlabelled naive Bayes by expectation-maximization. Passages that match a strict rule are trusted
positives; all others are unlabelled and start as negatives. EM re-estimates both classes, the trusted ones staying
positive. Every passage of every document is then scored, and scores are aggregated: a section, abstract or whole text is
residue if it has passages and all of them are; a document is marked if one of its units is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Documents the classifier is fitted on: a bounded sample (all of a smaller corpus), drawn by a hash of the key.
SAMPLE_DOCS = 5000
ROUNDS, MIN_COUNT, ALPHA = 8, 2, 0.5
#: Log odds that count as undecided: what isn't trusted needs this much more evidence than an even chance, in fitting as in
#: marking, so that the positive class can't drift to a common kind of real passage.
MARGIN = 4.0

# -- units and passages of a document in typesetting markup --------------------------------------------------------

_COMMENT = re.compile(r"(?<!\\)%[^\n]*\n?")
_HEAD = re.compile(r"\\(?:chapter|(?:sub)*section|paragraph)\*?\s*(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}")
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)(?:\\end\{abstract\}|\Z)", re.S)
_TAIL = re.compile(r"\\begin\{thebibliography\}.*|\\end\{document\}.*", re.S)
_SILENT = re.compile(
    r"\\(?:label|bibliographystyle|bibliography|input|include|subfile|documentclass|usepackage|title|author|date|thanks|address|affil|email|keywords|pagestyle|thispagestyle|vspace|hspace|setcounter|newtheorem|graphicspath)\*?(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}"
    r"|\\(?:maketitle|tableofcontents|appendix|newpage|clearpage|noindent|centering|bigskip|medskip|smallskip)\b"
    r"|\\(?:def|newcommand|renewcommand|providecommand|let)\b[^\n]*"
)
_BLOCK_TAG = re.compile(r"\{%[^\n]*?%\}")
_BREAK = re.compile(r"\n\s*\n")


def units(text: str) -> list[tuple[str, list[str]]]:
    """[(unit, passages)]: the abstract, each section, and what stands before the first heading.

    Comments, headings, labels, included files, the preamble and the bibliography are no content."""
    text = text.replace("\r\n", "\n")
    if "%" in text:
        text = _BLOCK_TAG.sub("{{tag}}", text)
        text = _COMMENT.sub("\n", text)
    at = text.find("\\begin{document}")
    if at >= 0:
        text = text[at + 16 :]
    text = _TAIL.sub("", text)
    out = []
    for m in _ABSTRACT.finditer(text):
        out.append(("abstract", m[1]))
    if out:
        text = _ABSTRACT.sub("\n\n", text)
    parts = _HEAD.split(text)
    out += [("front" if i == 0 else "section", p) for i, p in enumerate(parts)]
    return [(kind, [p for p in (x.strip() for x in _BREAK.split(_SILENT.sub(" ", body))) if p]) for kind, body in out]


# -- features ------------------------------------------------------------------------------------------------------------

_SLOT = re.compile(r"\{\{[^{}]*\}\}|\$\{\w+\}|#\{\w+\}|<<[^<>]*>>|\*\|[^|]*\|\*|\[\[[^\[\]]*\]\]|%\w+%|\(\([^()]*\)\)|<[A-Z][^<>$\\]{3,80}>|^\[[^\[\]]{2,60}\]$")
_FEATURE = re.compile(r"\\([A-Za-z]+)|\$[^$]*\$|(\d[\d.,]*)|([^\W\d_]+(?:['’\-][^\W\d_]+)*)|([.!?:])")
_VERB = re.compile(r"\\verb\*?(\W).*?\1|\\texttt\{[^{}]*\}|\\cite\w*\*?(?:\[[^\]]*\])*\{[^}]*\}|\\(?:eq)?ref\{[^}]*\}")


def features(passage: str) -> list[str]:
    """Words and shape of a passage: names and numbers by kind, slots of templates, commands, repetition, what's absent."""
    out = ["<quoted>"] * len(_VERB.findall(passage))
    text = _VERB.sub(" ", passage)
    slots = len(_SLOT.findall(text))
    if slots:
        text = _SLOT.sub(" ", text)
        out += ["<slot>"] * min(slots, 3)
    start, seen, words = True, set(), []
    for cmd, num, word, stop in _FEATURE.findall(text):
        if word:
            low = word.lower()
            if not start and word[0].isupper() and low not in seen and word[1:].islower() and len(word) > 3:
                out.append("<name>")
            else:
                out.append(low)
            seen.add(low)
            words.append(low)
            start = False
        elif num:
            out.append("<num>")
            start = False
        elif cmd:
            out.append("\\" + cmd)
            start = False
        elif stop:
            start = True
        else:
            out.append("<math>")
    n = len(words)
    if n >= 5 and len(set(words)) <= 0.4 * n:
        out += ["<repeats>"] * 4
    has = set(out)
    out += [f"<no {k}>" for k in ("name", "num", "math", "quoted") if f"<{k}>" not in has]
    out.append("<words 0>" if n == 0 else f"<words {min(6, n.bit_length())}>")
    if text and text.rstrip()[-1:] not in ".!?:;":
        out.append("<open end>")
    return out


# Wordings that by themselves make a short passage a trusted positive.
TRUSTED = [
    r"\\(?:lipsum|[Bb]lindtext|[Bb]linddocument|kant|Kant)\b(?:\[[^\]]*\])?\.?",
    r"(?:\{\{\s*\w+\s*\}\}|\$\{\w+\}|#\{\w+\}|<<\s*\w+\s*>>|\*\|\w+\|\*|\[\[\w+\]\])",
    r"\[(?:insert|add|your|type|enter)\b[^\[\]]{0,60}\]",
    r"(?:TODO|TBD|TBA|FIXME|XXX+(?:\s+XXX+)*)\b[^\n]{0,60}",
    r"lorem ipsum\b[^\d\\$]*",
    r"(?:(\w{2,8}(?: \w{2,8})?)[ .,]+)(?:\1[ .,]*){4,}",
    r"[^\d\\$]{0,80}\b(?:enable|enabled|disabled|activate|activ\w+|aktivier\w+)\b[^\d\\$]{0,40}\bjavascript\b[^\d\\$]{0,120}|javascript is (?:disabled|required|off)\b[^\d\\$]{0,120}",
    r"(?:HTTP(?:/[\d.]+)?|Error|Fehler|Erreur|Error:?) ?\d{3}\b[^\\$\n]{0,160}",
    r"(?:\d{3} )?(?:(?:page )?not found|access denied|service unavailable|internal (?:server )?error|bad gateway|forbidden)\b[^\\$]{0,160}",
    r"[\w.]+(?:Exception|Error): [^\\$]{0,400}",
    r"placeholder (?:for|text)\b[^\d\\$]{0,60}",
]
_TRUSTED = re.compile("(?:" + "|".join(f"(?:{p})" for p in TRUSTED) + r")\s*", re.I | re.S)


#: Formulas, tables, figures and listings are content by kind; their letters say nothing.
_DISPLAY = re.compile(r"\\begin\{(?:equation|align|eqnarray|gather|multline|displaymath|math|tabular|table|figure|algorithm|lstlisting|verbatim|array|tikzpicture)|\$\$|\\\[|\\includegraphics")


def display(passage: str) -> bool:
    return _DISPLAY.search(passage) is not None


def trusted(passage: str) -> bool:
    return _TRUSTED.fullmatch(passage) is not None


# -- the classifier -------------------------------------------------------------------------------------------------------------------


def fit(passages: list[str], rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """(weight of each feature, bias): log odds for residue. Passages are the sample; labels come from ``trusted``."""
    bags = [Counter(features(p)) for p in passages]
    sure = [trusted(p) for p in passages]
    count = Counter(f for b in bags for f in b)
    kept = {f for f, n in count.items() if n >= MIN_COUNT}
    bags = [{f: min(n, 4) for f, n in b.items() if f in kept} for b in bags]
    belief = [1.0 if s else 0.0 for s in sure]
    weights: dict[str, float] = {}
    share = min(max(sum(sure) / max(1, len(sure)), 1e-3), 0.5)
    bias = math.log(share / (1 - share)) - MARGIN
    for _ in range(rounds):
        pos: dict[str, float] = dict.fromkeys(kept, 0.0)
        neg: dict[str, float] = dict.fromkeys(kept, 0.0)
        for b, p in zip(bags, belief):
            for f, n in b.items():
                if p:
                    pos[f] += p * n
                if p < 1:
                    neg[f] += (1 - p) * n
        tp, tn = sum(pos.values()) + ALPHA * len(kept), sum(neg.values()) + ALPHA * len(kept)
        weights = {f: math.log((pos[f] + ALPHA) / tp) - math.log((neg[f] + ALPHA) / tn) for f in kept}
        fresh = [1.0 if s else 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + sum(weights[f] * n for f, n in b.items()))))) for b, s in zip(bags, sure)]
        done = max((abs(a - b) for a, b in zip(fresh, belief)), default=0.0) < 1e-3
        belief = fresh
        if done:
            break
    return weights, bias


def score(passage: str, weights: dict[str, float], bias: float) -> float:
    """Log odds that the passage is residue; features that the sample never showed count for nothing."""
    return bias + sum(weights.get(f, 0.0) * min(n, 4) for f, n in Counter(features(passage)).items())


def residue_units(text: str, weights: dict[str, float], bias: float) -> list[str]:
    """Kinds of the units that are residue altogether: ``abstract``, ``section``, or ``whole`` for a text without either."""
    found = [(kind, passages) for kind, passages in units(text) if passages]
    inner = any(kind != "front" for kind, _ in found)
    return ["whole" if kind == "front" else kind for kind, passages in found if not (kind == "front" and inner) and all(not display(p) and (score(p, weights, bias) > 0 or trusted(p)) for p in passages)]


def _passage_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"passage": list(dict.fromkeys(p for t in pdf["text"] for _, ps in units(t) for p in ps if not display(p)))}, dtype=object)


def _mark_batches(weights: dict[str, float], bias: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = [sorted(residue_units(t, weights, bias)) if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "is_residue": [bool(m) for m in marks], "n_units": [len(m) for m in marks], "units": [",".join(dict.fromkeys(m)) for m in marks]})

    return run


def fitted(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[dict[str, float], float]:
    """The classifier, fitted on the passages of about ``sample_docs`` documents drawn by a hash of doc_id (of all, if
    there are no more). What reaches the driver is bounded by the sample, not by the corpus. Without any
    passage the classifier is empty and marks nothing."""
    docs = documents.select("doc_id", "text").where("text is not null")
    total = max(1, documents.count())
    parts = 1 << 20
    if total > sample_docs:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < parts * sample_docs // total)
    passages = sorted({r[0] for r in docs.mapInPandas(_passage_batches, "passage string").toLocalIterator()})
    return fit(passages)


def marked(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, is_residue, n_units, units) of every document, in one pass without a shuffle.

    Input: doc_id long, text string; other columns are ignored. Every passage of every text is covered, whatever its
    length (a unit's passages are scored until one is real content). Null and empty texts, and texts without any
    passage, aren't residue. Repeated documents are marked each.
    """
    weights, bias = fitted(documents, sample_docs)
    return documents.select("doc_id", "text").mapInPandas(_mark_batches(weights, bias), "doc_id long, is_residue boolean, n_units int, units string")
