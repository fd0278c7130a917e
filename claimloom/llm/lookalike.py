"""Problem 5: one consistent form for text that looks the same but differs in its characters.

Method: script-aware repair. Each text is brought to its base characters (width variants, ligatures, letter-like Roman
numerals, combining accents, invisible characters, special spaces). Then the dominant script of each token is read off
the letters that only one script has, and look-alike letters of other scripts are substituted by those of the dominant one,
provided that the result is a word of the corpus vocabulary. Two kinds of look-alikes differ in what they need:

* letters of *the same* shape (Cyrillic а, Latin a) look the same wherever they stand. Their skeleton decides that two tokens are
  equal; the vocabulary decides the script of the form shown. A token that the vocabulary doesn't know stays in skeleton
  shape, so that two disguises of a word that never occurs plainly still agree.
* letters of *nearly* the same shape (Greek ν, Latin v) tell real words of the scripts apart, hence no skeleton may join them. They
  are substituted only in tokens of mixed script whose repaired form is in the corpus vocabulary: ``νalue`` is ``value`` where
  the corpus has that word, and stays as it is where it hasn't.

All decisions depend only on what a token looks like and on the corpus vocabulary, hence texts that look
the same get the same form; and no step joins characters that look different (letter case, punctuation,
accents, raised digits, ordinary white space stay as they are).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimloom.operators.skew import lookup_join
from claimloom.session import cut

# Letters of other scripts and the Latin letters of the same shape.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХӀҮѴԌаеѕіјорсухһӏѵԁԛԝ", "ABESIJKMHOPCTYXIYVGaesijopcyxhlvdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj", strict=True))
ARMENIAN = dict(zip("Օօհ", "Ooh", strict=True))
SCRIPTS = {"cyrillic": CYRILLIC, "greek": GREEK, "armenian": ARMENIAN}
# Letters of other scripts and the Latin letters of nearly the same shape.
NEAR = {
    "cyrillic": dict(zip("гкпѡҽ", "rknwe", strict=True)),
    "greek": dict(zip("αγικνρσυω", "ayikvpouw", strict=True)),
    "armenian": dict(zip("ՍՏսոցգզյ", "USungqqj", strict=True)),
    "cherokee": dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏃᏎᏒᏔᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYZ4RWSVLCPKB", strict=True)),
}
#: Letter-like symbols that stand for a letter in another style (mathematical alphabets) are nearly that letter.
STYLED = range(0x1D400, 0x1D800)

# Characters that leave no mark on the page.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0100, 0xE01F0)]
# Spaces that look like the plain one, and hyphens that look like hyphen-minus.
SPACES = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]


def _base_table() -> dict[int, str]:
    table: dict[int, str] = dict.fromkeys(INVISIBLE, "")
    table |= dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-")
    for lo, hi in ((0x2160, 0x2188), (0xFB00, 0xFB07), (0xFF01, 0xFFEF), (0x212A, 0x212C)):
        for c in range(lo, hi):
            kind = unicodedata.decomposition(chr(c))
            if c not in table and kind:
                table[c] = unicodedata.normalize("NFKC", chr(c))
    return table


BASE = _base_table()
TO_LATIN = str.maketrans({k: v for m in SCRIPTS.values() for k, v in m.items()})
FROM_LATIN = {s: str.maketrans({v: k for k, v in m.items()}) for s, m in SCRIPTS.items()}
NEAR_LATIN = str.maketrans({k: v for m in NEAR.values() for k, v in m.items()} | {chr(c): k for c in STYLED if (k := unicodedata.normalize("NFKC", chr(c))).isascii() and k.isalpha()})
NEAR_FROM_LATIN = {s: str.maketrans({v: k for k, v in m.items()}) for s, m in NEAR.items() if s in SCRIPTS}
_OTHER_SCRIPT = re.compile("[\u0370-\u058f\u13a0-\u13ff\u1f00-\u1fff\U0001d400-\U0001d7ff]")
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_LATIN_ALIKE = {s: frozenset(m.values()) for s, m in SCRIPTS.items()}
_ANY_ALIKE = frozenset().union(*_LATIN_ALIKE.values())


def base(text: str) -> str:
    """Composed text in plain characters: width, ligature, space, hyphen and invisible variants folded."""
    if text.isascii():
        return text
    text = text.translate(BASE)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """``base`` with every look-alike letter in its Latin shape: equal exactly for texts that look the same."""
    text = base(text)
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return text
    loose = unicodedata.normalize("NFD", text).translate(TO_LATIN)
    return unicodedata.normalize("NFC", loose)


def _script(ch: str) -> str | None:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    if 0x13A0 <= o < 0x1400:
        return "cherokee"
    if o in STYLED:
        return "styled"
    return None


def dominant(shape: str, default: str = "latin") -> str:
    """The script most letters of a skeleton belong to, counting only letters that no other script has
    in that shape. Ties and tokens without such letters take ``default``."""
    votes: dict[str, int] = {}
    for ch in shape:
        if ch.isalpha() and ch not in _ANY_ALIKE and (s := _script(ch)):
            votes[s] = votes.get(s, 0) + 1
    if not votes:
        return default
    best = max(votes.values())
    tops = [s for s, n in votes.items() if n == best]
    return tops[0] if len(tops) == 1 else (default if default in tops else sorted(tops)[0])


def near_repair(tok: str, script: str) -> str | None:
    """A skeleton token of mixed script with letters of nearly the same shape in its dominant script; None if it isn't mixed or
    doesn't become a token of that script alone."""
    scripts = {_script(c) for c in tok if c.isalpha()}
    if len(tok) < 2 or len(scripts) < 2 and scripts != {"styled"}:
        return None
    script = "latin" if script == "styled" else script
    loose = unicodedata.normalize("NFD", tok)
    out = loose.translate(NEAR_LATIN) if script == "latin" else loose.translate(FROM_LATIN[script]).translate(NEAR_FROM_LATIN[script]) if script in FROM_LATIN else loose
    out = unicodedata.normalize("NFC", out)
    return out if out != tok and {_script(c) for c in out if c.isalpha()} == {script} else None


def candidates(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(skeleton of the text, [(skeleton token, repaired token)] for every token that holds a look-alike letter or whose
    dominant script isn't Latin). A token's repairs come in the order in which they are to be tried."""
    shape = skeleton(text)
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return shape, []
    whole = dominant(shape)
    plain = set(_TOKEN.findall(base(text)))
    out: dict[tuple[str, str], None] = {}
    for sentence in _SENTENCE.split(shape):
        here = dominant(sentence, whole)
        for tok in _TOKEN.findall(sentence):
            script = dominant(tok, here)
            if script in FROM_LATIN:
                out[tok, unicodedata.normalize("NFC", unicodedata.normalize("NFD", tok).translate(FROM_LATIN[script]))] = None
            elif tok.isascii():
                if tok not in plain:
                    out[tok, tok] = None
                continue
            if (near := near_repair(tok, script)) is not None:
                out[tok, near] = None
    return shape, [(a, b) for a, b in out if a != b or a not in plain]


def words(text: str) -> list[str]:
    """Letter runs of the text in base form: what the vocabulary is made of."""
    return _TOKEN.findall(base(text))


def _single_script(tok: str) -> bool:
    scripts = {_script(c) for c in tok if c.isalpha()}
    return len(scripts) == 1


def _vocabulary_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen: set[str] = set()
        for t in pdf["text"]:
            if t:
                seen.update(_TOKEN.findall(t if t.isascii() else base(t)))
        yield pd.DataFrame({"word": [w for w in seen if w.isascii() or _single_script(w)]}, dtype=object)


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct words (one script each) of the column ``text`` over all rows. Words are collapsed within
    each Arrow batch before the shuffle, which therefore carries vocabulary, not tokens."""
    return texts.select("text").where("text is not null").mapInPandas(_vocabulary_batches, "word string").distinct()


def _h(s: str) -> bytes:
    return xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))


def _shape_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        raw, shapes, toks = [], [], []
        for t in pdf["text"]:
            shape, cand = candidates(t)
            raw.append(_h(t))
            shapes.append(None if shape == t and not cand else shape)
            toks.append([{"tok": a, "cand": b, "rank": i} for i, (a, b) in enumerate(cand)])
        yield pd.DataFrame({"tab": pdf["tab"], "key": pdf["key"], "raw": raw, "shape": shapes, "toks": toks, "same": [_h(t) if s is None else b"" for t, s in zip(pdf["text"], shapes)]})


def shapes(texts: DataFrame) -> DataFrame:
    """(tab, key, raw, shape, toks, same) of ``texts`` (tab, key, text); null texts are left out.
    ``shape`` is null where the text is its own skeleton and has no token to look up (``same`` then is the hash of the text)."""
    schema = "tab string, key long, raw binary, shape string, toks array<struct<tok:string,cand:string,rank:int>>, same binary"
    return texts.select("tab", "key", "text").where("text is not null").mapInPandas(_shape_batches, schema)


def _apply_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        forms, hashes, done, left = [], [], [], []
        for shape, fixes in zip(pdf["shape"], pdf["fixes"]):
            known: dict[str, str] = {}
            asked = sorted(fixes, key=lambda f: f["rank"]) if fixes is not None else []
            for f in asked:
                if f["known"]:
                    known.setdefault(f["tok"], f["cand"])
            form = _TOKEN.sub(lambda m: known.get(m[0], m[0]), shape) if known else shape
            forms.append(form)
            hashes.append(_h(form))
            done.append(len(known))
            left.append(len({f["tok"] for f in asked}) - len(known))
        yield pd.DataFrame({"tab": pdf["tab"], "key": pdf["key"], "raw": pdf["raw"], "form": forms, "form_hash": hashes, "n_repaired": done, "n_unknown": left})


def repaired(texts: DataFrame) -> DataFrame:
    """The consistent form of every text that isn't its own skeleton, and the hash of the form of every text.

    Input: tab string, key long (unique in its tab), text string; other columns are ignored. Output: tab, key,
    raw (hash of the text), form (null: the text itself), form_hash, n_repaired (distinct tokens substituted
    because the result is in the vocabulary), n_unknown (tokens left in skeleton shape). Null texts give no
    row; empty and blank ones are their own form. One row per input row with a text; repeated rows stay.
    """
    s = cut(shapes(texts))
    vocab = vocabulary(texts)
    asked = s.where("shape is not null").select("tab", "key", F.explode("toks").alias("t")).select("tab", "key", "t.*")
    known = asked.select(F.col("cand").alias("word")).distinct().join(vocab, "word", "left_semi").select(F.col("word").alias("cand"), F.lit(True).alias("known"))
    fix = F.struct("tok", "cand", "rank", F.coalesce("known", F.lit(False)).alias("known"))
    fixes = asked.join(known, "cand", "left").groupBy("tab", "key").agg(F.collect_list(fix).alias("fixes"))
    odd = (
        s.where("shape is not null").select("tab", "key", "raw", "shape")
        .join(fixes, ["tab", "key"], "left")
        .mapInPandas(_apply_batches, "tab string, key long, raw binary, form string, form_hash binary, n_repaired long, n_unknown long")
    )
    plain = s.where("shape is null").select("tab", "key", "raw", F.lit(None).cast("string").alias("form"), F.col("same").alias("form_hash"), F.lit(0).cast("long").alias("n_repaired"), F.lit(0).cast("long").alias("n_unknown"))
    return odd.unionByName(plain)


def same_looking_classes(forms: DataFrame) -> DataFrame:
    """(tab, key, class_id, n_links) for every row whose table has a different text of the same form.

    class_id is the smallest key of the class, n_links the number of rows of the class with another text: the pairs of
    ``same_looking_pairs`` that hold the row, without listing them. Rows find their class through ``lookup_join``, so
    a text or form with a large part of all rows is neither gathered nor shuffled. Repeated keys count as rows.
    """
    forms = cut(forms.select("tab", "key", "raw", "form_hash"))
    name = F.concat(F.col("tab").cast("binary"), "form_hash")
    variants = forms.groupBy(name.alias("name"), "raw").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    classes = variants.groupBy("name").agg(F.count("*").alias("v"), F.sum("n").alias("rows"), F.min("first").alias("class_id")).where("v > 1")
    lookup = variants.join(classes, "name").select(F.concat("name", "raw").alias("text"), "class_id", (F.col("rows") - F.col("n")).alias("n_links"), "n")
    rows = forms.select("tab", "key", F.concat(name, "raw").alias("text"))
    return lookup_join(rows, lookup, "text", forms.count(), "n").select("tab", "key", "class_id", "n_links")


def same_looking_pairs(forms: DataFrame) -> DataFrame:
    """(tab, key_a, key_b), key_a < key_b, for rows of one table with the same form and different texts.

    Only forms with at least two different texts take part. Rows of a form are matched through pairs of
    *different texts* (class representatives), so exact copies are never paired with one another. The join key is
    (tab, form, text); joins stream, and adaptive execution splits a text that holds many of the rows.
    """
    forms = cut(forms.select("tab", "key", "raw", "form_hash"))
    variants = forms.groupBy("tab", "form_hash", "raw").agg(F.count("*").alias("n"))
    multi = variants.groupBy("tab", "form_hash").agg(F.count("*").alias("v")).where("v > 1").select("tab", "form_hash")
    v = variants.join(multi, ["tab", "form_hash"], "left_semi")
    links = v.select("tab", "form_hash", F.col("raw").alias("raw_a")).join(v.select("tab", "form_hash", F.col("raw").alias("raw_b")), ["tab", "form_hash"]).where("raw_a < raw_b")
    rows = forms.join(multi, ["tab", "form_hash"], "left_semi").select("tab", "form_hash", "raw", "key")
    left = links.join(rows.withColumnRenamed("raw", "raw_a").withColumnRenamed("key", "ka"), ["tab", "form_hash", "raw_a"])
    both = left.join(rows.withColumnRenamed("raw", "raw_b").withColumnRenamed("key", "kb"), ["tab", "form_hash", "raw_b"])
    return both.select("tab", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
