"""Page bodies on pages made here."""

import random

from claimloom.llm import boilerplate as B

NOUNS = "yield damping creep latency recall torsion albedo entropy diversity flux".split()
NAMES = [a + b for a in ("Ver", "Tol", "Quis", "Bran", "Lom", "Hol") for b in ("dal", "orin", "eska", "umar", "ithe", "onde")]


def sentence(r):
    n, m, k = r.choice(NAMES), r.choice(NOUNS), r.choice(NOUNS)
    return r.choice([
        f"Our estimate of {r.random() * 30:.2f} mm agrees with the {n} value, although {m} fell slowly.", f"It remains open whether the {m} of the {n} reef depends on {k} or on the season.",
        f"Data were collected at {r.randint(2, 90)} stations by {n} staff, and {m} was coded twice.", f"Unlike {n}, the inlet showed strong {m} once {k} exceeded {r.random() * 9:.1f} Hz.",
    ])


def made(r, host, kind):
    title = f"On the {r.choice(NOUNS)} of {r.choice(NAMES)} and {r.choice(NAMES)} {r.randint(1, 9999)}"
    body, parts = [], []
    for h in ("Introduction", "Methods", "Results"):
        parts.append(("h", h))
        for _ in range(3):
            p = " ".join(sentence(r) for _ in range(r.choice([1, 2, 4, 5])))
            body.append(p)
            parts.append(("p", p))
    promo = f"Sign up for the weekly digest of {host} and get news sent straight to your {r.choice(['phone', 'inbox'])}."
    parts.insert(5, ("p", promo))
    teaser = f"Related: {sentence(r)}"
    cookie = f"By using {host} you agree to our use of cookies for {r.randint(9, 99)} days, as described on the privacy page."
    abstract = sentence(r) + " " + sentence(r)
    if kind == "source":
        lines = ["News", "About", cookie, title, "A. Author", "Abstract", abstract, *[x for _, x in parts], "References", "1. Author, A. On the recall of things that matter. Journal of Things 4, 5 (2001).", teaser, cookie]
        return title, set(body), "\n\n".join(lines)
    inner = "".join(f"<h2>{x}</h2>" if t == "h" else f"<p>{x[:9]}<em>{x[9:14]}</em>{x[14:]}" for t, x in parts)  # paragraphs are never closed
    page = f"<html><head><title>{title}</title><script>var t='{sentence(r)}'</script></head><body><nav><ul><li>News<li>About</ul><div class='cookie-bar'><p>{cookie}</div><article><h1>{title}</h1><p>A. Author</p><div class='abstract'><h2>Abstract</h2><p>{abstract}</div>{inner}<h2>References</h2><ol><li>1. Author, A. On the recall of things that matter. Journal of Things 4, 5 (2001).</ol></article><aside><p>{teaser}</p><p>{sentence(r)}</p></aside><footer><p>{cookie}</p></footer></body></html>"
    return title, set(body), page


def tables(spark, n=80):
    r = random.Random(4)
    res, src, want = [], [], {}
    for i in range(n):
        host = f"site{i % 3}.example"
        _, body, page = made(r, host, "resource")
        charset = ("utf-8", "iso-8859-1")[i % 2]
        res.append((i, f"https://{host}/p/{i}", bytearray(page.encode(charset)), f"text/html; charset={charset}", 200))
        want["resource", i] = body
        _, body, text = made(r, host, "source")
        src.append((i, f"https://{host}/s/{i}", text, "html_url" if i % 2 else "doi_html"))
        want["source", i] = body
    res += [(900, None, None, None, 200), (901, "x", bytearray(b""), None, 200), (902, "https://a.example", bytearray(b"%PDF-1.7 broken"), "text/html", 200), (903, "https://a.example", bytearray(b"<article><h1>T</h1><h2>Introduction</h2><p>" + b"never mind this page at all because it is gone. " * 3), None, 404)]
    src += [(900, None, None, "html_url"), (901, "u", "", "html_url"), (902, "u", "Introduction\n" + sentence(r), "arxiv")]
    rd = spark.createDataFrame([(*x, "clash", 1) for x in res], "resource_id long, url string, data binary, content_type string, status int, text string, host int")
    sd = spark.createDataFrame([(*x, 1) for x in src], "source_id long, canonical_url string, text string, source_type string, data int")
    return rd, sd, want


def test_bodies(spark, monkeypatch):
    rd, sd, want = tables(spark)
    rows = B.paragraphs(rd, sd).collect()
    got = {}
    for x in rows:
        got.setdefault((x["kind"], x["page_key"]), set()).add(x["paragraph"])
    assert sum(map(len, got.values())) == len(rows) and set(got) <= set(want)
    true = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert true >= 0.99 * sum(map(len, want.values())) and true >= 0.99 * len(rows)
    monkeypatch.setattr(B, "SIDE_ROWS", 0)  # runs and wrappers too large to hand out meet the pages host by host
    monkeypatch.setattr(B, "HOT", 9)  # and hosts with many pages are spread
    again = B.paragraphs(rd, sd).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_running_text_of_every_page_counts(spark):
    """More pages than running text was once learnt from; each wording stands in the running text of one page only."""
    words = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "ben dar fil gom".split()]
    short = [f"The {w} rises when {x} cools below the {y} of the basin." for w, x, y in zip(words, words[1:] + words[:1], words[2:] + words[:2])]
    rows, want = [], set()
    for i in range(6000):
        x = short[i % len(short)]
        body = [f"{x} It is so. {x}", x] if i < len(short) else [x] if i < 8 * len(short) else []
        want |= {("source", i, b) for b in body}
        rows.append((i, "https://one.example/p", "\n".join([f"Title {i} of a page", "A. Author", "Abstract", "We study this.", "Introduction", *body, "We went there and it rained. It went on. We left."]), "html_url"))
        want.add(("source", i, "We went there and it rained. It went on. We left."))
    none = spark.createDataFrame([], "resource_id long, url string, data binary, content_type string, status int")
    got = B.paragraphs(none, spark.createDataFrame(rows, "source_id long, canonical_url string, text string, source_type string"))
    assert {tuple(r) for r in got.collect()} == want


def test_runs_follow_tokens():
    a, b = "It is 3.5 mm at www.x.com, Tom said.", "It is 9 mm at www.why.com, Ann said."
    stream = B.codes([a, "", "Hello", b])
    h, inside = B.runs_of(stream)
    begins = [i for i, c in enumerate(stream) if c == B.BEGIN]
    lists = B.tokens([a, "", "Hello", b])
    n = len(lists[0])
    assert len(begins) == 4 and inside.sum() == sum(map(len, lists)) and lists[1:3] == [[], ["hello"]]
    assert lists[0] == lists[3] == "it is # mm at @ , N said .".split() and (h[:n] == h[begins[3] : begins[3] + n]).all() and len(set(h[:n])) == n


def items(text, *anchors):
    toks = [t if t != "_" else B.SLOT for t in text.split()]
    return [(t, False, i in anchors) for i, t in enumerate(toks)]


def test_alignment_makes_slots_and_optional_groups():
    w = items("^ we use cookies to measure visits . $", 0, 1, 6)
    w = B.align(w, "^ we use tools to measure visits . $".split())
    assert B.expression(w).replace("\\ ", " ") == r"\^ we use (?:\S+ )*?to measure visits \. \$ "
    w = B.align(w, ["^", "we", "use", B.SLOT, "to", "measure", "all", "visits", ".", "$"])
    assert "measure (?:all )?visits" in B.expression(w).replace("\\ ", " ")
    import re

    e = re.compile(B.expression(w))
    assert e.fullmatch("^ we use a b c to measure visits . $ ") and not e.fullmatch("^ we use a to count visits . $ ")
    assert B.align(w, "^ the reef lost all of its colour . $".split()) is None  # another text
    r = random.Random(2)
    for _ in range(300):
        x, y = ([r.choice("abcdef_") for _ in range(r.randint(3, 9))] for _ in range(2))
        if B.align(items(" ".join(x), 0, 2), [t if t != "_" else B.SLOT for t in y]) is not None:
            assert B.may_align(items(" ".join(x), 0, 2), [t if t != "_" else B.SLOT for t in y])
    assert B.align(items("^ a b c d e f g $", 6), "^ a b c d e x y $".split()) is None  # agrees, but on no fixed run


def test_units_that_follow_themselves_are_one_group():
    e = B.expression(items("^ home | news | _ | about | $", 0))
    assert e.count(")+") == 0
    e = B.expression(items("^ _ | _ | _ | $", 5))
    assert e.replace("\\ ", " ").count(")+") == 1
    import re

    assert re.fullmatch(e, "^ a b | c | d | e f | $ ") and not re.fullmatch(e, "^ a b | c | d $ ")
    assert re.fullmatch(e, "^ " + "a | " * 2000 + "b $ ") is None  # and it fails in linear time


def test_empty(spark):
    rd, sd, _ = tables(spark, 2)
    assert B.paragraphs(rd.limit(0), sd.limit(0)).count() == 0


def test_decode():
    assert B.decode("é".encode(), None) == "é" and B.decode("é".encode("cp1252"), None) == "é" and B.decode(b"\xef\xbb\xbfx", None) == "x"
    assert B.decode("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é" and B.decode(b'<meta charset="utf-8">' + "é".encode(), None).endswith("é") and B.decode(b"x", "text/html; charset=nonsense") == "x"


def test_blocks():
    title, blocks = B.html_blocks("<body><nav><p>menu item with words<h1>Title</h1><h2>Introduction</h2><div>A &amp; b <i>c</i>d<br>e</div><aside><p>off</p></aside><p>two</p></body>")
    assert title == "Title" and ("body", "A & b cde") in blocks and ("body", "two") in blocks and ("site", "off") in blocks
    assert B.html_blocks("")[1] == [] and B.line_blocks("")[1] == []


def test_tokens():
    assert B.tokens(["Don\u2019t e-mail i.e. Tom: 1,234.5 (3.) x466 \u2014 \xc9T\xc9"]) == ["don\u2019t e-mail i.e . N : # ( # . ) x # \u2014 N".split()]
    assert B.tokens([]) == [] and B.tokens(["", "_ "]) == [[], []] and list(B.codes([])) == [] and list(B.codes([""])) == [B.BEGIN, B.END]
