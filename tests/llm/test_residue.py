"""Residue: parsing, trusted wordings, accuracy on documents made here, edge cases."""

import random

from claimloom.llm import residue

RNG = random.Random(11)
NOUNS = "yield damping creep latency recall torsion albedo entropy diversity flux".split()
NAMES = [a + b for a in ("Ver", "Tol", "Quis", "Bran", "Lom") for b in ("dal", "orin", "eska", "umar", "ithe")]


def sentence(r):
    n, m, k = r.choice(NAMES), r.choice(NOUNS), r.choice(NOUNS)
    return r.choice([
        f"Our estimate of {r.random() * 30:.2f} mm agrees with the {n} value, although {m} fell.", f"It remains open whether {m} of the {n} reef depends on {k} or on the season.",
        f"Data were collected at {r.randint(2, 90)} stations by {n} staff, and {m} was coded twice.", f"Unlike {n}, the inlet showed strong {m} once {k} exceeded {r.random() * 9:.1f} Hz.", f"Does early {m} explain the {n} anomaly, or is {k} enough?",
    ])


def real(r, n):
    return " ".join(sentence(r) for _ in range(n))


BAD = ["{{abstract}}", "[Insert results here]", "TODO: write the methods", "Lorem ipsum dolor sit amet felis temporis carpiter.", "\\lipsum[1-3]", "\\blindtext", "Please enable JavaScript to view this document.", "JavaScript is disabled in your browser. Some parts will not work.",
       "Error 404 while reading file 99.", "404 Not Found", "java.lang.IllegalStateException: no stream at a.B(C.java:1)", "Bla bla bla bla bla bla bla bla.", "XXXX XXXX XXXX", "TBD", "Placeholder for title"]


def document(r, bad=None, where="section"):
    if where == "whole" and bad:
        return bad
    parts = ["\\documentclass{article}\n\\usepackage{lipsum}\n\\begin{document}\n\\maketitle", "\\begin{abstract}\n" + (bad if where == "abstract" and bad else real(r, 3)) + "\n\\end{abstract}"]
    for i, h in enumerate(("Introduction", "Methods", "Results")):
        parts.append(f"\\section{{{h}}}\\label{{s:{i}}}\n\n" + (bad if bad and where == "section" and i == 1 else real(r, 4) + "\n\n" + real(r, 2)))
    return "\n\n".join([*parts, "\\end{document}"])


NOT_CASES = [
    "In the layout study, lorem ipsum passages were shown to 117 participants for 9.16 km. " + sentence(RNG) + "\n\n" + real(RNG, 3), "Pages that ask readers to enable JavaScript made up 60.5\\% of the Verdal sample and were read by hand. " + sentence(RNG) + "\n\n" + real(RNG, 3),
    "\\section{A}\n\n% TODO: write this\n" + sentence(RNG), "\\section{A}\n\n\\input{sections/a}\n\n\\section{B}\n" + real(RNG, 3), sentence(RNG), "\\section{A}\n\n\\begin{equation}\nx = 1\n\\end{equation}", "\\section{A}\n\\begin{tabular}{l}\nVerdal & 1.2\\\\\n\\end{tabular}", "", "   ", None,
]


def corpus():
    r = random.Random(2)
    rows, truth = [], set()
    for d in range(400):
        bad = BAD[d % len(BAD)] if d % 4 == 0 else None
        text = document(r, bad, ("section", "abstract", "whole")[d // 4 % 3])
        if not bad and d % 5 == 0:  # articles that write about such wording
            text = text.replace("\\section{Results}", NOT_CASES[d // 5 % 2].rpartition(". ")[0].replace("117", str(d)).replace("60.5", f"{d / 7:.1f}") + ". " + sentence(r) + "\n\n\\section{Results}")
        rows.append((d, text))
        if bad:
            truth.add(d)
    return rows, truth


def test_units():
    u = residue.units("\\documentclass{a}\n\\begin{document}\n\\begin{abstract}x\\end{abstract}\n\\section{S \\emph{t}}\\label{q}\n% c\n{% block b %}\n\npara\n\\subsection{T}\n\\input{f}\n\\end{document} tail")
    assert u == [("abstract", ["x"]), ("front", []), ("section", ["{{tag}}", "para"]), ("section", [])]


def test_trusted():
    assert all(residue.trusted(b) for b in BAD)
    assert not any(residue.trusted(t) for t in NOT_CASES if t)


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    extra = [(1000 + i, t) for i, t in enumerate(NOT_CASES)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows + extra] + [(0, rows[0][1], "again")], "doc_id long, text string, units string")
    got = {r["doc_id"]: r for r in residue.marked(df).collect()}
    found = {d for d, r in got.items() if r["is_residue"]}
    assert len(got) == len(rows) + len(extra)
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 2, (sorted(truth - found), sorted(found - truth))
    assert not found & {1000 + i for i in range(len(NOT_CASES))}
    assert got[0]["units"] == "section" and got[4]["units"] == "abstract" and got[8]["units"] == "whole"


def test_generalises_beyond_trusted_wording():
    rows, _ = corpus()
    r = random.Random(3)
    unseen = ["The reader cannot run without scripting in your browser. Please allow it for this document.", "Error while reading the file."]
    texts = [t for _, t in rows] + [document(r, b) for b in unseen * 6]
    w, b = residue.fit(sorted({p for t in texts for _, ps in residue.units(t) for p in ps}))
    assert residue.score(unseen[0], w, b) > 0


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert residue.marked(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, ""), (3, "Some plain words. " * 50_000)], "doc_id long, text string")
    assert [r["is_residue"] for r in residue.marked(one).orderBy("doc_id").collect()] == [False, False, False]


def test_trusted_passages_beyond_the_sample(spark):
    """Trusted passages are residue whatever a fit says that never saw them."""
    real = "We measured the yield of sample {0} in 19{0} and found that the Tolorin value of $x_{0}$ fell by {0} percent, as \\cite{{a}} states."
    rows = [(i, "\\section{A}\n" + real.format(i) + "\n\\section{B}\n" + real.format(i + 1000)) for i in range(300)]
    bad = ["\\Kant[3]", "\\blindtext", "FIXME", "[insert your text here]", "placeholder for text", "placeholder for figure"]
    rows += [(1000 + i, f"\\section{{A}}\n{real.format(i)}\n\\section{{B}}\n{b}") for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (1, 20, 1000):
        assert {r[0] for r in residue.marked(df, sample).where("is_residue").collect()} == {1000 + i for i in range(len(bad))}
