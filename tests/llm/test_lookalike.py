"""Consistent forms of text that looks the same."""

from claimloom.llm import lookalike as L

PAIRS = [
    ("Effect: 1.18", "Ｅｆｆｅｃｔ: 1.18"), ("naïve", "nai\u0308ve"), ("soft", "so\u00adft"), ("a b", "a\u00a0b"), ("a-b", "a‐b"), ("fine", "ﬁne"), ("Xenon", "Χenοn"), ("spice", "ѕрісе"), ("VI", "ⅤⅠ"), ("Å", "Å"), ("é", "е\u0301"),
    ("a", "а"), ("K", "K"), ("x", "x\ufe0f"), ("hidden", "һіԁԁеn"), ("coo", "сօо"),
]
APART = [("a", "A"), ("a.", "a"), ("cafe", "café"), ("x2", "x²"), ("a b", "a  b"), ("a b", "a\tb"), ("α", "a"), ("l", "1"), ("O", "0"), ("–", "-"), ("e\u0300", "e\u0301")]


def forms(spark, texts):
    df = spark.createDataFrame([("t", i, t, "clash", 3) for i, t in enumerate(texts)], "tab string, key long, text string, form string, raw int")
    return df, {r["key"]: r for r in L.repaired(df).collect()}


def test_skeleton():
    for a, b in PAIRS:
        assert L.skeleton(a) == L.skeleton(b), (a, b)
    for a, b in APART:
        assert L.skeleton(a) != L.skeleton(b), (a, b)


def test_script_of_a_token_decides(spark):
    texts = ["измерения прошли", "измepения", "Rikellozen rose", "Rіkеllozen rose", "Η μέτρηση έγινε.", "H μέτρηση έγινε.", "qхzунот"]
    _, f = forms(spark, texts)
    form = lambda i: f[i]["form"] or texts[i]
    assert form(1) == "измерения" and f[1]["n_repaired"] == 1
    assert form(3) == form(2) == texts[2]
    assert form(4) == form(5) == texts[4]
    assert f[6]["n_unknown"] == 1


def test_pairs_against_brute_force(spark):
    texts = [t for p in PAIRS + APART for t in p] + [None, "", " ", "spice", "spice", "ѕрісе", "long ехаmple " * 20_000, "long example " * 20_000]
    df, f = forms(spark, texts)
    assert set(f) == {i for i, t in enumerate(texts) if t is not None}
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and L.skeleton(texts[a]) == L.skeleton(texts[b])}
    got = L.same_looking_pairs(L.repaired(df)).collect()
    assert {(r["key_a"], r["key_b"]) for r in got} == want and len(got) == len(want)
    assert L.same_looking_pairs(L.repaired(df.limit(0))).count() == 0


def test_vocabulary_decides_near_look_alikes(spark):
    texts = ["a νalue of αdmittance", "a value of admittance", "the νυ law", "the vu law", "𝐯alue", "𝐯𝐚𝐥𝐮𝐞"]
    plain = "value, admittance, vu and νυ are words"

    def pairs(*more):
        df = spark.createDataFrame([("t", i, t) for i, t in enumerate([*texts, *more])], "tab string, key long, text string")
        return {(r["key_a"], r["key_b"]) for r in L.same_looking_pairs(L.repaired(df)).collect()}

    assert pairs(plain) == {(0, 1), (4, 5)}
    # The skeleton alone joins none of them, and without the words in the corpus nothing may be substituted.
    assert len({L.skeleton(t) for t in texts}) == len(texts)
    texts[1] = "a factor of admittances"
    assert pairs(plain) == {(4, 5)} and pairs() == set()


def test_near_repair():
    assert L.near_repair("νalue", "latin") == "value" and L.near_repair("𝐯𝐚𝐥𝐮𝐞", "styled") == "value"
    assert L.near_repair("νυ", "greek") is None and L.near_repair("α", "latin") is None and L.near_repair("value", "latin") is None
    assert L.near_repair("дorовор", "cyrillic") == "договор"


def test_classes_count_the_pairs(spark):
    texts = [t for p in PAIRS + APART for t in p] + [None, "", "spice", "spice", "ѕрісе"]
    df = spark.createDataFrame([(("t", "u")[i % 7 == 0], i, t, 5) for i, t in enumerate(texts)], "tab string, key long, text string, class_id int")
    f = L.repaired(df)
    links: dict = {}
    for r in L.same_looking_pairs(f).collect():
        for k in (r["key_a"], r["key_b"]):
            links[r["tab"], k] = links.get((r["tab"], k), 0) + 1
    got = L.same_looking_classes(f).collect()
    assert {(r["tab"], r["key"]): r["n_links"] for r in got} == links and len(got) == len(links)
    assert all(r["class_id"] <= r["key"] for r in got)
    assert L.same_looking_classes(L.repaired(df.limit(0))).count() == 0


def test_tables_stay_apart(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "х"), ("a", 3, "х")], "tab string, key long, text string")
    assert [tuple(r) for r in L.same_looking_pairs(L.repaired(df)).collect()] == [("a", 1, 3)]


def test_vocabulary(spark):
    df = spark.createDataFrame([("plain words, plain",), ("mіxed",), (None,)], "text string")
    assert {r[0] for r in L.vocabulary(df).collect()} == {"plain", "words"}
