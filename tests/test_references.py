"""Reference identity on a small registry."""

import json

import pytest

from claimloom.operators import references

REF = "ref_id int, doi string, title string, authors array<string>, year string, publisher string, container_title string, citation string"


@pytest.fixture(scope="module")
def registry(spark):
    works = [
        {"DOI": "10.1234/A", "title": ["A Study of Mice"], "author": [{"given": "Jane", "family": "Doe"}, {"name": "Group X"}], "published": {"date-parts": [[2024]]}, "published-print": {"date-parts": [[2023, 5]]}, "publisher": "P", "container-title": ["J"], "link": [{"URL": "l1"}, {"URL": "l1"}], "URL": "u1"},
        {"DOI": "10.1234/b", "title": ["Twins"], "author": [{"family": "Roe"}], "published": {"date-parts": [[2000]]}},
        {"DOI": "10.1234/c", "title": ["Twins"], "author": [{"family": "Poe"}], "published": {"date-parts": [[2001]]}},
        {"DOI": "10.1234/d", "title": []},
    ]
    rows = [(i, json.dumps({"message": w} if i % 2 else w), "Crossref") for i, w in enumerate(works)]
    rows.append((9, json.dumps({"data": {"attributes": {"doi": "10.9999/E", "titles": [{"title": "Data Set"}], "creators": [{"name": "Moe, Max"}], "publicationYear": 2020, "publisher": "Repo", "url": "u9"}}}), "DataCite"))
    return references.registry_records(spark.createDataFrame(rows, "record_id long, payload string, registry string"))


def test_records(registry):
    r = {x["doi"]: x for x in registry.collect()}
    a = r["10.1234/a"]
    assert a["years"] == ["2023", "2024"] and a["authors"] == ["Jane Doe", "Group X"] and a["title"] == "A Study of Mice" and a["full_text_urls"] == ["l1", "l1"]
    e = r["10.9999/e"]
    assert e["years"] == ["2020"] and e["authors"] == ["Moe, Max"] and e["url"] == "u9" and e["publisher"] == "Repo"


def test_resolve(spark, registry):
    refs = [
        (1, "10.1234/A", None, None, None, None, None, None), (2, "10.1234/a", "A study of mice!", ["J. Doe"], "2024", "P", "J", None), (3, "10.1234/a", "Other", None, None, None, None, None),
        (4, "10.1234/b", "Twins", None, None, "P", None, None), (5, None, "twins", None, None, None, None, None), (6, None, "Twins", None, "2001", None, None, None), (7, "10.1234/zzz", None, None, None, None, None, None),
        (8, None, None, None, None, None, None, "Doe J. A study of mice. J, 2024"), (9, None, None, None, None, None, None, "Smith. A study of mice. 2024"), (10, None, None, None, None, None, None, "Doe. A study of mice. 1999"),
        (11, None, None, None, None, None, None, None), (12, "nonsense", None, None, None, None, None, None), (13, None, " ", None, None, None, None, None), (14, None, "x", None, "24", None, None, None), (15, None, None, None, None, None, None, "https://u:p@doi.org/10.1234/a"),
        (16, None, None, None, None, None, None, "Doe, A study of mice, 2023, https://doi.org/10.1234/a extra"), (17, None, None, None, None, None, None, "doi:10.1234/a"), (18, "10.1234/a", None, ["Jane"], None, None, None, None),
    ]
    got = {r["ref_id"]: r for r in references.resolve(spark.createDataFrame(refs, REF), references.registry_table(registry)).collect()}
    want = {1: "VERIFIED", 2: "VERIFIED", 3: "METADATA_MISMATCH", 4: "PARTIALLY_VERIFIED", 5: "AMBIGUOUS", 6: "VERIFIED", 7: "NOT_FOUND", 8: "VERIFIED", 9: "NOT_FOUND", 10: "NOT_FOUND", 11: "INVALID_INPUT", 12: "INVALID_INPUT", 13: "INVALID_INPUT", 14: "INVALID_INPUT", 15: "INVALID_INPUT", 17: "VERIFIED", 18: "METADATA_MISMATCH"}
    assert {k: got[k]["status"] for k in want} == want
    assert got[6]["doi"] == "10.1234/c" and got[2]["checks"]["authors"] == "MATCH" and got[3]["verdict"] == "WARN" and got[5]["verdict"] == "ABSTAIN" and got[16]["checks"].get("citation") == "MATCH"


def test_author_names(spark):
    cases = [("Jane Doe", "Doe, Jane", True), ("J. Doe", "Jane Doe", True), ("Doe J", "Jane Doe", True), ("Jane", "Jane Doe", False), ("K. Doe", "Jane Doe", False), ("Doe", "Jane Doe", True), ("", "Jane Doe", False), (None, "Jane Doe", False), ("Jane Doe", "", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, g string, r string")
    assert [x["is_match"] for x in references.author_match(df, "g", "r").orderBy("i").collect()] == [c[2] for c in cases]


def test_gate_urls_ratio_identity(spark):
    from pyspark.sql import functions as F

    res = spark.createDataFrame([(1, "VERIFIED"), (2, "AMBIGUOUS")], "ref_id int, status string")
    v = spark.createDataFrame([(1, "PASS", "r"), (2, "PASS", "r")], "ref_id int, claim_verdict string, claim_reason string")
    assert sorted(map(tuple, references.gated(res, v).collect())) == [(1, "VERIFIED", "PASS", "r"), (2, "AMBIGUOUS", "ABSTAIN", "REFERENCE_UNVERIFIED")]
    df = spark.createDataFrame([(["a", "b", "a", "c", "d", "e", "f"], None, "10.1/x"), (None, "u", "10.1/y")], "f array<string>, u string, d string")
    assert [r[0] for r in df.select(references.candidate_urls(F.col("f"), F.col("u"), F.col("d"))).collect()] == [["a", "b", "c", "d", "e", "f"], ["u", "https://doi.org/10.1/y"]]
    t = spark.createDataFrame([("abcd", "bcde"), ("abc", ""), ("same", "same")], "a string, b string")
    assert [r[0] for r in t.select(references.title_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 1.0]
    i = spark.createDataFrame([("10.1/X", "Some Title", "doi 10.1/x"), ("10.1/q", "Some title", "A SOME-TITLE b"), ("10.1/q", "Some title", "z" * 4000 + " some title")], "d string, t string, x string")
    assert [r[0] for r in i.select(references.identity_in_text(F.col("d"), F.col("t"), F.col("x"))).collect()] == [True, True, False]
