"""The article gate on small pages."""

from claimloom.operators import html

BODY = "<p>" + "Real text of the study. " * 40 + "</p>"


def page(inner, head=""):
    return f"<html><head>{head}</head><body>{inner}</body></html>".encode()


def test_gate():
    good = page(f"<nav>menu</nav><article><h1>T</h1><div class='abstract'><p>hidden</p></div><h2>1. Introduction</h2>{BODY}<h2>Results</h2>{BODY}<h2>References</h2><p>cited</p></article><aside>ad</aside>")
    r = html.read_article(good, "text/html; charset=utf-8")
    assert r["accepted"] and r["sections"] == ["introduction", "results"] and "hidden" not in r["raw"] and "cited" not in r["raw"] and "menu" not in r["raw"] and "ad" not in r["raw"].split()
    assert html.read_article(page(f"<article><h2>Introduction</h2>{BODY}{BODY}</article>"), None)["reason"] == "INCOMPLETE"
    assert html.read_article(page("<article><h2>Introduction</h2><p>x</p><h2>Methods</h2></article>"), None)["reason"] == "INCOMPLETE"
    assert html.read_article(page(f"<div>{BODY}</div>"), None)["reason"] == "NO_BODY"
    assert html.read_article(b"", None)["reason"] == "EMPTY"
    assert html.read_article(page("<div>" * 300), None)["reason"] == "DEPTH_LIMIT"
    assert html.read_article(page("<p>" + "<b></b>" * 50_001), None)["reason"] == "ELEMENT_LIMIT"


def test_body_container_first_and_charset():
    p = page(f"<main><h2>Introduction</h2>{BODY}<div class='article-body'><h2>Methods</h2>{BODY}<h3>Discussion</h3>{BODY}</div></main>")
    assert html.read_article(p, None)["sections"] == ["discussion", "methods"]
    assert "é" in html.read_article(page(f"<article><h2>Introduction</h2><p>é</p>{BODY}<h2>Results</h2>{BODY}</article>").decode().encode("latin-1"), "text/html; charset=iso-8859-1")["raw"]
    assert html.read_article(page("<article></article>"), "text/html; charset=none-such")["reason"] == "INCOMPLETE"


def test_frames(spark):
    df = spark.createDataFrame([(1, bytearray(page(f"<article><h2>Introduction</h2>{BODY}<h2>Results</h2>{BODY}</article>", "<meta name='Citation_Title' content='A'><meta name='citation_title' content='B'>")), None), (2, None, "text/html"), (3, bytearray(b""), None)], "resource_id long, data binary, content_type string")
    got = {r["resource_id"]: r for r in html.articles(df).collect()}
    assert got[1]["accepted"] and got[1]["text"].startswith("Introduction") and not got[2]["accepted"] and got[3]["reason"] == "EMPTY"
    assert [tuple(r) for r in html.metadata(df).collect()] == [(1, "citation_title", "B")]
    assert html.articles(df.limit(0)).count() == 0
