"""Identifiers against tables of (input, output)."""

import ipaddress

from pyspark.sql import functions as F

from claimloom.functions import identifiers as I


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_doi(spark):
    cases = {
        "10.1234/AbC.": "10.1234/abc", "doi:10.1234/x": "10.1234/x", "https://doi.org/10.1234%2Fx": "10.1234/x", "https://dx.doi.org/10.1234/x?y=1": "10.1234/x",
        "https://example.org/10.1234/x": None, "https://u:p@doi.org/10.1234/x": None, "see (10.1234/a(b)c).": "10.1234/a(b)c", "Smith (10.1234/x)": "10.1234/x", "none": None, "": None, "10.1234/a+b": "10.1234/a+b",
    }
    assert run(spark, I.normalize_doi, list(cases)) == list(cases.values())
    assert run(spark, I.normalize_doi, [None]) == [None]


def test_source_kind(spark):
    cases = {
        "C:\\papers\\x.pdf": ("local_pdf", "local:C:\\papers\\x.pdf"), "arXiv: 2301.12345v2": ("arxiv", "arxiv:2301.12345v2"), "hep-th/9901001": ("arxiv", "arxiv:hep-th/9901001"),
        "10.1234/1234567": ("arxiv", "arxiv:10.1234/1234567"), "10.1234/abc": ("reference", "doi:10.1234/abc"), "https://arxiv.org/abs/2301.12345": ("arxiv", "arxiv:2301.12345"),
        "https://arxiv.org/pdf/2301.12345.pdf": ("arxiv", "arxiv:2301.12345"), "https://x.example/a.PDF?q=1": ("pdf_url", "url:https://x.example/a.PDF?q=1"),
        "HTTPS://X.Example/Path?Q=1#frag": ("html_url", "url:https://x.example/Path?Q=1"), "https://u:p@x.example/": ("blocked", None), "A title of words": ("citation", None),
        "/data/in/x y z": ("local_pdf", "local:/data/in/x y z"), "./a.pdf": ("local_pdf", "local:./a.pdf"), "paper.pdf": ("local_pdf", "local:paper.pdf"), "~/p/q.PDF": ("local_pdf", "local:~/p/q.PDF"), "10.1234/abc.pdf": ("reference", "doi:10.1234/abc.pdf"), "//x/y": ("unsupported", None), "short": ("unsupported", None), "  ": ("empty", None),
    }
    assert [tuple(r) for r in run(spark, I.source_kind, list(cases))] == list(cases.values())


def test_canonical_url(spark):
    assert run(spark, I.canonical_url, [" HTTP://A.b/C?d=E#f", "ftp://a/b", "http:///x", "http://a", None]) == ["http://a.b/C?d=E", None, None, "http://a", None]


def test_public_addresses(spark):
    hosts = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "100.64.0.1", "198.18.0.1", "203.0.113.9", "240.0.0.1", "255.255.255.255", "1.1.1.1", "0.1.2.3", "192.0.0.9"]
    got = run(spark, I.is_public_url, [f"http://{h}/x" for h in hosts])
    assert got == [ipaddress.ip_address(h).is_global for h in hosts]
    assert run(spark, I.is_public_url, ["http://localhost/", "ftp://8.8.8.8/", "https://a.example"]) == [False, False, True]


def test_public_addresses_in_all_forms(spark):
    v6 = ["::1", "::", "fe80::1", "fc00::1", "fd12:3456::1", "2001:db8::1", "2001:4860:4860::8888", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b:1::1", "2002:a00:1::1", "2001:20::1", "2001:10::1", "100::1", "1:2:3:4:5:6:7:8"]
    got = run(spark, I.is_public_url, [f"http://[{h}]:8080/x" for h in v6])
    assert dict(zip(v6, got)) == {h: ipaddress.ip_address(h).is_global for h in v6}
    numbers = {"2130706433": False, "134744072": True, "0x7f000001": False, "0x08080808": True, "017700000001": False, "127.1": False, "8.8.2056": True, "10.1.1": False, "4294967296": False, "1.2.3.4.5": False, "256.1.1.1": False, "0177.0.0.1": False, "010.8.8.8": True}
    assert dict(zip(numbers, run(spark, I.is_public_url, [f"http://{h}/" for h in numbers]))) == numbers
    names = {"http://localhost./": False, "http://[3fff::1]/": False, "http://a.localhost/": False, "http://[::1": False, "http://[nonsense]/": False, "http://[fe80::1%25eth0]/": False, "http://a.example./": True, "http://user@[::1]:80/": False, "http://x1.example": True, None: False}
    assert dict(zip(names, run(spark, I.is_public_url, list(names)))) == names


def test_safe_filename(spark):
    cases = {"../../secret.txt": "secret.txt", "C:\\Windows\\file": "file", " a b.pdf ": "a b.pdf", "x/": None, "..": None, ".": None, "": None, "a\\..": None, "...": "...", None: None}
    assert dict(zip(cases, run(spark, I.safe_filename, list(cases)))) == cases
