"""Identifiers of works and sources: DOIs, arXiv ids, URLs, kinds of source strings."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from claimloom.functions.text import bind, strip

# Shapes of identifiers.
DOI = r"(?i)10\.[0-9]{4,9}/[^\s<>\x22]+"
ARXIV = r"(?i)^(?:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[A-Za-z0-9.\-]+/[0-9]{7}(?:v[0-9]+)?)$"
LOCAL = r"^(?:[A-Za-z]:[\\/]|/(?!/)|\.{1,2}[\\/]|~[\\/])"
LOCAL_FILE = r"(?i)^[^\s:]+\.pdf$"
DOI_HOSTS = ("doi.org", "dx.doi.org", "www.doi.org")
ARXIV_HOSTS = ("arxiv.org", "www.arxiv.org")
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(c: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark; empty where there is none."""
    return F.regexp_extract(c, _URL, k)


def host(c: Column) -> Column:
    """Lower-case host without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(url_part(c, 2), "^[^@]*@", ""), r":[0-9]*$", ""))


def has_credentials(c: Column) -> Column:
    return F.contains(url_part(c, 2), F.lit("@"))


def is_http(c: Column) -> Column:
    return F.lower(url_part(c, 1)).isin("http", "https")


def unquoted(c: Column) -> Column:
    """Percent-decoded; a plus sign stays one; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normalize_doi(c: Column) -> Column:
    """The first DOI of a DOI, resolver URL or citation, in lower case; null if there is none, or if the URL is
    another host's or holds credentials."""
    def unbracketed(found: Column) -> Column:
        # Closing brackets at the end that no opening one belongs to.
        surplus = F.greatest(F.lit(0), F.length(F.regexp_replace(found, r"[^)]", "")) - F.length(F.regexp_replace(found, r"[^(]", "")))
        tail = F.length(found) - F.length(F.regexp_replace(found, r"\)+$", ""))
        return F.nullif(F.lower(F.substring(found, F.lit(1), F.length(found) - F.least(surplus, tail))), F.lit(""))

    def of(v: Column) -> Column:
        bad = is_http(v) & (has_credentials(v) | ~host(v).isin(*DOI_HOSTS))
        body = F.when(is_http(v), F.regexp_replace(url_part(v, 3), "^/+", "")).otherwise(v)
        return F.when(~bad, bind(F.regexp_replace(F.regexp_extract(body, DOI, 0), "[.,;]+$", ""), unbracketed))

    return bind(unquoted(strip(c)), of)


def is_arxiv_id(c: Column) -> Column:
    return c.rlike(ARXIV)


def arxiv_of_url(c: Column) -> Column:
    """The arXiv id of an abstract or PDF address of the archive, else null."""
    path = F.regexp_replace(url_part(c, 3), "^/+|/+$", "")
    found = F.when(path.rlike("^(?:abs|pdf)/"), F.regexp_replace(F.substring(path, F.lit(5), F.length(path)), r"\.pdf$", ""))
    return F.when(host(c).isin(*ARXIV_HOSTS) & is_arxiv_id(found), found)


def canonical_url(c: Column) -> Column:
    """http(s) address with scheme and authority in lower case and no fragment; null for others and for credentials."""
    u = strip(c)
    ok = is_http(u) & (host(u) != "") & ~has_credentials(u)
    return F.when(ok, F.concat(F.lower(url_part(u, 1)), F.lit("://"), F.lower(url_part(u, 2)), url_part(u, 3), F.when(url_part(u, 4) == "?", "").otherwise(url_part(u, 4))))


def source_kind(c: Column) -> Column:
    """struct(source_type, canonical_id) of a source string; the first rule that applies wins.

    A blank string is ``empty``. Strings that begin like a path (drive, root, ``./``, ``../``, ``~/``) are local, and so is the name of a
    PDF file that is nothing else; whether the file exists shows when it's read. A citation's identity needs a registry, so it has no canonical id here.
    """
    made = lambda kind, ident: F.struct(F.lit(kind).alias("source_type"), ident.cast("string").alias("canonical_id"))

    def of(x: Column) -> Column:
        s, bare, doi, url_id, url = (x[k] for k in ("s", "bare", "doi", "url_id", "url"))
        return (
            F.when(F.coalesce(s, F.lit("")) == "", made("empty", F.lit(None)))
            .when(s.rlike(LOCAL), made("local_pdf", F.concat(F.lit("local:"), s)))
            .when(is_arxiv_id(bare), made("arxiv", F.concat(F.lit("arxiv:"), bare)))
            .when(doi.isNotNull(), made("reference", F.concat(F.lit("doi:"), doi)))
            .when(is_http(s) & url_id.isNotNull(), made("arxiv", F.concat(F.lit("arxiv:"), url_id)))
            .when(is_http(s) & F.endswith(F.lower(url_part(s, 3)), F.lit(".pdf")), made("pdf_url", F.concat(F.lit("url:"), s)))
            .when(is_http(s) & url.isNotNull(), made("html_url", F.concat(F.lit("url:"), url)))
            .when(is_http(s), made("blocked", F.lit(None)))
            .when(s.rlike(LOCAL_FILE), made("local_pdf", F.concat(F.lit("local:"), s)))
            .when((F.size(F.split(s, r"\s+")) >= 3) & ~s.rlike(r"^[/\\]"), made("citation", F.lit(None)))
            .otherwise(made("unsupported", F.lit(None)))
        )

    parts = lambda s: F.struct(s.alias("s"), F.regexp_replace(s, r"(?i)^arxiv:\s*", "").alias("bare"), normalize_doi(s).alias("doi"), arxiv_of_url(s).alias("url_id"), canonical_url(s).alias("url"))
    return bind(bind(strip(c), parts), of)


def safe_filename(c: Column) -> Column:
    """The last part of a path with either kind of separator, without white space around the path; null if that isn't a name
    (nothing, ``.`` or ``..``). Nothing in it can lead out of a folder."""
    name = F.regexp_extract(F.translate(strip(c), "\\", "/"), r"([^/]*)$", 1)
    return F.when(~name.isin("", ".", ".."), name)


# IPv4 blocks that aren't globally reachable (first address, prefix length), and exceptions in them.
PRIVATE_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4)]
PUBLIC_V4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]


def ipv4_number(c: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    part = [F.regexp_extract(c, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("long") for k in range(1, 5)]
    ok = part[0].between(0, 255) & part[1].between(0, 255) & part[2].between(0, 255) & part[3].between(0, 255)
    return F.when(ok, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def _inside(n: Column, blocks: list[tuple[str, int]]) -> Column:
    out = F.lit(False)
    for first, bits in blocks:
        lo = 0
        for p in first.split("."):
            lo = lo * 256 + int(p)
        out = out | n.between(lo, lo + (1 << (32 - bits)) - 1)
    return out


# IPv6 blocks that aren't globally reachable, and exceptions in them.
PRIVATE_V6 = ["::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10"]
PUBLIC_V6 = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


def ipv4_of_numbers(c: Column) -> Column:
    """The address that a host of one to four numbers stands for, in any base resolvers take (decimal, 0x, leading 0), the last
    one filling what is left; -1 if they are too large, null if the host isn't made of numbers."""
    parts = F.split(c, r"\.")
    n = F.size(parts)
    value = lambda p: F.coalesce(F.when(p.rlike("^0x"), F.conv(F.substring(p, F.lit(3), F.lit(64)), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p).try_cast("decimal(38,0)"), F.lit(-1))
    given = F.transform(parts, value)
    room = F.transform(given, lambda x, i: F.when(i == n - 1, F.pow(F.lit(256), 5 - n)).otherwise(F.lit(256)))
    fits = F.forall(F.arrays_zip(given.alias("v"), room.alias("r")), lambda z: (z["v"] >= 0) & (z["v"] < z["r"]))
    total = F.aggregate(F.transform(given, lambda x, i: F.when(i == n - 1, x.cast("double")).otherwise(x.cast("double") * F.pow(F.lit(256), 3 - i))), F.lit(0.0), lambda a, x: a + x)
    return F.when(c.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+))*$"), F.when((n <= 4) & fits, total.cast("long")).otherwise(-1))


def ipv6_digits(c: Column) -> Column:
    """The 32 hex digits of an IPv6 address (without brackets, in lower case); null if it isn't one."""
    body = F.regexp_replace(c, "%.*$", "")
    tail = F.regexp_extract(body, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    n = ipv4_number(tail)
    hexed = F.concat(F.lower(F.hex((n / 65536).cast("long"))), F.lit(":"), F.lower(F.hex(n % 65536)))
    body = F.when(tail == "", body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - F.length(tail)), hexed))

    def digits(b: Column) -> Column:
        halves = F.split(b, "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        left, right = groups(0), groups(1)
        gap = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
        every = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), gap), right)).when(F.size(halves) == 1, left)
        well = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~b.rlike(r"(^|[^:]):$|^:[^:]|:::")
        return F.when(well, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return bind(body, digits)


def _inside_v6(digits: Column, blocks: list[str]) -> Column:
    out = F.lit(False)
    for block in blocks:
        net = ipaddress.IPv6Network(block)
        out = out | digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return out


def is_public_url(c: Column) -> Column:
    """False for addresses that aren't http(s), have no host, or name this machine or a non-global address: IPv4 in any of the
    forms resolvers take, IPv6 (also one that maps IPv4). What looks like an address and isn't a valid one is
    refused. Names are resolved at acquisition, outside the engine, where ``is_public_host`` serves again."""
    return F.coalesce(is_http(c) & is_public_host(host(c)), F.lit(False))


def is_public_host(h: Column) -> Column:
    """``is_public_url`` for a host alone, in lower case."""

    def of(x: Column) -> Column:
        open4 = lambda n: (n >= 0) & (~_inside(n, PRIVATE_V4) | _inside(n, PUBLIC_V4))
        mapped = F.startswith(x["v6"], F.lit("0" * 20 + "ffff"))
        open6 = F.when(mapped, open4(F.conv(F.substring(x["v6"], 25, 8), 16, 10).cast("long"))).otherwise(~_inside_v6(x["v6"], PRIVATE_V6) | _inside_v6(x["v6"], PUBLIC_V6))
        local = x["name"].isin("", "localhost", "localhost.localdomain") | F.endswith(x["name"], F.lit(".localhost"))
        return F.when(F.contains(x["name"], F.lit(":")) | x["name"].rlike(r"[\[\]]"), F.coalesce(open6, F.lit(False))).when(x["v4"].isNotNull(), open4(x["v4"])).otherwise(~local)

    name = F.regexp_replace(h, r"\.$", "")
    return bind(bind(name, lambda n: F.struct(n.alias("name"), ipv4_of_numbers(n).alias("v4"), ipv6_digits(F.regexp_extract(n, r"^\[([^\[\]]*)\]$", 1)).alias("v6"))), of)
