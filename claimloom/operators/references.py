"""Reference identity: registry records, field checks, resolution against a registry table."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from claimloom.functions.identifiers import has_credentials, normalize_doi
from claimloom.functions.text import comparable, compared, strip
from claimloom.operators.nested import as_list, parse_records
from claimloom.session import cut

#: A registry record: doi, title, authors, years, publisher, container_title, url, full_text_urls, registry.
RECORD = ["doi", "title", "authors", "years", "publisher", "container_title", "url", "full_text_urls", "registry"]
#: Addresses tried per work.
ADDRESSES = 6
DATE_FIELDS = ("published", "published-print", "published-online", "issued")


def _v(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def _plain(v: Column) -> Column:
    """The text of a value that is text; an object isn't (its cast would be its JSON)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _joined(v: Column) -> Column:
    """Text of a field that is a string or a list of strings."""
    return F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), " "), F.try_variant_get(v, "$", "string"))


def registry_records(rows: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, *RECORD) from stored registry answers, both dialects; unreadable payloads are left out."""
    r = parse_records(parse_records(rows, payload, "message", "_a"), payload, "data", "_b")
    attributes = _v(F.col("_b"), "attributes")
    a = r.where(F.startswith(F.schema_of_variant("_a"), F.lit("OBJECT"))).select(key, F.col("_a").alias("w"), attributes.alias("d"), F.col("registry"))
    w, d = F.col("w"), F.col("d")
    person = lambda x: F.coalesce(
        F.nullif(F.array_join(F.filter(F.array(_v(x, "given", "string"), _v(x, "family", "string")), lambda p: F.coalesce(p, F.lit("")) != ""), " "), F.lit("")),
        _v(x, "name", "string"), _plain(x))
    creator = lambda x: F.coalesce(_v(x, "name", "string"), F.nullif(F.array_join(F.filter(F.array(_v(x, "givenName", "string"), _v(x, "familyName", "string")), lambda p: p.isNotNull()), " "), F.lit("")))
    real = lambda xs, f: F.filter(F.transform(F.filter(xs, lambda x: x.isNotNull() & ~F.is_variant_null(x)), f), lambda s: F.coalesce(s, F.lit("")) != "")
    year = lambda x: F.coalesce(F.try_variant_get(x, "$[0]", "string"), F.try_variant_get(x, "$", "string"))
    none = F.array().cast("array<string>")
    dates = F.concat(*[F.coalesce(F.transform(as_list(_v(w, f"{f}.date-parts")), year), none) for f in DATE_FIELDS])
    years = F.array_sort(F.array_distinct(F.filter(dates, lambda y: F.coalesce(y, F.lit("")).rlike("^[0-9]{4}$"))))
    links = F.coalesce(real(as_list(_v(w, "link")), lambda x: F.coalesce(_v(x, "URL", "string"), _plain(x))), none)
    crossref = F.struct(
        F.lower(F.coalesce(_v(w, "DOI", "string"), F.lit(""))).alias("doi"), F.coalesce(_joined(_v(w, "title")), F.lit("")).alias("title"),
        F.coalesce(real(as_list(_v(w, "author")), person), none).alias("authors"), years.alias("years"), F.coalesce(_v(w, "publisher", "string"), F.lit("")).alias("publisher"),
        F.coalesce(_joined(_v(w, "container-title")), F.lit("")).alias("container_title"), F.coalesce(_v(w, "resource.primary.URL", "string"), _v(w, "URL", "string")).alias("url"), links.alias("full_text_urls"))
    datacite = F.struct(
        F.lower(F.coalesce(_v(d, "doi", "string"), F.lit(""))).alias("doi"), F.coalesce(F.array_join(F.transform(as_list(_v(d, "titles")), lambda t: _v(t, "title", "string")), " "), F.lit("")).alias("title"),
        F.coalesce(real(as_list(_v(d, "creators")), creator), none).alias("authors"), F.filter(F.array(_v(d, "publicationYear", "string")), lambda y: y.isNotNull()).alias("years"), F.coalesce(_v(d, "publisher", "string"), F.lit("")).alias("publisher"),
        F.lit("").alias("container_title"), _v(d, "url", "string").alias("url"), none.alias("full_text_urls"))
    out = a.select(key, F.when(d.isNotNull() & ~F.is_variant_null(d), datacite).otherwise(crossref).alias("r"), "registry")
    return out.select(key, "r.*", "registry")


def registry_table(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One record per DOI, the last stored; records without DOI or title can't identify a work."""
    ok = records.where((F.col("doi") != "") & (F.col("title") != ""))
    cols = [c for c in RECORD if c != "doi"]
    return ok.groupBy("doi").agg(F.max_by(F.struct(*cols), F.col(key)).alias("r")).select("doi", "r.*")


def author_match(df: DataFrame, given: str, registered: str, out: str = "is_match") -> DataFrame:
    """``df`` with ``out``: the registered family name occurs in the given name, whose other parts are names or initials of the
    registered one. A null or blank side matches nothing."""
    d = _with_names(_with_names(df.withColumn("_g", F.array(F.coalesce(F.col(given), F.lit("")))).withColumn("authors", F.array(F.coalesce(F.col(registered), F.lit("")))), "_g", "_a"), "authors", "_b")
    none = F.array().cast("array<string>")
    return d.withColumn(out, _names_match(F.coalesce(F.get("_a", F.lit(0)), none), F.coalesce(F.get("_b", F.lit(0)), none))).drop("_g", "_a", "_b", "authors")


def _names_match(a: Column, b: Column) -> Column:
    family = F.get(b, F.size(b) - 1)
    personal = F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0)))
    fits = lambda t: F.exists(personal, lambda x: (x == t) | ((F.length(t) == 1) & F.startswith(x, t)))
    ok = (F.size(a) > 0) & (F.size(b) > 0) & F.array_contains(a, family) & F.forall(F.filter(a, lambda t: t != family), fits)
    return F.coalesce(ok, F.lit(False))


def _with_names(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: name parts of each author. Names are brought to comparable form as one string, in one pass of the UDF."""
    turned = F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: F.when(F.contains(r, F.lit(",")), F.concat(F.regexp_extract(r, r"^[^,]*,([\s\S]*)$", 1), F.lit(" "), F.regexp_extract(r, r"^([^,]*),", 1))).otherwise(r))
    kind = turned if column == "authors" else F.coalesce(F.col(column), F.array().cast("array<string>"))
    one = comparable(F.array_join(F.transform(kind, lambda n: F.translate(n, "\n", " ")), "\n"))
    return df.withColumn(out, F.transform(F.filter(F.split(one, "\n"), lambda n: n != ""), lambda n: F.regexp_extract_all(n, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def prepared(registry: DataFrame) -> DataFrame:
    """``registry_table`` with the comparable forms that checks use."""
    r = _with_names(registry, "authors", "r_names")
    return r.select(*[F.col(c).alias(f"r_{c}") for c in registry.columns], "r_names", compared(F.col("title")).alias("r_title_c"), compared(F.col("publisher")).alias("r_publisher_c"), compared(F.col("container_title")).alias("r_container_title_c"))


def reference_violation(refs: DataFrame) -> Column:
    """Why a reference is refused (null: it isn't). Columns: doi, title, authors, year, publisher, container_title, citation; a
    null field is not given."""
    texts = ["doi", "title", "publisher", "container_title", "citation"]
    blank = [F.when(strip(F.col(t)) == "", f"{t} must be a nonempty string.") for t in texts]
    total = sum((F.coalesce(F.length(F.col(t)), F.lit(0)) for t in texts), F.lit(0))
    return F.coalesce(
        *blank,
        F.when((F.size("authors") == 0) | F.exists("authors", lambda a: F.coalesce(strip(a), F.lit("")) == ""), "authors must be a nonempty list of names."),
        F.when(~F.col("year").rlike("^[0-9]{4}$"), "year must be a four-digit year."),
        *[F.when(has_credentials(strip(F.col(t))), "reference URLs must not contain embedded credentials.") for t in ("doi", "citation")],
        F.when((total > 8000) | (F.col("doi").isNull() & F.col("title").isNull() & F.col("citation").isNull()), "Supply doi, title or citation, within 8000 characters."),
        F.when(F.col("doi").isNotNull() & normalize_doi(F.col("doi")).isNull(), "Invalid DOI syntax."),
    )


def _checks() -> Column:
    """map(field -> MATCH, MISMATCH or UNKNOWN) of the fields that the reference gives."""
    one = lambda given, unknown, same: F.when(given, F.when(unknown, "UNKNOWN").when(same, "MATCH").otherwise("MISMATCH"))
    given = lambda c: F.col(c).isNotNull()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    every = F.forall("g_names", lambda g: F.exists("r_names", lambda r: _names_match(g, r)))
    pairs = [
        ("title", one(given("title"), empty("r_title"), F.col("title_c") == F.col("r_title_c"))),
        ("year", one(given("year"), F.size("r_years") == 0, F.array_contains("r_years", F.col("year")))),
        ("publisher", one(given("publisher"), empty("r_publisher"), F.col("publisher_c") == F.col("r_publisher_c"))),
        ("container_title", one(given("container_title"), empty("r_container_title"), F.col("container_title_c") == F.col("r_container_title_c"))),
        ("authors", one(given("authors"), F.size("r_authors") == 0, every)),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def _raw_match() -> Column:
    """The citation holds the record's title, agrees on a year if it has any, and names an author unless it's the bare title."""
    years = F.regexp_extract_all("citation", F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))
    words = F.split("citation_c", " ")
    surname = F.exists("r_names", lambda n: F.array_contains(words, F.get(n, F.size(n) - 1)))
    return F.coalesce((F.col("r_title_c") != "") & F.contains("citation_c", "r_title_c") & ((F.size(years) == 0) | F.arrays_overlap(years, "r_years")) & ((F.col("citation_c") == F.col("r_title_c")) | surname), F.lit(False))


def resolve(refs: DataFrame, registry: DataFrame, key: str = "ref_id") -> DataFrame:
    """Identity of each reference against ``registry_table``: (key, doi, verdict, status, n_matches, checks).

    refs: key, doi, title, authors array, year string, publisher, container_title, citation (null: not given). With a DOI the record of
    that DOI is meant. Without one, a structured title must equal a record's title; a citation must contain it. Records
    are looked up by equality (DOI; title in comparable form); a citation's candidates are records of whose title it has the
    rarest word, so no reference meets the whole registry. Refused input has status INVALID_INPUT.
    """
    r = refs.withColumn("violation", reference_violation(refs)).withColumn("q_doi", normalize_doi(F.coalesce("doi", "citation")))
    r = _with_names(r.withColumnRenamed("authors", "authors_given"), "authors_given", "g_names").withColumnRenamed("authors_given", "authors")
    for c in ("title", "publisher", "container_title", "citation"):
        r = r.withColumn(f"{c}_c", compared(F.col(c)))
    # Both sides are read by three lookups: their Python-made forms are computed once.
    r, p = cut(r), cut(prepared(registry))
    valid = r.where("violation is null")
    by_doi = valid.where("q_doi is not null").join(p, F.col("q_doi") == F.col("r_doi"), "left").withColumn("matched", F.col("r_doi").isNotNull())
    by_title = valid.where("q_doi is null and title is not null").join(p, F.col("title_c") == F.col("r_title_c"), "left").withColumn("matched", F.col("r_doi").isNotNull())
    cites = valid.where("q_doi is null and title is null")
    probes = cites.select(key, F.explode(_words("citation_c")).alias("probe"))
    pairs = probes.join(rarest_words(p.where("r_title_c <> ''"), "r_doi", "r_title_c"), "probe").select(key, "r_doi")
    found = cites.join(pairs, key).join(p, "r_doi").where(_raw_match())
    by_text = cites.join(found.select(key, *p.columns), key, "left").withColumn("matched", F.col("r_doi").isNotNull())
    cols = [key, "q_doi", "doi", "title", "authors", "year", "publisher", "container_title", "citation", "title_c", "publisher_c", "container_title_c", "citation_c", "g_names", *p.columns, "matched"]
    cand = by_doi.select(*cols).unionByName(by_title.select(*cols)).unionByName(by_text.select(*cols))
    cand = cand.withColumn("checks", F.when(F.col("matched"), _checks())).withColumn("clean", F.col("matched") & ~F.array_contains(F.map_values("checks"), "MISMATCH"))
    chosen = F.struct("r_doi", "checks", "citation", "raw_ok")
    cand = cand.withColumn("raw_ok", F.col("matched") & F.col("citation").isNotNull() & _raw_match())
    g = cand.groupBy(key, "q_doi").agg(
        F.count_if("matched").alias("n"), F.count_if("clean").alias("n_clean"),
        F.min_by(F.when(F.col("matched"), chosen), F.when(F.col("matched"), F.col("r_doi"))).alias("any"),
        F.min_by(F.when(F.col("clean"), chosen), F.when(F.col("clean"), F.col("r_doi"))).alias("only"))
    sole = F.when((F.col("n") > 1) & (F.col("n_clean") == 1), F.col("only")).when(F.col("n") == 1, F.col("any"))
    g = g.withColumn("s", sole)
    bare = F.rtrim(F.regexp_replace(F.lower(strip(F.col("s.citation"))), r"^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)", ""))
    bare = F.regexp_replace(bare, "[.,;]+$", "")
    own = normalize_doi(F.col("s.citation"))
    extra = F.filter(
        F.array(
            F.struct(F.lit("doi").alias("key"), F.when(F.col("q_doi").isNotNull() & own.isNotNull() & (own != F.col("q_doi")), "MISMATCH").alias("value")),
            F.struct(F.lit("citation").alias("key"), F.when(F.col("q_doi").isNotNull() & own.isNotNull() & (bare != F.col("q_doi")), F.when(F.col("s.raw_ok"), "MATCH").otherwise("UNKNOWN")).alias("value")),
        ), lambda e: e["value"].isNotNull())
    g = g.withColumn("checks", F.when(F.col("s").isNotNull(), F.map_concat("s.checks", F.map_from_entries(extra))))
    values = F.map_values("checks")
    status = (
        F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("s").isNull(), F.lit("AMBIGUOUS"))
        .when(F.array_contains(values, "MISMATCH"), "METADATA_MISMATCH").when(F.array_contains(values, "UNKNOWN"), "PARTIALLY_VERIFIED").otherwise("VERIFIED")
    )
    out = r.select(key, "violation").join(g.select(key, F.col("s.r_doi").alias("doi"), status.alias("status"), F.col("n").alias("n_matches"), "checks"), key, "left")
    st = F.when(F.col("violation").isNotNull(), "INVALID_INPUT").otherwise(F.coalesce("status", F.lit("NOT_FOUND")))
    verdict = F.when(st == "VERIFIED", "PASS").when(st.isin("METADATA_MISMATCH", "PARTIALLY_VERIFIED"), "WARN").when(st != "INVALID_INPUT", "ABSTAIN")
    return out.select(key, "doi", verdict.alias("verdict"), st.alias("status"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "checks")


def _words(c: str) -> Column:
    return F.array_distinct(F.split(F.col(c), " "))


def rarest_words(titles: DataFrame, key: str, c: str) -> DataFrame:
    """(key, probe): the word of each title that the fewest titles hold. A text that contains a title contains this word, and few
    titles share it, however common the title's other words are."""
    words = titles.select(key, F.explode(_words(c)).alias("word"))
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.join(n, "word").groupBy(key).agg(F.min_by("word", F.struct("n", "word")).alias("probe"))


def gated(resolved: DataFrame, verdicts: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, status, claim_verdict, claim_reason): a claim counts only if its reference is VERIFIED."""
    j = resolved.join(verdicts, key, "left")
    ok = F.col("status") == "VERIFIED"
    return j.select(key, "status", F.when(ok, F.col("claim_verdict")).otherwise("ABSTAIN").alias("claim_verdict"), F.when(ok, F.col("claim_reason")).otherwise("REFERENCE_UNVERIFIED").alias("claim_reason"))


def candidate_urls(full_text: Column, url: Column, doi: Column) -> Column:
    """Addresses to try for a work, in order, without repeats, at most ADDRESSES."""
    every = F.concat(F.coalesce(full_text, F.array().cast("array<string>")), F.array(url, F.concat(F.lit("https://doi.org/"), doi)))
    return F.slice(F.array_distinct(F.filter(every, lambda u: u.isNotNull())), 1, ADDRESSES)


@pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two titles in comparable form (matching blocks, not edit distance); 0 without an actual title."""
    return pd.Series([SequenceMatcher(None, x or "", y).ratio() if y else 0.0 for x, y in zip(a, b)])


def identity_in_text(doi: Column, title: Column, text: Column) -> Column:
    """The opening 4,000 characters hold the DOI or the title: a bibliography further on proves nothing."""
    opening = F.substring(text, 1, 4000)
    return F.contains(F.lower(opening), F.lower(doi)) | F.contains(compared(opening), compared(title))

