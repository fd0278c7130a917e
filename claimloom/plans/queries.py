"""Registered queries of the core; each takes (spark, folder of tables) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimloom.functions import identifiers as I, text as T
from claimloom.operators import batch, chunking, html, nested, policy, provenance, references, retrieval, store
from claimloom.session import cut, table
from claimloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Ids of replaced chunks that are sent to all tasks at most.
BROADCAST = 2_000_000


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _long(c: str):
    return F.col(c).cast("long").alias(c)


# -- nested records ---------------------------------------------------------------------------------------------------


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.work_rows(table(spark, d, "registry_records"))


@query
def p2_authors(spark: SparkSession, d: str) -> DataFrame:
    t = nested.work_tables(table(spark, d, "registry_records"))["author"]
    return t.select("record_id", "path", "ordinal", "given", "family", "name", "orcid")


@query
def p2_dates(spark: SparkSession, d: str) -> DataFrame:
    return nested.work_tables(table(spark, d, "registry_records"))["published"].select("record_id", "path", "year", "month", "day")


@query
def p2_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every list that the records hold."""
    return nested.list_rows(table(spark, d, "registry_records"))


@query
def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    r = nested.parse_records(table(spark, d, "registry_records").select("record_id", "payload"), "payload")
    return nested.merged_schema(r)


# -- text ------------------------------------------------------------------------------------------------------------


@query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "extracted_pages").select("page_id", T.normalize_text(F.col("text")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), T.text_hash(F.col("t")).alias("text_hash"))


@query
def normalize_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "chunks").select("id", T.normalize_text(F.col("text")).alias("t"))
    return t.select("id", F.length("t").alias("n_chars"), T.text_hash(F.col("t")).alias("text_hash"))


@query
def bm25_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_hash"))


@query
def content_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where("claim_text is not null").select("id", F.array_join(F.array_sort(T.content_stems(F.col("claim_text"))), " ").alias("stems"))


@query
def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where("claim_text is not null").select("id", F.array_join(T.numbers(F.col("claim_text")), " ").alias("numbers"))


def _claim_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims").select(F.col("id").alias("claim_id"), "claim_text")
    return table(spark, d, "evidence_candidates").join(c, "claim_id")


@query
def claim_coverage(spark: SparkSession, d: str) -> DataFrame:
    stems = lambda c: T.content_stems(F.coalesce(c, F.lit("")))
    c = table(spark, d, "claims").select(F.col("id").alias("claim_id"), stems("claim_text").alias("claim_stems"))
    e = table(spark, d, "evidence_candidates").select("candidate_id", "claim_id", stems("quote").alias("quote_stems"))
    pairs = e.join(c, "claim_id").select("candidate_id", T.coverage(F.col("claim_stems"), F.col("quote_stems")).alias("c"))
    return pairs.select("candidate_id", F.round("c", 6).alias("coverage"), (F.col("c") >= batch.RELEVANT).alias("relevant"))


@query
def numeric_guard(spark: SparkSession, d: str) -> DataFrame:
    num = lambda c: T.numbers(F.coalesce(F.col(c), F.lit("")))
    return _claim_pairs(spark, d).select("candidate_id", F.size(num("claim_text")).alias("n_numbers"), T.numbers_match(num("claim_text"), num("quote")).alias("numbers_match"))


@query
def label_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence_candidates").groupBy(T.label(F.col("predicted_label")).alias("label")).agg(F.count("*").alias("n"))


# -- chunks, windows, pages ----------------------------------------------------------------------------------------


@query
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return c.select("doc_id", "chunk_index", "start_char", "end_char", T.text_hash(F.col("chunk_text")).alias("text_hash"))


@query
def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.windows(table(spark, d, "chunks"))
    return w.select("id", "window_index", "start_char", "end_char", T.text_hash(F.col("quote")).alias("quote_hash"))


@query
def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_checks(table(spark, d, "chunks"))


@query
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    return chunking.assemble_pages(table(spark, d, "extracted_pages")).select("paper_id", "page_number", "start_char", "end_char")


@query
def page_range(spark: SparkSession, d: str) -> DataFrame:
    return chunking.page_range(table(spark, d, "chunks"), chunking.assemble_pages(table(spark, d, "extracted_pages")))


@query
def page_sidecar(spark: SparkSession, d: str) -> DataFrame:
    return store.page_sidecar(table(spark, d, "extracted_pages").where("paper_id is not null"))


# -- retrieval -------------------------------------------------------------------------------------------------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """The current chunks of each paper: of one delivered again, the last."""
    c = table(spark, d, "chunks").where("id is not null")
    last = c.groupBy("paper_id", "content_hash", "chunk_index").agg(F.max("id").alias("id")).select("id")
    # Those that were replaced are few, so their ids go to the texts; beyond BROADCAST they meet in a shuffle.
    replaced = cut(c.select("id").join(last, "id", "left_anti"), tidy=True)
    replaced = F.broadcast(replaced) if replaced.count() <= BROADCAST else replaced
    return c.join(replaced, "id", "left_anti").select(F.col("paper_id").alias("source_id"), F.col("id").alias("chunk_id"), "chunk_index", "start_char", "text")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (claim, paper) pairs that have evidence candidates."""
    return _claim_pairs(spark, d).select("claim_id", F.col("paper_id").alias("source_id"), F.col("claim_text").alias("claim")).where("claim is not null and source_id is not null").distinct()


@query
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.term_stats(retrieval.postings(_corpus(spark, d)))


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).select(F.col("claim_id").alias("query_id"), "source_id", F.col("claim").alias("query_text"))
    r = retrieval.top_k(pairs, _corpus(spark, d))
    return r.select("query_id", "source_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "overlap", F.round("overlap_ratio", 6).alias("overlap_ratio"))


@query
def searchable_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.searchable_counts(_corpus(spark, d))


@query
def claim_verification(spark: SparkSession, d: str) -> DataFrame:
    return batch.verify(_pairs(spark, d), _corpus(spark, d)).drop("candidate_id")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Every claim put to the first paper of its evidence; some papers couldn't be had."""
    first = table(spark, d, "evidence_candidates").groupBy("claim_id").agg(F.min("paper_id").alias("paper_id"))
    c = table(spark, d, "claims").join(first, F.col("id") == F.col("claim_id"), "left")
    items = c.select(F.col("id").alias("index"), F.col("claim_text").alias("claim"), F.concat(F.lit("paper "), F.col("paper_id")).alias("source"))
    error = F.when(F.col("id") % 11 == 5, "PDFEncryptedError").when(F.col("id") % 11 == 7, "TimeoutError")
    sources = table(spark, d, "papers").where("id % 13 <> 6").select(F.concat(F.lit("paper "), F.col("id")).alias("source"), F.col("id").alias("source_id"), error.alias("error"))
    return batch.verify_claims(items, sources, _corpus(spark, d))


@query
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    return r.select("index", "ok", F.md5(F.coalesce("claim", F.lit("-")).cast("binary")).alias("claim_md5"), "source", "source_state", "verdict", "semantic_class", "reason", "error_type")


@query
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return batch.summary(_results(spark, d))


# -- provenance ------------------------------------------------------------------------------------------------------


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with the whole text of its chunk. A quarter of the quotes are stored ones (mostly not slices of the chunk), a quarter
    are slices of it, a quarter its first five characters, the rest blank or missing."""
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    k = F.col("candidate_id") % 8
    slice_ = F.substring("text", F.least(F.col("candidate_id") % 900, F.length("text") - 1).cast("int") + 1, F.lit(40))
    quote = F.when(k < 2, F.col("quote")).when(k < 4, slice_).when(k < 6, F.substring("text", 1, 5)).when(k == 6, F.lit("  "))
    return table(spark, d, "evidence_candidates").select("candidate_id", "chunk_id", "quote").join(c, "chunk_id").select("candidate_id", "text", quote.alias("quote"))


@query
def exact_occurrences(spark: SparkSession, d: str) -> DataFrame:
    at = provenance.occurrences(F.col("text"), F.col("quote"))
    return _quotes(spark, d).select("candidate_id", at.alias("at")).select("candidate_id", F.when(F.col("at").isNotNull(), F.size("at")).alias("n"), F.array_max("at").alias("last"))


@query
def exact_quote(spark: SparkSession, d: str) -> DataFrame:
    v = provenance.verify_quote(F.col("text"), F.col("quote")).alias("v")
    return _quotes(spark, d).select("candidate_id", v).select("candidate_id", "v.verified", "v.reason", "v.start_char", "v.end_char", "v.occurrence_count")


@query
def exact_span(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "text", F.col("start_char").alias("from_char"))
    e = table(spark, d, "evidence_candidates").select("candidate_id", "chunk_id", "quote", "start_char", "end_char").join(c, "chunk_id")
    v = provenance.verify_span(F.col("text"), F.col("quote"), F.col("start_char") - F.col("from_char"), F.col("end_char") - F.col("from_char"))
    return e.select("candidate_id", v.alias("v")).select("candidate_id", "v.verified", "v.reason")


# -- scores and verdicts -----------------------------------------------------------------------------------------------


@query
def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_candidates")
    s = policy.softmax(F.col("contradiction"), F.col("entailment"), F.col("neutral"))
    r6 = lambda c: F.round(f"s.{c}", 6).alias(c)
    return e.select("candidate_id", s.alias("s")).where("s is not null").select("candidate_id", r6("contradiction"), r6("entailment"), r6("neutral"), F.col("s.label").alias("label"))


@query
def verdict_policy(spark: SparkSession, d: str) -> DataFrame:
    return policy.decide(table(spark, d, "evidence_candidates"), "claim_id", "paper_id")


@query
def verification_guards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_candidates")
    lab = T.label(F.col("predicted_label"))
    verdict = F.when(lab == "entailment", "pass").when(lab == "contradiction", "FAIL").when(lab == "neutral", "Abstain").otherwise(lab)
    why = policy.verification_violations(verdict, F.col("provenance_verified"), [F.col("entailment"), F.col("contradiction"), F.col("neutral")], F.col("start_char"), F.col("end_char"))
    return e.select("candidate_id", why.alias("violation"))


@query
def response_flat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence_candidates")
    v = policy.decide(e, "claim_id", "paper_id")
    ev = e.select(F.col("candidate_id").alias("selected"), "quote", "start_char", "end_char", "provenance_verified", "bm25_rank")
    return v.join(ev, "selected", "left").select(
        "claim_id", "paper_id", F.lit(True).alias("ok"), F.lit("FULL_TEXT").alias("source_state"), policy.gate(F.col("verdict"), F.col("provenance_verified")).alias("verdict"),
        "semantic_class", "reason", F.col("selected").alias("candidate_id"), "start_char", "end_char", "bm25_rank", F.length("quote").alias("quote_chars"))


# -- batches and reports -------------------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claims").select(F.col("id").alias("index"), F.col("claim_text").alias("claim"))
    s = table(spark, d, "source_documents").select(F.col("source_id").alias("index"), F.col("source_input").alias("source"))
    return c.join(s, "index", "full_outer")


@query
def batch_validate(spark: SparkSession, d: str) -> DataFrame:
    return batch.validate(_items(spark, d)).select("index", "ok", F.md5(F.coalesce("claim", F.lit("-")).cast("binary")).alias("claim_md5"), "source", "reason", "error_type")


@query
def batch_groups(spark: SparkSession, d: str) -> DataFrame:
    return batch.group_sources(batch.validate(_items(spark, d)).where("ok"))


@query
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    v = batch.validate(_items(spark, d)).select(F.col("index").alias("claim_id"), "ok", "source")
    w = policy.decide(table(spark, d, "evidence_candidates"), "claim_id").select("claim_id", "verdict")
    return batch.summary(v.join(w, "claim_id", "left"))


@query
def source_state_map(spark: SparkSession, d: str) -> DataFrame:
    errors = spark.createDataFrame([(e,) for e, _ in batch.SOURCE_STATES] + [("OtherError",)], "error string")
    states = table(spark, d, "source_documents").groupBy("source_state").agg(F.count("*").alias("n"))
    return errors.select("error", batch.source_state(F.col("error")).alias("source_state")).join(F.broadcast(states), "source_state", "left").select("error", "source_state", F.coalesce("n", F.lit(0)).alias("n"))


@query
def report_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    total = lambda n, v: F.concat(F.lit(f'"{n}": '), v)
    body = F.concat_ws(
        ", ", total("total_references_processed", (F.col("id") % 50).cast("string")), total("total_errors_found", F.when(F.col("id") % 5 == 0, "null").otherwise((F.col("id") % 3).cast("string"))),
        F.when(F.col("id") % 2 == 0, total("total_warnings_found", (F.col("id") % 4).cast("string"))), total("total_unverified_refs", F.when(F.col("id") % 3 == 0, "1").otherwise("0")))
    report = F.when(F.col("id") % 11 == 0, "{broken").otherwise(F.concat(F.lit('{"summary": {'), body, F.lit("}}")))
    t = readers.report_totals(p.select("id", report.alias("report")))
    return t.select("id", *batch.report_summary({k: F.col(k) for k in ("references", "errors", "warnings", "unverified", "information")}))


# -- store -------------------------------------------------------------------------------------------------------------


@query
def paper_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    fields = ["doi", "arxiv_id", "title", "authors_json", "year", "venue", "canonical_url", "source_type", "content_hash"]
    return store.upsert(None, p, "canonical_id", fields, ["updated_at", "id"]).select("canonical_id", *fields, "created_at", "updated_at", "n_writes")


@query
def paper_authors(spark: SparkSession, d: str) -> DataFrame:
    a = F.coalesce(F.from_json("authors_json", "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "papers").select("id", F.size(a).alias("n_authors"), F.get(a, F.lit(0)).alias("first_author"))


@query
def claim_dedup(spark: SparkSession, d: str) -> DataFrame:
    return store.claim_dedup(table(spark, d, "claims"))


@query
def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_chunks(table(spark, d, "chunks"))


@query
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return store.content_store(table(spark, d, "source_documents"))


@query
def content_integrity(spark: SparkSession, d: str) -> DataFrame:
    return store.integrity(table(spark, d, "source_documents"), "source_id")


@query
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which no paper has the stored text."""
    p = table(spark, d, "papers").select("normalized_text_path").where("normalized_text_path is not null")
    return table(spark, d, "source_documents").join(p, "normalized_text_path", "left_anti").select("source_id", "normalized_text_path")


@query
def orphan_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of chunks that a later delivery replaced."""
    return store.orphans(table(spark, d, "evidence_candidates"), _corpus(spark, d), "chunk_id", "chunk_id").select("candidate_id", "chunk_id")


@query
def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.counts({n: table(spark, d, n) for n in ("papers", "chunks", "claims", "evidence_candidates")})


# -- sources -------------------------------------------------------------------------------------------------------------


@query
def source_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_documents").select("source_id", I.source_kind(F.col("source_input")).alias("k")).select("source_id", "k.source_type", "k.canonical_id")


@query
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "resources").select("resource_id", I.canonical_url(F.col("url")).alias("canonical_url"), I.host(F.trim("url")).alias("host"))


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "source_documents").select("source_id", F.explode(F.array("raw_path", "normalized_text_path", "source_input")).alias("path"))
    return t.where("path is not null").select("source_id", "path", I.safe_filename(F.col("path")).alias("name")).distinct()


@query
def public_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in all forms, made from the rows' numbers."""
    n = F.col("resource_id")
    h = F.element_at(F.array(
        F.concat(F.lit("[::ffff:10.0.0."), n % 256, F.lit("]")), F.concat(F.lit("[2001:4860::"), F.lower(F.hex(n)), F.lit("]")), F.concat(F.lit("[fe80::"), F.lower(F.hex(n)), F.lit("]")),
        F.concat(F.lit("[fc00::1:"), F.lower(F.hex(n)), F.lit("]")), (n + 2130706433).cast("string"), (n + 134744072).cast("string"), F.concat(F.lit("0x7f"), F.lpad(F.lower(F.hex(n)), 6, "0")), F.lit("localhost."), F.lit("[::1]"), F.lit("[2001:db8::5]")), (n % 10 + 1).cast("int"))
    r = table(spark, d, "resources").select("resource_id", F.concat(F.lit("https://"), h, F.lit(":443/a")).alias("address"))
    return r.select("resource_id", "address", I.is_public_url(F.col("address")).alias("is_public"))


@query
def public_ip(spark: SparkSession, d: str) -> DataFrame:
    octet = lambda m, k: F.pmod(F.col("resource_id") * m, F.lit(k)).cast("string")
    first = F.element_at(F.array(*[F.lit(x) for x in ("10", "100", "127", "169", "172", "192", "198", "203", "8", "240")]), (F.col("resource_id") % 10 + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in ("0", "64", "127", "254", "16", "32", "168", "18", "51", "128")]), (F.floor(F.col("resource_id") / 10) % 10 + 1).cast("int"))
    url = F.concat(F.lit("http://"), first, F.lit("."), second, F.lit("."), octet(7, 256), F.lit("."), octet(13, 256), F.lit(":8080/x"))
    r = table(spark, d, "resources").select("resource_id", url.alias("address"), "url")
    return r.select("resource_id", "address", I.is_public_url(F.col("address")).alias("address_public"), I.is_public_url(F.trim("url")).alias("url_public"))


@query
def normalize_doi(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select(F.lit("papers").alias("tab"), F.col("id").alias("key"), F.col("doi").alias("x"))
    s = table(spark, d, "source_documents").select(F.lit("source_documents"), F.col("source_id"), F.col("source_input"))
    r = table(spark, d, "registry_records").select(F.lit("registry_records"), F.col("record_id"), F.col("doi"))
    return p.union(s).union(r).select("tab", "key", I.normalize_doi(F.col("x")).alias("doi"))


# -- references --------------------------------------------------------------------------------------------------------------


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return references.registry_table(references.registry_records(table(spark, d, "registry_records")))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Papers as references: two thirds of them without their DOI; every third as a citation text."""
    p = table(spark, d, "papers")
    a = F.from_json("authors_json", "array<string>")
    k = F.col("id") % 3
    cite = F.concat_ws(". ", F.array_join(a, ", "), F.col("title"), F.col("venue"), F.col("year").cast("string"))
    text = F.when(k == 2, F.nullif(cite, F.lit("")))
    return p.select(
        F.col("id").alias("ref_id"), F.when(k == 0, T.cleaned(F.col("doi"))).alias("doi"), F.when(k < 2, T.cleaned(F.col("title"))).alias("title"), F.when((k < 2) & (F.size(a) > 0), a).alias("authors"),
        F.when(k < 2, F.col("year").cast("string")).alias("year"), F.lit(None).cast("string").alias("publisher"), F.when(k == 0, T.cleaned(F.col("venue"))).alias("container_title"), text.alias("citation"))


@query
def registry_normalized(spark: SparkSession, d: str) -> DataFrame:
    r = references.registry_records(table(spark, d, "registry_records"))
    return r.select("record_id", "doi", "title", F.array_join("authors", "; ").alias("authors"), F.array_join("years", " ").alias("years"), "publisher", "container_title", F.size("full_text_urls").alias("n_links"))


@query
def author_match(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d).select("doi", F.get("authors", F.lit(0)).alias("registered"))
    p = table(spark, d, "papers").select("id", F.lower("doi").alias("doi"), F.get(F.from_json("authors_json", "array<string>"), F.lit(0)).alias("given"))
    j = p.join(r, "doi").where("given is not null and registered is not null")
    return references.author_match(j.select("id", "given", "registered"), "given", "registered")


@query
def resolve_reference(spark: SparkSession, d: str) -> DataFrame:
    r = references.resolve(_references(spark, d), _registry(spark, d))
    pairs = F.array_sort(F.transform(F.map_entries("checks"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return r.select("ref_id", "doi", "verdict", "status", "n_matches", F.array_join(pairs, " ").alias("checks"))


@query
def reference_claim_gate(spark: SparkSession, d: str) -> DataFrame:
    r = references.resolve(_references(spark, d), _registry(spark, d))
    v = policy.decide(table(spark, d, "evidence_candidates"), "paper_id").select(F.col("paper_id").alias("ref_id"), F.col("verdict").alias("claim_verdict"), F.col("reason").alias("claim_reason"))
    return references.gated(r, v)


@query
def candidate_urls(spark: SparkSession, d: str) -> DataFrame:
    r = references.registry_records(table(spark, d, "registry_records")).where("doi <> ''")
    return r.select("record_id", F.array_join(references.candidate_urls(F.col("full_text_urls"), F.col("url"), F.col("doi")), " ").alias("urls"))


@query
def title_ratio(spark: SparkSession, d: str) -> DataFrame:
    r = _registry(spark, d).select("doi", F.col("title").alias("registered"))
    p = table(spark, d, "papers").select("id", F.lower("doi").alias("doi"), "title").join(r, "doi")
    ratio = references.title_ratio(T.compared(F.col("registered")), T.compared(F.col("title")))
    return p.select("id", F.round(ratio, 6).alias("ratio"), (ratio >= 0.95).alias("title_matches"))


@query
def identity_in_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("title is not null").select(F.col("id").alias("paper_id"), F.coalesce("doi", F.lit("no doi")).alias("doi"), "title")
    s = table(spark, d, "source_documents").where("text is not null").select("source_id", "paper_id", "text").join(p, "paper_id")
    return s.select("source_id", references.identity_in_text(F.col("doi"), F.col("title"), F.col("text")).alias("identified"))


# -- pages of the web --------------------------------------------------------------------------------------------------------


@query
def html_article(spark: SparkSession, d: str) -> DataFrame:
    a = html.articles(table(spark, d, "resources"))
    return a.select("resource_id", "accepted", "reason", "sections", "headings", F.length("text").alias("n_chars"), T.text_hash(F.col("text")).alias("text_hash"))


@query
def html_metadata(spark: SparkSession, d: str) -> DataFrame:
    return html.metadata(table(spark, d, "resources"))
