"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, language, licenses, lines, lm, near, packing, pivots, quality, resampling, suffixes, token_counts, whitening

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_language_id": language.query,
    "op3_decontamination": decontaminate.query,
    "op4_token_counts": token_counts.query,
    "op5_line_dedup": lines.query,
    "op6_packing": packing.query,
    "op7_quality_rules": quality.query,
    "op8_suffix_dedup": suffixes.query,
    "op9_lm_scoring": lm.query,
    "op10_jaccard_join": near.query,
    "op11_whitening": whitening.query,
    "op12_embedding_dedup": pivots.query,
    "op13_resampling": resampling.query,
}
#: Of operators whose own columns SQL can't give: those columns that it can.
QUERIES |= {
    "llm_license_places": lambda spark, path: licenses.query(spark, path).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "llm_text_bytes": lambda spark, path: token_counts.query(spark, path).select("doc_id", "n_bytes"),
    "llm_quality_counts": lambda spark, path: quality.query(spark, path).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "llm_deviations": lambda spark, path: whitening.query(spark, path).where("component = 1").select("vec_id", "n", "deviation"),
}
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE: dict[str, str] = {
    "op3_decontamination": decontaminate.SQL,
    "op5_line_dedup": lines.SQL,
    "op12_embedding_dedup": pivots.SQL,
    "op13_resampling": resampling.SQL,
    "llm_deviations": whitening.DEVIATION_SQL,
    "llm_license_places": f"""
WITH d AS (SELECT doc_id, {decontaminate._WORDS} AS w FROM documents),
v AS (SELECT * FROM (VALUES {", ".join(f"('{phrase}', {len(phrase.split())}, '{label}')" for phrase, label in licenses.BASE.items())}) v(phrase, n, label)),
m AS (SELECT doc_id, i - 1 AS p, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), v WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)""",
    "llm_text_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents",
    "llm_quality_counts": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACED} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM x JOIN (SELECT doc_id, win FROM x GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS lines FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < {quality.MIN_WORDS} OR 100 * coalesce(n, 0) > {quality.REPEAT_PERCENT} * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)""",
}
