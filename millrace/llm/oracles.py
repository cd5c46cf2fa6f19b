"""DuckDB SQL for the queries of this folder that SQL can express on whole tables."""

from __future__ import annotations

from millrace.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS


def _quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words.split()}))
    rules = []
    for r in RULES:
        per = "1.0" if r.per is None else f"greatest({r.per}, 1)::DOUBLE"
        rules += [f"{r.top}::DOUBLE >= {r.low!r}::DOUBLE * {per}"] * (r.low is not None) + [f"{r.top}::DOUBLE <= {r.high!r}::DOUBLE * {per}"] * (r.high is not None)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) > 3)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (SELECT s.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^!?|]', '', 'g')) AS n_marks,
        len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
        length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals
      FROM s LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": _quality_rules()}
