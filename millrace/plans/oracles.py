"""DuckDB SQL for the catalogue, written by itself: other functions and another plan for the same rows."""

from __future__ import annotations

from millrace.functions.profiles import CORPUS_OTHER, CORPUS_TARGET, CORPUS_WORDS, PAIR_OTHER, PAIR_TARGET, REPORT_OTHER, REPORT_TARGET, TRANSLATED
from millrace.operators.prompts import ANGLES, DOMAINS, TASKS, TEMPLATE
from millrace.plans.inline import BLOCK_LOSSES, CHECKS, CONFIGS, ENDINGS, HISTORY, MADE, PAGES, REPLIES, RUNS, SCORED, SCORED_TEXTS, SOURCES, TOKEN_COUNTS, VOCABULARIES, WINDOWS


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else text(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def listed(words: str) -> str:
    return "(" + ", ".join(text(w) for w in dict.fromkeys(words.split())) + ")"


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"
NL = "chr(10)"
LEX = text(CORPUS_WORDS)


def _clean(column: str) -> str:
    t = f"regexp_replace(replace(replace({column}, chr(13) || {NL}, {NL}), chr(13), {NL}), '[ \\t]+', ' ', 'g')"
    menu = f"(length(trim(l, {WS})) > 120 AND (length(l) - length(replace(l, ' ', ''))) / greatest(length(trim(l, {WS})), 1) < 0.05)"
    return f"trim(regexp_replace(array_to_string(list_filter(string_split({t}, {NL}), lambda l: NOT {menu}), {NL}), '\\n{{3,}}', {NL} || {NL}, 'g'), {WS})"


def _clean_small(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(replace({column}, chr(13) || {NL}, {NL}), chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g'), {WS})"


def _share(words: str, known: str, empty: str = "0.0") -> str:
    return f"CASE WHEN len({words}) = 0 THEN {empty} ELSE len(list_filter({words}, lambda x: x IN {listed(known)})) / len({words}) END"


BASE = f"""
c AS (SELECT doc_id, source, CAST(substr(source, 4) AS INT) AS priority, {_clean("text")} AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), {LEX}) AS words, list_filter(list_transform(string_split(t, {NL}), lambda x: trim(x, {WS})), lambda x: x <> '') AS lines FROM c),
f AS (SELECT *, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / greatest(len(words), 1) AS mean_word, length(regexp_replace(t, '\\P{{L}}', '', 'g')) / greatest(length(t), 1) AS letters,
  CASE WHEN len(lines) = 0 THEN 1.0 ELSE len(list_distinct(lines)) / len(lines) END AS distinct_lines, (length(t) - length(replace(t, '#', '')) + length(t) - length(replace(t, '…', ''))) / greatest(len(words), 1) AS symbols FROM w),
q AS (SELECT *, CASE WHEN length(t) < 200 THEN 'too short' WHEN len(words) < 30 THEN 'too few words' WHEN mean_word < 2 OR mean_word > 12 THEN 'word length' WHEN letters < 0.6 THEN 'not enough letters'
  WHEN distinct_lines < 0.75 THEN 'repeated lines' WHEN symbols > 0.1 THEN 'symbols' END AS reason FROM f)"""

DEDUP = f"""{BASE},
p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY priority, doc_id) = 1 AS first_document FROM q WHERE reason IS NULL),
s AS (SELECT doc_id, priority, CASE WHEN len(lines) > 1 THEN lines ELSE list_filter(list_transform(string_split(regexp_replace(trim(t, {WS}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '') END AS segs,
  CASE WHEN len(lines) > 1 THEN {NL} ELSE ' ' END AS sep FROM p WHERE first_document),
e AS (SELECT doc_id, priority, sep, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM s),
g AS (SELECT *, length(seg) < 60 OR row_number() OVER (PARTITION BY seg ORDER BY priority, doc_id, pos) = 1 AS fresh FROM e),
d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE fresh) AS fresh, coalesce(sum(length(seg)) FILTER (WHERE fresh), 0) AS chars, CASE WHEN max(sep) = {NL} THEN string_agg(seg, {NL} ORDER BY pos) FILTER (WHERE fresh) ELSE string_agg(seg, ' ' ORDER BY pos) FILTER (WHERE fresh) END AS kept FROM g GROUP BY doc_id),
b AS (SELECT q.doc_id, q.source, q.priority, CASE WHEN q.reason IS NOT NULL THEN q.reason WHEN NOT p.first_document OR coalesce(d.chars, 0) < 200 THEN 'duplicate' END AS reason,
  CASE WHEN q.reason IS NOT NULL THEN q.reason WHEN NOT p.first_document THEN 'copy' WHEN coalesce(d.chars, 0) < 200 THEN 'little fresh text' END AS reason_detail,
  q.reason IS NULL AND p.first_document AND coalesce(d.chars, 0) >= 200 AND d.fresh < d.n AS partly_duplicate, d.kept FROM q LEFT JOIN p USING (doc_id) LEFT JOIN d USING (doc_id))"""

NEAR = f"""
sc AS (SELECT doc_id, {_clean_small("text")} AS t FROM documents),
sd AS (SELECT *, CASE WHEN length(t) < 200 THEN 'short' WHEN row_number() OVER (PARTITION BY t, length(t) >= 200 ORDER BY doc_id) > 1 THEN 'copy' END AS outcome FROM sc),
sw AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda x: x <> '') AS w FROM sd WHERE outcome IS NULL),
ss AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 13], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 13), 3)) AS i FROM sw)),
sn AS (SELECT doc_id, count(*) AS n FROM ss GROUP BY doc_id),
sp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM ss x JOIN ss y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
sj AS (SELECT a, b, k / (na.n + nb.n - k) AS jaccard FROM sp JOIN sn na ON na.doc_id = a JOIN sn nb ON nb.doc_id = b)"""


def _resolved(threshold: float) -> str:
    return f"""WITH RECURSIVE {NEAR},
near AS (SELECT a, b FROM sj WHERE jaccard > {threshold}),
todo AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM near GROUP BY b),
walk(i, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT todo.i, CASE WHEN len(list_filter(todo.earlier, lambda x: NOT list_contains(walk.dropped, x))) > 0 THEN list_append(walk.dropped, todo.b) ELSE walk.dropped END FROM walk JOIN todo ON todo.i = walk.i + 1),
gone AS (SELECT unnest(dropped) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM walk)),
done AS (SELECT sd.doc_id, CASE WHEN sd.outcome IS NOT NULL THEN sd.outcome WHEN gone.doc_id IS NOT NULL THEN 'near copy' ELSE 'kept' END AS outcome FROM sd LEFT JOIN gone USING (doc_id))"""


PAIRS = """pr AS (SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _pair_reasons(low: int, high: int, gates: bool) -> str:
    words = "regexp_extract_all(strip_accents(lower(instruction || ' ' || response)), '[a-z'']+')"
    language = f"WHEN {_share('x', PAIR_TARGET)} < 0.15 THEN 'not kreyol enough' WHEN {_share('x', PAIR_OTHER, '1.0')} > 0.05 THEN 'french'" if gates else ""
    return f"""WITH {PAIRS}, v AS (SELECT *, {words} AS x FROM pr)
SELECT coalesce(CASE WHEN length(instruction) NOT BETWEEN 10 AND 2000 THEN 'instruction length' WHEN length(response) NOT BETWEEN {low} AND {high} THEN 'response length'
 WHEN regexp_matches(response, '(?i)^(men yo|here are|voici|d[ak]ò|bien s|sure[,!]|of course)') THEN 'teacher commentary' {language} END, 'kept') AS reason, count(*) AS n FROM v GROUP BY 1"""


GRID = f"""g AS (SELECT d.x AS domain, t.x AS task, a.x AS angle, row_number() OVER (ORDER BY md5(concat_ws('|', '42', d.x, t.x, a.x))) - 1 AS job
 FROM (SELECT unnest([{", ".join(map(text, DOMAINS))}]) AS x) d, (SELECT unnest([{", ".join(map(text, TASKS))}]) AS x) t, (SELECT unnest([{", ".join(map(text, ANGLES))}]) AS x) a)"""

TOKENS = """i AS (SELECT doc_id, CASE WHEN substr(md5(text), 1, 8) < '0ccccccc' THEN 'val' ELSE 'train' END AS split,
  list_append(list_transform(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda x: x <> ''), lambda x: length(x)), 0) AS ids FROM documents)"""


#: Pre-tokens without lookahead: chr(1) has been put before the last white space of each run that something follows.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|(?:\x01 )?\p{L}+|(?:\x01 )?\p{N}+|(?:\x01 )?[^\s\p{L}\p{N}\x01]+|\x01\s|\s+"


def sql() -> dict[str, str]:
    json_pairs = ", ".join(f"({i}, {text(r[r.find('[') : r.rfind(']') + 1])})" for i, r in REPLIES if 0 <= r.find("[") < r.rfind("]"))
    return {
        "clean_lengths": f"SELECT doc_id, length({_clean('text')}) AS n, md5({_clean('text')}) AS digest FROM documents",
        "clean_small_lengths": f"SELECT doc_id, length({_clean_small('text')}) AS n, md5({_clean_small('text')}) AS digest FROM documents",
        "word_stats": f"WITH {BASE} SELECT doc_id, len(words)::BIGINT AS n_words, round(mean_word, 6) AS mean_length FROM f",
        "whitespace_word_stats": "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda x: x <> ''))::BIGINT AS n_words FROM documents",
        "text_features": f"WITH {BASE} SELECT doc_id, round(letters, 6) AS letters, round(distinct_lines, 6) AS distinct_lines, round(symbols, 6) AS symbols FROM f",
        "quality_reasons": f"WITH {BASE} SELECT doc_id, source, reason FROM q",
        "quality_reasons_by_source": f"WITH {BASE} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM q GROUP BY 1, 2",
        "language_rates": f"WITH {BASE} SELECT doc_id, round({_share('words', CORPUS_TARGET)}, 6) AS target, round({_share('words', CORPUS_OTHER)}, 6) AS other FROM w",
        "language_gate": f"""WITH {BASE} SELECT coalesce(reason, CASE WHEN NOT (len(words) >= 20 AND {_share('words', CORPUS_TARGET)} >= 0.06 AND {_share('words', CORPUS_TARGET)} > {_share('words', CORPUS_OTHER)})
          THEN 'not kreyol' END, 'kept') AS reason, count(*) AS n FROM q GROUP BY 1""",
        "mt_disclosure": f"WITH {BASE} SELECT doc_id, regexp_matches(lower(t), {text(TRANSLATED)}) AS says_translated FROM c",
        "doc_dedup": f"WITH {DEDUP} SELECT doc_id, first_document FROM p",
        "segment_counts": f"""WITH {BASE} SELECT doc_id, CASE WHEN len(lines) > 1 THEN len(lines) ELSE len(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {WS})), lambda x: x <> '')) END::BIGINT AS n_segments,
          len(lines) > 1 AS by_line FROM w""",
        "segment_dedup": f"WITH {DEDUP} SELECT doc_id, n, fresh FROM d",
        "segment_reuse_by_source": f"WITH {DEDUP} SELECT priority, count(*) AS n, count(*) FILTER (WHERE NOT fresh) AS repeated FROM g GROUP BY 1",
        "corpus_build": f"WITH {DEDUP} SELECT doc_id, reason, reason_detail, partly_duplicate, CASE WHEN reason IS NULL THEN md5(kept) END AS digest FROM b",
        "corpus_manifest": f"""WITH {DEDUP} SELECT count(*) AS documents, coalesce(sum(length(kept)), 0)::BIGINT AS characters, floor(coalesce(sum(length(kept)), 0) / 3.6)::BIGINT AS estimated_tokens,
          ceil(count(*) / 50000.0)::BIGINT AS shards FROM b WHERE reason IS NULL""",
        "corpus_source_counts": f"""WITH {DEDUP} SELECT source, coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM b GROUP BY 1, 2 UNION ALL SELECT source, 'read', count(*)::BIGINT FROM b GROUP BY 1
          UNION ALL SELECT source, 'chars', coalesce(sum(length(kept)) FILTER (WHERE reason IS NULL), 0)::BIGINT FROM b GROUP BY 1 UNION ALL SELECT source, 'partly duplicate', count(*) FILTER (WHERE partly_duplicate)::BIGINT FROM b GROUP BY 1""",
        "shard_assignment": f"WITH {DEDUP} SELECT doc_id, rank, (rank // 100)::INT AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY priority, doc_id) - 1 AS rank FROM b WHERE reason IS NULL)",
        "shingle_counts": f"WITH {NEAR} SELECT doc_id, n FROM sn",
        "near_dup_pairs": f"WITH {NEAR} SELECT a, b, round(jaccard, 6) AS jaccard FROM sj WHERE jaccard > 0.5",
        "near_dedup_kept": f"{_resolved(0.3)} SELECT doc_id, outcome FROM done",
        "prepare_summary": f"{_resolved(0.8)} SELECT outcome, count(*) AS n FROM done GROUP BY 1",
        "hash_split_counts": "SELECT CASE WHEN substr(md5(text), 1, 8) < '0ccccccc' THEN 'val' ELSE 'train' END AS split, source, count(*) AS n FROM documents GROUP BY 1, 2",
        "count_split": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, round_even((SELECT count(*) FROM documents) * 0.05, 0)) THEN 'val' ELSE 'train' END AS split FROM documents""",
        "held_out_documents": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 1500 AND substr(md5(text), 1, 8) < '0ccccccc' ORDER BY doc_id LIMIT 400",
        "exclude_sources": "SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src3', 'src7') GROUP BY 1",
        "survey_totals": """WITH s AS (SELECT source, floor(sum(strlen(text)) / 3.6)::BIGINT AS tokens FROM documents GROUP BY 1)
          SELECT sum(tokens) FILTER (WHERE source <> 'src19')::BIGINT AS usable_tokens, count(*) AS sources, round(sum(tokens) FILTER (WHERE source <> 'src19') / 2.24e9, 6) AS share FROM s""",
        "survey_table": f"""SELECT source, bytes, floor(bytes / 3.6)::BIGINT AS tokens, contains(note, 'EVALUATION') AS evaluation FROM (SELECT source, coalesce(nullif(m, 0), f)::BIGINT AS bytes, note FROM {values(SOURCES)} AS v(source, m, f, note)) WHERE bytes > 0""",
        "pack_blocks": f"""WITH {TOKENS}, o AS (SELECT split, ids, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM i),
          x AS (SELECT split, unnest(ids) AS id, o + generate_subscripts(ids, 1) - 1 AS k FROM o)
          SELECT split, (k // 256)::BIGINT AS block_id, sum(id)::BIGINT AS total, md5(string_agg(id::VARCHAR, ',' ORDER BY k)) AS digest FROM x GROUP BY 1, 2 HAVING count(*) = 256""",
        "pack_remainder": f"WITH {TOKENS} SELECT split, count(*) AS documents, sum(len(ids))::BIGINT AS tokens, (sum(len(ids)) // 256)::BIGINT AS blocks, (sum(len(ids)) % 256)::BIGINT AS dropped FROM i GROUP BY 1",
        "sft_pairs": f"WITH {PAIRS} SELECT conv_id, turn, length(instruction) AS n_instruction, length(response) AS n_response FROM pr",
        "sft_reject_reasons": _pair_reasons(40, 1500, True),
        "sft_reject_reasons_loose": _pair_reasons(40, 4000, False),
        "sft_dedup": f"WITH {PAIRS} SELECT conv_id, turn FROM pr QUALIFY row_number() OVER (PARTITION BY substr(strip_accents(lower(instruction)), 1, 12) ORDER BY conv_id, turn) = 1",
        "sft_report": f"""WITH {PAIRS}, v AS (SELECT *, regexp_extract_all(strip_accents(lower(instruction || ' ' || response)), '[a-z'']+') AS x FROM pr)
          SELECT count(*) AS pairs, round(avg({_share('x', REPORT_TARGET)}), 4) AS kreyol_word_rate, round(avg({_share('x', REPORT_OTHER)}), 4) AS french_word_rate, count(*) FILTER (WHERE regexp_matches(response, '[^\\x00-\\x7F]')) AS with_accents,
          count(DISTINCT instruction) AS unique_instructions, (list_sort(list(length(response))))[count(*) // 2 + 1]::BIGINT AS median_response_chars FROM v""",
        "sft_per_task": f"WITH {PAIRS} SELECT substr(instruction, 1, 1) AS task, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((conv_id, turn))) AS place FROM pr GROUP BY 1",
        "prompt_grid": f"WITH {GRID} SELECT * FROM g",
        "prompt_texts": f"WITH {GRID} SELECT job, md5(replace(replace(replace(replace({text(TEMPLATE)}, '{{domain}}', domain), '{{task}}', task), '{{angle}}', angle), '{{count}}', '10')) AS digest FROM g",
        "parse_json_pairs": f"""WITH r AS (SELECT * FROM (VALUES {json_pairs}) AS v(id, j) WHERE json_valid(j)), e AS (SELECT id, i - 1 AS pos, json_extract(j, '$[' || (i - 1) || ']') AS x FROM (SELECT id, j, unnest(range(1, json_array_length(j)::BIGINT + 1)) AS i FROM r))
          SELECT id, pos::BIGINT AS pos, trim(x->>'$.enstriksyon') AS instruction, trim(x->>'$.repons') AS response FROM e WHERE json_type(x) = 'OBJECT' AND coalesce(x->>'$.enstriksyon', '') <> '' AND coalesce(x->>'$.repons', '') <> ''""",
        "position_profile": """WITH s AS (SELECT vec_id // 16 AS w, list_stddev_samp(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings), m AS (SELECT w, avg(s) AS m FROM s GROUP BY w HAVING count(*) = 16),
          t AS (SELECT m FROM m WHERE w >= (SELECT count(*) // 2 FROM m)), d AS (SELECT avg(m) AS tail_mean, quantile_disc(m, 0.5) AS median FROM t), a AS (SELECT greatest(quantile_disc(abs(m - median), 0.5), 1e-6) AS mad FROM t, d),
          l AS (SELECT max(w) AS last FROM m, d, a WHERE abs(m - median) > 6 * mad)
          SELECT CASE WHEN abs(tail_mean - 0.125) > 0.05 * 0.125 THEN (SELECT count(*) FROM embeddings) ELSE coalesce((last + 1) * 16, 0) END::BIGINT AS trained, (SELECT count(*) FROM embeddings) AS rows, round(tail_mean, 6) AS tail_mean FROM d, l""",
        "lr_schedule": "SELECT range AS step, round(CASE WHEN range < 100 THEN 6e-4 * (range + 1) / 100 ELSE 6e-4 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (range - 100) / 900)))) END * 1e6, 6) AS rate FROM range(1000)",
        "position_bands": f"""SELECT model, first, last, round(avg(loss), 6) AS loss, round(avg(hit::INT), 6) AS hit FROM {values(SCORED)} AS v(model, doc_id, pos, loss, hit) JOIN (VALUES (0, 32), (32, 64), (64, 128), (128, 256)) AS b(first, last) ON pos >= first AND pos < last GROUP BY 1, 2, 3""",
        "bits_per_character": f"""SELECT model, round(sum(loss * (n - 1)) / ln(2) / sum(c), 6) AS bits_per_character, round(exp(least(sum(loss * (n - 1)) / sum(n - 1), 20)), 6) AS perplexity_per_token, round(sum(n - 1) / sum(c), 6) AS tokens_per_character
          FROM {values(SCORED_TEXTS)} AS v(model, loss, n, c) WHERE n >= 32 GROUP BY 1""",
        "prefix_match": f"""WITH s AS (SELECT id, string_split(made, ' ') AS m, string_split(real, ' ') AS r FROM {values(MADE)} AS v(id, made, real)), p AS (SELECT id, len(m) AS n, list_transform(range(1, least(len(m), len(r)) + 1), lambda i: m[i] = r[i]) AS same FROM s)
          SELECT id, coalesce(nullif(list_position(same, false), 0) - 1, len(same))::BIGINT AS run, round(len(list_filter(same, lambda x: x)) / n, 6) AS share FROM p""",
        "training_stop": f"""WITH RECURSIVE h AS (SELECT * FROM {values(HISTORY)} AS v(run, step, loss)), r(run, step, best, waited, stopped) AS (SELECT run, step, loss, 0::BIGINT, NULL::BIGINT FROM h WHERE step = 0 UNION ALL
          SELECT r.run, h.step, CASE WHEN stopped IS NULL AND loss < best - 1e-4 THEN loss ELSE best END, CASE WHEN stopped IS NOT NULL THEN waited WHEN loss < best - 1e-4 THEN 0 ELSE waited + 1 END,
          CASE WHEN stopped IS NOT NULL THEN stopped WHEN NOT loss < best - 1e-4 AND waited + 1 >= 3 THEN h.step END FROM r JOIN h ON h.run = r.run AND h.step = r.step + 1)
          SELECT run, best, waited, stopped::BIGINT AS stopped FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1""",
        "clean_composed": f"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, {_clean("nfc_normalize(replace(replace(text, chr(233), 'e' || chr(769)), chr(252), 'u' || chr(776)))")} AS t FROM documents)""",
        "source_head": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
        "source_registry": """SELECT priority::INT AS priority, source, sentences, (SELECT count(*) FROM documents d WHERE d.source = r.source) AS n
          FROM (VALUES (0, 'src7', FALSE), (1, 'src3', FALSE), (2, 'src5', TRUE)) AS r(priority, source, sentences)""",
        "source_configs": "SELECT DISTINCT source, lang FROM documents ORDER BY ALL",
        "survey_document": f"""WITH s AS (SELECT source, bytes, floor(bytes / 3.6)::BIGINT AS tokens, note, contains(note, 'EVALUATION') AS evaluation FROM (SELECT source, coalesce(nullif(m, 0), f)::BIGINT AS bytes, note FROM {values(SOURCES)} AS v(source, m, f, note)) WHERE bytes > 0)
          SELECT to_json({{bytes_per_token: 3.6::DOUBLE, usable_tokens: sum(tokens) FILTER (WHERE NOT evaluation)::BIGINT, sources: list({{source: source, bytes: bytes, tokens: tokens, note: note, evaluation: evaluation}} ORDER BY source)}})::VARCHAR AS document FROM s""",
        "nearest_configs": f"""SELECT dataset, array_to_string(list_filter(list_sort(list(DISTINCT config)), lambda x: contains(lower(x), 'ht') OR contains(lower(x), 'hat') OR contains(lower(x), 'cre'))[1:4], ',') AS near FROM {values(CONFIGS)} AS v(dataset, config) GROUP BY 1""",
        "published_summary": f"""WITH p AS (SELECT (max(text) FILTER (WHERE name = 'training_summary'))::JSON AS t, (max(text) FILTER (WHERE name = 'comparison'))::JSON AS c FROM {values(PAGES)} AS v(name, text)),
          b AS (SELECT t, (c->>'$.new.bits_per_character')::DOUBLE AS new_bits, (c->>'$.old.bits_per_character')::DOUBLE AS old_bits FROM p)
          SELECT (t->>'$.parameters')::BIGINT AS parameters, (t->>'$.unique_train_tokens')::BIGINT AS unique_train_tokens, (t->>'$.epochs')::DOUBLE AS epochs, (t->>'$.best_eval_perplexity')::DOUBLE AS best_eval_perplexity, new_bits, old_bits, old_bits / new_bits AS ratio FROM b""",
        "pack_manifest": f"""WITH {TOKENS} SELECT split, count(*) AS documents, sum(len(ids))::BIGINT AS tokens, (sum(len(ids)) // 256)::BIGINT AS blocks, (sum(len(ids)) // 256 * 256)::BIGINT AS tokens_kept, (sum(len(ids)) % 256)::BIGINT AS tokens_dropped FROM i GROUP BY 1""",
        "pack_source_counts": "SELECT source, count(*) AS documents, count(*) FILTER (WHERE substr(md5(text), 1, 8) < '0ccccccc') AS held_out FROM documents GROUP BY 1",
        "block_subset": f"""WITH {TOKENS}, o AS (SELECT split, ids, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM i),
          x AS (SELECT split, unnest(ids) AS id, o + generate_subscripts(ids, 1) - 1 AS k FROM o)
          SELECT split, (k // 256)::BIGINT AS block_id, sum(id)::BIGINT AS total FROM x WHERE (k // 256) % 7 = 3 GROUP BY 1, 2 HAVING count(*) = 256""",
        "scoring_blocks": """WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(substr(text, 1, 400000), '[\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'), lambda x: x <> ''), lambda x: length(x)) AS ids FROM documents),
          x AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS k FROM w)
          SELECT doc_id, (k // 64)::BIGINT AS block_id, sum(id)::BIGINT AS total FROM x WHERE k < 64 * 40 GROUP BY 1, 2 HAVING count(*) = 64""",
        "tokenizer_split": "SELECT doc_id, CASE WHEN n <= 100 THEN 'measured' WHEN n <= 600 THEN 'fitted' ELSE 'neither' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)",
        "sft_samples": f"WITH {PAIRS} SELECT conv_id, turn, substr(instruction, 1, 170) AS instruction, substr(response, 1, 280) AS response FROM pr ORDER BY conv_id, turn LIMIT 5",
        "sft_output": f"WITH {PAIRS} SELECT md5(instruction) AS instruction, md5(response) AS response FROM (SELECT * FROM pr ORDER BY conv_id, turn LIMIT 50)",
        "token_output": f"""WITH {TOKENS}, o AS (SELECT split, ids, coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM i),
          x AS (SELECT split, unnest(ids) AS id, o + generate_subscripts(ids, 1) - 1 AS k FROM o), b AS (SELECT split, sum(id) AS total FROM x GROUP BY split, k // 256 HAVING count(*) = 256)
          SELECT split, count(*) AS blocks, sum(total)::BIGINT AS total FROM b GROUP BY 1""",
        "block_perplexity": f"SELECT part, round(exp(least(avg(loss), 20)), 6) AS perplexity FROM {values(BLOCK_LOSSES)} AS v(part, block_id, loss) GROUP BY 1",
        "held_out_loss": f"WITH b AS (SELECT part, block_id // 4 AS batch, avg(loss) AS loss, count(*) AS n FROM {values(BLOCK_LOSSES)} AS v(part, block_id, loss) GROUP BY 1, 2) SELECT part, round(sum(loss * n) / sum(n), 6) AS loss, sum(n)::BIGINT AS blocks FROM b WHERE batch * 4 < 10 GROUP BY 1",
        "window_losses": f"""WITH w AS (SELECT * FROM {values(WINDOWS)} AS v(model, doc_id, start, tokens, loss)), g AS (SELECT DISTINCT model, s AS start FROM w, (VALUES (0), (600)) AS t(s))
          SELECT g.model, g.start::BIGINT AS start, round(avg(w.loss), 6) AS loss, count(w.loss) AS texts FROM g LEFT JOIN w ON w.model = g.model AND w.start = g.start AND w.tokens >= w.start + 64 GROUP BY 1, 2""",
        "stop_rate": f"SELECT model, count(*) FILTER (WHERE last_id = end_id OR tokens < prompt_tokens + most_new) AS stopped, count(*) AS prompts FROM {values(ENDINGS)} AS v(model, last_id, end_id, prompt_tokens, tokens, most_new) GROUP BY 1",
        "end_id_check": f"SELECT model, coalesce(end_id, 0) < vocabulary AS can_end FROM {values(VOCABULARIES)} AS v(model, end_id, vocabulary)",
        "training_throughput": f"""WITH c AS (SELECT *, (step + 1 - first_step) * per_step AS seen FROM {values(CHECKS)} AS v(run, step, first_step, total_steps, per_step, seconds))
          SELECT (step + 1)::BIGINT AS step, seen::BIGINT AS tokens_seen, round_even(seen / seconds, 0)::BIGINT AS tokens_per_second, round((total_steps - step - 1) * per_step / greatest(seen / seconds, 1) / 3600, 6) AS hours_left FROM c""",
        "training_arithmetic": f"""WITH r AS (SELECT *, greatest(1, blocks // (batch * accumulation)) AS steps FROM {values(RUNS)} AS v(run, blocks, block, batch, accumulation, epochs, parameters))
          SELECT run, (batch * accumulation * block)::BIGINT AS tokens_per_step, steps::BIGINT AS steps_per_epoch, floor(epochs * steps)::BIGINT AS total_steps, (20 * parameters::BIGINT) AS tokens_wanted, blocks::BIGINT * block * epochs < 20 * parameters::BIGINT AS short FROM r""",
        "model_comparison": f"""WITH m AS (SELECT model, sum(loss * (n - 1)) / ln(2) / sum(c) AS bits_per_character, exp(least(sum(loss * (n - 1)) / sum(n - 1), 20)) AS perplexity_per_token, sum(n - 1) / sum(c) AS tokens_per_character FROM {values(SCORED_TEXTS)} AS v(model, loss, n, c) WHERE n >= 32 GROUP BY 1),
          l AS (SELECT model, unnest(['bits_per_character', 'perplexity_per_token', 'tokens_per_character']) AS measure, unnest([bits_per_character, perplexity_per_token, tokens_per_character]) AS value FROM m)
          SELECT measure, round(max(value) FILTER (WHERE model = 'new'), 6) AS new, round(max(value) FILTER (WHERE model = 'old'), 6) AS old FROM l GROUP BY 1""",
        "fertility_delta": f"""WITH f AS (SELECT tokenizer, sum(tokens) / greatest(sum(words), 1) AS f FROM {values(TOKEN_COUNTS)} AS v(tokenizer, tokens, words) GROUP BY 1), b AS (SELECT max(f) FILTER (WHERE tokenizer = 'mine') AS mine, max(f) FILTER (WHERE tokenizer = 'theirs') AS theirs FROM f)
          SELECT round(mine, 6) AS mine, round(theirs, 6) AS theirs, round(100 * (mine / theirs - 1), 6) AS delta FROM b""",
        "sentence_glue": f"""WITH RECURSIVE t AS (SELECT source, doc_id, trim(text, {WS}) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text <> ''),
          g(source, i, doc_ord, size, doc_id, t) AS (SELECT source, i, 0::BIGINT, length(t), doc_id, t FROM t WHERE i = 1 UNION ALL
            SELECT t.source, t.i, CASE WHEN g.size >= 2000 THEN g.doc_ord + 1 ELSE g.doc_ord END, CASE WHEN g.size >= 2000 THEN 0 ELSE g.size END + length(t.t), t.doc_id, t.t FROM g JOIN t ON t.source = g.source AND t.i = g.i + 1)
          SELECT source, doc_ord, length(x) AS n, md5(x) AS digest FROM (SELECT source, doc_ord, string_agg(t, {NL} ORDER BY doc_id) AS x FROM g GROUP BY 1, 2)""",
        "pretoken_counts": f"""WITH m AS (SELECT regexp_replace(text, '(\\s)(\\S)', chr(1) || '\\1\\2', 'g') AS t FROM documents), e AS (SELECT replace(unnest(regexp_extract_all(t, {text(PRETOKENS)})), chr(1), '') AS token FROM m),
          c AS (SELECT token, count(*) AS n FROM e GROUP BY 1) SELECT length(token)::INT AS chars, count(*) AS distinct_tokens, sum(n)::BIGINT AS tokens FROM c GROUP BY 1""",
        "streaming_dedup": f"WITH {BASE} SELECT DISTINCT md5(t) AS digest FROM q WHERE reason IS NULL",
    }
