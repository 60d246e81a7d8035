"""SQL of the catalogue's queries, in DuckDB's dialect, written independently of the Spark plans."""

from __future__ import annotations

def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Fixed values, written again so that a change of the library's lists shows.
_STOP = _list((
    "the and but for nor yet not are was were has had have his her its our their your you she him they them who whom "
    "whose what which when where why how this that these those there here with without from into onto upon over "
    "under after before while until since then than only also just very some any all each every both few more most "
    "other such did does done can could will would shall should may might must let one two day step note nobody "
    "please yes"
).split())
_KEPT = _list("ok no yes hp mp sp xp npc pc id ui ai mod bug app api url xml json html boss buff debuff dps tank healer pvp pve cm mm kg km gb mb kb".split())
_LANGUAGES = {'auto': 'auto-detect (LLM decides)', 'en': 'English', 'zh': 'Simplified Chinese', 'zh-Hant': 'Traditional Chinese', 'ja': 'Japanese', 'ko': 'Korean', 'fr': 'French', 'de': 'German', 'es': 'Spanish', 'ru': 'Russian'}
_BLANK = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{_BLANK}+|{_BLANK}+\z', '', 'g')"


def _distinct_ci(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position(list_transform({x}, lambda v: lower(v)), lower(w)) = i)"


def _nouns(x: str) -> str:
    words = rf"list_filter(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND NOT list_contains({_STOP}, lower(w)))"
    return _distinct_ci(words)


def _bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '%[\p{{L}}\p{{N}}_]+|\{{\p{{Nd}}+\}}|\[[^\]]*\]', '', 'g')"


def _words(x: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all(lower({_bare(x)}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))))"


def _fragments(s: str, t: str) -> str:
    return f"list_sort(list_filter(list_intersect({_words(s)}, {_words(t)}), lambda w: length(w) > 2 AND NOT list_contains({_KEPT}, w)))"


_CJK = r"[\x{4e00}-\x{9fff}]"


def _untranslated(s: str, t: str) -> str:
    a, b, bare = f"lower({_strip(s)})", f"lower({_strip(t)})", _bare(t)
    cjk, alpha = f"len(regexp_extract_all({bare}, '{_CJK}'))", f"len(regexp_extract_all({bare}, '[a-zA-Z]'))"
    return f"({s} <> '' AND {t} <> '' AND ({a} = {b} OR (length({a}) > 10 AND length({b}) > 10 AND (contains({b}, {a}) OR contains({a}, {b}))) OR (length({bare}) > 5 AND {cjk} + {alpha} > 5 AND {alpha} > {cjk} * 2)))"


_TOKEN = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}][\p{L}\p{N}_'']*"
_PAIRS = "(SELECT * FROM string_rows WHERE source IS NOT NULL AND dest IS NOT NULL)"
_TR = "(SELECT * FROM string_rows WHERE source <> '')"
_PLAN = f"(SELECT source, min(row_idx) AS rep_row_idx, count(*) AS n_rows FROM {_TR} GROUP BY source)"
_LOOKUP = f"(SELECT norm, arg_min(term, ord) AS term, min(ord) AS ord FROM (SELECT *, lower({_strip('term')}) AS norm FROM glossary WHERE term IS NOT NULL) WHERE norm <> '' GROUP BY norm)"
_MISSING = "(SELECT * FROM glossary WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM vector_index WHERE embedding IS NOT NULL AND term IS NOT NULL))"
_OK = "(SELECT pos, embedding::DOUBLE[] AS v FROM vector_index WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"


def _cos(a: str, b: str) -> str:
    return f"coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0.0)"


_TOPK = f"""(SELECT * FROM (SELECT q.pos AS query, b.pos AS pos, round({_cos('q.v', 'b.v')}, 12) AS s, row_number() OVER (PARTITION BY q.pos ORDER BY round({_cos('q.v', 'b.v')}, 12) DESC, b.pos) AS rank
  FROM {_OK} q, {_OK} b WHERE q.pos % 100 = 0) WHERE rank <= 3)"""
_KW = f"(SELECT row_idx, unnest(k) AS keyword, unnest(range(len(k))) AS kw_pos FROM (SELECT row_idx, {_nouns('source')} AS k FROM string_rows WHERE source IS NOT NULL))"
_TOP5 = f"""(SELECT * FROM (SELECT keyword, term, ord, row_number() OVER (PARTITION BY keyword ORDER BY ord) AS rank
  FROM (SELECT DISTINCT keyword FROM {_KW}) k JOIN glossary g ON contains(lower(g.term), lower(k.keyword))) WHERE rank <= 5)"""
_BASE = """(SELECT g.ord, g.term, g.translation, v.v FROM glossary g LEFT JOIN (SELECT term, arg_min(embedding, pos)::DOUBLE[] AS v FROM vector_index WHERE len(embedding) = 96 GROUP BY term) v ON g.term = v.term)"""
_TIERED = f"""(
  WITH base AS MATERIALIZED (SELECT * FROM {_BASE}), kw AS MATERIALIZED (SELECT ord AS kw_id, term AS keyword, v AS kv FROM base WHERE ord % 100 = 0 AND term IS NOT NULL),
  t0 AS (SELECT kw_id, keyword, l.ord, 0 AS tier, 1 AS rank, NULL::DOUBLE AS score FROM kw JOIN {_LOOKUP} l ON lower({_strip('keyword')}) = l.norm),
  h1 AS (SELECT kw_id, keyword, b.ord, CASE WHEN kv IS NOT NULL AND v IS NOT NULL THEN round({_cos('kv', 'v')}, 12) END AS score FROM kw JOIN base b ON keyword <> '' AND contains(lower(b.term), lower(keyword))),
  t1 AS (SELECT kw_id, keyword, ord, 1 AS tier, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY kw_id ORDER BY score DESC NULLS LAST, ord) AS rank FROM h1) WHERE rank <= 5),
  h2 AS (SELECT kw_id, keyword, b.ord, round({_cos('kv', 'v')}, 12) AS score FROM kw, base b WHERE kv IS NOT NULL AND v IS NOT NULL),
  t2 AS (SELECT kw_id, keyword, ord, 2 AS tier, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY kw_id ORDER BY score DESC, ord) AS rank FROM h2) WHERE rank <= 3 AND score >= 0.75),
  every AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kw_id, ord ORDER BY tier, rank) AS n FROM every) WHERE n = 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY kw_id ORDER BY tier, rank) AS slot FROM one)
  SELECT kw_id, keyword, slot, term, coalesce(translation, '') AS translation, tier, score FROM ranked JOIN base USING (ord) WHERE slot <= 30)"""
_MENTION = f"""(
  WITH matched AS (SELECT p.rep_row_idx AS key, h.term, min(k.kw_pos * 10 + h.rank) AS first FROM {_PLAN} p JOIN {_KW} k ON k.row_idx = p.rep_row_idx JOIN {_TOP5} h ON h.keyword = k.keyword GROUP BY 1, 2)
  SELECT m.key, m.term, coalesce(g.translation, '') AS translation, contains(lower(p.source), lower(m.term)) AS mentioned,
    row_number() OVER (PARTITION BY m.key ORDER BY contains(lower(p.source), lower(m.term)) DESC, m.first, g.ord) AS place
  FROM matched m JOIN glossary g ON g.term = m.term JOIN {_PLAN} p ON p.rep_row_idx = m.key WHERE length(m.term) < 100)"""
_BLOCK = f"(SELECT key, '## Glossary' || chr(10) || string_agg('- ' || term || ' : ' || translation, chr(10) ORDER BY place) AS block FROM {_MENTION} GROUP BY key)"


def _names(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANGUAGES.items()) + f" ELSE {x} END"


_CODE = r"""CASE regexp_extract(coalesce(text, ''), '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]') WHEN '' THEN 'en' ELSE
  CASE WHEN regexp_matches(regexp_extract(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]'), '[\x{4e00}-\x{9fff}]') THEN 'zh'
  WHEN regexp_matches(regexp_extract(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]'), '[\x{3040}-\x{30ff}]') THEN 'ja'
  WHEN regexp_matches(regexp_extract(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0400}-\x{04ff}]'), '[\x{ac00}-\x{d7af}]') THEN 'ko' ELSE 'ru' END END"""


_REPLY = f"(SELECT row_idx, source, dest, {_strip("regexp_replace(dest, '```(json)?', '', 'g')")} AS r, regexp_extract(dest, '(?s)\\{{.*\\}}') AS inside FROM {_PAIRS})"
# Where every token starts, and where the eighth one's letters are first found.
_SPANS = f"""(SELECT *, list_transform(range(1, len(t) + 1), lambda i: coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x))), 0)) AS s,
  CASE WHEN length(t[8]) >= 2 AND contains(lower(text), lower(t[8])) THEN strpos(lower(text), lower(t[8])) - 1 END AS pos
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS t, regexp_split_to_array(text, '{_TOKEN}') AS g FROM documents WHERE text IS NOT NULL))"""
_EXCERPT = f"""SELECT doc_id, CASE WHEN n <= 12 THEN text ELSE CASE WHEN a > 0 THEN '…' ELSE '' END || text[a + 1:b] || CASE WHEN b < length(text) THEN '…' ELSE '' END END AS excerpt FROM (
  SELECT *, s[first + 1]::BIGINT AS a, (s[first + 12] + length(t[first + 12]))::BIGINT AS b FROM (
  SELECT *, least(greatest(CASE WHEN pos IS NULL THEN 0 ELSE greatest(len(list_filter(s, lambda x: x <= pos)) - 1, 0) - 4 END, 0), n - 12) AS first FROM (SELECT *, len(t) AS n FROM {_SPANS})))"""


def _sql() -> dict[str, str]:
    flagged, frags = _untranslated("source", "dest"), _fragments("source", "dest")
    touch = rf"lambda w: regexp_matches(lower(dest), '{_CJK}' || w || '([^a-z]|\z)') OR regexp_matches(lower(dest), '([^a-z]|\A)' || w || '{_CJK}')"
    return {
        "proper_noun_keywords": f"SELECT keyword, count(*) AS n_docs FROM (SELECT unnest({_nouns('text')}) AS keyword FROM documents WHERE text IS NOT NULL) GROUP BY keyword",
        "first_keywords": f"SELECT row_idx, kw_pos::INT AS kw_pos, keyword FROM {_KW}",
        "possessive_strip": f"""SELECT ord, term, CASE WHEN contains(term, '''s ') THEN nullif({_strip("regexp_extract(term, '(?s)^(.*?)''" + chr(92) + "s*s" + chr(92) + "s+', 1)")}, '') WHEN ends_with(term, '''s') THEN {_strip('term[:-3]')} ELSE term END AS stripped FROM glossary""",
        "keyword_union": f"SELECT row_idx, array_to_string({_distinct_ci('k')}, '|') AS keywords FROM (SELECT row_idx, list_concat(coalesce(string_split(id, '_'), []), {_nouns('source')}) AS k FROM string_rows WHERE source IS NOT NULL)",
        "english_words": f"SELECT row_idx, array_to_string({_words('source')}, ' ') AS words FROM string_rows WHERE source IS NOT NULL",
        "strip_markup": f"SELECT row_idx, {_bare('source')} AS bare FROM string_rows WHERE source IS NOT NULL",
        "strip_blanks": f"SELECT row_idx, lower({_strip('source')}) AS norm FROM string_rows WHERE source IS NOT NULL",
        "detect_language": f"SELECT doc_id, code, {_names('code')} AS language FROM (SELECT doc_id, {_CODE} AS code FROM documents)",
        "language_names": f"SELECT lang, {_names('lang')} AS language, count(*) AS n_docs FROM documents GROUP BY lang",
        "token_count": f"SELECT doc_id, len(regexp_extract_all(text, '{_TOKEN}'))::INT AS n_tokens FROM documents WHERE text IS NOT NULL",
        "truncate_reference": _EXCERPT,
        "parse_translation": f"SELECT row_idx, CASE WHEN starts_with(r, '{{') AND json_valid(r) THEN coalesce(json_extract_string(r, '$.translation'), source) WHEN inside <> '' AND json_valid(inside) THEN coalesce(json_extract_string(inside, '$.translation'), {_strip('dest')}) ELSE {_strip('dest')} END AS parsed FROM {_REPLY}",
        "find_anchor": "SELECT doc_id, (CASE WHEN text IS NULL THEN NULL WHEN contains(lower(text), 'iron sword') THEN strpos(lower(text), 'iron sword') - 1 WHEN contains(lower(text), 'the') THEN strpos(lower(text), 'the') - 1 END)::INT AS at FROM documents",
        "template_vars": """SELECT row_idx, replace(replace(replace('To {lang}: {text} {"keep": "{x}"} by {who}', '{lang}', 'Chinese'), '{text}', source), '{who}', coalesce(provider, '')) AS prompt FROM string_rows WHERE source IS NOT NULL""",
        "parse_keywords": r"""SELECT row_idx, CASE WHEN row_idx % 3 = 2 THEN '' ELSE regexp_replace(id, '["\\]', '', 'g') || '|B' END AS keywords FROM string_rows WHERE id IS NOT NULL""",
        "likely_untranslated": f"SELECT row_idx, coalesce({flagged}, false) AS flagged FROM {_PAIRS}",
        "untranslated_fragments": f"SELECT row_idx, array_to_string({frags}, ',') AS fragments FROM {_PAIRS}",
        "suspicious_fragments": f"SELECT * FROM (SELECT row_idx, array_to_string(list_filter({_fragments('source', 'dest')}, {touch}), ',') AS fragments FROM (SELECT row_idx, source, source || ' 见' || coalesce({_words('source')}[2], '') || '。' AS dest FROM {_PAIRS})) WHERE fragments <> ''",
        "retry_decision": f"SELECT decision, count(*) AS n_rows FROM (SELECT CASE WHEN NOT {flagged} AND len({frags}) = 0 THEN 'accept' WHEN attempt >= 2 THEN 'exhausted' WHEN {flagged} THEN 'retry_generic' ELSE 'retry_fragments' END AS decision FROM {_PAIRS}) GROUP BY decision",
        "named_fragments": f"SELECT * FROM (SELECT row_idx, array_to_string({frags}[1:5], ', ') AS named FROM {_PAIRS}) WHERE named <> ''",
        "display_strings": "SELECT ord, term || ' -> ' || coalesce(translation, '') AS shown, string_split(term || ' -> ' || coalesce(translation, ''), ' -> ')[1] AS term_back FROM glossary",
        "log_lines": "SELECT row_idx, '[' || strftime(exported_at, '%Y-%m-%d %H:%M:%S') || '] [' || CASE WHEN loaded_at IS NULL THEN 'ERROR' ELSE 'WARNING' END || '] [' || coalesce(provider, 'none') || ':load] row ' || row_idx AS line FROM string_rows WHERE loaded_at IS NULL OR attempt > 1",
        "translatable_rows": f"SELECT plugin, count(*) AS n_rows FROM {_TR} GROUP BY plugin",
        "selected_rows": f"SELECT row_idx, source FROM {_TR} WHERE attempt = 0",
        "dedup_plan": f"SELECT * FROM {_PLAN}",
        "dedup_stats": f"SELECT count(*) AS total, count(DISTINCT source) AS uniq, count(*) - count(DISTINCT source) AS saved FROM {_TR}",
        "fan_out": f"SELECT r.row_idx, coalesce(x.dest, '') AS translation FROM {_TR} r JOIN {_PLAN} p USING (source) JOIN string_rows x ON x.row_idx = p.rep_row_idx",
        "fill_dest": "SELECT r.row_idx, CASE WHEN coalesce(r.dest, '') = '' THEN coalesce(g.translation, '') ELSE r.dest END AS dest FROM string_rows r LEFT JOIN glossary g ON r.source = g.term",
        "clear_dest": "SELECT attempt, count(*) FILTER (attempt = 3 OR coalesce(dest, '') = '') AS n_empty, count(*) AS n_rows FROM string_rows GROUP BY attempt",
        "progress_metric": "SELECT plugin, floor(count(*) FILTER (coalesce(dest, '') <> '') / count(*) * 100)::INT AS percent FROM string_rows GROUP BY plugin",
        "glossary_lookup": f"SELECT norm, term FROM {_LOOKUP}",
        "glossary_lookup_exact": f"SELECT row_idx, term FROM (SELECT row_idx, lower({_strip('source')}) AS norm FROM string_rows) JOIN {_LOOKUP} USING (norm)",
        "glossary_containment_top5": f"SELECT keyword, rank::INT AS rank, term FROM {_TOP5}",
        "glossary_upsert": f"""WITH keep AS (SELECT * FROM glossary WHERE ord IN (SELECT ord FROM {_LOOKUP})), low AS (SELECT min(ord) AS l FROM glossary WHERE term IS NOT NULL), top AS (SELECT max(ord) + 1 AS m FROM keep)
          SELECT coalesce(k.ord, m + g.ord - l) AS ord, g.term, coalesce(upper(g.translation), '') AS translation FROM glossary g LEFT JOIN keep k ON k.term = g.term, low, top WHERE g.term IS NOT NULL""",
        "glossary_delete": f"SELECT ord, term, translation FROM glossary WHERE ord NOT IN (SELECT ord FROM {_MISSING})",
        "glossary_last_wins": "SELECT min(row_idx) AS ord, source AS term, arg_max(coalesce(dest, ''), row_idx) AS translation FROM string_rows WHERE source IS NOT NULL GROUP BY source",
        "valid_entries": f"SELECT * FROM (SELECT ord, {_strip('term')} AS term, {_strip('translation')} AS translation FROM glossary) WHERE term <> '' AND translation <> ''",
        "missing_terms": f"SELECT ord, term FROM {_MISSING}",
        "glossary_search": "SELECT ord, term FROM glossary WHERE contains(lower(term || ' -> ' || coalesce(translation, '')), 'gift ->')",
        "glossary_page": "SELECT ord, term FROM glossary ORDER BY ord LIMIT 200 OFFSET (SELECT CASE WHEN count(*) > 200 THEN 200 ELSE 0 END FROM glossary)",
        "page_count": "SELECT count(*) AS n_terms, greatest(1, ceil(count(*) / 200))::BIGINT AS n_pages FROM glossary",
        "vector_norms": f"SELECT pos, round(sqrt(list_inner_product(v, v)), 6) AS norm, CASE WHEN list_inner_product(v, v) > 0 THEN 1.0 ELSE 0.0 END AS unit_norm FROM {_OK}",
        "vector_topk": f"SELECT query, pos, rank::INT AS rank, round(s, 6) AS score FROM {_TOPK}",
        "vector_threshold": f"SELECT query, count(*) AS n_close FROM {_TOPK} WHERE round(s, 6) >= 0.75 GROUP BY query",
        "embedding_topk": f"""SELECT query, vec_id, rank::INT AS rank FROM (SELECT q.vec_id AS query, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_cos('q.v', 'b.v')}, 12) DESC, b.vec_id) AS rank
          FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b) WHERE rank <= 3""",
        "index_integrity": """WITH per AS (SELECT term, count(*) AS n FROM vector_index GROUP BY term), j AS (SELECT g.term AS gt, p.term AS pt, p.n, g.ord FROM glossary g FULL JOIN per p ON g.term = p.term)
          SELECT count(ord) AS n_terms, coalesce(sum(n), 0)::BIGINT AS n_entries, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (ord IS NULL) AS n_orphans, count(*) FILTER (n > 1) AS n_repeated,
          (SELECT count(*) FILTER (coalesce(len(embedding), -1) <> 96) FROM vector_index) AS n_other_width FROM j""",
        "index_delete": "SELECT pos, term FROM vector_index WHERE pos NOT IN (SELECT min(pos) FROM vector_index WHERE term IS NOT NULL GROUP BY term HAVING count(*) > 1)",
        "index_append": f"SELECT pos, term, coalesce(len(embedding), -1)::INT AS width FROM vector_index UNION ALL SELECT (SELECT max(pos) + 1 FROM vector_index) + ord - (SELECT min(ord) FROM {_MISSING}), term, 96 FROM {_MISSING}",
        "index_build": "SELECT term, 96 AS width FROM glossary WHERE term IS NOT NULL",
        "xml_strings": "SELECT coalesce(id, '') AS id, coalesce(source, '') AS source, coalesce(dest, '') AS dest FROM string_rows",
        "glossary_json": "SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, term, translation FROM glossary WHERE term IS NOT NULL",
        "glossary_csv": f"SELECT t AS term, arg_max(coalesce({_strip('translation')}, ''), ord) AS translation FROM (SELECT *, {_strip('term')} AS t FROM glossary WHERE term IS NOT NULL) GROUP BY t",
        "index_npy": "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, term, embedding[1]::DOUBLE AS first FROM vector_index WHERE len(embedding) = 96",
        "cleaned_keywords": f"SELECT row_idx, array_to_string({_distinct_ci('k')}, '|') AS keywords FROM (SELECT row_idx, list_filter(list_transform(list_concat(string_split(id, '_'), [' x ', '', 'X']), lambda w: {_strip('w')}), lambda w: w <> '') AS k FROM string_rows WHERE id IS NOT NULL)",
        "exchanges": f"SELECT source, CASE WHEN {_strip('source')} = '' THEN '' ELSE source END AS translation, CASE WHEN {_strip('source')} = '' THEN 'blank' ELSE 'exhausted' END AS status, CASE WHEN {_strip('source')} = '' THEN 0 ELSE 3 END AS calls FROM {_PLAN}",
        "result_feed": f"SELECT row_idx, source, CASE WHEN {_strip('source')} = '' THEN '' ELSE source END AS translation FROM {_TR}",
        "retrieve_tiered": f"SELECT kw_id, slot::INT AS slot, term, tier, round(score, 6) AS score FROM {_TIERED}",
        "retrieved_terms": f"SELECT term, translation, count(*) AS n_keywords FROM {_TIERED} GROUP BY term, translation",
        "mention_priority": f"SELECT key, term, mentioned, place::INT AS place FROM {_MENTION}",
        "glossary_block": f"SELECT * FROM {_BLOCK}",
        "chat_messages": f"SELECT p.rep_row_idx AS key, 2 AS n_messages, length('Translate.' || coalesce(chr(10) || chr(10) || b.block, ''))::INT AS system_chars, p.source AS user FROM {_PLAN} p LEFT JOIN {_BLOCK} b ON b.key = p.rep_row_idx",
    }


NAMES = tuple(_sql())


def sql() -> dict[str, str]:
    """SQL by query."""
    return _sql()
