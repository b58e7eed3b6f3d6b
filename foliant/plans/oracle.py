"""The same results in DuckDB SQL."""

from __future__ import annotations

from foliant.functions.sentences import LITERAL_ABBREVIATIONS, TOKEN_ABBREVIATIONS
from foliant.functions.terms import STOP_WORDS
from foliant.operators.chunking import SEPARATORS


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"


def _terms(x: str) -> str:
    return f"list_distinct(list_filter({_words(x)}, lambda w: length(w) >= 4 AND NOT list_contains({_list(STOP_WORDS)}, w)))"


def _digest(x: str) -> str:
    return f"md5(array_to_string({x}, chr(31)))"


def _items(x: str, source: str = "documents") -> str:
    return f"WITH made AS (SELECT doc_id, {x} AS i FROM {source}) SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made"


_SENTENCES = rf"""list_filter(regexp_split_to_array(array_to_string(list_transform(w, lambda x, i:
  CASE WHEN regexp_matches(regexp_replace(x, '[)"'']+$', ''), '[.!?。！？]$')
    AND NOT list_contains({_list(TOKEN_ABBREVIATIONS)}, lower(regexp_replace(x, '[.)!?]+$', '')))
    AND NOT (length(regexp_replace(x, '\.+$', '')) = 1 AND ends_with(x, '.'))
    AND NOT (regexp_full_match(x, '\d+\.') AND coalesce(regexp_matches(w[i + 1], '^\d'), false))
  THEN x || chr(30) ELSE x END), ' '), '\x1e ?'), lambda s: s <> '')"""
_WITH_SENTENCES = f"words AS (SELECT doc_id, text, {_tokens('text')} AS w FROM documents), sentences AS (SELECT doc_id, text, w, {_SENTENCES} AS s FROM words)"


def _pattern(x: str) -> str:
    for word in LITERAL_ABBREVIATIONS:
        x = f"replace({x}, '{word}', '{word.replace('.', chr(31))}')"
    split = rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30))"
    return f"list_filter(list_transform({split}, lambda s: {_strip('replace(s, chr(31), chr(46))')}), lambda s: s <> '')"


_EMPTY = "{'done': []::VARCHAR[], 'open': ''}"


def _packed(items: str, size: int, v: str = "s") -> str:
    joined = f"CASE WHEN {v}.open = '' THEN x ELSE {v}.open || ' ' || x END"
    fold = f"list_reduce({items}, lambda {v}, x: CASE WHEN length({joined}) <= {size} THEN {{'done': {v}.done, 'open': {joined}}} ELSE {{'done': CASE WHEN {v}.open = '' THEN {v}.done ELSE list_append({v}.done, {v}.open) END, 'open': x}} END, {_EMPTY})"
    return fold


def _closed(state: str) -> str:
    return f"CASE WHEN {state}.open = '' THEN {state}.done ELSE list_append({state}.done, {state}.open) END"


_FORCED = f"list_filter(list_transform(range(0, length(text), 512), lambda i: {_strip('substring(text, CAST(i + 1 AS BIGINT), 512)')}), lambda c: c <> '')"

_NEAREST = """scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label, a.label AS own_label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {where}
), hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k})"""


def _nearest(where: str = "", k: int = 5) -> str:
    return _NEAREST.format(where=where, k=k)


_RETRIEVED = f"{_nearest()}, docs AS (SELECT h.query_id, h.rank, h.vec_id AS id, h.score, d.text AS content, d.source FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id)"
_METRICS = f"""{_nearest()}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
per AS (SELECT query_id, any_value(own_label) AS own_label, count(*) AS num_retrieved, count(*) FILTER (label = own_label) AS found, min(rank) FILTER (label = own_label) AS first FROM hits GROUP BY query_id),
metrics AS (SELECT query_id, CASE WHEN n > 1 THEN found / (n - 1) ELSE 0 END AS recall_at_k, found / num_retrieved AS precision_at_k, CAST(found > 0 AS DOUBLE) AS hit_rate,
  coalesce(1.0::DOUBLE / first, 0) AS mrr, num_retrieved, n - 1 AS num_relevant, found AS num_relevant_retrieved FROM per JOIN sizes ON label = own_label)"""
_METRIC_COLUMNS = "round(recall_at_k::DOUBLE, 9) AS recall_at_k, round(precision_at_k::DOUBLE, 9) AS precision_at_k, hit_rate, round(mrr, 9) AS mrr"
_STATS = """SELECT query_id, count(*) AS num_retrieved, round(avg(score), 9) AS avg_score, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(stddev_pop(score), 9) AS score_std, true AS has_scores FROM hits GROUP BY query_id"""

_ASKED = f"""{_RETRIEVED}, asked AS (SELECT docs.*, q.text AS question, {_terms('q.text')} AS qt, {_terms('substring(content, 1, 500)')} AS ct FROM docs JOIN documents q ON q.doc_id = query_id),
judged AS (SELECT *, CASE WHEN trim(question) = '' THEN NULL WHEN len(qt) = 0 THEN 0.5 ELSE len(list_intersect(qt, ct)) / len(qt)::DOUBLE END AS s FROM asked)"""


def _lines(x: str, per_line: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {per_line}), chr(10))"


def _normalized(x: str, markers: bool = True) -> str:
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\p{{Cf}}|\p{{Co}}', '', 'g')"
    x = _lines(x, _strip("l"))
    if markers:
        x = rf"regexp_replace({x}, '(?im)^\s*\[?(?:page|p\.?)\s*\d+\s*\]?\s*$', '', 'g')"
        x = rf"regexp_replace({x}, '(?m)^\s*\d{{1,4}}\s*$', '', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = _lines(x, _strip("l"))
    x = rf"regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(x)


_HEADERS = "text"
for _p in (r"(?im)^\s*(?:confidential|draft|internal)\s*$", r"(?im)^\s*(?:copyright|©)\s*\d{4}.*$", r"(?im)^\s*\d+\s*of\s*\d+\s*$"):
    _HEADERS = f"regexp_replace({_HEADERS}, '{_p}', '', 'g')"

_GEN = f"""turns AS (SELECT conv_id, turn, role, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations),
answers AS (SELECT * FROM turns WHERE role = 'assistant')"""


def _generation(source: str, keys: str) -> str:
    return f"""terms AS (SELECT {keys}, answer, context, {_terms('answer')} AS a_terms, {_terms("coalesce(context, '')")} AS ct, {_words('answer')} AS aw, {_words("coalesce(context, '')")} AS cw FROM {source}),
grams AS (SELECT *, list_distinct(list_transform(range(1, len(aw)), lambda i: aw[i] || ' ' || aw[i + 1])) AS ab, list_distinct(list_transform(range(1, len(cw)), lambda i: cw[i] || ' ' || cw[i + 1])) AS cb FROM terms),
parts AS (SELECT *, len(list_intersect(a_terms, ct)) AS shared, len(list_intersect(ab, cb)) AS gshared, trim(answer) = '' OR coalesce(trim(context), '') = '' AS blank FROM grams),
faithful AS (SELECT *, CASE WHEN blank THEN 0 WHEN len(a_terms) = 0 THEN 1 WHEN len(ab) > 0 THEN 0.6::DOUBLE * (shared / len(a_terms)::DOUBLE) + 0.4::DOUBLE * (gshared / len(ab)::DOUBLE) ELSE shared / len(a_terms)::DOUBLE END AS f FROM parts),
measured AS (SELECT {keys}, f AS faithfulness_score, CASE WHEN blank THEN 0 WHEN len(ct) = 0 THEN 1 ELSE shared / len(ct)::DOUBLE END AS context_coverage,
  CASE WHEN context IS NULL OR len(a_terms) = 0 THEN 1 - f ELSE least(1, 0.5::DOUBLE * (1 - f) + 0.5::DOUBLE * ((len(a_terms) - shared) / len(a_terms)::DOUBLE)) END AS hallucination_risk,
  length({_strip('answer')}) AS answer_length, len({_tokens('answer')}) AS answer_word_count,
  len(list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda x: {_strip('x')} <> '')) AS answer_sentence_count,
  length({_strip("coalesce(context, '')")}) AS context_length, shared AS key_terms_in_answer, len(ct) AS total_key_terms FROM faithful),
ratios AS (SELECT *, CASE WHEN context_length > 0 THEN answer_length / context_length::DOUBLE ELSE 0 END AS context_utilization_ratio FROM measured)"""


_GEN_ROUNDED = ", ".join(f"round({m}::DOUBLE, 9) AS {m}" for m in ("faithfulness_score", "context_coverage", "hallucination_risk", "context_utilization_ratio"))
_CHUNKED = f"""chunked AS (SELECT doc_id, source, {_FORCED} AS c FROM documents), rows AS (SELECT doc_id, source, unnest(c) AS t, unnest(range(len(c))) AS i FROM chunked),
made AS (SELECT doc_id, source || '_chunk_' || i || '_' || substring(md5(t), 1, 8) AS chunk_id, 'doc_' || source || '_' || substring(md5(source || ':/corpus/' || doc_id), 1, 8) AS document_id, length(t) AS char_count, len({_tokens('t')}) AS word_count FROM rows)"""

_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')"


def _html() -> str:
    x = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for name in ("script", "style", "head", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<![a-z][^>]*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)</?(?:meta|link)\b[^>]*>', '', 'g')"
    x = rf"regexp_replace({x}, '[ \t\r\n]+', ' ', 'g')"
    blocks = "p|div|h1|h2|h3|h4|h5|h6|li|tr|td|th|article|section|header|footer|nav|aside|blockquote|pre|br|hr"
    x = rf"regexp_replace({x}, '(?is)\s*</?(?:{blocks})\b[^>]*>\s*', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<[a-z/][^>]*>', ' ', 'g')"
    return _normalized(_entities(x), markers=False)


def _entities(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _recursive(size: int, overlap: int) -> str:
    """One step for each separator; a step cuts and packs what is still too long."""
    steps, before = ["l0 AS (SELECT doc_id, text, [text] AS c FROM documents)"], "l0"
    kept = f"CASE WHEN length(s.open) <= {size} THEN {_strip('s.open')} ELSE s.open END"
    flushed = f"CASE WHEN {_strip('s.open')} = '' THEN s.done ELSE list_append(s.done, {kept}) END"
    for k, separator in enumerate(SEPARATORS, 1):
        mark = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separator)
        pieces = f"list_transform(string_split(p, {mark}), lambda y, i: CASE WHEN i = 1 THEN y ELSE {mark} || y END)"
        fold = f"list_reduce({pieces}, lambda s, x: CASE WHEN length(s.open) + length(x) <= {size} THEN {{'done': s.done, 'open': s.open || x}} ELSE {{'done': {flushed}, 'open': x}} END, {_EMPTY})"
        end = f"list_transform([{fold}], lambda s: {flushed})[1]"
        steps.append(f"l{k} AS (SELECT doc_id, text, flatten(list_transform(c, lambda p: CASE WHEN length(p) <= {size} THEN [p] ELSE {end} END)) AS c FROM {before})")
        before = f"l{k}"
    forced = f"list_filter(list_transform(range(0, length(p), {size}), lambda i: {_strip(f'substring(p, CAST(i + 1 AS BIGINT), {size})')}), lambda x: x <> '')"
    steps.append(f"pieces AS (SELECT doc_id, text, flatten(list_transform(c, lambda p: CASE WHEN length(p) <= {size} THEN [p] ELSE {forced} END)) AS c FROM {before})")
    lapped = f"list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x ELSE {_strip(f"right(c[i - 1], {overlap}) || ' ' || x")} END)"
    steps.append(f"made AS (SELECT doc_id, CASE WHEN {_strip('text')} = '' THEN [] WHEN length(text) <= {size} THEN [text] ELSE {lapped} END AS i FROM pieces)")
    return f"WITH {', '.join(steps)} SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made"


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to the value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _grouped(q: str, most: int) -> str:
    """Sentences packed; those that are too long are packed by words and stand alone."""
    words = _bound("v", _packed(_tokens("y"), most, "v"), _closed("v"))
    items = f"flatten(list_transform({q}, lambda y: CASE WHEN length(y) > {most} THEN list_transform({words}, lambda t: {{'t': t, 'alone': true}}) ELSE [{{'t': y, 'alone': false}}] END))"
    joined = "CASE WHEN s.open = '' THEN x.t ELSE s.open || ' ' || x.t END"
    fold = f"list_reduce({items}, lambda s, x: CASE WHEN NOT x.alone AND length({joined}) <= {most} THEN {{'done': s.done, 'open': {joined}}} WHEN x.alone THEN {{'done': list_append({_closed('s')}, x.t), 'open': ''}} ELSE {{'done': {_closed('s')}, 'open': x.t}} END, {_EMPTY})"
    return _bound("f", fold, _closed("f"))


def _merged(chunks: str, least: int, most: int) -> str:
    """Small chunks merged forward, and a small last one backward."""
    both, tail = "s.open || ' ' || x", "m.done[len(m.done)] || ' ' || m.open"
    fold = f"list_reduce({chunks}, lambda s, x: CASE WHEN s.open IS NULL THEN {{'done': s.done, 'open': x}} WHEN length(s.open) < {least} AND length({both}) <= {most} THEN {{'done': s.done, 'open': {both}}} ELSE {{'done': list_append(s.done, s.open), 'open': x}} END, {{'done': []::VARCHAR[], 'open': NULL::VARCHAR}})"
    end = f"CASE WHEN m.open IS NULL THEN m.done WHEN len(m.done) > 0 AND length(m.open) < {least} AND length({tail}) <= {most} THEN list_append(m.done[1:len(m.done) - 1], {tail}) ELSE list_append(m.done, m.open) END"
    return _bound("m", fold, end)


def _long(w: str) -> str:
    return f"list_filter({_bound('w', w, _SENTENCES)}, lambda x: length({_strip('x')}) > 10)"


def _by_words(w: str, most: int) -> str:
    return _bound("v", _packed(w, most, "v"), _closed("v"))


def _semantic(least: int, most: int, threshold: float | None, dims: int = 256) -> str:
    """The fallback strategy, or with a threshold the semantic one over hashed term vectors."""
    whole = f"CASE WHEN length(t) <= {most} THEN CASE WHEN t = '' THEN [] ELSE [t] END"
    fallback = f"CASE WHEN len(q) = 0 THEN {_by_words(_tokens('t'), most)} ELSE {_merged(_grouped('q', most), least, most)} END"
    head = f"long AS (SELECT doc_id, {_strip('text')} AS t, {_long(_tokens('text'))} AS q FROM documents)"
    if threshold is None:
        made = f"made AS (SELECT doc_id, {whole} ELSE {fallback} END AS i FROM long)"
        return f"WITH {head}, {made} SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made"
    buckets = f"list_transform({_words('y')}, lambda u: CAST(('0x' || substring(md5(u), 1, 8)) AS BIGINT) % {dims})"
    counts = _bound("p", buckets, f"list_transform(range({dims}), lambda i: CAST(len(list_filter(p, lambda x: x = i)) AS DOUBLE))")
    vector = _bound("c", counts, "CASE WHEN list_sum(c) > 0 THEN list_transform(c, lambda x: CAST(CAST(x / sqrt(list_sum(list_transform(c, lambda z: z * z))) AS FLOAT) AS DOUBLE)) END")
    dot = lambda a, b: f"list_sum(list_transform(range(1, {dims} + 1), lambda k: {a}[k] * {b}[k]))"
    cosine = f"{dot('vs[i - 1]', 'vs[i]')} / (sqrt({dot('vs[i - 1]', 'vs[i - 1]')}) * sqrt({dot('vs[i]', 'vs[i]')}))"
    marked = f"list_transform(q, lambda y, i: CASE WHEN i > 1 AND {cosine} < {threshold}::DOUBLE THEN chr(30) || y ELSE y END)"
    runs = rf"list_filter(list_transform(regexp_split_to_array(array_to_string({marked}, ' '), ' ?\x1e'), lambda x: {_strip('x')}), lambda x: x <> '')"
    bounded = f"CASE WHEN length(c) <= {most} THEN [c] ELSE {_bound('o', _long(_tokens('c')), f'CASE WHEN len(o) <= 1 THEN {_by_words(_tokens(chr(99)), most)} ELSE {_grouped(chr(111), most)} END')} END"
    parts = f"CASE WHEN len(q) <= 2 THEN [t] WHEN len(list_filter(vs, lambda x: x IS NULL)) > 0 THEN {fallback} ELSE {_merged('g', least, most)} END"
    return f"""WITH {head}, vectors AS (SELECT doc_id, t, q, list_transform(q, lambda y: {vector}) AS vs FROM long),
runs AS (SELECT doc_id, t, q, vs, CASE WHEN length(t) > {most} AND len(list_filter(vs, lambda x: x IS NULL)) = 0 THEN {runs} ELSE [] END AS r FROM vectors),
bounded AS (SELECT doc_id, t, q, vs, flatten(list_transform(r, lambda c: {bounded})) AS g FROM runs),
made AS (SELECT doc_id, {whole} ELSE {parts} END AS i FROM bounded) SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made"""


SQL: dict[str, str] = {
    "knn_topk": f"WITH {_nearest()} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM hits",
    "knn_pruned": f"WITH {_nearest()} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM hits",
    "knn_filtered": f"WITH {_nearest('WHERE b.label = 3')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM hits",
    "cosine_pairs": "WITH p AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(list_cosine_similarity(b::DOUBLE[], embedding::DOUBLE[]), 6) AS similarity FROM p WHERE b IS NOT NULL",
    "retrieve_context": f"""WITH {_RETRIEVED}, blocks AS (SELECT *, 'Document ' || rank || ' (from ' || coalesce(source, 'unknown') || '):' || chr(10) || coalesce(content, '') AS b FROM docs),
firsts AS (SELECT query_id, coalesce(source, 'unknown_source') AS source, min(rank) AS r FROM docs GROUP BY ALL),
names AS (SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources FROM firsts GROUP BY query_id),
contexts AS (SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY query_id)
SELECT query_id, length(context) AS context_chars, md5(context) AS context_md5, sources FROM contexts JOIN names USING (query_id)""",
    "ordered_sources": f"""WITH {_RETRIEVED}, firsts AS (SELECT query_id, coalesce(source, 'unknown_source') AS source, min(rank) AS r FROM docs GROUP BY ALL)
SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources, count(*) AS n FROM firsts GROUP BY query_id""",
    "semantic_segments": """WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label, vec_id, CASE WHEN b IS NOT NULL AND round(list_cosine_similarity(b::DOUBLE[], embedding::DOUBLE[]), 9) < 0 THEN 1 ELSE 0 END AS cut FROM p),
s AS (SELECT label, vec_id, CAST(sum(cut) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS segment FROM c)
SELECT label, segment, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM s GROUP BY label, segment""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT query_id, {_METRIC_COLUMNS}, CAST(5 AS BIGINT) AS k, num_retrieved, num_relevant, num_relevant_retrieved FROM metrics",
    "retrieval_metrics_avg": f"WITH {_METRICS} SELECT round(avg(recall_at_k), 9) AS recall_at_k, round(avg(precision_at_k), 9) AS precision_at_k, round(avg(hit_rate), 9) AS hit_rate, round(avg(mrr), 9) AS mrr, count(*) AS num_queries FROM metrics",
    "metric_report": f"""WITH {_METRICS}, best AS (SELECT query_id, round(max(score), 6) AS best FROM hits GROUP BY query_id),
q AS (SELECT m.*, best, 'rag_tenant' || (e.label % 3) AS tenant, d.source FROM metrics m JOIN best b ON b.query_id = m.query_id JOIN embeddings e ON e.vec_id = m.query_id LEFT JOIN documents d ON d.doc_id = m.query_id)
SELECT CASE grouping(tenant, source) WHEN 0 THEN 'all keys' WHEN 1 THEN 'tenant' WHEN 2 THEN 'source' ELSE 'total' END AS level, tenant, source, count(*) AS queries, count(*) FILTER (hit_rate = 0) AS misses,
  round(avg(recall_at_k), 9) AS recall_at_k, round(avg(precision_at_k), 9) AS precision_at_k, round(avg(hit_rate), 9) AS hit_rate, round(avg(mrr), 9) AS mrr, count(best) AS scored, min(best) AS score_min, max(best) AS score_max
FROM q GROUP BY GROUPING SETS ((tenant, source), (tenant), (source), ())""",
    "retrieval_stats": f"WITH {_nearest()} {_STATS}",
    "rerank_topk": f"""WITH {_ASKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS place FROM judged WHERE s IS NULL OR s >= 0.05)
SELECT query_id, place AS rank, id, round(s, 9) AS rerank_score FROM placed WHERE place <= 3""",
    "rerank_impact": f"""WITH {_ASKED}, after AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS place FROM judged) WHERE place <= 3)
SELECT j.query_id, bool_or(a2.id IS DISTINCT FROM j.id) AS order_changed, round(count(a1.id) / count(*)::DOUBLE, 9) AS overlap_ratio, CAST(coalesce(sum(abs(a1.place - j.rank)), 0) AS BIGINT) AS position_changes
FROM judged j LEFT JOIN after a1 ON a1.query_id = j.query_id AND a1.id = j.id LEFT JOIN after a2 ON a2.query_id = j.query_id AND a2.place = j.rank GROUP BY j.query_id""",
    "parse_scores": """WITH t AS (SELECT conv_id, turn, conv_id % 5 AS shape, least(length(coalesce(text, '')) % 13 / 10::DOUBLE, 1) AS a, (turn % 10 + 0.5::DOUBLE) / 10 AS b FROM conversations)
SELECT conv_id, turn, d AS document, round(CASE WHEN d = 1 AND shape < 4 THEN a WHEN d = 2 AND shape < 3 THEN b ELSE 0.5::DOUBLE END, 9) AS score FROM t, (VALUES (CAST(1 AS BIGINT)), (2)) v(d)""",
    "key_terms": _items(f"list_sort({_terms('text')})"),
    "bigrams": f"WITH words AS (SELECT doc_id, {_words('text')} AS u FROM documents), made AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]))) AS i FROM words) SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made",
    "sentences": f"WITH {_WITH_SENTENCES} SELECT doc_id, len(s) AS n, {_digest('s')} AS items_md5 FROM sentences",
    "pattern_sentences": _items(_pattern("text")),
    "sentence_chunks": f"""WITH parts AS (SELECT doc_id, text, {_pattern('text')} AS p FROM documents), folded AS (SELECT doc_id, text, p, {_packed('p', 512)} AS f FROM parts),
chunks AS (SELECT doc_id, text, p, {_closed('f')} AS c FROM folded),
tails AS (SELECT doc_id, text, p, c, list_transform(c, lambda x: right(x, 50)) AS t FROM chunks),
lapped AS (SELECT doc_id, CASE WHEN length(text) <= 512 OR len(c) = 0 THEN CASE WHEN {_strip('text')} = '' THEN [] ELSE [{_strip('text')}] END
  ELSE list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x ELSE {_strip("'...' || CASE WHEN length(c[i - 1]) < 50 THEN c[i - 1] WHEN position(' ' IN t[i - 1]) > 1 THEN regexp_replace(substring(t[i - 1], position(' ' IN t[i - 1])), '^" + chr(92) + "s+|" + chr(92) + "s+$', '', 'g') ELSE t[i - 1] END || ' ' || x")} END) END AS i FROM tails)
SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM lapped""",
    "recursive_chunks": _recursive(512, 50),
    "fallback_chunks": _semantic(100, 1000, None),
    "semantic_chunks": _semantic(100, 1000, 0.75),
    "forced_chunks": _items(_FORCED),
    "chunk_overlap": f"WITH forced AS (SELECT doc_id, {_FORCED} AS c FROM documents), made AS (SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN i = 1 THEN x ELSE {_strip(chr(114) + 'ight(c[i - 1], 50) || ' + chr(39) + ' ' + chr(39) + ' || x')} END) AS i FROM forced) SELECT doc_id, len(i) AS n, {_digest('i')} AS items_md5 FROM made",
    "paragraph_starts": r"""WITH parts AS (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}') AS p, regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '\n{2,}') AS g FROM documents),
made AS (SELECT doc_id, list_transform(range(0, len(g) + 1), lambda i: CAST(CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) AS BIGINT) AS VARCHAR)) AS i FROM parts)
SELECT doc_id, len(i) AS n, md5(array_to_string(i, chr(31))) AS items_md5 FROM made""",
    "normalize_text": f"WITH made AS (SELECT doc_id, {_normalized('text')} AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM made",
    "page_markers": f"WITH more AS (SELECT doc_id, text || chr(10) || 'Page 3' || chr(10) || '[Page 12]' || chr(10) || ' 17 ' || chr(10) || 'p. 4' || chr(10) || 'the end' || chr(10) AS text FROM documents) SELECT doc_id, md5({_normalized('text')}) AS text_md5 FROM more",
    "drop_repeated_lines": f"""WITH lines AS (SELECT doc_id, string_split({_HEADERS}, chr(10)) AS l FROM documents), each AS (SELECT doc_id, {_strip('unnest(l)')} AS x FROM lines),
many AS (SELECT doc_id, list(x) AS r FROM (SELECT doc_id, x FROM each WHERE length(x) >= 3 AND length(x) < 50 GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id)
SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT list_contains(coalesce(r, []), {_strip('x')})), chr(10))) AS text_md5 FROM lines LEFT JOIN many USING (doc_id)""",
    "ocr_repair": "SELECT doc_id, md5(replace(translate(text, '|0l—–' || chr(173) || chr(8203) || chr(65279), 'IO1--'), '…', '...')) AS text_md5 FROM documents",
    "answer_length": f"SELECT doc_id, length({_strip('text')}) AS chars, len({_tokens('text')}) AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: {_strip('x')} <> '')) AS sentences FROM documents",
    "reading_complexity": rf"""WITH {_WITH_SENTENCES}, sized AS (SELECT doc_id, len(w) AS n, len(s) AS m, list_transform(w, lambda x: length(regexp_replace(x, '^[.,!?;:"''\-()\[\]{{}}]+|[.,!?;:"''\-()\[\]{{}}]+$', '', 'g'))) AS z FROM sentences),
each AS (SELECT doc_id, coalesce(list_sum(z) / nullif(n, 0)::DOUBLE, 0) AS a, coalesce(n / nullif(m, 0)::DOUBLE, 0) AS b, coalesce(len(list_filter(z, lambda x: x > 6)) / nullif(n, 0)::DOUBLE, 0) AS c FROM sized)
SELECT doc_id, round(a, 9) AS avg_word_length, round(b, 9) AS avg_sentence_length, round(c, 9) AS long_word_ratio, round(least(1::DOUBLE, a / 10 * 0.3::DOUBLE + b / 30 * 0.3::DOUBLE + c * 0.4::DOUBLE), 9) AS complexity_score FROM each""",
    "chunk_ids": f"WITH {_CHUNKED} SELECT chunk_id, document_id, char_count, word_count FROM made",
    "document_totals": f"WITH {_CHUNKED} SELECT document_id, count(*) AS total_chunks, CAST(sum(char_count) AS BIGINT) AS total_chars, CAST(sum(word_count) AS BIGINT) AS total_words FROM made GROUP BY document_id",
    "metadata_merge": "SELECT doc_id, source, lang AS type, CAST(3 AS BIGINT) AS n FROM documents",
    "embed_texts": rf"""WITH words AS (SELECT conv_id, turn, text, list_transform({_words('text')}, lambda w: CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64) AS p FROM conversations),
counts AS (SELECT conv_id, turn, list_transform(range(64), lambda i: CAST(len(list_filter(p, lambda x: x = i)) AS DOUBLE)) AS c FROM words),
lengths AS (SELECT conv_id, turn, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM counts)
SELECT conv_id, turn, CASE WHEN n > 0 THEN round(list_sum(list_transform(c, lambda x, i: CAST(CAST(x / n AS FLOAT) AS DOUBLE) * i)), 4) END AS weighted FROM lengths""",
    "html_title": f"SELECT page_id, nullif({_entities(_TITLE)}, '') AS title FROM pages",
    "html_text": f"WITH made AS (SELECT page_id, {_html()} AS t FROM pages) SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM made",
    "file_router": r"""WITH paths AS (SELECT page_id, url || ['.TXT', '.md', '.html', '.docx', '.exe'][page_id % 5 + 1] AS path FROM pages), e AS (SELECT page_id, lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) AS extension FROM paths)
SELECT page_id, extension, CASE WHEN extension IN ('.txt', '.text', '.md', '.markdown') THEN 'text' WHEN extension IN ('.html', '.htm') THEN 'html' WHEN extension = '.pdf' THEN 'pdf' WHEN extension = '.docx' THEN 'docx' END AS reader FROM e""",
    "tenant_lookup": "SELECT tenant, CAST(count(*) AS BIGINT) AS n FROM documents JOIN (VALUES ('src0', 'zeta'), ('src1', 'beta:two'), ('src2', 'acme')) t(k, tenant) ON k = source GROUP BY tenant",
    "generation_metrics": f"WITH {_GEN}, {_generation('answers', 'conv_id, turn')} SELECT conv_id, turn, {_GEN_ROUNDED}, answer_length, answer_word_count, answer_sentence_count, context_length, key_terms_in_answer, total_key_terms FROM ratios",
    "generation_metrics_avg": f"WITH {_GEN}, {_generation('answers', 'conv_id, turn')} SELECT round(avg(faithfulness_score), 9) AS avg_faithfulness_score, round(avg(context_coverage), 9) AS avg_context_coverage, round(avg(hallucination_risk), 9) AS avg_hallucination_risk, round(avg(answer_length), 9) AS avg_answer_length, round(avg(answer_word_count), 9) AS avg_answer_word_count, count(*) AS num_answers FROM ratios",
    "upsert_merge": "SELECT CAST(vec_id AS VARCHAR) AS doc_id, 'v' || vec_id || CASE WHEN label % 2 = 1 THEN '!' ELSE '' END AS text, CAST(label AS VARCHAR) AS label FROM embeddings",
    "delete_points": "SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY label",
    "collection_info": "SELECT 'parquet' AS provider, 'c' AS collection, CAST(64 AS INTEGER) AS dimension, count(*) AS total_points, 'ready' AS status, 'cosine' AS metric FROM embeddings",
    "collection_search": f"""WITH scored AS (SELECT a.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON b.label = 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM scored) SELECT query_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 3""",
    "event_windows": "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, max(value) AS most FROM events GROUP BY ALL",
    "chunk_offsets": f"""WITH forced AS (SELECT doc_id, text, {_FORCED} AS c FROM documents),
folded AS (SELECT doc_id, list_reduce(c, lambda s, x: {{'done': list_append(s.done, {{'i': len(s.done), 'a': CASE WHEN position(x IN substring(text, s.at + 1)) > 0 THEN s.at + position(x IN substring(text, s.at + 1)) - 1 ELSE s.at END, 'n': length(x)}}),
  'at': CASE WHEN position(x IN substring(text, s.at + 1)) > 0 THEN s.at + position(x IN substring(text, s.at + 1)) ELSE s.at + 1 END}}, {{'done': []::STRUCT(i BIGINT, a BIGINT, n BIGINT)[], 'at': 0::BIGINT}}) AS f FROM forced),
rows AS (SELECT doc_id, unnest(f.done) AS r FROM folded) SELECT doc_id, r.i AS index, r.a AS start_char, r.a + r.n AS end_char FROM rows""",
}
_EVALUATED = f"""{_METRICS}, stats AS (SELECT query_id, avg(score) AS avg_score FROM hits GROUP BY query_id),
ctx AS (SELECT h.query_id, string_agg(coalesce(d.text, ''), ' ' ORDER BY h.rank) AS context FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id JOIN documents q ON q.doc_id = h.query_id GROUP BY h.query_id),
runs AS (SELECT q.doc_id AS query_id, q.text AS answer FROM documents q JOIN embeddings e ON e.vec_id = q.doc_id),
both_ AS (SELECT query_id, answer, context FROM runs JOIN ctx USING (query_id) WHERE answer <> ''), {_generation('both_', 'query_id')},
flat AS (SELECT r.query_id, m.recall_at_k::DOUBLE AS recall_at_k, m.precision_at_k::DOUBLE AS precision_at_k, m.hit_rate, m.mrr, s.avg_score, g.faithfulness_score::DOUBLE AS faithfulness_score, g.context_coverage::DOUBLE AS context_coverage, g.hallucination_risk::DOUBLE AS hallucination_risk, g.context_utilization_ratio::DOUBLE AS context_utilization_ratio
  FROM runs r LEFT JOIN metrics m USING (query_id) LEFT JOIN stats s USING (query_id) LEFT JOIN ratios g USING (query_id))"""
_FLAT = ("recall_at_k", "precision_at_k", "hit_rate", "mrr", "avg_score", "faithfulness_score", "context_coverage", "hallucination_risk", "context_utilization_ratio")
SQL["evaluate_runs"] = f"WITH {_EVALUATED} SELECT query_id, {', '.join(f'round({c}, 9) AS {c}' for c in _FLAT)} FROM flat"
SQL["evaluation_summary"] = f"WITH {_EVALUATED} SELECT count(*) AS num_evaluations, {', '.join(f'round(avg({c}), 9) AS ' + (c if c.startswith('avg') else 'avg_' + c) for c in _FLAT)} FROM flat"
