"""DuckDB SQL of ``more_queries``."""

from __future__ import annotations

from foliant.plans import oracle as o

_CONTEXT = r"""turns AS (SELECT conv_id, turn, role, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations),
answers AS (SELECT conv_id, turn, answer, context FROM turns WHERE role = 'assistant')"""

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: {o._strip('l')}), lambda l: l <> '')"
_PAGES = "list_transform(range(0, length(text), 1500), lambda i: substring(text, CAST(i + 1 AS BIGINT), 1500))"
_ROWS = f"""chunked AS (SELECT doc_id, source, {o._FORCED} AS c FROM documents), rows AS (SELECT doc_id, source, unnest(c) AS t, unnest(range(len(c))) AS i FROM chunked)"""
_DOCUMENT_ID = "'doc_' || source || '_' || substring(md5(source || ':/corpus/' || doc_id), 1, 8)"
_RECURSIVE = o._recursive(512, 50).rsplit(" SELECT doc_id, len(i)", 1)[0] + ", r AS (SELECT doc_id, unnest(i) AS t, unnest(range(len(i))) AS k FROM made)"


def _values(names: str, *rows: tuple) -> str:
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def _changed(source: str) -> str:
    return f"""SELECT p.query_id, count(*) FILTER (x.label = y.label) AS found, count(*) AS n, min(p.place) FILTER (x.label = y.label) AS first, any_value(z.n) - 1 AS relevant
  FROM {source} p JOIN embeddings x ON x.vec_id = p.query_id JOIN embeddings y ON y.vec_id = p.id JOIN sizes z ON z.label = x.label GROUP BY p.query_id"""


_SHARES = "CASE WHEN {t}.relevant > 0 THEN {t}.found / {t}.relevant::DOUBLE ELSE 0 END AS {t}r, {t}.found / {t}.n::DOUBLE AS {t}p, CAST({t}.found > 0 AS DOUBLE) AS {t}h, coalesce(1.0::DOUBLE / {t}.first, 0) AS {t}m"

SQL: dict[str, str] = {
    "text_files": f"WITH made AS (SELECT doc_id, text, {o._normalized('text', markers=False)} AS t FROM documents) SELECT '/corpus/' || doc_id || '.txt' AS path, md5(t) AS text_md5, length(t) AS char_count, len(string_split(t, chr(10))) AS line_count, length(text) AS original_char_count FROM made",
    "docx_files": f"WITH lines AS (SELECT doc_id, {_LINES} AS p FROM documents), joined AS (SELECT doc_id, p, array_to_string(p, chr(10)) AS t FROM lines) SELECT CAST(doc_id AS VARCHAR) AS path, md5({o._normalized('t', markers=False)}) AS text_md5, len(p) AS paragraph_count, true AS ok FROM joined",
    "pdf_files": f"""WITH cut AS (SELECT doc_id, text, {_PAGES} AS p FROM documents),
sized AS (SELECT doc_id, text, p, list_transform(p, lambda x: length({o._strip('x')})) AS n FROM cut),
rated AS (SELECT *, coalesce(len(list_filter(n, lambda x: x >= 50)) / nullif(len(n), 0)::DOUBLE, 0) AS ratio, len(list_filter(n, lambda x: x >= 50)) < 0.3::DOUBLE * len(p) OR len(p) = 0 AS recognized FROM sized),
made AS (SELECT *, CASE WHEN recognized THEN '[Page 1]' || chr(10) || translate('recognized ' || length(text) || ' characters of a scan, more than fifty in all', '|0l', 'IO1')
  ELSE array_to_string(list_transform(p, lambda x, i: '[Page ' || i || ']' || chr(10) || CASE WHEN n[i] >= 50 THEN {o._normalized('x', markers=False)} ELSE '[No text content]' END), chr(10) || chr(10)) END AS t FROM rated)
SELECT CAST(doc_id AS VARCHAR) AS path, md5(t) AS text_md5, recognized, CASE WHEN recognized THEN 1 ELSE len(p) END AS page_count, CASE WHEN recognized THEN 1.0::DOUBLE ELSE round_even(ratio, 2) END AS text_extraction_ratio,
  CASE WHEN recognized THEN false ELSE list_sum(n[1:3]) / least(3, len(n))::DOUBLE < 50 END AS scanned FROM made""",
    "file_metadata": "SELECT 'documents.parquet' AS source, '.parquet' AS file_type, count(*) AS n, true AS iso FROM documents",
    "chunk_position": f"WITH {_ROWS} SELECT doc_id, i AS chunk_index, (i + 1) || ' of ' || count(*) OVER (PARTITION BY doc_id) AS position FROM rows",
    "document_ids": "SELECT doc_id, 'doc_' || source || '_' || substring(md5(source || ':' || doc_id), 1, 8) AS document_id FROM documents",
    "chunk_metadata": f"""WITH {_ROWS} SELECT source || '_chunk_' || i || '_' || substring(md5(t), 1, 8) AS chunk_id,
  'char_count=' || length(t) || ';chunk_index=' || i || ';document_id=' || {_DOCUMENT_ID} || ';file_path=/corpus/' || doc_id || ';source=' || source || ';system=tests;word_count=' || len({o._tokens('t')}) AS stored FROM rows""",
    "chunk_strategies": " UNION ALL ".join(f"SELECT doc_id, n, '{name}' AS strategy FROM ({o.SQL[source]}) WHERE n > 0" for name, source in (("recursive", "recursive_chunks"), ("sentence", "sentence_chunks"), ("other", "recursive_chunks"))),
    "remote_embed": """WITH asked AS (SELECT conv_id, turn, text, turn % 5 <> 4 AND trim(text) <> '' AS there FROM conversations)
SELECT conv_id, turn, CASE WHEN there THEN CAST(length(text) AS DOUBLE) END AS chars, CASE WHEN there THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS spaces, CAST(CASE WHEN there THEN 3 ELSE -1 END AS BIGINT) AS dimension FROM asked""",
    "remote_answers": f"""WITH {_CONTEXT}, asked AS (SELECT conv_id, turn, answer AS question, context, length('Context:' || chr(10) || '---' || chr(10) || CASE WHEN context IS NULL THEN '' ELSE 'Document 1 (from turn):' || chr(10) || context END || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || answer) AS n FROM answers)
SELECT conv_id, turn, n % 7 NOT IN (3, 5) AS answered, md5(CASE WHEN n % 7 NOT IN (3, 5) THEN 'Be brief.|' || n ELSE 'No answer could be generated. ' || CASE WHEN context IS NULL THEN 0 ELSE 1 END || ' documents were found for: ' || question END) AS answer_md5 FROM asked""",
    "judge_scores": f"""WITH {_CONTEXT}, asked AS (SELECT conv_id, turn, length('Question: which?' || chr(10) || chr(10) || 'Rate each document from 0 to 10 as JSON.' || chr(10) || chr(10) || '[Document 1]' || chr(10) || substring(answer, 1, 500) || chr(10) || chr(10) || '[Document 2]' || chr(10) || substring(context, 1, 500)) AS n FROM answers WHERE context IS NOT NULL)
SELECT conv_id, turn, CASE WHEN n % 2 = 1 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS first, CASE WHEN n % 2 = 1 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS second FROM asked""",
    "listed_answer": f"""WITH {o._RETRIEVED}, asked AS (SELECT docs.* FROM docs JOIN documents q ON q.doc_id = query_id)
SELECT query_id, md5('Based on ' || count(*) || ' retrieved documents:' || chr(10) || string_agg('  ' || rank || '. ' || id || ' (score: N/A) from ' || coalesce(source, 'unknown'), chr(10) ORDER BY rank)) AS answer_md5 FROM asked GROUP BY query_id""",
    "extractive_answers": f"""WITH {o._RETRIEVED}, firsts AS (SELECT query_id, content, q.text AS question, {o._tokens("coalesce(content, '')")} AS w FROM docs JOIN documents q ON q.doc_id = query_id WHERE rank = 1),
cut AS (SELECT query_id, {o._terms('question')} AS qt, {o._SENTENCES} AS s FROM firsts), each AS (SELECT query_id, qt, unnest(s) AS x, unnest(range(len(s))) AS i FROM cut),
judged AS (SELECT query_id, x, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(qt, {o._terms('x')})) DESC, i) AS place FROM each)
SELECT f.query_id, md5(x) AS answer_md5 FROM firsts f LEFT JOIN judged j ON j.query_id = f.query_id AND place = 1""",
    "metric_changes": f"""WITH {o._ASKED}, sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
before AS (SELECT query_id, id, rank AS place FROM asked), after AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS place FROM judged) WHERE place <= 3),
b AS ({_changed('before')}), a AS ({_changed('after')}), shares AS (SELECT query_id, {_SHARES.format(t='b')}, {_SHARES.format(t='a')} FROM b JOIN a USING (query_id))
SELECT query_id, round(ar - br, 9) AS recall_at_k_change, round(ap - bp, 9) AS precision_at_k_change, round(ah - bh, 9) AS hit_rate_change, round(am - bm, 9) AS mrr_change FROM shares""",
    "external_scores": f"""WITH {_CONTEXT}, asked AS (SELECT conv_id || '-' || turn AS query_id, CASE WHEN context IS NULL THEN 0 ELSE 1 END AS c, length(answer) AS n, length(answer) % 11 <> 0 AS success FROM answers)
SELECT query_id, CASE WHEN success THEN CAST(c AS DOUBLE) END AS faithfulness, CASE WHEN success THEN CAST(n AS DOUBLE) END AS answer_relevancy, success, CASE WHEN NOT success THEN 'no score' END AS error, CASE WHEN success THEN (c + n) / 2::DOUBLE END AS overall FROM asked""",
    "evaluation_history": f"WITH {o._EVALUATED} SELECT r.query_id, CAST(2 AS BIGINT) AS n, g.query_id IS NOT NULL AS measured FROM runs r LEFT JOIN ratios g USING (query_id)",
    "context_texts": f"WITH {o._RETRIEVED} SELECT query_id, md5(string_agg(coalesce(content, ''), ' ' ORDER BY rank)) AS context_md5 FROM docs JOIN documents q ON q.doc_id = query_id GROUP BY query_id",
    "point_count": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT state, CAST(times * n AS BIGINT) AS n FROM n, (VALUES ('missing', 0), ('created', 0), ('filled', 1), ('appended', 2), ('dropped', 0)) t(state, times)",
    "collection_lifecycle": _values("step, done", ("exists", False), ("create", True), ("create again", False), ("upsert", True), ("other length", False), ("no collection", False), ("drop", True), ("drop again", True), ("gone", False)),
    "tenant_collections": "SELECT 'rag_tenant' || (label % 3) AS collection, count(*) AS total_points FROM embeddings GROUP BY 1",
    "chunk_stream": f"{_RECURSIVE} SELECT doc_id, source || '_chunk_' || k || '_' || substring(md5(t), 1, 8) AS chunk_id, length(t) AS chars FROM r JOIN documents USING (doc_id)",
    "ingest_stream": f"""{_RECURSIVE} SELECT source || '_chunk_' || k || '_' || substring(md5(t), 1, 8) AS chunk_id, {_DOCUMENT_ID} AS document_id, k AS chunk_index, CAST(n AS BIGINT) AS total_chunks, length(t) AS chars
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM r) JOIN documents USING (doc_id) WHERE len({o._words('t')}) > 0""",
    "bucketed_merge": """SELECT CAST(a.vec_id AS VARCHAR) AS doc_id, 'v' || a.vec_id || CASE WHEN a.label = 1 THEN '!' ELSE '' END AS text, CAST(a.label AS BIGINT) AS label FROM embeddings a
LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1 AND b.label = 2 WHERE a.label <> 3 AND NOT (a.label = 2 AND a.vec_id % 2 = 1 AND b.vec_id IS NOT NULL)""",
    "typed_search": """WITH scored AS (SELECT a.vec_id AS query_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON b.label = 2 AND b.vec_id % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM scored) SELECT query_id, rank, round(score, 6) AS score, CAST(2 AS BIGINT) AS label, true AS even, true AS same FROM ranked WHERE rank <= 3""",
    "judge_rerank": f"""WITH {o._ASKED}, judge AS (SELECT query_id, rank, id, {o._strip('question')} = '' AS blank, length(question) % 7 = 3 AS failed,
  CASE WHEN {o._strip('question')} = '' THEN NULL WHEN length(question) % 7 = 3 THEN 0.5::DOUBLE ELSE length(substring(coalesce(content, ''), 1, 500)) % 11 / 10::DOUBLE END AS v FROM asked),
placed AS (SELECT query_id, id, v, row_number() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST, rank) AS place FROM judge WHERE blank OR failed OR v >= 0.3::DOUBLE)
SELECT query_id, place AS rank, id, round(least(v, 1.0::DOUBLE), 9) AS rerank_score FROM placed WHERE place <= 3""",
    "evaluate_external": f"""WITH {_CONTEXT}, asked AS (SELECT conv_id || '-' || turn AS query_id, answer, context, context IS NOT NULL AND answer <> '' AS there, length(answer) AS n FROM answers)
SELECT query_id, CASE WHEN there AND n % 11 <> 0 THEN (1 + n) / 2::DOUBLE END AS overall, CASE WHEN there THEN n % 11 <> 0 END AS success, CASE WHEN context IS NOT NULL THEN 0.5::DOUBLE END AS avg_score, there AS measured FROM asked""",
    "semantic_chunks_once": o.SQL["semantic_chunks"],
    "passage_hits": f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len({o._tokens('b.text')}) > 0",
    "ingest_status": f"""{_RECURSIVE}, counted AS (SELECT doc_id, count(*) AS n, count(*) FILTER (len({o._words('t')}) = 0) AS lost FROM r GROUP BY doc_id)
SELECT source AS document_name, {_DOCUMENT_ID} AS document_id, coalesce(n, 0) AS chunk_count, {o._strip('text')} <> '' AND coalesce(lost, 0) = 0 AS success FROM documents LEFT JOIN counted USING (doc_id)""",
}
