"""The queries of queries.py in DuckDB SQL."""

from __future__ import annotations

from tessera import fixed
from tessera.functions import query as Q
from tessera.plans import queries as P


def sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = ", ".join(map(sql, fixed.STOPWORDS))
BLANKED = r"regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g')"
LETTERS = r"[a-zA-Z0-9\x{0900}-\x{097F}\x{0C00}-\x{0C7F}]+"
KEPT = f"length(term) BETWEEN {fixed.MIN_TOKEN} AND {fixed.MAX_TOKEN} AND term NOT IN ({STOP})"
TOKENS = f"""
found AS (SELECT doc_id, regexp_extract_all({BLANKED}, '{LETTERS}') AS parts FROM documents),
spread AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM found),
every AS (SELECT doc_id, pos, CASE WHEN length(part) = strlen(part) THEN lower(part) ELSE part END AS term FROM spread),
tok AS (SELECT * FROM every WHERE {KEPT})"""
SEARCHED = r"(length(term) >= 5 OR NOT regexp_full_match(term, '\d+'))"
INDEX = f"""{TOKENS},
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, log10((SELECT count(*) FROM documents) / count(*)::DOUBLE) AS idf FROM post GROUP BY term),
len AS (SELECT doc_id, sum(tf) AS length FROM post GROUP BY doc_id),
wgt AS (SELECT term, doc_id, tf, tf::DOUBLE / length * idf AS weight FROM post JOIN voc USING (term) JOIN len USING (doc_id)),
nrm AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM wgt GROUP BY doc_id)"""


def vector_rows(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return ", ".join(f"({sql(t)}, {w / total!r}::DOUBLE)" for t, w in weights.items())


def ranked(weights: dict[str, float], name: str = "cos") -> str:
    """CTEs: name (doc_id, score) is the cosine of every document with a positive one."""
    return f"""{name}_q AS (SELECT term, w * idf AS q FROM (VALUES {vector_rows(weights)}) v(term, w) JOIN voc USING (term)),
{name} AS (SELECT doc_id, sum(weight * q) / ((SELECT sqrt(sum(q * q)) FROM {name}_q) * any_value(norm)) AS score
  FROM wgt JOIN {name}_q USING (term) JOIN nrm USING (doc_id) GROUP BY doc_id HAVING any_value(norm) > 0 AND sum(weight * q) > 0)"""


def top(source: str, k: int = fixed.TOP_K, columns: str = "doc_id, round(score, 6) AS score") -> str:
    return f"SELECT {columns} FROM {source} ORDER BY round(score, 9) DESC, doc_id LIMIT {k}"


def ones(text: str) -> dict[str, float]:
    terms = Q.searched_terms(text)
    return {t: float(terms.count(t)) for t in terms}


def docs_with(*terms: str) -> str:
    return f"SELECT DISTINCT doc_id FROM tok WHERE term IN ({', '.join(map(sql, terms))})"


def docs_with_all(*terms: str) -> str:
    return f"SELECT doc_id FROM tok WHERE term IN ({', '.join(map(sql, terms))}) GROUP BY doc_id HAVING count(DISTINCT term) = {len(terms)}"


def floored(weights: dict[str, float], matching: str) -> str:
    return f"WITH {INDEX}, {ranked(weights)}, hit AS ({matching}), sc AS (SELECT doc_id, greatest(coalesce(score, 0), {fixed.BOOLEAN_FLOOR}) AS score FROM hit LEFT JOIN cos USING (doc_id)) {top('sc')}"


PHRASE = "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'er' AND b.term = 'en'"
DOT = "list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
FREE = Q.parse(P.FREE_TEXT).weighted_terms
LISTS = f"""{INDEX}, {ranked(FREE)}, kw AS ({top('cos', 20, 'doc_id, score')}),
dn AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings), sem AS ({top('dn', 20, 'doc_id, score')}),
kwr AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kw),
semr AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sem)"""


def rrf(kw: float = 1.0, sem: float = 1.0) -> str:
    return f"fused AS (SELECT doc_id, sum(part) AS score FROM (SELECT doc_id, {kw!r}::DOUBLE / (60 + rank) AS part FROM kwr UNION ALL SELECT doc_id, {sem!r}::DOUBLE / (60 + rank) FROM semr) GROUP BY doc_id)"


def min_max(source: str, name: str) -> str:
    span = "(max(score) OVER () - min(score) OVER ())"
    return f"{name} AS (SELECT doc_id, CASE WHEN {span} <= 1e-12 THEN 0.0 ELSE (score - min(score) OVER ()) / {span} END AS x FROM {source})"


def judged(weights: dict[int, dict[str, float]], name: str, ranking: str | None = None) -> str:
    """CTEs: name is evaluate.per_query, unrounded. ranking: SQL of query_id, doc_id, rank in place of the cosine's."""
    rows = ", ".join(f"({i}, {sql(t)}, {w!r}::DOUBLE)" for i, ws in weights.items() for t, w in ws.items())
    ids = ", ".join(f"({i})" for i in weights)
    k_columns = "".join(f", p{k} AS precision_{k}, r{k} AS recall_{k}, CASE WHEN p{k} + r{k} > 0 THEN 2 * p{k} * r{k} / (p{k} + r{k}) ELSE 0.0 END AS f1_{k}" for k in (5, 10))
    k_parts = "".join(f", coalesce(sum(hit) FILTER (rank <= {k}), 0) / {k}.0::DOUBLE AS p{k}, CASE WHEN n > 0 THEN coalesce(sum(hit) FILTER (rank <= {k}), 0) / n::DOUBLE ELSE 0.0 END AS r{k}" for k in (5, 10))
    return f"""{name}_v AS (SELECT query_id, term, w * idf AS q FROM (VALUES {rows}) v(query_id, term, w) JOIN voc USING (term)),
{name}_z AS (SELECT query_id, sqrt(sum(q * q)) AS size FROM {name}_v GROUP BY query_id),
{name}_s AS (SELECT query_id, doc_id, sum(weight * q) / (any_value(norm) * any_value(size)) AS score FROM wgt JOIN {name}_v USING (term) JOIN nrm USING (doc_id) JOIN {name}_z USING (query_id)
  WHERE norm > 0 AND size > 0 GROUP BY query_id, doc_id HAVING sum(weight * q) > 0),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_s),
{name}_r AS ({ranking or f'SELECT * FROM {name}_k WHERE rank <= 10'}),
{name}_h AS (SELECT query_id, doc_id, rank, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS hit FROM {name}_r),
{name}_p AS (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE END AS gain FROM {name}_h),
{name}_n AS (SELECT query_id, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 1) AS n FROM (VALUES {ids}) i(query_id)),
{name}_a AS (SELECT query_id, count(doc_id) AS num_retrieved, any_value(n) AS num_relevant, coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0) AS reciprocal_rank,
  CASE WHEN any_value(n) > 0 THEN coalesce(sum(gain), 0) / any_value(n) ELSE 0.0 END AS average_precision{k_parts.replace("n > 0", "any_value(n) > 0").replace("/ n::", "/ any_value(n)::")}
  FROM {name}_n LEFT JOIN {name}_p USING (query_id) GROUP BY query_id),
{name} AS (SELECT query_id, num_retrieved, num_relevant, reciprocal_rank, average_precision{k_columns} FROM {name}_a)"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in P.METRICS)
JUDGED = {i: ones(q) for i, q in P.JUDGED.items()}
SCRIPTS = r"length(regexp_replace(t, '[^\x{0900}-\x{097F}]', '', 'g')) AS hi, length(regexp_replace(t, '[^\x{0C00}-\x{0C7F}]', '', 'g')) AS te, length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS la"
STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def heading(x: str) -> str:
    few = f"len(string_split_regex(trim({x}), '\\s+')) <= 6"
    return f"(length({x}) > 6 AND (ends_with({x}, ':') OR (upper({x}) = {x} AND lower({x}) <> {x} AND {few}) OR regexp_matches({x}, '^(section|chapter|unit)\\s+\\d+', 'i')))"


def _snippet() -> str:
    words = P.SNIPPET.split()
    first = "least(" + ", ".join(f"nullif(strpos(lower(text), {sql(w)}), 0)" for w in words) + ")"
    return f"""WITH a AS (SELECT doc_id, text, {first} AS p FROM documents), b AS (SELECT *, greatest(0, p - 1 - 66) AS s FROM a), c AS (SELECT *, least(length(text), s + 200) AS e FROM b)
    SELECT doc_id, CASE WHEN p IS NULL THEN substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END
      ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || {STRIP.format('substr(text, s + 1, e - s)')} || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS snippet FROM c"""


GRAMS = "unnest(list_transform(range(1, length(m)), lambda i: substr(m, i, 2)))"
ORACLE: dict[str, str] = {
    "tokens_per_doc": f"WITH {TOKENS} SELECT d.doc_id, count(e.term)::INT AS n_tokens, (count(e.term) FILTER ({KEPT}))::INT AS n_indexed FROM documents d LEFT JOIN every e ON d.doc_id = e.doc_id GROUP BY d.doc_id",
    "token_positions": f"WITH {TOKENS} SELECT doc_id, pos::INT AS pos, term FROM tok",
    "stopword_filtered_counts": f"WITH {TOKENS} SELECT d.doc_id, count(t.term)::INT AS n_terms FROM documents d LEFT JOIN (SELECT * FROM tok WHERE {SEARCHED}) t ON d.doc_id = t.doc_id GROUP BY d.doc_id",
    "language_detect": f"WITH x AS (SELECT doc_id, {SCRIPTS} FROM (SELECT doc_id, text AS t FROM documents)), y AS (SELECT *, hi + te + la AS n FROM x) SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN hi / n > 0.3 THEN 'hi' WHEN te / n > 0.3 THEN 'te' WHEN la / n > 0.5 THEN 'en' ELSE 'mixed' END AS language FROM y",
    "doc_language_label": f"WITH x AS (SELECT doc_id, {SCRIPTS} FROM (SELECT doc_id, substr(text, 1, 500) AS t FROM documents)), y AS (SELECT *, hi + te + la AS n FROM x) SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN hi / n > 0.3 THEN 'Hindi' WHEN te / n > 0.3 THEN 'Telugu' ELSE 'English' END AS language FROM y",
    "char_ngrams": f"WITH {TOKENS} SELECT ngram, count(*) AS n FROM (SELECT {GRAMS} AS ngram FROM (SELECT '$' || term || '$' AS m FROM tok WHERE {SEARCHED})) GROUP BY ngram",
    "bigram_index": f"WITH {TOKENS} SELECT DISTINCT bigram, term FROM (SELECT term, {GRAMS} AS bigram FROM (SELECT DISTINCT term, '$' || term || '$' AS m FROM tok))",
    "normalized_names": r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(url, '^.*/', ''), '^(.+)\.[^.]+$', '\1')), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM pages",
    "file_types": "SELECT page_id, CASE " + " ".join(f"WHEN regexp_extract(lower(url), '(\\.[^./]+)$', 1) IN ({', '.join(map(sql, e))}) THEN {sql(k)}" for k, e in fixed.FILE_TYPES.items()) + " ELSE 'unknown' END AS file_type FROM pages",
    "embedding_inputs": f"WITH x AS (SELECT item_id, {STRIP.format('text')} AS t FROM benchmark) SELECT item_id, CASE WHEN t = '' THEN '' ELSE 'passage: ' || t END AS passage, CASE WHEN t = '' THEN '' ELSE 'query: ' || t END AS query FROM x",
    "rerank_texts": r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1200) AS rerank_text FROM documents",
    "plain_queries": r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b(AND|OR|NOT)\b', ' ', 'gi'), '[*?]', '', 'g'), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')) AS plain FROM benchmark""",
    "snippets": _snippet(),
    "headings": f"SELECT doc_id, count(*) AS n_headings FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {heading('line')} GROUP BY doc_id",
    "fixed_chunks": r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
      SELECT doc_id, 0::INT AS chunk_id, text FROM w WHERE len(ws) BETWEEN 1 AND 180
      UNION ALL SELECT doc_id, (i // 130)::INT, array_to_string(ws[i + 1 : i + 180], ' ') FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 130)) AS i FROM w WHERE len(ws) > 180)""",
    "sentence_split": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ls FROM documents),
      r AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
      p AS (SELECT doc_id, i, CASE WHEN {heading('line')} THEN [line] ELSE list_filter(list_transform(string_split(regexp_replace(line, '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') END AS ss FROM r),
      s AS (SELECT doc_id, i, unnest(ss) AS text, generate_subscripts(ss, 1) AS j FROM p)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS sentence_id, text FROM s""",
    "doc_freq": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term",
    "postings": f"WITH {TOKENS} SELECT term, doc_id, count(*)::INT AS tf FROM tok GROUP BY ALL",
    "doc_lengths": f"WITH {TOKENS} SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id",
    "idf": f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM voc",
    "tfidf_weights": f"WITH {INDEX} SELECT term, doc_id, round(weight, 6) AS weight FROM wgt",
    "doc_norms": f"WITH {INDEX} SELECT doc_id, round(norm, 6) AS norm FROM nrm",
    "top_terms": f"WITH {INDEX}, r AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM wgt) SELECT doc_id, term, round(weight, 6) AS weight, rank::INT AS rank FROM r WHERE rank <= 10",
    "term_lookup": f"WITH {TOKENS} SELECT doc_id, count(*)::INT AS tf, min(pos)::INT AS first FROM tok WHERE term = {sql(P.TERM)} GROUP BY doc_id",
    "bool_and": f"WITH {TOKENS} {docs_with_all('thing', 'ering')}",
    "bool_or": f"WITH {TOKENS} {docs_with('thing', 'ering')}",
    "bool_not": f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE doc_id NOT IN ({docs_with('thing')})",
    "bool_and_not": f"WITH {TOKENS} SELECT * FROM ({docs_with('thing')}) WHERE doc_id NOT IN ({docs_with('ering')})",
    "phrase_match": f"WITH {TOKENS} {PHRASE}",
    "incidence_stats": f"WITH {TOKENS}, c AS (SELECT (SELECT count(DISTINCT term) FROM tok) AS num_terms, (SELECT count(DISTINCT doc_id) FROM tok) AS num_docs, (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM tok)) AS non_zero_cells) SELECT num_terms, num_docs, num_terms * num_docs AS total_cells, non_zero_cells, round(1 - non_zero_cells / (num_terms * num_docs)::DOUBLE, 6) AS sparsity FROM c",
    "incidence_row": f"WITH {TOKENS} SELECT doc_id, max((term = {sql(P.TERM)})::INT)::INT AS present FROM tok GROUP BY doc_id",
    "wildcard_terms": f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tok WHERE regexp_full_match(term, 'th.*ed') GROUP BY term",
    "wildcard_candidates": f"WITH {TOKENS} SELECT DISTINCT term FROM tok WHERE contains('$' || term || '$', '$t') AND contains('$' || term || '$', 'th') AND contains('$' || term || '$', 'ed') AND contains('$' || term || '$', 'd$')",
    "wildcard_search": f"WITH {INDEX}, s AS (SELECT doc_id, sum(weight) AS score FROM wgt WHERE regexp_full_match(term, 'th.*ed') GROUP BY doc_id) {top('s')}",
    "keyword_ranked": f"WITH {INDEX}, {ranked(FREE)} {top('cos')}",
    "keyword_boolean_ranked": floored(ones(P.AND_NOT), f"SELECT * FROM ({docs_with('thing')}) WHERE doc_id NOT IN ({docs_with('ering')})"),
    "keyword_phrase_ranked": floored(ones("er en"), PHRASE),
    "keyword_phrase_boost": f"""WITH {INDEX}, {ranked(Q.parse(P.BOOSTED).weighted_terms)}, best AS ({top('cos', columns='doc_id, score')}),
      hit AS ({docs_with_all('timetable')} UNION ALL SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'class' AND b.term = 'routine'),
      s AS (SELECT doc_id, score + 0.15 * (SELECT count(*) FROM hit h WHERE h.doc_id = b.doc_id) AS score FROM best b) {top('s')}""",
    "keyword_many": f"WITH {INDEX}, {judged(JUDGED, 'j')} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM j_r",
    "dense_topk": f"WITH dn AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings) {top('dn')}",
    "dense_doc_maxpool": f"WITH dn AS (SELECT label::BIGINT AS doc_id, vec_id, {DOT} AS score FROM embeddings), best AS (SELECT * FROM dn ORDER BY round(score, 9) DESC, doc_id, vec_id LIMIT 50), s AS (SELECT doc_id, max(score) AS score FROM best GROUP BY doc_id) {top('s')}",
    "doc_mean_vector": "SELECT doc_id, (i - 1)::INT AS dim, round(avg(x), 6) AS x FROM (SELECT label::BIGINT AS doc_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL",
    "weighted_query_vector": "WITH p AS (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE / (1 + vec_id) AS x FROM embeddings WHERE vec_id < 3), t AS (SELECT i, sum(x) AS x FROM p GROUP BY i) SELECT (i - 1)::INT AS dim, round(x / sqrt(sum(x * x) OVER ()), 6) AS x FROM t",
    "similar_docs": f"WITH p AS (SELECT label::BIGINT AS doc_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT doc_id, i, avg(x) AS x FROM p GROUP BY ALL), s AS (SELECT a.doc_id, sum(a.x * b.x) AS score FROM m a JOIN m b ON a.i = b.i AND b.doc_id = 0 WHERE a.doc_id <> 0 GROUP BY a.doc_id) {top('s', 5)}",
    "rrf_fusion": f"WITH {LISTS}, {rrf()} {top('fused')}",
    "weighted_rrf": f"WITH {LISTS}, {rrf(*Q.fusion_weights(Q.parse(P.FREE_TEXT)))} {top('fused')}",
    "rrf_details": f"""WITH {LISTS}, b AS (SELECT coalesce(k.doc_id, s.doc_id) AS doc_id, k.rank AS kr, s.rank AS sr, k.score AS ks, s.score AS ss, coalesce(1.0::DOUBLE / (60 + k.rank), 0) AS kx, coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS sx FROM kwr k FULL JOIN semr s ON k.doc_id = s.doc_id)
      SELECT doc_id, kr::INT AS keyword_rank, round(ks, 6) AS keyword_score, round(kx, 6) AS keyword_rrf, sr::INT AS semantic_rank, round(ss, 6) AS semantic_score, round(sx, 6) AS semantic_rrf, round(kx + sx, 6) AS score FROM b ORDER BY round(kx + sx, 9) DESC, doc_id LIMIT 10""",
    "rerank_blend": f"WITH {LISTS}, {rrf()}, re AS ({top('sem', columns='doc_id, score')}), {min_max('fused', 'fa')}, {min_max('re', 'fb')}, s AS (SELECT coalesce(fa.doc_id, fb.doc_id) AS doc_id, coalesce(fa.x, 0) * 0.65::DOUBLE + coalesce(fb.x, 0) * 0.35::DOUBLE AS score FROM fa FULL JOIN fb ON fa.doc_id = fb.doc_id) {top('s')}",
    "linear_fusion": f"WITH {LISTS}, {min_max('kw', 'fa')}, {min_max('sem', 'fb')}, s AS (SELECT doc_id, sum(x) AS score FROM (SELECT doc_id, x * 0.4::DOUBLE AS x FROM fa UNION ALL SELECT doc_id, x * 0.6::DOUBLE FROM fb) GROUP BY doc_id) {top('s')}",
    "union_max": f"WITH {LISTS}, s AS (SELECT doc_id, greatest(max(score), 0) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY doc_id) {top('s')}",
    "display_scores": f"WITH {LISTS}, {min_max('kw', 'fa')}, t AS (SELECT doc_id, score * 10 AS v, min(score * 10) OVER () AS lo, max(score * 10) OVER () AS hi FROM kw) SELECT doc_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN v WHEN hi = lo THEN 0.5 ELSE (v - lo) / (hi - lo) END, 4) AS shown, round(x, 6) AS normal FROM t JOIN fa USING (doc_id)",
    "eval_per_query": f"WITH {INDEX}, {judged(JUDGED, 'j')} SELECT query_id, num_retrieved, num_relevant, {ROUNDED} FROM j",
    "eval_aggregate": f"WITH {INDEX}, {judged(JUDGED, 'j')} SELECT count(*) AS num_queries, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in P.METRICS[2:]) + " FROM j",
    "expansion_ab": f"""WITH {INDEX}, {judged(JUDGED, 'a')}, {judged(P.EXPANDED, 'b')}, d AS (SELECT query_id, b.average_precision - a.average_precision AS x, b.reciprocal_rank - a.reciprocal_rank AS y FROM a JOIN b USING (query_id))
      SELECT query_id, round(x, 6) AS delta_ap, round(y, 6) AS delta_rr, CASE WHEN x > 1e-9 THEN 'improved' WHEN x < -1e-9 THEN 'hurt' WHEN y > 1e-9 THEN 'improved' WHEN y < -1e-9 THEN 'hurt' ELSE 'unchanged' END AS verdict FROM d""",
    "failing_queries": f"WITH {INDEX}, {judged(JUDGED, 'j')} SELECT query_id, num_retrieved FROM j WHERE reciprocal_rank = 0 OR precision_5 = 0",
    "history_dedup": """WITH o AS (SELECT event_id, user_id, event_type AS action, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newer FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM o WHERE newer IS NULL OR newer <> action)
      SELECT event_id, user_id, action, place::INT AS place FROM r WHERE place <= 200""",
}
_FREE_ROWS = f"WITH {INDEX}, {ranked(FREE)}, best AS ({top('cos', columns='doc_id, score')})"
ORACLE["search_results"] = f"""{_FREE_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM best),
  a AS (SELECT rank, doc_id, score, text, source, least({', '.join(f"nullif(strpos(lower(text), {sql(w)}), 0)" for w in P.FREE_TEXT.split())}) AS p FROM r JOIN documents USING (doc_id)),
  b AS (SELECT *, greatest(0, p - 67) AS s FROM a), c AS (SELECT *, least(length(text), s + 200) AS e FROM b)
  SELECT rank::INT AS rank, doc_id, round(score, 4) AS score, CASE WHEN p IS NULL THEN substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END
    ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || {STRIP.format('substr(text, s + 1, e - s)')} || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS snippet, 'English' AS language, source FROM c"""


def overlap(name: str, terms: dict[int, list[str]], candidates: str) -> str:
    """CTEs: name (query_id, doc_id, score, fused) is the share of a query's terms in the first 1200 characters."""
    rows = ", ".join(f"({i}, {sql(t)}, {len(set(ts))})" for i, ts in terms.items() for t in dict.fromkeys(ts))
    blanked = BLANKED.replace("text", r"substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1200)", 1)
    return f"""{name}_w AS (SELECT * FROM (VALUES {rows}) v(query_id, term, many)), {name}_c AS ({candidates}),
{name}_t AS (SELECT DISTINCT doc_id, CASE WHEN length(part) = strlen(part) THEN lower(part) ELSE part END AS term FROM (SELECT doc_id, unnest(regexp_extract_all({blanked}, '{LETTERS}')) AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM {name}_c))),
{name} AS (SELECT c.query_id, c.doc_id, count(t.term) / any_value(w.many)::DOUBLE AS score, any_value(c.score) AS fused FROM {name}_c c JOIN {name}_w w ON c.query_id = w.query_id LEFT JOIN {name}_t t ON t.doc_id = c.doc_id AND t.term = w.term GROUP BY c.query_id, c.doc_id)"""


def grid(name: str, weights: str) -> str:
    """CTEs: name_k (configuration, query_id, doc_id, rank) of a table of weights, name_m its metrics."""
    return f"""{name}_p AS (SELECT configuration, query_id, doc_id, sum(x * CASE side WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END) AS score FROM parts CROSS JOIN {weights} GROUP BY ALL),
{name}_k AS (SELECT * EXCLUDE score FROM (SELECT *, row_number() OVER (PARTITION BY configuration, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_p) WHERE rank <= 10),
{name}_h AS (SELECT *, (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS hit FROM {name}_k),
{name}_g AS (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY configuration, query_id ORDER BY rank) / rank::DOUBLE END AS gain FROM {name}_h),
{name}_q AS (SELECT configuration, query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0) AS rr, coalesce(sum(gain), 0) / (SELECT n FROM good) AS ap, coalesce(sum(hit) FILTER (rank <= 5), 0) AS five FROM {name}_g GROUP BY ALL),
{name}_m AS (SELECT configuration, sum(rr) / {len(P.JUDGED)} AS mrr, sum(ap) / {len(P.JUDGED)} AS map, sum(five / 5.0::DOUBLE) / {len(P.JUDGED)} AS precision_5, sum(five / (SELECT n FROM good)::DOUBLE) / {len(P.JUDGED)} AS recall_5 FROM {name}_q GROUP BY configuration)"""


_IDS = ", ".join(map(str, P.JUDGED))
_TERMS = {i: Q.searched_terms(q) for i, q in P.JUDGED.items()}
_SPAN = "(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id))"
_SIDE = "SELECT query_id, doc_id, {0} AS side, CASE WHEN " + _SPAN + " <= 1e-12 THEN 0.0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / " + _SPAN + " END AS x FROM {1}"
GRID_LISTS = f"""{INDEX}, {judged(JUDGED, 'j')}, good AS (SELECT count(DISTINCT doc_id) AS n FROM labels WHERE quality = 1), kw30 AS (SELECT query_id, doc_id, score FROM j_k WHERE rank <= 30),
dots AS (SELECT q.vec_id::INT AS query_id, d.vec_id AS doc_id, list_dot_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings d CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN ({_IDS})) q),
sem30 AS (SELECT * EXCLUDE rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dots) WHERE rank <= 30),
{overlap('rr', _TERMS, 'SELECT * FROM kw30')},
parts AS ({_SIDE.format(0, 'kw30')} UNION ALL {_SIDE.format(1, 'sem30')} UNION ALL {_SIDE.format(2, 'rr')})"""
_ALL = ", ".join(f"({3 * i + j}, {a!r}::DOUBLE, {b!r}::DOUBLE, {w!r}::DOUBLE)" for i, (a, b) in enumerate(P.GRID) for j, w in enumerate((0.0, 0.2, 0.4)))
_FIRST = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, 0.0::DOUBLE)" for i, (a, b) in enumerate(P.GRID))
_STAGES = f"""{GRID_LISTS}, wa AS (SELECT * FROM (VALUES {_FIRST}) v(configuration, w0, w1, w2)), {grid('a', 'wa')},
best AS (SELECT w0, w1 FROM a_m JOIN wa USING (configuration) ORDER BY round((mrr + map) / 2, 9) DESC, configuration LIMIT 3),
wb AS (SELECT row_number() OVER () AS configuration, w0, w1, w2 FROM best CROSS JOIN (VALUES (0.2::DOUBLE), (0.4::DOUBLE)) v(w2)), {grid('b', 'wb')}"""
_FOUR = "round(mrr, 6) AS mrr, round(map, 6) AS map, round(precision_5, 6) AS precision_5, round(recall_5, 6) AS recall_5"
_AFTER = judged(JUDGED, "n", "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(fused, 9) DESC, doc_id) AS rank FROM rr) WHERE rank <= 10")
_VERDICT = "round(x, 6) AS delta_ap, round(y, 6) AS delta_rr, CASE WHEN x > 1e-9 THEN 'improved' WHEN x < -1e-9 THEN 'hurt' WHEN y > 1e-9 THEN 'improved' WHEN y < -1e-9 THEN 'hurt' ELSE 'unchanged' END AS verdict"
_MODES = {i: ones(q) for i, q in P.MODE_QUERIES.items()}
_RRF = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, q in P.MODE_QUERIES.items() for a, b in [Q.fusion_weights(Q.parse(q))])
_MODE_IDS = ", ".join(f"({i})" for i in P.MODE_QUERIES)
_MODE_LISTS = f"""dn AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings), dr AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM dn),
fw AS (SELECT * FROM (VALUES {_RRF}) v(query_id, a, b)),
hs AS (SELECT query_id, doc_id, sum(part) AS score FROM (SELECT query_id, doc_id, a / (60 + rank) AS part FROM m_k JOIN fw USING (query_id) WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, b / (60 + rank) FROM dr CROSS JOIN fw WHERE rank <= 20) GROUP BY ALL),
hr AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hs) WHERE rank <= 10)"""
_WHOLE = f"query_id, num_retrieved, num_relevant, {ROUNDED}"


def listed(table: dict[str, list[str]], name: str) -> str:
    """CTE: by page and path the values of a table for a name's parts, each once, in the order of the name."""
    rows = ", ".join(f"({sql(k)}, {i}, {sql(v)})" for k, values in table.items() for i, v in enumerate(values))
    return f"""{name} AS (SELECT page_id, path, string_agg(v, ' ' ORDER BY p, i) AS {name} FROM (SELECT DISTINCT ON (page_id, path, v) page_id, path, p, i, v FROM parts JOIN (VALUES {rows}) t(k, i, v) ON part = k ORDER BY page_id, path, v, p, i) GROUP BY ALL)"""


#: What the parser makes of each query: query, type, language, reason, intent, weighted embedding, then term and weight.
PARSES = """
('network security', 'free_text', 'en', 'strong_phrase', '', false, 'network', 1.0), ('network security', 'free_text', 'en', 'strong_phrase', '', false, 'security', 1.0),
('electricity', 'free_text', 'en', 'single_word_query', '', true, 'electricity', 1.3), ('electricity', 'free_text', 'en', 'single_word_query', '', true, 'power', 1.2),
('electricity', 'free_text', 'en', 'single_word_query', '', true, 'power supply', 0.3), ('electricity', 'free_text', 'en', 'single_word_query', '', true, 'current', 0.3),
('electricity', 'free_text', 'en', 'single_word_query', '', true, 'electric bill', 0.3),
('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'id', 1.4), ('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'card', 1.2),
('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'identity', 1.5), ('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'identity card', 1.5),
('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'student id', 0.3), ('id card', 'free_text', 'en', 'specific_multi_term_query', 'id', true, 'id proof', 0.3),
('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'house', 1.0), ('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'permission', 1.5),
('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'form', 1.0), ('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'approval', 1.5),
('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'noc', 1.5), ('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'building permit', 0.3),
('house permission form', 'free_text', 'en', 'specific_multi_term_query', 'permission', true, 'construction approval', 0.3),
('"er en"', 'phrase', 'en', 'phrase_query', '', false, 'er', 1.0), ('"er en"', 'phrase', 'en', 'phrase_query', '', false, 'en', 1.0), ('th*ed', 'wildcard', 'en', 'wildcard_query', '', false, 'th*ed', 1.0),
('terms and conditions', 'boolean', 'en', 'boolean_query', '', false, 'terms', 1.0), ('terms and conditions', 'boolean', 'en', 'boolean_query', '', false, 'conditions', 1.0),
('విద్య', 'free_text', 'te', 'single_word_query', '', true, 'విద్య', 1.0), ('విద్య', 'free_text', 'te', 'single_word_query', '', true, 'చదువు', 0.3), ('విద్య', 'free_text', 'te', 'single_word_query', '', true, 'శిక్షణ', 0.3),
('', 'empty', 'en', 'empty_query', '', false, NULL, NULL), ('"', 'phrase', 'en', 'phrase_query', '', false, NULL, NULL),
('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'bonafide', 1.0), ('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'timetable', 1.0),
('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'certificate', 1.4), ('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'schedule', 0.3),
('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'calendar', 0.3), ('bonafide 2024 timetable', 'free_text', 'en', 'specific_multi_term_query', 'certificate', true, 'class routine', 0.3)
"""
#: Weights of the keyword and the semantic list, and whether the query is short.
WEIGHTS = """
('network security', 0.4, 0.8, true), ('electricity', 0.4, 0.8, true), ('id card', 0.4, 0.8, true), ('house permission form', 0.2, 0.8, true), ('"er en"', 0.4, 0.8, true), ('th*ed', 0.4, 0.8, true),
('terms and conditions', 0.4, 0.8, true), ('విద్య', 0.4, 0.8, true), ('', 0.2, 0.8, false), ('"', 0.2, 0.8, false), ('bonafide 2024 timetable', 0.75, 0.8, true)
"""
#: Cleaned synonyms: language, term, synonym.
CLEANED = """
('en', 'network', 'networking'), ('en', 'security', 'protection'), ('en', 'security', 'safety'), ('en', 'marksheet', 'gradecard'), ('en', 'marksheet', 'result'), ('en', 'id', 'identity'), ('en', 'identity', 'id'),
('en', 'card', 'identity'), ('en', 'electricity', 'power'), ('en', 'electricity', 'current'), ('en', 'invoice', 'bill'), ('en', 'invoice', 'receipt'), ('en', 'timetable', 'schedule'), ('en', 'drainage', 'sewerage'), ('en', 'drainage', 'stormwater'),
('hi', 'सुरक्षा', 'रक्षा'), ('hi', 'सुरक्षा', 'बचाव'), ('hi', 'शिक्षा', 'पढ़ाई'), ('hi', 'शिक्षा', 'अध्ययन'), ('hi', 'स्वास्थ्य', 'सेहत'), ('hi', 'स्वास्थ्य', 'आरोग्य'), ('hi', 'बिजली', 'विद्युत'), ('hi', 'बिजली', 'पावर'), ('hi', 'पानी', 'जल'), ('hi', 'पानी', 'नीर'),
('te', 'విద్య', 'చదువు'), ('te', 'విద్య', 'శిక్షణ'), ('te', 'ఆరోగ్యం', 'ఆరోగ్యము'), ('te', 'ఆరోగ్యం', 'స్వస్థత'), ('te', 'నీరు', 'జలం'), ('te', 'విద్యుత్', 'కరెంటు'), ('te', 'భద్రత', 'రక్షణ'), ('te', 'భద్రత', 'సురక్ష')
"""
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
ORACLE |= {
    "query_parse": f"SELECT query, type, language, expand_reason, intent, weighted, term, weight::DOUBLE AS weight FROM (VALUES {PARSES}) v(query, type, language, expand_reason, intent, weighted, term, weight)",
    "query_weights": f"SELECT query, keyword::DOUBLE AS keyword, semantic::DOUBLE AS semantic, short FROM (VALUES {WEIGHTS}) v(query, keyword, semantic, short)",
    "synonyms_clean": f"SELECT * FROM (VALUES {CLEANED}) v(lang, term, synonym)",
    "synonym_forms": "SELECT doc_id, CASE WHEN lang = 'en' THEN lower(trim(substr(text, 1, 40))) ELSE trim(substr(text, 1, 40)) END AS form FROM documents",
    "name_terms": rf"""WITH n AS (SELECT page_id, unnest([url, 'd/my_id-card.' || page_id || '.pdf', 'd/house_permission-electricity.docx']) AS path FROM pages),
      m AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\.[^.]+$', '\1')), '[_.-]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM n),
      parts AS (SELECT page_id, path, unnest(string_split(name, ' ')) AS part, generate_subscripts(string_split(name, ' '), 1) AS p FROM m), {listed(fixed.FILENAME_TAGS, 'tags')}, {listed(fixed.FILENAME_TERMS, 'terms')}
      SELECT page_id, path, CASE WHEN name = '' THEN 'x' ELSE 'x' || chr(10) || chr(10) || concat_ws(' ', name, tags, terms) END AS text FROM m LEFT JOIN tags USING (page_id, path) LEFT JOIN terms USING (page_id, path)""",
    "file_documents": "SELECT row_number() OVER (ORDER BY 'item_id=' || item_id || '/') - 1 AS doc_id, item_id, 'text' AS file_type, text || chr(10) AS text FROM benchmark",
    "office_documents": rf"""WITH w AS (SELECT item_id, text, {_WORDS} AS ws FROM benchmark)
      SELECT item_id || '.docx' AS file_path, 'docx' AS file_type, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text, 0::INT AS n_pages FROM w
      UNION ALL SELECT item_id || '.xlsx', 'excel', '[Sheet: S]' || chr(10) || array_to_string(ws[1:3], ' | '), 0::INT FROM w
      UNION ALL SELECT item_id || '.pdf', 'pdf', array_to_string(ws[1:4], chr(10)) || chr(10) || chr(10) || array_to_string(ws[5:6], chr(10)), 2::INT FROM w
      UNION ALL SELECT item_id || '.png', 'image', 'NotImplementedError: no extractor is registered for image files', -1::INT FROM w""",
    "saved_history": ORACLE["history_dedup"],
    "incidence_cells": f"WITH {TOKENS} SELECT DISTINCT term, doc_id, 1::INT AS present FROM tok",
    "incidence_column": f"WITH {TOKENS} SELECT term, max((doc_id = 0)::INT)::INT AS present FROM tok GROUP BY term",
    "cluster_sizes": "SELECT c::INT AS cluster, (SELECT count(*) FROM embeddings WHERE label = c) AS size FROM range(12) r(c)",
    "similar_in_cluster": f"WITH s AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings WHERE vec_id <> 0 AND label = (SELECT label FROM embeddings WHERE vec_id = 0)) {top('s', 5)}",
    "semantic_search": f"WITH dn AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings) SELECT *, 'en' AS query_language FROM ({top('dn')})",
    "hybrid_search": ORACLE["weighted_rrf"],
    "search_modes": f"SELECT *, 'keyword' AS mode FROM ({ORACLE['keyword_ranked']}) UNION ALL SELECT *, 'semantic' FROM ({ORACLE['dense_topk']}) UNION ALL SELECT *, 'hybrid' FROM ({ORACLE['weighted_rrf']}) UNION ALL SELECT *, 'wildcard' FROM ({ORACLE['wildcard_search']})",
    "rerank": f"WITH {LISTS}, {overlap('rr', {0: Q.searched_terms(P.FREE_TEXT)}, 'SELECT 0 AS query_id, doc_id, score FROM kw')} SELECT doc_id, round(score, 6) AS score FROM rr ORDER BY round(score, 9) DESC, round(fused, 9) DESC, doc_id LIMIT 10",
    "without_failures": f"WITH {INDEX}, {judged(JUDGED, 'j')} SELECT count(*) AS num_queries, round(avg(reciprocal_rank), 6) AS mrr, round(avg(average_precision), 6) AS map, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in P.METRICS[2:]) + " FROM j WHERE reciprocal_rank > 0",
    "short_expansion_ab": f"SELECT * FROM ({ORACLE['expansion_ab']}) WHERE query_id IN (2, 3, 4, 5)",
    "metric_report": f"WITH {INDEX}, {judged(JUDGED, 'j')}, m AS (SELECT count(*)::DOUBLE AS num_queries, avg(reciprocal_rank) AS mrr, avg(average_precision) AS map, " + ", ".join(f"avg({m}) AS {m}" for m in P.METRICS[2:]) + " FROM j) "
    + " UNION ALL ".join(f"SELECT {i}::INT AS place, printf('%s: %.4f', {sql(c)}, {c}) AS line FROM m" for i, c in enumerate(["num_queries", "mrr", "map", *P.METRICS[2:]])),
    "eval_modes": f"WITH {INDEX}, {judged(_MODES, 'm')}, {_MODE_LISTS}, {judged(_MODES, 's', f'SELECT query_id, doc_id, rank FROM dr CROSS JOIN (VALUES {_MODE_IDS}) v(query_id) WHERE rank <= 10')}, {judged(_MODES, 'h', 'SELECT * FROM hr')} "
    f"SELECT {_WHOLE}, 'keyword' AS mode FROM m UNION ALL SELECT {_WHOLE}, 'semantic' FROM s UNION ALL SELECT {_WHOLE}, 'hybrid' FROM h",
    "fusion_grid": f"WITH {GRID_LISTS}, wx AS (SELECT * FROM (VALUES {_ALL}) v(configuration, w0, w1, w2)), {grid('g', 'wx')} SELECT configuration, query_id, doc_id, rank::INT AS rank FROM g_k",
    "two_stage_grid": f"WITH {_STAGES} SELECT 1 AS stage, w0, w1, w2, {_FOUR} FROM a_m JOIN wa USING (configuration) UNION ALL SELECT 2, w0, w1, w2, {_FOUR} FROM b_m JOIN wb USING (configuration)",
    "guarded_grid": f"WITH {_STAGES} SELECT w0, w1, round(precision_5, 6) AS precision_5, round(recall_5, 6) AS recall_5 FROM a_m JOIN wa USING (configuration) WHERE recall_5 >= (SELECT max(recall_5) FROM a_m) - 0.03 - 1e-9",
    "rerank_comparison": f"WITH {GRID_LISTS}, {_AFTER}, d AS (SELECT query_id, n.average_precision - j.average_precision AS x, n.reciprocal_rank - j.reciprocal_rank AS y FROM j JOIN n USING (query_id)) SELECT query_id, {_VERDICT} FROM d",
}
