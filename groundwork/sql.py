"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from .functions.text import STOPWORDS
from .operators.generation import ABSTAIN, INSTRUCTIONS, NO_CONTEXT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SIZE, STEP, DIM, K, RRF = 128, 112, 256, 20, 60
STOP = "[" + ", ".join(quoted(w) for w in STOPWORDS) + "]"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def content(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: NOT list_contains({STOP}, t))"


def sents(x: str) -> str:
    """No look-behind here: a mark after the stop, then a split at the mark."""
    stripped = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return rf"list_filter(string_split(regexp_replace({stripped}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def wds(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def f1(p: str, r: str) -> str:
    """F1 of two token lists that are columns."""
    same = f"list_sum(list_transform(list_distinct(list_intersect({p}, {r})), lambda t: least(len(list_filter({p}, lambda y: y = t)), len(list_filter({r}, lambda y: y = t)))))"
    n = f"coalesce({same}, 0)::double"
    return (
        f"CASE WHEN len({p}) = 0 AND len({r}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({r}) = 0 THEN 0.0 WHEN {n} = 0 THEN 0.0 "
        f"ELSE 2 * ({n} / len({p})) * ({n} / len({r})) / ({n} / len({p}) + {n} / len({r})) END"
    )


PLAIN = r"regexp_replace(answer, '\[\d+\]', ' ', 'g')"

CTE: dict[str, str] = {
    "dw": f"SELECT doc_id, source, {wds('text')} AS w FROM documents",
    "dn": "SELECT doc_id, source, w, len(w) AS n FROM dw WHERE len(w) > 0",
    "ci": f"SELECT doc_id, source, w, unnest(range(0, CASE WHEN n <= {SIZE} THEN 1 ELSE CAST(ceil((n - {SIZE}) / {STEP}.0) AS BIGINT) + 1 END)) AS i FROM dn",
    "chunks": f"SELECT doc_id || '#' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, i AS ordinal, source AS title, array_to_string(w[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS text, doc_id AS doc_seq FROM ci",
    "q": "SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question FROM benchmark",
    "ct": f"SELECT chunk_id, doc_id, doc_seq, ordinal, {toks('text')} AS t FROM chunks",
    "whole": "SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct",
    "tf": "SELECT chunk_id, doc_id, doc_seq, ordinal, dl, term, count(*) AS tf FROM (SELECT chunk_id, doc_id, doc_seq, ordinal, len(t) AS dl, unnest(t) AS term FROM ct) GROUP BY ALL",
    "dfs": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "raw": "SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, whole",
    "mean": "SELECT avg(raw) AS avg_idf FROM raw",
    "ts": "SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw, mean",
    "post": "SELECT term, chunk_id, doc_seq, ordinal, tf, idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS weight FROM tf JOIN ts USING (term), whole",
    "qt": f"SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({toks('question')}) AS term FROM q) GROUP BY ALL",
    "sc": "SELECT question_id, chunk_id, doc_seq, ordinal, sum(qtf * weight) AS score FROM qt JOIN post USING (term) GROUP BY ALL",
    "lead": f"SELECT chunk_id, doc_seq, ordinal FROM chunks ORDER BY doc_seq, ordinal LIMIT {2 * K}",
    "pads": "SELECT q.question_id, lead.chunk_id, lead.doc_seq, lead.ordinal, 0.0::double AS score FROM q, lead WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.question_id = q.question_id AND sc.chunk_id = lead.chunk_id)",
    "bm": f"SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_seq, ordinal) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM pads)) WHERE rank <= {K}",
    "md5t": f"SELECT 'q' AS kind, question_id AS id, unnest({toks('question')}) AS token FROM q UNION ALL SELECT 'c', chunk_id, unnest({toks('text')}) FROM chunks",
    "md5h": f"SELECT kind, id, ('0x' || substr(md5(token), 1, 15))::bigint % {DIM} AS bucket, CASE WHEN substr(md5(token), 16, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM md5t",
    "md5s": "SELECT kind, id, bucket, sum(sign) AS s FROM md5h GROUP BY ALL HAVING sum(sign) <> 0",
    "md5v": "SELECT kind, id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY kind, id)) AS weight FROM md5s",
    "dots": "SELECT a.id AS question_id, b.id AS chunk_id, sum(a.weight * b.weight) AS score FROM md5v a JOIN md5v b USING (bucket) WHERE a.kind = 'q' AND b.kind = 'c' GROUP BY ALL",
    "alld": "SELECT q.question_id, c.chunk_id, coalesce(dots.score, 0.0) AS score FROM q CROSS JOIN chunks c LEFT JOIN dots ON dots.question_id = q.question_id AND dots.chunk_id = c.chunk_id",
    "dn5": f"SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM alld) WHERE rank <= {K}",
    "fused": f"SELECT question_id, chunk_id, sum(1.0::double / ({RRF} + rank)) AS score FROM (SELECT question_id, chunk_id, rank FROM bm UNION ALL SELECT question_id, chunk_id, rank FROM dn5) GROUP BY ALL",
    "hy": f"SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= {K}",
    "rc": f"SELECT hy.question_id, chunk_id, hy.rank AS old, hy.score AS old_score, list_distinct({content('question')}) AS qs, {content('text')} AS cs FROM hy JOIN q USING (question_id) JOIN chunks USING (chunk_id)",
    "rs": "SELECT question_id, chunk_id, old, old_score, CASE WHEN len(qs) > 0 THEN len(list_distinct(list_intersect(qs, cs))) / len(qs)::double + 0.0001::double * len(list_filter(cs, lambda t: list_contains(qs, t))) END AS lex FROM rc",
    "rr": "SELECT question_id, chunk_id, coalesce(lex, old_score) AS score, CASE WHEN lex IS NULL THEN 'rrf' ELSE 'rerank' END AS source, row_number() OVER (PARTITION BY question_id ORDER BY round(lex, 9) DESC NULLS LAST, CASE WHEN lex IS NULL THEN old END NULLS FIRST, chunk_id) AS rank FROM rs",
    "rel": "SELECT q.question_id, CAST(d.doc_id AS VARCHAR) AS doc_id FROM q JOIN documents d ON contains(d.text, q.question)",
    "top5": "SELECT rr.question_id, rr.rank, chunk_id, title, text FROM rr JOIN chunks USING (chunk_id) WHERE rr.rank <= 5",
    "block": "SELECT question_id, string_agg('[' || rank || '] ' || CASE WHEN title <> '' THEN title || ': ' ELSE '' END || text, chr(10) ORDER BY rank) AS ctx FROM top5 GROUP BY question_id",
    "cand": f"SELECT question_id, rank, chunk_id, unnest({sents('text')}) AS s, generate_subscripts({sents('text')}, 1) AS j FROM top5",
    "over": f"SELECT question_id, rank, chunk_id, s, j, len(list_distinct({content('question')})) AS nq, len(list_distinct(list_intersect({content('question')}, {content('s')}))) AS n FROM cand JOIN q USING (question_id)",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, rank, j) AS r FROM over) WHERE r = 1",
    "said": f"SELECT q.question_id, coalesce(n = 0 OR nq = 0 OR n / nq::double < 0.15, true) AS abstained, CASE WHEN coalesce(n = 0 OR nq = 0 OR n / nq::double < 0.15, true) THEN {quoted(ABSTAIN)} ELSE s || ' [' || rank || ']' END AS answer, CASE WHEN coalesce(n = 0 OR nq = 0 OR n / nq::double < 0.15, true) THEN '' ELSE chunk_id END AS citations, {quoted(INSTRUCTIONS + chr(10) + chr(10) + 'Context:' + chr(10))} || coalesce(ctx, {quoted(NO_CONTEXT)}) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Answer:' AS prompt FROM q LEFT JOIN best USING (question_id) LEFT JOIN block USING (question_id)",
    "prev": "SELECT conv_id, turn, role, text AS answer, lag(text) OVER w AS question, coalesce(lag(text, 2) OVER w, '') AS reference_answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
    "pair": "SELECT *, question || chr(10) || reference_answer AS context, length(answer) < 60 AS abstained, length(question) < 60 AS no_answer FROM prev WHERE role = 'assistant' AND question IS NOT NULL",
    "ptok": f"SELECT *, {content(PLAIN)} AS ans, {content('question')} AS qt, {content('reference_answer')} AS rt, list_distinct({content('context')}) AS xt FROM pair",
    "judged": f"SELECT conv_id, turn, answer, abstained, no_answer, CASE WHEN abstained OR len(ans) = 0 THEN 1.0 ELSE len(list_filter(ans, lambda t: list_contains(xt, t))) / len(ans)::double END AS faithfulness, CASE WHEN abstained THEN 0.0 ELSE {f1('ans', 'qt')} END AS answer_relevance, CASE WHEN no_answer THEN abstained::int::double WHEN abstained THEN 0.0 ELSE {f1('ans', 'rt')} END AS correctness FROM ptok",
    "vars": "SELECT 'dense_only' AS variant, question_id, chunk_id, rank FROM dn5 UNION ALL SELECT 'hybrid', question_id, chunk_id, rank FROM hy UNION ALL SELECT 'hybrid_rerank', question_id, chunk_id, rank FROM rr UNION ALL SELECT 'bm25', question_id, chunk_id, rank FROM bm",
    "coll": "SELECT variant, question_id, doc_id, row_number() OVER (PARTITION BY variant, question_id ORDER BY min(rank), doc_id) AS rank FROM vars JOIN chunks USING (chunk_id) GROUP BY variant, question_id, doc_id",
    "nrel": "SELECT question_id, count(rel.doc_id) AS n FROM q LEFT JOIN rel USING (question_id) GROUP BY question_id",
    "hit": "SELECT variant, question_id, n, rank FROM (SELECT DISTINCT variant FROM vars) CROSS JOIN nrel LEFT JOIN (SELECT coll.* FROM coll SEMI JOIN rel ON coll.question_id = rel.question_id AND coll.doc_id = rel.doc_id) USING (variant, question_id)",
    "ks": "SELECT unnest([1, 3, 5, 10]) AS k",
    "ideal": "SELECT k, i, sum(1 / log2(j + 1.0)) AS g FROM ks, (SELECT unnest(range(1, 11)) AS i), (SELECT unnest(range(1, 11)) AS j) WHERE j <= i AND i <= k GROUP BY ALL",
    "mk": "SELECT variant, question_id, k, any_value(n) AS n, count(*) FILTER (rank <= k) AS h, coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= k), 0.0) AS gain FROM hit, ks GROUP BY variant, question_id, k",
    "mv": "SELECT variant, question_id, 'recall@' || k AS metric, h / nullif(n, 0)::double AS value FROM mk UNION ALL SELECT variant, question_id, 'ndcg@' || mk.k, CASE WHEN n > 0 THEN gain / g END FROM mk LEFT JOIN ideal ON ideal.k = mk.k AND ideal.i = least(n, mk.k) UNION ALL SELECT variant, question_id, 'precision@' || k, h / k::double FROM mk UNION ALL SELECT variant, question_id, 'mrr', CASE WHEN any_value(n) > 0 THEN coalesce(1.0 / min(rank), 0.0) END FROM hit GROUP BY variant, question_id",
    "vals": "SELECT CASE WHEN no_answer THEN 'short' ELSE 'long' END AS metric, conv_id, turn, answer, answer_relevance AS value FROM judged WHERE NOT abstained AND answer_relevance IS NOT NULL",
    "dif": "SELECT 'f-r' AS metric, conv_id, turn, answer, round(faithfulness, 9) - round(answer_relevance, 9) AS value FROM judged WHERE NOT abstained",
}

#: In the order in which they build on each other.
_ORDER = list(CTE)


def _uses(sql: str) -> set[str]:
    import re

    return {name for name in CTE if re.search(rf"\b{name}\b", sql)}


def query(sql: str) -> str:
    need, todo = set(), _uses(sql)
    while todo:
        need |= todo
        todo = set().union(*(_uses(CTE[n]) for n in todo)) - need
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in _ORDER if n in need) + " " if need else "") + sql


def _ranked(source: str, name: str) -> str:
    return query(f"SELECT question_id, chunk_id, rank, round(score, 6) AS score, {name} AS source FROM {source}")


def _hashed(source: str, salt: str, iterations: int, columns: str) -> str:
    """Bootstrap whose draws are md5 of the salt, the iteration and the draw."""
    return query(
        f"SELECT {columns} FROM (SELECT metric, quantile_cont(boot, 0.025) AS ci_low, quantile_cont(boot, 0.975) AS ci_high, avg((boot <= 0)::int) AS p_low, avg((boot >= 0)::int) AS p_high FROM ("
        f"SELECT d.metric, b, avg(v.value) AS boot FROM (SELECT metric, b, ('0x' || substr(md5({quoted(salt)} || ':' || b || ':' || d), 1, 15))::bigint % n AS i FROM "
        f"(SELECT metric, n, b, unnest(range(0, n)) AS d FROM (SELECT metric, n, unnest(range(0, {iterations})) AS b FROM (SELECT metric, count(*) AS n FROM {source} GROUP BY metric)))) d "
        f"JOIN (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY conv_id, turn, answer) - 1 AS i FROM {source}) v ON v.metric = d.metric AND v.i = d.i GROUP BY d.metric, b) GROUP BY metric) "
        f"JOIN (SELECT metric, count(*) AS n, avg(value) AS mean FROM {source} GROUP BY metric) USING (metric)"
    )


_BACK = chr(92)
_UNIT = f"list_filter(flatten(list_transform({sents('text')}, lambda s: list_transform(range(0, CAST(ceil(len({wds('s')}) / {SIZE}.0) AS BIGINT)), lambda i: ({wds('s')})[i * {SIZE} + 1 : (i + 1) * {SIZE}]))), lambda u: len(u) > 0)"
_SAID = f"source || ' [' || (n_chars % 9) || '] x [3] [' || (doc_id % 5) || '][99999999999999999999] [0]'"
_NUMBERS = f"list_filter(list_transform(regexp_extract_all(a, '{_BACK}[({_BACK}d+){_BACK}]', 1), lambda x: TRY_CAST(x AS INTEGER)), lambda n: n BETWEEN 1 AND 5)"
#: Each once, where it came first.
_FIRST = "list_filter(c, lambda n, i: list_position(c, n) = i)"
_WILCOXON = "(SELECT metric, round(value, 6) AS d FROM dif)"

ORACLE_SQL: dict[str, str] = {
    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
    "content_token_counts": f"SELECT doc_id, len(t) AS n_content, md5(array_to_string(t, ' ')) AS content_md5 FROM (SELECT doc_id, {content('text')} AS t FROM documents)",
    "sentence_split": f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {sents('text')} AS s FROM documents)",
    "citation_parse": f"SELECT doc_id, array_to_string({_FIRST}, ',') AS cited, array_to_string(list_transform({_FIRST}, lambda n: 'c' || n), ',') AS ids, regexp_replace(a, '{_BACK}[{_BACK}d+{_BACK}]', ' ', 'g') AS plain FROM (SELECT doc_id, a, {_NUMBERS} AS c FROM (SELECT doc_id, {_SAID} AS a FROM documents))",
    "chunk_fixed": query("SELECT chunk_id, doc_id, ordinal, title, len(string_split(text, ' ')) AS n_words, md5(text) AS text_md5 FROM chunks"),
    "chunk_recursive": (
        f"WITH u AS (SELECT doc_id, source, list_transform({_UNIT}, lambda u: {{'done': []::VARCHAR[][], 'cur': u}}) AS us FROM documents), "
        f"r AS (SELECT doc_id, source, list_reduce(us, lambda a, x: {{'done': CASE WHEN len(a.cur) + len(x.cur) > {SIZE} THEN list_append(a.done, a.cur) ELSE a.done END, "
        f"'cur': CASE WHEN len(a.cur) + len(x.cur) > {SIZE} THEN list_concat(a.cur[-{SIZE - STEP}:], x.cur) ELSE list_concat(a.cur, x.cur) END}}) AS z FROM u WHERE len(us) > 0), "
        "c AS (SELECT doc_id, source, list_append(z.done, z.cur) AS ch FROM r), "
        "x AS (SELECT doc_id, source, unnest(ch) AS w, generate_subscripts(ch, 1) - 1 AS i FROM c) "
        "SELECT doc_id || '#' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, i AS ordinal, source AS title, len(w) AS n_words, md5(array_to_string(w, ' ')) AS text_md5 FROM x"
    ),
    "bm25_term_stats": query("SELECT term, df, round(idf, 6) AS idf FROM ts"),
    "bm25_postings": query("SELECT term, chunk_id, tf, round(weight, 6) AS weight FROM post"),
    "bm25_corpus_stats": query("SELECT n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM whole, mean"),
    "bm25_topk": _ranked("bm", "'bm25'"),
    "hash_embed_md5": (
        f"WITH t AS (SELECT doc_id, unnest({toks('text')}) AS token FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 15))::bigint % {DIM} AS bucket, "
        "CASE WHEN substr(md5(token), 16, 1) >= '8' THEN 1 ELSE -1 END AS sign FROM t), s AS (SELECT doc_id, bucket, sum(sign) AS s FROM h GROUP BY ALL HAVING sum(sign) <> 0) "
        "SELECT doc_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 6) AS weight FROM s"
    ),
    "dense_topk": (
        "SELECT question_id, chunk_id, rank, round(score, 6) AS score, 'dense' AS source FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM "
        "(SELECT a.vec_id AS question_id, b.vec_id AS chunk_id, list_dot_product(a.embedding::double[], b.embedding::double[]) AS score FROM embeddings a, embeddings b)) WHERE rank <= 10"
    ),
    "dense_md5_topk": _ranked("dn5", "'dense'"),
    "hybrid_topk": _ranked("hy", "'rrf'"),
    "rerank_lexical": _ranked("rr", "source"),
    "collapse_documents": query("SELECT question_id, doc_id, rank FROM coll WHERE variant = 'bm25'"),
    "pool_candidates": query("SELECT DISTINCT question_id, doc_id FROM coll WHERE variant IN ('bm25', 'dense_only') AND rank <= 5"),
    "oracle_context": query("SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_seq, ordinal) AS rank, 1.0::double AS score, 'oracle' AS source FROM rel JOIN chunks USING (doc_id)"),
    "answer_extractive": query(f"SELECT question_id, answer, citations, abstained, len({toks('prompt')}) AS prompt_tokens, len({toks('answer')}) AS completion_tokens, 0.0::double AS cost_usd FROM said"),
    "judge_offline": query("SELECT conv_id, turn, round(faithfulness, 6) AS faithfulness, round(answer_relevance, 6) AS answer_relevance, round(correctness, 6) AS correctness FROM judged"),
    "generation_metrics": query(
        "SELECT conv_id, turn, CASE WHEN NOT abstained THEN round(faithfulness, 6) END AS faithfulness, CASE WHEN NOT abstained AND NOT no_answer THEN round(answer_relevance, 6) END AS answer_relevance, "
        "round(correctness, 6) AS correctness, (abstained = no_answer)::int::double AS abstention_accuracy FROM judged"
    ),
    "abstention_accuracy": query("SELECT question_id, n = 0 AS no_answer, abstained, (abstained = (n = 0))::int::double AS abstention_accuracy FROM said JOIN nrel USING (question_id)"),
    "metrics_retrieval": query(
        "SELECT question_id, "
        + ", ".join(f"round(max(value) FILTER (metric = '{m}@{k}'), 6) AS {m}_at_{k}" for k in (1, 3, 5, 10) for m in ("recall", "ndcg", "precision"))
        + ", round(max(value) FILTER (metric = 'mrr'), 6) AS mrr FROM mv WHERE variant = 'bm25' GROUP BY question_id"
    ),
    "ablation_estimates": query("SELECT variant, metric, round(avg(value), 6) AS mean, count(value) AS n FROM mv WHERE variant <> 'bm25' AND metric NOT LIKE 'precision%' GROUP BY variant, metric"),
    "regression_gate": query(
        "SELECT metric, round(value, 6) AS value, floor, coalesce(value >= floor - 1e-6, false) AS passed FROM (VALUES ('recall@5', 0.5::double), ('mrr', 0.99::double), ('recall@10', 0.2::double), ('missing', 0.1::double)) f(metric, floor) "
        "LEFT JOIN (SELECT metric, avg(value) AS value FROM mv WHERE variant = 'hybrid_rerank' GROUP BY metric) USING (metric)"
    ),
    "bootstrap_ci": _hashed("vals", "ci", 1000, "metric, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n"),
    "paired_bootstrap": _hashed("dif", "pair", 10_000, "metric, round(mean, 6) AS diff_mean, round(least(1.0, 2 * least(p_low, p_high)), 6) AS p_value, n"),
    "wilcoxon_stat": query(
        "SELECT metric, round(avg(d), 6) AS diff_mean, least(sum(CASE WHEN d > 0 THEN r ELSE 0.0 END), sum(CASE WHEN d < 0 THEN r ELSE 0.0 END))::double AS w, "
        "round((least(sum(CASE WHEN d > 0 THEN r ELSE 0.0 END), sum(CASE WHEN d < 0 THEN r ELSE 0.0 END)) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*)::double * (count(*) + 1) * (2 * count(*) + 1) / 24), 6) AS z, count(*) AS n "
        f"FROM (SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, abs(d)) - 1) / 2.0 AS r FROM {_WILCOXON} WHERE d <> 0) GROUP BY metric"
    ),
    "cohen_kappa": "SELECT n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM (SELECT count(*) AS n, avg(((quality = 1) = (toxic = 0))::int) AS po, avg((quality = 1)::int) AS pa, avg((toxic = 0)::int) AS pb FROM labels)",
    "spearman": (
        f"WITH d AS (SELECT n_chars AS x, len({sents('text')}) AS y FROM documents), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
        "rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d) SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r"
    ),
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
}
