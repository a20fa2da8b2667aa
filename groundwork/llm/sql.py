"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .chat_format import CLOSE, COLON, COLON_ESCAPE, ESCAPES, JOIN, LOSS_ROLE, OPEN
from .license_scan import LICENSE_NAME, TAG, TAG_END, TEMPLATES


def _q(text: str) -> str:
    """A literal; control characters by their codes."""
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _escaped(x: str, pairs) -> str:
    for plain, code in pairs:
        x = f"replace({x}, {_q(plain)}, {_q(code)})"
    return x


_HARD = _q("\\### Assistant: </turn> ok")
_TURNS = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
_LOSS = f"coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', {_HARD} UNION ALL SELECT -7, 1, 'assistant', {_HARD}),
     p AS (SELECT *, lag(role) OVER ({_TURNS}) AS before FROM t),
     c AS (SELECT *, length({_escaped('text', ESCAPES)}) + CASE WHEN before = role THEN {len(JOIN)}
                  ELSE {len(OPEN) + len(COLON) + len(CLOSE)} + length({_escaped('role', (*ESCAPES, COLON_ESCAPE))}) END AS n FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       length({_LOSS}) AS loss_chars, sha256({_LOSS}) AS loss_sha256, sum(n)::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
     k AS MATERIALIZED (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), '|')) ELSE 'none ' || doc_id END AS h FROM s),
     r AS MATERIALIZED (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY h),
     i AS MATERIALIZED (SELECT rep, n, unnest(s) AS g FROM r),
     l AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM i a JOIN i b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
     e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     c AS (SELECT rep AS id, rep AS reach FROM r UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.reach),
     m AS (SELECT id, min(reach) AS component FROM c GROUP BY id),
     d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, m.component AS component_id, coalesce(d.links, 0) AS n_links
FROM k JOIN r USING (h) JOIN m ON m.id = r.rep LEFT JOIN d ON d.a = r.rep
"""

_TEMPLATES = ", ".join(f"({n}, {_q(name)}, {_q(text)})" for n, (name, text) in enumerate(TEMPLATES))
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

LICENSES = rf"""
WITH f AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents),
     g(t, license_id, text) AS (VALUES {_TEMPLATES}),
     gt AS (SELECT t, license_id, term, count(*) AS tf FROM (SELECT t, license_id, unnest({_TOKENS.format('text')}) AS term FROM g) GROUP BY ALL),
     n AS (SELECT count(*) AS n FROM f),
     ft AS (SELECT path, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM f),
     idf AS MATERIALIZED (SELECT term, ln((n + 1.0) / (count(ft.path) + 1.0)) + 1.0 AS idf FROM (SELECT DISTINCT term FROM gt) LEFT JOIN ft USING (term) CROSS JOIN n GROUP BY term, n),
     gv AS MATERIALIZED (SELECT t, license_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS tw FROM gt JOIN idf USING (term)),
     u AS (SELECT path, 'line' AS kind, unnest(string_split(text, chr(10))) AS part FROM f UNION ALL
           SELECT path, 'block', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM f UNION ALL SELECT path, 'file', text FROM f),
     un AS MATERIALIZED (SELECT row_number() OVER () AS id, path, kind, part FROM u),
     ut AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS.format('part')}) AS term FROM un) GROUP BY ALL),
     uw AS MATERIALIZED (SELECT id, term, tf * coalesce(idf, ln(n + 1.0) + 1.0) AS w FROM ut LEFT JOIN idf USING (term) CROSS JOIN n),
     nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM uw GROUP BY id),
     dt AS (SELECT id, t, license_id, sum(w * tw) AS dot FROM uw JOIN gv USING (term) GROUP BY ALL),
     sc AS MATERIALIZED (SELECT path, kind, license_id, round(dot / norm, 6) AS score FROM dt JOIN nm USING (id) JOIN un USING (id) WHERE round(dot / norm, 6) >= 0.6
            UNION ALL SELECT path, kind, regexp_replace(regexp_extract(part, {_q(TAG)}, 1), {_q(TAG_END)}, ''), 1.0 FROM un WHERE kind = 'line' AND regexp_extract(part, {_q(TAG)}, 1) <> ''),
     ow AS MATERIALIZED (SELECT path, license_id, score, whole FROM (SELECT path, license_id, max(score) AS score, row_number() OVER (PARTITION BY path ORDER BY max(score) DESC, license_id) AS r FROM sc GROUP BY path, license_id)
            JOIN (SELECT path, bool_or(kind = 'file') AS whole FROM sc GROUP BY path) USING (path) WHERE r = 1),
     law AS MATERIALIZED (SELECT * FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS above, path AS source, license_id, score, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) AS r
             FROM ow WHERE whole OR regexp_matches(regexp_extract(path, '[^/]*$'), {_q(LICENSE_NAME)})) WHERE r = 1),
     fd AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM f),
     ih AS MATERIALIZED (SELECT folder, source, license_id, score FROM (SELECT folder, law.*, row_number() OVER (PARTITION BY folder ORDER BY length(above) DESC) AS k
             FROM fd JOIN law ON above = '' OR folder = above OR starts_with(folder, above || '/')) WHERE k = 1)
SELECT f.doc_id, f.path, coalesce(ow.license_id, ih.license_id) AS license_id, coalesce(ow.score, ih.score) AS score,
       CASE WHEN ow.license_id IS NOT NULL THEN 'own' WHEN ih.license_id IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN ow.license_id IS NOT NULL THEN f.path ELSE ih.source END AS license_path
FROM f LEFT JOIN ow USING (path) LEFT JOIN ih ON ih.folder = regexp_replace(f.path, '/?[^/]*$', '')
"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     w AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM q),
     h AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
     g AS (SELECT lang, 1 AS k, w1 AS phrase FROM h UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM h UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM h
           UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM h UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM h),
     f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL),
     n AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
     i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda s: array_to_string(w[s:s + m - 1], ' '))))) AS phrase FROM c WHERE k >= 3),
     b AS (SELECT lang, phrase, max(a) AS within FROM i GROUP BY ALL),
     d AS (SELECT c.* FROM c LEFT JOIN b USING (lang, phrase) WHERE within IS NULL OR 100 * within < 100 * a),
     x AS MATERIALIZED (SELECT d.*, cut, array_to_string(w[:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM d, unnest(range(1, k)) t(cut)),
     y AS MATERIALIZED (SELECT x.*, f.f AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.p1),
     z AS MATERIALIZED (SELECT y.*, f.f AS r FROM y JOIN f ON f.lang = y.lang AND f.phrase = y.p2),
     s AS (SELECT z.lang, z.phrase, a, cut, l, r, n, (1000::hugeint * a * n // (l::hugeint * r))::bigint AS score FROM z JOIN n USING (lang)),
     o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s) WHERE best = 1),
     t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""

_BLOCK = r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|section|blockquote|pre)(?:\s[^>]*)?>"
_DECODED = "x"
for _name, _char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
    _DECODED = f"replace({_DECODED}, {_q(_name)}, {_q(_char)})"

#: These tables' pages hold their text in one ``article`` element, which says what the cut must find.
PAGES = rf"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS html FROM pages),
     b AS (SELECT page_id, url, list_transform(regexp_split_to_array(html, '{_BLOCK}'), lambda x: trim(regexp_replace({_DECODED.replace("(x", "(regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')", 1)}, '\s+', ' ', 'g'))) AS b FROM a),
     t AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": LICENSES,
    "op6_ngram_jaccard_join": JACCARD,
    "op10_chat_formatting": CHAT,
    "op11_html_extraction": PAGES,
    "op12_phrase_collocations": PHRASES,
}
