"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT r.a, b.v FROM r JOIN b ON b.u = r.z)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(z) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

OP6 = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
    || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e, '')
    || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'Content-Type: text/html; charset=utf-8' || e
    || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') AS t, e
  FROM pages, (SELECT chr(13) || chr(10) AS e) WHERE page_id % 97 = 13)
SELECT page_id, 'damaged' AS kind, strlen(t)::BIGINT + 4 AS n_bytes, sha256(t || e || e) AS expected,
  sha256(left(t, length(t) - 1) || '~' || e || e) AS found
FROM r WHERE right(t, 1) <> '~'
"""

OP8 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS z FROM embeddings UNION SELECT r.a, l.w FROM r JOIN l ON l.u = r.z)
SELECT d.vec_id, (SELECT count(*) FROM l WHERE l.u = d.vec_id) AS n_links, m.c AS component_id, d.vec_id = m.c AS kept
FROM embeddings d JOIN (SELECT a, min(z) AS c FROM r GROUP BY 1) m ON m.a = d.vec_id
"""




def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for mark in ("[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>"):
        out = f"replace({out}, '{mark}', '{mark[0]}' || chr(92) || '{mark[1:]}')"
    return out


OP12 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, {_escaped("text")} AS body, CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[/INST]'
    ELSE '[ROLE]' || {_escaped("role")} || '[/ROLE]' END AS mark,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, body)) AS loss_sha256,
  sum(length(mark) + length(body) + 4)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(code, '' ORDER BY turn NULLS FIRST, role, body), 's?(ua)*ua?') AS valid
FROM e GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT w.lang, w.source, w.t, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.t = w.t GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)
    + 2 * (SELECT count(*) FROM k WHERE k.lang = g.lang) AS own, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang), 0)
    + 2 * (SELECT count(*) FROM k WHERE k.lang = g.lang) AS whole FROM g),
a AS (SELECT lang, t, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT m.lang, m.source, k.t, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // m.own AS p,
    1 + (1000000000::HUGEINT * (a.n + 2)) // m.whole AS q
  FROM m JOIN k ON k.lang = m.lang JOIN a ON a.lang = k.lang AND a.t = k.t
  LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.t = k.t),
s AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY 1, 2, 3),
o AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', t, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dups": OP4, "op6_fixity": OP6, "op8_vector_dups": OP8, "op12_chat_format": OP12,
            "op13_divergence": OP13}
