"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .secrets import RULES


def op6() -> str:
    return r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bl)),
ms AS (SELECT DISTINCT m FROM bl),
dg AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hits AS (SELECT dg.doc_id, dg.i, dg.m, bg.item_id FROM dg JOIN bg ON dg.m = bg.m AND dg.g = bg.g),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op8() -> str:
    def found(kind: int) -> str:
        r = RULES[kind]
        pattern = r.pattern.replace("'", "''")
        value = f"regexp_extract_all(t, '{pattern}', {r.group})"
        return f"SELECT doc_id, {kind} AS kind, regexp_extract_all(t, '{pattern}') AS m, {value} AS v, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')"

    names = ", ".join(f"'{r.kind}'" for r in RULES)
    least = ", ".join(str(r.least) for r in RULES)
    base = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found(k) for k in range(len(RULES)))}),
e AS (SELECT doc_id, kind, i, length(m[i]) AS width, length(v[i]) AS n, length(gaps[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
p AS (SELECT doc_id, kind, n, width, CAST(sum(gap + width) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM e),
s AS (SELECT doc_id, kind, stop - width AS start, ([{names}])[kind + 1] || ':' || (stop - width) || ':' || stop AS span FROM p WHERE n >= ([{least}])[kind + 1]),
g AS (SELECT doc_id, {counts}, coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind IN ({base})), '') AS b, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


def op7() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') AS g FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.a = w.doc_id
"""


def op2() -> str:
    return """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op3() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op12() -> str:
    return r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT row, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT x.lang, x.source, x.term, CAST(count(*) AS HUGEINT) AS n FROM x JOIN k ON x.lang = k.lang AND x.term = k.term GROUP BY x.lang, x.source, x.term),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS size FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.size, 0) + l.v) AS p, 1 + 1000000000 * (k.n + 1) // (l.size + l.v) AS q
      FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
y AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(y.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM r))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op11() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
