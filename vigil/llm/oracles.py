"""The same as DuckDB SQL for the operators whose results SQL can express. Quadratic, so for small tables only."""

from __future__ import annotations

from .secrets import BASE, MOST_OWNERS, MOST_REPOSITORIES, OPAQUE, PLACEHOLDER

#: Connected components of pairs (a, b), both ways, over nodes (id): the smallest id reachable.
_REACH = """reach AS (SELECT id, id AS r FROM nodes UNION SELECT p.b, reach.r FROM reach JOIN pairs p ON p.a = reach.id AND reach.r < p.b), least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

NEAR_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM v), {_REACH}
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN least ON id = vec_id"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d JOIN least ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, source, lang, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')"""


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(_matches(i, *b) for i, b in enumerate((*BASE, OPAQUE)))}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
x AS (SELECT r, source, lang, rank, kind, v[i] AS value, (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a, a + length(m[i]) AS b FROM i WHERE length(v[i]) >= least),
c AS (SELECT * FROM x WHERE kind <> '{OPAQUE[0]}' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND NOT regexp_matches(value, '/.*/')
 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.r = x.r AND y.kind <> '{OPAQUE[0]}' AND y.a < x.b AND x.a < y.b))),
u AS (SELECT value, count(DISTINCT source) <= {MOST_OWNERS} AND count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) <= {MOST_REPOSITORIES} AND NOT regexp_matches(value, '{PLACEHOLDER}') AS live FROM c GROUP BY value),
s AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind <> '{OPAQUE[0]}') AS base,
 string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind <> '{OPAQUE[0]}' OR live) AS spans, count(*) FILTER (live) AS n_owned, count(*) FILTER (NOT live) AS n_copied FROM c JOIN u USING (value) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN s USING (r)"""

FILL_IN_MIDDLE = """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT *, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (SELECT *, substring(t, 1, p) AS pre, substring(t, p + 1, q - p) AS mid, substring(t, q + 1) AS suf FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
