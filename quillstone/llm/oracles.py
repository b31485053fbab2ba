"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from . import licenses

TOP_K = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0),
 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
 SELECT * FROM r WHERE rank <= 20"""

# {links} gives rows (a, b) in both directions, {nodes} rows (n)
_REACH = "RECURSIVE {before}, reach(n, r) AS (SELECT n, n FROM nodes UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n), root AS (SELECT n, min(r) AS r FROM reach GROUP BY n)"

NEAR_DUPLICATES = "WITH " + _REACH.format(before=r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM w WHERE len(w) > 0),
 z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9), nodes AS (SELECT doc_id AS n FROM documents)""") + " SELECT n AS doc_id, r AS class_id, n = r AS kept FROM root"

NEAR_VECTORS = "WITH " + _REACH.format(before="""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9), nodes AS (SELECT vec_id AS n FROM embeddings)""") + " SELECT n AS vec_id, (SELECT count(*) FROM links WHERE a = n) AS n_links, r AS component_id, n = r AS kept FROM root"


def _canonical(x: str) -> str:
    t = f"lower({x})"
    t = rf"CASE WHEN regexp_matches({x}, '(?i)copyright|\(c\)|©') THEN regexp_replace({t}, '(?m)^[^\S\n]*(?:copyright[^\S\n]+(?:\(c\)|©|[0-9])|\(c\)|©)[^\n]*$', '', 'g') ELSE {t} END"
    t = rf"' ' || regexp_replace(replace({t}, '&', ' and '), '[!-/:-@\[-`{{-~‘’“”«»–—…\s]+', ' ', 'g') || ' '"
    for a, b in licenses.SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"sha256(trim({t}))"


def licences() -> str:
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in (*licenses.NOTICES, *licenses.TEXTS))
    return f"""WITH kn AS (SELECT min(n) AS n, {_canonical('t')} AS d FROM (VALUES {rows}) k(n, t) GROUP BY 2), li AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
 hi AS (SELECT doc_id, string_agg(DISTINCT n, ',' ORDER BY n) AS notices, count(DISTINCT n) AS n_notices FROM li JOIN kn ON kn.d = {_canonical('line')} WHERE trim(line) <> '' GROUP BY doc_id)
 SELECT doc_id, kn.n AS license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices FROM documents LEFT JOIN hi USING (doc_id) LEFT JOIN kn ON trim(text) <> '' AND kn.d = {_canonical('text')}"""
