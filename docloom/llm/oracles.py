"""DuckDB SQL for the operators of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

VECTOR_GROUPS = """
    WITH RECURSIVE v AS (
      SELECT vec_id, embedding::DOUBLE[] AS e,
             coalesce(embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS valid FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
              WHERE a.valid AND b.valid AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.c = l.a),
    least AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
    FROM v JOIN least ON least.a = v.vec_id LEFT JOIN degree d ON d.a = v.vec_id"""

REPEATED_WINDOWS = r"""
    WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
    rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT DISTINCT r, i + k AS p FROM rep, range(0, 35) t(k)),
    words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY words.r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (r)"""

REPEATED_BYTES = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
    win AS (SELECT doc_id, i, md5(substr(hx, 2 * i - 1, 200)) AS h FROM (SELECT doc_id, hx, unnest(range(1, len(hx) // 2 - 98)) AS i FROM d WHERE len(hx) >= 200)),
    earliest AS (SELECT h, min((doc_id::HUGEINT << 40) + i) AS first FROM win GROUP BY h HAVING count(*) > 1),
    late AS (SELECT doc_id, i FROM win JOIN earliest USING (h) WHERE (doc_id::HUGEINT << 40) + i > first),
    edges AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM late),
    numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
    runs AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM numbered GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS b FROM runs
             UNION ALL SELECT doc_id, coalesce(max(runs.b), 0) + 1, len(any_value(hx)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(substr(hx, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) WHERE b >= a GROUP BY doc_id),
    gone AS (SELECT doc_id, sum(b - a + 1) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
    SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

HARD_NEGATIVES = """
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id, b.label,
                 list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
          FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
    pos AS (SELECT ar, anchor_id, br, vec_id AS positive_id, score AS p FROM s WHERE label = al
            QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
    SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY pos.ar, pos.br ORDER BY score DESC, vec_id)::INTEGER AS rank,
           vec_id AS negative_id, p AS positive_score, score AS negative_score
    FROM pos JOIN s ON s.ar = pos.ar AND s.label <> s.al AND 80 * p <= 100 * score AND 100 * score <= 100 * p
    QUALIFY rank <= 5"""
