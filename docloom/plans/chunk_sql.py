"""The chunker as recursive SQL: each fold is a chain of passages, of which every one names the unit that the next begins with.

Where a passage ends follows from running totals of lengths, looked up by ASOF joins, so the recursion
takes a step for each passage and not for each word.
"""

#: Common table expressions up to `passages` (document_id, chunk_index, text), over documents (doc_id, text).
CHUNK_SQL = r"""
    norm AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(9), ' '), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(11) || chr(12)) AS t
             FROM documents WHERE text <> ''),
    split AS MATERIALIZED (SELECT doc_id, generate_subscripts(ps, 1) AS o, trim(unnest(ps), ' ' || chr(10) || chr(13) || chr(11) || chr(12)) AS para FROM (SELECT doc_id, string_split_regex(t, '\n\s*\n') AS ps FROM norm)),
    paras AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, para, len(para) > 600 AS long,
                     regexp_matches(para, '^(#{1,6}\s|[0-9]+\.\s|[A-Z][A-Z\s]{2,}:)') AS heading FROM split WHERE para <> ''),
    sentences AS MATERIALIZED (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, unnest(ss) AS sent
                  FROM (SELECT doc_id, i, string_split_regex(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM paras WHERE long)),
    -- words of long sentences, and of long paragraphs under number 0
    texts AS MATERIALIZED (SELECT doc_id, i, 0 AS j, para AS t FROM paras WHERE long UNION ALL SELECT doc_id, i, j, sent FROM sentences WHERE len(sent) > 600),
    words AS MATERIALIZED (SELECT doc_id, i, j, generate_subscripts(ws, 1) AS k, unnest(ws) AS w FROM (SELECT doc_id, i, j, string_split_regex(trim(t), '\s+') AS ws FROM texts)),
    ends AS MATERIALIZED (SELECT *, sum(len(w) + 1) OVER (PARTITION BY doc_id, i, j ORDER BY k) AS e FROM words),
    word_next AS MATERIALIZED (SELECT a.doc_id, a.i, a.j, a.k, greatest(a.k, coalesce(b.k, 0)) AS last
                  FROM (SELECT *, e - len(w) - 1 + 601 AS room FROM ends) a ASOF LEFT JOIN ends b ON a.doc_id = b.doc_id AND a.i = b.i AND a.j = b.j AND a.room >= b.e),
    word_chain(doc_id, i, j, k, last) AS (
      SELECT doc_id, i, j, k, last FROM word_next WHERE k = 1 UNION ALL
      SELECT n.doc_id, n.i, n.j, n.k, n.last FROM word_chain c JOIN word_next n ON n.doc_id = c.doc_id AND n.i = c.i AND n.j = c.j AND n.k = c.last + 1),
    word_all AS MATERIALIZED (SELECT c.doc_id, c.i, c.j, c.k, string_agg(w, ' ' ORDER BY e.k) AS part FROM word_chain c JOIN ends e ON e.doc_id = c.doc_id AND e.i = c.i AND e.j = c.j AND e.k BETWEEN c.k AND c.last GROUP BY ALL),
    word_parts AS MATERIALIZED (SELECT doc_id, i, j, coalesce(list(part ORDER BY k) FILTER (WHERE len(part) >= 80), [substring(any_value(t), 1, 600)]) AS parts FROM word_all JOIN texts USING (doc_id, i, j) GROUP BY doc_id, i, j),
    -- sentences of long paragraphs; a long one stands for its first part and begins a passage
    units AS MATERIALIZED (SELECT s.doc_id, s.i, s.j, len(sent) > 600 AS long, CASE WHEN len(sent) > 600 THEN parts[1] ELSE sent END AS u FROM sentences s LEFT JOIN word_parts w ON w.doc_id = s.doc_id AND w.i = s.i AND w.j = s.j),
    unit_ends AS MATERIALIZED (SELECT *, sum(len(u) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) AS e, min(CASE WHEN long THEN j END) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_long FROM units),
    unit_next AS MATERIALIZED (SELECT a.doc_id, a.i, a.j, least(greatest(a.j, coalesce(b.j, 0)), coalesce(a.next_long - 1, 1000000)) AS last
                  FROM (SELECT *, e - len(u) - 1 + 601 AS room FROM unit_ends) a ASOF LEFT JOIN unit_ends b ON a.doc_id = b.doc_id AND a.i = b.i AND a.room >= b.e),
    unit_chain(doc_id, i, j, last) AS (
      SELECT doc_id, i, j, last FROM unit_next WHERE j = 1 UNION ALL
      SELECT n.doc_id, n.i, n.j, n.last FROM unit_chain c JOIN unit_next n ON n.doc_id = c.doc_id AND n.i = c.i AND n.j = c.last + 1),
    unit_all AS MATERIALIZED (SELECT c.doc_id, c.i, c.j, string_agg(u, ' ' ORDER BY e.j) AS part FROM unit_chain c JOIN unit_ends e ON e.doc_id = c.doc_id AND e.i = c.i AND e.j BETWEEN c.j AND c.last GROUP BY ALL),
    unit_parts AS MATERIALIZED (SELECT doc_id, i, coalesce(list(part ORDER BY j) FILTER (WHERE len(part) >= 80), []) AS parts FROM unit_all GROUP BY doc_id, i),
    para_parts AS MATERIALIZED (SELECT u.doc_id, u.i, CASE WHEN len(u.parts) > 1 THEN u.parts ELSE w.parts END AS parts FROM unit_parts u JOIN word_parts w ON w.doc_id = u.doc_id AND w.i = u.i AND w.j = 0),
    -- paragraphs; a long one stands for its last part, or for itself where it is a heading behind enough text
    open_ends AS MATERIALIZED (SELECT p.*, parts, CASE WHEN long THEN parts[-1] ELSE para END AS u, sum(len(CASE WHEN long THEN parts[-1] ELSE para END) + 2) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS e,
                    min(CASE WHEN long THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_long,
                    count(*) OVER (PARTITION BY p.doc_id) AS n FROM paras p LEFT JOIN para_parts q ON q.doc_id = p.doc_id AND q.i = p.i),
    nodes AS MATERIALIZED (SELECT *, whole, CASE WHEN whole THEN len(para) ELSE len(u) END AS start FROM open_ends, (VALUES (false), (true)) v(whole) WHERE long OR NOT whole),
    heads AS MATERIALIZED (SELECT doc_id, i, e - len(u) - 2 AS before FROM open_ends WHERE heading),
    fits AS MATERIALIZED (SELECT a.*, greatest(a.i, coalesce(b.i, 0)) + 1 AS by_size FROM (SELECT *, e + 600 - start AS room FROM nodes) a ASOF LEFT JOIN open_ends b ON a.doc_id = b.doc_id AND a.room >= b.e),
    steps AS MATERIALIZED (SELECT f.*, least(by_size, coalesce(f.next_long, 1000000), coalesce(h.i, 1000000), f.n + 1) AS stop
              FROM (SELECT *, greatest(e + 80 - start, e - 1) AS floor FROM fits) f ASOF LEFT JOIN heads h ON h.doc_id = f.doc_id AND f.floor < h.before),
    links AS MATERIALIZED (SELECT s.doc_id, s.i, s.whole, s.stop, s.n, s.start + b.e - s.e AS size, coalesce(o.heading AND o.long AND s.start + b.e - s.e > 80, false) AS next_whole
              FROM steps s JOIN open_ends b ON b.doc_id = s.doc_id AND b.i = s.stop - 1 LEFT JOIN open_ends o ON o.doc_id = s.doc_id AND o.i = s.stop),
    chain(doc_id, i, whole, stop, n, size, next_whole) AS (
      SELECT * FROM links WHERE i = 1 AND NOT whole UNION ALL
      SELECT l.* FROM chain c JOIN links l ON l.doc_id = c.doc_id AND l.i = c.stop AND l.whole = c.next_whole),
    closed AS MATERIALIZED (SELECT c.doc_id, c.i, c.whole, c.stop > c.n AS final, string_agg(CASE WHEN c.whole AND o.i = c.i THEN para ELSE u END, chr(10) || chr(10) ORDER BY o.i) AS t
               FROM chain c JOIN open_ends o ON o.doc_id = c.doc_id AND o.i BETWEEN c.i AND c.stop - 1 GROUP BY ALL),
    early AS (SELECT c.doc_id, c.i, generate_subscripts(parts[:-2], 1) AS k, unnest(parts[:-2]) AS t FROM chain c JOIN para_parts p ON p.doc_id = c.doc_id AND p.i = c.i WHERE NOT c.whole),
    kept AS MATERIALIZED (SELECT doc_id, i, k, t, false AS final FROM early UNION ALL SELECT doc_id, i, 1000000, t, final FROM closed WHERE len(CASE WHEN final THEN trim(t, ' ' || chr(10)) ELSE t END) >= 80),
    chunks AS MATERIALIZED (SELECT doc_id, i, k, t FROM kept UNION ALL
               SELECT doc_id, i, 1000000, t FROM closed WHERE final AND len(trim(t, ' ' || chr(10))) < 80 AND doc_id NOT IN (SELECT doc_id FROM kept)),
    numbered AS (SELECT doc_id, row_number() OVER w - 1 AS chunk_index, t, lag(t) OVER w AS before FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY i, k)),
    passages AS (SELECT doc_id AS document_id, chunk_index::INTEGER AS chunk_index,
                        CASE WHEN before IS NULL THEN t ELSE regexp_replace(right(before, 120), '^\S+\s', '') || ' ' || t END AS text FROM numbered)"""
