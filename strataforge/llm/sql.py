"""DuckDB SQL for those operators that SQL can express."""

MIX = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST((rn - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS k FROM w),
r AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             (SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM o),
f AS (SELECT rest, ws FROM r WHERE cap * ws >= w * rest ORDER BY k LIMIT 1),
t AS (SELECT w.source, w.source_size,
             CASE WHEN w.cap * f.ws < w.w * f.rest THEN CAST(w.cap AS DOUBLE) ELSE CAST(w.w * f.rest AS DOUBLE) / CAST(f.ws AS DOUBLE) END AS target FROM w, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT p.doc_id, p.size, b.source_size, b.target,
       CAST(b.epochs * p.size + greatest(0, least(p.size, CAST(floor(b.target + 0.5) AS BIGINT) - b.epochs * b.source_size - p.start)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""

PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM t),
s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
o AS (SELECT lang, k.k AS words, array_to_string(list_slice(w, i, i + k.k - 1), ' ') AS phrase FROM g, (VALUES (1), (2), (3), (4)) k(k) WHERE i + k.k - 1 <= len(w)),
f AS (SELECT lang, words, phrase, CAST(count(*) AS BIGINT) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
u AS (SELECT c.*, k.k, array_to_string(list_slice(w, 1, k.k), ' ') AS lp, array_to_string(list_slice(w, k.k + 1, words), ' ') AS rp FROM c, (VALUES (1), (2), (3)) k(k) WHERE k.k < words),
v AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.lp JOIN f y ON y.lang = u.lang AND y.phrase = u.rp),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT c.lang, c.a, c.w, c.words, n.n, unnest(range(1, c.words - n.n + 2)) AS i FROM c, (VALUES (2), (3)) n(n) WHERE n.n < c.words),
m AS (SELECT lang, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, max(a) AS cover FROM q GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE 100 * CAST(coalesce(m.cover, 0) AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM z)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM r JOIN s ON s.lang = r.lang WHERE r.rank <= 2000
"""

# crc32 of a decimal number: for each character, eight steps of the reflected polynomial.
TRIE = r"""
WITH o AS (SELECT conv_id AS c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS what, length(coalesce(text, '')) AS chars, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, what, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, what) AS pos FROM o),
k AS (SELECT c, count(*) AS own, c - c % 100 AS base,
             xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
                             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1))), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM t GROUP BY c),
s AS (SELECT k.c, k.h, k.base, least(k.h, coalesce(b.own, 0)) AS head, least(k.h, coalesce(b.own, 0)) + greatest(0, k.own - k.h) AS len FROM k LEFT JOIN k b ON b.c = k.base),
r AS (SELECT s.c, t.pos AS d, t.what, t.chars FROM s JOIN t ON t.c = s.base AND t.pos <= s.head
      UNION ALL SELECT s.c, t.pos - s.h + s.head, t.what, t.chars FROM s JOIN t ON t.c = s.c AND t.pos > s.h),
p AS (SELECT c, d, chars, list(what) OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, [] FROM s),
n AS (SELECT p.d, p.key, min(p.c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
             string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE s.len = p.d) AS ends FROM p JOIN s ON s.c = p.c GROUP BY p.d, p.key),
e AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.key[1:n.d] = n.key) AS n_children, q.conv_id AS parent FROM n LEFT JOIN n q ON q.d = n.d - 1 AND q.key = n.key[1:n.d - 1]),
u AS (SELECT a.d, a.key, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(b.saved) AS saved_tokens FROM e a JOIN e b ON b.d >= a.d AND b.key[1:a.d] = a.key GROUP BY a.d, a.key)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, e.parent AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM e JOIN u ON u.d = e.d AND u.key = e.key
"""
