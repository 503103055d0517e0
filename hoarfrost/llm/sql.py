"""DuckDB SQL for the queries that SQL can express, over the registered views."""

#: op2: rules by text, then rates by host shrunk towards a beta prior fitted by moments.
HOST_RULES = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT rid, len(ws) AS n, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g WHERE i <= n - 2),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY 1),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT t.doc_id, t.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS BIGINT) AS k FROM f GROUP BY 1),
m AS (SELECT avg(k / n::DOUBLE) AS m, var_samp(k / n::DOUBLE) AS s2, avg(1 / n::DOUBLE) AS inv FROM h),
v AS (SELECT m, coalesce(s2 - m * (1 - m) * inv, 0) AS v FROM m),
p AS (SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS weight FROM v),
r AS (SELECT source, (k + m * weight) / (n + weight) AS rate FROM h CROSS JOIN p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""

#: op8: every 50-byte string by its place, the smallest document that has it, and what those of smaller documents cover.
SUFFIX_DEDUP = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
u AS (SELECT rid, doc_id, b, hex(b) AS x, CAST(octet_length(b) AS BIGINT) AS n FROM t),
s AS (SELECT rid, doc_id, i, b[i + 1 : i + 50] AS w FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM u WHERE n >= 50)),
d AS (SELECT w, min(doc_id) AS least, max(doc_id) AS most FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, i FROM s JOIN d USING (w) WHERE doc_id > least),
run AS (SELECT rid, min(i) AS a, max(i) + 50 AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM
(SELECT rid, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 50, -1) THEN 1 ELSE 0 END AS fresh FROM hit)) GROUP BY rid, k),
piece AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM run),
cut AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept FROM piece JOIN u USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN cut.rid IS NULL THEN x ELSE kept || x[2 * last + 1 : 2 * n] END)) AS kept_sha256
FROM u LEFT JOIN cut USING (rid)"""


#: op13: masks of the five filters by part, met by every order of them.
FILTER_AUDIT = r"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
+ CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
+ CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(pow(2, ascii(filter_order[step]) - 65) AS INTEGER) AS own,
CAST(list_sum(list_transform(range(1, step), lambda k: pow(2, ascii(filter_order[k]) - 65))) AS INTEGER) AS earlier FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
b AS (SELECT filter_order, step, own, coalesce(earlier, 0) AS earlier FROM s)
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
CAST(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
CAST(sum(sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c CROSS JOIN b GROUP BY part, filter_order, step, own"""

#: op11: a document's periodic part is written out, four-word windows meet their repeats, and consecutive meetings at one distance are runs.
PERIODIC_RUNS = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws) AS n, xor(4294967295::BIGINT, list_reduce(range(8 * length(k)), lambda c, b: xor((CASE WHEN b % 8 = 0 THEN xor(c, ascii(k[b // 8 + 1])::BIGINT) ELSE c END) >> 1,
CASE WHEN (CASE WHEN b % 8 = 0 THEN xor(c, ascii(k[b // 8 + 1])::BIGINT) ELSE c END) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END), 4294967295::BIGINT)) AS h FROM t),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE ws[1 : a] || list_transform(range(n - a), lambda i: ws[a + i % p + 1]) END AS ws FROM p),
w AS (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM d),
f AS (SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS f, lead(i, 3) OVER o AS whole FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT x.rid, x.i, y.i - x.i AS q FROM f x JOIN f y ON x.rid = y.rid AND x.f = y.f AND x.i < y.i WHERE x.whole IS NOT NULL AND y.whole IS NOT NULL),
s AS (SELECT rid, q, min(i) AS s, count(*) + 3 + q AS n FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM m) GROUP BY rid, q, grp HAVING count(*) + 3 >= greatest(q, 12 - q)),
r AS (SELECT rid, s, n, min(q) AS q FROM s GROUP BY 1, 2, 3),
best AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, n := n, q := q), [-n, s, q]) AS b, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM r),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (rid, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""

#: op12: five-word shingles that texts have in common, the pairs that share 85 % or more, and what they connect.
CIRCULANT_MINHASH = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM
(SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS same FROM s x JOIN s y ON x.s = y.s AND x.rid <> y.rid GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a AS rid, min(doc_id) AS least FROM reach JOIN t ON t.rid = b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, least), doc_id) AS component_id, coalesce(least(doc_id, least), doc_id) = doc_id AS kept FROM t LEFT JOIN n USING (rid) LEFT JOIN least USING (rid)"""
