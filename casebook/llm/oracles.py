"""DuckDB SQL for the queries of this folder that SQL can express."""

from casebook.llm.quality import BASE_RULES, POLICIES, RULES, mask

_BITS = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
windows AS (SELECT rid, i, ws[i : i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(ws) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask(BASE_RULES)} <> 0 AS base_failed,
  fail_bits & {mask(set(POLICIES[1]) | set(BASE_RULES))} = 0 AS kept, n_lines, n_upper, n_lower, fail_bits
FROM b
"""

#: What each rule of a policy does alone, from the failures of whole documents.
ABLATIONS = f"""
WITH f AS (SELECT list_filter([{", ".join(f"CASE WHEN {fails} THEN '{name}' END" for name, fails in RULES if name in POLICIES[1])}], lambda x: x IS NOT NULL) AS failed FROM ({OP9})),
r AS (SELECT unnest({list(POLICIES[1])}) AS rule)
SELECT rule, CAST(count_if(list_contains(failed, rule)) AS BIGINT) AS n_fail, CAST(count_if(failed = [rule]) AS BIGINT) AS n_only,
  CAST(count_if(len(list_filter(failed, lambda x: x <> rule)) = 0) AS BIGINT) AS n_kept_without
FROM f, r GROUP BY rule
"""

#: Base32 of 20 bytes: each hex digit gives 4 bits, each 5 bits a letter.
OP5 = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT rid, page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM p),
bits AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: right(bin(instr('0123456789abcdef', sha[i]) + 15), 4)), lambda x, y: x || y) AS b FROM h),
d AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS BIGINT), 1)), lambda x, y: x || y) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha) AS first_id FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM d
"""

OP4 = """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, host || path AS s, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u),
l AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM r),
-- crc32 is not a DuckDB function: the fold is computed bit by bit over the bytes
texts AS (SELECT s, label, count(*) AS n FROM l GROUP BY s, label),
crc_table AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS q(i)),
crc_all AS (SELECT list(c ORDER BY i) AS t FROM crc_table),
folded AS (SELECT texts.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * octet_length(encode(s)), 2), lambda i: CAST(('0x' || substr(hex(encode(s)), i, 2)) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 5 = 0 AS fold FROM texts, crc_all),
asked AS (SELECT * FROM folded WHERE label IS NULL OR fold),
grams AS (SELECT s, label, n, fold, substr('^^^^' || s || '$', i, 5) AS gram FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM folded)),
seen AS (SELECT gram, sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS b FROM grams WHERE label IS NOT NULL AND NOT fold GROUP BY gram),
nodes AS (SELECT right(gram, j + 1) AS suffix, substr(right(gram, j + 1), 1, j) AS context, sum(a) AS a, sum(b) AS b FROM seen, range(5) AS q(j) GROUP BY ALL),
contexts AS (SELECT context, sum(a) AS ca, sum(b) AS cb, count_if(a > 0) AS ta, count_if(b > 0) AS tb FROM nodes GROUP BY context),
wanted AS (SELECT DISTINCT gram FROM grams WHERE label IS NULL OR fold),
levels AS (SELECT gram, list({'a': CAST(coalesce(a, 0) AS DOUBLE), 'b': CAST(coalesce(b, 0) AS DOUBLE), 'ca': CAST(coalesce(ca, 0) AS DOUBLE), 'cb': CAST(coalesce(cb, 0) AS DOUBLE),
    'ta': CAST(coalesce(ta, 0) AS DOUBLE), 'tb': CAST(coalesce(tb, 0) AS DOUBLE)} ORDER BY j) AS x
  FROM (SELECT gram, j, right(gram, j + 1) AS suffix, substr(right(gram, j + 1), 1, j) AS context FROM wanted, range(5) AS q(j)) w
  LEFT JOIN nodes USING (suffix) LEFT JOIN contexts ON w.context = contexts.context GROUP BY gram),
p0 AS (SELECT gram, x, 1.0::DOUBLE / 256 AS pa, 1.0::DOUBLE / 256 AS pb FROM levels),
p1 AS (SELECT gram, x, CASE WHEN x[1].ca = 0 THEN pa ELSE (x[1].a + x[1].ta * pa) / (x[1].ca + x[1].ta) END AS pa, CASE WHEN x[1].cb = 0 THEN pb ELSE (x[1].b + x[1].tb * pb) / (x[1].cb + x[1].tb) END AS pb FROM p0),
p2 AS (SELECT gram, x, CASE WHEN x[2].ca = 0 THEN pa ELSE (x[2].a + x[2].ta * pa) / (x[2].ca + x[2].ta) END AS pa, CASE WHEN x[2].cb = 0 THEN pb ELSE (x[2].b + x[2].tb * pb) / (x[2].cb + x[2].tb) END AS pb FROM p1),
p3 AS (SELECT gram, x, CASE WHEN x[3].ca = 0 THEN pa ELSE (x[3].a + x[3].ta * pa) / (x[3].ca + x[3].ta) END AS pa, CASE WHEN x[3].cb = 0 THEN pb ELSE (x[3].b + x[3].tb * pb) / (x[3].cb + x[3].tb) END AS pb FROM p2),
p4 AS (SELECT gram, x, CASE WHEN x[4].ca = 0 THEN pa ELSE (x[4].a + x[4].ta * pa) / (x[4].ca + x[4].ta) END AS pa, CASE WHEN x[4].cb = 0 THEN pb ELSE (x[4].b + x[4].tb * pb) / (x[4].cb + x[4].tb) END AS pb FROM p3),
p5 AS (SELECT gram, CASE WHEN x[5].ca = 0 THEN pa ELSE (x[5].a + x[5].ta * pa) / (x[5].ca + x[5].ta) END AS pa, CASE WHEN x[5].cb = 0 THEN pb ELSE (x[5].b + x[5].tb * pb) / (x[5].cb + x[5].tb) END AS pb FROM p4),
llr AS (SELECT gram, CAST(round((ln(pa) - ln(pb)) * 1000000) AS BIGINT) AS llr FROM p5),
scores AS (SELECT s, CAST(floor(CAST(sum(llr) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM (SELECT s, gram FROM grams WHERE label IS NULL OR fold) JOIN llr USING (gram) GROUP BY s),
bins AS (SELECT CAST(floor(score / 10000.0) AS BIGINT) AS bin, sum(CASE WHEN label = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN label = 'block' THEN n ELSE 0 END) AS b
  FROM asked JOIN scores USING (s) WHERE label IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, a_from / CAST(all_a AS DOUBLE) + (all_b - b_from) / CAST(all_b AS DOUBLE) AS gain FROM
  (SELECT bin, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b, sum(a) OVER (ORDER BY bin DESC) AS a_from, sum(b) OVER (ORDER BY bin DESC) AS b_from FROM bins) WHERE all_a > 0 AND all_b > 0),
threshold AS (SELECT coalesce((SELECT bin FROM gains ORDER BY gain DESC, bin LIMIT 1), 0) AS least)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN label WHEN coalesce(floor(score / 10000.0), 0) >= least THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN score END AS score
FROM threshold, l LEFT JOIN scores USING (s)
"""

#: All alignments of every document with every item, by equal words.
OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS x FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
iw AS (SELECT item_id, unnest(x) AS word, unnest(range(len(x))) AS k, len(x) AS n FROM i),
m AS (SELECT doc_id, item_id, n, p - k AS off, k FROM dw JOIN iw USING (word)),
a AS (SELECT doc_id, item_id, n, off, count(*) AS n_matched, list(k) AS ks FROM m GROUP BY ALL HAVING 100 * count(*) >= 80 * least(n, 20)),
ok AS (SELECT *, n > 20 AND list_bool_or(list_transform(range(0, n - 19), lambda s: 100 * len(list_filter(ks, lambda k: k >= s AND k < s + 20)) >= 1600)) AS windowed FROM a)
SELECT doc_id, item_id, CAST(off AS INTEGER) AS off, CAST(n AS INTEGER) AS n_item_words, CAST(n_matched AS INTEGER) AS n_matched FROM ok WHERE 100 * n_matched >= 80 * n OR windowed
"""

#: Every string of 400 bytes of every text, by its MD5.
OP7 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d),
strings AS (SELECT rid, i, md5(b[i : i + 399]) AS h FROM starts),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM strings) WHERE n > 1),
islands AS (SELECT rid, i, sum(CASE WHEN i <= last_i + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run
  FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS last_i FROM twice)),
runs AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS z FROM islands GROUP BY rid, run),
edges AS (SELECT rid, CAST(0 AS BIGINT) AS a, CAST(1 AS BIGINT) AS z FROM d UNION ALL SELECT rid, a, z FROM runs UNION ALL SELECT rid, octet_length(b) + 1, 0 FROM d),
kept AS (SELECT rid, z AS x, lead(a) OVER (PARTITION BY rid ORDER BY a) - 1 AS y FROM edges),
left_ AS (SELECT rid, coalesce(string_agg(CASE WHEN y >= x THEN hex(b[x : y]) ELSE '' END, '' ORDER BY x), '') AS h FROM kept JOIN d USING (rid) WHERE y IS NOT NULL GROUP BY rid),
gone AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN left_ USING (rid) LEFT JOIN gone USING (rid)
"""

#: All pairs that share a shingle, and the closure of the links.
OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE w[i : i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 1 THEN 2 ELSE len(w) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON a = na.doc_id JOIN n AS nb ON b = nb.doc_id WHERE 100 * m >= 80 * (na.n + nb.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS v FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.v = e.a),
c AS (SELECT id, min(v) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON d.doc_id = c.id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLES = {"op7_repeats": OP7, "repeats_descended": OP7, "op8_near_duplicates": OP8, "op6_decontamination": OP6, "op4_url_filter": OP4, "op5_warc": OP5, "op9_quality_rules": OP9, "quality_ablations": ABLATIONS}

#: The unsigned crc32 of a decimal number, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, e: CASE WHEN xor(x, e) & 1 = 1 THEN xor(xor(x, e) >> 1, 3988292384) ELSE xor(x, e) >> 1 END))"""

ORACLES["op12_periods"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w, {CRC.format("doc_id")} AS h FROM documents),
f AS (SELECT r, doc_id, w, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS t FROM d),
x AS (SELECT r, doc_id, len(w) AS n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // t) END + 1]) END AS w FROM f),
o AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM x),
k AS (SELECT DISTINCT u.r, u.i - v.i AS q FROM o u JOIN o v ON u.r = v.r AND u.word = v.word AND v.i < u.i AND 4 * (u.i - v.i) <= u.n
  SEMI JOIN o y ON y.r = u.r AND y.word = u.word AND y.i = 2 * v.i - u.i SEMI JOIN o z ON z.r = u.r AND z.word = u.word AND z.i = 3 * v.i - 2 * u.i),
m AS (SELECT k.r, k.q, u.i, u.i - row_number() OVER (PARTITION BY k.r, k.q ORDER BY u.i) AS g FROM k JOIN o u ON u.r = k.r JOIN o v ON v.r = k.r AND v.i = u.i - k.q AND v.word = u.word),
s AS (SELECT r, start, e - start AS length, min(q) AS period FROM (SELECT r, q, min(i) - q AS start, max(i) + 1 AS e FROM m GROUP BY r, q, g) WHERE e - start >= greatest(6, 4 * q) GROUP BY r, start, e),
a AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM s GROUP BY r),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS place FROM s) WHERE place = 1),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM o ANTI JOIN (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM s) AS gone USING (r, i) GROUP BY r)
SELECT x.doc_id, coalesce(a.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(a.told, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM x LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)
"""

#: Every prefix of every conversation as a list, and subtrees by the prefixes of their nodes.
ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(digest || ':' || size ORDER BY turn NULLS FIRST, digest) AS w, {CRC.format("c")} % 9 AS h FROM t GROUP BY c),
r AS (SELECT l.c, list_concat(CASE WHEN l.h > 0 AND b.w IS NOT NULL THEN b.w[1:l.h] ELSE [] END, CASE WHEN l.h < len(l.w) THEN l.w[l.h + 1:] ELSE [] END) AS w FROM l LEFT JOIN l AS b ON b.c = l.c - l.c % 5),
p AS (SELECT c, len(w) AS n, d, CASE WHEN d = 0 THEN [] ELSE w[1:d] END AS path FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM r)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * CAST(split_part(path[d], ':', 2) AS BIGINT) END AS w, CASE WHEN d > 1 THEN path[1:d - 1] WHEN d = 1 THEN [] END AS up FROM p GROUP BY path, d),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path, CAST(sum(w) AS BIGINT) AS saved_tokens, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves
  FROM (SELECT w, n_children, CASE WHEN e = 0 THEN [] ELSE path[1:e] END AS path FROM (SELECT w, n_children, path, unnest(range(d + 1)) AS e FROM m)) GROUP BY path)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256 FROM m JOIN s USING (path) LEFT JOIN n AS u ON u.path = m.up
"""
