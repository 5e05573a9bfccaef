"""The registered queries of the training-data operators, and the SQL of those that SQL can express.

SQL expresses quotation linking, near-duplicate groups, repeated substrings, hard negatives and the prefix trie. Trained
models (op3, op8), byte formats and digests of them (op5, op9, op11), the graph search (op6) and the heuristics of packing and sharding (op4, op10) are beyond
it; tests/llm hold those against brute force, libraries, round trips and held-out rows.
"""

from __future__ import annotations

from . import bpe, langid, minhash, negatives, nndescent, packing, quotes, replay, sharding, suffixes, tiff, toxicity, trie

QUERIES = {
    "op1_quotation_linking": quotes.query,
    "op2_minhash": minhash.query,
    "op3_toxicity": toxicity.query,
    "op4_packing": packing.query,
    "op5_tiff": tiff.query,
    "op6_nn_descent": nndescent.query,
    "op7_suffix_array": suffixes.query,
    "op8_language_id": langid.query,
    "op9_bpe": bpe.query,
    "op10_sharding": sharding.query,
    "op11_merge_replay": replay.query,
    "op12_hard_negatives": negatives.query,
    "op13_prefix_trie": trie.query,
}

_OP1 = r"""
WITH RECURSIVE before AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn),
asked AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN p.text IS NULL OR (c.conv_id + c.turn) % 4 = 0 THEN c.text ELSE concat('On turn ', c.turn - 1, ' they wrote:', chr(10),
    CASE WHEN (c.conv_id + c.turn) % 4 = 2 AND g.text IS NOT NULL THEN concat('> On turn ', c.turn - 2, ' they wrote:', chr(10), '> > ', replace(g.text, chr(10), concat(chr(10), '> > ')), chr(10)) ELSE '' END,
    '> ', replace(CASE WHEN (c.conv_id + c.turn) % 4 = 3 THEN regexp_replace(split_part(p.text, chr(10), 1), '^[^ ]+ ', '') ELSE p.text END, chr(10), concat(chr(10), '> ')),
    chr(10), chr(10), coalesce(c.text, '')) END AS text
  FROM conversations c LEFT JOIN before p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN before g ON g.conv_id = c.conv_id AND g.turn = c.turn - 2),
numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS m FROM asked),
split AS (SELECT m, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM numbered),
marked AS (SELECT m, k, line, regexp_extract(line, '^([ \t]*>)*') AS mark FROM split),
lined AS (SELECT m, k, length(mark) - length(replace(mark, '>', '')) AS depth, CASE WHEN mark = '' THEN line ELSE trim(substr(line, length(mark) + 1)) END AS rest FROM marked),
shown AS (SELECT m, k, depth, trim(rest) AS rest, lag(k) OVER w AS before, lag(depth) OVER w AS d0, lag(trim(rest)) OVER w AS r0, lead(depth) OVER w AS d2 FROM lined WHERE trim(rest) <> '' WINDOW w AS (PARTITION BY m ORDER BY k)),
whose AS (SELECT m, k, before, regexp_full_match(rest, 'On\b.*\bwrote:') AS alone, depth = d0 AND regexp_full_match(concat(r0, ' ', rest), 'On\b.*\bwrote:') AS two FROM shown WHERE d2 > depth),
gone AS (SELECT m, k FROM whose WHERE alone OR two UNION SELECT m, before FROM whose WHERE NOT alone AND two),
deep AS (SELECT * FROM lined ANTI JOIN gone USING (m, k)),
cut AS (SELECT *, CASE WHEN depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY m ORDER BY k) OR (depth > 0 AND rest = '') THEN 1 ELSE 0 END AS brk FROM deep),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY m ORDER BY k) AS run FROM cut),
bodies AS (SELECT m, trim(coalesce(string_agg(rest, chr(10) ORDER BY k) FILTER (depth = 0), ''), concat(' ', chr(9), chr(10), chr(13))) AS body FROM deep GROUP BY m),
quoted AS (SELECT m, depth AS level, array_to_string(regexp_extract_all(lower(string_agg(rest, chr(10) ORDER BY k)), '[\p{L}\p{N}_]+'), ' ') AS norm FROM runs WHERE depth > 0 AND rest <> '' GROUP BY m, run, depth),
said AS (SELECT m, norm, level FROM quoted WHERE norm <> ''),
own AS (SELECT conv_id, turn, concat(' ', array_to_string(regexp_extract_all(lower(body), '[\p{L}\p{N}_]+'), ' '), ' ') AS words FROM bodies JOIN numbered USING (m) WHERE turn IS NOT NULL AND body <> ''),
linked AS (SELECT n.conv_id, n.turn, s.level, s.norm, min(w.turn) AS original FROM said s JOIN numbered n USING (m) JOIN own w ON w.conv_id = n.conv_id AND w.turn < n.turn AND contains(w.words, concat(' ', s.norm, ' ')) GROUP BY ALL),
parents AS (SELECT conv_id, turn, arg_min(original, level) AS parent, cast(sum(k) AS BIGINT) AS n_linked FROM (SELECT conv_id, turn, level, max(original) AS original, count(*) AS k FROM linked GROUP BY ALL) GROUP BY conv_id, turn),
up AS (SELECT conv_id, turn, parent AS root, cast(1 AS BIGINT) AS depth FROM parents UNION ALL SELECT u.conv_id, u.turn, p.parent, u.depth + 1 FROM up u JOIN parents p ON p.conv_id = u.conv_id AND p.turn = u.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
flat AS (SELECT n.conv_id, n.turn, n.role, b.body, cast((SELECT count(*) FROM said s WHERE s.m = n.m) AS INT) AS n_quotes, coalesce(p.n_linked, 0) AS n_linked, coalesce(p.parent, -1) AS parent_turn, coalesce(r.root, n.turn) AS root_turn, coalesce(r.depth, 0) AS depth
  FROM numbered n JOIN bodies b USING (m) LEFT JOIN parents p ON p.conv_id = n.conv_id AND p.turn = n.turn LEFT JOIN roots r ON r.conv_id = n.conv_id AND r.turn = n.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, body NULLS FIRST) - 1 AS position FROM flat
"""

_OP2 = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) ELSE w END AS s FROM worded),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, component_id = doc_id AS kept FROM sets JOIN least ON a = doc_id
"""

_OP7 = r"""
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM hexed WHERE length(h) >= 100),
windows AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS x FROM starts),
firsts AS (SELECT x, min(doc_id) AS first FROM windows GROUP BY x HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT DISTINCT doc_id, i FROM windows JOIN firsts USING (x) WHERE first < doc_id),
breaks AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS brk FROM hits),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM breaks),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS last FROM spans),
cut AS (SELECT doc_id, cast(sum(hi - lo) AS BIGINT) AS gone, count(*) AS n, max(hi) AS stop, string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo) AS head FROM gaps JOIN hexed USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(stop, 0) + 1)))) AS kept_sha256
FROM hexed LEFT JOIN cut USING (doc_id)
"""

_OP12 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, cast(list_inner_product(a.q, c.q) AS BIGINT) AS s FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (SELECT a, c AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, c) <= 5),
near AS (SELECT p.a, p.p, p.ps, n.c, n.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.c) AS r FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * ps <= 100 * n.s AND 100 * n.s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, cast(r AS INT) AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM near WHERE r <= 5
"""

# crc32 by its table: the numbers below 256, each divided eight times by the polynomial.
_OP13 = r"""
WITH RECURSIVE bits AS (SELECT range AS i, cast(range AS BIGINT) AS x, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY p) AS l FROM turns GROUP BY c),
heads AS (SELECT c, l, xor(list_reduce(list_transform(string_split(cast(c AS VARCHAR), ''), lambda s: cast(ascii(s) AS BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295) % 6 AS h FROM own, crc),
built AS (SELECT o.c, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS l FROM heads o LEFT JOIN own b ON b.c = o.c - o.c % 100),
members AS (SELECT c, d, l[1:d] AS k, len(l) = d AS last FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(cast(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM members GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n.n - 1) * length(n.k[d].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN kids USING (d, k)),
below AS (SELECT e AS d, k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, cast(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM known v JOIN below USING (d, k) LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.k[1:v.d - 1]
"""

ORACLE_SQL: dict[str, str] = {"op1_quotation_linking": _OP1, "op2_minhash": _OP2, "op7_suffix_array": _OP7, "op12_hard_negatives": _OP12, "op13_prefix_trie": _OP13}
