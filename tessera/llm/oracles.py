"""DuckDB SQL for the numbered queries that SQL can express."""

_CONTROL = r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|turn\|>|<\|text\|>|<\|end\|>"

OP8 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + 4 + sum(8 + 8 + 7 + length(role) + length(text)
    + 2 * len(regexp_extract_all(role || chr(10) || text, '{_CONTROL}'))
    - len(regexp_extract_all(role || chr(10) || text, '\\'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, s.n, item_id FROM spots s JOIN items USING (win) WHERE s.n = items.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_REACH = """reach AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

OP1 = rf"""
WITH RECURSIVE v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id AS id, label, e FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
nodes AS (SELECT id FROM good), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS BIGINT) AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
h AS (SELECT id, md5_number(x) AS x FROM s),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM h x JOIN h y ON x.x = y.x AND x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 180 * c >= 80 * (na.n + nb.n)),
nodes AS (SELECT id FROM n), {_REACH}
SELECT d.id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.id) AS component_id FROM d LEFT JOIN n ON n.id = d.id LEFT JOIN comp ON comp.id = d.id
"""

ORACLES: dict[str, str] = {"op1_embedding_near_dedup": OP1, "op7_ngram_jaccard_join": OP7, "op8_chat_formatting": OP8, "op10_benchmark_decontamination": OP10}

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT md5(win) AS h FROM spots GROUP BY md5(win) HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM spots WHERE md5(win) IN (SELECT h FROM twice)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

ORACLES["op4_substring_dedup"] = OP4

OP12 = r"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT id, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY id, run),
keyed AS (SELECT run, c, hex(encode(id || ':' || run)) AS k FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(k) / 2 AS BIGINT)), lambda j: CAST('0x' || substr(k, 2 * CAST(j AS INT) + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS h FROM keyed, tab),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
-- two words are near if one is the other without a letter, or both are the same without the letter at the same place
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS p FROM w)),
near AS (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.p = y.p AND x.word <> y.word
  UNION SELECT x.word, y.word FROM cuts x JOIN w y ON x.rest = y.word
  UNION SELECT y.word, x.word FROM cuts x JOIN w y ON x.rest = y.word),
best AS (SELECT a, count(*) AS n_near, min({'less': -y.n, 'word': b}) AS top FROM near JOIN w y ON y.word = b GROUP BY a),
led AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.word END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n FROM w LEFT JOIN best ON a = w.word),
path AS (SELECT word, form AS pos, 1 AS k FROM led WHERE form IS NOT NULL UNION ALL SELECT p.word, l.form, k + 1 FROM path p JOIN led l ON l.word = p.pos WHERE l.form IS NOT NULL),
ends AS (SELECT word, arg_max(pos, k) AS root FROM path GROUP BY word)
SELECT led.word, form, coalesce(root, led.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM led LEFT JOIN ends USING (word)
"""

OP13 = r"""
WITH RECURSIVE
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS k FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(range(CAST(length(k) / 2 AS BIGINT)), lambda j: CAST('0x' || substr(k, 2 * CAST(j AS INT) + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 20 AS h FROM keyed, tab),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM rows),
judged AS (SELECT *, substr(role, 1, 1) AS r, said = '' AS blank, said <> '' AND seen > 1 AS dup, said <> '' AND seen = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM placed),
sums AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM judged) GROUP BY conv_id),
-- stacks by their top: none, after s, after u, after a; each with cost and audit; inserts are put after each row
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS c0, '' AS t0, CAST(NULL AS INT) AS cs, '' AS ts, 2 AS cu, 'I' AS tu, 4 AS ca, 'II' AS ta FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, b0.c, b0.t, bs.c, bs.t, u.c, u.t, a.c, a.t FROM (
    SELECT *, list_min([u1, {'c': a1.c + 2, 't': a1.t || 'I'}, {'c': coalesce(b0.c, 99999999) + 2, 't': b0.t || 'I'}, {'c': coalesce(bs.c, 99999999) + 2, 't': bs.t || 'I'}]) AS u, list_min([a1, {'c': least(u1.c, a1.c + 2, coalesce(b0.c, 99999999) + 2, coalesce(bs.c, 99999999) + 2) + 2, 't': list_min([u1, {'c': a1.c + 2, 't': a1.t || 'I'}, {'c': coalesce(b0.c, 99999999) + 2, 't': b0.t || 'I'}, {'c': coalesce(bs.c, 99999999) + 2, 't': bs.t || 'I'}]).t || 'I'}]) AS a FROM (
      SELECT w.conv_id, j.i,
        {'c': c0 + 3, 't': t0 || 'D'} AS b0,
        list_min([{'c': coalesce(cs, 99999999) + 3, 't': ts || 'D'}, CASE WHEN r = 's' AND NOT gone THEN {'c': c0 + e, 't': t0 || 'K'} ELSE {'c': 99999999, 't': ''} END]) AS bs,
        list_min([{'c': cu + 3, 't': tu || 'D'}] || CASE WHEN gone THEN [] ELSE [{'c': c0 + e + x, 't': t0 || y}, {'c': coalesce(cs, 99999999) + e + x, 't': ts || y}, {'c': ca + e + x, 't': ta || y}] END) AS u1,
        list_min([{'c': ca + 3, 't': ta || 'D'}] || CASE WHEN gone THEN [] ELSE [{'c': cu + e + z, 't': tu || v}] END) AS a1
      FROM walk w JOIN (SELECT *, blank OR dup AS gone, CAST(cut AS INT) AS e, CASE r WHEN 'u' THEN 0 ELSE 2 END AS x, CASE r WHEN 'u' THEN 'K' ELSE 'R' END AS y, CASE r WHEN 'a' THEN 0 ELSE 2 END AS z, CASE r WHEN 'a' THEN 'K' ELSE 'R' END AS v FROM judged) j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1))),
ended AS (SELECT w.conv_id, list_min([{'c': c0, 't': t0}, {'c': ca, 't': ta}]) AS best FROM walk w LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(s.n, 0)),
-- the edit of each letter of the audit, the row it takes, and its place in the result
letters AS (SELECT conv_id, best.t AS audit, k, substr(best.t, CAST(k AS INT), 1) AS x, k - length(replace(substr(best.t, 1, CAST(k AS INT)), 'I', '')) AS inserted, length(replace(substr(best.t, 1, CAST(k AS INT)), 'D', '')) AS pos FROM (SELECT *, unnest(range(1, length(best.t) + 1)) AS k FROM ended)),
kept AS (SELECT l.conv_id, pos, x, j.role, j.text, j.r FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.k - l.inserted AND l.x <> 'I' WHERE x <> 'D'),
led AS (SELECT *, CAST(max(CASE WHEN pos = 1 AND x = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS INT) AS sys FROM kept),
said AS (SELECT conv_id, string_agg((CASE WHEN x = 'K' THEN role WHEN (pos - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body FROM led GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.t AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ended e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES |= {"op12_spelling_variants": OP12, "op13_conversation_repair": OP13}
