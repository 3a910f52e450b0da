"""DuckDB SQL for those of the corpus queries that SQL can express, over whole tables and written apart from the operators.

op1, op4 and op6 fit models, op7 deals by seeded hashes, op8 looks for substitutions at masked places, op9, op10 and op12 need
a tokenizer: these have none.
"""

from __future__ import annotations

#: Components are found by reachability between classes of equal sets; a prefix filter by exact rarity finds the pairs.
TRIE_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words
), ids AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS c FROM grams
), sets AS MATERIALIZED (
  SELECT md5(array_to_string(s, chr(10))) AS c, any_value(s) AS s, any_value(len(s)) AS n FROM grams WHERE len(s) > 0 GROUP BY 1
), each AS (
  SELECT c, n, unnest(s) AS h FROM sets
), placed AS MATERIALIZED (
  SELECT c, n, h, row_number() OVER (PARTITION BY c ORDER BY f, h) AS r FROM each JOIN (SELECT h, count(*) AS f FROM each GROUP BY h) USING (h)
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.c AS a, b.c AS b FROM placed a JOIN placed b ON a.h = b.h AND a.c < b.c
  WHERE a.r <= a.n - (a.n * 90 + 99) // 100 + 1 AND b.r <= b.n - (b.n * 90 + 99) // 100 + 1 AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), linked AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, x.n AS n, y.n AS m, len(list_intersect(x.s, y.s)) AS o FROM pairs JOIN sets x ON x.c = a JOIN sets y ON y.c = b)
  WHERE 100 * o >= 90 * (n + m - o)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked
), reach(a, b) AS (
  SELECT c, c FROM sets UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b
), least AS (
  SELECT reach.a AS c, min(ids.doc_id) AS component_id FROM reach JOIN ids ON ids.c = reach.b AND ids.n > 0 GROUP BY reach.a
), degrees AS (
  SELECT a AS c, count(*) AS n_links FROM both_ways GROUP BY a
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id,
  CASE WHEN n > 0 THEN coalesce(n_links, 0) ELSE 0 END AS n_links
FROM ids LEFT JOIN least USING (c) LEFT JOIN degrees USING (c)
"""

#: Each id occurs once in these tables, so a line's place is (doc_id, pos).
LINE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), lines AS MATERIALIZED (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM docs
), grams AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split(rtrim(line, chr(13)), ' '), lambda w: w <> ''))) AS s FROM lines
), named AS MATERIALIZED (
  SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id NULLS FIRST, pos) AS place, md5(array_to_string(s, ' ')) AS c, s FROM grams WHERE len(s) > 0
), sets AS MATERIALIZED (
  SELECT c, min(place) AS place, any_value(s) AS s, any_value(len(s)) AS n FROM named GROUP BY c
), each AS (
  SELECT c, n, place, unnest(s) AS h FROM sets
), placed AS MATERIALIZED (
  SELECT c, n, place, h, row_number() OVER (PARTITION BY c ORDER BY f, h) AS r FROM each JOIN (SELECT h, count(*) AS f FROM each GROUP BY h) USING (h)
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.c AS c, b.c AS c_ FROM placed a JOIN placed b ON a.h = b.h AND a.place > b.place
  WHERE a.r <= a.n - (a.n * 4 + 4) // 5 + 1 AND b.r <= b.n - (b.n * 4 + 4) // 5 + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), like_earlier AS (
  SELECT DISTINCT pairs.c FROM pairs JOIN sets x ON x.c = pairs.c JOIN sets y ON y.c = pairs.c_
  WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)
), gone AS (
  SELECT doc_id, pos FROM named JOIN sets USING (c) LEFT JOIN like_earlier ON like_earlier.c = named.c
  WHERE named.place > sets.place OR like_earlier.c IS NOT NULL
), cut AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN kept END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN CAST(0 AS DOUBLE) ELSE 1 - CAST(length(kept) AS DOUBLE) / greatest(length(d.text), 1) END AS removed_share
FROM documents d LEFT JOIN cut USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH rows_ AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\|[a-z_]{1,20}\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS safe_role,
    regexp_replace(text, '([<\[])(\\*)(\|[a-z_]{1,20}\||/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g') AS safe_text FROM rows_
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(safe_role) OVER w AS before FROM safe
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, safe_role, safe_text)
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(CASE WHEN before = safe_role THEN length('<|next|>') + length(safe_text)
      ELSE length('<|begin|>') + length(safe_role) + length('<|body|>') + length(safe_text) + length('<|end|>') END) AS chars
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM said
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), kept AS MATERIALIZED (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 30
), uses AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) JOIN kept USING (lang, term) GROUP BY ALL
), groups AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM docs
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN uses USING (lang, source) GROUP BY ALL
), whole AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM uses GROUP BY ALL) JOIN (SELECT lang, sum(n) AS total FROM uses GROUP BY lang) USING (lang) JOIN vocabulary USING (lang)
), shares AS MATERIALIZED (
  SELECT lang, g.source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM groups g JOIN kept USING (lang) JOIN vocabulary USING (lang) JOIN totals USING (lang, source) LEFT JOIN uses USING (lang, source, term)
), differences AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), valued AS (
  SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b USING (lang) LEFT JOIN differences d USING (lang) WHERE a.source <> b.source AND d.source IS NULL
  UNION ALL SELECT lang, source, 'pair', item, value FROM differences
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM valued) WHERE part = 'pair' OR rank <= 50
"""

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS MATERIALIZED (
  SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM docs LEFT JOIN labels USING (doc_id)
), masks AS MATERIALIZED (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM failed GROUP BY part, f
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), every AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, s.x AS step, o[s.x] AS i, o[:s.x - 1] AS before FROM every, letters s
), seen AS (
  SELECT part, filter_order, step, i, n, good, bad, f[i] AS hit, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fails FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE hit AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0) AS good_lost, coalesce(sum(bad) FILTER (WHERE NOT gone AND hit), 0) AS toxic_lost FROM seen GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley FROM counted
"""

SQL = {"op2_trie_join": TRIE_JOIN, "op3_line_dedup": LINE_DEDUP, "op5_chat_format": CHAT_FORMAT, "op11_source_divergence": DIVERGENCE, "op13_filter_audit": FILTER_AUDIT}
