"""Reference SQL of the queries that SQL can express, for small tables: plain definitions, without any filter or sketch."""

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, breaks: str) -> str:
    return f"[x FOR x IN regexp_split_to_array({text}, '{breaks}') IF x <> '']"


SPACED, PLAIN = r"[\x20\x09-\x0D]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {words(FOLDED, SPACED)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s
          WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
          WHERE 100 * common >= 85 * (m.n + n.n - common)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM either
          UNION SELECT reach.doc_id, either.b FROM reach JOIN either ON reach.other = either.a)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least_id, docs.doc_id)::BIGINT AS component_id
FROM docs LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP7 = f"""
WITH docs AS (SELECT doc_id, {words("coalesce(text, '')", SPACED)} AS w FROM documents),
starts AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS first_id FROM starts GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM starts JOIN first USING (s) WHERE first_id < doc_id),
listed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM listed
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = listed.doc_id AND gone.q = listed.q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH docs AS (SELECT doc_id, {words(FOLDED, PLAIN)} AS w FROM documents),
items AS (SELECT item_id, {words(FOLDED, PLAIN)} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS s
            FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
                  FROM items WHERE len(w) > 0)),
starts AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS s
           FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
                 FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
hits AS (SELECT DISTINCT doc_id, p, m, item_id FROM starts JOIN windows USING (m, s)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP12 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    {words("coalesce(text, '')", SPACED)} AS w FROM documents),
fails AS (SELECT doc_id, part, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY t)] AS f FROM docs),
masks AS (SELECT part, f, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
          FROM fails LEFT JOIN labels USING (doc_id) GROUP BY ALL),
orders AS (SELECT [x] AS o FROM range(1, 6) r(x)
           UNION ALL SELECT list_append(o, x) FROM orders, range(1, 6) r(x) WHERE len(o) < 5 AND NOT list_contains(o, x)),
steps AS (SELECT o, s, o[s] AS own FROM orders, range(1, 6) r(s) WHERE len(o) = 5),
states AS (SELECT part, o, s, own, n, good, toxic, f[own] AS failed, list_bool_or([f[x] FOR x IN o[:s - 1]]) AS gone,
                  len([x FOR x IN f IF x]) AS failures FROM masks, steps),
rows AS (SELECT part, o, s, own, sum(n) FILTER (NOT failed AND NOT coalesce(gone, false)) AS kept,
         sum(n) FILTER (failed AND NOT coalesce(gone, false)) AS removed, sum(n) FILTER (failed AND gone) AS redundant,
         sum(n) FILTER (failed AND failures = 1) AS unique_fails,
         sum(good) FILTER (failed AND NOT coalesce(gone, false)) AS good_lost,
         sum(toxic) FILTER (failed AND NOT coalesce(gone, false)) AS toxic_lost FROM states GROUP BY ALL)
SELECT part, array_to_string([substr('ABCDE', x::INT, 1) FOR x IN o], '') AS filter_order, s::INTEGER AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM rows
"""
