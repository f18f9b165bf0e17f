"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, 20 + length(role) + length(text) + CASE WHEN contains(text, '</s>')
        THEN 1 + len(regexp_extract_all(text, '[<\[](?:/?s>|/?INST\])')) + length(text) - length(replace(text, '\', '')) ELSE 0 END AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

PLAIN = "translate(coalesce(text, ''), '.,;:!?\"''()[]ABCDEFGHIJKLMNOPQRSTUVWXYZ', '           abcdefghijklmnopqrstuvwxyz')"
RUNS = "[array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]"

OP4 = f"""
WITH i AS (SELECT item_id, w, len(w) AS l, {RUNS} AS g FROM (SELECT item_id, {WORDS.format(PLAIN)} AS w FROM benchmark) WHERE len(w) >= 5),
d AS (SELECT doc_id, w, {RUNS} AS g FROM (SELECT doc_id, {WORDS.format(PLAIN)} AS w FROM documents) WHERE len(w) >= 5),
ip AS (SELECT item_id, l, unnest(g) AS x, unnest(range(len(g))) AS place FROM i),
dp AS (SELECT doc_id, unnest(g) AS x, unnest(range(len(g))) AS pos FROM d),
c AS (SELECT DISTINCT doc_id, l, pos - place AS start FROM dp JOIN ip USING (x) WHERE pos >= place),
wt AS (SELECT x, ln(1 + (SELECT count(*) FROM i) / count(DISTINCT item_id)) AS wt FROM ip GROUP BY 1),
ic AS (SELECT item_id, x, count(*) AS there FROM ip GROUP BY 1, 2),
it AS (SELECT item_id, sum(there * wt) AS item_total FROM ic JOIN wt USING (x) GROUP BY 1),
win AS (SELECT doc_id, item_id, l, start, unnest(d.g[start + 1 : start + l - 4]) AS x FROM c JOIN d USING (doc_id) JOIN i USING (l) WHERE start + l <= len(d.w)),
wc AS (SELECT doc_id, item_id, l, start, x, count(*) AS here FROM win GROUP BY ALL),
sums AS (SELECT doc_id, item_id, l, start, sum(least(here, coalesce(there, 0)) * coalesce(wt, ln(1 + (SELECT count(*) FROM i)))) AS common,
           sum(here * coalesce(wt, ln(1 + (SELECT count(*) FROM i)))) AS total FROM wc LEFT JOIN wt USING (x) LEFT JOIN ic USING (item_id, x) GROUP BY ALL),
sc AS (SELECT *, round(common / (total + item_total - common), 6) AS similarity FROM sums JOIN it USING (item_id))
SELECT doc_id, item_id, start, l AS n_words, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sc WHERE similarity >= 0.8) WHERE rn = 1
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (h) CROSS JOIN (SELECT unnest(range(50)) AS k) WHERE f < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END)) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op3_chat_format": OP3, "op4_decontamination": OP4, "op8_substring_dedup": OP8, "op9_near_dedup": OP9}
