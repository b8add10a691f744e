"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANK = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


OP1 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, unnest(range(1, n - 198)) AS k FROM n WHERE n >= 200),
s AS (SELECT w.r, k, md5(substr(h, 2 * k - 1, 400)) AS x FROM w JOIN n USING (r)),
c AS (SELECT r, k FROM s WHERE x IN (SELECT x FROM s GROUP BY x HAVING count(*) > 1)),
g AS (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 200 THEN 0 ELSE 1 END AS fresh FROM c),
i AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS run FROM g),
spans AS (SELECT r, min(k) AS a, max(k) + 200 AS b FROM i GROUP BY r, run),
kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS last FROM spans),
t AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(h, 2 * last - 1, 2 * (a - last)), '' ORDER BY a) AS head
      FROM kept JOIN n USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * stop - 1), h))) AS kept_sha256
FROM n LEFT JOIN t USING (r)
"""

OP2 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r, r AS t FROM ok UNION SELECT reach.r, b FROM reach JOIN links ON t = a),
least AS (SELECT reach.r, min(vec_id) AS m FROM reach JOIN v ON v.r = t GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(vec_id = coalesce(m, vec_id), false) AS kept
FROM v LEFT JOIN least USING (r) LEFT JOIN n USING (r)
"""

_CONTROL = r"(<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*ROLE\]|\[\\*/ROLE\])"
OP3 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 17 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(10, len(w)) - 1) AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
places AS (SELECT r, k, n, list_slice(w, k, k + n - 1) AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, k, n, item_id FROM places JOIN win USING (x)),
pos AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM hit),
h AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

OP6 = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT r, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT r, max({{'n': length(rh || rp), 'b': action = 'block', 'rule': rh || rp, 'action': action}}) AS best
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', BLANK)} AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, k, k + 4) AS x FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT r, r AS t FROM n UNION SELECT reach.r, b FROM reach JOIN links ON t = a),
least AS (SELECT reach.r, min(doc_id) AS m FROM reach JOIN d ON d.r = t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""

_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"""
OP11 = f"""
WITH t AS (SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY turn NULLS FIRST, x.role, x.text) AS w FROM t GROUP BY c),
h AS (SELECT o.c, o.w, coalesce(b.w, []) AS base, {_CRC.replace('c::', 'o.c::')} % 4 AS h FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 20),
s AS (SELECT c, list_concat(base[1:h], w[h + 1:len(w)]) AS w FROM h),
p AS (SELECT c, len(w) AS n, unnest(range(0, len(w) + 1)) AS d, w FROM s),
n AS (SELECT d, w[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.k[n.d].text, '{BLANK}')) ELSE 0 END AS saved FROM n LEFT JOIN kids USING (d, k)),
up AS (SELECT a AS d, k[1:a] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN up USING (d, k) LEFT JOIN n m ON m.d = v.d - 1 AND m.k = v.k[1:v.d - 1]
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS w, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 AS plain FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix,
  CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {"op1_suffix_dedup": OP1, "op2_embedding_dedup": OP2, "op3_chat_format": OP3, "op4_decontaminate": OP4, "op6_url_filter": OP6, "op10_ngram_join": OP10,
           "op11_prefix_trie": OP11, "op12_fill_in_middle": OP12}
