"""Equivalent SQL of the numbered queries that SQL can express."""

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{pattern}'), lambda x: x <> '')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""WITH d AS (SELECT doc_id, {_words(_GAP, _LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_words(_GAP, _LOWER)} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
 SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)) JOIN wins USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, {_words('[ \\x09-\\x0D]+', 'text')} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text: each character is put into the register, then come eight shifts, every one a step of the fold."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shifted = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) ELSE {shifted} END), 4294967295::BIGINT)"


_MARK = "md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"

OP12 = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), {_MARK}) AS k, {_MARK} AS mark,
 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - (c % 20 + 20) % 20 AS base, {_crc32('c::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT i.*, (SELECT count(*) FROM t WHERE t.c = i.base AND t.k <= i.h) AS lead FROM i),
r AS (SELECT o.c, t.k AS d, mark, words FROM o JOIN t ON t.c = o.base AND t.k <= o.h UNION ALL SELECT o.c, t.k - o.h + o.lead, mark, words FROM o JOIN t ON t.c = o.c AND t.k > o.h),
p AS (SELECT c, d, words, string_agg(mark, '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM i),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS words FROM p GROUP BY path, d),
k AS (SELECT path[:32 * (d - 1)] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT path[:32 * a] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n - 1) * words) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1),
e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path)
SELECT m.conv_id, m.d::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON m.d > 0 AND u.path = m.path[:32 * (m.d - 1)]"""
