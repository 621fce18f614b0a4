"""DuckDB SQL for the corpus queries that SQL expresses on whole tables."""

from __future__ import annotations

_STRIP = r"regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

LINE_DEDUP = rf"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut
), keyed AS (
  SELECT doc_id, i, line, translate({_STRIP}, '{_UPPER}', '{_UPPER.lower()}') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT d.*, c.k IS NOT NULL AND d.doc_id <> c.keeper AS gone FROM keyed d LEFT JOIN common c ON d.k = c.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, unnest(generate_series(i, i + 12)) AS p FROM win JOIN least ON win.k = least.k AND least.d < win.doc_id),
said AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT s.doc_id, count(g.p) AS n_removed, string_agg(s.word, ' ' ORDER BY s.p) FILTER (WHERE g.p IS NULL) AS t FROM said s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.p = s.p GROUP BY s.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_BENCH_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH i AS (SELECT item_id, {_BENCH_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, sizes)),
hits AS (SELECT places.doc_id, places.n, p, item_id FROM places JOIN windows ON places.n = windows.n AND places.k = windows.k),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS w FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
item_places AS (SELECT item_id, n, q, array_to_string(ws[q:q + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS q FROM i WHERE len(ws) > 0)),
equal_places AS (SELECT places.doc_id, item_id, places.n, p, p - q AS diagonal, p - row_number() OVER (PARTITION BY places.doc_id, item_id, p - q ORDER BY p) AS island FROM places JOIN item_places ON places.n = item_places.n AND places.k = item_places.k),
longest AS (SELECT doc_id, max(words) AS words FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS words FROM equal_places GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest.words, 0) AS longest_match
FROM d LEFT JOIN longest ON longest.doc_id = d.doc_id LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

def _crc32(rows: str) -> str:
    """CTEs ending in crc(id, crc): crc32 of the strings s of the query rows (id, s), ids distinct.

    crc32 is linear over bits: each byte adds the image of its bits under as many steps by a
    zero byte as bytes follow. Doubling makes the table of those images, whose first columns are those of the polynomial.
    """
    step = [0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320, *(1 << j for j in range(24))]
    image = "list_bit_xor(list_transform(range(0, 32), lambda j: ((x >> j) & 1) * m[j + 1]))"
    return f"""
crc_in AS ({rows}),
crc_long AS (SELECT coalesce(max(octet_length(encode(s))), 0) + 1 AS longest FROM crc_in),
crc_doubling(k, m, t) AS (
  SELECT 0, {step}::BIGINT[], [{[*(1 << j for j in range(8)), 0xFFFFFFFF]}::BIGINT[]]
  UNION ALL
  SELECT k + 1, list_transform(m, lambda x: {image}), list_concat(t, list_transform(t, lambda v: list_transform(v, lambda x: {image}))) FROM crc_doubling, crc_long WHERE len(t) <= longest
),
crc_last AS (SELECT t FROM crc_doubling ORDER BY k DESC LIMIT 1),
crc_table AS (SELECT unnest(t) AS z, unnest(range(0, len(t))) AS n FROM crc_last),
crc_bytes AS (SELECT id, octet_length(encode(s)) AS size, unnest(regexp_extract_all(hex(encode(s)), '..')) AS b, unnest(range(octet_length(encode(s)), 0, -1)) AS n FROM crc_in),
crc_parts AS (SELECT id, bit_xor(list_bit_xor([{', '.join(f"((('0x' || b)::BIGINT >> {j}) & 1) * z[{j + 1}]" for j in range(8))}])) AS x FROM crc_bytes JOIN crc_table USING (n) GROUP BY id),
crc AS (SELECT id, xor(xor(coalesce(x, 0), z[9]), 4294967295) AS crc FROM crc_in LEFT JOIN crc_parts USING (id) JOIN crc_table ON n = octet_length(encode(s)))"""


_HASH60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"

SHARDING = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS s FROM documents),{_crc32("SELECT id, s FROM t")},
h AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, octet_length(encode(s)) + 8 AS size, crc, {_HASH60.format("'tidemark:' || coalesce(doc_id::VARCHAR, ' ') || ':' || crc || ':' || (octet_length(encode(s)) + 8)")} AS h FROM t JOIN crc USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, crc, size) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n, ({_HASH60.format("'tidemark:' || stratum")} >> 28)::DOUBLE / 4294967296::DOUBLE AS phase FROM h),
f AS (SELECT *, row_number() OVER (ORDER BY (k + phase) / n::DOUBLE, stratum, k) - 1 AS place, count(*) OVER () AS total FROM r),
c AS (SELECT *, (place * 24) // total AS shard FROM f)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c
"""

_FOLLOWS = {"n": "u", "s": "u", "u": "a", "a": "u"}
_ROLE_OF = {"u": "user:", "a": "assistant:"}


def _insertions() -> str:
    """(state, letters, state after, cost, lines) of no, one and two insertions."""
    rows = []
    for state in _FOLLOWS:
        q, lines = state, []
        for n in range(3):
            rows.append(f"('{state}', '{'I' * n}', '{q}', {3 * n}, {lines}::VARCHAR[])")
            q = _FOLLOWS[q]
            lines = [*lines, _ROLE_OF[q]]
    return ", ".join(rows)


_WHITE = r"[ \t\n\v\f\r]"

REPAIR = rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
),{_crc32("SELECT id, s FROM t")},
damaged AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM t JOIN crc USING (id)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS said, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || left(role, 1) AS pair
  FROM damaged
),
f AS (SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'g' END AS fault FROM numbered),
insertions(q, letters, q2, price, lines) AS (VALUES {_insertions()}),
dp(conv_id, i, state, v) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 'n', {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT conv_id, i, state, min(v) FROM (
    SELECT f.conv_id, f.i, CASE edit WHEN 'D' THEN q2 WHEN 'K' THEN f.c WHEN 'R' THEN CASE q2 WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
      {{'c': (p.v.c + price + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 3 ELSE 0 END)::INTEGER,
        'a': p.v.a || letters || edit,
        'o': list_concat(p.v.o, list_concat(lines, CASE edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE q2 WHEN 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END))}} AS v
    FROM dp p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN insertions ON q = p.state, (VALUES ('D'), ('K'), ('R')) edits(edit)
    WHERE edit = 'D' OR fault IN ('g', 't') AND (edit = 'R' OR q2 || f.c IN ('ns', 'nu', 'su', 'ua', 'au'))
  ) GROUP BY conv_id, i, state
),
counts AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(i), 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
),
closing(q, letters, price, lines) AS (VALUES ('n', '', 0, []::VARCHAR[]), ('s', 'II', 6, ['user:', 'assistant:']), ('u', 'I', 3, ['assistant:']), ('a', '', 0, []::VARCHAR[])),
best AS (
  SELECT dp.conv_id, min({{'c': v.c + price, 'a': v.a || letters, 'o': list_concat(v.o, lines)}}) AS v
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND n = i JOIN closing ON q = state GROUP BY dp.conv_id
)
SELECT counts.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, v.c::BIGINT AS cost, v.a AS audit, sha256(array_to_string(v.o, chr(10))) AS repaired_sha256
FROM counts JOIN best ON best.conv_id IS NOT DISTINCT FROM counts.conv_id
"""

TRIE = f"""
WITH RECURSIVE own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS said FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),{_crc32("SELECT conv_id AS id, conv_id::VARCHAR AS s FROM own")},
rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(b.said[1:crc % 6], []), own.said[crc % 6 + 1:]) AS said
  FROM own JOIN crc ON crc.id = own.conv_id LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 100
),
prefixes AS (SELECT conv_id, d, len(said) = d AS ends, coalesce(length(said[d].text), 0) AS chars, md5(to_json(said[1:d])::VARCHAR) AS name, CASE WHEN d > 0 THEN md5(to_json(said[1:d - 1])::VARCHAR) END AS above FROM (SELECT conv_id, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT name, any_value(above) AS above, any_value(d) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefixes GROUP BY name),
children AS (SELECT above AS name, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
totals AS (
  SELECT p.name, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM nodes v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.depth LEFT JOIN children c ON c.name = v.name GROUP BY p.name
)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v LEFT JOIN nodes u ON u.name = v.above LEFT JOIN children c ON c.name = v.name JOIN totals ON totals.name = v.name
"""

SQL: dict[str, str] = {"op2_line_dedup": LINE_DEDUP, "op3_substring_dedup": SUBSTRING_DEDUP, "op8_decontamination": DECONTAMINATION, "op11_conversation_repair": REPAIR, "op12_interleaved_shards": SHARDING, "op13_prefix_trie": TRIE}
