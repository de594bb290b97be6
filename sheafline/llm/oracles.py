"""SQL for DuckDB, by query; written from the contract, not from the operators."""

from __future__ import annotations

#: kind, pattern, group, least length: the base kinds as the contract names them, then the formats that the method adds.
_KINDS = (
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("repository_token", "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", "xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("payment_key", "[rs]k_live_[A-Za-z0-9]{20,}", 0, 1),
    ("map_key", "AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _secrets_sql() -> str:
    """Matches and what lies between them give every span's place."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(_KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i, s AS start, s + length(m[i]) AS stop, length(v[i]) AS size, {least} AS least FROM (
    SELECT doc_id, i, m, v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')),
      unnest(range(1, len(m) + 1)) AS r(i))""")
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (""" + " UNION ALL ".join(parts) + """),
good AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM found WHERE size >= least),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""


_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<' || chr(92) || 'n') || chr(10)
    || replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
meet AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM meet JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)
), both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other
)
SELECT r.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN size ON size.doc_id = r.doc_id GROUP BY r.doc_id
"""

_WARC = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_SUBSTRINGS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i AS start, array_to_string(list_slice(words, i, i + 19), ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)
), later AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS rn FROM win
  ) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, start + k AS pos FROM later, range(0, 20) AS r(k)
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS kept_text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w) e
  LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos
  WHERE g.pos IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Unsigned CRC-32 of a text of ASCII letters, one bit after another.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

_PANES = (
    """
WITH c AS (
  SELECT DISTINCT ON (click_id) click_id, ts, kind, value, date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) AS d FROM clicks
  WHERE ts IS NOT NULL AND click_id IS NOT NULL AND arrived_at IS NOT NULL ORDER BY click_id, arrived_at, ts, kind NULLS FIRST, value NULLS FIRST
), q AS (SELECT *, ((d % 8) + 8) % 8 AS q, """
    + _CRC.format("CAST(click_id AS VARCHAR)")
    + """ AS crc FROM c),
r AS (
  SELECT least(7, q + greatest(0, crc % 30 - 23)) AS batch, click_id, coalesce(kind, 'none') AS kind, epoch_us(ts) - (d - q) * 86400000000 AS event,
    coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents FROM q
), w AS (SELECT b, (SELECT max(event) FROM r WHERE batch < b) AS w FROM range(8) AS t(b)),
h AS (SELECT r.*, (event - ((event % 3600000000) + 3600000000) % 3600000000) // 3600000000 AS hour FROM r),
l AS (SELECT h.*, coalesce(w >= (hour + 1) * 3600000000 + 4 * 86400000000, false) AS late FROM h JOIN w ON w.b = h.batch),
t AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM l WHERE NOT late GROUP BY ALL),
u AS (SELECT *, sum(n) OVER o AS n_all, sum(c) OVER o AS c_all FROM t WINDOW o AS (PARTITION BY kind, hour ORDER BY batch)),
p AS (SELECT kind, hour, min(batch) AS first FROM t GROUP BY ALL),
e AS (SELECT kind, hour, (SELECT min(b) FROM w WHERE b >= first AND w >= (hour + 1) * 3600000000 + 6 * 3600000000) AS e FROM p),
told AS (
  SELECT batch, hour, click_id, 1 AS n, cents AS c, 'late' AS record, kind FROM l WHERE late
  UNION ALL SELECT coalesce(e, 7), hour, -1, sum(n), sum(c), CASE WHEN e IS NULL THEN 'final' ELSE 'emit' END, kind FROM t JOIN e USING (kind, hour) WHERE batch <= coalesce(e, 7) GROUP BY kind, hour, e
  UNION ALL SELECT batch, hour, -1, n_all, c_all, 'replace', kind FROM u JOIN e USING (kind, hour) WHERE batch > e
  UNION ALL SELECT batch, hour, -1, n_all - n, c_all - c, 'retract', kind FROM u JOIN e USING (kind, hour) WHERE batch > e
)
SELECT CAST(batch AS BIGINT) AS batch, CAST(hour AS BIGINT) AS hour, CAST(click_id AS BIGINT) AS click_id, CAST(n AS BIGINT) AS n_rows, CAST(c AS BIGINT) AS cents, record, kind FROM told
"""
)

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
y AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN y USING (doc_id)
), n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, b)),
o AS (
  SELECT k1.c || k2.c || k3.c || k4.c || k5.c AS filter_order, [k1.b, k2.b, k3.b, k4.b, k5.b] AS bits FROM k k1, k k2, k k3, k k4, k k5
  WHERE k1.b + k2.b + k3.b + k4.b + k5.b = 31 AND xor(k1.b, xor(k2.b, xor(k3.b, xor(k4.b, k5.b)))) = 31 AND len(list_distinct([k1.c, k2.c, k3.c, k4.c, k5.c])) = 5
), s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS prior FROM o, range(1, 6) AS r(step)),
z AS (SELECT *, (mask & own) <> 0 AS fails, (mask & CAST(prior AS INTEGER)) <> 0 AS gone FROM n, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM z GROUP BY part, filter_order, step
"""


ORACLES: dict[str, str] = {
    "op1_secret_scan": _secrets_sql(),
    "op3_exact_topk": _TOP_K,
    "op4_chat_formatting": _CHAT,
    "op6_ngram_jaccard_join": _JACCARD,
    "op7_warc": _WARC,
    "op8_substring_dedup": _SUBSTRINGS,
    "op12_window_panes": _PANES,
    "op13_filter_audit": _AUDIT,
}
