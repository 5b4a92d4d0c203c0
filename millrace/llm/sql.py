"""SQL (DuckDB) with the same results as the queries that plain SQL can express."""

from __future__ import annotations

from millrace.llm.quality_rules import RULES, STOP_WORDS


def _rule(rule) -> str:
    value = f"{rule.measure}::DOUBLE" + (f" / nullif({rule.per}, 0)::DOUBLE" if rule.per else "")
    tests = ([f"{value} >= {float(rule.low)}"] if rule.low is not None else []) + ([f"{value} <= {float(rule.high)}"] if rule.high is not None else [])
    return f"coalesce({' AND '.join(tests)}, true)"


QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
windows AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM places),
twice AS (SELECT doc_id, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows JOIN twice USING (doc_id, a, b, c)) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '[!?]{{2,}}'))::BIGINT AS n_shouts,
         len(list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(list_filter(ls, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(_rule(r) for r in RULES)} AS kept
FROM b"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS symbols
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''))), 1, 13))::BIGINT + 0.5)::DOUBLE / 4503599627370496::DOUBLE)
         / CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE size::DOUBLE / (size + 4 * symbols)::DOUBLE END AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM keyed GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER ()
           - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM sources WINDOW o AS (ORDER BY (source_size * 3)::DOUBLE / weight, weight, source NULLS LAST)),
free AS (SELECT * FROM ranked WHERE remaining * weight < source_size * 3 * weights ORDER BY place LIMIT 1),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.place >= f.place THEN (f.remaining * r.weight)::DOUBLE / f.weights::DOUBLE ELSE (r.source_size * 3)::DOUBLE END AS target
  FROM ranked r LEFT JOIN free f ON true),
quotas AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota, coalesce(floor(target + 0.5)::BIGINT // nullif(source_size, 0), 0) AS epochs FROM targets),
placed AS (
  SELECT k.doc_id, k.size, q.source_size, q.target, q.epochs, q.quota - q.epochs * q.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN quotas q ON k.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS shingle FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, sides.y FROM reach JOIN sides ON reach.r = sides.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string expression."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: list_reduce(range(8), lambda c, k: {bit}, xor(a, b)), 4294967295::BIGINT), 4294967295)"


RUNS = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {crc32("doc_id::VARCHAR")} AS h
  FROM documents),
g AS (SELECT r, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS hit, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
places AS (SELECT *, unnest(range(n)) AS i FROM p),
w AS (SELECT r, n, i, ws[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM places),
matches AS (
  SELECT x.r, x.i, x.i - y.i AS q FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM matches),
stretches AS (SELECT r, q, min(i) - q AS s, max(i) + 1 AS e FROM islands GROUP BY r, q, island HAVING max(i) + 1 - min(i) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, e - s AS l, min(q) AS q FROM stretches GROUP BY r, s, e),
told AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS best,
         string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period,
       (1000 * best.l // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)"""


def _cell(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"


def _least(*cells: str) -> str:
    return f"list_min([{', '.join(cells)}])"


def _step(state: str, edits: list[tuple[str, str, str]]) -> str:
    """State after a row: it goes, or (state before, initial, role) tells how it stays."""
    line = "role || ':' || text || chr(10)"
    found = [_cell(state, "3", "D")]
    for before, initial, role in edits:
        found.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_cell(before, 'cut', 'K', line)} END")
        if role:
            found.append(f"CASE WHEN NOT gone THEN {_cell(before, '2 + cut', 'R', f"'{role}:' || text || chr(10)")} END")
    return _least(*found)


def _inserted(before: str, role: str) -> str:
    return _cell(before, "2", "I", f"'{role}:' || chr(10)")


_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 'r': ''}"
_START = "{'c': 0::BIGINT, 'a': '', 'r': ''}"
_FAULT = crc32("concat_ws(':', coalesce(c.conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' '))")

#: A shortest path over the states of the role pattern, row by row; conversations are numbered so that a null id joins.
REPAIR = rf"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
told AS (
  SELECT v, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_FAULT} % 20 AS fault
  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
damaged AS (
  SELECT v, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM told WHERE fault <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY v ORDER BY turn NULLS FIRST, role, text, copy) AS k, substr(role, 1, 1) AS initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
marked AS (SELECT *, last = '' AS blank, row_number() OVER (PARTITION BY v, role, text ORDER BY k) > 1 AS again FROM numbered),
judged AS (
  SELECT *, blank OR again AS gone, NOT blank AND again AS duplicate, NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS truncated,
         (NOT blank AND NOT again AND last NOT IN ('.', '!', '?'))::BIGINT AS cut,
         coalesce(lag(initial) OVER (PARTITION BY v ORDER BY k) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM marked),
counts AS (
  SELECT v, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM judged GROUP BY v),
paths AS (
  SELECT v, 0::BIGINT AS k, {_START} AS s0, {_NEVER} AS s1, {_inserted(_START, "user")} AS s2,
         {{'c': 4::BIGINT, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS s3 FROM ids
  UNION ALL
  SELECT v, k, t0, t1, t2, {_least("t3", _inserted("t2", "assistant"))}
  FROM (SELECT v, k, t0, t1, {_least("u2", *(_inserted(s, "user") for s in ("t0", "t1", "t3")))} AS t2, t3
        FROM (SELECT p.v, j.k, {_step("s0", [])} AS t0, {_step("s1", [("s0", "s", "")])} AS t1,
                     {_step("s2", [(s, "u", "user") for s in ("s0", "s1", "s3")])} AS u2, {_step("s3", [("s2", "a", "assistant")])} AS t3
              FROM paths p JOIN judged j ON p.v = j.v AND j.k = p.k + 1))),
ends AS (SELECT v, {_least("s0", "s3")} AS best FROM paths p WHERE k = coalesce((SELECT n FROM counts c WHERE c.v = p.v), 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(CASE WHEN best.r = '' THEN '' ELSE left(best.r, -1) END) AS repaired_sha256
FROM ids LEFT JOIN counts USING (v) JOIN ends USING (v)"""
