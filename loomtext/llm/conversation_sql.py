"""DuckDB SQL of the conversation queries op11 and op12."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: {bits}))"


TRIE_SQL = f"""WITH _k AS (SELECT conv_id, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
_t AS (SELECT conv_id, key, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS place FROM _k),
_c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM _t)),
_r AS (SELECT c.conv_id, 0 AS own, place, key, bytes FROM _c c JOIN _t t ON t.conv_id = c.base AND t.place <= c.h UNION ALL SELECT c.conv_id, 1, place, key, bytes FROM _c c JOIN _t t ON t.conv_id = c.conv_id AND t.place > c.h),
_p AS (SELECT conv_id, bytes, row_number() OVER w AS depth, string_agg(key, '') OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM _r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place) UNION ALL SELECT conv_id, 0, 0, '' FROM _c),
_n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM _p GROUP BY path, depth),
_b AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM _n WHERE depth > 0 GROUP BY 1),
_v AS (SELECT _n.*, coalesce(_b.n, 0) AS n_children FROM _n LEFT JOIN _b USING (path)),
_s AS (SELECT left(path, 32 * k) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS k FROM _v) GROUP BY 1),
_e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(path, depth) AS path FROM _p GROUP BY conv_id) GROUP BY path)
SELECT _v.conv_id, _v.depth, up.conv_id AS parent_conv_id, _v.n_convs, _v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM _v JOIN _s USING (path) LEFT JOIN _e USING (path) LEFT JOIN _v up ON _v.depth > 0 AND up.path = left(_v.path, 32 * (_v.depth - 1)) AND up.depth = _v.depth - 1"""


def _edit(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    more = f"list_append({state}.lines, {line})" if line else f"{state}.lines"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || {letter}, 'lines': {more}}} END"


def _enter(state: str, initial: str, role: str) -> str:
    """Keep or rerole a turn to a role behind a state."""
    kept = f"initial = '{initial}'"
    return _edit(state, f"pay + CASE WHEN {kept} THEN 0 ELSE 1 END", f"CASE WHEN {kept} THEN 'K' ELSE 'R' END", f"CASE WHEN {kept} THEN role ELSE '{role}' END || ':' || text", "stays")


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _closed(source: str) -> str:
    """States with what insertions reach, of a query of conv_id, k, e, s, u, a."""
    u = _least("u", *[_edit(x, "5", "'I'", "'user:'") for x in ("e", "s", "a")])
    return f"SELECT conv_id, k, e, s, u, {_least('a', _edit('u', '5', chr(39) + 'I' + chr(39), chr(39) + 'assistant:' + chr(39)))} AS a FROM (SELECT conv_id, k, e, s, {u} AS u, a FROM ({source}))"


_STRUCT = "STRUCT(cost BIGINT, audit VARCHAR, lines VARCHAR[])"
_BLANK = r"'[^\x20\x09-\x0D]'"
_GONE = {x: _edit(x, "2", "'D'", None) for x in "esua"}
_STEP = f"""SELECT d.conv_id, d.k + 1 AS k, {_GONE["e"]} AS e, {_least(_GONE["s"], _edit("e", "pay", "'K'", "role || ':' || text", "stays AND initial = 's'"))} AS s,
{_least(_GONE["u"], *[_enter(x, "u", "user") for x in "esa"])} AS u, {_least(_GONE["a"], _enter("u", "a", "assistant"))} AS a FROM _d d JOIN _f f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.k + 1"""

REPAIR_SQL = f"""WITH RECURSIVE _k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
_m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM _k WHERE kind > 0),
_a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM _m),
_o AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k, again FROM _a),
_g AS (SELECT *, CASE WHEN NOT regexp_matches(text, {_BLANK}) THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM _o),
_f AS (SELECT conv_id, k, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS pay FROM _g),
_q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k FROM _g GROUP BY conv_id),
_d AS ({_closed(f"SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'cost': 0, 'audit': '', 'lines': []}} AS {_STRUCT}) AS e, CAST(NULL AS {_STRUCT}) AS s, CAST(NULL AS {_STRUCT}) AS u, CAST(NULL AS {_STRUCT}) AS a FROM _f")} UNION ALL {_closed(_STEP)})
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT _q.*, {_least("d.e", "d.a")} AS best FROM _q JOIN _d d ON d.conv_id IS NOT DISTINCT FROM _q.conv_id AND d.k = _q.k) q ON q.conv_id IS NOT DISTINCT FROM c.conv_id"""
