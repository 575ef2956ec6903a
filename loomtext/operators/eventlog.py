"""An append-only event log with retractions.

A correction voids an earlier line of its own loop's file, unless that is a correction itself or is voided already (the
first wins). What is effective is the rest. Corrections are joined to their targets by (loop, line), so a log of any
size is shuffled by that key and no loop's file has to fit into one task.
"""

from __future__ import annotations

from loomtext.plans.shared import PRELUDES, VIEWS, shared_all
from loomtext.sources.tables import LOG_SQL, log_view

_VALID = (
    "SELECT c.loop, c.line AS by_line, c.supersedes AS line, row_number() OVER (PARTITION BY c.loop, c.supersedes ORDER BY c.line) AS k "
    "FROM {log} c JOIN {log} t ON t.loop = c.loop AND t.line = c.supersedes AND t.line < c.line AND t.event <> 'correction' WHERE c.event = 'correction'"
)
_EFFECTIVE = "SELECT l.loop, l.line, l.event, l.value, l.ts FROM {log} l LEFT JOIN (SELECT loop, line FROM v WHERE k = 1) x ON x.loop = l.loop AND x.line = l.line WHERE l.event <> 'correction' AND x.line IS NULL"
_WITH = "WITH v AS (" + _VALID + "), e AS (" + _EFFECTIVE + ") "

TAXONOMY = "(VALUES ('loop_start', 'frame'), ('commit', 'work'), ('test_run', 'work'), ('failure', 'trouble')) AS t(code, category)"

LOG = {
    "log_effective": _WITH + "SELECT loop, line, event FROM e",
    "log_voided_counts": "SELECT c.loop, t.event, count(*) AS n FROM {log} c JOIN {log} t ON t.loop = c.loop AND t.line = c.supersedes WHERE c.event = 'correction' GROUP BY c.loop, t.event",
    "log_validate_records": "SELECT line, rule FROM (SELECT line, CASE WHEN event = 'correction' AND supersedes IS NULL THEN 'no target' WHEN event = 'correction' AND supersedes >= line THEN 'not earlier' "
    "WHEN event = 'failure' AND value < 0 THEN 'negative' WHEN event IS NULL THEN 'unknown event' WHEN supersedes <= 0 THEN 'target before the first line' END AS rule FROM {log}) x WHERE rule IS NOT NULL",
    "log_validate": _WITH + "SELECT loop, 'first is not loop_start' AS rule FROM (SELECT loop, event, row_number() OVER (PARTITION BY loop ORDER BY line) AS k FROM e) x WHERE k = 1 AND event <> 'loop_start' "
    "UNION ALL SELECT loop, 'several loop_start' FROM e WHERE event = 'loop_start' GROUP BY loop HAVING count(*) > 1 "
    "UNION ALL SELECT c.loop, 'bad target' FROM (SELECT loop, line FROM {log} WHERE event = 'correction') c LEFT JOIN v ON v.loop = c.loop AND v.by_line = c.line AND v.k = 1 WHERE v.line IS NULL GROUP BY c.loop",
    "log_repair_slots": _WITH + "SELECT x.loop, x.line FROM (SELECT loop, line, event, row_number() OVER (PARTITION BY loop, event ORDER BY line) AS k FROM e) x JOIN "
    "(SELECT loop, t.event, count(*) AS n FROM (SELECT v.loop, l.event FROM v JOIN {log} l ON l.loop = v.loop AND l.line = v.line WHERE v.k = 1) t GROUP BY loop, t.event) b ON b.loop = x.loop AND b.event = x.event WHERE x.k <= b.n",
    "log_append_guard": _WITH + "SELECT l.loop, count(CASE WHEN e.event = 'loop_start' THEN 1 END) > 0 AS started, count(e.line) AS effective FROM (SELECT DISTINCT loop FROM {log}) l LEFT JOIN e ON e.loop = l.loop GROUP BY l.loop",
    "log_summary": _WITH + "SELECT loop, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max_by(value, CASE WHEN event = 'test_run' THEN line END) AS last_test FROM e GROUP BY loop",
    "two_strike": _WITH + "SELECT loop, count(*) AS n, count(*) >= 2 AS needs, bool_or(value > 50) AS has_reference FROM e WHERE event = 'failure' GROUP BY loop",
    "fact_events": "SELECT loop, line, event, ts FROM {log}",
    "fact_loops": _WITH + "SELECT loop, max_by(value, CASE WHEN event = 'loop_start' THEN line END) AS goal, count(CASE WHEN event = 'failure' THEN 1 END) AS n_failures, count(CASE WHEN event = 'commit' THEN 1 END) AS n_commits, count(CASE WHEN event = 'test_run' THEN 1 END) AS n_test_runs FROM e GROUP BY loop",
    "fact_failures": _WITH + "SELECT loop, line, value, row_number() OVER (PARTITION BY loop ORDER BY line) AS nth FROM e WHERE event = 'failure'",
    "dim_taxonomy": "SELECT code, category, count(line) AS n FROM " + TAXONOMY + " LEFT JOIN {log} l ON l.event = code GROUP BY code, category",
    "failure_dim_join": _WITH + "SELECT coalesce(t.category, '?') AS category, count(*) AS n FROM e LEFT JOIN " + TAXONOMY + " ON t.code = e.event GROUP BY coalesce(t.category, '?')",
}

assert VIEWS["log"] is log_view and PRELUDES["log"] is LOG_SQL
shared_all(LOG)
