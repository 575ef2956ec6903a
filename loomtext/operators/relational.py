"""Filters, joins, aggregates, windows, rankings and set operations over the views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.registry import query
from loomtext.plans.shared import shared_all
from loomtext.sources.tables import table

FIRST = "row_number() OVER (PARTITION BY "

#: Sources
SCANS = {
    "scan_documents": "SELECT doc_id, text, lang, source, n_chars FROM {documents}",
    "scan_registry": "SELECT 'documents' AS name, count(*) AS n FROM {documents} UNION ALL SELECT 'pages', count(*) FROM {pages} UNION ALL SELECT 'conversations', count(*) FROM {conversations}",
    "json_props": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}",
    ),
    "scan_conversations": "SELECT conv_id, turn, role, coalesce(text, '') AS text FROM {conversations}",
    "log_scan_numbered": (
        "SELECT event_id AS line, event_type FROM {events} WHERE try_parse_json(props) IS NOT NULL",
        "SELECT event_id AS line, event_type FROM {events} WHERE json_valid(props)",
    ),
    "scan_embeddings": ("SELECT vec_id, label, CAST(size(embedding) AS BIGINT) AS dim FROM {embeddings}", "SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim FROM {embeddings}"),
    "content_sha256": ("SELECT doc_id, sha2(text, 256) AS sha FROM {documents}", "SELECT doc_id, sha256(text) AS sha FROM {documents}"),
    "path_filter": "SELECT page_id, url FROM {pages} WHERE url LIKE '%.html' AND url NOT LIKE '%/de/%' AND url NOT LIKE '%m.%'",
}

_RUNS = (
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat(CAST(event_id % 4 AS {text}), ' passed') WHEN 1 THEN 'collected 0 items' WHEN 2 THEN ' ' WHEN 3 THEN concat('boom ', event_type) "
    "WHEN 4 THEN concat('0 passed, ', CAST(event_id % 3 AS {text}), ' failed') ELSE concat('no tests ran in ', CAST(event_id % 9 AS {text}), 's') END AS out FROM {{events}}"
)

#: Filters and predicates
FILTERS = {
    "facet_filter": "SELECT p_partkey, p_type FROM {part} WHERE p_type = (SELECT min(p_type) FROM {part})",
    "required_fields": (
        "SELECT c_custkey, field FROM (SELECT c_custkey, stack(3, 'c_name', c_name, 'c_mktsegment', c_mktsegment, 'translator', CAST(NULL AS STRING)) AS (field, value) FROM {customer}) x "
        "WHERE coalesce(value, '') = ''",
        "SELECT c_custkey, field FROM (SELECT c_custkey, 'c_name' AS field, c_name AS value FROM {customer} UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM {customer} "
        "UNION ALL SELECT c_custkey, 'translator', NULL FROM {customer}) x WHERE coalesce(value, '') = ''",
    ),
    # Two patterns of the test data alone; secret_scan has these and the reference's.
    "secret_scan_testdata": (
        "SELECT doc_id, CASE WHEN text RLIKE 'token = .[0-9a-f]+' THEN 'block' ELSE 'warn' END AS kind FROM {documents} WHERE text RLIKE 'token = .[0-9a-f]+|[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+'",
        "SELECT doc_id, CASE WHEN regexp_matches(text, 'token = .[0-9a-f]+') THEN 'block' ELSE 'warn' END AS kind FROM {documents} WHERE regexp_matches(text, 'token = .[0-9a-f]+|[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')",
    ),
    "first_hit": (
        "SELECT lang, min_by(doc_id, doc_id) AS doc_id, min_by(length(text), doc_id) AS chars FROM {documents} WHERE text LIKE '%er%' GROUP BY lang",
        "SELECT lang, min(doc_id) AS doc_id, arg_min(length(text), doc_id) AS chars FROM {documents} WHERE text LIKE '%er%' GROUP BY lang",
    ),
    # What a test run printed, made of the events.
    "ran_classifier": (
        "SELECT event_id, CASE WHEN out RLIKE 'no tests ran|collected 0 items' THEN 'none' WHEN out RLIKE '[1-9][0-9]* (passed|failed)' THEN 'ran' WHEN trim(out) = '' THEN 'silent' ELSE 'unknown' END AS verdict FROM (" + _RUNS.format(text="STRING") + ") x",
        "SELECT event_id, CASE WHEN regexp_matches(out, 'no tests ran|collected 0 items') THEN 'none' WHEN regexp_matches(out, '[1-9][0-9]* (passed|failed)') THEN 'ran' WHEN trim(out) = '' THEN 'silent' ELSE 'unknown' END AS verdict FROM (" + _RUNS.format(text="VARCHAR") + ") x",
    ),
}

#: Joins
JOINS = {
    "paragraph_join": "SELECT d.doc_id, d.lang, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    "words_own_left": "SELECT d.doc_id, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id",
    "semi_join_subset": ("SELECT o_orderkey FROM {orders} o LEFT SEMI JOIN {lineitem} l ON o_orderkey = l_orderkey AND l_quantity > 45", "SELECT o_orderkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45)"),
    "anti_unknown_paragraph": ("SELECT d.doc_id FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)"),
    "ledger_diff": "SELECT CASE WHEN c.k IS NULL THEN 'missing' ELSE 'extra' END AS side, coalesce(n.n_nationkey, c.k) AS k FROM (SELECT n_nationkey FROM {nation} WHERE n_nationkey < 20) n "
    "FULL OUTER JOIN (SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_nationkey >= 5) c ON n.n_nationkey = c.k WHERE n.n_nationkey IS NULL OR c.k IS NULL",
    "edition_meta_join": "SELECT s.s_suppkey, n.n_name, r.r_name FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "majority_assign": "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pos) AS k FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first_pos FROM {documents} GROUP BY source, lang) x) y WHERE k = 1",
    # Unmatched positions take the last matched one's paragraph, or 0 before any.
    "assign_paragraph_ffill": (
        "SELECT event_id, coalesce(last(best, true) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS paragraph FROM "
        "(SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS best FROM {events}) x",
        "SELECT event_id, coalesce(last_value(best IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS paragraph FROM "
        "(SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS best FROM {events}) x",
    ),
    "failure_attribution": "WITH a AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'error' AND event_id % 2 = 0), b AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'error' AND event_id % 2 = 1) "
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'fixed' ELSE 'standing' END AS state FROM a FULL OUTER JOIN b ON a.user_id = b.user_id",
}

#: Aggregates
AGGREGATES = {
    "stretch_ratio": "SELECT pair_id, CAST(sum(CASE WHEN side = 'dst' THEN length(text) ELSE 0 END) AS DOUBLE) / sum(CASE WHEN side = 'src' THEN length(text) ELSE 0 END) AS c FROM {sides} GROUP BY pair_id",
    "paragraph_chars": "SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM {paragraphs} GROUP BY doc_id",
    "fill_rate": "SELECT d.lang, count(l.quality) AS done, count(*) AS total, CAST(sum(CASE WHEN l.quality IS NOT NULL THEN n_chars ELSE 0 END) AS BIGINT) AS chars FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.lang)",
    "translator_ratio": "SELECT lang, count(*) AS n, avg(r) AS mean, CAST(sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS longer FROM (SELECT d.lang, CAST(n_chars AS DOUBLE) / 1500 AS r FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE n_chars > 0) x GROUP BY lang",
    "median_mean": "SELECT event_type, CAST(floor(median(value)) AS BIGINT) AS m FROM {events} GROUP BY event_type",
    "extent": "SELECT event_type, avg(value) AS mean, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type",
    "duplicate_keys": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM {documents}) x WHERE k > 1",
    "diff_gate": "SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS changed, count(*) AS lines, sum(l_quantity) > 200 AS large FROM {lineitem} GROUP BY l_orderkey ORDER BY changed DESC, l_orderkey LIMIT 5",
    "dense_totals": "SELECT d.lang, count(l.doc_id) AS n FROM (SELECT DISTINCT lang FROM {documents}) d LEFT JOIN (SELECT doc_id, lang FROM {documents} WHERE n_chars > 5000) l ON d.lang = l.lang GROUP BY d.lang",
    "structure_summary": "SELECT p.lang, p.paragraphs, p.chars, s.sentences FROM (SELECT lang, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM {paragraphs} GROUP BY lang) p JOIN "
    "(SELECT lang, count(*) AS sentences FROM {sentences} GROUP BY lang) s ON p.lang = s.lang",
    "chapter_counts": (
        "SELECT doc_id, c.id + 1 AS chapter, count(par) AS n FROM (SELECT doc_id, explode(sequence(0, floor((max(par) - 1) / 3))) AS id FROM {paragraphs} GROUP BY doc_id) c LEFT JOIN "
        "(SELECT doc_id AS d, par, floor((par - 1) / 3) AS k FROM {paragraphs} WHERE length(text) > 100) p ON c.doc_id = p.d AND c.id = p.k GROUP BY doc_id, c.id",
        "SELECT doc_id, c.id + 1 AS chapter, count(par) AS n FROM (SELECT doc_id, unnest(range(CAST(floor((max(par) - 1) / 3) AS BIGINT) + 1)) AS id FROM {paragraphs} GROUP BY doc_id) c LEFT JOIN "
        "(SELECT doc_id AS d, par, floor((par - 1) / 3) AS k FROM {paragraphs} WHERE length(text) > 100) p ON c.doc_id = p.d AND c.id = p.k GROUP BY doc_id, c.id",
    ),
    "token_length_profile": (
        "SELECT lang, CAST(floor(median(n)) AS BIGINT) AS mid, max(n) AS longest, count(CASE WHEN n > 128 THEN 1 END) AS over, CAST(sum(greatest(n - 128, 0)) AS BIGINT) AS lost FROM (SELECT lang, CAST(size(toks) AS BIGINT) AS n FROM {tokens}) x GROUP BY lang",
        "SELECT lang, CAST(floor(median(n)) AS BIGINT) AS mid, max(n) AS longest, count(CASE WHEN n > 128 THEN 1 END) AS over, CAST(sum(greatest(n - 128, 0)) AS BIGINT) AS lost FROM (SELECT lang, CAST(len(toks) AS BIGINT) AS n FROM {tokens}) x GROUP BY lang",
    ),
    # Four special tokens come first.
    "vocab_encode": (
        "WITH v AS (SELECT token FROM (SELECT explode(toks) AS token FROM {tokens} WHERE lang = 'de') x GROUP BY token HAVING count(*) >= 2) "
        "SELECT doc_id, count(*) AS n, count(CASE WHEN v.token IS NULL THEN 1 END) AS unknown FROM (SELECT doc_id, explode(toks) AS token FROM {tokens} WHERE lang = 'de') t LEFT JOIN v ON t.token = v.token GROUP BY doc_id",
        "WITH v AS (SELECT token FROM (SELECT unnest(toks) AS token FROM {tokens} WHERE lang = 'de') x GROUP BY token HAVING count(*) >= 2) "
        "SELECT doc_id, count(*) AS n, count(CASE WHEN v.token IS NULL THEN 1 END) AS unknown FROM (SELECT doc_id, unnest(toks) AS token FROM {tokens} WHERE lang = 'de') t LEFT JOIN v ON t.token = v.token GROUP BY doc_id",
    ),
    "char_diff": (
        "SELECT doc_id, ch, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT doc_id, explode(split(lower(text), '')) AS ch, 1 AS d FROM {documents} UNION ALL SELECT doc_id, explode(split(text, '')), -1 FROM {documents}) x WHERE ch <> '' GROUP BY doc_id, ch HAVING sum(d) <> 0",
        "SELECT doc_id, ch, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, 1 AS d FROM {documents} UNION ALL SELECT doc_id, unnest(string_split(text, '')), -1 FROM {documents}) x WHERE ch <> '' GROUP BY doc_id, ch HAVING sum(d) <> 0",
    ),
}

#: Windows
WINDOWS = {
    "chapter_offsets": "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) x WHERE before IS NULL OR before <> role",
    "chapter_range": "WITH s AS (SELECT conv_id, turn FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) x WHERE before IS NULL OR before <> role), "
    "t AS (SELECT conv_id, max(turn) + 1 AS total FROM {conversations} GROUP BY conv_id) SELECT s.conv_id, turn AS first, coalesce(lead(turn) OVER (PARTITION BY s.conv_id ORDER BY turn), total) AS last FROM s JOIN t ON s.conv_id = t.conv_id",
    "prefix_lengths": "SELECT doc_id, par, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY par ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS chars FROM {paragraphs}",
    "log_ts_order": "SELECT loop, bool_and(ts >= before) AS ordered FROM (SELECT loop, ts, coalesce(lag(ts) OVER (PARTITION BY loop ORDER BY line), ts) AS before FROM {log}) x GROUP BY loop",
    "block_ids": "SELECT doc_id, par, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY par) - 1) / 5) AS BIGINT) AS block FROM {paragraphs}",
    "translator_exact": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM {documents}) x WHERE k <= 12",
    "seeded_sample": ("SELECT doc_id FROM (SELECT doc_id FROM {documents} ORDER BY md5(concat('20260907:', CAST(doc_id AS STRING))), doc_id LIMIT 25) x", "SELECT doc_id FROM (SELECT doc_id FROM {documents} ORDER BY md5(concat('20260907:', CAST(doc_id AS VARCHAR))), doc_id LIMIT 25) x"),
}

#: Set operations
SETS = {
    "union_columns": "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM {customer} UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM {supplier}",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
}

shared_all(SCANS | FILTERS | JOINS | AGGREGATES | WINDOWS | SETS)

# Flags stand for Python's: Unicode classes and cases, and only a newline ends a line.
SECRET_BLOCK = (
    r"-----BEGIN (RSA |EC |OPENSSH |PGP )?PRIVATE KEY-----",
    r"AKIA[0-9A-Z]{16}",
    r"(?iU)\b(api[_-]?key|secret|token|password|passwd)\b\s*[=:]\s*['\"][^'\"]{8,}['\"]",
)
SECRET_WARN = (r"(?U)\beval\s*\(", r"(?iUd)(execute|cursor\.execute)\s*\(\s*[\"'].*%s.*[\"']\s*%")
#: What the test data hold besides.
SECRET_BLOCK_MORE = (r"token = .[0-9a-f]+",)
SECRET_WARN_MORE = (r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+",)


@query()
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that matches a pattern of secrets (block) or of risks (warn); tests/test_secret_scan.py holds it."""

    def hit(patterns: tuple[str, ...]) -> Column:
        return F.exists(F.split("text", "\n"), lambda line: F.array_contains(F.array(*[F.rlike(line, F.lit(p)) for p in patterns]), True))

    found = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(hit(SECRET_BLOCK + SECRET_BLOCK_MORE), "block").when(hit(SECRET_WARN + SECRET_WARN_MORE), "warn").alias("kind")
    )
    return found.where("kind IS NOT NULL")
