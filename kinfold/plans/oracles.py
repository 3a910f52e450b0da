"""DuckDB SQL for the queries of the registry, composed of common table expressions."""

from __future__ import annotations

from kinfold.functions.normalize import DENIED_HOSTS
from kinfold.operators.matching import COMPARISONS, FIXED

_DENIED = ", ".join(f"'{h}'" for h in (*DENIED_HOSTS, "cheap-pills.example.com"))
# DuckDB measures edit distance in bytes; with a letter of one byte for each accented one it counts characters.
_PLAIN = "translate({}, 'éßçäóèñíêüö', 'ABCDEFGHIJK')"
_LEV = f"levenshtein({_PLAIN.format('name_norm_l')}, {_PLAIN.format('name_norm_r')})"
_NEAR = f"levenshtein({_PLAIN.format('l.name_norm')}, {_PLAIN.format('r.name_norm')})"
_SHORT = "least(length(name_norm_l), length(name_norm_r))"
_NAME_LEVEL = f"CASE WHEN name_norm_l IS NULL OR name_norm_r IS NULL THEN -1 WHEN name_norm_l = name_norm_r THEN 3 WHEN {_SHORT} >= 6 AND {_LEV} <= 1 THEN 2 WHEN {_SHORT} >= 8 AND {_LEV} <= 2 THEN 1 ELSE 0 END"
_FORMS = "inc|llc|ltd|corp|gmbh|sa|ag"


def _case(c: str, levels: tuple[int, ...]) -> str:
    return f"CASE g_{c} " + " ".join(f"WHEN {x} THEN CAST({FIXED.weight(c, x)!r} AS DOUBLE)" for x in levels) + " ELSE 0 END"


_SIDES = "l.record_id AS record_id_l, r.record_id AS record_id_r, l.name_norm AS name_norm_l, r.name_norm AS name_norm_r, l.host AS host_l, r.host AS host_r, l.country_norm AS country_norm_l, r.country_norm AS country_norm_r, l.city_norm AS city_norm_l, r.city_norm AS city_norm_r"
_EXACT = "CASE WHEN {0}_l IS NULL OR {0}_r IS NULL THEN -1 WHEN {0}_l = {0}_r THEN 1 ELSE 0 END"

#: By name: the body, after those it needs.
_STEPS = {
    "base": "SELECT page_id, url, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, regexp_extract(url, '^https?://[^/]*\\.([a-z]+)/', 1) AS sfx FROM pages",
    "rec": """SELECT 'r' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS record_id, url AS handle,
      CASE WHEN page_id % 11 = 4 THEN title || ' group' WHEN page_id % 7 = 3 THEN left(title, length(title) - 1) WHEN page_id % 7 = 5 THEN left(title, length(title) - 2) ELSE title END AS name,
      CASE WHEN page_id % 5 = 0 OR page_id % 11 = 4 THEN NULL ELSE url END AS website, CAST(NULL AS VARCHAR) AS industry, CAST(NULL AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS founded,
      CASE WHEN page_id % 5 = 2 THEN NULL ELSE sfx END AS city, CAST(NULL AS VARCHAR) AS state, CASE WHEN page_id % 6 = 1 THEN NULL ELSE lang END AS country_code FROM base""",
    "keyed": r"""SELECT *, nullif(regexp_replace(lower(trim(name)), '\s+', ' ', 'g'), '') AS name_norm,
      nullif(regexp_extract(regexp_replace(regexp_replace(lower(trim(website)), '^https?://', ''), '^www\.', ''), '^([^/]+)', 1), '') AS host,
      lower(nullif(trim(country_code), '')) AS country_norm, lower(nullif(trim(city), '')) AS city_norm FROM rec""",
    "prep": "SELECT *, substring(name_norm, 1, 3) AS name_prefix FROM keyed",
    "local": rf"""SELECT *, nullif(regexp_replace(CASE WHEN regexp_matches(w, '^[a-z][a-z0-9+.-]*://') THEN regexp_extract(w, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) ELSE regexp_extract(w, '^([^/]*)', 1) END, '^www\.', ''), '') AS local_host,
      nullif(regexp_replace(t, '(?:(?:^| )(?:{_FORMS})[.,]*)+$', ''), '') AS local_name FROM (
      SELECT *, CASE WHEN contains(lower(trim(website)), '://') THEN lower(trim(website)) ELSE 'http://' || lower(trim(website)) END AS w, trim(regexp_replace(lower(coalesce(name, '')), '\s+', ' ', 'g')) AS t FROM rec)""",
    "coarse": "SELECT *, substring(local_name, 1, 20) || '|' || lower(trim(coalesce(country_code, ''))) AS coarse_key FROM local",
    "eligible": f"SELECT * FROM prep WHERE host IS NOT NULL AND host NOT IN ({_DENIED})",
    "by_host": f"SELECT {_SIDES} FROM eligible l JOIN eligible r ON l.host = r.host AND l.record_id < r.record_id",
    "by_prefix": f"SELECT {_SIDES} FROM prep l JOIN prep r ON l.name_prefix = r.name_prefix AND l.country_norm = r.country_norm AND l.record_id < r.record_id",
    "pairs": f"SELECT *, 'host' AS match_key FROM by_host UNION ALL SELECT *, 'prefix_country' AS match_key FROM by_prefix WHERE NOT coalesce(host_l = host_r AND host_l NOT IN ({_DENIED}), false)",
    "sure": f"SELECT record_id_l, record_id_r FROM by_host WHERE {_SHORT} >= 6 AND {_LEV} <= 2 UNION SELECT l.record_id, r.record_id FROM prep l JOIN prep r ON l.name_norm = r.name_norm AND l.country_norm = r.country_norm AND l.record_id < r.record_id",
    "compared": f"""SELECT *, CASE WHEN name_norm_l IS NULL OR name_norm_r IS NULL THEN -1 WHEN name_norm_l = name_norm_r THEN 3 WHEN {_SHORT} >= 6 AND {_LEV} <= 1 THEN 2 WHEN {_SHORT} >= 8 AND {_LEV} <= 2 THEN 1 ELSE 0 END AS g_name,
      {_EXACT.format('host')} AS g_host, {_EXACT.format('country_norm')} AS g_country, {_EXACT.format('city_norm')} AS g_city FROM pairs""",
    "weighed": "SELECT *, " + f"CAST({FIXED.prior_weight()!r} AS DOUBLE) + " + " + ".join(_case(c, x) for c, x in COMPARISONS.items()) + " AS match_weight FROM compared",
    "scored": "SELECT *, CASE WHEN p >= 0.9 THEN 'match' WHEN p >= 0.5 THEN 'review' WHEN p >= 0.2 THEN 'possible' ELSE 'non_match' END AS disposition FROM (SELECT *, 1 / (1 + pow(2.0::DOUBLE, -match_weight)) AS p FROM weighed)",
    "edges": "SELECT record_id_l AS a, record_id_r AS b FROM scored WHERE p >= 0.9 UNION SELECT record_id_r, record_id_l FROM scored WHERE p >= 0.9",
    "reach": "SELECT record_id AS node, record_id AS label FROM rec UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node",
    "golden": "SELECT node AS record_id, 'g' || min(label) AS golden_entity_id FROM reach GROUP BY node",
    "reps": f"""SELECT golden_entity_id, record_id, name_norm, host, country_norm, CASE WHEN host IS NOT NULL AND host NOT IN ({_DENIED}) THEN 'p' || substring(sha256(host), 1, 16) END AS host_parent_id
      FROM (SELECT g.golden_entity_id, p.*, row_number() OVER (PARTITION BY golden_entity_id ORDER BY record_id) AS rn FROM golden g JOIN prep p USING (record_id)) WHERE rn = 1""",
    "named": """SELECT golden_entity_id, name_parent_id FROM (SELECT c.golden_entity_id, p.golden_entity_id AS name_parent_id, row_number() OVER (PARTITION BY c.golden_entity_id ORDER BY length(p.name_norm), p.golden_entity_id) AS rn
      FROM reps c JOIN reps p ON c.country_norm = p.country_norm AND c.golden_entity_id <> p.golden_entity_id AND length(p.name_norm) >= 8 AND starts_with(c.name_norm, p.name_norm || ' ') WHERE c.host_parent_id IS NULL) WHERE rn = 1""",
    "tree": "SELECT g.record_id, g.golden_entity_id, coalesce(r.host_parent_id, n.name_parent_id, g.golden_entity_id) AS ultimate_parent_id FROM golden g JOIN reps r USING (golden_entity_id) LEFT JOIN named n USING (golden_entity_id)",
    "host_groups": "SELECT host, count(*) AS n FROM eligible GROUP BY host HAVING count(*) BETWEEN 2 AND 10",
    "name_groups": "SELECT name_norm, country_norm, count(*) AS n FROM prep WHERE name_norm IS NOT NULL AND country_norm IS NOT NULL GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10",
    "picked_hosts": "SELECT host FROM host_groups ORDER BY sha256('42|' || host), host LIMIT 18",
    "picked_names": "SELECT name_norm, country_norm FROM name_groups ORDER BY sha256('43|' || name_norm || '|' || country_norm), name_norm, country_norm LIMIT 9",
    "picked": "SELECT * FROM prep WHERE host IN (SELECT host FROM picked_hosts) OR (name_norm, country_norm) IN (SELECT (name_norm, country_norm) FROM picked_names)",
    "filler": "SELECT * FROM prep WHERE record_id NOT IN (SELECT record_id FROM picked) ORDER BY sha256('44|' || record_id), record_id LIMIT 30",
}
_NEEDS = {
    "rec": ["base"], "keyed": ["rec"], "prep": ["keyed"], "local": ["rec"], "coarse": ["local"], "eligible": ["prep"], "by_host": ["eligible"], "by_prefix": ["prep"], "pairs": ["by_host", "by_prefix"], "sure": ["by_host"], "compared": ["pairs"], "weighed": ["compared"],
    "scored": ["weighed"], "edges": ["scored"], "reach": ["edges"], "golden": ["reach"], "reps": ["golden"], "named": ["reps"], "tree": ["named"], "host_groups": ["eligible"], "name_groups": ["prep"], "picked_hosts": ["host_groups"], "picked_names": ["name_groups"], "picked": ["picked_hosts", "picked_names"], "filler": ["picked"],
}


def _with(last: str, body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for x in _NEEDS.get(name, []):
            visit(x)
        if name not in order:
            order.append(name)

    for x in last.split():
        visit(x)
    return "WITH RECURSIVE " + ",\n".join(f"{x} AS ({_STEPS[x]})" for x in order) + "\n" + body


def _hash(c: str) -> str:
    return f"'hash:' || substring(sha256(nullif(trim({c}), '')), 1, 8)"


_BLANK = "CAST({0} IS NULL OR trim({0}) = '' AS DOUBLE)"
_PROFILED = ("name", "website", "handle", "city", "state", "country_code")
_RATES = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({_BLANK.format(c)}), 6) AS null_rate FROM rec" for c in _PROFILED)
_KEYS = {"host": "local_host", "name": "local_name", "coarse": "coarse_key"}
_GROUPS = "(SELECT {0} AS k, count(*) AS n FROM coarse WHERE {0} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"
_ROUND = "round(match_weight, 6) AS match_weight, round(p, 6) AS match_probability"


def _u(name: str, c: str) -> str:
    return f"SELECT '{name}' AS comparison, round(CASE WHEN sum(n) > 1 THEN sum(n * (n - 1) / 2) / (sum(n) * (sum(n) - 1) / 2) ELSE 0 END, 9) AS u FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM prep WHERE {c} IS NOT NULL GROUP BY {c})"


def _duplicates(columns: str) -> str:
    return f"(SELECT count(*) AS n FROM rec GROUP BY {columns})"


SQL: dict[str, str] = {
    "company_records": _with("rec", "SELECT * FROM rec"),
    "normalize_keys": _with("prep", rf"SELECT record_id, name_norm, host, country_norm, city_norm, name_prefix, nullif(trim(regexp_replace(lower(trim(name)), '\s+', ' ', 'g')), '') AS name_norm_ingest, CASE WHEN host IS NOT NULL AND host NOT IN ({_DENIED}) THEN 'p' || substring(sha256(host), 1, 16) END AS host_parent_id FROM prep"),
    "normalize_local": _with("coarse", "SELECT record_id, local_host, local_name, coarse_key FROM coarse"),
    "masked_hash": _with("rec", f"SELECT record_id, {_hash('name')} AS name_hash, {_hash('website')} AS website_hash FROM rec"),
    "null_rates": _with("rec", _RATES),
    "exact_duplicates": _with("rec", f"SELECT CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS BIGINT) AS duplicate_rows FROM {_duplicates('name, city, country_code')}"),
    "country_top20": _with("rec", "SELECT trim(coalesce(country_code, '')) AS country_code, count(*) AS n FROM rec GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "dq_summary": _with(
        "coarse",
        f"SELECT 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM rec UNION ALL SELECT 'null_rate_' || column_name, null_rate FROM ({_RATES}) UNION ALL SELECT 'exact_duplicate_rows', CAST(coalesce(sum(n) FILTER (WHERE n >= 2), 0) AS DOUBLE) FROM {_duplicates('handle, name, website, city, country_code')}"
        + "".join(f" UNION ALL SELECT '{k}_groups_ge_2', CAST(count(*) AS DOUBLE) FROM {_GROUPS.format(c)} UNION ALL SELECT '{k}_records_in_groups_ge_2', CAST(coalesce(sum(n), 0) AS DOUBLE) FROM {_GROUPS.format(c)}" for k, c in _KEYS.items()),
    ),
    "host_collision_groups": _with("prep", "SELECT host, count(*) AS n FROM prep WHERE host IS NOT NULL GROUP BY 1 HAVING count(*) >= 2"),
    "name_collision_groups": _with("rec", r"SELECT nullif(trim(regexp_replace(lower(trim(name)), '\s+', ' ', 'g')), '') AS name_norm, count(*) AS n FROM rec GROUP BY 1 HAVING count(*) >= 2 AND nullif(trim(regexp_replace(lower(trim(any_value(name))), '\s+', ' ', 'g')), '') IS NOT NULL"),
    "coarse_key_collisions": _with("coarse", f"SELECT k AS coarse_key, n FROM {_GROUPS.format('coarse_key')}"),
    "collision_stats": _with("coarse", " UNION ALL ".join(f"SELECT '{k}' AS key_name, count(*) AS groups_ge_2, CAST(coalesce(sum(n), 0) AS BIGINT) AS records_in_groups_ge_2 FROM {_GROUPS.format(c)}" for k, c in _KEYS.items())),
    "masked_examples": _with("coarse", " UNION ALL ".join(f"(SELECT '{k}' AS key_name, {_hash('k')} AS example, n FROM {_GROUPS.format(c)} ORDER BY n DESC, k LIMIT 1)" for k, c in _KEYS.items())),
    "eligible_groups": _with("host_groups name_groups", "SELECT 'host' AS rule, host AS group_key, n FROM host_groups UNION ALL SELECT 'name_country', name_norm || '|' || country_norm, n FROM name_groups"),
    "part_collision_window": "SELECT p_name AS k1, p_brand AS k2, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL HAVING count(*) BETWEEN 2 AND 10",
    "max_host_group": _with("eligible", "SELECT coalesce(max(n), 0) AS max_group FROM (SELECT count(*) AS n FROM eligible GROUP BY host)"),
    "hash_topk_sample": _with("rec", "SELECT record_id, name, website FROM rec ORDER BY sha256('42|' || record_id), record_id LIMIT 100"),
    "threshold_sample": _with("rec", "SELECT record_id, name, website FROM (SELECT *, row_number() OVER (ORDER BY sha256('42|' || record_id), record_id) AS k, count(*) OVER () AS n FROM rec) WHERE k <= n // 2"),
    "enriched_sample": _with("filler", "SELECT record_id, name, website, country_code FROM picked UNION ALL SELECT record_id, name, website, country_code FROM filler"),
    "filler_antijoin": _with("filler", "SELECT record_id, name FROM filler"),
    "block_host": _with("by_host", "SELECT record_id_l, record_id_r FROM by_host"),
    "block_prefix_country": _with("by_prefix", "SELECT record_id_l, record_id_r FROM by_prefix"),
    "block_dedup_union": _with("pairs", "SELECT record_id_l, record_id_r, match_key FROM pairs"),
    "pair_counts_by_rule": _with("by_host by_prefix", "SELECT 'host' AS rule, count(*) AS n_pairs FROM by_host UNION ALL SELECT 'prefix_country', count(*) FROM by_prefix"),
    "deterministic_pairs": _with("sure", "SELECT record_id_l, record_id_r FROM sure"),
    "near_host_names": _with("eligible", f"""SELECT host, l.name_norm AS name_l, r.name_norm AS name_r, l.n AS n_l, r.n AS n_r, {_NEAR} AS distance
      FROM (SELECT host, name_norm, count(*) AS n FROM eligible GROUP BY ALL) l JOIN (SELECT host, name_norm, count(*) AS n FROM eligible GROUP BY ALL) r USING (host) WHERE l.name_norm < r.name_norm AND least(length(l.name_norm), length(r.name_norm)) >= 6 AND {_NEAR} <= 2"""),
    "distinct_pair_counts": _with("pairs", "SELECT 'host' AS rule, count(*) AS n_pairs, count(*) AS n_new FROM by_host UNION ALL SELECT 'prefix_country', (SELECT count(*) FROM by_prefix), (SELECT count(*) FROM pairs WHERE match_key = 'prefix_country')"),
    "lambda_estimate": _with("sure", "SELECT n_records, n_pairs, round(n_pairs / 0.6::DOUBLE / (n_records::DOUBLE * (n_records - 1) / 2), 9) AS lam FROM (SELECT (SELECT count(*) FROM prep) AS n_records, (SELECT count(*) FROM sure) AS n_pairs)"),
    "u_exact": _with("prep", " UNION ALL ".join(_u(*x) for x in (("host", "host"), ("country", "country_norm"), ("city", "city_norm")))),
    # as exact shares: at these sizes all pairs are fewer than the operator's 1,000,000
    "u_name_levels": _with("prep", f"""SELECT g_name, n_pairs, round(n_pairs / sum(n_pairs) OVER (), 9) AS share FROM (SELECT g_name, count(*) AS n_pairs FROM (SELECT {_NAME_LEVEL} AS g_name
      FROM (SELECT l.name_norm AS name_norm_l, r.name_norm AS name_norm_r FROM prep l JOIN prep r ON l.record_id < r.record_id WHERE l.name_norm IS NOT NULL AND r.name_norm IS NOT NULL)) GROUP BY 1)"""),
    "comparison_vectors": _with("compared", "SELECT record_id_l, record_id_r, g_name, g_host, g_country, g_city FROM compared"),
    "gamma_patterns": _with("compared", "SELECT g_name, g_host, g_country, g_city, count(*) AS n FROM compared GROUP BY ALL"),
    "class_patterns": _with("compared", "SELECT g_name, g_host, g_country, g_city, count(*) AS n FROM compared GROUP BY ALL"),
    "score_pairs_fixed": _with("scored", f"SELECT record_id_l, record_id_r, {_ROUND}, disposition FROM scored"),
    "disposition_histogram": _with("scored", "SELECT count(*) FILTER (WHERE p < 0.2) AS p_lt_02, count(*) FILTER (WHERE p >= 0.2 AND p < 0.5) AS p_02_05, count(*) FILTER (WHERE p >= 0.5 AND p < 0.9) AS p_05_09, count(*) FILTER (WHERE p >= 0.9) AS p_ge_09, count(*) AS n_pairs, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p FROM scored"),
    "pattern_histogram": _with("scored", "SELECT count(*) FILTER (WHERE p < 0.2) AS p_lt_02, count(*) FILTER (WHERE p >= 0.2 AND p < 0.5) AS p_02_05, count(*) FILTER (WHERE p >= 0.5 AND p < 0.9) AS p_05_09, count(*) FILTER (WHERE p >= 0.9) AS p_ge_09, count(*) AS n_pairs, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p FROM scored"),
    "review_queue": _with("scored", "SELECT record_id_l, record_id_r, round(p, 6) AS match_probability FROM scored WHERE disposition = 'review'"),
    "golden_entities": _with("golden", "SELECT record_id, golden_entity_id FROM golden"),
    "incremental_golden": _with("golden", "SELECT record_id, golden_entity_id FROM golden"),
    "cluster_stats": _with("golden", "SELECT count(*) AS cluster_n, count(*) FILTER (WHERE n = 1) AS singleton_n, coalesce(max(n), 0) AS max_size FROM (SELECT count(*) AS n FROM golden GROUP BY golden_entity_id)"),
    "cluster_review": _with("golden", f"SELECT golden_entity_id, cluster_size, record_id, {_hash('name_norm')} AS name_hash, {_hash('host')} AS host_hash, country_norm FROM (SELECT g.golden_entity_id, g.record_id, count(*) OVER (PARTITION BY golden_entity_id) AS cluster_size, name_norm, host, country_norm FROM golden g JOIN prep USING (record_id)) WHERE cluster_size >= 2 ORDER BY cluster_size DESC, golden_entity_id, record_id LIMIT 100"),
    "representatives": _with("reps", "SELECT golden_entity_id, record_id, name_norm, host, country_norm FROM reps"),
    "host_parent": _with("reps", "SELECT golden_entity_id, host_parent_id FROM reps"),
    "name_prefix_parent": _with("named", "SELECT golden_entity_id, name_parent_id FROM named"),
    "hierarchy": _with("tree", "SELECT record_id, golden_entity_id, ultimate_parent_id FROM tree"),
    "parent_review": _with("tree", f"SELECT ultimate_parent_id, parent_size, golden_entity_id, country_norm, {_hash('name_norm')} AS name_hash, {_hash('host')} AS host_hash FROM (SELECT *, count(*) OVER (PARTITION BY ultimate_parent_id) AS parent_size FROM (SELECT DISTINCT golden_entity_id, ultimate_parent_id FROM tree)) t JOIN reps USING (golden_entity_id) WHERE parent_size >= 2 ORDER BY parent_size DESC, ultimate_parent_id, golden_entity_id LIMIT 50"),
    "funnel": _with("tree", "SELECT *, round(1 - goldens / records, 6) AS record_to_golden, round(1 - parents / goldens, 6) AS golden_to_parent, round(1 - parents / records, 6) AS record_to_parent FROM (SELECT count(*) AS records, count(DISTINCT golden_entity_id) AS goldens, count(DISTINCT ultimate_parent_id) AS parents FROM tree)"),
    "verify_hierarchy": _with(
        "tree",
        " UNION ALL ".join(
            f"""SELECT '{t}_not_empty' AS "check", count(*) > 0 AS ok, count(*) AS detail FROM {t_} UNION ALL SELECT '{t}_unique_ids', count(*) = count(DISTINCT record_id), count(*) - count(DISTINCT record_id) FROM {t_} UNION ALL SELECT '{t}_no_nulls', count(*) FILTER (WHERE {nulls}) = 0, count(*) FILTER (WHERE {nulls}) FROM {t_}"""
            for t, t_, nulls in (("source", "rec", "record_id IS NULL"), ("golden", "golden", "record_id IS NULL OR golden_entity_id IS NULL"), ("hierarchy", "tree", "record_id IS NULL OR golden_entity_id IS NULL OR ultimate_parent_id IS NULL"))
        )
        + "".join(f" UNION ALL SELECT '{n}_same_ids', count(*) = 0, count(*) FROM (SELECT record_id FROM {a} EXCEPT SELECT record_id FROM {b} UNION ALL (SELECT record_id FROM {b} EXCEPT SELECT record_id FROM {a}))" for n, a, b in (("source_golden", "rec", "golden"), ("golden_hierarchy", "golden", "tree"))),
    ),
    "id_set_mismatch": _with("rec", "SELECT record_id, 'left' AS only_in FROM (SELECT record_id FROM rec WHERE website IS NOT NULL EXCEPT SELECT record_id FROM rec WHERE country_code IS NOT NULL) UNION ALL SELECT record_id, 'right' FROM (SELECT record_id FROM rec WHERE country_code IS NOT NULL EXCEPT SELECT record_id FROM rec WHERE website IS NOT NULL)"),
    "asof_join": """WITH bought AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
      SELECT event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = b.user_id AND v.ts <= b.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id,
        (SELECT o_orderkey FROM orders WHERE o_custkey = b.user_id AND o_orderdate <= b.ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM bought b""",
    "interval_join": "SELECT e.user_id, x.event_id AS error_id, e.event_id FROM events x JOIN events e ON e.user_id = x.user_id AND e.ts > x.ts AND e.ts < x.ts + INTERVAL 1 DAY WHERE x.event_type = 'error'",
    "event_sessions": """SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, round(sum(value), 6) AS total_value
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))
      GROUP BY user_id, island""",
}
