"""Snapshots derived from the given tables, in SQL that Spark and DuckDB read alike; the queries run on them."""

from __future__ import annotations

P = "'/ws/' || source || '/' || lang || '/d' || doc_id || '.txt'"
D = "'//depot/main/' || source || '/' || lang || '/d' || doc_id || '.txt'"

WORKSPACE = f"""
SELECT {P} AS path, lower({P}) AS path_key, CAST(length(text) AS BIGINT) AS size,
       CASE WHEN doc_id % 3 = 0 THEN 1704067200 + doc_id ELSE 1704067200 + doc_id + 100 END AS mtime_s,
       doc_id % 23 = 0 AS filtered, md5(text) AS digest
FROM documents WHERE doc_id % 11 <> 0
"""
DEPOT = f"""
SELECT doc_id AS seq, {D} AS depot_file, {P} AS client_file, lower({P}) AS client_key,
       CASE doc_id % 29 WHEN 0 THEN 'apple' WHEN 1 THEN 'binary+l' WHEN 2 THEN 'utf16' WHEN 3 THEN 'futuretype' ELSE 'text+w' END AS raw_type,
       CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN 'delete' WHEN doc_id % 41 = 0 THEN 'archive' ELSE 'edit' END AS head_action,
       CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 1 + doc_id % 5 END AS head_rev,
       CASE WHEN doc_id % 31 = 0 OR doc_id % 17 = 0 THEN NULL WHEN doc_id % 5 > 2 THEN doc_id % 5 ELSE 1 + doc_id % 5 END AS have_rev,
       CASE WHEN doc_id % 31 = 0 THEN 'add' WHEN doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 17 = 0 THEN NULL
            WHEN doc_id % 19 = 0 THEN 'edit' WHEN doc_id % 43 = 0 AND doc_id % 29 <> 0 THEN 'delete' END AS action,
       CAST(length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS file_size,
       md5(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS digest
FROM documents WHERE doc_id % 13 <> 0
"""
HAVE = f"""
SELECT lower({P}) AS path_key, 1704067200 + doc_id AS sync_time FROM documents
WHERE doc_id % 13 <> 0 AND doc_id % 31 <> 0 AND doc_id % 17 <> 0
"""
REVISIONS = """
SELECT '//depot/c' || o_custkey AS depot_file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rev,
       o_orderkey AS change, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'edit' ELSE 'add' END AS action
FROM orders
"""
#: Every 50th record again under another spelling of the depot path, half of them deleted.
COLLISIONS = """
SELECT seq, depot_file, client_key, head_action, have_rev FROM fx_depot
UNION ALL
SELECT seq + 1000000, upper(depot_file), client_key, CASE WHEN seq % 100 = 0 THEN 'delete' ELSE head_action END, have_rev FROM fx_depot WHERE seq % 50 = 0
"""
#: Head facts, with some paths absent.
TARGET = "SELECT depot_file, head_rev AS rev, head_action AS action FROM fx_depot WHERE head_rev IS NOT NULL AND head_action IS NOT NULL AND seq % 47 <> 0"
SCOPE = """
SELECT 'include' AS role, 'dir' AS kind, '/ws/src1' AS path, '/ws/src1' AS key
UNION ALL SELECT 'include', 'dir', '/ws/src2/en', '/ws/src2/en'
UNION ALL SELECT 'include', 'file', '/ws/src3/en/d3.txt', '/ws/src3/en/d3.txt'
UNION ALL SELECT 'include', 'dir', '/ws/none', '/ws/none'
UNION ALL SELECT 'exclude', 'dir', '/ws/src1/fr', '/ws/src1/fr'
"""
VIEW_MAP = f"""
SELECT lower({P}) AS path_key, CASE WHEN doc_id % 53 = 0 THEN NULL ELSE {D} END AS depot_file, doc_id % 61 = 0 AS unmapped
FROM documents WHERE doc_id % 59 <> 0
"""
VERDICTS = f"SELECT {P} AS path, doc_id % 5 = 0 AS ignored FROM documents WHERE doc_id % 67 <> 0"
#: A wide inventory with three path levels, one row a line item.
WIDE = """
SELECT '/ws/o' || (l_orderkey % 1000) || '/' || l_orderkey || '/l' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS path_key, CAST(l_quantity AS BIGINT) AS size
FROM lineitem
"""
#: A log of the events: errors are conflicts, other events files of a class; every run has one summary, wrong for every
#: tenth run, and none for every fifteenth.
RUNLOG = """
SELECT CAST(user_id AS STRING) AS run_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'conflict' ELSE 'file' END AS kind,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS class, CAST(NULL AS BOOLEAN) AS ok, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS conflicts
FROM events
UNION ALL
SELECT CAST(user_id AS STRING), max(event_id) + 1000000000, 'summary', NULL, user_id % 7 <> 0,
       count(CASE WHEN event_type <> 'error' THEN 1 END) + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END, count(CASE WHEN event_type = 'error' THEN 1 END)
FROM events WHERE user_id % 15 <> 0 GROUP BY user_id
"""

VIEWS = {
    "fx_workspace": WORKSPACE, "fx_depot": DEPOT, "fx_have": HAVE, "fx_revisions": REVISIONS, "fx_collisions": COLLISIONS, "fx_target": TARGET, "fx_scope": SCOPE, "fx_view_map": VIEW_MAP,
    "fx_verdicts": VERDICTS, "fx_wide": WIDE, "fx_runlog": RUNLOG,
}


def needed(names: list[str]) -> list[str]:
    """The views and the views that they read, in order."""
    out: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and other in VIEWS[name]:
                add(other)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return out


def with_views(names: list[str], sql: str) -> str:
    """A statement with the views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed(names)) + "\n" + sql
