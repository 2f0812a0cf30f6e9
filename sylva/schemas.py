"""Table schemas. Every table is read with an explicit schema; NULL has a meaning of its own (no have_rev: never synced).

``seq`` is the arrival order, which first-wins rules need, as a table has no order.
"""

from __future__ import annotations

DEPOT = "seq long, depot_file string, client_file string, client_key string, head_type string, unsupported_type string, head_action string, head_rev long, have_rev long, action string, file_size long, digest string"
WORKSPACE = "path string, path_key string, size long, mtime timestamp, filtered boolean"
HAVE = "path_key string, sync_time long"
TARGET = "depot_file string, rev long, action string"
REVISIONS = "depot_file string, rev long, change long, action string, head_type string, file_size long, digest string"
DIGEST_CACHE = "path_key string, size long, mtime timestamp, digest string"
SCOPE = "role string, kind string, path string, key string"
VIEW_MAP = "path_key string, depot_file string, unmapped boolean"
IGNORE_VERDICTS = "path string, ignored boolean, source string"
PLAN = "mode string, class string, action string, depot_file string, client_file string, rev long, applied boolean, force boolean, stage string, native_action string, handoff string"
CONFLICTS = "reason string, action string, depot_file string, client_file string, rev string, stage string, applied boolean"
FEED = "seq long, code string, depotFile string, clientFile string, action string, rev string, severity int, data string"
RUNLOG = (
    "run_id string, seq long, kind string, class string, action string, depotFile string, clientFile string, rev string, stage string, nativeAction string, applied boolean, force boolean, "
    "handoff string, reason string, message string, path string, type string, ok boolean, total long, conflicts long, counts map<string,long>, p4Calls long, command string, count long, "
    "phase string, step long, steps long"
)
