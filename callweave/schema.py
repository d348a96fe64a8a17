"""The tables of a code graph."""

from __future__ import annotations

SCHEMA_VERSION = 6

NODES = (
    "id string, name string, kind string, qualified_name string, file_path string, start_line long, end_line long, "
    "start_column long, end_column long, signature string, doc_comment string, is_test boolean"
)
EDGES = "source_id string, target_id string, kind string, resolution_kind int"
FILES = "file_path string, content_hash string, language string, size_bytes long, last_modified long, is_test boolean"
RAW_CALLS = (
    "caller_id string, callee_name string, callee_simple string, callee_scope string, call_kind string, receiver_expr string, "
    "receiver_type string, package_or_namespace string, import_hint string, line long, column long"
)
UNRESOLVED = "source_id string, specifier string, kind string, line long, column long"
METADATA = "key string, value string"
POSTINGS = "term string, id string, col string, pos int, tokens int"
TRIGRAMS = "gram string, id string"
IMPACTS = "term string, block int, shard int, id string, tf int, tokens int"
IMPACT_BLOCKS = "term string, block int, shard int, symbols long, words long, most_tf int, least_tokens int, least_id string, mean double, most double"
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "raw_calls": RAW_CALLS, "unresolved_refs": UNRESOLVED, "postings": POSTINGS, "trigrams": TRIGRAMS, "impacts": IMPACTS, "impact_blocks": IMPACT_BLOCKS, "project_metadata": METADATA}


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]
