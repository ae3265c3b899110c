"""All queries of the core, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["text_queries", "index_queries", "structure_queries", "symbol_queries", "ranking_queries", "ledger_queries", "evaluation_queries", "graph_queries", "stateful_queries", "source_queries", "anchor_queries", "excerpt_queries"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE

#: Columns that are 32-bit integers in Spark; the SQL's are cast to them.
INTEGERS = {
    "rank": ["keyword_rank", "tfidf_score", "tfidf_damped_score", "route_groups", "entry_documents", "ppmi_neighbors", "token_overlap_rank", "probe_names", "subsystem_localize", "rank_candidates", "retrieval_rank", "ambiguous_rank", "combined_route"],
    "position": ["scan_files", "evidence_match", "budget_pack", "greedy_fill", "prune_candidates", "probe_paths", "name_candidates"],
    "near_rank": ["near_ties"], "depth": ["path_parts"], "lines": ["line_windows"], "header": ["header_lines"], "files_changed": ["ledger_export"], "selected_files": ["ledger_export"],
    "version": ["version_latest", "version_lineage"], "token_rank": ["pass_fail_groups"], "unrelated": ["unrelated_files"], "n": ["morph_candidates"], "hop": ["resolve_candidates"], "comment_lines": ["symbol_sources"], "head": ["body_starts"],
}
_casts: dict[str, list[str]] = {}
for _column, _names in INTEGERS.items():
    for _name in _names:
        _casts.setdefault(_name, []).append(f"{_column}::INTEGER AS {_column}")
for _name, _columns in _casts.items():
    ORACLE[_name] = f"SELECT * REPLACE ({', '.join(_columns)}) FROM ({ORACLE[_name]})"
