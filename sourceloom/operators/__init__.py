"""Relational and graph operators: DataFrames in, DataFrames out.

What bears the name of its module (`symbols`, `fingerprints`) is imported from there.
"""

from sourceloom.operators.calls import call_edges, calls_by_caller, is_meaningful
from sourceloom.operators.changes import changed_paths, compare_snapshots, merge_snapshot, removed_paths, run_counters, update_plan
from sourceloom.operators.components import component_edges, layer_breakdown, layer_members
from sourceloom.operators.dependencies import dependencies_of, dependency_edges, dependents_of, fan, package_edges
from sourceloom.operators.external import external_roots, external_systems
from sourceloom.operators.fingerprints import regeneration
from sourceloom.operators.flows import build_flows, entry_points
from sourceloom.operators.symbols import package_counts, public_api, unique_names

__all__ = [
    "build_flows", "call_edges", "calls_by_caller", "changed_paths", "compare_snapshots", "component_edges", "dependencies_of",
    "dependency_edges", "dependents_of", "entry_points", "external_roots", "external_systems", "fan", "is_meaningful",
    "layer_breakdown", "layer_members", "merge_snapshot", "package_counts", "package_edges", "public_api", "regeneration", "removed_paths",
    "run_counters", "unique_names", "update_plan",
]
