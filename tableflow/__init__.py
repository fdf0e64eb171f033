"""tableflow: Spark-first batch table toolkit.

Every operator takes and returns DataFrames and stays inside Catalyst (no
Python UDFs), so predicate pushdown, column pruning and whole-stage codegen
apply to the whole plan.  Sinks are the only operators that run actions.

Sub-packages:
    sources    readers: JSON files and documents, JDBC, declared schemas
    sinks      writers: CSV (plain, guarded, single file), JSON, partition upsert
    operators  projections, filters, joins, quality checks, reconcile/upsert
    functions  column-expression builders: substitution, URLs, config flattening
    plans      job-level compositions: custom transform, fan-out, export job
"""

from tableflow.functions.config import flatten_placeholders
from tableflow.functions.nested import substitute_nested
from tableflow.functions.text import infix_path, prefix_names, split_list, substitute
from tableflow.functions.url import split_object_url
from tableflow.operators.filters import (
    composite_key_filter,
    filter_by_names,
    keep_unskipped,
    prefix_filter,
    skip_rules,
)
from tableflow.operators.hierarchy import cascade_tree
from tableflow.operators.joins import bridge_join, cascade_chain, cascade_filter, equi_join, lookup_report
from tableflow.operators.project import (
    default_map_field,
    drop_fields,
    drop_nested_fields,
    lift_nested_field,
    rename_fields,
)
from tableflow.operators.quality import (
    expect_predicates,
    expect_row_count,
    keep_last,
    non_empty,
    preview,
    row_count,
    run_gate,
)
from tableflow.operators.reconcile import insert_missing, partition_match, sync_plan, upsert
from tableflow.operators.substitute import substitute_from_table
from tableflow.plans.bridge import bridge_job, bridge_job_from_json
from tableflow.plans.catalog import CatalogSync
from tableflow.plans.export import ExportJob, custom_transform, fan_out
from tableflow.plans.sync import DefinitionSync, apply_plan
from tableflow.session import build_session, cluster_conf, scratch_path, shared_dir
from tableflow.sinks.csv import guarded_csv_export, read_csv, single_file_csv, write_csv
from tableflow.sinks.json import write_json, write_resource_documents
from tableflow.sinks.merge import FileTable
from tableflow.sinks.partitioned import partition_upsert
from tableflow.sinks.staged import publish_csv
from tableflow.sources.jdbc import read_jdbc
from tableflow.sources.json import read_json, read_json_documents
from tableflow.sources.schema import apply_schema
from tableflow.sources.splits import split_predicates, split_report
from tableflow.sources.variant import read_json_fitted

__all__ = [
    "CatalogSync", "DefinitionSync", "ExportJob", "FileTable", "apply_plan", "apply_schema", "bridge_job",
    "bridge_job_from_json", "bridge_join",
    "build_session", "cascade_chain", "cascade_filter", "cascade_tree", "cluster_conf", "composite_key_filter",
    "custom_transform", "default_map_field", "drop_fields", "drop_nested_fields", "equi_join",
    "expect_predicates", "expect_row_count", "fan_out", "filter_by_names", "flatten_placeholders",
    "guarded_csv_export", "infix_path", "insert_missing", "keep_last", "keep_unskipped",
    "lift_nested_field", "lookup_report", "non_empty", "partition_match", "partition_upsert",
    "prefix_filter", "prefix_names", "preview", "publish_csv", "read_csv", "read_jdbc", "read_json", "read_json_fitted",
    "read_json_documents", "rename_fields", "row_count", "run_gate", "scratch_path",
    "shared_dir", "single_file_csv", "skip_rules", "split_list", "split_object_url", "split_predicates", "split_report",
    "substitute", "substitute_from_table", "substitute_nested", "sync_plan", "upsert", "write_csv", "write_json",
    "write_resource_documents",
]
