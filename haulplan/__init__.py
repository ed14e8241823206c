"""Planning and accounting of large object-store transfers on Spark."""

from haulplan.operators.attempts import pending_work, retry_plan, shard_status
from haulplan.operators.shards import assign_shards, shard_summary
from haulplan.plans.jobs import (
    analyze,
    build_manifest,
    combine_parts,
    estimate,
    plan,
    rebase,
    rebase_file,
    report_json,
    shard_manifest,
    write_report,
)
from haulplan.sources.listing import read_json_arrays, read_listing, read_ndjson, read_parts
from haulplan.sources.manifests import read_manifest, read_sizes, write_manifest

__all__ = [
    "analyze",
    "assign_shards",
    "build_manifest",
    "combine_parts",
    "estimate",
    "pending_work",
    "plan",
    "read_json_arrays",
    "read_listing",
    "read_manifest",
    "read_ndjson",
    "read_parts",
    "read_sizes",
    "rebase",
    "rebase_file",
    "report_json",
    "retry_plan",
    "shard_manifest",
    "shard_status",
    "shard_summary",
    "write_manifest",
    "write_report",
]
