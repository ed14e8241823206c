"""The jobs a user calls: build, combine, rebase, shard, analyze, estimate."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.functions.numbers import round_half_even
from haulplan.functions.text import human_bytes
from haulplan.operators import advise, normalize
from haulplan.operators.histogram import DEFAULT_MAX, DEFAULT_MIN, histogram, log_histogram, range_histogram
from haulplan.operators.shards import assign_shards
from haulplan.operators.stats import same_keys, size_stats, size_summary, totals
from haulplan.operators.transfer_time import time_range, time_table
from haulplan.sources import listing, manifests
from haulplan.sources.shard_files import write_shard_metadata, write_shards
from haulplan.staging import stage


def build_manifest(objects: DataFrame, source: str, dest: str, run_id: str | None = None) -> DataFrame:
    """Manifest of a scanned listing (``seq, object``) or of a listing table (``seq, path, size, is_dir, mtime``)."""
    convert = normalize.from_objects if "object" in objects.columns else normalize.from_table
    return convert(objects, source, dest, run_id)


class Combined(NamedTuple):
    manifest: DataFrame
    rejected_parts: DataFrame


def combine_parts(
    spark: SparkSession,
    parts_dir: str,
    source: str,
    dest: str,
    run_id: str | None = None,
    pattern: str = "lsjson-*.json",
    max_bytes: int = listing.MAX_ARRAY_BYTES,
) -> Combined:
    """One manifest of all part files of a folder; parts that cannot be read are reported, not fatal.

    Parts above ``max_bytes`` are read in splits, to the same result.
    """
    parts = listing.read_parts(spark, parts_dir, pattern, max_bytes)
    large = listing.read_large_parts(spark, parts_dir, pattern, max_bytes)
    if large is None:
        return combine_texts(parts, source, dest, run_id)
    good, rejected = listing.split_parts(parts.where("text IS NOT NULL"))
    objects = listing.explode_arrays(good).unionByName(large[0].drop("part_number"))
    return Combined(build_manifest(objects, source, dest, run_id), rejected.union(large[1]))


def combine_texts(parts: DataFrame, source: str, dest: str, run_id: str | None = None, written: bool = False) -> Combined:
    """As :func:`combine_parts` for a table ``part, part_number, prefix, text``; ``written`` stages the parsed parts."""
    good, rejected = listing.split_parts(parts, written)
    return Combined(build_manifest(listing.explode_arrays(good), source, dest, run_id), rejected)


def rebase(manifest: DataFrame, source_root: str | None = None, dest_root: str | None = None) -> DataFrame:
    return normalize.rebase(manifest, source_root, dest_root)


def rebase_file(
    spark: SparkSession, path: str, out: str, source_root: str | None = None, dest_root: str | None = None
) -> None:
    """Rebase a JSON-lines manifest into another one, with all its fields and in its order."""
    rebased = manifests.rebase_objects(listing.read_ndjson(spark, path), source_root, dest_root)
    manifests.in_record_order(rebased).select("value").write.text(out)


def shard_manifest(
    manifest: DataFrame,
    outdir: str,
    num_shards: int,
    strategy: str = "bytes",
    spread_empty: bool = False,
    source: str = "",
    one_file_per_shard: bool = False,
) -> DataFrame:
    """Assign and write shards under ``outdir/shards``, metadata under ``outdir/metadata``."""
    sharded = stage(assign_shards(manifest, num_shards, strategy, spread_empty), "sharded")
    write_shards(sharded, f"{outdir}/shards", num_shards, strategy, one_file_per_shard=one_file_per_shard)
    write_shard_metadata(sharded, f"{outdir}/metadata", num_shards, strategy, source, outdir)
    return sharded


def plan(
    objects: DataFrame, source: str, dest: str, num_shards: int = 256, run_id: str | None = None, strategy: str = "bytes"
) -> DataFrame:
    """Listing to sharded manifest in one go; the manifest is written once in between."""
    manifest = stage(build_manifest(objects, source, dest, run_id), "manifest")
    return assign_shards(manifest, num_shards, strategy)


def analyze(
    sizes: DataFrame,
    group_cols: Sequence[str] = (),
    base_flags: str = advise.BASE_FLAGS,
    cpus_per_task: int = advise.CPUS_PER_TASK,
    array_concurrency: int = advise.ARRAY_CONCURRENCY,
    core_budget: int | None = None,
    max_shard_tib: int = advise.MAX_SHARD_TIB,
) -> DataFrame:
    """Analysis report: one row, or one row per group.

    ``sizes`` is a manifest or any table with ``size``.  The size buckets are
    written once; statistics, profile, shard plan and histogram all read them.
    """
    summary = stage(size_summary(sizes, group_cols), "sizes")
    stats = advise.transfer_profile(size_stats(sizes, group_cols, summary), base_flags)
    planned = advise.shard_plan(stats, cpus_per_task, array_concurrency, core_budget, max_shard_tib)
    bin_fields = ["range_min", "range_max", "range_label", "file_count", "pct_files", "bytes", "bytes_human", "pct_bytes"]
    bins = histogram(sizes, group_cols, summary).groupBy(*group_cols).agg(
        F.expr(f"array_sort(collect_list(struct(bin, {', '.join(bin_fields)}))) AS bins")  # at most 64 bins
    )
    if group_cols:
        report = planned.join(bins, same_keys(planned, bins, group_cols), "left").drop(*[bins[c] for c in group_cols])
    else:
        report = planned.withColumn("bins", bins.scalar())
    texts = report.withColumns({f"{n}_human": human_bytes(n) for n in ("total_bytes", "min_size", "max_size", "median_size")})
    rounded = texts.withColumns({n: round_half_even(n, 1) for n in ("small_files_pct", "medium_files_pct", "large_files_pct")})
    fields = ", ".join(f"b.{name} AS {name}" for name in bin_fields)
    found = {
        "total_files": "total_files",
        "total_bytes": "total_bytes",
        "total_bytes_human": "total_bytes_human",
        "file_size_stats": """struct(min_size, min_size_human, max_size, max_size_human, median_size, median_size_human,
          small_files_pct, medium_files_pct, large_files_pct)""",
        "profile": "profile",
        "profile_explanation": "profile_explanation",
        "suggested_flags": "suggested_flags",
        "suggested_shard_count": "num_shards",
        "shard_count_reasoning": "reasoning",
        "shard_count_assumptions": "assumptions",
        "histogram": f"transform(bins, b -> struct({fields}))",
    }
    described = rounded.selectExpr(
        *group_cols,
        "CASE WHEN total_files > 0 THEN 'ok' ELSE 'error' END AS status",
        "CASE WHEN total_files = 0 THEN 'No files found in manifest' END AS error",
        *[f"CASE WHEN total_files > 0 THEN {value} END AS {name}" for name, value in found.items()],
    )
    return described.withColumn("suggested_flags", F.coalesce("suggested_flags", F.lit(base_flags)))


def report_json(report: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The report as one JSON text per row."""
    fields = [c for c in report.columns if c not in group_cols]
    return report.select(*group_cols, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("report"))


def write_report(report: DataFrame, path: str, group_cols: Sequence[str] = ()) -> None:
    report_json(report, group_cols).write.json(path) if group_cols else report_json(report).coalesce(1).write.text(path)


class Estimate(NamedTuple):
    totals: DataFrame
    times: DataFrame
    ends: DataFrame
    bins: DataFrame | None


def estimate(
    sizes: DataFrame,
    min_rate: str,
    max_rate: str,
    prefer_units: str = "Gbps",
    hist_mode: str | None = "pow2",
    hist_min: int = DEFAULT_MIN,
    hist_max: int = DEFAULT_MAX,
    hist_bins: int = 0,
    group_cols: Sequence[str] = (),
) -> Estimate:
    """Totals, transfer times and size histogram of a listing's sizes (see ``normalize.totals_input``).

    ``hist_mode`` is ``pow2``, ``log`` or None for no histogram.
    """
    if hist_mode not in ("pow2", "log", None):
        raise ValueError(f"hist_mode must be pow2, log or None: {hist_mode!r}")
    summed = totals(sizes, group_cols)
    bins = None
    if hist_mode == "pow2":
        bins = range_histogram(sizes, hist_min, hist_max, group_cols)
    elif hist_mode == "log":
        bins = log_histogram(sizes, hist_min, hist_max, hist_bins, group_cols)
    return Estimate(
        summed.withColumn("bytes_human", human_bytes("bytes_total")),
        time_table(summed, min_rate, max_rate, prefer_units),
        time_range(summed, min_rate, max_rate, prefer_units),
        bins,
    )
