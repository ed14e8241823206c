"""Copier settings and shard counts, derived from size statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulplan.functions.text import human_bytes
from haulplan.operators.stats import LARGE_ABOVE, SMALL_BELOW
from haulplan.schema import TIB

# Copier options per profile, and the options every copy gets.
PROFILE_FLAGS = {
    "empty": "--transfers 32 --checkers 64 --fast-list",
    "small_files": "--transfers 64 --checkers 128 --fast-list",
    "large_files": "--transfers 16 --checkers 32 --buffer-size 256M",
    "mixed": "--transfers 32 --checkers 64 --fast-list",
}
BASE_FLAGS = "--retries 10 --low-level-retries 20 --stats 600s --progress"

# Assumptions of the shard plan.
CPUS_PER_TASK = 4
ARRAY_CONCURRENCY = 64
MAX_SHARD_TIB = 10
SHARDS_PER_SLOT = 4


# Rules of the profiles and their explanations; the first match counts.
PROFILE_RULES = {
    "empty": ("total_files = 0", "'No files to analyze, using default settings'"),
    "small_files": (
        f"small_files_pct > 70 OR median_size < {SMALL_BELOW}",
        "concat('Optimized for small files (', cast(rint(small_files_pct) AS int), '% < 1MB, median ', median_text, ')')",
    ),
    "large_files": (
        f"large_files_pct > 50 OR median_size > {LARGE_ABOVE}",
        "concat('Optimized for large files (', cast(rint(large_files_pct) AS int), '% > 100MB, median ', median_text, ')')",
    ),
    "mixed": ("true", "concat('Balanced settings for mixed file sizes (median ', median_text, ')')"),
}


def _case(results: dict[str, str], subject: str = "") -> Column:
    return F.expr(f"CASE {subject} " + " ".join(f"WHEN {when} THEN {then}" for when, then in results.items()) + " END")


def transfer_profile(stats: DataFrame, base_flags: str = BASE_FLAGS) -> DataFrame:
    """Add ``profile, profile_flags, profile_explanation, suggested_flags`` to size statistics."""
    profiled = stats.withColumns(
        {
            "median_text": human_bytes("median_size"),
            "profile": _case({rule: f"'{name}'" for name, (rule, _) in PROFILE_RULES.items()}),
        }
    )
    return profiled.withColumns(
        {
            "profile_flags": _case({f"'{name}'": f"'{flags}'" for name, flags in PROFILE_FLAGS.items()}, "profile"),
            "profile_explanation": _case({f"'{name}'": text for name, (_, text) in PROFILE_RULES.items()}, "profile"),
        }
    ).select(
        "*", F.concat("profile_flags", F.lit(" " + base_flags)).alias("suggested_flags")
    ).drop("median_text")


def shard_plan(
    totals: DataFrame,
    cpus_per_task: str | int = CPUS_PER_TASK,
    array_concurrency: str | int = ARRAY_CONCURRENCY,
    core_budget: str | int | None = None,
    max_shard_tib: str | int = MAX_SHARD_TIB,
) -> DataFrame:
    """Add the suggested shard count, its reasoning and its assumptions to rows with ``total_bytes``.

    Settings are numbers or column names.  One shard is enough below the byte
    cap; above it the count follows the bytes, limited by four shards per
    concurrent task and, when a core budget is known, by the tasks that fit into
    it.
    """
    assumed = totals.selectExpr(
        "*",
        f"""struct(total_bytes, cast({cpus_per_task} AS bigint) AS cpus_per_task,
          cast({array_concurrency} AS bigint) AS array_concurrency,
          cast({'NULL' if core_budget is None else core_budget} AS bigint) AS core_budget,
          cast({max_shard_tib} AS bigint) AS max_shard_bytes_tb) AS assumptions""",
    )
    limits = assumed.selectExpr(
        "*",
        f"assumptions.max_shard_bytes_tb * {TIB}L AS _cap",
        f"assumptions.array_concurrency * {SHARDS_PER_SLOT} AS _by_concurrency",
        "greatest(1L, assumptions.core_budget div assumptions.cpus_per_task) AS _cores",
    ).selectExpr(
        "*",
        "(total_bytes + _cap - 1) div _cap AS _by_bytes",
        "CASE WHEN assumptions.core_budget IS NOT NULL THEN _cores END AS _by_cores",
    )
    chosen = limits.selectExpr("*", "least(_by_concurrency, _by_cores) AS _upper").selectExpr(  # least() passes over null
        "*", "CASE WHEN total_bytes < _cap THEN 1L ELSE greatest(1L, least(_upper, _by_bytes)) END AS num_shards"
    )
    reasoned = chosen.withColumn("_total", human_bytes("total_bytes")).selectExpr(
        "*",
        """CASE WHEN total_bytes < _cap THEN concat('total_bytes (', _total, ') is below the per-shard cap (',
            assumptions.max_shard_bytes_tb, ' TiB); a single shard is sufficient.')
          ELSE concat_ws('; ',
            concat('shards_by_bytes=', _by_bytes, ' (total ', _total, ' / ', assumptions.max_shard_bytes_tb, ' TiB cap)'),
            concat('shards_by_concurrency=', _by_concurrency, ' (4 x ', assumptions.array_concurrency, ')'),
            concat('shards_by_cores=', _by_cores, ' (', assumptions.core_budget, ' cores / ',
              assumptions.cpus_per_task, ' cpus_per_task)'),
            concat('chose max(1, min(upper=', _upper, ', shards_by_bytes)) = ', num_shards)) END AS reasoning""",
    )
    return reasoned.drop("_cap", "_cores", "_by_bytes", "_by_concurrency", "_by_cores", "_upper", "_total")
