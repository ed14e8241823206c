import json

import pytest

from haulplan.operators.advise import BASE_FLAGS, shard_plan, transfer_profile
from haulplan.operators.stats import size_stats
from haulplan.plans.jobs import analyze, report_json

TIB = 1024**4
MIB = 1024**2

# case: total bytes, settings, shards, part of the reasoning
PLAN_CASES = {
    "below_cap": (5 * TIB, {}, 1, "below the per-shard cap"),
    "zero": (0, {}, 1, "a single shard is sufficient"),
    "by_bytes": (100 * TIB, {}, 10, "shards_by_bytes=10"),
    "cores_equal": (100 * TIB, {"core_budget": 40, "cpus_per_task": 4}, 10, "shards_by_cores=10"),
    "cores_cap": (500 * TIB, {"core_budget": 16, "cpus_per_task": 4}, 4, "upper=4"),
    "concurrency_cap": (500 * TIB, {"array_concurrency": 8}, 32, "shards_by_concurrency=32 (4 x 8)"),
    "custom_cap": (5 * TIB, {"max_shard_tib": 1}, 5, "/ 1 TiB cap"),
    "at_cap": (10 * TIB, {}, 1, "shards_by_bytes=1"),
    "just_above": (10 * TIB + 1, {}, 2, "shards_by_bytes=2"),
    "few_cores": (500 * TIB, {"core_budget": 2}, 1, "shards_by_cores=1"),
    "echo": (100 * TIB, {"cpus_per_task": 8, "array_concurrency": 32, "core_budget": 200, "max_shard_tib": 20}, 5, ""),
}


@pytest.mark.parametrize("name", PLAN_CASES)
def test_shard_plan(spark, name):
    total, settings, shards, reasoning = PLAN_CASES[name]
    row = shard_plan(spark.createDataFrame([(total,)], "total_bytes bigint"), **settings).first()
    assert row.num_shards == shards and reasoning in row.reasoning
    assert row.assumptions.asDict() == {
        "total_bytes": total,
        "cpus_per_task": settings.get("cpus_per_task", 4),
        "array_concurrency": settings.get("array_concurrency", 64),
        "core_budget": settings.get("core_budget"),
        "max_shard_bytes_tb": settings.get("max_shard_tib", 10),
    }


def test_shard_plan_full_reasoning(spark):
    row = shard_plan(spark.createDataFrame([(100 * TIB,)], "total_bytes bigint"), core_budget=40).first()
    assert row.reasoning == (
        "shards_by_bytes=10 (total 100.00 TiB / 10 TiB cap); shards_by_concurrency=256 (4 x 64); "
        "shards_by_cores=10 (40 cores / 4 cpus_per_task); chose max(1, min(upper=10, shards_by_bytes)) = 10"
    )


PROFILES = {
    "empty": ([], "No files to analyze, using default settings"),
    "small_files": ([10] * 8 + [200 * MIB] * 2, "Optimized for small files (80% < 1MB, median 10 B)"),
    "large_files": ([5 * MIB] * 3 + [200 * MIB] * 7, "Optimized for large files (70% > 100MB, median 200.00 MiB)"),
    "mixed": ([5 * MIB] * 6 + [200 * MIB] * 4, "Balanced settings for mixed file sizes (median 5.00 MiB)"),
}


@pytest.mark.parametrize("name", PROFILES)
def test_profiles(sizes_of, name):
    sizes, explanation = PROFILES[name]
    row = transfer_profile(size_stats(sizes_of(sizes))).first()
    assert row.profile == name and row.profile_explanation == explanation
    assert row.suggested_flags == f"{row.profile_flags} {BASE_FLAGS}"


def test_profile_bounds_are_strict(sizes_of):
    exactly_70 = [10] * 7 + [5 * MIB] * 3
    assert transfer_profile(size_stats(sizes_of(sorted(exactly_70)))).first().profile == "small_files"  # by its median
    half_large = [5 * MIB] * 5 + [200 * MIB] * 5
    assert transfer_profile(size_stats(sizes_of(half_large))).first().profile == "mixed"


def test_report_document(sizes_of):
    report = json.loads(report_json(analyze(sizes_of([1, 1024, 3 * MIB, 3 * MIB + 5]))).first().report)
    assert report["status"] == "ok" and report["error"] is None
    assert report["total_files"] == 4 and report["total_bytes_human"] == "6.00 MiB"
    assert report["file_size_stats"]["median_size_human"] == "1.00 KiB"
    assert report["shard_count_assumptions"]["core_budget"] is None
    assert len(report["histogram"]) == 22 and report["histogram"][0]["range_label"] == "1 B - 2 B"
    assert sum(b["file_count"] for b in report["histogram"]) == 4


def test_report_of_nothing(sizes_of):
    row = analyze(sizes_of([]), base_flags="--x").first()
    assert (row.status, row.error, row.suggested_flags) == ("error", "No files found in manifest", "--x")
    assert row.histogram is None and row.total_files is None


def test_report_per_group(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 9), (None, 2 * MIB)], "name string, size bigint")
    found = {r.name: (r.total_files, r.profile, len(r.histogram)) for r in analyze(rows, ["name"]).collect()}
    assert found == {"a": (2, "small_files", 2), None: (1, "mixed", 1)}
