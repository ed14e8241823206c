import random

import pytest

from haulplan.operators.stats import QUANTILES, order_statistics, size_stats, size_summary, totals

MIB = 1024**2


def expected(sizes):
    ordered, n = sorted(sizes), len(sizes)
    if n == 0:
        return dict.fromkeys(
            ["total_files", "total_bytes", "min_size", "max_size", "mean_size", "p10_size", "median_size", "p90_size",
             "small_files_pct", "medium_files_pct", "large_files_pct"], 0)
    small = sum(s < MIB for s in sizes)
    large = sum(s > 100 * MIB for s in sizes)
    return {
        "total_files": n, "total_bytes": sum(sizes), "min_size": ordered[0], "max_size": ordered[-1], "mean_size": sum(sizes) / n,
        "p10_size": ordered[int(0.1 * (n - 1))], "median_size": ordered[int(0.5 * (n - 1))], "p90_size": ordered[int(0.9 * (n - 1))],
        "small_files_pct": 100.0 * small / n, "medium_files_pct": 100.0 * (n - small - large) / n, "large_files_pct": 100.0 * large / n,
    }


chance = random.Random(11)
CASES = {
    "none": [],
    "one": [5],
    "two": [9, 4],
    "ten": list(range(10)),
    "eleven": list(range(10, -1, -1)),
    "zeros": [0] * 20,
    "equal": [1024] * 7,
    "bounds": [MIB - 1, MIB, 100 * MIB, 100 * MIB + 1],
    "unknown sizes": [-1, -1, 0, 5, 7],
    "hot size": [4096] * 300 + list(range(1, 500)),
    "wide": [chance.randrange(2 ** chance.randrange(1, 55)) for _ in range(3000)],
    "one bucket": [2**40 + chance.randrange(2**20) for _ in range(1000)],
}


@pytest.mark.parametrize("name", CASES)
def test_size_stats(sizes_of, name):
    assert size_stats(sizes_of(CASES[name])).first().asDict() == pytest.approx(expected(CASES[name]), rel=1e-15)


def test_grouped_equals_one_by_one(spark):
    rows = [(name if name != "zeros" else None, size) for name, sizes in CASES.items() for size in sizes]
    grouped = size_stats(spark.createDataFrame(rows, "name string, size bigint"), ["name"]).collect()
    found = {row.name: {k: v for k, v in row.asDict().items() if k != "name"} for row in grouped}
    assert set(found) == {name if name != "zeros" else None for name, sizes in CASES.items() if sizes}
    for name, stats in found.items():
        assert stats == pytest.approx(expected(CASES[name or "zeros"]), rel=1e-15)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_any_rank_any_partitioning(sizes_of, partitions):
    sizes = CASES["wide"]
    quantiles = {f"q{i}": i / 40 for i in range(41)}
    found = order_statistics(sizes_of(sizes, partitions), quantiles=quantiles).first().asDict()
    assert found == {name: sorted(sizes)[int(q * (len(sizes) - 1))] for name, q in quantiles.items()}


def test_totals(sizes_of, spark):
    assert totals(sizes_of([])).first().asDict() == {"objects": 0, "bytes_total": 0}
    assert totals(sizes_of([3, 4])).first().asDict() == {"objects": 2, "bytes_total": 7}


def test_summary_is_small(sizes_of):
    assert size_summary(sizes_of([2**30 + i for i in range(5000)])).count() == 1


@pytest.mark.parametrize("groups", [0, 1])
def test_many_sizes_in_one_bucket(spark, groups):
    """10 million different sizes of one bucket: rounds of digits, no list of sizes."""
    low, n = 2**44, 10_000_000
    sizes = spark.range(n).selectExpr(f"{low}L + (id * 7919L) % {n}L * 1001L AS size", "'g' AS name")
    assert size_summary(sizes).count() == 1
    quantiles = {"q0": 0.0, "q1": 0.123, "q2": 0.5, "q3": 0.999, "q4": 1.0}
    found = order_statistics(sizes, ["name"][:groups], quantiles).first().asDict()
    assert {name: found[name] for name in quantiles} == {name: low + int(q * (n - 1)) * 1001 for name, q in quantiles.items()}


def test_ranks_of_many_records_of_few_sizes(spark):
    """Ranges that stay large until their last digit."""
    sizes = spark.range(400_000).selectExpr("CASE WHEN id % 4 = 0 THEN 2L * 1099511627776 ELSE 2L * 1099511627776 + 1 + id % 3 END AS size", "id % 2 AS k")
    rows = sorted((r.size, r.k) for r in sizes.collect())
    for key in (0, 1):
        mine = [size for size, k in rows if k == key]
        found = order_statistics(sizes, ["k"]).where(f"k = {key}").first().asDict()
        assert [found[name] for name in QUANTILES] == [mine[int(q * (len(mine) - 1))] for q in QUANTILES.values()]
