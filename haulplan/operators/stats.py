"""Totals, size statistics and exact order statistics, for all records or per group.

One pass folds the sizes into ordered buckets that are 1/1024 of a power of two
wide (:func:`size_summary`).  Totals, shares, extremes and histograms come from
that small table.  An exact percentile then needs one more narrow pass over the
few buckets that hold a wanted rank, and further ones only where such a bucket holds many records.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulplan.functions.numbers import coarse_size
from haulplan.functions.text import percent
from haulplan.schema import MIB
from haulplan.staging import stage

# Bounds of the size classes; both bounds belong to "medium".
SMALL_BELOW = 1 * MIB
LARGE_ABOVE = 100 * MIB

# Reported percentiles.
QUANTILES = {"p10_size": 0.1, "median_size": 0.5, "p90_size": 0.9}

#: Bits of a size that one round of a selection settles, and records below which a range is settled at once.
DIGIT_BITS = 12
FEW = 1 << 16

#: Tasks over which the records of one group and bucket are spread.
SALTS = 16


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns (a group may be null)."""
    return reduce(lambda a, b: a & b, [left[key].eqNullSafe(right[key]) for key in keys])


def totals(sizes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Number of objects and sum of bytes."""
    return sizes.groupBy(*group_cols).agg(
        F.count("size").alias("objects"), F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("bytes_total")
    )


def size_summary(sizes: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per group and size bucket: counts, bytes, extremes and size classes.

    The table is bounded per group (1,024 rows per power of two) and built with
    map-side partial sums, so a group or size that holds most rows is no hot spot.
    A missing size counts as 0.
    """
    sizes = sizes.withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    return sizes.groupBy(*group_cols, coarse_size("size").alias("_bucket")).agg(
        F.expr("count(*) AS _files"),
        F.expr("sum(size) AS _bytes"),
        F.expr("min(size) AS _smallest"),
        F.expr("max(size) AS _biggest"),
        F.expr(f"count_if(size < {SMALL_BELOW}) AS _small"),
        F.expr(f"count_if(size > {LARGE_ABOVE}) AS _large"),
    )


def held(rows: DataFrame, group_cols: Sequence[str], label: str) -> DataFrame:
    """Rows that are used several times: written if there are groups, else (a few rows) kept in the plan."""
    if group_cols:
        return stage(rows, label)
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def rows_in_buckets(sizes: DataFrame, group_cols: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``group_cols, _bucket, size`` of the records in wanted buckets, with the other columns of ``wanted``.

    ``wanted`` may name a bucket several times.  Records of buckets that no group wants are left out
    before any join with groups, and a group that holds most records is spread over ``SALTS`` tasks.
    """
    known = sizes.select(*group_cols, F.coalesce("size", F.lit(0).cast("bigint")).alias("size"))
    known = known.withColumn("_bucket", coarse_size("size"))
    if not group_cols:
        return known.join(F.broadcast(wanted), "_bucket")  # a few rows, see held
    near = known.join(F.broadcast(wanted.select("_bucket").distinct()), "_bucket", "left_semi")  # at most 2^16 buckets
    keys = [*group_cols, "_bucket"]
    others = [name for name in wanted.columns if name not in keys]
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    wanted = wanted.withColumnsRenamed({key: f"_of_{key}" for key in keys}).withColumn("_of_salt", salts)
    rows = near.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return rows.join(wanted, reduce(and_, [*same, F.col("_salt") == F.col("_of_salt")])).select(*keys, "size", *others)


def _wanted_ranks(summary: DataFrame, group_cols: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Bucket of each quantile, the rank left inside it, its smallest size, the bits of its range, its records."""
    group = Window.partitionBy(*group_cols)
    upto = F.sum("_files").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = summary.withColumns({"_upto": upto, "_n": F.sum("_files").over(group)})
    ranks = ", ".join(f"struct('{name}' AS _name, floor({q!r}D * (_n - 1)) AS _rank)" for name, q in quantiles.items())
    return (
        ranked.withColumn("_wanted", F.expr(f"explode(array({ranks}))"))
        .where("_wanted._rank >= _upto - _files AND _wanted._rank < _upto")
        .selectExpr(
            *group_cols,
            "_bucket",
            "_wanted._name AS _name",
            "_wanted._rank - (_upto - _files) AS _rank",
            "_smallest AS _low",
            "CASE WHEN _biggest = _smallest THEN 0 ELSE length(bin(_biggest - _smallest)) END AS _width",
            "_files",
        )
    )


def _next_digit(sizes: DataFrame, group_cols: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` with each open range narrowed by one digit of the sizes counted above its lower end.

    A digit has ``DIGIT_BITS`` bits, or all that are left where the range holds few records, so a
    range never has more than ``2**DIGIT_BITS`` or ``FEW`` counts.
    """
    key = [*group_cols, "_bucket", "_low"]
    shift = f"CASE WHEN _files <= {FEW} THEN 0 ELSE greatest(_width - {DIGIT_BITS}, 0) END"
    unsettled = wanted.where("_width > 0").withColumn("_shift", F.expr(shift))
    ranges = unsettled.select(*key, "_width", "_shift").distinct()
    inside = rows_in_buckets(sizes, group_cols, ranges).where("size >= _low AND shiftright(size - _low, _width) = 0")
    digits = inside.groupBy(*key, F.expr("shiftright(size - _low, _shift) AS _digit")).agg(F.count("*").alias("_count"))
    upto = F.sum("_count").over(Window.partitionBy(*key).orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
    digits = digits.withColumn("_upto", upto).withColumnsRenamed({name: f"_of{name}" for name in key})
    same = [F.col(name).eqNullSafe(F.col(f"_of{name}")) for name in key]
    found = unsettled.join(digits, reduce(and_, same) & (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_count")))
    narrowed = found.selectExpr(
        *group_cols,
        "_bucket",
        "_name",
        "_rank - (_upto - _count) AS _rank",
        "_low + shiftleft(_digit, _shift) AS _low",
        "_shift AS _width",
        "_count AS _files",
    )
    return wanted.where("_width = 0").unionByName(narrowed)


def order_statistics(
    sizes: DataFrame,
    group_cols: Sequence[str] = (),
    quantiles: dict[str, float] = QUANTILES,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Exact elements at index ``floor(q * (n - 1))`` of the sorted sizes, one column per quantile.

    Radix selection: the bucket that holds a rank is narrowed digit by digit on counts, for all
    quantiles and groups in one job a round.  Buckets with one size need no round, those
    with few records one, and the widest possible (2^53 sizes) five.
    """
    summary = size_summary(sizes, group_cols) if summary is None else summary
    wanted = held(_wanted_ranks(summary, group_cols, quantiles), group_cols, "ranks")
    while not wanted.where("_width > 0").isEmpty():
        wanted = held(_next_digit(sizes, group_cols, wanted), group_cols, "ranks")
    return wanted.groupBy(*group_cols).agg(*[F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in quantiles])


def size_stats(sizes: DataFrame, group_cols: Sequence[str] = (), summary: DataFrame | None = None) -> DataFrame:
    """Count, bytes, extremes, mean, p10 / median / p90 and size-class shares.

    Without groups there is always one row, all zeros for an empty input.  The
    bucket table is written once, so the sizes are read twice in all.
    """
    summary = stage(size_summary(sizes, group_cols), "sizes") if summary is None else summary
    ranks = order_statistics(sizes, group_cols, summary=summary)
    both = summary.unionByName(ranks, allowMissingColumns=True)
    sums = both.groupBy(*group_cols).agg(
        F.expr("coalesce(sum(_files), 0L) AS total_files"),
        F.expr("coalesce(sum(_bytes), 0L) AS total_bytes"),
        F.expr("coalesce(min(_smallest), 0L) AS min_size"),
        F.expr("coalesce(max(_biggest), 0L) AS max_size"),
        *[F.expr(f"coalesce(max({name}), 0L) AS {name}") for name in QUANTILES],
        F.expr("coalesce(sum(_small), 0L) AS _small_files"),
        F.expr("coalesce(sum(_large), 0L) AS _large_files"),
    )
    return sums.select(
        *group_cols,
        "total_files",
        "total_bytes",
        "min_size",
        "max_size",
        F.expr("CASE WHEN total_files > 0 THEN total_bytes / total_files ELSE 0D END AS mean_size"),
        *QUANTILES,
        percent("_small_files", "total_files").alias("small_files_pct"),
        percent("total_files - _small_files - _large_files", "total_files").alias("medium_files_pct"),
        percent("_large_files", "total_files").alias("large_files_pct"),
    )
