"""Positions and running totals without a global window.

Places come from one range shuffle: rows are written sorted, and a row's place is its
place in the partition behind the counts of the partitions before.  Totals are
summed inside chunks of an ordered integer key and over one row per chunk, so no task ever holds more
than ``2**CHUNK_SHIFT`` rows of a unique key, whatever the key's distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulplan.staging import stage

CHUNK_SHIFT = 20


def total_before(rows: DataFrame, key: str, values: Sequence[str], shift: int = CHUNK_SHIFT) -> DataFrame:
    """Add ``<value>_before``: the sum of each value over all rows with a smaller key.

    ``rows`` has one row per key and is read twice, so it should be a table.
    Works in two levels: inside chunks of the key, and over the chunk totals.
    """
    chunked = rows.withColumn("_chunk", F.shiftright(key, shift))
    chunks = chunked.groupBy("_chunk").agg(*[F.sum(v).alias(f"_{v}_chunk") for v in values])
    ordered_chunks = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("_chunk", *[_sum_or_zero(f"_{v}_chunk", ordered_chunks).alias(f"_{v}_start") for v in values])
    inside = Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(starts, "_chunk")
        .withColumns({f"{v}_before": F.col(f"_{v}_start") + _sum_or_zero(v, inside) for v in values})
        .drop("_chunk", *[f"_{v}_start" for v in values])
    )


def _sum_or_zero(value: str, window: Window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint"))


def record_index(manifest: DataFrame) -> DataFrame:
    """Add ``index``: the dense 0-based position of each record in ``seq`` order.

    One narrow pass counts the records and the different values of ``seq``, by bitmaps of
    2^15 values each.  A ``seq`` without gaps or repeats then only has to be shifted;
    otherwise records are ranked, equal ones by their names, those without ``seq`` last.
    """
    seen = manifest.groupBy(F.bitmap_bucket_number("seq")).agg(
        F.count("*").alias("rows"),
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("seq"))).alias("values"),
    )
    seen = seen.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"), F.sum("values").alias("values")).first()
    if seen.rows and seen.rows == seen["values"] and seen.last - seen.first + 1 == seen.rows:
        return manifest.withColumn("index", F.col("seq") - seen.first)
    return ranked(manifest, record_order(manifest), "index")


def record_order(manifest: DataFrame) -> list[Column]:
    """Record order, with ties told apart by name."""
    return [F.col("seq").asc_nulls_last(), *[F.col(name).asc_nulls_last() for name in ("source", "path") if name in manifest.columns]]


#: ``monotonically_increasing_id`` holds the partition above the row's place in it.
_PLACE_BITS = 33


def ranked(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the dense 0-based place of each row in the order.

    One range shuffle, which samples ``rows``, so they should be a table.  Rows are
    written sorted with their place inside the partition; the partitions' counts, one
    number each, are added up on the driver.  Rows that are equal in the whole order
    share a partition, so the order should end with a key.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    partition = F.shiftright("_id", _PLACE_BITS)
    counts = sorted(placed.groupBy(partition.alias("part")).count().collect())
    starts, before = [], 0
    for part, count in counts:
        starts.append((part, before))
        before += count
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    joined = placed.withColumn("_of", partition).join(starts, F.col("_of") == F.col("_part"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return joined.withColumn(name, place).drop("_of", "_part", "_id", "_start")


def number_within(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its group, also for groups of any size.

    A place in the order of all groups, less the first place of the own group.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = ranked(rows, [*keys, *order], name)
    firsts = placed.groupBy(*group).agg(F.min(name).alias("_first")).withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group])
    joined = placed.join(stage(firsts, "firsts"), same)
    return joined.withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_of_{g}" for g in group])


def largest(manifest: DataFrame, count: int) -> DataFrame:
    """The ``count`` largest records, ties in record order."""
    return manifest.orderBy(F.col("size").desc(), "seq").limit(count)
