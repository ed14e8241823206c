"""Assignment of manifest records to shards: by count, by key hash, by bytes.

By bytes means largest first, each record to the shard that is lightest so far.  That
is sequential over records but not over sizes: a vector of loads is carried down the
size classes on the driver (at most 256 a power of two, counts and bytes of each), every
class is poured onto the lightest shards by water level, and a record finds its shard
from its rank inside the class.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulplan.functions.numbers import coarse_size
from haulplan.operators.ordering import number_within, ranked, record_index, record_order

STRATEGIES = ("bytes", "count", "hash")

#: Size classes of the byte balance: 2**8 for each power of two.
CLASS_BITS = 8
_SEGMENT = pa.struct([("start", pa.int64()), ("cycle", pa.list_(pa.int32()))])
_SEGMENTS = pa.schema([("_of", pa.int64()), ("_first", pa.int64()), ("_segments", pa.list_(_SEGMENT))])


def check_shards(num_shards: int, strategy: str = "bytes") -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}: {strategy!r}")
    if num_shards < 1:
        raise ValueError(f"number of shards must be at least 1: {num_shards}")


def assign_shards(
    manifest: DataFrame,
    num_shards: int,
    strategy: str = "bytes",
    spread_empty: bool = False,
) -> DataFrame:
    """Add ``shard_id``.  An empty manifest is an error.

    ``bytes`` reads the manifest several times, so it should be a table and not
    a raw scan.
    """
    check_shards(num_shards, strategy)
    if manifest.isEmpty():
        raise ValueError("the manifest has no records")
    if strategy == "count":
        return shard_by_count(manifest, num_shards)
    if strategy == "hash":
        return shard_by_hash(manifest, num_shards)
    return shard_by_bytes(manifest, num_shards, spread_empty)


def shard_by_count(manifest: DataFrame, num_shards: int) -> DataFrame:
    """Deal records round robin in record order."""
    indexed = record_index(manifest)
    return indexed.withColumn("shard_id", (F.col("index") % num_shards).cast("int")).drop("index")


def sha1_modulo(key: Column, divisor: int) -> Column:
    """SHA-1 of the UTF-8 text, read as one big number, modulo ``divisor``.

    The 160 bits are folded in five 32-bit words, which stays within BIGINT.
    """
    digest = F.sha1(F.encode(key, "UTF-8"))
    rest = F.lit(0).cast("bigint")
    for word in range(5):
        value = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("bigint")
        rest = (rest * 2**32 + value) % divisor
    return rest


def shard_by_hash(manifest: DataFrame, num_shards: int) -> DataFrame:
    """Shard from the hash of ``source``, else ``path``, else the record's position."""
    key = F.coalesce(F.nullif("source", F.lit("")), F.nullif("path", F.lit("")))
    keyless = "(source IS NULL OR source = '') AND (path IS NULL OR path = '')"  # answered by file statistics
    if not manifest.where(keyless).isEmpty():
        manifest = record_index(manifest)
        key = F.coalesce(key, F.col("index").cast("string"))
    return manifest.withColumn("shard_id", sha1_modulo(key, num_shards).cast("int")).drop("index")


def pour(classes: Iterable[tuple[int, int, int]], num_shards: int) -> tuple[list[tuple], np.ndarray]:
    """Spread size classes, largest first, over shards: rows ``bucket, first, segments`` and the loads.

    A class is ``bucket, records, bytes``; its records count as equally large, ``size``.  Dealing them one by one to the lightest
    shard (the first of equals) fills the loads like water: cut into levels of ``size`` bytes, a
    shard takes part from the level of its load on, and within a level shards take
    turns by what they hold beyond it.  So the turns of a class are a few segments, each
    a start rank and a cycle of shards.
    """
    loads, numbers = np.zeros(num_shards, np.int64), np.arange(num_shards)
    out, first = [], 0
    for bucket, count, total in classes:
        size = max(1, total // count)
        if count == 1:
            lightest = int(loads.argmin())
            loads[lightest] += size
            out.append((bucket, first, [(0, [lightest])]))
            first += 1
            continue
        levels, beyond = np.divmod(loads, size)
        turns = np.lexsort((numbers, beyond))
        steps = np.unique(levels)
        segments, start = [], 0
        for level, following in zip(steps.tolist(), [*steps[1:].tolist(), None]):
            cycle = turns[levels[turns] <= level]
            left = count - start
            taken = left if following is None else min(left, len(cycle) * (following - level))
            segments.append((start, cycle[:taken].tolist()))
            loads[cycle] += size * (taken // len(cycle) + (np.arange(len(cycle)) < taken % len(cycle)))
            start += taken
            if start == count:
                break
        out.append((bucket, first, segments))
        first += count
    return out, loads


def shard_by_bytes(manifest: DataFrame, num_shards: int, spread_empty: bool = False) -> DataFrame:
    """Balance bytes over shards: largest first, each to the lightest shard.

    Sizes of one class, at most a 256th apart, count as their mean when loads are compared.
    Records without bytes all go to the lightest shard, the first of equals, or are
    dealt by ``seq`` with ``spread_empty``.
    """
    spark = manifest.sparkSession
    full = manifest.where(F.col("size") > 0).withColumn("_bucket", coarse_size("size", CLASS_BITS))
    classes = full.groupBy("_bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()  # at most 256 for a power of two
    segments, loads = pour(sorted(((c["_bucket"], c.rows, c["bytes"]) for c in classes), reverse=True), num_shards)
    table = pa.table(
        {"_of": [s[0] for s in segments], "_first": [s[1] for s in segments], "_segments": [[{"start": a, "cycle": c} for a, c in s[2]] for s in segments]},
        schema=_SEGMENTS,
    )
    placed = ranked(full, [F.col("size").desc(), *record_order(manifest)], "_rank")
    joined = placed.join(spark.createDataFrame(table), F.col("_bucket") == F.col("_of")).withColumn("_rank", F.col("_rank") - F.col("_first"))
    own = F.element_at(F.filter("_segments", lambda s: s["start"] <= F.col("_rank")), -1)
    turn = F.get(own["cycle"], ((F.col("_rank") - own["start"]) % F.size(own["cycle"])).cast("int"))
    placed = joined.withColumn("shard_id", turn).drop("_bucket", "_rank", "_of", "_first", "_segments")
    empty = manifest.where(F.col("size").isNull() | (F.col("size") <= 0))
    of_empty = F.pmod("seq", F.lit(num_shards)) if spread_empty else F.lit(int(loads.argmin()))
    return placed.unionByName(empty.withColumn("shard_id", F.coalesce(of_empty, F.lit(0)).cast("int")))


def shard_summary(sharded: DataFrame, num_shards: int) -> DataFrame:
    """Files and bytes of every shard, shards without records included."""
    found = sharded.groupBy(F.col("shard_id").alias("found")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    shards = sharded.sparkSession.range(num_shards).select(F.col("id").cast("int").alias("shard_id"))
    none = F.lit(0).cast("bigint")
    return shards.join(found, F.col("shard_id") == F.col("found"), "left").select(
        "shard_id", F.coalesce("files", none).alias("files"), F.coalesce("bytes", none).alias("bytes")
    )


def shard_order(strategy: str) -> list[Column]:
    """Order of the records inside a shard: by size for ``bytes``, else as listed."""
    return [F.col("size").desc(), F.col("seq")] if strategy == "bytes" else [F.col("seq")]


def shard_positions(sharded: DataFrame, strategy: str = "bytes") -> DataFrame:
    """Add ``shard_pos``, the 0-based place of a record in its shard.

    A shard may hold any number of records, also of one size.
    """
    by_size = [F.col("size").desc()] if strategy == "bytes" else []
    return number_within(sharded, ["shard_id"], [*by_size, *record_order(sharded)], "shard_pos")


def work_list(sharded: DataFrame, shard_id: int) -> DataFrame:
    """Relative paths of one shard, for the copier's include list."""
    return sharded.where(F.col("shard_id") == shard_id).select("path")
