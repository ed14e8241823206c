"""Shard folders: one sub-folder per shard, plus metadata."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from haulplan.operators.shards import shard_order, shard_summary
from haulplan.schema import SHARDS_SCHEMA
from haulplan.staging import stage


def write_shards(
    sharded: DataFrame,
    outdir: str,
    num_shards: int,
    strategy: str = "bytes",
    file_format: str = "json",
    partitions: int | None = None,
    one_file_per_shard: bool = False,
) -> None:
    """Write ``outdir/shard_id=<k>/`` with the records in shard order.

    Records are range-partitioned by shard and place, so a shard that holds a
    large part of all records is written by several tasks; its files in name
    order give the shard order.  Shards without records then have no folder; they
    are in the summary.  ``one_file_per_shard`` sends each shard to one task
    instead, for copiers that open a shard by its number; as JSON, a shard without
    records is an empty file.
    """
    order = ["shard_id", *shard_order(strategy)]
    if one_file_per_shard:
        spread = sharded.repartitionById(num_shards, "shard_id")
    elif partitions:
        spread = sharded.repartitionByRange(partitions, *order)
    else:
        spread = sharded.repartitionByRange(*order)
    writer = spread.sortWithinPartitions(*order).write.partitionBy("shard_id")
    if file_format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(file_format).save(outdir)
    if one_file_per_shard and file_format == "json":
        _add_empty_files(sharded, outdir, num_shards)
    if file_format == "parquet":
        write_shard_index(sharded.sparkSession, outdir, sharded.schema)


def _add_empty_files(sharded: DataFrame, outdir: str, num_shards: int) -> None:
    """An empty file for every shard number without records."""
    used = {row.shard_id for row in sharded.select("shard_id").distinct().collect()}  # at most num_shards numbers
    spark = sharded.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(outdir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in range(num_shards):
        if shard not in used:
            files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{outdir}/shard_id={shard}/part-00000.json")).close()


def read_shards(spark: SparkSession, outdir: str, schema, file_format: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(file_format).load(outdir)


#: Folder of the segment list inside a parquet shard folder; scans skip names that begin so.
INDEX = "_index"


def write_shard_index(spark: SparkSession, outdir: str, schema: StructType) -> None:
    """Write the segment list of a parquet shard folder: ``shard_id, file, first_pos, rows``.

    A segment is a file; files of a shard in name order hold the shard order.  Rows are counted from the
    file footers, so no column is read.
    """
    files = read_shards(spark, outdir, schema, "parquet").groupBy("shard_id", F.col("_metadata.file_name").alias("file"))
    segments = files.agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # files of one shard
    first = F.coalesce(F.sum("rows").over(before), F.lit(0).cast("bigint"))
    segments.withColumn("first_pos", first).coalesce(1).write.mode("overwrite").parquet(f"{outdir}/{INDEX}")


def read_shard_index(spark: SparkSession, outdir: str) -> DataFrame:
    return spark.read.schema("shard_id int, file string, rows bigint, first_pos bigint").parquet(f"{outdir}/{INDEX}")


def read_shard(spark: SparkSession, outdir: str, schema: StructType, shard: int) -> DataFrame:
    """Records of one shard of a parquet shard folder with ``shard_pos``, their place in the shard.

    Only the shard's folder is read, and nothing is shuffled: a place is the row's number in its file
    behind the first place of the file.  A shard without records gives no rows.
    """
    segments = read_shard_index(spark, outdir).where(F.col("shard_id") == shard).select("file", "first_pos")
    rows = read_shards(spark, outdir, schema, "parquet").where(F.col("shard_id") == shard)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = rows.join(segments, F.col("_file") == F.col("file"))  # the list's true size decides about a broadcast
    return placed.withColumn("shard_pos", F.col("first_pos") + F.col("_row")).drop("_file", "file", "_row", "first_pos")


def read_pending(spark: SparkSession, outdir: str, schema: StructType, status: DataFrame, file_format: str = "json") -> DataFrame:
    """Records of a shard folder whose shard is not done; ``status`` names every shard (see ``shard_status``).

    The states are written, one short row per shard.  As the records are partitioned by shard, the scan is
    pruned at run time to the folders of unfinished shards.
    """
    states = stage(status.select(F.col("shard_id").cast("int").alias("shard_id"), "status"), "states")
    return read_shards(spark, outdir, schema, file_format).join(states.where("status <> 'done'"), "shard_id", "left_semi")


def shard_metadata(summary: DataFrame, num_shards: int, strategy: str, source: str = "", outdir: str = "") -> DataFrame:
    """One row about the whole shard folder; ``summary`` has one row per shard."""
    created = datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None).isoformat() + "Z"
    return summary.agg(F.sum("files").alias("num_records"), F.sum("bytes").alias("bytes_total")).select(
        F.lit(SHARDS_SCHEMA).alias("schema"),
        F.lit(source).alias("input"),
        F.lit(outdir).alias("outdir"),
        F.lit(num_shards).cast("bigint").alias("num_shards"),
        F.lit(strategy).alias("strategy"),
        "num_records",
        "bytes_total",
        F.lit(created).alias("created_at"),
    )


def write_shard_metadata(sharded: DataFrame, metadir: str, num_shards: int, strategy: str, source: str = "", outdir: str = "") -> None:
    """Write ``metadir/summary`` (one row per shard) and ``metadir/meta`` (one row)."""
    summary = shard_summary(sharded, num_shards)
    summary.coalesce(1).write.json(f"{metadir}/summary")
    shard_metadata(summary, num_shards, strategy, source, outdir).coalesce(1).write.json(f"{metadir}/meta")
