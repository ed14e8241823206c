"""The registered queries, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import DEST, RUN_ID, SOURCE
from haulplan.functions.rates import bytes_per_second
from haulplan.functions.text import human_bytes, human_rate, human_seconds
from haulplan.operators import advise, attempts, histogram, normalize, ordering, progress, shards, stats, transfer_time
from haulplan.plans import jobs
from haulplan.schema import MANIFEST, TIB
from haulplan.sources import listing, manifests, shard_files
from haulplan.staging import staging_path
from haulplan.streaming import jobs as live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- Sources ---------------------------------------------------------------


def _record_columns(manifest: DataFrame) -> DataFrame:
    """Manifest with its maps flattened to plain columns."""
    return manifest.withColumns(
        {
            "md5": F.col("hashes")["md5"],
            "hash_count": F.size("hashes"),
            "priority": F.col("meta")["priority"],
            "copies": F.col("meta")["copies"],
        }
    ).drop("hashes", "meta", "seq")


@query
def s1_json_arrays(spark, sf_dir):
    objects = listing.read_json_arrays(spark, inputs.written_arrays(spark, sf_dir))
    manifest = jobs.build_manifest(objects, SOURCE, DEST, RUN_ID)
    return ordering.record_index(manifest).select("index", "path", "size", "source")


@query
def s1_arrays_in_splits(spark, sf_dir):
    """The same arrays through the block automaton, which large files take."""
    objects = listing.read_json_arrays(spark, inputs.written_arrays(spark, sf_dir), max_bytes=0)
    manifest = jobs.build_manifest(objects, SOURCE, DEST, RUN_ID)
    return ordering.record_index(manifest).select("index", "path", "size", "source")


@query
def s4_part_files(spark, sf_dir):
    """Part files with sidecars and damaged parts, as a folder."""
    combined = jobs.combine_parts(spark, inputs.written_parts(spark, sf_dir), SOURCE, DEST, RUN_ID)
    return ordering.record_index(combined.manifest).select("index", "path", "size", "source", "dest")


@query
def s2_ndjson(spark, sf_dir):
    objects = listing.read_ndjson(spark, inputs.written_lines(inputs.order_lines(spark, sf_dir)))
    return _record_columns(ordering.record_index(jobs.build_manifest(objects, SOURCE, DEST, RUN_ID)))


@query
def s3_detected_form(spark, sf_dir):
    paths = [inputs.written_arrays(spark, sf_dir), inputs.written_lines(inputs.order_lines(spark, sf_dir))]
    return stats.totals(normalize.totals_input(listing.read_listing(spark, paths, ordered=False)))


@query
def s4_combine_parts(spark, sf_dir):
    combined = jobs.combine_texts(inputs.damaged_arrays(spark, sf_dir), SOURCE, DEST, RUN_ID)
    return ordering.record_index(combined.manifest).select("index", "path", "size", "source", "dest")


@query
def s4_rejected_parts(spark, sf_dir):
    return jobs.combine_texts(inputs.damaged_arrays(spark, sf_dir), SOURCE, DEST, RUN_ID).rejected_parts


@query
def s5_manifest_strict(spark, sf_dir):
    path = staging_path(spark, "manifest-json")
    manifests.write_manifest(inputs.manifest(spark, sf_dir, "orders"), path, "json")
    return manifests.read_manifest(spark, path).drop("hashes", "meta")


@query
def s6_sizes_lenient(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr(inputs.ORDER_LINE).alias("value"))
    return stats.totals(manifests.read_sizes(spark, inputs.written_lines(lines)))


# --- Projections and filters -----------------------------------------------


@query
def p1_manifest(spark, sf_dir):
    return inputs.manifest(spark, sf_dir, "orders").drop("hashes", "meta")


@query
def p1_manifest_from_objects(spark, sf_dir):
    objects = listing.parse_lines(inputs.order_lines(spark, sf_dir))
    return _record_columns(jobs.build_manifest(objects, SOURCE, DEST, RUN_ID))


@query
def p2_join_root(spark, sf_dir):
    roots = inputs.listing(spark, sf_dir, "pages").withColumn("root", F.concat("dataset", F.repeat(F.lit("/"), (F.col("seq") % 4).cast("int"))))
    return roots.select("seq", normalize.join_root(F.col("root"), F.col("path")).alias("joined"))


@query
def p3_rebase(spark, sf_dir):
    wide = inputs.manifest(spark, sf_dir, "orders").withColumn("note", F.col("path"))
    return jobs.rebase(wide, source_root="other:pool/").drop("hashes", "meta")


@query
def p3_rebase_lines(spark, sf_dir):
    lines = inputs.manifest(spark, sf_dir, "documents").select(
        "seq", F.to_json(F.struct("source_root", "dest_root", "path", "size", F.col("path").alias("note"))).alias("value")
    )
    out = staging_path(spark, "rebased")
    jobs.rebase_file(spark, inputs.written_lines(lines), out, dest_root="other:pool//")
    fields = "source_root string, dest_root string, source string, dest string, path string, size bigint, note string"
    return spark.read.schema(fields).json(out)


@query
def p4_part_prefix(spark, sf_dir):
    rows = inputs.listing(spark, sf_dir, "documents")
    prefix = F.when(F.col("seq") % 3 == 0, F.concat("dataset", F.lit("/"))).when(F.col("seq") % 3 == 1, "")
    return rows.select("seq", normalize.put_prefix(prefix, F.col("path")).alias("path"))


@query
def p5_work_list(spark, sf_dir):
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 16, "hash")
    return shards.work_list(sharded, 3)


@query
def p7_first_roots(spark, sf_dir):
    return normalize.first_roots(inputs.manifest(spark, sf_dir, "orders"))


@query
def f_object_rules(spark, sf_dir):
    objects = listing.parse_lines(inputs.order_lines(spark, sf_dir))
    value = F.col("object")
    return objects.select(
        "seq",
        normalize.is_directory(value).alias("is_directory"),
        normalize.is_directory_any_case(value).alias("is_directory_any_case"),
        normalize.text_path(value).alias("path"),
        normalize.size_or_zero(normalize.field(value, "Size")).alias("manifest_size"),
        normalize.listed_size(value).alias("listed_size"),
    )


# --- Aggregations ----------------------------------------------------------


@query
def a1_totals(spark, sf_dir):
    objects = listing.parse_lines(inputs.order_lines(spark, sf_dir))
    return stats.totals(normalize.totals_input(objects))


@query
def a1_totals_by_dataset(spark, sf_dir):
    return stats.totals(inputs.sized(spark, sf_dir, "orders"), ["dataset"])


def _register_for_listings(build, label):
    for name in inputs.LISTINGS:
        QUERIES[f"{label}_{name}"] = lambda spark, sf_dir, name=name: build(inputs.sized(spark, sf_dir, name))


_register_for_listings(stats.size_stats, "a2_size_stats")
_register_for_listings(lambda sizes: stats.size_stats(sizes, ["dataset"]), "a2_size_stats_by_dataset")
_register_for_listings(histogram.histogram, "a5_histogram")
_register_for_listings(lambda sizes: histogram.histogram(sizes, ["dataset"]), "a5_histogram_by_dataset")
_register_for_listings(histogram.range_histogram, "a6_range_histogram")
_register_for_listings(histogram.log_histogram, "a7_log_histogram")


@query
def a3_order_statistics(spark, sf_dir):
    quantiles = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    return stats.order_statistics(inputs.sized(spark, sf_dir, "orders"), quantiles=quantiles)


@query
def a6_range_histogram_by_dataset(spark, sf_dir):
    return histogram.range_histogram(inputs.sized(spark, sf_dir, "orders"), 1000, 5_000_000, ["dataset"])


@query
def a7_log_histogram_by_dataset(spark, sf_dir):
    return histogram.log_histogram(inputs.sized(spark, sf_dir, "pages"), 1, 10**12, 12, ["dataset"])


def _profile(sizes, group_cols=()):
    kept = ["total_files", "median_size", "profile", "profile_explanation", "suggested_flags"]
    return advise.transfer_profile(stats.size_stats(sizes, group_cols)).select(*group_cols, *kept)


_register_for_listings(_profile, "a9_profile")
_register_for_listings(lambda sizes: _profile(sizes, ["dataset"]), "a9_profile_by_dataset")


@query
def a10_shard_plan(spark, sf_dir):
    """Shard plans for every dataset as if each of its bytes stood for 1,024, under four settings."""
    datasets = stats.totals(inputs.sized(spark, sf_dir, "orders"), ["dataset"]).select(
        "dataset", (F.col("bytes_total") * 1024).alias("total_bytes")
    )
    setting = lambda cpus, tasks, cores, cap: F.struct(
        F.lit(cpus).cast("bigint").alias("cpus"), F.lit(tasks).cast("bigint").alias("tasks"),
        F.lit(cores).cast("bigint").alias("cores"), F.lit(cap).cast("bigint").alias("cap")
    )
    settings = F.array(setting(4, 64, None, 10), setting(4, 64, 40, 10), setting(8, 2, None, 20), setting(4, 64, 200, 10**4))
    cases = datasets.select("*", F.explode(settings).alias("setting")).select("dataset", "total_bytes", "setting.*")
    planned = advise.shard_plan(cases, "cpus", "tasks", "cores", "cap")
    return planned.select(
        "dataset", "cpus", "tasks", "cores", "cap", "num_shards", "reasoning", F.col("assumptions.total_bytes").alias("total_bytes")
    )


def _report(sizes, group_cols=()):
    report = jobs.analyze(sizes, group_cols, core_budget=40)
    sub = F.col("file_size_stats")
    return report.select(
        *group_cols, "status", "total_files", "total_bytes", "total_bytes_human",
        *[sub[name].alias(name) for name in ("min_size", "max_size_human", "median_size", "small_files_pct", "large_files_pct")],
        "profile", "suggested_flags", "suggested_shard_count",
        F.size("histogram").alias("bins"), F.col("histogram")[0]["range_label"].alias("first_bin"),
        F.aggregate("histogram", F.lit(0).cast("bigint"), lambda total, b: total + b["file_count"]).alias("binned_files"),
    )


_register_for_listings(_report, "k4_report")
_register_for_listings(lambda sizes: _report(sizes, ["dataset"]), "k4_report_by_dataset")


# --- Shards ----------------------------------------------------------------


@query
def h1_count(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 7, "count").select("seq", "shard_id")


@query
def h2_hash(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 97, "hash").select("seq", "shard_id")


@query
def h2_hash_without_source(spark, sf_dir):
    """Key is the path for some records and the position for the rest."""
    bare = inputs.manifest(spark, sf_dir, "orders").withColumns(
        {"source": F.lit(""), "path": F.when(F.col("seq") % 2 == 0, F.col("path"))}
    )
    return shards.assign_shards(bare, 97, "hash").select("seq", "shard_id")


@query
def h3_bytes_documents(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "documents"), 8).select("seq", "shard_id")


@query
def h3_bytes_pages(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "pages"), 12).select("seq", "shard_id")


@query
def h3_bytes_orders(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 64).select("seq", "shard_id")


@query
def h3_bytes_spread(spark, sf_dir):
    return shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 16, spread_empty=True).select("seq", "shard_id")


@query
def a8_shard_summary(spark, sf_dir):
    """More shards than fit the key range, so some stay empty."""
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "pages"), 400, "hash")
    return shards.shard_summary(sharded, 400)


@query
def k1_manifest_round_trip(spark, sf_dir):
    path = staging_path(spark, "manifest")
    manifests.write_manifest(inputs.manifest(spark, sf_dir, "documents"), path)
    return spark.read.schema(MANIFEST).parquet(path).drop("hashes", "meta")


@query
def k2_shard_files(spark, sf_dir):
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 7, "count")
    path = staging_path(spark, "shards")
    shard_files.write_shards(sharded, path, 7, "count")
    return shard_files.read_shards(spark, path, sharded.schema).select("shard_id", "seq", "path", "size")


@query
def k2_shard_positions(spark, sf_dir):
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 7, "count")
    by_size = shards.shard_positions(sharded, "bytes").withColumnRenamed("shard_pos", "pos_by_size")
    return shards.shard_positions(by_size, "count").select("seq", "shard_id", "shard_pos", "pos_by_size")


@query
def k2_one_shard_positions(spark, sf_dir):
    sharded = inputs.manifest(spark, sf_dir, "orders").withColumn("shard_id", F.lit(0))
    return shards.shard_positions(sharded, "bytes").select("seq", "shard_pos")


@query
def k2_shard_by_index(spark, sf_dir):
    """One shard of three, spread over many files, by its segment list."""
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "orders"), 3, "count")
    path = staging_path(spark, "shards")
    shard_files.write_shards(sharded, path, 3, "count", "parquet", partitions=24)
    return shard_files.read_shard(spark, path, sharded.schema, 1).select("shard_pos", "seq", "path", "size")


@query
def k2_file_per_shard(spark, sf_dir):
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "documents"), 40, "hash")
    path = staging_path(spark, "shards")
    shard_files.write_shards(sharded, path, 40, "hash", one_file_per_shard=True)
    line = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    files = spark.read.text(path).select("_metadata.file_path", "value", line.alias("line"))
    records = files.select("file_path", "line", F.from_json("value", "seq bigint, path string").alias("r"))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("line")) - 1
    return records.select(F.regexp_extract("file_path", r"shard_id=(\d+)/", 1).cast("int").alias("shard_id"), place.alias("shard_pos"), "r.seq", "r.path")


@query
def k3_shard_metadata(spark, sf_dir):
    sharded = shards.assign_shards(inputs.manifest(spark, sf_dir, "pages"), 400, "hash")
    summary = shards.shard_summary(sharded, 400)
    return shard_files.shard_metadata(summary, 400, "hash", "pages", "out").drop("created_at")


@query
def plan_end_to_end(spark, sf_dir):
    sharded = jobs.plan(inputs.listing(spark, sf_dir, "documents"), SOURCE, DEST, 8, RUN_ID)
    return shards.shard_summary(sharded, 8)


# --- Order -----------------------------------------------------------------


@query
def o2_record_index(spark, sf_dir):
    return ordering.record_index(inputs.manifest(spark, sf_dir, "orders").select("seq", "size")).select("seq", "index")


@query
def o5_largest(spark, sf_dir):
    return ordering.largest(inputs.manifest(spark, sf_dir, "orders"), 100).select("seq", "path", "size")


@query
def duplicate_paths(spark, sf_dir):
    """Paths of documents when every document is listed under its source only."""
    manifest = inputs.manifest(spark, sf_dir, "documents").withColumn("path", F.substring_index("path", "/", 2))
    return normalize.duplicate_paths(manifest)


# --- Texts and transfer times ----------------------------------------------


@query
def c1_human_bytes(spark, sf_dir):
    rows = inputs.sized(spark, sf_dir, "orders")
    powers = (-20, -10, 0, 10, 20)
    scaled = rows.selectExpr("seq", *[f"cast(size * pow(2, {power}) AS bigint) AS `bytes_{power}`" for power in powers])
    return scaled.select("seq", *[human_bytes(f"`bytes_{power}`").alias(f"bytes_{power}") for power in powers])


@query
def c2_human_seconds(spark, sf_dir):
    times = {
        "long_time": "o_totalprice",
        "short_time": "o_totalprice / 3600D",
        "whole_minutes": "rint(o_totalprice / 100D) * 60D",
        "undefined_time": "-o_totalprice",
    }
    rows = inputs.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", *[f"{value} AS {name}" for name, value in times.items()])
    return rows.select("seq", *[human_seconds(name).alias(name) for name in times])


@query
def c3_rates(spark, sf_dir):
    events = inputs.in_parallel(inputs.table(spark, sf_dir, "events")).select("event_id", F.expr("cast(cast(value * 100 AS bigint) AS string)").alias("number"))
    units = {"gbps": "Gbps", "mb_s": " MB/s", "kib_s": "KiB/s ", "tb_per_sec": "TbPerSec", "plain": "Bp/s", "pib": " PiBps"}
    return events.select("event_id", *[bytes_per_second(F.concat("number", F.lit(unit))).alias(name) for name, unit in units.items()])


@query
def c4_human_rates(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS seq", "o_totalprice * 12345D AS rate")
    return rows.select("seq", human_rate("rate").alias("gbps"), human_rate("rate", "MBps").alias("mb_s"))


def _estimate(spark, sf_dir, **options):
    return jobs.estimate(inputs.sized(spark, sf_dir, "orders"), "1Gbps", "40Gbps", group_cols=["dataset"], hist_mode=None, **options)


@query
def e1_time_steps(spark, sf_dir):
    """Rates between the lowest and the highest event value of each user, for one TiB."""
    ranges = inputs.table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.floor(F.min("value")) * 1e6).alias("max_rate"), (F.floor(F.max("value") + 1) * 1e6).alias("min_rate")
    )
    steps = transfer_time.time_steps_for(ranges.withColumn("bytes_total", F.lit(TIB)))
    return steps.select("user_id", "step", F.round("rate", 0).cast("bigint").alias("rate"))


@query
def e2_time_table(spark, sf_dir):
    return _estimate(spark, sf_dir).times


@query
def e3_time_range(spark, sf_dir):
    return _estimate(spark, sf_dir, prefer_units="MBps").ends


# --- State, retry, resume --------------------------------------------------


def _event_shards(spark, sf_dir):
    """Shards named by the users; a shard's records are the user's orders."""
    orders = inputs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard_id"), F.col("o_orderkey").alias("seq"))
    return orders.groupBy("shard_id").agg(F.count("*").alias("files"))


@query
def t1_attempt_summary(spark, sf_dir):
    return attempts.attempt_summary(inputs.attempts(spark, sf_dir))


@query
def t1_shard_status(spark, sf_dir):
    return attempts.shard_status(_event_shards(spark, sf_dir), inputs.attempts(spark, sf_dir))


@query
def t2_pending_work(spark, sf_dir):
    sharded = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("shard_id"), F.col("o_orderkey").alias("seq"), "o_totalprice"
    )
    status = attempts.shard_status(_event_shards(spark, sf_dir), inputs.attempts(spark, sf_dir))
    return attempts.pending_work(sharded, status)


@query
def t2_pending_folders(spark, sf_dir):
    """Records of unfinished shards out of a shard folder; shards from 20 on never succeed."""
    sharded = inputs.manifest(spark, sf_dir, "orders").withColumn("shard_id", F.expr("cast(seq % 32 AS int)"))
    path = staging_path(spark, "shards")
    shard_files.write_shards(sharded, path, 32, "count")
    log = inputs.attempt_log(spark, sf_dir).withColumn("shard_id", F.expr("cast(shard_id % 32 AS int)"))
    log = log.withColumn("rc", F.expr("CASE WHEN shard_id < 20 THEN rc ELSE 1 END"))
    status = attempts.shard_status(shards.shard_summary(sharded, 32), attempts.number_attempts(log))
    return shard_files.read_pending(spark, path, sharded.schema, status).select("shard_id", "seq", "path", "size")


@query
def t3_retry_plan(spark, sf_dir):
    status = attempts.shard_status(_event_shards(spark, sf_dir), inputs.attempts(spark, sf_dir))
    return attempts.retry_plan(status, max_attempts=60)


@query
def t4_progress(spark, sf_dir):
    return progress.progress_checkpoints(inputs.manifest(spark, sf_dir, "orders"))


@query
def t4_progress_fine(spark, sf_dir):
    return progress.progress_checkpoints(inputs.manifest(spark, sf_dir, "documents"), every=64)


# --- Streams ---------------------------------------------------------------


@query
def x1_live_manifest(spark, sf_dir):
    """Part files through the streaming build."""
    parts_dir, out = inputs.written_arrays(spark, sf_dir), staging_path(spark, "live")
    arriving = live.stream_parts(spark, parts_dir, pattern="part-*.txt")
    live.append_parts(arriving, parts_dir, out, staging_path(spark, "state"), SOURCE, DEST, RUN_ID).awaitTermination()
    return spark.read.parquet(out).select("path", "size", "source")


@query
def x1_late_sidecars(spark, sf_dir):
    """Parts first, their sidecars a minute later, then a part that lets the rest go unprefixed."""
    parts_dir, out, state = staging_path(spark, "parts"), staging_path(spark, "live"), staging_path(spark, "state")
    parts = inputs.damaged_arrays(spark, sf_dir).select("part", "prefix", "text")
    minute = 60_000
    start = 20_000_000 * minute

    def run():
        arriving = live.stream_parts_and_sidecars(spark, parts_dir, "5 minutes")
        live.append_parts(arriving, parts_dir, out, state, SOURCE, DEST, RUN_ID).awaitTermination()

    inputs.write_files(spark, parts_dir, inputs.part_files(parts.drop("prefix")), start)
    run()
    inputs.write_files(spark, parts_dir, inputs.part_files(parts.drop("text")), start + minute)
    run()
    inputs.write_file(spark, parts_dir, "lsjson-end.json", "[]", start + 20 * minute)
    run()
    return spark.read.parquet(out).select("path", "size", "source")


@query
def x1_live_progress(spark, sf_dir):
    out = staging_path(spark, "progress")
    arriving = live.stream_parts(spark, inputs.written_arrays(spark, sf_dir), pattern="part-*.txt")
    live.keep_latest(live.live_progress(arriving), out, staging_path(spark, "state")).awaitTermination()
    return _last_batch(spark, out)


@query
def x1_live_checkpoints(spark, sf_dir):
    """Progress after every 64 records of arriving parts, over several batches."""
    parts_dir, out = inputs.written_arrays(spark, sf_dir), staging_path(spark, "live")
    arriving = live.stream_parts(spark, parts_dir, pattern="part-*.txt", files_per_batch=10)
    live.append_parts(arriving, parts_dir, out, staging_path(spark, "state"), SOURCE, DEST, RUN_ID, every=64).awaitTermination()
    listed = live.read_progress(spark, f"{out}_progress")
    return listed.agg(F.max("files_listed").alias("files_listed"), F.max("bytes_listed").alias("bytes_listed"), F.count("*").alias("reports"))


@query
def x2_live_attempts(spark, sf_dir):
    """Shard status from the raw log, numbered by keyed state."""
    log, out, state = staging_path(spark, "log"), staging_path(spark, "status"), staging_path(spark, "state")
    raw = inputs.attempt_log(spark, sf_dir)
    raw.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(log)
    arriving = spark.readStream.schema(raw.schema).parquet(log)
    live.keep_latest(live.live_attempts(arriving), out, state, "update").awaitTermination()
    return live.read_latest(spark, out, "shard_id")


@query
def x2_live_shard_status(spark, sf_dir):
    log, out, state = staging_path(spark, "log"), staging_path(spark, "status"), staging_path(spark, "state")
    numbered = inputs.attempts(spark, sf_dir)
    numbered.write.parquet(log)
    arriving = spark.readStream.schema(numbered.schema).parquet(log)
    live.keep_latest(live.live_shard_status(arriving), out, state).awaitTermination()
    return _last_batch(spark, out)


def _last_batch(spark, out):
    batches = spark.read.parquet(out)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).scalar()).drop("batch")
