"""Run the jobs from a shell: ``python -m haulplan <job> ...`` or through ``spark-submit``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.operators import advise
from haulplan.operators.attempts import MAX_ATTEMPTS, pending_work, retry_plan, shard_status
from haulplan.operators.normalize import totals_input
from haulplan.operators.progress import progress_checkpoints
from haulplan.operators.shards import STRATEGIES
from haulplan.plans import jobs
from haulplan.schema import MANIFEST, MANIFEST_SCHEMA, SHARDED
from haulplan.sources import listing, manifests
from haulplan.sources.shard_files import read_shards
from haulplan.staging import stage


def _load_manifest(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.format == "parquet":
        return spark.read.schema(MANIFEST).parquet(args.input)
    return stage(manifests.read_manifest(spark, args.input, [MANIFEST_SCHEMA, *args.accept_schema]), "manifest")


def build(spark: SparkSession, args: argparse.Namespace) -> None:
    objects = listing.read_listing(spark, args.input, form=args.form)
    _write_manifest(jobs.build_manifest(objects, args.source, args.dest, args.run_id), args)


def _write_manifest(manifest: DataFrame, args: argparse.Namespace) -> None:
    if args.progress:
        manifest = stage(manifest, "manifest")
        progress_checkpoints(manifest).write.json(args.progress)
    manifests.write_manifest(manifest, args.out, args.format)


def combine(spark: SparkSession, args: argparse.Namespace) -> None:
    combined = jobs.combine_parts(spark, args.parts_dir, args.source, args.dest, args.run_id)
    _write_manifest(combined.manifest, args)
    for part in combined.rejected_parts.toLocalIterator():
        print(f"skipped {part.part}: {part.reason}")


def rebase(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.format == "parquet":
        moved = jobs.rebase(spark.read.parquet(args.input), args.source_root, args.dest_root)
        manifests.write_manifest(moved, args.out)
    else:
        jobs.rebase_file(spark, args.input, args.out, args.source_root, args.dest_root)


def shard(spark: SparkSession, args: argparse.Namespace) -> None:
    manifest = _load_manifest(spark, args)
    _write_shards(manifest, args)


def _write_shards(manifest: DataFrame, args: argparse.Namespace) -> None:
    jobs.shard_manifest(
        manifest, args.outdir, args.num_shards, args.strategy, args.spread_empty, args.input, args.one_file_per_shard
    )


def plan(spark: SparkSession, args: argparse.Namespace) -> None:
    objects = listing.read_listing(spark, args.input, form=args.form)
    _write_shards(stage(jobs.build_manifest(objects, args.source, args.dest, args.run_id), "manifest"), args)


def status(spark: SparkSession, args: argparse.Namespace) -> None:
    shards = spark.read.schema("shard_id int, files bigint, bytes bigint").json(f"{args.outdir}/metadata/summary")
    attempts = spark.read.schema("shard_id int, attempt bigint, rc bigint").json(args.attempts)
    found = stage(retry_plan(shard_status(shards, attempts), args.max_attempts), "status")
    if args.pending:
        sharded = read_shards(spark, f"{args.outdir}/shards", SHARDED)
        manifests.write_manifest(pending_work(sharded, found).drop("shard_id"), args.pending, "json")
    if args.out:
        found.write.json(args.out)
    else:
        for row in found.groupBy("status", "action").agg(F.count("*").alias("shards")).orderBy("status", "action").collect():
            print(row.status, row.action, row.shards)


def analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.format == "parquet":
        sizes = spark.read.parquet(args.input)
    else:
        sizes = stage(manifests.read_sizes(spark, args.input), "sizes")  # texts are parsed once
    report = jobs.analyze(
        sizes,
        args.group_by,
        args.base_flags,
        args.assumed_cpus_per_task,
        args.assumed_array_concurrency,
        args.assumed_core_budget,
        args.max_shard_bytes_tb,
    )
    if args.out:
        jobs.write_report(report, args.out, args.group_by)
    else:
        for row in jobs.report_json(report, args.group_by).toLocalIterator():
            print(*row)


def estimate(spark: SparkSession, args: argparse.Namespace) -> None:
    objects = listing.read_listing(spark, args.input, ordered=False, form=args.form)
    sizes = stage(totals_input(objects), "sizes")
    mode = None if args.no_hist else args.hist_mode
    result = jobs.estimate(
        sizes, args.min_rate, args.max_rate, args.prefer_units, mode, args.hist_min, args.hist_max, args.hist_bins
    )
    for table in result:
        if table is not None:
            table.show(200, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="haulplan", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(job, *required: str, manifest_format: bool = True) -> argparse.ArgumentParser:
        sub = commands.add_parser(job.__name__)
        sub.set_defaults(job=job)
        for name in required:
            sub.add_argument(f"--{name}", required=True, dest="input" if name == "in" else None)
        if manifest_format:
            sub.add_argument("--format", choices=["json", "parquet"], default="json", help="format of manifest files")
        return sub

    for job, place in ((build, "in"), (combine, "parts-dir")):
        sub = command(job, place, "source", "dest", "out")
        sub.add_argument("--run-id")
        sub.add_argument("--progress", help="folder for the records and bytes listed after every interval and at the end")
        if job is build:
            sub.add_argument("--form", choices=["auto", "array", "ndjson"], default="auto", help="form of the listing")
    sub = command(rebase, "in", "out")
    sub.add_argument("--source-root")
    sub.add_argument("--dest-root")
    for job, more in ((shard, ()), (plan, ("source", "dest"))):
        sub = command(job, "in", "outdir", *more, manifest_format=job is shard)
        sub.add_argument("--num-shards", type=int, required=True)
        sub.add_argument("--strategy", choices=STRATEGIES, default="bytes")
        sub.add_argument("--spread-empty", action="store_true")
        sub.add_argument("--one-file-per-shard", action="store_true", help="one file, maybe empty, for every shard number")
        if job is shard:
            sub.add_argument("--accept-schema", action="append", default=[], help="further schema name to accept")
        else:
            sub.add_argument("--run-id")
            sub.add_argument("--form", choices=["auto", "array", "ndjson"], default="auto", help="form of the listing")
    sub = command(status, "outdir", "attempts", manifest_format=False)
    sub.add_argument("--max-attempts", type=int, default=MAX_ATTEMPTS)
    sub.add_argument("--pending", help="folder for the records that are still to be copied")
    sub.add_argument("--out", help="folder for the status of every shard; else counts are printed")
    sub = command(analyze, "in")
    sub.add_argument("--out")
    sub.add_argument("--group-by", action="append", default=[], help="column to analyze by (parquet manifests)")
    sub.add_argument("--base-flags", default=advise.BASE_FLAGS)
    sub.add_argument("--assumed-cpus-per-task", type=int, default=advise.CPUS_PER_TASK)
    sub.add_argument("--assumed-array-concurrency", type=int, default=advise.ARRAY_CONCURRENCY)
    sub.add_argument("--assumed-core-budget", type=int)
    sub.add_argument("--max-shard-bytes-tb", type=int, default=advise.MAX_SHARD_TIB)
    sub = command(estimate, "in", "min-rate", "max-rate", manifest_format=False)
    sub.add_argument("--form", choices=["auto", "array", "ndjson"], default="auto", help="form of the listing")
    sub.add_argument("--prefer-units", choices=["Gbps", "MBps"], default="Gbps")
    sub.add_argument("--no-hist", action="store_true")
    sub.add_argument("--hist-mode", choices=["pow2", "log"], default="pow2")
    sub.add_argument("--hist-min", type=int, default=jobs.DEFAULT_MIN)
    sub.add_argument("--hist-max", type=int, default=jobs.DEFAULT_MAX)
    sub.add_argument("--hist-bins", type=int, default=0)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.job(SparkSession.builder.appName("haulplan").getOrCreate(), args)


if __name__ == "__main__":
    main()
