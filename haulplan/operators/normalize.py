"""From listing objects to manifest records."""

from __future__ import annotations

import secrets
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulplan.schema import MANIFEST_COLUMNS, MANIFEST_SCHEMA

STRING_MAP = "map<string,string>"


def new_run_id() -> str:
    """UTC time and three random bytes; drawn once per job, never per row."""
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}_{secrets.token_hex(3)}"


def join_root(root: Column, path: Column) -> Column:
    """Path below a root, whatever number of slashes the root ends with."""
    return F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path)


def put_prefix(prefix: Column, path: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("/"), path)).otherwise(path)


def field(value: Column, name: str, data_type: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", data_type)


def _has_type(value: Column, name: str, type_name: str) -> Column:
    return F.coalesce(F.schema_of_variant(field(value, name)) == type_name, F.lit(False))


def is_directory(value: Column) -> Column:
    """Only a boolean true marks a directory; the text ``"true"`` does not."""
    return _has_type(value, "IsDir", "BOOLEAN") & F.coalesce(field(value, "IsDir", "boolean"), F.lit(False))


def is_directory_any_case(value: Column) -> Column:
    lower = _has_type(value, "isdir", "BOOLEAN") & F.coalesce(field(value, "isdir", "boolean"), F.lit(False))
    return is_directory(value) | lower


def text_path(value: Column) -> Column:
    """The path when it is a non-empty string, else null."""
    return F.when(_has_type(value, "Path", "STRING"), F.nullif(field(value, "Path", "string"), F.lit("")))


def _is_false_like(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return text.isNull() | text.isin("", "[]", "{}")


def size_or_zero(size: Column) -> Column:
    """Size for the manifest: an absent or empty size is 0, and the row stays.

    A size that is present and no number fails the job, as it makes every total
    wrong.
    """
    number = F.try_variant_get(size, "$", "bigint")
    bad = F.raise_error(F.concat(F.lit("not a size: "), F.try_variant_get(size, "$", "string"))).cast("bigint")
    return F.coalesce(number, F.when(_is_false_like(size), F.lit(0).cast("bigint")).otherwise(bad))


def size_or_skip(size: Column) -> Column:
    """Size for lenient analysis: absent or empty is 0, no number is null (skip the row)."""
    number = F.try_variant_get(size, "$", "bigint")
    return F.coalesce(number, F.when(_is_false_like(size), F.lit(0).cast("bigint")))


def listed_size(value: Column) -> Column:
    """Size for totals: ``Size``, else ``size`` when that key is absent; null means skip.

    An explicit JSON null in ``Size`` does not fall back to ``size``.
    """
    size = F.coalesce(field(value, "Size"), field(value, "size"))
    return F.when(~is_directory_any_case(value), F.try_variant_get(size, "$", "bigint"))


def _records(rows: DataFrame, source_root: str, dest_root: str, run_id: str | None) -> DataFrame:
    source, dest = F.lit(source_root), F.lit(dest_root)
    return rows.withColumns(
        {
            "schema": F.lit(MANIFEST_SCHEMA),
            "run_id": F.lit(run_id or new_run_id()),
            "source_root": source,
            "dest_root": dest,
            "source": join_root(source, F.col("path")),
            "dest": join_root(dest, F.col("path")),
        }
    ).select(MANIFEST_COLUMNS)


def from_objects(objects: DataFrame, source_root: str, dest_root: str, run_id: str | None = None) -> DataFrame:
    """Manifest of scanned objects (``seq, object`` and, for parts, ``prefix``).

    Directories and objects without a usable path are dropped.
    """
    value = F.col("object")
    prefix = F.col("prefix") if "prefix" in objects.columns else F.lit("")
    no_entries = F.create_map().cast(STRING_MAP)
    rows = (
        objects.where(~is_directory(value))
        .withColumn("relative", text_path(value))
        .where(F.col("relative").isNotNull())
        .select(
            "seq",
            put_prefix(prefix, F.col("relative")).alias("path"),
            size_or_zero(field(value, "Size")).alias("size"),
            field(value, "ModTime", "string").alias("mtime"),
            F.coalesce(field(value, "Hashes", STRING_MAP), no_entries).alias("hashes"),
            F.coalesce(
                F.nullif(field(value, "ETag", "string"), F.lit("")), F.nullif(field(value, "etag", "string"), F.lit(""))
            ).alias("etag"),
            field(value, "StorageClass", "string").alias("storage_class"),
            F.coalesce(field(value, "Metadata", STRING_MAP), no_entries).alias("meta"),
        )
    )
    return _records(rows, source_root, dest_root, run_id)


def from_table(listing: DataFrame, source_root: str, dest_root: str, run_id: str | None = None) -> DataFrame:
    """Manifest of a listing that is already a table (``seq, path, size, is_dir, mtime``)."""
    no_entries = F.create_map().cast(STRING_MAP)
    rows = listing.where(~F.coalesce("is_dir", F.lit(False)) & (F.col("path") != "")).select(
        "seq",
        "path",
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        "mtime",
        no_entries.alias("hashes"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("storage_class"),
        no_entries.alias("meta"),
    )
    return _records(rows, source_root, dest_root, run_id)


def rebase(manifest: DataFrame, source_root: str | None = None, dest_root: str | None = None) -> DataFrame:
    """Move a manifest to other roots; every column but the four root columns stays as it is."""
    new_source = F.coalesce(F.lit(source_root), F.col("source_root"), F.lit(""))
    new_dest = F.coalesce(F.lit(dest_root), F.col("dest_root"), F.lit(""))
    path = F.coalesce(F.col("path"), F.lit(""))
    return manifest.withColumns(
        {
            "source_root": new_source,
            "dest_root": new_dest,
            "source": join_root(new_source, path),
            "dest": join_root(new_dest, path),
        }
    )


def totals_input(objects: DataFrame) -> DataFrame:
    """Sizes that count for totals: no directories, no missing or unreadable sizes."""
    return objects.select(listed_size(F.col("object")).alias("size")).where(F.col("size").isNotNull())


def first_roots(manifest: DataFrame) -> DataFrame:
    """Roots of the first record, and how many different pairs of roots there are."""
    pairs = manifest.groupBy("source_root", "dest_root").agg(F.min("seq").alias("first_seq"))
    return pairs.agg(
        F.min_by("source_root", "first_seq").alias("source_root"),
        F.min_by("dest_root", "first_seq").alias("dest_root"),
        F.count("*").alias("distinct_roots"),
    )


def resolve_roots(manifest: DataFrame, source_root: str | None = None, dest_root: str | None = None) -> tuple[str, str]:
    """Given roots, completed from the first record; unknown roots are an error."""
    if not (source_root and dest_root):
        first = first_roots(manifest).first()
        source_root, dest_root = source_root or first.source_root, dest_root or first.dest_root
    if not (source_root and dest_root):
        raise ValueError("source and destination root are not given and not in the manifest")
    return source_root, dest_root


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    """Paths listed more than once (overlapping parts are kept, so this is a check)."""
    return manifest.groupBy("path").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
