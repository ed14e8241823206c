"""Manifest files: strict and lenient reading, writing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.operators.normalize import STRING_MAP, field, join_root, size_or_skip, size_or_zero
from haulplan.schema import MANIFEST_COLUMNS, MANIFEST_SCHEMA
from haulplan.sources.listing import is_blank, opens_with, read_ndjson, with_json


def _check_schema(schema: Column, accepted: Sequence[str]) -> Column:
    found = F.coalesce(schema, F.lit("none"))
    refused = F.raise_error(F.concat(F.lit("unknown manifest schema: "), found)).cast("string")
    return F.when(schema.isin(*accepted), schema).otherwise(refused)


def manifest_from_objects(objects: DataFrame, accepted: Sequence[str] = (MANIFEST_SCHEMA,)) -> DataFrame:
    """Typed manifest of parsed records (``seq, object``).

    A record's own ``seq`` wins over its place in the file.
    """
    value = F.col("object")
    texts = ["run_id", "source_root", "dest_root", "source", "dest", "path", "mtime", "etag", "storage_class"]
    columns = {name: field(value, name, "string") for name in texts}
    columns |= {name: F.coalesce(field(value, name, STRING_MAP), F.create_map().cast(STRING_MAP)) for name in ("hashes", "meta")}
    columns |= {
        "schema": _check_schema(field(value, "schema", "string"), accepted),
        "size": size_or_zero(field(value, "size")),
        "seq": F.coalesce(field(value, "seq", "bigint"), F.col("seq")),
    }
    return objects.select([columns[name].alias(name) for name in MANIFEST_COLUMNS])


def read_manifest(spark: SparkSession, paths: str | list[str], accepted: Sequence[str] = (MANIFEST_SCHEMA,)) -> DataFrame:
    """Manifest in newline-delimited JSON; a line that is no JSON fails the job."""
    return manifest_from_objects(read_ndjson(spark, paths), accepted)


def sizes_of_lines(lines: DataFrame) -> DataFrame:
    """Sizes of manifest lines (``value``), leaving out lines and sizes that cannot be read."""
    parsed = with_json(lines.where(~is_blank(F.col("value"))), "value", "object")
    sizes = parsed.where(F.col("object").isNotNull() & opens_with(F.col("value"), "{")).select(size_or_skip(field(F.col("object"), "size")).alias("size"))
    return sizes.where(F.col("size").isNotNull())


def read_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return sizes_of_lines(spark.read.text(paths))


def rebase_objects(objects: DataFrame, source_root: str | None = None, dest_root: str | None = None) -> DataFrame:
    """Rebase parsed records as JSON text, so that fields unknown to us survive.

    Returns ``seq, value`` with ``seq`` also inside the record.
    """
    value = F.col("object")
    new_source = F.coalesce(F.lit(source_root), field(value, "source_root", "string"), F.lit(""))
    new_dest = F.coalesce(F.lit(dest_root), field(value, "dest_root", "string"), F.lit(""))
    path = F.coalesce(field(value, "path", "string"), F.lit(""))
    seq = F.coalesce(field(value, "seq", "bigint"), F.col("seq"))
    changed = {
        "source_root": new_source,
        "dest_root": new_dest,
        "source": join_root(new_source, path),
        "dest": join_root(new_dest, path),
        "seq": seq,
    }
    others = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda key, _: ~key.isin(*changed))
    written = F.create_map(*[item for name, new in changed.items() for item in (F.lit(name), new.cast("variant"))])
    record = F.to_json(F.map_concat(others, written))
    return objects.select(seq.alias("seq"), record.alias("value"))


def in_record_order(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition by ``seq``: files in name order hold the records in order."""
    ranged = df.repartitionByRange(partitions, "seq") if partitions else df.repartitionByRange("seq")
    return ranged.sortWithinPartitions("seq")


def write_manifest(manifest: DataFrame, path: str, file_format: str = "parquet", ordered: bool | None = None) -> None:
    """Write a manifest as ``parquet`` or as compact ``json`` lines.

    JSON lines are put in record order; parquet has the order in ``seq`` and is
    written without a shuffle, unless ``ordered`` asks for one.  Null fields are
    written, so that every record has every field.
    """
    ordered = file_format == "json" if ordered is None else ordered
    rows = in_record_order(manifest) if ordered else manifest
    writer = rows.write.option("ignoreNullFields", "false") if file_format == "json" else rows.write
    writer.format(file_format).save(path)
