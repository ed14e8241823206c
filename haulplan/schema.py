"""Record layouts shared by the whole package."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST_SCHEMA = "haulplan.manifest.v1"
SHARDS_SCHEMA = "haulplan.shards.v1"

MIB = 1024**2
TIB = 1024**4

#: One manifest record.  ``seq`` carries the record order: it is unique and
#: rises with the position in the listing, but it may have gaps.
MANIFEST = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("source_root", T.StringType()),
        T.StructField("dest_root", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.StringType()),
        T.StructField("hashes", T.MapType(T.StringType(), T.StringType())),
        T.StructField("etag", T.StringType()),
        T.StructField("storage_class", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)

MANIFEST_COLUMNS = MANIFEST.fieldNames()

SHARDED = T.StructType([*MANIFEST.fields, T.StructField("shard_id", T.IntegerType())])
