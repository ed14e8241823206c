"""Scans of object listings: JSON arrays, newline-delimited JSON and part folders.

Every scan returns ``seq BIGINT, object VARIANT``.  VARIANT keeps the JSON type
of each field, which the normalising rules need (a directory flag counts only as
a boolean, a path only as a string), and tells ``ETag`` from ``etag``.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulplan.operators.ordering import ranked
from haulplan.sources.array_blocks import array_texts
from haulplan.staging import stage

#: An array file up to this size is one row of one task; a larger one is read in splits, to the same result.
MAX_ARRAY_BYTES = 64 * 1024**2

#: Sidecars up to this number are looked for one by one; for more the folder is listed.
LOOKUPS = 1000

#: Positions inside one part file stay below ``2**PART_SHIFT``.
PART_SHIFT = 40


#: Start of a file name that Spark spells in two ways (``file:/x``, ``file:///x``).
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"

#: White space of JSON.
BLANKS = " \t\r\n"


def is_blank(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS)) == ""


def with_json(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the VARIANT of a JSON text; null when the whole text is not one JSON value.

    Spark's parser stops behind the first value and would pass over anything
    that follows.  The text is therefore read as the first element of an array
    that ends with a mark, and counts only if the mark is the second element.  The
    mark is a hash of the text, so no text can hold its own.  Of repeated keys in
    an object the last one counts, for which a setting of the session is needed.

    The value is handed on by ``explode``, behind which no filter is moved, so
    that a text is parsed once however often the value is used.
    """
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    sign = F.md5(F.encode(F.col(text), "UTF-8"))
    elements = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"'), sign, F.lit('"]'))), "$", "array<variant>")
    mark = F.try_variant_get(F.get("_elements", F.lit(1)), "$", "string")
    value = F.when((F.size("_elements") == 2) & (mark == sign), F.get("_elements", F.lit(0)))
    return rows.withColumn("_elements", elements).withColumn(name, F.explode(F.array(value))).drop("_elements")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def opens_with(text: Column, bracket: str) -> Column:
    """Whether the first character that is no JSON blank is ``bracket``."""
    return F.startswith(F.ltrim(text, F.lit(BLANKS)), F.lit(bracket))


def explode_arrays(parts: DataFrame) -> DataFrame:
    """Objects of parsed arrays: ``part_number, array VARIANT`` plus any columns to keep.

    Elements that are no objects are dropped.  ``seq`` orders by part, then by
    position inside the part, and needs no shuffle.
    """
    kept = [name for name in parts.columns if name not in ("array", "part_number")]
    elements = parts.select(
        *kept, "part_number", F.posexplode(F.try_variant_get("array", "$", "array<variant>")).alias("position", "object")
    )
    return elements.where(is_object(F.col("object"))).select(*kept, _seq(F.col("position")), "object")


def _seq(position: Column) -> Column:
    return (F.shiftleft(F.col("part_number").cast("bigint"), PART_SHIFT) + position).alias("seq")


def _files(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)


def _part() -> Column:
    return F.regexp_replace(F.col("_metadata.file_path"), SCHEME, "").alias("part")


def _numbered(files: DataFrame) -> DataFrame:
    """``part, part_number, length`` of all files of a scan, numbered in the order of their paths.

    The names come from the scan's plan, since a scan gives no row for an empty file.
    """
    names = [(re.sub(SCHEME, "", name), unquote(re.sub(SCHEME, "", name))) for name in files.inputFiles()]
    numbered = ranked(files.sparkSession.createDataFrame(names, "part string, path string"), [F.col("path"), F.col("part")], "part_number")
    lengths = files.select(_part(), "length")
    numbered = numbered.join(lengths, "part", "left")
    return numbered.select("part", F.col("part_number").cast("int").alias("part_number"), F.coalesce("length", F.lit(0)).alias("length"))


def _whole_files(spark: SparkSession, paths: str | list[str], max_bytes: int, pattern: str = "*") -> DataFrame:
    """``part, part_number, text`` of files read whole, in the order of their paths.

    Empty files give no row in a scan, so they are added with an empty text.  A
    file above the limit has a null text and is not read.
    """
    numbered = _numbered(_files(spark, paths, pattern))
    texts = spark.read.option("pathGlobFilter", pattern).text(paths, wholetext=True)
    texts = texts.where(F.col("_metadata.file_size") <= max_bytes).select(_part(), F.col("value").alias("text"))
    large = F.when(F.col("length") <= max_bytes, "")
    others = numbered.where((F.col("length") > max_bytes) | (F.col("length") == 0)).select("part", "part_number", large.alias("text"))
    return texts.join(numbered.select("part", "part_number"), "part").unionByName(others)


def read_large_arrays(
    spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_ARRAY_BYTES, pattern: str = "*"
) -> tuple[DataFrame, DataFrame] | None:
    """Array files above the limit, read in splits: objects and files, or None without any.

    Objects are ``part, part_number, seq, object``, files ``part, is_array``.  Objects may stand
    anywhere, on one line or on many; see :mod:`haulplan.sources.array_blocks`.
    """
    files = _files(spark, paths, pattern)
    if files.where(F.col("length") > max_bytes).isEmpty():
        return None
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "}").text(paths)
    lines = lines.where(F.col("_metadata.file_size") > max_bytes).select(
        F.xxhash64(_part()).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )
    texts, whole = array_texts(lines, BLANKS)
    is_array = F.col("array").isNotNull() & opens_with(F.col("text"), "[")
    parsed = with_json(texts, "text", "array").withColumn("is_array", F.coalesce(is_array, F.lit(False)))
    parsed = stage(parsed.select("file", "offset", "array", "is_array"), "array-texts")
    numbered = _numbered(files).drop("length").withColumn("file", F.xxhash64("part"))
    checked = parsed.groupBy("file").agg(F.min("is_array").alias("is_array")).join(whole, "file").join(numbered, "file")
    elements = parsed.select("file", "offset", F.posexplode(F.try_variant_get("array", "$", "array<variant>")).alias("position", "object"))
    placed = elements.where(is_object(F.col("object"))).join(numbered, "file")
    objects = placed.select("part", "part_number", _seq(F.col("offset") + F.col("position")), "object")
    return objects, checked.select("part", (F.col("is_array") & F.col("whole")).alias("is_array"))


def read_json_arrays(spark: SparkSession, paths: str | list[str], max_bytes: int = MAX_ARRAY_BYTES) -> DataFrame:
    """Files that each hold one JSON array; anything else in a file is an error, found by any action that reads rows."""
    refused = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("part")))
    is_array = opens_with(F.col("text"), "[") & F.col("array").isNotNull()
    parsed = with_json(_whole_files(spark, paths, max_bytes).where("text IS NOT NULL"), "text", "array")
    arrays = parsed.withColumn("array", F.when(is_array, F.col("array")).otherwise(refused.cast("variant")))
    small = explode_arrays(arrays.drop("text", "part"))
    large = read_large_arrays(spark, paths, max_bytes)
    if large is None:
        return small
    objects, checked = large
    bad = checked.where(F.when(F.col("is_array"), False).otherwise(refused.cast("boolean")))
    none = bad.select(F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("variant").alias("object"))
    return small.unionByName(objects.select("seq", "object")).union(none)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse the column ``value``; blank lines are skipped, bad JSON fails, non-objects are dropped."""
    parsed = with_json(lines.where(~is_blank(F.col("value"))), "value", "object")
    refused = F.raise_error(F.concat(F.lit("not JSON: "), F.col("value"))).cast("boolean")
    is_kept = F.when(F.col("object").isNull(), refused).otherwise(opens_with(F.col("value"), "{"))
    return parsed.where(is_kept).drop("value")


def order_lines(lines: DataFrame) -> DataFrame:
    """Give staged rows ``file, block, row`` a ``seq`` in file-name and line order.

    ``row`` rises inside a block.  One narrow aggregate finds the first and the
    last row of each block; blocks are summed inside their file, and files, one row each,
    in one place.  The starts are written, so that its true size decides whether
    it is broadcast to the rows.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    blocks = blocks.withColumn("rows", F.col("last") - F.col("first") + 1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("rows").alias("rows"))
    of_files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(of_files), F.lit(0)).alias("before"))
    before = F.col("before") + F.coalesce(F.sum("rows").over(in_file), F.lit(0))
    starts = blocks.join(files, "file").select("file", "block", (before - F.col("first")).alias("start"))
    placed = lines.join(stage(starts, "blocks"), ["file", "block"])
    return placed.select(
        (F.col("start") + F.col("row")).alias("seq"), *[c for c in lines.columns if c not in ("file", "block", "row")]
    )


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def read_ndjson(spark: SparkSession, paths: str | list[str], ordered: bool = True) -> DataFrame:
    """Newline-delimited JSON objects.

    With ``ordered`` the parsed rows are written once to the staging folder, so
    that the order numbers cannot change between two evaluations.  Totals and
    histograms need no order and skip that step.
    """
    if not ordered:
        return parse_lines(spark.read.text(paths))
    return order_lines(stage(parse_lines(_lines(spark, paths)), "lines"))


def array_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: ``file`` and whether its first non-blank character opens an array."""
    head = _lines(spark, paths).where((F.col("block") == 0) & ~is_blank(F.col("value")))
    return head.groupBy("file").agg(F.min_by(opens_with(F.col("value"), "["), "row").alias("is_array"))


def as_path(uri: str) -> str:
    """Path of a scanned file, with the characters of patterns taken as they are."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(uri))


def read_listing(spark: SparkSession, paths: str | list[str], ordered: bool = True, form: str = "auto") -> DataFrame:
    """Files of either form, told apart by their first character.

    Array files come first in ``seq``.  Detection reads the files once more, so
    name the form (``array`` or ``ndjson``) of a large listing if it is known.
    """
    if form == "array":
        return read_json_arrays(spark, paths)
    if form == "ndjson":
        return read_ndjson(spark, paths, ordered)
    if form != "auto":
        raise ValueError(f"form must be auto, array or ndjson: {form!r}")
    forms = array_files(spark, paths).collect()  # one row per listing file
    arrays, others = ([as_path(row.file) for row in forms if row.is_array is is_array] for is_array in (True, False))
    scans = [read_json_arrays(spark, arrays)] if arrays else []
    if others:
        lines = read_ndjson(spark, others, ordered)
        if ordered:
            behind = F.shiftleft(F.lit(len(arrays)).cast("bigint"), PART_SHIFT)
            lines = lines.withColumn("seq", F.col("seq") + behind)
        scans.append(lines)
    if not scans:
        return parse_lines(spark.createDataFrame([], "seq bigint, value string"))
    if not ordered:
        scans = [scan.select("object") for scan in scans]
    return scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])


def read_parts(
    spark: SparkSession, parts_dir: str, pattern: str = "lsjson-*.json", max_bytes: int = MAX_ARRAY_BYTES
) -> DataFrame:
    """Part files of a folder: ``part, part_number, prefix, text``.

    A part ``x.json`` may have a sidecar ``x.prefix`` whose stripped text is put
    before its paths.  No part at all is an error.  The text of a part above the
    limit is null; see :func:`read_large_parts`.
    """
    if not _files(spark, parts_dir, pattern).inputFiles():
        raise FileNotFoundError(f"no part files {pattern} in {parts_dir}")
    return _with_prefixes(_whole_files(spark, parts_dir, max_bytes, pattern), parts_dir)


def read_large_parts(
    spark: SparkSession, parts_dir: str, pattern: str = "lsjson-*.json", max_bytes: int = MAX_ARRAY_BYTES
) -> tuple[DataFrame, DataFrame] | None:
    """Objects (``part, part_number, prefix, seq, object``) and rejected parts of those above the limit, None without any."""
    large = read_large_arrays(spark, parts_dir, max_bytes, pattern)
    if large is None:
        return None
    objects, checked = large
    good = objects.join(stage(checked.where("is_array").select("part"), "good"), "part", "left_semi")
    rejected = checked.where(~F.col("is_array")).select(_file_name(), F.lit("not a JSON array").alias("reason"))
    return _with_prefixes(good, parts_dir), rejected


def _file_name() -> Column:
    return F.element_at(F.split("part", "/"), -1).alias("part")


def _with_prefixes(parts: DataFrame, parts_dir: str) -> DataFrame:
    named = parts.withColumn("part", _file_name())
    prefixes = read_prefixes(parts.sparkSession, parts_dir)
    others = [name for name in parts.columns if name not in ("part", "part_number")]
    return named.join(prefixes, file_stem(F.col("part")) == F.col("stem"), "left").select(
        "part", "part_number", F.coalesce("prefix", F.lit("")).alias("prefix"), *others
    )


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_prefixes(spark: SparkSession, parts_dir: str, parts: list[str] | None = None) -> DataFrame:
    """Sidecars of a folder: ``stem, prefix``.

    With up to ``LOOKUPS`` names of ``parts`` only their sidecars are looked for, and the folder is not listed.
    """
    if parts is None or len(parts) > LOOKUPS or re.search(r"[*?\[\]{}\\]", parts_dir):
        sidecars = spark.read.option("pathGlobFilter", "*.prefix").text(parts_dir, wholetext=True)
    else:
        paths = [spark._jvm.org.apache.hadoop.fs.Path(parts_dir, unquote(stem) + ".prefix") for stem in {re.sub(r"\.[^.]*$", "", p) for p in parts}]
        files = spark._jvm.org.apache.hadoop.fs.Path(parts_dir).getFileSystem(spark._jsc.hadoopConfiguration())
        found = [as_path(path.toUri().toString()) for path in paths if files.exists(path)]
        if not found:
            return spark.range(0).where("false").select(F.lit("").alias("stem"), F.lit("").alias("prefix"))  # a join with it is planned away
        sidecars = spark.read.text(found, wholetext=True)
    return sidecars.select(
        file_stem(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("stem"),
        stripped("value").alias("prefix"),
    )


def stripped(text: str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_parts(parts: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed parts and rejected parts (``part, reason``).

    A part that is no JSON, no array, or too large to be read, is left out and reported.  With ``written``
    the parsed parts are staged, so that using both results parses the texts once.
    """
    opens = F.coalesce(opens_with(F.col("text"), "["), F.lit(False))
    parsed = with_json(parts, "text", "array").withColumn("opens", opens).withColumn("missing", F.col("text").isNull()).drop("text")
    parsed = stage(parsed, "parsed") if written else parsed
    is_array = F.col("opens") & F.col("array").isNotNull()
    reason = F.when(F.col("missing"), "too large").when(F.col("array").isNull(), "not JSON").otherwise("not a JSON array")
    return parsed.where(is_array).drop("opens", "missing"), parsed.where(~is_array).select("part", reason.alias("reason"))
