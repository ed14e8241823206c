"""Removal of every byte covered by a long string that also starts elsewhere.

A string of ``LENGTH`` bytes is known by where it starts.  Starts are refined in
rounds, from intervals of starts down to single ones, without sorting suffixes:

* Each start has an anchor, the position of the smallest hash of ``GRAM`` bytes in
  its string (the last one of equals).  Equal strings have equal anchors at equal
  distances.  Starts with one anchor and distances in one cell of a fixed grid are
  an interval.  All its strings share their common bytes, the interval's core.
* An interval whose core occurs once holds no repeated start.  An interval whose
  whole text occurs again, at the same distances, is repeated as a whole.
* What is neither is cut by the next, finer grid, among intervals with the same
  core only; on the last grid an interval is one start, and its core the string.

Only hashes are counted, with pre-aggregation, so a text that a third of all
documents hold is as cheap as any other.  Equality is that of two independent
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import BYTE_VALUES, discard, find_package, mix, powers, table, text_slices
from haulplan.staging import stage

LENGTH = 400
GRAM = 16
GRIDS = (193, 32, 1)  # starts an interval of each round spans at most

_SECOND = mix(BYTE_VALUES + np.uint64(0x632BE59BD9B4E019))
_PLACE = np.uint64((1 << 26) - 1)


class Ranges:
    """Hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        self.forth, self.back = powers(len(data) + 1)
        self.sums = []
        for values in (BYTE_VALUES, _SECOND):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * self.forth[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def get(self, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
        sums = self.sums[second]
        return mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def anchors(ranges: Ranges, size: int, length: int) -> np.ndarray:
    """Anchor of the string at each start of a slice (strings that run over the end of a text included)."""
    grams = np.arange(max(0, size - GRAM + 1))
    keys = (ranges.get(grams, grams + GRAM) & ~_PLACE) | (_PLACE - (grams.astype(np.uint64) & _PLACE))
    window, done = length - GRAM + 1, 1
    while done < window:  # minima of windows twice as long, up to the wanted width
        step = min(done, window - done)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        done += step
    base = np.arange(len(keys))
    return base + ((_PLACE - (keys & _PLACE)).astype(np.int64) - base & int(_PLACE))


def intervals(ranges: Ranges, starts: np.ndarray, anchor: np.ndarray, grid: int, length: int) -> dict[str, np.ndarray]:
    """Intervals of ascending ``starts``: first start, number of starts, hash of the core, two of the whole text."""
    cell = (anchor - starts) // grid
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (np.diff(starts) != 1) | (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(starts)))
    first = starts[at]
    core = anchor[at] - cell[at] * grid
    last = first + count - 1 + length
    salt = cell[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor[at] - first).astype(np.uint64)
    return {
        "first": first,
        "starts": count,
        "anchor": anchor[at],
        "core": mix(ranges.get(core, core + length - grid + 1) + cell[at].astype(np.uint64)),
        "whole": mix(ranges.get(first, last) ^ salt),
        "again": mix(ranges.get(first, last, True) + salt),
    }


_KEY = ["doc_id", "text_key"]


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, text``: equal rows have equal keys and share their results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("text_key"), text.alias("text"))


_PIECE = "doc_id bigint, text_key bigint, first int, starts int, anchor int, core bigint, whole bigint, again bigint"


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def first_intervals(rows: DataFrame, length: int) -> DataFrame:
    """Intervals of all texts on the coarsest grid."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch):
                if len(data) < length:
                    continue
                ranges = Ranges(data)
                anchor = anchors(ranges, len(data), length)
                starts = np.arange(len(anchor))
                of = np.searchsorted(bounds, starts, "right") - 1
                inside = starts + length <= bounds[of + 1]
                found = intervals(ranges, starts[inside], anchor[inside], GRIDS[0], length)
                of = of[found["first"]]
                base = bounds[of]
                columns = [batch.column(c).slice(lo, hi - lo).take(pa.array(of)) for c in _KEY]
                columns += [pa.array((found["first"] - base).astype(np.int32)), pa.array(found["starts"].astype(np.int32))]
                columns += [pa.array((found["anchor"] - base).astype(np.int32)), *[_signed(found[c]) for c in ("core", "whole", "again")]]
                yield pa.RecordBatch.from_arrays(columns, [*_KEY, "first", "starts", "anchor", "core", "whole", "again"])

    return rows.mapInArrow(read, _PIECE)


_FINER = "ctx bigint, weight bigint, first int, starts int, core bigint, whole bigint, again bigint"


def finer_intervals(contexts: DataFrame, grid: int, length: int) -> DataFrame:
    """Intervals of the contexts' starts on a finer grid; ``first`` counts from the context's beginning."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch, "bytes"):
                ranges = Ranges(data)
                count = batch.column("starts").slice(lo, hi - lo).to_numpy()
                reach = batch.column("reach").slice(lo, hi - lo).to_numpy()
                of = np.repeat(np.arange(hi - lo), count)
                begin = np.concatenate([[0], np.cumsum(count)[:-1]])
                starts = bounds[of] + np.arange(len(of)) - begin[of]
                found = intervals(ranges, starts, bounds[of] + reach[of], grid, length)
                of = np.searchsorted(bounds, found["first"], "right") - 1
                columns = [batch.column(c).slice(lo, hi - lo).take(pa.array(of)) for c in ("ctx", "weight")]
                columns += [pa.array((found["first"] - bounds[of]).astype(np.int32)), pa.array(found["starts"].astype(np.int32))]
                columns += [_signed(found[c]) for c in ("core", "whole", "again")]
                yield pa.RecordBatch.from_arrays(columns, ["ctx", "weight", "first", "starts", "core", "whole", "again"])

    return contexts.select("ctx", "weight", "starts", "reach", "bytes").mapInArrow(read, _FINER)


_TEXT = ["core", "whole", "again"]


def refine(found: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """Intervals that are repeated as a whole, and one of each text among cores that are met with several texts.

    ``found`` is a written table with ``weight`` occurrences per row.
    """
    busy = found.groupBy("core").agg(F.sum("weight").alias("weight")).where("weight > 1").select("core")
    met = stage(found.join(stage(busy, "cores"), "core"), "met")
    one = F.min(F.struct(*place)).alias("place")
    texts = stage(met.groupBy(*_TEXT).agg(F.sum("weight").alias("weight"), one), "texts")
    twice = stage(texts.where("weight > 1").select(*_TEXT), "twice")
    repeated = met.join(twice, _TEXT)
    several = stage(texts.groupBy("core").agg(F.count("*").alias("texts")).where("texts > 1").select("core"), "several")
    mixed = texts.join(several, "core").select("weight", "place.*")
    return repeated, mixed


def repeated_starts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text_key, first, starts``: all starts of strings that also start elsewhere, as intervals."""
    found = stage(first_intervals(rows, length).withColumn("weight", F.lit(1).cast("bigint")), "intervals")
    where = [*_KEY, "first", "starts", "anchor"]
    repeated, mixed = refine(found, where)
    results = [stage(repeated.select(*_KEY, "first", "starts"), "repeated")]
    discard(found)  # its repeated cores are written
    wanted = stage(mixed, "mixed").withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_key")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    part = F.expr(f"substring(cast(text as binary), first + 1, starts + {length - 1})")
    contexts = rows.join(wanted.hint("shuffle_hash"), same).select(
        *_KEY, "first", "starts", "weight", (F.col("anchor") - F.col("first")).alias("reach"), part.alias("bytes")
    )
    for depth, grid in enumerate(GRIDS[1:], 1):
        contexts = stage(contexts.withColumn("ctx", F.monotonically_increasing_id()), "contexts")
        found = stage(finer_intervals(contexts, grid, length), "intervals")
        repeated, mixed = refine(found, ["ctx", "first", "starts"])
        known = contexts.select("ctx", *_KEY, F.col("first").alias("_from"))
        placed = repeated.where("weight = 1").join(known, "ctx")
        results.append(stage(placed.select(*_KEY, (F.col("_from") + F.col("first")).cast("int").alias("first"), "starts"), "repeated"))
        if depth < len(GRIDS) - 1:
            parts = stage(mixed, "mixed").select("ctx", "weight", F.col("first").alias("_skip"), F.col("starts").alias("_starts"))
            contexts = contexts.drop("weight").join(parts, "ctx").select(
                *_KEY,
                (F.col("first") + F.col("_skip")).cast("int").alias("first"),
                F.col("_starts").alias("starts"),
                "weight",
                (F.col("reach") - F.col("_skip")).cast("int").alias("reach"),
                F.expr(f"substring(bytes, _skip + 1, _starts + {length - 1})").alias("bytes"),
            )
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary, kept_sha256 string"


def cut_repeats(rows: DataFrame, repeats: DataFrame, length: int) -> DataFrame:
    """Take the strings at the given starts out of the texts."""
    runs = repeats.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(
        F.collect_set(F.struct("first", "starts")).alias("runs")  # no more than the text has bytes
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                data, spans = text.encode(), []
                for run in sorted((r["first"], r["first"] + r["starts"] - 1 + length) for r in runs or ()):
                    if spans and run[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], run[1])
                    else:
                        spans.append(list(run))
                edges = [0, *[e for span in spans for e in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                spans = [{"begin": a, "end": b} for a, b in spans]
                out.append((doc, len(data), len(data) - len(kept), spans, kept, sha256(kept).hexdigest()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
                names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.join(runs.hint("shuffle_hash"), same, "left").select("doc_id", "text", "runs").mapInArrow(cut, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` (bytes), ``kept_sha256`` of every row of ``docs``.

    ``spans`` are the maximal removed runs.  A null text counts as empty.  A
    repeated row counts as another place, so both lose what they share.  The kept
    bytes may cut a character of several bytes.  An empty table gives no rows.
    """
    if length <= GRIDS[0] + GRAM:
        raise ValueError(f"strings must be longer than {GRIDS[0] + GRAM} bytes: {length}")
    find_package(docs.sparkSession)
    rows = with_key(docs)
    return cut_repeats(rows, repeated_starts(rows, length), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without strings of 400 bytes that occur twice."""
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
