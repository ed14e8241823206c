"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a vectorised step holds at once; a longer text forms a step of its own.
SLICE_BYTES = 1 << 19

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from any working directory.

    On a cluster the package is shipped as usual (``--py-files`` or an image).
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def short_arrow_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, and those of Parquet readers, since texts are long: an executor holds several at once, in the JVM and in its workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")


def discard(staged: DataFrame) -> None:
    """Remove a written intermediate table that no later step reads."""
    spark = staged.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in staged.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(batches: Iterator) -> Iterator:
    """The batches of a task; what a finished one leaves in Arrow's pool goes back to the system, since workers outlive tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def short_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few rows at a time become Python objects."""
    for batch in released(batches):
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def runs_of_bytes(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and end row of runs of rows with at most ``limit`` bytes in all; a larger row is a run of its own."""
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > limit:
            yield first, row
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a batch in runs of at most ``limit`` bytes of text: first row, end row, UTF-8 bytes, text bounds.

    Nulls count as empty texts.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


# ---- hashes of byte ranges, by prefix sums modulo 2**64 -------------------------------------------------

_U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all others."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: A random value for each byte; the second table folds letter case and takes every digit for 0.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U64(0xD6E8FEB86659FD93))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
FOLDED_VALUES = BYTE_VALUES[_FOLD]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, at least ``count`` of each."""
    if len(_powers[0]) < count:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(count + (count >> 2), _U64(base))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each range."""
    forth, back = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts of one slice; ``first[i]:first[i + 1]`` are those of text ``i``.

    ``white`` marks other bytes that part words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, white: np.ndarray = _WHITE):
        self.data, self.bounds = data, bounds
        solid = ~white[data]
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner] = False
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        after[inner - 1] = False
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        return range_hashes(values[self.data], self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word windows that stay inside their text: first word of each, and its hash."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = len(hashes) - width + 1
    inside = np.ones(total, bool)
    for back in range(1, width):  # a window must not reach over the start of a later text
        at = first[1:-1] - back
        inside[at[(at >= 0) & (at < total)]] = False
    starts = np.flatnonzero(inside)
    value = np.zeros(len(starts), np.uint64)
    for k in range(width):
        value = (value ^ hashes[starts + k]) * _U64(0x9FB21C651E98DF25)
        value ^= value >> _U64(29)
    return starts, mix(value)


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values in each text's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
