"""Quality rules: basic counts of a text, and lines that many documents of a host share.

One vectorised pass over the texts gives the basic counts and the hash of every
normalised line (letter case folded, digits alike, white space single).  For each
host (``source``) the distinct texts that hold a line are counted; copies of a text
count once, so a clean text is not rejected for being copied.  Lines above the
host's limit are taken out, and a document that keeps too few of its words is
rejected.  Counts are pre-aggregated and only lines above a limit are joined back,
so neither a hot host nor a hot line gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import BYTE_VALUES, FOLDED_VALUES, Words, find_package, mix, range_hashes, sums_by_text, table, text_slices, windows
from haulplan.staging import stage

MIN_WORDS = 10  # a text with fewer words fails
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20  # share of words in repeated windows above which a text fails
LINE_SHARE = 0.02  # of a host's distinct texts that may hold a line
LINE_LEAST = 20  # texts that may hold a line at any host
KEPT_SHARE = 0.5  # of its words that a document must keep

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    _, where, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[where] > 1


def text_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts per text of a slice; text, hash and words of each distinct normalised line; hash of each text."""
    words, texts = Words(data, bounds), len(bounds) - 1
    owner = words.owner()
    out = {"n_words": words.counts()}
    out["word_chars"] = sums_by_text(words.solid & ((data & 0xC0) != 0x80), bounds)
    out["n_symbols"] = sums_by_text(_SYMBOLS[data], bounds)

    starts, hashes = windows(words.hashes(), words.first, REPEAT_WINDOW)
    again = starts[_repeated(mix(hashes + owner[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))] if len(starts) else starts
    edges = np.zeros(len(owner) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(edges)[: len(owner)] > 0
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=texts)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    nexts = np.append(line_starts[1:], len(data))
    line_ends = nexts - (data[nexts - 1] == 10) if len(line_starts) else nexts[:0]
    first = np.searchsorted(words.starts, line_starts)
    last = np.searchsorted(words.starts, nexts)
    full = last > first
    line_starts, line_ends, first, last = line_starts[full], line_ends[full], first[full], last[full]
    of = np.searchsorted(bounds, line_starts, "right") - 1
    salt = of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    raw = mix(range_hashes(BYTE_VALUES[data], line_starts, line_ends) + salt)
    out["n_dup_lines"] = np.bincount(of, minlength=texts) - np.bincount(of[np.unique(raw, return_index=True)[1]], minlength=texts)

    lines = range_hashes(words.hashes(FOLDED_VALUES), first, last)
    _, kept, same = np.unique(mix(lines + salt), return_index=True, return_inverse=True)
    line_words = np.bincount(same, weights=last - first, minlength=len(kept)).astype(np.int64)
    whole = range_hashes(BYTE_VALUES[data], bounds[:-1], bounds[1:])
    return out, of[kept], lines[kept], line_words, whole


def text_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, source``, the basic counts, a hash of the text, and ``lines`` (hash, words) of every row."""
    find_package(docs.sparkSession)
    line = pa.struct([("line", pa.int64()), ("words", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch):
                counts, of, lines, line_words, whole = text_counts(data, bounds)
                order = np.argsort(of, kind="stable")
                offsets = np.searchsorted(of[order], np.arange(hi - lo + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(lines[order].view(np.int64)), pa.array(line_words[order])], fields=list(line))
                columns = [batch.column("doc_id").slice(lo, hi - lo), batch.column("source").slice(lo, hi - lo)]
                columns += [pa.array(counts[c].astype(np.int64)) for c in _COLUMNS]
                columns += [pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", *_COLUMNS, "text_hash", "lines"])

    schema = f"doc_id bigint, source string, {', '.join(f'{c} bigint' for c in _COLUMNS)}, text_hash bigint, lines array<struct<line: bigint, words: bigint>>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, schema)


def common_lines(facts: DataFrame, share: float = LINE_SHARE, least: int = LINE_LEAST) -> DataFrame:
    """``host, line`` of the lines that more of a host's distinct texts hold than its limit."""
    lines = facts.select(F.coalesce("source", F.lit("")).alias("host"), "text_hash", F.explode("lines.line").alias("line"))
    held = lines.distinct().groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > least)
    hosts = facts.select(F.coalesce("source", F.lit("")).alias("host"), "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all_texts"))
    return held.join(hosts, "host").where(F.col("texts") > share * F.col("all_texts")).select("host", "line", "texts")


def judge(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_LEAST, kept_share: float = KEPT_SHARE) -> DataFrame:
    """Counts and verdict of every row of ``docs``: doc_id, the counts, ``kept_words``, ``base_failed``, ``kept``.

    A null text has no words and fails.  A null source is a host of its own, the
    empty name.  Repeated rows are judged alike.  An empty table gives no rows.
    """
    facts = stage(text_facts(docs).withColumn("row", F.monotonically_increasing_id()), "facts")
    common = stage(common_lines(facts, share, least), "common")
    lines = facts.select("row", F.coalesce("source", F.lit("")).alias("host"), F.explode("lines").alias("l")).select("row", "host", "l.*")
    lost = stage(lines.join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost")), "lost")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    repeats = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    judged = facts.drop("lines", "text_hash", "source").join(lost, "row", "left")
    judged = judged.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats).withColumn("kept_words", left)
    rich = (F.col("kept_words") >= MIN_WORDS) & (F.col("kept_words") >= kept_share * F.col("n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & rich).drop("row", "lost")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents."""
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")
