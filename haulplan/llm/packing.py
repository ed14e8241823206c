"""Best-fit packing of token pieces into sequences of fixed length.

Lengths are whole numbers up to the capacity, so the plan is made on counts per
length, a table bounded by the capacity whatever the corpus:

1. lengths above ``SMALL_SHARE`` of the capacity are sorted and cut into groups of
   equal cardinality, each rounded up to its largest length (linear grouping);
2. column generation finds configurations of the few rounded lengths, and whole
   multiples of them are taken; what is left over is put best-fit;
3. actual pieces replace the rounded ones, largest first inside a group, which
   leaves runs of sequences with the same free space;
4. small lengths go best-fit, longest first, into the free space and new sequences.

The plan is a list of runs: "pieces number a to b of length s go to sequences q,
q+1, ... at offset o".  A piece finds its run from its length and its number among
the pieces of that length.  Pieces are numbered per hash chunk and moved by the
chunks before, so neither a hot length nor a hot source meets in one task.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulplan.llm.common import find_package, released, table, vocabulary
from haulplan.staging import stage

CAPACITY = 1024
GROUPS = 96
SMALL_SHARE = 8  # lengths up to capacity / SMALL_SHARE count as small
END_ID = 2  # token that ends a document
CHUNK_ROWS = 1 << 18  # pieces numbered by one task and length

# ---- pieces -----------------------------------------------------------------------------------------------

#: Pieces of text whose ids a worker remembers; more are tokenized each time they occur.
REMEMBERED = 300_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern always starts a new token before a space that a
    letter or sign follows, so texts are cut there and repeated parts looked up.
    New parts in plain Latin letters and signs go through a faster library that
    is given the ranks of the same file; all others through ``tokenizers``.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        signs = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        signs |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in signs.values())}
        entries = self.library.get_vocab(with_added_tokens=False).items()
        ranks = {bytes(signs[c] for c in entry): rank for entry, rank in entries if entry not in self.special}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.odd = regex.compile(r" (?![!-~¡-ɏ])")  # a space that may belong to what stands before
        self.cut = regex.compile(r"(?= [!-~¡-ɏ])")
        self.latin = regex.compile(r"[ -~\n¡-ɏ]*")

    def word(self, word: str) -> bytes:
        if self.latin.fullmatch(word) and not any(s in word for s in self.special):
            return array("I", self.plain(word)).tobytes()
        return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if self.odd.search(text):
                words = [w for w in self.cut.split(text) if w]
            else:
                first, *rest = text.split(" ")
                words = [first, *[" " + w for w in rest]]
            try:
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                parts = []
                for w in words:
                    found = known.get(w)
                    if found is None:
                        found = self.word(w)
                        if len(known) < REMEMBERED:
                            known[w] = found
                    parts.append(found)
                out.append(b"".join(parts))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def runs_of_texts(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` characters together, one text at least."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of the tokenized documents: doc_id, piece, start, length, ids_crc32, and the ids on request.

    A null text counts as empty; every document ends with ``END_ID``, so it has a
    piece.  A document beyond the capacity is cut so that all pieces but the
    first are full.  Repeated rows are packed as often as they occur.
    """
    find_package(docs.sparkSession)
    shown = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in released(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in runs_of_texts(texts):
                rows = []
                for doc, data in zip(ids[lo:hi], tokens.ids(texts[lo:hi])):
                    data += END_ID.to_bytes(4, "little")
                    total = len(data) // 4
                    start, end = 0, (total - 1) % capacity + 1
                    for piece in range(-(-total // capacity)):
                        part = data[4 * start : 4 * end]
                        rows.append((doc, piece, start, end - start, zlib.crc32(part), *([part] if keep_ids else [])))
                        start, end = end, end + capacity
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, shown)


# ---- plan on counts per length ----------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], last[room] = best[room - 1], -1
        fit = int(np.searchsorted(sizes, room, "right"))
        if fit:
            worth = best[room - sizes[:fit]] + values[:fit]
            k = int(worth.argmax())
            if worth[k] > best[room] + 1e-12:
                best[room], last[room] = worth[k], k
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole multiples of them that stay within the demand, from the fractional optimum.

    Column generation with an explicit basis inverse; sizes rise.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        inverse = np.linalg.inv(basis)
        use = np.maximum(inverse @ demand, 0)
    left, chosen = demand.astype(np.int64).copy(), []
    for k in np.argsort(-use):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(use[k] + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            chosen.append((pattern, times))
            left -= times * pattern
    for k in range(n - 1, -1, -1):  # the rest: fullest patterns that the rest still allows
        while left[k] > 0:
            pattern, room = np.zeros(n, np.int64), capacity
            for j in range(k, -1, -1):
                pattern[j] = min(int(left[j]), room // int(sizes[j]))
                room -= int(pattern[j] * sizes[j])
            times = int((left[pattern > 0] // pattern[pattern > 0]).min())
            chosen.append((pattern, times))
            left -= times * pattern
    return chosen


class Plan:
    """Runs of pieces of one length: number, first sequence, offset; ``each`` pieces of the run share a sequence."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, number of the first, sequence, offset, each
        self.sequences = 0


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Plan for the given number of pieces of each length (1 to the capacity)."""
    plan, done = Plan(), dict.fromkeys(counts, 0)
    space: list[tuple[int, int, int]] = []  # free, first sequence, number of sequences

    def put(length: int, sequence: int, used: int, bins: int, each: int) -> None:
        plan.runs.append((length, done[length], sequence, used, each))
        done[length] += bins * each

    if counts.get(capacity):
        put(capacity, 0, 0, counts[capacity], 1)
        plan.sequences = counts[capacity]
    large = sorted((s for s in counts if capacity // SMALL_SHARE < s < capacity and counts[s]), reverse=True)
    if large:
        ranks = np.cumsum([counts[s] for s in large])  # group of a length: where its last piece falls
        per_group = -(-int(ranks[-1]) // groups)
        members: dict[int, list[int]] = {}
        for s, upto in zip(large, ranks):
            members.setdefault((int(upto) - 1) // per_group, []).append(s)
        grouped = [members[g] for g in sorted(members, reverse=True)]  # rounded lengths rise
        sizes = np.array([max(g) for g in grouped])
        demand = np.array([sum(counts[s] for s in g) for g in grouped], float)
        stock = [[[s, counts[s]] for s in sorted(g, reverse=True)] for g in grouped]
        for pattern, times in configurations(sizes, demand, capacity):
            runs = [(plan.sequences, times, 0)]
            plan.sequences += times
            for k in np.flatnonzero(pattern)[::-1]:
                for _ in range(int(pattern[k])):
                    after = []
                    for sequence, bins, used in runs:
                        while bins:
                            s, left = stock[k][0]
                            some = min(bins, left)
                            put(s, sequence, used, some, 1)
                            after.append((sequence, some, used + s))
                            sequence, bins = sequence + some, bins - some
                            stock[k][0][1] -= some
                            if not stock[k][0][1]:
                                stock[k].pop(0)
                    runs = after
            space += [(capacity - used, sequence, bins) for sequence, bins, used in runs if used < capacity]
    space.sort()
    for s in sorted((s for s in counts if s <= capacity // SMALL_SHARE and s < capacity), reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(space, (s, -1, -1))
            if at < len(space):
                free, sequence, bins = space.pop(at)
            else:
                free, sequence, bins = capacity, plan.sequences, -(-left // (capacity // s))
                plan.sequences += bins
            each = min(free // s, left)
            some = min(bins, left // each)
            put(s, sequence, capacity - free, some, each)
            left -= some * each
            for rest, first, number in ((free - each * s, sequence, some), (free, sequence + some, bins - some)):
                if number and rest:
                    insort(space, (rest, first, number))
    return plan


# ---- whole operator ---------------------------------------------------------------------------------------


def number_by_length(pieces: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Add ``number``: 0-based and dense among the pieces of a length."""
    chunks = max(16, -(-rows // CHUNK_ROWS))
    chunked = pieces.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = stage(chunked.groupBy("length", "_chunk").agg(F.count("*").alias("_rows")), "lengths")
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*order)) - 1
    return (
        chunked.withColumn("_inside", inside)
        .join(starts, ["length", "_chunk"])
        .withColumn("number", F.col("_start") + F.col("_inside"))
        .drop("_chunk", "_inside", "_start")
    )


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` of 1 to the capacity.

    ``order`` names columns that tell pieces apart; rows equal in all of them are
    interchangeable.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    find_package(spark)
    pieces = stage(pieces, "pieces")
    found = pieces.groupBy("length").agg(F.count("*").alias("rows")).toArrow()  # at most `capacity` rows
    counts = dict(zip(found["length"].to_pylist(), found["rows"].to_pylist()))
    plan = make_plan(counts, capacity, groups)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    width = 44  # bits for the number inside a length
    keys = (runs[:, 0] << width) | runs[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length, number = frame["length"].to_numpy(np.int64), frame["number"].to_numpy(np.int64)
            at = np.searchsorted(keys, (length << width) | number, "right") - 1
            inside, each = number - runs[at, 1], runs[at, 4]
            frame["sequence_id"] = runs[at, 2] + inside // each
            frame["offset"] = runs[at, 3] + inside % each * length
            yield frame.drop(columns="number")

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    numbered = number_by_length(pieces, order, sum(counts.values()))
    return numbered.select(*pieces.columns, "number").mapInPandas(place, T.StructType([*pieces.schema.fields, *added]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    pieces = token_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pack(pieces, ["doc_id", "piece", "ids_crc32"])
