"""SimHash near-duplicates: fingerprints, links by pivot distance tables, components.

Every distinct fingerprint gets a table of Hamming distances to fixed reference
fingerprints (pivots).  By the triangle inequality two fingerprints whose tables
differ by more than the allowed distance in any coordinate cannot link, so only
pairs within it in all coordinates are compared bit by bit.

Pairs are only looked at inside buckets.  Two fingerprints of 64 bits that differ
in at most two bits agree in two of four blocks of 16 bits, so six buckets per
fingerprint meet every link.  A bucket above ``BUCKET`` members is cut again by
two of four blocks of the 32 free bits, then of the 16 free bits; after that it
holds at most 256 distinct fingerprints.  No bucket is skipped or shortened, and a
bucket emits the edges of a spanning forest instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import find_package, mix, released, table
from haulplan.llm.components import components
from haulplan.staging import stage

SHINGLE = 3
DISTANCE = 2  # the blocks below reach every link up to this
PIVOTS = 16
BUCKET = 64
SEED = 42

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def simhash(text: str, width: int = SHINGLE) -> int:
    """Fingerprint of a text, unsigned; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()  # bytes split at ASCII white space only
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[lo : lo + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_class, bits`` (a hash of the text, the fingerprint as a signed integer) of every row; a null text counts as empty."""
    find_package(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            bits = np.array([simhash(t, width) if t else 0 for t in batch.column("text").to_pylist()], np.uint64)
            columns = [batch.column("doc_id"), batch.column("text_class"), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_class", "bits"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_class", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.mapInArrow(hashed, "doc_id bigint, text_class bigint, bits bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _finer(mask: int) -> list[int]:
    """Masks that add two of four blocks of the free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // 4
    blocks = [sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(4)]
    return [mask | x | y for x, y in combinations(blocks, 2)]


#: Masks of the three depths; those of a depth continue each mask of the one before in order.
MASKS = [_finer(0)]
for _ in range(2):
    MASKS.append([finer for mask in MASKS[-1] for finer in _finer(mask)])


def forest(bits: np.ndarray, tables: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that span the links among the members of one bucket."""
    n = len(bits)
    apart = np.abs(tables[:, None, :] - tables[None, :, :]).max(axis=2)
    left, right = np.nonzero(np.triu(apart <= distance, 1))
    near = np.bitwise_count(bits[left] ^ bits[right]) <= distance
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    edges = []
    for a, b in zip(left[near].tolist(), right[near].tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def bucket_edges(members: DataFrame, distance: int) -> DataFrame:
    """Edges of all buckets; rows of a bucket lie together and in order in their partition."""

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = pd.concat([held, frame]) if held is not None else frame
            keys = frame[["mask", "part"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            yield edges_of(frame.iloc[:done], [0, *cuts.tolist()] if len(cuts) else [0])
            held = frame.iloc[done:]
        if held is not None:
            yield edges_of(held, [0, len(held)])

    def edges_of(frame: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        bits = frame["bits"].to_numpy(np.int64)
        found = []
        if len(frame):
            tables = np.stack(frame["distances"].to_numpy()).astype(np.int16)
            for lo, hi in zip(cuts, cuts[1:]):
                found += [(bits[lo + a], bits[lo + b]) for a, b in forest(bits[lo:hi].view(np.uint64), tables[lo:hi], distance)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    together = members.repartition("mask", "part").sortWithinPartitions("mask", "part", "bits")
    return together.mapInPandas(linked, "a bigint, b bigint")


def links(prints: DataFrame, distance: int = DISTANCE, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a, b`` that connect all distinct ``bits`` within the distance (up to 2), without all pairs."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be 0 to {DISTANCE}: {distance}")
    find_package(prints.sparkSession)
    points = mix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    away = [F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(int(p))))).cast("tinyint") for p in points]
    rows = stage(prints.select("bits", F.array(*away).alias("distances")), "pivots")
    masked = rows.select("*", F.explode(F.array(*[_masked(k, m) for k, m in enumerate(MASKS[0])])).alias("_key"))
    edges = None
    for depth, masks in enumerate(MASKS):
        members = masked.select("bits", "distances", "_key.*")
        busy = members.groupBy("mask", "part").agg(F.count("*").alias("members")).where("members > 1")
        members = members.join(stage(busy, "buckets"), ["mask", "part"])
        last = depth == len(MASKS) - 1
        small = members if last else members.where(F.col("members") <= bucket)
        found = stage(bucket_edges(small, distance), "links")
        edges = found if edges is None else edges.union(found)
        if last:
            break
        large = stage(members.where(F.col("members") > bucket).select("bits", "distances", "mask"), "large")
        if large.isEmpty():
            break
        children = [[_masked(6 * k + j, m) for j, m in enumerate(MASKS[depth + 1][6 * k : 6 * k + 6])] for k in range(len(masks))]
        nested = F.array(*[F.array(*c) for c in children])
        masked = large.select("bits", "distances", F.explode(F.element_at(nested, F.col("mask") + 1)).alias("_key"))
    return edges


def _masked(number: int, mask: int):
    return F.struct(F.lit(number).alias("mask"), F.col("bits").bitwiseAND(F.lit(_signed(mask))).alias("part"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, text_class, bits, component, component_id`` of every row of ``docs``.

    ``component`` is a fingerprint that names the component, ``text_class`` a hash of the text, ``component_id`` is the smallest doc_id that links reach, links being at most
    ``distance`` differing bits.  Texts without words share fingerprint 0.  A null
    doc_id keeps its row and counts for no component; a component of such rows
    only has a null one.  Repeated rows stay.  An empty table gives no rows.
    """
    marks = stage(fingerprints(docs, width), "fingerprints")
    prints = stage(marks.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct")
    members = components(links(prints, distance))
    members = members.union(members.select("root", "root").distinct())
    first = members.join(prints, F.col("node") == F.col("bits")).select("bits", "root", "first_id")
    first = stage(first, "members")
    roots = stage(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = first.join(roots, "root").select(F.col("bits").alias("linked"), "root", "component_id")
    lone = F.when(F.col("linked").isNull(), F.col("first_id")).otherwise(F.col("component_id"))
    labels = prints.join(named, F.col("bits") == F.col("linked"), "left").select("bits", F.coalesce("root", "bits").alias("component"), lone.alias("component_id"))
    return marks.join(stage(labels, "labels"), "bits").select("doc_id", "text_class", "bits", "component", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
