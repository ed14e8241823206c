"""Exact top-k inner products by columnar branch and bound.

Vectors become whole numbers, ``floor(64 * x)``, and are packed into blocks in
vertical layout: one row of the block's matrix per dimension, dimensions in groups.
A task takes one block of queries and one of candidates and adds the products
group by group.  The norm of the dimensions still to come bounds what a candidate
can gain (Cauchy-Schwarz).  A first pass over one block of candidates gives every
query a threshold, its k-th best score there; once few candidates can
still reach it, each query goes on with its own survivors, compacted after every
group.  Blocks have a fixed number of rows, every query block meets every candidate
block, and the best of each pair are merged per query.

Sums that doubles cannot hold exactly are taken as estimates with an error bound;
what the bounds leave is scored again in whole numbers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulplan.llm.common import find_package, table
from haulplan.staging import stage

SCALE = 64
TOP = 20
EVERY = 20  # ids divisible by this are queries
CANDIDATES = 8192  # rows of a candidate block
QUERIES = 512  # rows of a query block
GROUP = 16  # dimensions added between two prunings
EXACT = 1 << 53  # whole numbers below this are exact as doubles
WIDEST = 2.0**480  # squares of smaller components have finite sums as doubles
SPARSE = 0.25  # share of candidates in reach from which on each query keeps its own
PROBES = 32  # one query in so many is looked at for that share
MOST_SENT = 1 << 26  # bytes of a candidate block that is broadcast
LONGS = (-(1 << 63), (1 << 63) - 1)


def pack_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` usable vectors: ``ids``, ``owners`` (row numbers), ``dims`` and the matrix.

    ``vectors`` has ``vec_id, embedding`` and a unique ``row``.  Vectors that are
    null or hold null or non-finite components are left out; a shorter one counts
    as filled up with zeros.  The matrix holds 1/64 of the whole numbers, so that they fit every finite component.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row, vec, values in zip(*(batch.column(c).to_pylist() for c in ("row", "vec_id", "embedding"))):
                if values is not None and None not in values:
                    held.append((row, vec, values))
                if len(held) == rows:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held: list) -> pa.RecordBatch:
        width = max(len(v) for _, _, v in held)
        matrix = np.zeros((width, len(held)))
        for k, (_, _, values) in enumerate(held):
            matrix[: len(values), k] = values
        good = np.isfinite(matrix).all(axis=0)
        matrix = matrix[:, good]
        fine = np.abs(matrix) < EXACT
        matrix[fine] = np.floor(SCALE * matrix[fine]) / SCALE  # larger ones are whole numbers
        ids = np.array([-1 if v is None else v for _, v, _ in held], np.int64)[good]
        null = np.array([v is None for _, v, _ in held], bool)[good]
        owners = np.array([r for r, _, _ in held], np.int64)[good]
        columns = [ids.tobytes(), null.tobytes(), owners.tobytes(), width, matrix.tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], ["ids", "nulls", "owners", "dims", "matrix"])

    found = vectors.select("row", "vec_id", "embedding").mapInArrow(packed, "ids binary, nulls binary, owners binary, dims int, matrix binary")
    return found.withColumn("block", F.monotonically_increasing_id())


def _whole(column: np.ndarray) -> list[int]:
    return [SCALE * int(v) if abs(v) >= EXACT else int(SCALE * v) for v in column.tolist()]


def _best(scores: np.ndarray, error: np.ndarray | float, k: int) -> np.ndarray:
    """Places that can be among the best ``k``, if each score is off by at most its error."""
    places = np.flatnonzero(scores > -np.inf)
    if len(places) <= k:
        return places
    low = (scores - error)[places]
    return places[(scores + error)[places] >= np.partition(low, len(low) - k)[len(low) - k]]


def best_of_blocks(
    queries: np.ndarray, candidates: np.ndarray, same: np.ndarray, k: int, least: np.ndarray | None = None, group: int = GROUP
) -> Iterator[tuple[np.ndarray, list[int]]]:
    """For each query the numbers and exact scores of the candidates that can be among its best ``k``, ties included.

    Both matrices have one row per dimension, as :func:`pack_blocks` makes them.  ``same``
    holds the candidate that is the query's own row, or -1; candidates that score below
    ``least`` of a query may be left out.
    """
    dims = min(len(queries), len(candidates))
    queries, candidates = queries[:dims], candidates[:dims]
    peaks = [float(np.abs(m).max(initial=0)) for m in (queries, candidates)]
    if max(peaks) >= WIDEST:  # no bounds: doubles have no place for the squares
        rows = [_whole(c) for c in candidates.T]
        for q, own in zip(queries.T, same):
            asked = _whole(q)
            scores = [sum(x * y for x, y in zip(asked, row)) for row in rows]
            others = [c for c in range(len(rows)) if c != own]
            floor = sorted((scores[c] for c in others), reverse=True)[:k]
            found = [c for c in others if scores[c] >= floor[-1]]
            yield np.array(found, np.int64), [scores[c] for c in found]
        return
    exact = peaks[0] * peaks[1] * SCALE**2 * max(dims, 1) < EXACT
    order = np.argsort(-(candidates**2).sum(axis=1), kind="stable")  # heavy dimensions first
    q, live = SCALE * queries[order], SCALE * candidates[order]
    tails = lambda m: np.sqrt(np.append(np.cumsum((m**2)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1])), axis=0))
    query_tail, tail = tails(q), tails(live)
    rounding = 0.0 if exact else (dims + 8) * 2.0**-51
    error = lambda n, at: rounding * query_tail[0][n] * tail[0][at]
    least = np.full(q.shape[1], -np.inf) if least is None else least

    def reach(n: int, scores: np.ndarray, at: np.ndarray | slice, done: int) -> np.ndarray:
        """Which candidates can still come to the threshold."""
        return scores + query_tail[done][n] * tail[done][at] * (1 + 1e-9) + error(n, at) + 1e-6 >= least[n]

    scores = np.zeros((q.shape[1], live.shape[1]))
    own = np.flatnonzero(same >= 0)
    scores[own, same[own]] = -np.inf
    every, done = slice(None), 0
    while done < dims:
        scores += q[done : done + group].T @ live[done : done + group]
        done = min(done + group, dims)
        probes = range(0, q.shape[1], PROBES)
        if live.shape[1] and np.mean([reach(n, scores[n], every, done).mean() for n in probes]) <= SPARSE:
            break
    for n in range(q.shape[1]):
        at = np.flatnonzero(reach(n, scores[n], every, done))
        kept, rest = scores[n][at], done
        while rest < dims:
            kept = kept + q[rest : rest + group, n] @ live[rest : rest + group, at]
            rest = min(rest + group, dims)
            alive = reach(n, kept, at, rest)
            at, kept = at[alive], kept[alive]
        best = _best(kept, error(n, at), k)
        at, kept = at[best], kept[best]
        if exact:
            yield at, kept.astype(np.int64).tolist()
        else:
            asked = _whole(queries[:, n])
            yield at, [sum(x * y for x, y in zip(asked, _whole(candidates[:, c]))) for c in at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query row with every other row.

    Both tables have ``row, vec_id, embedding``, other columns are ignored; a query row is
    recognised among the candidates by ``row``, so equal vectors find each other.  Ties go
    to the smaller vec_id, null ids last.  Rows with one and the same query id are ranked
    apart.  Scores beyond a long are ranked by their exact value and shown as the nearest
    long.  Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    find_package(spark)
    candidate_blocks = stage(pack_blocks(vectors, CANDIDATES), "candidates")
    query_blocks = stage(pack_blocks(queries, QUERIES), "queries")
    asked = query_blocks.select(*[F.col(c).alias(f"q_{c}") for c in query_blocks.columns])
    numbers = query_blocks.select("block")
    pairs = candidate_blocks.select("block").withColumnRenamed("block", "candidate").join(numbers, F.lit(True))  # two numbers a pair of blocks
    pairs = stage(pairs, "pairs")
    size = F.octet_length("owners")
    first = candidate_blocks.agg(F.max(F.struct(size, "block")).alias("b"), F.max_by(F.octet_length("matrix"), F.struct(size, "block")).alias("bytes")).first()

    def scored(row: dict, least: np.ndarray | None) -> Iterator[tuple[int, list[tuple]]]:
        """Query numbers, and of each the best ``(score, id or None)`` in a pair of blocks."""
        asked_rows, rows = np.frombuffer(row["q_owners"], np.int64), np.frombuffer(row["owners"], np.int64)
        ids, nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        if not len(asked_rows) or not len(rows):
            return
        q = np.frombuffer(row["q_matrix"]).reshape(row["q_dims"], -1)
        c = np.frombuffer(row["matrix"]).reshape(row["dims"], -1)
        by_row = np.argsort(rows)
        at = np.minimum(np.searchsorted(rows[by_row], asked_rows), len(rows) - 1)
        same = np.where(rows[by_row][at] == asked_rows, by_row[at], -1)
        for n, (found, scores) in enumerate(best_of_blocks(q, c, same, k, least)):
            best = sorted(((-s, bool(nulls[f]), int(ids[f])) for f, s in zip(found, scores)))[:k]
            yield n, [(-s, None if null else i) for s, null, i in best]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield {name: batch.column(name)[row].as_py() for name in batch.schema.names}

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            least = np.full(len(row["q_owners"]) // 8, -np.inf)
            for n, best in scored(row, None):
                if len(best) == k:
                    score = min(max(best[-1][0], -(1 << 1000)), 1 << 1000)
                    least[n] = np.nextafter(float(score), -np.inf)
            yield pa.RecordBatch.from_pydict({"t_block": pa.array([row["q_block"]], pa.int64()), "least": pa.array([least.tobytes()], pa.binary())})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            asked_rows, asked_ids = np.frombuffer(row["q_owners"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            found: list[tuple] = []
            for n, best in scored(row, np.frombuffer(row["least"])):
                for score, vec in best:
                    shown = min(max(score, LONGS[0]), LONGS[1])
                    beyond = (score + (1 << 2200)).to_bytes(280, "big") if shown in LONGS else None
                    found.append((int(asked_rows[n]), int(asked_ids[n]), vec, shown, beyond))
            if found:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["query_row", "query_id", "vec_id", "score", "beyond"])

    rows = candidate_blocks.withColumnRenamed("block", "c_block")
    chosen = F.lit(first["b"]["block"] if first["b"] else None).cast("bigint")
    opening = pairs.where(F.col("candidate") == chosen).repartition("block").join(asked, F.col("block") == F.col("q_block"))
    block = rows.where(F.col("c_block") == chosen)
    opening = opening.join(F.broadcast(block) if (first["bytes"] or 0) <= MOST_SENT else block, F.col("candidate") == F.col("c_block"))
    least = stage(opening.mapInArrow(thresholds, "t_block bigint, least binary"), "thresholds")
    asked = asked.join(least, F.col("q_block") == F.col("t_block")).drop("t_block")
    joined = pairs.repartition("candidate", "block").join(asked, F.col("block") == F.col("q_block")).join(rows, F.col("candidate") == F.col("c_block"))
    found = joined.select("q_ids", "q_owners", "q_dims", "q_matrix", "least", "ids", "nulls", "owners", "dims", "matrix").mapInArrow(
        search, "query_row bigint, query_id bigint, vec_id bigint, score bigint, beyond binary"
    )
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 20, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    vectors = stage(vectors, "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0),
t AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM t WHERE rank <= {TOP}
"""
