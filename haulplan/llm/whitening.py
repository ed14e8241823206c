"""Embedding whitening by incremental eigendecomposition.

Each task keeps the spectrum of the vectors it has read: their number, mean, eigenvalues
and eigenvectors of the scatter matrix.  A vector is a centred rank-one update of the
scatter.  In the eigenbasis that is a diagonal plus ``z z'``: entries that cannot
matter are deflated, the others' new eigenvalues are the roots of the secular
equation, all found at once, and ``z`` is recomputed from the roots, which keeps the
eigenvectors orthogonal (Gu and Eisenstat).

Spectra of tasks are combined in rounds of a few at a time: each eigenpair of one is
a rank-one update of the other, and the difference of the means is one more.  The
combined eigenvectors are the basis of a distributed Rayleigh-Ritz step: the sums of
products of centred, projected vectors are taken over all partitions, and the Ritz vectors of that small matrix are
the components.  It is done twice; the second sums also give the error of the result.

Only spectra and sums of a fixed size, ``d`` by ``d``, leave the tasks.  Distinct vectors are found by a
grouping with map-side combining, so one vector may be any share of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulplan.llm.common import discard, find_package, released, table
from haulplan.staging import stage

COMPONENTS = 4
SCALE = 256
FAN_IN = 8  # spectra that one task combines
LEAST = 1e-13  # share of the trace below which an eigenvalue counts as zero
REFINEMENTS = 2

_EPS = np.finfo(float).eps
_SPECTRUM = "id bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"


# ---- rank-one updates --------------------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(weights / (poles - x)) = 0``: nearest pole and distance from it, one root behind each pole.

    ``poles`` rise strictly, ``weights`` are positive.  A root is kept as a distance
    from its nearer pole, which is exact where the root itself would be rounded to
    the pole.
    """
    count = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    gaps = ends - poles
    middle = 1 + (weights / (poles - poles[:, None] - (gaps / 2)[:, None])).sum(axis=1)
    right = middle < 0  # the function rises, so the root lies in the upper half
    right[-1] = False
    origin = np.arange(count) + right
    from_origin = poles - poles[origin][:, None]
    low = np.where(right, -gaps / 2, 0.0)
    high = np.where(right, 0.0, gaps / 2)
    high[-1] = gaps[-1]
    x = (low + high) / 2
    for _ in range(100):
        apart = from_origin - x[:, None]
        terms = weights / apart
        value = 1 + terms.sum(axis=1)
        slope = (terms / apart).sum(axis=1)
        low = np.where(value < 0, x, low)
        high = np.where(value < 0, high, x)
        # A hyperbola through value and slope with its pole at the origin; else halving.
        a, pole = slope * x * x, x
        guess = np.where(np.abs(value + slope * pole) > 0, a / np.where(value + slope * pole == 0, 1.0, value + slope * pole), x)
        good = (guess > low) & (guess < high)
        step = np.where(good, guess, (low + high) / 2)
        done = (np.abs(step - x) <= 4 * _EPS * np.abs(x)) | (high - low <= 4 * _EPS * np.abs(x)) | (np.abs(value) <= 8 * _EPS * (1 + np.abs(terms).sum(axis=1)))
        x = np.where(done, x, step)
        if done.all():
            break
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors diag(values) vectors' + v v'``."""
    z = vectors.T @ v
    scale = max(float(np.abs(values).max()), float(z @ z))
    if not scale > 0:
        return values, vectors
    small = 8 * _EPS * scale
    # Deflation: of near-equal eigenvalues one takes the whole weight, by a rotation.
    for k in np.flatnonzero(np.diff(values) <= small).tolist():
        length = math.hypot(z[k], z[k + 1])
        if length > 0:
            c, s = z[k + 1] / length, z[k] / length
            z[k], z[k + 1] = 0.0, length
            low, high = vectors[:, k] * c - vectors[:, k + 1] * s, vectors[:, k] * s + vectors[:, k + 1] * c
            vectors = vectors.copy()
            vectors[:, k], vectors[:, k + 1] = low, high
    use = np.abs(z) * math.sqrt(scale) > small
    # A pole that stands too near the last one used has no weight left; it stays as it is.
    poles, weights = values[use], z[use] ** 2
    if len(poles) == 0:
        return values, vectors
    if len(poles) > 1 and (np.diff(poles) <= 0).any():
        return full_update(values, vectors, v)
    origin, x = secular_roots(poles, weights)
    apart = (poles - poles[origin][:, None]) - x[:, None]  # row: root, column: pole minus root
    # The weights whose exact roots these are: product over roots and poles, in logarithms of ratios.
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    ratios = -apart / -between.T
    np.fill_diagonal(ratios, 1.0)
    own = -np.diagonal(apart)
    exact = np.sqrt(np.abs(np.prod(ratios, axis=0) * own))
    parts = np.copysign(exact, z[use]) / apart
    lengths = np.sqrt((parts * parts).sum(axis=1))
    if not np.isfinite(lengths).all() or (lengths == 0).any():
        return full_update(values, vectors, v)
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[use] = poles[origin] + x
    new_vectors[:, use] = vectors[:, use] @ (parts / lengths[:, None]).T
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


def full_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the whole matrix, for the rare update whose roots the numbers cannot tell from the poles."""
    return np.linalg.eigh((vectors * values) @ vectors.T + np.outer(v, v))


class Spectrum:
    """Number, mean, and eigenvalues and eigenvectors of the scatter of the vectors added so far."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def empty(cls, dimensions: int) -> Spectrum:
        return cls(0, np.zeros(dimensions), np.zeros(dimensions), np.eye(dimensions))

    def update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            self.update(off * math.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + off / self.n

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector * math.sqrt(value))
        off, both = other.mean - self.mean, self.n + other.n
        self.update(off * math.sqrt(self.n * other.n / both))
        self.mean = self.mean + off * (other.n / both)
        self.n = both

    def row(self, number: int) -> dict:
        return {"id": number, "n": self.n, "mean": self.mean.tolist(), "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of_row(cls, row) -> Spectrum:
        values = np.array(row.values_, float)
        return cls(int(row.n), np.array(row.mean, float), values, np.array(row.vectors, float).reshape(len(values), -1))


# ---- distributed steps --------------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: scaled whole numbers of the vectors that take part."""
    entry = F.col("embedding").cast("array<double>")
    known = rows.where(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), entry.alias("embedding"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = float(2**53)  # whole numbers beyond it are no longer told apart as doubles
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(limit)), F.lit(-limit))).cast("bigint"))
    return known.where((F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True))).select("vec_id", whole.alias("x"))


def matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    values = batch.column("x")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def spectrum(fit: DataFrame, dimensions: int) -> Spectrum:
    """The spectrum of all rows ``x``, from those of tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dimensions)
        for batch in released(batches):
            for x in matrix(batch, dimensions).astype(float):
                own.add(x)
        if own.n:
            columns = own.row(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([columns["id"]], pa.int64()), pa.array([columns["n"]], pa.int64()), *(pa.array([columns[c]], pa.list_(pa.float64())) for c in ("mean", "values", "vectors"))],
                ["id", "n", "mean", "values", "vectors"],
            )

    def combined(rows: pd.DataFrame) -> pd.DataFrame:
        spectra = [Spectrum.of_row(r) for r in rows.rename(columns={"values": "values_"}).sort_values("id").itertuples()]
        for other in spectra[1:]:
            spectra[0].combine(other)
        return pd.DataFrame([spectra[0].row(int(rows["id"].min()) // FAN_IN)])

    found = stage(fit.mapInArrow(read, _SPECTRUM).withColumn("id", F.monotonically_increasing_id()), "spectra")
    # Ids of partitions are far apart; places in their order are dense, one row for each task.
    ids = sorted(r.id for r in found.select("id").collect())
    place = found.sparkSession.createDataFrame([(old, k) for k, old in enumerate(ids)], "id bigint, place bigint")
    left, found = len(ids), found.join(place, "id").withColumn("id", F.col("place")).drop("place")
    while left > 1:
        group = F.expr(f"id div {FAN_IN}")
        found = stage(found.groupBy(group.alias("group")).applyInPandas(combined, _SPECTRUM), "spectra")
        left = math.ceil(left / FAN_IN)
    row = found.first()
    return Spectrum(row.n, np.array(row.mean), np.array(row["values"]), np.array(row.vectors).reshape(dimensions, -1))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in 64 bits where they hold it, else in Python's whole numbers."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(1, *(abs(s) for s in sums))
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def projected_sums(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """Sum over all rows of ``p p'`` with ``p`` the centred row on the basis, divided by ``n``."""
    width = basis.shape[1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in released(batches):
            p = (deviations(matrix(batch, len(sums)), n, sums) / n).astype(float) @ basis
            total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["products"])

    rows = fit.mapInArrow(read, "products array<double>").select(F.posexplode("products").alias("cell", "value"))
    cells = rows.groupBy("cell").agg(F.sum("value").alias("value")).collect()  # the square of the dimensions
    out = np.zeros(width * width)
    for c in cells:
        out[c.cell] = c.value
    return out.reshape(width, width) / n


class Whitening:
    """What whitening needs: number and sums of the fit list, components (columns), their eigenvalues, trace, error."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float, error: float):
        self.n, self.sums, self.vectors, self.values, self.trace, self.error = n, sums, vectors, values, trace, error


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``rows`` with the column ``x``, from their distinct vectors; None without rows."""
    fit = stage(rows.select("x").distinct(), "distinct")
    first = fit.first()
    if first is None:
        return None
    dimensions = len(first.x)
    totals = fit.agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("x", F.lit(k)).cast("decimal(38,0)")) for k in range(dimensions)]).alias("sums")).first()
    n, sums = totals.n, [int(s) for s in totals.sums]
    basis = spectrum(fit, dimensions).vectors
    for _ in range(REFINEMENTS):
        basis = np.linalg.qr(basis)[0]
        values, turned = np.linalg.eigh(projected_sums(fit, n, sums, basis))
        basis = basis @ turned
    order = np.argsort(-values, kind="stable")
    values, basis = values[order], basis[:, order]
    trace = float(values.sum())
    count = int((values[:components] > LEAST * trace).sum()) if trace > 0 else 0
    values, basis = values[:count], basis[:, :count]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    white = projected_sums(fit, n, sums, basis / np.sqrt(values)) if count else np.zeros((0, 0))
    error = float(np.abs(white - np.eye(count)).max(initial=0.0))
    discard(fit)
    return Whitening(n, sums, basis, values, trace, error)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row and component.

    ``rows`` has ``vec_id, embedding``.  Vectors that are null, empty or hold null or
    non-finite entries are left out, and so are those of another length than most
    vectors (the longer of two equally frequent ones counts).  Entries are whole numbers of
    ``1 / 256``, held to 2^53 of these.  A component without variance is left out, so equal vectors alone
    give no rows, nor does an empty table.  Rows of one id are whitened each for itself, null ids
    too.  ``deviation`` is null where 64 bits do not hold it.  Other columns are ignored.
    """
    spark = rows.sparkSession
    find_package(spark)
    known = usable(rows)
    lengths = known.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    known = known.where(F.size("x") == lengths["size"])
    model = fit_whitening(known, components)
    scaled = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace if len(model.values) else model.values
    n, sums, error, count = model.n, model.sums, model.error, len(model.values)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            off = deviations(matrix(batch, len(sums)), n, sums)
            exact = off.dtype == np.int64 and len(sums) * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63
            squares = (off * off).sum(axis=1) if exact else [int(s) for s in (off.astype(object) ** 2).sum(axis=1)]
            squares = [int(s) if s < 1 << 63 else None for s in squares]
            white = (off / n).astype(float) @ scaled
            rows_in = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows_in), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows_in)),
                    pa.array(np.full(rows_in * count, n, np.int64)),
                    pa.array([s for s in squares for _ in range(count)], pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, rows_in)),
                    pa.array(np.full(rows_in * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return known.mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
