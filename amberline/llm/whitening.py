"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. All that touches the vectors is a pass
``Q -> Xc' (Xc Q) / n`` over the written blocks of the centred fit list, summed by Spark.

1. A random block of orthonormal columns goes through one pass; Rayleigh-Ritz gives its
   values. The smallest is at most the eigenvalue of that place, so the interval from 0
   to it lies in the unwanted part of the spectrum.
2. A Chebyshev polynomial of a few passes stays below one on that interval and grows
   fast above it: it damps the unwanted spectrum. QR and Rayleigh-Ritz follow, and a new
   interval.
3. The wanted pairs are certified: each residual is at rounding level, and Lanczos steps
   on the complement of the wanted vectors show that nothing larger is left there.
   Otherwise what Lanczos found joins the block and iteration goes on.

Driver and tasks hold a block of ``dimensions x (components + spare)`` numbers, whatever
the number of vectors.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import map_rows
from amberline.session import materialise

SPARE = 28  # columns of the block beyond the wanted ones
GAIN = 1e6  # a filter is as long as it takes to lift the last wanted vector by this much
DEGREES = (4, 16)
SPREAD = 1e8
ROUNDS = 40
PROBES = 12  # Lanczos steps of the certificate
RESIDUAL = 1e-13  # of the largest eigenvalue
BLOCK_ROWS = 4096
LIMIT = 2**62


def _usable(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """(vec_id, x): x = floor(256 * entry) of rows whose entries are all there and finite."""
    entry = lambda c: F.floor(F.lit(256.0) * c.cast("double"))
    broken = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
    whole = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", broken), F.lit(True))
    # CASE keeps floor away from entries that are dropped
    rows = rows.select("vec_id", F.when(whole, F.transform("v", entry)).alias("x"))
    return materialise(rows.where(F.col("x").isNotNull()), "usable-vectors")


def _packed(rows: DataFrame, dimensions: int) -> DataFrame:
    """(data): blocks of rows as 64-bit integers."""

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        block = []
        for (x,) in found:
            block.append(x)
            if len(block) == BLOCK_ROWS:
                yield (np.array(block, np.int64).tobytes(),)
                block = []
        if block:
            yield (np.array(block, np.int64).tobytes(),)

    return map_rows(rows, run, "data binary")


@dataclass
class FitList:
    """The different vectors, once each, in written blocks, with their number and exact sums."""

    blocks: DataFrame
    dimensions: int
    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def _summed(self, part, size: int) -> np.ndarray:
        """The sum over all blocks of ``part(centred rows)``, ``size`` numbers."""
        mean, dimensions = self.mean, self.dimensions

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            total = np.zeros(size)
            for (data,) in rows:
                total += part(np.frombuffer(data, np.int64).reshape(-1, dimensions) - mean).ravel()
            yield (total.tolist(),)

        parts = map_rows(self.blocks, run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
        found = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()  # ``size`` rows
        out = np.zeros(size)
        for at, value in found:
            out[at] = value
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass over the centred rows."""
        return self._summed(lambda x: x.T @ (x @ q), q.size).reshape(q.shape) / self.n

    def trace(self) -> float:
        return float(self._summed(lambda x: np.einsum("ij,ij->j", x, x), self.dimensions).sum()) / self.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the rows' projections, centred by their own mean."""
        k = projection.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            y = x @ projection
            return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

        found = self._summed(part, k * k + k) / self.n
        return found[:k * k].reshape(k, k) - np.outer(found[k * k:], found[k * k:])


def fit_list(usable: DataFrame, dimensions: int) -> FitList:
    blocks = materialise(_packed(usable.select("x").distinct(), dimensions), "fit-list")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (data,) in rows:
            x = np.frombuffer(data, np.int64).reshape(-1, dimensions)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # neither can overflow in a block
            yield from zip(range(dimensions), high.tolist(), low.tolist())
            yield -1, len(x), 0

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = map_rows(blocks, run, "at int, high long, low long").groupBy("at").agg(wide("high").alias("high"), wide("low").alias("low")).collect()
    sums = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) if r["at"] >= 0 else int(r["high"]) for r in found}
    return FitList(blocks, dimensions, sums.get(-1, 0), [sums.get(i, 0) for i in range(dimensions)])


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and the rotation of ``q`` to their vectors."""
    inner = q.T @ vq
    values, rotation = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], rotation[:, ::-1]


def chebyshev(times, q: np.ndarray, vq: np.ndarray, high: float, top: float, degree: int) -> np.ndarray:
    """p(V) q, with p the Chebyshev polynomial of the interval from 0 to ``high``, scaled to one at ``top``."""
    half = high / 2
    sigma = first = half / (half - top)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, 2 * (following / half) * (times(now) - half * now) - (sigma * following) * before
        sigma = following
    return now


def filter_degree(top: float, wanted: float, high: float) -> int:
    """The least degree that lifts ``wanted`` by GAIN over the interval from 0 to ``high``, within DEGREES.

    It stays so low that the largest vector is not lifted by more than SPREAD over the
    last wanted one, or rounding would fill every column with it.
    """
    grows = lambda value: np.arccosh(max(2 * value / high - 1, 1 + 1e-12))
    lift, apart = grows(wanted), grows(top) - grows(wanted)
    least = min(max(np.ceil(np.arccosh(GAIN) / lift), DEGREES[0]), DEGREES[1])
    return int(max(1, min(least, np.log(SPREAD) / max(apart, 1e-12))))


def largest_outside(times, known: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """A bound for V's largest eigenvalue on the complement of ``known``'s columns, and its vector, by Lanczos."""
    clear = lambda v: v - known @ (known.T @ v)
    v = clear(clear(rng.standard_normal(known.shape[0])))
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    for _ in range(min(PROBES, known.shape[0] - known.shape[1])):
        w = clear(times(basis[-1][:, None])[:, 0])
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):
            for b in basis:
                w = w - b * (b @ w)
            w = clear(w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-14 * max(max(map(abs, alphas)), 1e-300) or len(alphas) == known.shape[0] - known.shape[1]:
            break
        basis.append(w / betas[-1])
    m = len(alphas)
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:m - 1], 1) + np.diag(betas[:m - 1], -1))
    return float(values[-1] + betas[-1] * abs(vectors[-1, -1])), np.array(basis[:m]).T @ vectors[:, -1]


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # largest, as a part of the largest eigenvalue
    certified: bool
    passes: int


def leading(times, dimensions: int, components: int, seed: int = 7) -> Spectrum:
    """The ``components`` leading eigenpairs of the symmetric, non-negative V behind ``times``; fewer where its rank is lower."""
    passes = 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(q)

    rng = np.random.default_rng(seed)
    wanted, size = min(components, dimensions), min(components + SPARE, dimensions)
    q = np.linalg.qr(rng.standard_normal((dimensions, size)))[0]
    best: tuple | None = None
    stalled = 0
    for _ in range(ROUNDS):
        vq = counted(q)
        values, rotation = rayleigh_ritz(q, vq)
        q, vq = q @ rotation, vq @ rotation
        if values[0] <= 0:
            return Spectrum(np.zeros(0), np.zeros((dimensions, 0)), 0.0, True, passes)
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0])
        stalled = stalled + 1 if best is not None and residual > best[0] / 2 else 0
        if best is None or residual < best[0]:
            best = residual, values, q
        if residual <= RESIDUAL or (residual < 1e-10 and stalled > 2):
            if size == dimensions:
                return _kept(values, q, wanted, residual, True, passes)
            bound, missed = largest_outside(counted, q[:, :wanted], rng)
            if bound <= values[wanted - 1] * (1 + 1e-9) + 1e-13 * values[0]:
                return _kept(values, q, wanted, residual, True, passes)
            # the probe's own bound may be loose where the rest is just below: only what rises above is taken in
            if float(missed @ counted(missed[:, None])[:, 0]) <= values[wanted - 1] and stalled > 4:
                break
            q[:, -1] = missed
            q = np.linalg.qr(q)[0]
            stalled += 1
            continue
        high = max(float(values[-1]), 1e-12 * float(values[0]))
        filtered = chebyshev(counted, q, vq, high, float(values[0]), filter_degree(float(values[0]), float(values[wanted - 1]), high))
        q = np.linalg.qr(filtered / np.maximum(np.linalg.norm(filtered, axis=0), 1e-300))[0]
    residual, values, q = best
    logging.getLogger(__name__).warning("not certified after %d passes: residual %.1e", passes, residual)
    return _kept(values, q, wanted, residual, False, passes)


def _kept(values: np.ndarray, q: np.ndarray, wanted: int, residual: float, certified: bool, passes: int) -> Spectrum:
    k = int((values[:wanted] > 1e-12 * values[0]).sum())  # the rest is rounding: V has no further rank
    return Spectrum(values[:k].copy(), q[:, :k].copy(), residual, certified, passes)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for every usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, certified.

    Rows without a vector, with an empty one, or with null, NaN or infinite entries are
    dropped; so are rows whose length is not the table's most frequent one (the longer
    of equally frequent lengths), which have no place in its space. Rows that repeat a
    vec_id, or have none, each get their rows; repeated vectors count once in the fit.
    Components end where the covariance has no further rank: equal vectors, or a single
    one, give no row, as does an empty table. Entries are floored to 64 bits; a deviation
    beyond 64 bits is null.
    """
    if components < 1:
        raise ValueError("components is at least 1")
    spark = vectors.sparkSession
    usable = _usable(vectors, column, key)
    lengths = usable.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT + ", certified boolean")
    dimensions = lengths["length"]
    usable = usable.where(F.size("x") == dimensions)
    fit = fit_list(usable, dimensions)
    found = leading(fit.times, dimensions, components)
    if not len(found.values):
        return spark.createDataFrame([], RESULT + ", certified boolean")
    scaled = found.vectors / np.sqrt(found.values)
    explained = (found.values / fit.trace()).tolist()
    error = float(np.abs(fit.covariance_of(scaled) - np.eye(len(found.values))).max())
    n, sums, mean, certified = fit.n, fit.sums, fit.mean, found.certified
    most = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list:
        if dimensions * (n * max(int(x.max()), -int(x.min())) + most) ** 2 < LIMIT:
            return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            if not len(x):
                continue
            white, deviation = (x - mean) @ scaled, pa.array(deviations(x), pa.int64())
            for at in range(scaled.shape[1]):
                same = lambda value, kind: pa.array([value] * len(x), kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), same(at + 1, pa.int32()), same(n, pa.int64()), deviation, pa.array(white[:, at]),
                     same(explained[at], pa.float64()), same(error, pa.float64()), same(certified, pa.bool_())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "certified"])

    return usable.mapInArrow(run, RESULT + ", certified boolean")
