"""Embedding whitening by Chebyshev-filtered subspace iteration.

Method: vectors are quantized to whole numbers and each distinct one is kept
once, packed, in the fit list.  The leading eigenvectors of its covariance V
come from a block Q of ``dim x block`` numbers on the driver.  A pass over the
fit list gives V Q: every task centres its rows, multiplies them by Q and by
their own transpose and hands on ``dim * block`` sums, which Spark adds.  A
polynomial recurrence over such passes damps the unwanted spectrum
``[low, cut]``; QR makes the block orthonormal, a Rayleigh-Ritz step turns it
to Ritz vectors, and this goes on until the residuals ``|V q - e q|`` of all
wanted ones certify them.  ``low`` and ``cut`` follow the Ritz values, so no
eigenvalue needs to be known before.  V itself is never formed.

A task holds one Arrow batch and its sums; the driver holds blocks of ``dim *
block`` numbers; neither grows with the rows.  Copies are merged in the batch,
then by Spark's partial aggregation, so a vector held by a third of all rows
costs one row for each task.  The fit list is a reliable checkpoint, and the
sums of a lost task are made again from it.  A pass has a task for each
``PASS_BYTES`` of the fit list (at least one for each core), whatever number of
partitions the session shuffles to.

Defined cases
-------------
* a vector that is null or holds null or non-finite entries: its row is dropped;
* vectors of different lengths: shorter ones are filled up with zeros;
* ``256 * c`` beyond a long is held at the long's end;
* repeated rows stay, each with its result; extra columns are ignored; a null
  ``vec_id`` stays null;
* fewer dimensions than components: as many components as dimensions;
* an eigenvalue of 0 (one distinct vector, or fewer directions than
  components): ``whitened`` is null, and the component takes no part in
  ``identity_error`` (null without any); ``explained`` is null where the trace is 0;
* ``deviation`` is exact up to 38 digits, null beyond;
* an empty table, or one without a usable vector, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start
from connrisk.session import reliable

#: Steps of the quantization, and components returned.
SCALE, COMPONENTS = 256.0, 4
#: Columns of the block for each component (at most the dimensions): the guards beyond the wanted ones widen the gap
#: to the damped spectrum.
BLOCK = 8
#: Longest polynomial between two Rayleigh-Ritz steps, and how far it may pull the wanted vectors apart.
DEGREE, RATIO = 10, 1e8
#: Residuals, as part of the largest eigenvalue: certified below the first; below the second when rounding keeps them there.
CERTIFIED, ROUNDING = 2e-15, 1e-12
#: Bytes of the fit list that a task of a pass reads, and sums of tasks that one task adds up: a pass is a job, and many
#: passes take no more tasks than their work needs, however many partitions the session shuffles to.
PASS_BYTES, SUM_ROWS = 32 << 20, 1 << 17
#: Eigenvalues below this part of the largest are 0.
ZERO = 1e-12
_MOST_PASSES = 20_000
_LONG_MAX, _LONG_MIN = 2**63 - 1, -(2**63)


# --- eigenvectors, given a product with V -------------------------------------------

def _degree(top: float, last: float, low: float, cut: float) -> int:
    """The longest recurrence that pulls ``top`` and ``last`` apart by no more than ``RATIO``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    grow = lambda v: math.acosh(max(1.0, (v - middle) / half))
    apart = grow(top) - grow(last)
    return max(2, min(DEGREE, int(math.log(RATIO) / apart) if apart > 0 else DEGREE))


def _filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, cut: float,
              top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times ``q``: at most 1 on ``[low, cut]``, scaled to 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    first = scale = half / (top - middle)
    before, now = q, (vq - middle * q) * (scale / half)
    for _ in range(degree - 1):
        after = 1.0 / (2.0 / first - scale)
        before, now = now, (2.0 * after / half) * (apply(now) - middle * now) - scale * after * before
        scale = after
    return now


def leading_eigenpairs(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int | None = None,
                       seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, vectors, residual)`` of the ``k`` largest eigenvalues of a
    positive semidefinite matrix that is known only by ``apply(Q) = V Q``."""
    k = min(k, dim)
    width = min(dim, max(BLOCK * k, k) if block is None else max(block, k))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    low, best, stuck = math.inf, math.inf, 0
    for _ in range(_MOST_PASSES):
        vq = apply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        rest = np.linalg.norm(vq - q * values, axis=0)
        top = max(values[0], 0.0)
        residual = float(rest[:k].max())
        stuck = 0 if residual < best / 2 else stuck + 1
        best = min(best, residual)
        if residual <= CERTIFIED * top or width == dim or stuck > 2 and residual <= ROUNDING * top:
            return np.maximum(values[:k], 0.0), q[:, :k], residual / top if top else 0.0
        low = max(0.0, min(low, float((values - rest).min())))
        cut = max(float(values[-1]), low + 1e-3 * (top - low))
        q = np.linalg.qr(_filtered(apply, q, vq, low, cut, top, _degree(top, float(values[k - 1]), low, cut)))[0]
    raise RuntimeError("the leading eigenvectors could not be certified")


# --- vectors as whole numbers ---------------------------------------------------------

def quantized(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that stay, their whole numbers (filled up with zeros) and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry is NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    keep = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    starts, lengths = offsets[:-1][keep].astype(np.int64), np.diff(offsets)[keep].astype(np.int64)
    dim = int(lengths.max()) if len(keep) else 0
    if len(keep) and (lengths == dim).all():
        raw = values[starts[:, None] + np.arange(dim)]
    else:
        raw = np.zeros((len(keep), dim))
        for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            raw[i, :n] = values[a : a + n]
    with np.errstate(over="ignore"):
        floor = np.floor(SCALE * raw)
    x = np.where(np.abs(floor) < 2.0**63, floor, 0.0).astype(np.int64)
    x[floor >= 2.0**63] = _LONG_MAX
    x[floor <= -(2.0**63)] = _LONG_MIN
    return keep, x, lengths


def packed(x: np.ndarray) -> list[bytes]:
    """One key for each row: bytes of an entry, then the entries without the
    zeros at the end, so equal vectors have equal keys and others have not."""
    if not x.size:
        return [b"\x01"] * len(x)
    high = np.maximum(x.max(axis=1), ~x.min(axis=1))
    widths = np.select([high < 1 << 7, high < 1 << 15, high < 1 << 31], [1, 2, 4], 8)
    used = np.where((x != 0).any(axis=1), x.shape[1] - np.argmax(x[:, ::-1] != 0, axis=1), 0)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        whole, size, tag = x[rows].astype(f"<i{w}").tobytes(), x.shape[1] * w, bytes([w])
        for i, (row, n) in enumerate(zip(rows.tolist(), used[rows].tolist(), strict=True)):
            out[row] = tag + whole[i * size : i * size + n * w]
    return out


def unpacked(keys: list[bytes], dim: int) -> np.ndarray:
    """The rows of ``packed``, as long as ``dim``."""
    out = np.zeros((len(keys), dim), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(keys):
        kinds.setdefault((key[0], len(key) - 1), []).append(i)
    for (w, size), rows in kinds.items():
        if size:
            flat = np.frombuffer(b"".join([keys[i][1:] for i in rows]), f"<i{w}")
            out[rows, : size // w] = flat.reshape(len(rows), size // w)
    return out


def _fit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x, lengths = quantized(batch.column(0))
        longest: dict[bytes, int] = {}
        for key, n in zip(packed(x), lengths.tolist(), strict=True):
            if n > longest.get(key, -1):
                longest[key] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(longest), pa.binary()), pa.array(list(longest.values()), pa.int32())],
                                         ["key", "dim"])


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(key, dim)``: each distinct quantized vector once, with its greatest length; a reliable checkpoint."""
    rows = spread_scan(vectors.select(column)).mapInArrow(_fit_keys, "key binary, dim int")
    return reliable(rows.groupBy("key").agg(F.max("dim").alias("dim")))


# --- passes over the fit list -----------------------------------------------------------

def gathered(fit: DataFrame, size: int) -> DataFrame:
    """The fit list, ``size`` bytes, in partitions for a pass; at least one for each core, if it has as many."""
    return fit.coalesce(max(fit.sparkSession.sparkContext.defaultParallelism, -(-size // PASS_BYTES)))


def _added(parts: DataFrame, slot: str, value: str, size: int) -> DataFrame:
    """The sum of each of ``size`` slots over the rows that each task made, in as few tasks as they need."""
    rows = size * parts.rdd.getNumPartitions()
    return parts.groupBy(slot).agg(F.sum(value).alias(value)).coalesce(-(-rows // SUM_ROWS))


def column_sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sums of the fit list, one for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)  # of 32 bits each: no overflow below 2**31 rows a task
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dim)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        total = [Decimal((h << 32) + v) for h, v in zip(high.tolist(), low.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["j", "s"])

    rows = _added(fit.select("key").mapInArrow(run, "j int, s decimal(38,0)"), "j", "s", dim)
    sums = {r.j: int(r.s) for r in rows.withColumn("s", F.col("s").cast("decimal(38,0)")).collect()}
    return [sums.get(j, 0) for j in range(dim)]


def _summed(fit: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], dim: int, mean: np.ndarray) -> np.ndarray:
    """The sums of ``part(centred rows)``, ``size`` numbers, over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += part(unpacked(batch.column(0).to_pylist(), dim) - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["slot", "v"])

    out = np.zeros(size)
    for r in _added(fit.select("key").mapInArrow(run, "slot int, v double"), "slot", "v", size).collect():
        out[r.slot] = r.v
    return out


class Whitening:
    """Components of a fit list: ``n``, ``sums``, ``values``, ``vectors``
    (``dim x components``), ``trace``, ``residual`` and ``identity_error``."""

    def __init__(self, fit: DataFrame, components: int = COMPONENTS) -> None:
        size = fit.agg(F.count("*").alias("n"), F.max("dim").alias("d"), F.sum(F.octet_length("key")).alias("b")).first()
        self.n, self.dim, self.passes = size.n, size.d or 0, 0
        if not self.n or not self.dim:
            return
        n, dim = self.n, self.dim
        fit = gathered(fit, size.b)
        self.sums = column_sums(fit, dim)
        mean = self.mean = np.array([s / n for s in self.sums])
        self.trace = float(_summed(fit, 1, lambda c: np.array([np.einsum("ij,ij->", c, c)]), dim, mean)[0]) / n

        def product(q: np.ndarray) -> np.ndarray:
            self.passes += 1
            return _summed(fit, q.size, lambda c: (c.T @ (c @ q)).ravel(), dim, mean).reshape(q.shape) / n

        self.values, self.vectors, self.residual = leading_eigenpairs(product, dim, components)
        self.live = self.values > ZERO * self.values[0] if self.trace else np.zeros(len(self.values), bool)
        to = self.vectors[:, self.live] / np.sqrt(self.values[self.live])
        self.identity_error = None
        if self.live.any():
            m = to.shape[1]
            cov = _summed(fit, m * m, lambda c: ((c @ to).T @ (c @ to)).ravel(), dim, mean).reshape(m, m) / n
            self.identity_error = float(np.abs(cov - np.eye(m)).max())

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Exact ``sum((n x - sums)**2)`` of each row, null beyond 38 digits."""
        sums = np.array(self.sums, object)
        bound = max(map(abs, self.sums)) + self.n * (max(int(x.max()), -int(x.min())) if x.size else 0)
        if bound * bound * self.dim < 2**63:
            found = ((x * self.n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        else:
            found = ((x.astype(object) * self.n - sums) ** 2).sum(axis=1).tolist()
        return [Decimal(v) if v < 10**38 else None for v in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``
    for every usable row and component."""
    start(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    fitted = Whitening(fit_list(vectors, column), components)
    if not fitted.n or not fitted.dim:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore"):
            to = fitted.vectors / np.where(fitted.live, np.sqrt(fitted.values), np.inf)
        shares = [v / fitted.trace if fitted.trace else None for v in fitted.values.tolist()]
        many = len(shares)
        for batch in batches:
            keep, x, _ = quantized(batch.column(1))
            x = np.pad(x, ((0, 0), (0, fitted.dim - x.shape[1])))
            projected = ((x - fitted.mean) @ to).ravel()
            dead = np.tile(~fitted.live, len(keep))
            rows = np.repeat(np.arange(len(keep)), many)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep)).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(keep))),
                pa.array(np.full(len(rows), fitted.n, np.int64)),
                pa.array(fitted.deviations(x), pa.decimal128(38, 0)).take(pa.array(rows)),
                pa.array(projected, mask=dead),
                pa.array(shares * len(keep), pa.float64()),
                pa.array([fitted.identity_error] * len(rows), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return spread_scan(vectors.select(F.col(key).alias("vec_id"), column)).mapInArrow(run, schema)
