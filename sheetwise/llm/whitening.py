"""Whitening of embeddings from an exact covariance, found by polarisation.

A vector's entries become integers x = floor(scale * c) + offset. The fit list is each distinct x vector once, so copies do not weigh more. For
each dimension i and each pair of dimensions i < j, the squares of y_i and of y_i + y_j are summed as exact integers, where y is x centred on the
integer below its mean. With the remainders R of the means these sums give n**2 times the variances of all x_i and x_i + x_j exactly, and a covariance is
half of var(x_i + x_j) - var(x_i) - var(x_j). Each becomes a double once, by one correctly rounded division, so the offset costs no digits.

Scale. Vectors are packed (a width and the integers in it) before they are shuffled to be made distinct, which Spark does with partial aggregation, so a vector with
many copies is one row of each task. Sums are d (d + 1) / 2 rows of each task, whatever its rows. The driver gets these d (d + 1) / 2 sums,
and tasks get d by ``components`` doubles: both follow from the dimension, not from the rows.

Edge cases: rows whose vector is null or holds null, NaN or an infinity are left out. Vectors with another number of entries are a space of their own, with
its own fit. Empty vectors have no component. A direction along which the fit list does not vary (to double precision) is no component, so a list
of one vector, or of equal ones, gives no rows. An entry whose integer does not fit 64 bits counts as the largest or smallest one. A deviation
of more than 38 digits is null. Repeated rows, ties and null ids are rows like others; an empty table gives no rows. Extra columns are ignored unless kept; a kept one with a result's name is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import no_clash
from sheetwise.runtime import scratch, ship

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: Largest and smallest integer of an entry.
MOST = 2**63 - 1
#: Rows whose squares are summed at once.
BLOCK = 1024
#: Sums of squares travel as digits of this many bits, so that Spark adds them as longs; squares of 64-bit pair sums have up to 131 bits.
DIGIT, DIGITS = 31, 6
TYPES = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _whole(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of numbers: which rows are usable, their numbers of entries, and the entries of the usable rows."""
    if pa.types.is_null(lists.type):
        return np.zeros(len(lists), bool), np.zeros(0, np.int64), np.zeros(0)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    ends = np.cumsum(sizes)
    usable = np.asarray(lists.is_valid()) & (bad[ends] == bad[ends - sizes])
    return usable, sizes[usable], values[np.repeat(usable, sizes)]


def _integers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    limit = float(2**62)
    return np.clip(scaled, -limit, limit).astype(np.int64) + offset


def pack(vectors: np.ndarray, offset: int) -> list[bytes]:
    """Each row of integers as the narrowest of four widths, with that width first; equal vectors have equal bytes."""
    moved = vectors - offset
    low, high = moved.min(axis=1, initial=0), moved.max(axis=1, initial=0)
    width = np.full(len(moved), 8)
    for w in (4, 2, 1):
        fits = (low >= np.iinfo(TYPES[w]).min) & (high <= np.iinfo(TYPES[w]).max)
        width[fits] = w
    out: list[bytes] = [b""] * len(moved)
    for w, kind in TYPES.items():
        rows = np.flatnonzero(width == w)
        if len(rows):
            size, raw = w * moved.shape[1], moved[rows].astype(kind).tobytes()
            for k, i in enumerate(rows.tolist()):
                out[i] = bytes([w]) + raw[k * size : (k + 1) * size]
    return out


def unpack(packed: list[bytes], dims: int, offset: int) -> np.ndarray:
    out = np.empty((len(packed), dims), np.int64)
    widths = np.array([p[0] for p in packed])
    for w, kind in TYPES.items():
        rows = np.flatnonzero(widths == w)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(packed[i][1:] for i in rows.tolist()), kind).reshape(len(rows), dims)
    return out + offset


def _by_dims(sizes: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of entries, places among the rows, matrix) for each number of entries in a batch."""
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[starts[rows][:, None] + np.arange(d)]


def fit_list(vectors: DataFrame, col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(dims, packed)``: each distinct integer vector once."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sizes, values = _whole(b.column(0))
            for d, _, own in _by_dims(sizes, values):
                if d:
                    yield pa.record_batch([pa.array(np.full(len(own), d, np.int32)), pa.array(pack(_integers(own, scale, offset), offset), pa.binary())], names=["dims", "packed"])

    return vectors.select(F.col(col).cast("array<double>").alias("v")).mapInArrow(run, "dims int, packed binary").distinct()


def _matrices(batches: Iterator[pa.RecordBatch], offset: int) -> Iterator[tuple[int, np.ndarray]]:
    """Packed vectors of one task as matrices of up to ``BLOCK`` rows."""
    for b in batches:
        dims = np.asarray(b.column(0))
        for d in np.unique(dims).tolist():
            rows = b.filter(pa.array(dims == d)).column(1).to_pylist()
            for i in range(0, len(rows), BLOCK):
                yield d, unpack(rows[i : i + BLOCK], d, offset)


def _sum_rows(d: int, sums: list[int], n: int) -> pa.RecordBatch:
    """Rows (dims, place, digits): integers of any sign and size, cut so that the digits of many tasks can be added."""
    digits = [[(abs(s) >> (DIGIT * k) & ((1 << DIGIT) - 1)) * (-1 if s < 0 else 1) for s in sums] for k in range(DIGITS)]
    arrays = [pa.array(np.full(len(sums), d, np.int32)), pa.array(np.arange(len(sums), dtype=np.int64)), *[pa.array(x, pa.int64()) for x in digits], pa.array([n] * len(sums), pa.int64())]
    return pa.record_batch(arrays, names=["dims", "place", *[f"g{k}" for k in range(DIGITS)], "n"])


SUMS = "dims int, place long, " + ", ".join(f"g{k} long" for k in range(DIGITS)) + ", n long"


def _exact_sum(values: np.ndarray, most: int, axis: int = 0) -> list[int]:
    """Sums of a matrix's columns (or rows) of integers of at most ``most``, exactly."""
    if most * max(values.shape[axis], 1) < MOST:
        return values.sum(axis=axis, dtype=np.int64).tolist()
    return values.astype(object).sum(axis=axis).tolist()


def _totals(sums: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dims -> (rows, sum of each place), added over tasks by Spark."""
    found = sums.groupBy("dims", "place").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(DIGITS)], F.sum("n").alias("n")).toArrow().sort_by([("dims", "ascending"), ("place", "ascending")])
    digits = [found.column(f"g{k}").to_pylist() for k in range(DIGITS)]
    out: dict[int, tuple[int, list[int]]] = {}
    for i, (d, n) in enumerate(zip(found.column("dims").to_pylist(), found.column("n").to_pylist())):
        out.setdefault(d, (n, []))[1].append(sum(g[i] << (DIGIT * k) for k, g in enumerate(digits)))
    return out


def _first_sums(fit: DataFrame, offset: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors, and the sum of each dimension of x - offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for d, x in _matrices(batches, offset):
            z = x - offset
            n, have = total.get(d, (0, [0] * d))
            total[d] = n + len(z), [a + b for a, b in zip(have, _exact_sum(z, int(np.abs(z).max(initial=0))))]
        for d, (n, sums) in total.items():
            yield _sum_rows(d, sums, n)

    return _totals(fit.mapInArrow(run, SUMS))


def pair_places(d: int) -> list[tuple[int, int]]:
    """Places of the polarised sums: (i, i) is y_i alone, (i, j) is y_i + y_j."""
    return [(i, j) for i in range(d) for j in range(i, d)]


def polarised_squares(y: np.ndarray) -> list[int]:
    """Sums over a matrix's rows of y_i ** 2 and (y_i + y_j) ** 2, in the order of :func:`pair_places`, exactly."""
    d = y.shape[1]
    most = int(np.abs(y).max(initial=0))
    turned = np.ascontiguousarray(y.T)
    if 4 * most * most * max(len(y), 1) >= MOST:
        turned = turned.astype(object)
    out: list[int] = []
    for i in range(d):
        both = turned[i:] + turned[i]
        both[0] = turned[i]
        out += (both * both).sum(axis=1).tolist() if both.dtype == object else np.einsum("ij,ij->i", both, both).tolist()
    return out


def _polarised(fit: DataFrame, offset: int, centres: dict[int, np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for d, x in _matrices(batches, offset):
            n, have = total.get(d, (0, [0] * (d * (d + 1) // 2)))
            total[d] = n + len(x), [a + b for a, b in zip(have, polarised_squares(centred(x, centres[d])))]
        for d, (n, sums) in total.items():
            yield _sum_rows(d, sums, n)

    return _totals(fit.mapInArrow(run, SUMS))


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre, as integers that do not overflow."""
    far = max(int(np.abs(x // 2).max(initial=0)), int(np.abs(centre // 2).max(initial=0))) >= 2**61
    return x.astype(object) - centre.astype(object) if far else x - centre


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of one number of entries."""

    n: int
    #: Integers below the means of x, and what the sums of x have beyond n times them.
    centre: np.ndarray
    rest: list[int]
    #: d x components: unit eigenvectors of the covariance, and their eigenvalues.
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred integers."""
        return (y.astype(float) - np.array([r / self.n for r in self.rest])) @ self.axes / np.sqrt(self.values)


def covariance(d: int, n: int, squares: list[int], rest: list[int]) -> tuple[np.ndarray, float]:
    """Covariance (divisor n) and trace from polarised sums of squares; ``rest`` are the sums of the same y."""
    at = {p: s for p, s in zip(pair_places(d), squares)}
    # n ** 2 times the variance of y_i and of y_i + y_j, as integers.
    spread = {(i, j): n * s - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for (i, j), s in at.items()}
    v = np.empty((d, d))
    for i, j in at:
        v[i, j] = v[j, i] = spread[i, i] / n**2 if i == j else (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n**2)
    return v, sum(spread[i, i] for i in range(d)) / n**2


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> dict[int, Whitening]:
    """A whitening for each number of entries, from a :func:`fit_list`; the list is read twice."""
    ship(fit.sparkSession)
    first = _first_sums(fit, offset)
    centres = {d: np.array([s // n + offset for s in sums], np.int64) for d, (n, sums) in first.items()}
    squares = _polarised(fit, offset, centres)
    out = {}
    for d, (n, sums) in first.items():
        rest = [s % n for s in sums]
        v, trace = covariance(d, n, squares[d][1], rest)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
        varies = values > 8 * d * np.finfo(float).eps * max(trace, 0.0)
        values, axes = values[varies], axes[:, varies]
        largest = np.abs(axes).argmax(axis=0)
        axes = axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        out[d] = Whitening(n, centres[d], rest, axes, values, trace)
    return out


def identity_errors(fit: DataFrame, model: dict[int, Whitening], offset: int = OFFSET) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance less the identity, for each number of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for d, x in _matrices(batches, offset):
            w = model[d].project(centred(x, model[d].centre))
            w = np.concatenate((np.ones((len(w), 1)), w), axis=1)
            total[d] = total.get(d, 0) + w.T @ w
        for d, m in total.items():
            yield pa.record_batch([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["dims", "place", "s"])

    found = fit.mapInArrow(run, "dims int, place long, s double").groupBy("dims", "place").agg(F.sum("s").alias("s")).toArrow().sort_by([("dims", "ascending"), ("place", "ascending")])
    dims, s = np.asarray(found.column("dims")), np.asarray(found.column("s"))
    out = {}
    for d, own in model.items():
        k = len(own.values)
        m = s[dims == d].reshape(k + 1, k + 1) / own.n
        out[d] = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(k)).max(initial=0.0))
    return out


def _deviations(y: np.ndarray, own: Whitening) -> list[int]:
    """Sum over dimensions of (n x - S) ** 2, exactly."""
    most = int(np.abs(y).max(initial=0)) * own.n + own.n
    if y.dtype != object and most * most * max(y.shape[1], 1) < MOST:
        far = y * own.n - np.array(own.rest, np.int64)
        return (far * far).sum(axis=1).tolist()
    far = y.astype(object) * own.n - np.array(own.rest, object)
    return (far * far).sum(axis=1).tolist()


def whiten(vectors: DataFrame, model: dict[int, Whitening], errors: dict[int, float], keep: list[str | Column], col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """A row for each usable vector and component, from 1: ``keep`` columns, then component, n, deviation (a decimal), whitened, explained and identity_error."""
    no_clash(keep, OUT)
    ship(vectors.sparkSession)
    rows = vectors.select(F.struct(*keep).alias("_keep"), F.col(col).cast("array<double>").alias("_v"))
    schema = rows.select("_keep").schema.add("component", "integer").add("n", "long").add("deviation", "decimal(38,0)").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    limit = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usable, sizes, values = _whole(b.column(1))
            places = np.flatnonzero(usable)
            for d, rows, own in _by_dims(sizes, values):
                m = model.get(d)
                if m is None or not len(m.values):
                    continue
                k = len(m.values)
                for i in range(0, len(rows), BLOCK):
                    y = centred(_integers(own[i : i + BLOCK], scale, offset), m.centre)
                    dev = [Decimal(x) if x < limit else None for x in _deviations(y, m)]
                    many = len(y) * k
                    yield pa.record_batch(
                        [
                            b.column(0).take(pa.array(np.repeat(places[rows[i : i + BLOCK]], k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(many, m.n)),
                            pa.array(dev, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(y)), k))), pa.array(m.project(y).ravel()), pa.array(np.tile(m.values / m.trace, len(y))),
                            pa.array(np.full(many, errors[d])),
                        ],
                        names=["_keep", *OUT],
                    )

    return rows.mapInArrow(run, schema).select("_keep.*", *OUT)


def whitened(vectors: DataFrame, keep: list[str | Column], col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """:func:`whiten` with a model fitted on the same vectors. The packed fit list is written to the shared folder for the three readings of it, then deleted."""
    with scratch(vectors.sparkSession) as own:
        fit = own(fit_list(vectors, col, scale, offset))
        model = fit_whitening(fit, components, offset)
        errors = identity_errors(fit, model, offset)
    return whiten(vectors, model, errors, keep, col, scale, offset)
