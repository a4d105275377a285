"""Embedding whitening: the leading eigenvectors of the covariance by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is one distributed pass over the fit list: every task centres its
vectors and adds up C^T (C Q) for a few columns Q at once, and only that small matrix (components x columns) goes to the
driver. There the Ritz pairs of the subspace are formed; pairs whose residual reaches double precision are locked, and for
the others the projected correction equations are solved together by a few steps of MINRES, each step one more pass.

The fit list is each distinct vector of whole numbers once, written to the shared folder as blocks of rows; what grows
with the data stays there. The offset that the contract adds to every entry cancels in all results and is not stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import stage

SCALE = 64
#: Entries beyond this count as this. Far above any embedding; below it every double holds a whole number exactly.
LARGEST = float(1 << 52)
#: Ritz vectors kept beside the wanted ones, MINRES steps of a correction, and outer rounds before giving up.
GUARD, INNER, ROUNDS = 4, 5, 300
#: Residual, as a part of the largest eigenvalue, at which a pair is locked.
TOLERANCE = 128 * np.finfo(float).eps
#: Partial sums that the driver adds up itself; more of them are first added up by tasks.
FAN = 256
_LOW = 26


@dataclass
class Whitening:
    """What a fit gives: exact counts and sums, and per component the direction, its eigenvalue and the share of variance."""

    n: int
    sums: list[int]
    largest: int
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def whole(self) -> bool:
        return self.n * (self.largest + 1) < 1 << 62

    def differences(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exactly: int64, or Python integers where those could overflow."""
        if self.whole:
            return self.n * y - np.array(self.sums, np.int64)
        return self.n * y.astype(object) - np.array(self.sums, object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """y - S / n, rounded once."""
        return (self.differences(y) / self.n).astype(np.float64)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.vectors / np.sqrt(self.values)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Per row the exact sum of (n * y - S)^2; None if no long holds it."""
        z = self.differences(y)
        if z.dtype == object or (len(z) and float(np.abs(z).max()) ** 2 * z.shape[1] >= 2.0**62):
            z = z.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def usable(vectors: DataFrame, name: str) -> DataFrame:
    """vec_id and v (array<double>) of the rows whose vector is not null and holds finite numbers only."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )


def usual_length(found: DataFrame) -> int:
    """The length that most vectors have, the smaller of two equally frequent; 0 without vectors."""
    usual = found.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), "n").first()
    return usual["n"] if usual else 0


def cells(found: DataFrame, length: int) -> DataFrame:
    """vec_id and x (binary): floor(64 c) of every entry of the vectors of ``length`` entries; others are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(y)], names=["vec_id", "x"])

    return found.where(F.size("v") == length).mapInArrow(scan, "vec_id long, x binary")


def packed(values: np.ndarray) -> pa.Array:
    """A key per row: its whole numbers in four bytes each, in eight if one of them needs more."""
    y = np.clip(np.floor(values * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)
    wide = (np.abs(y) >= 1 << 31).any(axis=1)
    return pa.array([(row if w else row.astype(np.int32)).tobytes() for row, w in zip(y, wide)], pa.binary())


def unpacked(keys: pa.Array, length: int) -> np.ndarray:
    parts = [np.frombuffer(key, np.int32 if len(key) == 4 * length else np.int64) for key in keys.to_pylist()]
    return np.array(parts, np.int64).reshape(-1, length)


def fit_list(rows: DataFrame, length: int) -> DataFrame:
    """Each distinct x once, many to a row: ``bytes`` (of a whole number) and ``data``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = unpacked(batch.column(0), length)
            step = max(1, (1 << 18) // length)
            for part in (y[i : i + step] for i in range(0, len(y), step)):
                kind = next(k for k in (np.int16, np.int32, np.int64) if (np.abs(part) <= np.iinfo(k).max).all())
                yield pa.RecordBatch.from_arrays([pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["bytes", "data"])

    return stage(rows.select("x").distinct().mapInArrow(scan, "bytes int, data binary"), "fit-list")


def total(blocks: DataFrame, parts: int, length: int, kind: str, partial: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """The sum of ``partial`` over all tasks, as a flat array; None without tasks. Many tasks add up in levels of FAN."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield np.frombuffer(data, f"i{size}").astype(np.int64).reshape(-1, length)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([partial(rows(batches)).astype(kind).tobytes()], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(p, kind) for batch in batches for p in batch.column(0).to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([sum(found[1:], found[0]).tobytes()], pa.binary())], names=["part"])

    sums = blocks.mapInArrow(scan, "part binary")
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, "part binary")
    found = [np.frombuffer(r["part"], kind) for r in sums.collect()]
    return sum(found[1:], found[0]) if found else None


def _added(terms: Iterator[np.ndarray], zero: np.ndarray) -> np.ndarray:
    """A compensated sum, so that the error does not grow with the number of blocks."""
    result, lost = zero, np.zeros_like(zero)
    for term in terms:
        term = term - lost
        following = result + term
        lost = (following - result) - term
        result = following
    return result


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], size: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors of a symmetric positive operator.

    ``product`` maps size x p columns at once. Pairs are locked from the largest down. RuntimeError after ROUNDS rounds.
    """
    count = min(count, size)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((size, min(size, count + GUARD))))[0]
    images, locked, values = product(basis), np.zeros((size, 0)), []
    least, patience = np.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, images = basis @ turn, images @ turn
        basis = ritz
        wanted = count - len(values)
        scale = max([abs(float(theta[0])), *values], default=0.0)
        residual = images[:, :wanted] - ritz[:, :wanted] * theta[:wanted]
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = 0
        while done < wanted and norms[done] <= TOLERANCE * scale:
            done += 1
        if done < wanted:  # rounding alone may hold a residual just above the limit
            patience = 0 if done or norms[done] < 0.5 * least else patience + 1
            least = norms[done] if done else min(least, norms[done])
            if patience >= 6 and norms[done] <= 1e4 * TOLERANCE * scale:
                done, patience, least = done + 1, 0, np.inf
        if done:
            locked = np.hstack([locked, ritz[:, :done]])
            values += [float(v) for v in theta[:done]]
            basis, images = basis[:, done:], images[:, done:]
            theta, residual = theta[done:], residual[:, done:]
            if len(values) == count:
                order = np.argsort(values)[::-1]
                return np.array(values)[order], locked[:, order]
        wanted = count - len(values)
        room = size - locked.shape[1]
        if basis.shape[1] >= room or basis.shape[1] < wanted or basis.shape[1] + wanted > 4 * (count + GUARD):
            # Restart from the best Ritz vectors, with fresh images that carry no rounding from earlier rounds.
            keep = basis if basis.shape[1] >= room else basis[:, : wanted + GUARD]
            fill = np.random.default_rng(len(values)).standard_normal((size, max(0, min(room, wanted) - keep.shape[1])))
            basis = _orthonormal(np.hstack([keep, fill]), locked, np.zeros((size, 0)))
            images = product(basis)
            if basis.shape[1] >= room:
                continue
            theta = (basis * images).sum(axis=0)
            residual = images - basis * theta
            residual -= locked @ (locked.T @ residual)
        width = min(wanted, residual.shape[1], basis.shape[1])
        steps = _minres(product, locked, basis[:, :width], theta[:width], -residual[:, :width])
        more = _orthonormal(steps, locked, basis)[:, : room - basis.shape[1]]
        if more.shape[1]:
            basis, images = np.hstack([basis, more]), np.hstack([images, product(more)])
    raise RuntimeError("Jacobi-Davidson did not reach double precision")


def _orthonormal(columns: np.ndarray, locked: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``columns`` outside ``locked`` and ``basis``; what lies inside them goes."""
    known, result = np.hstack([locked, basis]), []
    for column in columns.T:
        norm = np.linalg.norm(column)
        if not np.isfinite(norm) or norm == 0:
            continue
        column = column / norm
        for _ in range(3):
            column = column - known @ (known.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        if left >= 1e-10:
            result.append(column)
            known = np.hstack([known, column[:, None]])
    return np.array(result).T if result else np.zeros((len(columns), 0))


def _minres(product: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, ritz: np.ndarray, theta: np.ndarray, right: np.ndarray) -> np.ndarray:
    """INNER steps of MINRES for (I - QQ')(A - theta I)(I - QQ') t = right, Q the locked vectors and the own Ritz vector, for all columns at once."""

    def project(x: np.ndarray) -> np.ndarray:
        x = x - locked @ (locked.T @ x)
        return x - ritz * (ritz * x).sum(axis=0)

    with np.errstate(divide="ignore", invalid="ignore"):
        v, before = project(right), np.zeros_like(right)
        beta = np.linalg.norm(v, axis=0)
        tiny = np.maximum(beta, 1e-300) * 1e-14
        v = v / np.maximum(beta, 1e-300)
        eta, solution = beta.copy(), np.zeros_like(right)
        cosine, older_cosine = np.ones_like(beta), np.ones_like(beta)
        sine, older_sine = np.zeros_like(beta), np.zeros_like(beta)
        w, older_w = np.zeros_like(right), np.zeros_like(right)
        beta = np.zeros_like(beta)
        active = eta > 0
        for _ in range(INNER):
            if not active.any():
                break
            image = project(product(v) - v * theta)
            alpha = (v * image).sum(axis=0)
            following = image - v * alpha - before * beta
            next_beta = np.linalg.norm(following, axis=0)
            delta = cosine * alpha - older_cosine * sine * beta
            first = np.hypot(delta, next_beta)
            second = sine * alpha + older_cosine * cosine * beta
            third = older_sine * beta
            usable = active & (first > tiny)
            safe = np.where(usable, first, 1.0)
            direction = (v - older_w * third - w * second) / safe
            older_cosine, older_sine = cosine, sine
            cosine, sine = delta / safe, next_beta / safe
            solution = np.where(usable, solution + direction * (cosine * eta), solution)
            eta = -sine * eta
            older_w, w = w, direction
            active = usable & (next_beta > tiny)
            before, v, beta = v, np.where(active, following / np.where(next_beta > 0, next_beta, 1.0), 0.0), next_beta
        return project(solution)


def fit(rows: DataFrame, length: int, components: int) -> Whitening:
    """Fit on the distinct x of ``rows`` (``cells``). Components without variance are left out; none if no x differs."""
    blocks = fit_list(rows, length)
    parts = blocks.rdd.getNumPartitions()
    low = (1 << _LOW) - 1

    def sums(found: Iterator[np.ndarray]) -> np.ndarray:
        result = np.zeros(2 + 2 * length, np.int64)
        for y in found:
            result[0] += len(y)
            result[2 : 2 + length] += (y >> _LOW).sum(axis=0)
            result[2 + length :] += (y & low).sum(axis=0)
        return result

    added = total(blocks, parts, length, "int64", sums)
    n = int(added[0]) if added is not None else 0
    whole = [(int(h) << _LOW) + int(k) for h, k in zip(added[2 : 2 + length], added[2 + length :])] if n else [0] * length
    # Entries are kept by their width in the blocks; its greatest number bounds every product exactly.
    width = blocks.agg(F.max("bytes")).first()[0] or 2
    model = Whitening(n, whole, int(LARGEST) if width == 8 else (1 << (8 * width - 1)) - 1, np.zeros((length, 0)), np.zeros(0), np.zeros(0), None)
    if n < 2:
        return model

    def product(columns: np.ndarray) -> np.ndarray:
        def centred(found: Iterator[np.ndarray]) -> np.ndarray:
            terms = ((c.T @ (c @ columns)) for c in map(model.centred, found))
            return _added(terms, np.zeros_like(columns))

        return total(blocks, parts, length, "float64", centred).reshape(columns.shape) / n

    def squares(found: Iterator[np.ndarray]) -> np.ndarray:
        return _added(((model.centred(y) ** 2).sum(axis=0) for y in found), np.zeros(length))

    trace = float(total(blocks, parts, length, "float64", squares).sum()) / n
    if trace == 0:
        return model
    values, vectors = leading_eigenpairs(product, length, components)
    real = values > length * 16 * np.finfo(float).eps * values[0]
    model.vectors, model.values, model.explained = vectors[:, real], values[real], values[real] / trace
    count = int(real.sum())
    mean = total(blocks, parts, length, "float64", lambda found: _added((model.whitened(y).sum(axis=0) for y in found), np.zeros(count))) / n

    def outer(found: Iterator[np.ndarray]) -> np.ndarray:
        return _added((w.T @ w for w in (model.whitened(y) - mean for y in found)), np.zeros((count, count)))

    covariance = total(blocks, parts, length, "float64", outer).reshape(count, count) / n
    model.identity_error = float(np.abs(covariance - np.eye(count)).max())
    return model


def whiten(vectors: DataFrame, name: str = "embedding", components: int = 16, length: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every usable row in every component.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those of another ``length`` (without
    it: of another than most have). Null ids stay, other columns are ignored.
    Repeated rows give repeated results; ties of eigenvalues give any orthonormal basis of their space. An empty table, or
    one with a single distinct vector, has no variance and gives no rows. ``deviation`` is null where no long holds it.
    """
    found = usable(vectors, name)
    length = usual_length(found) if length is None else length
    rows = cells(found, length)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not length:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(rows, length, components)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        count = len(known.values)
        for batch in batches:
            step = max(1, (1 << 18) // length)
            for at in range(0, len(batch) if count else 0, step):
                part = batch.slice(at, step)
                y = unpacked(part.column(1), length)
                every = np.repeat(np.arange(len(y)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(every)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(len(every), known.n)), pa.array(known.deviation(y), pa.int64()).take(pa.array(every)),
                        pa.array(known.whitened(y).reshape(-1)), pa.array(np.tile(known.explained, len(y))), pa.array(np.full(len(every), known.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(scan, schema)
