"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers, so that sums and squared deviations are exact, and are written once
as blocks of a few thousand vectors. Every step of the bidiagonalisation is one Spark job over the
blocks: a task multiplies its centred rows with a vector (Xw) and the outcome with the rows
transposed (X'u); Spark adds the tasks' shares up, one number per dimension. The left vectors are
never stored: u = Xw, and w, one number per dimension, stays with the driver, as do v and X'u. Both
sides are reorthogonalised against all earlier vectors in each step. The driver holds at most
(dimensions x steps) numbers, whatever the number of vectors.

X'U, W and V give exact residuals of the small singular value problem. Steps go on until the wanted
components have converged, and then from a fresh random start until it is clear that no component
was missed, as equal eigenvalues would be from a single start.

Defined results: rows whose vector is null, or holds a null or a non-finite entry, are dropped, as
are vectors of another length than most have (the longest, if several lengths are as frequent).
Entries beyond 2^40 after scaling count as 2^40. Repeated rows count and are returned as often as
they are there, rows with a null id too. Components without variance are not returned, so there are
fewer than asked for if the vectors lie in fewer dimensions. Equal eigenvalues leave the choice of
axes open; it is the same for all rows. A deviation beyond a long is null. An empty table gives an
empty result. Columns other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import column_of
from ledgerframe.session import materialize

SCALE, SHIFT = 1024, 100_000
#: Largest whole number an entry can become, before the shift.
LARGEST = 1 << 40
BLOCK_ROWS = 4096
#: Residual of a component that counts as converged, as a share of the largest singular value.
CONVERGED = 1e-14
#: Steps from a fresh start that must leave the wanted components as they are.
CHECK_STEPS = 20
SEED = 12


def vectors(frame: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ident and vector (doubles) of the rows that count."""
    found = frame.select(F.col(ident).alias("ident"), F.col(vector).cast("array<double>").alias("vector"))
    # a comparison with NaN as such is true in Spark, so it is asked for by name
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = found.filter(F.col("vector").isNotNull()).filter(~F.coalesce(odd, F.lit(True)))
    lengths = found.groupBy(F.size("vector").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return found.filter(F.size("vector") == (usual[0]["length"] if usual else 0))


def blocks(found: DataFrame) -> DataFrame:
    """ids, rows, width, data: whole numbers without the shift, in the fewest bytes that hold a block."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                whole = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64)
                top = int(np.abs(whole).max(initial=0))
                width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                data = whole.astype(f"<i{width}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([part.num_rows], pa.int32()), pa.array([width], pa.int32()), pa.array([data], pa.binary())],
                    ["ids", "rows", "width", "data"],
                )

    kind = column_of(found, "ident", "ids").split(" ", 1)[1]
    return materialize(found.mapInArrow(packed, f"ids array<{kind}>, rows int, width int, data binary"), "vectors")


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The ids and the matrix of each block."""
    for batch in batches:
        at = {name: batch.schema.get_field_index(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            rows, width = batch.column(at["rows"])[i].as_py(), batch.column(at["width"])[i].as_py()
            matrix = np.frombuffer(batch.column(at["data"])[i].as_buffer(), f"<i{width}").reshape(rows, -1)
            yield (batch.column(at["ids"])[i].values if "ids" in at else None), matrix


def summed(stored: DataFrame, share: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum of ``share`` over all blocks: ``size`` numbers, added up by Spark."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for _, matrix in block_rows(batches):
            total += share(matrix)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "share"])

    slim = stored.select("rows", "width", "data")
    rows = slim.mapInArrow(shares, f"place int, share {kind}").groupBy("place").agg(F.sum("share").alias("share")).collect()
    total = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for row in rows:
        total[row["place"]] = row["share"]
    return total


@dataclass
class Components:
    """Axes (dimensions x count), their variances, all variance, and what centring needs."""

    axes: np.ndarray
    variances: np.ndarray
    trace: float
    n: int
    sums: np.ndarray
    steps: int


def components(stored: DataFrame, count: int) -> Components:
    """The leading principal components of the stored vectors."""
    first = stored.select("rows", F.length("data").alias("bytes"), "width").limit(1).collect()
    size = first[0]["bytes"] // first[0]["width"] // first[0]["rows"] if first else 0
    totals = summed(stored, lambda m: np.append(m.sum(axis=0, dtype=np.int64), len(m)), size + 1, "long")
    n, sums = int(totals[-1]), totals[:-1]
    if not n or not size:
        return Components(np.zeros((size, 0)), np.zeros(0), 0.0, n, sums, 0)
    mean = sums / n
    square = float(summed(stored, lambda m: np.array([np.square(m - mean).sum()]), 1, "double")[0])

    def products(w: np.ndarray) -> tuple[np.ndarray, float]:
        """X'u and u'u for u = Xw."""

        def share(matrix: np.ndarray) -> np.ndarray:
            centred = matrix - mean
            u = centred @ w
            return np.append(centred.T @ u, u @ u)

        found = summed(stored, share, size + 1, "double")
        return found[:-1], float(found[-1])

    return bidiagonalised(products, size, count, square, n, sums)


def bidiagonalised(products, size: int, count: int, square: float, n: int, sums: np.ndarray) -> Components:
    """The components from the products X'(Xw), (Xw)'(Xw) alone; ``square`` is the sum of X's squares."""
    rng = np.random.default_rng(SEED)
    right = np.zeros((size, 0))  # V
    weights = np.zeros((size, 0))  # W: U = XW
    images = np.zeros((size, 0))  # X'U
    tiny = np.sqrt(square) * 1e-13
    left_to_check, steps, before = None, 0, None

    def apart(vector: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(2):
            vector = vector - right @ (right.T @ vector)
        return vector, float(np.linalg.norm(vector))

    def fresh() -> np.ndarray:
        vector, length = apart(rng.standard_normal(size))
        return vector / length

    v = fresh() if square else None
    while v is not None and right.shape[1] < size:
        # Xv less what earlier left vectors hold of it; these parts are known from X'U
        w = v - weights @ (images.T @ v)
        right = np.column_stack([right, v])
        image, length = products(w)
        steps += 1
        held = weights.T @ image  # U'u: what rounding left of earlier vectors
        alpha = np.sqrt(max(length - held @ held, 0.0))
        if alpha > tiny:
            weights = np.column_stack([weights, (w - weights @ held) / alpha])
            images = np.column_stack([images, (image - images @ held) / alpha])
        # U'XV, bidiagonal but for fresh starts
        small = images.T @ right
        p, s, q = np.linalg.svd(small, full_matrices=False)
        wanted = min(count, int((s > tiny).sum()))
        residual = images @ p[:, :wanted] - right @ q[:wanted].T * s[:wanted]
        settled = wanted == count and bool((np.linalg.norm(residual, axis=0) <= CONVERGED * s[0]).all())
        if settled and square - float(s @ s) < s[count - 1] ** 2:
            break  # what is left of the variance can't hold a larger component
        if settled and left_to_check is None:
            left_to_check, before = CHECK_STEPS, s[:count]
            v = fresh() if right.shape[1] < size else None
            continue
        if left_to_check is not None:
            if not np.allclose(s[:count], before, rtol=1e-10):
                left_to_check = None
            else:
                left_to_check -= 1
                if settled and left_to_check <= 0:
                    break
        if right.shape[1] < size:
            following, beta = apart(images[:, -1]) if alpha > tiny else (None, 0.0)
            v = following / beta if beta > tiny else fresh()
    if not right.shape[1]:
        return Components(np.zeros((size, 0)), np.zeros(0), square / n, n, sums, steps)
    _, s, q = np.linalg.svd(images.T @ right, full_matrices=False)
    wanted = min(count, int((s > tiny).sum()))
    axes = np.linalg.qr(right @ q[:wanted].T)[0] if wanted else np.zeros((size, 0))
    return Components(axes, s[:wanted] ** 2 / n, square / n, n, sums, steps)


def deviations(matrix: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n*x - S)^2 per row, exact; null beyond a long."""
    rough = np.square(matrix * float(n) - sums).sum(axis=1)
    with np.errstate(over="ignore"):
        exact = np.square(matrix * np.int64(n) - sums).sum(axis=1)
    values = exact.tolist()
    for i in np.flatnonzero(rough > 2.0**62).tolist():
        whole = sum((n * x - s) ** 2 for x, s in zip(matrix[i].tolist(), sums.tolist(), strict=True))
        values[i] = whole if whole < 1 << 63 else None
    return pa.array(values, pa.int64())


def whitened(frame: DataFrame, count: int = 8, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: its whitened coordinate, with the fit's figures."""
    stored = blocks(vectors(frame, ident, vector))
    found = components(stored, count)
    width = found.axes.shape[1]
    n, sums, mean = found.n, found.sums, found.sums / max(found.n, 1)
    turn = found.axes / np.sqrt(found.variances)

    def moments(matrix: np.ndarray) -> np.ndarray:
        z = (matrix - mean) @ turn
        return np.append((z.T @ z).ravel(), z.sum(axis=0))

    error = 0.0
    if width:
        both = summed(stored, moments, width * width + width, "double") / n
        middle = both[width * width :]
        covariance = both[: width * width].reshape(width, width) - np.outer(middle, middle)
        error = float(np.abs(covariance - np.eye(width)).max())
    shares = found.variances / (found.trace or 1.0)
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in block_rows(batches):
            size = len(matrix)
            each = np.repeat(np.arange(size), width)
            z = (matrix - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * width, n, np.int64)),
                    deviations(matrix, n, sums).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(shares, size)),
                    pa.array(np.full(size * width, error)),
                ],
                [ident, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"{ident} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return stored.mapInArrow(rows, schema)
