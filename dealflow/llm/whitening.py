"""Embedding whitening by shifted CholeskyQR.

The centred vectors, one row each, are a tall matrix ``A``. A distributed pass adds up its Gram matrix, whose Cholesky
factor ``R`` orthogonalises the rows by a triangular solve per row; the first factor is that of the Gram matrix with a
small shift, so that it exists for any matrix. Further passes do the same with the rows already solved until their
Gram matrix is the identity, up to rounding and directions without any spread. The product of the factors is the ``R`` of
``A = Q R``, and its singular values and right vectors are those of ``A``: the spreads and components of the vectors, with
the accuracy of the vectors rather than that of their squares.

Only matrices of width times width leave the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealflow.session import materialise

SCALE = 256  # steps per unit of an entry
COMPONENTS = 4
LARGEST = 1 << 53  # entries beyond this many steps are taken as this
MOST_WIDTH = 4096  # bound of the matrices that tasks and the driver hold: 128 MB
ROUNDING = np.finfo(np.float64).eps / 2
MOST_PASSES = 12
TOLERANCE = 1e-13  # of a Gram matrix, per component
FEW = 32  # partial sums that reach the driver at most
BATCH = 4096  # rows solved together
LONG = 1 << 63


def steps(entry: Column) -> Column:
    """``floor(256 * entry)`` as a long."""
    value = F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), entry.cast("double") * SCALE))
    return F.floor(value).cast("long")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of ``vectors(vec_id, embedding)`` without null vectors and those with a null or non-finite entry.

    Vectors shorter than the longest get zeros at the end.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & finite).select("vec_id", F.transform("embedding", steps).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as longs, filled up to ``width`` by zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * width:
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        out[i, : len(row)] = row.as_py()
    return out


def _slices(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield _matrix(batch[name].slice(at, BATCH), width)


def summed(rows: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], name: str = "x", width: int = 0) -> np.ndarray:
    """The sum of ``part`` over blocks of rows, as doubles.

    Each task adds up its own; the tasks' sums are added up by ever fewer tasks until ``FEW`` are left for the driver.
    No task holds more than one sum.
    """
    width = width or shape[0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in _slices(batches, name, width):
            total += part(block)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            for one in batch["total"]:
                total, some = total + np.frombuffer(one.as_py()).reshape(shape), True
        if some:
            yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    sums = rows.select(name).mapInArrow(add, "total binary")
    count = rows.rdd.getNumPartitions()
    while count > FEW:
        count = max(FEW, int(count**0.5))
        sums = sums.repartition(count).mapInArrow(merge, "total binary")
    found = [np.frombuffer(r["total"]).reshape(shape) for r in sums.collect()]
    return np.sum(found, axis=0) if found else np.zeros(shape)


def exact_sums(rows: DataFrame, width: int) -> list[int]:
    """The sum per dimension as whole numbers of any size, added up in two halves of 32 bits."""
    halves = [F.sum(F.shiftright("v", 32).cast("decimal(38,0)")).alias("high"), F.sum(F.col("v").bitwiseAND(0xFFFFFFFF).cast("decimal(38,0)")).alias("low")]
    found = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(*halves).collect()  # one row per dimension
    sums = [0] * width
    for r in found:
        sums[r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return sums


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n``, from the exact differences ``n * x - sums``."""
    return _differences(x, n, sums).astype(np.float64) / n


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: longs where they are enough, else Python's whole numbers."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if largest < LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact squared length of ``n * x - sums`` per row; None beyond the range of a long."""
    differences = _differences(x, n, sums)
    width = x.shape[1]
    if differences.dtype != object and float(np.abs(differences).max(initial=0)) ** 2 * width < LONG / 2:
        return (differences * differences).sum(1).tolist()
    squares = (differences.astype(object) ** 2).sum(1) if width else [0] * len(x)
    return [int(s) if s < LONG else None for s in squares]


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn."""
    for factor in factors:
        rows = triangular(factor, rows.T).T
    return rows


def triangular(upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve ``upper.T @ y = right`` by forward substitution, a dimension at a time for all columns of ``right``."""
    out = np.empty_like(right, np.float64)
    for i in range(len(upper)):
        out[i] = (right[i] - upper[:i, i] @ out[:i]) / upper[i, i]
    return out


def factor(gram: np.ndarray, rows: int, first: bool) -> np.ndarray:
    """The Cholesky factor of a Gram matrix, shifted at the first pass and where it is not positive."""
    width = len(gram)
    shift = 11 * (rows * width + width * (width + 1)) * ROUNDING * float(np.linalg.norm(gram, 2))
    least = np.linalg.eigvalsh(gram)[0]
    if first or least <= shift:
        gram = gram + max(shift, np.finfo(np.float64).tiny) * np.eye(width)
    return np.linalg.cholesky(gram).T


def orthogonal(gram: np.ndarray) -> bool:
    """Whether a Gram matrix is the identity on the directions that have any spread."""
    values = np.linalg.eigvalsh(gram)
    slack = TOLERANCE * len(gram)
    return bool(np.all((np.abs(values - 1) <= slack) | (np.abs(values) <= slack)))


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """``R`` of the centred rows of ``fit(x)``, by repeated passes of shifted CholeskyQR.

    Each dimension is divided by its root mean square first, which ``R`` takes back; one without spread stays zero.
    """
    width = len(sums)
    squares = summed(fit, (width,), lambda x: (centred(x, n, sums) ** 2).sum(0))
    if not squares.any():
        return np.zeros((width, width))
    scale = np.where(squares > 0, np.sqrt(squares), 1.0)
    factors: list[np.ndarray] = []
    whole = np.eye(width)
    for step in range(MOST_PASSES):
        held = list(factors)

        def part(x: np.ndarray, held: list[np.ndarray] = held) -> np.ndarray:
            q = solved(centred(x, n, sums) / scale, held)
            return q.T @ q

        gram = summed(fit, (width, width), part)
        if step and orthogonal(gram):
            break
        factors.append(factor(gram, n, not step))
        whole = factors[-1] @ whole
    return whole * scale


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first ``most`` eigenvalues and unit eigenvectors (columns) of the covariance, and its trace.

    Directions without spread, up to rounding, are no components. An eigenvector's largest entry is positive.
    """
    _, spread, vectors = np.linalg.svd(r)
    values = spread**2 / n
    held = spread > len(spread) * 4 * ROUNDING * spread.max(initial=0.0)
    vectors = vectors[held][:most]
    if len(vectors):
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
        vectors = vectors * signs[:, None]
    return values[held][:most], vectors.T, float(values.sum())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened components of ``vectors(vec_id, embedding)``: a row per vector and component.

    Vectors that are null or hold a null or non-finite entry are left out; a null ``vec_id`` and repeated rows are rows
    like any other, and shorter vectors are filled up by zeros. Entries are taken in whole steps, ``x``, entries beyond
    2^53 steps as 2^53. Fitted is each distinct ``x`` once: ``n`` of them, with sums ``S``. Columns: ``vec_id, component``
    (from 1, by falling eigenvalue ``e``), ``n``, ``deviation`` (sum of ``(n * x - S)^2``, null beyond a long), ``whitened``
    (``x - S / n`` on the component, over ``sqrt(e)``), ``explained`` (``e / trace``) and ``identity_error``, the largest entry
    of the whitened vectors' covariance less the identity. There are fewer components than ``most`` if the vectors spread
    in fewer directions, and no rows if in none.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = schema.replace("vec_id long", f"vec_id {dict(vectors.dtypes)['vec_id']}")
    rows = materialise(usable(vectors.select("vec_id", "embedding")), "steps")
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of over {MOST_WIDTH} entries")
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    fit = materialise(rows.select(filled.alias("x")).groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    n = fit.count()
    if not width or not n:
        return spark.createDataFrame([], schema)
    sums = exact_sums(fit, width)
    values, axes, trace = components(triangle(fit, n, sums), n, most)
    found = len(values)
    if not found:
        return spark.createDataFrame([], schema)
    onto = axes / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) @ onto

    mean = summed(fit, (found,), lambda x: whitened(x).sum(0), width=width) / n
    covariance = summed(fit, (found, found), lambda x: (whitened(x) - mean).T @ (whitened(x) - mean), width=width) / n
    error = float(np.abs(covariance - np.eye(found)).max())
    explained = (values / trace).tolist()

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                ids = batch["vec_id"].slice(at, BATCH)
                x = _matrix(batch["x"].slice(at, BATCH), width)
                count = len(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(np.repeat(np.arange(count), found))),
                        "component": pa.array(np.tile(np.arange(1, found + 1), count), pa.int32()),
                        "n": pa.array(np.full(count * found, n), pa.int64()),
                        "deviation": pa.array([d for d in deviations(x, n, sums) for _ in range(found)], pa.int64()),
                        "whitened": whitened(x).reshape(-1),
                        "explained": np.tile(explained, count),
                        "identity_error": np.full(count * found, error),
                    }
                )

    return rows.mapInArrow(show, schema)
