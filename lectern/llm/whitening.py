"""Embedding whitening by TSQR: no covariance is formed to find the components.

Each entry c of a vector becomes the integer floor(1024 * c) + 100000, so sums over all
rows are exact whatever their order. Rows are centred by these sums, ``(n * x - S) / n``,
each partition is reduced to the R of its QR factorisation, and R factors are merged FAN
at a time in rounds until one is left: a round is a shuffle of d x d matrices and is
written to the shared folder, so a lost executor repeats no more than one round. The
right singular vectors of the last R are the eigenvectors of the covariance, its squared
singular values over n the eigenvalues. The driver receives the sums (d numbers) and that
last R (d x d); tasks hold two matrices at most besides a block of rows.

``identity_error`` is measured on the whitened rows themselves, in a pass of its own.

Edge cases: null vectors, and vectors with a null, NaN or infinite entry or one of 2**43
and beyond (not representable in the exact sums), are dropped. The dimension is that of
most vectors (of those that tie the largest); others lack entries, or have surplus ones,
and are dropped alike. Fewer components than asked come of fewer dimensions. A component
without variance has whitened and explained 0 in all rows and no part in
``identity_error``. Repeated rows all count and are all returned; a null id is an id. An
empty table, or one without a vector of one dimension or more, gives no rows. A deviation
beyond 2**63 is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, drop, workers_see_package

COMPONENTS = 8
#: R factors that one step of the merge tree takes.
FAN = 16
UNITS, SHIFT = 1024, 100_000
#: Entries from here on are not taken for numbers; singular values below this share of the largest are none.
TOO_LARGE, NOTHING = 2.0**43, 1e-12
#: Rows that are factored at once, at least.
BLOCK = 2048


def integers(column: pa.ListArray, dimension: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of the rows kept, their entries as integers) for each dimension in a column of vectors, or the one asked for."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries become NaN
    held = np.maximum(sizes, 0)
    for d in [dimension] if dimension is not None else np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        own = flat[np.repeat(sizes == d, held)].reshape(len(rows), d)
        whole = (np.abs(own) < TOO_LARGE).all(axis=1)  # false for NaN
        yield d, rows[whole], np.floor(own[whole] * UNITS).astype(np.int64) + SHIFT


def _fits(*factors: int) -> bool:
    """Whether a product of bounds stays within 64 bits."""
    bound = 1
    for f in factors:
        bound *= int(f)
    return bound < 2**62


def _most(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=1))


def sums(vectors: DataFrame) -> DataFrame:
    """(vector) -> dimension, at, total (exact), n: sums of integers by dimension and place; place -1 counts the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in integers(batch.column(0)):
                total = x.sum(axis=0) if _fits(_most(x), max(len(x), 1)) else x.astype(object).sum(axis=0)
                n, before = found.setdefault(d, [0, np.zeros(d, object)])
                found[d] = [n + len(rows), before + total.astype(object)]
        for d, (n, total) in found.items():
            texts = [str(v) for v in [0, *total.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array(texts, pa.string()), pa.array([n] * (d + 1), pa.int64())], ["dimension", "at", "total", "n"])

    return vectors.select("vector").mapInArrow(run, "dimension int, at int, total string, n long").groupBy("dimension", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


class Centre:
    """Count and exact sums of the fit list; what a task needs to centre its rows."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold them, else Python's."""
        if _fits(self.n, 2 * _most(x)) and _fits(2 * max(map(abs, self.total), default=0)):
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def rows(self, numerators: np.ndarray) -> np.ndarray:
        return (numerators / self.n).astype(np.float64)

    @staticmethod
    def deviations(numerators: np.ndarray) -> list[int | None]:
        if numerators.dtype == object or not _fits(_most(numerators), _most(numerators), numerators.shape[1]):
            return [v if v < 2**63 else None for v in (numerators.astype(object) ** 2).sum(axis=1).tolist()]
        return (numerators**2).sum(axis=1).tolist()


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def _row(key: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.ascontiguousarray(r, "<f8").tobytes()], pa.binary())], ["id", "r"])


def factors(vectors: DataFrame, centre: Centre) -> DataFrame:
    """(vector) -> id, r: the R factor of each partition's centred rows."""
    d = len(centre.total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, x in integers(batch.column(0), d):
                held.append(centre.rows(centre.numerators(x)))
                size += len(x)
            if size >= max(BLOCK, 4 * d):
                held, size = [_factor(held)], 0
        if held:
            yield _row(TaskContext.get().partitionId(), _factor(held))

    return vectors.select("vector").mapInArrow(run, "id long, r binary")


def merged(rs: DataFrame, d: int) -> np.ndarray:
    """One R factor out of many: FAN neighbours become one, round after round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r = None, None
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(data.as_py(), "<f8").reshape(-1, d)
                if key == now:
                    r = _factor([r, own])
                else:
                    if now is not None:
                        yield _row(now, r)
                    now, r = key, own
        if now is not None:
            yield _row(now, r)

    rs = cut(rs, "factors")
    while (last := rs.agg(F.max("id")).first()[0]) > 0:
        groups = last // FAN + 1
        step = rs.select(F.floor(F.col("id") / FAN).alias("up"), "id", "r").repartition(groups, "up").sortWithinPartitions("up", "id")
        after = cut(step.select("up", "r").mapInArrow(run, "id long, r binary"), "factors")
        drop(rs)
        rs = after
    found = np.frombuffer(rs.first()["r"], "<f8").reshape(-1, d)
    drop(rs)
    return found


class Whitening:
    """Components by falling eigenvalue, and the eigenvalues' shares."""

    def __init__(self, centre: Centre, r: np.ndarray, components: int):
        _, s, right = np.linalg.svd(r, full_matrices=False)
        some = min(components, len(centre.total))
        s, right = (np.concatenate([x, np.zeros((max(some - len(x), 0), *x.shape[1:]))]) for x in (s, right))
        energy = s**2
        self.centre, self.live = centre, s[:some] > NOTHING * max(s.max(initial=0), 0.5)
        right = right[:some] * np.where(np.take_along_axis(right[:some], np.abs(right[:some]).argmax(axis=1)[:, None], 1) < 0, -1, 1)  # the largest entry is positive
        scale = np.where(self.live, np.sqrt(centre.n) / np.where(self.live, s[:some], 1), 0)
        self.vectors, self.map = right, (right * scale[:, None]).T
        self.explained = np.where(self.live, energy[:some] / (energy.sum() or 1), 0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """(vector) -> the whitening of all its rows; None where there are no vectors."""
    found = cut(sums(vectors), "sums")
    most = found.where("at = -1 and dimension > 0 and n > 0").orderBy(F.desc("n"), F.desc("dimension")).select("dimension", "n").first()
    if most is None:
        return None
    d, n = most
    centre = Centre(n, [int(r[0]) for r in found.where((F.col("dimension") == d) & (F.col("at") >= 0)).orderBy("at").select("total").collect()])
    drop(found)
    return Whitening(centre, merged(factors(vectors, centre), d), components)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    d, k = len(model.centre.total), int(model.live.sum())
    cells = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, _, x in integers(batch.column(0), d):
                w = model.centre.rows(model.centre.numerators(x)) @ model.map[:, model.live]
                products += w.T @ w
                plain += w.sum(axis=0)
        values = [*plain.tolist(), *[products[c] for c in cells]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], ["cell", "value"])

    if not k:
        return 0.0
    rows = vectors.select("vector").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect()
    value = {c: v / model.centre.n for c, v in rows}
    return max(abs(value[k + at] - value[i] * value[j] - (i == j)) for at, (i, j) in enumerate(cells))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row a vector and component."""
    workers_see_package(embeddings.sparkSession)
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, deviation long, whitened double, explained double"
    model = fit(rows, components)
    if model is None:
        out, n, error = embeddings.sparkSession.createDataFrame([], schema), 0, 0.0
    else:
        n, error = model.centre.n, identity_error(rows, model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(model.explained)
            for batch in batches:
                for _, places, x in integers(batch.column(1), len(model.centre.total)):
                    above = model.centre.numerators(x)
                    w = model.centre.rows(above) @ model.map
                    each = np.repeat(np.arange(len(places)), k)
                    columns = [batch.column(0).take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))), pa.array(model.centre.deviations(above), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(model.explained, len(places)))]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

        out = rows.mapInArrow(run, schema)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
