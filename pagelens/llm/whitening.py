"""Whitening of vectors by QDWH spectral divide and conquer.

Vectors become integers ``floor(256 * component)``; the fit list holds each
distinct one once. Its count, sums and the sums of products of rows centred at
the rounded mean are added up exactly, as integers, so the covariance is the
true one rounded once, whatever the number and order of tasks.

The eigenvectors come from spectral divide and conquer: the polar factor ``U``
of the covariance less a shift (found by QR-based dynamically weighted Halley
iterations) gives the projector ``(U + I) / 2`` on the eigenvectors above the
shift, whose range and complement split the matrix in two smaller ones. Of the
parts below, only those that can hold a wanted component are split on.

The model of a vector length (its mean and ``COMPONENTS`` directions) is sent
to all tasks, which project their rows.

Defined results: rows whose vector is NULL or holds a NULL or non-finite entry
are left out; integers beyond 64 bits take the nearest bound; vectors of
different lengths have fits of their own; vectors of fewer entries than
components have as many components as entries, empty ones none; a component
without variance (a single distinct vector, or an eigenvalue that is nothing
beside the largest) has NULL ``whitened`` and does not count in
``identity_error``; a ``deviation`` beyond 64 bits is NULL; repeated rows are
each given their result; an empty table gives no rows; other columns are
ignored.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagelens.llm.numbers import finite, floored, rows_by_size
from pagelens.operators.shared import cut

SCALE = 256
COMPONENTS = 4
# Tasks whose sums are added in one go; more are added in two steps.
GROUP_TASKS = 256
LONG = 1 << 63
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by QDWH.

    ``low`` bounds the least singular value of the iterate from below; it sets
    the weights, which take it to one in at most six steps from 1e-16.
    """
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    one = np.eye(len(x))
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        before = x
        if r > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
            upper, lower = both[: len(x)], both[len(x) :]
            x = q / r * x + (p - q / r) / np.sqrt(r) * (upper @ lower.T)
        else:
            half = np.linalg.inv(np.linalg.cholesky(one + r * (x.T @ x)))
            x = q / r * x + (p - q / r) * ((x @ half.T) @ half)
        x = (x + x.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        if 1 - low < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray):
    """Orthonormal bases of the eigenvectors above and below a shift.

    The median of the diagonal halves the spectrum; the mean lies strictly
    inside it. A shift on an eigenvalue gives no projector: the next is tried.
    """
    diagonal = np.sort(np.diag(a))
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / len(a)
    shifts = [np.median(diagonal), mean]
    shifts += [mean + f * spread for f in (1 / 8, -1 / 8, 1 / 4, -1 / 4, 1 / 3, -1 / 3)]
    best = None
    for shift in shifts:
        u = polar(a - shift * np.eye(len(a)))
        above = int(round((np.trace(u) + len(a)) / 2))
        if not 0 < above < len(a):
            continue
        projector = (u + np.eye(len(a))) / 2
        lead = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")[:above]
        start = projector[:, lead]
        for _ in range(2):
            basis, _ = np.linalg.qr(start, mode="complete")
            start = projector @ basis[:, :above]
        basis, _ = np.linalg.qr(start, mode="complete")
        upper, lower = basis[:, :above], basis[:, above:]
        miss = np.linalg.norm(lower.T @ a @ upper)
        if best is None or miss < best[0]:
            best = miss, upper, lower
        if miss <= 10 * len(a) * EPS * np.linalg.norm(a):
            break
    return best and best[1:]


def leading(a: np.ndarray, wanted: int, floor: float = 0.0):
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and
    their vectors. Off-diagonal parts below ``floor`` are rounding."""
    floor = floor or len(a) * EPS * np.linalg.norm(a)
    rest = a - np.diag(np.diag(a))
    parts = None if np.linalg.norm(rest) <= floor else _halves(a)
    if parts is None:
        order = np.argsort(-np.diag(a), kind="stable")[:wanted]
        return np.diag(a)[order], np.eye(len(a))[:, order]
    found = []
    for basis in parts:
        if wanted > 0:
            small = basis.T @ a @ basis
            values, vectors = leading((small + small.T) / 2, wanted, floor)
            found.append((values, basis @ vectors))
            wanted -= len(values)
    values = np.concatenate([v for v, _ in found])
    order = np.argsort(-values, kind="stable")
    return values[order], np.hstack([v for _, v in found])[:, order]


def principal(covariance: np.ndarray, wanted: int):
    """Eigenvalues and unit vectors (as rows) with the largest entry positive."""
    # Scaled by a power of two, so that squares stay finite and nothing is rounded.
    _, power = np.frexp(np.abs(covariance).max(initial=0))
    values, vectors = leading(np.ldexp(covariance, -int(power)), wanted)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.ldexp(values, int(power)), (vectors * np.where(top < 0, -1.0, 1.0)).T


def _exact(values: np.ndarray, rows: int) -> np.ndarray:
    """As 64-bit integers where sums of ``rows`` products fit, else unbounded."""
    most = max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))
    return values.astype(np.int64 if most * most * max(rows, 1) < LONG else object)


def _summed(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds up rows of equal keys exactly."""
    names = [*keys, "many", "sums"]

    def run(key, part):
        lists = part.column("sums").to_pylist()
        sums = [str(sum(map(int, column))) for column in zip(*lists)]
        columns = [pa.array([k.as_py()], pa.int32()) for k in key]
        columns.append(pa.array([sum(part.column("many").to_pylist())], pa.int64()))
        columns.append(pa.array([sums], pa.list_(pa.string())))
        return pa.table(dict(zip(names, columns)))

    schema = ", ".join(f"{k} int" for k in keys) + ", many bigint, sums array<string>"
    return totals.groupBy(*keys).applyInArrow(run, schema)


def _sums(totals: DataFrame, keys: list[str]) -> DataFrame:
    """By groups of tasks, then all: no task adds the rows of all tasks."""
    return _summed(_summed(totals, [*keys, "tasks"]), keys)


def first_moments(fit: DataFrame) -> DataFrame:
    """``size, many, sums``: number of distinct vectors and sums by dimension."""

    def run(batches):
        totals: dict = {}
        for batch in batches:
            for size, _, values in rows_by_size(batch, "x"):
                many, sums = totals.get(size, (0, np.zeros(size, object)))
                own = _exact(values, len(values)).sum(axis=0).astype(object)
                totals[size] = many + len(values), sums + own
        yield from _partials((s, many, sums) for s, (many, sums) in totals.items())

    schema = "size int, many bigint, sums array<string>, tasks int"
    return _sums(fit.mapInArrow(run, schema), ["size"])


def _partials(rows, extra: tuple = ()):
    rows = list(rows)
    if not rows:
        return
    group = TaskContext.get().partitionId() // GROUP_TASKS
    *keys, many, sums = zip(*rows)
    columns = [pa.array(list(k), pa.int32()) for k in keys]
    columns += [
        pa.array(list(many), pa.int64()),
        pa.array([[str(v) for v in s] for s in sums], pa.list_(pa.string())),
        pa.array([group] * len(rows), pa.int32()),
    ]
    names = ["size", *extra, "many", "sums", "tasks"]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def products(fit: DataFrame, centres: dict) -> DataFrame:
    """``size, row, sums``: rows of the sums of products about the centres."""

    def run(batches):
        totals: dict = {}
        for batch in batches:
            for size, _, values in rows_by_size(batch, "x"):
                apart = values.astype(object) - centres[size]
                apart = _exact(apart, len(values))
                own = (apart.T @ apart).astype(object)
                totals[size] = totals[size] + own if size in totals else own
        yield from _partials(
            ((s, i, 0, row) for s, total in totals.items() for i, row in enumerate(total)),
            ("row",),
        )

    schema = "size int, row int, many bigint, sums array<string>, tasks int"
    return _sums(fit.mapInArrow(run, schema), ["size", "row"])


class Model:
    """What the rows of one vector length are projected with."""

    def __init__(self, many: int, sums: list[int], trace: float, values, axes):
        self.many, self.sums, self.trace = many, sums, trace
        self.values = np.array(values, dtype=np.float64)
        self.axes = np.array(axes, dtype=np.float64).reshape(len(self.values), -1)
        self.mean = np.array([s / many for s in sums])
        # Less than the rounding of the matrix itself is no variance.
        least = len(sums) * EPS * max(trace, 0.0)
        self.varied = self.values > least

    def whiten(self, values: np.ndarray) -> np.ndarray:
        """One row a vector, one column a component; NaN without variance."""
        apart = values.astype(np.float64) - self.mean
        out = np.full((len(values), len(self.values)), np.nan)
        for k in np.flatnonzero(self.varied).tolist():
            out[:, k] = (apart * self.axes[k]).sum(axis=1) / np.sqrt(self.values[k])
        return out

    def deviations(self, values: np.ndarray) -> list:
        """Sum over dimensions of ``(many * x - sums) ** 2``; NULL beyond 64 bits."""
        most = max(
            [abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))]
        ) * self.many + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * values.shape[1] < LONG else object
        apart = values.astype(kind) * self.many - np.array(self.sums, dtype=kind)
        squares = (apart * apart).sum(axis=1)
        return [int(v) if v < LONG else None for v in squares.tolist()]


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each vector length; a fit of ``d`` entries takes ``d ** 2``
    numbers in one task and ``components * d`` on the driver."""
    first = {r.size: (r.many, [int(s) for s in r.sums]) for r in first_moments(fit).collect()}
    centres = {
        size: np.array([(2 * s + many) // (2 * many) for s in sums], dtype=object)
        for size, (many, sums) in first.items()
        if size
    }

    def decompose(key, part):
        size = key[0].as_py()
        many, sums = first[size]
        order = np.argsort(part.column("row").to_numpy())
        rows = part.column("sums").take(pa.array(order)).to_pylist()
        rest = [s - many * int(c) for s, c in zip(sums, centres[size])]
        covariance = np.array(
            [
                [(many * int(v) - a * b) / (many * many) for v, b in zip(row, rest)]
                for row, a in zip(rows, rest)
            ]
        )
        values, axes = principal(covariance, min(components, size))
        trace = sum(
            Fraction(many * int(row[i]) - a * a, many * many)
            for i, (row, a) in enumerate(zip(rows, rest))
        )
        return pa.table(
            {
                "size": pa.array([size], pa.int32()),
                "trace": pa.array([float(trace)], pa.float64()),
                "e": pa.array([values.tolist()], pa.list_(pa.float64())),
                "axes": pa.array([axes.ravel().tolist()], pa.list_(pa.float64())),
            }
        )

    schema = "size int, trace double, e array<double>, axes array<double>"
    found = products(fit.filter("size > 0"), centres).groupBy("size")
    return {
        r["size"]: Model(*first[r["size"]], r["trace"], r["e"], r["axes"])
        for r in found.applyInArrow(decompose, schema).collect()
    }


def identity_errors(fit: DataFrame, models: dict, components: int) -> dict:
    """Largest entry of the covariance of whitened rows less the identity."""

    def run(batches):
        for batch in batches:
            for size, at, values in rows_by_size(batch, "x"):
                if size in models:
                    out = models[size].whiten(values)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), size, np.int32)),
                            pa.array(out.tolist(), pa.list_(pa.float64())),
                        ],
                        names=["size", "w"],
                    )

    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    cells = [
        F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c_{i}_{j}")
        for i, j in pairs
    ]
    found = fit.mapInArrow(run, "size int, w array<double>").groupBy("size").agg(*cells)
    errors = {}
    for row in found.collect():
        varied = models[row["size"]].varied
        gaps = [
            abs(row[f"c_{i}_{j}"] - (i == j))
            for i, j in pairs
            if i < len(varied) and varied[i] and varied[j]
        ]
        errors[row["size"]] = max(gaps, default=None)
    return errors


def whiten(
    vectors: DataFrame,
    row_id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """``row_id, component, n, deviation, whitened, explained, identity_error``,
    one row for each usable vector and component."""
    rows = vectors.filter(finite(vector)).select(
        row_id, F.size(vector).alias("size"), floored(vector, scale).alias("x")
    )
    fit = cut(rows.select("size", "x").distinct())
    models = fitted(fit, components)
    errors = identity_errors(fit, models, components)

    def run(batches):
        for batch in batches:
            for size, at, values in rows_by_size(batch, "x"):
                if size not in models:
                    continue
                model = models[size]
                k = len(model.values)
                white = model.whiten(values).ravel()
                share = [v / model.trace if model.trace > 0 else None for v in model.values]
                each = pa.array(np.repeat(at, k))
                deviation = np.repeat(np.array(model.deviations(values), dtype=object), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(row_id).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, model.many, np.int64)),
                        pa.array(deviation.tolist(), pa.int64()),
                        pa.array(white, pa.float64(), mask=np.isnan(white)),
                        pa.array(share * len(at), pa.float64()),
                        pa.array([errors[size]] * (len(at) * k), pa.float64()),
                    ],
                    names=names,
                )

    names = [
        row_id, "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    kind = rows.schema[row_id].dataType.simpleString()
    schema = (
        f"`{row_id}` {kind}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    return rows.select(row_id, "x").mapInArrow(run, schema)
