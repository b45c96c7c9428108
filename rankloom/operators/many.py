"""Many linear models from one table at once: all labels and all folds share each pass over the rows.

Logistic models are fitted by L-BFGS. A pass computes, for the point where each model then stands, its loss and gradient
in Arrow batches as one matrix product; a task hands on one row for each block of models, and blocks are added in tasks of their own. The driver
holds coefficients and their last few steps, never rows. Folds are masks: the model of a fold is fitted on all rows outside it.

Ridge models are solved from sums of products: they are taken once for each fold, and a fold's model uses the total less
the fold's own part, so the rows are read once for any number of folds.

Vectors are standardised by the mean and the population deviation of the rows a model is fitted on; parts without spread count as 0.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a packed block; numbers of a block of results.
ROWS, RESULT = 4096, 1 << 16
#: Steps that L-BFGS remembers.
MEMORY = 10


@dataclass
class Models:
    """Coefficients in the space of the vectors as they are: weights (fold, output, part), and intercept (fold, output). folds: the folds' numbers; None is the model of all rows."""

    folds: list
    weights: np.ndarray
    intercept: np.ndarray
    passes: int = 0


def _vector(df: DataFrame, vector: str):
    return F.col(vector).cast("array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def packed(df: DataFrame, vector: str, target, fold: str | None) -> DataFrame:
    """The rows in blocks: n, width, x (the vectors' bytes), y (targets' bytes), fold (bytes). target: a column, a number or an array of numbers; fold: null and no fold are -1."""
    f = F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)
    rows = df.select(_vector(df, vector).alias("x"), target.alias("y"), f.alias("fold"))
    rows = rows.withColumn("y", F.col("y").cast("array<double>") if isinstance(rows.schema["y"].dataType, T.ArrayType) else F.array(F.col("y").cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                n = part.num_rows
                x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
                if len(x) % n or len(y) % n:
                    raise ValueError("vectors must be of one width, without nulls")
                held = [pa.array([v], t) for v, t in ((n, pa.int32()), (len(x) // n, pa.int32()), (x.tobytes(), pa.binary()), (y.tobytes(), pa.binary()), (part.column("fold").to_numpy().astype(np.int32).tobytes(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(held, ["n", "width", "x", "y", "fold"])

    return rows.mapInArrow(run, "n int, width int, x binary, y binary, fold binary")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for n, x, y, f in zip(*(batch.column(c) for c in ("n", "x", "y", "fold")), strict=True):
        n = n.as_py()
        yield np.frombuffer(x.as_buffer(), np.float64).reshape(n, -1), np.frombuffer(y.as_buffer(), np.float64).reshape(n, -1), np.frombuffer(f.as_buffer(), np.int32)


def summed(blocks: DataFrame, make, width: int) -> np.ndarray:
    """The sum over all blocks of make(x, y, fold), an array of width numbers. Each task adds its own and hands on pieces of RESULT numbers; pieces are added by place, so no task gets more than one piece from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x, y, f in _blocks(batch):
                total += make(x, y, f)
        places = range(0, width, RESULT)
        yield pa.RecordBatch.from_arrays([pa.array([p // RESULT for p in places], pa.int32()), pa.array([total[p : p + RESULT].tobytes() for p in places], pa.binary())], ["place", "sum"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("sum")[0].as_buffer()) // 8)
        for s in table.column("sum"):
            total += np.frombuffer(s.as_buffer(), np.float64)
        return pa.table({"place": table.column("place").slice(0, 1), "sum": pa.array([total.tobytes()], pa.binary())})

    rows = blocks.mapInArrow(run, "place int, sum binary").groupBy("place").applyInArrow(add, "place int, sum binary")
    # As many numbers as coefficients (and a few more).
    found = {r.place: np.frombuffer(r.sum, np.float64) for r in rows.collect()}
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(width)


def _moments(blocks: DataFrame, width: int, folds: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each model's rows: how many, the mean and the population deviation of each part. Deviations from the total's mean are summed, as large means would swallow the spread."""
    own = [-2 if f is None else f for f in folds]

    def first(x, _, __):
        return np.concatenate([[len(x)], x.sum(0)])

    total = summed(blocks, first, 1 + width)
    centre = total[1:] / max(1.0, total[0])

    def second(x, _, f):
        out = []
        for k in own:
            d = (x if k < 0 else x[f != k]) - centre
            out.append(np.concatenate([[len(d)], d.sum(0), (d * d).sum(0)]))
        return np.concatenate(out)

    sums = summed(blocks, second, len(folds) * (1 + 2 * width)).reshape(len(folds), -1)
    n = sums[:, 0]
    mean = sums[:, 1 : 1 + width] / np.maximum(1, n)[:, None]
    spread = np.sqrt(np.maximum(0, sums[:, 1 + width :] / np.maximum(1, n)[:, None] - mean * mean))
    spread[spread < 1e-12 * np.maximum(1, np.abs(centre))] = 0
    return n, mean + centre, spread


class _Descent:
    """One model's L-BFGS: where it stands, and where it looks next."""

    def __init__(self, size: int) -> None:
        self.at, self.loss, self.slope = np.zeros(size), np.inf, None
        self.look, self.step, self.way = self.at, 1.0, None
        self.pairs: deque = deque(maxlen=MEMORY)
        self.done = False

    def _direction(self) -> np.ndarray:
        q, held = self.slope.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            held.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(held), strict=True):
            q += (a - r * (y @ q)) * s
        return -q

    def told(self, loss: float, slope: np.ndarray, tolerance: float) -> None:
        """What the point looked at is worth. Moves there if it is low enough, else looks half as far."""
        if self.slope is not None:
            fall = self.slope @ self.way
            if loss > self.loss + 1e-4 * self.step * fall:
                self.step /= 2
                if self.step < 1e-10:
                    self.done = True
                self.look = self.at + self.step * self.way
                return
            s, y = self.look - self.at, slope - self.slope
            if s @ y > 1e-14:
                self.pairs.append((s, y, 1.0 / (s @ y)))
        self.at, self.loss, self.slope = self.look, loss, slope
        if np.abs(slope).max(initial=0) <= tolerance:
            self.done = True
            return
        self.way = self._direction()
        if self.slope @ self.way >= 0:
            self.pairs.clear()
            self.way = -self.slope
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / np.abs(slope).sum())
        self.look = self.at + self.step * self.way


def logistic(blocks: DataFrame, outputs: int, folds: list, joint: bool = False, strength: float | None = None, passes: int = 100, tolerance: float = 1e-6) -> Models:
    """L2 logistic models of packed() rows, for each fold (None: of all rows) one a label (targets 0 or 1, as many as outputs), or (joint) one of outputs classes (the target is the class). The mean loss plus strength / 2 times the squared weights (1 / rows where None) is least; intercepts are free."""
    first = blocks.select("width").first()
    if first is None:
        return Models(folds, np.zeros((len(folds), outputs, 0)), np.zeros((len(folds), outputs)))
    width, count = first[0], len(folds)
    n, mean, spread = _moments(blocks, width, folds)
    own = np.array([-2 if f is None else f for f in folds])  # no row's fold is -2
    inverse = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 0)
    penalty = np.full(count, strength) if strength is not None else 1 / np.maximum(1, n)
    units = [(f, slice(0, outputs)) for f in range(count)] if joint else [(f, slice(k, k + 1)) for f in range(count) for k in range(outputs)]
    each = (width + 1) * (outputs if joint else 1)
    walks = [_Descent(each) for _ in units]
    sc = blocks.sparkSession.sparkContext

    def raw(point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = point[..., :width] * inverse[:, None]
        return w, point[..., width] - (w * mean[:, None]).sum(-1)

    done = 0
    while done < passes and not all(w.done for w in walks):
        done += 1
        point = np.zeros((count, outputs, width + 1))
        for (f, k), walk in zip(units, walks, strict=True):
            point[f, k] = walk.look.reshape(-1, width + 1)
        weights, intercept = raw(point)
        sent = sc.broadcast((weights.reshape(-1, width).T.copy(), intercept.ravel()))

        def make(x, y, f, sent=sent):
            w, b = sent.value
            z = (x @ w + b).reshape(len(x), count, outputs)
            mask = (f[:, None] != own).astype(np.float64)
            if joint:
                top = z.max(2, keepdims=True)
                e = np.exp(z - top)
                total = e.sum(2, keepdims=True)
                hit = y[:, :1].astype(np.int64)[:, :, None] == np.arange(outputs)
                loss = ((np.log(total) + top)[..., 0] - (z * hit).sum(2)) * mask
                error = (e / total - hit) * mask[..., None]
                loss = loss.sum(0)
            else:
                loss = ((np.logaddexp(0, z) - y[:, None] * z) * mask[..., None]).sum(0).ravel()
                error = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y[:, None]) * mask[..., None]
            flat = error.reshape(len(x), -1)
            return np.concatenate([loss, flat.sum(0), (flat.T @ x).ravel()])

        losses = len(units)
        sums = summed(blocks, make, losses + count * outputs * (width + 1))
        sent.destroy()
        g0 = sums[losses : losses + count * outputs].reshape(count, outputs)
        g = (sums[losses + count * outputs :].reshape(count, outputs, width) - g0[..., None] * mean[:, None]) * inverse[:, None]
        for u, ((f, k), walk) in enumerate(zip(units, walks, strict=True)):
            if not walk.done:
                here = point[f, k]
                slope = np.concatenate([g[f, k] / max(1, n[f]) + penalty[f] * here[:, :width], g0[f, k][:, None] / max(1, n[f])], axis=1)
                walk.told(sums[u] / max(1, n[f]) + penalty[f] / 2 * (here[:, :width] ** 2).sum(), slope.ravel(), tolerance)
    point = np.zeros((count, outputs, width + 1))
    for (f, k), walk in zip(units, walks, strict=True):
        point[f, k] = walk.at.reshape(-1, width + 1)
    if joint:
        point[..., width] -= point[..., width].mean(1, keepdims=True)
    weights, intercept = raw(point)
    return Models(folds, weights, intercept, done)


def ridge(blocks: DataFrame, folds: list, alpha: float = 1.0) -> Models:
    """Ridge models of packed() rows with one target, for each fold (None: of all rows), from one pass over the products and one over the means."""
    first = blocks.select("width").first()
    if first is None:
        return Models(folds, np.zeros((len(folds), 1, 0)), np.zeros((len(folds), 1)))
    width = first[0]
    own = [f for f in folds if f is not None]

    def means(x, y, _):
        return np.concatenate([[len(x)], x.sum(0), [y[:, 0].sum()]])

    total = summed(blocks, means, width + 2)
    centre = total[1:] / max(1.0, total[0])
    size = width + 2

    def products(x, y, f):
        m = np.column_stack([np.ones(len(x)), x - centre[:-1], y[:, 0] - centre[-1]])
        return np.concatenate([(part.T @ part).ravel() for part in [m, *(m[f == k] for k in own)]])

    sums = summed(blocks, products, (1 + len(own)) * size * size).reshape(-1, size, size)
    weights, intercept = np.zeros((len(folds), 1, width)), np.zeros((len(folds), 1))
    for k, f in enumerate(folds):
        s = sums[0] - (sums[1 + own.index(f)] if f is not None else 0)
        n = s[0, 0]
        if n < 1:
            continue
        mean = s[0, 1:] / n
        c = s[1:, 1:] - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(0, np.diag(c)[:width] / n))
        inverse = np.where(spread > 1e-12 * np.maximum(1, np.abs(centre[:-1])), 1 / np.where(spread > 0, spread, 1), 0)
        a = c[:width, :width] * inverse[:, None] * inverse + alpha * np.eye(width)
        weights[k, 0] = np.linalg.solve(a, c[:width, width] * inverse) * inverse
        intercept[k, 0] = mean[width] + centre[-1] - weights[k, 0] @ (mean[:width] + centre[:-1])
    return Models(folds, weights, intercept, 2)


def scores(df: DataFrame, vector: str, models: Models, fold: str | None, column: str) -> DataFrame:
    """df with column: the outputs of each row's model, as an array; a row is judged by the model of its fold (without one, by the first)."""
    sent = df.sparkSession.sparkContext.broadcast((models.weights, models.intercept, {(-1 if f is None else int(f)): k for k, f in enumerate(models.folds)}))
    x, f = "_x", "_f"
    rows = df.drop(column).withColumns({x: _vector(df, vector), f: F.coalesce(F.col(fold).cast("int"), F.lit(-1)) if fold else F.lit(-1)})
    kept = df.drop(column).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, place = sent.value
        for batch in batches:
            which = np.array([place.get(int(v), 0) for v in batch.column(f).to_numpy()], np.int64)
            out = np.zeros((batch.num_rows, weights.shape[1]))
            vectors = _matrix(batch.column(x), weights.shape[2]) if batch.num_rows else np.zeros((0, weights.shape[2]))
            for k in np.unique(which):
                at = which == k
                out[at] = vectors[at] @ weights[k].T + intercept[k]
            made = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * weights.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, column])

    return rows.mapInArrow(run, T.StructType([*df.drop(column).schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))
