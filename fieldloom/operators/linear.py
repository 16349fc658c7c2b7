"""Linear algebra from one pass of sums: Gram matrices, components, regressions, probes.

Only sums as wide as the features reach the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _block(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _added(keys: list[str], last: bool):
    """Sums of the sums and of the raw rows of a group; few raw rows stay as they are until the end."""

    def add(t: pa.Table) -> pa.Table:
        sums, raw = None, []
        width = t.column("width").to_numpy()
        for d, data in zip(width, t.column("data")):
            data = np.frombuffer(data.as_buffer(), np.float64)
            if d:
                raw.append(data.reshape(-1, d))
            elif sums is None:
                sums = data.copy()
            else:
                sums += data
        if raw:
            x = np.concatenate(raw)
            if sums is None and not last and len(x) < x.shape[1]:
                return _part(t, keys, x.shape[1], x.ravel())
            own = _sums(x)
            sums = own if sums is None else sums + own
        return _part(t, keys, 0, sums)

    return add


def _part(t: pa.Table, keys: list[str], width: int, data: np.ndarray) -> pa.Table:
    slot = t.column("slot").slice(0, 1) if "slot" in t.schema.names else pa.array([0], pa.int64())
    return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "slot": slot, "width": pa.array([width], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def _sums(x: np.ndarray) -> np.ndarray:
    """Number, sum and sum of outer products, flat."""
    return np.concatenate(([float(len(x))], x.sum(0), (x.T @ x).ravel()))


def _tree_sum(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts ``keys, slot, width, data`` added in two levels of groups, in one job: a row for each of the keys."""
    kinds = "".join(f"`{k}` {parts.schema[k].dataType.simpleString()}, " for k in keys)
    schema = kinds + "slot long, width long, data binary"
    one = parts.groupBy(*keys, "slot").applyInArrow(_added(keys, False), schema)
    last = one.withColumn("slot", F.lit(0).cast("long")).groupBy(*(keys or ["slot"]))
    return last.applyInArrow(_added(keys, True), schema)


SLOTS = 64


def grouped_gram(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Number, sum and sum of outer products of the complete rows of each group: ``keys, data`` (flat 8-byte floats).

    A task adds what it sees of a group; where that is fewer rows than the
    vectors are wide it passes the rows themselves on, which take less room.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        task = TaskContext.get().partitionId() % SLOTS

        def out(first: pa.RecordBatch, row: int, width: int, data: np.ndarray) -> pa.RecordBatch:
            values = [first.column(k).slice(row, 1) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*values, pa.array([task]), pa.array([width], pa.int64()), pa.array([data.tobytes()], pa.binary())], names=[*keys, "slot", "width", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _block(batch.column(len(keys)))
            ok = np.flatnonzero(np.isfinite(x).all(1))
            coded = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in range(len(keys))]
            codes = np.stack([np.zeros(batch.num_rows, np.int64), *coded], 1)[ok]
            _, first, of = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            of = of.ravel()
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(first) + 1))
            for g in range(len(first)):
                rows = x[ok[order[edges[g] : edges[g + 1]]]]
                at = int(ok[first[g]])
                if keys and len(rows) < x.shape[1]:
                    yield out(batch, at, x.shape[1], rows.ravel())
                    continue
                name = tuple(batch.column(k)[at].as_py() for k in range(len(keys)))
                if name in held:
                    held[name][2] += _sums(rows)
                else:
                    held[name] = [batch.slice(at, 1), 0, _sums(rows)]
            if len(held) > 64:
                for h in held.values():
                    yield out(*h[:2], 0, h[2])
                held.clear()
        for h in held.values():
            yield out(*h[:2], 0, h[2])

    rows = df.select(*keys, F.col(vector).cast("array<double>").alias("_x")).filter("size(_x) > 0")
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    parts = rows.mapInArrow(partial, kinds + "slot long, width long, data binary")
    return _tree_sum(parts, keys).select(*keys, "data")


def unfold(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of a flat row."""
    flat = np.frombuffer(data, np.float64)
    d = int((np.sqrt(4 * (len(flat) - 1) + 1) - 1) / 2 + 0.5)
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the complete rows: sums of sums on the executors, one row to the driver."""
    got = grouped_gram(df, [], vector).collect()
    return unfold(got[0].data) if got else (0, np.zeros(0), np.zeros((0, 0)))


def correlations(df: DataFrame, keys: list[str], vector: str, left: list[str], right: list[str], min_rows: int) -> DataFrame:
    """Of each group with ``min_rows`` complete rows the correlation of the first positions (``left``) with the others (``right``).

    Rows ``keys, component, feature, r``; r is null where a side is constant.
    """
    sums = grouped_gram(df, keys, vector)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, total, outer = unfold(batch.column(len(keys))[i].as_py())
                if n < min_rows:
                    continue
                mean = total / n
                cov = outer / n - np.outer(mean, mean)
                var = np.diag(cov)
                std = np.where(var > 1e-13 * np.maximum(np.diag(outer) / n, 1e-300), np.sqrt(np.maximum(var, 0)), np.nan)
                r = (cov / np.outer(std, std))[: len(left), len(left) :]
                row = pa.array(np.full(r.size, i))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(row) for k in range(len(keys))], pa.array(np.repeat(left, len(right))), pa.array(np.tile(right, len(left))), pa.array(r.ravel(), mask=np.isnan(r).ravel())],
                    names=[*keys, "component", "feature", "r"],
                )

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return sums.mapInArrow(matrices, kinds + "component string, feature string, r double")


@dataclass
class Basis:
    mean: np.ndarray
    components: np.ndarray
    ratio: np.ndarray


def pca(df: DataFrame, vector: str, k: int) -> Basis:
    """Exact principal components; in each, the weight of largest size is positive."""
    n, total, outer = gram(df, vector)
    mean = total / max(n, 1)
    value, v = np.linalg.eigh(outer / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(-value)[:k]
    c = v[:, order].T
    c *= np.sign(c[np.arange(len(c)), np.abs(c).argmax(1)])[:, None]
    return Basis(mean, c, np.maximum(value[order], 0) / max(float(value.sum()), 1e-300))


def project(df: DataFrame, vector: str, basis: Basis, out: str = "s") -> DataFrame:
    """Scores of the centred vectors, as matrix products over Arrow batches."""

    def scores(x: pa.Array) -> pa.Array:
        y = (_block(x) - basis.mean) @ basis.components.T if len(x) else np.zeros((0, len(basis.components)))
        return pa.ListArray.from_arrays(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32), pa.array(y.ravel()))

    scores.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(scores, "array<double>")(vector))


def moments(n: int, total: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, population deviations (1 where 0) and covariances."""
    mean = total / n
    cov = outer / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    return mean, np.where(std > 1e-12 * np.maximum(1, np.abs(mean)), std, 1.0), cov


def ridge(n: int, total: np.ndarray, outer: np.ndarray, features: list[int], targets: list[int], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients on standardised features (rows: features) and intercepts, for all targets at once."""
    mean, std, cov = moments(n, total, outer)
    x, y = np.array(features), np.array(targets)
    z = cov[np.ix_(x, x)] / np.outer(std[x], std[x]) * n
    b = cov[np.ix_(x, y)] / std[x][:, None] * n
    return np.linalg.solve(z + alpha * np.eye(len(x)), b), mean[y]


def elastic_net(n: int, total: np.ndarray, outer: np.ndarray, features: list[int], target: int, alpha: float, l1_ratio: float = 1.0, steps: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on standardised features and target, from the Gram matrix."""
    _, std, cov = moments(n, total, outer)
    x = np.array(features)
    q, c = cov[np.ix_(x, x)] / np.outer(std[x], std[x]), cov[x, target] / std[x] / std[target]
    w = np.zeros(len(x))
    for _ in range(steps):
        far = 0.0
        for j in range(len(x)):
            r = c[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - alpha * l1_ratio, 0) / (q[j, j] + alpha * (1 - l1_ratio)) if q[j, j] > 0 else 0.0
            far, w[j] = max(far, abs(new - w[j])), new
        if far < tol:
            break
    return w


def ols(n: int, total: np.ndarray, outer: np.ndarray, features: list[int], target: int) -> tuple[np.ndarray, float]:
    """Coefficients on standardised features, and R2; of collinear features the shortest solution."""
    _, std, cov = moments(n, total, outer)
    x = np.array(features)
    q, c = cov[np.ix_(x, x)] / np.outer(std[x], std[x]), cov[x, target] / std[x]
    w = np.linalg.lstsq(q, c, rcond=1e-12)[0]
    return w, float(c @ w / cov[target, target]) if cov[target, target] > 0 else float("nan")


def score(n: int, total: np.ndarray, outer: np.ndarray, features: list[int], target: int, coef: np.ndarray, intercept: float) -> tuple[float, float, float]:
    """R2, RMSE and correlation of raw-unit predictions on the rows that the sums are of; no row is read again."""
    x = np.array(features)
    mean, cov = total / n, outer / n - np.outer(total / n, total / n)
    bias = intercept + coef @ mean[x] - mean[target]
    spread, shared, var = coef @ cov[np.ix_(x, x)] @ coef, coef @ cov[x, target], cov[target, target]
    mse = max(var - 2 * shared + spread + bias * bias, 0.0)
    return 1 - mse / var if var > 0 else float("nan"), float(np.sqrt(mse)), float(shared / np.sqrt(spread * var)) if spread * var > 0 else float("nan")


def fit_grid(train: tuple, test: tuple, features: list[int], targets: list[int], counts: list[int], alphas: list[float], kind: str = "ridge", l1_ratio: float = 1.0) -> list[tuple]:
    """Each target, number of first features and alpha: ``(target, n_features, alpha, selected, r2, rmse, corr)``, scored on the test sums.

    Two Gram matrices serve the whole grid. Ridge has raw targets, the others
    standardised ones, as their penalties have.
    """
    out = []
    n, total, outer = train
    mean, std, _ = moments(n, total, outer)
    for count in counts:
        x = features[:count]
        for alpha in alphas:
            if kind == "ridge":
                coefs, _ = ridge(n, total, outer, x, targets, alpha)
            for k, y in enumerate(targets):
                w = coefs[:, k] if kind == "ridge" else elastic_net(n, total, outer, x, y, alpha, l1_ratio)
                raw, at = raw_units(w, std[x], mean[x], 1.0 if kind == "ridge" else std[y], mean[y])
                out.append((y, len(x), alpha, int((w != 0).sum()), *score(*test, x, y, raw, at)))
    return out


def best_alpha(grid: list[tuple]) -> list[tuple]:
    """Of each target and number of features the row with the largest R2; of ties the first."""
    best: dict[tuple, tuple] = {}
    for row in grid:
        if row[:2] not in best or row[4] > best[row[:2]][4]:
            best[row[:2]] = row
    return list(best.values())


def rank_coefficients(df: DataFrame, name: str, coef: str, keys: list[str] | None = None) -> DataFrame:
    """``place`` from 1 by falling size of the coefficient, ties by name."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(F.desc(F.abs(F.col(coef))), name)))


def raw_units(coef: np.ndarray, std_x: np.ndarray, mean_x: np.ndarray, std_y: float = 1.0, mean_y: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for unscaled data from those for scaled."""
    raw = coef * std_y / std_x
    return raw, mean_y - float(raw @ mean_x)


@dataclass
class Probe:
    mean: np.ndarray
    std: np.ndarray
    coef: np.ndarray
    intercept: float

    def direction(self) -> tuple[np.ndarray, np.ndarray]:
        """The unit direction among scaled features, and the same in raw units."""
        unit = self.coef / max(float(np.linalg.norm(self.coef)), 1e-300)
        return unit, unit * self.std


def logistic_probe(df: DataFrame, vector: str, truth: str, c: float = 1.0, steps: int = 25, tol: float = 1e-8) -> Probe | None:
    """L2 logistic regression on standardised features, classes weighted to balance, by Newton steps.

    A step is one pass that sums gradient and curvature per task, and these in a
    tree. None if only one class occurs.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.col(truth).cast("double").alias("y")).filter("size(x) > 0 AND y IS NOT NULL")
    n, total, outer = gram(rows, "x")
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if n == 0 or len(counts) < 2:
        return None
    mean, std, _ = moments(n, total, outer)
    weight = {y: sum(counts.values()) / (len(counts) * k) for y, k in counts.items()}
    w = np.zeros(len(mean) + 1)
    for _ in range(steps):

        def partial(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _block(batch.column(0))
                y = batch.column(1).to_numpy()
                ok = np.isfinite(x).all(1)
                x, y = np.c_[(x[ok] - mean) / std, np.ones(ok.sum())], y[ok]
                p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                s = np.array([weight[v] for v in y])
                g += x.T @ (s * (p - y))
                h += (x * (s * p * (1 - p))[:, None]).T @ x
            data = np.concatenate((g, h.ravel())).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS]), pa.array([0]), pa.array([data], pa.binary())], names=["slot", "width", "data"])

        flat = np.frombuffer(_tree_sum(rows.mapInArrow(partial, "slot long, width long, data binary"), []).first().data, np.float64)
        g, h = flat[: len(w)], flat[len(w) :]
        pull = np.full(len(w), 1 / c)
        pull[-1] = 0
        step = np.linalg.solve(h.reshape(len(w), -1) + np.diag(pull + 1e-12), g + pull * w)
        w = w - step
        if np.abs(step).max() < tol:
            break
    return Probe(mean, std, w[:-1], float(w[-1]))


def probabilities(df: DataFrame, vector: str, probe: Probe, out: str = "p") -> DataFrame:
    scaled = F.zip_with(F.zip_with(vector, F.array(*map(F.lit, probe.mean.tolist())), lambda x, m: x - m), F.array(*map(F.lit, (probe.coef / probe.std).tolist())), lambda x, w: x * w)
    return df.withColumn(out, 1 / (1 + F.exp(-(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v) + probe.intercept))))
