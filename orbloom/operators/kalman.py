"""Vector Kalman filter and smoother of order-p autoregressions, parallel over series and over time.

A state of P coefficients follows x(t) = sum Phi(k) x(t-k) + w.  An epoch observes all of it, as values with a
covariance or as normal equations (N, b), or not at all.  Series are cut into ranges of ``SPAN`` epochs:

1. every range becomes one filtering element, the composite of its epochs (Särkkä and García-Fernández, "Temporal
   parallelization of Bayesian smoothers", 2021), on as many tasks as there are ranges;
2. elements before a range, composed, give the state in which it starts; ranges of ranges are composed the same way,
   so no task meets more than ``FAN`` elements, however long a series is;
3. every range is filtered from its start, and filtered epochs are written out; a task moves many ranges of one series
   at once, so each of its steps is one of arrays;
4. the same three steps run backward for the smoother: a range's smoothing element maps the smoothed state behind it to
   that of its first epoch.

The results are those of the sequential recursion.  Frames: ``obs`` has key columns, t (0, 1, ... within a series),
epoch, and l with r (P variances or P x P) or normal (P x P) with right; ``model`` has a row for each key.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbloom.functions.index import literal_table
from orbloom.functions.special import chi2_quantile
from orbloom.operators import batches, nearest, regression
from orbloom.operators.stored import numbered, stored

SPAN = 128
FAN = 128
MODEL = "order int, p int, phi array<double>, q array<double>, sigma0 array<double>, radius double"
FILTERED = "t bigint, epoch double, xf array<double>, pf array<double>, gap boolean, share double, qc double, dof int, rejected boolean, skip boolean"
SMOOTHED = "t bigint, epoch double, x array<double>, sigma array<double>"


# --- the autoregression ---------------------------------------------------------------------------------------------


def _types(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def lag_products(series: DataFrame, keys: list[str], vector: str, order: int, span: int = 4096) -> DataFrame:
    """Sums over epochs of x(t + h) x(t)' by key and lag h = 0 .. order: entries (h, i, value), and the number of epochs.

    A range of epochs also gets the last ``order`` epochs of the range before, so no product is missed or met twice.
    """
    k = F.floor(F.col("t") / span)
    own = series.select(*keys, "t", F.col(vector).alias("x"), k.alias("k"))
    halo = own.withColumn("k", F.explode(F.when(F.col("t") % span >= span - order, F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, t, first = np.stack(pdf["x"].to_numpy()), pdf["t"].to_numpy(), pdf["k"].iloc[0] * span
        at = {int(v): j for j, v in enumerate(t)}
        out = []
        for h in range(order + 1):
            pairs = [(j, at[int(v) - h]) for j, v in enumerate(t) if v >= first and int(v) - h in at]
            a, b = x[[p[0] for p in pairs]], x[[p[1] for p in pairs]]
            out.append(pd.DataFrame({"h": h, "i": np.arange(x.shape[1] ** 2), "value": (a.T @ b).ravel()}))
        return pd.concat(out).assign(**{c: pdf[c].iloc[0] for c in keys}, epochs=int((t >= first).sum()))[[*keys, "h", "i", "value", "epochs"]]

    sums = halo.groupBy(*keys, "k").applyInPandas(run, f"{_types(series, keys)}h int, i int, value double, epochs bigint")
    return sums.groupBy(*keys, "h", "i").agg(F.sum("value").alias("value"), F.sum("epochs").alias("epochs"))


def yule_walker(sigma: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Phi [order, P, P], innovation covariance, stationary covariance and spectral radius from covariances at lags 0 .. order."""
    order, p = len(sigma) - 1, len(sigma[0])
    big = np.block([[sigma[i - j] if i >= j else sigma[j - i].T for j in range(order)] for i in range(order)])
    phi = np.linalg.solve(big.T, np.hstack(sigma[1:]).T).T.reshape(p, order, p).transpose(1, 0, 2)
    q = sigma[0] - sum(a @ c.T for a, c in zip(phi, sigma[1:]))
    radius = float(np.abs(np.linalg.eigvals(companion(phi))).max())
    return phi, (q + q.T) / 2, (sigma[0] + sigma[0].T) / 2, radius


def companion(phi: np.ndarray) -> np.ndarray:
    order, p, _ = phi.shape
    f = np.eye(order * p, k=-p)
    f[:p] = phi.transpose(1, 0, 2).reshape(p, order * p)
    return f


def fit_var(series: DataFrame, keys: list[str], vector: str = "x", order: int = 1, shrink: float = 0.0, within: list[str] | None = None, condition: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The autoregression of every key: Yule-Walker from products summed in Spark.

    ``shrink`` times the mean variance of all keys that agree in ``within`` (the key itself, by default) is added to the
    diagonal at lag 0; ``condition`` then maps each lag's covariance to the one that is used.
    """
    within = keys if within is None else within
    sums = lag_products(series, keys, vector, order)
    size = sums.where("h = 0").groupBy(*keys).agg(F.max("i").alias("top"), F.max("epochs").alias("epochs"))
    size = size.withColumn("p", F.sqrt(F.col("top") + 1.0).cast("int")).drop("top")
    of = sums.where("h = 0").drop("h", "epochs").join(size, keys).where("i % (p + 1) = 0")
    load = of.groupBy(*within).agg((shrink * F.sum(F.col("value") / F.col("epochs")) / F.count("*")).alias("load"))
    rows = sums.drop("epochs").join(size, keys)
    rows = rows.join(load, within) if within else rows.join(F.broadcast(load))  # one row if nothing parts the keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, t = int(pdf["p"].iloc[0]), int(pdf["epochs"].iloc[0])
        if t <= order + 1:
            raise ValueError(f"{t} epochs are too few for order {order}")
        sigma = []
        for h in range(order + 1):
            part = pdf[pdf["h"] == h].sort_values("i")["value"].to_numpy()
            sigma.append((part.reshape(p, p) if len(part) else np.zeros((p, p))) / (t - h))
        sigma[0] = sigma[0] + float(pdf["load"].iloc[0]) * np.eye(p)
        if condition is not None:
            sigma = [condition(s) for s in sigma]
        phi, q, s0, radius = yule_walker(sigma)
        if radius >= 1:
            warnings.warn(f"the process is not stationary: spectral radius {radius:.4f}", stacklevel=1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "order": order, "p": p, "phi": [phi.ravel()], "q": [q.ravel()], "sigma0": [s0.ravel()], "radius": radius})

    return rows.groupBy(*keys).applyInPandas(run, _types(series, keys) + MODEL)


# --- ranges ---------------------------------------------------------------------------------------------------------


def _t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _mv(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a @ v[..., None])[..., 0]


def _sym(a: np.ndarray) -> np.ndarray:
    return (a + _t(a)) / 2


class Process:
    """Companion form of one model row."""

    def __init__(self, row):
        self.p, self.order = int(row["p"]), int(row["order"])
        self.f = companion(np.asarray(row["phi"], float).reshape(self.order, self.p, self.p))
        self.size = len(self.f)
        self.q = np.zeros_like(self.f)
        self.q[: self.p, : self.p] = np.asarray(row["q"], float).reshape(self.p, self.p)
        self.s0 = np.kron(np.eye(self.order), np.asarray(row["sigma0"], float).reshape(self.p, self.p))

    def observed(self, row) -> tuple | None:
        """("l", values, covariance), ("n", normal matrix, right side), or None for a gap."""
        has = [row[c] is not None and not (isinstance(row[c], float) and row[c] != row[c]) for c in ("l", "normal")]
        if all(has):
            raise ValueError("an epoch has both values and normal equations")
        if not any(has):
            return None
        a, b = (np.asarray(row[c], float) for c in (("l", "r") if has[0] else ("normal", "right")))
        values, square = (a, b) if has[0] else (b, a)
        if len(values) != self.p or square.size not in ((self.p, self.p**2) if has[0] else (self.p**2,)):
            raise ValueError(f"an epoch has {len(values)} values and a matrix of {square.size} numbers for {self.p} coefficients")
        square = np.diag(square) if square.size == self.p and self.p > 1 or square.ndim == 1 and square.size == self.p else square.reshape(self.p, self.p)
        return ("l", values, square) if has[0] else ("n", square, values)

    def all_observed(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for all rows: kind (0 gap, 1 values, 2 normal equations), vectors and matrices."""
        kind, vec, square = np.zeros(table.num_rows, int), np.zeros((table.num_rows, self.p)), np.zeros((table.num_rows, self.p, self.p))
        columns = {c: table.column(c).combine_chunks() for c in ("l", "r", "normal", "right")}
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        has = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in columns.items()}
        if (has["l"] & has["normal"]).any():
            raise ValueError("an epoch has both values and normal equations")
        for code, a, b in ((1, "l", "r"), (2, "right", "normal")):
            rows = np.flatnonzero(has["l"] if code == 1 else has["normal"])
            kind[rows] = code
            v, m = (columns[c].take(pa.array(rows)) for c in (a, b))
            sizes = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(int) for x in (v, m)]
            good = (sizes[0] == self.p) & ((sizes[1] == self.p**2) | ((code == 1) & (sizes[1] == self.p)))
            if not good.all():
                raise ValueError(f"an epoch has {sizes[0][~good][0]} values and a matrix of {sizes[1][~good][0]} numbers for {self.p} coefficients")
            vec[rows] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.p)
            for n in np.unique(sizes[1]):
                at = np.flatnonzero(sizes[1] == n)
                x = m.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                square[rows[at]] = x.reshape(-1, self.p, self.p) if n == self.p**2 else x[:, :, None] * np.eye(self.p)
        return kind, vec, square

    def elements(self, kind: np.ndarray, vec: np.ndarray, square: np.ndarray) -> tuple:
        """A, b, C, eta, J of epochs."""
        n, k = self.size, self.p
        info, v = np.zeros((len(kind), n, n)), np.zeros((len(kind), n))
        one, two = kind == 1, kind == 2
        root = np.linalg.inv(square[one])
        info[one, :k, :k], v[one, :k] = root, _mv(root, vec[one])
        info[two, :k, :k], v[two, :k] = square[two], vec[two]
        m = np.linalg.inv(np.eye(n) + self.q @ info)
        c = m @ self.q
        back = self.f.T @ _t(m)
        return m @ self.f, _mv(c, v), _sym(c), _mv(back, v), back @ info @ self.f

    def steps(self, x: np.ndarray, p: np.ndarray, kind: np.ndarray, vec: np.ndarray, square: np.ndarray, skip: np.ndarray) -> tuple:
        """Filtered states and covariances, mean shares of the data, and statistics and freedoms of the innovations (NaN, -1: none)."""
        x, p, k, eye = x @ self.f.T, _sym(self.f @ p @ self.f.T + self.q), self.p, np.eye(self.size)
        share, qc, dof = np.full(len(x), np.nan), np.full(len(x), np.nan), np.full(len(x), -1)
        at = np.flatnonzero(kind == 1)
        if len(at):
            d, s = vec[at] - x[at, :k], p[at, :k, :k] + square[at]
            qc[at], dof[at] = (d * np.linalg.solve(s, d[..., None])[..., 0]).sum(axis=1), k
            on = ~skip[at]
            at, d, s = at[on], d[on], s[on]
            gain = _t(np.linalg.solve(_t(s), _t(p[at][:, :, :k])))
            keep = np.tile(eye, (len(at), 1, 1))
            keep[:, :, :k] -= gain
            x[at] += _mv(gain, d)
            p[at] = _sym(keep @ p[at] @ _t(keep) + gain @ square[at] @ _t(gain))
            share[at] = np.einsum("bii->b", gain[:, :k]) / k
        at = np.flatnonzero(kind == 2)
        if len(at):
            n = square[at]
            u = vec[at] - _mv(n, x[at, :k])
            w = n @ p[at][:, :k, :k] @ n + n
            qc[at], dof[at] = (u * _mv(np.linalg.pinv(_sym(w), hermitian=True), u)).sum(axis=1), np.linalg.matrix_rank(n)
            on = ~skip[at]
            at, n, u = at[on], n[on], u[on]
            # Information form without the inverse of the predicted covariance.
            grow = np.tile(eye, (len(at), 1, 1))
            grow[:, :, :k] += p[at][:, :, :k] @ n
            new = _sym(np.linalg.solve(grow, p[at]))
            x[at] += _mv(new[:, :, :k], u)
            p[at] = new
            share[at] = np.einsum("bii->b", new[:, :k, :k] @ n) / k
        return x, p, share, qc, dof

    def step(self, x: np.ndarray, p: np.ndarray, obs: tuple | None, skip: bool) -> tuple:
        """The step of one epoch; share, statistic and freedom are None where there is none."""
        kind = 0 if obs is None else 1 if obs[0] == "l" else 2
        vec, square = (np.zeros(self.p), np.zeros((self.p, self.p))) if obs is None else obs[1:] if kind == 1 else obs[:0:-1]
        x, p, share, qc, dof = (a[0] for a in self.steps(x[None], p[None], np.array([kind]), vec[None], square[None], np.array([skip])))
        return x, p, None if np.isnan(share) else float(share), float(qc) if kind else None, int(dof) if kind else None


def joined(one: tuple, two: tuple) -> tuple:
    """The composite of two filtering elements (or of as many pairs), the earlier first."""
    a1, b1, c1, e1, j1 = one
    a2, b2, c2, e2, j2 = two
    m = np.linalg.inv(np.eye(b1.shape[-1]) + c1 @ j2)
    left, right = a2 @ m, _t(a1) @ _t(m)
    c, j = left @ c1 @ _t(a2) + c2, right @ j2 @ a1 + j1
    return left @ a1, _mv(left, b1 + _mv(c1, e2)) + b2, _sym(c), _mv(right, e2 - _mv(j2, b1)) + e1, _sym(j)


def started(element: tuple, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state behind an element that begins in (x, p)."""
    a, b, c, e, j = element
    m = a @ np.linalg.inv(np.eye(x.shape[-1]) + p @ j)
    return _mv(m, x + _mv(p, e)) + b, _sym(m @ p @ _t(a) + c)


def backward(process: Process, xf: np.ndarray, pf: np.ndarray, last: np.ndarray) -> tuple:
    """E, g, L: the smoothed state of an epoch is E times that of the next one plus g, its covariance E P E' + L."""
    pp, cross = process.f @ pf @ process.f.T + process.q, pf @ process.f.T
    if process.order > 1:
        pp[last] = np.eye(process.size)
        e = cross @ np.linalg.pinv(pp, rcond=np.finfo(float).eps * process.size)
    else:
        pp[last] = np.eye(process.size)
        e = _t(np.linalg.solve(_t(pp), _t(cross)))
    e[last] = 0
    g, rest = xf - _mv(e, xf @ process.f.T), _sym(pf - e @ pp @ _t(e))
    return e, g, np.where(last[:, None, None], pf, rest)


def behind(one: tuple, two: tuple) -> tuple:
    """The composite of two smoothing elements (or of as many pairs), the earlier first."""
    return one[0] @ two[0], _mv(one[0], two[1]) + one[1], one[0] @ two[2] @ _t(one[0]) + one[2]


def _flat(parts: tuple) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in parts])


def _parts(flat, n: int, shapes: str) -> tuple:
    """Matrices (m) and vectors (v) of a flat element."""
    flat, out, at = np.asarray(flat, float), [], 0
    for s in shapes:
        k = n * n if s == "m" else n
        out.append(flat[at : at + k].reshape((n, n) if s == "m" else n))
        at += k
    return tuple(out)


def _cogrouped(left: DataFrame, right: DataFrame, by: list[str]):
    """Both sides by their keys; new names for the right side's columns, as it may stem from the left one."""
    fresh = right.withColumnsRenamed({c: f"_{c}" for c in right.columns}).select(*[F.col(f"_{c}").alias(c) for c in right.columns])
    return left.groupBy(*by).cogroup(fresh.groupBy(*by))


def _before(elements: DataFrame, keys: list[str], shapes: str, join: Callable, reverse: bool = False, fan: int = FAN) -> DataFrame:
    """keys, k, before: the composite of all elements (keys, k, size, e) before k, or behind it; none for the outermost."""
    top = elements.agg(F.max("k")).first()[0] or 0
    types = _types(elements, keys)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        n, acc = int(pdf["size"].iloc[0]), None
        for e in pdf["e"]:
            e = _parts(e, n, shapes)
            acc = e if acc is None else join(acc, e)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "k": [pdf["k"].iloc[0] // fan], "size": [n], "e": [_flat(acc)]})

    def scan(pdf: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ascending=not reverse)
        if not len(pdf):
            return pd.DataFrame(columns=[*keys, "k", "before"])
        n = int(pdf["size"].iloc[0])
        given = outer["before"].iloc[0] if len(outer) else None
        acc, out = (None if given is None else _parts(given, n, shapes)), []
        for e in pdf["e"]:
            out.append(None if acc is None else _flat(acc))
            e = _parts(e, n, shapes)
            acc = e if acc is None else join(e, acc) if reverse else join(acc, e)
        return pdf[[*keys, "k"]].assign(before=out)

    grouped = elements.withColumn("of", F.floor(F.col("k") / fan))
    if top < fan:
        outer = elements.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("of"), F.lit(None).cast("array<double>").alias("before"))
    else:
        wider = stored(grouped.groupBy(*keys, "of").applyInPandas(total, f"{types}k bigint, size int, e array<double>"), "kalman-composites")
        outer = _before(wider, keys, shapes, join, reverse, fan).withColumnRenamed("k", "of")
    return _cogrouped(grouped, outer, [*keys, "of"]).applyInPandas(scan, f"{types}k bigint, before array<double>")


# --- whole series ---------------------------------------------------------------------------------------------------


def _observations(obs: DataFrame, keys: list[str], span: int) -> DataFrame:
    cols = [F.col(c) if c in obs.columns else F.lit(None).cast("array<double>").alias(c) for c in ("l", "r", "normal", "right")]
    skip = F.col("skip") if "skip" in obs.columns else F.lit(False).alias("skip")
    return obs.select(*keys, F.col("t").cast("long").alias("t"), F.col("epoch").cast("double").alias("epoch"), *cols, skip, F.floor(F.col("t") / span).alias("k"))


HELD = 1 << 14  # numbers of the state's square that a group of ranges holds for each epoch of a range


def _width(model: DataFrame) -> int:
    """How many ranges of a series go together: fewer for larger states."""
    size = model.agg(F.max(F.col("order") * F.col("p"))).first()[0] or 1
    return int(max(1, min(256, HELD // size**2)))


def _by_range(rows: DataFrame, side: DataFrame, keys: list[str], wide: int, run: Callable, schema: str) -> DataFrame:
    """``run`` on ``wide`` ranges of a series at once: rows sorted by (k, t), and the rows of ``side`` (one for each key and k) by k."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def whole(table: pa.Table, other: pa.Table) -> pa.Table:
        if table.num_rows and not other.num_rows:
            raise ValueError("a series has no model")
        if not table.num_rows:
            raise ValueError("a model's range has no rows")
        out = run(table.sort_by([("k", "ascending"), ("t", "ascending")]).combine_chunks(), other.sort_by("k").combine_chunks())
        return out.select(names)

    left, right = (x.withColumn("_g", F.floor(F.col("k") / wide)) for x in (rows, side))
    fresh = right.withColumnsRenamed({c: f"_{c}" for c in right.columns}).select(*[F.col(f"_{c}").alias(c) for c in right.columns])
    return left.groupBy(*keys, "_g").cogroup(fresh.groupBy(*keys, "_g")).applyInArrow(whole, schema)


def _ranges(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of every range in rows sorted by k."""
    begin = batches.starts(table, ["k"])
    return begin, np.diff([*begin, table.num_rows])


def _model(side: pa.Table) -> Process:
    return Process(side.select(["order", "p", "phi", "q", "sigma0"]).slice(0, 1).to_pylist()[0])


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of numbers as lists."""
    flat = np.ascontiguousarray(x).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="int32") * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    """Lists of one length as rows of numbers."""
    x = table.column(name).combine_chunks()
    return (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _given(side: pa.Table, n: int, shapes: str) -> tuple[np.ndarray, tuple]:
    """Which rows have an element ``before`` them, and those elements."""
    has = side.column("before").is_valid().to_numpy()
    flat = _matrix(side.filter(side.column("before").is_valid()).combine_chunks(), "before") if has.any() else np.zeros((0, sum(n * n if c == "m" else n for c in shapes)))
    out, at = [], 0
    for c in shapes:
        k = n * n if c == "m" else n
        out.append(flat[:, at : at + k].reshape((-1, n, n) if c == "m" else (-1, n)))
        at += k
    return has, tuple(out)


def _with_keys(table: pa.Table, keys: list[str], rows: np.ndarray, columns: dict) -> pa.Table:
    return pa.Table.from_batches([batches.repeated(table, keys, rows, columns)])


def filter_once(obs: DataFrame, model: DataFrame, keys: list[str], span: int = SPAN, fan: int = FAN, alpha: float | None = None) -> DataFrame:
    """Filtered epochs (FILTERED) with their range k; ``skip`` says which epochs were kept out, ``rejected`` which fail the test."""
    rows, types = _observations(obs, keys, span), _types(obs, keys)
    models, wide = rows.select(*keys, "k").distinct().join(model, keys), _width(model)

    def element(table: pa.Table, side: pa.Table) -> pa.Table:
        process, (begin, length) = _model(side), _ranges(table)
        kind, vec, square = process.all_observed(table)
        kind = np.where(table.column("skip").to_numpy(), 0, kind)
        acc = process.elements(kind[begin], vec[begin], square[begin])
        for j in range(1, length.max()):
            on = np.flatnonzero(length > j)
            at = begin[on] + j
            new = joined(tuple(x[on] for x in acc), process.elements(kind[at], vec[at], square[at]))
            for x, y in zip(acc, new):
                x[on] = y
        flat = np.concatenate([x.reshape(len(begin), -1) for x in acc], axis=1)
        return _with_keys(table, [*keys, "k"], begin, {"size": np.full(len(begin), process.size, "int32"), "e": _lists(flat)})

    elements = stored(_by_range(rows, models, keys, wide, element, f"{types}k bigint, size int, e array<double>"), "kalman-elements")
    starts = models.join(_before(elements, keys, "mvmvm", joined, fan=fan), [*keys, "k"])

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        process, (begin, length), count = _model(side), _ranges(table), table.num_rows
        n = process.size
        kind, vec, square = process.all_observed(table)
        skip = table.column("skip").to_numpy()
        x, p = np.zeros((len(begin), n)), np.tile(process.s0, (len(begin), 1, 1))
        has, given = _given(side, n, "mvmvm")
        if has.any():
            x[has], p[has] = started(given, x[has], p[has])
        xf, pf = np.zeros((count, n)), np.zeros((count, n, n))
        share, qc, dof = np.full(count, np.nan), np.full(count, np.nan), np.full(count, -1)
        for j in range(length.max()):
            on = np.flatnonzero(length > j)
            at = begin[on] + j
            x[on], p[on], share[at], qc[at], dof[at] = process.steps(x[on], p[on], kind[at], vec[at], square[at], skip[at])
            xf[at], pf[at] = x[on], p[on]
        bad = np.zeros(count, bool)
        if alpha is not None:
            for d in np.unique(dof[kind > 0]):
                bad |= (dof == d) & (kind > 0) & (qc > chi2_quantile(1 - alpha, int(d)))
        columns = {"t": table.column("t").combine_chunks(), "epoch": table.column("epoch").combine_chunks(), "xf": _lists(xf), "pf": _lists(pf), "gap": kind == 0}
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
        columns |= {"share": pa.array(share, mask=(kind == 0) | skip), "qc": pa.array(qc, mask=kind == 0), "dof": pa.array(dof.astype("int32"), mask=kind == 0), "rejected": bad, "skip": skip}
        return _with_keys(table, [*keys, "k"], np.arange(count), columns)

    return stored(_by_range(rows, starts, keys, wide, run, f"{types}k bigint, {FILTERED}"), "kalman-filtered")


def filter_series(obs: DataFrame, model: DataFrame, keys: list[str], qc: str = "none", alpha: float = 1e-3, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """The filter over all series; with qc ``reject``, epochs whose innovation fails the test do not enter.

    Which epochs fail depends on those kept out before them.  Passes repeat until the set of failing epochs is the set
    that was kept out; the first pass that agrees with itself is the sequential result, as each epoch's test then
    rests on the decisions before it.
    """
    if qc not in ("none", "flag", "reject"):
        raise ValueError(f"unknown quality control: {qc}")
    out = filter_once(obs, model, keys, span, fan, None if qc == "none" else alpha)
    while qc == "reject" and not out.where("rejected <> skip").isEmpty():
        seen = out.select(*keys, "t", F.col("rejected").alias("skip"))
        out = filter_once(obs.drop("skip").join(seen, [*keys, "t"]), model, keys, span, fan, alpha)
    return out


def smooth_series(filtered: DataFrame, model: DataFrame, keys: list[str], lag: int | None = None, fan: int = FAN) -> DataFrame:
    """Smoothed state and sigma of every epoch, from all epochs or from those up to ``lag`` later."""
    types, wide = _types(filtered, keys), _width(model)
    ends = filtered.groupBy(*keys).agg(F.max("t").alias("end"))
    models = filtered.select(*keys, "k").distinct().join(model.join(ends, keys), keys)

    def state(process: Process, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(table, "xf"), _matrix(table, "pf").reshape(-1, process.size, process.size)

    def smoothers(process: Process, table: pa.Table, side: pa.Table) -> tuple:
        return backward(process, *state(process, table), table.column("t").to_numpy() == side.column("end")[0].as_py())

    def result(process: Process, table: pa.Table, rows: np.ndarray, x: np.ndarray, p: np.ndarray) -> pa.Table:
        sigma = np.sqrt(np.maximum(np.einsum("bii->bi", p)[:, : process.p], 0))
        return _with_keys(table, [*keys, "t", "epoch"], rows, {"x": _lists(x[:, : process.p]), "sigma": _lists(sigma)})

    if lag is not None:
        # Each group of ranges also gets the first ``lag`` epochs behind it, however many groups they reach into.
        size = filtered.where("k = 1").agg(F.min("t")).first()[0]
        size = 1 << 62 if size is None else size * wide
        own = filtered.withColumn("k", F.floor(F.col("k") / wide).cast("long")).withColumn("home", F.col("k"))
        reach = F.transform(F.sequence(F.lit(0), F.lit(-(-lag // size))), lambda d: F.col("home") - d)
        near = own.withColumn("k", F.explode(F.filter(reach, lambda k: (k >= 0) & (F.col("t") < (k + 1) * size + lag))))

        def windows(table: pa.Table, side: pa.Table) -> pa.Table:
            process, (x, p) = _model(side), state(_model(side), table)
            e, g, rest = smoothers(process, table, side)
            i = np.flatnonzero(table.column("home").to_numpy() == table.column("k").to_numpy())
            last = np.minimum(table.num_rows - 1, i + lag)
            x, p = x[last], p[last]
            for back in range(1, lag + 1):
                on = np.flatnonzero(last - back >= i)
                at = last[on] - back
                x[on], p[on] = _mv(e[at], x[on]) + g[at], e[at] @ p[on] @ _t(e[at]) + rest[at]
            return result(process, table, i, x, _sym(p))

        groups = models.withColumn("k", F.floor(F.col("k") / wide).cast("long")).dropDuplicates([*keys, "k"])
        return _by_range(near, groups, keys, 1, windows, types + SMOOTHED)

    def element(table: pa.Table, side: pa.Table) -> pa.Table:
        process, (begin, length) = _model(side), _ranges(table)
        all_of = smoothers(process, table, side)
        acc = tuple(x[begin] for x in all_of)
        for j in range(1, length.max()):
            on = np.flatnonzero(length > j)
            new = behind(tuple(x[on] for x in acc), tuple(x[begin[on] + j] for x in all_of))
            for x, y in zip(acc, new):
                x[on] = y
        flat = np.concatenate([x.reshape(len(begin), -1) for x in acc], axis=1)
        return _with_keys(table, [*keys, "k"], begin, {"size": np.full(len(begin), process.size, "int32"), "e": _lists(flat)})

    elements = stored(_by_range(filtered, models, keys, wide, element, f"{types}k bigint, size int, e array<double>"), "kalman-backward")
    starts = models.join(_before(elements, keys, "mvm", behind, reverse=True, fan=fan), [*keys, "k"])

    def run(table: pa.Table, side: pa.Table) -> pa.Table:
        process, (begin, length) = _model(side), _ranges(table)
        n = process.size
        e, g, rest = smoothers(process, table, side)
        x, p = np.zeros((len(begin), n)), np.zeros((len(begin), n, n))
        # What lies behind ends at the last epoch, so its first factor is zero and the rest is the state; so is the last epoch's.
        has, given = _given(side, n, "mvm")
        x[has], p[has] = given[1], given[2]
        xs, ps = np.zeros((table.num_rows, n)), np.zeros((table.num_rows, n, n))
        for j in range(length.max()):
            on = np.flatnonzero(length > j)
            at = begin[on] + length[on] - 1 - j
            x[on], p[on] = _mv(e[at], x[on]) + g[at], e[at] @ p[on] @ _t(e[at]) + rest[at]
            xs[at], ps[at] = x[on], p[on]
        return result(process, table, np.arange(table.num_rows), xs, _sym(ps))

    return _by_range(filtered, starts, keys, wide, run, types + SMOOTHED)


# --- coefficient series ---------------------------------------------------------------------------------------------

STRUCTURES = {"full": "0", "orderblock": "m * 2 + cs", "diagonal": "n * 100000 + m * 2 + cs"}


def blocks(coef: DataFrame, structure: str) -> DataFrame:
    """The index of the coefficients that occur: block, i (place in the block), n, m, cs. As many rows as coefficients."""
    if structure not in STRUCTURES:
        raise ValueError(f"unknown structure: {structure}")
    rows = sorted((r.block, r.m, r.cs, r.n) for r in coef.select("n", "m", "cs").distinct().withColumn("block", F.expr(STRUCTURES[structure])).collect())
    out, count = [], {}
    for b, m, cs, n in rows:
        count[b] = count.get(b, -1) + 1
        out.append((b, count[b], n, m, cs))
    return literal_table(coef.sparkSession, ["block", "i", "n", "m", "cs"], out)


def vectors(coef: DataFrame, structure: str, values: list[str]) -> DataFrame:
    """block, epoch and an array for each of the value columns, in the order of ``blocks``."""
    rows = coef.withColumn("block", F.expr(STRUCTURES[structure]))
    packed = rows.groupBy("block", "epoch").agg(F.sort_array(F.collect_list(F.struct("m", "cs", "n", *values))).alias("x"))
    return packed.select("block", "epoch", *[F.col(f"x.{v}").alias(v) for v in values])


def chain(obs: DataFrame, model_series: DataFrame, t0: float, order: int = 1, structure: str = "orderblock", shrink: float = 0.0, condition: Callable | None = None, climatology: bool = True, grid: DataFrame | None = None, tolerance: float = 0.5 / 365.25, smoother: bool = True, lag: int | None = None, qc: str = "none", alpha: float = 1e-3, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """A smoothed series (epoch, n, m, cs, v, s) from noisy sets and a model of the process, and a report by epoch and block.

    The model series, less its own climatology, gives the autoregression; so reduced, the observations (epoch, n, m, cs,
    v, s) are filtered on the grid of epochs (their own, if none is given), where an epoch without observation within
    the tolerance is predicted; the climatology comes back at the end.  Coefficients of different blocks do not meet,
    so blocks are series of their own.
    """
    if not obs.where("s IS NULL OR s <= 0").isEmpty():
        raise ValueError("observations without a sigma: there is no default noise")
    key = ["n", "m", "cs"]
    index = blocks(model_series, structure)
    resid = regression.residuals(model_series.select("epoch", *key, "v"), key, t0).select("epoch", *key, F.col("residual").alias("v"))
    steps = numbered(model_series.select("epoch"))
    trained = vectors(resid, structure, ["v"]).join(steps, "epoch").withColumnRenamed("v", "x")
    model = stored(fit_var(trained, ["block"], "x", order, shrink, [], condition), "kalman-model")

    seen = obs.select("epoch", *key, "v", "s")
    if climatology:
        usual = stored(regression.fit(seen.select("epoch", *key, "v"), key, t0), "kalman-climatology")
        seen = regression.evaluate(usual, seen, key, t0).select("epoch", *key, (F.col("v") - F.col("model")).alias("v"), "s")
    times = numbered(obs.select("epoch") if grid is None else grid.select("epoch"))
    if grid is None:
        match = times.select("t", "epoch", F.col("epoch").alias("r_epoch"))
    else:
        match = nearest.nearest(times.withColumn("row_key", F.col("t")), obs.select("epoch").distinct(), tolerance, how="left").select("t", "epoch", "r_epoch")
    ids = [r.block for r in index.select("block").distinct().collect()]  # no more than coefficients
    slots = match.withColumn("block", F.explode(F.array(*[F.lit(b) for b in ids])))
    values = vectors(seen.withColumn("r", F.col("s") ** 2), structure, ["v", "r"]).withColumnsRenamed({"v": "l", "epoch": "r_epoch"})
    rows = slots.join(values, ["block", "r_epoch"], "left").select("block", "t", "epoch", "l", "r")

    filtered = filter_series(rows, model, ["block"], qc, alpha, span)
    if smoother:
        states = smooth_series(filtered, model, ["block"], lag)
    else:
        p = model.select("block", "p")
        states = filtered.join(p, "block").select("block", "t", "epoch", F.slice("xf", F.lit(1), F.col("p")).alias("x"), F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda j: F.sqrt(F.greatest(F.element_at("pf", (j * (F.sqrt(F.size("pf").cast("double")).cast("int") + 1) + 1).cast("int")), F.lit(0.0)))).alias("sigma"))
    flat = states.select("block", "epoch", F.posexplode(F.arrays_zip("x", "sigma")).alias("i", "y")).select("block", "epoch", "i", F.col("y.x").alias("v"), F.col("y.sigma").alias("s"))
    out = flat.join(index, ["block", "i"]).select("epoch", *key, "v", "s")
    if climatology:
        out = regression.evaluate(usual, out, key, t0).select("epoch", *key, (F.col("v") + F.col("model")).alias("v"), "s")
    return out, filtered.select("block", "t", "epoch", "gap", "share", "qc", "dof", "rejected")
