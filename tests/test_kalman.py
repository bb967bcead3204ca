"""The vector Kalman chain against the sequential recursion, joint least squares and its own streaming form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbloom.functions.special import chi2_quantile
from orbloom.operators import kalman as K

SCHEMA = "key string, t bigint, epoch double, l array<double>, r array<double>, normal array<double>, right array<double>"


def stable(p, order, seed):
    rng = np.random.default_rng(seed)
    phi = rng.normal(size=(order, p, p))
    phi *= 0.8 / np.abs(np.linalg.eigvals(K.companion(phi))).max() ** np.arange(1, order + 1)[:, None, None]
    q = 0.2 * np.eye(p) + 0.05
    s0 = q.copy()
    for _ in range(400):
        s0 = phi[0] @ s0 @ phi[0].T + q if order == 1 else s0
    return phi, q, (s0 + s0.T) / 2


def observations(p, t, seed, kind="l"):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(t):
        if k % 5 == 3:
            out.append(None)
            continue
        a = rng.normal(size=(p, p))
        r = a @ a.T / p + 0.3 * np.eye(p) if k % 2 else np.diag(0.3 + rng.random(p))
        out.append((rng.normal(size=p) * (30 if k == 17 else 1), r))
    return out


def rows(key, obs, kind="l"):
    for t, o in enumerate(obs):
        if o is None:
            yield key, t, 2000 + t / 12, None, None, None, None
        elif kind == "l":
            r = np.diag(o[1]) if np.count_nonzero(o[1]) == len(o[0]) else o[1].ravel()
            yield key, t, 2000 + t / 12, o[0].tolist(), r.tolist(), None, None
        else:
            n = np.linalg.inv(o[1])
            yield key, t, 2000 + t / 12, None, None, n.ravel().tolist(), (n @ o[0]).tolist()


def model_rows(spark, models):
    return spark.createDataFrame([(k, len(phi), len(q), phi.ravel().tolist(), q.ravel().tolist(), s.ravel().tolist(), 0.8) for k, (phi, q, s) in models.items()], "key string, " + K.MODEL)


def sequential(model, obs, alpha=None):
    phi, q, s0 = model
    f = K.companion(phi)
    p, size = len(q), len(f)
    big = np.zeros((size, size))
    big[:p, :p] = q
    h = np.eye(p, size)
    x, c, out = np.zeros(size), np.kron(np.eye(len(phi)), s0), []
    for o in obs:
        xp, cp = f @ x, f @ c @ f.T + big
        x, c, bad = xp, cp, False
        if o is not None:
            s, d = h @ cp @ h.T + o[1], o[0] - h @ xp
            bad = alpha is not None and d @ np.linalg.solve(s, d) > chi2_quantile(1 - alpha, p)
            if not bad:
                g = cp @ h.T @ np.linalg.inv(s)
                x, c = xp + g @ d, (np.eye(size) - g @ h) @ cp
        out.append((x, c, xp, cp, bad))
    return f, out


def smoothed(f, out, last=None, first=0):
    last = len(out) - 1 if last is None else last
    x, c = out[last][:2]
    got = [(x, c)]
    for k in range(last - 1, first - 1, -1):
        g = out[k][1] @ f.T @ np.linalg.inv(out[k + 1][3])
        x, c = out[k][0] + g @ (x - out[k + 1][2]), out[k][1] + g @ (c - out[k + 1][3]) @ g.T
        got.append((x, c))
    return got[::-1]


def collected(df, *cols):
    return {(r.key, r.t): tuple(np.array(r[c]) if isinstance(r[c], list) else r[c] for c in cols) for r in df.collect()}


@pytest.fixture(scope="module")
def case(spark):
    models = {"a": stable(3, 1, 1), "b": stable(2, 1, 2)}
    obs = {"a": observations(3, 41, 3), "b": observations(2, 9, 4)}
    frame = spark.createDataFrame([r for k, o in obs.items() for r in rows(k, o)], SCHEMA)
    return models, obs, frame, model_rows(spark, models)


def test_ranges_equal_the_sequential_filter_and_smoother(case):
    models, obs, frame, model = case
    filtered = K.filter_series(frame, model, ["key"], span=4, fan=3)  # 11 ranges, composed in three layers
    got = collected(filtered, "xf", "pf", "gap")
    whole = collected(K.smooth_series(filtered, model, ["key"], fan=3), "x", "sigma")
    late = collected(K.smooth_series(filtered, model, ["key"], lag=6), "x", "sigma")
    for k, m in models.items():
        f, want = sequential(m, obs[k])
        back = smoothed(f, want)
        for t, (x, c, _, _, _) in enumerate(want):
            assert np.allclose(got[k, t][0], x, atol=1e-9) and np.allclose(got[k, t][1], c.ravel(), atol=1e-9) and got[k, t][2] == (obs[k][t] is None)
            p = len(m[1])
            assert np.allclose(whole[k, t][0], back[t][0][:p], atol=1e-9) and np.allclose(whole[k, t][1], np.sqrt(np.diag(back[t][1])[:p]), atol=1e-9)
            lagged = smoothed(f, want, min(len(want) - 1, t + 6), t)[0]
            assert np.allclose(late[k, t][0], lagged[0][:p], atol=1e-9) and np.allclose(late[k, t][1], np.sqrt(np.diag(lagged[1])[:p]), atol=1e-9)


def test_smoother_is_joint_least_squares(case):
    models, obs, frame, model = case
    whole = collected(K.smooth_series(K.filter_series(frame, model, ["key"], span=8), model, ["key"]), "x")
    for k, (phi, q, s0) in models.items():
        p, t = len(q), len(obs[k])
        n, b = np.zeros((t * p, t * p)), np.zeros(t * p)
        n[:p, :p] = np.linalg.inv(phi[0] @ s0 @ phi[0].T + q)
        iq = np.linalg.inv(q)
        for i in range(1, t):
            u, v = slice((i - 1) * p, i * p), slice(i * p, (i + 1) * p)
            n[v, v] += iq
            n[u, u] += phi[0].T @ iq @ phi[0]
            n[u, v] -= phi[0].T @ iq
            n[v, u] -= iq @ phi[0]
        for i, o in enumerate(obs[k]):
            if o is not None:
                v = slice(i * p, (i + 1) * p)
                n[v, v] += np.linalg.inv(o[1])
                b[v] += np.linalg.inv(o[1]) @ o[0]
        want = np.linalg.solve(n, b).reshape(t, p)
        assert all(np.allclose(whole[k, i][0], want[i], atol=1e-8) for i in range(t))


def test_normal_equations_give_the_same_states(spark, case):
    models, obs, frame, model = case
    normal = spark.createDataFrame([r for k, o in obs.items() for r in rows(k, o, "n")], SCHEMA)
    one, two = (collected(K.filter_series(x, model, ["key"], "flag", span=4, fan=3), "xf", "pf", "qc", "share") for x in (frame, normal))
    for k in one:
        assert np.allclose(one[k][0], two[k][0], atol=1e-8) and np.allclose(one[k][1], two[k][1], atol=1e-8)
        assert (one[k][2] is None and two[k][2] is None) or one[k][2] == pytest.approx(two[k][2], rel=1e-6)


def test_second_order_and_singular_normals(spark):
    model = stable(2, 2, 9)
    obs = observations(2, 21, 10)
    frame = spark.createDataFrame(list(rows("a", obs)), SCHEMA)
    filtered = K.filter_series(frame, model_rows(spark, {"a": model}), ["key"], span=5, fan=2)
    whole = collected(K.smooth_series(filtered, model_rows(spark, {"a": model}), ["key"], fan=2), "x", "sigma")
    f, want = sequential(model, obs)
    got = collected(filtered, "xf")
    back = smoothed(f, want)
    for t, w in enumerate(want):
        assert np.allclose(got["a", t][0], w[0], atol=1e-8) and np.allclose(whole["a", t][0], back[t][0][:2], atol=1e-6)
    # One of two coefficients observed: normal equations of rank one.
    half = spark.createDataFrame([("a", 0, 2000.0, None, None, [4.0, 0.0, 0.0, 0.0], [8.0, 0.0])], SCHEMA)
    x, p = K.Process({"p": 2, "order": 1, "phi": np.zeros(4), "q": np.eye(2).ravel(), "sigma0": np.eye(2).ravel()}), np.eye(2)
    r = K.filter_series(half, model_rows(spark, {"a": (np.zeros((1, 2, 2)), np.eye(2), np.eye(2))}), ["key"], "flag").first()
    assert np.allclose(r.xf, [1.6, 0.0]) and np.allclose(r.pf, [0.2, 0, 0, 1]) and r.dof == 1


def test_rejection_is_that_of_the_sequential_filter(case):
    models, obs, frame, model = case
    got = collected(K.filter_series(frame, model, ["key"], "reject", 0.05, span=4, fan=3), "xf", "rejected", "skip")
    flags = 0
    for k, m in models.items():
        for t, w in enumerate(sequential(m, obs[k], 0.05)[1]):
            assert np.allclose(got[k, t][0], w[0], atol=1e-9) and got[k, t][1] == got[k, t][2] == w[4]
            flags += w[4]
    assert flags > 1


def test_wrong_epochs_are_refused(spark, case):
    model = case[3]
    both = spark.createDataFrame([("a", 0, 2000.0, [1.0] * 3, [1.0] * 3, [1.0] * 9, [1.0] * 3)], SCHEMA)
    short = spark.createDataFrame([("a", 0, 2000.0, [1.0] * 2, [1.0] * 2, None, None)], SCHEMA)
    for bad in (both, short, short.withColumn("key", F.lit("none"))):
        with pytest.raises(Exception):
            K.filter_series(bad, model, ["key"]).count()


def test_autoregression_by_hand(spark):
    x = np.array([[1.0, 0.0], [0.5, 1.0], [-1.0, 0.5], [0.0, -1.0], [1.0, 1.0], [0.5, -0.5], [-0.5, 0.5]])
    frame = spark.createDataFrame([("a", t, v.tolist()) for t, v in enumerate(x)], "key string, t bigint, x array<double>")
    for span, shrink in ((3, 0.0), (100, 0.25)):
        K_rows = K.lag_products(frame, ["key"], "x", 1, span).collect()
        assert {r.epochs for r in K_rows if r.h == 0} == {7}
        r = K.fit_var(frame, ["key"], "x", 1, shrink).first()
        c0 = x.T @ x / 7
        c0 = c0 + shrink * np.trace(c0) / 2 * np.eye(2)
        c1 = x[1:].T @ x[:-1] / 6
        phi = c1 @ np.linalg.inv(c0)
        q = c0 - phi @ c1.T
        assert np.allclose(r.phi, phi.ravel()) and np.allclose(r.q, ((q + q.T) / 2).ravel()) and np.allclose(r.sigma0, c0.ravel())
        assert r.radius == pytest.approx(np.abs(np.linalg.eigvals(phi)).max())
    doubled = K.fit_var(frame, ["key"], "x", condition=lambda c: 2 * c).first()
    assert np.allclose(doubled.phi, K.fit_var(frame, ["key"], "x").first().phi) and np.allclose(np.array(doubled.sigma0), 2 * (x.T @ x / 7).ravel())
    with pytest.raises(Exception):
        K.fit_var(frame.where("t < 2"), ["key"], "x").count()


def test_second_order_products_meet_across_ranges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(23, 2))
    frame = spark.createDataFrame([("a", t, v.tolist()) for t, v in enumerate(x)], "key string, t bigint, x array<double>")
    got = {(r.h, r.i): r.value for r in K.lag_products(frame, ["key"], "x", 2, 5).collect()}
    for h in range(3):
        want = (x[h:].T @ x[: 23 - h]).ravel()
        assert all(abs(got[h, i] - w) < 1e-12 for i, w in enumerate(want))


def test_stream_equals_batch(spark, case, tmp_path):
    from orbloom.streaming.kalman import stream_vectors

    models, obs, frame, model = case
    flat = frame.where("l IS NULL OR size(r) = size(l)").drop("normal", "right", "t")  # the stream takes variances
    rank = flat.selectExpr("key", "epoch", "l", "r", "row_number() OVER (PARTITION BY key ORDER BY epoch) - 1 AS t")
    batch = {(r.key, r.epoch): r for r in K.filter_series(rank, model, ["key"], "reject", 0.05, span=4).collect()}
    source = f"{tmp_path}/in"
    for k in range(3):
        flat.where(f"epoch >= {2000 + k * 1.2} AND epoch < {2001.2 + k * 1.2}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(flat.schema).option("maxFilesPerTrigger", 1).parquet(source)
    process = {r.key: K.Process(r.asDict()) for r in model.collect()}
    q = stream_vectors(stream, process, 0.05).writeStream.format("memory").queryName("vector_states").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("vector_states").collect()
    assert len(got) == len(batch)
    for r in got:
        w = batch[r.key, r.epoch]
        assert np.allclose(r.x, w.xf[: len(r.x)], atol=1e-9) and r.gap == w.gap and r.rejected == w.rejected


def test_chain_beats_its_observations(spark):
    rng = np.random.default_rng(21)
    index = [(n, m, cs) for n in range(2, 4) for m in range(n + 1) for cs in ((0, 1) if m else (0,))]
    p, t = len(index), 90
    x = np.zeros((t + 100, p))
    for k in range(1, t + 100):
        x[k] = 0.9 * x[k - 1] + rng.normal(size=p)
    x = x[100:]
    noise = rng.normal(size=x.shape) * 2
    cols = ["epoch", "n", "m", "cs", "v", "s"]
    truth = pd.DataFrame([(2005 + k / 12, *c, x[k, i], 2.0) for k in range(t) for i, c in enumerate(index)], columns=cols)
    seen = truth.assign(v=truth.v + noise.ravel())
    obs = spark.createDataFrame(seen[((seen.epoch - 2005) * 12).round() % 10 > 0])  # every tenth epoch is missing
    grid = spark.createDataFrame([(2005 + k / 12,) for k in range(t)], "epoch double")
    for structure in ("orderblock", "diagonal", "full"):
        out, report = K.chain(obs, spark.createDataFrame(truth), 2008.0, structure=structure, shrink=1e-6, climatology=False, grid=grid, span=16)
        got = out.toPandas().merge(truth, on=["epoch", "n", "m", "cs"])
        assert len(got) == len(truth)
        assert ((got.v_x - got.v_y) ** 2).mean() < 0.6 * 4
        assert 0.7 < ((got.v_x - got.v_y) ** 2).mean() / (got.s_x**2).mean() < 1.4  # formal sigmas are honest
        gaps = {r.t for r in report.where("gap").collect()}
        assert gaps == set(range(0, t, 10))
    with pytest.raises(ValueError):
        K.chain(obs.withColumn("s", F.lit(0.0)), obs, 2008.0)


def test_many_ranges_step_as_one_does():
    """Gaps, values, normal equations and epochs kept out, side by side, for a process of second order."""
    rng = np.random.default_rng(8)
    process = K.Process({"p": 2, "order": 2, "phi": np.concatenate([0.5 * np.eye(2).ravel(), 0.2 * np.eye(2).ravel()]), "q": np.eye(2).ravel(), "sigma0": 2 * np.eye(2).ravel()})
    kind, skip = np.array([0, 1, 2, 1, 2]), np.array([False, False, False, True, True])
    x, vec = rng.standard_normal((5, 4)), rng.standard_normal((5, 2))
    p, square = (np.stack([(a := rng.standard_normal((n, n))) @ a.T + np.eye(n) for _ in range(5)]) for n in (4, 2))
    got = process.steps(x, p, kind, vec, square, skip)
    for i, c in enumerate(kind):
        obs = None if c == 0 else ("l", vec[i], square[i]) if c == 1 else ("n", square[i], vec[i])
        one = process.step(x[i], p[i], obs, bool(skip[i]))
        assert np.allclose(got[0][i], one[0]) and np.allclose(got[1][i], one[1])
        assert all((b is None and (a == -1 or np.isnan(a))) or np.isclose(a, b) for a, b in zip((y[i] for y in got[2:]), one[2:]))
