"""Queries process every set of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbloom.operators import combination as M
from orbloom.operators import sequential as K
from orbloom.operators import windows as O
from orbloom.plans import registry
from orbloom.plans.base import coef

QUERIES = registry.queries()


@pytest.mark.parametrize("name", ["synthesis_points", "destripe_moving", "mc_propagate"])
def test_every_set_is_in_the_result(spark, sf_dir, name):
    sets = coef(spark, sf_dir).select("set_id").distinct().count()
    assert QUERIES[name](spark, sf_dir).select("set_id").distinct().count() == sets


def test_var_model_uses_every_epoch(spark, sf_dir):
    rows = coef(spark, sf_dir).where("n <= 2").orderBy("epoch", "n", "m", "cs").select("epoch", "n", "m", "cs", "v").toPandas()
    x = rows.pivot(index=["n", "m", "cs"], columns="epoch", values="v")
    from orbloom.functions.index import index_arrays

    order = list(zip(*(a.tolist() for a in index_arrays(2, 0))))
    phi = K.fit_var(x.loc[order].to_numpy(), 1, 0.1)[0][0]
    got = {(r.i, r.j): r.phi for r in QUERIES["var_model"](spark, sf_dir).collect()}
    assert len(got) == phi.size and all(abs(got[k] - v) < 2e-6 for k, v in np.ndenumerate(phi))


def test_moving_destripe_by_polynomials(spark, sf_dir):
    x = coef(spark, sf_dir).where("set_id < 3").toPandas()
    got = O.destripe_moving(coef(spark, sf_dir).where("set_id < 3"), ["set_id"], 1, 1, 3).toPandas()
    for _, g in x.assign(parity=x.n % 2).groupby(["set_id", "m", "cs", "parity"]):
        g = g.sort_values("n")
        n, v = g.n.to_numpy(float), g.v.to_numpy()
        want = v.copy()
        if g.m.iloc[0] >= 1 and len(n) > 2:
            for i in range(len(n)):
                lo, hi = max(0, i - 1), min(len(n), i + 2)
                want[i] -= np.polyval(np.polyfit(n[lo:hi], v[lo:hi], 1), n[i])
        h = got.merge(g[["set_id", "n", "m", "cs"]], on=["set_id", "n", "m", "cs"]).sort_values("n")
        assert np.allclose(h.v, want, atol=1e-9)


def test_modes_of_more_epochs_than_places(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4200, 3)) * [3.0, 2.0, 1.0]
    x = spark.createDataFrame([(t, p, float(v)) for (t, p), v in np.ndenumerate(a)], "t long, p long, v double")
    patterns, pcs, share = M.eof(x, "t", ["p"], "v", 2)
    u, s, vt = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    assert np.allclose(share, (s**2 / (s**2).sum())[:2])
    got = {(r.p, r["mode"]): r.pattern for r in patterns.collect()}
    assert all(abs(abs(got[p, j]) - abs(vt[j, p])) < 1e-9 for p in range(3) for j in range(2))
    pc = {(r.t, r["mode"]): r.pc for r in pcs.collect()}
    assert len(pc) == 8400 and all(abs(abs(pc[t, j]) - abs(u[t, j] * s[j])) < 1e-8 for t in range(4200) for j in range(2))


def test_eof_query_takes_all_labels(spark, sf_dir):
    rows = coef(spark, sf_dir).select("epoch", "n", "m", "cs", "v").toPandas()
    a = rows.pivot(index="epoch", columns=["n", "m", "cs"], values="v").to_numpy()
    s = np.linalg.svd(a - a.mean(axis=0), compute_uv=False)
    explained = {r["mode"]: r.explained for r in QUERIES["eof"](spark, sf_dir).collect()}
    assert all(abs(explained[j] - s[j] ** 2 / (s**2).sum()) < 2e-6 for j in range(3))


def test_chain_standard_fits_every_set(spark, sf_dir, monkeypatch):
    from orbloom.plans import field_queries

    seen = []
    fit = field_queries.R.fit
    monkeypatch.setattr(field_queries.R, "fit", lambda x, *a, **b: seen.append(x) or fit(x, *a, **b))
    assert QUERIES["chain_standard"](spark, sf_dir).count() == 64
    sets = coef(spark, sf_dir).select("epoch").distinct().count()
    assert seen[0].select("epoch").distinct().count() == sets


def test_simulation_is_dealt_by_its_draws(spark, sf_dir, monkeypatch):
    """More draws, more parts: no part's sums outgrow its memory."""
    monkeypatch.setattr(M, "DRAWS", 1 << 14)
    x = coef(spark, sf_dir).where("n < 2")
    out = M.monte_carlo(x, lambda d: d.groupBy("sample", "set_id").agg(F.sum("v").alias("value")), ["set_id"], 200)
    assert out.rdd.getNumPartitions() == -(-x.count() * 200 // (1 << 14)) > 8


def test_separated_field_meets_no_other_epoch(spark):
    """More epochs than places: one shuffle, by the epoch, and the field of the dense decomposition."""
    rng = np.random.default_rng(6)
    a = np.outer(rng.standard_normal(80), [3.0, -2.0, 1.0, 2.0]) + 0.1 * rng.standard_normal((80, 4))
    x = spark.createDataFrame([(float(t), p, float(v)) for (t, p), v in np.ndenumerate(a)], "t double, p int, v double")
    out, n, rms = M.separate(x, "t", ["p"], "v", keep=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    c = a - a.mean(axis=0)
    u = np.linalg.svd(c, full_matrices=False)[2][0]
    got = out.toPandas().sort_values(["t", "p"])
    assert np.allclose(got.separated, (c @ np.outer(u, u)).ravel()) and np.allclose(got.separated + got.noise, c.ravel())
    assert n == 1 and np.isclose(rms, np.sqrt(((c - c @ np.outer(u, u)) ** 2).mean()))
