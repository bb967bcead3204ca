import math

import numpy as np
import pytest

from orbloom.functions import special as S
from orbloom.functions.index import sh_index


@pytest.mark.parametrize("nmax,least", [(3, 0), (7, 0), (12, 2)])
def test_index_size_order_and_uniqueness(nmax, least):
    rows = sh_index(nmax, least)
    assert len(rows) == (nmax + 1) ** 2 - least**2
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert len({r[1:] for r in rows}) == len(rows)
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert all(m or not cs for _, _, m, cs in rows)


def test_normal_field_j2():
    assert S.normal_field(4)[2] * -math.sqrt(5) == pytest.approx(1.082629821313e-3, rel=1e-9)


def test_gauss_legendre_integrates_polynomials():
    x, w = S.gauss_legendre(6)
    assert w.sum() == pytest.approx(2)
    assert (w * x**10).sum() == pytest.approx(2 / 11)


def test_legendre_is_orthonormal_and_derivative_agrees():
    x, w = S.gauss_legendre(14)
    p = S.legendre(8, np.arcsin(x))
    for m in range(4):
        g = np.einsum("ik,jk,k->ij", p[m:, m], p[m:, m], w) / 2 * (1 if m == 0 else 0.5)
        assert np.allclose(g, np.eye(len(g)), atol=1e-12)
    lat, h = np.array([0.3, -0.7]), 1e-6
    _, d, dd = S.legendre_derivative(6, lat)
    assert np.allclose(d, (S.legendre(6, lat + h) - S.legendre(6, lat - h)) / (2 * h), atol=1e-6)
    assert np.allclose(dd, (S.legendre(6, lat + 1e-4) - 2 * S.legendre(6, lat) + S.legendre(6, lat - 1e-4)) / 1e-8, atol=1e-4)


def test_special_functions():
    assert S.betainc(0.3, 2, 3) == pytest.approx(0.3483, abs=1e-4)
    assert S.psi(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert S.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert S.chi2_quantile(0.95, 10) == pytest.approx(18.307, abs=0.05)


def test_gaussian_weights_fall_and_stay_zero():
    w = S.gaussian_weights(200, 1000.0)
    assert w[0] == 1 and np.all(np.diff(w) <= 0) and w[-1] == 0


def test_kernels_refuse_what_they_cannot_do():
    with pytest.raises(ValueError):
        S.kernel_factors("ewh", 4)
    with pytest.raises(ValueError):
        S.kernel_factors("geoid", 4, height=1.0)
    with pytest.raises(ValueError):
        S.kernel_factors("ewh", 4, kn=[0, -1, 0, 0, 0])
    assert S.kernel_factors("gravity_anomaly", 3)[1] == 0
