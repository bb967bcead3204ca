"""Numerical functions that Spark SQL lacks, in numpy; results go to Spark as small dimension tables."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

# Defining constants of the reference ellipsoids and the gravity-field defaults.
GM_EARTH, R_EARTH = 3.986004415e14, 6378136.3
RHO_EARTH, RHO_WATER = 5517.0, 1000.0
ELLIPSOIDS = {
    "WGS84": {"gm": 3.986004418e14, "a": 6378137.0, "f": 1 / 298.257223563, "omega": 7.292115e-5},
    "GRS80": {"gm": 3.986005e14, "a": 6378137.0, "f": 1 / 298.257222101, "omega": 7.292115e-5},
}
CHI2_1_MEDIAN = 0.454936423119573


def betainc(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def psi(x: float) -> float:
    """Digamma: recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def chi2_quantile(p: float, k: float) -> float:
    """Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    c = 2 / (9 * k)
    return k * max(0.0, 1 - c + z * math.sqrt(c)) ** 3


def student_p(t: float, nu: float) -> float:
    return betainc(nu / (nu + t * t), nu / 2, 0.5)


def f_test_p(f: float, d1: float, d2: float) -> float:
    return betainc(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def sinc_pi(x):
    return np.sinc(x)


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1] from the eigenvalues of the Jacobi matrix."""
    k = np.arange(1, n)
    off = k / np.sqrt(4.0 * k * k - 1)
    x, v = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return x, 2 * v[0] ** 2


@lru_cache(maxsize=16)
def _legendre(nmax: int, lat: tuple[float, ...]) -> np.ndarray:
    phi = np.asarray(lat)
    t, u = np.sin(phi), np.cos(phi)
    p = np.zeros((nmax + 1, nmax + 1, len(phi)))
    scale = 1e-280
    sect = np.full(len(phi), scale)
    for m in range(nmax + 1):
        if m:
            sect = sect * (math.sqrt(3.0) if m == 1 else math.sqrt((2 * m + 1) / (2 * m)))
        col = u**m / scale
        a, b = sect, np.zeros_like(sect)
        p[m, m] = a * col
        for n in range(m + 1, nmax + 1):
            alpha = math.sqrt((2 * n + 1) * (2 * n - 1) / ((n - m) * (n + m)))
            beta = math.sqrt((2 * n + 1) * (n + m - 1) * (n - m - 1) / ((n - m) * (n + m) * (2 * n - 3))) if n > m + 1 else 0.0
            a, b = alpha * t * a - beta * b, a
            p[n, m] = a * col
    return p


def legendre(nmax: int, lat_rad) -> np.ndarray:
    """4-pi normalised associated Legendre functions [n, m, latitude]; kept for the last few grids."""
    return _legendre(nmax, tuple(float(x) for x in np.atleast_1d(lat_rad)))


def legendre_derivative(nmax: int, lat_rad) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Functions and their first and second latitude derivatives, from neighbouring orders."""
    p = legendre(nmax, lat_rad)

    def step(q: np.ndarray) -> np.ndarray:
        d = np.zeros_like(q)
        for n in range(nmax + 1):
            for m in range(n + 1):
                up = math.sqrt((n - m) * (n + m + 1)) * (math.sqrt(2) if m == 0 else 1) * q[n, m + 1] if m < n else 0.0
                down = math.sqrt((n + m) * (n - m + 1)) * (math.sqrt(2) if m == 1 else 1) * q[n, m - 1] if m else 0.0
                d[n, m] = 0.5 * (up - down) if m else 0.5 * up
                if m == 0:
                    d[n, m] = math.sqrt(n * (n + 1) / 2) * q[n, 1] if n else 0.0
        return d

    d = step(p)
    return p, d, _second(nmax, p, d, lat_rad)


def _second(nmax: int, p: np.ndarray, d: np.ndarray, lat_rad) -> np.ndarray:
    """Legendre's differential equation gives the second derivative."""
    phi = np.atleast_1d(lat_rad)
    n = np.arange(nmax + 1)[:, None, None]
    m = np.arange(nmax + 1)[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.tan(phi) * d - (n * (n + 1) - m**2 / np.cos(phi) ** 2) * p


def ylm(lat_rad, lon_rad, n: np.ndarray, m: np.ndarray, cs: np.ndarray) -> np.ndarray:
    """Basis rows [points, coefficients]."""
    p = legendre(int(n.max()), lat_rad)[n, m].T
    arg = np.atleast_1d(lon_rad)[:, None] * m[None, :]
    return p * np.where(cs == 0, np.cos(arg), np.sin(arg))


def quadrature(nmax: int, n_lat: int | None = None, n_lon: int | None = None):
    """Latitudes, longitudes and weights (sum 1) of a Gauss-Legendre grid, point by point, in radians."""
    n_lat, n_lon = n_lat or nmax + 1, n_lon or 2 * nmax + 2
    x, w = gauss_legendre(n_lat)
    lat, lon = np.arcsin(x), 2 * np.pi * np.arange(n_lon) / n_lon
    return np.repeat(lat, n_lon), np.tile(lon, n_lat), np.repeat(w / 2 / n_lon, n_lon)


def gaussian_weights(nmax: int, radius_km: float, r_km: float = 6378.1363) -> np.ndarray:
    """Degree weights of the Gaussian smoother; from where the recursion turns unstable they are zero."""
    b = math.log(2) / (1 - math.cos(radius_km / r_km))
    w = np.zeros(nmax + 1)
    w[0] = 1
    if nmax:
        w[1] = 1 / math.tanh(b) - 1 / b
    for n in range(1, nmax):
        nxt = w[n - 1] - (2 * n + 1) / b * w[n]
        if not 0 <= nxt <= w[n]:
            break
        w[n + 1] = nxt
    return w


def normal_field(nmax: int, system: str = "WGS84", **changes: float) -> np.ndarray:
    """Even zonal coefficients (4-pi normalised) of a level ellipsoid."""
    d = ELLIPSOIDS[system] | changes
    e2 = d["f"] * (2 - d["f"])
    ep = math.sqrt(e2 / (1 - e2))
    m = d["omega"] ** 2 * d["a"] ** 3 * (1 - d["f"]) / d["gm"]
    q0 = ((1 + 3 / ep**2) * math.atan(ep) - 3 / ep) / 2
    j2 = e2 / 3 * (1 - 2 / 15 * m * ep / q0)
    c = np.zeros(nmax + 1)
    c[0] = 1
    for k in range(1, nmax // 2 + 1):
        j = (-1) ** (k + 1) * 3 * e2**k / ((2 * k + 1) * (2 * k + 3)) * (1 - k + 5 * k * j2 / e2)
        c[2 * k] = -j / math.sqrt(4 * k + 1)
    return c


# Potential-type quantities: power of (R/r) added to n.
_UPWARD = {"potential": 1, "gravity_anomaly": 2, "gravity_disturbance": 2, "gravity_gradient_rr": 3}


def kernel_factors(quantity: str, nmax: int, gm: float = GM_EARTH, r: float = R_EARTH, kn=None, hn=None, rho_earth: float = RHO_EARTH, rho_water: float = RHO_WATER, height: float = 0.0) -> np.ndarray:
    """Degree factors from Stokes coefficients to a field quantity."""
    n = np.arange(nmax + 1.0)
    for name, x in (("kn", kn), ("hn", hn)):
        if x is not None and len(x) < nmax + 1:
            raise ValueError(f"{name} has {len(x)} entries but degrees 0..{nmax} need {nmax + 1}")
    if kn is not None:
        load = 1 + np.asarray(kn, float)[: nmax + 1]
        if not np.all(np.isfinite(load)) or np.any(load == 0):
            raise ValueError("the load kernel divides by 1 + kn, which is zero or not finite")
    elif quantity in ("ewh", "surface_density", "bottom_pressure", "deformation_up"):
        raise ValueError(f"{quantity} needs the load Love numbers kn")
    if quantity == "deformation_up" and hn is None:
        raise ValueError("deformation_up needs the load Love numbers hn as well")
    density = r * rho_earth / 3
    table = {
        "none": lambda: np.ones_like(n),
        "geoid": lambda: np.full_like(n, r),
        "potential": lambda: np.full_like(n, gm / r),
        "gravity_anomaly": lambda: gm / r**2 * (n - 1),
        "gravity_disturbance": lambda: gm / r**2 * (n + 1),
        "gravity_gradient_rr": lambda: gm / r**3 * (n + 1) * (n + 2),
        "ewh": lambda: density / rho_water * (2 * n + 1) / load,
        "surface_density": lambda: density * (2 * n + 1) / load,
        "bottom_pressure": lambda: gm / r**2 * density * (2 * n + 1) / load,
        "deformation_up": lambda: r * np.asarray(hn, float)[: nmax + 1] / load,
    }
    if quantity not in table:
        raise ValueError(f"unknown quantity: {quantity}")
    k = table[quantity]()
    if height > 0:
        if quantity not in _UPWARD:
            raise ValueError(f"a height does not apply to {quantity}, a surface quantity")
        k = k * (r / (r + height)) ** (n + _UPWARD[quantity])
    return k


def log_chi2_bias(k: float) -> float:
    """Mean of half the logarithm of a chi-square over its degrees of freedom."""
    return 0.5 * (psi(k / 2) - math.log(k / 2))
