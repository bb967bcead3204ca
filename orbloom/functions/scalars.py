"""Column expressions: epochs, file names, latitudes, pole tide, products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586


def decimal_year(ts: Column) -> Column:
    """Year plus the passed share of it."""
    y = F.year(ts)
    begin = F.unix_timestamp(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    end = F.unix_timestamp(F.make_timestamp(y + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return y + (F.unix_timestamp(ts) - begin) / (end - begin)


def month_epoch(ts: Column) -> Column:
    """Mid-month decimal year."""
    return F.year(ts) + (F.month(ts) - 0.5) / 12


def days_in_year(y: Column) -> Column:
    return F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), F.lit(366)).otherwise(F.lit(365))


def day_epoch(y: Column, doy: Column) -> Column:
    """Mid-day decimal year of a day of year."""
    return y + (doy - 0.5) / days_in_year(y)


def date_code_epoch(code: Column) -> Column:
    """yyyymmdd(.hhmm) to decimal year; numbers below 18000000 pass as they are."""
    d = F.floor(code)
    y, mo, day = F.floor(d / 10000).cast("int"), F.floor((d % 10000) / 100).cast("int"), (d % 100).cast("int")
    part = code - d
    hours = F.floor(part * 100)
    minutes = F.round((part * 10000) % 100)
    doy = F.dayofyear(F.make_date(y, mo, day)) - 1 + (hours + minutes / 60) / 24
    return F.when(code >= 1.8e7, y + doy / days_in_year(y)).otherwise(code)


def month_number(epoch: Column) -> Column:
    """1 to 12 from the fraction of a decimal year."""
    return F.greatest(F.lit(1), F.least(F.lit(12), 1 + F.floor((epoch - F.floor(epoch)) * 12))).cast("int")


def file_name_epoch(name: Column) -> Column:
    """Epoch in a product file's name: year and days of a span, a date, or a month; null without one."""
    span = [F.regexp_extract(name, r"_?(\d{4})(\d{3})-(\d{4})(\d{3})", k) for k in (1, 2, 3, 4)]
    y0, d0, y1, d1 = (F.when(x != "", x).cast("int") for x in span)
    date = F.regexp_extract(name, r"_(\d{4}-\d{2}-\d{2})", 1)
    month = [F.regexp_extract(name, r"_(\d{4})-(\d{2})", k) for k in (1, 2)]
    day = F.when(date != "", date).cast("date")
    ym = [F.when(x != "", x).cast("int") for x in month]
    return F.coalesce((day_epoch(y0, d0) + day_epoch(y1, d1)) / 2, day_epoch(F.year(day), F.dayofyear(day)), ym[0] + (ym[1] - 0.5) / 12)


def product_of(name: Column) -> Column:
    return F.when(name.rlike("G[ASD][A-DM]"), F.regexp_extract(name, "(GSM|GAA|GAB|GAC|GAD)", 1)).otherwise(F.lit("unknown"))


def combined_product(a: Column, b: Column, sign: str) -> Column:
    """Type of a sum or difference: equal types stay, a restored background gives 'A+B', others 'combined'."""
    gad = F.when((a == "GSM") & b.isin("GAA", "GAB", "GAC", "GAD"), F.concat(a, F.lit(sign), b))
    return F.when(a == b, a).otherwise(F.coalesce(gad, F.lit("combined")))


def sinc_pi(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(F.lit(TWO_PI / 2) * x) / F.nullif(F.lit(TWO_PI / 2) * x, F.lit(0.0)))


def geodetic_to_geocentric(lat_deg: Column, flattening: float = 1 / 298.257223563) -> Column:
    k = (1 - flattening) ** 2
    return F.when(F.abs(lat_deg) >= 90, lat_deg).otherwise(F.degrees(F.atan(F.lit(k) * F.tan(F.radians(lat_deg)))))


def geocentric_to_geodetic(lat_deg: Column, flattening: float = 1 / 298.257223563) -> Column:
    k = (1 - flattening) ** 2
    return F.when(F.abs(lat_deg) >= 90, lat_deg).otherwise(F.degrees(F.atan(F.tan(F.radians(lat_deg)) / F.lit(k))))


def hammer(lat_deg: Column, lon_deg: Column) -> tuple[Column, Column]:
    """Hammer projection to the plane."""
    phi, lam = F.radians(lat_deg), F.radians(lon_deg)
    z = F.sqrt(1 + F.cos(phi) * F.cos(lam / 2))
    return F.lit(2 * 2**0.5) * F.cos(phi) * F.sin(lam / 2) / z, F.lit(2**0.5) * F.sin(phi) / z


# Conventional mean poles in milliarcseconds (polynomials in years from 2000) and pole tide factors.
_POLE_2010_CUBIC = ((55.974, 1.8243, 0.18413, 0.007024), (346.346, 1.7896, -0.10729, -0.000908))
_POLE_2010_LINEAR = ((23.513, 7.6141), (358.891, -0.6287))
_POLE_2018 = ((55.0, 1.677), (320.5, 3.460))
SOLID_TIDE, OCEAN_TIDE = -1.333e-9, -2.1778e-10


def mean_pole(model: str, epoch: Column) -> tuple[Column, Column]:
    """x and y of the mean pole in arcseconds."""
    t = epoch - 2000

    def poly(c):
        out = F.lit(c[-1])
        for a in reversed(c[:-1]):
            out = out * t + F.lit(a)
        return out / 1000

    if model == "IERS2018":
        return poly(_POLE_2018[0]), poly(_POLE_2018[1])
    if model != "IERS2010":
        raise ValueError(f"unknown mean pole: {model}")
    return tuple(F.when(epoch < 2010, poly(c)).otherwise(poly(k)) for c, k in zip(_POLE_2010_CUBIC, _POLE_2010_LINEAR))


def pole_tide_change(epoch: Column, source: str = "IERS2010", target: str = "IERS2018", mode: str = "both") -> tuple[Column, Column]:
    """What to add to C21 and S21 to go from one mean pole to another."""
    (xa, ya), (xb, yb) = mean_pole(source, epoch), mean_pole(target, epoch)
    m1, m2 = xb - xa, ya - yb
    dc = ds = F.lit(0.0)
    if mode in ("solid", "both"):
        dc, ds = dc + SOLID_TIDE * (m1 + 0.0115 * m2), ds + SOLID_TIDE * (m2 - 0.0115 * m1)
    if mode in ("ocean", "both"):
        dc, ds = dc + OCEAN_TIDE * (m1 - 0.01724 * m2), ds + OCEAN_TIDE * (m2 + 0.03365 * m1)
    return dc, ds


def retry_delay(attempt: Column, jitter: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before the next try: doubling, with jitter, up to a limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1) * (1 + jitter), F.lit(most))
