"""Scalar functions: Columns in, Columns out; missing is null, and non-finite numbers become missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6
OFF_EDGE = 1.2345e-9


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def safe_div(x: Column, y: Column) -> Column:
    """x / y with the divisor kept TINY away from zero, on its own side (zero: above)."""
    return F.when(y.isNotNull(), x / (F.when(y < 0, -1.0).otherwise(1.0) * F.greatest(F.abs(y), F.lit(TINY))))


SCALAR = {
    "Abs": F.abs,
    "Sign": F.signum,
    "Log": lambda x: F.log(F.abs(x) + TINY),
    "Add": lambda x, y: x + y,
    "Sub": lambda x, y: x - y,
    "Mul": lambda x, y: x * y,
    "Div": safe_div,
    "Greater": lambda x, y: (x > y).cast("double"),
    "Less": lambda x, y: (x < y).cast("double"),
}


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


#: fixed values: twelve industries, the first range that holds the code wins
INDUSTRIES = (
    ("NoDur", ((100, 999), (2000, 2399), (2700, 2749), (2770, 2799), (3100, 3199), (3940, 3989))),
    ("Durbl", ((2500, 2519), (2590, 2599), (3630, 3659), (3710, 3711), (3714, 3714), (3716, 3716), (3750, 3751), (3792, 3792), (3900, 3939), (3990, 3999))),
    ("Manuf", ((2520, 2589), (2600, 2699), (2750, 2769), (3000, 3099), (3200, 3569), (3580, 3629), (3700, 3709), (3712, 3713), (3715, 3715), (3717, 3749), (3752, 3791), (3793, 3799), (3830, 3839), (3860, 3899))),
    ("Enrgy", ((1200, 1399), (2900, 2999))),
    ("Chems", ((2800, 2829), (2840, 2899))),
    ("BusEq", ((3570, 3579), (3660, 3692), (3694, 3699), (3810, 3829), (7370, 7379))),
    ("Telcm", ((4800, 4899),)),
    ("Utils", ((4900, 4949),)),
    ("Shops", ((5000, 5999), (7200, 7299), (7600, 7699))),
    ("Hlth", ((2830, 2839), (3693, 3693), (3840, 3859), (8000, 8099))),
    ("Money", ((6000, 6999),)),
)


def industry(code: Column) -> Column:
    """The name of the code's industry; 'Other' for the rest and for missing codes."""
    out = F.lit("Other")
    for name, ranges in reversed(INDUSTRIES):
        hit = F.lit(False)
        for lo, hi in ranges:
            hit = hit | code.between(lo, hi)
        out = F.when(hit, name).otherwise(out)
    return out


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; a small constant keeps exact decimals off the rounding edge."""
    return F.round(x + OFF_EDGE, digits) + F.lit(0.0)
