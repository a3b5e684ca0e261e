"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi
#: A correlation this near to 1 or -1 is it: beyond, the rounding of its square would show in the root of what is left.
NEAR = 1e-12


def micro(x: Column) -> Column:
    """Millionths as a long; the offset keeps exact ties away from the border, so that engines agree."""
    return F.floor(x * 1e6 + 0.5137).cast("long")


def milli(x: Column) -> Column:
    """micro with three digits fewer, for large values."""
    return F.floor(x * 1e3 + 0.5137).cast("long")


def nano(x: Column) -> Column:
    """micro with three more digits, for values far below 1."""
    return F.floor(x * 1e9 + 0.5137).cast("long")


def inverse_or_zero(x: Column) -> Column:
    return F.when(x != 0, 1.0 / x).otherwise(F.lit(0.0))


def arc_cosine(s: Column, d1: Column, d2: Column) -> tuple[Column, Column]:
    """The ReLU step of a neural tangent kernel on a covariance with given standard deviations: (new covariance, derivative factor). Zero deviations give zero."""
    ok = (d1 > 0) & (d2 > 0)
    r = F.when(F.abs(s / d1 / d2) > 1 - NEAR, F.signum(s)).otherwise(s / d1 / d2)
    rest = PI - F.acos(r)
    new = (r * rest + F.sqrt(F.greatest(1 - r * r, F.lit(0.0)))) / PI * d1 * d2
    return F.when(ok, new).otherwise(0.0), F.when(ok, rest / PI).otherwise(0.0)


def truncation(n: Column) -> Column:
    """The nonparanormal clip: 1 / (4 n^(1/4) sqrt(pi ln n))."""
    return 1 / (4 * F.pow(n, F.lit(0.25)) * F.sqrt(PI * F.ln(n)))


# The rational approximations of the normal quantile of Wichura (1988), algorithm AS 241, constant term first:
# around the median, in the tails, and in the far tails; numerator and denominator each.
MEDIAN = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def ratio(of: tuple[tuple[float, ...], tuple[float, ...]], x):
    """A quotient of two polynomials of x, a column or an array."""
    top, bottom = (reduce(lambda got, c: got * x + c, reversed(cs[:-1]), cs[-1]) for cs in of)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1; there is none among the built-in functions."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(MEDIAN, 0.180625 - q * q)).otherwise(F.signum(q) * tail)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """normal_quantile of an array."""
    q, r = p - 0.5, np.sqrt(-np.log(np.minimum(p, 1 - p)))
    tail = np.where(r <= 5, ratio(TAIL, r - 1.6), ratio(FAR, r - 5))
    return np.where(np.abs(q) <= 0.425, q * ratio(MEDIAN, 0.180625 - q * q), np.sign(q) * tail)
