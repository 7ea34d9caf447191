"""Normal distribution and the tests built on it, as column expressions.

The tail is the double-precision approximation of Hart, in the form published by G. West,
"Better approximations to cumulative normal functions" (Wilmott Magazine, 2005).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
SWITCH = 7.07106781186547
SQRT_TWO_PI = 2.506628274631


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _far_fraction(x: Column) -> Column:
    return reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + F.lit(0.65))


def normal_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0, accurate in the far tail; it leaves the range of a double near 38."""
    density = F.exp(-(x * x) / 2.0)
    near = density * _polynomial(NUMERATOR, x) / _polynomial(DENOMINATOR, x)
    far = density / _far_fraction(x) / SQRT_TWO_PI
    return F.when(x < SWITCH, near).otherwise(far)


def normal_cdf(z: Column) -> Column:
    tail = normal_tail(F.abs(z))
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def two_sided_p(z: Column) -> Column:
    """2 (1 - cdf(|z|)); reaches 0 near |z| = 8.3, where 1 - cdf does."""
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def two_sided_p_tail(z: Column) -> Column:
    """The same probability without cancellation, as far as a double goes (|z| of about 38)."""
    return 2.0 * normal_tail(F.abs(z))


def log10_two_sided_p(z: Column) -> Column:
    """The decimal logarithm of the same probability, finite for every finite z."""
    x = F.abs(z)
    far = (F.log(F.lit(2.0 / SQRT_TWO_PI)) - x * x / 2.0 - F.log(_far_fraction(x))) / F.log(F.lit(10.0))
    return F.when(x < SWITCH, F.log10(2.0 * normal_tail(x))).otherwise(far)


def two_proportion_z(n_a: Column, hits_a: Column, n_b: Column, hits_b: Column) -> Column:
    """Pooled z statistic of rate B against rate A: 0 without variance, NULL for an empty group."""
    rate_a = F.try_divide(hits_a.cast("double"), n_a.cast("double"))
    rate_b = F.try_divide(hits_b.cast("double"), n_b.cast("double"))
    pooled = F.try_divide((hits_a + hits_b).cast("double"), (n_a + n_b).cast("double"))
    one = F.lit(1.0)
    spread = F.try_divide(one, n_a.cast("double")) + F.try_divide(one, n_b.cast("double"))
    error = F.sqrt(pooled * (one - pooled) * spread)
    return F.when(error > 0, (rate_b - rate_a) / error).when(error.isNotNull(), 0.0)


def significant(p: Column, confidence: float) -> Column:
    """1 when p lies below 1 - confidence; an undefined p is not significant."""
    return F.when(p < 1 - confidence, 1).otherwise(0)


def chi2_two_groups(n_a: Column, n_b: Column, share_a: float) -> Column:
    """Goodness of fit of two counts to an expected share, one degree of freedom."""
    total = (n_a + n_b).cast("double")
    expected_a, expected_b = total * share_a, total * (1 - share_a)
    return F.try_divide((n_a - expected_a) * (n_a - expected_a), expected_a) + F.try_divide(
        (n_b - expected_b) * (n_b - expected_b), expected_b
    )


def chi2_p(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return two_sided_p_tail(F.sqrt(chi2))
