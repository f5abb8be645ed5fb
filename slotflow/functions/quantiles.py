"""Student-t critical values as one column expression for every number of degrees of freedom."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES = 16  # of the Gauss-Legendre rule: the integrand is smooth on the range that matters
_ROUNDS = 8  # of Newton's method
_SHIFT = 40  # of the gamma functions' argument, where their ratio's expansion is exact to the last digits
#: Gamma(y + 1/2) / Gamma(y) = sqrt(y) * (sum of c[k] / y**k)
_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304)


def _gamma_ratio(x: Column) -> Column:
    """Gamma(x + 1/2) / Gamma(x) for x >= 1/2."""
    y = x + F.lit(float(_SHIFT))
    far = F.lit(0.0)
    for k, c in enumerate(_RATIO):
        far = far + F.lit(c) / F.pow(y, F.lit(float(k)))
    steps = F.sequence(F.lit(0), F.lit(_SHIFT - 1))
    return F.aggregate(steps, F.sqrt(y) * far, lambda r, i: r * (x + i) / (x + i + F.lit(0.5)))


def t_critical(dof: Column, confidence: float) -> Column:
    """Two-sided critical value for ``dof`` (NULL below 1).

    With t = sqrt(dof) tan(a), the share within t is a constant times the integral of
    cos ** (dof - 1) from 0 to a. It rises ever more slowly with a, so Newton's method climbs
    to the wanted share from the normal quantile, which is always below.
    """
    nu = dof.cast("double")
    x, w = np.polynomial.legendre.leggauss(_NODES)
    rule = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip((x + 1) / 2, w / 2)])

    def power(angle: Column) -> Column:
        return F.exp((nu - 1) / 2 * F.log1p(-F.pow(F.sin(angle), F.lit(2.0))))

    def climbed(front: Column) -> Column:
        def climb(angle: Column, _: Column) -> Column:
            share = front * angle * F.aggregate(rule, F.lit(0.0), lambda s, n: s + n["w"] * power(angle * n["x"]))
            return angle + (F.lit(confidence) - share) / (front * power(angle))

        start = F.atan(F.lit(NormalDist().inv_cdf(0.5 + confidence / 2)) / F.sqrt(nu))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, climb)

    # As an element, the front factor is computed once and not in every round.
    front = F.lit(2 / math.sqrt(math.pi)) * _gamma_ratio(nu / 2)
    angle = F.get(F.transform(F.array(front), climbed), F.lit(0))
    return F.when(dof >= 1, F.sqrt(nu) * F.tan(angle))
