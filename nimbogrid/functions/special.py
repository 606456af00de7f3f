"""Special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation with g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """The gamma function of positive and negative numbers; missing at its poles."""

    def above(v: Column) -> Column:
        v = v - 1
        s = F.lit(LANCZOS[0])
        for n, a in enumerate(LANCZOS[1:], 1):
            s = s + a / (v + n)
        t = v + 7.5
        return math.sqrt(2 * math.pi) * F.pow(t, v + 0.5) * F.exp(-t) * s

    pole = (x <= 0) & (x == F.floor(x))
    return F.when(pole, None).when(x >= 0.5, above(F.greatest(x, F.lit(0.5)))).otherwise(F.try_divide(F.lit(math.pi), F.sin(math.pi * x) * above(1 - F.least(x, F.lit(0.5)))))
