"""Closed-form statistics as columns."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def kelly_size(p: Column, payoff: float | Column, scale: float = 0.5, cap: float = 1.0) -> Column:
    """Scaled Kelly fraction for a known payoff ratio, clipped to [0, cap]."""
    edge = p - (1 - p) / payoff
    return F.least(F.greatest(edge * scale, F.lit(0.0)), F.lit(cap))


def breakeven_win_rate(payoff: float | Column, cost: float | Column = 0.0, avg_risk: float = 1.0) -> Column:
    """Win rate at which the barrier geometry pays for itself after costs."""
    payoff = payoff if isinstance(payoff, Column) else F.lit(float(payoff))
    cost = cost if isinstance(cost, Column) else F.lit(float(cost))
    base = F.lit(1.0) / (1.0 + payoff)
    return F.when(payoff > 0, F.least(F.lit(1.0), base + cost / (avg_risk * (1.0 + payoff))))


def wilson_bound(wins: Column, n: Column, upper: bool, z: float = 1.959963984540054) -> Column:
    """Wilson score bound of a win rate (95% by default)."""
    share = wins / n
    centre = share + z * z / (2 * n)
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    raw = (centre + spread if upper else centre - spread) / (1 + z * z / n)
    return F.when(n > 0, F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def sidak(p: Column, tried: int | Column) -> Column:
    """p-value of the best of ``tried`` independent variants."""
    return 1.0 - F.pow(1.0 - p, tried if isinstance(tried, Column) else F.lit(tried))


def log_factorial(n: Column) -> Column:
    """ln n!, from Stirling's series; small arguments are exact products."""
    x = n.cast("double")
    series = ((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
              - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * F.pow(x, F.lit(7))))
    small = F.element_at(F.array(*[F.lit(math.log(math.factorial(i))) for i in range(16)]),
                         (F.least(n, F.lit(15)) + 1).cast("int"))
    return F.when(n <= 15, small).otherwise(series)


def profit_factor(net: Column) -> Column:
    """Sum of wins over sum of losses; losses include zero."""
    wins = F.sum(F.when(net > 0, net).otherwise(0.0))
    losses = F.sum(F.when(net <= 0, net).otherwise(0.0))
    n_wins = F.sum(F.when(net > 0, 1).otherwise(0))
    return (F.when(losses != 0, wins / F.abs(losses))
            .when(n_wins > 0, F.lit(INFINITY)).when(F.count(net) > 0, F.lit(0.0)))


def compounded(ret: Column) -> Column:
    """Total compounded return of a group."""
    return F.product(1 + ret) - 1


def compounded_or_lost(ret: Column) -> Column:
    """``compounded`` as a sum of logs; a loss of all or more ends at -1."""
    grown = F.exp(F.sum(F.when(ret > -1, F.log1p(ret)))) - 1
    return F.when(F.min(ret) <= -1, F.lit(-1.0)).otherwise(grown)
