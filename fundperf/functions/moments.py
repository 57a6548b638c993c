"""Statistics as partial states that merge: a state of each month gives any span of months.

A moment state holds the count, the mean and the sum of squared distances from it; a pair state those of both columns
and the sum of products. Merged means are taken first and the distances of the parts' means added, so nothing
large is subtracted from something as large. Compounded returns merge as products, and whether the last day has a
return as the greatest (day, present) number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundperf.constants import TRADING_DAYS_PER_YEAR
from fundperf.functions.stats import present_on, ratio


@dataclass(frozen=True)
class Moments:
    """Count, mean and squared distances of one column."""

    name: str

    def partial(self, value: Column) -> list[Column]:
        n = F.count(value)
        return [
            n.alias(f"{self.name}_n"),
            F.avg(value).alias(f"{self.name}_mean"),
            (F.var_pop(value) * n).alias(f"{self.name}_m2"),
        ]

    def means(self) -> list[str]:
        return [f"{self.name}_mean"]

    def counts(self) -> str:
        return f"{self.name}_n"

    def merged(self) -> list[Column]:
        """Aggregates over states that know the merged mean, as ``_all_<name>_mean``."""
        n, mean, whole = (F.col(f"{p}{self.name}_{q}") for p, q in (("", "n"), ("", "mean"), ("_all_", "mean")))
        return [
            F.sum(n).alias(f"{self.name}_n"),
            F.max(whole).alias(f"{self.name}_mean"),
            F.sum(F.col(f"{self.name}_m2") + n * (mean - whole) * (mean - whole)).alias(f"{self.name}_m2"),
        ]

    def deviation(self) -> Column:
        """Sample standard deviation; NULL for fewer than two values."""
        n = F.col(f"{self.name}_n")
        return F.when(n > 1, F.sqrt(F.col(f"{self.name}_m2") / (n - 1)))

    def volatility(self) -> Column:
        return self.deviation() * F.sqrt(F.lit(float(TRADING_DAYS_PER_YEAR)))

    def annual_mean(self) -> Column:
        return F.col(f"{self.name}_mean") * F.lit(float(TRADING_DAYS_PER_YEAR))


@dataclass(frozen=True)
class Pairs:
    """Counts, means, squared distances of the regressor and products of two columns, where both are present."""

    name: str

    def partial(self, y: Column, x: Column) -> list[Column]:
        both = y.isNotNull() & x.isNotNull()
        own_y, own_x = F.when(both, y), F.when(both, x)
        n = F.count(own_x)
        return [
            n.alias(f"{self.name}_n"),
            F.avg(own_y).alias(f"{self.name}_my"),
            F.avg(own_x).alias(f"{self.name}_mx"),
            (F.var_pop(own_x) * n).alias(f"{self.name}_m2"),
            (F.covar_pop(own_y, own_x) * n).alias(f"{self.name}_c2"),
        ]

    def means(self) -> list[str]:
        return [f"{self.name}_my", f"{self.name}_mx"]

    def counts(self) -> str:
        return f"{self.name}_n"

    def merged(self) -> list[Column]:
        n = F.col(f"{self.name}_n")
        off_y, off_x = (F.col(f"{self.name}_{m}") - F.col(f"_all_{self.name}_{m}") for m in ("my", "mx"))
        return [
            F.sum(n).alias(f"{self.name}_n"),
            F.max(f"_all_{self.name}_my").alias(f"{self.name}_my"),
            F.max(f"_all_{self.name}_mx").alias(f"{self.name}_mx"),
            F.sum(F.col(f"{self.name}_m2") + n * off_x * off_x).alias(f"{self.name}_m2"),
            F.sum(F.col(f"{self.name}_c2") + n * off_y * off_x).alias(f"{self.name}_c2"),
        ]

    def beta(self) -> Column:
        """Least-squares slope; NULL for a constant regressor."""
        return ratio(F.col(f"{self.name}_c2"), F.col(f"{self.name}_m2"))

    def alpha(self) -> Column:
        """Least-squares intercept, in units of one day."""
        return F.col(f"{self.name}_my") - self.beta() * F.col(f"{self.name}_mx")


@dataclass(frozen=True)
class Compound:
    """The product of daily returns plus one, and the last day with whether it has a return."""

    name: str

    def partial(self, returns: Column, day: Column) -> list[Column]:
        return [
            F.product(returns + 1.0).alias(f"{self.name}_growth"),
            F.max(present_on(day, returns)).alias(f"{self.name}_last"),
        ]

    def means(self) -> list[str]:
        return []

    def merged(self) -> list[Column]:
        return [
            F.product(f"{self.name}_growth").alias(f"{self.name}_growth"),
            F.max(f"{self.name}_last").alias(f"{self.name}_last"),
        ]

    def total(self) -> Column:
        """The compounded return, NULL when the last day has none."""
        return F.when(F.col(f"{self.name}_last").bitwiseAND(1) == 1, F.col(f"{self.name}_growth") - 1.0)


def merged_states(states: DataFrame, keys: list[str], parts: list, *more: Column) -> DataFrame:
    """One state per key from any number of partial ones; ``more`` are further aggregates.

    Two aggregates over the states, of which there are few: the merged means come first.
    """
    sums = []
    for part in parts:
        if part.means():
            n = F.col(part.counts())
            sums += [
                ratio(F.sum(n * F.col(mean)), F.sum(F.when(F.col(mean).isNotNull(), n))).alias(f"_all_{mean}")
                for mean in part.means()
            ]
    whole = states.groupBy(*keys).agg(*sums)
    same = [states[key].eqNullSafe(whole[key]) for key in keys]
    known = states.join(whole, same).select(states["*"], *[whole[name] for name in whole.columns if name not in keys])
    return known.groupBy(*keys).agg(*[column for part in parts for column in part.merged()], *more)
