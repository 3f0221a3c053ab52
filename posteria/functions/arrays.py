"""Statistics of one bounded array per row (an object's posterior draws).

An array is as long as the number of draws, a run parameter, so these stay
inside the row and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: turns a median absolute deviation into a normal sigma.
MAD_TO_SIGMA = 1.482602218505602


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quantile(ordered: Column, q: float) -> Column:
    """Interpolated quantile of an ascending array."""
    h = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.get(ordered, F.floor(h).cast("int"))
    high = F.get(ordered, F.ceil(h).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (h - F.floor(h)))


def median(ordered: Column) -> Column:
    n = F.size(ordered)
    middle = F.shiftright(n, 1)
    return F.when(
        n > 0,
        F.when(n % 2 == 1, F.get(ordered, middle)).otherwise(
            (F.get(ordered, middle - 1) + F.get(ordered, middle)) / 2.0
        ),
    )


def mean(values: Column) -> Column:
    return F.when(
        F.size(values) > 0,
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values),
    )


def mad_std(ordered: Column, centre: Column | None = None) -> Column:
    def spread(m: Column) -> Column:
        return median(F.sort_array(F.transform(ordered, lambda x: F.abs(x - m)))) * MAD_TO_SIGMA

    return let(median(ordered) if centre is None else centre, spread)


def sigma_clip(values: Column, sigma: float = 6.0, max_rounds: int = 10) -> Column:
    """Ascending values left after dropping, round by round, what is further
    than ``sigma`` MAD sigmas from the median, to a fixpoint or ``max_rounds``."""
    start = F.struct(F.sort_array(values).alias("v"), F.lit(False).alias("done"))

    def cut(state: Column) -> Column:
        def keep(m: Column) -> Column:
            return let(
                mad_std(state["v"], m) * float(sigma),
                lambda s: F.filter(state["v"], lambda x: F.abs(x - m) <= s),
            )

        return let(
            let(median(state["v"]), keep),
            lambda v: F.struct(v.alias("v"), (F.size(v) == F.size(state["v"])).alias("done")),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(max_rounds)),
        start,
        lambda state, _: F.when(state["done"], state).otherwise(cut(state)),
        lambda state: state["v"],
    )


def centred(values: Column) -> Column:
    return let(mean(values), lambda m: F.transform(values, lambda x: x - m))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
