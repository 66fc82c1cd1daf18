"""Numeric expressions: coercion, bins, ratios, row-wise means, normal tails."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(col: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into zero."""
    return F.round(col, digits) + F.lit(0.0)


def nan_to_null(col: Column) -> Column:
    """NaN is a missing value here; aggregates skip only NULL."""
    return F.when(~F.isnan(col), col)


def to_number(col: Column, kind: str = "double") -> Column:
    """Text to number; anything unreadable (and NaN) becomes NULL."""
    value = F.trim(col).try_cast(kind)
    return nan_to_null(value) if kind in ("double", "float") else value


def safe_div(num: Column, den: Column) -> Column:
    """Division that gives NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_with_ties(won: Column, lost: Column, tied: Column, recorded: Column | None = None,
                    when_empty: float | None = None) -> Column:
    """(won + half the ties) / games; else the recorded ratio; else ``when_empty``."""
    games = won + lost + tied
    options = [safe_div(won + F.lit(0.5) * tied, games)]
    if recorded is not None:
        options.append(recorded)
    if when_empty is not None:
        options.append(F.lit(float(when_empty)))
    return F.coalesce(*options)


def rank_to_percentile(rank: Column, size: Column) -> Column:
    """Rank 1 of ``size`` becomes 1.0, the last rank 0.0; undefined for a single entry."""
    return F.when(size > 1, F.lit(1.0) - (rank.cast("double") - 1.0) / (size.cast("double") - 1.0))


def bin_right_closed(value: Column, edges: list[float], missing: int = -1) -> Column:
    """Ordinal class of ``value`` with bins (-inf, e0], (e0, e1], ... (e_last, inf)."""
    chain = F.when(value.isNull(), F.lit(missing))
    for label, edge in enumerate(edges):
        chain = chain.when(value <= F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(len(edges)))


def duration_class(duration: Column, low: int = 2, high: int = 4) -> Column:
    """Ordinal duration class; non-positive or missing durations are open (-1)."""
    return F.when(duration <= 0, F.lit(-1)).otherwise(bin_right_closed(duration, [low, high]))


def row_mean(cols: list[Column]) -> Column:
    """Mean over the non-null values of a row."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    return safe_div(total, row_count(cols))


def row_count(cols: list[Column]) -> Column:
    """How many of the columns hold a value in this row."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def row_sum(cols: list[Column], all_missing: float | None = 0.0) -> Column:
    """Row sum with missing as zero; ``all_missing`` is the result when nothing is present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    empty = F.lit(None).cast("double") if all_missing is None else F.lit(float(all_missing))
    return F.when(row_count(cols) > 0, total).otherwise(empty)


def decade_label(year: Column, last: int | None = None) -> Column:
    """"1990s"; years from ``last`` on share one open-ended label such as "2010s+"."""
    floor = (F.floor(year / 10) * 10).cast("int")
    label = F.concat(floor.cast("string"), F.lit("s"))
    if last is None:
        return label
    return F.when(floor >= last, F.lit(f"{last}s+")).otherwise(label)


# Name tokens of measures for which a high value is bad.
BAD_WHEN_HIGH = ("TO", "Int", "Pen")


def measure_sign(name: str, bad_tokens: tuple[str, ...] = BAD_WHEN_HIGH) -> float:
    """-1.0 where a high value of the measure is bad, else 1.0."""
    return -1.0 if any(token in name for token in bad_tokens) else 1.0


def normal_two_sided(z: Column, terms: int = 80) -> Column:
    """Two-sided normal tail 2(1 - Phi(|z|)), exact to rounding.

    Near zero by the series of positive terms x^(2k+1) / (2k+1)!!, far out by the continued
    fraction x + 1/(x + 2/(x + ...)) of density over tail, from its inner end outwards.
    """
    x = F.abs(z).cast("double")
    density = F.exp(-x * x / 2.0) / F.lit((2.0 * math.pi) ** 0.5)

    def add(state, k):
        term = state["term"] * x * x / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("term"), x.alias("total")), add,
                         lambda state: state["total"])
    fraction = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), x, lambda inner, k: x + k / inner)
    return F.when(x < 3.0, 1.0 - 2.0 * density * series).when(x.isNotNull(), 2.0 * density / fraction)
