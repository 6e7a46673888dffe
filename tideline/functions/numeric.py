"""Scalar functions of dates, prices and forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_year(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.when(F.month(day) <= 6, "H1").otherwise("H2"))


def next_month(day: Column) -> Column:
    return F.add_months(F.trunc(day, "MM"), 1)


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def quota_day_start(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    """The start of the day in ``zone``, summer time included."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def contract_code(day: Column) -> Column:
    """The futures month letter and the last two digits of the year. (Fixed value: the exchanges' month letters.)"""
    return F.concat(F.substring(F.lit("FGHJKMNQUVXZ"), F.month(day), F.lit(1)), F.date_format(day, "yy"))


def implied_probability(price: Column, low: Column, high: Column) -> Column:
    """Share of the way from ``low`` to ``high``, as a percentage within 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (price - low) / F.nullif(high - low, F.lit(0.0))))


def compound_cost(principal: Column, monthly_rate: Column, months: int) -> Column:
    return principal * (F.pow(1 + monthly_rate, F.lit(float(months))) - 1)


def path_return(left: Column, right: Column, t: Column) -> Column:
    """A return between two anchors, interpolated in logarithms."""
    return F.expm1(F.log1p(left) * (1 - t) + F.log1p(right) * t)


def forward_pass(x: Column, layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]]) -> Column:
    """A dense network on an array column: tanh layers and a linear last one, by higher-order functions."""
    for k, (weights, bias) in enumerate(layers):
        outs = []
        for row, b in zip(weights, bias, strict=True):
            w = F.array(*map(F.lit, row))
            dot = F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v) + F.lit(b)
            outs.append(dot if k == len(layers) - 1 else F.tanh(dot))
        x = F.array(*outs)
    return x[0]


def standardised(x: Column, mean: Sequence[float], sd: Sequence[float], limit: float = 6.0) -> Column:
    """Each element less its mean over its deviation (1 where that is next to 0), clipped."""
    m, s = F.array(*map(F.lit, mean)), F.array(*(F.lit(v if v >= 1e-9 else 1.0) for v in sd))
    z = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b)
    return F.transform(z, lambda v: F.least(F.lit(limit), F.greatest(F.lit(-limit), v)))


GRAMS_PER_OUNCE = 31.1034768


def gram_price(ounce: Column, rate: Column) -> Column:
    """The price of a gram in another currency; null unless both are positive."""
    return F.when((ounce > 0) & (rate > 0), ounce * rate / GRAMS_PER_OUNCE)


def premium(ask: Column, raw: Column) -> Column:
    """What is asked above the raw value, as a share; null where that is not positive."""
    return F.when(raw > 0, ask / raw - 1)


def spread_share(bid: Column, ask: Column) -> Column:
    return F.when(ask > 0, (ask - bid) / ask).otherwise(F.lit(0.0))


def half_even(x: Column, digits: int) -> Column:
    """Rounded to the nearest, ties to the even digit."""
    return F.bround(x, digits)


def half_up(x: Column, digits: int) -> Column:
    """Rounded to the nearest, ties away from zero."""
    return F.round(x, digits)


def drift_percent(now: Column, then: Column) -> Column:
    """Relative move in percent; null unless both prices are positive."""
    return F.when((now > 0) & (then > 0), (now / then - 1) * 100)


def unusualness(z: Column) -> Column:
    return F.when(F.abs(z) >= 1.5, "extreme").when(F.abs(z) >= 0.6, "high").when(z.isNotNull(), "normal")


def volatility_scale(v: Column, reference: Column) -> Column:
    """A volatility against its usual value, within 0.75 and 2."""
    return F.least(F.greatest(v / F.greatest(reference, F.lit(1e-9)), F.lit(0.75)), F.lit(2.0))


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.exp(F.lit(-math.log(2)) * age_days / half_life)


def version_time(t: Column) -> Column:
    """The time of a compact version stamp (20260915T070122Z); null for any other text."""
    return F.when(t.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(F.regexp_replace(t, "[TZ]", " "), F.lit("yyyyMMdd HHmmss ")))


def shifted_clock(ts: Column, hours: int = 3) -> Column:
    """Hours and minutes so many hours east of UTC."""
    return F.date_format(ts + F.expr(f"INTERVAL {hours} HOURS"), "HH:mm")


def unread(generated: Column, seen: Column) -> Column:
    """Something that was made and has not been seen since; what was never seen is unread."""
    return F.when(generated.isNull(), False).when(seen.isNull(), True).otherwise(generated > seen)


def break_even_rate(principal: Column, total: Column, months: int) -> Column:
    """The monthly rate at which a principal grows to the total."""
    return F.when((principal > 0) & (total > 0), F.pow(total / principal, F.lit(1.0 / months)) - 1)
