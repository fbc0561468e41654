"""Scalar columns for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bar_chars(percent: Column) -> Column:
    """Filled cells, 0 to 20, of a bar for ``percent``."""
    return F.greatest(F.least((percent / 100 * 20).cast("int"), F.lit(20)), F.lit(0))


def bar(percent: Column) -> Column:
    """The bar itself, of 20 cells."""
    return F.concat(F.repeat(F.lit("█"), bar_chars(percent)), F.repeat(F.lit("░"), F.lit(20) - bar_chars(percent)))


def format_duration(us: Column, interval: Column | None = None) -> Column:
    """µs as text in us, ms or s, by the size of ``interval`` (its own where that is null or 0); up to two decimals."""
    us = us.cast("double")
    size = F.abs(us) if interval is None else F.when(F.coalesce(interval, F.lit(0)) == 0, F.abs(us)).otherwise(F.abs(interval))
    value = F.when(size >= 1e6, us / 1e6).when(size >= 1e3, us / 1e3).otherwise(us)
    unit = F.when(size >= 1e6, "s").when(size >= 1e3, "ms").otherwise("us")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), "[.]$", "")
    return F.when(us == 0, F.lit("0")).otherwise(F.concat(digits, F.lit(" "), unit))


def nice_interval(span: Column, width: Column, least: Column) -> Column:
    """A tick step of 1, 2 or 5 times a power of ten, 1 at least, for ``span`` over ``width`` with ticks ``least`` apart."""
    ticks = F.greatest((width / least).cast("int"), F.lit(2))
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = raw / power
    step = F.when(lead < 1.5, 1.0).when(lead < 3.5, 2.0).when(lead < 7.5, 5.0).otherwise(10.0)
    return F.when((span > 0) & (width > 0), F.greatest(step * power, F.lit(1.0))).otherwise(F.lit(1.0))


def us_to_ms(us: Column) -> Column:
    return us / 1e3


def us_to_s(us: Column) -> Column:
    return us / 1e6
