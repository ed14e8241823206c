"""How long the listed bytes take at assumed transfer rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulplan.functions.rates import parse_rate
from haulplan.functions.text import human_rate, human_seconds


def _positive(rate: float, text: str) -> float:
    if rate <= 0:
        raise ValueError(f"rate must be above zero: {text!r}")
    return rate


def _at_rate(totals: DataFrame, rate: str, prefer_units: str) -> DataFrame:
    timed = totals.withColumns({"rate": F.col(rate), "seconds": F.expr(f"bytes_total / {rate}")})
    return timed.withColumns({"rate_text": human_rate("rate", prefer_units), "time_text": human_seconds("seconds")})


def time_table(totals: DataFrame, min_rate: str, max_rate: str, prefer_units: str = "Gbps") -> DataFrame:
    """Seven geometric rate steps per row of totals (``bytes_total``); none for a zero rate."""
    ends = {"min_rate": F.lit(parse_rate(min_rate)), "max_rate": F.lit(parse_rate(max_rate))}
    return time_steps_for(totals.withColumns(ends), prefer_units).drop(*ends)


def time_range(totals: DataFrame, min_rate: str, max_rate: str, prefer_units: str = "Gbps") -> DataFrame:
    """Time at the slow and the fast end, in whatever order the rates are given."""
    given = [_positive(parse_rate(text), text) for text in (min_rate, max_rate)]
    ends = F.array(
        F.struct(F.lit("slow").alias("end"), F.lit(min(given)).alias("rate")),
        F.struct(F.lit("fast").alias("end"), F.lit(max(given)).alias("rate")),
    )
    both = totals.withColumn("given", F.explode(ends))
    return _at_rate(both.withColumn("end", F.col("given.end")), "given.rate", prefer_units).drop("given")


def time_steps_for(ranges: DataFrame, prefer_units: str = "Gbps", rows: int = 7) -> DataFrame:
    """As :func:`time_table`, with the rates in columns ``min_rate, max_rate`` (bytes per second)."""
    low, high = F.least("min_rate", "max_rate"), F.greatest("min_rate", "max_rate")
    near = high - low <= 1e-9 * high
    steps = (
        F.when(low <= 0, F.array().cast("array<double>"))
        .when(near, F.array(low))
        .otherwise(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: low * F.pow(high / low, i / float(rows - 1))))
    )
    stepped = ranges.select("*", F.posexplode(steps).alias("step", "assumed"))
    return _at_rate(stepped, "assumed", prefer_units).drop("assumed")
