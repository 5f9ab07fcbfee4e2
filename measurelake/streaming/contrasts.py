"""Running means per cohort, tissue and probe over a stream of measurements.

The batch analyses need no stream; this one keeps their descriptive input
current: windowed, watermarked and mergeable, since mean and count are sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_means(stream: DataFrame, keys: list[str], time: str, value: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Window start, keys, n and mean; rows later than ``late`` are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys)
    sums = grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return sums.select(F.col("w.start").alias("start"), *keys, "n", "mean")
