"""The counting and summary operators over unbounded tables: windowed, with a watermark for late rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, item: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, item, count) per window; rows later than `late` behind the newest are dropped and old state is freed."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w.alias("w"), F.col(item).alias("item"))
    return g.agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "item", "count")


def windowed_summary(stream: DataFrame, time: str, column: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, count, mean, std, min, max) of a column per window."""
    x = F.col(column).cast("double")
    g = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    a = g.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return a.select(F.col("w.start").alias("start"), "count", "mean", "std", "min", "max")
