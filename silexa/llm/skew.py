"""Heavy hitters of a key."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: int = 1000) -> list:
    """Keys holding more than 1/`share` of all rows: never more than `share` of them, so the list may be broadcast."""
    total = df.count()
    least = max(1000, total // share)
    return [r[0] for r in df.groupBy(key).count().filter(F.col("count") > least).select(key).collect() if r[0] is not None]
