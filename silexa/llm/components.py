"""Connected components of a graph of links."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, staged

#: Links that one task holds (16 bytes each); a graph of more is joined in rounds over all tasks, with the same result.
LINKS = 1 << 21


def _least_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (lo == hi).all():
            break
        np.minimum.at(label, hi, lo)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["cls", "comp"])


def connected_components(links: DataFrame) -> DataFrame:
    """(cls, comp) of every end of a link (a, b): the least id of its component.

    A graph of up to LINKS links is joined by one task. In a larger one each round takes the least label among neighbours
    and then the label's own label, so that paths shorten by halves. `links` should be a written table: it is read twice.
    """
    links = links.select("a", "b")
    if links.count() <= LINKS:
        return staged(links.coalesce(1).mapInArrow(_least_labels, "cls bigint, comp bigint"), "components")
    both = staged(links.union(links.select("b", "a")), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "v"))
    while True:
        least = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = labels.join(least, labels.v == least.a).select("v", F.col("l").alias("old"), F.least("l", "n").alias("l"))
        jump = step.select(F.col("v").alias("l"), F.col("l").alias("far"))
        after = cut(step.join(jump, "l").select("v", "old", F.least("l", "far").alias("l")))
        changed = not after.filter(F.col("old") != F.col("l")).isEmpty()
        labels = after.select("v", "l")
        if not changed:
            return labels.select(F.col("v").alias("cls"), F.col("l").alias("comp"))
