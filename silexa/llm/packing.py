"""Filling fixed-capacity containers with items (problem 8)."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Pieces of one size that a task numbers.
PIECES = 100_000


class OpenBins:
    """Open bins by remaining capacity, as ranges of bin numbers, under a segment tree that tells which capacities have any.

    `tightest(size)` finds the smallest remaining capacity that still holds `size` in logarithmic time.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, bins: int) -> None:
        """`bins` bins from number `first` on."""
        if not bins:
            return
        self.ranges[remaining].append((first, bins))
        at = remaining + self.width
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, size: int) -> int:
        """The smallest non-empty capacity >= size, or -1."""
        at = size + self.width
        if self.count[at]:
            return size
        while at > 1 and (at & 1 or not self.count[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width

    def take(self, remaining: int) -> tuple[int, int]:
        at = remaining + self.width
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.ranges[remaining].pop()


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of `counts[size]` items of each size: rows (size, first, n, each, bin).

    The n items of the size from number `first` on go to bins from number `bin` on, `each` to a bin. Items of one size fill the
    tightest bin that holds them until it holds no more, so that all bins of like room are filled in one step: the work and the rows
    depend on the number of sizes, not on that of items, and the bins are those that items placed one by one would get.
    """
    tree, out, bins = OpenBins(capacity), [], 0
    for size in sorted((s for s in counts if s > 0), reverse=True):
        first, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, each = capacity, capacity // size
                lo, m = bins, -(-left // each)
                bins += m
            else:
                each = room // size
                lo, m = tree.take(room)
            n = min(left, m * each)
            full, part = divmod(n, each)
            out.append((size, first, n, each, lo))
            tree.add(room - each * size, lo, full)
            tree.add(room - part * size, lo + full, int(part > 0))
            tree.add(room, lo + full + (part > 0), m - full - (part > 0))
            first, left = first + n, left - n
    if counts.get(0):  # no room needed: spread over all bins
        out.append((0, 0, counts[0], -(-counts[0] // max(bins, 1)), 0))
    return np.array(out, np.int64).reshape(-1, 5)


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Assign every item to a container of `capacity`; only an item above the capacity is split.

    Best-fit decreasing with a segment tree over remaining capacities, of all items together: only the number of items of each size (at most
    `capacity` + 1 rows) goes to the driver, where the containers are filled in runs of equal items; then every item is numbered within its
    size, in parts of about PIECES, and finds its container from its number. An item of more than `capacity` gives full
    pieces, one container each, and a rest that is packed like an item. Returns (container, key, piece, start, length), containers
    numbered from 0; start is the offset of the piece in its item.

    A null or negative size counts as 0; an item of size 0 takes no room but is assigned. Rows with a null key
    are left out; rows that agree in key and size count once. An empty table gives an empty result.
    """
    rows = items.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")).distinct()
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))
    rows = rows.select("id", "n", F.explode(cut).alias("piece")).select("id", "piece", F.least(F.col("n") - F.col("piece") * F.lit(capacity).cast("long"), F.lit(capacity)).cast("int").alias("size"))
    rows = staged(rows, "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("size").count().collect()}  # at most capacity + 1 rows
    runs = best_fit_decreasing(counts, capacity)
    parts = -(-max(counts.values(), default=1) // PIECES)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("size", "part").count().select("size", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("size", "part").orderBy("id", "piece")
    rows = rows.withColumn("r", F.row_number().over(own)).join(base, ["size", "part"]).select("id", "piece", "size", (F.col("base") + F.col("r") - 1).alias("number"))
    by = np.lexsort((runs[:, 1], runs[:, 0]))
    sizes, first, _, each, lo = runs[by].T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, stop = np.searchsorted(sizes, np.arange(capacity + 1)), np.searchsorted(sizes, np.arange(capacity + 1), "right")
        for b in batches:
            s, number = b.column("size").to_numpy(), b.column("number").to_numpy()
            at = np.empty(len(s), np.int64)
            for k in np.unique(s):
                mine = np.flatnonzero(s == k)
                at[mine] = start[k] + np.searchsorted(first[start[k] : stop[k]], number[mine], "right") - 1
            bins = lo[at] + (number - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("id"), b.column("piece"), b.column("size")], ["container", "id", "piece", "size"])

    out = rows.mapInArrow(place, f"container bigint, id {dict(rows.dtypes)['id']}, piece int, size int")
    start = F.col("piece").cast("long") * capacity
    return out.select("container", F.col("id").alias(key), "piece", start.alias("start"), F.col("size").alias("length"))


def token_lengths(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens): every text's length in tokens of the byte-level BPE vocabulary file at path `vocabulary`.

    The file is read here and sent to the tasks. A null text has 0 tokens. Texts are encoded whole.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file is some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(content.value)
        for b in batches:
            texts = [t or "" for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(encode(texts), pa.int64())], ["id", "n"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n bigint")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_tokens"))


def _encoder(content: str) -> Callable[[list[str]], list[int]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
