"""Items that appear together (problem 6)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Baskets are cut into blocks of so many items; neighbours in one row of a stripe; pairs counted before stripes leave.
_BLOCK, _ROW, _FLUSH = 512, 512, 2_000_000


def _stripes(codes: np.ndarray, counts: np.ndarray, heavy: np.ndarray) -> pa.RecordBatch:
    """Stripes of sorted pair codes: (a, part, neighbours, counts), a long stripe in several rows."""
    a, b = codes >> 32, codes & 0xFFFFFFFF
    part = np.where(np.isin(a, heavy), b % 16, 0)
    if len(heavy):
        by = np.lexsort((b, part, a))
        a, b, part, counts = a[by], b[by], part[by], counts[by]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])]) if len(a) else np.zeros(0, int)
    sizes = np.diff(np.r_[new, len(a)])
    starts = np.concatenate([np.arange(s, s + n, _ROW) for s, n in zip(new, sizes)]) if len(new) else new
    offsets = pa.array(np.r_[starts, len(a)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(a[starts]), pa.array(part[starts].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(counts))],
        ["a", "part", "b", "c"],
    )


def _emit(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for left, right in zip(batch.column("l"), batch.column("r")):
                x = np.sort(np.asarray(left.values, np.int64))
                if right.is_valid:  # two different blocks of one basket
                    y = np.asarray(right.values, np.int64)
                    i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                    code = (np.minimum(i, j) << 32) | np.maximum(i, j)
                else:
                    i, j = np.triu_indices(len(x), 1)
                    code = (x[i] << 32) | x[j]
                held.append(code)
                size += len(code)
                if size >= _FLUSH:
                    yield _stripes(*np.unique(np.concatenate(held), return_counts=True), heavy)
                    held, size = [], 0
        if size:
            yield _stripes(*np.unique(np.concatenate(held), return_counts=True), heavy)

    return run


def _merge(least: int):
    """Sums the stripes of every (a, part), which come sorted; only the last key of a batch is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(code: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            keep = count >= least
            code, count = code[keep], count[keep]
            return pa.RecordBatch.from_arrays([pa.array(code >> 32), pa.array(code & 0xFFFFFFFF), pa.array(count)], ["a", "b", "c"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            b, c = batch.column("b"), batch.column("c")
            a = np.repeat(batch.column("a").to_numpy(), b.value_lengths().to_numpy())
            codes = np.concatenate([codes, (a << 32) | b.flatten().to_numpy()])
            counts = np.concatenate([counts, c.flatten().to_numpy()])
            codes, at = np.unique(codes, return_inverse=True)
            counts = np.bincount(at, weights=counts).astype(np.int64)
            ready = np.searchsorted(codes, a[-1] << 32)
            yield out(codes[:ready], counts[:ready])
            codes, counts = codes[ready:], counts[ready:]
        yield out(codes, counts)

    return run


def log_likelihood_ratio(c: Column, na: Column, nb: Column, n: Column) -> Column:
    """Dunning's G2 of the 2x2 table of two items' baskets."""
    def h(*ks: Column) -> Column:
        total = sum(ks[1:], ks[0])
        return sum((F.when(k > 0, k * F.log(k / total)).otherwise(0.0) for k in ks[1:]), F.when(ks[0] > 0, ks[0] * F.log(ks[0] / total)).otherwise(0.0))

    k11, k12, k21, k22 = (x.cast("double") for x in (c, na - c, nb - c, n - na - nb + c))
    return 2 * (h(k11, k12, k21, k22) - h(k11 + k12, k21 + k22) - h(k11 + k21, k12 + k22))


def items_together(df: DataFrame, basket: str, item: str, min_count: int = 8, min_lift: float = 1.0, min_llr: float = 10.83) -> DataFrame:
    """Pairs of items that occur together in at least `min_count` baskets and more often than chance.

    Stripes: from every basket each item gets an associative array of its neighbours; arrays are combined inside each
    task, merged by item, and scored by Dunning's log-likelihood ratio. Returns (item_a, item_b, together, n_a, n_b,
    n_baskets, lift, llr), item_a < item_b; `lift` is together * n_baskets / (n_a * n_b).

    Exact shortcuts keep the work bounded: an item of fewer than `min_count` baskets, or (as together <= n_a) of more
    than n_baskets / `min_lift`, can't be in a pair; and any pair has a basket outside the `min_count` - 1 largest,
    so those of them that alone hold over a hundredth of all pairs emit none: each item keeps a bit for each of them and
    the common bits are added to the pair's count. Larger baskets are cut into blocks handled by different tasks; items of more than a thousandth of all rows
    have their stripe split in parts.

    Items are integers from 0 to 2**31 - 1. Rows with a null basket or item are left out, repeated rows count once,
    an empty table gives an empty result, other columns are ignored.
    """
    rows = df.select(F.col(basket).alias("u"), F.col(item).cast("long").alias("i")).filter(F.col("u").isNotNull() & F.col("i").isNotNull())
    rows = staged(rows.distinct(), "together")
    n_baskets, n_rows = rows.agg(F.count_distinct("u"), F.count("*")).first()
    if not n_rows:
        n_baskets = 0
    spare = min_count - 1
    counts = rows.groupBy("i").agg(F.count("*").alias("na")).filter((F.col("na") >= min_count) & (F.col("na") <= n_baskets / min_lift))
    fit = staged(rows.join(counts, "i"), "together-fit")
    # never more than `spare` baskets and a thousand items
    sizes = fit.groupBy("u").agg(F.count("*").alias("s"))
    squares = sizes.agg(F.sum(F.col("s").cast("double") ** 2)).first()[0] or 0.0
    # a basket is worth leaving out if it alone gives more than a hundredth of all pairs
    largest = [r[0] for r in sizes.filter(F.col("s").cast("double") ** 2 > squares / 100).orderBy(F.desc("s"), "u").limit(min(spare, 62)).select("u").collect()]
    heavy = np.array([r[0] for r in counts.filter(F.col("na") > max(1000, n_rows // 1000)).select("i").collect()], np.int64)
    bit = F.lit(0).cast("long")
    for k, u in enumerate(largest):
        bit = F.when(F.col("u") == F.lit(u), F.lit(1 << k).cast("long")).otherwise(bit)
    stats = fit.groupBy("i").agg(F.first("na").alias("na"), F.bit_or(bit).alias("bits"))

    rest = fit.filter(~F.col("u").isin(largest)) if largest else fit
    sizes = rest.groupBy("u").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("nb")).filter(F.col("nb") > 1)
    big = rest.join(sizes, "u").withColumn("k", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int"))
    # an item of block k takes part in the block pairs (x, k) and (k, x)
    big = big.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    big = big.groupBy("u", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y")).agg(
        F.collect_list(F.when(F.col("k") <= F.col("o"), F.col("i"))).alias("l"), F.collect_list(F.when(F.col("k") > F.col("o"), F.col("i"))).alias("r")
    ).select("l", F.when(F.col("x") < F.col("y"), F.col("r")).alias("r"))
    small = rest.join(sizes.select("u"), "u", "left_anti").groupBy("u").agg(F.collect_list("i").alias("l")).filter(F.size("l") > 1)
    baskets = small.select("l", F.lit(None).cast("array<bigint>").alias("r")).unionByName(big)

    stripes = baskets.mapInArrow(_emit(heavy), "a bigint, part int, b array<bigint>, c array<bigint>")
    merged = stripes.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(_merge(max(1, min_count - len(largest))), "a bigint, b bigint, c bigint")
    sa = stats.select(F.col("i").alias("a"), F.col("na").alias("n_a"), F.col("bits").alias("ba"))
    sb = stats.select(F.col("i").alias("b"), F.col("na").alias("n_b"), F.col("bits").alias("bb"))
    together = F.col("c") + F.bit_count(F.col("ba").bitwiseAND(F.col("bb")))
    n = F.lit(n_baskets).cast("long")
    out = merged.join(sa, "a").join(sb, "b").withColumn("together", together).filter(F.col("together") >= min_count)
    out = out.withColumn("lift", F.col("together") * n / (F.col("n_a") * F.col("n_b"))).filter(F.col("lift") >= min_lift)
    out = out.withColumn("llr", log_likelihood_ratio(F.col("together"), F.col("n_a"), F.col("n_b"), n)).filter(F.col("llr") >= min_llr)
    return out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "together", "n_a", "n_b", n.alias("n_baskets"), "lift", "llr")
