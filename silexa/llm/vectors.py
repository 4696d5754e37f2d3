"""Sparse vectors: one canonical form per key, and classes of equal vectors."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unit vectors that agree to so many decimals are one class of copies.
DECIMALS = 6
#: Decimals of a cosine.
DIGITS = 9


def _unit(i: pa.ListArray, v: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of index and value lists: the rows that have a vector, its row starts, indices and unit values."""
    li, lv = (x.value_lengths().fill_null(0).to_numpy().astype(np.int64) for x in (i, v))
    n = np.minimum(li, lv)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    x, y = (z.flatten().to_numpy(zero_copy_only=False).astype(float)[np.repeat(np.cumsum(k) - k, n) + place] for z, k in ((i, li), (v, lv)))
    ok = np.isfinite(y) & (y != 0) & np.isfinite(x) & (x >= 0)
    row, x, y = row[ok], x[ok].astype(np.int64), y[ok]
    by = np.lexsort((x, row))
    row, x, y = row[by], x[by], y[by]
    first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(x) != 0)][: len(row)])
    if len(first):
        row, x, y = row[first], x[first], np.add.reduceat(y, first)
    row, x, y = row[y != 0], x[y != 0], y[y != 0]
    rows, starts = np.unique(row, return_index=True)
    offsets = np.r_[starts, len(row)]
    if len(rows):
        y = y / np.repeat(np.maximum.reduceat(np.abs(y), starts), np.diff(offsets))
        y = y / np.sqrt(np.repeat(np.add.reduceat(y * y, starts), np.diff(offsets)))
    return rows, offsets, x, y


def canonical(df: DataFrame, key: str, idx: str, val: str, space: str | None = None) -> DataFrame:
    """(space, key, cls, idx, val): one unit vector per space and key, indices ascending, without zeros.

    Vectors of several spaces never meet; without a `space` column there is one space. Entries of a null, NaN, infinite
    or zero value or a negative index are dropped, values of a repeated index are added, the longer of two arrays of
    different lengths is cut. Keys with null, empty or zero vectors only, and rows of a null key or space, have no row.
    Of several forms of a key's vector that differ after this, the longest counts (ties by hash). `cls` is the hash of
    space and content: equal for copies and for vectors of the same direction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offsets, x, y = _unit(b.column("i"), b.column("v"))
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(z)) for z in (x, y)]
            yield pa.RecordBatch.from_arrays([b.column("space").take(pa.array(rows)), b.column("key").take(pa.array(rows)), *lists], ["space", "key", "idx", "val"])

    kind = dict(df.dtypes)
    of = F.col(space) if space else F.lit("")
    rows = df.filter(F.col(key).isNotNull() & of.isNotNull() & F.col(idx).isNotNull() & F.col(val).isNotNull()).select(of.alias("space"), F.col(key).alias("key"), F.col(idx).alias("i"), F.col(val).alias("v"))
    rows = rows.mapInArrow(run, f"space {kind[space] if space else 'string'}, key {kind[key]}, idx array<bigint>, val array<double>")
    cls = F.xxhash64("space", "idx", F.transform("val", lambda x: F.round(x * 10**DECIMALS).cast("long")))
    rows = rows.withColumn("cls", cls)
    best = rows.groupBy("space", "key").agg(F.max_by(F.struct("cls", "idx", "val"), F.struct(F.size("idx"), "cls")).alias("x"))
    return best.select("space", "key", "x.cls", "x.idx", "x.val")


def classes(vectors: DataFrame) -> DataFrame:
    """(space, cls, idx, val): one row per class of equal vectors."""
    return vectors.groupBy("cls").agg(F.first(F.struct("space", "idx", "val")).alias("x")).select("x.space", "cls", "x.idx", "x.val")


def csr(idx: pa.ListArray, val: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, indices and values of a batch of vectors."""
    offsets = np.r_[0, np.cumsum(idx.value_lengths().to_numpy())]
    return offsets, idx.flatten().to_numpy(), val.flatten().to_numpy()


def dots(a: tuple, b: tuple, each: Callable = np.multiply) -> np.ndarray:
    """Row-wise dot products of two equally long batches of sparse vectors; or sums of what `each` gives for their common entries."""
    (ao, ai, av), (bo, bi, bv) = a, b
    n = len(ao) - 1
    ra, rb = np.repeat(np.arange(n), np.diff(ao)), np.repeat(np.arange(n), np.diff(bo))
    width = int(max(ai.max(initial=0), bi.max(initial=0))) + 1
    ka, kb = ra * width + ai, rb * width + bi  # ascending, as rows and their indices are
    if not len(ka) or not len(kb):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    return np.bincount(ra[same], weights=each(av[same], bv[at[same]]), minlength=n)


def with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b) of class ids; cosines are rounded to DIGITS decimals, so that equal ones are ties."""
    va = vectors.select(F.col("cls").alias("a"), F.col("idx").alias("ai"), F.col("val").alias("av"))
    vb = vectors.select(F.col("cls").alias("b"), F.col("idx").alias("bi"), F.col("val").alias("bv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cos = dots(csr(x.column("ai"), x.column("av")), csr(x.column("bi"), x.column("bv"))) if x.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(np.round(cos, DIGITS))], ["a", "b", "cosine"])

    return pairs.join(va, "a").join(vb, "b").select("a", "b", "ai", "av", "bi", "bv").mapInArrow(run, "a bigint, b bigint, cosine double")


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows, which come sorted by `names`."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(n).to_numpy() for n in names])
        cuts = np.r_[0, np.flatnonzero((np.diff(keys) != 0).any(0)) + 1, b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            now = tuple(keys[:, lo])
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.concat_batches(held)


def whole_chunks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches again, which come sorted by `names`, such that none ends inside a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(n).to_numpy() for n in names])
        change = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
        if held and any(held[-1].column(n)[-1].as_py() != b.column(n)[0].as_py() for n in names):
            yield pa.concat_batches(held)
            held = []
        if held and len(change):
            yield pa.concat_batches([*held, b.slice(0, change[0])])
            held = []
            b = b.slice(change[0])
            change = change[1:] - change[0]
        if not held and len(change):
            yield b.slice(0, change[-1])
            b = b.slice(change[-1])
        held.append(b)
    if held:
        yield pa.concat_batches(held)
