"""Percentiles by deterministic buffer collapsing (problem 4)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a full buffer, and first-stage merges per group. The rank error of n values is at most
#: n * (levels - 1) / (2 * SIZE), with levels = log2(n / SIZE): 0.5 % at a thousand million values.
SIZE, FAN = 2048, 32


class Buffers:
    """Sorted buffers of one group: level -> values that each stand for 2**level input values.

    Values below SIZE wait unsorted at level 0. Two full buffers of a level collapse into one of the next: their
    merged values are thinned to every second position, the offset alternating with each collapse of that level
    (so that errors cancel) - a binary tree, which bounds the total rank error.
    """

    __slots__ = ("full", "loose", "odd")

    def __init__(self) -> None:
        self.full: dict[int, list[np.ndarray]] = {}
        self.loose: list[np.ndarray] = []
        self.odd: dict[int, int] = {}

    def add(self, values: np.ndarray) -> None:
        self.loose.append(values)
        if sum(map(len, self.loose)) >= SIZE:
            x = np.concatenate(self.loose)
            whole = len(x) // SIZE * SIZE
            self.loose = [x[whole:]]
            for k in range(0, whole, SIZE):
                self.put(0, np.sort(x[k : k + SIZE]))

    def put(self, level: int, values: np.ndarray) -> None:
        if level == 0 and len(values) < SIZE:
            self.add(values)
            return
        at = self.full.setdefault(level, [])
        at.append(values)
        if len(at) == 2:
            merged = np.sort(np.concatenate(at), kind="stable")
            at.clear()
            offset = self.odd.get(level, 0)
            self.odd[level] = 1 - offset
            self.put(level + 1, merged[offset::2])

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        rest = np.concatenate(self.loose) if self.loose else np.zeros(0)
        if len(rest):
            yield 0, np.sort(rest)
        for level, buffers in sorted(self.full.items()):
            for b in buffers:
                yield level, b


_OUT = ["g", "s", "level", "vals"]
_SCHEMA = "g string, s int, level int, vals array<double>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    g, s, level, vals = zip(*rows) if rows else ((), (), (), ())
    flat = np.concatenate(vals) if vals else np.zeros(0)
    offsets = pa.array(np.r_[0, np.cumsum([len(v) for v in vals])].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(s, pa.int32()), pa.array(level, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], _OUT)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of one partition: raw (g, v) rows -> buffers per group. Memory: at most the partition's values."""
    held: dict[str, Buffers] = {}
    salt = TaskContext.get().partitionId() % FAN
    for b in batches:
        if b.num_rows == 0:
            continue
        g = b.column("g").dictionary_encode()
        code, v = g.indices.to_numpy(), b.column("v").to_numpy()
        by = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(code[by]) != 0])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(by)]):
            held.setdefault(g.dictionary[int(code[by[lo]])].as_py(), Buffers()).add(v[by[lo:hi]])
    rows: list[tuple] = []
    for name, buffers in held.items():
        rows += [(name, salt, level, vals) for level, vals in buffers.rows()]
        if len(rows) > 2000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _merge(final: bool):
    """Merges the buffers of equal groups, which come sorted; only one group is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buffers, rows = None, Buffers(), []

        def close() -> list[tuple]:
            return [(key[0], 0 if final else key[1], level, vals) for level, vals in buffers.rows()] if key else []

        for b in batches:
            g, s, level, vals = (b.column(c) for c in _OUT)
            offsets, flat = vals.offsets.to_numpy(), vals.values.to_numpy()
            for k in range(b.num_rows):
                now = (g[k].as_py(), 0 if final else s[k].as_py())
                if now != key:
                    rows += close()
                    key, buffers = now, Buffers()
                    if len(rows) > 2000:
                        yield _batch(rows)
                        rows = []
                buffers.put(level[k].as_py(), flat[offsets[k] : offsets[k + 1]])
        yield _batch(rows + close())

    return run


def _key(keys: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable sketch of `value` per group: rows (keys..., level, vals), one per buffer.

    Every task sketches its own rows, so only buffers are shuffled, never raw values of a hot group; they are merged
    in two stages (salted, then whole). Null and NaN values don't count; a null key is a group of its own; an empty
    table gives an empty sketch; other columns are ignored.
    """
    long = df.select(_key(keys).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    built = long.mapInArrow(_build, _SCHEMA)
    half = built.repartition("g", "s").sortWithinPartitions("g", "s", "level", "vals").mapInArrow(_merge(False), _SCHEMA)
    return _named(_merged(half), df, keys)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Combine sketches, for instance those of separate days, into one per group of `keys`."""
    s = sketches.select(_key(keys).alias("g"), F.lit(0).alias("s"), "level", "vals")
    return _named(_merged(s), sketches, keys)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g", "level", "vals").mapInArrow(_merge(True), _SCHEMA)


def _named(rows: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    kind = "struct<" + ",".join(f"k{i}:{source.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)) + ">"
    rows = rows.withColumn("j", F.from_json("g", kind))
    return rows.select(*[F.col(f"j.k{i}").alias(k) for i, k in enumerate(keys)], "level", "vals")


def percentiles(sketches: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys..., n, q array<double>): the value count and the nearest-rank percentiles of every group; `probs` ascend.

    The value of rank ceil(p * n) among the buffers' weighted values. Up to SIZE values of a group it is exact.
    """
    w = F.expr("shiftleft(1L, level)")
    points = F.expr("transform(vals, x -> struct(x AS v, shiftleft(1L, level) AS w))")
    g = sketches.select(*keys, points.alias("p"), (w * F.size("vals")).alias("n"))
    # a group's sketch has about SIZE * log2(n / SIZE) points
    g = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    wanted = F.array(*[F.greatest(F.ceil(F.col("n") * F.lit(p)).cast("long"), F.lit(1)).cast("long") for p in probs])
    step = """aggregate(p, struct(0L AS cum, cast(array() AS array<double>) AS q),
      (acc, x) -> struct(acc.cum + x.w AS cum,
        if(size(acc.q) < size(r) AND acc.cum + x.w >= get(r, size(acc.q)),
           concat(acc.q, transform(filter(slice(r, size(acc.q) + 1, size(r)), y -> y <= acc.cum + x.w), y -> x.v)), acc.q) AS q)).q"""
    return g.withColumn("r", wanted).select(*keys, "n", F.expr(step).alias("q"))
