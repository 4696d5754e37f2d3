"""Similarity clusters (problem 7): MinHash candidates, exact verification, components, medoids."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, staged
from .components import connected_components
from .vectors import DIGITS, csr, dots, whole_chunks, whole_groups

#: Hash rows of a band, bands of the first pass, block of exact comparison, bucket size up to which all its similar pairs
#: are links, and seed; columns that are dense, and pairs that are compared, at a time.
ROWS, FIRST, BLOCK, FEW, SEED = 2, 8, 1024, 16, 7_340_033
COLUMNS, PAIRS = 4096, 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((_mix(x) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


@dataclass(frozen=True)
class Measure:
    """How two records (space, vector) are compared exactly: `cosine` similarity, or `euclid` distance, with two bounds.

    Records are similar within `strict`, and belong to one component within `loose`. `jaccard` is the similarity of token sets from which
    on candidates are retrieved.

    - `cosine`: a record's tokens are its indices (with sign), weighted by their squared values, which sum to 1. Two vectors of cosine c that
      have the same values on what they share have a weighted Jaccard similarity of c / (2 - c); none has less than `floor`.
    - `euclid`: vectors list all their few dimensions; the tokens are the cells, `cell` wide, of the square of `reach` cells on each side of the record, in its space.
    """

    kind: str
    strict: float
    loose: float
    jaccard: float
    cell: float = 0.0
    reach: int = 0

    def within(self, x: np.ndarray, bound: float) -> np.ndarray:
        return x >= bound - 1e-9 if self.kind == "cosine" else x <= bound + 1e-9

    @property
    def floor(self) -> float:
        """The least Jaccard similarity that loosely similar records can have: 1 - sum of min(a^2, b^2) is half the sum of |a^2 - b^2|,
        so at most sqrt(1 - c^2) by Cauchy and Schwarz."""
        if self.kind == "euclid":
            return self.jaccard
        r = math.sqrt(max(0.0, 1 - self.loose**2))
        return (1 - r) / (1 + r)

    def similarity(self, a: tuple, b: tuple) -> np.ndarray:
        """Row-wise cosines or distances of two batches of vectors."""
        if self.kind == "cosine":
            return dots(a, b)
        n = len(a[0]) - 1
        return np.sqrt(((a[2].reshape(n, -1) - b[2].reshape(n, -1)) ** 2).sum(1)) if n else np.zeros(0)

    def token_jaccard(self, a: tuple, b: tuple, same_space: np.ndarray) -> np.ndarray:
        """Row-wise exact Jaccard similarity of the token sets of two batches."""
        if self.kind == "euclid":
            side, n = 2 * self.reach, len(a[0]) - 1
            shift = [np.abs(np.rint(x / self.cell) - np.rint(y / self.cell)).reshape(n, -1) for x, y in [(a[2], b[2])]][0]
            common, whole = np.maximum(side - shift, 0).prod(1), float(side) ** shift.shape[1]
        else:
            signed = [(o, 2 * i + (v < 0), v**2) for o, i, v in (a, b)]
            common = dots(*signed, each=np.minimum)
            whole = 1.0
        return np.where(same_space, common / (2 * whole - common), 0.0)

    def minima(self, space: np.ndarray, vectors: tuple, seeds: np.ndarray) -> np.ndarray:
        """(seeds x records): the MinHash of every record's tokens; for weighted tokens by consistent weighted sampling."""
        offsets, idx, val = vectors
        n, starts = len(offsets) - 1, offsets[:-1]
        with np.errstate(over="ignore"):
            if self.kind == "euclid":
                span = np.arange(-self.reach, self.reach, dtype=np.int64)
                cells = np.rint(val / self.cell).astype(np.int64).reshape(n, -1)
                base = _mix(space.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[:, None]
                for d in range(cells.shape[1]):
                    base = _mix(base[:, :, None] * np.uint64(31) + (cells[:, d, None] + span).astype(np.uint64)[:, None, :]).reshape(n, -1)
                return np.stack([_mix(base ^ s).min(1) for s in seeds])
            names, at = np.unique(2 * idx + (val < 0), return_inverse=True)
            token = _mix(names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            log_w, row, out = np.log(val**2), np.repeat(np.arange(n), np.diff(offsets)), []
            for s in seeds:
                u = [_uniform(token ^ (s * np.uint64(2 * j + 3))) for j in range(5)]
                r, c, beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
                t = np.floor(log_w / r[at] + beta[at])
                a = c[at] - r[at] * (t - beta[at] + 1)
                least = a == np.minimum.reduceat(a, starts)[row]
                h = _mix(token[at] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s)
                out.append(np.minimum.reduceat(np.where(least, h, np.uint64(2**64 - 1)), starts))
            return np.stack(out)


def bands_for(jaccard: float, miss: float = 0.002) -> int:
    """Bands after which a pair at the least Jaccard similarity is missed with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - jaccard**ROWS))


def _several(df: DataFrame, m: Measure | tuple[Measure, ...]) -> tuple[DataFrame, tuple[Measure, ...]]:
    """Records with the number `m` of their measure, and the measures; records of different measures never meet."""
    return (df, m) if isinstance(m, tuple) else (df.withColumn("m", F.lit(0)), (m,))


def _by_measure(g: pa.RecordBatch, ms: tuple[Measure, ...]) -> Iterator[tuple[int, Measure, np.ndarray]]:
    kind = g.column("m").to_numpy()
    for k in np.unique(kind):
        yield int(k), ms[k], np.flatnonzero(kind == k)


def band_rows(sets: DataFrame, ms: tuple[Measure, ...], first: int, last: int | None = None) -> DataFrame:
    """(cls, label, bucket) of every class for its measure's bands from `first` to before `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.default_rng(SEED).integers(1, 2**63, ROWS * max(bands_for(m.jaccard) for m in ms), np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for no, m, rows in _by_measure(whole, ms) if whole.num_rows else ():
                b = whole.take(pa.array(rows))
                upto = min(last or 1 << 20, bands_for(m.jaccard))
                if upto <= first:
                    continue
                least = m.minima(b.column("space").to_numpy(), csr(b.column("idx"), b.column("val")), seeds[first * ROWS : upto * ROWS])
                with np.errstate(over="ignore"):
                    key = np.zeros((upto - first, b.num_rows), np.uint64) + np.arange(first, upto, dtype=np.uint64)[:, None] + np.uint64(no << 32)
                    for r in range(ROWS):
                        key = _mix(key) + least[r::ROWS]
                tile = pa.array(np.tile(np.arange(b.num_rows), upto - first))
                yield pa.RecordBatch.from_arrays([b.column("cls").take(tile), b.column("label").take(tile), pa.array(key.ravel().view(np.int64))], ["cls", "label", "bucket"])

    return sets.select("cls", "label", "m", "space", "idx", "val").mapInArrow(run, "cls bigint, label bigint, bucket bigint")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a graph, from its matrix."""
    fresh = np.ones(len(near), bool)
    edges: list[tuple] = []
    for s in range(len(near)):
        if not fresh[s]:
            continue
        fresh[s] = False
        front = np.array([s])
        while len(front):
            reached = near[front] & fresh
            new = np.flatnonzero(reached.any(0))
            edges.append((front[reached[:, new].argmax(0)], new))
            fresh[new] = False
            front = new
    return tuple(np.concatenate(e) for e in zip(*edges))


def verified_links(rows: DataFrame, sets: DataFrame, ms: tuple[Measure, ...]) -> DataFrame:
    """(a, b), labels: links that join all loosely similar records of different labels that share a bucket.

    Every pair of a bucket is compared exactly, in blocks if it is large; but while a small bucket gives all its similar pairs, a
    larger one gives a spanning forest of them, so that links stay linear in its size and join the same records. The exact
    Jaccard similarity of a link's token sets must reach the measure's floor. Buckets of one label need nothing.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rows = rows.join(sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb")), "bucket")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("bucket", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "cls", "label").join(sets.select("cls", "m", "space", "idx", "val"), "cls")

    def similar(g: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        label, space, kind = (g.column(c).to_numpy() for c in ("label", "space", "m"))
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
        out = []
        for no in np.unique(kind[i]):
            m, mine = ms[no], np.flatnonzero(kind[i] == no)
            for lo in range(0, len(mine), PAIRS):
                p, q = i[mine[lo : lo + PAIRS]], j[mine[lo : lo + PAIRS]]
                a, b = (csr(g.column("idx").take(pa.array(e)), g.column("val").take(pa.array(e))) for e in (p, q))
                ok = m.within(m.similarity(a, b), m.loose) & (m.token_jaccard(a, b, space[p] == space[q]) >= m.floor - 1e-9)
                out.append(np.sort(np.stack([label[p[ok]], label[q[ok]]], 1), 1))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_chunks(batches, ["bucket", "x", "y"]):
            keys = np.stack([g.column(c).to_numpy() for c in ("bucket", "x", "y")])
            starts = np.r_[0, np.flatnonzero((np.diff(keys) != 0).any(0)) + 1]
            n = np.diff(np.r_[starts, g.num_rows])
            few = (n <= FEW) & (keys[1, starts] == keys[2, starts])
            left = np.repeat(np.where(few, starts + n, 0), n) - np.arange(g.num_rows) - 1  # partners after each row
            left = np.maximum(left, 0)
            i = np.repeat(np.arange(g.num_rows), left)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
            yield similar(g, i, j)
            for s, size in zip(starts[~few], n[~few]):
                one = g.slice(s, size)
                m = ms[one.column("m")[0].as_py()]
                label, k = one.column("label").to_numpy(), one.column("k").to_numpy()
                how = _all_pairs(one, np.arange(size), np.arange(size), m) if keys[1, s] == keys[2, s] else None
                if how is None:  # only pairs between the two blocks
                    x, y = np.flatnonzero(k == keys[1, s]), np.flatnonzero(k == keys[2, s])
                    near = np.zeros((size, size), bool)
                    near[np.ix_(x, y)] = m.within(_all_pairs(one, x, y, m), m.loose)
                    near |= near.T
                else:
                    near = m.within(how, m.loose)
                yield similar(one, *_forest(near | (label[:, None] == label[None])))

    return rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def components_of(sets: DataFrame, m: Measure | tuple[Measure, ...]) -> DataFrame:
    """(cls, comp) of every class: the components of loosely similar ones.

    The first bands join most of what belongs together; for the rest only buckets that still hold several components are compared.
    """
    sets, ms = _several(sets, m)
    own = sets.withColumn("label", F.col("cls"))
    first = connected_components(staged(verified_links(staged(band_rows(own, ms, 0, FIRST), "bands"), sets, ms), "links"))
    labels = staged(sets.select("cls").join(first, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("label")), "labels")
    more = staged(verified_links(staged(band_rows(sets.join(labels, "cls"), ms, FIRST), "bands"), sets, ms), "links")
    if more.isEmpty():
        return labels.withColumnRenamed("label", "comp")
    second = connected_components(more).withColumnRenamed("cls", "label")
    return labels.join(second, "label", "left").select("cls", F.coalesce("comp", "label").alias("comp"))


def _all_pairs(g: pa.RecordBatch, left: np.ndarray, right: np.ndarray, m: Measure) -> np.ndarray:
    """Cosines or distances of the rows `left` with the rows `right`."""
    offsets, idx, val = csr(g.column("idx"), g.column("val"))
    if m.kind == "euclid":
        x = val.reshape(g.num_rows, -1)
        return np.sqrt(sum(np.subtract.outer(c[left], c[right]) ** 2 for c in x.T))
    names, at = np.unique(idx, return_inverse=True)
    row = np.repeat(np.arange(g.num_rows), np.diff(offsets))
    how = np.zeros((len(left), len(right)))
    for lo in range(0, len(names), COLUMNS):  # dense in some columns at a time
        some = (at >= lo) & (at < lo + COLUMNS)
        dense = np.zeros((g.num_rows, min(COLUMNS, len(names) - lo)))
        dense[row[some], at[some] - lo] = val[some]
        how += dense[left] @ dense[right].T
    return how


def _block_pairs(rows: DataFrame, ms: tuple[Measure, ...], columns: list[str], each: Callable, schema: str) -> DataFrame:
    """What `each` gives for pairs of blocks of (comp, cls, m, idx, val, *columns), so that every pair of a component is compared.

    Large components are cut into blocks of BLOCK, a pair of blocks a task. `each` gets the rows of a pair, the places of the
    left and the right block in them, how they compare, by which measure, and whether the two are the same block.
    """
    sizes = rows.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    rows = rows.join(sizes, "comp").withColumn("k", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("comp", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "cls", "m", "idx", "val", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["comp", "x", "y"]):
            k, x, y = g.column("k").to_numpy(), g.column("x")[0].as_py(), g.column("y")[0].as_py()
            left, right = np.flatnonzero(k == x), np.flatnonzero(k == y)
            m = ms[g.column("m")[0].as_py()]
            yield from each(g, left, right, _all_pairs(g, left, right, m), m, x == y)

    return rows.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y").mapInArrow(run, schema)


def exact_degrees(parts: DataFrame, m: Measure | tuple[Measure, ...]) -> DataFrame:
    """(cls, comp, weight, similar, closeness) of (comp, cls, [m,] weight, idx, val): every pair of a component compared.

    `similar` is the weight of the records of the component that are strictly similar to the class, its own included;
    `closeness` sums its similarity (or negative distance) to all. No pair is ever a row.
    """
    parts, ms = _several(parts, m)
    rows = parts.join(parts.groupBy("comp").agg((F.count("*") == 1).alias("alone")), "comp")
    # a class alone has only its copies to be similar to
    self = F.when(F.col("m").isin([k for k, x in enumerate(ms) if x.kind == "cosine"]), F.aggregate("val", F.lit(0.0), lambda acc, v: acc + v * v)).otherwise(0.0)
    alone = rows.filter("alone").select("comp", "cls", "weight", F.col("weight").alias("similar"), (self * F.col("weight")).alias("closeness"))

    def each(g: pa.RecordBatch, left: np.ndarray, right: np.ndarray, how: np.ndarray, m: Measure, same: bool) -> Iterator[pa.RecordBatch]:
        w = g.column("weight").to_numpy().astype(float)
        near = m.within(how, m.strict)
        close = how if m.kind == "cosine" else -how
        rows = [(left, near @ w[right], close @ w[right])]
        if not same:
            rows.append((right, near.T @ w[left], close.T @ w[left]))
        take = np.concatenate([r[0] for r in rows])
        yield pa.RecordBatch.from_arrays(
            [g.column("comp").take(pa.array(take)), g.column("cls").take(pa.array(take)), g.column("weight").take(pa.array(take)), pa.array(np.concatenate([r[1] for r in rows]).astype(np.int64)), pa.array(np.concatenate([r[2] for r in rows]))],
            ["comp", "cls", "weight", "similar", "closeness"],
        )

    done = _block_pairs(rows.filter("NOT alone").drop("alone"), ms, ["weight"], each, "comp bigint, cls bigint, weight bigint, similar bigint, closeness double")
    return done.groupBy("comp", "cls", "weight").agg(F.sum("similar").alias("similar"), F.sum("closeness").alias("closeness")).union(alone)


def _greatest_near(rows: DataFrame, ms: tuple[Measure, ...]) -> DataFrame:
    """(cls, h): of every class of (comp, cls, m, idx, val, d) the greatest (d, b) among the strictly similar others of its
    component that have a `d`; classes without such have no row."""

    def each(g: pa.RecordBatch, left: np.ndarray, right: np.ndarray, how: np.ndarray, m: Measure, same: bool) -> Iterator[pa.RecordBatch]:
        d, cls = g.column("d").fill_null(-1).to_numpy(), g.column("cls").to_numpy()
        place = np.empty(len(d), np.int64)
        place[np.lexsort((cls, d))] = np.arange(len(d))
        near = m.within(how, m.strict) & (cls[left][:, None] != cls[right][None])
        for a, b, ok in [(left, right, near)] + ([] if same else [(right, left, near.T)]):
            if not len(a) or not len(b):
                continue
            top = np.where(ok & (d[b] >= 0), place[b], -1)
            best = top.argmax(1)
            found = np.flatnonzero(top.max(1) >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(cls[a[found]]), pa.array(d[b[best[found]]]), pa.array(cls[b[best[found]]])], ["cls", "d", "b"])

    return _block_pairs(rows, ms, ["d"], each, "cls bigint, d bigint, b bigint").groupBy("cls").agg(F.max(F.struct("d", "b")).alias("h"))


def _split(loose: DataFrame, ms: tuple[Measure, ...]) -> DataFrame:
    """(cls, comp): loose components (comp, cls, m, weight, idx, val) divided around medoids.

    A class that has more similar records than every class similar to it is a medoid; classes similar to medoids join
    the greatest of them; the rest is divided in further rounds, where degrees count the remaining classes only. All pairs
    of a component are compared, not only the candidates.
    """
    left = staged(loose.select("comp", "cls", "m", "weight", "idx", "val"), "left")
    done = None
    while not left.isEmpty():
        degree = exact_degrees(left, ms).select("cls", F.col("similar").alias("d"))
        rows = staged(left.join(degree, "cls"), "degree")
        own = rows.select("comp", "cls", "m", "d", "idx", "val").join(_greatest_near(rows, ms), "cls", "left")
        medoid = F.col("h").isNull() | (F.struct("d", "cls") > F.struct(F.col("h.d").alias("d"), F.col("h.b").alias("cls")))
        own = staged(own.withColumn("medoid", medoid).select("comp", "cls", "m", F.when(F.col("medoid"), F.col("d")).alias("d"), "idx", "val"), "medoids")
        heads = own.filter("d IS NOT NULL").select("cls", F.col("cls").alias("comp"))
        joined = _greatest_near(own, ms).join(heads.select("cls"), "cls", "left_anti").select("cls", F.col("h.b").alias("comp"))
        now = cut(heads.union(joined))
        done = now if done is None else done.union(now)
        left = staged(left.join(now.select("cls"), "cls", "left_anti"), "left")
    return done if done is not None else loose.select("cls", "comp").limit(0)


def similarity_clusters(records: DataFrame, m: Measure | tuple[Measure, ...]) -> tuple[DataFrame, DataFrame]:
    """Clusters of mutually similar records: (members, groups).

    `records` has (key, space bigint, cls, idx, val), and with several measures the number `m` of the record's; records of one `cls` are copies, those of different spaces are never similar. Copies
    are collapsed; MinHash banding of the token sets gives candidates, the measure and the exact Jaccard similarity verify them, loosely
    similar classes form connected components, whose every pair is then compared in blocks. A component in which all
    are strictly similar is a cluster as it is (`whole`); others are divided around highest-degree medoids, all their pairs compared.

    members: (m, key, cluster, whole). groups: (m, cluster, size, whole, typical): the three keys nearest to all others, of copies only the least.
    Records similar to no other are clusters of their own copies. Null keys and empty vectors must not occur
    (the callers filter them); an empty table gives empty results.
    """
    records, ms = _several(records, m)
    records = staged(records.select("m", "key", "space", "cls", "idx", "val"), "records")
    sets = staged(records.groupBy("cls").agg(F.first(F.struct("m", "space", "idx", "val")).alias("x"), F.count("*").alias("weight"), F.min("key").alias("key")).select("cls", "x.*", "weight", "key"), "sets")
    comps = components_of(sets, ms)
    parts = sets.join(comps, "cls")
    degrees = staged(exact_degrees(parts.select("comp", "cls", "m", "weight", "idx", "val"), ms), "degrees")
    totals = degrees.groupBy("comp").agg(F.sum("weight").alias("size"), F.min("similar").alias("least"))
    state = staged(degrees.join(totals, "comp").withColumn("whole", F.col("least") == F.col("size")), "state")
    tight = state.filter("whole").select("cls", "comp")
    apart = staged(state.filter("NOT whole").select("comp", "cls", "weight").join(sets.select("cls", "m", "idx", "val"), "cls"), "apart")
    split = staged(_split(apart, ms), "split")
    # members are typical of the cluster they are in, not of the component it was part of
    inner = exact_degrees(apart.drop("comp").join(split, "cls"), ms)
    closeness = state.filter("whole").select("cls", "closeness").union(inner.select("cls", "closeness"))
    again = tight.withColumn("whole", F.lit(True)).union(split.withColumn("whole", F.lit(False)))
    again = staged(again.join(sets.select("cls", "m", "weight", "key"), "cls"), "clusters")
    names = again.groupBy("comp").agg(F.first("m").alias("m"), F.min("key").alias("cluster"), F.sum("weight").alias("size"), F.first("whole").alias("whole"))
    members = records.select("m", "key", "cls").join(again.select("cls", "comp", "whole"), "cls").join(names.select("comp", "cluster"), "comp").select("m", "key", "cluster", "whole")
    typical = again.join(closeness, "cls")
    salt = F.pmod(F.xxhash64("cls"), F.lit(32))
    order = [F.desc(F.round("closeness", DIGITS)), F.col("key")]
    typical = typical.withColumn("r", F.row_number().over(Window.partitionBy("comp", salt).orderBy(*order))).filter("r <= 3")
    typical = typical.withColumn("r", F.row_number().over(Window.partitionBy("comp").orderBy(*order))).filter("r <= 3")
    typical = typical.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]).alias("typical"))
    return members, names.join(typical, "comp").select("m", "cluster", "size", "whole", "typical")


def isolated(groups: DataFrame, positions: DataFrame, distance: float) -> DataFrame:
    """Clusters (key, cluster) of `groups` (space, x, y, cluster) that no other position of their space is within
    `distance` of: an exact check by cells of that size."""
    cell = lambda c: F.floor(F.col(c) / F.lit(distance)).cast("int")
    near = groups.select("space", "cluster", F.col("x").alias("gx"), F.col("y").alias("gy"), cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    near = near.withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    other = positions.select("space", "x", "y", F.col("cluster").alias("oc"), cell("x").alias("cx"), cell("y").alias("cy")).distinct()
    hit = near.join(other, ["space", "cx", "cy"]).filter((F.col("cluster") != F.col("oc")) & (F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) <= distance + 1e-9))
    return groups.join(hit.select("cluster").distinct(), "cluster", "left_anti")
