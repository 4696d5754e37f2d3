"""Most similar vectors for every vector, by multi-index hashing (problem 1)."""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .components import connected_components
from .vectors import DIGITS, canonical, classes, csr, whole_groups, with_cosine

#: Vectors on which the rotation is fitted (a hash sample); every vector is indexed.
SAMPLE, ROUNDS, SEED = 4096, 8, 20_240_601
#: Vectors of a bucket from which on it is searched by blocks, exactly.
HOT = 256
#: Exact search: columns that are dense at a time, vectors of a block, queries of a block at a time, products of entries at a time.
COLUMNS, BLOCK, QUERIES, PRODUCTS = 2048, 8192, 256, 1 << 22
#: Bits by which a query's substring may differ from an index entry's.
PROBE = 1


def plan(n: int, min_cosine: float, miss: float, probe: int = PROBE) -> tuple[int, int, int]:
    """(substrings, bits of each, Hamming radius) for `n` vectors, with substrings probed within `probe` bits.

    A substring has log2(n) bits, so that a bucket holds about one unrelated vector at any size. Two vectors at angle
    t differ in a bit with probability t / pi; there are as many substrings as keep the chance that none of them
    agrees within `probe` bits below `miss` at the least cosine wanted. By the pigeonhole principle every code within a
    Hamming distance below (probe + 1) * substrings has a substring within `probe` bits of the query's, so probing
    retrieves it for certain; more distant ones up to the radius are retrieved by chance 1 - miss or more. The radius, four standard
    deviations above the mean distance at the least cosine, filters what is retrieved before vectors are compared.
    """
    bits = min(28, max(8, math.ceil(math.log2(max(n, 2)))))
    differ = math.acos(min(1.0, min_cosine)) / math.pi
    near = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(probe + 1))
    parts = math.ceil(math.log(miss) / math.log(1 - near)) if 0 < near < 1 else 1
    total = parts * bits
    return parts, bits, math.ceil(total * differ + 4 * math.sqrt(total * differ * (1 - differ)))


def _gauss(idx: np.ndarray, bits: int) -> np.ndarray:
    """A row of `bits` normal numbers for every index, made from the index alone: indices of any size have their own."""
    n = (idx.astype(np.uint64)[:, None] * np.uint64(bits) + np.arange(bits, dtype=np.uint64)) * np.uint64(2) + np.uint64(SEED)
    u = []
    for k in (0, 1):
        with np.errstate(over="ignore"):
            x = (n + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u.append(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5)
    return (np.sqrt(-2 * np.log(u[0] / 2**53)) * np.cos(2 * np.pi * u[1] / 2**53)).astype(np.float32)


def _project(offsets: np.ndarray, idx: np.ndarray, val: np.ndarray, bits: int) -> np.ndarray:
    """Vectors times a random matrix of `bits` columns, some thousand entries at a time."""
    out = np.zeros((len(offsets) - 1, bits), np.float32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    names, at = np.unique(idx, return_inverse=True)
    for first_name in range(0, len(names), 65_536):
        basis = _gauss(names[first_name : first_name + 65_536], bits)
        some = np.flatnonzero((at >= first_name) & (at < first_name + len(basis)))
        for lo in range(0, len(some), 16_384):
            part = some[lo : lo + 16_384]
            x = basis[at[part] - first_name] * val[part, None].astype(np.float32)
            r = rows[part]
            first = np.flatnonzero(np.r_[True, np.diff(r) != 0])
            out[r[first]] += np.add.reduceat(x, first, axis=0)
    return out


def learn_rotation(x: np.ndarray) -> np.ndarray:
    """Iterative quantisation: the rotation under which the signs lose least of the sample.

    The sample isn't centred: signs about the origin tell the angle between two vectors, signs about a mean would not.
    """
    r = np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((x.shape[1],) * 2))[0].astype(np.float32)
    if len(x) > x.shape[1]:  # a smaller sample doesn't determine a rotation
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(x @ r).T @ x, full_matrices=False)
            r = (u @ vt).T.astype(np.float32)
    return r


def binary_codes(vectors: DataFrame, parts: int, bits: int) -> DataFrame:
    """(space, cls, subs array<bigint>, c0, c1, ...): the substrings of each vector's code, each with its number in the upper
    half, and the whole code in 64-bit words."""
    total = parts * bits
    words = -(-total // 64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _project(*csr(b.column("idx"), b.column("val")), total)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    some = vectors.orderBy(F.xxhash64("cls", F.lit(1))).limit(SAMPLE)
    sample = [np.frombuffer(r[0], np.float32) for r in some.select("idx", "val").mapInArrow(project, "x binary").collect()]
    rotation = learn_rotation(np.array(sample, np.float32).reshape(-1, total))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bit = (_project(*csr(b.column("idx"), b.column("val")), total) @ rotation) > 0
            sub = bit.reshape(n, parts, bits) @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(parts, dtype=np.int64) << 32)
            whole = np.zeros((n, words * 64), np.uint8)
            whole[:, :total] = bit
            code = np.packbits(whole, axis=1).view(np.int64).reshape(n, words)
            subs = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(sub.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("space"), b.column("cls"), subs, *[pa.array(code[:, w]) for w in range(words)]], ["space", "cls", "subs", *[f"c{w}" for w in range(words)]])

    space = vectors.schema["space"].dataType.simpleString()
    return vectors.select("space", "cls", "idx", "val").mapInArrow(encode, f"space {space}, cls bigint, subs array<bigint>, " + ", ".join(f"c{w} bigint" for w in range(words)))


def _within(sub: str, bits: int, probe: int, upward: bool) -> Column:
    """The values within `probe` bits of a substring, itself first; with `upward` only those greater than it, of which any
    two substrings have one in one direction."""
    masks = [sum(1 << i for i in c) for k in range(1, probe + 1) for c in combinations(range(bits), k)]
    other = F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]) if masks else F.array().cast("array<bigint>"), lambda m: F.col(sub).bitwiseXOR(m))
    return F.concat(F.array(sub), F.filter(other, lambda x: x > F.col(sub)) if upward else other)


def similar_classes(vectors: DataFrame, min_cosine: float, miss: float = 0.005, probe: int = PROBE, k: int = 10) -> DataFrame:
    """(cls, near, cosine) for pairs of different vectors of a space of at least `min_cosine`, in both directions.

    Each vector's substrings are index entries; the vector asks all entries within `probe` bits of its own. Two substrings
    find each other in both directions, so a vector asks only for itself and for greater values. Retrieved pairs
    are filtered by the Hamming distance of the whole codes before vectors are fetched and compared.

    Buckets of more than HOT vectors, the mark of a mass of nearly equal ones, give no pairs: `_massed` compares all
    vectors that would probe them with all their members, and each keeps the `k` nearest.
    """
    n = vectors.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    parts, bits, radius = plan(n, min_cosine, miss, probe)
    codes = staged(binary_codes(vectors, parts, bits), "codes")
    words = [c for c in codes.columns if c.startswith("c") and c != "cls"]
    each = codes.select("space", "cls", F.explode("subs").alias("sub"))
    hot = staged(each.groupBy("space", "sub").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("space", "sub"), "hot")
    massed = not hot.isEmpty()
    index = codes.select("space", "cls", F.explode("subs").alias("sub"), *words)
    index = index.join(hot, ["space", "sub"], "left_anti") if massed else index
    asking = codes.select("space", F.col("cls").alias("b"), F.explode("subs").alias("own"), *[F.col(w).alias(f"o{w}") for w in words])
    asking = asking.withColumn("sub", F.explode(_within("own", bits, probe, True)))
    distance = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in words])
    pairs = index.withColumnRenamed("cls", "a").join(asking, ["space", "sub"]).filter(((F.col("sub") != F.col("own")) | (F.col("a") < F.col("b"))) & (distance <= radius))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = with_cosine(pairs, vectors).filter(F.col("cosine") >= min_cosine)
    near = near.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("near"), "cosine"), F.struct(F.col("b").alias("cls"), F.col("a").alias("near"), "cosine"))).alias("x")).select("x.*")
    if massed:
        near = near.union(_massed(each, hot, vectors, bits, probe, k).filter(F.col("cosine") >= min_cosine)).distinct()
    return near


def _massed(each: DataFrame, hot: DataFrame, vectors: DataFrame, bits: int, probe: int, k: int) -> DataFrame:
    """(cls, near, cosine): the `k` nearest members of large buckets for every vector that is in one of them or probes it.

    A mass is in a large bucket of most substrings. Large buckets that share a vector form a component, and every asking vector is
    compared once with all members of the component, in pairs of blocks: exactly, whatever its size.
    """
    name = F.xxhash64("space", "hot")
    # large buckets are few (at most one for HOT index entries): they are multiplied by the probes, not the vectors
    around = hot.withColumn("hot", F.col("sub")).withColumn("sub", F.explode(_within("hot", bits, probe, False)))
    hits = staged(each.join(around, ["space", "sub"]).select("cls", name.alias("hot"), (F.col("sub") == F.col("hot")).alias("member")), "hits")
    inside = hits.filter("member")
    links = inside.join(inside.groupBy("cls").agg(F.min("hot").alias("a")), "cls").filter(F.col("a") != F.col("hot")).select("a", F.col("hot").alias("b")).distinct()
    comps = connected_components(staged(links, "links")).withColumnRenamed("cls", "hot")
    at = hits.join(comps, "hot", "left").groupBy(F.coalesce("comp", "hot").alias("space"), "cls").agg(F.max("member").alias("base"))
    rows = at.join(vectors.select("cls", "idx", "val"), "cls").select("space", "cls", F.col("cls").alias("head"), F.lit(True).alias("asks"), "base", "idx", "val")
    return exact_nearest(rows, k)


def _cosines(q: tuple, b: tuple) -> np.ndarray:
    """Dot products of each row of `q` with each row of `b`: by the columns' entries, or densely where entries are many."""
    (qo, qi, qv), (bo, bi, bv) = q, b
    nq, nb = len(qo) - 1, len(bo) - 1
    rq, rb = np.repeat(np.arange(nq), np.diff(qo)), np.repeat(np.arange(nb), np.diff(bo))
    names, at = np.unique(np.r_[qi, bi], return_inverse=True)
    aq, ab = at[: len(qi)], at[len(qi) :]
    count = np.bincount(ab, minlength=len(names))
    each = count[aq]
    if each.sum() * 300 > nq * nb * len(names):
        out = np.zeros((nq, nb))
        for lo in range(0, len(names), COLUMNS):  # dense in some columns at a time
            width = min(COLUMNS, len(names) - lo)
            dense = [np.zeros((nq, width)), np.zeros((nb, width))]
            for x, r, a, v in zip(dense, (rq, rb), (aq, ab), (qv, bv)):
                some = (a >= lo) & (a < lo + width)
                x[r[some], a[some] - lo] = v[some]
            out += dense[0] @ dense[1].T
        return out
    order = np.argsort(ab, kind="stable")
    starts, rows, values = np.cumsum(count) - count, rb[order], bv[order]
    out, ends, lo = np.zeros(nq * nb), np.cumsum(each), 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, "right")))
        e = each[lo:hi]
        pos = np.arange(e.sum()) + np.repeat(starts[aq[lo:hi]] - (np.cumsum(e) - e), e)
        out += np.bincount(np.repeat(rq[lo:hi], e) * nb + rows[pos], np.repeat(qv[lo:hi], e) * values[pos], nq * nb)
        lo = hi
    return out.reshape(nq, nb)


def exact_nearest(rows: DataFrame, keep: int) -> DataFrame:
    """(cls, near, cosine): the `keep` nearest base vectors of every asking vector, by comparing it with its whole space.

    `rows` has (space, cls, head, asks, base, idx, val). Equal cosines go by `head`. A task compares a block of
    queries with a block of vectors and gives `keep` rows a query; those of all blocks are merged.
    """
    rows = staged(rows, "compared")
    sizes = rows.groupBy("space").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    rows = rows.join(sizes, "space").withColumn("k", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    columns = ["cls", "head", "idx", "val"]
    asked = rows.filter("asks").select("space", F.col("k").alias("x"), F.col("o").alias("y"), F.lit(True).alias("query"), *columns)
    both = asked.union(rows.filter("base").select("space", F.col("o").alias("x"), F.col("k").alias("y"), F.lit(False).alias("query"), *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, ["space", "x", "y"]):
            query = g.column("query").to_numpy(zero_copy_only=False)
            base = g.filter(pa.array(~query))
            asked = g.filter(pa.array(query))
            ids, n = base.column("cls").to_numpy(), base.num_rows
            if not n:
                continue
            b = csr(base.column("idx"), base.column("val"))
            for lo in range(0, asked.num_rows, QUERIES):
                q = asked.slice(lo, QUERIES)
                own = q.column("cls").to_numpy()
                cos = np.rint(_cosines(csr(q.column("idx"), q.column("val")), b) * 10.0**DIGITS).astype(np.int64)
                order = cos * n - np.arange(n)  # the vectors come sorted by head
                near = np.argpartition(-order, keep, axis=1)[:, : keep + 1] if n > keep + 1 else np.broadcast_to(np.arange(n), (len(own), n))
                i, j = np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()
                other = own[i] != ids[j]
                i, j = i[other], j[other]
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j]), base.column("head").take(pa.array(j)), pa.array(np.round(cos[i, j] / 10.0**DIGITS, DIGITS))], ["cls", "near", "head", "cosine"])

    kind = rows.schema["head"].dataType.simpleString()
    found = both.repartition("space", "x", "y").sortWithinPartitions("space", "x", "y", "head").mapInArrow(run, f"cls bigint, near bigint, head {kind}, cosine double")
    order = Window.partitionBy("cls").orderBy(F.desc("cosine"), "head", "near")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= keep).select("cls", "near", "cosine")


def _completed(near: DataFrame, unique: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cls, near, cosine) with the exact nearest classes instead for every class that has fewer than `k` other keys near."""
    heads = members.groupBy("cls").agg(F.count("*").alias("weight"), F.min("key").alias("head"))
    around = near.join(heads.select(F.col("cls").alias("near"), "weight"), "near").groupBy("cls").agg(F.sum("weight").alias("around"))
    asks = F.coalesce("around", F.lit(0)) + F.col("weight") <= k
    rows = unique.join(heads, "cls").join(around, "cls", "left").select(F.xxhash64("space").alias("space"), "cls", "head", asks.alias("asks"), F.lit(True).alias("base"), "idx", "val")
    rows = staged(rows, "asking")
    short = rows.filter("asks").select("cls")
    return staged(near.join(short, "cls", "left_anti").union(exact_nearest(rows, k)), "completed")


def _first(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first `k` rows of every group, ranked in salted parts first, so that no task sorts a whole large group."""
    salt = F.pmod(F.xxhash64("key"), F.lit(32))
    part = Window.partitionBy(group, salt).orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= k).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k)


def most_similar(
    df: DataFrame, key: str, idx: str, val: str, k: int = 10, min_cosine: float = 0.94, miss: float = 0.005, complete: bool = False, space: str | None = None, probe: int = PROBE
) -> DataFrame:
    """For every vector its `k` most similar other vectors: ([space,] key, other, cosine, rank), ties by the other's key.

    Multi-index hashing: each vector gets a binary code from a learned rotation, the code is split into substrings, each
    an index of its own; probing all entries within `probe` bits of a substring retrieves every code within the
    pigeonhole radius (see `plan`); what is retrieved is filtered by the codes' Hamming distance and reranked by the cosine of the
    vectors themselves. Neighbours of at least `min_cosine` are found with a probability of 1 - `miss` or more; less
    similar ones are no neighbours, unless the result is to be `complete`: then a vector that has fewer than `k`
    neighbours is compared with all others, whatever their cosine, and gets its true `k`.

    Collections named by `space` are searched in one go, each for itself. Vectors of the same direction form a class
    that is searched once. Each class then needs only the first k + 1 keys of itself and of its neighbours, so copies
    never multiply. Null, empty and zero vectors have no neighbours; how they are read is told at `canonical`. Other
    columns are ignored; an empty table gives an empty result.
    """
    members = staged(canonical(df, key, idx, val, space), "vectors")
    unique = staged(classes(members), "classes")
    near = staged(similar_classes(unique, min_cosine, miss, probe, k), "similar")
    if complete:
        near = _completed(near, unique, members, k)
    own = unique.select("cls", F.col("cls").alias("near"), F.lit(1.0).alias("cosine"))
    heads = _first(members.select("key", "cls"), "cls", ["key"], k + 1).select("key", F.col("cls").alias("near"))
    wide = _first(near.union(own).join(heads, "near"), "cls", [F.desc("cosine"), "key"], k + 1).select("cls", F.col("key").alias("other"), "cosine", "r")
    each = members.select("space", "key", "cls").join(wide, "cls").filter(F.col("key") != F.col("other"))
    # a key that is itself among its class's first leaves its place to the next
    self_at = wide.select("cls", F.col("other").alias("key"), F.col("r").alias("at"))
    rank = F.when(F.col("at") < F.col("r"), F.col("r") - 1).otherwise(F.col("r"))
    each = each.join(self_at, ["cls", "key"], "left").withColumn("rank", rank).filter(F.col("rank") <= k)
    return each.select(*([F.col("space").alias(space)] if space else []), F.col("key").alias(key), F.col("other"), "cosine", "rank")
