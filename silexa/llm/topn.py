"""Top N rows of every group by simultaneous bisection of all groups (problem 3)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .skew import hot_keys

_WAYS, _SALT, _BIG = 16, 32, 1.7976931348623157e308
_TAKEN, _OPEN, _TIED = 1, 0, 2


def _word(df: DataFrame, name: str, descending: bool) -> Column:
    """An order-preserving number of a column: the row that ranks first has the greatest."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.greatest(F.least(col.cast("double"), F.lit(_BIG)), F.lit(-_BIG))
        return F.when(col.isNull() | F.isnan(col), F.lit(-_BIG)).otherwise(x if descending else -x)
    if isinstance(kind, T.TimestampType):
        x = F.unix_micros(col)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.unix_micros(col.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        x = F.unix_date(col).cast("long")
    elif isinstance(kind, T.IntegralType):
        x = col.cast("long")
    else:
        raise TypeError(f"{name}: {kind.simpleString()} has no numeric order")
    return F.coalesce(x if descending else F.bitwise_not(x), F.lit(-(2**63)).cast("long"))


def _bucket(w: str, lo: str, hi: str) -> Column:
    """Which of the interval's equal parts a row lies in; the parts' bounds are the midpoints of four bisections."""
    x, a, b = (F.col(c).cast("double") for c in (w, lo, hi))
    # halves keep the differences finite; a range too narrow for a double is split at its exact upper end
    part = F.floor((x / 2 - a / 2) / F.nullif(b / 2 - a / 2, F.lit(0.0)) * _WAYS).cast("int")
    return F.least(F.coalesce(part, F.when(F.col(w) == F.col(hi), _WAYS - 1).otherwise(0)), F.lit(_WAYS - 1))


def top_n(df: DataFrame, group: str, order: list[tuple[str, bool]], n: int, distinct: bool = True) -> DataFrame:
    """The `n` first rows of every group, by `order`: (column, descending) pairs, the last ones identifying the row.

    The order columns form an order-preserving code of several words (score first, identifier last). For all groups
    at once the cutoff is refined: rows are counted above the midpoints of each group's open interval, the interval
    shrinks to the part that holds the cutoff (and to the least and greatest code in it), and when only ties remain
    on one word the next word decides, until each group holds exactly `n`. Rows below an interval are dropped
    and rows above are taken in every pass, so the passes shrink geometrically; no group is ever sorted or collected.
    Groups with more than a thousandth of all rows are salted.

    Rows with a null group are left out. A null (or NaN) order value ranks last, infinities rank as the greatest and
    least doubles. With `distinct`, rows that agree in group and order columns count once; without it the caller
    guarantees that there are none. Groups with fewer rows are returned whole; an empty table gives an empty result;
    all columns of `df` are kept, whatever their names.
    """
    names = [c for c, _ in order]
    if distinct:
        df = df.dropDuplicates([group, *names])
    words = [f"w{i}" for i in range(len(order))]
    # the caller's columns travel as one struct, so that none can clash with ours
    base = df.select(F.col(group).alias("g"), F.struct(*[F.col(c) for c in df.columns]).alias("row"), *[_word(df, c, d).alias(w) for w, (c, d) in zip(words, order)])
    base = staged(base.filter(F.col("g").isNotNull()), "topn")
    hot = hot_keys(base, "g")
    salt = F.when(F.col("g").isin(hot), F.pmod(F.xxhash64(*words), F.lit(_SALT))).otherwise(0).cast("int") if hot else F.lit(0)
    # the first interval is the same for all groups
    first = base.agg(F.min(words[0]).alias("lo"), F.max(words[0]).alias("hi"), F.lit(n).cast("long").alias("k"))
    open_ = base.withColumn("salt", salt).crossJoin(F.broadcast(first))  # one row
    taken = []
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else w
        tied = []
        while True:
            done = staged(_pass(open_, w, after, hot), f"topn-{i}")
            state = {r[0] for r in done.select("st").distinct().collect()}  # at most three values
            if _TAKEN in state:
                taken.append(done.filter(F.col("st") == _TAKEN).select("row.*"))
            if _TIED in state:
                tied.append(done.filter(F.col("st") == _TIED).drop("st", "elo", "ehi").withColumnsRenamed({"tlo": "lo", "thi": "hi"}))
            if _OPEN not in state:
                break
            open_ = done.filter(F.col("st") == _OPEN).drop("st", "tlo", "thi").withColumnsRenamed({"elo": "lo", "ehi": "hi"})
        if not tied:
            break
        open_ = reduce(DataFrame.unionByName, tied)
        if i + 1 == len(words):  # equal in every word: only where the caller's promise fails, or nulls and extreme values meet
            rank = F.row_number().over(Window.partitionBy("g").orderBy(*[F.col("row")[c] for c in names]))
            # the constant bound lets every task keep the first n of a group before any row moves
            taken.append(open_.withColumn("r", rank).filter((F.col("r") <= n) & (F.col("r") <= F.col("k"))).select("row.*"))
    return reduce(DataFrame.unionByName, taken) if taken else df.limit(0)


def _pass(rows: DataFrame, w: str, after: str, hot: list) -> DataFrame:
    """One refinement of every open group: the rows taken, still open, or tied on this word, with their interval."""
    rows = rows.withColumn("b", _bucket(w, "lo", "hi"))
    hist = rows.groupBy("g", "b").agg(
        F.count("*").alias("c"), F.max("k").alias("k"), F.min(w).alias("lo"), F.max(w).alias("hi"), F.min(after).alias("nlo"), F.max(after).alias("nhi")
    )
    # at most _WAYS rows a group
    above = F.sum("c").over(Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hist = hist.withColumn("cum", above).withColumn("lowest", F.row_number().over(Window.partitionBy("g").orderBy("b")) == 1)
    # the part that holds the cutoff; a group with too few rows takes its lowest part whole
    edge = hist.filter(((F.col("cum") - F.col("c")) < F.col("k")) & ((F.col("cum") >= F.col("k")) | F.col("lowest")))
    edge = edge.select(
        F.col("g").alias("eg"), F.col("b").alias("eb"), (F.col("cum") <= F.col("k")).alias("whole"), (F.col("k") - (F.col("cum") - F.col("c"))).alias("nk"),
        (F.col("lo") == F.col("hi")).alias("tie"), F.col("lo").alias("elo"), F.col("hi").alias("ehi"), F.col("nlo").alias("tlo"), F.col("nhi").alias("thi"),
    )
    salts = F.explode(F.when(F.col("eg").isin(hot), F.sequence(F.lit(0), F.lit(_SALT - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    edge = edge.withColumn("s", salts)
    on = (F.col("g") == F.col("eg")) & (F.col("salt") == F.col("s")) & (F.col("b") >= F.col("eb"))
    state = F.when((F.col("b") > F.col("eb")) | F.col("whole"), _TAKEN).when(F.col("tie"), _TIED).otherwise(_OPEN)
    keep = [c for c in rows.columns if c not in ("lo", "hi", "k", "b")]
    return rows.join(edge, on).select(*keep, "elo", "ehi", "tlo", "thi", F.col("nk").alias("k"), state.alias("st"))
