"""Scalar functions on times, numbers, maps and JSON."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def time_parts(epoch_seconds: str | Column) -> dict[str, Column]:
    """year, month, week (of year), weekday (Monday = 1), day, hour and minute of epoch seconds, in the session's zone."""
    t = F.timestamp_seconds(_c(epoch_seconds))
    return {"year": F.year(t), "month": F.month(t), "week": F.weekofyear(t), "weekday": F.weekday(t) + 1, "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t)}


def parse_time(text: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds, null if the text doesn't fit."""
    return F.unix_timestamp(F.try_to_timestamp(_c(text), F.lit(pattern)))


def format_time(epoch_seconds: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(_c(epoch_seconds), pattern)


def hours_between(a: str | Column, b: str | Column) -> Column:
    """Whole hours from one epoch second to another."""
    return F.floor((_c(b) - _c(a)) / 3600).cast("bigint")


def sigmoid(x: str | Column, clamp: float | None = None) -> Column:
    """1 / (1 + e^-x); with `clamp` 0 or 1 beyond it."""
    y = 1 / (1 + F.exp(-_c(x)))
    return y if clamp is None else F.when(_c(x) > clamp, 1.0).when(_c(x) < -clamp, 0.0).otherwise(y)


def kernel(x: str | Column, name: str = "None") -> Column:
    """None (identity), Sigmoid or Polynomial (square)."""
    match name.lower():
        case "none":
            return _c(x)
        case "sigmoid":
            return sigmoid(x)
        case "polynomial":
            return _c(x) * _c(x)
    raise ValueError(f"unknown kernel {name!r}")


def parse_double(x: str | Column) -> Column:
    return _c(x).try_cast("double")


def parse_int(x: str | Column) -> Column:
    return _c(x).try_cast("int")


def parse_pairs(x: str | Column) -> Column:
    """map<string,string> of `k:v,k:v`, split at an entry's last colon; of equal keys the first counts."""
    parts = F.filter(F.split(_c(x), ","), lambda p: p.rlike(r"^.+:[^:]*$"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, r":[^:]*$", "")).alias("k"), F.trim(F.substring_index(p, ":", -1)).alias("v")))
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(once)


def uniform(text: Column) -> Column:
    """A repeatable number in [0, 1) for a text, from its MD5 digest: any engine can make the same."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _draw(key: str | Column, seed: int) -> Column:
    return uniform(F.concat_ws("/", _c(key).cast("string"), F.lit(str(seed))))


def bernoulli(p: float, key: str | Column, seed: int = 42) -> Column:
    """A repeatable draw per key."""
    return _draw(key, seed) < p


def multinomial(weights: list[float], key: str | Column, seed: int = 42) -> Column:
    """A repeatable index drawn per key in proportion to the weights, by the inverse of their running sums."""
    u = _draw(key, seed) * sum(weights)
    out: Column = F.lit(len(weights) - 1)
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(u < sum(weights[: i + 1]), i).otherwise(out)
    return out.cast("int")


def poisson(rate: float, key: str | Column, seed: int = 42, most: int = 12) -> Column:
    """A repeatable Poisson draw per key, at most `most`."""
    import math

    u = _draw(key, seed)
    cum, p, steps = 0.0, math.exp(-rate), []
    for k in range(most):
        cum += p
        steps.append((k, cum))
        p *= rate / (k + 1)
    out: Column = F.lit(most)
    for k, c in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out


def unescape(x: str | Column) -> Column:
    r"""\t, \n, \r, \\ and \uXXXX as the characters they stand for, in one pass; other escapes stay as they are."""
    tokens = F.regexp_extract_all(_c(x), F.lit(r"(?s)(?:\\u[0-9a-fA-F]{4})+|\\.|[^\\]+|\\"), F.lit(0))

    def char(t: Column) -> Column:
        out = F.when(t.rlike(r"^\\u[0-9a-fA-F]{4}"), F.decode(F.unhex(F.replace(t, F.lit("\\u"), F.lit(""))), "UTF-16BE")).otherwise(t)
        for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
            out = F.when(t == a, b).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, char), "")


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
