"""Checks of columns and their types, which fail before anything runs."""
from __future__ import annotations

from pyspark.sql import DataFrame

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def require(df: DataFrame, **columns: str | tuple[str, ...]) -> DataFrame:
    """`df`, if it has the columns, each of one of the given kinds; "numeric" stands for all numbers, "vector" for ML vectors and
    arrays of doubles. Raises ValueError that names every fault at once."""
    kinds, faults = dict(df.dtypes), []
    for name, want in columns.items():
        allowed = (want,) if isinstance(want, str) else want
        kind = kinds.get(name)
        if kind is None:
            faults.append(f"column {name!r} is missing; there are {', '.join(df.columns)}")
        elif not any(_is(kind, w) for w in allowed):
            faults.append(f"column {name!r} is {kind}, not {' or '.join(allowed)}")
    if faults:
        raise ValueError("; ".join(faults))
    return df


def _is(kind: str, want: str) -> bool:
    if want == "numeric":
        return kind.split("(")[0] in NUMERIC
    return kind in ("vector", "array<double>") if want == "vector" else kind == want


def append_column(df: DataFrame, name: str) -> str:
    """`name`, if no column is called so yet: what an operator adds must not replace a column of the caller."""
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    return name
