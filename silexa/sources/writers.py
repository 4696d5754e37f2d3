"""Sinks, file-system operations and chained pipeline stages."""
from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import FORMATS


def write_csv(df: DataFrame, path: str, delimiter: str = ",", drop_null: bool = False, mode: str = "errorifexists") -> None:
    """CSV with a header, optionally without rows that hold a null."""
    (df.na.drop() if drop_null else df).write.mode(mode).option("header", True).option("sep", delimiter).csv(path)


def write_json(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines; one file only for small results (`single`)."""
    (df.coalesce(1) if single else df).write.mode(mode).json(path)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """parquet, json, csv or tsv; any other format is a ValueError."""
    match fmt:
        case "parquet":
            df.write.mode(mode).parquet(path)
        case "json":
            write_json(df, path, mode=mode)
        case "csv":
            write_csv(df, path, mode=mode)
        case "tsv":
            write_csv(df, path, "\t", mode=mode)
        case _:
            raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")


def write_lines(df: DataFrame, path: str, separator: str = "\t", mode: str = "errorifexists") -> None:
    """Rows as separated text lines; nulls are empty fields."""
    df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def sparse_text(df: DataFrame, label: str = "label", idx: str = "idx", val: str = "val", base: int = 1, separator: str = " ") -> DataFrame:
    """(value): LibSVM lines `label i:v ...` of sparse rows, indices ascending and raised by `base`."""
    pairs = F.array_sort(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")))
    entries = F.transform(pairs, lambda e: F.concat_ws(":", (e["i"] + base).cast("string"), e["v"].cast("string")))
    return df.select(F.concat_ws(separator, F.col(label).cast("string"), F.array_join(entries, separator)).alias("value"))


def write_libsvm(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sparse rows (label, idx, val) as 1-based LibSVM lines."""
    sparse_text(df).write.mode(mode).text(path)


class FileSystem:
    """exists, list, delete, mkdirs, copy and rename on whatever file system a path names."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []

    def mkdirs(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        """False if nothing was there."""
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._at(source)
        return fs.rename(p, self._at(target)[1])

    def copy(self, source: str, target: str) -> bool:
        (fa, a), (fb, b) = self._at(source), self._at(target)
        return self._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, self._conf)


def load_stages(spark: SparkSession, data_path: str) -> list[Transformer]:
    """The stages that made the table at `data_path`, kept beside it as `<path>Stages`; none if it has none."""
    at = f"{data_path}Stages"
    return list(PipelineModel.load(at).stages) if FileSystem(spark).exists(at) else []


def save_stages(spark: SparkSession, previous: list[Transformer], model: Transformer, data_path: str) -> PipelineModel:
    """Keep `previous` and this model as the stages of the table at `data_path`, and return them as one pipeline."""
    own = list(model.stages) if isinstance(model, PipelineModel) else [model]
    chain = PipelineModel([*previous, *own])
    chain.write().overwrite().save(f"{data_path}Stages")
    return chain
