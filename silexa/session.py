"""Session helpers: table loading and lineage cuts."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in `spark.checkpoint.dir`; only where that is unset (tests, local runs) is a
    folder of our own made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="silexa-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan is executed once and its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder, which is deleted when the application ends."""
    sc = spark.sparkContext
    own = os.path.join(shared_dir(spark), "silexa-stage", sc.applicationId)
    if own not in _MARKED:
        p = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(own)
    return os.path.join(own, f"{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as parquet in the shared folder and read it back: a lineage cut that keeps column pruning."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
