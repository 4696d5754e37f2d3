"""The isolation forest as a stage of an ML pipeline."""
from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import append_column, require
from .iforest import IsolationForest, IsolationForestModel


class _ForestParams(HasFeaturesCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows of a tree, or a share of all up to 1.0", TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "features of a tree, or a share of all up to 1.0", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of anomalies", TypeConverters.toFloat)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw with replacement", TypeConverters.toBoolean)
    approxQuantileRelativeError = Param(Params._dummy(), "approxQuantileRelativeError", "rank error of the threshold", TypeConverters.toFloat)
    anomalyScoreCol = Param(Params._dummy(), "anomalyScoreCol", "score column", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "entries of a feature vector", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(numTrees=100, maxSamples=256.0, maxFeatures=1.0, maxDepth=10, contamination=0.1, bootstrap=False, seed=123456, approxQuantileRelativeError=0.0, anomalyScoreCol="anomalyScore", predictionCol="prediction", featuresCol="features")

    def _wide(self, df: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
        """The vector's entries as columns of their own."""
        c = self.getFeaturesCol()
        require(df, **{c: "vector"})
        x = F.col(c) if dict(df.dtypes)[c] == "array<double>" else vector_to_array(c)
        names = [f"__f{i}" for i in range(size)]
        return df.withColumn("__x", x).select("*", *[F.get("__x", F.lit(i)).alias(n) for i, n in enumerate(names)]).drop("__x"), names


class IForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over a vector column; parameters by keyword, e.g. `IForest(numTrees=50, contamination=0.05)`."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, df: DataFrame) -> IForestModel:
        c = self.getFeaturesCol()
        require(df, **{c: "vector"})
        x = F.col(c) if dict(df.dtypes)[c] == "array<double>" else vector_to_array(c)
        size = df.select(F.size(x)).first()
        wide, names = self._wide(df, size[0] if size else 0)
        g = self.getOrDefault
        forest = IsolationForest(g("numTrees"), g("maxSamples"), g("maxFeatures"), g("maxDepth"), g("contamination"), g("bootstrap"), g("seed"), g("approxQuantileRelativeError"))
        model = IForestModel(forest.fit(wide, names))
        self._copyValues(model)
        return model._set(size=len(names))


class IForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Adds the score and the prediction (1.0 for an anomaly) to a table."""

    def __init__(self, forest: IsolationForestModel | None = None) -> None:
        super().__init__()
        self.forest = forest

    def _transform(self, df: DataFrame) -> DataFrame:
        score, prediction = append_column(df, self.getOrDefault("anomalyScoreCol")), append_column(df, self.getPredictionCol())
        wide, names = self._wide(df, self.getOrDefault("size"))
        return self.forest.transform(wide).drop(*names).withColumnsRenamed({"anomaly_score": score, "prediction": prediction}) if "anomaly_score" not in df.columns else self._kept(df)

    def _kept(self, df: DataFrame) -> DataFrame:
        """For tables that have a column `anomaly_score` of their own."""
        held = df.withColumnRenamed("anomaly_score", "__held")
        return self._transform(held).withColumnRenamed("__held", "anomaly_score")

    def summary(self, df: DataFrame) -> DataFrame:
        """(anomalies, rows)"""
        return self.forest.summary(self._wide(df, self.getOrDefault("size"))[0])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: IForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.forest.save(f"{path}/forest")


class _Reader(MLReader):
    def load(self, path: str) -> IForestModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = IForestModel(IsolationForestModel.load(spark, f"{path}/forest"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
