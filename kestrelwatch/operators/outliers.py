"""Hours with far more failures than expected: features, models, and the outlier rule."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = {"linear": LinearRegressionModel, "logistic": PipelineModel, "forest": RandomForestRegressionModel}
# Fixed values of the deployed models.
MAX_ITER, REG_PARAM = 20, 0.001


def fit_features(counts: DataFrame, invalid: str = "error") -> PipelineModel:
    """One-hot hour and weekday. ``invalid="keep"`` gives hours and days not seen in training a slot of their own
    instead of failing on them."""
    stages = [
        OneHotEncoder(inputCols=["hour"], outputCols=["hourVec"], handleInvalid=invalid),
        StringIndexer(inputCol="day", outputCol="dayCat", handleInvalid=invalid),
        OneHotEncoder(inputCols=["dayCat"], outputCols=["dayVec"], handleInvalid=invalid),
    ]
    return Pipeline(stages=stages).fit(counts)


def add_features(counts: DataFrame, features: PipelineModel) -> DataFrame:
    return VectorAssembler(inputCols=["hourVec", "dayVec"], outputCol="features").transform(features.transform(counts))


def fit_model(training: DataFrame, kind: str = "logistic", reg_param: float = REG_PARAM):
    """``linear``, ``forest``, or ``logistic``, which takes every count that occurs as a class of its own. Classes are numbered
    by rank, so that their number is that of the distinct counts whatever their height."""
    columns = {"featuresCol": "features", "labelCol": "count"}
    if kind == "logistic":
        found = [r["count"] for r in training.select("count").distinct().orderBy("count").collect()]
        rank = training.sparkSession.createDataFrame([(n, float(i)) for i, n in enumerate(found)], "count long, class double")
        ranked = training.join(rank, "count").select("features", "class")
        model = LogisticRegression(maxIter=MAX_ITER, regParam=reg_param, featuresCol="features", labelCol="class", predictionCol="rank").fit(ranked)
        # The way back: the count of the class that was predicted, as text, and that as a number.
        back = IndexToString(inputCol="rank", outputCol="counted", labels=[str(n) for n in found])
        return PipelineModel([model, back, SQLTransformer(statement="SELECT *, CAST(counted AS DOUBLE) AS prediction FROM __THIS__")])
    if kind == "linear":
        return LinearRegression(maxIter=MAX_ITER, regParam=reg_param, **columns).fit(training)
    if kind == "forest":
        return RandomForestRegressor(seed=0, **columns).fit(training)
    raise ValueError(f"unknown model {kind!r}; use one of {sorted(MODELS)}")


def train(counts: DataFrame, kind: str = "logistic", invalid: str = "error", reg_param: float = REG_PARAM):
    """Fit features and a model on hourly counts (``training_counts``). The counts, one row per hour and operation,
    are cached while the algorithms pass over them."""
    counts = counts.select("day", "hour", "count").persist()
    try:
        features = fit_features(counts, invalid)
        return features, fit_model(add_features(counts, features).select("features", "count"), kind, reg_param)
    finally:
        counts.unpersist()


def save_models(features: PipelineModel, model, path: str) -> None:
    features.write().overwrite().save(f"{path}/features")
    model.write().overwrite().save(f"{path}/model")


def load_models(path: str, kind: str = "logistic"):
    return PipelineModel.load(f"{path}/features"), MODELS[kind].load(f"{path}/model")


def predict(counts: DataFrame, features: PipelineModel, model) -> DataFrame:
    """Add ``prediction`` to rows with ``day`` and ``hour``; on a table or a stream."""
    kept = counts.columns
    return model.transform(add_features(counts, features)).select(*kept, "prediction")


def errors(counts: DataFrame, features: PipelineModel, model) -> DataFrame:
    """One row: mean absolute error, root mean squared error and the number of rows."""
    residual = F.col("count") - F.col("prediction")
    return predict(counts, features, model).agg(
        F.avg(F.abs(residual)).alias("mean_absolute_error"),
        F.sqrt(F.avg(residual * residual)).alias("root_mean_squared_error"),
        F.count(F.lit(1)).alias("rows"),
    )


def residuals(counts: DataFrame, features: PipelineModel, model) -> DataFrame:
    return predict(counts, features, model).withColumn("residuals", F.col("count") - F.col("prediction"))


def outliers(scored: DataFrame, factor: float = 2, floor: int = 10) -> DataFrame:
    """Rows whose count is above ``factor`` times the prediction and above ``floor``."""
    return scored.filter((F.col("count") > F.col("prediction") * factor) & (F.col("count") > floor))


def mean_per_hour_of_week(counts: DataFrame) -> DataFrame:
    """A model without training: the mean count of the same weekday and hour, at most 7 x 24 rows."""
    return counts.groupBy("day", "hour").agg(F.avg("count").alias("prediction"))


def predict_mean(counts: DataFrame, means: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(means), ["day", "hour"], "left").select(*counts.columns, "prediction")
