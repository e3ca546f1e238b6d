"""Classifiers on Spark ML: training, weighting, scoring, persistence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from herdsignal.functions.numbers import class_tag
from herdsignal.operators.metrics import POSITIVE_WEIGHT
from herdsignal.session import cut

# Boosting rounds and tree depth.
ROUNDS = 10
DEPTH = 6


def class_weight(df: DataFrame, label: str = "annotation", positive: float = POSITIVE_WEIGHT) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(1.0)))


def _whole(values: Column) -> Column:
    """Whether an array of doubles has neither null nor NaN: flat, whatever the number of features, and compiled.

    ``array_contains`` is null where the array, or one of the values that are not NaN, is.
    """
    return F.coalesce(~F.array_contains(values, F.lit(float("nan"))), F.lit(False))


def _fit(df: DataFrame, features: Sequence[str] | str, make: Callable[[int], Estimator]) -> PipelineModel:
    """Every iteration reads the rows again, so they are computed once and written out.

    ``features`` are number columns, or one array column with all of them; ``make`` is told how many there are.
    Rows that lack a feature or the label teach nothing; ``score`` returns them without a probability.
    """
    if isinstance(features, str):
        used = _used(make(1))
        values = F.col(features).cast("array<double>")
        rows = cut(df.where(_whole(values)).na.drop(subset=used).select(array_to_vector(values).alias(features), *used))
        first = rows.first()
        return PipelineModel([make(len(first[features]) if first else 0).setFeaturesCol(features).fit(rows)])
    estimator = make(len(features))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    whole = df.where(_whole(F.array(*[F.col(name).cast("double") for name in features]))).na.drop(subset=_used(estimator))
    rows = cut(assembler.transform(whole).select("features", *_used(estimator)))
    return PipelineModel([assembler, estimator.fit(rows)])


def _used(estimator) -> list[str]:
    """Label column and, where one is set, weight column."""
    weighted = estimator.hasParam("weightCol") and estimator.isSet("weightCol")
    return [estimator.getLabelCol(), *([estimator.getWeightCol()] if weighted else [])]


def train_trees(
    df: DataFrame,
    features: Sequence[str] | str,
    label: str = "annotation",
    weight: str | None = None,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    seed: int = 42,
) -> PipelineModel:
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed)
    return _fit(df, features, lambda width: trees.setWeightCol(weight) if weight else trees)


def train_network(
    df: DataFrame,
    features: Sequence[str] | str,
    label: str = "annotation",
    hidden: Sequence[int] = (16,),
    iterations: int = 20,
    seed: int = 42,
) -> PipelineModel:
    """Feed-forward network; inputs should be scaled."""
    network = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", maxIter=iterations, seed=seed)
    return _fit(df, features, lambda width: network.setLayers([width, *hidden, 2]))


def train_weighted(
    df: DataFrame, features: Sequence[str] | str, label: str = "annotation", positive: float = POSITIVE_WEIGHT
) -> PipelineModel:
    """Logistic regression with heavier positive rows."""
    regression = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=20)
    return _fit(class_weight(df, label, positive), features, lambda width: regression)


def score(model: PipelineModel, df: DataFrame, label: str = "annotation", keep: Sequence[str] = ()) -> DataFrame:
    """Every row with truth ``y``, ``probability`` of heat and class ``y_pred``; both null where a feature is missing."""
    first = model.stages[0]
    if isinstance(first, VectorAssembler):
        features = first.getInputCols()
        values = F.array(*[F.col(name).cast("double") for name in features])
        whole = _whole(values)
    else:
        values = F.col(first.getFeaturesCol()).cast("array<double>")
        whole = _whole(values) & (F.size(values) == first.numFeatures)
    # Asked once for a row.
    kept = F.struct(*keep, F.col(label).cast("int").alias("y"), whole.alias("whole")).alias("_kept")
    placed = df.select(kept, values.alias("_values"))
    if isinstance(first, VectorAssembler):
        inputs = [F.when(F.col("_kept.whole"), F.get("_values", F.lit(i))).otherwise(F.lit(0.0)).alias(name) for i, name in enumerate(features)]
    else:
        blank = F.array_repeat(F.lit(0.0), first.numFeatures)
        inputs = [array_to_vector(F.when(F.col("_kept.whole"), F.col("_values")).otherwise(blank)).alias(first.getFeaturesCol())]
    filled = placed.select("_kept", *inputs)
    probability = F.when(F.col("_kept.whole"), vector_to_array("probability")[1])
    scored = model.transform(filled).select("_kept.*", probability.alias("probability")).drop("whole")
    return scored.withColumn("y_pred", F.when(F.col("probability").isNotNull(), class_tag(F.col("probability"))))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
