"""Classification metrics and histograms from scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Class names, positive weight, number of bins.
CLASS_NAMES = ("no heat", "heat")
POSITIVE_WEIGHT = 250.0
BINS = 50


def _rows(condition: Column, weight: str | None) -> Column:
    """Number of rows, or sum of their weights, where the condition holds."""
    return F.coalesce(F.sum(F.when(condition, F.col(weight) if weight else F.lit(1))), F.lit(0)).cast("long")


def confusion(df: DataFrame, truth: str = "y", predicted: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Counts for all four cells, zero where no row falls, and the share within the true class.

    ``weight`` names a count column when ``df`` is already counted.
    """
    cells = [
        _rows((F.col(truth) == y) & (F.col(predicted) == p), weight).alias(f"n{y}{p}")
        for y in (0, 1)
        for p in (0, 1)
    ]
    rows = [
        F.struct(F.lit(y).alias("y"), F.lit(p).alias("y_pred"), F.col(f"n{y}{p}").alias("n"))
        for y in (0, 1)
        for p in (0, 1)
    ]
    by_class = Window.partitionBy("y")
    return (
        df.agg(*cells)
        .select(F.inline(F.array(*rows)))
        .withColumn("share", F.try_divide("n", F.sum("n").over(by_class)))
    )


def report(df: DataFrame, truth: str = "y", predicted: str = "y_pred", weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages; 0/0 is 0."""

    def ratio(over, under):
        return F.coalesce(F.try_divide(over, under), F.lit(0.0))

    y, p = F.col(truth), F.col(predicted)
    counts = df.agg(
        *[_rows((y == k) & (p == k), weight).alias(f"hit{k}") for k in (0, 1)],
        *[_rows(y == k, weight).alias(f"true{k}") for k in (0, 1)],
        *[_rows(p == k, weight).alias(f"said{k}") for k in (0, 1)],
        _rows(F.lit(True), weight).alias("rows"),
    )
    scores = counts
    for k in (0, 1):
        scores = scores.withColumns(
            {
                f"precision{k}": ratio(F.col(f"hit{k}"), F.col(f"said{k}")),
                f"recall{k}": ratio(F.col(f"hit{k}"), F.col(f"true{k}")),
            }
        ).withColumn(
            f"f1{k}",
            ratio(
                2 * F.col(f"precision{k}") * F.col(f"recall{k}"), F.col(f"precision{k}") + F.col(f"recall{k}")
            ),
        )
    accuracy = ratio(F.col("hit0") + F.col("hit1"), F.col("rows"))

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def averaged(name, weight0, weight1):
        mean = [weight0 * F.col(f"{m}0") + weight1 * F.col(f"{m}1") for m in ("precision", "recall", "f1")]
        return line(name, *mean, F.col("rows"))

    lines = [
        line(CLASS_NAMES[k], F.col(f"precision{k}"), F.col(f"recall{k}"), F.col(f"f1{k}"), F.col(f"true{k}"))
        for k in (0, 1)
    ]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, F.col("rows")))
    lines.append(averaged("macro avg", F.lit(0.5), F.lit(0.5)))
    lines.append(
        averaged("weighted avg", ratio(F.col("true0"), F.col("rows")), ratio(F.col("true1"), F.col("rows")))
    )
    return scores.select(F.inline(F.array(*lines)))


def accuracy(df: DataFrame, truth: str = "y", predicted: str = "y_pred") -> DataFrame:
    """Whole percent of right rows: all, truly positive, truly negative; null where a class is absent."""
    right = (F.col(truth) == F.col(predicted)).cast("int")
    positive = F.col(truth) > 0.5

    def percent(condition):
        share = F.avg(F.when(condition, right)) if condition is not None else F.avg(right)
        return F.bround(100 * share, 0).cast("int")

    return df.agg(
        percent(None).alias("accuracy"),
        percent(positive).alias("accuracy_positive"),
        percent(~positive).alias("accuracy_negative"),
    )


def cross_entropy(
    df: DataFrame, truth: str = "y", logit: str = "logit", positive_weight: float = POSITIVE_WEIGHT
) -> DataFrame:
    """Mean weighted cross entropy from logits, in the form that does not overflow."""
    x, y = F.col(logit), F.col(truth)
    weight = 1 + (positive_weight - 1) * y
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return df.agg(F.avg((1 - y) * x + weight * soft).alias("loss"))


def plain_cross_entropy(df: DataFrame, truth: str = "y", probability: str = "probability") -> DataFrame:
    """Mean cross entropy from probabilities, each logarithm bounded below by -100."""
    p, y = F.col(probability), F.col(truth)
    bounded = lambda value: F.when(value > 0, F.greatest(F.ln(value), F.lit(-100.0))).otherwise(F.lit(-100.0))
    return df.agg(F.avg(-(y * bounded(p) + (1 - y) * bounded(1 - p))).alias("loss"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last one is closed.

    The range enters as a scalar subquery. All bins are returned, empty ones with 0. NaN and infinite
    values count as missing.
    """
    number = F.col(column).cast("double")
    value = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
    limits = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    values = df.where(value.isNotNull()).select(value.alias("_value"), limits.alias("_limits"))
    low, width = F.col("_limits.low"), (F.col("_limits.high") - F.col("_limits.low")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_value") - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = values.groupBy((place + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    # Never more rows than bins on either side.
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def animals_per_organisation(organisations: DataFrame, animals: DataFrame) -> DataFrame:
    """Animal count of every organisation, also of empty ones; counted before the join."""
    counts = animals.groupBy("organisation_id").agg(F.count("animal_id").alias("animals"))
    return organisations.join(counts, "organisation_id", "left").withColumn(
        "animals", F.coalesce("animals", F.lit(0))
    )


def any_label(df: DataFrame, keys=("organisation_id", "animal_id")) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(F.col("pregnant") | F.col("cyclic") | F.col("inseminated")).alias("has_heat"))
