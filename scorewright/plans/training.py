"""Training, scoring and explaining the two classifiers with Spark ML."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.labels import at_threshold
from scorewright.operators.features import class_weights
from scorewright.plans.forest import Forest, forest_probability, grow_forest
from scorewright.schemas import MODEL_INPUTS
from scorewright.sources.runlog import log_rows

FOREST, LOGISTIC = "rf", "logreg"
TREES = 100
# Room for the split statistics of one pass: enough for a whole level of all trees.
LEVEL_MEGABYTES = 1_024
LOGISTIC_ITERATIONS = 1_000


def _given(name: str) -> Column:
    """An input of a model; what is missing or infinite counts as 0, when fitted and scored."""
    value = F.col(name).cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def weighted(train: DataFrame) -> tuple[DataFrame, int]:
    """Inputs, label and balanced class weight; and the number of rows.

    There is one weight per class, so they go into the plan as constants.
    """
    weights = class_weights(train).collect()
    weight = F.lit(None).cast("double")
    for row in weights:
        weight = F.when(F.col("label") == row["label"], row["weight"]).otherwise(weight)
    inputs = [_given(c).alias(c) for c in MODEL_INPUTS]
    rows = train.select(*inputs, F.col("label").cast("double").alias("label"))
    return rows.withColumn("weight", weight), sum(r["n"] for r in weights)


def train_model(
    train: DataFrame, model_type: str = FOREST, seed: int = 42, tree_depth: int | None = None
) -> PipelineModel | Forest:
    """Scale the inputs and fit a balanced classifier.

    A forest's trees grow until their leaves are pure; it needs no scaling and stays in
    tables.  With ``tree_depth`` they end there, and Spark ML's forest, which the driver
    holds, is fitted.  Its rows, and those of the logistic fit, are cached for the passes
    of the fit; a lost executor only means that its part is computed again.
    """
    if model_type not in (FOREST, LOGISTIC):
        raise ValueError(f"model_type must be '{FOREST}' or '{LOGISTIC}'")
    rows, count = weighted(train)
    if model_type == FOREST and tree_depth is None:
        return grow_forest(rows, MODEL_INPUTS, trees=TREES, seed=seed)
    if model_type == FOREST:
        classifier = RandomForestClassifier(
            featuresCol="inputs",
            weightCol="weight",
            numTrees=TREES,
            maxDepth=tree_depth,
            featureSubsetStrategy="sqrt",
            cacheNodeIds=True,
            maxMemoryInMB=LEVEL_MEGABYTES,
            seed=seed,
        )
    else:
        # The balanced weights sum to the row count; the loss is an average, so
        # this strength equals a penalty of one half of the squared norm.
        classifier = LogisticRegression(
            featuresCol="inputs",
            weightCol="weight",
            maxIter=LOGISTIC_ITERATIONS,
            standardization=False,
            regParam=1.0 / max(count, 1),
            elasticNetParam=0.0,
        )
    stages = [
        VectorAssembler(inputCols=MODEL_INPUTS, outputCol="raw_inputs"),
        StandardScaler(inputCol="raw_inputs", outputCol="inputs", withMean=True, withStd=True),
        classifier,
    ]
    rows = rows.cache()
    try:
        return Pipeline(stages=stages).fit(rows)
    finally:
        rows.unpersist()


def score(model: PipelineModel | Forest, df: DataFrame) -> DataFrame:
    """Add the probability of class 1 and the predicted class to every row."""
    rows = df.select(F.struct(*df.columns).alias("row"), *[_given(c).alias(c) for c in MODEL_INPUTS])
    if isinstance(model, Forest):
        scored = forest_probability(model, rows).select("row.*", "predicted_prob")
        return scored.withColumn("predicted_label", at_threshold(F.col("predicted_prob")))
    return model.transform(rows).select(
        "row.*", vector_to_array("probability").getItem(1).alias("predicted_prob")
    ).withColumn("predicted_label", at_threshold(F.col("predicted_prob")))


def score_to_log(
    model: PipelineModel | Forest,
    df: DataFrame,
    model_name: str,
    prompt_variant: str | None = None,
    timestamp: Column | None = None,
) -> DataFrame:
    """Log rows of one classifier run."""
    variant = None if prompt_variant is None else F.lit(prompt_variant)
    return log_rows(score(model, df), F.lit(model_name), variant, timestamp=timestamp)


def scoring_stats(model: PipelineModel | Forest, df: DataFrame, model_name: str) -> DataFrame:
    """Measured seconds per row of scoring ``df``."""
    # The sum needs every probability, so none of the scoring is optimised away.
    total = score(model, df).agg(
        F.count("predicted_prob").alias("n"), F.sum("predicted_prob").alias("s")
    )
    start = time.perf_counter()
    rows = total.first()["n"]
    seconds = time.perf_counter() - start
    return df.sparkSession.createDataFrame(
        [(model_name, rows, seconds / rows if rows else None)],
        "model_name string, n long, latency_per_tx double",
    )


def feature_importance(
    spark: SparkSession, model: PipelineModel | Forest, top_k: int = 10
) -> DataFrame:
    """Inputs by importance; a classifier without any gives no rows."""
    if isinstance(model, Forest):
        return model.importances().orderBy(F.desc("importance"), "feature").limit(top_k)
    classifier = model.stages[-1]
    if hasattr(classifier, "featureImportances"):
        values = classifier.featureImportances.toArray()
    elif hasattr(classifier, "coefficients"):
        values = abs(classifier.coefficients.toArray())
    else:
        values = []
    rows = [(name, float(v)) for name, v in zip(MODEL_INPUTS, values)]
    importances = spark.createDataFrame(rows, "feature string, importance double")
    return importances.orderBy(F.desc("importance"), "feature").limit(top_k)


def save(model: PipelineModel | Forest, path: str) -> None:
    if isinstance(model, Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | Forest:
    spark = SparkSession.active()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/cells")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return Forest(spark, path, MODEL_INPUTS)
    return PipelineModel.load(path)
