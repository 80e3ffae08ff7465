"""A treatment classifier: weighted word and pair counts of a window, class-balanced logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of hashed words, and the most labelled rows that a model is fitted on.
FEATURES, FIT_ROWS = 1 << 16, 50_000


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> PipelineModel:
    """Fit on (window, label): at most ``fit_rows`` labelled rows in hash order, each class weighing the same."""
    kept = rows.filter("window is not null and label is not null").orderBy(F.xxhash64("window", "label")).limit(fit_rows)
    n = Window.partitionBy("label")
    weighed = kept.withColumn("weight", 1.0 / F.count(F.lit(1)).over(n))
    stages = [
        StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="window", outputCol="words", pattern=r"[^a-z0-9]+"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=FEATURES),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=FEATURES),
        IDF(inputCol="tf1", outputCol="x1"),
        IDF(inputCol="tf2", outputCol="x2"),
        VectorAssembler(inputCols=["x1", "x2"], outputCol="x"),
    ]
    prepared = Pipeline(stages=stages).fit(weighed)
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=30, regParam=0.01).fit(prepared.transform(weighed))
    labels = prepared.stages[0].labels
    return PipelineModel([*prepared.stages[1:], model, IndexToString(inputCol="prediction", outputCol="pred", labels=labels + ["__other"])])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``pred`` and its probability; NULL windows are read as empty."""
    out = model.transform(rows.withColumn("window", F.coalesce("window", F.lit(""))))
    return out.withColumn("probability", F.array_max(vector_to_array("probability"))).drop("words", "pairs", "tf1", "tf2", "x1", "x2", "x", "rawPrediction", "prediction")


def cross_validated(rows: DataFrame, folds: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every labelled window with the label that a model fitted on the other folds predicts.

    Folds are by the window's hash, so equal windows are never on both sides.
    Rows without a window or label are left out; a fold whose others are empty
    predicts nothing.
    """
    if folds < 2:
        raise ValueError("two folds at least")
    known = rows.filter("window is not null and label is not null").withColumn("fold", F.pmod(F.xxhash64("window"), F.lit(folds)).cast("int"))
    out = None
    for i in range(folds):
        rest = known.filter(F.col("fold") != i)
        if rest.limit(1).count():
            part = predict(fit(rest, fit_rows), known.filter(F.col("fold") == i)).select(*known.columns, "pred")
            out = part if out is None else out.unionByName(part)
    return known.limit(0).withColumn("pred", F.lit(None).cast("string")) if out is None else out
