"""Fitted models: the transaction model, the pattern classifier and the case calibrator."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import logit
from ..params import DEFAULT, Params
from .features import label_table, model_columns
from .memory import FEATURES


def prepare(features: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Model input: categories as text with ``NA`` for null, numbers with a missing flag and a fill value."""
    cats, nums = model_columns(features)
    out = features.withColumns({f"c_{c}": F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cats})
    filled = {}
    for c in nums:
        v = F.col(c).cast("double")
        filled[f"x_{c}"] = F.coalesce(v, F.lit(-1.0))
        filled[f"m_{c}"] = v.isNull().cast("double")
    return out.withColumns(filled), [f"c_{c}" for c in cats], list(filled)


def txn_pipeline(cats: list[str], nums: list[str], iterations: int = 40, depth: int = 5, seed: int = 0) -> Pipeline:
    """Categories unseen in training share one extra index; the trees treat indices as categories."""
    index = StringIndexer(inputCols=cats, outputCols=[f"i_{c}" for c in cats], handleInvalid="keep")
    assemble = VectorAssembler(inputCols=[f"i_{c}" for c in cats] + nums, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=0.1, maxBins=64,
                          seed=seed, checkpointInterval=-1)
    return Pipeline(stages=[index, assemble, trees])


def train_txn_model(features: DataFrame, train_before: int, **kw) -> PipelineModel:
    data, cats, nums = prepare(features)
    return txn_pipeline(cats, nums, **kw).fit(data.filter(F.col("us") < train_before).select("y", *cats, *nums))


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """All input columns and ``p_txn``."""
    data, _, _ = prepare(features.drop("p_txn"))
    out = model.transform(data)
    return out.select(*[c for c in features.columns if c != "p_txn"], F.get(vector_to_array("probability"), F.lit(1)).alias("p_txn"))


def split_counts(ledger: DataFrame, closed: DataFrame, members: DataFrame, split: int, end: int) -> DataFrame:
    """Rows and positives of the time-split arms: training labels are limited to cases opened before the split."""
    early = label_table(closed, members, opened_before=split).select("TransactionID", F.lit(1).alias("y_train"))
    every = label_table(closed, members).select("TransactionID", F.lit(1).alias("y_valid"))
    j = ledger.select("TransactionID", "us").join(early, "TransactionID", "left").join(every, "TransactionID", "left")
    train, valid = F.col("us") < split, (F.col("us") >= split) & (F.col("us") < end)
    return j.agg(F.count_if(train).alias("n_train"), F.count_if(valid).alias("n_valid"),
                 F.count_if(train & F.col("y_train").isNotNull()).alias("n_train_pos"),
                 F.count_if(valid & F.col("y_valid").isNotNull()).alias("n_valid_pos"))


def train_pattern_model(index: DataFrame, trees: int = 40, depth: int = 8, seed: int = 0) -> PipelineModel:
    """Multiclass pattern model over episode features; classes weigh the same in total."""
    data = index.filter(F.col("outcome") == "confirmed_fraud")
    sizes = data.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k")).first()
    data = data.join(sizes, "pattern").withColumn("weight", F.lit(float(total["_t"])) / (F.lit(float(total["_k"])) * F.col("_n")))
    label = StringIndexer(inputCol="pattern", outputCol="label", stringOrderType="alphabetAsc")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[label, assemble, forest]).fit(data.select("pattern", "weight", *FEATURES))


def pattern_probabilities(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``case_id`` and ``pattern_p``: map of class name to probability."""
    labels = model.stages[0].labels
    scored = model.stages[2].transform(model.stages[1].transform(features))
    names = F.array(*[F.lit(x) for x in labels])
    return scored.select("case_id", F.map_from_arrays(names, vector_to_array("probability")).alias("pattern_p"))


def train_calibrator(cases: DataFrame, params: Params = DEFAULT) -> dict:
    """Logistic fit on ``p_flag, p_max, n_members, known_uid`` against ``y``; returns parameter overrides."""
    x = cases.select("y", logit(F.col("p_flag")).alias("a"), logit(F.col("p_max")).alias("b"),
                     F.log1p(F.col("n_members").cast("double")).alias("c"), (F.col("known_uid") > 0).cast("double").alias("d"))
    data = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(x).persist()
    n, prior = data.agg(F.count(F.lit(1)), F.avg("y")).first()
    fit = LogisticRegression(labelCol="y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    data.unpersist()
    return {"cal_weights": tuple(float(w) for w in fit.coefficients), "cal_intercept": float(fit.intercept), "train_prior": float(prior)}
