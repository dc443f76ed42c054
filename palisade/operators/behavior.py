"""Behaviour models over window features: forest and votes."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.forest import Forest, grow
from palisade.plans.stage import checkpointed

# Forest parameters
TREES, DEPTH, SHARE, LEAF = 100, 10, 0.7, 2
MIN_ROWS, MIN_CLASSES = 50, 2
#: MB of node histograms that each running task holds; a smaller share takes more passes over the rows. Nodes
#: try all features, so the trees do not depend on it.
HISTOGRAM_MB = 128


def behavior_label(provider, dport):
    """Training label of a window: provider, else GenericHttps on port 443, else Unknown."""
    return F.coalesce(provider, F.when(dport == 443, "GenericHttps"), F.lit("Unknown"))


def train_behavior_model(vectors: DataFrame, label="label", features="features", trees=TREES, seed=7, histogram_mb=HISTOGRAM_MB):
    """(StringIndexerModel, forest) on array features; None below 50 rows or two classes."""
    rows = checkpointed(vectors.select(F.col(label).alias("label"), array_to_vector(F.col(features)).alias("vector")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("classes")).first()
    if size.n < MIN_ROWS or size.classes < MIN_CLASSES:
        return None
    labels = StringIndexer(inputCol="label", outputCol="class", stringOrderType="alphabetAsc").fit(rows)
    known = labels.transform(rows).select("class", vector_to_array("vector").alias("features"))
    return labels, grow(known, len(labels.labels), size.n, trees, DEPTH, SHARE, LEAF, seed, histogram_mb)


def _nodes(forest: Forest | RandomForestClassificationModel, folder: str) -> list[dict]:
    """Trees as arrays (feature, threshold, left, right, class); at most trees * 2**11 nodes."""
    if isinstance(forest, Forest):
        return forest.trees
    path = f"{folder}/forest-{forest.uid}"
    forest.write().overwrite().save(path)
    data = forest_session(forest).read.parquet(f"{path}/data")
    n = "nodeData" if "nodeData" in data.columns else None
    at = lambda f: F.col(f"{n}.{f}" if n else f)
    rows = data.select(
        "treeID", at("id").alias("id"), at("prediction").alias("prediction"), at("leftChild").alias("left"),
        at("rightChild").alias("right"), at("split.featureIndex").alias("feature"),
        F.get(at("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
    ).toPandas()
    trees = []
    for _, t in rows.sort_values(["treeID", "id"]).groupby("treeID"):
        trees.append({c: t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "prediction")})
    return trees


def forest_session(forest):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _votes(trees, x: np.ndarray, classes: int) -> np.ndarray:
    counts = np.zeros((len(x), classes))
    everyone = np.arange(len(x))
    for t in trees:
        node = np.zeros(len(x), dtype=np.int64)
        inner = t["left"][node] >= 0
        while inner.any():
            rows, at = everyone[inner], node[inner]
            low = x[rows, t["feature"][at]] <= t["threshold"][at]
            node[rows] = np.where(low, t["left"][at], t["right"][at])
            inner = t["left"][node] >= 0
        counts[everyone, t["prediction"][node].astype(int)] += 1
    return counts


def predict_behavior(vectors: DataFrame, model, folder: str, features="features", known="known_provider") -> DataFrame:
    """Add predicted label, confidence (share of agreeing trees), behavior_class and is_novel.

    Without a model (too few rows to train one) every row is Unknown with confidence 0."""
    if model is None:
        unknown = F.lit("Unknown")
        return vectors.withColumns({"predicted": unknown, "confidence": F.lit(0.0), "behavior_class": unknown, "is_novel": F.lit(False)})
    labels: StringIndexerModel = model[0]
    return vote_behavior(vectors, _nodes(model[1], folder), list(labels.labels), features, known)


def vote_behavior(vectors: DataFrame, forest: list[dict], names: list[str], features="features", known="known_provider") -> DataFrame:
    """Hard votes of the trees, given as arrays feature, threshold, left, right (-1: leaf) and
    prediction (place in names); a row goes left where its feature is at most the threshold.
    Ties go to the first name. A forest has at most TREES * 2 ** (DEPTH + 1) nodes."""
    trees = vectors.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("predicted string, confidence double")
    def vote(x: pd.Series) -> pd.DataFrame:
        counts = _votes(trees.value, np.stack(x.to_numpy()), len(names))
        best = counts.argmax(axis=1)
        share = counts.max(axis=1) / counts.sum(axis=1)
        return pd.DataFrame({"predicted": [names[i] for i in best], "confidence": share})

    rows = vectors.withColumn("_p", vote(F.col(features)))
    predicted = F.col("predicted")
    generic = predicted.isin("GenericHttps", "Unknown")
    return (
        rows.withColumn("predicted", F.col("_p.predicted"))
        .withColumn("confidence", F.col("_p.confidence"))
        .withColumn("behavior_class", F.when(generic, predicted).otherwise(F.concat(F.lit("LlmApi("), predicted, F.lit(")"))))
        .withColumn("is_novel", F.col(known).isNull() & ~generic)
        .drop("_p")
    )
