"""Reranking by gradient-boosted trees: training sample, seed ensemble, variants by feature group, and the first k."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features, split, topk

SEEDS = (13, 1, 2, 3, 4)
#: Of a model: trees, their depth, the step, the least rows of a leaf and the share of rows that a tree sees.
TREES, DEPTH, STEP, LEAF, ROWS = 100, 6, 0.05, 100, 0.8


def variants(groups: dict[str, list[str]], without: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    """The columns of each variant: all groups but those it goes without."""
    return {name: [c for g, columns in groups.items() if g not in left_out for c in columns] for name, left_out in without.items()}


#: All features; without the query's history; without the cheap blocks.
VARIANTS = variants(features.GROUPS, {"all": (), "no_history": ("hist",), "no_cheap": ("price", "intent", "modifier", "toponym", "online", "flags", "twins", "text_len", "cat0")})


def sample(rows: DataFrame, query: str, item: str, label: str, n: int = 100, seed: int = 13) -> DataFrame:
    """What a model learns from: queries with a true candidate, all of these and the n others that are first by hash."""
    return split.negatives(rows, query, item, label, n, seed, need_positive=True)


def train(rows: DataFrame, columns: list[str], label: str, seeds: tuple[int, ...] = SEEDS, trees: int = TREES, leaf: int = LEAF) -> list[PipelineModel]:
    """A model for each seed.  Missing values are a number of their own and a flag, as trees here know no nulls."""
    ready = features.sentinels(rows.select(label, *columns), columns).withColumn(label, F.col(label).cast("double"))
    wide = [*columns, *(f"{c}_missing" for c in columns)]
    out = []
    for seed in seeds:
        gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=leaf, subsamplingRate=ROWS, featureSubsetStrategy="0.8", seed=seed)
        out.append(Pipeline(stages=[VectorAssembler(inputCols=wide, outputCol="features"), gbt]).fit(ready))
    return out


def score(rows: DataFrame, models: list[PipelineModel], columns: list[str], query: str, item: str, digits: int = 9) -> DataFrame:
    """``query, item, score``: the mean of the models' probabilities."""
    out = features.sentinels(rows.select(query, item, *columns), columns)
    keep = [query, item]
    for i, model in enumerate(models):
        name = f"__p{i}"
        out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        keep.append(name)
    mean = reduce(Column.__add__, [F.col(c) for c in keep[2:]]) / len(models)
    return out.select(query, item, F.round(mean, digits).alias("score"))


def rerank(rows: DataFrame, models: list[PipelineModel], columns: list[str], query: str, item: str, k: int = 50) -> DataFrame:
    """``query, item, score, rank``: the k candidates with the largest score."""
    return topk.top_k(score(rows, models, columns, query, item), query, "score", item, k)


def save(models: list[PipelineModel], path: str) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path.rstrip('/')}/{i}")


def load(spark: SparkSession, path: str, n: int = len(SEEDS)) -> list[PipelineModel]:
    return [PipelineModel.read().session(spark).load(f"{path.rstrip('/')}/{i}") for i in range(n)]
