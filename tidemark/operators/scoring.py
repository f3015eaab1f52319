"""Fitting the three model families and scoring tables with them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel, StandardScaler, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scores import predicted
from tidemark.operators import boosting
from tidemark.operators.prepare import preparation_stages, prepared_columns, slot_names
from tidemark.roles import FeatureGroups, Roles
from tidemark.session import shared_folder, stored


# The settings that the three families are compared with.
@dataclass(frozen=True)
class LogisticConfig:
    max_iter: int = 1000
    c: float = 1.0
    class_weight: str | dict | None = None


@dataclass(frozen=True)
class BoostedTreesConfig:
    n_trees: int = 300
    learning_rate: float = 0.05
    max_depth: int = 6
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42


@dataclass(frozen=True)
class NeuralConfig:
    components: int = 64
    hidden: tuple[int, ...] = (32, 16)
    max_iter: int = 20
    seed: int = 42


@dataclass
class FittedModel:
    """A scorer with the names of its inputs and of its vector slots."""

    name: str
    groups: FeatureGroups
    pipeline: PipelineModel
    slots: list[str]

    @property
    def estimator(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame, column: str = "y_prob") -> DataFrame:
        """The table with the probability of class 1, and nothing else added."""
        scored = df
        for stage in self.pipeline.stages:
            scored = stage.transform(scored)
        probability = vector_to_array("probability").getItem(1)
        return scored.withColumn("__score", probability).select(
            *df.columns, F.col("__score").alias(column)
        )


def projection(directions: np.ndarray, source: str = "features", target: str = "reduced") -> PCAModel:
    """A saveable JVM stage that multiplies vectors by a fixed matrix (slots x components); sparse
    vectors stay sparse. The stage of principal components does just that, without centring, whatever
    matrix it holds."""
    slots, k = directions.shape
    context = SparkContext.getOrCreate()
    matrix = DenseMatrix(slots, k, directions.T.ravel().tolist())
    model = PCAModel(PCAModel._new_java_obj(
        "org.apache.spark.ml.feature.PCAModel", f"projection_{uuid.uuid4().hex[:12]}",
        _py2java(context, matrix), _py2java(context, Vectors.dense([0.0] * k))))
    return model._set(k=k).setInputCol(source).setOutputCol(target)


def _training_rows(train: DataFrame, groups: FeatureGroups, roles: Roles) -> DataFrame:
    groups.require()
    if roles.target not in train.columns:
        raise ValueError(f"the training table has no column '{roles.target}'")
    label = F.col(roles.target).cast("double").alias("label")
    return train.select(*groups.features, label)


def _prepared(train: DataFrame, groups: FeatureGroups, scale: bool):
    """Preparation model, and the training rows as written feature vectors."""
    stages = preparation_stages(train, groups.numeric, groups.categorical, scale)
    vectors = stages.transform(train)
    slots = slot_names(vectors)
    helpers = [*prepared_columns(groups.numeric, groups.categorical), *groups.features]
    return stages, stored(vectors.drop(*helpers)), slots


def fit_logistic(
    train: DataFrame,
    groups: FeatureGroups,
    roles: Roles = Roles(),
    config: LogisticConfig = LogisticConfig(),
    name: str = "logreg",
) -> FittedModel:
    """Logistic regression with a ridge penalty on scaled features."""
    rows = _training_rows(train, groups, roles)
    stages, vectors, slots = _prepared(rows, groups, scale=True)
    sizes = {r["label"]: r["count"] for r in vectors.groupBy("label").count().collect()}
    n = sum(sizes.values())
    weights = config.class_weight
    if weights == "balanced":
        weights = {label: n / (len(sizes) * size) for label, size in sizes.items()}
    total = float(n)
    options = {}
    if weights:
        weight = F.lit(1.0)
        for label, value in weights.items():
            weight = F.when(F.col("label") == float(label), F.lit(float(value))).otherwise(weight)
        vectors = vectors.withColumn("weight", weight)
        options["weightCol"] = "weight"
        given = {float(label): float(value) for label, value in weights.items()}
        total = sum(size * given.get(label, 1.0) for label, size in sizes.items())
    # the penalty weighs against the mean loss here, against the summed loss in ``c``
    model = LogisticRegression(
        maxIter=config.max_iter,
        regParam=1.0 / (config.c * total),
        elasticNetParam=0.0,
        standardization=False,
        **options,
    ).fit(vectors)
    return FittedModel(name, groups, PipelineModel([*stages.stages, model]), slots)


def fit_boosted_trees(
    train: DataFrame,
    groups: FeatureGroups,
    roles: Roles = Roles(),
    config: BoostedTreesConfig = BoostedTreesConfig(),
    name: str = "trees",
) -> FittedModel:
    """Gradient-boosted trees on unscaled features."""
    spark = train.sparkSession
    shared_folder(spark)
    rows = _training_rows(train, groups, roles)
    stages = preparation_stages(rows, groups.numeric, groups.categorical, scale=False)
    ready = stages.transform(rows)
    slots = slot_names(ready)
    numeric = [f"num__{c}" for c in groups.numeric]
    indexes = [f"index__{c}" for c in groups.categorical]
    sizes = [len(s.labels) for s in stages.stages if isinstance(s, StringIndexerModel)]
    narrow = stored(ready.select(*numeric, *[F.col(c).cast("int").alias(c) for c in indexes], "label"))
    columns, trees = boosting.grow(
        narrow, numeric, indexes, sizes, config.n_trees, config.learning_rate, config.max_depth,
        config.row_share, config.column_share, config.seed,
    )
    model = boosting.as_model(
        spark, columns, trees, config.learning_rate, config.max_depth, seed=config.seed,
        subsamplingRate=config.row_share, featureSubsetStrategy=str(config.column_share),
    )
    return FittedModel(name, groups, PipelineModel([*stages.stages, model]), slots)


def fit_mlp(
    train: DataFrame,
    groups: FeatureGroups,
    roles: Roles = Roles(),
    config: NeuralConfig = NeuralConfig(),
    name: str = "mlp",
) -> FittedModel:
    """A small neural network on the leading singular directions of the scaled features."""
    rows = _training_rows(train, groups, roles)
    stages, vectors, slots = _prepared(rows, groups, scale=True)
    k = min(config.components, len(slots))
    old = MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features")
    # the matrix of directions has one row per slot
    directions = RowMatrix(old).computeSVD(k).V.toArray()
    reduce = projection(directions)
    reduced = reduce.transform(vectors)
    scaler = StandardScaler(inputCol="reduced", outputCol="scaled", withMean=True).fit(reduced)
    model = MultilayerPerceptronClassifier(
        featuresCol="scaled",
        layers=[directions.shape[1], *config.hidden, 2],
        maxIter=config.max_iter,
        seed=config.seed,
    ).fit(scaler.transform(reduced).select("scaled", "label"))
    pipeline = PipelineModel([*stages.stages, reduce, scaler, model])
    return FittedModel(name, groups, pipeline, slots)


def predict_label(model: FittedModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = model.score(df)
    return scored.withColumn("y_pred", predicted(F.col("y_prob"), threshold))


def score_long(
    df: DataFrame, models: list[FittedModel], keep: list[str], target: str
) -> DataFrame:
    """One row per input row and model, from one scan of the table."""
    scored = df
    for i, model in enumerate(models):
        scored = model.score(scored, f"__score{i}")
    pairs = [
        F.struct(F.lit(m.name).alias("model"), F.col(f"__score{i}").alias("y_prob"))
        for i, m in enumerate(models)
    ]
    label = F.col(target).cast("int").alias("y_true")
    return scored.select(*keep, label, F.inline(F.array(*pairs))).select(
        *keep, "model", "y_true", "y_prob"
    )
