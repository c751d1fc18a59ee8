"""Fitting and applying pyspark.ml models on feature frames."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.functions.numeric import clip_at_zero
from rainloom.operators.bagging import Forest, ForestSettings, forests
from rainloom.operators.boosting import Ensemble, Settings, chances, ensembles
from rainloom.operators.metrics import balanced_weights, best_threshold, threshold_sweep

SEED = 42
#: Marks a label as 0 or 1, so that a model has two classes even if its rows show one.
TWO_CLASSES = {"ml_attr": {"type": "binary"}}


@dataclass(frozen=True)
class Fitted:
    """A fitted model with what serving needs: its inputs, threshold and version label."""

    stages: PipelineModel
    features: list[str]
    threshold: float = 0.5
    name: str = "model"
    version: int = 1

    @property
    def label(self) -> str:
        return f"{self.name} v{self.version}"


@dataclass(frozen=True)
class Grown:
    """Like ``Fitted``, for the trees of ``boosting`` and ``bagging``."""

    trees: Ensemble | Forest
    features: list[str]
    threshold: float = 0.5
    name: str = "model"
    version: int = 1

    @property
    def label(self) -> str:
        return f"{self.name} v{self.version}"


@dataclass(frozen=True)
class Grower:
    """Fits models of histogram trees, one or many at once in the same jobs."""

    settings: Settings | ForestSettings
    name: str
    #: rows with a missing input take no part
    complete: bool = False

    def many(self, rows: DataFrame, features: list[str], label: str, masks: dict[str, Column]) -> dict[str, Grown]:
        """A model for every mask, from the rows for which it is true."""
        known = rows.dropna(subset=features) if self.complete else rows
        fit = forests if isinstance(self.settings, ForestSettings) else ensembles
        return {m: Grown(trees, features, name=self.name) for m, trees in fit(known, features, label, masks, self.settings).items()}

    def __call__(self, train: DataFrame, features: list[str], label: str, name: str | None = None, version: int = 1) -> Grown:
        model = self.many(train, features, label, {"all": F.lit(True)})["all"]
        return replace(model, name=name or self.name, version=version)


#: Gradient boosting with missing inputs as data, and forests whose bags are balanced one by one.
fit_boosted = Grower(Settings(), "boosted")
fit_bagged = Grower(ForestSettings(), "forest", complete=True)


def fit_forest(
    train: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 15, leaf: int = 1,
    balanced: bool = True, name: str = "forest", version: int = 1,
) -> Fitted:
    """Random forest on complete rows, classes weighted to balance. Rows of one class give a model that is sure of it."""
    rows = train.select(*features, F.col(label).cast("double").alias(label, metadata=TWO_CLASSES)).dropna()
    rows = balanced_weights(rows, label) if balanced else rows
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=SEED
    )
    if balanced:
        forest.setWeightCol("weight")
    stages = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), forest]).fit(rows)
    return Fitted(stages, features, name=name, version=version)


def predict(model: Fitted | Grown, df: DataFrame, probability: str = "prob") -> DataFrame:
    """Add the probability of the event; other columns stay, in one pass."""
    if isinstance(model, Grown):
        return df.select(*df.columns, chances({"": model.trees}, df, model.features)[0]["score"].alias(probability))
    scored = model.stages.transform(df).withColumn(probability, vector_to_array("probability")[1])
    return scored.select(*df.columns, probability)


def calibrated(model: Fitted | Grown, calibration: DataFrame, label: str, thresholds: list[float]) -> Fitted | Grown:
    """The model with the threshold of best F1 on rows it was not fitted to."""
    scored = predict(model, calibration, "_p").where(F.col(label).isNotNull())
    row = best_threshold(threshold_sweep(scored, [], "_p", label, thresholds), []).select("threshold").first()
    return model if row is None else replace(model, threshold=row["threshold"])


def importances(model: Fitted | Grown, top: int | None = None) -> list[tuple[str, float]]:
    """Inputs by importance, largest first; as many entries as the model has inputs."""
    shares = model.trees.gains() if isinstance(model, Grown) else model.stages.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(model.features, (float(v) for v in shares)), key=lambda e: (-e[1], e[0]))
    return ranked[:top] if top else ranked


def save_model(spark: SparkSession, model: Fitted | Grown, path: str) -> None:
    """Model files plus one row of facts, so that serving follows the model's own inputs."""
    facts = {"features": model.features, "threshold": model.threshold, "name": model.name, "version": model.version}
    if isinstance(model, Grown):
        kind = "forest" if isinstance(model.trees, Forest) else "boosted"
        spark.createDataFrame([(model.trees.dumps(),)], "value string").coalesce(1).write.text(f"{path}/trees")
    else:
        kind = "stages"
        model.stages.write().save(f"{path}/stages")
    spark.createDataFrame([(json.dumps(facts | {"kind": kind}),)], "value string").coalesce(1).write.text(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> Fitted | Grown:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    kind = facts.pop("kind")
    if kind == "stages":
        return Fitted(PipelineModel.load(f"{path}/stages"), **facts)
    text = spark.read.text(f"{path}/trees").first()["value"]
    return Grown((Forest if kind == "forest" else Ensemble).loads(text), **facts)


# --- amounts ----------------------------------------------------------------------------

def fit_amount(train: DataFrame, features: list[str], amount: str, trees: int = 200, depth: int = 15) -> PipelineModel | None:
    """Forest for the amount, fitted on wet rows only; no model where there are none."""
    wet = train.where(F.col(amount) > 0).dropna(subset=features)
    if wet.isEmpty():
        return None
    forest = RandomForestRegressor(featuresCol="_x", labelCol=amount, numTrees=trees, maxDepth=depth, seed=SEED, predictionCol="_amount")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), forest]).fit(wet)


def predict_amount(gate: Fitted, amount_model: PipelineModel | None, df: DataFrame, out: str = "amount") -> DataFrame:
    """Two stages: nothing where the classifier says no, else the amount, never below 0. Without a model of
    the amount it is null where the classifier says yes."""
    gated = predict(gate, df, "_gate")
    scored = amount_model.transform(gated) if amount_model else gated
    wet = clip_at_zero(F.col("_amount")) if amount_model else F.lit(None).cast("double")
    value = F.when(F.col("_gate") >= gate.threshold, wet).otherwise(F.lit(0.0))
    return scored.withColumn(out, value).select(*df.columns, out)
