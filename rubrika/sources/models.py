"""Stored models, with what belongs to them: class names, cleaning, version."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrika.operators.epochs import EpochModel, load_epoch_model
from rubrika.operators.scoring import score
from rubrika.operators.token_model import TokenModel, load_token_model
from rubrika.schemas import DEFAULT_VERSION, LABELS
from rubrika.sources import files

Model = PipelineModel | TokenModel | EpochModel
ABOUT = "kind string, names array<string>, clean boolean, version string"


@dataclass(frozen=True)
class StoredModel:
    """A model and how it scores: its class names, whether texts are cleaned, and its version."""

    model: Model
    names: tuple[str, ...] = LABELS
    clean: bool = True
    version: str = DEFAULT_VERSION

    def score(self, df: DataFrame, **options) -> DataFrame:
        """``scoring.score`` with the model's names and cleaning, and its ``model_version``."""
        scored = score(df, self.model, clean=self.clean, names=self.names, **options)
        return scored.withColumn("model_version", F.lit(self.version))


def _kind(model: Model) -> str:
    if isinstance(model, TokenModel):
        return "tokens"
    return "epochs" if isinstance(model, EpochModel) else "pipeline"


def save_model(
    model: Model,
    path: str,
    names: Sequence[str] = LABELS,
    clean: bool = True,
    version: str = DEFAULT_VERSION,
) -> None:
    """Writes the model and what belongs to it, replacing one at the same place."""
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:
        model.save(path)
    about = {"kind": _kind(model), "names": list(names), "clean": clean, "version": version}
    files.write_text(SparkSession.active(), f"{path}/about.json", json.dumps(about))


def load_stored(path: str) -> StoredModel:
    """Reads a stored model of any kind; fails where there is none. One that was stored without
    names, cleaning and version has the usual ones."""
    spark = SparkSession.active()
    about = {}
    if files.exists(spark, f"{path}/about.json"):
        about = spark.read.schema(ABOUT).json(f"{path}/about.json").first().asDict()
    kind = about.pop("kind", None)
    if kind is None:
        kind = "tokens" if files.exists(spark, f"{path}/classes") else "pipeline"
    if kind == "pipeline":
        model = PipelineModel.load(path)
    else:
        model = (load_token_model if kind == "tokens" else load_epoch_model)(spark, path)
    if not about:
        return StoredModel(model)
    return StoredModel(model, tuple(about["names"]), about["clean"], about["version"])


def load_model(path: str) -> Model:
    """The model alone."""
    return load_stored(path).model
