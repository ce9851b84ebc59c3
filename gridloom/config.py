"""Typed and bounded parameters of the services."""

from __future__ import annotations

from enum import Enum
from typing import Annotated, Literal

from pydantic import BaseModel, ConfigDict, Field


class Task(str, Enum):
    regression = "regression"
    classification = "classification"


class Config(BaseModel):
    model_config = ConfigDict(str_strip_whitespace=True, extra="forbid")


class TrainConfig(Config):
    data: str
    target: str
    task: Task = Task.regression
    engineer: bool = False
    tune: bool = False
    n_trials: Annotated[int, Field(ge=1, le=500)] = 50
    tune_method: Literal["tpe", "random", "halving"] = "tpe"
    test_size: Annotated[float, Field(gt=0, lt=1)] = 0.2
    objective: str | None = None  #: of the choice of model, where it is not the task
    ensemble: Literal["voting", "stacking"] | None = None
    advanced_cv: bool = False
    save: str | None = None


class DriftConfig(Config):
    reference: str
    current: str
    threshold: Annotated[float, Field(gt=0, lt=10)] = 0.2


class AnomalyConfig(Config):
    data: str
    methods: tuple[str, ...] = ("iforest", "lof")
    contamination: Annotated[float, Field(gt=0, lt=1)] = 0.05
    consensus: Annotated[int, Field(ge=1)] = 2


class FairnessConfig(Config):
    data: str
    target: str
    predicted: str
    sensitive: str


class ForecastConfig(Config):
    data: str
    column: str
    horizon: Annotated[int, Field(ge=1, le=1000)] = 12
    method: str = "auto"


class ClusterConfig(Config):
    data: str
    n_clusters: Annotated[int, Field(ge=2, le=1000)] = 5
    method: str = "kmeans"
    features: tuple[str, ...] = ()
