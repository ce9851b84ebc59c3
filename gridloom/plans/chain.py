"""Chains of steps with ``>>``: table steps give a table, report steps a report; they don't mix."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gridloom.errors import DataValidationError
from gridloom.operators import clean as cleaning
from gridloom.operators import models
from gridloom.operators.features import FeatureEngineer
from gridloom.roles import ColumnRoles


class Step:
    """One step; ``run`` takes and returns the chain's state."""

    kind = "table"

    def __rshift__(self, other: Step | Chain) -> Chain:
        return Chain([self]) >> other

    def run(self, state):
        raise NotImplementedError


class Chain:
    """Steps in order, lazy until ``run``."""

    def __init__(self, steps: list[Step]):
        kinds = {s.kind for s in steps if s.kind != "any"}
        for s in steps:
            if not isinstance(s, Step):
                raise TypeError(f"not a step: {s!r}")
        if len(kinds) > 1:
            raise TypeError("table and report steps cannot be mixed")
        self.steps, self.kind = list(steps), next(iter(kinds), "any")

    def __rshift__(self, other: Step | Chain) -> Chain:
        if not isinstance(other, (Step, Chain)):
            raise TypeError(f"not a step: {other!r}")
        return Chain(self.steps + (other.steps if isinstance(other, Chain) else [other]))

    def run(self, state=None):
        if not self.steps:
            raise ValueError("an empty chain")
        if state is None:
            state = TableState() if self.kind != "report" else None
        for step in self.steps:
            state = step.run(state)
        return state

    def __repr__(self) -> str:
        return " >> ".join(type(s).__name__ for s in self.steps)


@dataclass
class TableState:
    df: DataFrame | None = None
    target: str | None = None
    features: list[str] | None = None
    model_name: str | None = None
    model: object = None
    log: list[str] = field(default_factory=list)

    @property
    def table(self) -> DataFrame:
        if self.df is None:
            raise DataValidationError("the chain has no table yet")
        return self.df

    @property
    def numeric_only(self) -> bool:
        features = self.features if self.features is not None else [c for c in self.table.columns if c != self.target]
        return set(features) <= set(ColumnRoles.of(self.table).numeric)


@dataclass
class Load(Step):
    df: DataFrame

    def run(self, state: TableState) -> TableState:
        state.df = self.df
        return state


@dataclass
class Clean(Step):
    df: DataFrame | None = None
    exclude: tuple[str, ...] = ()

    def run(self, state: TableState) -> TableState:
        state.df = cleaning.clean(self.df if self.df is not None else state.table, exclude=self.exclude)
        return state


@dataclass
class Engineer(Step):
    engineer: FeatureEngineer = field(default_factory=FeatureEngineer)

    def run(self, state: TableState) -> TableState:
        state.df = self.engineer.fit_transform(state.table, state.target)
        return state


@dataclass
class Select(Step):
    target: str
    features: list[str] | None = None

    def run(self, state: TableState) -> TableState:
        state.target = self.target
        state.features = self.features if self.features is not None else [c for c in state.table.columns if c != self.target]
        state.df = state.table.select(*state.features, self.target)
        return state


@dataclass
class Choose(Step):
    objective: str
    facts: dict = field(default_factory=dict)

    def run(self, state: TableState) -> TableState:
        state.model_name = models.choose_model(self.objective, state.table.count(), **{"numeric_only": state.numeric_only} | self.facts)
        return state


@dataclass
class Train(Step):
    task: str = "regression"

    def run(self, state: TableState) -> TableState:
        if state.target is None or state.features is None:
            raise DataValidationError("select a target before training")
        name = state.model_name or models.choose_model(self.task, state.table.count(), numeric_only=state.numeric_only)
        state.model = models.train(state.table, state.target, state.features, name, self.task)
        return state


@dataclass
class Apply(Step):
    """Any function of a table."""

    f: Callable[[DataFrame], DataFrame]

    def run(self, state: TableState) -> TableState:
        state.df = self.f(state.table)
        return state


@dataclass
class Log(Step):
    message: str
    kind = "any"

    def run(self, state):
        getattr(state, "log", []).append(self.message)
        return state
