"""Declarations: semantic models, metric requests, bundles and policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from tallyward import fixed


class Refused(Exception):
    """A request that may not or can not run; ``code`` is stable."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.details = details


@dataclass(frozen=True)
class Condition:
    """``column op value`` inside a measure."""

    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class Measure:
    name: str
    column: str
    agg: str
    filters: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    dimensions: tuple[Dimension, ...] = ()
    measures: tuple[Measure, ...] = ()
    time_column: str | None = None

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)


@dataclass(frozen=True)
class Link:
    """An allowed equi-join between two tables."""

    left_table: str
    left_column: str
    right_table: str
    right_column: str

    def same_as(self, other: Link) -> bool:
        mine = {(self.left_table, self.left_column), (self.right_table, self.right_column)}
        return mine == {(other.left_table, other.left_column), (other.right_table, other.right_column)}


@dataclass(frozen=True)
class WindowRule:
    """Queries on ``table`` must bound ``column`` to at most ``max_days``."""

    table: str
    column: str
    max_days: int


@dataclass(frozen=True)
class Bundle:
    name: str
    tables: tuple[str, ...]
    links: tuple[Link, ...] = ()
    windows: tuple[WindowRule, ...] = ()


@dataclass(frozen=True)
class Semantics:
    """All models plus the joins declared between their tables."""

    models: tuple[Model, ...]
    links: tuple[Link, ...] = ()

    def __post_init__(self) -> None:
        names = [m.name for m in self.models]
        if len(set(names)) != len(names):
            raise Refused("ambiguous_ref", "a model name is declared twice")
        for model in self.models:
            fields = [d.name for d in model.dimensions] + [m.name for m in model.measures]
            if len(set(fields)) != len(fields):
                raise Refused("ambiguous_ref", f"a field of {model.name} is declared twice")
            for measure in model.measures:
                if measure.agg not in fixed.AGGREGATIONS:
                    raise Refused("invalid_aggregation", f"{model.name}.{measure.name}: {measure.agg}")

    def model(self, name: str) -> Model | None:
        return next((m for m in self.models if m.name == name), None)

    def link(self, one: Model, two: Model) -> Link | None:
        """First declared join between two models, oriented from ``one`` to ``two``."""
        for link in self.links:
            if (link.left_table, link.right_table) == (one.table, two.table):
                return link
            if (link.left_table, link.right_table) == (two.table, one.table):
                return Link(link.right_table, link.right_column, link.left_table, link.left_column)
        return None

    def split(self, ref: str) -> tuple[Model, str]:
        name, dot, rest = ref.partition(".")
        if not dot:
            raise Refused("ambiguous_ref", f"{ref!r} must be written as model.field")
        model = self.model(name)
        if model is None:
            raise Refused("unknown_model", f"no model {name!r}")
        if not rest:
            raise Refused("ambiguous_ref", f"{ref!r} has an empty field")
        return model, rest

    def measure(self, ref: str) -> tuple[Model, Measure]:
        model, name = self.split(ref)
        found = model.measure(name)
        if found is None:
            raise Refused("unknown_measure", f"no measure {ref!r}")
        return model, found

    def dimension(self, ref: str) -> tuple[Model, Dimension]:
        model, name = self.split(ref)
        found = model.dimension(name)
        if found is None:
            raise Refused("unknown_dimension", f"no dimension {ref!r}")
        return model, found


@dataclass(frozen=True)
class Filter:
    """A request filter on a ``model.field`` ref."""

    field: str
    op: str
    value: Any = None
    values: Sequence[Any] | None = None
    range: tuple[Any, Any] | None = None


@dataclass(frozen=True)
class Request:
    measures: Sequence[str]
    dimensions: Sequence[str] = ()
    filters: Sequence[Filter] = ()
    time_range: tuple[str, str] | None = None
    time_grain: str | None = None
    order_by: Sequence[tuple[str, str]] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Scope:
    """What one caller may use."""

    bundle: Bundle
    max_rows: int = 0
    pii_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Agent:
    name: str
    role: str = "domain"
    bundle: str | None = None
    can_query: bool = True


@dataclass(frozen=True)
class Policy:
    """The policy a query log is judged by."""

    agents: tuple[Agent, ...]
    bundles: tuple[Bundle, ...]
    pii: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_rows: int = 500
    enforce_limit: bool = True
    single_statement: bool = True
    allow_execute: bool = True
    pii_mode: str = "block"
    revision: str = "unversioned"

    def agent(self, name: str) -> Agent | None:
        return next((a for a in self.agents if a.name == name), None)

    def bundle(self, name: str | None) -> Bundle | None:
        return next((b for b in self.bundles if b.name == name), None)

    @property
    def pii_names(self) -> list[str]:
        return sorted({c.lower() for cols in self.pii.values() for c in cols})
