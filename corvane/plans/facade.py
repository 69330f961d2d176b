"""The only way in for callers: templates that expose metrics with typed parameters, ranges and scan limits."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import CATALOGUE, Metric, run_metric
from .schema import CLINICAL, Schema

#: Days a range may span, rows of an organisation that a query may scan.
MAX_RANGE_DAYS, MAX_SCAN_ROWS = 400, 5_000_000


class QueryRefused(ValueError):
    """A request that doesn't fit its template."""


@dataclass(frozen=True)
class Parameter:
    """A declared parameter of kind date, integer, decimal, text or choice; numbers within inclusive bounds."""

    name: str
    kind: str
    required: bool = False
    allowed: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None

    def read(self, raw: object) -> object:
        """The value of its type, or QueryRefused."""
        readers = {"date": lambda: raw if isinstance(raw, dt.date) else dt.date.fromisoformat(str(raw)), "integer": lambda: int(str(raw)), "decimal": lambda: float(str(raw)), "text": lambda: str(raw), "choice": lambda: str(raw)}
        try:
            value = readers[self.kind]()
        except ValueError:
            raise QueryRefused(f"{self.name} isn't of kind {self.kind}") from None
        if self.kind in ("integer", "decimal") and not (self.least is None or value >= self.least) or self.kind in ("integer", "decimal") and not (self.most is None or value <= self.most) or value != value:
            raise QueryRefused(f"{self.name} is out of bounds")
        if self.allowed and value not in self.allowed:
            raise QueryRefused(f"{self.name} is none of {sorted(self.allowed)}")
        return value


RANGE = (Parameter("from", "date"), Parameter("to", "date"))


@dataclass(frozen=True)
class Template:
    """A question that may be asked: a metric, its parameters, the groupings it permits and who may ask."""

    name: str
    metric: str
    parameters: tuple[Parameter, ...] = RANGE
    group_by: tuple[str, ...] = ()
    role: str = "analyst"
    max_range_days: int = MAX_RANGE_DAYS

    def read(self, given: dict[str, object]) -> dict[str, object]:
        """The parameters by name; unknown, missing and unreadable ones and too long or reversed ranges are refused."""
        known = {p.name: p for p in self.parameters}
        if unknown := set(given) - set(known):
            raise QueryRefused(f"{self.name} has no parameters {sorted(unknown)}")
        if missing := {p.name for p in self.parameters if p.required} - set(given):
            raise QueryRefused(f"{self.name} needs {sorted(missing)}")
        values = {n: known[n].read(v) for n, v in given.items()}
        if "from" in values and "to" in values:
            days = (values["to"] - values["from"]).days + 1
            if not 1 <= days <= self.max_range_days:
                raise QueryRefused(f"a range of {days} days; 1 to {self.max_range_days} are allowed")
        return values


@dataclass
class Registry:
    """Templates by name: one per metric, each within what its metric allows."""

    metrics: dict[str, Metric] = field(default_factory=lambda: dict(CATALOGUE))
    schema: Schema = CLINICAL
    templates: dict[str, Template] = field(default_factory=dict)

    def add(self, template: Template) -> None:
        metric = self.metrics.get(template.metric)
        if metric is None:
            raise QueryRefused(f"unknown metric {template.metric}")
        if template.name in self.templates or any(t.metric == template.metric for t in self.templates.values()):
            raise QueryRefused(f"{template.name} or its metric is registered")
        if wide := set(template.group_by) - set(metric.group_by) - set(metric.allowed):
            raise QueryRefused(f"{template.metric} can't be grouped by {sorted(wide)}")
        metric.validate(self.schema)
        self.templates[template.name] = template

    def ask(self, name: str, fact: DataFrame, dims: dict[str, DataFrame], organization_id: str, roles: set[str], parameters: dict[str, object] | None = None, group_by: tuple[str, ...] | None = None, max_scan_rows: int | None = MAX_SCAN_ROWS) -> DataFrame:
        """The cells of a template for one organisation, after disclosure control."""
        template = self.templates.get(name)
        if template is None:
            raise QueryRefused(f"no template {name}")
        if template.role not in roles:
            raise QueryRefused(f"{name} is for the role {template.role}")
        if not organization_id or not organization_id.strip():
            raise QueryRefused("an organisation is needed")
        if group_by and (extra := set(group_by) - set(template.group_by)):
            raise QueryRefused(f"{name} may not be grouped by {sorted(extra)}")
        values = template.read(parameters or {})
        key = lambda d: int(d.strftime("%Y%m%d")) if d else None
        return run_metric(self.metrics[template.metric], fact, dims, organization_id, group_by, key(values.get("from")), key(values.get("to")), self.schema, max_scan_rows=max_scan_rows)


def default_registry() -> Registry:
    """One template per metric of the catalogue, with the groupings that the metric allows."""
    registry = Registry()
    for name, metric in CATALOGUE.items():
        registry.add(Template(name, name, group_by=(*metric.group_by, *metric.allowed)))
    return registry


def freshness(fact: DataFrame, organization_id: str, load: str = "load_id") -> DataFrame:
    """(organization_id, rows, last_load, last_date): how recent an organisation's rows of a fact are; no row without any."""
    rows = fact.where(F.col("organization_id") == organization_id)
    return rows.groupBy("organization_id").agg(F.count("*").alias("rows"), F.max(load).alias("last_load"), F.max("date_key").alias("last_date"))


@dataclass(frozen=True)
class Dashboard:
    """Tiles of templates, each with its grouping."""

    name: str
    tiles: tuple[tuple[str, str], ...]
    role: str = "analyst"

    def render(self, registry: Registry, facts: dict[str, DataFrame], dims: dict[str, DataFrame], organization_id: str, roles: set[str], parameters: dict[str, object] | None = None) -> DataFrame:
        """(tile, label, value, subjects, suppressed, reason): the cells of all tiles one after the other."""
        if self.role not in roles:
            raise QueryRefused(f"{self.name} is for the role {self.role}")
        out = None
        for name, group in self.tiles:
            cells = registry.ask(name, facts[registry.metrics[registry.templates[name].metric].fact], dims, organization_id, roles, parameters, (group,))
            tile = cells.select(F.lit(name).alias("tile"), F.col(group.replace(".", "__")).cast("string").alias("label"), "value", "subjects", "suppressed", "reason")
            out = tile if out is None else out.unionByName(tile)
        return out


def is_due(period: str, last: dt.date | None, today: dt.date) -> bool:
    """Whether a daily, weekly or monthly report is due: never run, or the current day, ISO week or month has no run; missed ones are caught up once."""
    if last is None:
        return True
    mark = {"daily": lambda d: d.toordinal(), "weekly": lambda d: d.isocalendar()[:2], "monthly": lambda d: (d.year, d.month)}[period]
    return mark(today) > mark(last)
