"""Star schema declarations: facts, dimensions, how columns may be used, and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    """Column types; ``measurable`` ones may be summed, ``groupable`` ones may be grouped by."""

    KEY = T.StringType()
    TEXT = T.StringType()
    DATE = T.DateType()
    INTEGER = T.LongType()
    DECIMAL = T.DoubleType()
    BOOLEAN = T.BooleanType()


_MEASURABLE = ("INTEGER", "DECIMAL")
_GROUPABLE = ("TEXT", "DATE", "INTEGER", "BOOLEAN")


class Sensitivity(Enum):
    OPEN = "non_identifying"
    QUASI = "quasi_identifier"
    PSEUDONYM = "pseudonym"


@dataclass(frozen=True)
class Col:
    """A declared column. Keys may not be open."""

    name: str
    kind: str
    sensitivity: Sensitivity = Sensitivity.OPEN
    nullable: bool = True

    def __post_init__(self) -> None:
        if self.kind == "KEY" and self.sensitivity is Sensitivity.OPEN:
            raise ValueError(f"{self.name}: a key can't be non-identifying")

    @property
    def measurable(self) -> bool:
        return self.kind in _MEASURABLE

    @property
    def groupable(self) -> bool:
        return self.kind in _GROUPABLE

    def field(self) -> T.StructField:
        # sensitivity travels with the column through projections
        return T.StructField(self.name, Kind[self.kind].value, self.nullable, {"sensitivity": self.sensitivity.value, "kind": self.kind})


def key(name: str) -> Col:
    return Col(name, "KEY", Sensitivity.PSEUDONYM)


@dataclass(frozen=True)
class Dimension:
    name: str
    key: str
    columns: tuple[Col, ...]


@dataclass(frozen=True)
class Fact:
    """A fact at one grain; ``dimensions`` maps its key columns to dimensions, in order of precedence."""

    name: str
    columns: tuple[Col, ...]
    dimensions: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> Col | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def about_patients(self) -> bool:
        """Whether rows speak about single persons, so that the budget of quasi-identifiers applies."""
        return any(c.name in ("patient_key", "cohort_key") and c.sensitivity is Sensitivity.PSEUDONYM for c in self.columns)


@dataclass(frozen=True)
class Schema:
    facts: dict[str, Fact]
    dimensions: dict[str, Dimension]

    def __post_init__(self) -> None:
        for fact in self.facts.values():
            for column, dim in fact.dimensions.items():
                if dim not in self.dimensions or fact.column(column) is None:
                    raise ValueError(f"{fact.name}.{column} -> {dim} isn't declared")

    def resolve(self, fact: Fact, expression: str) -> tuple[str | None, str, Col]:
        """(key column or None, dimension or fact, column) of a grouping expression such as ``dim_code.display``.

        The first declared key to the dimension counts. Keys and pseudonyms can't be grouped by.
        """
        dim_name, _, name = expression.rpartition(".")
        if not dim_name:
            col = fact.column(name)
            where: tuple[str | None, str] = (None, fact.name)
        else:
            via = next((k for k, d in fact.dimensions.items() if d == dim_name), None)
            if via is None:
                raise ValueError(f"{fact.name} has no key to {dim_name}")
            col = next((c for c in self.dimensions[dim_name].columns if c.name == name), None)
            where = (via, dim_name)
        if col is None or not col.groupable or col.sensitivity is Sensitivity.PSEUDONYM:
            raise ValueError(f"can't group {fact.name} by {expression}")
        return (*where, col)


_COMMON = (Col("organization_id", "TEXT"), Col("date_key", "INTEGER"), Col("load_id", "TEXT"))
Q = Sensitivity.QUASI

#: The clinical star schema. The date dimension is keyed by yyyymmdd.
CLINICAL = Schema(
    facts={
        f.name: f
        for f in (
            Fact("fact_encounter", (key("encounter_key"), key("patient_key"), key("cohort_key"), key("organization_key"), Col("encounter_class", "TEXT"), Col("length_of_stay_days", "DECIMAL"), Col("is_readmission", "BOOLEAN"), *_COMMON), {"cohort_key": "dim_cohort", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_observation", (key("observation_key"), key("patient_key"), key("cohort_key"), key("code_key"), key("organization_key"), Col("value", "DECIMAL"), Col("unit", "TEXT"), Col("is_abnormal", "BOOLEAN"), Col("status", "TEXT"), *_COMMON), {"cohort_key": "dim_cohort", "code_key": "dim_code", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_adverse_event", (key("event_key"), key("patient_key"), key("cohort_key"), key("drug_code_key"), key("event_code_key"), key("organization_key"), Col("seriousness", "TEXT"), Col("is_serious", "BOOLEAN"), *_COMMON), {"cohort_key": "dim_cohort", "drug_code_key": "dim_code", "event_code_key": "dim_code", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_document_ingestion", (key("document_key"), key("source_key"), key("organization_key"), Col("document_type", "TEXT"), Col("page_count", "INTEGER"), Col("chunk_count", "INTEGER"), Col("processing_ms", "DECIMAL"), Col("used_ocr", "BOOLEAN"), Col("quality_score", "DECIMAL"), Col("succeeded", "BOOLEAN"), *_COMMON), {"source_key": "dim_source_system", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_answer", (key("answer_key"), key("role_key"), key("organization_key"), Col("question_category", "TEXT"), Col("response_mode", "TEXT"), Col("latency_ms", "DECIMAL"), Col("citation_count", "INTEGER"), Col("is_grounded", "BOOLEAN"), Col("was_abstained", "BOOLEAN"), *_COMMON), {"role_key": "dim_actor_role", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_phi_access", (key("access_key"), key("role_key"), key("organization_key"), Col("purpose", "TEXT"), Col("outcome", "TEXT"), Col("was_break_glass", "BOOLEAN"), Col("was_reviewed", "BOOLEAN"), *_COMMON), {"role_key": "dim_actor_role", "organization_key": "dim_organization", "date_key": "dim_date"}),
            Fact("fact_job_run", (key("run_key"), key("organization_key"), Col("job_kind", "TEXT"), Col("status", "TEXT"), Col("duration_ms", "DECIMAL"), Col("rows_processed", "INTEGER"), Col("rows_rejected", "INTEGER"), *_COMMON), {"organization_key": "dim_organization", "date_key": "dim_date"}),
        )
    },
    dimensions={
        d.name: d
        for d in (
            Dimension("dim_date", "date_key", (Col("date", "DATE", Q), Col("month", "TEXT", Q), Col("quarter", "TEXT"), Col("year", "INTEGER"), Col("day_of_week", "TEXT"), Col("is_weekend", "BOOLEAN"))),
            Dimension("dim_organization", "organization_key", (Col("organization_id", "TEXT"), Col("organization_name", "TEXT"), Col("organization_kind", "TEXT"), Col("region", "TEXT"))),
            Dimension("dim_cohort", "cohort_key", (Col("age_band", "TEXT", Q), Col("sex", "TEXT", Q), Col("postal_prefix", "TEXT", Q), Col("risk_band", "TEXT"))),
            Dimension("dim_code", "code_key", (Col("code", "TEXT"), Col("code_system", "TEXT"), Col("display", "TEXT"), Col("category", "TEXT"))),
            Dimension("dim_actor_role", "role_key", (Col("role", "TEXT"), Col("is_service_account", "BOOLEAN"))),
            Dimension("dim_source_system", "source_key", (Col("source_system", "TEXT"), Col("channel", "TEXT"), Col("interface_kind", "TEXT"))),
        )
    },
)
