"""Declared metrics, their validation against the schema, and their compilation to DataFrame aggregations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.disclosure import suppress
from .schema import CLINICAL, Schema, Sensitivity

Filter = tuple  # (column, operator) or (column, operator, value)
MEASURES = ("count", "count_distinct", "ratio", "sum", "average", "min", "max", "percentile")
_NUMERIC = ("sum", "average", "min", "max", "percentile")
#: Measures whose cells add up to the total; only these need complementary suppression.
ADDITIVE = ("count", "sum")


def predicate(f: Filter) -> Column:
    """A filter as a column that is never null: a null value satisfies no comparison, not even ``ne`` and ``not_in``."""
    name, op, *rest = f
    c, v = F.col(name), rest[0] if rest else None
    if op in ("in", "not_in") and not isinstance(v, (list, tuple)):
        raise ValueError(f"{op} needs a list")
    if op in ("eq", "ne", "gt", "gte", "lt", "lte") and v is None:
        raise ValueError(f"{op} needs a value")
    made = {
        "eq": lambda: c == v, "ne": lambda: c != v, "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v), "gt": lambda: c > v, "gte": lambda: c >= v,
        "lt": lambda: c < v, "lte": lambda: c <= v, "is_true": lambda: c.eqNullSafe(True), "is_false": lambda: c.eqNullSafe(False),
        "is_null": c.isNull, "not_null": c.isNotNull,
    }
    if op not in made:
        raise ValueError(f"unknown operator {op}")
    return F.coalesce(made[op](), F.lit(False))


def all_of(filters: tuple[Filter, ...]) -> Column:
    return reduce(lambda a, b: a & b, [predicate(f) for f in filters], F.lit(True))


@dataclass(frozen=True)
class Metric:
    """A declared aggregate over one fact."""

    name: str
    fact: str
    measure: str
    column: str | None = None
    filters: tuple[Filter, ...] = ()
    denominator: tuple[Filter, ...] = ()
    subject: str | None = None
    group_by: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    percentile: float = 0.95
    minimum_cell: int = 11
    max_quasi: int = 1

    def validate(self, schema: Schema = CLINICAL) -> None:
        """Refuses what the schema can't answer: unknown facts and columns, text sums, patient facts without subject."""
        fact = schema.facts.get(self.fact)
        if fact is None or self.measure not in MEASURES:
            raise ValueError(f"{self.name}: unknown fact or measure")
        if self.measure not in ("count", "ratio"):
            col = fact.column(self.column or "")
            if col is None or self.measure in _NUMERIC and not col.measurable:
                raise ValueError(f"{self.name}: {self.measure} of {self.column}")
        if self.measure == "ratio" and not self.denominator:
            raise ValueError(f"{self.name}: a ratio needs a denominator")
        if fact.about_patients and (self.subject is None or fact.column(self.subject) is None):
            raise ValueError(f"{self.name}: a patient-level fact needs a subject")
        for f in (*self.filters, *self.denominator):
            if fact.column(f[0]) is None:
                raise ValueError(f"{self.name}: filter on unknown {f[0]}")
            predicate(f)
        for g in (*self.group_by, *self.allowed):
            schema.resolve(fact, g)

    def check_grouping(self, group_by: tuple[str, ...], schema: Schema = CLINICAL) -> None:
        """Refuses groupings outside the whitelist and more quasi-identifiers than the budget on patient-level facts."""
        fact = schema.facts[self.fact]
        if extra := set(group_by) - set(self.group_by) - set(self.allowed):
            raise ValueError(f"{self.name} may not be grouped by {sorted(extra)}")
        quasi = sum(schema.resolve(fact, g)[2].sensitivity is Sensitivity.QUASI for g in group_by)
        if fact.about_patients and quasi > self.max_quasi:
            raise ValueError(f"{self.name}: {quasi} quasi-identifiers, {self.max_quasi} allowed")

    def lineage(self) -> dict[str, object]:
        return {"metric": f"{self.name}@1.0.0", "fact": self.fact, "measure": self.measure, "column": self.column, "filters": [list(f) for f in self.filters], "group_by": list(self.group_by)}


def date_parts(date_key: Column) -> dict[str, Column]:
    """The attributes of the date dimension as functions of a key yyyymmdd; null for a key that is no date."""
    d = F.try_to_timestamp(date_key.cast("string"), F.lit("yyyyMMdd")).cast("date")
    return {
        "date": d, "month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(F.year(d), F.lit("-Q"), F.quarter(d)), "year": F.year(d).cast("long"),
        "day_of_week": F.date_format(d, "EEEE"), "is_weekend": F.dayofweek(d).isin(1, 7),
    }


def dim_date(facts: DataFrame, column: str = "date_key") -> DataFrame:
    """The date dimension of the dates that occur, keyed by yyyymmdd."""
    days = facts.select(F.col(column).alias("date_key")).where("date_key is not null").distinct()
    return days.select("date_key", *[c.alias(n) for n, c in date_parts(F.col("date_key")).items()])


def group_columns(facts: DataFrame, metric: Metric, group_by: tuple[str, ...], dims: dict[str, DataFrame], schema: Schema = CLINICAL) -> tuple[DataFrame, list[str]]:
    """Facts with one column per grouping expression; a key without dimension row gives ``unknown``, a null attribute stays null."""
    fact, names = schema.facts[metric.fact], []
    wanted: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for g in group_by:
        via, where, col = schema.resolve(fact, g)
        name = g.replace(".", "__")
        names.append(name)
        if via is None:
            facts = facts.withColumn(name, F.col(col.name).cast("string"))
        else:
            wanted.setdefault((via, where), []).append((name, col.name))
    for (via, where), cols in wanted.items():
        if where == "dim_date" and where not in dims:  # the date dimension is a function of its key
            parts = date_parts(F.col(via))
            facts = facts.withColumns({n: F.when(F.col(via).isNull(), "unknown").otherwise(parts[c].cast("string")) for n, c in cols})
            continue
        d = dims[where].dropDuplicates([schema.dimensions[where].key]).select(F.col(schema.dimensions[where].key).alias("_k"), F.lit(True).alias("_hit"), *[F.col(c).cast("string").alias(n) for n, c in cols])
        facts = facts.join(d, facts[via] == F.col("_k"), "left")
        for n, _ in cols:
            facts = facts.withColumn(n, F.when(F.col("_hit").isNull(), "unknown").otherwise(F.col(n)))
        facts = facts.drop("_k", "_hit")
    return facts, names


def measure(facts: DataFrame, metric: Metric, keys: list[str]) -> DataFrame:
    """(keys…, value, subjects): groups whose value is null are left out; a group without matching row counts 0."""
    hit, base = all_of(metric.filters), all_of(metric.denominator)
    rows = base if metric.measure == "ratio" else hit
    subject = F.countDistinct(F.when(rows & F.col(metric.subject).isNotNull() & (F.col(metric.subject) != ""), F.col(metric.subject))) if metric.subject else F.count_if(rows)
    if metric.measure == "percentile":
        # one row per distinct value, so a hot group stays small before its running count
        v = facts.where(hit & F.col(metric.column).isNotNull()).groupBy(*keys, F.col(metric.column).cast("double").alias("_v")).count()
        w = Window.partitionBy(*keys) if keys else Window.partitionBy()
        v = v.withColumn("_n", F.sum("count").over(w)).withColumn("_c", F.sum("count").over(w.orderBy("_v")))
        at = F.greatest(F.lit(1), F.floor(F.col("_n") * metric.percentile))
        values = v.where(F.col("_c") >= at).groupBy(*keys).agg(F.min("_v").alias("value"))
        subjects = facts.groupBy(*keys).agg(subject.cast("long").alias("subjects"))
        if not keys:
            n = subjects.first()["subjects"]  # one number
            return values.where("value is not null").withColumn("subjects", F.lit(n).cast("long"))
        cond = reduce(lambda a, b: a & b, [values[k].eqNullSafe(subjects[k]) for k in keys])
        return values.join(subjects, cond).select(*[values[k] for k in keys], "value", "subjects").where("value is not null")
    x = F.when(hit, F.col(metric.column or metric.filters[0][0] if metric.column or metric.filters else "date_key"))
    n = x.cast("double")
    value = {
        "count": lambda: F.count_if(hit).cast("double"), "count_distinct": lambda: F.countDistinct(x).cast("double"),
        "ratio": lambda: F.round(F.count_if(base & hit) / F.nullif(F.count_if(base), F.lit(0)), 6),
        "sum": lambda: F.round(F.sum(n), 6), "average": lambda: F.round(F.avg(n), 6), "min": lambda: F.min(n), "max": lambda: F.max(n),
    }[metric.measure]()
    return facts.groupBy(*keys).agg(value.alias("value"), subject.cast("long").alias("subjects")).where("value is not null")


def run_metric(
    metric: Metric, fact: DataFrame, dims: dict[str, DataFrame], organization_id: str | None = None, group_by: tuple[str, ...] | None = None,
    date_from: int | None = None, date_to: int | None = None, schema: Schema = CLINICAL, every_organization: bool = False, max_scan_rows: int | None = None, with_total: bool = False,
) -> DataFrame:
    """(group columns…, value, subjects, suppressed, reason): a metric after disclosure control, in one scan of the fact.

    The rows of one organisation, which must be named and not blank; only ``every_organization``, for the operator of the
    platform, reads all. An inclusive range of date keys drops null ones. With ``max_scan_rows`` an organisation of more
    rows, in any range, is refused. ``with_total`` adds the total, or that it is withheld. Without rows the result is empty.
    """
    if organization_id is None and not every_organization:
        raise ValueError("a metric needs an organisation")
    metric.validate(schema)
    group_by = metric.group_by if group_by is None else tuple(group_by)
    metric.check_grouping(group_by, schema)
    if organization_id is not None:
        if not organization_id.strip():
            raise ValueError("a blank organisation has no rows")
        fact = fact.where(F.col("organization_id") == organization_id)
    if max_scan_rows is not None and fact.limit(max_scan_rows + 1).count() > max_scan_rows:
        raise ValueError(f"more than {max_scan_rows} rows to scan")
    if date_from is not None and date_to is not None and date_to < date_from:
        raise ValueError("the range ends before it begins")
    if date_from is not None:
        fact = fact.where(F.col("date_key") >= date_from)
    if date_to is not None:
        fact = fact.where(F.col("date_key") <= date_to)
    rows, keys = group_columns(fact, metric, group_by, dims, schema)
    # additive cells add up to the total; other measures need none
    return suppress(measure(rows, metric, keys), None, keys, metric.minimum_cell, metric.measure in ADDITIVE, with_total=with_total)


def _m(name: str, fact: str, measure_: str, group_by: str, allowed: str = "", **k: object) -> Metric:
    return Metric(name, f"fact_{fact}", measure_, group_by=(group_by,), allowed=tuple(allowed.split()), **k)


#: The metrics that users run.
CATALOGUE = {
    m.name: m
    for m in (
        _m("adverse_event_count", "adverse_event", "count", "dim_date.month", "dim_date.quarter dim_code.display seriousness dim_organization.organization_name", subject="patient_key"),
        _m("serious_adverse_event_rate", "adverse_event", "ratio", "dim_date.quarter", "dim_code.display", filters=(("is_serious", "is_true"),), denominator=(("event_key", "not_null"),), subject="patient_key"),
        _m("cohort_patient_count", "observation", "count_distinct", "dim_date.month", "dim_code.display dim_cohort.age_band dim_cohort.sex", column="patient_key", subject="patient_key", max_quasi=2),
        _m("abnormal_result_rate", "observation", "ratio", "dim_code.display", "dim_date.month dim_organization.organization_name", filters=(("is_abnormal", "is_true"),), denominator=(("status", "not_in", ("entered-in-error", "cancelled")),), subject="patient_key"),
        _m("mean_length_of_stay", "encounter", "average", "dim_organization.organization_name", "dim_date.month dim_cohort.age_band", column="length_of_stay_days", filters=(("encounter_class", "eq", "IMP"),), subject="patient_key"),
        _m("documents_ingested", "document_ingestion", "count", "dim_date.month", "dim_date.day_of_week dim_source_system.source_system document_type dim_organization.organization_name", minimum_cell=1),
        _m("ingestion_success_rate", "document_ingestion", "ratio", "dim_source_system.source_system", "dim_date.month document_type", filters=(("succeeded", "is_true"),), denominator=(("document_key", "not_null"),), minimum_cell=1),
        _m("ingestion_p95_latency", "document_ingestion", "percentile", "dim_source_system.source_system", "dim_date.month document_type", column="processing_ms", minimum_cell=1),
        _m("mean_extraction_quality", "document_ingestion", "average", "document_type", "dim_source_system.source_system dim_date.month", column="quality_score", filters=(("succeeded", "is_true"),), minimum_cell=1),
        _m("etl_job_failure_count", "job_run", "count", "job_kind", "dim_date.month", filters=(("status", "eq", "failed"),), minimum_cell=1, max_quasi=0),
        _m("phi_access_count", "phi_access", "count", "outcome", "purpose dim_actor_role.role dim_date.month", minimum_cell=1, max_quasi=0),
        _m("break_glass_count", "phi_access", "count", "dim_date.month", "dim_actor_role.role was_reviewed", filters=(("was_break_glass", "is_true"),), minimum_cell=1, max_quasi=0),
        _m("break_glass_review_rate", "phi_access", "ratio", "dim_date.month", "dim_actor_role.role", filters=(("was_reviewed", "is_true"),), denominator=(("was_break_glass", "is_true"),), minimum_cell=1, max_quasi=0),
        _m("deidentification_job_status", "job_run", "count", "status", "dim_date.month", filters=(("job_kind", "eq", "deidentification"),), minimum_cell=1, max_quasi=0),
        _m("answers_produced", "answer", "count", "dim_date.month", "question_category response_mode dim_actor_role.role", minimum_cell=1, max_quasi=0),
        _m("grounding_pass_rate", "answer", "ratio", "dim_date.month", "question_category dim_actor_role.role", filters=(("is_grounded", "is_true"),), denominator=(("was_abstained", "is_false"),), minimum_cell=1, max_quasi=0),
        _m("abstention_rate", "answer", "ratio", "dim_date.month", "question_category", filters=(("was_abstained", "is_true"),), denominator=(("answer_key", "not_null"),), minimum_cell=1, max_quasi=0),
        _m("answer_p95_latency", "answer", "percentile", "question_category", "dim_date.month response_mode", column="latency_ms", minimum_cell=1, max_quasi=0),
    )
}
