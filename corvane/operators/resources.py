"""JSON resources: search, compartments, a versioned store and its transactions, kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States in which a resource no longer counts.
RETRACTED = ("entered-in-error", "cancelled", "revoked", "nullified")


def path(name: str, kind: str = "string") -> Column:
    """A value of the ``resource`` variant by dotted path, list positions as numbers; null if it is missing or of another type."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in name.split("."))
    return F.try_variant_get("resource", "$" + steps, kind)


def read_resources(lines: DataFrame, column: str = "line") -> DataFrame:
    """(resource_type, id, resource) of the lines that hold a JSON object with both; others are left out. Repeated rows count once."""
    r = lines.where(F.col(column).isNotNull()).select(column).distinct().select(F.try_parse_json(column).alias("resource"))
    r = r.where(F.schema_of_variant("resource").startswith("OBJECT"))
    return r.select(path("resourceType").alias("resource_type"), path("id").alias("id"), "resource").where("resource_type <> '' and id <> ''")


def search(resources: DataFrame, resource_type: str, offset: int = 0, count: int = 20, with_retracted: bool = False, **parameters: str) -> DataFrame:
    """(id, resource) of one page of matches, sorted by id: all parameters must hold.

    Known are status, code, subject, gender, family (without case, a beginning) and date (a beginning); unknown ones are
    refused. Retracted resources are left out unless wanted.
    """
    known = {
        "status": lambda v: path("status") == v, "code": lambda v: path("code.coding.0.code") == v, "subject": lambda v: path("subject.reference") == v,
        "gender": lambda v: path("gender") == v, "family": lambda v: F.lower(path("name.0.family")).startswith(v.lower()), "date": lambda v: F.coalesce(path("effectiveDateTime"), path("birthDate")).startswith(v),
    }
    if unknown := set(parameters) - set(known):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    r = resources.where(F.col("resource_type") == resource_type)
    for name, value in parameters.items():
        r = r.where(F.coalesce(known[name](value), F.lit(False)))
    if not with_retracted:
        r = r.where(~F.coalesce(path("status").isin(*RETRACTED), F.lit(False)))
    return r.select("id", "resource").orderBy("id").offset(offset).limit(count)


def compartments(resources: DataFrame) -> DataFrame:
    """(subject, resource_type, resources): how many resources belong to each subject, the subject's own included."""
    own = resources.where("resource_type = 'Patient'").select(F.concat(F.lit("Patient/"), "id").alias("subject"), "resource_type")
    refers = resources.select(path("subject.reference").alias("subject"), "resource_type").where("subject is not null")
    return own.unionByName(refers).groupBy("subject", "resource_type").agg(F.count("*").alias("resources"))


def current(log: DataFrame) -> DataFrame:
    """The newest version per (resource_type, id) of a version log (…, version, deleted); deleted resources are gone."""
    w = Window.partitionBy("resource_type", "id").orderBy(F.desc("version"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not coalesce(deleted, false)").drop("_n")


def apply_changes(log: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new log rows, refused) of changes (resource_type, id, action, expected_version, resource, sequence).

    ``create`` needs that no live resource exists, ``update`` and ``delete`` that one does, and ``expected_version``, if
    given, must be its version. One change per resource and call: the first by sequence; later ones are refused.
    """
    newest = log.groupBy("resource_type", "id").agg(F.max_by(F.struct("version", F.coalesce("deleted", F.lit(False)).alias("deleted")), "version").alias("n"))
    w = Window.partitionBy("resource_type", "id").orderBy("sequence")
    c = changes.withColumn("_n", F.row_number().over(w)).join(newest, ["resource_type", "id"], "left")
    live = F.coalesce(~F.col("n.deleted"), F.lit(False))
    reason = (
        F.when(F.col("_n") > 1, "repeated").when((F.col("action") == "create") & live, "exists").when((F.col("action") != "create") & ~live, "missing")
        .when(F.col("expected_version").isNotNull() & ~F.col("expected_version").eqNullSafe(F.col("n.version")), "version")
    )
    c = c.withColumn("reason", reason)
    new = c.where("reason is null").select("resource_type", "id", (F.coalesce("n.version", F.lit(0)) + 1).alias("version"), (F.col("action") == "delete").alias("deleted"), F.when(F.col("action") != "delete", F.col("resource")).alias("resource"))
    return new, c.where("reason is not null").select("resource_type", "id", "sequence", "reason")
