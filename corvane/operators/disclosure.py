"""Statistical disclosure control over published cells.

Complementary suppression always takes the smallest published cells first, so the cells it takes are a
prefix of an order, and whether a prefix suffices depends only on its length and sum: one window computes
it without a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def suppress(cells: DataFrame, total: DataFrame | None, keys: list[str], minimum: int, additive: bool, reports: tuple[str, ...] = (), with_total: bool = False, may_withhold: bool = True) -> DataFrame:
    """(keys…, value, subjects, suppressed, reason): cells after primary and complementary suppression.

    With ``reports``, columns among ``keys``, the cells of each of their values are a report of its own, with its own total;
    the reports are spread over tasks. With ``with_total`` the columns ``total`` and ``total_withheld`` follow: the total is
    withheld (null) if even with every cell suppressed it would give one away; without ``may_withhold`` such a report fails.

    A cell of fewer than ``minimum`` but at least one subject is primary-suppressed; zero cells stay. Of additive
    measures, further cells are suppressed, smallest (value, key) first, until at least two are suppressed and the
    published ones don't give the total away; if no prefix suffices, all are. A suppressed value is null. ``total`` has
    one row with ``total``; without a row no prefix suffices, without ``total`` it is the sum of the cells. Cells with a null
    value are never candidates.
    """
    label = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]) if keys else F.lit("")
    c = cells.withColumn("_p", (F.col("subjects") > 0) & (F.col("subjects") < minimum)).withColumn("_g", label)
    everything = Window.partitionBy(*reports)  # published cells are few: groups of one report
    if total is None:
        c = c.withColumn("total", F.sum("value").over(everything))
    else:
        row = total.first()  # one number
        c = c.withColumn("total", F.lit(row["total"] if row else None).cast("double"))
    c = c.withColumns({"_np": F.sum(F.col("_p").cast("long")).over(everything), "_open": F.sum(F.when(~F.col("_p"), F.col("value")).otherwise(0.0)).over(everything)})
    # rank and running sum among the candidates in order of (value, key)
    order = Window.partitionBy(*reports, "_p").orderBy(F.col("value").asc_nulls_last(), "_g")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumns({"_k": F.row_number().over(order), "_sum": F.sum(F.coalesce("value", F.lit(0.0))).over(run)})
    enough = ~F.col("_p") & (F.col("_np") + F.col("_k") >= 2) & (F.col("total") - (F.col("_open") - F.col("_sum")) > 0)
    first = F.min(F.when(enough, F.col("_k"))).over(everything)
    none_needed = (F.col("_np") >= 2) & (F.col("total") - F.col("_open") > 0)
    take = F.when(F.lit(not additive) | (F.col("_np") == 0) | none_needed, 0).otherwise(F.coalesce(first, F.count("*").over(everything)))
    c = c.withColumn("_take", take)
    extra = ~F.col("_p") & (F.col("_k") <= F.col("_take")) & F.col("value").isNotNull()
    hidden = F.col("_p") | extra
    more = []
    if with_total:
        c = c.withColumns({"_all": F.count_if(hidden).over(everything), "_shown": F.sum(F.when(hidden, 0.0).otherwise(F.col("value"))).over(everything)})
        given_away = F.lit(additive) & (F.col("_np") > 0) & ((F.col("_all") < 2) | ~F.coalesce(F.col("total") - F.col("_shown") > 0, F.lit(False)))
        if not may_withhold:
            given_away = F.when(given_away, F.raise_error(F.lit("the cells can't be protected without withholding the total"))).otherwise(False).cast("boolean")
        more = [F.when(~given_away, F.col("total")).alias("total"), given_away.alias("total_withheld")]
    return c.select(
        *keys, F.when(~hidden, F.col("value")).alias("value"), "subjects", hidden.alias("suppressed"),
        F.when(F.col("_p"), "small_cell").when(extra, "complementary").alias("reason"), *more,
    )
