"""Percentiles by the index rule: element floor(n * p) of the sorted values, counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.storage import checkpoint

#: Parameter of the approximate quantiles that bracket a wanted place: their error in places is n / ACCURACY.
ACCURACY = 10_000
#: Groups whose brackets are broadcast; those of more are joined by a shuffle.
GROUPS = 100_000


def index_of(values: Column, p: float) -> Column:
    """The rule on an array of one small group; null for an empty array."""
    ordered = F.array_sort(values)
    at = F.least(F.floor(F.size(ordered) * F.lit(p)).cast("int"), F.size(ordered) - 1)
    return F.get(ordered, at)


def index_percentiles(df: DataFrame, value: str, ps: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row per group with a column for each named share; nulls in value are left out.

    No task sorts a whole group: approximate quantiles a little below and above a share bracket the wanted place, the
    rows below the bracket are counted, and only the distinct values inside it are ordered, with their counts. A bracket
    holds some thousandth of a group's places, wherever its values lie; ties are one value."""
    keys = keys or []
    by = [*keys, "_all"]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v"))
    margin = 4 / ACCURACY
    shares = [max(0.0, p - margin) for p in ps.values()] + [min(1.0, p + margin) for p in ps.values()]
    around = F.percentile_approx("_v", F.array(*map(F.lit, shares)), F.lit(ACCURACY))
    span = rows.groupBy(*by).agg(around.alias("_q"), F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    wanted = [
        F.struct(
            F.lit(name).alias("name"), F.least(F.floor(F.col("_n") * F.lit(p)), F.col("_n") - 1).alias("place"),
            (F.col("_q")[i] if p > margin else F.col("_min")).alias("low"), (F.col("_q")[len(ps) + i] if p < 1 - margin else F.col("_max")).alias("high"),
        )
        for i, (name, p) in enumerate(ps.items())
    ]
    span = span.select(*by, F.array(*wanted).alias("_w"))
    if keys:
        span = checkpoint(span)
    # one row without keys; a row for each group else, broadcast up to GROUPS of them
    span = F.broadcast(span) if not keys or span.count() <= GROUPS else span.hint("merge")
    met = rows.join(span, by).select(*keys, "_all", "_v", F.explode("_w").alias("_w")).filter(F.col("_v") <= F.col("_w.high"))
    # rows below the bracket are one row of a null value
    inside = F.when(F.col("_v") >= F.col("_w.low"), F.col("_v"))
    counts = met.groupBy(*by, F.col("_w.name").alias("_name"), F.col("_w.place").alias("_k"), inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    running = counts.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy(F.col("_x").asc_nulls_first())))
    found = running.filter((F.col("_k") >= F.col("_to") - F.col("_c")) & (F.col("_k") < F.col("_to")))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in ps])
