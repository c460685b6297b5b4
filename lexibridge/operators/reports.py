"""Reporting operators: dense time series, top-n with a rest, keyed rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(spark, as_of: str, steps: int, unit: str) -> DataFrame:
    """`steps` consecutive labels (day or month, as text) that end at `as_of`."""
    last = F.to_date(F.lit(as_of))
    if unit == "day":
        first, step, form = F.date_sub(last, steps - 1), F.expr("interval 1 day"), "yyyy-MM-dd"
    else:
        first, step, form = F.trunc(F.add_months(last, 1 - steps), "month"), F.expr("interval 1 month"), "yyyy-MM"
    return spark.range(1).select(F.explode(F.sequence(first, F.when(F.lit(unit == "day"), last).otherwise(F.trunc(last, "month")), step)).alias("d")).select(F.date_format("d", form).alias("bucket"))


def bucket(at: Column, unit: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd" if unit == "day" else "yyyy-MM")


def dense_series(events: DataFrame, labels: DataFrame, key: Column, **measures: Column) -> DataFrame:
    """The measures by bucket, 0 for buckets without events. `labels` is a short list of buckets."""
    sums = events.withColumn("bucket", key).groupBy("bucket").agg(*[m.alias(n) for n, m in measures.items()])
    return labels.join(sums, "bucket", "left").select("bucket", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in measures])


def top_with_rest(totals: DataFrame, name: str, value: str, keep: int, rest: str = "__other__", unknown: str = "__unknown__") -> DataFrame:
    """Totals by name; if there are more than keep + 1 names, all but the top `keep` are one rest row.

    Ranked by total, then name; blank names are one unknown row.
    """
    named = totals.select(F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(unknown)).alias(name), value).groupBy(name).agg(F.sum(value).alias(value))
    # One row per name: names are few, and the window needs them in one order.
    order = Window.orderBy(F.desc(value), name)
    ranked = named.withColumns({"rank": F.row_number().over(order), "names": F.count("*").over(Window.partitionBy())})
    folded = F.when((F.col("names") > keep + 1) & (F.col("rank") > keep), F.lit(rest)).otherwise(F.col(name))
    return ranked.groupBy(folded.alias(name)).agg(F.sum(value).alias(value))


def active_minutes(first: Column, last: Column, requests: Column) -> Column:
    """Minutes between first and last sight, rounded up, at least one for any request."""
    seconds = F.unix_timestamp(last) - F.unix_timestamp(first)
    return F.when(requests <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(seconds / 60))).cast("long")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def progress(done: Column, total: Column) -> Column:
    """Whole percent that reaches 100 only when all is done."""
    return F.when(total <= 0, 0).when(done >= total, 100).when(done <= 0, 0).otherwise(F.least(F.lit(99), F.floor(done * 100 / total))).cast("int")
