"""Joins along time and along lines: the last version before each moment, and points within spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_of(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000 * seconds)).cast("long")


def as_of(moments: DataFrame, versions: DataFrame, key: str, at: str, since: str, order: list[str], values: list[str], *, seconds: int = 86_400) -> DataFrame:
    """moments with the values of the version (key, since, values) of their key that was last saved at or before them; of versions
    of one time the last by order counts, and without one values are null. Nulls in key or time find nothing.

    A key's rows are not gathered in one place: they are parted into stretches of some seconds, each of which gets a carry row, the last
    version of the stretches before it. Only those carries, one a stretch, are put in order over a whole key."""
    taken = {"_bucket", "_at", "_side", "_order", "_value", "_row"} & {*moments.columns, *versions.columns}
    if taken:
        raise ValueError(f"names of helper columns: {sorted(taken)}")
    value = F.struct(*[F.col(v) for v in values])
    right = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(
        F.col(key).alias("_key"), F.col(since).alias("_at"), F.struct(*order).alias("_order"), value.alias("_value")
    )
    right = right.withColumn("_bucket", bucket_of(F.col("_at"), seconds))
    left = moments.withColumn("_bucket", bucket_of(F.col(at), seconds))
    ends = right.groupBy("_key", "_bucket").agg(F.max_by("_value", F.struct("_at", "_order")).alias("_value"))
    asked = left.where(F.col(key).isNotNull() & F.col("_bucket").isNotNull()).select(F.col(key).alias("_key"), "_bucket").distinct()
    both = ends.unionByName(asked.withColumn("_value", F.lit(None)), allowMissingColumns=True).groupBy("_key", "_bucket").agg(F.max("_value").alias("_value"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carries = both.withColumn("_value", F.last("_value", ignorenulls=True).over(before)).where("_value is not null")
    none = F.lit(None)
    events = left.select(F.struct(*moments.columns).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_at"), "_bucket", F.lit(2).alias("_side"))
    events = events.unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    events = events.unionByName(carries.withColumns({"_side": F.lit(0), "_at": none.cast(moments.schema[at].dataType)}), allowMissingColumns=True)
    # the carry comes first (its time is null), then versions before moments of the same time
    inside = Window.partitionBy("_key", "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    known = events.where("_key is not null and _bucket is not null").withColumn("_value", F.last("_value", ignorenulls=True).over(inside)).where("_side = 2")
    rest = left.where(F.col(key).isNull() | F.col("_bucket").isNull()).select(*moments.columns, *[F.lit(None).cast(versions.schema[v].dataType).alias(v) for v in values])
    return known.select("_row.*", *[F.col("_value")[v].alias(v) for v in values]).unionByName(rest)


def within(points: DataFrame, spans: DataFrame, on: list[str], point: str, first: str, last: str, *, width: int) -> DataFrame:
    """Each point with each span of the same on that holds it (first and last count). Lines are cut into bins of a width: a span is in
    every bin that it touches and a point in one, so that the join is one of equals and a long file is many groups."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    cut = points.withColumn("_bin", F.floor(F.col(point) / width))
    return cut.join(binned, [*on, "_bin"]).where(F.col(point).between(F.col(first), F.col(last))).drop("_bin")
