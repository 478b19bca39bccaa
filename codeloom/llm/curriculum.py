"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source gets a target (words it gives to the whole mix) and a schedule: its share of attention as a piecewise linear
function of training time, 0 to 1. Integrating the schedule gives the part of the target that is wanted up to any time;
inverting that curve turns a document's place in its source's cumulative word count into a training position. Documents,
repeated as often as the target asks, are then range-sorted by position.

Schedules are rows: of the sources that the caller names, and by turns of SCHEDULES for the others, in order of sources.

Running sums never gather a source in one task: a document falls into one of many hash buckets of its source, buckets are
summed first, and a document adds what stands before its bucket to what stands before it inside the bucket.

Defined results: null and empty texts have size 0 and are never taken; the null source is a source, last in order;
a source without words has target 0; rows that share a doc_id are documents of their own; very long texts are only
counted; ties in the order of a source go by doc_id and size; an empty table gives no rows; other columns, whatever their
names, play no part (training_order returns them as they are).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Workspace, free_name

#: Corners (time, height) of a schedule; heights are 0 or more, and times ascend from 0 to 1.
Corners = Sequence[tuple[float, float]]
#: Schedules of sources that no other is given for, by turns: even, late and later.
SCHEDULES: tuple[Corners, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.2), (0.5, 0.8), (1.0, 2.2)))
STRETCHES = "array<struct<passed:double,start:double,length:double,height:double,slope:double>>"


#: Exclusive end of the hashes that order a source's documents: 56 bits.
ORDER_SPAN = 1 << 56


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """source, source_size, place (from 0, in order), weight, target of each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the words of all sources by weight; none is
    above max_repeat times its source's size, and what a capped source leaves goes to the others by weight until none is
    above. That fixed point is min(cap, level * weight) with one level for all: order sources by cap / weight, and the
    level is that of the first source whose cap is above what the words left by those before it would give; levels of later
    sources are lower, so that it is the largest level at which a source is not capped.
    One row per source; only this table is ordered in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", (F.col("place") % 3 + 1).cast("double"))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("_level", left / weights)
    free = F.col("_level") * F.col("weight") <= F.col("_cap")
    per = per.withColumn("_at", F.max(F.when(free, F.col("_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("weight"), F.col("_cap")))
    return per.select("source", "source_size", "place", "weight", target.alias("target"))


def running_words(sizes: DataFrame, space: Workspace) -> DataFrame:
    """sizes (source, size, _order) with _before: words of its source before each row, in the order of _order.

    A source of n rows has about sqrt(n) buckets of about sqrt(n) rows, so that neither the running sum over buckets nor
    that inside one is ever a large share of the rows. Sources are joined by equality; a hot one is split at run time."""
    stats = sizes.groupBy("source").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("_parts"))
    stats = stats.withColumnRenamed("source", "_source")
    rows = sizes.join(stats, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bucket", F.floor(F.col("_order") / F.lit(float(ORDER_SPAN)) * F.col("_parts"))).drop("_parts")
    rows = space.write(rows, "rows")
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_before", F.col("_ahead") + F.col("_inside")).drop("_source", "_b", "_ahead", "_inside", "_bucket")


def stretches(corners: Corners) -> tuple[float, list[tuple[float, float, float, float, float]]]:
    """Area below a schedule, and (area before, start, length, height, slope) of each stretch between two corners."""
    times, heights = [t for t, _ in corners], [h for _, h in corners]
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)) or min(heights) < 0 or max(heights) <= 0:
        raise ValueError(f"no schedule: {corners}")
    out, area = [], 0.0
    for (t0, h0), (t1, h1) in zip(corners, corners[1:], strict=False):
        if h0 + h1 > 0:  # a stretch without attention has no positions
            out.append((area, t0, t1 - t0, h0, (h1 - h0) / (t1 - t0)))
        area += (t1 - t0) * (h0 + h1) / 2
    return area, out


def with_schedules(targets: DataFrame, schedules: Mapping[str | None, Corners] | None = None) -> DataFrame:
    """targets (source, place, ...) with _area and _stretches of each source's schedule. One row a source; the schedules that a
    caller names are as many as the caller wrote."""
    made = lambda corners: F.struct(F.lit(stretches(corners)[0]).alias("area"), F.array(*[F.struct(*map(F.lit, x)) for x in stretches(corners)[1]]).cast(STRETCHES).alias("stretches"))
    by_turns = F.get(F.array(*[made(c) for c in SCHEDULES]), (F.col("place") % len(SCHEDULES)).cast("int"))
    chosen = by_turns
    for source, corners in (schedules or {}).items():
        chosen = F.when(F.col("source").eqNullSafe(F.lit(source)), made(corners)).otherwise(chosen)
    return targets.withColumn("_s", chosen).select("*", F.col("_s.area").alias("_area"), F.col("_s.stretches").alias("_stretches")).drop("_s", "place")


def position(done: Column, area: Column, parts: Column) -> Column:
    """Training time, 0 to 1, by which the part done of a source's target is wanted: the integral of its schedule, inverted in
    the last stretch that starts before it (a quadratic)."""
    wanted = done * area
    at = F.element_at(F.filter(parts, lambda s: (s.passed <= wanted) | (s.passed == 0)), -1)
    need = F.greatest(wanted - at.passed, F.lit(0.0))
    root = at.height + F.sqrt(F.greatest(at.height * at.height + 2 * at.slope * need, F.lit(0.0)))
    return F.least(at.start + at.length, at.start + F.when(root > 0, 2 * need / root).otherwise(0.0))


def order_key(docs: DataFrame, seed: int) -> Column:
    """A hash, 0 to ORDER_SPAN - 1, of doc_id, the bytes of the text and the seed."""
    given = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.octet_length("text"), F.lit(0)).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(given), 1, 14), 16, 10).cast("long")


def mix(docs: DataFrame, *, max_repeat: int = 3, seed: int = 17, schedules: Mapping[str | None, Corners] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, and positions: training times of the taken copies, ascending.

    A source's documents form a line in hash order, repeated up to max_repeat times; the mix takes each copy whose middle
    lies before the target, so that what is taken is within half a document of it. A copy's position is the time by which its
    source's schedule wants what lies before its middle."""
    space = Workspace(docs.sparkSession, "mix")
    key = F.xxhash64("doc_id", "text", "source").alias("_key")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(docs, seed).alias("_order"), key)
    sizes = space.write(sizes, "sizes")
    targets = space.write(with_schedules(source_targets(sizes, max_repeat), schedules), "targets").withColumnRenamed("source", "_source")
    lines = running_words(sizes, space)
    rows = lines.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    size, middle = F.col("source_size"), F.col("_before") + F.col("size") / 2
    wanted = F.ceil(F.try_divide(F.col("target") - middle, size))
    copies = F.when(F.col("size") > 0, F.least(F.lit(max_repeat), F.greatest(F.lit(0), wanted))).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))
    count = F.col("copies").cast("int")
    done = lambda k: F.least(F.lit(1.0), (middle + (k - 1) * size) / F.col("target"))
    times = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: position(done(k), F.col("_area"), F.col("_stretches"))))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.coalesce(times, F.array().cast("array<double>")).alias("positions"), "_key",
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """mix() with first_position and last_position (null where nothing is taken), range-sorted by first_position: documents
    in the order in which training first meets them, then those that it never does."""
    ends = {"first_position": F.try_element_at("positions", F.lit(1)), "last_position": F.try_element_at("positions", F.lit(-1))}
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return mix(docs, **options).withColumns(ends).repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, *, position_column: str = "position", **options) -> DataFrame:
    """docs, each as often as the mix takes it, range-sorted by training position, which is a column more.

    All columns stay; should docs have one called position_column, the new one gets underscores behind it until it is free.
    Rows alike in doc_id, text and source are interchangeable: one of them stands for all of their copies."""
    space = Workspace(docs.sparkSession, "order")
    name = free_name(docs, position_column)
    taken = space.write(mix(docs, **options), "taken")
    rows = taken.groupBy("_key").agg(F.count(F.lit(1)).alias("__cl_n"))
    several = rows.where("__cl_n > 1").select(F.col("_key").alias("__cl_k"))
    times = taken.select(F.col("_key").alias("__cl_k"), F.explode("positions").alias("__cl_position"))
    keyed = docs.withColumn("__cl_key", F.xxhash64("doc_id", "text", "source"))
    alike = F.col("__cl_key") == F.col("__cl_k")
    single = keyed.join(several, alike, "left_anti")
    chosen = keyed.join(several, alike, "left_semi").dropDuplicates(["__cl_key"])
    # positions are as many as documents: the texts are shuffled for them at every size
    out = single.unionByName(chosen).join(times.hint("merge"), alike).drop("__cl_key", "__cl_k").withColumnRenamed("__cl_position", name)
    return out.repartitionByRange(name).sortWithinPartitions(name)
