"""Ranks with ties inside groups, by a distributed counting sort.

Rows of a group are ordered by a pair (few values, many ties) and, within equal pairs, by further columns. Wanted are the
rows of the first few distinct pairs of each group, with their position in the group. Sorting a group in one task would not
do: one group may hold a third of all rows, and so may one pair.

1. Prune: a row can only be among the first pairs of its group if its pair is among the first of the group in its own
   partition. The limit is applied to each partition's rows before anything is shuffled.
2. Count: a matrix per group of partitions by pairs. Its column sums say how many rows have a pair; exclusive prefix sums over
   the first pairs of the group allocate to each pair its slots, the positions from base on.
3. Scatter: a row meets the cell of its own partition and pair, which holds the pair's slots. A cell stands for no more rows
   than a partition has, so that hot groups and pairs are spread as the partitions are. Rows of later pairs have no cell.
4. Split: the bucket of a pair with more than chunk rows is split at keys sampled from it, into at most fan buckets whose counts
   again have exclusive prefix sums; what is still large is split again. A row's own number is the last part of its key, so that
   even rows that are equal in every column can be parted.
5. Sort: buckets of about chunk rows are sorted, each by itself; a row's position is the bucket's base and its place there.

No step sends rows to the driver, broadcasts anything that grows with them, or has a task that sees a whole group or pair.

Defined results: nulls come last in each column and equal each other, in groups too; equal rows are ranked one by one, in any
order among themselves; an empty table gives no rows; of the columns of the table only the named ones play a part.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Workspace

#: Rows of a bucket that meet one copy of what is known about it.
SALTED = 500_000
#: Sampled keys for each bucket that a split makes.
SAMPLES = 8


def nulls_last(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`").asc_nulls_last() for n in names]


def key_of(names: list[str]) -> Column:
    """A struct whose order is that of the columns, nulls last."""
    return F.struct(*itertools.chain.from_iterable((F.col(f"`{n}`").isNull().alias(f"e{k}"), F.col(f"`{n}`").alias(f"v{k}")) for k, n in enumerate(names)))


def meet(rows: DataFrame, known: DataFrame, on: list[str], *values: str) -> DataFrame:
    """rows with the values of known, which has one row for each combination of on; nulls meet nulls."""
    mine = known.select(key_of(on).alias("__cl_k"), *values)
    return rows.join(mine, key_of(on) == F.col("__cl_k")).drop("__cl_k")


def meet_bucket(rows: DataFrame, known: DataFrame, bucket: list[str], *values: str) -> DataFrame:
    """meet() for rows of large buckets: known has one row a bucket, of which every SALTED rows get a copy of their own."""
    copies = F.expr(f"sequence(0, (__cl_held - 1) div {SALTED})")
    salted = known.withColumn("__cl_salt", F.explode(copies))
    salt = F.pmod(F.xxhash64(F.lit(11), "__cl_id"), F.expr(f"(__cl_held - 1) div {SALTED} + 1"))
    return meet(rows.withColumn("__cl_salt", salt), salted, [*bucket, "__cl_salt"], *values).drop("__cl_salt")


def prefix(over: Window, value: str) -> Column:
    """The sum of value over all rows before."""
    return F.coalesce(F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def pruned(rows: DataFrame, group: list[str], pair: list[str], top: int) -> DataFrame:
    """rows with __cl_id (number) and __cl_part (partition), without those whose pair comes after top others of the group in
    the same partition."""
    own = rows.withColumn("__cl_id", F.monotonically_increasing_id()).withColumn("__cl_part", F.shiftright("__cl_id", 33).cast("int"))
    place = F.dense_rank().over(Window.partitionBy(*group, "__cl_part").orderBy(*nulls_last(pair)))
    return own.withColumn("__cl_place", place).where(F.col("__cl_place") <= top).drop("__cl_place")


def count_matrix(rows: DataFrame, group: list[str], pair: list[str]) -> DataFrame:
    """Cells: rows of each group, pair and partition."""
    return rows.groupBy(*group, *pair, "__cl_part").agg(F.count(F.lit(1)).alias("__cl_n"))


def slots(matrix: DataFrame, group: list[str], pair: list[str], top: int) -> DataFrame:
    """place, tied (rows of the pair) and base (rows of earlier pairs) of the first top pairs of each group."""
    totals = matrix.groupBy(*group, *pair).agg(F.sum("__cl_n").alias("__cl_tied"))
    earlier = Window.partitionBy(*group).orderBy(*nulls_last(pair))
    first = totals.withColumn("__cl_place", F.row_number().over(earlier)).where(F.col("__cl_place") <= top)
    return first.withColumn("__cl_base", prefix(earlier, "__cl_tied"))


def split(large: DataFrame, group: list[str], order: list[str], fan: int, again: int, space: Workspace) -> DataFrame:
    """large with each bucket (group, __cl_base, __cl_held rows) parted at sampled keys into up to fan buckets."""
    bucket = [*group, "__cl_base"]
    key = F.struct(key_of(order).alias("o"), F.col("__cl_id").alias("i"))
    step = F.greatest(F.lit(1), F.expr(f"__cl_held div {SAMPLES * fan}"))
    some = large.where(F.pmod(F.xxhash64(F.lit(again), "__cl_id"), step) == 0)
    some = some.groupBy(*bucket, "__cl_held").agg(F.array_sort(F.collect_list(key)).alias("__cl_s"))
    width = F.greatest(F.lit(1), F.ceil((F.size("__cl_s") + 1) / F.lit(fan))).cast("int")
    cuts = F.filter("__cl_s", lambda x, k: (k + 1) % width == 0)
    cuts = space.write(some.select(*bucket, "__cl_held", cuts.alias("__cl_cuts")), f"cuts-{again}")
    # a bucket of which no row was sampled stays as it is, and is sampled anew
    kept = space.write(large.groupBy(*bucket, "__cl_held").agg(F.lit(1).alias("__cl_one")), f"buckets-{again}")
    mine = key_of([*bucket])
    cuts = kept.join(cuts.select(mine.alias("__cl_k"), "__cl_cuts"), mine == F.col("__cl_k"), "left").drop("__cl_k", "__cl_one")
    parted = meet_bucket(large, cuts, bucket, "__cl_cuts")
    parted = parted.withColumn("__cl_at", F.coalesce(F.size(F.filter("__cl_cuts", lambda c: c <= key)), F.lit(0))).drop("__cl_cuts")
    parted = space.write(parted, f"parted-{again}")
    counts = parted.groupBy(*bucket, "__cl_held", "__cl_at").agg(F.count(F.lit(1)).alias("__cl_n"))
    counts = counts.withColumn("__cl_to", F.col("__cl_base") + prefix(Window.partitionBy(*bucket).orderBy("__cl_at"), "__cl_n"))
    new = counts.groupBy(*bucket, "__cl_held").agg(F.map_from_entries(F.collect_list(F.struct("__cl_at", F.struct("__cl_to", "__cl_n")))).alias("__cl_new"))
    moved = meet_bucket(parted, space.write(new, f"counts-{again}"), bucket, "__cl_new").withColumn("__cl_new", F.element_at("__cl_new", F.col("__cl_at")))
    return moved.withColumns({"__cl_base": F.col("__cl_new.__cl_to"), "__cl_held": F.col("__cl_new.__cl_n")}).drop("__cl_new", "__cl_at")


def ranked(rows: DataFrame, group: list[str], pair: list[str], order: list[str], *, carry: list[str] | None = None, top: int = 5, chunk: int = 2000, fan: int = 64) -> DataFrame:
    """The rows of the first top distinct pairs of each group: columns group, pair, order and carry, with place (1 plus the
    distinct earlier pairs), pos (from 1 in order of pair and order) and tied (rows of the group with the same pair)."""
    named = list(dict.fromkeys([*group, *pair, *order, *(carry or [])]))
    if taken := {"place", "pos", "tied"} & set(named):
        raise ValueError(f"columns of the result: {sorted(taken)}")
    space = Workspace(rows.sparkSession, "ranking")
    own = space.write(pruned(rows.select(*[F.col(f"`{n}`") for n in named]), group, pair, top), "rows")
    matrix = space.write(count_matrix(own, group, pair), "matrix")
    first = space.write(slots(matrix, group, pair, top), "slots")
    cells = meet(matrix, first, [*group, *pair], "__cl_place", "__cl_tied", "__cl_base")
    now = meet(own, space.write(cells, "cells"), [*group, *pair, "__cl_part"], "__cl_place", "__cl_tied", "__cl_base")
    now = space.write(now.drop("__cl_part").withColumn("__cl_held", F.col("__cl_tied")), "scattered-0")
    for dead in ("rows", "matrix", "slots", "cells"):
        space.drop(dead)
    done = now.where(F.col("__cl_held") <= chunk)
    for again in itertools.count(1):
        large = now.where(F.col("__cl_held") > chunk)
        if large.isEmpty():
            break
        now = space.write(split(large, group, order, fan, again, space), f"scattered-{again}")
        for dead in ("cuts", "buckets", "parted", "counts"):
            space.drop(f"{dead}-{again}")
        done = done.unionByName(now.where(F.col("__cl_held") <= chunk))
    inside = Window.partitionBy(*group, "__cl_base").orderBy(*nulls_last(order), "__cl_id")
    pos = F.col("__cl_base") + F.row_number().over(inside)
    return done.select(*named, F.col("__cl_place").cast("long").alias("place"), pos.cast("long").alias("pos"), F.col("__cl_tied").alias("tied"))


def sale_lines_ranked(lines: DataFrame, *, top: int = 5, chunk: int = 2000, fan: int = 64) -> DataFrame:
    """ranked() for lines of sales (sale_id, line_no, item_id, vendor_id, quantity, amount, discount, shipped_at): groups of vendor,
    item parity and month, sales whose number's crc32 is divisible by 5 together in one; quantities in tens, then percent.
    Amounts and discounts that are no finite numbers count as null."""
    hundredths = lambda c: F.floor(100 * F.when(F.abs(c) < float("inf"), F.col(c)) + 0.5)
    together = F.coalesce(F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    month = F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))
    parts = {"vendor_id": F.col("vendor_id"), "part": F.coalesce(F.pmod("item_id", F.lit(2)), F.lit(-1)), "month": month}
    rows = lines.select(
        *[F.when(together, F.lit(-1)).otherwise(c).cast("long").alias(n) for n, c in parts.items()], (-F.expr("(quantity - pmod(quantity, 10)) div 10")).cast("long").alias("tens"),
        hundredths("discount").alias("percent"), *[F.col(c).cast("long").alias(c) for c in ("sale_id", "line_no", "quantity")], hundredths("amount").alias("amount_cents"),
    )
    out = ranked(rows, ["vendor_id", "part", "month"], ["tens", "percent"], ["sale_id", "line_no", "quantity", "amount_cents"], top=top, chunk=chunk, fan=fan)
    return out.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")
