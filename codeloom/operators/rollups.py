"""Rollups over levels, as repository, folder and file, with sketches that merge without a rescan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a distinct sketch's registers: a relative standard error of 1.04 / sqrt(4096), or 1.6 %.
REGISTERS = 12
#: Size of a quantile sketch: ranks are within about 1.3 %.
KEPT = 200


def sketched(rows: DataFrame, levels: list[str], distinct: str, value: str) -> DataFrame:
    """A row for each of the finest levels: n, total (of value), and sketches of distinct and of value. Store it: rolled() needs no more."""
    number = F.col(value).cast("double")
    return rows.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"), F.hll_sketch_agg(distinct, F.lit(REGISTERS)).alias("seen"), F.kll_sketch_agg_double(number, F.lit(KEPT)).alias("spread")
    )


def rolled(base: DataFrame, levels: list[str], quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Every prefix of levels, down to all rows: level (how many are given; the others are null), n, total, n_distinct and quantiles, from
    sketches alone. Rows of a level are merged from those of the next finer one, so that each merge is of what is left."""
    out, finer = None, base
    for k in range(len(levels), -1, -1):
        if k < len(levels):
            finer = finer.groupBy(*levels[:k]).agg(
                F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("seen").alias("seen"), F.kll_merge_agg_double("spread").alias("spread")
            )
        keys = [F.col(c) if c in levels[:k] else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in levels]
        points = [F.kll_sketch_get_quantile_double("spread", F.lit(q)) for q in quantiles]
        made = finer.select(*keys, F.lit(k).alias("level"), "n", "total", F.hll_sketch_estimate("seen").alias("n_distinct"), F.array(*points).alias("quantiles"))
        out = made if out is None else out.unionByName(made)
    return out
