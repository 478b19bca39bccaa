"""Line dedup by distinct-site spread: lines found on many sites are boilerplate and go.

Each line hash gets a HyperLogLog sketch of the sites that hold it; sketches are merged by aggregation, partly before the
shuffle. A line whose estimate is within the sketch's error of the limit gets an exact distinct count; every other line
is decided by its sketch. Then boilerplate lines are removed wherever they stand.

Defined results: a null text has no lines; blank lines are never removed; the null site is a site; every row is a
document of its own, also where rows share a doc_id or are equal; very long texts are one array of lines each; an empty
table gives no rows; other columns, whatever their names, play no part (remove_boilerplate returns them as they are).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Workspace
from codeloom.llm.line_frequency import normal_line


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, site, lines: hash (null where blank) and length of each line of the text."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    normal = F.transform(lines, lambda x: F.struct(normal_line(x).alias("normal"), F.length(x).alias("chars")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("site"), normal.alias("lines"))
    hashed = F.transform("lines", lambda x: F.struct(F.when(x.normal != "", F.xxhash64(x.normal)).alias("hash"), x.chars.alias("chars")))
    return rows.withColumn("lines", hashed)


def spread(rows: DataFrame, space: Workspace, min_sites: int, lg_k: int) -> DataFrame:
    """hash, sites of the lines on min_sites sites or more. sites is exact for lines near the limit."""
    held = rows.select("site", F.explode(F.array_distinct(F.transform("lines", lambda x: x.hash))).alias("hash")).where("hash is not null")
    sketches = held.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    # four standard errors of a sketch of 2**lg_k registers, and one more for rounding
    band = 1 + min_sites * 4 * 1.04 / 2 ** (lg_k / 2)
    candidates = space.write(sketches.where(F.col("sites") >= min_sites - band), "candidates")
    near = candidates.where(F.abs(F.col("sites") - min_sites) <= band).select(F.col("hash").alias("_hash"))
    exact = held.join(near, F.col("hash") == F.col("_hash"), "left_semi").groupBy("hash").agg(F.countDistinct("site").alias("sites"))
    sure = candidates.where(F.col("sites") > min_sites + band)
    return sure.unionByName(exact.where(F.col("sites") >= min_sites))


def boilerplate(docs: DataFrame, *, min_sites: int = 8, lg_k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rows of lines_of, hash and sites of boilerplate lines), both written."""
    space = Workspace(docs.sparkSession, "spread")
    rows = space.write(lines_of(docs), "rows")
    return rows, space.write(spread(rows, space, min_sites, lg_k), "boilerplate")


def spread_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (numbers of removed lines, from 0), clean_chars (length of the
    text without them)."""
    rows, boiler = boilerplate(docs, **options)
    boiler = boiler.select(F.col("hash").alias("_hash"))
    lines = rows.select("row", F.posexplode("lines").alias("at", "line")).select("row", "at", "line.hash", "line.chars")
    hits = lines.join(boiler, F.col("hash") == F.col("_hash"))
    gone = hits.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list("at")).alias("removed"), F.sum(F.col("chars") + 1).alias("_chars"))
    out = rows.join(gone, F.col("row") == F.col("_row"), "left")
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x.chars + 1)
    return out.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.greatest(F.lit(0), total - F.coalesce(F.col("_chars"), F.lit(0)) - 1).cast("long").alias("clean_chars"),
    )


def remove_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """docs with the boilerplate lines taken out of text; a text of which nothing is left becomes empty."""
    _, boiler = boilerplate(docs, **options)
    known = boiler.select(F.col("hash").alias("__cl_hash"))
    keyed = docs.withColumn("__cl_row", F.monotonically_increasing_id())
    space = Workspace(docs.sparkSession, "clean")
    keyed = space.write(keyed, "docs")
    lines = keyed.select("__cl_row", F.posexplode(F.split("text", "\n")).alias("__cl_at", "__cl_line"))
    hits = lines.join(known, F.xxhash64(normal_line(F.col("__cl_line"))) == F.col("__cl_hash"), "left_semi").where(normal_line(F.col("__cl_line")) != "")
    gone = hits.groupBy(F.col("__cl_row").alias("__cl_r")).agg(F.collect_list("__cl_at").alias("__cl_gone"))
    out = keyed.join(gone, F.col("__cl_row") == F.col("__cl_r"), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, k: ~F.array_contains("__cl_gone", k)), "\n")
    return out.withColumn("text", F.when(F.col("__cl_gone").isNull(), F.col("text")).otherwise(left)).drop("__cl_row", "__cl_r", "__cl_gone")
