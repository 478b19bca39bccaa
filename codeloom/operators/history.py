"""Histories: snippets and chat messages as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codeloom.operators.triage import score_color

PAGE, MEMORY = 50, 12
#: Rows that quantiles are taken from, and the parts between them.
SAMPLED, MOST_PARTS = 10_000, 256
# What a snippet without a value gets.
DEFAULTS = {"title": "untitled.py", "code": "", "language": "python", "style_score": 0, "error_count": 0, "style_issue_count": 0}


def with_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in rows.columns else F.lit(v) for n, v in DEFAULTS.items()})


def parted(rows: DataFrame, order: str) -> DataFrame:
    """rows with _key (order, and a hash of the row that parts equal ones) and _part, from 0: between quantiles of the keys, found in a
    sample of at most about SAMPLED rows, so that no value, outlier or null makes one part larger than others."""
    own = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]
    keyed = rows.withColumn("_key", F.struct(F.col(order).alias("o"), F.xxhash64(*own).alias("h")))
    n = rows.count()
    some = keyed.where(F.pmod(F.xxhash64("_key.h", F.lit(1)), F.lit(max(1, n // SAMPLED))) == 0).select("_key")
    sample = [r._key for r in some.orderBy("_key").collect()]
    parts = min(MOST_PARTS, math.isqrt(n) + 1, len(sample) + 1)
    cuts = [tuple(sample[k * len(sample) // parts]) for k in range(1, parts)]
    known = rows.sparkSession.createDataFrame([(cuts,)], T.StructType([T.StructField("_cuts", T.ArrayType(keyed.schema["_key"].dataType))]))
    return keyed.crossJoin(F.broadcast(known)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")


def numbered_after(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """rows with ids that go on after the largest existing one, in the given order. Numbers are dealt out in parts, whose sizes, summed
    up first, say where each one's numbers begin."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    dealt = parted(rows, order)
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(ahead, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    numbered = dealt.withColumn("_place", place).join(F.broadcast(sizes), "_part").crossJoin(F.broadcast(last))
    return numbered.withColumn("id", (F.col("_last") + F.col("_ahead") + F.col("_place")).cast("long")).drop("_part", "_place", "_ahead", "_last", "_key")


def latest(rows: DataFrame, limit: int = PAGE) -> DataFrame:
    return rows.orderBy(F.desc("id")).limit(limit)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose id is not deleted; rows of other tables that name a deleted id stay."""
    return rows.join(ids.select("id"), "id", "left_anti")


def display(snippets: DataFrame) -> DataFrame:
    return snippets.withColumns({
        "score_color": score_color(F.col("style_score")), "has_errors": F.coalesce("error_count", F.lit(0)) > 0,
        "date_display": F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit("")),
    })


def upsert_by_name(files: DataFrame, uploads: DataFrame) -> DataFrame:
    """files (ord, name, code) with the code of uploads put in place by name; new names follow, in upload order.

    Of several uploads of a name the last one counts; names keep their first place. Both sides are pre-aggregated by name."""
    final = uploads.groupBy("name").agg(F.max_by("code", "ord").alias("_new"), F.min("ord").alias("_at"))
    last = files.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"))
    joined = files.select("ord", "name", "code", F.lit(True).alias("_old")).join(final, "name", "full")
    moved = joined.crossJoin(F.broadcast(last)).withColumn("ord", F.coalesce(F.col("ord"), F.col("_last") + 1 + F.col("_at")))
    return moved.select("ord", "name", F.coalesce("_new", "code").alias("code"))


def renamed(files: DataFrame, old: str, new: str) -> DataFrame:
    """files (name) with one renamed, if there is one of the old name and none of the new."""
    taken = files.where(F.col("name") == new).limit(1).agg((F.count(F.lit(1)) > 0).alias("_taken"))
    name = F.when((F.col("name") == old) & ~F.col("_taken"), F.lit(new)).otherwise(F.col("name"))
    return files.crossJoin(F.broadcast(taken)).withColumn("name", name).drop("_taken")


def with_new_file(files: DataFrame, stem: str = "file", ending: str = ".py") -> DataFrame:
    """files (ord, name, code) with an empty one more, last, called by how many there are then: of two files, file_3.py is the new one. If
    that name is taken the next free number counts."""
    number = F.try_element_at(F.regexp_extract_all("name", F.lit(rf"\A{stem}_([0-9]+)\{ending}\z"), F.lit(1)), F.lit(1)).cast("int")
    known = files.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_last"), F.count(F.lit(1)).cast("int").alias("_n"), F.collect_set(number).alias("_taken"))
    free = F.array_min(F.array_except(F.sequence(F.col("_n") + 1, F.col("_n") + F.size("_taken") + 1), "_taken"))
    new = known.select((F.col("_last") + 1).alias("ord"), F.concat(F.lit(f"{stem}_"), free.cast("string"), F.lit(ending)).alias("name"), F.lit("").alias("code"))
    return files.select("ord", "name", "code").unionByName(new)


def with_snippets(messages: DataFrame, snippets: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Messages beside the columns of the snippet that they are about."""
    return messages.join(snippets.withColumnRenamed("id", "_snippet"), F.col(key) == F.col("_snippet")).drop("_snippet")


def sidebar(snippets: DataFrame, limit: int = PAGE) -> DataFrame:
    """What a list of saved snippets shows: the latest ones, as display() has them."""
    return display(latest(snippets, limit)).orderBy(F.desc("id"))


def remove_file(files: DataFrame, name: str) -> DataFrame:
    """files without the named one, unless nothing would be left."""
    rest = files.where(F.col("name") != name)
    return rest if not rest.isEmpty() else files


def recent_messages(messages: DataFrame, key: str, order: str, memory: int = MEMORY) -> DataFrame:
    """The last messages of each conversation, oldest first by order; roles other than user are assistant."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    kept = messages.withColumn("_n", newest).where(F.col("_n") <= memory).drop("_n")
    return kept.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("assistant"))


def chat_history(messages: DataFrame, snippet_id: int) -> DataFrame:
    return messages.where(F.col("snippet_id") == snippet_id).orderBy("id")


def open_by_path(scan: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The file of a scanned path, found by its file name: the first of that name (names may collide)."""
    name = scan.where(F.col("path") == path).orderBy("ord").limit(1).select("filename")
    return files.join(F.broadcast(name), F.col("name") == F.col("filename"), "left_semi").orderBy("ord").limit(1)
