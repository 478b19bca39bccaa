"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated 5-word windows of a text. The method hashes normalised lines,
counts for each host (source) the distinct documents that hold a line, takes away the lines above the host's limit, and
rejects documents that keep too little of their words.

Defined results: a null text has no words and fails the base rules; the null source is a host; every row is a document
of its own, also where rows share a doc_id or are equal; very long texts are one array of words each; an empty table gives
no rows; other columns, whatever their names, play no part (remove_lines returns them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Workspace

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def base_counts(docs: DataFrame) -> DataFrame:
    """One pass over the texts without a shuffle: counts of the base rules, and hash and words of each line.

    Repeated windows: windows are hashed from word hashes, and only where two are equal in a text are (hash, place) pairs
    sorted. The words under windows at places p1 < p2 < ... are WINDOW for the last and min(WINDOW, p(k+1) - p(k)) for
    each other, so that n words cost n log n whatever their repetition. Hashes have 64 bits: two different windows of one
    text of 20,000 words meet by chance once in 10^11 texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = lambda s: F.filter(F.split(s, SPACES), lambda w: w != "")
    row = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), "doc_id", "source", text.alias("text"), words(text).alias("w"), lines.alias("lines"))
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    rows = rows.select(
        "row", "doc_id", "source", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"), F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("hash"), F.size(words(x)).alias("words"))).alias("lines"),
    )
    n = F.size("h") - (WINDOW - 1)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    windows = F.when(n >= 1, F.transform(places, lambda k: F.xxhash64(*[F.get("h", k + j) for j in range(WINDOW)])))
    rows = rows.withColumn("windows", windows)
    pairs = F.array_sort(F.transform("windows", lambda x, k: F.struct(x.alias("x"), k.alias("k"))))
    rows = rows.withColumn("pairs", F.when(F.size("windows") > F.size(F.array_distinct("windows")), pairs))
    same = lambda p, k: p.x.eqNullSafe(F.get("pairs", k).x)
    twice = F.filter("pairs", lambda p, k: ((k > 0) & same(p, k - 1)) | same(p, k + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda p: p.k)))
    spans = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.get("at", k + 1) - p))
    total = F.coalesce(F.aggregate(spans, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", total).drop("h", "windows", "pairs", "at")


def frequent_lines(rows: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """source, hash of the lines that more documents of the host hold than its limit: the larger of min_docs and
    max_share of its documents. Counts are pre-aggregated before the shuffle; a document counts a line once."""
    hosts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_docs"))
    held = rows.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x.hash))).alias("hash"))
    counts = held.groupBy("source", "hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_docs)
    joined = counts.join(hosts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return joined.where(F.col("_n") > max_share * F.col("_docs")).select("source", "hash")


def judged(docs: DataFrame, space: Workspace, *, min_docs: int = 20, max_share: float = 0.02, min_words_left: int = 10, min_share_left: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, base counts, n_removed_words, base_failed, kept) of docs, and (_row, _hash, _words) of the lines that go from
    each row. docs may have a column row of the caller's numbers."""
    rows = space.write(base_counts(docs), "rows")
    frequent = space.write(frequent_lines(rows, min_docs, max_share), "frequent")
    frequent = frequent.select(F.col("source").alias("_source"), F.col("hash").alias("_hash"))
    # the written table is small or not as its size tells the planner; a hot line's rows are split at run time
    lines = rows.select("row", "source", F.explode("lines").alias("line")).select("row", "source", "line.hash", "line.words")
    hits = lines.join(frequent, (F.col("hash") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source")))
    going = hits.select(F.col("row").alias("_row"), "_hash", F.col("words").alias("_words"))
    gone = going.groupBy("_row").agg(F.sum("_words").alias("_gone"))
    out = rows.drop("lines").join(gone, F.col("row") == F.col("_row"), "left")
    out = out.withColumn("n_removed_words", F.coalesce(F.col("_gone"), F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    kept = ~failed & (left >= min_words_left) & (left >= min_share_left * F.col("n_words"))
    return out.withColumn("kept", kept).drop("_row", "_gone", "source"), going


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, n_removed_words (in lines above the host's limit), base_failed, kept.

    A line is above its host's limit where more than min_docs and max_share of the host's documents hold it. kept: not
    base_failed, and at least min_words_left words and min_share_left of all words are left."""
    space = Workspace(docs.sparkSession, "lines")
    return judged(docs.select("doc_id", "source", "text"), space, **options)[0].drop("row")


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents that quality() keeps, without the lines above their host's limit; all columns stay.

    Other lines, blank ones too, stay as they are, so that offsets inside them do not move."""
    space = Workspace(docs.sparkSession, "lines")
    keyed = space.write(docs.withColumn("__cl_row", F.monotonically_increasing_id()), "docs")
    verdicts, going = judged(keyed.select(F.col("__cl_row").alias("row"), "doc_id", "source", "text"), space, **options)
    kept = verdicts.where("kept").select(F.col("row").alias("__cl_kept"))
    gone = going.groupBy(F.col("_row").alias("__cl_r")).agg(F.collect_set("_hash").alias("__cl_gone"))
    out = keyed.join(kept, F.col("__cl_row") == F.col("__cl_kept")).join(gone, F.col("__cl_row") == F.col("__cl_r"), "left")
    stays = lambda x: ~F.array_contains("__cl_gone", F.xxhash64(normal_line(x))) | ~x.rlike(r"[^\x20\x09-\x0D]")
    text = F.when(F.col("__cl_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    return out.withColumn("text", text).drop("__cl_row", "__cl_kept", "__cl_r", "__cl_gone")
