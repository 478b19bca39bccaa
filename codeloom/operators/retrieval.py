"""Chunks of source files, and their ranking by BM25 or by vector distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import is_blank, split_lines, text, tokens
from codeloom.operators import blockwise
from codeloom.operators.rules import computed_once, exploded

WINDOW, STEP, CUT = 60, 30, 2000
K1, B = 1.5, 0.75
#: Bytes of query vectors, and vectors, that meet at once.
BLOCK_BYTES, BLOCK_ROWS = 32_000_000, 8192


def windows(lines: Column, *, window: int = WINDOW, step: int = STEP, cut: int = CUT) -> Column:
    """Overlapping windows of an array of lines, as array of name, line, kind and code."""
    count = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), count) - 1, F.lit(step))

    def made(start: Column) -> Column:
        name = F.concat(F.lit("lines "), (start + 1).cast("string"), F.lit("-"), F.least(start + window, count).cast("string"))
        body = F.substring(F.array_join(F.slice(lines, start + 1, F.lit(window)), "\n"), 1, cut)
        return F.struct(name.alias("name"), (start + 1).alias("line"), F.lit("block").alias("kind"), body.alias("code"))

    return F.transform(starts, made)


def line_chunks(files: DataFrame, *, window: int = WINDOW, step: int = STEP, cut: int = CUT) -> DataFrame:
    """Overlapping windows of lines of each non-blank file (path, code): one row per chunk, ord from 0 in the file.

    Windows are made from the file's own array; nothing is shuffled."""
    lines = computed_once(files.where(~is_blank(F.col("code"))), "_lines", split_lines(F.col("code")))
    return chunk_rows(lines, windows(F.col("_lines"), window=window, step=step, cut=cut)).drop("_lines")


def chunk_rows(files: DataFrame, chunks: Column) -> DataFrame:
    """A row for each of the chunks of files (path, code), with ord from 0, id and text; windows are called by their first line,
    others by their name, and a whole file by its path."""
    rest = [c for c in files.columns if c != "code"]
    rows = exploded(files.withColumn("_chunks", chunks), "_chunks", "ord", *rest).select("*", "_i.*").drop("_i")
    own = F.when(F.col("kind") == "block", F.concat(F.lit("L"), F.col("line").cast("string"))).when(F.col("kind") != "file", F.col("name"))
    named = rows.withColumn("id", F.coalesce(F.concat("path", F.lit("::"), own), F.col("path")))
    return named.withColumn("text", F.concat_ws(" ", "path", "name", text("code")))


def repo_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("kind") == k)
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_chunks"), kind("function").alias("functions"), kind("method").alias("methods"),
        kind("class").alias("classes"), F.countDistinct("path").alias("files"),
    )


def term_counts(docs: DataFrame, key: str, value: str = "text") -> DataFrame:
    """key, term, tf, dl: counts inside each document, from its own array. Documents without terms have no rows."""
    words = docs.select(key, tokens(F.col(value)).alias("_t"))
    exploded = words.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return exploded.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, value: str = "text") -> DataFrame:
    """term, df. Each document gives a term once, before anything is shuffled."""
    once = docs.select(F.explode(F.array_distinct(tokens(F.col(value)))).alias("term"))
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", *, top: int = 4, value: str = "text", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, key, score, rank of the best documents of each query; scores above 0, ties by key.

    Only terms that some query asks for leave the documents: the query terms meet each document's terms by a join on the
    term whose query side the planner broadcasts if its measured size allows. A query without terms gets the first
    documents in key order, unscored."""
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    docs_only = docs.select(key, tokens(F.col(value)).alias("_t"))
    stats = docs_only.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_t")).alias("words"))
    vocabulary = asked.select("term").distinct()
    held = docs_only.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(vocabulary, "term", "left_semi")
    counts = held.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    average = F.col("words") / F.greatest(F.col("n"), F.lit(1))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.nullif(average, F.lit(0.0))))
    scored = counts.join(df, "term").crossJoin(F.broadcast(stats)).select(key, "term", (idf * norm).alias("_s"))
    sums = asked.join(scored, "term").groupBy(query_key, key).agg(F.round(F.sum("_s"), 9).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    ranked = sums.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= top) & (F.col("score") > 0))
    silent = queries.where(F.size(tokens(F.col(query_text))) == 0).select(query_key)
    first = docs.select(key).orderBy(key).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(key)))
    without = silent.crossJoin(F.broadcast(first)).select(query_key, key, F.lit(None).cast("double").alias("score"), "rank")
    return ranked.select(query_key, key, "score", "rank").unionByName(without)


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two float arrays, summed as doubles in order."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, queries: DataFrame, *, top: int = 4, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """query_id, key, distance, rank: exact nearest vectors of each stated query, ties by key.

    Every vector meets every query of its length: blocks of vectors meet blocks of queries (of BLOCK_BYTES at most), each pair of blocks
    in memory, and only the best of each query in a block are shuffled. Vectors that are null, or hold a null, have no part in it; a query
    that does is near to nothing, and gets the first vectors in order of keys without a distance."""
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(F.coalesce(F.col(c), F.array()), lambda x: x.isNull())
    held, asking = vectors.where(whole(vector)), queries.where(whole(query_vector))
    n, size = held.count(), asking.agg(F.sum(8 * F.size(query_vector) + 32).alias("n")).first().n or 0
    parts, blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-size // BLOCK_BYTES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    some = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    rows = held.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.size(vector).alias("length"), some(key, parts).alias("part"), every(blocks).alias("block"))
    asked = asking.select(F.col(query_key).alias("query"), F.col(query_vector).alias("q"), F.size(query_vector).alias("length"), some(query_key, blocks).alias("block"), every(parts).alias("part"))
    found = blockwise.nearest_in(rows, asked, ["length", "part", "block"], top).select(F.col("query").alias(query_key), F.col("key").alias(key), "distance")
    first = vectors.select(key).orderBy(key).limit(top)
    without = queries.where(~whole(query_vector)).select(query_key).crossJoin(F.broadcast(first)).select(query_key, key, F.lit(None).cast("double").alias("distance"))
    best = Window.partitionBy(query_key).orderBy("distance", key)
    return found.unionByName(without).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def retrieve(keyword: DataFrame, vector: DataFrame | None, query_key: str = "query_id") -> DataFrame:
    """Vector results of each query that has any, keyword results of the others."""
    if vector is None:
        return keyword
    rest = keyword.join(vector.select(query_key).distinct(), query_key, "left_anti")
    return vector.unionByName(rest, allowMissingColumns=True)


def context_text(results: DataFrame, *keys: str, cut: int = 800) -> DataFrame:
    """keys, context: the chunks of each query as fenced text in order of rank. One row per query."""
    head = F.format_string("// %s — %s `%s` (line %d)\n```\n%s\n```", "path", "kind", "name", "line", F.substring("code", 1, cut))
    listed = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("part")))).alias("_parts"))
    return listed.select(*keys, F.array_join(F.transform("_parts", lambda p: p.part), "\n\n").alias("context"))
