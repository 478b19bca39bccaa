"""A stored keyword index: postings by term in blocks, each with its largest impact, and BM25 search that skips blocks.

Documents are numbered as they are tokenised, once, and every SPAN numbers make a span. A block holds the postings of one term in one
span, so that no group grows with the corpus, and blocks of different terms in a span speak of the same documents. A search takes
the heads of the asked terms' blocks first: the sum of their impacts is more than any document of the span can score, the
largest is less than its best document scores. Spans whose sum stays below the k-th best of what is surely reached have no part
in the first k. Only the blocks of the other spans are read for scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import tokens
from codeloom.operators import blockwise
from codeloom.operators.retrieval import B, K1

SPAN = 128
#: Folders of terms, of which a search opens those of its terms.
BUCKETS = 32
#: Spans whose documents are scored together.
STRETCH = 64
#: Documents that are made into blocks at once, and blocks that are handed on at once.
DOCUMENTS, ROWS = 4096, 50_000
#: More than rounding can add to a sum.
SLACK = 1e-7


def impact(tf: Column | np.ndarray, dl: Column | np.ndarray, average: float) -> Column | np.ndarray:
    """What an occurrence weighs, before the rarity of its term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / (average or 1.0)))


def block_rows(average: float, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """term, span, top, held, postings of the texts (key, id, words) of a task. A span that lies in two batches has two blocks of a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                keys, ids, words = batch.columns
                terms, n = words.flatten().dictionary_encode(), batch.num_rows
                inside = words.value_parent_indices().to_numpy().astype(np.int64)
                if not len(terms):
                    continue
                cells, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * n + inside, return_counts=True)
                term, doc = np.divmod(cells, n)
                weight = impact(tf, np.bincount(inside, minlength=n)[doc], average)
                place = (ids.to_numpy() // span)[doc]
                starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
                ends = np.r_[starts, len(cells)].astype(np.int32)
                postings = pa.StructArray.from_arrays([keys.take(pa.array(doc)), pa.array(weight)], ["key", "weight"])
                made = {
                    "term": terms.dictionary.take(pa.array(term[starts])), "span": pa.array(place[starts]), "top": pa.array(np.maximum.reduceat(weight, starts)),
                    "held": pa.array(np.diff(ends).astype(np.int64)), "postings": pa.ListArray.from_arrays(pa.array(ends), postings),
                }
                yield from pa.Table.from_pydict(made).to_batches(max_chunksize=ROWS)

    return run


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class KeywordIndex:
    """The index of one collection in a folder: tables documents (key, id, dl), terms (term, idf) and blocks (term, span, top,
    postings), and the numbers of documents and words. It is replaced as a whole by build()."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _columns(self) -> str:
        key = self._read("documents").schema["key"].dataType.simpleString()
        return f"term string, span bigint, top double, held bigint, postings array<struct<key:{key},weight:double>>"

    def _blocks(self) -> DataFrame:
        """Blocks, also where there are none, and so no files that say what they would hold."""
        return self.spark.read.schema(f"{self._columns()}, bucket int").parquet(f"{self.folder}/blocks")

    def build(self, docs: DataFrame, key: str, value: str = "text", span: int = SPAN) -> KeywordIndex:
        """Indexes docs by a column whose values are unique. Texts are read twice, for their lengths and for their blocks, which are made
        where the texts lie: nothing but the terms' numbers of documents is shuffled."""
        split = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("id"), tokens(F.col(value)).alias("words"))
        split.select("key", "id", F.size("words").alias("dl")).write.mode("overwrite").parquet(f"{self.folder}/documents")
        n, words = self._read("documents").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        blocks = split.mapInArrow(block_rows(words / max(1, n), span), self._columns()).withColumn("bucket", bucket(F.col("term")))
        blocks.sortWithinPartitions("bucket", "term", "span").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/blocks")
        frequency = self._blocks().groupBy("bucket", "term").agg(F.sum("held").alias("df"))
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        frequency.select("bucket", "term", "df", idf.alias("idf")).write.mode("overwrite").parquet(f"{self.folder}/terms")
        return self

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/terms/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def weights(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """query, term, bucket, idf of the terms of queries that some document has."""
        asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
        asked = asked.withColumn("bucket", bucket(F.col("term")))
        return asked.join(self._read("terms").drop("df"), ["bucket", "term"])

    def live_spans(self, weights: DataFrame, top: int) -> DataFrame:
        """query, span: where documents of the first top may be."""
        heads = self._blocks().select("bucket", "term", "span", "top")
        reach = heads.join(weights, ["bucket", "term"]).groupBy("query", "span").agg(
            F.sum(F.col("idf") * F.col("top")).alias("most"), F.max(F.col("idf") * F.col("top")).alias("least")
        )
        sure = reach.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("least"), "span"))).where(F.col("k") <= top)
        # the k-th largest of what spans surely reach; with fewer spans nothing is sure
        bar = sure.groupBy(F.col("query").alias("_query")).agg(F.min(F.when(F.col("k") == top, F.col("least"))).alias("bar"), F.max("k").alias("_n"))
        bar = bar.select("_query", F.coalesce("bar", F.lit(0.0)).alias("bar"))
        return reach.join(bar, F.col("query") == F.col("_query")).where(F.col("most") >= F.col("bar") - SLACK).select("query", "span")

    def postings(self, queries: DataFrame, *, top: int = 4, query_key: str = "query_id", query_text: str = "query", prune: bool = True) -> DataFrame:
        """query, idf, postings: the blocks that a search reads for scoring."""
        weights = self.weights(queries, query_key, query_text)
        blocks = self._blocks().select("bucket", "term", "span", "postings")
        if not prune:
            return blocks.join(weights, ["bucket", "term"]).select("query", "idf", "postings")
        live = self.live_spans(weights, top).join(weights.withColumnRenamed("query", "_q"), F.col("query") == F.col("_q")).drop("_q")
        return blocks.join(live, ["bucket", "term", "span"]).select("query", "idf", "postings")

    def search(self, queries: DataFrame, *, top: int = 4, key: str = "doc_id", query_key: str = "query_id", query_text: str = "query", prune: bool = False) -> DataFrame:
        """query_id, key, score, rank of the best documents of each query, as retrieval.bm25 gives them; a query without terms gets
        the first documents in order of keys, unscored. The blocks of all asked terms are read once and meet the questions in stretches
        of documents, of which each gives its own best; with prune, spans that no question needs are left out by their heads."""
        weights = self.weights(queries, query_key, query_text)
        stretch = F.expr(f"span div {STRETCH}").alias("stretch")
        blocks = self._blocks().join(weights.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        if prune:
            blocks = blocks.join(self.live_spans(weights, top).select("span").distinct(), "span", "left_semi")
        everywhere = self._blocks().select(stretch).distinct()
        asked = weights.select("query", "term", "idf").crossJoin(F.broadcast(everywhere))
        scores = blockwise.heaviest_in(blocks.select(stretch, "term", "postings"), asked, "stretch", top).withColumn("score", F.round("score", 9))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        ranked = scores.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= top) & (F.col("score") > 0)).select("query", "key", "score", "rank")
        silent = queries.where(F.size(tokens(F.col(query_text))) == 0).select(F.col(query_key).alias("query"))
        first = self._read("documents").select("key").orderBy("key").limit(top).withColumn("rank", F.row_number().over(Window.orderBy("key")))
        without = silent.crossJoin(F.broadcast(first)).select("query", "key", F.lit(None).cast("double").alias("score"), "rank")
        return ranked.unionByName(without).select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank")
