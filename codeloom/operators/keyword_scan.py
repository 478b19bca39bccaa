"""BM25 of many questions over texts that no index holds, in two readings of the texts and without their postings as rows.

The first reading counts in how many texts each asked term stands; in the second, stretches of texts meet all questions as arrays and give their
own best. What is shuffled grows with the questions and the stretches, not with the texts' words. The asked terms lie in a shared folder, from
which each task reads them: they have to fit into one task's memory, about 100 bytes a term of a question."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import tokens
from codeloom.operators import blockwise
from codeloom.operators.retrieval import B, K1

#: Texts that meet the questions at once, and texts, or characters, that are split into words at once.
STRETCH, SOME, CHARS = 16_384, 1024, 4 << 20
#: bytes -> bytes: of lowered ASCII what is no letter or digit made a space, and of other characters every byte.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """What functions.text.tokens finds: lower-case runs of ASCII letters and digits."""
    return (text or "").lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


def read_table(uri: str) -> pa.Table:
    """A Parquet table of the shared folder, read by a task."""
    parsed = urlparse(uri)
    fs, path = (pafs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else pafs.FileSystem.from_uri(uri)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
    return pads.dataset(sorted(files), format="parquet", filesystem=fs).to_table()


def cells(texts: list[str | None], vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, times) of asked terms in texts, by term and text, and the number of words of each text."""
    found, lengths, start = [], np.zeros(len(texts), np.int64), 0
    while start < len(texts):
        flat, owner, stop, chars = [], [], start, 0
        while stop < len(texts) and stop - start < SOME and chars < CHARS:
            held = words(texts[stop])
            flat += held
            lengths[stop], chars, stop = len(held), chars + len(texts[stop] or ""), stop + 1
        term = pc.index_in(pa.array(flat, pa.binary()), value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(start, stop), lengths[start:stop])[term >= 0]
        found.append(np.unique(term[term >= 0] * len(texts) + owner, return_counts=True))
        start = stop
    at, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(at, kind="stable")
    return *np.divmod(at[order], max(1, len(texts))), times[order], lengths


def counts_of(docs: DataFrame, text: str, uri: str) -> DataFrame:
    """term, n: in how many texts each asked term stands; the row without a term has the texts as n and their words as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pc.unique(read_table(uri)["term"]).sort().cast(pa.binary())
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, STRETCH):
                term, _, _, lengths = cells(batch.column(0).slice(at, STRETCH).to_pylist(), vocabulary)
                df += np.bincount(term, minlength=len(df))
                n, total = n + len(lengths), total + int(lengths.sum())
        some = np.flatnonzero(df)
        rows = {"term": pa.concat_arrays([vocabulary.take(pa.array(some)).cast(pa.string()), pa.nulls(1, pa.string())]), "n": pa.array([*df[some], n], pa.int64()), "words": pa.array([0] * len(some) + [total], pa.int64())}
        yield pa.RecordBatch.from_pydict(rows)

    found = docs.select(text).mapInArrow(run, "term string, n long, words long")
    return found.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def best_in_stretches(docs: DataFrame, key: str, text: str, uri: str, average: float, top: int, query: str) -> DataFrame:
    """query, key, score of the best texts of each question (query, term, idf below uri) in each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = read_table(uri).combine_chunks()
        vocabulary = pc.unique(asked["term"]).sort()
        known = vocabulary.cast(pa.binary())
        numbers = pc.index_in(asked["term"], value_set=vocabulary).to_numpy()
        asked = asked.append_column("number", pa.array(numbers)).sort_by([("query", "ascending"), ("number", "ascending")])
        number, idf = asked["number"].to_pylist(), asked["idf"].to_numpy()
        for batch in batches:
            for at in range(0, batch.num_rows, STRETCH):
                rows = batch.slice(at, STRETCH)
                term, text_at, tf, lengths = cells(rows.column(1).to_pylist(), known)
                weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text_at] / (average or 1.0)))
                firsts = np.searchsorted(term, np.arange(len(known) + 1)).tolist()
                keys = pa.chunked_array([rows.column(0)])
                held = lambda k: ((firsts[number[k]], firsts[number[k] + 1]),)  # noqa: B023, E731
                found = blockwise.heaviest(asked["query"], held, idf, text_at, weight, blockwise.places(keys), top)
                yield from pa.table({"query": asked["query"].take(found[0]), "key": keys.take(found[1]), "score": found[2]}).combine_chunks().to_batches()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"query {query}, key {docs.schema[key].dataType.simpleString()}, score double")


def search(docs: DataFrame, queries: DataFrame, folder: str, key: str = "doc_id", *, top: int = 4, text: str = "text", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, key, score, rank of the best texts of each question, as retrieval.bm25 gives them; questions without terms get nothing. What
    is asked, and how rare it is, is written below a folder that driver and executors share."""
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    asked.write.mode("overwrite").parquet(f"{folder}/asked")
    spark = docs.sparkSession
    asked = spark.read.schema(asked.schema).parquet(f"{folder}/asked")
    counts_of(docs, text, f"{folder}/asked").write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n, total = counts.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    idf = F.log((n - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    weights = asked.join(counts.where("term is not null").select("term", idf.alias("idf")), "term").select("query", "term", "idf")
    weights.write.mode("overwrite").parquet(f"{folder}/weights")
    kind = asked.schema["query"].dataType.simpleString()
    scores = best_in_stretches(docs, key, text, f"{folder}/weights", total / max(1, n), top, kind).withColumn("score", F.round("score", 9))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key")))
    return ranked.where((F.col("rank") <= top) & (F.col("score") > 0)).select(F.col("query").alias(query_key), F.col("key").alias(key), "score", "rank")
