"""Tables in a folder, with versions: a write stages its files beside the others, and then publishes a manifest in one step.

A manifest (log/<version>.json) names the parts, folders of Parquet files, that a version consists of. Publishing creates the next
manifest, and fails if somebody else has created it meanwhile: of two writers that have read the same version, one publishes and
the other is told, or tries again on what is there now. A write that breaks off has no manifest, and nothing of it is seen; readers
keep the version that they have begun with, since parts stay until vacuum() removes what no late version names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import history, retrieval
from codeloom.sources.keyword_index import KeywordIndex
from codeloom.sources.vector_index import VectorIndex

SNIPPET = "id bigint, title string, code string, language string, style_score int, error_count int, style_issue_count int, created_at timestamp_ntz"
CHAT = "id bigint, snippet_id bigint, role string, content string, ts timestamp_ntz"
CHUNKS = "ord int, path string, id string, name string, code string, line int, kind string, text string, repo_id string, embedding array<float>"
#: Times that a save starts again when another one has come first.
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another writer has published since the version was read."""


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder; at exit the gateway may be gone, and then it stays."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110
        pass


class Table:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder, with the times of their last change in seconds."""
        fs, path = self._fs()
        there = path(f"{self.folder}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(there)] if fs.exists(there) else []

    def version(self) -> int:
        return max([int(n[:-5]) for n, _ in self._names("log") if re.fullmatch(r"[0-9]+\.json", n)], default=0)

    def parts(self, version: int) -> list[str]:
        """Parts of a version; the empty version 0 has none."""
        if not version:
            return []
        text = self.spark.read.text(f"{self.folder}/log/{version}.json", wholetext=True).first().value
        return json.loads(text)["parts"]

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.parts(self.version() if version is None else version)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)

    def _typed(self, rows: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        known = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in fields}
        return rows.select(*[known[f.name].cast(f.dataType).alias(f.name) for f in fields])

    def stage(self, rows: DataFrame) -> str:
        """Writes rows as a part that no version names yet."""
        part = uuid.uuid4().hex
        self._typed(rows).write.parquet(f"{self.folder}/data/{part}")
        return part

    def publish(self, parts: list[str], base: int) -> int:
        """Makes parts the version after base; Conflict if there is one already."""
        if self.version() != base or not self._create(f"{self.folder}/log/{base + 1}.json", json.dumps({"parts": parts})):
            raise Conflict(f"{self.folder}: version {base} is no longer the last")
        return base + 1

    def _create(self, name: str, text: str) -> bool:
        """Creates a whole file under a name that is free, in one step; whether it was."""
        where = urlparse(name)
        if where.scheme in ("", "file"):
            os.makedirs(os.path.dirname(where.path), exist_ok=True)
            made = f"{where.path}.{uuid.uuid4().hex}"
            with open(made, "w") as out:
                out.write(text)
            try:
                os.link(made, where.path)  # a link to a name that is taken fails, where a rename would replace it
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
            return True
        fs, path = self._fs()
        try:
            out = fs.create(path(name), False)
        except Exception as error:
            if fs.exists(path(name)):
                return False
            raise RuntimeError(f"could not create {name}") from error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _written(self, made: Callable[[int], DataFrame], kept: Callable[[int], list[str]], attempts: int) -> int:
        """Stages made(version) and publishes it with kept(version); from the start again if another writer was first."""
        for attempt in range(attempts):
            base = self.version()
            part = self.stage(made(base))
            try:
                return self.publish([*kept(base), part], base)
            except Conflict:
                remove(self.spark, f"{self.folder}/data/{part}")
                if attempt + 1 == attempts:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def append(self, rows: DataFrame) -> int:
        return self._written(lambda _: rows, self.parts, ATTEMPTS)

    def replace(self, rows: DataFrame, base: int | None = None) -> int:
        """Puts rows, which may come from this table, in place of all that is there; Conflict if base, by default the version at the time
        of the call, is no longer the last when they are written."""
        base = self.version() if base is None else base
        part = self.stage(rows)
        try:
            return self.publish([part], base)
        except Conflict:
            remove(self.spark, f"{self.folder}/data/{part}")
            raise

    def delete_rows(self, ids: list[int]) -> int:
        """Rows that were there with one of the ids, which are no longer. Only parts that hold one are written anew."""
        for attempt in range(ATTEMPTS):
            base = self.version()
            held = self.read(base).where(F.col("id").isin(ids)).groupBy(F.input_file_name().alias("file")).count().collect()
            if not held:
                return 0
            parts = self.parts(base)
            touched = {p for p in parts if any(f"/data/{p}/" in r.file for r in held)}
            rest = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in sorted(touched)]).where(~F.col("id").isin(ids))
            part = self.stage(rest)
            try:
                self.publish([*[p for p in parts if p not in touched], part], base)
                return sum(r["count"] for r in held)
            except Conflict:
                remove(self.spark, f"{self.folder}/data/{part}")
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    def vacuum(self, hours: float = 24, keep: int = 10) -> list[str]:
        """Removes parts that none of the last keep versions names and that are older than hours; names of what went."""
        last = self.version()
        named = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.parts(v)}
        old = [n for n, at in self._names("data") if n not in named and at < time.time() - 3600 * hours]
        for name in old:
            remove(self.spark, f"{self.folder}/data/{name}")
        return old


def stamped(rows: DataFrame, column: str) -> DataFrame:
    """rows with the time of writing where they have none of their own."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return rows.withColumn(column, F.coalesce(F.col(column).cast("timestamp_ntz"), now) if column in rows.columns else now)


class Snippets(Table):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, SNIPPET)

    def save(self, rows: DataFrame, order: str) -> int:
        """Adds rows with ids that go on after those of the version that they are published on; returns the new version."""
        given = stamped(history.with_defaults(rows), "created_at")
        return self._written(lambda base: history.numbered_after(given, self.read(base), order), self.parts, ATTEMPTS)

    def delete(self, snippet_id: int) -> bool:
        """Whether there was such a snippet. Messages about it stay."""
        return self.delete_rows([snippet_id]) > 0

    def latest(self, limit: int = history.PAGE) -> DataFrame:
        return history.latest(self.read(), limit)

    def get(self, snippet_id: int) -> DataFrame:
        return self.read().where(F.col("id") == snippet_id)


class Chat(Table):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, CHAT)

    def save(self, rows: DataFrame, order: str) -> int:
        given = stamped(rows, "ts")
        return self._written(lambda base: history.numbered_after(given, self.read(base), order), self.parts, ATTEMPTS)

    def of(self, snippet_id: int) -> DataFrame:
        return history.chat_history(self.read(), snippet_id)


class ChunkIndex:
    """Chunks by repository, with a keyword index, and a vector each and a vector index where an embedder is given. Every repository has a
    folder of its own, so that indexing or clearing one touches no other.

    index() takes a repository's files anew but embeds only texts that it has not embedded before: vectors go by the hash of the
    text, so that of a repository in which one file has changed only that file's new chunks are sent to the embedder."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[list[str]], list[list[float]]] | None = None):
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), embed

    def _folder(self, repo_id: str) -> str:
        readable = re.sub("[^a-zA-Z0-9_-]", "_", repo_id)[:60]
        return f"{self.folder}/{readable}-{hashlib.sha256(repo_id.encode()).hexdigest()[:16]}"

    def _table(self, repo_id: str) -> Table:
        return Table(self.spark, f"{self._folder(repo_id)}/chunks", CHUNKS)

    def _keyword(self, repo_id: str, version: int) -> KeywordIndex:
        return KeywordIndex(self.spark, f"{self._folder(repo_id)}/keyword-{version}")

    def _vector(self, repo_id: str, version: int) -> VectorIndex:
        return VectorIndex(self.spark, f"{self._folder(repo_id)}/vector-{version}")

    def _with_vectors(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the embedder's vectors of a text column, an Arrow batch at a time; without an embedder, nulls."""
        embed = self.embed
        if embed is None:
            return rows.withColumn(name, F.lit(None).cast("array<float>"))

        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([[float(x) for x in v] for v in embed(texts.fillna("").tolist())] if len(texts) else [], dtype=object)

        return rows.withColumn(name, F.pandas_udf(vectors, "array<float>")(F.col(column)))

    def _embedded(self, table: Table, chunks: DataFrame) -> DataFrame:
        """chunks with embeddings: of equal texts in the last version those that it has, of others new ones, each text once."""
        if self.embed is None:
            return self._with_vectors(chunks, "text", "embedding")
        hashed = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
        known = table.read().where("embedding is not null").groupBy(hashed(F.col("text")).alias("_hash")).agg(F.any_value("embedding").alias("embedding"))
        keyed = chunks.withColumn("_key", hashed(F.col("text")))
        new = keyed.join(known, F.col("_key") == F.col("_hash"), "left_anti").groupBy("_key").agg(F.any_value("text").alias("_text"))
        new = self._with_vectors(new, "_text", "embedding").select(F.col("_key").alias("_hash"), "embedding")
        return keyed.join(known.unionByName(new), F.col("_key") == F.col("_hash"), "left").drop("_key", "_hash")

    def index(self, repo_id: str, chunks: DataFrame) -> int:
        """Replaces a repository's chunks, and builds its indexes; returns the number of chunks."""
        table = self._table(repo_id)
        version = table.replace(self._embedded(table, chunks.withColumn("repo_id", F.lit(repo_id))))
        rows = self.of(repo_id)
        self._keyword(repo_id, version).build(rows, "id")
        if self.embed is not None:
            self._vector(repo_id, version).build(rows, "id")
        return rows.count()

    def clear(self, repo_id: str) -> None:
        remove(self.spark, self._folder(repo_id))

    def of(self, repo_id: str) -> DataFrame:
        return self._table(repo_id).read()

    def search(self, repo_id: str, questions: DataFrame, top: int = 4, exact: bool = False) -> DataFrame:
        """query_id, chunk_key (the chunk's id), rank of the chunks for questions (query_id, query) by the stored indexes: nearest vectors,
        or BM25 for a question that vectors give nothing for, and for all of them without an embedder."""
        version = self._table(repo_id).version()
        if not version:
            return self.spark.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_key string, rank int")
        keyword = self._keyword(repo_id, version).search(questions, top=top, key="chunk_key").select("query_id", "chunk_key", "rank")
        if self.embed is None:
            return keyword
        asked = self._with_vectors(questions.select("query_id", "query"), "query", "_vector").select("query_id", "_vector")
        near = self._vector(repo_id, version).search(asked, top=top, key="chunk_key", query_vector="_vector", exact=exact)
        return retrieval.retrieve(keyword, near.select("query_id", "chunk_key", "rank"))
