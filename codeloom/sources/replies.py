"""Replies of a language model to many prompts, under a quota, paid for once.

A prompt goes by its hash. What the table of replies has is not asked again, and equal prompts are asked once. The rest is dealt to a
fixed number of tasks, each with its share of the quota as a token bucket; a refusal for the rate is waited out longer and longer. Every
reply is put into a journal (a file by the prompt's hash) as it comes, so that a task that is run again, or a job, takes up where
the one before it ended. When all tasks are done the replies are published in the table in one step.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import prompts as texts
from codeloom.sources.store import Table

REPLIES = "hash string, reply string, error string, tries int"


class RateLimited(Exception):
    """What a provider raises when it is asked too often."""


class Bucket:
    """A token bucket: rate tokens a second, burst at most."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1.0, burst), clock, sleep
        self.held, self.at = self.burst, clock()

    def take(self) -> None:
        """Waits until there is a token, and takes it."""
        now = self.clock()
        self.held, self.at = min(self.burst, self.held + (now - self.at) * self.rate), now
        if self.held < 1:
            self.sleep((1 - self.held) / self.rate)
            self.held, self.at = 1.0, self.clock()
        self.held -= 1


def asked(provider: Callable[[str], str], prompt: str, bucket: Bucket, tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> dict:
    """reply or error, and the number of tries. Only refusals for the rate are tried again."""
    for k in range(1, tries + 1):
        bucket.take()
        try:
            return {"reply": provider(prompt), "error": None, "tries": k}
        except RateLimited as e:
            if k == tries:
                return {"reply": None, "error": f"rate limit: {e}", "tries": k}
            sleep(wait * 2 ** (k - 1) * (1 + random.random() / 4))  # noqa: S311
        except Exception as e:  # noqa: BLE001 what the provider says is the row's error: one prompt must not end the job
            return {"reply": None, "error": str(e) or type(e).__name__, "tries": k}
    raise AssertionError


class Journal:
    """Replies by hash in a folder that all tasks share."""

    def __init__(self, folder: str):
        parsed = urlparse(folder)
        self.fs, self.folder = (pafs.LocalFileSystem(), parsed.path) if parsed.scheme in ("", "file") else pafs.FileSystem.from_uri(folder)

    def _path(self, key: str) -> str:
        return f"{self.folder}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        if self.fs.get_file_info(self._path(key)).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(self._path(key)) as file:
            return json.loads(file.read())

    def put(self, key: str, value: dict) -> None:
        path = self._path(key)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{path}.tmp") as file:
            file.write(json.dumps(value).encode())
        self.fs.move(f"{path}.tmp", path)


class Replies(Table):
    """The table of replies (REPLIES) in a folder, and its journal."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, REPLIES)

    def ask(
        self, prompts: DataFrame, provider: Callable[[str], str], *, prompt: str = "prompt", per_minute: float = 30, tasks: int = 2, burst: float = 1, tries: int = 6, wait: float = 2.0,
        backend: str = "", local_model: str = "",
    ) -> DataFrame:
        """prompts with reply, failed and tries. A failed row has the text that a user reads as its reply, and is asked again by the next
        call; nulls get none. tasks share per_minute; the provider raises RateLimited when it is asked too often."""
        journal, rate = f"{self.folder}/journal", per_minute / 60 / tasks
        keyed = prompts.withColumn("_hash", F.sha2(F.col(prompt), 256))
        known = self.read().where("reply is not null").select("hash")
        new = keyed.where("_hash is not null").join(known, F.col("_hash") == F.col("hash"), "left_anti")
        new = new.groupBy("_hash").agg(F.any_value(prompt).alias("_prompt"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, kept = Bucket(rate, burst), Journal(journal)
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    said = kept.get(key)
                    if said is None:
                        said = asked(provider, text, bucket, tries, wait)
                        if said["error"] is None:
                            kept.put(key, said)
                    yield pa.RecordBatch.from_pylist([{"hash": key, **said}], pa.schema([("hash", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("tries", pa.int32())]))

        task = F.pmod(F.xxhash64("_hash"), F.lit(tasks)).cast("int")
        version = self.append(new.repartitionById(tasks, task).mapInArrow(run, REPLIES))
        last = self.read(version).groupBy("hash").agg(F.max_by(F.struct("reply", "error", "tries"), F.struct(F.col("reply").isNotNull(), F.col("tries"))).alias("_said"))
        out = keyed.join(last, F.col("_hash") == F.col("hash"), "left").drop("_hash", "hash")
        said = lambda name: F.col("_said")[name]
        limited = said("error").startswith("rate limit: ")
        message = F.when(limited, texts.rate_limit_text(said("error"), F.lit(backend))).otherwise(texts.error_text(said("error"), F.lit(backend), F.lit(local_model)))
        named = {"reply": F.coalesce(said("reply"), F.when(said("error").isNotNull(), message)), "failed": said("error").isNotNull() & said("reply").isNull(), "tries": said("tries")}
        return out.withColumns(named).drop("_said")
