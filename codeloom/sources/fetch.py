"""Raw files that a table names, fetched by tasks that share out each host.

Addresses of a host are dealt to a few slots, each of which one task takes one after another, so that a host sees no more requests at once
than it has slots, however many tasks and addresses there are; hosts do not wait for each other. What is known by its sha is not
fetched again. A failure is a row with its error, not an exception."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources import web

FETCHED = "url string, path string, filename string, sha string, content string, error string, status int"
TYPES = pa.schema([(n, pa.int32() if n == "status" else pa.string()) for n in ("url", "path", "filename", "sha", "content", "error", "status")])
#: Answers that ask to come again later.
LATER = (403, 429, 503)


def addresses(listing: DataFrame, host: str = "https://raw.githubusercontent.com") -> DataFrame:
    """listing (repository, branch, path) with the url of each raw file."""
    quoted = F.replace(F.url_encode("path"), F.lit("+"), F.lit("%20"))
    return listing.withColumn("url", F.concat_ws("/", F.lit(host), "repository", "branch", F.replace(quoted, F.lit("%2F"), F.lit("/"))))


def fetch(rows: DataFrame, known: DataFrame | None = None, *, slots: int = 4, tasks: int = 32, pause: float = 0.0, token: str | None = None, timeout: float = 15, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """FETCHED for rows (url; path and sha if there are): texts of up to web.LONGEST bytes. Rows whose url and sha are in known (url, sha)
    are left out. slots: requests to one host at a time; pause: seconds between those of a slot."""
    given = rows.select("url", *[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in ("path", "sha")]).where("url is not null")
    if known is not None:
        seen = known.select(F.col("url").alias("_url"), F.col("sha").alias("_sha")).where("_sha is not null")
        given = given.join(seen, (F.col("url") == F.col("_url")) & (F.col("sha") == F.col("_sha")), "left_anti")
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    slot = F.pmod(F.xxhash64("url"), F.lit(slots))
    task = F.pmod(F.xxhash64(host, slot), F.lit(tasks)).cast("int")
    dealt = given.withColumns({"_host": host, "_slot": slot}).repartitionById(tasks, task).sortWithinPartitions("_host", "_slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, path, sha in zip(*(batch.column(n).to_pylist() for n in ("url", "path", "sha")), strict=True):
                for k in range(tries):
                    try:
                        ok, body, error, status = web.get(url, token, timeout, web.LONGEST)
                    except ValueError as e:  # no address at all
                        ok, body, error, status = False, None, str(e), 0
                    time.sleep(pause)
                    if ok or status not in LATER or k + 1 == tries:
                        break
                    time.sleep(wait * 2**k)
                row = {"url": url, "path": path, "filename": (path or url).rsplit("/", 1)[-1], "sha": sha, "content": body if ok else None, "error": None if ok else error or "fetch failed", "status": status}
                yield pa.RecordBatch.from_pylist([row], TYPES)

    return dealt.select("url", "path", "sha").mapInArrow(run, FETCHED)
