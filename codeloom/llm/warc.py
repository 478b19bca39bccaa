"""WARC archives with a two-level capture index.

Writing: each page becomes a WARC/1.1 record in a compressed archive (one gzip member a record). Of pages with equal
payloads the one with the largest page_id is the response; the others are revisit records that carry headers only and
refer to it. Payloads smaller than min_revisit_bytes are always responses.

Index: a line per record, sorted by (reversed-host URL key, page_id), in blocks of lines compressed together; a sparse
directory holds the first key and the byte range of each block. A lookup searches the directory, reads one block,
searches that, and then reads one byte range of one archive.

Defined results: a null html is an empty payload; a null url has the key "-"; pages that share a page_id and a payload
are records of their own, all of them responses if they are the largest, and each record has an id of its own; an empty
table gives no rows. A null page_id ranks below every other; a revisit of a payload that only null ids have does not occur
(all are responses). Very long pages are records like others, one held at a time; other columns, whatever their names, play
no part.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import AtomicFile, Workspace, store, tasks

CAPTURES = "key string, page_id long, archive string, offset long, length long"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Index lines of a compressed block.
BLOCK_LINES = 2_000
#: Neighbouring bytes of an archive that one task reads.
STRETCH = 16 << 20
END = b"\r\n"


def url_key(url: str | None) -> str:
    """http://www.Example.com:80/a?b -> com,example)/a?b: hosts that belong together sort together."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return "-" + url.strip()
    labels = ",".join(reversed(host.split(".")))
    port_text = "" if port in (None, 80, 443) else f":{port}"
    return f"{labels}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1, from its hexadecimal form: 10 digits are 8 base32 letters."""
    whole = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(whole, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, space: Workspace, min_revisit_bytes: int = 0) -> DataFrame:
    """row, page_id, url, html, _digest, _bytes, and _first, _first_row: page_id and row of the response of a payload that several
    pages have.

    Only digests and ids are grouped; the groups of several pages are written before the join, so that the rows of one
    hot payload are split among tasks at run time."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", html.alias("html"), payload_digest(html.cast("binary")).alias("_digest"), F.octet_length(html).cast("long").alias("_bytes"))
    groups = rows.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_digest").agg(F.max("page_id").alias("_first"), F.max(F.struct("page_id", "row"))["row"].alias("_first_row"), F.count(F.lit(1)).alias("_n"))
    groups = space.write(groups.where("_n > 1 and _first is not null").select(F.col("_digest").alias("_d"), "_first", "_first_row"), "groups")
    return rows.join(groups, F.col("_digest") == F.col("_d"), "left").drop("_d")


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record(row: int, page_id: int | None, url: str | None, html: str, digest: str, first: int | None, first_row: int | None) -> bytes:
    """One uncompressed record. first, first_row: the response's page_id and row if several pages have this payload."""
    payload = html.encode("utf-8", "replace")
    revisit = first is not None and first != page_id
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    body = END.join(head) + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id, row),
        "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)),
    }
    if revisit:
        fields["WARC-Refers-To"] = record_id(first, first_row)
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "replace") for k, v in fields.items()), b""]
    return END.join(lines) + END + body + END + END


def read_record(raw: bytes) -> dict:
    """What a compressed record says of itself; a response's payload is checked against its digest and its length."""
    head, _, rest = gzip.decompress(raw).partition(END + END)
    fields = dict(line.split(b": ", 1) for line in head.split(END)[1:])
    body = rest[: int(fields[b"Content-Length"])]
    http, _, payload = body.partition(END + END)
    length = int(next(x for x in http.split(END) if x.startswith(b"Content-Length: "))[16:])
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != length:
            raise ValueError(f"record {fields[b'WARC-Record-ID']!r} is damaged")
    number = lambda name: int(x) if (x := fields[name].split(b":")[2]) else None
    return {
        "record_id": fields[b"WARC-Record-ID"].decode(), "page_id": number(b"WARC-Record-ID"), "url": fields[b"WARC-Target-URI"].decode(), "payload": payload, "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number(b"WARC-Refers-To") if kind == "revisit" else None,
    }


def write_archives(plan: DataFrame, folder: str, *, archive_bytes: int = 1_000_000_000, level: int = 4) -> DataFrame:
    """Writes archives, one or more a partition; one row (CAPTURES) per record. Running the result writes the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, out, name = TaskContext.get().partitionId(), 0, None, ""
        for batch in batches:
            rows = []
            for row, page_id, url, html, digest, first, first_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and out.at >= archive_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, files = f"part-{part:06d}-{files:04d}.warc.gz", files + 1
                    out = AtomicFile(f"{folder}/{name}")
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = pack.compress(record(row, page_id, url, html, digest, first, first_row)) + pack.flush()
                rows.append((url_key(url), page_id, name, out.write(raw), len(raw)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return plan.select("row", "page_id", "url", "html", "_digest", "_first", "_first_row").mapInArrow(run, CAPTURES)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Range-sorts captures by (key, page_id, place) and writes a shard of compressed blocks per partition. Returns the
    directory: one row per block. Ties of the key are parted by page_id, so that a hot URL is no hot partition."""
    order = ["key", "page_id", "archive", "offset"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"shard-{TaskContext.get().partitionId():06d}.cdx"
        lines, blocks, out = [], [], None

        def block() -> None:
            raw = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode("utf-8", "replace"), 6)
            blocks.append((*lines[0][:2], *lines[-1][:2], name, out.write(raw), len(raw)))
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or AtomicFile(f"{folder}/{name}")
                lines.append(line)
                if len(lines) == block_lines:
                    block()
        if lines:
            block()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), DIRECTORY_TYPES, strict=True)], DIRECTORY_NAMES)

    return ordered.mapInArrow(run, DIRECTORY)


DIRECTORY = "first_key string, first_id long, last_key string, last_id long, shard string, offset long, length long"
DIRECTORY_NAMES = [x.split()[0] for x in DIRECTORY.split(", ")]
DIRECTORY_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def rank(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Sort key of an index line; a null page_id comes first, as in Spark. Code points order as their UTF-8 bytes do."""
    return key, page_id is not None, page_id or 0


class CaptureIndex:
    """Lookups against a directory and its shards. Blocks are kept as long as lookups fall into them."""

    def __init__(self, folder: str, directory: list[tuple]):
        self.folder, self.directory = folder, sorted(directory, key=lambda r: (rank(*r[:2]), rank(*r[2:4]), r[4], r[5]))
        self.firsts = [rank(*r[:2]) for r in self.directory]
        self.lasts = [rank(*r[2:4]) for r in self.directory]
        self.held: tuple[int, list, list] | None = None

    def block(self, k: int) -> tuple[list, list]:
        if self.held is None or self.held[0] != k:
            *_, shard, offset, length = self.directory[k]
            fs, path = store(f"{self.folder}/{shard}")
            with fs.open_input_file(path) as file:
                lines = [tuple(json.loads(x)) for x in zlib.decompress(file.read_at(length, offset)).decode().split("\n")]
            self.held = k, lines, [rank(*x[:2]) for x in lines]
        return self.held[1:]

    def find(self, key: str, page_id: int | None) -> list[tuple]:
        """Every capture of the page: the last block that starts at or before it, then those before while they end there."""
        wanted, out = rank(key, page_id), []
        k = bisect.bisect_right(self.firsts, wanted) - 1
        while k >= 0 and self.lasts[k] >= wanted:
            lines, ranks = self.block(k)
            out += lines[bisect.bisect_left(ranks, wanted) : bisect.bisect_right(ranks, wanted)]
            k -= 1
        return out


def lookup(pages: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """CAPTURES of each distinct (url, page_id) of pages, through the index.

    Queries are grouped by the index shards that their keys fall into (a range join on the few shard bounds); each task
    gets the directory rows of its shards only, and answers its queries in key order, a block at a time."""
    spark = pages.sparkSession
    bounds = directory.groupBy("shard").agg(F.min(F.struct("first_key", "first_id")).alias("lo"), F.max(F.struct("last_key", "last_id")).alias("hi")).orderBy("shard").collect()
    firsts = [rank(*r.lo) for r in bounds]
    lasts = [rank(*r.hi) for r in bounds]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = rank(key := url_key(url), page_id)
                k = bisect.bisect_right(firsts, wanted) - 1
                while k >= 0 and lasts[k] >= wanted:
                    out.append((k, key, page_id))
                    k -= 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], ["number", "key", "page_id"])

    number = spark.createDataFrame([(r.shard, k) for k, r in enumerate(bounds)], "_shard string, number int")
    blocks = directory.join(number, F.col("shard") == F.col("_shard")).select(
        "number", F.lit(0).alias("kind"), F.col("first_key").alias("key"), F.col("first_id").alias("page_id"), F.struct(*DIRECTORY_NAMES).alias("block")
    )
    wanted = pages.select("url", "page_id").mapInArrow(place, "number int, key string, page_id long").select("number", F.lit(1).alias("kind"), "key", "page_id")
    wanted = wanted.distinct().withColumn("block", F.lit(None).cast(blocks.schema["block"].dataType))
    both = blocks.unionByName(wanted).repartition(tasks(pages), "number").sortWithinPartitions("number", "kind", "key", F.col("page_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting, index = None, [], None
        for batch in batches:
            rows = []
            for number, kind, key, page_id, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != shard:
                    shard, waiting, index = number, [], None
                if kind == 0:
                    waiting.append(tuple(block.values()))
                    continue
                index = index or CaptureIndex(folder, waiting)
                rows += index.find(key, page_id)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "archive", "offset", "length"])

    return both.mapInArrow(run, CAPTURES)


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """Range reads of captured records, in file order: FOUND rows, from what the archives hold. Tasks are dealt stretches of
    archives, so that each has about as many bytes to read as rows of one length would give it."""
    stretch = F.floor(F.col("offset") / STRETCH)
    ordered = captures.repartition(tasks(captures), "archive", stretch).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    fs, path = store(f"{folder}/{archive}")
                    name, file = archive, fs.open_input_file(path)
                r = read_record(file.read_at(length, offset))
                rows.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return ordered.mapInArrow(run, FOUND)


def archive_and_read(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes archives and index of pages, looks every page up, and returns what its record holds (FOUND)."""
    space = Workspace(pages.sparkSession, "warc")
    plan = plan_records(pages, space, min_revisit_bytes)
    captures = space.write(write_archives(plan, space.path("archives")), "captures")
    directory = space.write(write_index(captures, space.path("index")), "directory")
    return read_captures(lookup(pages.select("page_id", "url"), directory, space.path("index")), space.path("archives"))
