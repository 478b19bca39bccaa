"""Helpers shared by the operators of this subpackage: shared storage, words, table reading."""

from __future__ import annotations

import atexit
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes -> bytes: A-Z lowered, every other ASCII byte that is no digit or letter made a space.
#: Splitting the result at spaces gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z were lowered,
#: since every byte of a non-ASCII character is 0x80 or more.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The words that the size of a text counts: runs of anything but ASCII white space.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: Characters that array operations take at once.
SOME_CHARS = 1 << 20


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lowered; none for null."""
    return [] if text is None else text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def text_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about SOME_CHARS characters each."""
    start = chars = 0
    for at, text in enumerate(texts):
        chars += len(text or "")
        if chars >= SOME_CHARS or at == len(texts) - 1:
            yield start, at + 1
            start, chars = at + 1, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(df: DataFrame) -> int:
    """Partitions for steps whose rows are few and whose work is not: as many as the session asks for, never merged."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (tests, one machine) a
    folder of this process is made and set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Tables and files of one run in the shared folder.

    write() cuts a plan: the rows are stored as Parquet and reread, so a lost executor costs only its running tasks.
    drop() frees what no later step reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{shared_root(spark).rstrip('/')}/codeloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def write(self, df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
        """The rows, reread. A writer holds 100 rows at least, and a reader those of a group, so that large rows ask for a few a file."""
        df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.uri)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as error:  # at exit the gateway may be gone already
            if name:
                raise RuntimeError(f"could not remove {self.path(name)}") from error


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, usable in executors."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path or uri
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when complete; a rerun task replaces it with equal bytes."""

    def __init__(self, uri: str):
        self.fs, self.final = store(uri)
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        if self.local:
            self.fs.create_dir(posixpath.dirname(self.final), recursive=True)
        # object stores publish a file on close, and there a rename would copy it
        self.now = f"{self.final}.{uuid.uuid4().hex}.tmp" if self.local else self.final
        self.out = self.fs.open_output_stream(self.now)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Returns the offset at which the bytes start."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        if self.local:
            self.fs.move(self.now, self.final)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
