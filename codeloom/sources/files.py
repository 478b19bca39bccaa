"""Source files and listings as DataFrames."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.languages import basename, tree_language
from codeloom.operators.triage import in_tree

LONGEST = 204_800

#: A portable corpus of small source files made from orders, the same text in any SQL engine.
CORPUS_SQL = """
select o_orderkey as file_id,
  concat('src/mod_', cast(o_orderkey % 40 as string), '/f', cast(o_orderkey as string),
    case o_orderkey % 5 when 0 then '.py' when 1 then '.js' when 2 then '.ts' when 3 then '.go' else '.md' end) as path,
  concat('var x = ', cast(o_custkey as string), ';',
    case when o_orderkey % 3 = 0 then '  ' else '' end, chr(10),
    case when o_orderkey % 4 = 0 then 'if (a == b) { console.log(a' else 'if (a === b) { }' end, chr(10),
    case when o_orderkey % 7 = 0 then '// todo ' else '// ' end, o_orderpriority,
    case when o_orderkey % 11 = 0 then repeat('x', 130) else '' end) as code
from orders
"""


def spread(rows: DataFrame, key: str, rows_a_task: int = 16_384) -> DataFrame:
    """Narrow rows dealt over tasks by a key, before much is made of each of them: a table of a few MB is one task else, whatever its
    rows turn into. The number of tasks is stated, since a shuffle of so few bytes would be gathered into few tasks again."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_a_task))
    return rows.repartition(tasks, key)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, ord, path, filename, language, code."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    made = sql_over(spark, CORPUS_SQL, "orders", spread(orders, "o_orderkey"))
    return named(made.withColumn("ord", F.col("file_id")))


def sql_over(spark: SparkSession, sql: str, name: str, rows: DataFrame) -> DataFrame:
    """SQL text over a DataFrame that it calls by name; other braces of the text are its own."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"from {name}", f"from {{{name}}}"), **{name: rows})


def named(files: DataFrame) -> DataFrame:
    """files (path) with filename and language."""
    return files.withColumns({"filename": basename(F.col("path")), "language": tree_language(F.col("path"))})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a folder tree that a scan takes: path, size, filename, language. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    rows = named(found.select(path.alias("path"), F.col("length").alias("size"), F.lit("blob").alias("type")))
    return rows.where(in_tree(F.col("path"), F.col("type"), F.col("size"), F.col("language"))).drop("type")


def heads(files: DataFrame) -> DataFrame:
    """path, content: the first LONGEST bytes of files (path), of which no more is read; a character that is cut in two goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                local = path.startswith("file:")
                fs, name = (pafs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if local else pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as file:
                    raw = file.read(LONGEST)
                try:
                    raw = codecs.getincrementaldecoder("utf-8")().decode(raw).encode()
                except UnicodeDecodeError:
                    pass  # it is no text, which the caller says
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [raw]}, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.select("path").mapInArrow(run, "path string, content binary")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, language, code, fetch_error of every file below a folder: texts of up to LONGEST bytes, cut there;
    what is no UTF-8 has no code. Of a longer file only the beginning is read, however large it is."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    whole = found.where(F.col("length") <= LONGEST).select("path", "content")
    code = F.try_validate_utf8(F.col("content").cast("string"))
    base = folder.rstrip("/") + "/"
    both = whole.unionByName(heads(found.where(F.col("length") > LONGEST)))
    rows = both.select(F.substring_index(F.col("path"), base, -1).alias("path"), code.alias("code"))
    return named(rows).withColumn("fetch_error", F.when(F.col("code").isNull(), "Binary file").otherwise(""))
