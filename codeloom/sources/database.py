"""Tables of a database over JDBC, as a source and a sink. The driver's jar has to be on Spark's class path."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

#: Rows that a reading or writing task fetches or sends at once.
BATCH = 10_000


def connection(setting: str | None, default: str) -> tuple[str, dict[str, str]]:
    """The JDBC address of a setting such as postgresql://user:password@host/name, and the options user and password, which drivers do not
    take from the address; default where the setting is unset or still has a placeholder (<...>). sqlite:///x is a file x."""
    if not setting or not setting.strip() or "<" in setting:
        return default, {}
    url = setting.strip()
    if url.startswith("jdbc:"):
        return url, {}
    kind, _, rest = url.partition("://")
    kind = kind.split("+")[0]
    if kind == "sqlite":
        return f"jdbc:sqlite:{rest.removeprefix('/')}", {}
    who, _, where = rest.rpartition("@")
    user, colon, password = who.partition(":")
    options = {"user": unquote(user)} if user else {}
    return f"jdbc:{ {'postgres': 'postgresql'}.get(kind, kind) }://{where}", options | ({"password": unquote(password)} if colon else {})


def address(setting: str | None, default: str) -> str:
    """The address of connection() alone."""
    return connection(setting, default)[0]


def read(spark: SparkSession, url: str, table: str, key: str | None = None, tasks: int = 1, **options: str) -> DataFrame:
    """A table; filters, columns and limits go to the database. With a numeric key, tasks read stretches of it side by side, whose
    ends the database is asked for; rows beyond the ends and those without a key belong to the first and the last stretch."""
    given = {"url": url, "fetchsize": str(BATCH), **options}
    if key is not None and tasks > 1:
        asked = f"select min({key}) as lo, max({key}) as hi from {table}"
        ends = spark.read.format("jdbc").options(**given, query=asked).load().first()
        if ends[0] is not None:
            given |= {"partitionColumn": key, "lowerBound": str(ends[0]), "upperBound": str(ends[1] + 1), "numPartitions": str(tasks)}
    return spark.read.format("jdbc").options(**given, dbtable=table).load()


def write(rows: DataFrame, url: str, table: str, mode: str = "append", tasks: int | None = None, **options: str) -> None:
    """Appends rows, or replaces those of the table ("overwrite", which empties it and keeps its definition). A task's rows are one
    transaction; a task that is run again sends its rows again, so give the table a key where that matters. tasks bounds the
    connections."""
    given = {"url": url, "dbtable": table, "batchsize": str(BATCH), "truncate": "true", **options}
    if tasks is not None:
        given["numPartitions"] = str(tasks)
    rows.write.format("jdbc").options(**given).mode(mode).save()
