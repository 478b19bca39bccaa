"""Substring dedup by hashing units (lines, paragraphs or sentences) over the whole corpus.

A text is cut into units; a unit is normalised to its lower-case words and hashed (128 bits). Digests are grouped over
all rows; the occurrence of smallest rank (its first one there) stays, all others are repeats and go. Lines are the units
of the query, whatever their length (min_words can ask for more). Offsets of what goes are those of the original text.

A passage need not be a whole unit, so every window of WINDOW words is a repeat as well where it stands in a row of
smaller rank, or WINDOW words or more behind its first place in the same text. Repeated units and windows that overlap or
touch are one run. Windows are exact: of all runs of GRAM words the smallest hash of each window is a mark of its row
(winnowing), so equal windows share a mark, and only the windows that hold a mark found again are compared. Where units that
follow each other follow each other in the same keeper too, the keeper has the windows inside them as well, and neither
their marks nor they are looked at again.

Defined results: rank is doc_id, null last; of rows that share a doc_id, or have none, one that is the same for all units
of equal place in the order of rows keeps, so that of repeated rows exactly one stays; null, empty and wordless texts have
no units; very long texts are hashed piece by piece and compared whole; ties inside a text go to the first place; an empty
table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import SOME_CHARS, WORD_BYTES, Workspace, free_name, text_parts

UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n[^\S\n]*[^\s][^\n]*)*"),
    "sentence": re.compile(r"[^\n.!?]+[.!?]*|[.!?]+"),
}
UNIT_TYPE = pa.struct([("high", pa.int64()), ("low", pa.int64()), *[(n, pa.int32()) for n in ("start", "stop", "words", "word")], ("again", pa.bool_())])
LAST_RANK = (1 << 63) - 1
#: Words of a window and of the shorter runs that its mark is chosen from.
WINDOW, GRAM = 50, 25
#: Bases of the rolling hashes (odd, so that they have inverses modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: A window has 64 + 32 bits; the zeros of the second part, first in a row, cost nothing in a shuffle.
UPPER = np.uint64(0xFFFFFFFF00000000)


def units_of(text: str | None, kind: str = "line", min_words: int = 1) -> list[tuple[int, int, int, int, int, int, bool]]:
    """(digest as two integers, start, stop, words, words before it, whether it stands earlier in the text too) of each unit
    of min_words or more; offsets count characters."""
    out, seen, before = [], set(), 0
    for found in UNITS[kind].finditer(text or ""):
        words = found.group().encode("utf-8", "replace").translate(WORD_BYTES).split()
        if len(words) >= max(1, min_words):
            digest = blake2b(b" ".join(words), digest_size=16).digest()
            out.append((*struct.unpack("<qq", digest), found.start(), found.end(), len(words), before, digest in seen))
            seen.add(digest)
        before += len(words)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each run of values (uint64) from start up to stop."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[:-1], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(values))[starts])


class Words:
    """Words of texts as arrays: the text of each, its (start, stop) in the joined bytes, a hash by each base asked for."""

    def __init__(self, texts: list[str | None], bases: tuple[int, ...] = BASES[:1]):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.bytes = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self.offsets = np.cumsum([0, *[len(r) + 1 for r in raw]])
        plain = np.frombuffer(self.bytes.tobytes().translate(WORD_BYTES), np.uint8)
        inside = np.concatenate([[False], plain != 32, [False]])
        self.edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.stops = self.edges[::2], self.edges[1::2]
        self.text = np.searchsorted(self.offsets, self.starts, "right") - 1
        # a word's hash does not depend on where it stands: long texts are hashed piece by piece, in bounded memory
        cuts = np.unique(np.searchsorted(self.starts, np.arange(0, len(plain) + SOME_CHARS, SOME_CHARS)))
        self.hashes = [np.concatenate([np.zeros(0, np.uint64), *(self._piece(plain, a, b, base) for a, b in zip(cuts[:-1], cuts[1:], strict=True))]) for base in bases]

    def _piece(self, plain: np.ndarray, first: int, stop: int, base: int) -> np.ndarray:
        low, high = self.starts[first], self.stops[stop - 1]
        return run_hashes(plain[low:high].astype(np.uint64) + np.uint64(1), self.starts[first:stop] - low, self.stops[first:stop] - low, base)

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of each word, counted in characters of the joined texts."""
        if not len(self.edges):
            return self.edges, self.edges
        leading = ((self.bytes & 0xC0) != 0x80).view(np.uint8)
        counts = np.add.reduceat(leading, self.edges[:-1], dtype=np.int64)
        counts[-1] = leading[self.edges[-2] : self.edges[-1]].sum()
        at = int(leading[: self.edges[0]].sum()) + np.concatenate([[0], np.cumsum(counts)])
        return at[::2], at[1::2]

    def runs(self, n: int, base: int = 0) -> np.ndarray:
        """Hash of the n words from each word on, also where they reach into the next text."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        return run_hashes(self.hashes[base], at, at + n, BASES[base])

    def windows(self) -> np.ndarray:
        """Whether the WINDOW words from each word on are of one text."""
        return self.text[: max(0, len(self.text) - WINDOW + 1)] == self.text[WINDOW - 1 :]


def sliding(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best (minimum or maximum) of each n neighbours."""
    wide = 1
    size = len(values) - n + 1
    while 2 * wide <= n:
        values = best(values[:-wide], values[wide:])
        wide *= 2
    return best(values[:size], values[n - wide : n - wide + size])


def marks_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each run of GRAM words that is the smallest of a window."""
    inside, span = words.windows(), WINDOW - GRAM + 1
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, rim = words.runs(GRAM), np.zeros(span - 1, np.uint64)
    least = np.where(inside, sliding(grams, span, np.minimum), np.uint64(0))
    chosen = np.flatnonzero(sliding(np.concatenate([rim, least, rim]), span, np.maximum) == grams)
    return chosen, grams[chosen]


MARK_ARROW = pa.struct([("mark", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("twice", pa.bool_())])


def marks_by_text(texts: list[str | None]) -> list[list[np.ndarray]]:
    """The columns of MARK_ARROW for each text: its distinct marks, the words that all windows around them cover (from lo, up to
    hi), and whether a mark stands in it twice."""
    out = []
    for a, b in text_parts(texts):
        words = Words(texts[a:b])
        place, found = marks_of(words)
        ends = np.searchsorted(words.text, np.arange(b - a + 1))
        cuts = np.searchsorted(words.text[place], np.arange(b - a + 1))
        for k in range(b - a):
            once, back = np.unique(found[cuts[k] : cuts[k + 1]], return_inverse=True)
            order = np.argsort(back, kind="stable")
            at, count = place[cuts[k] : cuts[k + 1]][order] - ends[k], np.bincount(back, minlength=len(once))
            first, last = at[np.cumsum(count) - count], at[np.cumsum(count) - 1]
            out.append([once.view(np.int64), np.maximum(0, first - (WINDOW - GRAM)), np.minimum(ends[k + 1] - ends[k], last + WINDOW), count > 1])
    return out


WINDOW_TYPE = "array<struct<high:bigint,low:bigint,word:int,start:int,stop:int,again:boolean,open:boolean>>"
WINDOW_ARROW = pa.struct([("high", pa.int64()), ("low", pa.int64()), *[(n, pa.int32()) for n in ("word", "start", "stop")], *[(n, pa.bool_()) for n in ("again", "open")]])


def windows_of(text: str, asked: np.ndarray, runs: list[tuple[int, int]], same: list[tuple[int, int]]) -> list[np.ndarray]:
    """The columns of WINDOW_ARROW for all windows whose mark is asked for, but those inside same: runs (from word, up to word)
    that a keeper holds as they are. Open are those that no run of repeated units holds already."""
    words = Words([text], BASES)
    place, found = marks_of(words)
    held = np.unique(found[np.isin(found, asked.view(np.uint64))])
    at = np.zeros(0, np.int64)
    if len(held):
        at = np.flatnonzero(np.isin(sliding(words.runs(GRAM), WINDOW - GRAM + 1, np.minimum), held))
    high, low = words.runs(WINDOW)[at].view(np.int64), (words.runs(WINDOW, 1)[at] & UPPER).view(np.int64)
    pairs = np.empty(len(at), [("high", np.int64), ("low", np.int64)])
    pairs["high"], pairs["low"] = high, low
    _, first, back = np.unique(pairs, return_index=True, return_inverse=True)
    before = at[first[back]] if len(at) else at
    starts, stops = words.chars()
    fresh, again, free = before == at, at - before >= WINDOW, ~inside_runs(at, runs)
    use = (fresh | free) & ~inside_runs(at, same)
    return [c[use] for c in (high, low, at, starts[at], stops[at + WINDOW - 1], again, free)]


def inside_runs(at: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    """Whether the window at each place lies inside one of the runs, which do not overlap."""
    bounds = np.array(sorted(runs), np.int64).reshape(-1, 2)
    k = np.searchsorted(bounds[:, 0], at, "right") - 1
    return (k >= 0) & (np.append(bounds[:, 1], -1)[k] >= at + WINDOW)


def lists_of(values: list[list[np.ndarray]], kind: pa.StructType) -> pa.ListArray:
    """An array of structs for each entry, which are lists of columns."""
    offsets = np.cumsum([0, *[len(v[0]) for v in values]])
    columns = [pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*values, strict=True), kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in kind]))


def unit_table(rows: DataFrame, kind: str, min_words: int) -> DataFrame:
    """row, doc_id, rank, units, marks and text (null without marks), from rows (row, doc_id, text). One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = some.column(2).to_pylist()
                found = [[np.array(c) for c in zip(*u, strict=True)] if (u := units_of(t, kind, min_words)) else [np.zeros(0, int)] * len(UNIT_TYPE) for t in texts]
                marks = marks_by_text(texts)
                # only texts with marks are asked for again
                kept = pa.array([t if len(m[0]) else None for t, m in zip(texts, marks, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists_of(found, UNIT_TYPE), lists_of(marks, MARK_ARROW), kept], ["row", "doc_id", "units", "marks", "text"])

    kinds = "row long, doc_id long, units array<struct<high:long,low:long,start:int,stop:int,words:int,word:int,again:boolean>>, marks array<struct<mark:long,lo:int,hi:int,twice:boolean>>, text string"
    return rows.select("row", "doc_id", "text").mapInArrow(run, kinds).withColumn("rank", F.coalesce("doc_id", F.lit(LAST_RANK)))


def window_table(texts: DataFrame) -> DataFrame:
    """row, doc_id, rank, windows, from row, doc_id, rank, text, asked (marks that were found again), runs (of repeated units) and
    same (runs that a keeper holds as they are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = lambda runs: [(r["word"], r["end"]) for r in runs or ()]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = batch.slice(at, 100)
                given = zip(*[rows.column(k).to_pylist() for k in (3, 4, 5, 6)], strict=True)
                found = [windows_of(t, np.array(a, np.int64), pairs(u), pairs(v)) for t, a, u, v in given]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], lists_of(found, WINDOW_ARROW)], ["row", "doc_id", "rank", "windows"])

    return texts.mapInArrow(run, f"row long, doc_id long, rank long, windows {WINDOW_TYPE}")


def repeated_units(table: DataFrame, space: Workspace) -> DataFrame:
    """row, word, end, start, stop, n_units (1), first, keeper, shift of every unit that is not its digest's first one in its
    keeper, written. keeper is the row of smallest rank that holds the digest, and word + shift its place there.

    Digests are pre-aggregated before the shuffle, and both sides of the join come from tables, so that a hot one is split
    among tasks at run time."""
    placed = table.select("row", "doc_id", "rank", F.explode("units").alias("u")).select("row", "doc_id", "rank", "u.*")
    first = F.min(F.when(~F.col("again"), F.struct("rank", "row", "word"))).alias("keeper")  # of equal ranks always the same one
    groups = placed.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low")).agg(first, F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = space.write(groups.where("n > 1").drop("n"), "groups")
    found = placed.drop("doc_id", "rank").join(groups, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
    found = found.where(F.col("again") | (F.col("keeper.row") != F.col("row")))
    end, shift = (F.col("word") + F.col("words")).alias("end"), (F.col("keeper.word") - F.col("word")).alias("shift")
    out = space.write(found.select("row", "word", end, "start", "stop", F.lit(1).cast("long").alias("n_units"), "first", F.col("keeper.row").alias("keeper"), shift), "repeated")
    space.drop("groups")
    return out


def same_runs(pieces: DataFrame) -> DataFrame:
    """row, word, end of the longest runs of repeated units that stand in one keeper as they are."""
    in_row = Window.partitionBy("row").orderBy("word")
    goes_on = (F.lag("end").over(in_row) == F.col("word")) & (F.lag("keeper").over(in_row) == F.col("keeper")) & (F.lag("shift").over(in_row) == F.col("shift"))
    apart = pieces.withColumn("_apart", F.when(goes_on, 0).otherwise(1))
    runs = apart.withColumn("_run", F.sum("_apart").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "_run").agg(F.min("word").alias("word"), F.max("end").alias("end")).drop("_run")


def asked_marks(table: DataFrame, same: DataFrame, space: Workspace) -> DataFrame:
    """_row, asked: the marks of each row that are found again, but those of which all windows lie in a run of same."""
    marks = table.select("row", F.explode("marks").alias("m")).select("row", F.col("m.lo").alias("at"), "m.hi", "m.mark", "m.twice", F.lit(None).cast("int").alias("end"))
    runs = same.select("row", F.col("word").alias("at"), F.lit(None).cast("int").alias("hi"), F.lit(None).cast("long").alias("mark"), F.lit(None).cast("boolean").alias("twice"), "end")
    # runs do not overlap: the last one that begins at or before a mark's windows is the one that can hold them
    before = Window.partitionBy("row").orderBy("at", F.col("end").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    held = marks.unionByName(runs).withColumn("_reach", F.max("end").over(before)).where(F.col("mark").isNotNull() & F.coalesce(F.col("_reach") < F.col("hi"), F.lit(True)))
    left = space.write(held.select("row", "mark", "twice"), "marks")
    again = left.groupBy("mark").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1")
    again = space.write(again.select(F.col("mark").alias("_mark")), "marks_again")
    return left.join(again, F.col("mark") == F.col("_mark")).groupBy(F.col("row").alias("_row")).agg(F.collect_list("mark").alias("asked"))


def repeated_windows(space: Workspace, table: DataFrame, runs: DataFrame, same: DataFrame) -> DataFrame:
    """row, word, end, start, stop, n_units (0), first of every repeated window of WINDOW words that no run holds already."""
    listed = lambda df, name: df.groupBy(F.col("row").alias(f"_{name}")).agg(F.collect_list(F.struct("word", "end")).alias(name))
    wanted = asked_marks(table, same, space)
    for name, df in (("runs", runs), ("same", same)):
        wanted = wanted.join(listed(df, name), F.col("_row") == F.col(f"_{name}"), "left").drop(f"_{name}")
    wanted = space.write(wanted, "asked")
    space.drop("marks")
    space.drop("marks_again")
    texts = table.where("text is not null").join(wanted, F.col("row") == F.col("_row")).select("row", "doc_id", "rank", "text", "asked", "runs", "same")
    windows = space.write(window_table(texts), "windows")
    space.drop("asked")
    placed = windows.select("row", "doc_id", "rank", F.explode("windows").alias("w")).select("row", "doc_id", "rank", "w.*")
    groups = placed.groupBy(F.col("high").alias("_high"), F.col("low").alias("_low"))
    groups = groups.agg(F.min(F.struct("rank", "row"))["row"].alias("keeper"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = space.write(groups, "window_groups")
    found = placed.where("open").drop("doc_id", "rank").join(groups, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")))
    found = found.where(F.col("again") | (F.col("keeper") != F.col("row")))
    return found.select("row", "word", (F.col("word") + F.lit(WINDOW)).alias("end"), "start", "stop", F.lit(0).cast("long").alias("n_units"), "first")


def joined(pieces: DataFrame) -> DataFrame:
    """Pieces (row, word, end, start, stop, n_units, first) of a row that overlap or touch made one."""
    in_row = Window.partitionBy("row").orderBy("word")
    reach = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    apart = pieces.withColumn("apart", F.coalesce((F.col("word") > reach).cast("int"), F.lit(1)))
    runs = apart.withColumn("run", F.sum("apart").over(in_row.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "run")
    return runs.agg(
        F.min("word").alias("word"), F.max("end").alias("end"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.sum("n_units").alias("n_units"), F.min("first").alias("first"),
    ).drop("run")


def spans_of_rows(rows: DataFrame, space: Workspace, unit: str, min_words: int) -> DataFrame:
    """row, start, stop, n_units, n_words, first_doc_id, doc_id of each run that goes, from rows (row, doc_id, text)."""
    table = space.write(unit_table(rows, unit, min_words), "units")
    pieces = repeated_units(table, space)
    units = space.write(joined(pieces.drop("keeper", "shift")), "unit_runs")
    same = space.write(same_runs(pieces), "same_runs")
    space.drop("repeated")
    runs = space.write(joined(units.unionByName(repeated_windows(space, table, units, same))), "runs")
    names = table.select(F.col("row").alias("_row"), "doc_id")
    out = runs.join(names, F.col("row") == F.col("_row")).drop("_row")
    return out.select("row", "doc_id", "start", "stop", "n_units", (F.col("end") - F.col("word")).cast("long").alias("n_words"), F.col("first").alias("first_doc_id"))


def repeated_spans(docs: DataFrame, *, unit: str = "line", min_words: int = 1) -> DataFrame:
    """Removed spans: doc_id, start, stop (characters of the original text), n_units (whole repeated units in it), n_words,
    first_doc_id (the smallest doc_id that keeps a unit of the span, or a window that its units do not hold)."""
    space = Workspace(docs.sparkSession, "units")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return spans_of_rows(rows, space, unit, min_words).drop("row")


def without_spans(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the (start, stop) of what is left in the original text."""
    left, at = [], 0
    for start, stop in sorted(spans):
        if start > at:
            left.append((at, start))
        at = max(at, stop)
    if at < len(text):
        left.append((at, len(text)))
    return "".join(text[a:b] for a, b in left), left


def remove_repeats(docs: DataFrame, *, unit: str = "line", min_words: int = 1, kept: str = "kept") -> DataFrame:
    """docs with text cut, and a column kept: array of (start, stop) of the kept parts in the original text (null: all of it).

    All columns stay; should docs have a column of that name, the new one gets underscores behind it until it is free."""
    space = Workspace(docs.sparkSession, "cut")
    kept = free_name(docs, kept)
    rows = space.write(docs.withColumn("__cl_row", F.monotonically_increasing_id()), "rows")
    spans = spans_of_rows(rows.select(F.col("__cl_row").alias("row"), "doc_id", "text"), space, unit, min_words)
    spans = spans.groupBy(F.col("row").alias("__cl_r")).agg(F.collect_list(F.struct("start", "stop")).alias("__cl_spans"))
    marked = rows.join(spans, F.col("__cl_row") == F.col("__cl_r"), "left").drop("__cl_row", "__cl_r")

    @F.udf("struct<text:string,kept:array<struct<start:int,stop:int>>>", useArrow=True)
    def cut(text, spans):  # noqa: ANN001, ANN202
        if text is None or spans is None:
            return text, None
        return without_spans(text, [(s["start"], s["stop"]) for s in spans])

    return marked.withColumn("__cl_cut", cut("text", "__cl_spans")).withColumns({"text": F.col("__cl_cut.text"), kept: F.col("__cl_cut.kept")}).drop("__cl_cut", "__cl_spans")
