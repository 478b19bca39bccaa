"""Benchmark decontamination with a distributed positional inverted index.

Index: documents are dealt to shards of bounded size; a shard holds, for each of its words, the sorted positions of its
occurrences (positions run through all words of the shard, with a gap between documents) and a table of its documents.
Shards are rows of a Parquet table, so a search reads them where they lie and nothing is shuffled; a word that stands in
every document makes each shard's list longer, never one list for all.

Search: the windows of the benchmark lie in files of bounded size. Of each window the shard's rarest word gives the
candidates; they are intersected with the lists of the other words, each moved by its place in the window, from the
next rarest on, until nothing is left: exact phrases. Proximity search does the same with a slop: a window is near
where a place p has each of its words within slop words of p plus the word's place. Windows with a word that the shard lacks
are never looked up.

Defined results: null and wordless texts have no words, are in the index with none, and are never contaminated; very long
texts are indexed in pieces that overlap by more than a window, and put together again; a null or wordless item has no
windows; equal items each count; a null item_id counts as the string "null"; rows that share a doc_id are documents of
their own; an empty benchmark leaves every document clean; an empty table gives no rows; other columns, whatever their
names, play no part (drop_contaminated returns them as they are).
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_BYTES, AtomicFile, Workspace, lower_words, store

#: Words between two documents in positions: no window reaches across. Pieces of a long text overlap by as many.
GAP = 1_000
#: Bytes of text that a piece takes.
PIECE_BYTES = 8 << 20
#: Candidates that a shard looks at together, and windows that it is asked for together.
CANDIDATES, WINDOWS = 2_000_000, 100_000
#: Shards in a file: a task holds no more of them at once, however many its texts make.
SHARDS = 4
SHARD_TYPES = [
    ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("whole", pa.list_(pa.bool_())), ("starts", pa.list_(pa.int64())),
    ("offsets", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("firsts", pa.list_(pa.int64())), ("postings", pa.binary()),
]
SHARD = "rows array<long>, doc_ids array<long>, known array<boolean>, whole array<boolean>, starts array<long>, offsets array<long>, n_words array<long>, own array<long>, terms array<string>, firsts array<long>, postings binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FOUND_TYPES = [("row", pa.int64()), ("doc_id", pa.int64()), ("whole", pa.bool_()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]
FOUND = "row long, doc_id long, whole boolean, n_words long, n_hit long, spans array<struct<start:long,stop:long>>, items array<string>, near array<string>"


class Shard:
    """Postings in memory: positions of word t are postings[firsts[t]:firsts[t + 1]]."""

    def __init__(self, terms: list[str], firsts: np.ndarray, postings: np.ndarray):
        self.number = {t: k for k, t in enumerate(terms)}
        self.firsts, self.postings, self.counts = firsts, postings, np.append(np.diff(firsts), 0)
        self.span = int(postings.max(initial=0)) + 2 * GAP
        #: (word, position) as one ascending number, so that all lists are searched together.
        self.keys = np.repeat(np.arange(len(terms)), self.counts[:-1]) * self.span + postings + GAP

    def numbers(self, words: list[str]) -> np.ndarray:
        """The shard's number of each word, -1 for others."""
        return np.array([self.number.get(w, -1) for w in words], np.int64)

    def find(self, windows: np.ndarray, sizes: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, place, position of its rarest word) of each match, some candidates at a time; windows are rows of numbers,
        of which the first sizes count."""
        inside = np.arange(windows.shape[1]) < sizes[:, None]
        lengths = np.where(inside, self.counts[windows], np.iinfo(np.int64).max)
        alive = np.flatnonzero(lengths.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        order = np.argsort(lengths[alive], axis=1, kind="stable")
        work = np.cumsum(lengths[alive, order[:, 0]] * (2 * slop + 1)) if len(alive) else np.zeros(0, np.int64)
        cuts = np.unique(np.searchsorted(work, np.arange(0, int(work[-1]) + CANDIDATES, CANDIDATES), "right")) if len(work) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(work) else ():
            yield self._find(alive[a:b], windows[alive[a:b]], inside[alive[a:b]], order[a:b], slop)

    def _find(self, names: np.ndarray, windows: np.ndarray, inside: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        anchor = order[:, 0]
        term = windows[np.arange(len(windows)), anchor]
        counts = self.counts[term]
        owner = np.repeat(np.arange(len(windows)), counts)
        at = self.postings[np.arange(len(owner)) + np.repeat(self.firsts[term] - (np.cumsum(counts) - counts), counts)]
        shifts = np.arange(-slop, slop + 1)
        starts = (at - anchor[owner])[:, None] + shifts
        owner, at, starts = np.repeat(owner, len(shifts)), np.repeat(at, len(shifts)), starts.ravel()
        for k in range(1, windows.shape[1]):
            place = order[owner, k]
            key = windows[owner, place] * self.span + starts + place + GAP
            k_at = np.minimum(np.searchsorted(self.keys, key - slop), len(self.keys) - 1)
            found = self.keys[k_at]
            good = ~inside[owner, place] | ((found >= key - slop) & (found <= key + slop))
            owner, at, starts = owner[good], at[good], starts[good]
        return names[owner], starts, at


def pieces_of(text: str | None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(words of the text before the piece, new words in it, its words): pieces of some PIECE_BYTES, each of which begins with
    the last GAP words of the one before."""
    raw, at, before, tail = b"" if text is None else text.encode("utf-8", "replace").translate(WORD_BYTES), 0, 0, []
    while True:
        end = raw.find(b" ", at + PIECE_BYTES) if len(raw) - at > PIECE_BYTES else -1
        words = raw[at : end if end >= 0 else len(raw)].split()
        yield before - len(tail), len(words), tail + words
        if end < 0:
            return
        at, before, tail = end, before + len(words), (tail + words)[-GAP:]


def build_index(docs: DataFrame, shard_words: int = 1_000_000) -> DataFrame:
    """Shards (SHARD) of docs (row, doc_id, text): every word of every text."""

    def pack(held: list[tuple]) -> pa.RecordBatch:
        rows, ids, whole, offsets, own, texts = zip(*held, strict=True)
        counts = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(counts + GAP) - counts - GAP
        flat = [w for words in texts for w in words]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        codes = np.fromiter(map(numbers.__getitem__, flat), np.int32, len(flat))
        at = np.arange(len(flat)) + np.repeat(np.arange(len(counts)) * GAP, counts)
        order = np.argsort(codes.astype(np.uint16) if len(numbers) < 1 << 16 else codes, kind="stable")
        at, firsts = at[order], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(numbers)))])
        gaps = np.diff(at, prepend=0)
        gaps[firsts[:-1]] = at[firsts[:-1]]
        row = {
            "rows": rows, "doc_ids": [i or 0 for i in ids], "known": [i is not None for i in ids], "whole": whole, "starts": starts, "offsets": offsets, "n_words": counts, "own": own,
            "terms": [w.decode("utf-8", "replace") for w in numbers], "firsts": firsts, "postings": gaps.astype("<u4").tobytes(),
        }
        return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in SHARD_TYPES], [k for k, _ in SHARD_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                for row, doc_id, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    whole = text is None or len(text) * 4 <= PIECE_BYTES
                    for offset, own, words in pieces_of(text):
                        held.append((row, doc_id, whole, offset, own, words))
                        size += len(words) + GAP // 100
                        if size >= shard_words:
                            yield pack(held)
                            held, size = [], 0
        if held:
            yield pack(held)

    return docs.select("row", "doc_id", "text").mapInArrow(run, SHARD)


def open_shard(row: dict) -> Shard:
    firsts = np.array(row["firsts"], np.int64)
    gaps = np.frombuffer(row["postings"], "<u4").astype(np.int64)
    if len(gaps):
        total, heads = np.cumsum(gaps), firsts[:-1]
        gaps = total - np.repeat(total[heads] - gaps[heads], np.diff(firsts))
    return Shard(row["terms"], firsts, gaps)


def windows_of(text: str | None, width: int = 13) -> list[tuple[bytes, ...]]:
    """Windows of an item: width consecutive words each; the whole item if it has fewer, but not none."""
    words = lower_words(text)
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]


class Block:
    """Distinct windows of some items: words, windows as rows of word numbers, sizes, and the items of each window."""

    def __init__(self, raw: bytes):
        held = np.load(io.BytesIO(raw))
        self.words = held["words"].tobytes().decode("utf-8", "replace").split(" ")
        self.windows, self.sizes, self.firsts, self.owners = (held[k] for k in ("windows", "sizes", "firsts", "owners"))
        self.items = json.loads(held["items"].tobytes())

    @staticmethod
    def pack(windows: dict[tuple[bytes, ...], list[int]], items: list[str], width: int) -> bytes:
        numbers: dict[bytes, int] = {}
        rows = np.zeros((len(windows), width), np.int32)
        for k, window in enumerate(windows):
            rows[k, : len(window)] = [numbers.setdefault(w, len(numbers)) for w in window]
        out = io.BytesIO()
        np.savez(
            out, words=np.frombuffer(b" ".join(numbers), np.uint8), windows=rows, sizes=np.array([len(w) for w in windows], np.int32),
            firsts=np.cumsum([0, *map(len, windows.values())]), owners=np.array([i for of in windows.values() for i in of], np.int32),
            items=np.frombuffer(json.dumps(items).encode(), np.uint8),
        )
        return out.getvalue()

    def items_of(self, windows: np.ndarray, pieces: np.ndarray) -> Iterator[tuple[int, list[str]]]:
        """(piece, items) of matches (window, piece)."""
        for window, piece in np.unique(np.stack([windows, pieces], axis=1), axis=0).tolist():
            yield piece, [self.items[k] for k in self.owners[self.firsts[window] : self.firsts[window + 1]].tolist()]


def write_blocks(benchmark: DataFrame, folder: str, width: int, block_bytes: int = 4_000_000) -> list[str]:
    """Writes the windows of all items below folder, in files of about block_bytes of text or less; returns their names. The
    driver sees only those."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).first().n or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, windows, held = [], [], {}, 0

        def finish() -> None:
            names.append(f"block-{TaskContext.get().partitionId():06d}-{len(names):04d}.npz")
            file = AtomicFile(f"{folder}/{names[-1]}")
            file.write(Block.pack(windows, items, width))
            file.close()

        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = dict.fromkeys(windows_of(text, width))
                if found:
                    items.append(item)
                    held += len(text)
                for window in found:
                    windows.setdefault(window, []).append(len(items) - 1)
                if held >= block_bytes:
                    finish()
                    items, windows, held = [], {}, 0
        if windows:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return sorted(r.name for r in rows.coalesce(max(1, -(-size // block_bytes))).mapInArrow(run, "name string").collect())


_blocks: dict[str, Block] = {}


def block(uri: str) -> Block:
    """A block, the last one of which a worker process keeps."""
    if uri not in _blocks:
        fs, path = store(uri)
        with fs.open_input_file(path) as file:
            found = Block(file.read())
        _blocks.clear()
        _blocks[uri] = found
    return _blocks[uri]


def search_shard(row: dict, blocks: Iterator[Block], slop: int) -> list[tuple]:
    """Columns of FOUND for the documents, or pieces of documents, of a shard."""
    shard, starts, counts = open_shard(row), np.array(row["starts"], np.int64), np.array(row["n_words"], np.int64)
    # hits are marked by words, with one place between documents, since the gaps between many short ones are longer than all of them
    firsts = np.cumsum(counts + 1) - counts - 1
    change = np.zeros(int((counts + 1).sum()) + 1, np.int32)
    exact: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    for asked in blocks:
        numbers = shard.numbers(asked.words)
        for at in range(0, len(asked.windows), WINDOWS):
            sizes = asked.sizes[at : at + WINDOWS]
            windows = np.where(np.arange(asked.windows.shape[1]) < sizes[:, None], numbers[asked.windows[at : at + WINDOWS]], -1)
            for found, names in ((shard.find(windows, sizes), exact), (shard.find(windows, sizes, slop), near)):
                for window, start, place in found:
                    pieces = np.searchsorted(starts, place, "right") - 1
                    if names is exact:
                        first = start - starts[pieces] + firsts[pieces]
                        np.add.at(change, first, 1)
                        np.add.at(change, first + sizes[window], -1)
                    for piece, items in asked.items_of(at + window, pieces):
                        names.setdefault(piece, set()).update(items)
    hit = np.concatenate([[False], np.cumsum(change) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    spans: dict[int, list[dict]] = {}
    for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        piece = int(np.searchsorted(firsts, first, "right")) - 1
        shift = row["offsets"][piece] - int(firsts[piece])
        spans.setdefault(piece, []).append({"start": first + shift, "stop": stop + shift})
    out = []
    for k, (number, doc_id, known, whole, own) in enumerate(zip(*(row[n] for n in ("rows", "doc_ids", "known", "whole", "own")), strict=True)):
        held = spans.get(k, [])
        out.append((number, doc_id if known else None, whole, own, sum(s["stop"] - s["start"] for s in held), held, sorted(exact.get(k, ())), sorted(near.get(k, ()))))
    return [*zip(*out, strict=True)]


def search(index: DataFrame, folder: str, names: list[str], slop: int) -> DataFrame:
    """FOUND: per document, or piece of a long one, n_words, the spans of words inside occurrences of windows and n_hit (their
    words), items (with exact occurrences) and near (with occurrences by proximity), as ids sorted as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = search_shard(batch.slice(k, 1).to_pylist()[0], (block(f"{folder}/{n}") for n in names), slop)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FOUND_TYPES, strict=True)], [n for n, _ in FOUND_TYPES])

    return index.mapInArrow(run, FOUND)


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """One row (of FOUND) for each document of pieces: spans that overlap or touch made one, items of all pieces."""
    of = lambda name: F.flatten(F.collect_list(name))
    found = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.array_sort(of("spans")).alias("_all"), *[F.array_sort(F.array_distinct(of(n))).alias(n) for n in ("items", "near")])
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")

    def add(held, s):  # noqa: ANN001, ANN202
        last = F.try_element_at(held, F.lit(-1))
        merged = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.stop, s.stop).alias("stop"))))
        return F.when(last.stop >= s.start, merged).otherwise(F.concat(held, F.array(s)))

    found = found.withColumn("spans", F.aggregate("_all", none, add))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return found.select("row", "doc_id", F.lit(True).alias("whole"), "n_words", hit.alias("n_hit"), "spans", "items", "near")


def matches(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, slop: int = 2, space: Workspace | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """FOUND for each row of docs (doc_id, text), or (row, doc_id, text) with numbers of the caller."""
    if width + slop >= GAP:
        raise ValueError(f"windows of {width} words with a slop of {slop} reach over {GAP} words")
    space = space or Workspace(docs.sparkSession, "phrases")
    rows = docs if "row" in docs.columns else docs.withColumn("row", F.monotonically_increasing_id())
    index = space.write(build_index(rows.select("row", "doc_id", "text")), "index", SHARDS)
    names = write_blocks(benchmark, space.path("blocks"), width, block_bytes)
    found = search(index, space.path("blocks"), names, slop)
    long_rows = index.select(F.explode(F.arrays_zip("rows", "whole")).alias("p")).where("not p.whole")
    if long_rows.isEmpty():  # nothing is put together, and nothing shuffled, unless a text was parted
        return found
    found = space.write(found, "found")
    return found.where("whole").unionByName(joined_pieces(found.where("not whole")))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words), and n_near: items found by
    proximity, the exact ones among them."""
    return verdicts(matches(docs.select("doc_id", "text"), benchmark, **options)).drop("row")


def verdicts(found: DataFrame) -> DataFrame:
    return found.select(
        "row", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.size("near").cast("long").alias("n_near"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated documents; all columns stay.

    Rows are named by a hash of doc_id and text here, so that rows that share a doc_id are told apart."""
    space = Workspace(docs.sparkSession, "clean")
    named = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    found = verdicts(matches(named, benchmark, space=space, **options))
    bad = space.write(found.where("contaminated").select(F.col("doc_id").alias("__cl_bad")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64("doc_id", "text") == F.col("__cl_bad"), "left_anti")
