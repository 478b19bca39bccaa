"""Token ids in binary shards: fixed-size id blocks, transposed into byte or bit planes, each plane compressed.

File format of a shard (little-endian):

    magic 8 bytes
    for each block of up to block_ids ids, for each plane: zstandard of the plane, or nothing if all its bits are 0
    zstandard of the document table: doc_id int64 per document, 1 byte per document (1: doc_id is null), ids int64
    zstandard of the chunk index: per block first byte int64, ids int64, then the length of each plane int64
    JSON footer, its length as uint32, magic

Byte planes: plane k holds byte k of every id. Bit planes: plane k holds bit k of every id, 8 ids a byte. High planes of
a small vocabulary are all zero and take no bytes; each other plane is far more regular than the ids as they stand.

A shard holds whole documents; shards follow each other in ascending order of doc_id, so that id offsets over the whole
corpus are sums over shards.

Defined results: documents of equal doc_id are ordered by a hash of their text (copies and repeated rows are interchangeable);
a null doc_id comes first; null and empty texts hold the end id alone; very long texts are encoded piece by piece, cut at
white space; an empty table gives no shards and no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import AtomicFile, Workspace, store

MAGIC = b"CLPLANE1"
#: Characters that the encoder's array operations take at once.
CHUNK = 500_000
MANIFEST = "shard string, n_docs long, n_ids long, n_bytes long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def chunks_of(text: str | bytes) -> Iterator[str | bytes]:
    """The text in parts of some CHUNK characters, cut before ASCII white space: words stay whole, however long."""
    space, at = re.compile("[\t-\r ]" if isinstance(text, str) else rb"[\t-\r ]"), 0
    while len(text) - at > CHUNK and (cut := space.search(text, at + CHUNK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """ids as uint32. All-zero planes come back empty."""
    if bits:
        top = int(ids.max(initial=0)).bit_length()
        planes = [np.packbits(((ids >> k) & 1).astype(np.uint8)).tobytes() for k in range(top)]
        return [*(p if any(p) else b"" for p in planes), *[b""] * (32 - top)]
    block = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [block[:, k].tobytes() if block[:, k].any() else b"" for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if plane:
            raw = np.frombuffer(plane, np.uint8)
            if len(planes) == 32:
                ids |= np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(k)
            else:
                ids |= raw.astype(np.uint32) << np.uint32(8 * k)
    return ids


class ShardWriter:
    def __init__(self, uri: str, block_ids: int, bits: bool, level: int):
        self.file, self.block_ids, self.bits = AtomicFile(uri), block_ids, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block_ids * self.block_ids
            for k in range(0, whole, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) if p else b"" for p in to_planes(ids, self.bits)]
        self.chunks.append([self.file.write(b"".join(packed)), len(ids), *map(len, packed)])

    def close(self) -> int:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        table = self.zip.compress(docs[:, 0].tobytes() + docs[:, 1].astype(np.uint8).tobytes() + docs[:, 2].tobytes())
        index = self.zip.compress(np.array(self.chunks, "<i8").tobytes())
        foot = {
            "n_docs": len(docs), "n_ids": self.n_ids, "n_chunks": len(self.chunks), "planes": 32 if self.bits else 4,
            "block_ids": self.block_ids, "table": [self.file.write(table), len(table)], "index": [self.file.write(index), len(index)],
        }
        raw = json.dumps(foot).encode()
        self.file.write(raw + len(raw).to_bytes(4, "little") + MAGIC)
        self.file.close()
        return self.file.at


class ShardReader:
    """Random access by id position: blocks are found through the chunk index, and only they are read."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        length = int.from_bytes(tail[:4], "little")
        self.foot = json.loads(self.file.read_at(length, size - 12 - length))
        self.unzip = zstandard.ZstdDecompressor()
        n = self.foot["n_docs"]
        raw = self._unzip(*self.foot["table"])
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool)
        self.n_tokens = np.frombuffer(raw, "<i8", n, 9 * n)
        self.chunks = np.frombuffer(self._unzip(*self.foot["index"]), "<i8").reshape(-1, 2 + self.foot["planes"])
        self.ends = np.cumsum(self.chunks[:, 1])

    def _unzip(self, at: int, length: int) -> bytes:
        return self.unzip.decompress(self.file.read_at(length, at))

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.chunks[k].tolist()
        raw, planes, pos = self.file.read_at(sum(lengths), at), [], 0
        for length in lengths:
            planes.append(self.unzip.decompress(raw[pos : pos + length]) if length else b"")
            pos += length
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the shard."""
        first = int(np.searchsorted(self.ends, start, "right"))
        last = int(np.searchsorted(self.ends, max(start, stop - 1), "right"))
        if stop <= start or first >= len(self.chunks):
            return np.zeros(0, np.uint32)
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        base = int(self.ends[first] - self.chunks[first, 1])
        return got[start - base : stop - base]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position, ids) of each document, reading each block once."""
        held, base, k, start = np.zeros(0, np.uint32), 0, 0, 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.n_tokens.tolist(), strict=True):
            if base + len(held) < start + n:
                parts = [held[start - base :]]
                base, have = start, len(parts[0])
                while have < n:
                    parts.append(self.block(k))
                    have, k = have + len(parts[-1]), k + 1
                held = np.concatenate(parts)
            yield None if null else doc_id, start, held[start - base : start - base + n]
            start += n


class WordEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of them once.

    A tokenizer that drops white space, composes, lowers and splits by a pattern (WORD_NORMALIZERS, then a removing Split
    by WORD_SPLIT before a byte-level step) gives a text the ids of its pieces one after another. Texts of Latin-1
    letters, digits and punctuation are lowered and split here by array operations, CHUNK at a time, and each distinct
    piece goes to the library's model once; its ids are found again by a 64-bit hash of the piece, whose bytes are then
    compared (should two pieces share a hash, the library takes the whole part). In other texts each distinct word (between ASCII white space, which nothing merges across) goes through the whole library once. Any other
    tokenizer gets whole texts. What is kept is bounded in number and forgotten all at once when it is too much.
    """

    #: How such a tokenizer file describes its steps.
    WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPACE, LETTER, DIGIT, MARK = range(4)

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        about = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in about["added_tokens"]]
        split = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = (
            (about["normalizer"] or {}).get("normalizers") == self.WORD_NORMALIZERS
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": self.WORD_SPLIT}, "Removed", True)
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
            and not any(any(c.isspace() for c in t) for t in self.special)
        )
        kind = [unicodedata.category(chr(b))[0] for b in range(256)]
        self.kind = np.array([self.LETTER if k == "L" else self.DIGIT if k == "N" else self.MARK for k in kind], np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = self.SPACE
        #: Latin-1 without control characters and wide spaces.
        self.plain = bytes(b for b in range(256) if 9 <= b <= 13 or 32 <= b < 127 or b > 160)
        self.lower = bytes(ord(chr(b).lower()) for b in range(256))
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in set(seen))
        self.letters = {b: b for b in seen} | {b: 256 + k for k, b in enumerate(others)}  # byte-level alphabet
        rng = np.random.default_rng(7)
        self.salt = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.words: dict[bytes, bytes] = {}
        self.bits = max(10, (2 * self.keep).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.known, self.used = 0, 0
        self.first, self.length, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, "<u4")
        self.spelt_at, self.spelt_size, self.spelt, self.n_spelt = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8), 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_words(self, text: str) -> bytes:
        return b"".join(map(self._some_words, chunks_of(text)))

    def _some_words(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").split()
        new = list({*words}.difference(self.words))
        self.words.update(zip(new, self._whole([w.decode("utf-8", "replace") for w in new]), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 for others. Linear probing of the whole array at once."""
        found, open_ = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            keys = self.keys[slot]
            hit = keys == hashes[open_]
            found[open_[hit]] = self.at[slot[hit]]
            on = ~hit & (keys != 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found

    def _grow(self) -> None:
        """Twice the slots, so that at most half of them are ever taken and probing ends soon."""
        taken = np.flatnonzero(self.keys)
        keys, at = self.keys[taken], self.at[taken]
        self.bits += 1
        self.keys, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        for value, number in zip(keys.tolist(), at.tolist(), strict=True):
            slot = value >> (64 - self.bits)
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.at[slot] = value, number

    def _learn(self, value: int, raw: bytes) -> None:
        piece = raw.decode("latin-1")
        if 2 * self.known >= 1 << self.bits:
            self._grow()
        letters = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        slot = value >> (64 - self.bits)
        while self.keys[slot]:
            slot = (slot + 1) & ((1 << self.bits) - 1)
        if self.known == len(self.first):
            self.first, self.length, self.spelt_at, self.spelt_size = (np.resize(x, 2 * self.known) for x in (self.first, self.length, self.spelt_at, self.spelt_size))
        while self.n_spelt + len(raw) > len(self.spelt):
            self.spelt = np.resize(self.spelt, 2 * len(self.spelt))
        self.spelt[self.n_spelt : self.n_spelt + len(raw)] = np.frombuffer(raw, np.uint8)
        self.spelt_at[self.known], self.spelt_size[self.known], self.n_spelt = self.n_spelt, len(raw), self.n_spelt + len(raw)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.keys[slot], self.at[slot] = value, self.known
        self.first[self.known], self.length[self.known] = self.used, len(ids)
        self.pool[self.used : self.used + len(ids)] = ids
        self.known, self.used = self.known + 1, self.used + len(ids)

    def _pieces(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the pieces of lowered Latin-1 bytes that end with white space."""
        kind = self.kind[raw]
        start = np.empty(len(raw), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == self.DIGIT
        quotes = np.flatnonzero(raw == ord("'"))
        if len(quotes):
            quotes = quotes[(quotes == 0) | (kind[quotes - 1] != self.MARK)]  # others are amid a run of marks
            after = raw[np.minimum(quotes[:, None] + [1, 2], len(raw) - 1)]
            one = np.isin(after[:, 0], np.frombuffer(b"stmd", np.uint8))
            two = np.zeros(len(quotes), bool)
            for pair in (b"re", b"ve", b"ll"):
                two |= (after == np.frombuffer(pair, np.uint8)).all(axis=1)
            for cut, size in ((quotes[one], 1), (quotes[two], 2)):
                start[cut + 1] = False
                start[cut + 1 + size] |= kind[cut + 1 + size] != self.SPACE
        bounds = np.flatnonzero(start)
        keep = kind[bounds] != self.SPACE
        ends = np.append(bounds[1:], len(raw))
        return bounds[keep], (ends - bounds)[keep]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        sizes = np.array([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        starts, lengths = self._pieces(raw)
        if not len(starts):
            return [b""] * len(texts)
        # hash: sum of salt[byte] * odd ** place over the bytes of a piece; white space after it counts as 0
        cut = int(starts[0])
        raw, starts = raw[cut:], starts - cut
        spans = np.diff(np.append(starts, len(raw)))
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), spans)
        inside = place < np.repeat(lengths, spans)
        powers = np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        value = self.salt[raw] * powers[place]
        value[~inside] = 0
        hashes = np.add.reduceat(value, starts)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(32))) | np.uint64(1)
        numbers = self._find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            values, where = np.unique(hashes[missing], return_index=True)
            for v, k in zip(values.tolist(), missing[where].tolist(), strict=True):
                self._learn(v, raw[starts[k] : starts[k] + lengths[k]].tobytes())
            numbers[missing] = self._find(hashes[missing])
        spelt = self.spelt[np.minimum(np.repeat(self.spelt_at[numbers], spans) + place, len(self.spelt) - 1)]
        if (self.spelt_size[numbers] != lengths).any() or (inside & (spelt != raw)).any():  # two pieces of one hash
            return self._whole([t.decode("latin-1") for t in texts])
        counts = self.length[numbers].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.pool[np.arange(int(ends[-1])) + np.repeat(self.first[numbers] - (ends - counts), counts)]
        # pieces before the end of each text, then ids before it
        stops = np.searchsorted(starts, np.cumsum(sizes) - cut)
        at = np.concatenate([[0], np.append(0, ends)[stops]]) * 4
        packed = ids.tobytes()
        return [packed[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._whole([t or "" for t in texts])
        if self.known + len(self.words) > self.keep:
            self.forget()
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []

        def flush() -> None:
            for (k, _), ids in zip(waiting, self._plain([raw for _, raw in waiting]), strict=True):
                out[k].append(ids)
            waiting.clear()

        size = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or raw.translate(None, self.plain) or any(t in text for t in self.special):
                out[k].append(self._by_words(text))
                continue
            for part in chunks_of(raw.translate(self.lower)):
                waiting.append((k, part))
                size += len(part)
                if size > CHUNK:
                    flush()
                    size = 0
        if waiting:
            flush()
        return [b"".join(parts) for parts in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, so that later tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int = 1,
    block_ids: int = 65_536,
    bits: bool = False,
    shard_ids: int = 64_000_000,
    level: int = 3,
) -> DataFrame:
    """Encode docs (doc_id, text), add end_id to each, and write shards in ascending doc_id order below folder.

    One range shuffle of the texts on (doc_id, hash of text); then each partition streams through the encoder and its
    file, holding one block, the document table of one shard and a bounded batch of texts. Returns the manifest
    (one row per shard); running it writes the files. A rerun task writes the same bytes under the same name.
    """
    ordered = (
        docs.select("doc_id", "text")
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
        .drop("_tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done, shard, name = encoder(tokenizer), TaskContext.get().partitionId(), [], None, ""
        end = np.array([end_id], "<u4").tobytes()

        def finish() -> None:
            done.append((name, len(shard.docs), shard.n_ids, shard.close()))

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                for doc_id, raw in zip(rows.column(0).to_pylist(), encode.encode(rows.column(1).to_pylist()), strict=True):
                    if shard is not None and shard.n_ids >= shard_ids:
                        finish()
                        shard = None
                    if shard is None:
                        name = f"shard-{part:06d}-{len(done):04d}.planes"
                        shard = ShardWriter(f"{folder}/{name}", block_ids, bits, level)
                    shard.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if shard is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["shard", "n_docs", "n_ids", "n_bytes"])

    return ordered.mapInArrow(run, MANIFEST)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document what its shard holds: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    The offset of a shard is a running sum over the manifest, one row per shard; the ids themselves are never moved."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    # as many tasks as asked for: the rows are few, but a file stands behind each
    shards = shards.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for doc_id, start, ids in ShardReader(f"{folder}/{name}").documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name))
                    if len(rows) == 20_000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return shards.mapInArrow(run, DOCS)


def tokens_to_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards of docs, then read them back: one row per document (see read_shards).

    Without folder the files go to the shared folder of the session and live as long as the driver."""
    space = Workspace(docs.sparkSession, "planes")
    folder = folder or space.path("shards")
    manifest = space.write(write_shards(docs, folder, tokenizer, **options), "manifest")
    return read_shards(manifest, folder)
