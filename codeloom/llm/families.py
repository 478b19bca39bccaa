"""Exact links among sets that may be similar: families of sets are compared in blocks, from the shingles of whole texts.

A family is a group of sets that sketches have brought together, far below the threshold. Its sets are dealt into blocks of bounded
size; a task holds one pair of blocks at a time, and pairs of sets are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WORD_BYTES, Workspace, tasks, text_parts
from codeloom.llm.components import components
from codeloom.llm.shingles import shingle_hashes

#: Sets of a large family that all its others are compared with first.
LEADS = 8


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of equal keys, which follow each other, as lists of columns."""
    key, held = None, None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        tags = list(zip(*(cols[k] for k in keys), strict=True))
        at = 0
        while at < len(tags):
            end = at + 1
            while end < len(tags) and tags[end] == tags[at]:
                end += 1
            if tags[at] == key:
                for n, values in cols.items():
                    held[n] += values[at:end]
            else:
                if held is not None:
                    yield key, held
                key, held = tags[at], {n: values[at:end] for n, values in cols.items()}
            at = end
    if held is not None:
        yield key, held


def roots_of(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def dealt(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """rows (set, key, blocks) with low, high and side: each row once for every pair of blocks of its key that its own block is
    in, dealt by the number of the pair, so that the pairs of one key are spread evenly over all tasks."""
    n, n_tasks = F.col(blocks).cast("long"), tasks(rows)
    own = F.pmod(F.xxhash64(F.lit(3), "set"), n)
    pair = lambda k: F.struct(F.least(k, own).alias("low"), F.greatest(k, own).alias("high"), own.alias("side"))
    spread = rows.withColumn("_pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), pair)))
    spread = spread.select(*rows.columns, "_pair.*")
    number = F.col("low") * n - F.expr("low * (low - 1) div 2") + F.col("high") - F.col("low")
    task = F.pmod(F.xxhash64(F.lit(5), key) + number, F.lit(n_tasks)).cast("int")
    return spread.repartitionById(n_tasks, task).sortWithinPartitions(key, "low", "high", "set")


def compare_block_pair(sets: list[np.ndarray], copies: list[int], side: list[int] | None, above: int = 4, below: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of a block pair, copies counted, and its component's smallest index. side: the block of each set where
    only pairs across the two count. Linked are sets with common * below >= above * union."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.int64)
    step = max(256, 8_000_000 // max(1, n))  # columns at once: a matrix of 32 MB, whose products are exact
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, min(step, int(column[b - 1]) - low + 1)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += (part @ part.T).astype(np.int64)
    linked = below * common >= above * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if side is not None:
        sides = np.array(side)
        linked &= sides[:, None] != sides[None, :]
    return linked @ np.array(copies, np.int64), roots_of(linked)


def shingle_sets(texts: DataFrame, bytes_to: bytes = WORD_BYTES) -> DataFrame:
    """set, family, blocks, copies, shingles (sorted distinct hashes as bytes) from the same with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(4).to_pylist()
            for at, stop in text_parts(given):
                hashes, counts = shingle_hashes(given[at:stop], bytes_to)
                ends = np.cumsum(counts)
                found = [np.unique(hashes[e - n : e]).tobytes() for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, stop - at).columns[:4], pa.array(found, pa.binary())], ["set", "family", "blocks", "copies", "shingles"])

    return texts.select("set", "family", "blocks", "copies", "text").mapInArrow(run, "set long, family long, blocks long, copies long, shingles binary")


EDGES = "a long, b long"


def linked_in_groups(rows: DataFrame, keys: list[str], across: bool, above: int, below: int) -> DataFrame:
    """EDGES that join what is linked in each group of rows (keys, set, side, shingles) that lie together: of all pairs, or of
    those across two sides only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for _, group in groups(batches, keys):
            keep = [k for k, s in enumerate(group["set"]) if k == 0 or s != group["set"][k - 1]]  # a repeated row has one set
            if len({group["side"][k] for k in keep}) > across and len(keep) > 1:
                number, side, raw = ([group[n][k] for k in keep] for n in ("set", "side", "shingles"))
                _, root = compare_block_pair([np.frombuffer(x, np.uint64) for x in raw], [1] * len(keep), side if across else None, above, below)
                held += [(s, number[r]) for s, r in zip(number, root.tolist(), strict=True) if s != number[r]]
            if len(held) > 20_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["a", "b"])

    return rows.select(*keys, "set", "side", "shingles").mapInArrow(run, EDGES)


def dealt_to(rows: DataFrame, parts: dict, keys: list[str]) -> DataFrame:
    """rows with an array of the parts (a column of structs with block and side) exploded, lying together by family and block."""
    n = tasks(rows)
    spread = rows.select("family", "set", "shingles", F.explode(parts["to"]).alias("_to")).select("family", "set", "shingles", "_to.*")
    number = F.pmod(F.xxhash64(F.lit(5), "family") + sum((F.col(k) * f for k, f in parts["number"].items()), F.lit(0)), F.lit(n))
    return spread.repartitionById(n, number.cast("int")).sortWithinPartitions(*keys, "set")


def joined(sets: DataFrame, space: Workspace, *, block: int, block_shingles: int, above: int, below: int) -> DataFrame:
    """EDGES, written: enough to join exactly what links join in each family of sets (family, set, shingles).

    A family of one block is compared whole. In a larger one each block is compared whole and with LEADS leads of the family,
    which ties nearly all of a family of near copies together: its sets are shipped once, and the leads once a block. Only
    sets outside the family's largest component then meet all blocks, in blocks of their own: their links to what they are not
    joined with yet may be anywhere. Sets within the largest component need no more links."""
    sized = sets.groupBy(F.col("family").alias("_family")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.octet_length("shingles") / 8).alias("_shingles"))
    # a family that is a large share of all sets has blocks enough for every task
    n_all = max(1, sets.count())
    even = F.least(F.ceil(F.col("_n") / 64), F.ceil(F.col("_n") * F.lit(tasks(sets) / n_all)))
    sized = sized.select("_family", F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_shingles") / block_shingles), F.when(F.col("_n") > block, even), F.lit(1)).alias("blocks"))
    given = space.write(sets.join(space.write(sized, "family-sizes"), F.col("family") == F.col("_family")).drop("_family"), "family-sets")
    own = F.pmod(F.xxhash64(F.lit(3), "set"), F.col("blocks"))
    least = [F.min(F.when(F.pmod(F.xxhash64(F.lit(7), "set"), F.lit(LEADS)) == k, F.col("set"))) for k in range(LEADS)]
    most = F.greatest(F.lit(1), F.expr(f"{8 * block_shingles} div max(octet_length(shingles))")).cast("int")  # the leads of a block are no more than a block
    leads = given.where("blocks > 1").groupBy(F.col("family").alias("_family")).agg(F.slice(F.array_compact(F.array(*least)), F.lit(1), most).alias("_leads"))
    leads = space.write(leads.select("_family", F.explode("_leads").alias("_lead")), "family-leads")
    marked = given.join(leads, (F.col("family") == F.col("_family")) & (F.col("set") == F.col("_lead")), "left").withColumn("own", own)
    to = F.struct(F.col("own").alias("block"), F.lit(0).alias("side"))
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(0).alias("side")))
    first = dealt_to(marked.withColumn("_all", F.when(F.col("_lead").isNull(), F.array(to)).otherwise(everywhere)), {"to": "_all", "number": {"block": 1}}, ["family", "block"])
    out = space.write(linked_in_groups(first, ["family", "block"], False, above, below), "links-1")
    if leads.isEmpty():
        return out
    large = given.where("blocks > 1").select("family", "set")
    known = components(out.join(large, F.col("a") == F.col("set"), "left_semi"), space, "joined")
    large = large.join(known, F.col("set") == F.col("node"), "left").select("family", "set", F.coalesce("root", "set").alias("root"))
    large = space.write(large, "labels")
    counts = large.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = space.write(counts.groupBy(F.col("family").alias("_family")).agg(F.max_by("root", F.struct("n", "root")).alias("main")), "mains")
    outside = large.join(main, F.col("family") == F.col("_family")).where("root <> main").select("family", F.col("set").alias("_set"))
    outside = space.write(outside, "outside")
    left = outside.groupBy(F.col("family").alias("_family")).agg(F.ceil(F.count(F.lit(1)) / block).alias("others"))
    rest = given.join(space.write(left, "outside-sizes"), F.col("family") == F.col("_family")).drop("_family")
    rest = rest.join(outside.select("_set"), F.col("set") == F.col("_set"), "left").withColumn("own", own)
    # of a pair of outside sets, both sides are dealt; what stands on both sides of one group is compared as any other pair
    mine = F.pmod(F.xxhash64(F.lit(13), "set"), F.col("others"))
    row = lambda block, other, side: F.struct(block.alias("block"), other.alias("other"), F.lit(side).alias("side"))
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda o: row(F.col("own"), o, 0))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: row(b, mine, 1))
    rest = rest.withColumn("_all", F.when(F.col("_set").isNull(), beside).otherwise(F.concat(beside, F.filter(across, lambda x: (x.block != F.col("own"))))))
    second = dealt_to(rest, {"to": "_all", "number": {"block": 1, "other": 7}}, ["family", "block", "other"])
    more = space.write(linked_in_groups(second, ["family", "block", "other"], True, above, below), "links-2")
    for dead in ("joined", "labels", "mains", "outside", "outside-sizes", "family-sizes", "family-sets", "family-leads"):
        space.drop(dead)
    return out.unionByName(more)


def linked_classes(
    docs: DataFrame, sets: DataFrame, families: DataFrame, space: Workspace, *, above: int, below: int, block: int, block_shingles: int, bytes_to: bytes = WORD_BYTES
) -> DataFrame:
    """node, root (smallest set of its class), written, of the sets that have links: sets (set, doc_id, text_hash) of families (node,
    root), from the whole texts of docs (doc_id, text)."""
    named = families.join(sets, F.col("node") == F.col("set")).select("set", F.col("root").alias("family"), F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    member = space.write(named, "members")
    # the texts of members are shuffled for this at every size: they are a share of the corpus, never a side to broadcast
    alike = (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(member.hint("merge"), alike)
    one = F.lit(1).cast("long")
    shingles = space.write(shingle_sets(texts.withColumns({"blocks": one, "copies": one}), bytes_to).select("family", "set", "shingles"), "shingles")
    classes = components(joined(shingles, space, block=block, block_shingles=block_shingles, above=above, below=below), space, "classes")
    for dead in ("members", "shingles", "links-1", "links-2"):
        space.drop(dead)
    return classes
