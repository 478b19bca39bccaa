"""N-gram Jaccard join by chosen paths, and near-duplicate classes.

A text is the set of its runs of five lower-case words (a text of fewer words, but not none, is one run); two texts are
linked if their sets have a Jaccard similarity of 4/5 or more. Steps:

1. Each text gets a digest of its set, and a sketch: for each of many hash functions the smallest value over the set, which
   is a token sampled evenly from the set, and the same one in two sets with the probability of their similarity. Texts
   of equal sets are linked, and one of them stands for all.
2. Chosen paths: every run starts with all sets in one bucket. A bucket is split by a token sampled at a place of the sketch
   that the path so far chooses (often two places, so that a similar pair keeps about one common bucket a level);
   buckets up to small are compared by brute force on sketches, larger ones are split again. Before that, each set of a
   large bucket is compared with the bucket's lead: what agrees is tied to it, and a bucket whose sets are all tied
   together is done, so that a hot family is not carried on. What is still large at the last depth is compared by brute
   force too, dealt into pairs of blocks. Runs repeat until a pair at the threshold is met with the target recall.
3. Sets that met and whose sketches agree well enough, far below the threshold, form families: connected components.
4. In a family all pairs are compared exactly, from the shingle sets of whole texts. Families are dealt into blocks of
   bounded size (sets and shingles), and the pairs of blocks evenly among tasks; pairs of sets are counted there and never
   leave it as rows. A block pair returns for each set its number of links (copies counted) and its component there. Where only
   classes are asked for (keep_one), a large family's sets meet leads first, and then only what those have not tied together.
5. Components of those are the classes.

A link between different texts is lost only if no path of meetings joins its two sets, which is far rarer than that
the pair itself never meets. Copies are never expanded into pairs.

Defined results: null and wordless texts are linked with nothing, and so is a text of fewer than five words but with copies of
it; class_id is the smallest doc_id of the class (nulls aside); rows that share a doc_id are texts of their own; ties and
repeated rows are copies; very long texts are hashed piece by piece and compared whole; an empty table gives no rows; other
columns, whatever their names, play no part (keep_one returns them as they are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Workspace, tasks, text_parts
from codeloom.llm.components import components
from codeloom.llm.families import compare_block_pair, dealt, groups, linked_classes, roots_of, shingle_sets
from codeloom.llm.shingles import ODD, mix, shingle_hashes

PLACES = 64
#: Sets of a large bucket that all its others are compared with first.
LEADS = 8
#: Similarity as a fraction: links have common * below >= above * union.
ABOVE, BELOW = 4, 5
FACTORS = np.random.default_rng(20240301).integers(1, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of PLACES values (uint32) per text that has shingles."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), PLACES), np.uint32)
    for k, factor in enumerate(FACTORS):
        out[:, k] = np.minimum.reduceat((hashes * factor) >> np.uint64(32), starts) if len(starts) else 0
    return out


def sketch_table(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, digest, size (shingles) and sketch (null without words) of each document. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, stop in text_parts(texts):
                hashes, counts = shingle_hashes(texts[at:stop])
                found, ends = iter(sketch(hashes, counts)), np.cumsum(counts)
                digests, sizes, sketches = [], [], []
                for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    distinct = np.unique(hashes[end - n : end])
                    sizes.append(len(distinct))
                    digests.append(blake2b(distinct.tobytes(), digest_size=16).digest() if n else None)
                    sketches.append(next(found).tobytes() if n else None)
                rows = batch.slice(at, stop - at)
                columns = [rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "digest", "size", "sketch"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, digest binary, size long, sketch binary").withColumn("row", F.monotonically_increasing_id())


def meets(similarity: float, depth: int) -> float:
    """Probability that one run brings a pair whose sketches agree in this share of places together at full depth: a path goes
    on at one place, and at a second one with the probability that keeps a pair at the threshold in one common child on
    average."""
    second, met = BELOW / ABOVE - 1, 1.0
    for _ in range(depth):
        met = 1 - (1 - similarity * met) * (1 - second * similarity * met)
    return met


def recall_of(runs: int, depth: int, least: float, similarity: float = ABOVE / BELOW) -> float:
    """Probability that a pair of this similarity meets and passes the check of sketches. All runs draw from one sketch, so that
    they are independent only given the number of places in which it agrees, a binomial."""
    chance = lambda k: math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k)
    return sum(chance(k) * (1 - (1 - meets(k / PLACES, depth)) ** runs) for k in range(math.ceil(least * PLACES), PLACES + 1))


def runs_for(recall: float, depth: int, least: float) -> int:
    """Runs that reach the recall at the threshold for a pair whose buckets are large at every level."""
    runs, before = 1, 0.0
    while before < (now := recall_of(runs, depth, least)) < recall:
        runs, before = runs + 1, now
    if now < recall:
        raise ValueError(f"{PLACES} places with a check at {least} reach a recall of {now:.6f} at most")
    return runs


def children(paths: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into paths, new path) of each path's children under its set's sketch."""
    chosen = mix(paths ^ np.uint64(0xA5A5A5A5))
    first = (chosen % np.uint64(PLACES)).astype(np.int64)
    other = ((chosen >> np.uint64(16)) % np.uint64(PLACES)).astype(np.int64)
    again = ((chosen >> np.uint64(40)) % np.uint64(ABOVE * 1000)).astype(np.int64) < (BELOW - ABOVE) * 1000
    again &= other != first
    at = np.concatenate([np.arange(len(paths)), np.flatnonzero(again)])
    place = np.concatenate([first, other[again]])
    value = sketches[at, place].astype(np.uint64)
    return at, mix(mix(paths[at] * ODD + place.astype(np.uint64) + np.uint64(1)) + value)


PATHS = "path long, set long, label long"


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def path_batch(path: np.ndarray, sets: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(sets), pa.array(label)], ["path", "set", "label"])


def first_paths(sets: DataFrame, runs: int) -> DataFrame:
    """PATHS of sets (set, sketch) below the roots of all runs. A set's label is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * ODD)
        for batch in batches:
            if batch.num_rows:
                own = batch.column("set").to_numpy(zero_copy_only=False)
                at, new = children(np.tile(roots, len(own)), sketches_of(batch.column("sketch"))[np.repeat(np.arange(len(own)), runs)])
                yield path_batch(new, own[at // runs], own[at // runs])

    return sets.select("set", "sketch").mapInArrow(run, PATHS)


def next_paths(rows: DataFrame) -> DataFrame:
    """PATHS of the children of rows (path, set, label, sketch), with their sketches: few go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                path, own, label = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("path", "set", "label"))
                at, below = children(path.view(np.uint64), sketches_of(batch.column("sketch")))
                yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), pa.array(own[at]), pa.array(label[at]), batch.column("sketch").take(pa.array(at))], ["path", "set", "label", "sketch"])

    return rows.select("path", "set", "label", "sketch").mapInArrow(run, f"{PATHS}, sketch binary")


def with_sketches(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """rows (set) with the sketch of slim (_set, sketch)."""
    return rows.join(slim, F.col("set") == F.col("_set")).drop("_set")


def listed(rows: DataFrame) -> DataFrame:
    """_path, sets, labels, sketches of rows (path, set, label, sketch), of which a path has only a few: lists in order of sets,
    the sketches one after another."""
    some = rows.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("set", "label", "sketch"))).alias("_l"))
    part = lambda name: F.transform("_l", lambda x: x[name])
    return some.select("_path", part("set").alias("sets"), part("label").alias("labels"), F.aggregate(part("sketch"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("sketches"))


def leads_of(large: DataFrame) -> DataFrame:
    """listed() sets of each large bucket: the smallest of each of LEADS parts of its sets."""
    part = F.pmod(F.xxhash64(F.lit(7), "set"), F.lit(LEADS))
    least = [F.min(F.when(part == k, F.col("set"))) for k in range(LEADS)]
    chosen = large.groupBy(F.col("path").alias("_path")).agg(F.array_compact(F.array(*least)).alias("_leads")).select("_path", F.explode("_leads").alias("_lead"))
    return listed(large.join(chosen, (F.col("path") == F.col("_path")) & (F.col("set") == F.col("_lead"))).select("path", "set", "label", "sketch"))


def by_path(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """(rows, sets, labels, sketches of what is listed) for each path of a batch."""
    _, first, back = np.unique(batch.column("path").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    for k, at in enumerate(first.tolist()):
        sets, labels, raw = (batch.column(n)[at].as_py() for n in ("sets", "labels", "sketches"))
        yield np.flatnonzero(back == k), sets, labels, np.frombuffer(raw, np.uint32).reshape(len(sets), -1)


def agreeing(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x agree with which of y in the share least of places."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for k in range(x.shape[1]):
        same += x[:, None, k] == y[None, :, k]
    return same >= least * x.shape[1]


def tied_to_leads(rows: DataFrame, least: float) -> DataFrame:
    """path, set, label, sketch, main, ties of rows (path, set, label, sketch) with the leads of their bucket listed beside them: ties are
    leads that agree with the set, one of each group of leads that agree; label is the group's from there on, and main that
    of the largest group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, label = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("set", "label"))
                sketches, main, ties = sketches_of(batch.column("sketch")), np.zeros(len(own), np.int64), [()] * len(own)
                label = label.copy()
                for at, sets, labels, leads in by_path(batch):
                    group = roots_of(agreeing(leads, leads, least))
                    of_group = {g: min(labels[k] for k in np.flatnonzero(group == g).tolist()) for g in np.unique(group).tolist()}
                    main[at] = of_group[int(np.bincount(group).argmax())]
                    for row, found in zip(at.tolist(), agreeing(sketches[at], leads, least), strict=True):
                        if found.any():
                            met = {int(group[k]): sets[k] for k in np.flatnonzero(found).tolist()}
                            ties[row] = [s for s in met.values() if s != own[row]]
                            label[row] = min(of_group[g] for g in met)
                columns = [batch.column("path"), batch.column("set"), pa.array(label), batch.column("sketch"), pa.array(main), pa.array(ties, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "set", "label", "sketch", "main", "ties"])

    given = rows.select("path", "set", "label", "sketch", "sets", "labels", "sketches")
    return given.mapInArrow(run, f"{PATHS}, sketch binary, main long, ties array<long>")


def compare_with_listed(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): each listed set b with a set of each other label among rows (path, set, label, sketch, listed sets) that agrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            if batch.num_rows:
                own, label, sketches = batch.column("set").to_pylist(), batch.column("label").to_pylist(), sketches_of(batch.column("sketch"))
                for at, sets, labels, others in by_path(batch):
                    for r, k in zip(*(x.tolist() for x in np.nonzero(agreeing(sketches[at], others, least))), strict=True):
                        row = int(at[r])
                        if label[row] != labels[k]:
                            found.setdefault((sets[k], label[row]), own[row])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([*found.values()], pa.int64()), pa.array([b for b, _ in found], pa.int64())], ["a", "b"])

    return rows.select("path", "set", "label", "sketch", "sets", "labels", "sketches").mapInArrow(run, "a long, b long")


def compare_sketches(buckets: DataFrame, least: float) -> DataFrame:
    """(a, b) that join the sets whose sketches agree in at least the share least of places, in each bucket (path, blocks, set,
    sketch) or pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in groups(batches, ["path", "low", "high"]):
            sets = rows["set"]
            x = np.frombuffer(b"".join(rows["sketch"]), np.uint32).reshape(len(sets), -1)
            out += [(a, sets[r]) for a, r in zip(sets, roots_of(agreeing(x, x, least)).tolist(), strict=True) if a != sets[r]]
            if len(out) > 20_000:
                yield pairs(out)
                out = []
        if out:
            yield pairs(out)

    def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return dealt(buckets, "path", "blocks").select("path", "low", "high", "set", "sketch").mapInArrow(run, "a long, b long")


def meetings(sets: DataFrame, space: Workspace, *, recall: float, depth: int, small: int, least: float, block: int) -> DataFrame:
    """(a, b), written: edges over the sets (set, sketch) that met in a bucket, enough to connect what belongs together."""
    slim = sets.select(F.col("set").alias("_set"), "sketch")
    paths = space.write(first_paths(sets, runs_for(recall, depth, least)), "paths-1")
    leaves, ties = [], []
    for level in range(1, depth + 1):
        sizes = paths.groupBy(F.col("path").alias("_path"))
        sizes = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("n > 1 and _lo <> _hi")
        sizes = space.write(sizes.select("_path", "n"), f"sizes-{level}")
        members = space.write(paths.join(sizes, F.col("path") == F.col("_path")).drop("_path"), f"members-{level}")
        space.drop(f"paths-{level}")
        large = members.where(F.col("n") > small)
        last = level == depth or large.isEmpty()
        leaf = (members if last else members.where(F.col("n") <= small)).withColumn("blocks", F.ceil(F.col("n") / block))
        # sketches are joined to the paths of the first level only: from there on the few rows that go on have theirs with them
        leaves.append((with_sketches(leaf, slim) if level == 1 else leaf).select("path", "blocks", "set", "sketch"))
        if last:
            break
        if level == 1:
            large = space.write(with_sketches(large, slim), "large")
        leads = space.write(leads_of(large), f"leads-{level}")
        checked = tied_to_leads(large.join(leads, F.col("path") == F.col("_path")), least)
        checked = space.write(checked, f"checked-{level}")
        ties.append(checked.select(F.col("set").alias("a"), F.explode("ties").alias("b")))
        others = checked.where("label <> main")
        left = space.write(others.groupBy(F.col("path").alias("_path")).agg(F.count(F.lit(1)).alias("others")), f"left-{level}")
        few, many = (left.where(F.col("others") <= small).select("_path"), left.where(F.col("others") > small).select("_path"))
        known = space.write(listed(others.join(few, F.col("path") == F.col("_path")).drop("_path")), f"others-{level}")
        ties.append(space.write(compare_with_listed(checked.join(known, F.col("path") == F.col("_path")), least), f"met-{level}"))
        paths = space.write(next_paths(checked.join(many, F.col("path") == F.col("_path"))), f"paths-{level + 1}")
    all_leaves = leaves[0]
    for more in leaves[1:]:
        all_leaves = all_leaves.unionByName(more)
    out = compare_sketches(all_leaves, least)
    for more in ties:
        out = out.unionByName(more)
    out = space.write(out.distinct(), "meetings")
    space.drop("large")
    for k in range(1, level + 1):
        for name in ("sizes", "members", "leads", "checked", "left", "others", "met"):
            space.drop(f"{name}-{k}")
    return out


LINKS = "set long, links long, root long"


def exact_links(docs: DataFrame, sets: DataFrame, families: DataFrame, space: Workspace, block: int, block_shingles: int) -> DataFrame:
    """LINKS of the sets of families, from whole texts. A block has about block sets and block_shingles shingles at most, and
    a family that is a large share of all work has blocks enough for every task to get some of its pairs."""
    known = sets.select("set", "doc_id", "text_hash", "copies", "size")
    member = space.write(families.join(known, F.col("node") == F.col("set")).select("set", F.col("root").alias("family"), "doc_id", "text_hash", "copies", "size"), "member")
    sized = space.write(member.groupBy(F.col("family").alias("_family")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")), "sized")
    work = sized.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("w")).first().w or 1.0
    even = F.least(F.ceil(F.col("n") / 64), F.ceil(F.col("n") * math.sqrt(2 * tasks(docs) / work)))
    sized = sized.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles), even, F.lit(1)))
    mine = member.join(sized, F.col("family") == F.col("_family")).select("set", "family", "blocks", "copies", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
    # the texts are shuffled for this at every size: members are a share of the corpus, never a side to broadcast
    texts = docs.select("doc_id", "text").join(mine.hint("merge"), (F.xxhash64("text") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    spread = dealt(space.write(shingle_sets(texts), "shingles"), "family", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int]] = []
        for (_, low, high), rows in groups(batches, ["family", "low", "high"]):
            keep = [k for k, s in enumerate(rows["set"]) if k == 0 or s != rows["set"][k - 1]]  # a repeated row has one set
            if len(keep) > 1:
                number, copies, side, raw = ([rows[n][k] for k in keep] for n in ("set", "copies", "side", "shingles"))
                links, root = compare_block_pair([np.frombuffer(x, np.uint64) for x in raw], copies, side if low != high else None)
                held += [(s, n, number[r]) for s, n, r in zip(number, links.tolist(), root.tolist(), strict=True) if n]
            if len(held) > 20_000:
                yield as_batch(held)
                held = []
        if held:
            yield as_batch(held)

    def as_batch(held: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["set", "links", "root"])

    return spread.mapInArrow(run, LINKS)


def near_duplicates(
    docs: DataFrame, *, recall: float = 0.995, depth: int = 6, small: int = 64, least: float = 0.55, block: int = 512, block_shingles: int = 2_000_000, count_links: bool = True
) -> DataFrame:
    """row, doc_id, text_hash, class_root (a number of the class), class_id, n_links of each document, copies included.

    n_links needs every pair of a family to be compared. Without count_links it is null, and a family of n near copies is not: its sets
    meet a few leads and those outside its largest class only (families.joined), n / block sets of shuffled leads in all.

    recall is that of a pair at the threshold whose buckets are large down to the last depth; the fewer levels a pair's
    buckets need, the higher it is (recall_of)."""
    space = Workspace(docs.sparkSession, "paths")
    table = space.write(sketch_table(docs), "sketches")
    copies = table.where("digest is not null").groupBy(F.col("digest").alias("_digest")).agg(F.min("row").alias("set"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"))
    copies = space.write(copies, "copies")
    sets = table.join(copies.drop("low", "_digest"), F.col("row") == F.col("set")).select("set", "copies", "doc_id", "text_hash", "size", "sketch")
    sets = space.write(sets, "sets")
    met = meetings(sets.select("set", "sketch"), space, recall=recall, depth=depth, small=small, least=least, block=block)
    families = components(met, space, "families")
    if count_links:
        links = space.write(exact_links(docs, sets, families, space, block, block_shingles), "links")
        classes = components(links.select(F.col("set").alias("a"), F.col("root").alias("b")), space, "classes")
        linked = links.groupBy(F.col("set").alias("_set")).agg(F.sum("links").alias("links"))
    else:
        known = sets.select("set", "doc_id", "text_hash")
        classes = linked_classes(docs, known, families, space, above=ABOVE, below=BELOW, block=block, block_shingles=block_shingles)
        linked = sets.select(F.col("set").alias("_set"), F.lit(None).cast("long").alias("links"))
    for dead in ("sets", "meetings", "families", "member", "sized", "shingles") if count_links else ("meetings", "families"):
        space.drop(dead)
    classes = classes.withColumnRenamed("root", "class_root")
    known = copies.join(linked, F.col("set") == F.col("_set"), "left").drop("_set").join(classes, F.col("set") == F.col("node"), "left")
    known = known.select(
        "_digest", "low", F.coalesce("class_root", "set").alias("class_root"), (F.coalesce(F.col("links"), F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    known = space.write(known, "known-sets")
    lows = known.groupBy(F.col("class_root").alias("_root")).agg(F.min("low").alias("class_id"))
    known = space.write(known.join(lows, F.col("class_root") == F.col("_root")).drop("_root", "low"), "known")
    for dead in ("copies", "links", "classes", "known-sets"):
        space.drop(dead)
    out = table.drop("sketch").join(known, F.col("digest") == F.col("_digest"), "left")
    return out.select(
        "row", "doc_id", "text_hash", F.coalesce("class_root", "row").alias("class_root"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links") if count_links else F.lit(None).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one with its smallest doc_id. All columns stay."""
    space = Workspace(docs.sparkSession, "keep")
    rows = space.write(near_duplicates(docs, count_links=False, **options), "rows")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_root").agg(F.min("row").alias("__cl_row"))
    # rows alike in doc_id and text are all found by the key of the one that stays: they are made one below
    named = [F.col("doc_id").alias("__cl_doc"), F.col("text_hash").alias("__cl_hash")]
    times = space.write(rows.groupBy(*named).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "times")
    kept = rows.join(first.drop("class_root"), F.col("row") == F.col("__cl_row")).select(*named)
    several = times.select(F.col("__cl_doc").alias("d"), F.col("__cl_hash").alias("h"))
    kept = kept.join(several, (F.col("__cl_hash") == F.col("h")) & F.col("__cl_doc").eqNullSafe(F.col("d")), "left")
    kept = space.write(kept.select("__cl_doc", "__cl_hash", F.col("h").isNotNull().alias("__cl_several")), "kept")
    alike = (F.col("__cl_key") == F.col("__cl_hash")) & F.col("doc_id").eqNullSafe(F.col("__cl_doc"))
    # what stays is a share of the corpus: the texts are shuffled once, at every size
    left = docs.withColumn("__cl_key", F.xxhash64("text")).join(kept.hint("merge"), alike).drop("__cl_doc", "__cl_hash")
    once, more = left.where("not __cl_several"), left.where("__cl_several")
    return once.unionByName(more.dropDuplicates(["doc_id", "__cl_key"])).drop("__cl_key", "__cl_several")
