"""Near duplicates by MinHash: many universal hash minima, banding, signature verification, exact checks, connected components.

A text is the set of its runs of five words, A-Z lowered (a text of fewer words, but not none, is one run); texts whose sets have
a Jaccard similarity of 17/20 or more are linked. Steps:

1. Signatures: for each of 130 functions x -> a * x + b of the 64-bit hashes of a set, the smallest value. Two sets agree at a place
   with the probability of their similarity. Equal sets are linked; one of them stands for all from here on.
2. Bands: places are taken five at a time. Sets that agree in a whole band share a bucket; a pair at the threshold shares none with a
   probability of (1 - 0.85^5)^26 = 2.4e-7. Buckets of the same sets, as copies with few changes have them in most bands, count once.
3. Verification: in a bucket, signatures that agree in fewer places than least belong to different texts (a pair at the threshold
   is six standard deviations above). Small buckets are compared whole. In a large one all sets are compared with a few leads
   first, and then with those that agree with no lead of the largest group, so that a hot bucket costs what its rows cost.
4. What agrees forms families, in which links are confirmed on the full sets of whole texts, block by block (families.joined).
5. Components of the exact links, by alternating large-star and small-star steps; those are the classes.

A link is lost only if no chain of bands and signatures joins its two sets. Pairs are never expanded: tasks return edges that
join what is linked, as many as sets at most.

Defined results: null and wordless texts have an empty set and are linked with nothing; a text of fewer than five words is linked
with the same words only; component_id is the smallest doc_id of the component, nulls aside, and null if all are null; kept is
whether doc_id is component_id, so that rows that share that doc_id are kept together; ties and repeated rows are equal sets; very
long texts are hashed piece by piece and compared whole; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.chosen_path import compare_sketches, compare_with_listed, leads_of, listed, sketches_of, tied_to_leads
from codeloom.llm.common import Workspace, text_parts
from codeloom.llm.components import components
from codeloom.llm.families import linked_classes
from codeloom.llm.shingles import ODD, mix, shingle_hashes

BANDS, ROWS = 26, 5
PLACES = BANDS * ROWS
#: Similarity as a fraction: links have common * below >= above * union.
ABOVE, BELOW = 17, 20
_rng = np.random.default_rng(20240517)
FACTORS, TERMS = _rng.integers(1, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1), _rng.integers(0, 2**63, PLACES, np.uint64)
#: bytes -> bytes: A-Z lowered, ASCII white space made a space: words are runs [^\x20\x09-\x0D]+.
SPACE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def minima(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of PLACES values (uint32) per text that has shingles: which smallest value it is, not how small."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), PLACES), np.uint32)
    for k in range(PLACES):
        out[:, k] = mix(np.minimum.reduceat(hashes * FACTORS[k] + TERMS[k], starts)) >> np.uint64(32) if len(starts) else 0
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, digest, size (shingles) and sketch (null without words) of each document. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at, stop in text_parts(texts):
                hashes, counts = shingle_hashes(texts[at:stop], SPACE_BYTES)
                found, ends = iter(minima(hashes, counts)), np.cumsum(counts)
                digests, sizes, sketches = [], [], []
                for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    distinct = np.unique(hashes[end - n : end])
                    sizes.append(len(distinct))
                    digests.append(blake2b(distinct.tobytes(), digest_size=16).digest() if n else None)
                    sketches.append(next(found).tobytes() if n else None)
                rows = batch.slice(at, stop - at)
                columns = [rows.column(0), rows.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "digest", "size", "sketch"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, digest binary, size long, sketch binary").withColumn("row", F.monotonically_increasing_id())


def band_keys(sets: DataFrame) -> DataFrame:
    """path (band and its values), set: a row for each band of sets (set, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = sketches_of(batch.column("sketch")).astype(np.uint64).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2])
                for k in range(ROWS):
                    key = mix(key * ODD + values[:, :, k])
                own = np.repeat(batch.column("set").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(own)], ["path", "set"])

    return sets.select("set", "sketch").mapInArrow(run, "path long, set long")


def agreements(sets: DataFrame, space: Workspace, *, small: int, least: float, block: int) -> DataFrame:
    """(a, b), written: edges over sets (set, sketch) that share a bucket and agree, enough to connect what agrees."""
    paths = space.write(band_keys(sets), "bands")
    mixed = F.xxhash64("set")
    same = [F.count(F.lit(1)).alias("n"), F.min("set").alias("lo"), F.max("set").alias("hi"), F.bit_xor(mixed).alias("x"), F.sum(mixed % 2**40).alias("s")]
    buckets = paths.groupBy(F.col("path").alias("_path")).agg(*same).where("n > 1")
    once = space.write(buckets.groupBy("n", "lo", "hi", "x", "s").agg(F.min("_path").alias("_path")).select("_path", "n"), "buckets")
    slim = sets.select(F.col("set").alias("_set"), "sketch")
    members = paths.join(once, F.col("path") == F.col("_path")).drop("_path")
    members = space.write(members.join(slim, F.col("set") == F.col("_set")).select("path", "set", F.col("set").alias("label"), "sketch", "n"), "in-buckets")
    space.drop("bands")
    large = members.where(F.col("n") > small)
    whole = members.where(F.col("n") <= small).withColumn("blocks", F.lit(1)).select("path", "blocks", "set", "sketch")
    ties = None
    if not large.isEmpty():
        leads = space.write(leads_of(large), "bucket-leads")
        checked = space.write(tied_to_leads(large.join(leads, F.col("path") == F.col("_path")), least), "checked")
        others = checked.where("label <> main")
        left = space.write(others.groupBy(F.col("path").alias("_path")).agg(F.count(F.lit(1)).alias("others")), "left")
        few, many = left.where(F.col("others") <= small).select("_path"), left.where(F.col("others") > small).select("_path")
        known = space.write(listed(others.join(few, F.col("path") == F.col("_path")).drop("_path")), "others")
        met = compare_with_listed(checked.join(known, F.col("path") == F.col("_path")), least)
        ties = checked.select(F.col("set").alias("a"), F.explode("ties").alias("b")).unionByName(space.write(met, "met"))
        rest = large.join(many, F.col("path") == F.col("_path")).withColumn("blocks", F.ceil(F.col("n") / block))
        whole = whole.unionByName(rest.select("path", "blocks", "set", "sketch"))
    edges = compare_sketches(whole, least)
    out = space.write((edges if ties is None else edges.unionByName(ties)).distinct(), "agreements")
    for dead in ("buckets", "in-buckets", "bucket-leads", "checked", "left", "others", "met"):
        space.drop(dead)
    return out


def components_of(docs: DataFrame, *, small: int = 256, least: float = 0.65, block: int = 512, block_shingles: int = 2_000_000) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, class_root (a number of the component) and component_id of each document."""
    space = Workspace(docs.sparkSession, "minhash")
    table = space.write(signatures(docs), "signatures")
    copies = table.where("digest is not null").groupBy(F.col("digest").alias("_digest")).agg(F.min("row").alias("set"), F.min("doc_id").alias("low"))
    copies = space.write(copies, "copies")
    sets = space.write(table.join(copies.select("set"), F.col("row") == F.col("set")).select("set", "doc_id", "text_hash", "sketch"), "sets")
    families = components(agreements(sets.select("set", "sketch"), space, small=small, least=least, block=block), space, "families")
    classes = linked_classes(docs, sets.drop("sketch"), families, space, above=ABOVE, below=BELOW, block=block, block_shingles=block_shingles, bytes_to=SPACE_BYTES)
    classes = classes.withColumnRenamed("root", "class_root")
    known = copies.join(classes, F.col("set") == F.col("node"), "left").select("_digest", "low", F.coalesce("class_root", "set").alias("class_root"))
    known = space.write(known, "known-sets")
    lows = known.groupBy(F.col("class_root").alias("_root")).agg(F.min("low").alias("component_id"))
    known = space.write(known.join(lows, F.col("class_root") == F.col("_root")).select("_digest", "class_root", "component_id"), "known")
    for dead in ("copies", "sets", "agreements", "families", "classes", "known-sets"):
        space.drop(dead)
    out = table.drop("sketch").join(known, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", "text_hash", F.col("size").alias("n_shingles"), F.coalesce("class_root", "row").alias("class_root"), component.alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document of docs (doc_id, text)."""
    return components_of(docs, **options).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
