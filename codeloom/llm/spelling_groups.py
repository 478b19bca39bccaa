"""Spelling variants of the words of a corpus, grouped without pairs.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of
largest count if that is at least twice its own; following forms leads to its root. No pair of near words is ever a row. Words
are numbered in the order of their code points, and only numbers and counts move:

1. Replacements: a word is in one group for each of its positions, that of the words with the same prefix and suffix around it.
   Words of a group are near each other, and two words share one group at most. A group says its size, which less one is the
   number of near words, and its top two words; a member takes the first that is not itself.
2. Indels: a word's deletions, each once, join the vocabulary on their key. The word found takes the number and the top one of
   those that it is a deletion of; they take it as near word.
3. What a word's groups and deletions said is combined by a sum and a maximum.
4. Roots: forms have ever larger counts, so there are no circles; each round doubles the steps that a pointer makes.

Groups are keyed by 128-bit sums over (position, code point), in which leaving a position out or shifting what follows it is a
subtraction: a word of n code points has n keys in O(n) time and space, however long it is. Two different strings share a key with
a probability of 2**-128. A group has no more words than the alphabet has letters, whatever the corpus.

Defined results: null and empty texts have no words; a null doc_id is the empty text in the hash that chooses letters to drop;
rows that share a doc_id are texts of their own, and repeated rows count as often as they are there; very long texts and words are
taken whole; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.common import Workspace

RUN = "[A-Za-zÀ-ÿ]+"
#: A letter is dropped from runs whose hash this divides.
DROP = 97
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Code points whose keys are made at once; a longer word is taken by itself.
AT_ONCE = 1 << 18

KEYS = "k1 long, k2 long"


def word_counts(docs: DataFrame, *, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lowered, with one letter dropped where the hash of doc_id and run says so;
    words of at least shortest code points that occur least times or more in all."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("r"))
    # in a run without letters above 127 lower() changes A-Z alone, and it is much faster
    lowered = F.when(F.octet_length("r") == F.char_length("r"), F.lower("r")).otherwise(F.translate("r", upper, upper.lower()))
    # one row more for each run, so that it is made once: expressions are copied into every use otherwise
    hashed = runs.select("d", F.explode(F.array(lowered)).alias("r")).select("r", F.crc32(F.concat_ws(":", "d", "r").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("r").cast("long")).cast("int")
    word = F.when(F.pmod("h", F.lit(DROP)) == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))).otherwise(F.col("r"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits that look independent of those of x (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(points: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a code point adds to the two halves of a key at a place; place -1 is none, and adds what nobody uses."""
    x = points.astype(np.uint64) * A + place.astype(np.uint64) * B
    return mixed(x), mixed(x ^ np.uint64(0xD6E8FEB86659FD93))


def keys_of(words: list[str]) -> dict[str, np.ndarray]:
    """For the code points of words one after another: word (index of theirs), place, whole (key of the word), without (key of the
    word with a wildcard at the place), deleted (key of the word without the place) and first (whether the code point differs
    from that before, so that each deletion is there once)."""
    size = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - start[word]
    out = {"word": word, "place": place}
    for half, (own, shifted) in enumerate(zip(weights(points, place), weights(points, place - 1), strict=True), 1):
        sums = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        up, up_shifted = sums(own), sums(shifted)
        end = start + size
        whole = up[end] - up[start]
        out[f"whole{half}"], out[f"without{half}"] = whole, whole[word] - own
        at = np.arange(len(points))
        out[f"deleted{half}"] = up[at] - up[start[word]] + up_shifted[end[word]] - up_shifted[at + 1]
    before = np.concatenate([np.zeros(1, np.uint32), points])[:-1] if len(points) else points
    out["first"] = (place == 0) | (points != before)
    return out


def numbered(words: DataFrame) -> DataFrame:
    """words (word, n) with num, whose order is that of the words by code points."""
    return words.orderBy("word").withColumn("num", F.monotonically_increasing_id())


def keyed(words: DataFrame) -> DataFrame:
    """kind, length, place, k1, k2, num, n of words (word, n, num): itself (kind 0, length and key its own, no place), its deletions
    (kind 1, with the length and key of what is left) and its wildcards (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts, numbers = batch.column(0).to_pylist(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            ends = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE)))
                yield rows(words[at:stop], counts[at:stop], numbers[at:stop])
                at = stop

    def rows(words: list[str], counts: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        found, size = keys_of(words), np.array([len(w) for w in words])
        word, once = found["word"], np.flatnonzero(found["first"])
        parts = (np.arange(len(words)), word[once], word)
        of = np.concatenate(parts)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(x) for x in parts])
        place = np.concatenate([np.full(len(words) + len(once), -1), found["place"]])
        halves = [np.concatenate([found[f"whole{h}"], found[f"deleted{h}"][once], found[f"without{h}"]]).view(np.int64) for h in (1, 2)]
        columns = [kind, (size[of] - (kind == 1)).astype(np.int32), place.astype(np.int32), *halves, numbers[of], counts[of]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "length", "place", "k1", "k2", "num", "n"])

    return words.select("word", "n", "num").mapInArrow(run, f"kind int, length int, place int, {KEYS}, num long, n long")


GROUP = ["length", "place", "k1", "k2"]


def best(n: Column, num: Column) -> Column:
    """A struct whose smallest value is that of the largest n, ties by the smallest word."""
    return F.struct((-n).alias("m"), num.alias("num"))


def replacements(rows: DataFrame) -> DataFrame:
    """num, near, best for members of wildcard groups of two or more: what their group's size and top two words say."""
    ordered = Window.partitionBy(*GROUP).orderBy(F.desc("n"), "num")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = lambda k: best(F.nth_value("n", k).over(whole), F.nth_value("num", k).over(whole))
    seen = rows.where("kind = 2").select("num", F.count(F.lit(1)).over(whole).alias("size"), top(1).alias("one"), top(2).alias("two")).where("size > 1")
    other = F.when(F.col("one.num") == F.col("num"), F.col("two")).otherwise(F.col("one"))
    return seen.select("num", (F.col("size") - 1).alias("near"), other.alias("best"))


def indels(rows: DataFrame) -> DataFrame:
    """num, near, best for words and their deletions that are words."""
    of_key = Window.partitionBy("length", "k1", "k2")
    word = F.min(F.when(F.col("kind") == 0, best(F.col("n"), F.col("num")))).over(of_key)
    longer = F.min(F.when(F.col("kind") == 1, best(F.col("n"), F.col("num")))).over(of_key)
    seen = rows.where("kind < 2").select("kind", "num", word.alias("own"), F.count_if(F.col("kind") == 1).over(of_key).alias("deletions"), longer.alias("longer"))
    seen = seen.where("own is not null and deletions > 0")
    is_word = F.col("kind") == 0
    return seen.select("num", F.when(is_word, F.col("deletions")).otherwise(F.lit(1)).alias("near"), F.when(is_word, F.col("longer")).otherwise(F.col("own")).alias("best"))


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """num, root of forms (num, form): the last one that following forms comes to."""
    now = space.write(forms.select("num", F.col("form").alias("root")), "roots-0")
    for k in itertools.count(1):
        further = now.select(F.col("num").alias("_n"), F.col("root").alias("_r"))
        step = now.join(further, F.col("root") == F.col("_n"), "left")
        step = space.write(step.select("num", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), f"roots-{k}")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """word, n, form, form_n, root, n_near of the words of docs (doc_id, text)."""
    space = Workspace(docs.sparkSession, "spelling")
    words = space.write(numbered(space.write(word_counts(docs, shortest=shortest, least=least), "counts")), "words")
    rows = space.write(keyed(words), "keys")
    said = replacements(rows).unionByName(indels(rows)).groupBy(F.col("num").alias("_num"))
    said = said.agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    known = words.join(said, F.col("num") == F.col("_num"), "left").drop("_num")
    large = F.when(-F.col("best.m") >= times * F.col("n"), F.col("best"))
    known = known.select("num", "word", "n", large["num"].alias("form"), (-large["m"]).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    known = space.write(known, "known")
    for dead in ("keys", "counts"):
        space.drop(dead)
    ends = roots(known.where("form is not null").select("num", "form"), space)
    named = lambda name: words.select(F.col("num").alias(f"_{name}"), F.col("word").alias(f"{name}_word"))
    ends = ends.join(known.select(F.col("num").alias("_num"), "form"), F.col("num") == F.col("_num"))
    ends = ends.join(named("form"), F.col("form") == F.col("_form")).join(named("root"), F.col("root") == F.col("_root"))
    out = known.drop("form").join(ends.select("_num", "form_word", "root_word"), F.col("num") == F.col("_num"), "left")
    return out.select("word", "n", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"), "n_near")
