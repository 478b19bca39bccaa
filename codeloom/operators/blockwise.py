"""The best of many for each question, block by block: a block of rows meets the questions asked of it as arrays, and only its own best go on.

The pairs of questions and rows are never rows of a table. Spark deals the blocks; what is ranked at the end is a few rows for each question and block."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the matrix of questions and vectors that is held at once.
CELLS = 4_000_000
#: More than rounding can add to a distance that is found by products, relative to the squares that it is made of.
SLACK = 1e-9


def places(keys: pa.ChunkedArray) -> np.ndarray:
    """The place of each key in the order of keys, as Spark orders them (nulls first, texts by their bytes)."""
    out = np.empty(len(keys), np.int64)
    out[pc.sort_indices(keys, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(keys))
    return out


def matrix(lists: pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def first_places(cost: np.ndarray, place: np.ndarray, top: int) -> np.ndarray:
    """Positions of the smallest costs, ties by place."""
    return np.lexsort((place, cost))[:top]


def nearest_in(vectors: DataFrame, questions: DataFrame, by: list[str], top: int) -> DataFrame:
    """query, key, distance (squared): the nearest vectors (by, key, vector) in each block for the questions (by, query, q) asked of it,
    ties by key. All vectors of a block and its questions have the same length. Products say which may be near; their distances are
    summed as retrieval.squared_distance sums them."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        keys, place, found = block["key"], places(block["key"]) if len(block) else None, []
        if len(block) and len(asked):
            v, q = matrix(block["vector"]), matrix(asked["q"])
            with np.errstate(all="ignore"):
                size, asking = (v * v).sum(1), (q * q).sum(1)
                step = max(1, CELLS // len(v))
                for at in range(0, len(q), step):
                    part = q[at : at + step]
                    away = np.nan_to_num(size - 2 * (part @ v.T) + asking[at : at + step, None], nan=np.inf, posinf=np.inf)
                    some = min(top, len(v)) - 1
                    bar = np.partition(away, some, axis=1)[:, some] + SLACK * (size.max() + asking[at : at + step])
                    bar = np.nan_to_num(bar, nan=np.inf, posinf=np.inf)
                    for k in range(len(part)):
                        near = np.flatnonzero(away[k] <= bar[k])
                        squares, distance = (v[near] - part[k]) ** 2, np.zeros(len(near))
                        for column in squares.T:
                            distance += column
                        best = first_places(distance, place[near], top)
                        found.append((np.full(len(best), at + k), near[best], distance[best]))
        query, row, distance = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query": asked["query"].take(pa.array(query)), "key": keys.take(pa.array(row)), "distance": pa.array(distance)})

    schema = f"query {questions.schema['query'].dataType.simpleString()}, key {vectors.schema['key'].dataType.simpleString()}, distance double"
    return vectors.groupBy(*by).cogroup(questions.groupBy(*by)).applyInArrow(run, schema)


def heaviest(
    queries: pa.ChunkedArray, slices: Callable[[int], Iterable[tuple[int, int]]], idf: np.ndarray, documents: np.ndarray, weight: np.ndarray, place: np.ndarray, top: int
) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(row, document, score) of the documents of largest sums for each of queries, whose rows stand together: a row k weighs its idf in the
    slices of documents and weight that its term has. Sums are compared at nine digits, ties by place."""
    sums, found = np.zeros(len(place)), []
    encoded = pc.dictionary_encode(queries, null_encoding="encode").combine_chunks()
    encoded = encoded.chunk(0) if isinstance(encoded, pa.ChunkedArray) else encoded
    code = encoded.indices.to_numpy(zero_copy_only=False)
    bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1)) if len(code) else []
    for first, last in zip(bounds, bounds[1:], strict=False):
        sums[:] = 0
        for k in range(first, last):
            for start, end in slices(k):
                sums[documents[start:end]] += idf[k] * weight[start:end]
        digits = np.floor(sums * 1e9 + 0.5)
        some = min(top, len(digits))
        bar = max(1.0, np.partition(digits, len(digits) - some)[len(digits) - some]) if some else 1.0
        near = np.flatnonzero(digits >= bar)
        best = near[first_places(-digits[near], place[near], top)]
        found.append((np.full(len(best), first), best, sums[best]))
    row, document, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.array(row), pa.array(document), pa.array(score)


def heaviest_in(postings: DataFrame, questions: DataFrame, by: str, top: int) -> DataFrame:
    """query, key, score: the keys of largest sums of idf times weight in each block, from its postings (by, term, postings of key and
    weight) and the questions (by, query, term, idf); sums are compared at nine digits, ties by key."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by([("query", "ascending"), ("term", "ascending")])
        lists = pa.concat_arrays(block["postings"].chunks) if block["postings"].num_chunks else pa.array([], block["postings"].type)
        flat = lists.flatten()
        keys = pc.dictionary_encode(flat.field("key"), null_encoding="encode")
        documents, weight = keys.indices.to_numpy(zero_copy_only=False), flat.field("weight").to_numpy(zero_copy_only=False)
        place = places(pa.chunked_array([keys.dictionary]))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        held: dict[str, list[tuple[int, int]]] = {}
        for term, end, start in zip(block["term"].to_pylist(), ends, [0, *ends], strict=False):
            held.setdefault(term, []).append((start, end))
        terms = asked["term"].to_pylist()
        row, document, score = heaviest(asked["query"], lambda k: held.get(terms[k], ()), asked["idf"].to_numpy(), documents, weight, place, top)
        return pa.table({"query": asked["query"].take(row), "key": keys.dictionary.take(document), "score": score})

    key = postings.schema["postings"].dataType.elementType["key"].dataType.simpleString()
    schema = f"query {questions.schema['query'].dataType.simpleString()}, key {key}, score double"
    return postings.groupBy(by).cogroup(questions.groupBy(by)).applyInArrow(run, schema)
