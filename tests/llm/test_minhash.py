"""Operator 13: MinHash near duplicates against brute force; hot families; leads; odd rows."""

import random
import re

import numpy as np
import pytest

from codeloom.llm import minhash
from codeloom.llm.common import Workspace
from codeloom.llm.families import joined
from codeloom.llm.shingles import shingle_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    sets, root = [plain_set(t) for _, t in docs], [*range(len(docs))]

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(k)] = min(doc_id, least.get(top(k), doc_id))
    return sorted(((d, len(s), least.get(top(k)), d == least.get(top(k))) for k, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    return words


def families_of(rng, n, size, times):
    """n families of texts around a base, of which copies are linked, chained, or just not."""
    docs = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 60, 200]))]
        for _ in range(size):
            docs.append(" ".join(changed(rng, base, rng.randrange(times + 1)) if len(base) > 5 else base))
    rng.shuffle(docs)
    return [(k, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize(("small", "block", "block_shingles"), [(256, 512, 2_000_000), (2, 3, 10_000), (4, 5, 500)])
def test_components_equal_brute_force(make, small, block, block_shingles):
    docs = families_of(random.Random(small), 12, 14, 3)
    got = found(minhash.near_duplicates(make(docs), small=small, block=block, block_shingles=block_shingles))
    assert got == plain_components(docs)
    assert 12 < len({c for _, _, c, _ in got}) < len(docs)


def test_hot_passage_and_hot_family(make):
    """Texts that share a long passage but are no copies stay apart; a family of 300 near copies is one component."""
    rng = random.Random(9)
    passage, base = [f"p{k}" for k in range(150)], [f"b{k}" for k in range(120)]
    docs = [(k, " ".join(passage + [f"u{k}-{j}" for j in range(rng.randrange(30, 60))])) for k in range(150)]
    docs += [(1000 + k, " ".join(changed(rng, base, 1))) for k in range(300)]
    docs += [(5000 + k, " ".join(base)) for k in range(200)]
    for options in ({}, {"small": 16, "block": 32}):
        assert found(minhash.near_duplicates(make(docs), **options)) == plain_components(docs)


def test_links_outside_the_largest_component(spark):
    """Blocks of three; a chain and a pair, beside a star, are found wherever their sets are dealt."""
    star, chain, pair = [list(range(100))] * 9, [[*range(200 + 5 * k, 300 + 5 * k)] for k in range(8)], [[*range(900, 1000)], [*range(905, 1005)]]
    sets = [(k, np.array(sorted({*x, 2000 + k}), np.uint64)) for k, x in enumerate(star + chain + pair)]
    df = spark.createDataFrame([(1, k, x.tobytes()) for k, x in sets], "family long, set long, shingles binary")
    edges = joined(df, Workspace(spark, "test"), block=3, block_shingles=10**6, above=17, below=20)
    root = {k: k for k, _ in sets}
    for a, b in sorted((max(r), min(r)) for r in edges.collect()):
        old, new = root[a], root[b]
        root = {k: new if v == old else v for k, v in root.items()}
    groups = sorted(sorted(k for k in root if root[k] == g) for g in set(root.values()))
    assert groups == [[*range(9)], [*range(9, 17)], [17, 18]]


def test_minima_agree_as_sets_do():
    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    b = a[:3000] + [f"v{k}" for k in range(1000)]
    hashes, counts = shingle_hashes([" ".join(a), " ".join(b), None, "x"], minhash.SPACE_BYTES)
    assert counts.tolist() == [3996, 3996, 0, 1]
    x, y, _ = minhash.minima(hashes, counts)
    assert abs((x == y).mean() - 2996 / 4996) < 0.15
    assert [len(plain_set(" ".join(a))), len(plain_set("A\x0bb\x1fc d É"))] == [3996, 1]


def test_odd_rows(odd, odd_plain, none, make):
    docs = [(r.doc_id, r.text) for r in odd_plain.collect()]
    got = found(minhash.near_duplicates(odd))
    assert got == found(minhash.near_duplicates(odd_plain))
    want = plain_components(docs)
    assert [r[:3] for r in got] == [(d, n, d if n == 0 else c) for d, n, c, _ in want]
    assert all(k == (d == c) for d, _, c, k in got)
    assert minhash.near_duplicates(none).count() == 0
    rows = [(None, "only nulls share this text of words"), (None, "only nulls share this text of words"), (3, "a b"), (2, "A\tB"), (1, "a b c")]
    assert found(minhash.near_duplicates(make(rows))) == sorted([(None, 3, None, True)] * 2 + [(3, 1, 2, False), (2, 1, 2, True), (1, 1, 1, True)], key=repr)


def test_long_texts(make):
    """Texts of megabytes are compared whole."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:160_000])), (4, " ".join(words[100_000:]))]
    got = found(minhash.near_duplicates(make(docs), block_shingles=100_000))
    assert [r[2] for r in got] == [1, 1, 1 if 159_996 / 189_996 >= 0.85 else 3, 4]
