"""Operator 12: spelling variants against a brute-force version over all pairs of words; odd rows; long words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from codeloom.llm import spelling_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_words(docs, shortest=5, least=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def plain_variants(docs, shortest=5, least=3, times=2):
    n = plain_words(docs, shortest, least)
    near = {w: [v for v in n if plain_near(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], form.get(w), n[form[w]] if w in form else None, root, len(near[w])))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "n", "form", "form_n", "root", "n_near").collect()), key=repr)


def test_variants_equal_all_pairs(spark, make):
    """Small alphabets give many ties, doubled letters, long chains of forms, and words with near ones of all three kinds."""
    rng, docs = random.Random(12), []
    for alphabet, top in (("ab", 9), ("aéÿ", 7), ("abcdefgh", 6)):
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3, top))) for _ in range(160)]
        for k in range(40):
            docs.append((k, " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(120))))
    got = found(spelling_groups.variants(make(docs)))
    assert got == plain_variants(docs)
    assert any(f and r != f for _, _, f, _, r, _ in got) and any(k > 5 for *_, k in got)


def test_odd_rows(spark, odd, odd_plain, none):
    docs = [(r.doc_id, r.text) for r in odd_plain.collect()]
    for least in (1, 3):
        assert found(spelling_groups.variants(odd, least=least)) == found(spelling_groups.variants(odd_plain, least=least)) == plain_variants(docs, least=least)
    assert spelling_groups.variants(none).count() == 0
    assert spelling_groups.variants(odd.where("text is null")).count() == 0


def test_upper_case_and_dropped_letters(make):
    """Only A-Z are lowered; other scripts end a run; the hash drops letters here and there."""
    docs = [(k, f"ÀÉabcDEF àéabcdef x{'W' * (k % 7 + 3)} naïve-Straße漢wörter_ÜBER×÷") for k in range(300)]
    assert spelling_groups.word_counts(make(docs)).count() == len(plain_words(docs))
    assert found(spelling_groups.variants(make(docs))) == plain_variants(docs)
    assert any("ÀÉabcdef" != w and w.startswith("ÀÉ") for w in plain_words(docs, least=1))


def test_long_words_take_linear_space(make):
    """Words of 200,000 letters: keys, not strings, move."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    docs = [(k, f"{base} {base} {base} {base} {base} {base} {base[:777]}Q{base[778:]} {base[:150_000]}{base[150_001:]}") for k in range(3)]
    got = {len(w): (n, form == base, near) for w, n, form, _, _, near in found(spelling_groups.variants(make(docs))) if "q" not in w}
    assert got == {200_000: (18, False, 2), 199_999: (3, True, 1)}


def test_keys():
    """Keys agree exactly where strings do."""
    words = ["aabbc", "abbc", "aabc", "aabbd", "xabbc", "ÿabbc", "aaaaa", "aaaa"]
    k = spelling_groups.keys_of(words)
    whole, wild = {}, {}
    for w, a, b in zip(words, k["whole1"].tolist(), k["whole2"].tolist(), strict=True):
        whole[a, b] = w
    for at, (i, p) in enumerate(zip(k["word"].tolist(), k["place"].tolist(), strict=True)):
        w = words[i]
        less = w[:p] + w[p + 1 :]
        assert whole.get((int(k["deleted1"][at]), int(k["deleted2"][at]))) == (less if less in words else None)
        wild.setdefault((len(w), p, int(k["without1"][at]), int(k["without2"][at])), set()).add(w[:p] + "?" + w[p + 1 :])
        assert bool(k["first"][at]) == (p == 0 or w[p] != w[p - 1])
    assert all(len(s) == 1 for s in wild.values()) and len(wild) == len({(w[:p], w[p + 1 :], len(w)) for w in words for p in range(len(w))})
    assert len(np.unique(k["whole1"])) == len(words)
