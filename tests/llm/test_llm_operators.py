"""The operators on odd rows, empty tables, clashing columns, and against brute force."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from codeloom.llm import bitplanes, chosen_path, components, curriculum, gam_classifier, license_scan, line_frequency, phrase_index, queries, site_spread, unit_dedup, warc
from codeloom.llm.common import Workspace, lower_words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(WORD, lower)


def random_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_words():
    for text in (None, "", "a-B c_d éÀ½ 漢 x\x7fy\x80z 9a", "\x00\x1f~"):
        assert [w.decode() for w in lower_words(text)] == plain_words(text)


# 1. bit planes


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2**32), (1000, 300), (70_001, 50_000), (64, 1)):
        ids = rng.integers(0, top, n, np.uint64).astype(np.uint32)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, bits), n) == ids).all()


def test_shard_round_trip(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(k if k % 5 else None, rng.integers(0, 49_408, n).astype(np.uint32)) for k, n in enumerate([0, 3, 700, 64, 1, 0, 5000, 63])]
    writer = bitplanes.ShardWriter(f"{tmp_path}/a/s.planes", 64, True, 3)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = bitplanes.ShardReader(f"{tmp_path}/a/s.planes")
    assert [(d, i.tolist()) for d, _, i in reader.documents()] == [(d, i.tolist()) for d, i in docs]
    flat = np.concatenate([i for _, i in docs])
    for a, b in ((0, 0), (0, 1), (63, 65), (100, 3000), (len(flat) - 1, len(flat))):
        assert (reader.ids(a, b) == flat[a:b]).all()
    (tmp_path / "a/s.planes").write_bytes((tmp_path / "a/s.planes").read_bytes()[:-5])
    with pytest.raises(ValueError, match="no complete shard"):
        bitplanes.ShardReader(f"{tmp_path}/a/s.planes")


def test_encoder_equals_the_library():
    rng = random.Random(3)
    encoder = bitplanes.WordEncoder(queries.tokenizer_path(), keep=500)
    letters = ["ab'stremvldXY \"!1½Éé\n", "aZ 'sΣσςİßœŐ́  \x85\x1c漢🙂,.<|endoftext|>", "\x00\x7f\xad a"]
    for some in letters:
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>"]) for _ in range(800)]
        wanted = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == wanted
    assert encoder.encode([None, ""]) == [b"", b""]


def test_pieces_of_one_hash_are_told_apart():
    """With a hash that only sees lengths nearly every piece meets another one; ids are the library's all the same."""
    encoder = bitplanes.WordEncoder(queries.tokenizer_path(), keep=500)
    encoder.salt[:] = 3
    texts = ["some words of the same length", "more text that meets them", "it's 12 of them"]
    assert encoder.encode(texts) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    rng = random.Random(41)
    encoder = bitplanes.WordEncoder(queries.tokenizer_path())
    for word in ("plain's", "漢字", "Ünï"):
        text = " ".join(word + "x" * rng.randint(0, 5) + rng.choice(["", ".\n", "\t!"]) for _ in range(150_000)) + " " + "y" * 600_000 + " end"
        assert len([*bitplanes.chunks_of(text)]) > 1 and "".join(bitplanes.chunks_of(text)) == text
        assert encoder.encode([text, "a b"]) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, "a b")]


def plain_tokens(docs):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = queries.op1_bitplane_tokens(spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == plain_tokens([tuple(r) for r in docs])


def test_tokens_of_odd_rows(odd, none):
    got = bitplanes.tokens_to_shards(odd, queries.tokenizer_path(), block_ids=100, shard_ids=1000).drop("shard").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 5, 6, 7]
    assert {(r.n_tokens, r.ids_crc32) for r in got} == {r[2:] for r in plain_tokens([(x.doc_id, x.text) for x in odd.collect()])}
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert bitplanes.tokens_to_shards(none, queries.tokenizer_path()).count() == 0


# 2. units


def test_repeated_spans(make):
    rng = random.Random(4)
    passage = ". ".join(" ".join(random_words(rng, 12, 10**6)) for _ in range(6)) + "."
    texts = {k: ". ".join(" ".join(random_words(rng, 11, 10**6)) for _ in range(5)) + "." for k in range(6)}
    given = {0: texts[0], 1: f"{texts[1]} {passage} {texts[2]}", 2: f"{passage}\n{texts[3]}", 3: f"Title. {texts[4]}\n{passage.upper()}", 4: texts[5]}
    lines = {r.doc_id: (r.n_words, r.n_units, r.first_doc_id) for r in unit_dedup.repeated_spans(make([*given.items()])).collect()}
    assert lines == {2: (72, 0, 1), 3: (72, 1, 2)}  # the windows of 2 stand in 1; the line of 3 is the line of 2
    got = {r.doc_id: r for r in unit_dedup.repeated_spans(make([*given.items()]), unit="sentence").collect()}
    assert {k: (r.n_words, r.first_doc_id) for k, r in got.items()} == {2: (72, 1), 3: (72, 1)}
    assert all(plain_words(given[k][r.start : r.stop]) == plain_words(passage) for k, r in got.items())
    cut = {r.doc_id: r for r in unit_dedup.remove_repeats(make([*given.items()]), unit="sentence").collect()}
    assert cut[2].text.strip() == texts[3] and [tuple(s) for s in cut[2].kept] == [(got[2].stop, len(given[2]))]
    assert cut[1].text == given[1] and cut[1].kept is None


def test_units_of_odd_rows(odd, odd_plain, none):
    assert unit_dedup.repeated_spans(odd).collect() == unit_dedup.repeated_spans(odd_plain).collect()
    assert unit_dedup.repeated_spans(odd).where("doc_id = 1").count() == 1  # of two equal rows one keeps
    assert unit_dedup.repeated_spans(none).count() == 0
    cut = unit_dedup.remove_repeats(odd)
    assert cut.columns == [*odd.columns, "kept"] and sorted(r.text for r in cut.where("doc_id = 1").collect()) == ["", "one two three four five six seven"]
    clash = unit_dedup.remove_repeats(odd.withColumnRenamed("n_chars", "Kept"))
    assert clash.columns[-1] == "kept_" and "Kept" in clash.columns and clash.count() == odd.count()


def test_equal_ranks_keep_one(make):
    """Rows without a doc_id, rows that share one, and the largest one there is."""
    rows = [(None, "a line of five words")] * 3 + [(2**63 - 1, "a line of five words"), (4, "Another line, of five words!\nx"), (4, "another line of five words")]
    got = unit_dedup.repeated_spans(make(rows)).collect()
    assert len(got) == 4 and sum(r.doc_id == 4 for r in got) == 1 and {r.first_doc_id for r in got if r.doc_id != 4} == {2**63 - 1}


def test_every_repeated_line_goes(make):
    rng = random.Random(21)
    lines = [" ".join(random_words(rng, n)) for n in (1, 2, 5, 9, 30, 60)]
    docs = [(k, "\n".join(rng.choice(["  {}.", "{}", "(({}))"]).format(rng.choice(lines)) + "\n" * rng.randint(0, 2) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    spans, seen = {}, set()
    for r in unit_dedup.repeated_spans(make(docs)).collect():
        spans.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        at, gone = 0, set()
        for line in text.split("\n"):
            words = plain_words(line)
            gone |= set(range(at, at + len(words))) if tuple(words) in seen else set()
            seen |= {tuple(words)} if words else set()
            at += len(words)
        assert gone == covered(spans.get(doc_id, []), text)


def test_long_texts_of_units(make):
    """Some 20 MB of text a row: offsets hold, and the passage is found behind them."""
    rng = random.Random(22)
    filler = " ".join(f"é{k}" for k in range(2_000_000))
    passage = " ".join(random_words(rng, 60, 10**6))
    got = unit_dedup.repeated_spans(make([(1, passage), (2, f"{filler} {passage} end")])).collect()
    assert [(r.doc_id, r.start, r.stop, r.n_words) for r in got] == [(2, len(filler) + 1, len(filler) + 1 + len(passage), 60)]


@pytest.mark.parametrize("kind", ["line", "paragraph", "sentence"])
def test_units_cover_words(kind):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab .!\n") for _ in range(40))
        units = unit_dedup.units_of(text, kind)
        assert sum(u[4] for u in units) == len(plain_words(text)) if kind != "sentence" else all(plain_words(text[u[2] : u[3]]) for u in units)
        assert all(a[3] <= b[2] for a, b in zip(units, units[1:], strict=False))


def passages(docs, size=50):
    """(doc_id, words) of maximal runs of words inside windows that stand in an earlier document, by brute force."""
    seen, out = set(), []
    for doc_id, text in docs:
        words = plain_words(text)
        windows = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
        inside = sorted({j for k, w in enumerate(windows) if w in seen for j in range(k, k + size)})
        seen.update(windows)
        runs = {}
        for place, j in enumerate(inside):
            runs.setdefault(j - place, []).append(j)
        out += [(doc_id, r) for r in runs.values()]
    return out


def covered(spans, text):
    """Places of the words of a text that lie in spans of characters."""
    ends = [m.span() for m in re.finditer(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    return {k for k, (a, b) in enumerate(ends) for s in spans if s.start <= a and b <= s.stop}


def test_every_repeated_window_is_removed(make):
    """Passages that hold no whole sentence of both texts, or only short ones, at every place in a text."""
    rng = random.Random(15)
    words = lambda n: [w + rng.choice(["", "é漢"]) for w in random_words(rng, n, 10**6)]
    shared = [words(n) for n in (50, 51, 60, 75, 120, 49)]
    docs = []
    for k in range(40):
        text = words(rng.randrange(40))
        for _ in range(2):
            text += [*rng.choice(shared), *words(rng.randrange(1, 30))]
        text = [w + rng.choice(["", ".", ",", "!\n"]) if rng.random() < 0.3 else w for w in text]
        docs.append((k, " ".join(text)))
    docs.append((40, " ".join([*words(7), *shared[2], *words(5)]) + "."))
    docs.append((41, "A. " + " ".join([*words(3), *shared[2], *words(9)]) + " and so on."))
    spans = {}
    for r in unit_dedup.repeated_spans(make(docs)).collect():
        spans.setdefault(r.doc_id, []).append(r)
    wanted = passages(docs)
    assert len(wanted) > 10
    for doc_id, places in wanted:
        assert set(places) <= covered(spans.get(doc_id, []), dict(docs)[doc_id]), doc_id
    assert [r.n_words for r in spans[41]] == [60] and spans[41][0].n_units == 0


def test_periodic_text_keeps_one_window(make):
    got = unit_dedup.repeated_spans(make([(1, "word " * 1000)])).collect()
    assert [(r.start, r.stop, r.n_words, r.first_doc_id) for r in got] == [(250, 4999, 950, 1)]


# 3. licences


def test_base_phrases_equal_brute_force(spark):
    found = queries.op3_license_scan(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in found:
        words = plain_words(texts[r.doc_id])
        places = [(label, k) for phrase, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for _, k in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for label, _ in places})) and 0 <= r.score <= 1
        assert {*filter(None, r.base_labels.split(","))} <= {*r.labels.split(",")}


def test_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    templates = {f"t{k}": " ".join(random_words(rng, 25, 12)) for k in range(4)}
    scanner = license_scan.LicenseScanner(templates, {"w1 w2": "p", "w3 w3": "q"})
    known = {tuple(w[a:b]) for w in [*map(str.split, templates.values()), ["w1", "w2"], ["w3", "w3"]] for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    for _ in range(100):
        words = random_words(rng, 40, 14)
        state, run = 0, 0
        for k, word in enumerate(words):
            state, run = scanner.automaton.step(state, run, scanner.vocabulary.get(word.encode(), -1))
            assert run == max(n for n in range(k + 2) if n == 0 or tuple(words[k + 1 - n : k + 1]) in known)
        places, _ = scanner.scan([[w.encode() for w in words]])[0]
        assert sorted(places) == sorted((label, k) for a, b, label in (("w1", "w2", "p"), ("w3", "w3", "q")) for k in range(39) if words[k : k + 2] == [a, b])


def test_spans_of_changed_templates(make):
    mit = license_scan.TEMPLATES["mit-text"]
    given = [(1, "x " + mit.replace("free of charge", "gratis") + " y"), (2, mit[: len(mit) // 4]), (3, f"{mit}\n\n{mit}"), (4, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in license_scan.scan(make(given)).collect()}
    assert got[1].labels == "mit" and got[1].spans[0].label == "mit-text" and got[1].score > 0.9 and got[2].labels == ""
    assert [s.label for s in got[3].spans].count("mit-text") == 2
    assert (got[4].base_labels, got[4].labels, got[4].score) == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0)


def plain_spans(scanner, templates, words, min_match, max_gap):
    """Best share of each template by brute force: every run that ends and cannot go on, every chain of them."""
    sequences = [t.split() for t in templates.values()]
    holds = lambda run: [(t, k) for t, s in enumerate(sequences) for k in range(len(s) - len(run) + 1) if s[k : k + len(run)] == run]
    longest = [max(n for n in range(k + 2) if n == 0 or holds(words[k + 1 - n : k + 1])) for k in range(len(words))]
    found = {}
    for k, n in enumerate(longest):
        if n >= min_match and (k + 1 == len(words) or longest[k + 1] <= n):
            for t, there in holds(words[k + 1 - n : k + 1]):
                found.setdefault(t, []).append((k + 1 - n, there, n))
    best = {}

    def chains(t, last, covered):
        best[t] = max(best.get(t, 0), min(covered, len(sequences[t])))
        for here, there, n in found[t]:
            h, a, w = last
            gained = n - max(0, a + w - there, h + w - here)
            if h < here and a < there and here - h - w <= max_gap and there - a - w <= max_gap and gained > 0 and here - h <= max_gap + 4 * len(sequences[t]):
                chains(t, (here, there, n), covered + gained)

    for t, matches in found.items():
        for m in matches:
            chains(t, m, m[2])
    return {label: best[t] / len(sequences[t]) for t, label in enumerate(templates) if best.get(t, 0)}


def test_chains_labels_and_score_equal_brute_force(make):
    rng = random.Random(42)
    templates = {f"t{k}": " ".join(random_words(rng, 12, 40)) for k in range(4)}
    scanner = license_scan.LicenseScanner(templates, {"w1 w2": "p"})
    docs, wanted = [], {}
    for k in range(60):
        words = random_words(rng, rng.randint(0, 5), 40)
        for _ in range(2):
            part = rng.choice([*templates.values()]).split()
            words += [w for w in part[rng.randint(0, 4) :] if rng.random() < 0.92] + random_words(rng, rng.randint(0, 5), 40)
        docs.append((k, " ".join(words)))
        wanted[k] = {t: s for t, s in plain_spans(scanner, templates, words, 3, 12).items() if s >= 0.6}
    got = {r.doc_id: r for r in license_scan.scan(make(docs), templates=templates, phrases={"w1 w2": "p"}).collect()}
    assert sum(map(len, wanted.values())) > 30
    for k, shares in wanted.items():
        labels = {*filter(None, got[k].labels.split(","))} - {"p"}
        assert got[k].score == pytest.approx(max([*shares.values(), 0.5 if got[k].n_base else 0]))
        assert labels <= {*shares} and {t for t, s in shares.items() if s == max(shares.values())} <= labels
        for s in got[k].spans:
            assert s.share <= shares[s.label] + 1e-9
        lost = {*shares} - labels  # only where a better covered one lies over the same words
        assert all(any(s.share > shares[t] for s in got[k].spans) for t in lost)


def test_licences_that_differ_in_a_word(make):
    lines = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("4.0-line")}
    got = license_scan.scan(make([(n, f"Text before. {v} Text after.") for n, v in enumerate(lines.values())] * 2)).orderBy("doc_id").collect()
    assert [[s.label for s in r.spans] for r in got] == [[label] for label in lines for _ in range(2)]


def test_licences_have_one_label_each(make):
    """Texts, notices, lines and tags of a licence; the longest identifier of a tag counts."""
    apache = (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined"
    )
    given = [
        (1, apache), (2, "// SPDX-License-Identifier: BSD-3-Clause\nint x;"), (3, "SPDX-License-Identifier: BSD-3-Clause-Clear"), (4, "spdx license identifier"),
        (5, "This project is licensed under the terms of the MIT license. Released under the MIT License."), (6, "SPDX-License-Identifier: GPL-2.0-or-later OR MIT"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(make(given)).collect()}
    assert [got[k].labels for k in range(1, 7)] == ["apache,apache-2.0", "bsd-3-clause", "bsd-3-clause-clear", "", "mit", "gpl-2.0-or-later"]
    assert (got[2].n_base, got[2].score, got[2].spans[0].first, got[2].spans[0].last) == (0, 1.0, 0, 5)


def test_templates_from_a_table(spark, make):
    rows = spark.createDataFrame([("house-1", "one two three four five six"), ("house-1", "seven eight nine ten eleven"), ("house-2", None)], "licence string, text string")
    got = license_scan.scan(make([(1, "x seven eight nine ten eleven"), (2, "one two three four five six y")]), templates=license_scan.templates_of(rows)).collect()
    assert {r.labels for r in got} == {"house-1"}


def test_long_texts_of_licences(make):
    """A licence in the middle of two million words."""
    words = "lorem ipsum dolor " * 350_000
    (got,) = license_scan.scan(make([(1, f"{words}{license_scan.TEMPLATES['isc-text']} {words}")])).collect()
    assert (got.labels, got.n_words, got.spans[0].first) == ("isc", 2 * 1_050_000 + 34, 1_050_000)


def test_licences_of_odd_rows(odd, none):
    got = license_scan.scan(odd).collect()
    assert len(got) == odd.count() and {r.n_base for r in got} == {0} and {r.first_word for r in got} == {None}
    assert license_scan.scan(none).count() == 0


# 4. archives


PAGES = "page_id long, url string, html string"


def test_archives_of_odd_rows(spark):
    rows = [(1, "http://a.b/x", "same"), (5, "http://www.a.b:80/x?q=1", "same"), (3, None, "same"), (7, "ftp://[bad", ""), (8, "", None), (8, "http://é.com/ü", "é漢"), (None, None, "lone"), (9, "http://a.b/x", "x\r\n\r\ny")]
    rows += [(10 + k, "http://hot/", "hot") for k in range(50)]
    got = {(r.page_id, r.payload_bytes): r for r in warc.archive_and_read(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", key int")).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        alike = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = max(alike) if len(alike) > 1 and page_id != max(alike) else None
        r = got[page_id, len(payload)]
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == ("revisit" if first else "response", first)
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_every_record_has_an_id_of_its_own(spark):
    pages = spark.createDataFrame([(8, "http://a/1", "same"), (8, "http://a/2", "same"), (8, "http://a/3", "other"), (3, "u", "same"), (None, "v", "w")], PAGES)
    space = Workspace(spark, "ids")
    captures = space.write(warc.write_archives(warc.plan_records(pages, space), space.path("archives")), "captures").collect()
    records, heads = [], []
    for c in captures:
        fs, path = warc.store(f"{space.path('archives')}/{c.archive}")
        with fs.open_input_file(path) as file:
            raw = file.read_at(c.length, c.offset)
        records.append(warc.read_record(raw))
        heads.append(warc.gzip.decompress(raw).split(b"\r\n\r\n")[0].decode())
    ids = [r["record_id"] for r in records]
    assert len({*ids}) == len(ids) == 5 and sorted(r["page_id"] or 0 for r in records) == [0, 3, 8, 8, 8]
    revisit = next(h for h, r in zip(heads, records, strict=True) if r["record_type"] == "revisit")
    refers = revisit.split("WARC-Refers-To: ")[1].split("\r\n")[0]
    assert any(r["record_id"] == refers and r["payload"] == b"same" and r["record_type"] == "response" for r in records)


def test_min_revisit_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "v", "abcd"), (4, "v", "abcd")], PAGES)
    got = {r.page_id: r.record_type for r in warc.archive_and_read(pages, min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_url_keys():
    assert [warc.url_key(u) for u in ("http://www.Ex.com:80/a?b", "https://m.ex.com:8080", None, "")] == ["com,ex)/a?b", "com,ex,m:8080)/", "-", "-"]


def test_index_lookup_equals_scan(spark, tmp_path):
    rng = random.Random(7)
    lines = sorted(((f"k{rng.randrange(30):02}", rng.randrange(40), "f", k, 1) for k in range(500)), key=lambda x: x[:4])
    captures = spark.createDataFrame(lines, warc.CAPTURES)
    directory = [tuple(r) for r in warc.write_index(captures, str(tmp_path), block_lines=7).collect()]
    index = warc.CaptureIndex(str(tmp_path), directory)
    for key in (f"k{n:02}" for n in range(31)):
        for page_id in range(41):
            assert sorted(index.find(key, page_id)) == [x for x in lines if x[:2] == (key, page_id)]


# 5. line frequency


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    under = {k + j for k, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(under) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len({*lines}), len(under), failed


def test_base_rules_of_odd_rows(odd, none, make):
    rng = random.Random(8)
    texts = [r.text for r in odd.collect()] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["a b c d e " * 6, "x" * 10]
    got = line_frequency.quality(make([(k, t) for k, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [plain_quality(t) for t in texts]
    assert line_frequency.quality(odd).count() == odd.count() and line_frequency.quality(none).count() == 0


def test_frequent_lines_deplete(make):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    shared = " ".join(f"s{j}" for j in range(30))
    rows = [(k, f"{shared}\n{words(k)}", "hot") for k in range(40)] + [(100 + k, f"{shared.upper()}\n a b", "hot") for k in range(5)] + [(200, f"{shared}\n{words(9)}", "calm"), (201, f"{shared}\na b", None)]
    got = {r.doc_id: r for r in line_frequency.quality(make(rows), min_docs=20, max_share=0.1).collect()}
    assert got[0].n_removed_words == 30 and got[0].kept and not got[100].kept and not got[100].base_failed
    assert got[200].n_removed_words == 0 and got[201].kept


def test_remove_lines(make, odd, none):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    shared = " ".join(f"s{j}" for j in range(30))
    rows = [(k, f"{words(k)}\n\n  {shared} \nend", "hot") for k in range(40)] + [(100 + k, f"{shared.upper()}\n a b", "hot") for k in range(5)] + [(200, f"{shared}\n{words(9)}", "calm")]
    docs = make(rows)
    options = {"min_docs": 20, "max_share": 0.1}
    got = {r.doc_id: r.text for r in line_frequency.remove_lines(docs, **options).collect()}
    kept = {r.doc_id: r for r in line_frequency.quality(docs, **options).where("kept").collect()}
    assert got.keys() == kept.keys() == {*range(40), 200}
    assert got[7].split("\n")[:2] == [words(7), ""] and "s5" not in got[7] and got[200] == rows[-1][1]
    texts = dict((k, t) for k, t, _ in rows)
    assert all(len(texts[k].split()) - len(t.split()) == kept[k].n_removed_words for k, t in got.items())
    assert line_frequency.remove_lines(odd).columns == odd.columns and line_frequency.remove_lines(none).count() == 0


# 6. curriculum


def plain_targets(sizes, most=3.0):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: left * weight[s] / weights for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_equal_brute_force(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = {None if k == 0 else f"s{k}": rng.choice([1, 5, 50, 500, 5000, 100_000]) for k in range(rng.randint(1, 9))}
        df = spark.createDataFrame([*sizes.items()], "source string, size long")
        got = {r.source: r.target for r in curriculum.source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def mixed(make):
    rng = random.Random(10)
    return make([(k, " ".join(["w"] * rng.randint(0, 40)), "big" if k < 300 else rng.choice(["a", "b", "c", None])) for k in range(500)])


def test_mix_meets_targets(make):
    docs = mixed(make)
    rows = curriculum.mix(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(r.text.split()) for r in docs.collect()}
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20.5 and own[0].source_size == sum(r.size for r in own)
        assert all(r.taken <= 3 * r.size and max(r.copies for r in own) - r.copies <= 1 for r in own if r.size)
        assert all(len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, curriculum.mix(docs).collect()))


def test_training_order(make):
    docs = mixed(make)
    copies = {r.doc_id: r.copies for r in curriculum.mix(docs).collect()}
    out = curriculum.training_order(docs)
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter({k: n for k, n in copies.items() if n})
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    clash = curriculum.training_order(docs.withColumnRenamed("n_chars", "Position"), schedules={"big": FLAT_THEN_STEEP})
    assert clash.columns == ["doc_id", "text", "lang", "source", "Position", "position_"] and min(r.position_ for r in clash.where("source = 'big'").collect()) >= 0.25
    twice = docs.unionByName(docs)
    assert sum(len(r.text.split()) for r in curriculum.training_order(twice).collect()) == sum(r.taken for r in curriculum.mix(twice).collect())


def area_until(t, corners):
    total = 0.0
    for (t0, h0), (t1, h1) in zip(corners, corners[1:], strict=False):
        step = min(max(t - t0, 0), t1 - t0)
        total += h0 * step + (h1 - h0) / (t1 - t0) * step**2 / 2
    return total


FLAT_THEN_STEEP = ((0.0, 0.0), (0.25, 0.0), (0.5, 3.0), (1.0, 0.0))


@pytest.mark.parametrize("corners", [*curriculum.SCHEDULES, FLAT_THEN_STEEP])
def test_schedules_invert(spark, corners):
    rng = random.Random(11)
    done = [rng.random() for _ in range(50)] + [0.0, 1.0]
    df = spark.createDataFrame([("x", 0, d) for d in done], "source string, place int, d double")
    rows = curriculum.with_schedules(df, {"x": corners})
    for d, t in ((r.d, r.t) for r in rows.select("d", curriculum.position(F.col("d"), F.col("_area"), F.col("_stretches")).alias("t")).collect()):
        assert area_until(t, corners) == pytest.approx(d * area_until(1, corners), abs=1e-9)


def test_positions_equal_brute_force(make):
    """Positions of every copy from each source's line of documents, with schedules by turns and given ones."""
    docs = mixed(make)
    given = {"big": FLAT_THEN_STEEP, None: ((0.0, 2.0), (1.0, 0.0))}
    rows = curriculum.curriculum(docs, schedules=given).collect()
    order = {r.doc_id: r.o for r in docs.select("doc_id", curriculum.order_key(docs, 17).alias("o")).collect()}
    names = sorted({r.source for r in rows} - {None}) + [None]
    for place, source in enumerate(names):
        corners = given.get(source, curriculum.SCHEDULES[place % 3])
        before = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (order[r.doc_id], r.doc_id, r.size)):
            for k, t in enumerate(r.positions):
                done = min(1.0, (before + r.size / 2 + k * r.source_size) / r.target)
                assert area_until(t, corners) == pytest.approx(done * area_until(1, corners), abs=1e-9)
            assert (r.first_position, r.last_position) == ((r.positions[0], r.positions[-1]) if r.copies else (None, None))
            before += r.size
    firsts = [r.first_position for r in rows]
    taken = [t for t in firsts if t is not None]
    assert taken == sorted(taken) and firsts[len(taken) :] == [None] * (len(firsts) - len(taken))
    with pytest.raises(ValueError, match="no schedule"):
        curriculum.curriculum(docs, schedules={"big": ((0.0, 1.0), (0.5, 1.0))})


def test_curriculum_is_in_the_plan(spark):
    plan = queries.op6_curriculum_mix(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(first_position" in plan and "SQRT" in plan.upper() and "Python" not in plan


def test_mix_of_odd_rows(odd, none):
    rows = curriculum.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert curriculum.mix(none).count() == 0 and curriculum.training_order(none).count() == 0
    assert sum(r.taken for r in rows) == sum(len(r.text.split()) for r in curriculum.training_order(odd).collect())


# 7. classifier


def test_classifier_on_held_out_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.op7_gam_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    held = [(got[k].predicted, y) for k, y in labels if got[k].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95


def test_interactions_are_learned():
    rng = np.random.default_rng(12)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_classifier.AdditiveModel(pairs=2).fit(x[:3000], y[:3000])
    assert (1, 0) in model.pair_tables and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def plain_features(text):
    words = (text or "").split()
    if not words:
        return [0.0] * len(gam_classifier.FEATURES)
    raw, n, low = text.encode(), len(words), [w.lower() for w in words]
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda of: sum(raw.count(bytes([b])) for b in of) / len(raw)
    return [
        np.log1p(n), sum(len(w) for w in words) / n, share(range(65, 91)), share(b"#*$%&|<>@^~{}[]\\=+_"), share(b"0123456789"), share(b".,;:!?\"'()-/"),
        len({*low}) / n, max(low.count(w) for w in {*low}) / n, sum(w[-1] in ".!?" for w in words) / n, n / max(1, len(lines)), 1 - len({*lines}) / max(1, len(lines)),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, sum(not any(c.isalpha() for c in w) for w in words) / n, sum(w.isupper() for w in words) / n,
        len({*zip(low, low[1:], strict=False)}) / max(1, n - 1), sum(len(w) > 14 for w in words) / n,
    ]


def test_scores_equal_brute_force(spark):
    """The query's scores from features computed plainly and tables looked up one by one."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = gam_classifier.fit(docs, labels)
    assert len(model.tables) == len(gam_classifier.FEATURES) and len(model.pair_tables) == model.n_pairs
    got = {r.doc_id: r for r in queries.op7_gam_quality(spark, SMALL).collect()}
    for r in docs.collect():
        x = plain_features(r.text)
        at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges, strict=True)]
        total = model.start + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[a], at[b]] for (a, b), t in model.pair_tables.items())
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(43)
    model = gam_classifier.AdditiveModel()
    leaf = lambda g, h: g.sum() ** 2 / (h.sum() + model.smooth)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        gain, at = model._cut(g, h)
        tries = {k: leaf(g[:k], h[:k]) + leaf(g[k:], h[k:]) - leaf(g, h) for k in range(1, 9)}
        best = max(tries, key=tries.get)
        assert (gain, at) == ((pytest.approx(tries[best]), best) if tries[best] > 1e-9 else (0.0, 0))
        step = model._tree(g, h)
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), 9]
        assert len(cuts) <= 5 and at in cuts
        assert all(np.allclose(step[a:b], model.rate * g[a:b].sum() / (h[a:b].sum() + model.smooth)) for a, b in zip(cuts, cuts[1:], strict=False))


def test_classifier_never_sees_held_out_labels(spark, make):
    docs = make([(k, "good words here " * (k % 7 + 3) if k % 2 else "### $$$ %%% " * 9) for k in range(200)])
    true = [(k, k % 2) for k in range(200)]
    false = [(k, 1 - y if zlib.crc32(str(k).encode()) % 3 == 1 else y) for k, y in true]
    one, two = ({r.doc_id: r.score for r in gam_classifier.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (true, false))
    assert one == two and all((one[k] > 0.5) == y for k, y in true)
    bounded, _ = gam_classifier.training_rows(docs, spark.createDataFrame(true, "doc_id long, quality int"), 30)
    assert 10 <= len(bounded) <= 30


def test_classifier_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "x"), (6, 0, "x"), (None, 1, "x"), (2, None, "x"), (99, 1, "x")], "doc_id long, quality int, text string")
    assert gam_classifier.classify(odd, labels).count() == odd.count()
    unlabelled = gam_classifier.classify(odd, labels.where("false")).collect()
    assert {r.score for r in unlabelled} == {0.5} and gam_classifier.classify(none, labels).count() == 0


# 8. chosen paths


def plain_classes(texts):
    sets = []
    for t in texts:
        w = plain_words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n, root = len(texts), [*range(len(texts))]
    links = [0] * n

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)], links


def families(rng, n_families, size):
    texts = []
    for _ in range(n_families):
        base = random_words(rng, rng.randint(40, 120), 10**6)
        for _ in range(rng.randint(1, size)):
            words = [*base]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("small", "block", "size", "depth"), [(64, 512, 12, 6), (4, 8, 40, 6), (4, 8, 40, 1)])
def test_near_duplicates_equal_brute_force(make, small, block, size, depth):
    """Small buckets and blocks send the same families through deeper paths and pairs of blocks."""
    texts = families(random.Random(13), 25, size) + ["", "one two", "one two", "a b c d e", "A b, c d e!"]
    got = chosen_path.near_duplicates(make([*enumerate(texts)]), small=small, block=block, depth=depth, block_shingles=500).orderBy("doc_id").collect()
    classes, links = plain_classes(texts)
    assert [(r.class_id, r.n_links) for r in got] == [*zip(classes, links, strict=True)]


def test_keep_one(odd, none, make):
    texts = families(random.Random(14), 15, 6)
    kept = chosen_path.keep_one(make([*enumerate(texts)]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*plain_classes(texts)[0]})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = chosen_path.keep_one(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - 1
    assert chosen_path.near_duplicates(odd).count() == odd.count()
    assert chosen_path.keep_one(none).count() == 0 and chosen_path.near_duplicates(none).count() == 0


def test_runs_reach_the_recall():
    """The stated recall against a simulation of paths and sketch checks, for pairs whose buckets are large at every level."""
    rng = np.random.default_rng(31)
    depth, least, n = 6, 0.55, 4000
    runs = chosen_path.runs_for(0.995, depth, least)
    assert chosen_path.recall_of(runs - 1, depth, least) < 0.995 <= chosen_path.recall_of(runs, depth, least)
    assert chosen_path.recall_of(runs, 3, least) > 0.9995
    one = rng.integers(0, 2**32, (n, chosen_path.PLACES), np.uint32)
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 2**32, one.shape, np.uint32))
    met = np.zeros(n, bool)
    roots = chosen_path.mix(np.arange(1, runs + 1, dtype=np.uint64) * chosen_path.ODD)
    held = [(np.tile(roots, n), np.repeat(np.arange(n), runs)) for _ in range(2)]
    for _ in range(depth):
        nexts = []
        for (paths, owner), x in zip(held, (one, two), strict=True):
            at, new = chosen_path.children(paths, x[owner])
            nexts.append((new, owner[at]))
        held = nexts
    for k in range(n):
        met[k] = bool({*held[0][0][held[0][1] == k].tolist()} & {*held[1][0][held[1][1] == k].tolist()})
    met &= (one == two).mean(axis=1) >= least
    assert met.mean() > 0.99
    with pytest.raises(ValueError, match="at most"):
        chosen_path.runs_for(1 - 1e-12, 1, least)


def test_pairs_at_the_threshold_are_found(make):
    """2,000 pairs of similarity 0.80 to 0.82 that share frequent passages, so that nearly all buckets are split again."""
    rng = random.Random(32)
    frequent = [" ".join(random_words(rng, 12, 10**6)) for _ in range(2)]
    texts, similarity = [], []
    for _ in range(2000):
        base = f"{frequent[0]} {' '.join(random_words(rng, rng.randint(26, 28), 10**9))} {frequent[1]}".split()
        other = [*base]
        other[len(base) // 2] = "changed"
        texts += [" ".join(base), " ".join(other)]
        n = len(base) - 4
        similarity.append((n - 5) / (n + 5))
    assert 0.8 <= min(similarity) and max(similarity) < 0.83
    got = chosen_path.near_duplicates(make([*enumerate(texts)]), small=8).orderBy("doc_id").collect()
    linked = [got[k].class_id == got[k + 1].class_id == k and got[k].n_links == got[k + 1].n_links == 1 for k in range(0, len(got), 2)]
    assert sum(linked) / len(linked) >= 0.99


def test_block_pairs_count_exactly():
    rng = np.random.default_rng(33)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)) for _ in range(40)]
    alike = np.array([[5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}) for b in sets] for a in sets])
    np.fill_diagonal(alike, False)
    links, root = chosen_path.compare_block_pair(sets, [*range(1, 41)], None)
    assert links.tolist() == (alike @ np.arange(1, 41)).tolist() and root.tolist() == chosen_path.roots_of(alike).tolist()
    side = rng.integers(0, 2, 40)
    links, _ = chosen_path.compare_block_pair(sets, [1] * 40, side.tolist())
    assert links.tolist() == (alike & (side[:, None] != side[None])).sum(axis=1).tolist()


def test_long_texts_of_pairs(make):
    """Two texts of some 10 MB that differ in a few words, hashed in pieces."""
    words = [f"é{k}" for k in range(1_000_000)]
    other = ["x" if k % 100 == 7 else w for k, w in enumerate(words)]
    got = chosen_path.near_duplicates(make([(1, " ".join(words)), (2, " ".join(other)), (3, "short")])).orderBy("doc_id").collect()
    assert [(r.class_id, r.n_links) for r in got] == [(1, 1), (1, 1), (3, 0)]
    hashes, counts = chosen_path.shingle_hashes([" ".join(words)])
    assert len({*hashes.tolist()}) == counts[0] == 999_996


def test_components(spark):
    rng = random.Random(15)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "t").collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != 300}


# 9. phrases


def with_rows(docs):
    return docs.withColumn("row", F.monotonically_increasing_id())


def plain_near(words, window, slop):
    """Places p of a text's words where each word of the window stands within slop of p and its own place."""
    at = {}
    for k, w in enumerate(words):
        at.setdefault(w, []).append(k)
    return {p for p in range(-slop, len(words) + slop) if all(any(abs(k - p - j) <= slop for k in at.get(w, ())) for j, w in enumerate(window))}


def test_index_equals_brute_force(make, monkeypatch):
    rng = random.Random(16)
    texts = [" ".join(random_words(rng, rng.randint(0, 60), 6)) for _ in range(80)]
    monkeypatch.setattr(phrase_index, "CANDIDATES", 50)
    phrases = [("w1",), ("w1", "w2"), ("w3", "w3"), ("w1", "w2", "w1", "w3"), ("w5", "w0", "w0"), ("w1", "nowhere")]
    for row in phrase_index.build_index(with_rows(make([*enumerate(texts)])), shard_words=300).collect():
        shard = phrase_index.open_shard(row.asDict())
        windows = np.full((len(phrases), 4), -1)
        for k, phrase in enumerate(phrases):
            windows[k, : len(phrase)] = shard.numbers([*phrase])
        sizes = np.array([*map(len, phrases)])
        for slop in (0, 2):
            got = {(w, p) for found in shard.find(windows, sizes, slop) for w, p, _ in zip(*(x.tolist() for x in found), strict=True)}
            wanted = {(k, start + p) for k, phrase in enumerate(phrases) for doc_id, start in zip(row.doc_ids, row.starts, strict=True) for p in plain_near(texts[doc_id].split(), phrase, slop)}
            assert got == wanted


def test_proximity(spark, make):
    docs = make([(0, "a x b y c"), (1, "a b c"), (2, "c z z z z z a b"), (3, "b a c"), (4, "a x x x b c")])
    items = spark.createDataFrame([(7, "A b, c")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near) for r in phrase_index.contamination(docs, items).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (0, 0), 3: (0, 1), 4: (0, 1)}
    assert {r.doc_id: r.n_near for r in phrase_index.contamination(docs, items, slop=0).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}


def plain_contamination(text, items, width=13, slop=2):
    words, hit, exact, near = plain_words(text), set(), set(), set()
    for item, said in items:
        for window in phrase_index.windows_of(said, width):
            window = [w.decode() for w in window]
            places = [k for k in range(len(words) - len(window) + 1) if words[k : k + len(window)] == window]
            hit |= {k + j for k in places for j in range(len(window))}
            exact |= {item} if places else set()
            near |= {item} if plain_near(words, window, slop) else set()
    return len(words), len(hit), len(exact), len(near)


def test_blocks_and_pieces_change_nothing(spark, make, monkeypatch):
    """Benchmarks in many blocks, and texts in overlapping pieces, give what brute force gives."""
    rng = random.Random(17)
    said = [" ".join(random_words(rng, rng.randint(3, 30), 30)) for _ in range(12)]
    docs = []
    for k in range(30):
        words = random_words(rng, rng.randint(0, 60), 30)
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(said).split()[rng.randint(0, 3) :]
            words += [w for w in part if rng.random() < 0.97] + random_words(rng, 9, 30)
        docs.append((k, " ".join(words)))
    items = [(str(k % 9), x) for k, x in enumerate(said)]
    wanted = {k: plain_contamination(t, items) for k, t in docs}
    frame = spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    answer = lambda **options: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.n_near) for r in phrase_index.contamination(make(docs), frame, **options).collect()}
    assert answer() == answer(block_bytes=60) == wanted
    text = " ".join(t for _, t in docs) * 3
    monkeypatch.setattr(phrase_index, "GAP", 40)
    monkeypatch.setattr(phrase_index, "PIECE_BYTES", 500)
    given = [{"piece": k, "offset": o, "own": n, "words": w} for k, (o, n, w) in enumerate(phrase_index.pieces_of(text))]
    words = plain_words(text)
    assert len(given) > 5 and sum(p["own"] for p in given) == len(words)
    assert all([w.decode() for w in p["words"]] == words[p["offset"] : p["offset"] + len(p["words"])] for p in given)


def test_long_texts_of_phrases(spark, make):
    """A text of several pieces: counts, spans across the seams, and items of all pieces."""
    item = " ".join(f"q{k}" for k in range(20))
    filler = [f"é{k % 1000}" for k in range(2_200_000)]
    seam = next(phrase_index.pieces_of(" ".join(filler)))[1]
    for at in (5, seam - 9, 2_100_000):
        filler[at : at + 20] = item.split()
    items = spark.createDataFrame([(1, item), (2, "nothing of it here")], "item_id long, text string")
    docs = make([(0, " ".join(filler)), (1, f"x {item}"), (2, None)])
    found = {r.doc_id: r for r in phrase_index.matches(docs.select("doc_id", "text"), items).collect()}
    assert found[0].n_words == len(filler) and found[0].items == found[0].near == ["1"]
    assert [(s.start, s.stop) for s in found[0].spans] == [(5, 25), (seam - 9, seam + 11), (2_100_000, 2_100_020)] and found[0].n_hit == 60
    assert (found[1].n_hit, found[2].n_words) == (20, 0)


def test_contamination_of_odd_rows(spark, odd, none, make):
    items = spark.createDataFrame([(1, "One TWO three", "x"), (2, None, "x"), (None, "word " * 13, "x"), (4, "", "x"), (1, "six seven", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.n_words): r for r in phrase_index.contamination(odd, items).collect()}
    assert (got[1, 7].n_hit, got[1, 7].n_items, got[1, 7].contaminated) == (5, 1, True)
    assert (got[6, 30_000].n_hit, got[6, 30_000].items_sha256) == (30_000, hashlib.sha256(b"null").hexdigest())
    assert not got[2, 0].contaminated and phrase_index.contamination(none, items).count() == 0
    assert phrase_index.contamination(odd, items.where("false")).where("contaminated").count() == 0
    left = phrase_index.drop_contaminated(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    edge = make([(0, " ".join(["a"] * 19 + ["one", "two", "three"]) + " b" * 38), (1, " ".join(["one", "two", "three"]) + " b" * 58)])
    assert {r.doc_id: r.contaminated for r in phrase_index.contamination(edge, items.limit(1)).collect()} == {0: True, 1: False}
    assert phrase_index.contamination(none, items.where("false")).count() == 0
    with pytest.raises(ValueError, match="reach over"):
        phrase_index.contamination(odd, items, slop=2000)


# 10. spread


def test_spread_counts_sites(make):
    rows = [(100 * s + k, f"shared line\nwide {s}\nnear edge" if s < 5 else "shared line\nown", f"site{s}") for s in range(12) for k in range(3)]
    got = {r.doc_id: r for r in site_spread.spread_report(make(rows), min_sites=6).collect()}
    assert (got[0].n_removed, got[0].removed, got[1100].removed) == (1, [0], [0, 1])
    cleaned = {r.doc_id: r.text for r in site_spread.remove_boilerplate(make(rows), min_sites=6).collect()}
    assert cleaned[0] == "wide 0\nnear edge" and cleaned[1100] == ""
    assert all(len(cleaned[k]) == r.clean_chars for k, r in got.items())
    assert site_spread.spread_report(make(rows), min_sites=13).where("n_removed > 0").count() == 0


def test_spread_of_odd_rows(odd, none):
    got = site_spread.spread_report(odd, min_sites=2).collect()
    assert len(got) == odd.count() and site_spread.spread_report(none).count() == 0
    assert site_spread.remove_boilerplate(odd, min_sites=2).columns == odd.columns


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    space = Workspace(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = space.write(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        assert name == "tokens" or docs.columns == columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = gam_classifier.classify(seen["quality"][0], labels).where("predicted = 1")
    assert ids(seen["quality"][1]) == ids(scores)
    rows = seen["near_duplicates"][0].orderBy("doc_id").collect()
    classes, _ = plain_classes([r.text for r in rows])
    assert ids(seen["near_duplicates"][1]) == Counter(rows[k].doc_id for k in {*classes})
    verdicts = phrase_index.contamination(seen["decontamination"][0], spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert ids(seen["decontamination"][1]) == ids(verdicts.where("not contaminated"))
    taken = {r.doc_id: r.copies for r in curriculum.mix(seen["mixing"][0]).collect()}
    assert ids(seen["mixing"][1]) == Counter({k: n for k, n in taken.items() if n})
    last = seen["tokens"][0].select("doc_id", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in docs.orderBy("start").collect()] == plain_tokens([tuple(r) for r in last])
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_index_holds_few_shards_at_once(spark, make, monkeypatch, tmp_path):
    """However many shards a task makes, a file holds few of them, so that neither its writer nor its reader has them all."""
    from pathlib import Path

    import pyarrow.parquet as pq

    whole = phrase_index.build_index
    monkeypatch.setattr(phrase_index, "build_index", lambda docs: whole(docs, shard_words=50))
    docs = make([(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(20))) for k in range(200)]).coalesce(1)
    items = docs.where("doc_id % 40 = 0").selectExpr("cast(doc_id as string) item_id", "text")
    space = Workspace(spark, "few")
    got = {r.doc_id: r.items for r in phrase_index.matches(docs, items, space=space).collect()}
    assert len(got) == 200 and all(str(k) in got[k] for k in range(0, 200, 40))
    held = [pq.ParquetFile(f).metadata.num_rows for f in Path(space.path("index").removeprefix("file://")).glob("*.parquet")]
    assert sum(held) > 20 and max(held) <= 4


def test_short_documents_take_no_memory_for_gaps(make):
    """Hits are marked by words: 20,000 texts of a word or none are no 20 million places."""
    import tracemalloc

    n = 20_000
    texts = [("lone" if k % 3 else "") for k in range(n)]
    texts[5], texts[n - 1] = "first second", "before first second after"
    row = next(r.asDict() for r in phrase_index.build_index(with_rows(make([*enumerate(texts)])).coalesce(1), shard_words=10**7).collect())
    asked = phrase_index.Block(phrase_index.Block.pack({(b"first", b"second"): [0]}, ["x"], 13))
    tracemalloc.start()
    found = phrase_index.search_shard(row, iter([asked]), 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = {i: (hit, spans) for i, hit, spans in zip(found[1], found[4], found[5], strict=True) if hit}
    assert at == {5: (2, [{"start": 0, "stop": 2}]), n - 1: (2, [{"start": 1, "stop": 3}])}
    assert peak < 40_000_000
