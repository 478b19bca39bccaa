"""Texts of megabytes through the operators that take them whole, and odd and empty tables through the pipeline's stages."""

import base64
import hashlib
import re

import pytest
from helpers import SMALL

from codeloom.llm import curriculum, gam_classifier, line_frequency, site_spread, warc
from codeloom.llm.common import Workspace

LINE = "Some words of a line that is in the text again and again, # and a symbol.\n"
LONG = LINE * 30_000 + "one last line of its own"


@pytest.fixture(scope="module")
def long_docs(make):
    return make([(1, LONG, "a"), (2, "short words of no weight at all in a text of ten words", "a"), *((10 + k, LINE, f"s{k}") for k in range(9))])


@pytest.fixture(scope="session")
def make(spark):
    def run(rows):
        return spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return run


def test_archives(spark):
    html = "<p>é</p>" * 400_000
    got = warc.archive_and_read(spark.createDataFrame([(1, "http://a/", html), (2, "http://b/", html)], "page_id long, url string, html string")).orderBy("page_id").collect()
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert [(r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == [(len(html.encode()), digest, "revisit", 2), (len(html.encode()), digest, "response", None)]


def test_line_frequency(long_docs):
    got = {r.doc_id: r for r in line_frequency.quality(long_docs).collect()}
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG)
    assert (got[1].n_words, got[1].word_chars, got[1].n_symbols, got[1].n_dup_lines) == (len(words), sum(map(len, words)), LONG.count("#"), 29_999)
    assert got[1].base_failed and not got[1].kept and not got[2].base_failed


def test_mix(long_docs):
    got = {r.doc_id: r for r in curriculum.curriculum(long_docs).collect()}
    assert got[1].size == len(LONG.split()) and all(r.taken <= 3 * r.size for r in got.values())


def test_scores(spark, long_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), *((10 + k, k % 2) for k in range(9))], "doc_id long, quality int")
    got = gam_classifier.classify(long_docs, labels).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)


def test_site_spread(long_docs):
    got = {r.doc_id: r for r in site_spread.spread_report(long_docs).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[1].clean_chars) == (30_001, 30_000, len("one last line of its own"))
    assert got[10].n_removed == 1


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_tables_through_the_pipeline(spark, request, rows):
    """Clashing columns, nulls, repeated rows and no rows at all, stage after stage."""
    import corpus_pipeline

    docs = request.getfixturevalue(rows)
    columns, n, space = docs.columns, docs.count(), Workspace(spark, "odd-stages")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, space.write(stage(spark, docs, SMALL), name)
        if name != "tokens":
            assert docs.columns == columns and docs.count() <= 3 * before.count()
        if name in ("near_duplicates", "decontamination"):
            assert docs.exceptAll(before).count() == 0 if rows == "none" else docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert docs.count() <= 3 * n and {"doc_id", "start", "n_tokens", "ids_crc32"} <= {*docs.columns}
