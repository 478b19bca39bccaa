"""Stored indexes: the same rows as without them, fewer blocks read, recall measured."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import retrieval
from codeloom.sources import store
from codeloom.sources.keyword_index import KeywordIndex
from codeloom.sources.vector_index import VectorIndex


@pytest.fixture(scope="module")
def texts(spark):
    """2,000 texts; 'common' is in all of them, 'rare' in a few, which have it often."""
    rng, rows = random.Random(1), []
    for k in range(2000):
        words = ["common"] * rng.randrange(1, 4) + [f"w{int(300 * rng.random() ** 2)}" for _ in range(rng.randrange(5, 60))]
        words += ["rare"] * (5 if k % 401 == 0 else 0)
        rows.append((k, " ".join(words)))
    return spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "!?")], "doc_id long, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "common rare"), (2, "w1 w2 common"), (3, "w299"), (4, "nowhere"), (5, "w5 w5 W5 common nowhere"), (6, "?"), (7, None)], "query_id long, query string")


def rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("span", [4, 128])
def test_index_equals_scan(texts, asked, tmp_path, span):
    spark = texts.sparkSession
    index = KeywordIndex(spark, str(tmp_path / "k"))
    assert not index.exists()
    assert index.build(texts, "doc_id", span=span).exists()
    for top in (1, 4, 30):
        want = rows(retrieval.bm25(texts, asked, top=top))
        assert rows(index.search(asked, top=top)) == rows(index.search(asked, top=top, prune=False)) == want


def test_pruned_blocks(texts, asked, tmp_path):
    """A search for the few texts with a rare word leaves out nearly all blocks of the common one."""
    index = KeywordIndex(texts.sparkSession, str(tmp_path / "k")).build(texts, "doc_id", span=16)
    read = {p: {r.query: (r["count"], r.n) for r in index.postings(asked, top=4, prune=p).groupBy("query").agg(F.count("*").alias("count"), F.sum(F.size("postings")).alias("n")).collect()} for p in (True, False)}
    assert read[False][1][1] > 2000 and read[True][1][1] < 300 and read[True][1][0] < read[False][1][0] / 5
    assert all(read[True][q] <= read[False][q] for q in read[False])


def test_search_plan(texts, asked, tmp_path):
    """No text is tokenised but the questions'; postings are scanned once, heads without postings."""
    index = KeywordIndex(texts.sparkSession, str(tmp_path / "k")).build(texts, "doc_id")
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("postings" in line for line in scans) == 1 and not any("words" in line.split("ReadSchema")[1] for line in scans)
    assert "CartesianProduct" not in plan


def test_index_of_nothing(spark, asked, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k")).build(spark.createDataFrame([], "doc_id long, text string"), "doc_id")
    assert index.search(asked).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    """60 clumps of 50 vectors, some equal, some null."""
    rng, out = random.Random(2), []
    for c in range(60):
        centre = [rng.gauss(0, 4) for _ in range(12)]
        out += [(50 * c + k, [x + rng.gauss(0, 1) for x in centre] if k else centre) for k in range(50)]
    return spark.createDataFrame([*out, (9000, None), (9001, out[0][1])], "vec_id long, embedding array<float>")


def test_vector_index(spark, vectors, tmp_path):
    """Exact mode gives what a scan gives; a few cells give nine tenths of it at least."""
    asked = vectors.where("vec_id % 37 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = VectorIndex(spark, str(tmp_path / "v")).build(vectors, "vec_id")
    want = rows(retrieval.nearest(vectors.where("embedding is not null"), asked, top=10))
    assert rows(index.search(asked, top=10, exact=True)) == rows(index.search(asked, top=10, exact=True, probes=1)) == want
    found = {r[:2] for r in rows(index.search(asked, top=10))}
    assert len(found & {r[:2] for r in want}) >= 0.9 * len(want)
    assert index.search(asked.where("false")).count() == 0


def test_vector_index_reads_its_cells(spark, vectors, tmp_path):
    """A search for one vector opens folders of its cells only."""
    index = VectorIndex(spark, str(tmp_path / "v")).build(vectors, "vec_id", cells=30)
    asked = vectors.where("vec_id = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert index.search(asked, probes=2, top=1).first().vec_id == 50
    cells = spark.read.parquet(str(tmp_path / "v/centres"))
    assert cells.count() == 30 and cells.agg(F.sum("held")).first()[0] == 3001


def test_small_vector_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<float>")
    assert VectorIndex(spark, str(tmp_path / "a")).build(none, "vec_id").search(asked, exact=True).count() == 0
    one = spark.createDataFrame([(7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in VectorIndex(spark, str(tmp_path / "b")).build(one, "vec_id").search(asked).collect()] == [(1, 7, 1.0, 1)]


def test_only_new_texts_are_embedded(spark, tmp_path):
    """Re-indexing a repository in which one file has changed sends that file's chunks to the embedder, and no other."""
    sent = spark.sparkContext.accumulator(0)

    def embed(texts):
        sent.add(len(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    files = [(f"{k}.js", f"line {'a' * k}\n" * 3) for k in range(20)]
    index = store.ChunkIndex(spark, str(tmp_path / "i"), embed)
    chunked = lambda fs: retrieval.line_chunks(spark.createDataFrame(fs, "path string, code string"))
    assert index.index("r", chunked(files)) == 20 and sent.value == 20
    files[3] = ("3.js", "changed aaa\n")
    assert index.index("r", chunked(files[:-1])) == 19 and sent.value == 21
    assert index.of("r").where("embedding is null").count() == 0
    got = index.search("r", spark.createDataFrame([(1, "3.js lines 1-1 changed aaa")], "query_id int, query string"), top=1).first()
    assert got.chunk_key == "3.js::L1"


def test_index_is_built_where_texts_lie(texts, tmp_path):
    """No copy of the words is written, and no posting is shuffled on the way into a block; spans over two batches count whole."""
    index = KeywordIndex(texts.sparkSession, str(tmp_path / "k")).build(texts, "doc_id")
    assert not (tmp_path / "k/words").exists()
    held = index._blocks().where("term = 'common'").agg(F.sum("held"), F.sum(F.size("postings"))).first()
    assert tuple(held) == (2000, 2000)


def test_equal_scores_across_stretches(spark, tmp_path):
    """Of equal texts the smallest keys come first, also where keys are texts and stretches many."""
    docs = spark.range(9000).selectExpr("concat('k', id) as doc_id", "if(id % 2 = 0, 'a b', 'a c') as text").repartition(3, "doc_id")
    asked = spark.createDataFrame([(None, "b"), (2, "a c")], "query_id long, query string")
    index = KeywordIndex(spark, str(tmp_path / "k")).build(docs, "doc_id", span=4)
    assert rows(index.search(asked)) == rows(retrieval.bm25(docs, asked))


def test_distances_are_no_rows(vectors):
    """Only the best of each block leave it; vectors of another length or with a null have no part, and a question without a vector no distance."""
    spark = vectors.sparkSession
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [5.0, 2.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, query array<float>")
    found = retrieval.nearest(odd, asked, top=3)
    assert rows(found) == rows(spark.createDataFrame([(1, 1, 0.0, 1), (1, 4, 16.0, 2), (2, 1, None, 1), (2, 2, None, 2), (2, 3, None, 3)], "a long, b long, c double, d int"))
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_scan_equals_bm25(spark, tmp_path, monkeypatch):
    """Questions of texts that lie in several stretches get what the joins give; odd texts and questions count as they do there."""
    import pyarrow as pa

    from codeloom.operators import keyword_scan

    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 40)}" for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += [None, "", "?!", "W1-w2_W3", "İw1 Kelvin Kelvin é1w2", "w1" * 50, texts[0], texts[0]]
    docs = spark.createDataFrame([(k * 3 % 128, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = [(k, " ".join(f"w{rng.randrange(45)}" for _ in range(5))) for k in range(30)] + [(90, None), (91, "!"), (92, "nowhere"), (93, "KELVIN w1 w1"), (None, "w2 elvin")]
    questions = spark.createDataFrame(asked, "query_id long, query string")
    for k, top in enumerate((1, 4)):
        wanted = {tuple(r) for r in retrieval.bm25(docs, questions, top=top).where("score is not null").collect()}
        assert {tuple(r) for r in keyword_scan.search(docs, questions, f"file://{tmp_path}/{k}", top=top).collect()} == wanted and len(wanted) > 30 * top
    asked_terms = pa.array([b"elvin", b"w0", b"w1", b"w9"], pa.binary())
    whole = [x.tolist() for x in keyword_scan.cells(texts, asked_terms)]
    monkeypatch.setattr(keyword_scan, "SOME", 3)
    assert [x.tolist() for x in keyword_scan.cells(texts, asked_terms)] == whole and len(whole[0]) > 50  # split into words some at a time
    nothing = keyword_scan.search(docs.limit(0), questions, f"file://{tmp_path}/e")
    assert nothing.count() == 0 and keyword_scan.search(docs, questions.limit(0), f"file://{tmp_path}/n").count() == 0


def test_fallback_builds_no_keyword_index(spark):
    """One round of questions does not have all words indexed for it."""
    from codeloom import queries
    from helpers import SMALL

    assert queries.QUERIES["vector_fallback"](spark, f"{SMALL}/").count() > 0
    assert (spark.sparkContext.applicationId, f"{SMALL}/", "keyword") not in queries.BUILT
