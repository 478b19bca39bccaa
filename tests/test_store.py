"""Versions of tables: concurrent writers, writes that break off, deletes that touch few parts, outliers in numbering."""

import random
import threading

import pytest

from codeloom.operators import history
from codeloom.sources import store

ID = "id int"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_second_replacement_is_refused(spark, tmp_path):
    """Of two writers that have read the same version, one publishes; the other is told, and nothing of it is seen."""
    a, b = store.Table(spark, str(tmp_path / "t"), ID), store.Table(spark, str(tmp_path / "t"), ID)
    a.append(spark.range(3).selectExpr("int(id) id"))
    base, before = b.version(), b.read()
    a.replace(spark.range(5).selectExpr("int(id) id"))
    with pytest.raises(store.Conflict):
        b.replace(spark.range(7).selectExpr("int(id) id"), base)
    assert ids(a.read()) == [0, 1, 2, 3, 4]
    assert ids(before) == [0, 1, 2]  # what was read before stays readable
    assert len(list((tmp_path / "t/data").iterdir())) == 2  # the refused part is gone


def test_published_names_are_taken(spark, tmp_path):
    """Two that publish the same version at the same moment: the name is created once."""
    t = store.Table(spark, str(tmp_path / "t"), ID)
    done = []

    def write(k):
        done.append(t._create(f"{t.folder}/log/1.json", f'{{"parts": ["{k}"]}}'))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(done) == [False] * 7 + [True] and t.version() == 1 and len(list((tmp_path / "t/log").iterdir())) == 1


def test_concurrent_saves_lose_nothing(spark, tmp_path):
    """Saves from several threads: all rows are there, each with an id of its own."""
    snippets = store.Snippets(spark, f"file://{tmp_path}/s")
    failed = []

    def save(k):
        try:
            snippets.save(spark.createDataFrame([(f"{k}-{j}",) for j in range(5)], "title string"), "title")
        except store.Conflict:
            failed.append(k)

    threads = [threading.Thread(target=save, args=(k,)) for k in range(3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    got = snippets.read().collect()
    assert sorted(r.id for r in got) == [*range(1, 16 - 5 * len(failed))]
    assert {r.title for r in got} == {f"{k}-{j}" for k in range(3) for j in range(5) if k not in failed}


def test_broken_write_is_not_seen(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ID)
    t.append(spark.range(3).selectExpr("int(id) id"))
    with pytest.raises(Exception, match="raise_error|boom"):
        t.append(spark.range(3).selectExpr("if(id = 2, raise_error('boom'), int(id)) id"))
    t.stage(spark.range(9).selectExpr("int(id) id"))  # a writer that is killed before it publishes
    assert ids(t.read()) == [0, 1, 2] and t.version() == 1
    assert t.vacuum() == [] and len(t.vacuum(hours=0)) == 2 and ids(t.read()) == [0, 1, 2]


def test_deletes_touch_few_parts(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), ID)
    for k in range(3):
        t.append(spark.range(10 * k, 10 * k + 10).selectExpr("int(id) id"))
    before = t.parts(3)
    assert t.delete_rows([11, 12, 99]) == 2 and t.delete_rows([99]) == 0
    assert [p in t.parts(4) for p in before] == [True, False, True] and t.version() == 4
    assert ids(t.read()) == [k for k in range(30) if k not in (11, 12)] and ids(t.read(3)) == [*range(30)]


def test_numbers_despite_outliers(spark):
    """20,000 values and one of 10^15; equal values; texts. Parts of the numbering stay even."""
    rows = spark.range(20_000).selectExpr("if(id = 77, 1000000000000000, id % 5000) k", "concat('s', id % 300) s", "id given")
    old = spark.createDataFrame([(7,)], "id long")
    for order in ("k", "s"):
        made = history.numbered_after(rows, old, order)
        got = made.orderBy("id").collect()
        assert [r.id for r in got] == [*range(8, 20_008)]
        assert [r[order] for r in got] == sorted(r[order] for r in got)
    rng = random.Random(1)
    few = spark.createDataFrame([(None if rng.random() < 0.3 else rng.randrange(3),) for _ in range(50)], "k int")
    assert ids(history.numbered_after(few, old, "k")) == [*range(8, 58)]


def test_parts_of_numbering_are_even(spark):
    for k in ("if(id = 77, 1000000000000000, id)", "if(id % 3 = 0, 5, id)", "if(id % 2 = 0, null, id)"):
        sizes = history.parted(spark.range(20_000).selectExpr(f"{k} k", "id"), "k").groupBy("_part").count().collect()
        assert 100 < len(sizes) <= 256 and max(r["count"] for r in sizes) < 1000
