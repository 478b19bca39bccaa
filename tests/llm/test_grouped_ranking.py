"""Operator 11: ranks with ties, against a brute-force version; splitting of hot pairs; odd rows."""

import datetime as dt
import math
import random
import zlib

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from codeloom.llm import grouped_ranking

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def last(*values):
    return tuple(x for v in values for x in (v is None, v or 0))


def plain_ranks(rows, top=5):
    """Rows (group, pair, order) of dicts, ranked by sorting each group whole."""
    groups = {}
    for group, pair, order in rows:
        groups.setdefault(group, []).append((last(*pair), last(*order), pair, order))
    out = []
    for group, lines in groups.items():
        lines.sort(key=lambda x: x[:2])
        pairs = sorted({x[0] for x in lines})
        for pos, (p, _, pair, order) in enumerate(lines, 1):
            if (place := pairs.index(p) + 1) <= top:
                out.append((*group, *pair, *order, place, pos, sum(x[0] == p for x in lines)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("top", "chunk", "fan"), [(5, 2000, 64), (5, 3, 2), (2, 7, 4), (1, 1, 3)])
def test_ranked_equals_sorting(spark, top, chunk, fan):
    """One group and one pair hold a third of all rows; many rows are equal; nulls everywhere."""
    rng, rows = random.Random(5), []
    some = lambda n: None if rng.random() < 0.1 else rng.randrange(n)
    for k in range(900):
        hot = k % 3 == 0
        rows.append(((7, 1) if hot else (some(5), some(2)), (0, 3) if k % 6 == 0 else (some(3), some(4)), (some(4), some(3))))
    flat = [(*g, *p, *o) for g, p, o in rows]
    df = spark.createDataFrame(flat, "a long, b long, p long, q long, x long, y long").repartition(5)
    got = grouped_ranking.ranked(df, ["a", "b"], ["p", "q"], ["x", "y"], top=top, chunk=chunk, fan=fan)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_ranks(rows, top)


def test_equal_rows_in_one_pair_are_split(spark):
    """5,000 rows equal in all columns: buckets are parted by the rows' own numbers."""
    df = spark.range(5000, numPartitions=3).select(F.lit(1).alias("g"), F.lit(2).alias("p"), F.lit(3).alias("o"))
    got = grouped_ranking.ranked(df, ["g"], ["p"], ["o"], chunk=200, fan=4)
    assert [r.pos for r in got.orderBy("pos").collect()] == list(range(1, 5001))
    assert got.select("place", "tied").distinct().collect() == [(1, 5000)]


def test_rows_are_pruned_before_the_shuffle(spark):
    plan = grouped_ranking.pruned(spark.read.parquet(f"{SMALL}/sale_lines.parquet"), ["vendor_id"], ["quantity"], 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def plain_sale_lines(rows):
    half_up = lambda x: None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)
    out = []
    for sale_id, line_no, item_id, vendor_id, quantity, amount, discount, _, shipped_at in rows:
        one = sale_id is not None and zlib.crc32(str(sale_id).encode()) % 5 == 0
        group = (-1, -1, -1) if one else (vendor_id, -1 if item_id is None else item_id % 2, -1 if shipped_at is None else 100 * shipped_at.year + shipped_at.month)
        out.append((group, (None if quantity is None else -(quantity // 10), half_up(discount)), (sale_id, line_no, quantity, half_up(amount))))
    return [(v, p, m, pos, place, s, n, q, percent, cents, tied) for v, p, m, _, percent, s, n, q, cents, place, pos, tied in plain_ranks(out)]


def test_sale_lines_odd_rows(spark):
    rng, rows = random.Random(6), []
    maybe = lambda v: None if rng.random() < 0.15 else v
    for _ in range(400):
        rows.append((
            maybe(rng.randrange(30)), maybe(rng.randrange(3)), maybe(rng.randrange(-4, 5)), maybe(rng.randrange(3)), maybe(rng.randrange(-25, 60)),
            maybe(rng.choice([1.005, 2.5, math.nan, math.inf, -3.14])), maybe(rng.choice([0.0, 0.05, 0.07, math.nan])), None, maybe(dt.datetime(2024, rng.randrange(1, 4), 3)),
        ))
    rows += rows[:100] + [(None,) * 9] * 3
    df = spark.createDataFrame(rows, LINES).withColumns({"pos": F.lit("x"), "tied": F.lit(1.5), "__cl_id": F.lit(None), "tens": F.lit(0)})
    for chunk in (2000, 10):
        got = grouped_ranking.sale_lines_ranked(df, chunk=chunk, fan=4)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_sale_lines(rows), key=repr)
    assert {t for _, t in got.dtypes} == {"bigint"}


def test_no_rows_and_taken_names(spark):
    assert grouped_ranking.sale_lines_ranked(spark.createDataFrame([], LINES)).count() == 0
    with pytest.raises(ValueError, match="pos"):
        grouped_ranking.ranked(spark.range(1).selectExpr("id pos", "id p", "id o"), ["pos"], ["p"], ["o"])
