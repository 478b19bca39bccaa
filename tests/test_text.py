"""Text primitives against plain Python on seeded random strings."""

import json
import random
import re

from pyspark.sql import functions as F

from codeloom.functions import json as replies
from codeloom.functions import text
from codeloom.operators import rules


def frame(spark, values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")


def column(df, made):
    return [r.x for r in df.select("k", made.alias("x")).orderBy("k").collect()]


def strings(letters, n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_lines_strip_and_blank(spark):
    given = ["", "\n", "a\n\n", "a\r\nb\r", "a\x0bb\x85c\u2028 ", *strings("ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000", 2000, 12, 1)]
    df = frame(spark, given)
    assert column(df, text.split_lines(F.col("t"))) == [g.splitlines() for g in given]
    assert column(df, text.strip(F.col("t"))) == [g.strip() for g in given]
    assert column(df, text.rstrip(F.col("t"))) == [g.rstrip() for g in given]
    assert column(df, text.is_blank(F.col("t"))) == [not g.strip() for g in given]


def test_null_text_is_empty(spark):
    df = frame(spark, [None])
    assert column(df, text.split_lines(F.col("t"))) == [[]]
    assert column(df, text.tokens(F.col("t"))) == [[]]
    assert column(df, text.is_blank(F.col("t"))) == [True]


def test_tokens(spark):
    given = strings("aB9_é.-  \n", 500, 15, 2)
    assert column(frame(spark, given), text.tokens(F.col("t"))) == [re.findall("[a-z0-9]+", g.lower()) for g in given]


def net(code, opening, closing):
    quote, n = "", 0
    for ch in code:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        else:
            n += (ch == opening) - (ch == closing)
    return n


def test_bracket_nets(spark):
    given = strings("()[]{}\"'ab\n\\", 2000, 15, 3)
    df = frame(spark, given)
    for (a, b), (_, col) in zip(rules.BRACKETS, rules.bracket_nets(F.col("t")).items(), strict=True):
        assert column(df, col) == [net(g, a, b) for g in given]


def recover(reply):
    for found in (reply.strip(), *(m.group(1) for m in [re.search(r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", reply)] if m), *(m.group(0) for m in [re.search(r"\{[\s\S]*\}", reply)] if m)):
        try:
            return json.loads(found)
        except json.JSONDecodeError:
            continue
    return None


def test_recovered_json(spark):
    given = ['{"a": 1}', ' {"a": 1} ', 'x ```json\n{"a": 2}\n``` y', 'so {"a": {"b": 3}} ok', "{", "", "[1, 2]", "a } b {", '```\n{"a": 4}\n```', '{"a": 1} {"b": 2}']
    got = column(frame(spark, given), replies.recovered_json(F.col("t")))
    assert [None if g is None else json.loads(g) for g in got] == [recover(g) for g in given]


def test_terminal_text(spark):
    df = spark.createDataFrame([("o", "e", 1, False), ("", "e", 0, False), ("", "", 0, False), ("o", "e", 0, False), ("", "", 2, True)], "o string, e string, c int, t boolean")
    got = [r.x for r in df.select(text.terminal_text(F.col("o"), F.col("e"), F.col("c"), F.col("t")).alias("x")).collect()]
    assert got == ["o\n--- stderr ---\ne\n[Process exited with code 1]", "e", "(no output)", "o", ""]


def test_rules_order_and_cap(spark):
    code = "\n".join(["x" * 130 + " "] * 40 + ["(", "TODO fixme"])
    df = spark.createDataFrame([(1, code, "go"), (2, "   ", "go"), (3, "var a == b; console.log(1)\n", "javascript"), (4, None, "go")], "k int, code string, language string")
    got = {r.k: r for r in rules.with_rules(df).collect()}
    assert [i.code for i in got[1].style_issues] == [c for _ in range(10) for c in ("LINE_LEN", "TRAIL_WS")] + ["LINE_LEN"] * 30
    assert got[1].errors == [] and got[1].style_score == 0
    assert (got[2].style_issues, got[2].style_score, got[4].style_score) == ([], 100, 100)
    assert [i.code for i in got[3].style_issues] == ["NO_VAR", "CONSOLE_LOG", "LOOSE_EQ"]
    assert got[3].style_score == 91
