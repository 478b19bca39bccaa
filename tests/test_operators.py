"""Operators against small plain restatements, and golden cases."""

import ast
import math
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom import queries as engine
from codeloom.functions import text
from codeloom.operators import history, prompts, python_code, python_lint, python_spacing, retrieval, rules, triage, urls
from codeloom.plans import scan
from codeloom.sources import files as sources
from codeloom.sources import database, store, web
from codeloom.streaming import streams
from helpers import SMALL


def test_urls(spark):
    cases = {
        "https://github.com/o/r": ("repo", "main", None), "github.com/o/r.git": ("repo", "main", None), " https://github.com/o/r/ ": ("repo", "main", None),
        "https://github.com/o/r/blob/dev/a/b.py": ("single_file", "dev", "b.py"), "https://github.com/o/r/tree/dev/a/b": ("repo", "dev", None),
        "https://github.com/o/r/tree/dev": ("unknown", None, None), "https://raw.githubusercontent.com/o/r/dev/x.ts": ("single_file", "dev", "x.ts"),
        "http://github.com/o/r": ("unknown", None, None), "https://example.com/o/r": ("unknown", None, None), "": ("unknown", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.parse_url(F.col("u")).alias("p")).select("u", "p.*")
    assert {r.u: (r.type, r.branch, r.filename) for r in df.collect()} == cases


def test_triage_thresholds(spark):
    rows = [(10, 0, 100), (11, 0, 100), (0, 1, 100), (0, 0, 70), (0, 0, 69), (0, 0, 60), (0, 0, 61), (20, 4, 0)]
    df = spark.createDataFrame(rows, "c int, e int, s int").select("*", triage.flagged(F.col("c"), F.col("e"), F.col("s")).alias("f"), triage.priority(F.col("c"), F.col("e"), F.col("s")).alias("p"))
    assert [(r.f, r.p) for r in df.collect()] == [(c > 10 or e > 0 or s < 70, 3 * e + 2 * max(0, c - 10) + max(0, 70 - s) // 10) for c, e, s in rows]


def test_triage_of_missing_values(spark):
    df = spark.createDataFrame([(0, "a", None, None, None)], "ord int, path string, complexity int, errors array<string>, style_score int")
    row = triage.triage(df).first()
    assert (row.flagged, row.priority_score, row.error_count, row.style_score) == (False, 0, 0, 100)


def plain_bm25(docs, query, top):
    words = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in docs.items()}
    n, average = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    df = {}
    for w in words.values():
        for t in {*w}:
            df[t] = df.get(t, 0) + 1
    score = {}
    for k, w in words.items():
        score[k] = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / average)) for t in {*re.findall("[a-z0-9]+", query.lower())} if t in df)
    return [k for k in sorted(score, key=lambda k: (-round(score[k], 9), k))[:top] if score[k] > 0]


def test_bm25(spark):
    docs = {1: "the cat sat", 2: "the dog", 3: "cat cat dog bird", 4: "", 5: "the cat sat", 6: "nothing here"}
    asked = {1: "cat dog", 2: "the the", 3: "zebra", 4: " ?! ", 5: "SAT cat"}
    frame = spark.createDataFrame([*docs.items()], "doc_id int, text string")
    got = retrieval.bm25(frame, spark.createDataFrame([*asked.items()], "query_id int, query string"), top=3)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    assert found == {q: plain_bm25(docs, t, 3) for q, t in asked.items() if plain_bm25(docs, t, 3)} | {4: [1, 2, 3]}


def test_nearest_in_blocks(spark, monkeypatch):
    vectors = spark.range(40).selectExpr("id as vec_id", "array(cast(id * 7 % 11 as float), cast(id % 5 as float)) as embedding")
    asked = vectors.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as query")
    answer = lambda: sorted(map(tuple, retrieval.nearest(vectors, asked).collect()))
    whole = answer()
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)
    assert answer() == whole and len(whole) == 40
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    for query in range(0, 40, 4):
        near = sorted(rows, key=lambda k: (sum((a - b) ** 2 for a, b in zip(rows[k], rows[query], strict=True)), k))[:4]
        assert [k for _, k, _, _ in sorted((r for r in whole if r[0] == query), key=lambda r: r[3])] == near


def test_bm25_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert retrieval.bm25(empty, spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_line_chunks(spark):
    code = "\n".join(f"l{k}" for k in range(1, 66))
    df = spark.createDataFrame([("a", code), ("b", "  "), ("c", "one\n")], "path string, code string")
    got = [(r.path, r.ord, r.line, r.name, r.code.count("\n")) for r in retrieval.line_chunks(df).orderBy("path", "ord").collect()]
    assert got == [("a", 0, 1, "lines 1-60", 59), ("a", 1, 31, "lines 31-65", 34), ("a", 2, 61, "lines 61-65", 4), ("c", 0, 1, "lines 1-1", 0)]


SAMPLE = '''import os
from . import util
from a.b import c as d

class A(B):
    """Doc."""
    def m(self, x, *, k):
        def inner(y): return y
        return x and k or inner(1)

@wrap
async def f(a, /, b):
    async for i in b: pass
    for i in a:
        assert i
    with open("x") as g, g: pass
    try: pass
    except ValueError: pass
'''


def test_structure():
    got = python_code.structure(SAMPLE)
    assert [(f["name"], f["class"], f["args"]) for f in got["functions"]] == [("m", "A", ["self", "x"]), ("inner", "A", ["y"]), ("f", None, ["b"])]
    assert got["classes"] == [{"name": "A", "lineno": 5, "bases": ["B"], "docstring": "Doc."}]
    assert got["imports"] == [".util", "a.b.c", "os"]
    assert got["complexity"] == 1 + 2 + 1 + 1 + 1 + 1
    assert got["node_count"] == sum(1 for _ in ast.walk(ast.parse(SAMPLE)))
    assert got["functions"][2]["decorators"] == ["wrap"]


@pytest.mark.parametrize("code", ["def (", "a\x00b", "(" * 5000])
def test_structure_of_broken_code(code):
    assert python_code.structure(code)["syntax_ok"] is False
    assert python_code.flow(code) == {"nodes": [], "edges": []}


def test_pieces():
    got = [(p["name"], p["kind"], p["line"]) for p in python_code.pieces(SAMPLE)]
    assert got == [("A.m", "method", 7), ("A", "class", 5), ("f", "function", 12)]
    assert python_code.pieces("x = 1")[0]["kind"] == "file"


def edges(code):
    graph = python_code.flow(code)
    names = [n["label"] for n in graph["nodes"]]
    return names, [(e["src"], e["dst"], e["label"]) for e in graph["edges"]]


def test_flow_of_branches():
    names, found = edges("def f(a):\n    if a:\n        return 1\n    b = 2\n    while b:\n        b -= 1\n        break\n")
    assert names == ["START", "def f()", "if a", "return 1", "merge", "b = 2", "while b", "b -= 1", "break", "after loop", "END"]
    assert found == [(0, 1, ""), (1, 2, ""), (2, 3, ""), (2, 4, ""), (4, 5, ""), (5, 6, ""), (6, 7, ""), (7, 8, ""), (8, 6, "loop"), (6, 9, "exit"), (9, 10, ""), (3, 10, "")]


def test_flow_of_else_try_and_dead_code():
    names, found = edges("if a:\n    x\nelse:\n    raise b\ntry:\n    y\nexcept E:\n    z\nexcept:\n    raise\n")
    assert names == ["START", "if a", "x", "raise b", "merge", "try:", "y", "except merge", "except E", "z", "except Exception", "raise", "END"]
    assert (2, 4, "True") in found and (3, 12, "") in found and (9, 7, "") in found and (7, 12, "") in found and (11, 12, "") in found
    names, found = edges("def f():\n    return 1\n    x\n")
    assert names == ["START", "def f()", "return 1", "x", "END"] and (2, 3, "") not in found and (3, 4, "") in found


def codes(issues):
    return sorted({i["code"] for i in issues})


def test_python_errors():
    assert codes(python_lint.errors("import os\nimport sys\nprint(sys)\nprint(nope)\n")) == ["UndefinedName", "UnusedImport"]
    assert codes(python_lint.errors("def f(a):\n    b = 1\n    return a\ndef f(a):\n    return a\n")) == ["RedefinedWhileUnused", "UnusedVariable"]
    assert codes(python_lint.errors("return 1\nbreak\ncontinue\n")) == ["BreakOutsideLoop", "ContinueOutsideLoop", "ReturnOutsideFunction"]
    assert codes(python_lint.errors("def (")) == ["E999"]
    assert python_lint.errors("  ") == [] and python_lint.errors("x = [i for i in range(3)]\nprint(x)\n") == []


def test_python_style_and_security():
    assert codes(python_lint.style("import os, sys\nx = 1 \nif x == None: y = 2;\n\n")) == ["E401", "E701", "E703", "E711", "W291", "W391"]
    assert codes(python_lint.style("x = '" + "a" * 120 + "'")) == ["E501", "W292"]
    assert codes(python_lint.security("assert x\neval(y)\nsubprocess.run(z, shell=True)\npassword = 'a'\n")) == ["B101", "B105", "B307", "B602"]
    assert python_lint.maintainability("") == 100 and 0 <= python_lint.maintainability("x = 1 + 2\n") <= 100


@pytest.mark.parametrize(
    ("code", "wanted"),
    [
        ("f( a)\n", [(1, 3, "E201")]), ("f(a )\n", [(1, 4, "E202")]), ("f(a , b)\n", [(1, 4, "E203")]), ("f (a)\n", [(1, 2, "E211")]), ("x  = 1\n", [(1, 2, "E221")]),
        ("x =  1\n", [(1, 4, "E222")]), ("x=1\n", [(1, 2, "E225")]), ("if x in(1, 2):\n    pass\n", [(1, 8, "E225")]), ("f(a,b)\n", [(1, 5, "E231")]), ("f(a,  b)\n", [(1, 5, "E241")]),
        ("f(a = 1)\n", [(1, 4, "E251"), (1, 6, "E251")]), ("def f(a: int=1):\n    pass\n", [(1, 13, "E252")]), ("x = 1 # a\n", [(1, 6, "E261")]), ("x = 1  #a\n", [(1, 8, "E262")]),
        ("#a\n", [(1, 1, "E265")]), ("## a\n", [(1, 1, "E266")]), ("import  os\n", [(1, 7, "E271")]), ("x = 1\nimport os\n", [(2, 1, "E402")]), ("a = 1; b = 2\n", [(1, 6, "E702")]),
        ("if not a in b:\n    pass\n", [(1, 4, "E713")]), ("if not a is b:\n    pass\n", [(1, 4, "E714")]), ("x = type(a) == type(b)\n", [(1, 5, "E721")]), ("f = lambda x=1: x\n", [(1, 1, "E731")]),
        ("l = 1\n", [(1, 1, "E741")]), ("x = b'\\N'\n", [(1, 7, "W605")]), ("if a:\n  b = 1\n", [(2, 1, "E111")]), ("#!/bin/sh\n#: x\n", []), ("x = r'\\d'\n", []),
        ("def f(a: int = 1, *, b=2) -> int:\n    # note\n    return a[1:2, ::3]\n", []), ("x = f'{a:>10}{b!r}'\n", []), ("x = (\n    1,\n    2,\n)\nprint(*x, **y)\n", []),
        ("match x:\n    case [1, 2]:\n        pass\n", []), ('"""Text."""\nfrom __future__ import annotations\n__all__ = []\nimport os\n', []), ("x=(\n", []),
    ],
)
def test_python_spacing(code, wanted):
    assert [f[:3] for f in python_spacing.findings(code, python_code.parsed(code)[0])] == wanted


def test_python_shadows_and_suspicions():
    found = lambda code: [(i["line"], i["code"]) for i in python_lint.errors(code)]
    assert found("x = 1\ndef f():\n    print(x)\n    x = 2\n    return x\n") == [(3, "UndefinedLocal")]
    assert found("n = 0\ndef f():\n    n += 1\n    return n\ndef g():\n    global n\n    n += 1\ndef h(n):\n    n = n + 1\n    return n\n") == [(3, "UndefinedLocal")]
    assert found("import os\nfor os in range(3):\n    print(os)\n") == [(2, "ImportShadowedByLoopVar")]
    assert found("x = f'a'\nassert (x, 'y')\nif x is 'a':\n    raise NotImplemented\n") == [(1, "FStringMissingPlaceholders"), (2, "AssertTuple"), (3, "IsLiteral"), (4, "RaiseNotImplemented")]
    assert found("d = {'a': 1, 'a': 2, 'b': 3, 'b': 3}\n") == [(1, "MultiValueRepeatedKeyLiteral")] * 2
    assert found("try:\n    pass\nexcept ValueError as e:\n    pass\n") == [(3, "UnusedVariable")]


def test_python_security():
    code = '''import subprocess
from random import randint as r
import hashlib as h
def f(password="x", t="/tmp/a"):
    """0.0.0.0"""
    try:
        r(1, 2)
    except Exception:
        pass
    subprocess.run(["ls"])
    subprocess.run("ls " + t, shell=True)
    os.system(t)
    requests.get(u, verify=False)
    requests.get(u, timeout=3)
    os.chmod("a", 0o777)
    q = "select * from t where a = " + t
    h.md5(b"", usedforsecurity=False)
    h.md5(b"")
    login(token="abc", host="0.0.0.0")
    return f"delete from {t}"
'''
    wanted = [
        (1, "B404"), (4, "B107"), (4, "B108"), (7, "B311"), (8, "B110"), (10, "B603"), (10, "B607"), (11, "B602"), (12, "B605"), (13, "B113"), (13, "B501"), (15, "B103"),
        (16, "B608"), (18, "B324"), (19, "B104"), (19, "B106"), (20, "B608"),
    ]
    assert sorted((i["line"], i["code"]) for i in python_lint.security(code)) == wanted


@pytest.mark.parametrize("code", ["x = " + " + ".join(["a"] * 3000) + "\n", "f()" + "()" * 3000, "if f" + "()" * 3000 + ":\n    pass\n", "\0", "def g():\n\tif x:\n        y\n"])
def test_nesting_never_ends_a_job(code):
    made = python_lint.lint(code)
    assert 0 <= made["maintainability"] <= 100 and made["ast_info"]["line_count"] >= 1
    assert python_code.pieces(code) and "nodes" in python_code.flow(code)


def test_analyse_and_scan(spark):
    given = [(0, "a.py", "import os\n"), (1, "b.js", "var x = 1;\n"), (2, "c.md", None), (3, "d.py", "def (")]
    df = sources.named(spark.createDataFrame(given, "ord int, path string, code string"))
    got = {r.path: r for r in scan.scan(df).collect()}
    assert (got["a.py"].error_count, got["d.py"].error_count, got["b.js"].error_count, got["c.md"].flagged) == (1, 1, 0, False)
    assert got["b.js"].total_issues == 1 and got["d.py"].ast_info.syntax_ok is False
    assert {r.path: r.error_count for r in scan.scan(df, language_aware=False).collect()}["b.js"] == 1
    assert [r.path for r in scan.review_prompts(scan.scan(df)).orderBy("ord").collect()] == ["a.py", "d.py"]
    assert {(r.path, r.kind) for r in scan.index_chunks(df).collect()} == {("a.py", "file"), ("b.js", "block"), ("d.py", "file")}


def test_summaries(spark):
    issue = "struct<line:int,col:int,code:string,message:string,severity:string,category:string>"
    df = spark.createDataFrame([([(k, 1, "C", "m", "info", "style") for k in range(9)],), ([],), (None,)], f"i array<{issue}>")
    got = [r.x for r in df.select(prompts.issue_summary(F.col("i"), "T").alias("x")).collect()]
    assert got[0].split("\n")[0] == "T:" and got[0].endswith("  ... and 1 more") and got[0].count("\n") == 9
    assert got[1:] == ["T: None", "T: None"]
    assert df.limit(1).select(prompts.lint_summary(F.col("i"), F.slice("i", 1, 0)).alias("x")).first().x.startswith("Errors/Warnings (9):\n  Line 0: [C] m")


def test_syntax_summary_and_provider(spark):
    df = sources.named(spark.createDataFrame([(0, "a.py", SAMPLE), (1, "b.py", "def (")], "ord int, path string, code string"))
    got = [r.x for r in python_code.with_structure(df).orderBy("ord").select(prompts.syntax_summary(F.col("ast_info")).alias("x")).collect()]
    assert "Functions: 3 — ['m', 'inner', 'f']" in got[0] and got[1].startswith("Syntax error at line 1: ")
    replied = prompts.with_replies(df.select("ord", F.col("path").alias("prompt")), lambda xs: [x.upper() for x in xs])
    assert [r.reply for r in replied.orderBy("ord").collect()] == ["A.PY", "B.PY"]


def test_upsert_and_remove(spark):
    files = spark.createDataFrame([(0, "a", "1"), (1, "b", "2")], "ord int, name string, code string")
    new = spark.createDataFrame([(0, "b", "3"), (1, "c", "4"), (2, "c", "5")], "ord int, name string, code string")
    assert [(r.name, r.code) for r in history.upsert_by_name(files, new).orderBy("ord").collect()] == [("a", "1"), ("b", "3"), ("c", "5")]
    assert history.remove_file(files.where("name = 'a'"), "a").count() == 1
    assert [r.name for r in history.remove_file(files, "a").collect()] == ["b"]


def test_store(spark, tmp_path):
    snippets = store.Snippets(spark, str(tmp_path / "s"))
    assert snippets.latest().count() == 0 and snippets.delete(1) is False
    snippets.save(spark.createDataFrame([("x",), ("y",)], "title string"), "title")
    snippets.save(spark.createDataFrame([("z",)], "title string"), "title")
    assert [(r.id, r.title, r.language) for r in snippets.latest().collect()] == [(3, "z", "python"), (2, "y", "python"), (1, "x", "python")]
    assert snippets.delete(2) is True and [r.id for r in snippets.latest().collect()] == [3, 1]
    assert snippets.get(3).first().title == "z"
    log = store.Chat(spark, str(tmp_path / "c"))
    log.save(spark.createDataFrame([(3, "user", "hi", 0), (1, "user", "no", 1)], "snippet_id int, role string, content string, k int"), "k")
    assert [r.content for r in log.of(3).collect()] == ["hi"]
    index = store.ChunkIndex(spark, str(tmp_path / "i"))
    chunks = retrieval.line_chunks(spark.createDataFrame([("a.js", "x\n")], "path string, code string"))
    assert index.index("r1", chunks) == 1 and index.index("r2", chunks) == 1 and index.index("r1", chunks.unionByName(chunks)) == 2
    index.clear("r1")
    assert (index.of("r1").count(), index.of("r2").count()) == (0, 1)


def test_chunk_vectors(spark, tmp_path):
    """Vectors answer where there is an embedder; repositories of like names stay apart; without vectors, keywords answer."""
    embed = lambda texts: [[float(t.count(c)) for c in "xyz"] for t in texts]
    chunks = retrieval.line_chunks(spark.createDataFrame([("1.js", "xxx\n"), ("2.js", "yyyy\n"), ("3.js", "zz zz\n")], "path string, code string"))
    asked = spark.createDataFrame([(1, "yyy"), (2, "zz")], "query_id int, query string")
    index = store.ChunkIndex(spark, str(tmp_path / "v"), embed)
    assert index.index("a/b", chunks) == 3 and index.index("a_b", chunks.where("path = '1.js'")) == 1
    assert {(r.query_id, r.chunk_key) for r in index.search("a/b", asked, top=1).collect()} == {(1, "2.js::L1"), (2, "3.js::L1")}
    assert {r.chunk_key for r in index.search("a_b", asked, top=1).collect()} == {"1.js::L1"}
    plain = store.ChunkIndex(spark, str(tmp_path / "w"))
    assert plain.index("r", chunks) == 3
    assert {(r.query_id, r.chunk_key) for r in plain.search("r", asked).collect()} == {(2, "3.js::L1")}
    index.clear("a/b")
    assert index.of("a/b").count() == 0 and index.of("a_b").count() == 1


def test_database(spark, tmp_path):
    """An embedded database that comes with Spark: written, read in stretches, replaced."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("id as ID", "concat('t', id) as TITLE", "cast(id % 7 as int) as N")
    database.write(rows, url, "SNIPPET", tasks=2, createTableColumnTypes="TITLE varchar(100)", **options)
    database.write(spark.range(100, 110).selectExpr("id as ID", "'new' as TITLE", "0 as N"), url, "SNIPPET", **options)
    got = database.read(spark, url, "SNIPPET", '"ID"', 4, **options)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 110
    assert [r.ID for r in got.where("TITLE = 'new'").orderBy("ID").collect()] == [*range(100, 110)]
    database.write(rows.limit(0), url, "SNIPPET", mode="overwrite", **options)
    assert database.read(spark, url, "SNIPPET", '"ID"', 4, **options).count() == 0
    assert database.address("postgresql://h/d", "x") == database.address("postgres://h/d", "x") == "jdbc:postgresql://h/d"
    assert database.connection("postgresql+asyncpg://me:p%40ss@h:1/d", "x") == ("jdbc:postgresql://h:1/d", {"user": "me", "password": "p@ss"})
    assert database.connection("sqlite:///a.db", "x") == ("jdbc:sqlite:a.db", {}) and database.connection("sqlite:////t/a.db", "x")[0] == "jdbc:sqlite:/t/a.db"
    assert database.address(None, "x") == database.address("postgresql://<user>@h/d", "x") == "x" and database.address("jdbc:a:b", "x") == "jdbc:a:b"


def test_file_sources(spark, tmp_path):
    (tmp_path / "d/node_modules").mkdir(parents=True)
    for name, body in {"a.py": b"x = 1\n", "b.bin": b"\xff\xfe", "d/c.js": b"var a\n", "d/node_modules/e.js": b"1", "f.md": b"\xff\xff"}.items():
        (tmp_path / name).write_bytes(body)
    assert {r.path for r in sources.list_files(spark, str(tmp_path)).collect()} == {"a.py", "d/c.js", "f.md"}
    got = {r.path: r for r in sources.read_files(spark, str(tmp_path)).collect()}
    (tmp_path / "long.js").write_bytes(b"x" + "é".encode() * 200_000)
    (tmp_path / "long.bin").write_bytes(b"\xff" * 300_000)
    longer = {r.path: r for r in sources.read_files(spark, str(tmp_path)).collect()}
    assert longer["long.js"].code == "x" + "é" * 102_399 and longer["long.bin"].fetch_error == "Binary file" and longer.keys() == got.keys() | {"long.js", "long.bin"}
    assert got["a.py"].code == "x = 1\n" and got["f.md"].code is None and got["f.md"].fetch_error == "Binary file"


def test_web_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, body = {"/ok": (200, b'{"a": 1}'), "/limit": (403, b'{"message": "API rate limit exceeded"}'), "/gone": (404, b"{}")}.get(self.path, (500, b"oops"))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    web.register(spark)
    rows = spark.read.format("web").option("urls", f"{base}/ok {base}/limit {base}/gone {base}/bad http://127.0.0.1:9/x").load().collect()
    server.shutdown()
    got = {r.url.rsplit("/", 1)[-1]: (r.ok, r.status, r.body or r.error) for r in rows}
    assert got["ok"] == (True, 200, '{"a": 1}') and got["limit"] == (False, 403, web.RATE_LIMIT) and got["gone"] == (False, 404, web.NOT_FOUND)
    assert got["bad"] == (False, 500, "oops") and got["x"][2].startswith("Network error")
    assert web.headers("t")["Authorization"] == "Bearer t"


def test_tree_and_raw_files(spark):
    tree = b'{"tree": [{"path": "a.py", "type": "blob", "size": 5}, {"path": "node_modules/b.js", "type": "blob", "size": 1}], "truncated": true}'
    pages = {"/repos/o/new/git/trees/main?recursive=1": tree, "/repos/o/old/git/trees/master?recursive=1": tree, "/raw/o/new/main/a%20b.py": b"x" * 10 + "é".encode() * 5, "/raw/o/new/main/c.bin": b"\xff\xfe"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path in pages else 404)
            self.end_headers()
            self.wfile.write(pages.get(self.path, b"{}"))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    web.register(spark)
    rows = spark.read.format("tree").option("repositories", "o/new o/old o/none").option("api", base).load()
    got = {(r.repository, r.path): (r.branch, r.truncated, r.error) for r in rows.collect()}
    raw = spark.read.format("web").option("urls", web.raw_addresses("o/new", "main", ["a b.py", "c.bin"], f"{base}/raw")).option("longest", "13").load().collect()
    listed = sources.named(rows.where("path is not null"))
    assert {r.path for r in listed.where(triage.in_tree(F.col("path"), F.col("type"), F.col("size"), F.col("language"))).collect()} == {"a.py"}
    server.shutdown()
    assert got["o/new", "a.py"] == ("main", True, None) and got["o/old", "a.py"] == ("master", True, None) and got["o/none", None] == (None, False, web.NOT_FOUND)
    assert {r.url.rsplit("/", 1)[-1]: (r.body, r.error) for r in raw} == {"a%20b.py": ("x" * 10 + "é", None), "c.bin": (None, "Binary file")}


def test_numbers_of_any_amount(spark):
    old = spark.createDataFrame([(7,)], "id long")
    rows = spark.range(5000).selectExpr("case when id % 10 = 0 then null else id * id end as k", "cast(id as string) as s")
    for order in ("k", "s"):
        got = history.numbered_after(rows, old, order).orderBy("id").collect()
        assert [r.id for r in got] == [*range(8, 5008)]
        values = [r[order] for r in got]
        assert values == sorted(values, key=lambda v: (v is not None, v))
    assert history.numbered_after(rows.where("false"), old, "k").count() == 0


def test_new_and_renamed_files(spark):
    files = spark.createDataFrame([(0, "untitled_1.py", "1"), (4, "untitled_3.py", "2")], "ord int, name string, code string")
    made = history.with_new_file(files)
    assert [(r.ord, r.name, r.code) for r in made.orderBy("ord").collect()][-1] == (5, "file_3.py", "")
    assert [r.name for r in history.with_new_file(files.where("false")).collect()] == ["file_1.py"]
    assert "file_4.py" in {r.name for r in history.with_new_file(files.withColumn("name", F.expr("if(ord = 4, 'file_3.py', name)"))).collect()}
    assert {r.name for r in history.renamed(files, "untitled_1.py", "a.py").collect()} == {"a.py", "untitled_3.py"}
    assert {r.name for r in history.renamed(files, "untitled_1.py", "untitled_3.py").collect()} == {"untitled_1.py", "untitled_3.py"}


def test_base64(spark):
    df = spark.createDataFrame([("aGVs\nbG8=\n",), ("not base64!",), (None,), ("//79",)], "b string")
    assert df.limit(1).select(text.to_base64(F.lit("é")).alias("x"), text.data_uri(F.lit(b"ab")).alias("y")).first() == ("w6k=", "data:image/png;base64,YWI=")
    assert [r.x for r in df.select(text.from_base64(F.col("b")).alias("x")).collect()] == ["hello", None, None, None]


def test_replacement_after_a_crash(spark, tmp_path):
    kept = store.Table(spark, str(tmp_path / "t"), "id int")
    kept.append(spark.createDataFrame([(1,)], "id int"))
    (tmp_path / "t/new").mkdir()
    (tmp_path / "t/new-left").mkdir()
    kept.replace(kept.read().selectExpr("id + 1 as id"))
    assert [r.id for r in kept.read().collect()] == [2] and kept.version() == 2


def test_texts_for_failures(spark):
    df = spark.createDataFrame([("Model x not found", "ollama"), ("quota", "groq"), ("boom", "groq")], "m string, b string")
    got = [r.x for r in df.select(prompts.error_text(F.col("m"), F.col("b"), F.lit("tiny")).alias("x")).collect()]
    assert "ollama pull tiny" in got[0] and "quota" in got[1] and "boom" in got[2] and "GROQ_API_KEY" in prompts.no_backend_text()


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    run = streams.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination()
    key = lambda df: {(r.window_start, r.event_type, r.n) for r in df.collect()}
    assert key(spark.table("windows")) == key(streams.event_windows(events))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from codeloom import queries
    from helpers import SMALL

    top = plan_of(queries.QUERIES["triage_top"](spark, SMALL))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top and "Python" not in top
    assert "o_totalprice" not in top  # columns that nothing needs are not read
    assert "WindowGroupLimit" in plan_of(queries.QUERIES["knn_top"](spark, SMALL))
    assert "Exchange" not in plan_of(queries.QUERIES["line_rules"](spark, SMALL))
    for name, sign in (("line_rules", "LINE_LEN"), ("triage_top", "LINE_LEN"), ("scan_display", "LINE_LEN"), ("clean_files", "LINE_LEN"), ("py_errors", "ArrowEvalPython"), ("functions", "ArrowEvalPython"), ("cfg_edges", "ArrowEvalPython"), ("repo_scan_literal", "ArrowEvalPython")):
        assert plan_of(queries.QUERIES[name](spark, SMALL)).count(f"{sign} [" if sign.startswith("Arrow") else sign) == 1, name  # rules and Python run once
    assert "LINE_LEN" not in plan_of(queries.QUERIES["js_rules"](spark, SMALL))
    for name in ("repo_scan", "index_repo"):  # two tables of files, each read once
        assert plan_of(queries.QUERIES[name](spark, SMALL)).count("FileScan") == 2, name
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,5)]" in plan_of(queries.QUERIES["chat_by_id"](spark, SMALL))


def test_display_runs_what_it_shows_once(spark):
    """A sort of all rows samples its input; what the columns are made of must not run twice for that."""
    ran = spark.sparkContext.accumulator(0)

    def score(k):
        ran.add(1)
        return k % 100

    made = spark.range(1000).select(
        F.col("id").cast("int").alias("ord"), F.concat(F.lit("p"), "id").alias("path"), F.lit("f").alias("filename"), F.lit(0).alias("complexity"), F.lit(0).alias("error_count"),
        F.udf(score, "int")("id").alias("style_score"), (F.col("id") % 2 == 0).alias("flagged"), F.lit(1).alias("priority_score"),
    )
    shown = triage.display(made).collect()
    assert ran.value == 1000 and [r.flagged for r in shown] == [True] * 500 + [False] * 500 and [r.ord for r in shown[:3]] == [0, 2, 4]


def test_checks_run_only_where_asked(spark, monkeypatch):
    """A query of one list of findings runs the check that makes it; the rows are those of all checks together."""
    codes = ["import os\nif x == None:\n    assert x\n", "def f(:\n", "", "def f(a):\n" + "    if a:\n        a = 1\n" * 7]
    files = spark.createDataFrame([*enumerate(codes)], "file_id int, code string")
    whole = {r.file_id: r for r in python_lint.with_lint(files).collect()}
    for column in ("errors", "style_issues", "style_score", "security_issues", "complexity_issues", "maintainability", "ast_info"):
        one = python_lint.with_lint(files, column)
        assert {r.file_id: r[column] for r in one.collect()} == {k: r[column] for k, r in whole.items()}
    assert python_lint.with_lint(files, "errors").columns == ["file_id", "code", "errors"]
    called = []
    monkeypatch.setattr(python_lint, "style", lambda *a: called.append(a) or [])
    assert [*python_lint.lint(codes[0], ["errors"])] == ["errors"] and not called


def test_narrow_tables_are_spread(spark):
    """Files made of a table of one small file are made in many tasks."""
    assert spark.read.parquet(f"{SMALL}/customer.parquet").rdd.getNumPartitions() < 4
    for made in (engine.python_files(spark, SMALL), engine.corpus(spark, SMALL)):
        sizes = made.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < made.count() / 2


def test_cached_walk_is_ast_walk():
    tree = ast.parse(Path(python_lint.__file__).read_text())
    assert python_code.walk(tree) == [*ast.walk(tree)] == python_code.walk(tree)
    assert python_code.walk(tree.body[-1]) == [*ast.walk(tree.body[-1])]


def test_ends_of_lines_of_any_kind(spark):
    codes = ["a \nb", "a\n", "a\r\nb\r\n", "a \x0bb\u2028c\u00a0", "\n", "", None, " \t\n", "a\n\n", "TODO\x85x\u3000\x85", "a \r"]
    rows = spark.createDataFrame([*enumerate(codes)], "k int, code string")
    out = rows.select("k", text.split_lines(F.col("code")).alias("l"), text.is_blank(F.col("code")).alias("b"), rules.generic_issues(F.col("code"), text.split_lines(F.col("code"))).alias("i"))
    for r in out.collect():
        code = codes[r.k] or ""
        lines = code.splitlines()
        assert r.l == lines and r.b == (not code.strip())
        wanted = [(n, "TRAIL_WS") for n, x in enumerate(lines, 1) if x != x.rstrip()] + [(n, "TODO") for n, x in enumerate(lines, 1) if "TODO" in x]
        assert [(i.line, i.code) for i in r.i] == wanted


def test_definitions_are_found_without_expressions():
    """nodes in which no definition can stand are not looked at; functions keep their order and class."""
    tree = ast.parse(SAMPLE + "class A:\n    def f(self):\n        if self.x:\n            def g(): return [i for i in 'ab']\n        class B:\n            async def h(self): pass\n")
    assert not any(isinstance(n, ast.expr | ast.arguments) for n, _ in python_code.outline(tree))
    named = [(n.name, owner) for n, owner in python_code.outline(tree) if isinstance(n, python_code.FUNCTIONS)]
    assert named[-3:] == [("f", "A"), ("g", "A"), ("h", "B")]


def test_nearest_function_is_that_of_a_walk():
    """expressions are not looked at for it."""
    codes = [SAMPLE, Path(python_lint.__file__).read_text(), "x = [lambda: 1]\n", "if a:\n    def deep(): pass\nmatch a:\n    case 1:\n        def far(): pass\n", "try:\n    pass\nexcept E:\n    def f(): pass\nclass A:\n    class B:\n        def g(self): pass\n"]
    for tree in map(ast.parse, codes):
        assert python_code.nearest(tree) is next((n for n in ast.walk(tree) if isinstance(n, python_code.FUNCTIONS)), None)


def test_errors_walk_little_more_than_once(monkeypatch):
    """the checks share what was walked."""
    code = "import os\n\n\n" + "def f(a):\n    b = [a + i for i in a]\n    for c in b:\n        print(c, a)\n    return {'k': b}\n\n\n" * 20
    called, below = [], python_code.children
    monkeypatch.setattr(python_code, "children", lambda n: called.append(n) or below(n))
    assert len(python_lint.errors(code)) == 20  # the import, and a function that comes again
    assert len(called) < 3 * sum(1 for _ in ast.walk(ast.parse(code)))


def test_style_looks_up_no_patterns(monkeypatch):
    """a line meets only the patterns that it may match, made beforehand."""
    code = "import os, sys\ntry:\n    x = 1;\nexcept:\n    y = x == None or x != True\nif x: y = 2\ndef f(): pass\n"
    monkeypatch.setattr(python_lint, "re", None)
    assert {"E401", "E703", "E722", "E711", "E712", "E701", "E302"} <= {i["code"] for i in python_lint.style(code)}


def test_scan_asks_for_numbers(spark):
    """complexity and score go without the lists that they count, and are those of the lists."""
    codes = ["import os\nif x == None:\n    assert x and os\n", "def f(:\n", "", None, " \n", "def f(a):\n" + "    if a:\n        a = 1\n" * 7, "@" + "(" * 60 + "a" + ")" * 60 + "\ndef f(): pass\n"]
    files = spark.createDataFrame([*enumerate(codes)], "file_id int, code string")
    few = python_lint.with_lint(files, *scan.SHOWN)
    assert few.columns == ["file_id", "code", "errors", "complexity", "style_score"]
    whole = {r.file_id: r for r in python_lint.with_lint(files).collect()}
    assert {r.file_id: (r.errors, r.complexity, r.style_score) for r in few.collect()} == {k: (r.errors, r.ast_info.complexity, r.style_score) for k, r in whole.items()}


def test_chunks_of_other_files_meet_no_parser(spark, monkeypatch):
    """of a file that is no Python nothing is parsed, and no chunk is made that another one replaces."""
    given, column = [], python_code.python_column
    monkeypatch.setattr(python_code, "python_column", lambda name, analyse, schema: given.append(analyse) or column(name, analyse, schema))
    files = spark.createDataFrame([(0, "a.py", "x = 1\n"), (1, "b.js", "var x;\n")], "ord int, path string, code string")
    assert [(r.path, r.kind) for r in scan.index_chunks(files).orderBy("path").collect()] == [("a.py", "file"), ("b.js", "block")]
    assert given[0]("") == [] and given[0]("x = 1\n") == python_code.pieces("x = 1\n")


def test_pieces_are_whole(spark):
    """Functions, classes and modules longer than some thousand characters keep their ends, also behind a form feed."""
    body = "".join(f"    value_{k} = {k}\n" for k in range(400))
    code = f"x = '\x0c'\n\ndef long(a):\n{body}    return 'last'\n\nclass Long:\n    def m(self):\n{body.replace('    ', '        ')}        return 'end'\n"
    found = {p["name"]: p["code"] for p in python_code.pieces(code)}
    assert found["long"] == f"def long(a):\n{body}    return 'last'"
    assert found["Long.m"].startswith("    def m") and found["Long.m"].endswith("return 'end'") and len(found["Long"]) > 8000
    module = "x = 1\n" * 2000
    rows = {"a.py": code, "b.py": module}
    chunks = python_code.python_chunks(spark.createDataFrame([*rows.items()], "path string, code string")).collect()
    assert {(r.name, r.text) for r in chunks} == {(n, f"a.py {n} {c}") for n, c in found.items()} | {("module", f"b.py module {module}")}


def test_issue_counts(spark):
    """Counted as arrays, ASCII or not, issues are those of the rules: by code their number, first and last line, after the cap."""
    import random

    from codeloom.operators import rule_counts

    rng = random.Random(5)
    parts = ["var x = 1", " var\ty;", "var", "if (a == b) {", "a ===b", "==c ", " a ==", "console.log(", "todo", "FixMe hack", "xXx", "'(", '"[', '"', "}", "]", " ", "\t", "\x1f", "\x00", "x" * 121, "y" * 120, "\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x1c"]
    odd = ["\x85", " ", " ", "K", "ﬁxme", "ı", "é" * 121]
    codes = ["".join(rng.choices(parts + (odd if k % 4 == 0 else []), k=rng.randint(0, 120))) for k in range(600)] + [None, "", " \n\t", "\n", "\x1f\n", "x" * 130 + " \n", ("t" * 121 + " \n") * 40 + "todo\n(", "a \n" * 60, "hack\n" * 60 + "TODO"]
    rows = [(k, c, ["javascript", "typescript", "go", "", None][k % 5]) for k, c in enumerate(codes)]
    files = spark.createDataFrame(rows, "file_id long, code string, language string").repartition(3)
    plain = rules.issue_rows(rules.with_rules(files), "style_issues", "file_id").groupBy("file_id", "code").agg(F.count("*"), F.min("line"), F.max("line"))
    counted = rules.exploded(rule_counts.with_issue_counts(files), "issue_counts", "ord", "file_id").select("file_id", "_i.*")
    wanted, got = ({tuple(r) for r in df.collect()} for df in (plain, counted))
    assert wanted == got and len(got) > 2000


def test_capped_issues_are_no_rows(spark):
    """The issues of issue_cap50 are counted where the text lies; ASCII texts do not meet the rules' expressions line by line."""
    from codeloom import queries

    plan = plan_of(queries.QUERIES["issue_cap50"](spark, SMALL))
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("LINE_LEN") == 1
