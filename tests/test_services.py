"""Replies under quotas, fetching by rows, joins along time, rollups of sketches, memories of chats as state."""

import collections
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from codeloom.operators import history, rollups, temporal
from codeloom.sources import fetch, replies
from codeloom.streaming import memory


def test_bucket_keeps_its_rate():
    now = [0.0]
    bucket = replies.Bucket(2.0, 3, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(23):
        bucket.take()
    assert 9.9 < now[0] < 10.1  # three at once, then two a second


def test_only_refusals_are_tried_again():
    free, waits = replies.Bucket(1e9, 1e9), []

    def provider(fails, error):
        left = [fails]

        def ask(prompt):
            left[0] -= 1
            if left[0] >= 0:
                raise error
            return prompt.upper()

        return ask

    assert replies.asked(provider(3, replies.RateLimited("slow")), "a", free, 6, 1, waits.append) == {"reply": "A", "error": None, "tries": 4}
    assert len(waits) == 3 and waits == sorted(waits) and waits[0] >= 1 and waits[2] >= 4
    assert replies.asked(provider(9, replies.RateLimited("slow")), "a", free, 3, 0, waits.append)["error"] == "rate limit: slow"
    assert replies.asked(provider(9, ValueError("broken")), "a", free, 6, 0, waits.append) == {"reply": None, "error": "broken", "tries": 1}


def test_prompts_are_paid_once(spark, tmp_path):
    """Equal prompts and those of an earlier call, or of a job that has failed, are not sent again; failed rows carry a text."""
    log = tmp_path / "sent"
    log.mkdir()

    def provider(prompt):
        if prompt == "p6" and not (log / "seen").exists():
            raise ValueError("no quota left")
        (log / f"{prompt}-{time.time_ns()}").write_text("")
        return prompt.upper()

    table = replies.Replies(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([(k, f"p{k % 7}") for k in range(30)] + [(30, None)], "id int, prompt string")
    options = {"per_minute": 1e6, "wait": 0.0, "backend": "groq"}
    got = {r.id: r for r in table.ask(rows, provider, **options).collect()}
    sent = lambda: collections.Counter(f.name.split("-")[0] for f in log.iterdir() if f.name != "seen")
    assert sent() == {f"p{k}": 1 for k in range(6)} and got[8].reply == "P1" and got[30].reply is None and not got[8].failed
    assert got[6].failed and got[13].failed and got[6].reply.startswith("## The account's quota")
    (log / "seen").write_text("")
    more = rows.unionByName(spark.createDataFrame([(99, "new")], "id int, prompt string"))
    got = {r.id: r for r in table.ask(more, provider, **options).collect()}
    assert sent() == {"new": 1, **{f"p{k}": 1 for k in range(7)}} and got[6].reply == "P6" and not got[6].failed and got[99].reply == "NEW"
    lost = replies.Replies(spark, str(tmp_path / "r"))  # the table is lost, the journal is not: as when a job dies before it publishes
    lost.replace(lost.read().where("false"))
    assert {r.reply for r in lost.ask(rows.where("id < 7"), provider, **options).collect()} == {f"P{k}" for k in range(7)} and max(sent().values()) == 1


def test_fetch_by_rows(spark):
    """Some thousand addresses; one host is asked by two at a time at most; what is known is left out; failures are rows."""
    lock, now, most, seen, busy = threading.Lock(), [0], [0], collections.Counter(), collections.Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
                seen[self.path] += 1
                busy[self.path] += self.path.startswith("/busy")
            time.sleep(0.0005)
            code = 404 if self.path == "/gone" else 429 if busy[self.path] == 1 else 200
            with lock:
                now[0] -= 1
            self.send_response(code)
            self.end_headers()
            self.wfile.write(b"\xff\xfe" if self.path == "/bin" else b"text of " + self.path.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = [(f"{base}/f{k}.py", f"d/f{k}.py", f"s{k}") for k in range(2000)] + [(f"{base}/{x}", x, None) for x in ("gone", "bin", "busy")] + [("http://127.0.0.1:9/x", "x", None), ("nonsense", None, None), (None, None, None)]
    listing = spark.createDataFrame(rows, "url string, path string, sha string").repartition(8)
    known = spark.createDataFrame([(f"{base}/f{k}.py", f"s{k}" if k % 2 else "old") for k in range(1000)], "url string, sha string")
    got = {r.path or r.url: r for r in fetch.fetch(listing, known, slots=2, wait=0.01).collect()}
    server.shutdown()
    assert len(got) == 1500 + 5 and most[0] <= 2 and all(seen[f"/f{k}.py"] == (k >= 1000 or k % 2 == 0) for k in range(2000))
    assert (got["d/f0.py"].content, got["d/f0.py"].filename, got["d/f0.py"].error) == ("text of /f0.py", "f0.py", None)
    assert (got["gone"].content, got["gone"].status) == (None, 404) and got["bin"].error == "Binary file" and got["busy"].content and seen["/busy"] == 2
    assert got["x"].error.startswith("Network error") and got["nonsense"].content is None and got["nonsense"].error
    named = spark.createDataFrame([("o/r", "main", "a b/c+d.py")], "repository string, branch string, path string")
    assert fetch.addresses(named, "http://h").first().url == "http://h/o/r/main/a%20b/c%2Bd.py"


def test_as_of(spark):
    """Against a scan of all versions: ties, nulls, a key with most rows, moments before any version, empty buckets between."""
    rng = random.Random(8)
    at = lambda: rng.choice([None, *range(0, 3_000_000, 40_000)])
    key = lambda: rng.choice([None, 1, 1, 1, 2, 3])
    moments = [(k, key(), at()) for k in range(300)]
    versions = [(k, key(), at() if k % 9 else 77, rng.randrange(3)) for k in range(120)]
    time_of = "cast(timestamp_seconds(t) as timestamp_ntz) t"
    left = spark.createDataFrame(moments, "id int, key int, t long").selectExpr("id", "key", time_of)
    right = spark.createDataFrame(versions, "v int, key int, t long, seq int").selectExpr("v", "key", time_of, "seq", "if(v % 5 = 0, null, v) maybe")
    got = {r.id: (r.v, r.maybe) for r in temporal.as_of(left, right, "key", "t", "t", ["seq", "v"], ["v", "maybe"]).collect()}
    for k, of, t in moments:
        found = [(vt, seq, v) for v, vk, vt, seq in versions if None not in (of, t, vt) and vk == of and vt <= t]
        want = max(found)[2] if found else None
        assert got[k] == (want, None if want is None or want % 5 == 0 else want)
    assert len(got) == 300 and temporal.as_of(left.where("false"), right, "key", "t", "t", ["seq"], ["v"]).count() == 0
    assert {r.v for r in temporal.as_of(left, right.where("false"), "key", "t", "t", ["seq"], ["v"]).collect()} == {None}


def test_within_has_an_equal_join(spark):
    points = spark.range(0, 500).selectExpr("concat('f', id % 3) path", "int(id) line")
    spans = spark.range(0, 40).selectExpr("concat('f', id % 3) path", "int(id * 12) lo", "int(id * 12 + id % 37) hi")
    got = temporal.within(points, spans, ["path"], "line", "lo", "hi", width=30)
    assert got.count() == points.alias("p").join(spans.alias("s"), F.expr("p.path = s.path and line between lo and hi")).count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "_bin" in plan


def test_rollups_merge_sketches(spark):
    """Levels merged from stored sketches: exact sums, distinct counts and quantiles within their bounds, null keys apart from totals."""
    rows = spark.range(40_000).selectExpr("if(id % 7 = 0, null, id % 3) repo", "id % 11 folder", "id % 5000 author", "double(id % 1000) size")
    base = rollups.sketched(rows, ["repo", "folder"], "author", "size")
    got = rollups.rolled(base, ["repo", "folder"], (0.1, 0.5)).collect()
    assert collections.Counter(r.level for r in got) == {2: 44, 1: 4, 0: 1}
    (whole,) = [r for r in got if r.level == 0]
    assert (whole.n, whole.total) == (40_000, 40_000 * 499.5) and abs(whole.n_distinct - 5000) < 0.05 * 5000
    assert abs(whole.quantiles[0] - 100) < 30 and abs(whole.quantiles[1] - 500) < 30
    assert sum(r.n for r in got if r.level == 1) == sum(r.n for r in got if r.level == 2) == 40_000


def test_chat_memory_as_state(spark, tmp_path):
    """Turns in any order, in several micro-batches, with a restart between: what is remembered equals the batch operator."""
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "model"]), f"{c}:{t}") for c in range(6) for t in range(3 * c + 2)]
    rng.shuffle(turns)
    schema = "conv_id long, turn long, role string, content string"
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest[r.conv_id] = r

    for start in range(0, len(turns), 20):
        spark.createDataFrame(turns[start : start + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = memory.remembered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), memory=12)
        run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        run.awaitTermination()
    want = history.recent_messages(spark.createDataFrame(turns, schema), "conv_id", "turn").orderBy("conv_id", "turn").collect()
    got = [(c, t.turn, t.role, t.content) for c in sorted(latest) for t in latest[c].turns]
    assert got == [(r.conv_id, r.turn, r.role, r.content) for r in want]
    assert {c: r.n_seen for c, r in latest.items()} == {c: 3 * c + 2 for c in range(6)}
