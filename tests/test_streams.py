"""Stateful streams and streaming sources: against the batch forms, over restarts."""

import datetime
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from quire.operators import release
from quire.sources.formats import register
from quire.streaming import feed
from quire.streaming.updater import PROVIDER, updater_stream

T0 = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "user long, ts timestamp, id string, event string"


def run(spark, folder, every, checkpoint, sink):
    """All files there are, one in each batch, then what the watermark lets out."""
    src = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    out = updater_stream(src, "user", "ts", "id", "event", "1 hour", every)
    q = out.writeStream.format("parquet").option("path", f"file://{sink}").option("checkpointLocation", f"file://{checkpoint}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.schema("user long, at timestamp, id string, event string, state string").parquet(f"file://{sink}")


@pytest.fixture
def stateful(spark):
    spark.conf.set(*PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(PROVIDER[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{folder}")


def test_updater_stream_is_the_batch_form(stateful, tmp_path):
    spark, rng = stateful, random.Random(3)
    names = sorted({e for to in release.MOVES.values() for e in to} | {"noise"})
    rows = [(u, T0 + datetime.timedelta(seconds=60 * i), f"{i}", rng.choice(["check", "newer", "download", "done", *names])) for u in (1, 2, 3) for i in range(40)]
    # out of order by less than the lateness, some twice
    order = sorted(range(len(rows)), key=lambda k: rows[k][1].timestamp() + rng.uniform(0, 3000))
    sent = [rows[k] for k in order]
    flush = [(9, T0 + datetime.timedelta(days=2 + i), "x", "noise") for i in range(2)]
    folder = tmp_path / "in"
    for part in (sent[:40], sent[30:80], sent[80:], flush[:1], flush[1:]):
        write(spark, folder, part)
    got = run(spark, folder, None, tmp_path / "check", tmp_path / "out").where("user < 9")
    assert got.count() == len(rows)
    last = {r["user"]: r["state"] for r in got.groupBy("user").agg(F.max_by("state", F.struct("at", F.col("id").cast("int"))).alias("state")).collect()}
    batch = release.updater_states(spark.createDataFrame(rows, EVENTS), "user", ["ts", "id"], "event")
    assert last == {r["user"]: r["state"] for r in batch.collect()}
    # each step, not only the last
    states = {}
    for u, _, i, e in rows:
        states[u, i] = release.MOVES[states.get((u, str(int(i) - 1)), "idle")].get(e, states.get((u, str(int(i) - 1)), "idle"))
    assert {(r["user"], r["id"]): r["state"] for r in got.collect()} == states


def test_checks_fall_due_and_restarts_lose_nothing(stateful, tmp_path):
    spark, folder = stateful, tmp_path / "in"
    hour = lambda h: T0 + datetime.timedelta(hours=h)
    write(spark, folder, [(1, hour(0), "a", "check"), (1, hour(1), "b", "error"), (2, hour(2), "c", "newer")])
    write(spark, folder, [(1, hour(20), "d", "check"), (1, hour(20.5), "e", "same")])
    run(spark, folder, "24 hours", tmp_path / "check", tmp_path / "out")
    # the state is in the store: a new query goes on from it; d put the check off to 44
    write(spark, folder, [(8, hour(60), "x", "noise")])
    write(spark, folder, [(8, hour(61), "y", "noise")])
    write(spark, folder, [(1, hour(1), "late", "newer"), (8, hour(62), "z", "noise")])
    got = run(spark, folder, "24 hours", tmp_path / "check", tmp_path / "out")
    rows = sorted((r["user"], r["at"].timestamp() / 3600 - T0.timestamp() / 3600, r["event"], r["state"]) for r in got.where("user < 8").collect())
    assert rows == [(1, 0, "check", "checking"), (1, 1, "error", "failed"), (1, 20, "check", "checking"), (1, 20.5, "same", "up to date"), (1, 44, "due", "checking"), (2, 2, "newer", "idle")]


FEED = json.dumps({"tag_name": "v1.2.0", "html_url": "u", "body": "b", "published_at": "p", "assets": [{"name": "a.zip", "browser_download_url": "z", "size": 5, "digest": "sha256:" + "a" * 64}]})


def answers(spark, folder, checkpoint, table, **options):
    src = spark.readStream.format("release_answers").options(path=str(folder), **options).load()
    q = feed.releases(src).writeStream.format("parquet").option("path", f"file://{table}").option("checkpointLocation", f"file://{checkpoint}").start()
    q.processAllAvailable()
    q.stop()
    return {r["number"]: (r["status"], r["class"], r["tag"], r["archive_url"]) for r in spark.read.parquet(f"file://{table}").collect()}, spark.read.parquet(f"file://{table}").count()


def test_recorded_answers_are_read_once(spark, tmp_path):
    register(spark)
    folder = tmp_path / "answers"
    for status, text, visible in ((200, FEED, None), (404, None, True), (404, None, False), (403, None, None)):
        feed.record(str(folder), status, text, visible)
    got, n = answers(spark, folder, tmp_path / "c", tmp_path / "t")
    expected = {0: (200, "ok", "v1.2.0", "z"), 1: (404, "noRelease", None, None), 2: (404, "inaccessible", None, None), 3: (403, "rateLimited", None, None)}
    assert got == expected and n == 4
    feed.record(str(folder), 429, None)
    feed.record(str(folder), 500, None)
    feed.record(str(folder), 0, None)
    got, n = answers(spark, folder, tmp_path / "c", tmp_path / "t")
    assert got == expected | {4: (429, "rateLimited", None, None), 5: (500, "httpStatus", None, None), 6: (0, "httpStatus", None, None)} and n == 7


def test_feed_is_asked_once_at_a_time(spark, tmp_path):
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["Cache-Control"]))
            status = {"/feed": 200, "/gone": 404, "/project": 200}[self.path]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(FEED.encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        register(spark)
        folder = tmp_path / "answers"
        got, n = answers(spark, folder, tmp_path / "c", tmp_path / "t", url=f"{url}/feed")
        assert got == {0: (200, "ok", "v1.2.0", "z")} and n == 1
        # not due: a restart asks nothing
        assert answers(spark, folder, tmp_path / "c", tmp_path / "t", url=f"{url}/feed")[1] == 1
        assert asked == [("/feed", "no-cache")]
        assert feed.poll(f"{url}/gone", str(folder), f"{url}/project") == 1
        # another one is under way
        (folder / ".asking").touch()
        assert feed.poll(f"{url}/feed", str(folder)) is None
        assert feed.poll(f"{url}/feed", str(folder), stale=0) == 2
        # no one answers: the attempt counts
        assert feed.poll("http://127.0.0.1:1/", str(folder)) == 3
        got, n = answers(spark, folder, tmp_path / "c", tmp_path / "t")
        assert n == 4 and got[1][:2] == (404, "noRelease") and got[3][:2] == (0, "httpStatus")
    finally:
        server.shutdown()
