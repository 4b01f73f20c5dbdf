"""Streams that go on by themselves: timers of silent checks, and files that still grow."""

import os
import random
import subprocess
import sys
import time

import pytest

from siftspark.sources import growing
from siftspark.streaming import live, watch

EVENTS = "name string, seq int, event string, line string, timeout_s double, goal boolean"


def test_silence_in_a_session_of_its_own():
    """Behind other streams in one session the watched one didn't get on in time (see README), so it runs in its own."""
    pytest.importorskip("google.protobuf")
    run = subprocess.run([sys.executable, "-m", "pytest", __file__, "-x", "-q", "-k", "silence_alone"], env=os.environ | {"OWN_SESSION": "1"}, timeout=400, capture_output=True, text=True)
    assert run.returncode == 0 and "1 passed" in run.stdout, run.stdout[-3000:]


@pytest.mark.skipif("OWN_SESSION" not in os.environ, reason="runs by the test above")
def test_silence_alone_changes_a_check(spark, tmp_path):
    key, provider = watch.PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    places = [str(tmp_path / x) for x in ("in", "out", "ck")]
    put = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(places[0])
    seen = lambda: [(r.name, r.state, r.status, r.lines, r.last_line) for r in spark.read.schema(watch.OUT).parquet(places[1]).orderBy("elapsed_s").collect()]

    def start():
        events = watch.watched(spark.readStream.schema(EVENTS).parquet(places[0]), slow_s=2, quiet_s=4)
        return events.writeStream.format("parquet").option("path", places[1]).option("checkpointLocation", places[2]).trigger(processingTime="0 seconds").start()

    def until(query, told):
        for _ in range(400):
            assert query.isActive, query.exception()
            if query.lastProgress and query.lastProgress["batchId"] >= 1 and told(seen()):
                return
            time.sleep(0.2)
        raise AssertionError(seen())

    try:
        put([("a", 1, "start", None, 30.0, None), ("a", 2, "line", "\x1b[1mone\x1b[0m", None, None), ("a", 3, "line", " \x1b[0m ", None, None), ("b", 1, "start", None, None, None), ("b", 2, "line", "x", None, None), ("b", 3, "finish", "FINDINGS", None, None), ("c", 1, "line", "never started", None, None), ("d", 1, "start", None, 6.0, True)])
        query = start()
        until(query, lambda rows: {"slowing", "quiet"} & {r[1] for r in rows if r[0] == "a"})  # nothing came meanwhile
        query.stop()
        query = start()  # goes on with the timers of the checkpoint
        until(query, lambda rows: {"a", "d"} <= {r[0] for r in rows if r[1] == "timed out"})
        query.stop()
    finally:
        for query in spark.streams.active:
            query.stop()
        spark.conf.set(key, before)
    rows = seen()
    assert [r for r in rows if r[0] == "b"] == [("b", "finished", "FINDINGS", 1, "x")] and not [r for r in rows if r[0] == "c"]
    states = [r[1] for r in rows if r[0] == "a"]
    order = ["active", "slowing", "quiet", "near timeout", "timed out"]
    assert states[0] == "active" and [order.index(s) for s in states] == sorted(set(map(order.index, states)))
    assert {r[2:] for r in rows if r[0] == "a" and r[1] == "timed out"} == {("ERROR", 1, "one")}
    assert {r[2:] for r in rows if r[0] == "d" and r[1] == "timed out"} == {("PASS", 0, "spawned process")}


def test_pieces_end_at_whole_characters(tmp_path):
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab\né€😀") for _ in range(400)).encode()
    (tmp_path / "f").write_bytes(text)
    with open(tmp_path / "f", "rb") as file:
        for stop in range(len(text) + 1):
            cut = growing.whole_until(file, stop)
            want = next(n for n in range(stop, -1, -1) if len(text[:n].decode(errors="ignore").encode()) == n)
            assert cut == want
    (tmp_path / "g").write_bytes(b"\x80\x80\x80\x80\xff")
    with open(tmp_path / "g", "rb") as file:
        assert growing.whole_until(file, 4) == 4 and growing.whole_until(file, 0) == 0


def test_growing_files_are_read_on(spark, tmp_path):
    folder, out, ck = tmp_path / "runs", str(tmp_path / "lines"), str(tmp_path / "ck")
    folder.mkdir()
    rnd = random.Random(4)
    long = "".join(rnd.choice("abé€😀 ") for _ in range(90_000)) + "\n"
    texts = {"big": long * 2 + "end without a line end", "small": "one\ntwo €\nthree\n", "none": "", "bad": "x\ny"}

    def run():
        lines = live.whole_lines(growing.output(spark, str(folder), 150_000))
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    def lines():
        return sorted((r.name, r.line) for r in spark.read.parquet(out).collect())

    data = {n: t.encode() for n, t in texts.items()}
    cut = {"big": len(long.encode()) + 7, "small": 10, "none": 0, "bad": 3}  # small: inside the euro sign
    for name, d in data.items():
        (folder / f"{name}.out").write_bytes(d[: cut[name]])
    (folder / "other.txt").write_text("not read")
    run()
    assert lines() == sorted([("big", long[:-1]), ("small", "one"), ("bad", "x")])
    for name, d in data.items():
        with open(folder / f"{name}.out", "ab") as file:
            file.write(d[cut[name] :])
        (folder / f"{name}.out.done").touch()
    run()  # a restart goes on where it was
    want = sorted((n, x) for n, t in texts.items() for x in t.removesuffix("\n").split("\n") if t)
    assert lines() == want
    run()
    assert lines() == want
