"""Debounce by the clock."""

from __future__ import annotations

import time

from noteloom.streaming.changes import debounce_arrivals, held_arrivals


def test_newest_change_comes_out_after_a_quiet_time_by_itself(spark, tmp_path):
    source, out = tmp_path / "in", []
    source.mkdir()

    def put(name, *rows):
        (tmp_path / name).write_text("\n".join(f"{p},{r},{t},{str(k).lower()}" for p, r, t, k in rows))
        (tmp_path / name).rename(source / name)

    def start(gap, trigger):
        changes = spark.readStream.schema("path string, revision long, text string, known boolean").csv(str(source))
        quiet = debounce_arrivals(changes, "path", "revision", "text", gap, known="known")
        sink = lambda batch, number: out.extend((time.time(), r["path"], r["revision"], r["text"]) for r in batch.collect())
        return quiet.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(**trigger).start()

    def wait(n):
        end = time.time() + 60
        while len(out) < n and time.time() < end:
            time.sleep(0.2)

    put("0.csv", ("old", 1, "a", True), ("old", 3, "c", True), ("old", 2, "b", True), ("new", 1, "x", False))
    start(8, {"once": True}).awaitTermination()
    assert [(p, r, t) for _, p, r, t in out] == [("new", 1, "x")]  # a new note waits for nothing
    assert [tuple(r) for r in held_arrivals(spark, str(tmp_path / "checkpoint"), "path", "revision", "text").collect()] == [("old", 3, "c")]
    put("1.csv", ("old", 2, "late", True), ("other", 5, "o", True))
    put_at = time.time()
    job = start(8, {"processingTime": "1 second"})  # a restart: what was held is there, and its clock begins anew by the late change
    try:
        wait(3)
    finally:
        job.stop()
    assert sorted((p, r, t) for _, p, r, t in out[1:]) == [("old", 3, "c"), ("other", 5, "o")]
    assert all(at >= put_at + 8 for at, *_ in out[1:])
    assert held_arrivals(spark, str(tmp_path / "checkpoint"), "path", "revision", "text").count() == 0
