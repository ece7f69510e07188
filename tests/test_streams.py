"""Streams on small files: late rows, watermarks, sessions, replay sink, state across batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrain.streaming import tracker_stream as ts
from pulsegrain.streaming import windows_stream as ws

ROWS = "subject_id long, event_id long, off_us long, hr_bpm double, rhythm_class string"
TIMED = "at timestamp, k string, value double"


def files(spark, folder, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{n}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_state_crosses_batches_and_late_rows_are_counted(spark, tmp_path):
    batches = [[(1, 1, 10, 250.0, "AF"), (2, 9, 5, None, None)], [(1, 2, 20, 250.0, "AF"), (1, 3, 5, 60.0, "N")], [(1, 4, 30, 60.0, None)]]
    out = ts.run_to_end(spark, ts.track_stream(files(spark, tmp_path / "in", batches, ROWS)), str(tmp_path / "run"))
    got = {r["event_id"]: r for r in out.collect()}
    assert sorted(got) == [1, 2, 4, 9]
    assert got[2]["timer"] == 20.0 and got[2]["samples"] == 2 and not got[2]["alert"] and got[1]["alert"]
    assert got[4]["late"] == 1 and got[4]["timer"] == 20.0 and got[9]["ratio"] is None


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t = "2024-01-01 00:00:00"
    rows = spark.createDataFrame([(0, "a", 1.0), (30, "a", 3.0), (70, "a", 5.0), (300, "a", 9.0)], "s int, k string, value double")
    timed = rows.select((F.lit(t).cast("timestamp") + F.make_interval(secs="s")).alias("at"), "k", "value")
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
    done = ws.tumbling_counts(stream, "at", ["k"], "1 minute", "10 seconds").select("n", "mean_value")
    assert sorted(tuple(r) for r in ts.run_to_end(spark, done, str(tmp_path / "w")).collect()) == [(1, 5.0), (2, 2.0)]
    spells = ws.session_counts(stream, "at", ["k"], "35 seconds", "10 seconds").select("n")
    assert sorted(r[0] for r in ts.run_to_end(spark, spells, str(tmp_path / "s")).collect()) == [1, 2]


def test_replay_sink_writes_each_batch_once(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [[(1, 1, 10, 70.0, "N")], [(1, 2, 20, 70.0, "N")]], ROWS)
    write = ws.replay_sink(str(tmp_path / "out"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    write(spark.createDataFrame([(1, 1, 10, 70.0, "N")], ROWS), 0)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
