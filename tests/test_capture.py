"""Shelves and lists read off made-up videos, the command line, readers and streams."""

import json

import numpy as np
from pyspark.sql import functions as F

from tesserae import cli
from tesserae.operators import capture, review
from tesserae.operators import timeseries as ts
from tesserae.sources import readers
from tesserae.streaming import streams


def make():
    """grab, reader: a frame's brightness is its time; what stands in it depends on that and on its turn."""

    def grab(video, t):
        img = np.full((40, 100, 3), int(t * 2) % 250, np.uint8)
        img[::2, :, :] += np.uint8(min(5, int(t)))
        return img

    def reader(img):
        n = int(img[1, 0, 0])
        if img.shape[0] > img.shape[1]:
            return [([1, 2, 3, 8], "TURNED", 0.5)]
        return [([10, 5 * i, 30, 5 * i + 4], f"entry line {n // 4} {i}", 0.9 - 0.01 * i) for i in range(13 if n < 60 else 2)]

    return grab, reader


def test_spines_of_a_video(spark):
    grab, reader = make()
    times = spark.createDataFrame([("v", float(t)) for t in range(8)] + [("w", 2.0)], "video string, t double")
    rows = capture.extract_spines(capture.seek(times, grab), reader, k=2, band=1.0, scale=1, tile=60, vertical=True, presets=("lanczos",)).collect()
    by = {v: [r for r in rows if r["video"] == v] for v in "vw"}
    assert {r["t"] for r in by["w"]} == {2.0} and {r["t"] for r in by["v"]} <= {5.0, 6.0}
    turned = next(r for r in by["w"] if r["text"] == "TURNED")
    assert turned["preset"] == "lanczos_rotccw" and (turned["x"], turned["y"], turned["w"], turned["h"]) == (100 - 1 - 8, 1, 6, 2)
    assert [r["conf"] for r in sorted(by["v"], key=lambda r: r["ord"])] == sorted((r["conf"] for r in by["v"]), reverse=True)
    assert capture.extract_spines(capture.seek(times, grab), reader, min_focus=1e9).count() == 0


def test_scroll_of_a_video(spark):
    grab, reader = make()
    motion = spark.createDataFrame([("v", i, 5.0 if 100 <= i < 300 or 600 <= i < 800 else 0.0) for i in range(900)], "video string, pos int, win double")
    ranges = capture.scroll_ranges(motion, grab, reader, 10.0)
    assert [(r["start_s"], r["end_s"]) for r in ranges.collect()] == [(10.0, 29.9)]
    lines = capture.capture_scroll(ranges, grab, reader, step_s=2.0).orderBy("seq").collect()
    assert len({r["text"] for r in lines}) == len(lines) > 26
    short = capture.capture_scroll(spark.createDataFrame([("v", 10.0, 14.0)], "video string, start_s double, end_s double"), grab, reader, step_s=1.0, k=1)
    assert short.count() == 13


def test_run_reads_all_stages(spark, tmp_path, monkeypatch):
    grab, reader = make()

    def decode(video, lo, hi):
        return [(lo + k / 10, 40, 100, grab(video, lo + k / 10).tobytes()) for k in range(int((hi - lo) * 10))]

    def hear(audio, lo, hi, beam_size=1, language="x"):
        return [(0.0, 2.0, f"he read entry line in his book Facing Reality {language}{beam_size}")]

    known = {"decode": decode, "grab": grab, "reader": reader, "hear": hear}
    monkeypatch.setattr(cli, "_model", known.__getitem__)
    out = str(tmp_path / "work")
    spark.createDataFrame([("v", 20.0)], "video string, duration_s double").write.parquet(str(tmp_path / "videos"))
    spark.createDataFrame([("v", 9.0)], "audio string, duration_s double").write.parquet(str(tmp_path / "audio"))
    argv = ["run", str(tmp_path / "videos"), "--out", out, "--decode", "decode", "--seek", "grab", "--reader", "reader", "--model", "hear", "--audio", str(tmp_path / "audio"), "--start", "1", "--end", "4", "--presets", "lanczos", "--upscale", "1", "--band", "1.0", "--beam-size", "5", "--language", "en", "--include-head", "--topk", "2"]
    cli.COMMANDS["run"](spark, cli.parser().parse_args(argv))
    assert spark.read.parquet(f"{out}/spines").where("text LIKE 'entry line%'").count() > 0
    assert "en5" in spark.read.parquet(f"{out}/segments").first()["text"]
    assert [r["phrase"] for r in spark.read.parquet(f"{out}/report/audio_titles").collect()] == ["Facing Reality"]
    assert spark.read.parquet(f"{out}/report/shown").count() > 0 and "## Titles mentioned in audio" in spark.read.parquet(f"{out}/report/report").first()["text"]


def test_bench_of_spines(spark, tmp_path, capsys):
    files = {"labels": {"video": "v", "books": [{"title": "Sapiens", "author": "Y Harari", "confident": True}], "author_bands": []}, "reads": [{"text": "Sapiens", "conf": 0.9}], "books": {"gazetteer": [{"phrase": "Sapiens", "title": "Sapiens", "authors": ["Y Harari"], "status": "weak"}], "author_spines": []}}
    for n, v in files.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(v))
    cli.COMMANDS["bench-spines"](spark, cli.parser().parse_args(["bench-spines", f"{tmp_path}/reads.json", "--labels", f"{tmp_path}/labels.json", "--books", f"{tmp_path}/books.json", "--out", f"{tmp_path}/out"]))
    r = spark.read.parquet(f"{tmp_path}/out").first()
    assert (r["found"], r["verified"]) == ("Sapiens", False)


def test_readers(spark, tmp_path):
    (tmp_path / "cache.json").write_text(json.dumps({"a": {"docs": [{"title": "T", "edition_count": 3}]}, "b": {"docs": []}, "c": {}}))
    rows = {(r["key"], r["known"], r["title"]) for r in readers.lookup_cache(spark, f"{tmp_path}/cache.json").collect()}
    assert rows == {("a", True, "T"), ("b", True, None), ("c", False, None)}
    (tmp_path / "ocr.json").write_text(json.dumps({"f.png": [{"box": [1, 2, 3, 4], "text": "x", "conf": 0.5}]}))
    r = readers.ocr_blocks(spark, f"{tmp_path}/ocr.json").first()
    assert (r["frame"], r["x0"], r["y1"], r["text"]) == ("f.png", 1.0, 4.0, "x")
    p = readers.probe(spark.createDataFrame([("  Duration: 00:01:02.50, x\n Video: h264, yuv, 1280x720 [SAR",)], "value string")).first()
    assert (p["duration_s"], p["width"], p["height"]) == (62.5, 1280, 720)
    got = readers.fetch(spark.createDataFrame([("a",), ("b",)], "phrase string"), lambda p: [] if p == "a" else None, tries=1).collect()
    assert {(r["phrase"], r["known"]) for r in got} == {("a", True), ("b", False)}


def streamed(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(90)
    return spark.table(name)


def test_streams_are_their_batch_forms(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts = streamed(spark, streams.tumbling_counts(stream()), "counts", "complete")
    want = events.groupBy(F.window("ts", "5 minutes"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((r["start"], r["event_type"], r["n"]) for r in counts.collect()) == sorted((r["window"]["start"], r["event_type"], r["n"]) for r in want.collect())
    firsts = streamed(spark, streams.first_seen(stream(), keys=("event_type",), late="10000 days"), "firsts", "append")
    assert sorted(r["event_type"] for r in firsts.collect()) == sorted(r[0] for r in events.select("event_type").distinct().collect())


def test_hold_detector_in_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = streamed(spark, streams.held_cuts(stream, 100.0, 3), "held", "append")
    batch = ts.hold_detector(ts.positions(events.select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id"), "user_id", lambda a, b: F.abs(a - b), "value", [(100.0, 3)])
    assert got.count() == batch.count() > 0
    assert sorted(r[0] for r in got.groupBy("user_id").count().select("count").collect()) == sorted(r[0] for r in batch.groupBy("user_id").count().select("count").collect())


def test_sessions_and_delayed_cuts_in_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts", "event_id")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = streamed(spark, streams.sessions(stream()), "sessions", "complete")
    want = events.groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = streamed(spark, streams.delayed_cuts(stream(), spike=60.0, stable=90.0), "delayed", "append")
    at = ts.positions(events.select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id")
    last = at.groupBy("user_id").agg(F.max("pos").alias("last"))
    batch = ts.rolling_median(ts.consecutive_mad(at, "user_id", "value"), "user_id", 5).where("mad > 60 AND win < 90").join(last, "user_id").where("pos + 5 <= last")
    key = lambda df: sorted((r["user_id"], r["ts"], round(r["mad"], 6), round(r["win"], 6)) for r in df.collect())
    assert key(got) == key(batch) and got.count() > 0


def test_language_model_gates(spark):
    def titles(texts):
        return ["```json\n[{\"title\": \"Sapiens\", \"t\": 5.0}, {\"title\": \" \"}]\n```" if "Sapiens" in t else "no list" for t in texts]

    said = spark.createDataFrame([(1, i, float(i), "we read Sapiens" if i in (5, 7) else "and so on") for i in range(10)] + [(2, 0, 0.0, "nothing")], "doc_id long, seq long, start double, text string")
    assert [tuple(r) for r in review.extract_titles(said, titles, chunk=4).collect()] == [(1, "Sapiens", 5.0)]
    fixed = review.correct_phrases(spark.createDataFrame([("LOSISG GROUND",), ("LOSISG GROUND",), ("x",), (None,)], "phrase string"), lambda ps: ["Losing Ground" if "LOS" in p else "" for p in ps])
    assert {tuple(r) for r in fixed.collect()} == {("LOSISG GROUND", "Losing Ground"), ("x", "x")}
