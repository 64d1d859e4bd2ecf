"""Command line: each subcommand reads tables or files, runs one part of the plan and writes Parquet.

Models (decoders, recognisers, reviewers) are named as module:function and imported where needed:
--model reads files, --seek gives a video's frame at a time, --reader reads a frame."""

from __future__ import annotations

import argparse
import functools
import importlib
import inspect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import images
from .operators import capture, export, mining, review, spatial
from .operators import timeseries as ts
from .plans.pipeline import Artifacts, Config, compile_entries, exportable, report
from .sources import readers


def _model(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _save(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").parquet(out)


def _have(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage's table if it is there and not empty, so that a run can go on where it stopped."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return None if df.isEmpty() else df


def features(spark, a):
    _save(images.features(readers.frames(spark.read.parquet(a.input), _model(a.decode))), a.out)


def segment(spark, a):
    f = spark.read.parquet(a.input)
    f = f.withColumn("pos", (F.row_number().over(Window.partitionBy("video").orderBy("t")) - 1).cast("int"))
    moved = ts.rolling_median(ts.consecutive_mad(f.select("video", "pos", "blocks"), "video", "blocks", True).drop("blocks"), "video", int(a.window_s * a.fps) // 2)
    _save(moved, a.out + "/motion")
    _save(ts.cuts(spark.read.parquet(a.out + "/motion"), "video", a.spike, a.stable), a.out + "/cuts")


def frames(spark, a):
    moved = spark.read.parquet(a.input + "/motion")
    _save(ts.representatives(moved, spark.read.parquet(a.input + "/cuts"), "video", a.fps, include_head=a.include_head), a.out)


def ocr(spark, a):
    _save(readers.recognise(readers.images(spark, a.input, a.pattern), _model(a.model)), a.out)


def covers(spark, a):
    boxes = images.panel_boxes(spark.read.parquet(a.input))
    _save(spatial.keep_panels(boxes, F.col("width"), F.col("height")), a.out)


def scroll(spark, a):
    """Finds the scrolling lists of videos by their motion (--seek, --reader), or stitches lines that are given."""
    table = spark.read.parquet(a.input)
    if not a.seek:
        return _save(spatial.stitch(table, "doc_id", a.columns), a.out)
    grab, reader = _model(a.seek), _model(a.reader)
    if a.start is not None and a.end is not None:
        ranges = table.select("video").distinct().select("video", F.lit(a.start).alias("start_s"), F.lit(a.end).alias("end_s"))
    else:
        ranges = capture.scroll_ranges(table, grab, reader, a.fps, a.min_lines, stable=a.stable)
    _save(capture.capture_scroll(ranges, grab, reader, a.step, k=a.topk, columns=a.columns), a.out)


def audio(spark, a):
    model = _model(a.model)
    said = {n: getattr(a, n) for n in ("beam_size", "language") if n in inspect.signature(model).parameters}
    _save(readers.transcribe(spark.read.parquet(a.input), functools.partial(model, **said), a.chunk_s), a.out)


def captions(spark, a):
    _save(mining.segments_of(mining.new_words(mining.caption_cues(readers.whole(spark, a.input)))), a.out)


def spines(spark, a):
    """Reads the shelves of videos (--seek, --reader, from --start to --end), or puts given reads upright."""
    table = spark.read.parquet(a.input)
    if not a.seek:
        return _save(spatial.best_reads(spatial.unrotate(table), "doc_id", a.min_len), a.out)
    n = int((a.end - a.start) / a.step + 1e-9)
    times = table.select("video").distinct().select("video", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).select("video", (F.lit(a.start) + F.col("i") * a.step).alias("t"))
    roi = tuple(map(int, a.roi.split(","))) if a.roi else None
    reads = capture.extract_spines(capture.seek(times, _model(a.seek)), _model(a.reader), tuple(a.presets.split(",")), a.topk, roi, a.band, a.upscale, least=a.min_len, min_focus=a.min_focus, stack=a.stack, panorama=a.stack, vertical=a.vertical)
    _save(reads, a.out)


def compile_(spark, a):
    read = lambda name: _have(spark, f"{a.input}/{name}")
    catalogues = [(c, t) for c in ("catalogue", "crossref") if (t := read(c)) is not None]
    names = ("scroll", "panels", "crop_text", "spines", "segments", "titles", "corrections", "serials")
    found = {n: read(n) for n in names}
    if (keyed := read("panels_keyed")) is not None:
        found["panels"] = keyed
    out = compile_entries(Artifacts(catalogues=catalogues, **found), spark, Config(fuzzy=a.fuzzy, max_queries=a.max_queries))
    for name, df in out.items():
        _save(df, f"{a.out}/{name}")
    kept = exportable(spark.read.parquet(f"{a.out}/entries"))
    export.write_text(export.bibtex(kept), "bibtex", f"{a.out}/bib")
    export.write_text(export.ris(kept), "ris", f"{a.out}/ris")
    _save(report(out), f"{a.out}/report")


def vlm_bundle(spark, a):
    review.bundle(readers.images(spark, a.input, a.pattern).select(F.col("path").alias("image"))).write.mode("overwrite").json(a.out)


def vlm_run(spark, a):
    items = review.ask(spark.read.json(a.input, "id long, image string, question string"), _model(a.model), "image")
    _save(items.withColumn("entries", review.parse_reply(F.col("reply"))), a.out)


def vlm_merge(spark, a):
    merged, fresh = review.merge(spark.read.parquet(a.input), spark.read.parquet(a.review))
    _save(merged, a.out)
    _save(fresh, a.out + "-added")


def bench_spines(spark, a):
    """Scores of a label file's shelf: reads (input) and a compiled report (--books), all JSON."""
    labels, books = (readers.whole(spark, p).select(F.lit(0).cast("long").alias("doc_id"), F.from_json("value", s).alias("v")) for p, s in ((a.labels, readers.label_schema()), (a.books, readers.book_schema())))
    asked = labels.select("doc_id", F.explode("v.books").alias("b")).select("doc_id", F.lit("book").alias("kind"), F.col("b.title").alias("label"), "b.author", "b.confident")
    asked = asked.union(labels.select("doc_id", F.explode("v.author_bands").alias("b")).select("doc_id", F.lit("author_band"), "b.name", F.lit(None).cast("string"), "b.confident"))
    reads = readers.json_rows(spark, a.input, readers.SPINE_READS).select(F.lit(0).cast("long").alias("doc_id"), F.col("seq").alias("ord"), "text")
    entries = books.select("doc_id", F.posexplode("v.gazetteer").alias("ord", "g")).select("doc_id", F.col("ord").cast("long").alias("ord"), "g.phrase", "g.matched_as", "g.title", "g.authors", "g.status")
    bands = books.select("doc_id", F.explode("v.author_spines").alias("name"))
    scores = review.spine_scores(asked, reads, entries, bands)
    _save(scores, a.out)
    review.recalls(spark.read.parquet(a.out)).show(truncate=False)


def pdf(spark, a):
    """Hands the images, in order, to an injected writer."""
    writer = _model(a.model)
    writer(readers.images(spark, a.input, a.pattern).orderBy("path").toLocalIterator(), a.out)


def _pages(spark, a):
    """The representative frames themselves, sought in the videos."""
    _save(capture.seek(spark.read.parquet(a.input).select("video", "t"), _model(a.seek)).withColumn("seg", F.concat_ws("@", "video", "t")), a.out)


def _blocks(spark, a):
    _save(capture.read(spark.read.parquet(a.input), _model(a.reader)).withColumn("frame", F.concat(F.concat_ws("@", "video", "t"), F.lit(".png"))), a.out)


def _panels(spark, a):
    """Panels of the representative frames with the text that was read in and around them."""
    boxes = images.panel_boxes(spark.read.parquet(f"{a.input}/pages"))
    kept = spatial.keep_panels(boxes, F.col("width"), F.col("height"))
    number = F.row_number().over(Window.partitionBy("seg").orderBy("y", "x", "w", "h"))
    kept = kept.withColumn("file", F.concat("seg", F.lit("-"), number, F.lit(".png")))
    _save(spatial.attach_panel_text(kept, spark.read.parquet(f"{a.input}/ocr")), a.out)


def _keyed(df: DataFrame) -> DataFrame:
    """Rows of a video under the number that stands for it in the report."""
    name = F.col("video") if "video" in df.columns else F.col("audio") if "audio" in df.columns else F.regexp_extract("seg", "^(.*)@", 1)
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.xxhash64(name))


def run(spark, a):
    """Every stage whose table is not there yet, one after the other, in one working folder, then the report.
    Stages whose model is not named are left out: frames need --decode and --seek, reading them --reader,
    shelves --start and --end, a transcript --model and --audio, pages as a document --writer."""
    at = lambda name: f"{a.out}/{name}"
    see, read_ = bool(a.seek), bool(a.seek and a.reader)
    stages = [
        ("features", features, a.input, bool(a.decode)), ("moves", segment, at("features"), bool(a.decode)), ("reps", frames, at("moves"), bool(a.decode)),
        ("pages", _pages, at("reps"), see), ("ocr", _blocks, at("pages"), read_), ("panels", _panels, a.out, read_),
        ("scroll_lines", scroll, at("moves") + "/motion", read_), ("shelf", spines, a.input, read_ and a.start is not None and a.end is not None),
        ("speech", audio, a.audio, bool(a.audio and a.model)),
    ]
    shelf_only = ("start", "end")
    for name, step, source, wanted in stages:
        if wanted and _have(spark, at(name)) is None and _have(spark, at(name) + "/cuts") is None:
            own = {**vars(a), "input": source, "out": at(name)}
            if name == "scroll_lines":
                own |= dict.fromkeys(shelf_only)
            step(spark, argparse.Namespace(**own))
    if a.writer and see:
        pages = spark.read.parquet(at("pages")).select(F.col("seg").alias("path"), F.col("rgb").alias("content"))
        _model(a.writer)(pages.orderBy("path").toLocalIterator(), at("pages.pdf"))
    for name, source in (("scroll", "scroll_lines"), ("spines", "shelf"), ("segments", "speech")):
        made = _have(spark, at(source))
        if made is not None and _have(spark, at(name)) is None:
            made = _keyed(made)
            if name == "segments":
                made = made.withColumn("seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "text")) - 1).cast("long"))
            _save(made.withColumn("seq", F.col("seq").cast("long")) if name == "scroll" else made, at(name))
    panels = _have(spark, at("panels"))
    if panels is not None and "doc_id" not in panels.columns:
        _save(_keyed(panels), at("panels_keyed"))
    compile_(spark, argparse.Namespace(**{**vars(a), "input": a.out, "out": at("report")}))


COMMANDS = {"features": features, "segment": segment, "frames": frames, "ocr": ocr, "covers": covers, "scroll": scroll, "audio": audio, "captions": captions, "spines": spines, "compile": compile_, "vlm-bundle": vlm_bundle, "vlm-run": vlm_run, "vlm-merge": vlm_merge, "bench-spines": bench_spines, "pdf": pdf, "run": run}


def parser() -> argparse.ArgumentParser:
    p, c = argparse.ArgumentParser(prog="tesserae"), Config()
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--out", default="out")
        s.add_argument("--model", default="")
        s.add_argument("--decode", default="")
        s.add_argument("--seek", default="")
        s.add_argument("--reader", default="")
        s.add_argument("--writer", default="")
        s.add_argument("--audio", default="")
        s.add_argument("--language", default="en")
        s.add_argument("--pattern", default="*.png")
        s.add_argument("--roi", help="x,y,w,h")
        s.add_argument("--presets", default="unsharp")
        for flag in ("--stack", "--vertical"):
            s.add_argument(flag, action="store_true")
        for flag, default in (("--start", None), ("--end", None), ("--step", 0.5 if name == "scroll" else 1.0), ("--min-focus", 0.0)):
            s.add_argument(flag, type=float, default=default)
        s.add_argument("--min-len", type=int, default=3)
        s.add_argument("--labels")
        s.add_argument("--books")
        s.add_argument("--review")
        s.add_argument("--fps", type=float, default=10.0)
        s.add_argument("--columns", type=int, default=2)
        s.add_argument("--include-head", action="store_true")
        for field, default in (("spike", c.spike), ("stable", c.stable), ("window-s", c.window_s), ("fuzzy", c.fuzzy), ("chunk-s", c.chunk_s), ("band", c.band)):
            s.add_argument(f"--{field}", type=float, default=default)
        for field, default in (("max-queries", c.max_queries), ("min-lines", c.min_lines), ("upscale", c.upscale), ("topk", c.top_k), ("beam-size", c.beam_size)):
            s.add_argument(f"--{field}", type=int, default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](SparkSession.builder.appName("tesserae").getOrCreate(), a)


if __name__ == "__main__":
    main()
