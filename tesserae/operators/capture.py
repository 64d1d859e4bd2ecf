"""Reading shelves and scrolling lists off a video with injected functions.

grab(video, t) gives a frame as an array (height, width, 3); reader(array) gives what stands in it as
(box, text, confidence), box being x0, y0, x1, y1. Frames are sought by their time, spread over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images
from . import spatial
from . import timeseries as ts

Grab = Callable[[str, float], np.ndarray]
Reader = Callable[[np.ndarray], list[tuple[list[float], str, float]]]
FRAME = "video string, t double, height int, width int, rgb binary"
LINE = "text string, conf double, x0 double, y0 double, x1 double, y1 double"


def _array(r) -> np.ndarray:
    return np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)


def seek(times: DataFrame, grab: Grab) -> DataFrame:
    """The frames (video, t, height, width, rgb) at points in time (video, t)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                img = np.ascontiguousarray(grab(r.video, r.t), np.uint8)
                yield pd.DataFrame([(r.video, r.t, img.shape[0], img.shape[1], img.tobytes())], columns=["video", "t", "height", "width", "rgb"])

    return times.select("video", F.col("t").cast("double").alias("t")).repartition("video", "t").mapInPandas(run, FRAME)


def read(frames: DataFrame, reader: Reader) -> DataFrame:
    """(video, t, seq, text, conf, x0, y0, x1, y1): what a reader finds in each frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = [(r.video, r.t, i, text, float(conf), *map(float, box)) for i, (box, text, conf) in enumerate(reader(_array(r)))]
                yield pd.DataFrame(rows, columns=["video", "t", "seq", "text", "conf", "x0", "y0", "x1", "y1"])

    return frames.select("video", "t", "height", "width", "rgb").mapInPandas(run, f"video string, t double, seq int, {LINE}")


def focus(frames: DataFrame, roi: tuple[int, int, int, int] | None = None, band: float = 1.0) -> DataFrame:
    """Frames cut to a region (x, y, w, h), or to the upper share `band`, with the cut's own sharpness."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                img = _array(r)
                x, y, w, h = roi or (0, 0, r.width, int(r.height * band))
                img = np.ascontiguousarray(img[y : y + h, x : x + w])
                yield pd.DataFrame([(r.video, r.t, *img.shape[:2], img.tobytes(), images.sharpness(images.luma(img)))], columns=["video", "t", "height", "width", "rgb", "sharpness"])

    return frames.select("video", "t", "height", "width", "rgb").mapInPandas(run, f"{FRAME}, sharpness double")


def _views(presets: tuple[str, ...], scale: int, stack: bool, panorama: bool):
    def views(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sharpness", "t"], ascending=[False, True])
        crops = [(r.t, _array(r)) for r in pdf.itertuples(index=False)]
        pan = images.stitch_pan([c for _, c in crops]) if panorama and len(crops) > 2 else None
        made = [("stack", images.stack_median([c for _, c in crops]), crops[0][0])] if stack and len(crops) > 1 else []
        made += [("panorama", images.enhance(pan, "unsharp", scale), crops[0][0])] if pan is not None else []
        made += [(p, images.enhance(c, p, scale), t) for t, c in crops for p in presets]
        rows = [(pdf["video"].iloc[0], i, t, p, *img.shape[:2], np.ascontiguousarray(img).tobytes()) for i, (p, img, t) in enumerate(made)]
        return pd.DataFrame(rows, columns=["video", "view", "t", "preset", "height", "width", "rgb"])

    return views


def _read_views(reader: Reader, tile: int, turns: tuple[str, ...]):
    turned = {"none": lambda x: x, "ccw": lambda x: np.rot90(x), "cw": lambda x: np.rot90(x, -1)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = []
                for k, turn in enumerate(turns):
                    img = np.ascontiguousarray(turned[turn](_array(r)))
                    for offset in range(0, img.shape[1], tile):
                        for i, (box, text, conf) in enumerate(reader(img[:, offset : offset + tile])):
                            rows.append((r.video, r.view, r.t, r.preset if turn == "none" else f"{r.preset}_rot{turn}", k, offset, i, turn, r.width, r.height, text, float(conf), *map(float, box)))
                yield pd.DataFrame(rows, columns=["video", "view", "t", "preset", "k", "offset", "i", "turn", "image_w", "image_h", "text", "conf", "x0", "y0", "x1", "y1"])

    return run


def extract_spines(frames: DataFrame, reader: Reader, presets: tuple[str, ...] = ("unsharp",), k: int = 3, roi: tuple[int, int, int, int] | None = None, band: float = 0.22, scale: int = 4, tile: int = 1400, least: int = 3, min_focus: float = 0.0, stack: bool = False, panorama: bool = False, vertical: bool = False) -> DataFrame:
    """(video, ord, text, conf, t, preset, upscale, x, y, w, h): a shelf's reads, the best of each text first.

    The `k` sharpest cuts of a video that are in focus are made readable by each preset, stacked or joined to
    a panorama, read tile by tile, on request turned both ways as well, and boxes are put back upright."""
    cuts = focus(frames, roi, band).where(F.col("sharpness") >= min_focus)
    best = spatial.sharpest(cuts, "video", k)
    views = best.groupBy("video").applyInPandas(_views(tuple(presets), scale, stack, panorama), "video string, view int, t double, preset string, height int, width int, rgb binary")
    turns = ("none", "ccw", "cw") if vertical else ("none",)
    reads = views.repartition("video", "view").mapInPandas(_read_views(reader, tile, turns), f"video string, view int, t double, preset string, k int, offset int, i int, turn string, image_w int, image_h int, {LINE}")
    reads = spatial.unrotate(reads).withColumn("upscale", F.lit(scale)).withColumn("ord", F.struct("view", "k", "offset", "i"))
    kept = spatial.best_reads(reads, "video", least)
    order = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("conf"), "ord")) - 1
    return kept.withColumn("ord", order.cast("long")).select("video", "ord", "text", "conf", "t", "preset", "upscale", "x", "y", "w", "h")


def scroll_ranges(motion: DataFrame, grab: Grab, reader: Reader, fps: float, least_lines: int = 12, probe_s: float = 2.0, stable: float = 1.0, most_s: float = 180.0) -> DataFrame:
    """(video, start_s, end_s): the moving stretches in which some probe holds enough lines to be a list."""
    runs = ts.moving_runs(motion, "video", fps, stable, most_s=most_s).select("video", "start_s", "end_s")
    probes = runs.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("end_s") - F.col("start_s")) / probe_s).cast("int"))).alias("i"))
    probes = probes.withColumn("t", F.col("start_s") + F.col("i") * probe_s)
    lines = read(seek(probes.select("video", "t").distinct(), grab), reader).groupBy("video", "t").agg(F.count("*").alias("lines"))
    rich = probes.join(lines, ["video", "t"]).groupBy("video", "start_s", "end_s").agg(F.max("lines").alias("lines"))
    return rich.where(F.col("lines") >= least_lines).drop("lines")


def capture_scroll(ranges: DataFrame, grab: Grab, reader: Reader, step_s: float = 0.5, card_s: float = 10.0, k: int = 3, columns: int = 2) -> DataFrame:
    """(video, seq, column, y, text, conf): the lines of the stretches (video, start_s, end_s), each once. Of a
    stretch of up to `card_s`, an animated card, only the sharpest frames are read."""
    times = ranges.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("end_s") - F.col("start_s")) / step_s + 1e-9).cast("int"))).alias("i"))
    times = times.withColumn("t", F.col("start_s") + F.col("i") * step_s).withColumn("card", F.col("end_s") - F.col("start_s") <= card_s)
    frames = focus(seek(times.select("video", "t").distinct(), grab)).join(times.select("video", "t", "start_s", "card").distinct(), ["video", "t"])
    rank = F.row_number().over(Window.partitionBy("video", "start_s").orderBy(F.desc("sharpness"), "t"))
    frames = frames.withColumn("_n", rank).where(~F.col("card") | (F.col("_n") <= k)).dropDuplicates(["video", "t"])
    lines = read(frames, reader).select("video", "t", ((F.col("y0") + F.col("y1")) / 2).alias("y"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), "text", "conf")
    return spatial.stitch(lines, "video", columns)
