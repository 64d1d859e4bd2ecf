"""Readers with explicit schemas: keys may be absent, so nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPINE_READS = "text string, conf double, t double, preset string, upscale int, x double, y double, w double, h double"
PANELS = "seg string, file string, x long, y long, w long, h long, frame_frac double, ar double, text string"
SCROLL_LINES = "column int, y double, text string, conf double"
WORD = "struct<word:string,start:double,end:double,probability:double>"
SEGMENT = f"struct<start:double,end:double,t:double,text:string,words:array<{WORD}>>"
DOC = "struct<title:string,title_suggest:string,author_name:array<string>,first_publish_year:int,edition_count:int,ratings_average:double,publisher:string>"
REVIEW = "entries array<struct<verdict:string,title:string,author:string,image:string,model:string,year:int,note:string,ocr:string>>"
LABELS = "video string, clip string, method string, books array<struct<title:string,author:string,confident:boolean,shelf:int,x:int,w:int>>, author_bands array<struct<name:string,confident:boolean,shelf:int>>"
NODES = "id string, round string, parent string, intent string, action string, observation string, metric string, verdict string, commit string"
GAZETTEER = "struct<phrase:string,matched_as:string,title:string,authors:array<string>,year:int,score:double,match_type:string,editions:int,freq:int,source:string,status:string,verified:boolean,context_ok:boolean,provenance:array<string>>"


def label_schema() -> str:
    """A label file as one struct."""
    return f"struct<{_as_struct(LABELS)}>"


def book_schema() -> str:
    """A compiled report as one struct."""
    return f"struct<gazetteer:array<{GAZETTEER}>,author_spines:array<string>>"


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def json_rows(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(path, seq, ...): the rows of files that hold one array of objects, in file order."""
    rows = whole(spark, path).select("path", F.posexplode(F.from_json("value", f"array<struct<{_as_struct(item)}>>")).alias("seq", "r"))
    return rows.select("path", "seq", "r.*")


def _as_struct(ddl: str) -> str:
    """Column definitions in the form that a nested type takes."""
    out, depth = [], 0
    for part in ddl.split(", "):
        name, _, kind = part.partition(" ") if depth == 0 else ("", "", part)
        out.append(f"{name}:{kind}" if name else kind)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, start, end, t, text, words) of transcript files."""
    got = whole(spark, path).select("path", F.posexplode(F.from_json("value", f"struct<segments:array<{SEGMENT}>>")["segments"]).alias("seq", "s"))
    return got.select("path", "seq", "s.*")


def ocr_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(frame, seq, x0, y0, x1, y1, text, conf) of a file that maps frames to blocks."""
    kind = "map<string,array<struct<box:array<double>,text:string,conf:double>>>"
    frames = whole(spark, path).select(F.explode(F.from_json("value", kind)).alias("frame", "blocks"))
    rows = frames.select("frame", F.posexplode("blocks").alias("seq", "b"))
    box = [F.get("b.box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("frame", "seq", *box, "b.text", "b.conf")


def lookup_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, known, seq, document columns) of lookup caches. A key whose documents are an empty list is
    known to have none (one row, seq null); a key without a list is a failed lookup (known false)."""
    entries = whole(spark, path).select(F.explode(F.from_json("value", f"map<string,struct<docs:array<{DOC}>>>")).alias("key", "e"))
    rows = entries.select("key", F.col("e.docs").isNotNull().alias("known"), F.posexplode_outer("e.docs").alias("seq", "d"))
    return rows.select("key", "known", "seq", "d.*")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ...) of an exploration tree; rounds may be numbers or words."""
    got = whole(spark, path).select(F.posexplode(F.from_json("value", f"struct<nodes:array<struct<{_as_struct(NODES)}>>>")["nodes"]).alias("seq", "n"))
    return got.select("seq", "n.*")


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, ...) of the resolved entries of compiled reports."""
    got = whole(spark, path).select("path", F.posexplode(F.from_json("value", f"struct<gazetteer:array<{GAZETTEER}>>")["gazetteer"]).alias("seq", "g"))
    return got.select("path", "seq", "g.*")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    got = whole(spark, path).select("path", F.posexplode(F.from_json("value", "struct<" + REVIEW.replace(" ", ":", 1) + ">")["entries"]).alias("seq", "e"))
    return got.select("path", "seq", "e.*")


def images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, content) of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def probe(info: DataFrame, column: str = "value") -> DataFrame:
    """Adds duration_s, width, height out of a decoder's description of a video."""
    time = [F.regexp_extract(column, r"Duration: (\d+):(\d+):(\d+(?:\.\d+)?)", k).cast("double") for k in (1, 2, 3)]
    size = [F.regexp_extract(column, r"Video:.*?\b(\d{2,5})x(\d{2,5})\b", k) for k in (1, 2)]
    return info.withColumn("duration_s", time[0] * 3600 + time[1] * 60 + time[2]).withColumn("width", size[0].cast("int")).withColumn("height", size[1].cast("int"))


def frames(videos: DataFrame, decode: Callable[[str, float, float], Iterator[tuple[float, int, int, bytes]]], chunk_s: float = 60.0) -> DataFrame:
    """(video, t, height, width, rgb) of videos (video, duration_s), time range by time range in parallel.
    decode(video, from, to) is injected and yields frames."""
    ranges = videos.select("video", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_s") / chunk_s).cast("int"))).alias("k"), "duration_s")
    ranges = ranges.select("video", (F.col("k") * chunk_s).alias("lo"), F.least(F.col("duration_s"), (F.col("k") + 1) * chunk_s).alias("hi")).where("lo < hi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for t, h, w, rgb in decode(r.video, r.lo, r.hi):
                    yield pd.DataFrame([(r.video, t, h, w, rgb)], columns=["video", "t", "height", "width", "rgb"])

    return ranges.repartition("video", "lo").mapInPandas(run, "video string, t double, height int, width int, rgb binary")


def recognise(images: DataFrame, model: Callable[[bytes], list[tuple[list[float], str, float]]], keep: str = "path") -> DataFrame:
    """(keep, seq, x0, y0, x1, y1, text, conf): what an injected recogniser reads in each image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, content in zip(b[keep], b["content"], strict=True):
                rows = [(k, i, *map(float, box), text, round(float(conf), 3)) for i, (box, text, conf) in enumerate(model(content))]
                yield pd.DataFrame(rows, columns=[keep, "seq", "x0", "y0", "x1", "y1", "text", "conf"])

    return images.select(keep, "content").mapInPandas(run, f"{keep} string, seq int, x0 double, y0 double, x1 double, y1 double, text string, conf double")


def transcribe(audio: DataFrame, model: Callable[[str, float, float], list[tuple[float, float, str]]], chunk_s: float = 300.0) -> DataFrame:
    """(audio, start, end, text): what an injected recogniser hears, chunk by chunk, in the recording's time.
    audio: audio, duration_s."""
    chunks = audio.select("audio", "duration_s", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_s") / chunk_s).cast("int"))).alias("k"))
    chunks = chunks.select("audio", (F.col("k") * chunk_s).alias("lo"), F.least(F.col("duration_s"), (F.col("k") + 1) * chunk_s).alias("hi")).where("lo < hi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rows = [(r.audio, round(r.lo + s, 2), round(r.lo + e, 2), text) for s, e, text in model(r.audio, r.lo, r.hi)]
                yield pd.DataFrame(rows, columns=["audio", "start", "end", "text"])

    return chunks.repartition("audio", "lo").mapInPandas(run, "audio string, start double, end double, text string")


def fetch(phrases: DataFrame, client: Callable[[str], list[dict] | None], tries: int = 3, pause_s: float = 1.0) -> DataFrame:
    """(phrase, known, seq, document columns): an injected catalogue client, asked with growing pauses. A
    failure (None) stays unknown, an empty answer is known."""
    import random
    import time

    def ask(phrase: str) -> list[dict] | None:
        for k in range(tries):
            got = client(phrase)
            if got is not None or k == tries - 1:
                return got
            time.sleep(pause_s * (2**k + random.random()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, docs is not None, docs) for p, docs in ((p, ask(p)) for p in b["phrase"])], columns=["phrase", "known", "docs"])

    got = phrases.select("phrase").distinct().mapInPandas(run, f"phrase string, known boolean, docs array<{DOC}>")
    return got.select("phrase", "known", F.posexplode_outer("docs").alias("seq", "d")).select("phrase", "known", "seq", "d.*")
