"""Folding model replies and labels into results: review bundles and merges, corrections, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as X
from ..functions.kernels import fuzzy_score_udf
from .evidence import dedupe, match_labels

QUESTION = "List every book title and every author band you can read in this image. For each: title, author (if legible), and rough box. Skip logos and set dressing that are not books."
REPLY = "array<struct<kind:string,title:string,author:string>>"


def bundle(images: DataFrame) -> DataFrame:
    """(id, image, question): one open question per image."""
    return images.select((F.row_number().over(Window.orderBy("image")) - 1).alias("id"), "image", F.lit(QUESTION).alias("question"))


def parse_reply(content, schema: str = REPLY):
    """A model's JSON list, fenced or not; null where it is none."""
    bare = F.regexp_replace(F.trim(content), r"^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema)


def ask(items: DataFrame, model: Callable[[list[str]], list[str]], column: str, chunk: int = 40) -> DataFrame:
    """Adds reply: what an injected model says to each row's text, in chunks. The model is called on executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), chunk):
                part = b.iloc[s : s + chunk].copy()
                part["reply"] = model(part[column].tolist())
                yield part

    return items.mapInPandas(run, StructType([*items.schema.fields, StructField("reply", StringType())]))


def extract_titles(segments: DataFrame, model: Callable[[list[str]], list[str]], key: str = "doc_id", chunk: int = 80) -> DataFrame:
    """(key, phrase, t): the titles an injected model finds in a transcript, `chunk` segments at a time. It gets the
    segments of a chunk with their times, one a line, and answers with a JSON list of {title, t}; what is no
    such list counts for nothing, a title counts once, at its first time."""
    place = Window.partitionBy(key).orderBy("seq")
    lines = segments.select(key, "seq", F.floor((F.row_number().over(place) - 1) / chunk).alias("_c"), F.concat(F.lit("["), F.bround("start", 1).cast("string"), F.lit("] "), "text").alias("_l"))
    chunks = lines.groupBy(key, "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_l"))), lambda x: x["_l"]), "\n").alias("said"))
    got = ask(chunks, model, "said", 1).withColumn("e", F.explode(parse_reply(F.col("reply"), "array<struct<title:string,t:double>>")))
    title = F.trim("e.title")
    found = got.where(title != "").groupBy(key, F.lower(title).alias("_k")).agg(F.min(F.struct(F.coalesce("e.t", F.lit(0.0)).alias("t"), title.alias("phrase"))).alias("m"))
    return found.select(key, "m.phrase", "m.t")


def correct_phrases(phrases: DataFrame, model: Callable[[list[str]], list[str]], chunk: int = 40) -> DataFrame:
    """(phrase, fixed): an injected model's spelling of each distinct phrase, `chunk` at a time; unanswered ones stay."""
    said = ask(phrases.select("phrase").where("phrase IS NOT NULL").distinct(), model, "phrase", chunk)
    return said.select("phrase", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), "phrase").alias("fixed"))


def corrected(phrases: DataFrame, corrections: DataFrame) -> DataFrame:
    """Phrases with each replaced by its correction if there is one. corrections: phrase, fixed."""
    fixed = corrections.groupBy("phrase").agg(F.min("fixed").alias("_fixed"))
    return phrases.join(fixed, "phrase", "left").withColumn("phrase", F.coalesce(F.nullif("_fixed", F.lit("")), "phrase")).drop("_fixed")


def merge(entries: DataFrame, reviewed: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(all entries after merging, those the review added). reviewed: key, seq, verdict, title, author, image, year."""
    books = reviewed.where("verdict = 'book' AND title <> ''")
    have = entries.select(key, F.lower("title").alias("_t")).distinct()
    fresh = books.withColumn("_t", F.lower("title")).join(have, [key, "_t"], "left_anti")
    last = entries.groupBy(key).agg(F.max("ord").alias("_last"))
    authors = F.when(F.col("author") != "", F.array("author")).otherwise(F.array().cast("array<string>"))
    rows = fresh.join(last, key, "left").select(
        key, (F.coalesce("_last", F.lit(-1)) + 1 + F.col("seq")).cast("long").alias("ord"), F.col("title").alias("phrase"), "title", authors.alias("authors"), F.col("year").cast("int").alias("year"),
        F.lit(1.0).alias("score"), F.lit("vlm").alias("match_type"), F.lit(0).alias("freq"), F.lit("vlm").alias("source"), F.lit("confirmed").alias("status"),
    )
    return dedupe(entries.select(*rows.columns).unionByName(rows), key), rows


def new_bands(bands: DataFrame, reviewed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name): author bands with those of a review that are not there yet, by lower-cased name."""
    added = reviewed.where("verdict = 'author_band' AND title <> ''").select(key, F.col("title").alias("name"))
    have = bands.select(key, F.lower("name").alias("_n"))
    fresh = added.withColumn("_n", F.lower("name")).join(have.distinct(), [key, "_n"], "left_anti").drop("_n")
    return bands.select(key, "name").unionByName(fresh)


def spine_scores(labels: DataFrame, reads: DataFrame, entries: DataFrame, bands: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kind, label, found, score, verified, right_record, reported_author) of each confident label.

    labels: key, kind (book or author_band), label, author, confident; reads: key, ord, text; entries: key,
    ord, phrase, matched_as, title, authors, status; bands: key, name. A book's record is the entry that goes
    by what was found (a phrase before other names), else by the best match among the entries' own names."""
    asked = labels.where("confident AND label IS NOT NULL")
    given = entries.select(key, "ord", F.posexplode(F.array("phrase", "matched_as", "title")).alias("which", "name"), "title", "authors", "status").where("name IS NOT NULL AND name <> ''")
    # of entries with one phrase the last counts, of those that share another name the first
    rank = F.when(F.col("which") == 0, F.struct(F.lit(0).alias("r"), (-F.col("ord")).alias("o"), F.lit(0).alias("w"))).otherwise(F.struct(F.lit(1).alias("r"), F.col("ord").alias("o"), F.col("which").alias("w")))
    records = given.groupBy(key, X.norm(F.col("name")).alias("_k")).agg(F.min_by(F.struct("title", "authors", "status"), rank).alias("rec"))
    names = given.select(key, F.struct(F.lit(1).alias("a"), F.col("which").alias("b"), F.col("ord").alias("c")).alias("o"), F.col("name").alias("text"))
    names = names.unionByName(bands.select(key, F.struct(F.lit(1).alias("a"), F.lit(3).alias("b"), F.lit(0).cast("long").alias("c")).alias("o"), F.col("name").alias("text")).distinct())
    seen = reads.select(key, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("ord").cast("long").alias("c")).alias("o"), "text")
    placed = lambda t: t.where("text IS NOT NULL").withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("o", "text"))).drop("o")
    hit = match_labels(asked, placed(seen.unionByName(names)), key).withColumn("_k", X.norm(F.col("found"))).join(records, [key, "_k"], "left").drop("_k")
    own = match_labels(asked, placed(names), key).withColumn("_k", X.norm(F.col("found"))).join(records.withColumnRenamed("rec", "other"), [key, "_k"], "left").select(key, "label", "other")
    rows = asked.join(hit, [key, "label"]).join(own, [key, "label"])
    good = F.when(F.coalesce("rec", "other")["status"].isin("confirmed", "verified"), F.coalesce("rec", "other"))
    rows = rows.withColumn("good", good)
    surname = F.nullif(F.element_at(F.split(F.trim(F.lower(F.coalesce("author", F.lit("")))), r"\s+"), -1), F.lit(""))
    by_author = F.coalesce(F.contains(F.lower(F.array_join(F.col("good")["authors"], " ")), surname), F.lit(False))
    by_title = fuzzy_score_udf("label", F.coalesce(F.col("good")["title"], F.lit(""))) >= 0.8
    book, found = F.col("kind") == "book", F.col("good").isNotNull()
    shown = bands.select(key, F.col("name").alias("found"), F.lit(True).alias("_band")).distinct()
    rows = rows.join(shown, [key, "found"], "left")
    reported = F.col("found").isNotNull() & (F.coalesce("_band", F.lit(False)) | F.coalesce(F.col("rec")["status"] == "author", F.lit(False)))
    return rows.select(key, "kind", "label", "found", "score", F.when(book, found).alias("verified"), F.when(book, found & (by_author | by_title)).alias("right_record"), F.when(~book, reported).alias("reported_author"))


def recalls(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, recall_surface, recall_verified, recall_right_record, bands_reported) over scored labels."""
    share = lambda c, kind: F.bround(F.avg(F.when(F.col("kind") == kind, c.cast("double"))), 2)
    return scores.groupBy(key).agg(
        share(F.col("found").isNotNull(), "book").alias("recall_surface"), share(F.col("verified"), "book").alias("recall_verified"),
        share(F.col("right_record"), "book").alias("recall_right_record"), share(F.col("reported_author"), "author_band").alias("bands_reported"),
    )
