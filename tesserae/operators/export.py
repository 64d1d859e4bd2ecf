"""Bibliographies and reports as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bib_key


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _title() -> Column:
    return F.coalesce("title", "phrase")


def bibtex(entries: DataFrame) -> DataFrame:
    """Adds bibtex, a record for each entry."""
    authors = F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, F.array_join("authors", " and ")).otherwise("Unknown")
    note = F.concat(F.lit("score="), F.coalesce(F.col("score").cast("string"), F.lit("None")), F.lit(" via "), _text("match_type"), F.lit("; provenance="), F.array_join(F.coalesce("provenance", F.array().cast("array<string>")), "; "))
    field = lambda name, v: F.concat(F.lit(f"  {name:<6} = {{"), v, F.lit("}"))
    body = F.concat_ws(",\n", field("title", _title()), field("author", authors), field("year", _text("year")), field("note", note))
    return entries.withColumn("bibtex", F.concat(F.lit("@book{"), bib_key(F.col("authors"), F.col("year")), F.lit(",\n"), body, F.lit("\n}")))


def ris(entries: DataFrame) -> DataFrame:
    """Adds ris, a record for each entry."""
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("AU  - "), a, F.lit("\n"))), "")
    year = F.coalesce(F.concat(F.lit("PY  - "), F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("\n")), F.lit(""))
    text = F.concat(F.lit("TY  - BOOK\nTI  - "), _title(), F.lit("\n"), people, year, F.lit("N1  - score="), F.coalesce(F.col("score").cast("string"), F.lit("None")), F.lit(" match="), _text("match_type"), F.lit("\nER  - \n"))
    return entries.withColumn("ris", text)


def section(rows: DataFrame, title: str, line: Column, order: str, key: str) -> DataFrame:
    """(key, title, text): a Markdown section of each key with a line for each row, in order."""
    got = rows.select(key, F.struct(F.col(order).alias("o"), line.alias("t")).alias("l"))
    text = F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda s: F.concat(F.lit("- "), s["t"])), "\n"))
    return got.groupBy(key).agg(F.lit(title).alias("title"), text.alias("text"))


def write_text(rows: DataFrame, column: str, path: str, order: str = "ord", separator: str = "\n\n") -> None:
    """One text file of a column, in order. For exports of one run, which are short."""
    rows.orderBy(order).select(column).coalesce(1).write.mode("overwrite").option("lineSep", separator).text(path)
