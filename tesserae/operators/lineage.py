"""Trees of exploration: ranking, paths to the root, filters, and the rendered log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import IMPACT
from ..plans.cuts import cut


def with_impact(nodes: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])
    rest = F.when(F.col("verdict") == "kept", 0.05).otherwise(0.0)
    return nodes.withColumn("impact", F.coalesce(F.element_at(known, F.col("id")), rest))


def kept(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Nodes with the verdict kept; "keep" counts too unless strict."""
    return nodes.where(F.col("verdict").isin("kept") if strict else F.col("verdict").isin("kept", "keep"))


def rank(nodes: DataFrame, strict: bool = True) -> DataFrame:
    return kept(with_impact(nodes), strict).where("impact > 0").orderBy(F.desc("impact"), "seq")


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path, depth): from the root down to each node. An unknown parent ends it; a tree that runs in a
    circle is an error.

    Paths double their length by each round's join. The nodes that are some others' 2^k-th ancestors get fewer
    with every k, so where as many are left as the round before they stand in a circle, or above one."""
    up = nodes.select("id", F.col("parent").alias("at"), F.col("id").cast("string").alias("path"), F.lit(1).alias("depth"))
    before = None
    while left := up.select("at").distinct().where("at IS NOT NULL").count():
        if left == before:
            raise ValueError("the tree runs in a circle")
        before, open_ = left, up.where("at IS NOT NULL")
        # in late rounds few ancestors are asked for by all rows: only those are met
        tops = up.join(open_.select(F.col("at").alias("id")).distinct(), "id", "left_semi")
        tops = tops.select(F.col("id").alias("at"), F.col("at").alias("_up"), F.col("path").alias("_over"), F.col("depth").alias("_more"))
        longer = open_.join(tops, "at", "left").select("id", F.col("_up").alias("at"), F.concat_ws(" <- ", "_over", "path").alias("path"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
        up = cut(up.where("at IS NULL").unionByName(longer))
    return up.groupBy("id").agg(F.coalesce(F.max_by("path", "depth"), F.lit("")).alias("path"), F.max("depth").alias("depth"))


def by_verdict(nodes: DataFrame, verdict: str) -> DataFrame:
    return nodes.where(F.col("verdict") == verdict).orderBy("seq")


def search(nodes: DataFrame, word: str) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", "intent", "action", "observation", "metric"))
    return nodes.where(F.contains(blob, F.lit(word.lower()))).orderBy("seq")


def round_order(r: Column) -> list[Column]:
    """Numbered rounds first, then others, then open fronts, then dead ends."""
    return [r == "x", r == "open", F.when(r.rlike("^[0-9]+$"), r.cast("int")).otherwise(999), r]


def render(nodes: DataFrame) -> DataFrame:
    """(round, text): a Markdown section for each round, in order. A parent that is not there is not named."""
    known = nodes.select(F.col("id").alias("parent")).distinct()
    n = with_impact(nodes).drop("parent").join(nodes.select("seq", "parent").join(known, "parent"), "seq", "left")
    head = F.concat(F.lit("- **"), "id", F.lit("** ["), "verdict", F.when(F.col("id").isin(list(IMPACT)), F.concat(F.lit(", impact "), F.format_number("impact", 2))).otherwise(""), F.lit("]"), F.coalesce(F.concat(F.lit(" commit "), F.nullif("commit", F.lit(""))), F.lit("")))
    parent = F.when(F.col("parent").isNotNull(), F.concat(F.lit("\n  - branched from: "), "parent")).otherwise("")
    item = F.concat(head, F.lit("\n  - intent: "), "intent", F.lit("\n  - action: "), "action", F.lit("\n  - outcome: "), "observation", F.lit(" (metric: "), "metric", F.lit(")"), parent)
    grouped = n.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("t")))).alias("i"))
    title = F.when(F.col("round") == "x", "Dead ends (tried, dropped, why)").when(F.col("round") == "open", "Declared-open fronts").otherwise(F.concat(F.lit("Round "), "round"))
    text = F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform("i", lambda s: s["t"]), "\n"))
    return grouped.select("round", text.alias("text")).orderBy(*round_order(F.col("round")))


def ideas(nodes: DataFrame) -> DataFrame:
    """(id, impact, line): the nodes of a set worth, whatever their verdict, the best first."""
    worth = nodes.where(F.col("id").isin([i for i, v in IMPACT.items() if v > 0]))
    line = F.concat(F.lit("1. "), F.format_number("impact", 2), F.lit(" `"), "id", F.lit("` - "), "intent", F.lit(" ["), "metric", F.lit("]"))
    return with_impact(worth).select("id", "impact", line.alias("line"), "seq").orderBy(F.desc("impact"), "seq").drop("seq")


def log(nodes: DataFrame) -> DataFrame:
    """(ord, text): the whole log, section by section: a heading, the rounds in order, the ranked ideas."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "# Log of the exploration\n\nEvery decision with its outcome. Verdicts: kept, dropped, open.")], "ord int, text string")
    rounds = render(nodes).withColumn("ord", F.row_number().over(Window.orderBy(*round_order(F.col("round")))))  # rounds are few
    lines = F.array_sort(F.collect_list(F.struct((-F.col("impact")).alias("i"), "seq", "line")))
    best = ideas(nodes).join(nodes.select("id", "seq"), "id").agg(lines.alias("l"))
    text = F.concat(F.lit("## Ranked ideas\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    last = best.select(F.lit(2**31 - 1).alias("ord"), text.alias("text"))
    return head.unionByName(rounds.select("ord", "text")).unionByName(last).orderBy("ord")
