"""Operator 2: mixing sources to target weights.

Each document gets a hash-random key (the MD5 of its id, which any engine can compute). Within its
source the documents stand in key order, and the running sum of their sizes is cut at the source's
budget. The running sum is distributed: keys fall into hash buckets, the buckets of a source are
summed first (with a combine before the shuffle, so a hot source costs no more than another), the
bucket totals are scanned once, and only then does each small (source, bucket) group scan its rows.

Targets come from integers and one division, so that reruns and other engines agree to the bit.

Defined results: null or empty text has size 0 and takes nothing; a null source is a source, ranked
last; an empty table gives no rows; equal rows with equal ids are interchangeable and stand one
after the other; other columns of the input are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count

WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MAX_EPOCHS = 3
#: Hexadecimal digits of the key that name the bucket: 4,096 buckets to a source.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Sources share the sum of all sizes by weight; a target above `max_epochs` times its source's size
    stops there and the rest is shared again. In order of cap to weight the stopped sources come
    first, so one scan over the few source rows finds the level at which the sharing settles."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (k + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs).cast("long") * F.col("source_size"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("cap") * F.col("left_weight") <= F.col("weight") * F.col("left"))
    )
    per = per.withColumn("rest", F.min(F.when(~F.col("stops"), F.struct(F.col("left_weight") * -1, "left", "left_weight"))).over(everything))
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("rest.left")).cast("double") / F.col("rest.left_weight").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words that the mix takes of each document.

    The budget is floor(target); a source gives whole epochs first, then the documents that come
    first in key order, the last of them in part, so that the words taken are the budget exactly."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", _key(F.col("doc_id")))
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    targets = source_targets(buckets.select("source", F.col("bucket_size").alias("size")), weights, max_epochs)
    starts = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    targets = targets.select(F.col("source").alias("s2"), "source_size", "target")
    starts = starts.join(targets, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    scanned = sized.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    out = scanned.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    epochs = epochs.cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inner")))
    taken = (epochs * F.col("size") + part).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents, each as often as the mix takes it; a document that the budget cuts stays
    whole if at least half of it is taken. The columns are those of the input."""
    mixed = mix(docs).select(F.col("doc_id").alias("_id"), F.struct("source", "size").alias("_of"), "size", "taken")
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.lit(1)).cast("int")
    mixed = mixed.select("_id", copies.alias("_copies")).groupBy("_id").agg(F.max("_copies").alias("_copies"))
    joined = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["_id"]))
    repeated = joined.where("_copies > 0").withColumn("_epoch", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, 3 * source_size AS cap FROM p),
l AS (SELECT *, (SELECT sum(source_size) FROM p)::BIGINT
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
               (SELECT sum(weight) FROM w)::BIGINT
               - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_weight
      FROM w),
f AS (SELECT max(rest_weight) AS rw, arg_max(rest, rest_weight) AS r FROM l WHERE cap * rest_weight > weight * rest),
t AS (SELECT source, source_size, CASE WHEN cap * rest_weight <= weight * rest THEN cap::DOUBLE ELSE (weight * r)::DOUBLE / rw::DOUBLE END AS target FROM l, f),
s AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM s
"""
