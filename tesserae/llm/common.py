"""Shared pieces: table readers, batches of texts, distributed components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: blank and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the cluster's shared folder; only where none is named, as in local tests, sets one beside the
    warehouse, which is shared as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads on from there, so that lost executors lose no
    lineage; files of earlier steps that are done with are given back first."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sweep(spark)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shelve(df: DataFrame) -> tuple[DataFrame, Callable[[], object]]:
    """The rows as Parquet in the shared folder, and what deletes them; columns that repeat take
    little room there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/shelf-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), lambda: remove(spark, folder)


def give_back() -> None:
    """Returns memory that a worker no longer uses to the system: workers live on between tasks, and several
    stand beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most about `limit` bytes of text, one row at least, with the texts as UTF-8 (null: empty)."""
    give_back()
    for batch in batches:
        at = batch.schema.get_field_index(column)
        values = batch.column(at).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.binary_length(values).fill_null(0))
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start), [v.as_py() or b"" for v in values.slice(start, i - start)]
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start), [v.as_py() or b"" for v in values.slice(start)]
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit fingerprints."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id in `edges` (a long, b long): the smallest id that links reach.

    Alternates large and small stars: edges only ever shrink towards the minima, each round is two
    aggregations by id, and the links stay distributed. Each round is cut in the shared folder."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        # large star: every larger neighbour of u goes to the least of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, goes to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        e = small
        # done when every id but the roots has one link, to a root
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.union(e.select("v", "v").distinct())
