"""Operator 10: exact top-k inner products, score at a time over an impact-ordered index.

Index. Vectors (integer components) are dealt into blocks. A component is a posting (dimension, vector,
impact). A block's postings are quantised by the bit length of their impact: segment b holds those with
2^(b-1) <= |impact| < 2^b, dimension by dimension. Segments are kept from the highest impact down, each
with the norm of what the lower ones leave of each vector.

Search. A query takes a block's segments in descending impact and adds query component times impact to
the accumulators of the vectors they name. After each, the part of a score that is still to come is at most
the query's norm times the rest's norm (Cauchy and Schwarz), plus what rounding can come to. The k-th best
of the lower bounds proves which vectors can no longer enter; once the possible members are few, or nothing
is left, they are rescored exactly from the full vectors. Nothing stops without that proof, so the result
is exact.

Blocks of vectors meet batches of queries in tiles, so a task holds one of each however many there are;
their k best are merged per query by a ranking that Spark cuts to k rows before the shuffle and after.

Defined results: null vectors and vectors with null or non-finite components take no part, on either
side; vectors of another length than the query's are no candidates for it; equal scores rank by
smaller id; repeated rows with another id are candidates of their own, all rows with the query's own
id are left out; a query with fewer candidates gets all; an empty table gives no rows; a score
beyond 64 bits is null, its rank is exact."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 20
BLOCK = 4096
QUERY_BATCH = 512
#: Scores whose bound is below it are exact in double precision; others are summed as Python's integers.
_EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors whose components are all finite, as doubles."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    big = lambda y: F.abs(y) >= _EXACT  # integers already, and maybe none that floor() can return
    v = F.transform(x, lambda e: F.when(big(e.cast("double") * scale), e.cast("double") * scale).otherwise(F.floor(e.cast("double") * scale).cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad).select("vec_id", v.alias("v"))


def build(ids: np.ndarray, matrix: np.ndarray) -> dict:
    """The posting segments of one block, highest impact first: (dimensions, vectors, impacts, the norms of
    the rest)."""
    bits = np.frexp(np.abs(matrix))[1]
    dims, rows = np.nonzero(matrix.T)  # dimension by dimension
    impacts, level = matrix[rows, dims], bits[rows, dims]
    squares = np.bincount(rows, impacts * impacts, len(ids))
    segments = []
    for b in np.unique(level)[::-1]:
        own = level == b
        d, r, x = dims[own], rows[own], impacts[own]
        squares = np.maximum(0.0, squares - np.bincount(r, x * x, len(ids)))
        segments.append((d, r, x, squares))
    if segments:
        segments[-1] = (*segments[-1][:3], np.zeros(len(ids)))
    norms = np.sqrt((matrix * matrix).sum(1))
    # a difference of squares is off by some roundings of the whole square
    off = norms * np.sqrt(8 * (matrix.shape[1] + 2) * np.finfo(np.float64).eps)
    segments = [(d, r, x, np.where(rest > 0, np.sqrt(rest) + off, 0.0) if k == len(segments) - 1 else np.sqrt(rest) + off) for k, (d, r, x, rest) in enumerate(segments)]
    return {"ids": ids, "matrix": matrix, "segments": segments, "norms": norms}


def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best of the block for each query."""
    ids, matrix, segments = index["ids"], index["matrix"], index["segments"]
    n, out_rows, out_cols = len(ids), [], []
    by_id = np.argsort(ids, kind="stable")
    first, last = (np.searchsorted(ids[by_id], query_ids, side) for side in ("left", "right"))
    # more than the rounding of a score can come to, whatever the order of its sums
    rounding = 8 * (matrix.shape[1] + len(segments) + 2) * np.finfo(np.float64).eps * index["norms"]
    for row, q in enumerate(queries):
        norm, own = float(np.sqrt(q @ q)), by_id[first[row] : last[row]]
        keep = min(n, k + len(own))
        scores, possible = np.zeros(n), np.arange(n)
        for dims, rows, impacts, rest in segments:
            scores += np.bincount(rows, q[dims] * impacts, n)
            slack = norm * (rest + rounding)
            low = scores - slack
            bar = np.partition(low, n - keep)[n - keep]
            possible = np.flatnonzero(scores + slack >= bar)
            if len(possible) <= 4 * keep:
                break
        possible = possible[~np.isin(possible, own)] if len(own) else possible
        out_rows.append(np.full(len(possible), row))
        out_cols.append(possible)
    rows, cols = np.concatenate([*out_rows, np.zeros(0, np.int64)]), np.concatenate([*out_cols, np.zeros(0, np.int64)])
    exact = _exact(queries, matrix, rows, cols)
    place = exact if exact.dtype != object else np.unique(exact, return_inverse=True)[1]
    order = np.lexsort((ids[cols], -place, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    best = rank < k
    return rows[best], ids[cols[best]], exact[best]


def _exact(queries: np.ndarray, matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The inner products of pairs, as 64-bit integers or, where one may not fit in a double, as Python's."""
    exact = np.empty(len(rows), np.int64)
    size, width = np.abs(queries).max(1, initial=0), np.abs(matrix).max(1, initial=0)
    large = matrix.shape[1] * size[rows] * width[cols] >= _EXACT
    fits = np.flatnonzero(~large)
    for s in range(0, len(fits), 100_000):
        at = fits[s : s + 100_000]
        exact[at] = np.einsum("ij,ij->i", queries[rows[at]], matrix[cols[at]]).astype(np.int64)
    if large.any():
        exact = exact.astype(object)
        for i in np.flatnonzero(large):
            exact[i] = sum(int(x) * int(y) for x, y in zip(queries[rows[i]], matrix[cols[i]], strict=True))
    return exact


def _wide(x: int) -> tuple[int, int, str | None]:
    """(side, score, wide): by side, then -score, then wide, scores stand from the highest down; side is not 0
    for those beyond 64 bits, which `wide` orders: by their digits, or from the top by what they lack to nines."""
    if abs(x) < 2**63:
        return 0, x, None
    d = str(abs(x))
    return (1, 0, f"{len(d):04d}{d}") if x < 0 else (-1, 0, f"{9999 - len(d):04d}" + "".join(str(9 - int(c)) for c in d))


def _search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    for dims in set(queries["dims"]) & set(vectors["dims"]):
        v, q = vectors[vectors["dims"] == dims], queries[queries["dims"] == dims]
        matrix = np.frombuffer(b"".join(v["v"]), np.float64).reshape(len(v), dims)
        qs = np.frombuffer(b"".join(q["v"]), np.float64).reshape(len(q), dims)
        index, q_ids = build(v["vec_id"].to_numpy(), matrix), q["vec_id"].to_numpy()
        for s in range(0, len(q), QUERY_BATCH):
            rows, ids, scores = search(index, q_ids[s : s + QUERY_BATCH], qs[s : s + QUERY_BATCH], k)
            out.append(pd.DataFrame({"query_id": q_ids[s:][rows], "vec_id": ids, "score": scores, "side": 0, "wide": None}))
            if scores.dtype == object:
                out[-1][["side", "score", "wide"]] = [_wide(x) for x in scores.tolist()]
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "side": [], "wide": []}).astype({"wide": object})


def _binary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["dims"] = [len(v) for v in b["v"]]
        b["v"] = [np.asarray(v, np.float64).tobytes() for v in b["v"]]
        yield b


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of (vec_id, v) rows: the k highest integer inner products."""
    pack = lambda df: df.mapInPandas(_binary, "vec_id long, v binary, dims int")
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)))
    meet = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    blocks, batches = (max(1, -(-df.count() // block)) for df in (vectors, queries))
    packed = meet(deal(pack(vectors), blocks, "block"), batches, "batch")
    asked = meet(deal(pack(queries).distinct(), batches, "batch"), blocks, "block")
    found = packed.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInPandas(functools.partial(_search_block, k=k), "query_id long, vec_id long, score long, side int, wide string")
    best = Window.partitionBy("query_id").orderBy("side", F.desc("score"), "wide", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(F.col("side") == 0, F.col("score")).alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
