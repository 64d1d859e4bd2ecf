"""Operator 6: toxicity by subword-bag embeddings averaged into a linear softmax.

A word's features are the hashed character n-grams of "<word>" and the word itself, so an unseen
misspelling shares most of its vectors with the word it comes from. A word is the average of its
features' embeddings; a softmax over two classes reads it. Both are trained jointly in numpy.
A text is as toxic as its most toxic stretch: it is read in windows of a fixed number of distinct
words, each window is an average of its words, and the text's logit is a smooth maximum over windows
(so a long clean text cannot dilute one insult, and one odd clean word has a window against it).

Training rows are a bounded sample of the labelled rows whose crc32(doc_id as text) mod 5 is not 0:
the `per_class` rows of each label with the smallest MD5 of the id, up to `most_bytes` of text. Whole texts
are used. Window, sample, epochs and the other settings were chosen on remainder 1, after training on 2 to 4. Labels,
lang, source and doc_id are no features. Inference folds embeddings and softmax into one number per
hash bucket (a table of fixed size, which is all that is sent to the executors).

Defined results: null and empty text are scored by the bias alone; documents without labels are
scored alike; a null doc_id counts as an empty id, which is held out; without training rows of both classes every score is 0; equal texts, equal scores; an
empty table gives no rows; other columns are left out."""

from __future__ import annotations

import collections
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, mix64, table, text_batches

BUCKETS = 1 << 17
DIMS = 4
WINDOW = 24
PER_CLASS = 1500
#: Bytes of text that are learnt from, half for each class.
MOST_BYTES = 64_000_000
EPOCHS = 60
#: Steepness of the smooth maximum; texts that a feature must occur in; step sizes of embeddings, softmax, bias.
SHARP = 2.0
LEAST_DOCS = 8
RATES = (16.0, 0.1, 0.2)
FOLDS = 5
KEPT_WORDS = 100_000
_WORD = re.compile(r"\w+")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every feature: each word's n-grams of 3 to 5 bytes within "<word>", and itself."""
    buf = np.frombuffer(b"".join([b"<%b>" % w.encode() for w in words]), np.uint8)
    starts = np.flatnonzero(buf == 60)
    ends = np.r_[starts[1:], len(buf)]
    owner = np.repeat(np.arange(len(words)), ends - starts)
    code = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    left = np.repeat(ends, ends - starts) - np.arange(len(buf))  # bytes to the word's end
    h, buckets, owners = mix64(code), [], []
    for n in range(2, 6):
        m = len(buf) - n + 1
        if m <= 0:
            break
        h = mix64(h[:m] * np.uint64(0x100000001B3) + code[n - 1 :])
        if n > 2:
            ok = left[:m] >= n
            buckets.append(h[ok])
            owners.append(owner[:m][ok])
    place = np.arange(len(buf)) - np.repeat(starts, ends - starts)
    whole = np.add.reduceat(mix64(code + place.astype(np.uint64)), starts)
    buckets.append(mix64(whole))
    owners.append(np.arange(len(words)))
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def words(text: str) -> list[str]:
    """Distinct words in order of appearance."""
    return list(dict.fromkeys(_WORD.findall(text.lower())))


class Model:
    """What inference needs: a value per bucket and the bias."""

    def __init__(self, table: np.ndarray | None = None, bias: float = 0.0):
        self.table, self.bias, self.kept = table, bias, {}

    def values(self, words: list[str]) -> np.ndarray:
        """The average of each word's features."""
        at, owner = features(words)
        return np.bincount(owner, self.table[at], len(words)) / np.bincount(owner, minlength=len(words))

    def score(self, texts: list[str]) -> list[float]:
        if self.table is None:
            return [0.0] * len(texts)
        docs = [words(t) for t in texts]
        new = list({w: None for d in docs for w in d if w not in self.kept})
        more = dict(zip(new, self.values(new).tolist(), strict=True)) if new else {}
        found = collections.ChainMap(self.kept, more)
        if len(self.kept) < KEPT_WORDS:
            self.kept.update(more)
            found = self.kept
        out = []
        for d in docs:
            z = self.bias
            if d:
                v = np.fromiter(map(found.__getitem__, d), np.float64, len(d))
                z += pooled(np.add.reduceat(v, np.arange(0, len(v), WINDOW)) / WINDOW)
            out.append(float(_sigmoid(z)))
        return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pooled(z: np.ndarray) -> float:
    """A smooth maximum."""
    m = z.max()
    return float(m + np.log(np.exp(SHARP * (z - m)).sum()) / SHARP)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> Model:
    """Joint full-batch descent over embeddings and softmax; deterministic.

    Features of under `LEAST_DOCS` training texts keep no vector. Steps are scaled by the largest
    entry of the averaged gradient, so that features grow by how often they tell the classes apart."""
    if len(set(labels.tolist())) < 2:
        return Model()
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    doc_words = [[vocab.setdefault(w, len(vocab)) for w in words(t)] for t in texts]
    keep = [k for k, d in enumerate(doc_words) if d]
    doc_words, y = [doc_words[k] for k in keep], labels[keep].astype(np.float64)
    f_all, f_word = features(list(vocab))
    f_len = np.bincount(f_word, minlength=len(vocab))
    w_all = np.concatenate([np.asarray(d) for d in doc_words])
    docs_of_word = np.bincount(w_all, minlength=len(vocab))
    common = np.bincount(f_all, docs_of_word[f_word], BUCKETS) >= LEAST_DOCS
    kept = common[f_all]
    f_all, f_word = f_all[kept], f_word[kept]
    used, f_all = np.unique(f_all, return_inverse=True)
    d_len = np.array([len(d) for d in doc_words])
    n_win = -(-d_len // WINDOW)
    win_at = np.r_[0, np.cumsum(n_win)[:-1]]
    w_win = np.repeat(win_at, d_len) + (np.arange(len(w_all)) - np.repeat(np.r_[0, np.cumsum(d_len)[:-1]], d_len)) // WINDOW
    win_doc = np.repeat(np.arange(len(y)), n_win)
    first_word = np.flatnonzero(np.diff(w_win, prepend=-1))
    emb, soft, bias = rng.normal(0, 0.01, (len(used), DIMS)), rng.normal(0, 1, (DIMS, 2)), np.zeros(2)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    momentum = [np.zeros_like(p) for p in (emb, soft, bias)]
    for t in range(1, epochs + 1):
        # the loss sees the word vectors through the difference of the two classes alone
        diff = soft[:, 1] - soft[:, 0]
        word_z = np.bincount(f_word, (emb @ diff)[f_all], len(vocab)) / f_len
        z = np.add.reduceat(word_z[w_all], first_word) / WINDOW
        top = np.maximum.reduceat(z, win_at)
        e = np.exp(SHARP * (z - top[win_doc]))
        s = np.add.reduceat(e, win_at)
        g = (_sigmoid(top + np.log(s) / SHARP + bias[1] - bias[0]) - y) * weight
        g_win = g[win_doc] * e / s[win_doc] / WINDOW
        g_word = np.bincount(w_all, g_win[w_win], len(vocab)) / f_len
        g_feature = np.bincount(f_all, g_word[f_word], len(used))
        g_soft = emb.T @ g_feature
        grads = [g_feature[:, None] * diff[None, :], np.stack([-g_soft, g_soft], 1), np.array([-g.sum(), g.sum()])]
        for k, (p, gr, rate) in enumerate(zip((emb, soft, bias), grads, RATES, strict=True)):
            momentum[k] = 0.7 * momentum[k] + 0.3 * gr
            p -= rate * (1 - t / (epochs + 1)) * momentum[k] / (np.abs(momentum[k]).max() + 1e-12)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = emb @ (soft[:, 1] - soft[:, 0])
    return Model(out, float(bias[1] - bias[0]))


def _fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _learn(t: pa.Table) -> pa.Table:
    """The model of the chosen rows, which are few, as its table and bias (null: no model)."""
    t = t.sort_by("doc_id")
    model = train(t.column("text").to_pylist(), np.array(t.column("toxic").to_pylist()))
    give_back()
    return pa.table({"bias": [model.bias], "weights": pa.array([None if model.table is None else model.table.tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """Learns from at most `per_class` labelled rows of each class that are not held out, and at most
    `most_bytes` of their text; one task trains, and the driver gets the table alone."""
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    labelled = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = labelled.where("toxic = 1").orderBy(order).limit(per_class).union(labelled.where("toxic = 0").orderBy(order).limit(per_class))
    chosen = F.broadcast(chosen)  # two times per_class rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text IS NOT NULL").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    read = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))  # of the chosen rows
    rows = rows.withColumn("read", read).where(F.col("read") <= most_bytes // 2)
    got = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_learn, "bias double, weights binary").collect()
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]) if got and got[0]["weights"] is not None else Model()


def _scores(batches: Iterator[pa.RecordBatch], table: np.ndarray | None, bias: float) -> Iterator[pa.RecordBatch]:
    model = Model(table, bias)
    for batch, texts in text_batches(batches, "text"):
        scores = model.score([t.decode("utf-8", "replace") for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    rows = docs.select("doc_id", "text", (_fold() == 0).alias("held_out"))
    return rows.mapInArrow(functools.partial(_scores, table=model.table, bias=model.bias), "doc_id long, held_out boolean, score double, predicted int")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def _clean(batches: Iterator[pa.RecordBatch], table: np.ndarray | None, bias: float) -> Iterator[pa.RecordBatch]:
    model = Model(table, bias)
    for batch, texts in text_batches(batches, "text"):
        yield batch.filter(pa.array([s < 0.5 for s in model.score([t.decode("utf-8", "replace") for t in texts])]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under 0.5, as they are."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.mapInArrow(functools.partial(_clean, table=model.table, bias=model.bias), docs.schema)
