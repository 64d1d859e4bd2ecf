"""Operator 9: packing documents into sequences of a fixed length.

Token ids are made next to the scan and never shuffled: what moves are piece descriptions (document,
start, length, checksum). Pieces fall into randomised groups by a hash of their row, so rows of one id or without id spread; each group is
packed on its own by first-fit decreasing, where a tournament tree over the free room of the group's
sequences finds the first one that fits in logarithmic time. A group holds a bounded number of
documents on average, whatever the table's size.

Pieces of full length are sequences of their own. Each sequence is padded to the length, unless what
it holds is a power of two.

Ids equal those of the whole text: the pre-tokeniser always breaks before a single blank that stands
between two characters that are not white space, so text falls into blank-led units whose ids do not
depend on their neighbours. Units repeat, so the ids of the first
`KEPT_UNITS` are kept in each worker. Text with other
white space next to a blank is encoded whole.

Defined results: null or empty text has the end id alone; a repeated row is a document of its own;
an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import array
import base64
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Units whose ids a worker keeps.
KEPT_UNITS = 150_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Units are encoded from the vocabulary's ranks, which is what the library's own model does with
    each pre-token; a text that holds a special token's string goes to the library whole."""

    def __init__(self, path: str, ranks_path: str, kept: int = KEPT_UNITS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.encode = lambda text: bytes(core.encode_to_tiktoken_buffer(text, set()))
        for probe in ("It's  a\n\n test,\ttext: 12 naïve çedillas\u00a0x ", "ungüach zu\n eniegeß", ""):
            if self.encode(probe) != self.whole(probe):
                raise ValueError(f"{ranks_path} and {path} are not the same vocabulary")
        self.blank_led = np.zeros(max(ranks.values()) + 1, bool)
        self.blank_led[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.led: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """Ids of many units, encoded in one go: each begins with the only token that begins with a blank."""
        if not units:
            return {}
        ids = self.encode(" " + " ".join(units))
        at = (np.flatnonzero(self.blank_led[np.frombuffer(ids, np.uint32)]) * 4).tolist()
        return {u: ids[i:j] for u, i, j in zip(units, at, [*at[1:], len(ids)], strict=True)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        led, out, todo, missing = self.led, [b""] * len(texts), [], {}
        for k, text in enumerate(texts):
            if any(x in text for x in self.special):
                out[k] = self.whole(text)
                continue
            first, *rest = text.split(" ")
            ids = list(map(led.get, rest))
            new = {p: None for p, x in zip(rest, ids, strict=True) if x is None} if None in ids else {}
            if rest and (not first or first[-1].isspace()) or any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                out[k] = self.encode(text)
                continue
            missing.update(new)
            todo.append((k, first, rest, ids, bool(new)))
        more = self._units(list(missing))
        for k, first, rest, ids, some in todo:
            if some:
                ids = [more[p] if x is None else x for p, x in zip(rest, ids, strict=True)]
            out[k] = self.encode(first) + b"".join(ids)
        if len(led) < self.kept:
            led.update(more)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str) -> UnitEncoder:
    return UnitEncoder(path, ranks_path)


def cut_pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    return [(s, min(length, n - s)) for s in range(0, n, length)]


def _pieces(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(*paths), np.array([end_id], "<u4").tobytes()
    for batch, texts in text_batches(batches, "text"):
        rows: list[tuple] = []
        ids = encode([t.decode("utf-8", "replace") for t in texts])
        for doc, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
            x += end
            n = len(x) // 4
            rows += [(doc, s, k, zlib.crc32(x[4 * s : 4 * (s + k)]), n) for s, k in cut_pieces(n, length)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


class Tournament:
    """The largest free room under each node; finds the first bin with room."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        tree, k = self.tree, 1
        while k < self.size:
            k *= 2
            if tree[k] < need:
                k += 1
        return k - self.size

    def take(self, bin_: int, need: int) -> int:
        """Takes room; returns the offset at which it begins, counted from the room's end."""
        tree, k = self.tree, bin_ + self.size
        left = tree[k]
        tree[k] = left - need
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
        return left


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all at most `room`; bins are numbered in the order they open."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), room)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        bins[i] = b = tree.first_fit(need)
        offsets[i] = room - tree.take(b, need)
    return bins, offsets


def _pack(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start", "length", "ids_crc32", "doc_tokens"], ignore_index=True)
    bins, pdf["offset"] = first_fit_decreasing(pdf["length"].to_numpy(), length)
    pdf["sequence_id"] = (pdf.pop("group").to_numpy() << 32) + bins
    return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pieces(docs: DataFrame, paths: tuple[str, str], length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_pieces, paths=paths, length=length, end_id=end_id), PIECES)


def pack(docs: DataFrame, paths: tuple[str, str], length: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))
    cuts = pieces(docs, paths, length, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", F.lit(9)), F.lit(groups)))
    return cuts.groupBy("group").applyInPandas(functools.partial(_pack, length=length), f"{PIECES}, sequence_id long, offset long")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_paths())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_paths())
