"""Operator 5: token counts of whole texts, huge ones by overlap resynchronisation.

Texts up to `chunk` characters go to the library as they are. A longer one is encoded in chunks that
overlap; offsets place each token in the text, and two neighbours are spliced at a character where
both begin a token and which is proven stable. If an overlap has no such place, or its two chunks do not
agree on one, it is doubled until they do or it reaches the text's end.

Proof of stability: the blank becomes the mark U+2581, merges only ever build pieces of the
vocabulary, and when no piece has the mark after another character, no merge crosses from a
character into a following blank. A text cut there falls into two whose ids are those of the whole;
the blank itself is dropped from the second, as the encoder puts the mark in front of each text.
Both facts are checked against the loaded model; a model without them has its texts encoded whole.

Defined results: null and empty text have 0 tokens; each row is counted on its own; an empty table
gives no rows; other columns are left out."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_batches

LIMIT = 4096
CHUNK = 1 << 16
OVERLAP = 1 << 9
MARK = "▁"
_STABLE = re.compile(r"(?<=[^ ▁])(?= )")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.sp, self.chunk, self.overlap = sentencepiece.SentencePieceProcessor(model_file=path), chunk, overlap
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        probe = "éé ﬁ  a\tb\n  c "
        self.stable = not crossing and self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _spans(self, text: str, at: int) -> list[int]:
        """Where in the document, in characters, each token of a chunk begins that is taken from `at`."""
        begins = [p.begin for p in self.sp.encode(text, return_type="proto").pieces]  # in bytes
        heads = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return (np.searchsorted(heads, begins) + at).tolist()

    def _begin(self, text: str, at: int) -> int:
        """Encoding from `at` drops the blank there."""
        return at + (at > 0)

    def huge(self, text: str) -> int:
        """Tokens of a long text, spliced."""
        total, at, n = 0, 0, len(text)
        # tokens of text[at:] are still to count; `at` is 0 or a stable place
        while True:
            end, overlap = at + self.chunk, self.overlap
            left_at, common = self._begin(text, at), None
            while common is None:
                stop = end + overlap
                if stop >= n:
                    return total + len(self.sp.encode(text[left_at:]))
                places = [m.start() for m in _STABLE.finditer(text, end, stop)]
                if len(places) > 1:
                    left = self._spans(text[left_at:stop], left_at)
                    right_at = self._begin(text, places[0])
                    agreed = set(left) & set(self._spans(text[right_at:stop], right_at))
                    common = next((p for p in places[1:] if p in agreed), None)
                overlap *= 2
            total += sum(b < common for b in left)
            at = common

    def __call__(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk or not self.stable else "" for t in texts]
        out = [len(x) for x in self.sp.encode(short, num_threads=1)]
        return [self.huge(t) if len(t) > self.chunk and self.stable else k for t, k in zip(texts, out, strict=True)]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _counts(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch, texts in text_batches(batches, "text", 1_000_000):
        tokens = count([t.decode("utf-8", "replace") for t in texts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([k > limit for k in tokens])],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; one pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_counts, path=path, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path())
