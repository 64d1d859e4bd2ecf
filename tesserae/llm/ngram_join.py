"""Operator 1: n-gram Jaccard join by multiple-global-order filtering.

A document is the set of 64-bit fingerprints of its word n-grams. Two sets link when
100 * |a & b| >= `percent` * |a | b|. If they link, then under any total order of all n-grams they
share one of their first p = n - ceil(percent * n / 100) + 1 tokens. That holds for each of several
orders, so a candidate pair has to share a prefix token under all of them.

The orders put rare n-grams first, by their document frequency over the whole corpus, and differ in how
finely they tell frequencies apart and in how they break ties. The frequencies are counted for every
n-gram, by bucket: blocks of documents send each bucket their distinct tokens (four bytes each), a bucket
sends back one byte of rank for each. What is sent to one task is bounded by the number of buckets, which
grows with the input; nothing is broadcast. A token of one document only is no one's candidate, so a
document whose prefixes hold nothing else is done: that is the intersected filter at no cost of pairs.

Copies (equal sets) are one class. The other classes' prefix tokens under the first order meet by token,
and a token's holders give pairs: all of them while they are few; a token of many holders gives each
holder a pair with a pivot, and the rest of its pairs in later rounds, only between holders that are not
connected yet. Since components are what is asked, a pair inside a component needs no check, and a
family of thousands of near copies costs a few pairs for each. Rounds go on until no token has
holders in two components whose pair is unchecked, so no link between components is lost. In a pair the
smaller set holds the token early, within its first n - ceil(2 * percent * n / (100 + percent)) + 1: a
token that no set holds so early gives no pairs, nor do pairs whose places leave too few tokens to share.

Candidates are held against the prefixes under the other orders (the intersection of the filters), as
arrays of integers, and only what is left moves texts, which are verified on the whole sets.

Defined results: documents without words have the empty set and link with nothing; fewer words than n
give the whole sequence as the one n-gram; null text is empty; ties and repeated rows fall into one
class; rows without doc_id are documents like others, whose id is never a component's unless no other
has one (then null); an empty table gives no rows; other columns are left out."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, cut, give_back, mix64, shelve, sweep, table, text_batches

SIZE = 4
PERCENT = 85
#: Bytes of text in a block, and of tokens that a bucket of frequencies is told.
BLOCK = 2_000_000
BUCKET = 8_000_000
#: Bytes of short texts that are read together.
GROUP = 1 << 17
#: Bytes of unpacked text that are verified together.
VERIFIED = 1_000_000
#: A token with up to so many holders gives all pairs at once.
FEW = 6
#: Pivots a token of many holders has in each later round. Members of a family that link with few of
#: the others find one of them among ever more pivots; what is connected then needs no more pairs.
PIVOTS = (8, 24, 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    first = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([first, np.full(n - 1, b, np.uint64)])) for b in (_BASE, pow(int(_BASE), -1, 1 << 64)))


def _hashed(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the runs of n words."""
    count = len(words) - n + 1
    h = np.full(count, np.uint64(n))
    for i in range(n):
        h = h * _STEP + words[i : count + i]
    return mix64(h).view(np.int64)


def _group_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    raw = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    word = ~_SPACE[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    # a word's fingerprint: the sum of its bytes' codes times powers of their places
    n = len(raw)
    power, inverse = _powers(max(2 * GROUP, 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[raw] * power[:n], out=sums[1:])
    words = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    grams = _hashed(words, size) if len(words) >= size else None
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, begins).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        x = grams[lo : hi - size + 1] if hi - lo >= size else _hashed(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.int64)
        x = np.sort(x)
        yield x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of each text's n-grams of lower-cased words. Short texts are read
    in groups, as most of the time would go to calls otherwise."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    total = 0
    for t in texts:
        if group and total + len(t) > GROUP:
            out.extend(_group_sets(group, size))
            group, total = [], 0
        group.append(t)
        total += len(t) + 1
    if group:
        out.extend(_group_sets(group, size))
    return out


def shingles(text: bytes, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def frequency_ranks(counts: np.ndarray) -> np.ndarray:
    """0 for tokens of one document, then each count on its own up to 16, then eighths of powers of two."""
    return np.where(counts <= 16, counts - 1, np.minimum(255, 15 + 8 * np.log2(np.maximum(counts, 16) / 16))).astype(np.uint8)


#: The orders: how each sees a token's rank.
ORDERS = (lambda r: r, lambda r: np.frexp(r.astype(np.float64))[1].astype(np.uint8), lambda r: (r > 0).astype(np.uint8))


def _order(tokens: np.ndarray, ranks: np.ndarray, k: int, p: int) -> np.ndarray:
    """Places of the first p tokens under order k."""
    mixed = mix64(tokens.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
    place = ORDERS[k](ranks).astype(np.uint64) << np.uint64(56) | mixed >> np.uint64(8)
    return np.argsort(place, kind="stable")[:p]


def _fingerprint(tokens: np.ndarray) -> int:
    return int(mix64(mix64(tokens.view(np.uint64) * _STEP).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


_ROW = pa.struct([("doc_id", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_BLOCKS = "block long, rows array<struct<doc_id:long,set_id:long,n:long,packed:binary>>"


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, sets' fingerprints and sizes, compressed texts."""
    press = zstandard.ZstdCompressor(level=1)
    block = TaskContext.get().partitionId() << 32
    for batch, texts in text_batches(batches, "text", BLOCK):
        sets = shingle_sets(texts, size)
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array([_fingerprint(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())]
        rows = pa.StructArray.from_arrays(columns, fields=list(_ROW))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), rows)], names=["block", "rows"])
        block += 1


def _read_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, pa.StructArray, list[np.ndarray]]]:
    """Each block's row, its documents and their sets."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            rows = one.column(one.schema.get_field_index("rows")).flatten()
            texts = [unpack.decompress(z.as_py()) for z in rows.field("packed")]
            yield one, rows, shingle_sets(texts, size)
    give_back()


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct tokens in unsigned order, and how many of its documents hold each."""
    return np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.uint64), return_counts=True)


_TOKENS = "bucket int, block long, tokens binary, counts binary"


def _tokens(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """What each bucket (the first bits of a token) is told of a block: four more bytes of each token, and
    in how many documents it stands (at most 255: more is known to be frequent)."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    for one, _, sets in _read_blocks(batches, size):
        tokens, counts = _distinct(sets)
        at = np.r_[0, np.searchsorted(tokens, edges), len(tokens)].astype(np.int32)
        parts = [pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer((at * w).astype(np.int32)), pa.py_buffer(x)]) for w, x in ((4, tokens.astype(np.uint32)), (1, np.minimum(counts, 255).astype(np.uint8)))]
        some = pa.array(np.flatnonzero(np.diff(at)), pa.int32())
        block = pa.array(np.full(len(some), one.column("block")[0].as_py()), pa.int64())
        yield pa.RecordBatch.from_arrays([some, block, *[p.take(some) for p in parts]], names=["bucket", "block", "tokens", "counts"])


def _rank(t: pa.Table) -> pa.Table:
    """A bucket's answer to each block: the ranks of the tokens it told of, in their order."""
    press = zstandard.ZstdCompressor(level=1)
    told = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("tokens")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t.column("counts")])
    _, at = np.unique(np.concatenate(told), return_inverse=True)
    ranks = frequency_ranks(np.bincount(at, counts))[at]
    ends = np.cumsum([len(x) for x in told])
    give_back()
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "ranks": pa.array([press.compress(ranks[e - len(x) : e].tobytes()) for e, x in zip(ends, told, strict=True)], pa.binary())})


_HOLDERS = "set_id long, n long, tokens array<long>, places array<long>, second array<int>, third array<int>, packed binary"


def _holders(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The sets with a token of several documents among the first under every order: those tokens and
    places under the first order, the tokens (four bytes) under the others, the text."""
    unpack = zstandard.ZstdDecompressor()
    for one, rows, sets in _read_blocks(batches, size):
        answers = sorted(one.column(one.schema.get_field_index("answers"))[0].as_py() or [], key=lambda a: a["bucket"])
        ranks = np.frombuffer(b"".join(unpack.decompress(a["ranks"]) for a in answers), np.uint8)
        known, _ = _distinct(sets)
        out: dict[int, tuple] = {}
        for i, x in enumerate(sets):
            p = prefix_length(len(x), percent)
            mine = ranks[np.searchsorted(known, x.view(np.uint64))]
            if p == 0 or np.count_nonzero(mine == 0) >= p:
                continue
            key = rows.field("set_id")[i].as_py()
            if key in out:
                continue
            firsts = [_order(x, mine, k, p) for k in range(len(ORDERS))]
            shared = [f[mine[f] > 0] for f in firsts]
            others = [np.sort(x[f].view(np.uint64).astype(np.uint32)).view(np.int32) for f in shared[1:]]
            out[key] = (key, len(x), x[shared[0]], np.flatnonzero(mine[firsts[0]] > 0), *others, rows.field("packed")[i])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        names = ["set_id", "n", "tokens", "places", "second", "third", "packed"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out.values()], kind) for k, kind in enumerate(kinds)], names=names)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.sort(np.concatenate([a, b]), kind="stable")  # merges two runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that link. Pairs are taken together up to a bound of their unpacked bytes; a text that
    stands in several of them is unpacked once."""
    unpack = zstandard.ZstdDecompressor()

    def checked(rows: list[tuple[int, int]], texts: dict[int, bytes]) -> list[tuple[int, int]]:
        sets = dict(zip(texts, shingle_sets([unpack.decompress(z) for z in texts.values()], size), strict=True))
        return [(a, b) for a, b in rows if linked(sets[a], sets[b], percent)]

    for batch in batches:
        out: list[tuple[int, int]] = []
        rows: list[tuple[int, int]] = []
        texts: dict[int, bytes] = {}
        total = 0
        for i in range(batch.num_rows):
            a, b, za, zb = (batch.column(c)[i].as_py() for c in ("a", "b", "packed_a", "packed_b"))
            more = sum(zstandard.frame_content_size(z) for k, z in ((a, za), (b, zb)) if k not in texts)
            if rows and total + more > VERIFIED:
                out += checked(rows, texts)
                rows, texts, total = [], {}, 0
                more = sum(map(zstandard.frame_content_size, (za, zb)))
            rows.append((a, b))
            texts |= {a: za, b: zb}
            total += more
        if rows:
            out += checked(rows, texts)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def bucket_bits(tokens: int) -> int:
    """Bits that name a bucket: a bucket is told some `BUCKET` bytes, up to 131,072 buckets."""
    return min(17, max(4, (4 * tokens // BUCKET).bit_length()))


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        blocks, drop = shelve(texts.mapInArrow(functools.partial(_blocks, size=size), _BLOCKS))
        bits = bucket_bits(blocks.agg(F.expr("sum(aggregate(rows.n, 0L, (s, n) -> s + n))")).first()[0] or 0)
        told = blocks.select("block", "rows").mapInArrow(functools.partial(_tokens, size=size, bits=bits), _TOKENS)
        answers, forget = shelve(told.groupBy("bucket").applyInArrow(_rank, "block long, bucket int, ranks binary"))
        sweep(docs.sparkSession)  # what the buckets were told goes before the blocks move
        answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "ranks")).alias("answers"))  # one for each bucket
        held = blocks.join(answers, "block", "left").mapInArrow(functools.partial(_holders, size=size, percent=percent), _HOLDERS)
        self.holders, self.drop = shelve(held.dropDuplicates(["set_id"]))
        self.sets = cut(blocks.select(F.explode("rows").alias("r")).select("r.doc_id", "r.n", "r.set_id"))
        forget()
        drop()
        self.classes = self.sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("class_id"))

    @functools.cached_property
    def repeats(self) -> bool:
        """Whether ids do not tell the rows apart."""
        return not self.sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty()

    def _fits(self):
        """Sizes and places leave enough tokens to share."""
        need = F.ceil(F.lit(self.percent) * (F.col("na") + F.col("nb")) / F.lit(100 + self.percent))
        return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need

    def _pairs(self, a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        """Pairs that meet and whose sizes and places leave enough tokens to share."""
        known = [[F.col("component").alias(f"c{x}")] if "component" in a.columns else [] for x in "ab"]
        left = a.select(*on, F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), *known[0])
        right = b.select(*on, F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), *known[1])
        apart = F.col("ca") != F.col("cb") if known[0] else F.col("a") != F.col("b")
        return left.join(right, on).where(apart & self._fits()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The candidate pairs that share a token under every further order too, and link."""
        side = lambda x, *cs: self.holders.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cs])
        kept = pairs.distinct()
        for x in "ab":
            kept = kept.join(side(x, "second", "third"), x)
        kept = kept.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b")
        for x in "ab":
            kept = kept.join(side(x, "packed"), x)
        return cut(kept.mapInArrow(functools.partial(_verify, size=self.size, percent=self.percent), "a long, b long"))

    def _pivots(self, many: DataFrame, by, among: DataFrame | None = None, number: int = 1) -> DataFrame:
        """The holders of tokens, or those `among` them, each with the pivots of its own size and of the
        next smaller one; where components are known, only those of another component. A token has a
        `number` of pivots: the least early holder of each of so many buckets."""
        bucket = F.pmod(F.xxhash64("set_id", F.lit(number)), F.lit(number)).alias("bucket")
        pivot = many.where("early").groupBy("token", "level", bucket).agg(F.min(F.struct(by.alias("h"), *[c for c in many.columns if c not in ("token", "level")])).alias("p"))
        pivot = pivot.select("token", "level", "p.*").drop("h")
        return self._pairs(among or many, pivot.unionByName(pivot.withColumn("level", F.col("level") + 1)), ["token", "level"])

    def _split(self, many: DataFrame, part: DataFrame) -> DataFrame:
        """The holders of tokens that are held in two components or more, with their component; `main` is
        the token's largest one."""
        named = many.join(part.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        sizes = named.groupBy("token", "component").agg(F.count("*").alias("k"), F.max("early").alias("early"))
        split = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max("early").alias("_e"), F.max_by("component", F.struct("k", "component")).alias("main")).where("parts > 1 AND _e")
        return cut(named.join(split.select("token", "main"), "token"))

    def _apart(self, left: DataFrame) -> DataFrame:
        """Every pair of holders in two components that share a token. One of two is not of the token's
        largest component, so what a family has joined does not meet itself."""
        aside = left.where("component <> main")
        early = self._pairs(aside, left.where("early"), ["token"])
        return early.unionByName(self._pairs(aside.where("early"), left.where("component = main AND NOT early"), ["token"]))

    def _joined(self, part: DataFrame, links: DataFrame) -> DataFrame:
        """The components of `part` after more links; what is joined already is not worked out again."""
        if links.isEmpty():
            return part
        return connected_components(part.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))

    def components(self) -> DataFrame:
        """(doc_id, n, component_id, set_id, component) of every row. Where ids repeat, two components can have
        the same component_id; component, a set's, is one's own. Without words set_id and component are null."""
        postings = self.holders.select("set_id", "n", F.explode(F.arrays_zip("tokens", "places")).alias("p")).select("set_id", "n", F.col("p.tokens").alias("token"), F.col("p.places").alias("place"))
        step = 100.0 / self.percent
        postings = postings.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step))))
        early = F.col("place") <= F.col("n") - F.ceil(F.lit(2 * self.percent) * F.col("n") / F.lit(100 + self.percent))
        postings = postings.withColumn("early", early)
        held = postings.groupBy("token").agg(F.count("*").alias("k"), F.max("early").alias("_e")).where("k > 1 AND _e").drop("_e")  # copies are one holder now
        shared = cut(postings.join(held, "token"))
        few, many = shared.where(F.col("k") <= FEW), shared.where(F.col("k") > FEW)
        first = self._pairs(few, few.where("early"), ["token"])
        # at first only by its commonest token, so that a member of a family meets one or two pivots
        best = many.groupBy("set_id").agg(F.max_by(F.struct("token", "level", "n", "place"), F.struct("early", "k", "token")).alias("t")).select("set_id", "t.*")
        many = many.drop("k")
        part = connected_components(self.links(first.union(self._pivots(many, F.col("set_id"), best))))
        left = self._split(many, part)
        for number in PIVOTS:
            if left.isEmpty():
                break
            more = self.links(self._pivots(left, F.xxhash64("set_id", F.lit(number)), number=number))
            if not more.isEmpty():
                part = self._joined(part, more)
                left = self._split(left.drop("component", "main"), part)
        if not left.isEmpty():
            part = self._joined(part, self.links(self._apart(left)))
        named = self.classes.join(part.select(F.col("id").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
        named = named.join(least, "component").select("set_id", "component_id", "component")
        full = self.sets.where("n > 0").join(named, "set_id").select("doc_id", "n", "component_id", "set_id", "component")
        none = F.lit(None).cast("long")
        out = cut(full.union(self.sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), none, none)))
        self.drop()
        sweep(out.sparkSession)
        return out


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _Join(docs, size, percent).components().select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def _with_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows with their set's fingerprint, null without words."""
    for batch, texts in text_batches(batches, "text"):
        sets = pa.array([_fingerprint(x) if len(x) else None for x in shingle_sets(texts, size)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, sets], names=[*batch.schema.names, "_set"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id.
    Documents without words stay, as do rows without id. Where rows share an id, each group keeps one of
    its own: a row with the smallest id, of several sets the one with the smallest fingerprint."""
    found = _Join(docs, 5, 80)
    parts = found.components()
    if not found.repeats:
        return docs.join(parts.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    kept = parts.where("doc_id = component_id AND component IS NOT NULL").groupBy("doc_id", "component").agg(F.min("set_id").alias("_set")).select(F.col("doc_id").alias("kept_id"), F.col("_set").alias("kept_set"))
    schema = StructType([*docs.schema.fields, StructField("_set", LongType())])
    rows = docs.where("doc_id IS NOT NULL").mapInArrow(functools.partial(_with_sets, size=5), schema)
    out = rows.join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("_set") == F.col("kept_set"))).dropDuplicates(["doc_id", "_set"])
    out = out.select(*docs.columns).unionByName(rows.where("_set IS NULL").select(*docs.columns))
    return out.unionByName(docs.where("doc_id IS NULL"))
