"""Every operator as a query over the driver's tables, and the same in DuckDB's SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..operators import evidence, export, lineage, mining, resolve, spatial
from ..operators import timeseries as ts

SPIKE, STABLE, HALF = 150.0, 35.0, 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- time series over events, per user


def _motion(spark: SparkSession, d: str) -> DataFrame:
    e = ts.positions(_t(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id")
    return ts.rolling_median(ts.consecutive_mad(e, "user_id", "value"), "user_id", HALF)


_MOTION = f"""
WITH e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
m AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY pos)), 0) AS mad, max(pos) OVER (PARTITION BY user_id) AS last FROM e),
w AS (SELECT m.*, g.spot FROM m, LATERAL (SELECT unnest(CASE WHEN pos = 0 AND last = 0 THEN range(-{HALF}, {HALF + 1}) WHEN pos = 0 THEN range(-{HALF}, 1) WHEN pos = last THEN range(last, last + {HALF + 1}) ELSE [pos] END) AS spot) g),
s AS (SELECT * FROM (SELECT *, median(mad) OVER (PARTITION BY user_id ORDER BY spot ROWS BETWEEN {HALF} PRECEDING AND {HALF} FOLLOWING) AS win FROM w) WHERE spot = pos)
"""
_CUTS = f"""{_MOTION}, f AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS step FROM s WHERE mad > {SPIKE} AND win < {STABLE}),
cut AS (SELECT * FROM f WHERE step IS NULL OR step > 2)"""


@query(f"{_CUTS} SELECT user_id, event_id, pos::INTEGER AS pos, round(mad, 4) AS mad, round(win, 4) AS win FROM cut")
def seg_cuts(spark, d):
    c = ts.cuts(_motion(spark, d), "user_id", SPIKE, STABLE)
    return c.select("user_id", "event_id", "pos", F.round("mad", 4).alias("mad"), F.round("win", 4).alias("win"))


@query(f"{_MOTION} SELECT user_id, event_id, pos::INTEGER AS pos, round(mad, 4) AS mad, round(win, 4) AS win FROM s")
def seg_motion(spark, d):
    return _motion(spark, d).select("user_id", "event_id", "pos", F.round("mad", 4).alias("mad"), F.round("win", 4).alias("win"))


@query(f"""{_MOTION}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM s WHERE win >= {STABLE})
SELECT user_id, round(min(pos) / 10.0, 2) AS start_s, round(max(pos) / 10.0, 2) AS end_s, count(*) AS n FROM r GROUP BY user_id, run HAVING count(*) / 10.0 BETWEEN 0.3 AND 18.0""")
def moving_runs(spark, d):
    r = ts.moving_runs(_motion(spark, d), "user_id", 10.0, STABLE, 0.3, 18.0)
    return r.select("user_id", F.round("start_s", 2).alias("start_s"), F.round("end_s", 2).alias("end_s"), "n")


@query(f"""{_CUTS}, i AS (SELECT s.user_id, s.pos, s.win, sum(CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s.user_id ORDER BY s.pos) AS k FROM s LEFT JOIN cut c ON c.user_id = s.user_id AND c.pos = s.pos)
SELECT DISTINCT user_id, round(arg_min(pos, struct_pack(w := win, p := pos)) / 10.0, 2) AS t FROM i WHERE k >= 1 GROUP BY user_id, k HAVING count(*) >= 2""")
def interval_argmin(spark, d):
    m = _motion(spark, d)
    return ts.representatives(m, ts.cuts(m, "user_id", SPIKE, STABLE), "user_id", 10.0)


_ROBUST = """
WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events),
m AS (SELECT *, coalesce(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY pos)), 0) AS mad FROM e),
c AS (SELECT event_type, median(mad) AS med FROM m WHERE pos > 0 GROUP BY 1), v AS (SELECT event_type, median(abs(mad - med)) + 1e-9 AS dev FROM m JOIN c USING (event_type) WHERE pos > 0 GROUP BY 1),
a AS (SELECT m.* FROM m JOIN c USING (event_type) JOIN v USING (event_type) WHERE mad > med + 3 * 1.4826 * dev),
g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY pos) AS island FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY event_type ORDER BY pos) AS step FROM a)),
spike AS (SELECT event_type, arg_max(pos, struct_pack(m := mad, p := -pos)) AS pos, max(mad) AS mad FROM g GROUP BY event_type, island)
"""


def _by_type(spark, d):
    e = ts.positions(_t(spark, d, "events").select("event_type", "event_id", "ts", "value"), "event_type", "ts", "event_id")
    return ts.consecutive_mad(e, "event_type", "value")


@query(f"{_ROBUST} SELECT event_type, pos::INTEGER AS pos, round(mad, 4) AS mad FROM spike")
def robust_spikes(spark, d):
    return ts.robust_spikes(_by_type(spark, d), "event_type", z=3.0).select("event_type", "pos", F.round("mad", 4).alias("mad"))


@query(f"""{_ROBUST}, f AS (SELECT DISTINCT event_type, pos FROM m WHERE mad > 200)
SELECT event_type, n::BIGINT AS n, round(tp / n, 6) AS precision, round(tt / nt, 6) AS recall, round(CASE WHEN tp / n + tt / nt > 0 THEN 2 * (tp / n) * (tt / nt) / (tp / n + tt / nt) ELSE 0 END, 6) AS f1 FROM (
SELECT event_type, count(*) AS n, sum(CASE WHEN EXISTS (SELECT 1 FROM spike s WHERE s.event_type = f.event_type AND abs(s.pos - f.pos) <= 2) THEN 1 ELSE 0 END) AS tp FROM f GROUP BY 1)
JOIN (SELECT event_type, count(*) AS nt, sum(CASE WHEN EXISTS (SELECT 1 FROM f WHERE s.event_type = f.event_type AND abs(s.pos - f.pos) <= 2) THEN 1 ELSE 0 END) AS tt FROM spike s GROUP BY 1) USING (event_type)""")
def tolerance_scores(spark, d):
    m = _by_type(spark, d)
    s = ts.tolerance_scores(m.where("mad > 200"), ts.robust_spikes(m, "event_type", z=3.0), "event_type", 2)
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""{_MOTION}, f AS (SELECT user_id, pos, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS step FROM s WHERE mad > {SPIKE}),
g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f)
SELECT user_id, island::BIGINT AS island, min(pos)::INTEGER AS lo, max(pos)::INTEGER AS hi, count(*) AS n FROM g GROUP BY 1, 2""")
def spike_islands(spark, d):
    i = ts.islands(_motion(spark, d).where(F.col("mad") > SPIKE), "user_id")
    return i.groupBy("user_id", "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))


_LAGGED = "WITH v AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


def _lagged(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    return v.withColumn("b", F.lag("e").over(Window.partitionBy("label").orderBy("vec_id")))


@query(f"{_LAGGED} SELECT vec_id, CASE WHEN b IS NULL THEN 0 ELSE round(list_sum(list_transform(range(1, 65), lambda i: abs(e[i]::DOUBLE - b[i]::DOUBLE))) / 64, 6) END AS mad FROM v")
def embedding_mad(spark, d):
    v = ts.positions(_t(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id")
    return ts.consecutive_mad(v, "label", "embedding", True).select("vec_id", F.round("mad", 6).alias("mad"))


@query(f"""{_LAGGED}, h AS (SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS x,
 list_sum(list_transform(range(0, 32), lambda i: CASE WHEN b[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT AS y FROM v WHERE b IS NOT NULL) SELECT vec_id, bit_count(xor(x, y))::INTEGER AS distance FROM h""")
def phash_hamming(spark, d):
    bits = lambda c: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.get(c, i) > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2), i).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return _lagged(spark, d).where("b IS NOT NULL").select("vec_id", ts.hamming(bits(F.col("e")), bits(F.col("b"))).cast("int").alias("distance"))


@query(f"""{_LAGGED} SELECT vec_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: least(abs(e[i])::DOUBLE, abs(b[i])::DOUBLE))), 6) AS hist,
 round(100.0 * len(list_filter(range(1, 65), lambda i: abs(e[i]::DOUBLE * 200 - b[i]::DOUBLE * 200) > 25)) / 64, 6) AS pixels FROM v WHERE b IS NOT NULL""")
def frame_distances(spark, d):
    mag = lambda c: F.transform(c, F.abs)
    far = lambda c: F.transform(c, lambda x: x.cast("double") * 200)
    v = _lagged(spark, d).where("b IS NOT NULL")
    return v.select("vec_id", F.round(ts.histogram_distance(mag(F.col("e")), mag(F.col("b"))), 6).alias("hist"), F.round(ts.pixel_share(far(F.col("e")), far(F.col("b"))), 6).alias("pixels"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
f(user_id, pos, thr, hold, run, kept, cut) AS (
 SELECT user_id, pos, thr, hold, 0, value, true FROM e, (VALUES (100.0::DOUBLE, 3), (200.0::DOUBLE, 1)) s(thr, hold) WHERE pos = 0
 UNION ALL SELECT user_id, pos, thr, hold, CASE WHEN run >= hold THEN 0 ELSE run END, CASE WHEN run >= hold THEN value ELSE kept END, run >= hold FROM (
  SELECT e.user_id, e.pos, f.thr, f.hold, e.value, f.kept, CASE WHEN abs(e.value - f.kept) > f.thr THEN f.run + 1 ELSE 0 END AS run FROM f JOIN e ON e.user_id = f.user_id AND e.pos = f.pos + 1))
SELECT user_id, thr, hold::INTEGER AS hold, pos::INTEGER AS pos FROM f WHERE cut""")
def hold_detector(spark, d):
    e = ts.positions(_t(spark, d, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id")
    return ts.hold_detector(e, "user_id", lambda a, b: F.abs(a - b), "value", [(100.0, 3), (200.0, 1)])


@query()
def detector_bench(spark, d):
    """The detector grid over short synthetic frames made from embeddings, label by label."""
    v = ts.positions(_t(spark, d, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id")
    g = F.transform("embedding", lambda x: x.cast("double") * 300)
    pos = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    hist = F.transform(pos, lambda x: x / F.aggregate(pos, F.lit(1e-9), lambda s, y: s + y))
    frames = v.select("label", "pos", g.alias("gray"), g.alias("blocks"), F.xxhash64("vec_id").alias("phash"), hist.alias("hist"))
    return ts.run_bench(frames, "label", 10.0, 12.0, 40.0)


# ---------------------------------------------------------------- text


@query("""WITH k AS (SELECT doc_id, source, n_chars, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS n FROM k) SELECT doc_id, source, n_chars, md5(key) AS key FROM r WHERE n = 1 AND length(key) >= 3""")
def norm_dedupe(spark, d):
    """Best row of each normalised text."""
    k = _t(spark, d, "documents").withColumn("key", X.norm(F.col("text"))).where(F.length("key") >= 3)
    best = k.groupBy(F.md5(F.col("key").cast("binary")).alias("key")).agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("o"), "source")).alias("m"))
    return best.select((-F.col("m.o")).alias("doc_id"), "m.source", "m.n_chars", "key")


def _lines(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return docs.where(F.trim("text") != "")


_MARK = r"[\"“”]|journal|proceedings|proc\.|nature|science|psychology|behaviour|behavior|entropy|genetics|ssrn|vol\.|no\."


@query(f"""WITH l AS (SELECT doc_id, seq, trim(text, ' ') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents)),
k AS (SELECT * FROM l WHERE text <> '' AND lower(text) <> 'bibliography'),
e AS (SELECT *, sum(CASE WHEN first OR regexp_matches(text, '^[A-Z][a-zA-Z''’-]+,') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS entry FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS first FROM k)),
j AS (SELECT doc_id, entry, string_agg(text, ' ' ORDER BY seq) AS text FROM e GROUP BY 1, 2)
SELECT doc_id, entry::BIGINT AS entry, md5(text) AS text, CASE WHEN regexp_matches(text, '{_MARK}', 'i') THEN 'article' ELSE 'book' END AS kind,
 nullif(regexp_extract(text, '(1[6-9]\\d{{2}}|20\\d{{2}})', 1), '')::INTEGER AS year FROM j""")
def bibliography_entries(spark, d):
    return mining.bibliography(_lines(spark, d)).withColumn("text", F.md5(F.col("text").cast("binary")))


def _segments(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lit(0).alias("seq"), F.lit(0.0).alias("start"), "text", "lang")


@query()
def title_ngrams(spark, d):
    """Of all documents, in every language."""
    return mining.title_candidates(_segments(spark, d))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^ -~]', 'x', 'g'), '\\b([A-Z][a-z]{2,})\\b', 1)) AS word FROM documents WHERE lang = 'en') SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""")
def proper_nouns(spark, d):
    """Of the English documents, which its SQL has; proper_nouns_all has all."""
    return _proper_nouns(_segments(spark, d).where("lang = 'en'"))


def _proper_nouns(docs):
    plain = F.regexp_replace("text", "[^ -~]", "x")  # word boundaries differ between engines elsewhere
    w = docs.select("doc_id", F.explode(X.proper_nouns(plain)).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^ -~]', 'x', 'g'), '\\b([A-Z][a-z]{2,})\\b', 1)) AS word FROM documents) SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""")
def proper_nouns_all(spark, d):
    return _proper_nouns(_segments(spark, d))


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')), lambda x: length(x) > 3 AND NOT list_contains(['the','and','for','with','from','who','how','why','what','when','their','its','our','are','was','were','been','being','have','has','had','other','else','into','about','than','then','them'], x))"


@query(f"""WITH a AS (SELECT doc_id, unnest(t) AS tok, len(t) AS n FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE lang = 'en' AND n_chars < 800)),
b AS (SELECT item_id, unnest(t) AS tok, len(t) AS n FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark)),
s AS (SELECT doc_id, item_id, count(*) / least(a.n, b.n) AS score FROM a JOIN b USING (tok) GROUP BY doc_id, item_id, a.n, b.n),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s)
SELECT d.doc_id, coalesce(score >= 0.45, false) AS cited, round_even(coalesce(score, 0), 2) AS match_score, md5(CASE WHEN score >= 0.45 THEN b.text END) AS match
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND r = 1 LEFT JOIN benchmark b USING (item_id) WHERE lang = 'en' AND n_chars < 800""")
def overlap_join(spark, d):
    """Of the short English documents, which its SQL has; overlap_join_all has all."""
    return _cited(spark, d, _t(spark, d, "documents").where("lang = 'en' AND n_chars < 800"))


def _cited(spark, d, docs):
    c = evidence.cite(docs.select(F.col("doc_id").alias("id"), "text"), _t(spark, d, "benchmark").select(F.col("item_id").alias("entry"), "text"))
    return c.select(F.col("id").alias("doc_id"), "cited", "match_score", F.md5(F.col("match").cast("binary")).alias("match"))


@query(f"""WITH a AS (SELECT doc_id, unnest(t) AS tok, len(t) AS n FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)),
b AS (SELECT item_id, unnest(t) AS tok, len(t) AS n FROM (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark)),
s AS (SELECT doc_id, item_id, count(*) / least(a.n, b.n) AS score FROM a JOIN b USING (tok) GROUP BY doc_id, item_id, a.n, b.n),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS r FROM s)
SELECT d.doc_id, coalesce(score >= 0.45, false) AS cited, round_even(coalesce(score, 0), 2) AS match_score, md5(CASE WHEN score >= 0.45 THEN b.text END) AS match
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND r = 1 LEFT JOIN benchmark b USING (item_id)""")
def overlap_join_all(spark, d):
    return _cited(spark, d, _t(spark, d, "documents"))


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations), s AS (SELECT * FROM t WHERE text <> ''),
p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s), n AS (SELECT conv_id, turn, trim(CASE WHEN b IS NOT NULL AND starts_with(text, b) THEN substr(text, length(b) + 1) ELSE text END) AS text FROM p)
SELECT conv_id, turn, md5(text) AS text FROM n WHERE text <> ''""")
def caption_diff(spark, d):
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", " "), r"\s+", " "))
    cues = _t(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("seq"), text.alias("text"))
    return mining.new_words(cues, "conv_id").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text"))


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, text FROM conversations WHERE text <> ''), p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s),
n AS (SELECT conv_id, turn, trim(CASE WHEN b IS NOT NULL AND starts_with(text, b) THEN substr(text, length(b) + 1) ELSE text END, ' ') AS text FROM p),
r AS (SELECT conv_id, text, turn * 2.0::DOUBLE AS a, turn * 2.0::DOUBLE + 2 AS z, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM n WHERE text <> ''),
f(conv_id, k, seg, a, z, text) AS (SELECT conv_id, k, 0, a, z, text FROM r WHERE k = 1
 UNION ALL SELECT r.conv_id, r.k, f.seg + o.o::INTEGER, CASE WHEN o.o THEN r.a ELSE f.a END, r.z, CASE WHEN o.o THEN r.text ELSE trim(f.text || ' ' || r.text, ' ') END
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1, LATERAL (SELECT len(regexp_split_to_array(f.text, '\\s+')) >= 10 OR f.z - f.a > 6.0 AS o) o)
SELECT conv_id, seg::INTEGER AS seq, arg_max(a, k) AS "start", arg_max(z, k) AS "end", arg_max(text, k) AS text FROM f GROUP BY conv_id, seg""")
def caption_segments(spark, d):
    t = F.col("turn").cast("double")
    cues = _t(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), (t * 2).alias("start"), (t * 2 + 2).alias("end"), "text")
    return mining.segments_of(mining.new_words(cues, "conv_id"), "conv_id")


_VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.500 align:start\nhello <c>the the</c> world\n\n00:00:02.500 --> 00:01:04.000\nhello the world again\n"


@query("""SELECT * FROM (VALUES (0, 1.0::DOUBLE, 2.5::DOUBLE, 'hello the world'), (1, 2.5::DOUBLE, 64.0::DOUBLE, 'hello the world again')) AS t(seq, "start", "end", text)""")
def vtt_cues(spark, d):
    return mining.caption_cues(spark.createDataFrame([("a", _VTT)], "path string, value string")).select("seq", "start", "end", "text")


@query("""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS seq, turn * 61.25::DOUBLE AS "start", turn * 61.25::DOUBLE + 2.5 AS "end", role || ' number ' || turn AS text FROM conversations""")
def vtt_of_talks(spark, d):
    """The cues of caption files that are made of every conversation's turns, tags and odd blanks included."""
    c = _t(spark, d, "conversations").withColumn("a", F.col("turn") * 61250).withColumn("z", F.col("a") + 2500)
    part = lambda ms, unit, n: F.lpad((F.floor(ms / unit) % n).cast("string"), 2, "0")
    stamp = lambda ms: F.concat(part(ms, 3_600_000, 100), F.lit(":"), part(ms, 60_000, 60), F.lit(":"), part(ms, 1000, 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    cue = F.concat(stamp(F.col("a")), F.lit(" --> "), stamp(F.col("z")), F.lit(" align:start\n<c>"), "role", F.lit("</c>\nnumber  "), "turn", F.lit("\n\n"))
    files = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("cues"))
    files = files.select("conv_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda x: x["cue"]), "")).alias("value"))
    return mining.caption_cues(files, "conv_id")


@query("""SELECT page_id, title, length(title)::INTEGER AS n, title LIKE '%|%' AS piped, lower(regexp_extract(title, '^([\\p{L}\\p{N}]+)', 1)) AS head FROM (SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)""")
def page_titles(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return p.withColumn("n", F.length("title")).withColumn("piped", F.contains("title", F.lit("|"))).withColumn("head", F.lower(F.regexp_extract("title", r"^([\p{L}\p{N}]+)", 1)))


_PHRASES = ["New York", "West Africa", "African Americans", "Cambridge University", "University of Austin", "Charles T. Murray", "CHARLES T. MURRAY", "Losing Ground", "and the", "Facing Reality", "Daniel Dennett"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {r})" for p, r in zip(_PHRASES, ["true", "true", "true", "true", "true", "true", "false", "false", "true", "false", "false"], strict=True)) + ") AS t(phrase, rejected)")
def phrase_guards(spark, d):
    p = spark.createDataFrame([(p,) for p in _PHRASES], "phrase string")
    return p.withColumn("rejected", X.rejected_phrase(F.col("phrase")))


_PAIRS = list(zip(["C", "G", "B", "A", "Y", "U", "I", "U", "O", "D", "F", "M", "S"], ["G", "B", "R", "R", "I", "V", "L", "L", "Q", "O", "E", "N", "Z"], strict=True))
_DEGARBLE = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))


@query(f"""WITH w AS (SELECT DISTINCT p_name AS phrase FROM part), g(pair, a, b) AS (VALUES {_DEGARBLE}),
c AS (SELECT phrase, pair, i, substr(phrase, i, 1) AS ch, a, b FROM w, g, LATERAL (SELECT unnest(range(1, length(phrase) + 1)) AS i)),
v AS (SELECT phrase, pair, i, CASE WHEN upper(ch) = a THEN CASE WHEN ch = upper(ch) THEN b ELSE lower(b) END WHEN upper(ch) = b THEN CASE WHEN ch = upper(ch) THEN a ELSE lower(a) END END AS dst FROM c WHERE regexp_matches(ch, '[A-Za-z]')),
o AS (SELECT phrase, substr(phrase, 1, i - 1) || dst || substr(phrase, i + 1) AS variant, row_number() OVER (PARTITION BY phrase ORDER BY pair, i) AS r FROM v WHERE dst IS NOT NULL),
f AS (SELECT phrase, variant, min(r) AS r FROM o GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY r) AS k FROM f) SELECT phrase, variant, k::INTEGER AS k FROM n WHERE k <= 12""")
def degarble(spark, d):
    p = _t(spark, d, "part").select(F.col("p_name").alias("phrase")).distinct()
    return p.select("phrase", F.posexplode(X.glyph_variants(F.col("phrase"), 12)).alias("k", "variant")).withColumn("k", F.col("k") + 1)


# ---------------------------------------------------------------- kernels


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), q AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM n) SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM q WHERE b IS NOT NULL""")
def jaro_winkler(spark, d):
    n = _t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = n.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b IS NOT NULL")  # distinct names are few
    return pairs.withColumn("score", F.round(K.jaro_winkler_udf("a", "b"), 6))


@query()
def string_kernels(spark, d):
    n = _t(spark, d, "part").select(F.col("p_name").alias("a")).distinct()
    pairs = n.withColumn("b", F.lead("a").over(Window.orderBy("a"))).where("b IS NOT NULL")
    return pairs.select("a", "b", K.metaphone_udf("a").alias("metaphone"), K.phonetic_udf("a").alias("phonetic"), K.ratio_udf("a", "b").alias("ratio"), K.token_set_ratio_udf("a", "b").alias("token_set"), K.fuzzy_score_udf("a", "b").alias("fuzzy"))


@query()
def fused_words(spark, d):
    w = _t(spark, d, "part").select(F.upper(F.regexp_replace("p_name", " ", "")).alias("token"), "p_name").distinct()
    words = [r[0] for r in w.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct().collect()]
    return w.select("token", K.split_fused_udf(words)("token").alias("parts"))


# ---------------------------------------------------------------- catalogue


def _catalogue(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("The "), "p_name").alias("title"), F.array(F.concat(F.lit("Author "), "p_brand")).alias("authors"), (F.lit(1900) + F.col("p_size")).alias("year"), (F.col("p_size") % 7 + 1).alias("editions"))
    return resolve.catalogue_rows(p)


def _phrases(spark, d):
    n = _t(spark, d, "part").select("p_name").distinct()
    return n.select(F.col("p_name").alias("phrase")).union(n.select(F.substring("p_name", 1, 8)).distinct())


_CATALOGUE = """WITH c AS (SELECT p_partkey AS seq, 'The ' || p_name AS title, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', '', 'g') AS norm_key FROM part),
n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT DISTINCT phrase, regexp_replace(lower(phrase), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM (SELECT p_name AS phrase FROM n UNION SELECT substr(p_name, 1, 8) FROM n)),
x AS (SELECT phrase, title, seq, 'exact' AS how FROM p JOIN c ON key = norm_key),
y AS (SELECT phrase, title, seq, 'prefix' AS how FROM p JOIN c ON starts_with(norm_key, key) WHERE length(key) >= 6 AND phrase NOT IN (SELECT phrase FROM x)),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY seq, title) AS k FROM (SELECT * FROM x UNION ALL SELECT * FROM y))"""


@query(f"{_CATALOGUE} SELECT phrase, title, seq, how FROM r WHERE k <= 10")
def catalog_lookup(spark, d):
    return resolve.lookup(_phrases(spark, d), _catalogue(spark, d)).select("phrase", "title", "seq", "how")


@query(f"""{_CATALOGUE}, s AS (SELECT s_suppkey AS seq, s_name AS title FROM supplier), q AS (SELECT phrase FROM p UNION SELECT s_name FROM supplier), a AS (SELECT phrase, title, seq, how, 'catalogue' AS origin FROM r WHERE k <= 10)
SELECT phrase, count(*) AS n, min(origin) AS origin FROM (SELECT * FROM a UNION ALL SELECT q.phrase, s.title, s.seq, 'exact', 'suppliers' FROM q JOIN s ON q.phrase = s.title WHERE q.phrase NOT IN (SELECT phrase FROM a)) GROUP BY 1""")
def catalog_fallback(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("title"), F.array(F.lit("x")).alias("authors"))
    asked = _phrases(spark, d).union(_t(spark, d, "supplier").select("s_name"))
    found = resolve.fallback(asked.distinct(), [("catalogue", _catalogue(spark, d)), ("suppliers", resolve.catalogue_rows(s))])
    return found.groupBy("phrase").agg(F.count("*").alias("n"), F.min("origin").alias("origin"))


@query("""WITH p AS (SELECT DISTINCT p_name AS phrase, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS n FROM part), s AS (SELECT DISTINCT regexp_replace(lower(substr(p_name, 1, 5)), '[^a-z0-9]', '', 'g') AS s FROM part WHERE p_partkey < 6)
SELECT phrase FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(s.s, p.n) OR contains(p.n, s.s))""")
def serial_veto(spark, d):
    """Against the few short names its SQL has; serial_veto_all has whole names of a whole table."""
    part = _t(spark, d, "part")
    return resolve.without_serials(part.select(F.col("p_name").alias("phrase")).distinct(), part.where("p_partkey < 6").select(F.substring("p_name", 1, 5).alias("container")))


_VETO_PHRASES = "SELECT p_name AS phrase FROM part UNION SELECT substr(s_name, 10, 1000) FROM supplier UNION SELECT p_name || ' ' || s_name FROM part JOIN supplier ON p_partkey = s_suppkey UNION SELECT c_name FROM customer"


@query(f"""WITH p AS (SELECT phrase, regexp_replace(lower(phrase), '[^a-z0-9]', '', 'g') AS n FROM ({_VETO_PHRASES})), s AS (SELECT DISTINCT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS s FROM supplier)
SELECT phrase FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.s <> '' AND p.n <> '' AND (contains(s.s, p.n) OR contains(p.n, s.s)))""")
def serial_veto_all(spark, d):
    """Whole names of all suppliers as serials; parts, customers, pieces of suppliers' names and names around them as phrases."""
    part, supplier, customer = (_t(spark, d, n) for n in ("part", "supplier", "customer"))
    around = part.join(supplier, F.col("p_partkey") == F.col("s_suppkey")).select(F.concat_ws(" ", "p_name", "s_name"))
    phrases = part.select(F.col("p_name").alias("phrase")).union(supplier.select(F.substring("s_name", 10, 1000))).union(around).union(customer.select("c_name")).distinct()
    return resolve.without_serials(phrases, supplier.select(F.col("s_name").alias("container")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(p_name), p_size ORDER BY p_partkey) AS n FROM part) SELECT p_partkey AS seq, p_name AS title FROM r WHERE n = 1""")
def catalog_seed(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), F.array(F.lit("A")).alias("author_name"), (F.lit(1900) + F.col("p_size")).alias("first_publish_year"))
    return resolve.seed(p).select("seq", "title")


@query("""SELECT p_name AS phrase, 0::BIGINT AS seq, 'On ' || p_name AS title, 'A ' || p_brand AS authors, CASE WHEN p_size % 5 > 0 THEN 1900 + p_size END::INTEGER AS year, 3 AS editions, 'Press' AS publisher FROM part
WHERE p_size % 3 < 2 AND len(list_filter(regexp_extract_all(p_name, '[A-Za-z0-9'']+'), lambda w: length(w) > 2)) >= 2""")
def register_books(spark, d):
    """A register's replies made of all parts: a book, a monograph or an article each, and an article after it."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.element_at(F.array(*map(F.lit, ("book", "monograph", "journal-article"))), (F.col("p_size") % 3 + 1).cast("int"))
    year = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("[["), (F.lit(1900) + F.col("p_size")).cast("string"), F.lit(", 3]]"))).otherwise("[[null]]")
    reply = F.concat(F.lit('{"message": {"items": [{"type": '), quoted(kind), F.lit(', "title": ['), quoted(F.concat(F.lit("On "), "p_name")), F.lit('], "author": [{"given": "A", "family": '), quoted(F.col("p_brand")), F.lit('}], "issued": {"date-parts": '), year, F.lit('}, "publisher": "Press"}, {"type": "journal-article", "title": ["x"]}]}}'))
    docs = resolve.monographs(_t(spark, d, "part").select(F.col("p_name").alias("phrase"), reply.alias("value")))
    return docs.select("phrase", "seq", "title", F.array_join("author_name", "; ").alias("authors"), F.col("first_publish_year").alias("year"), F.col("edition_count").alias("editions"), "publisher")


@query()
def match_docs(spark, d):
    p = _phrases(spark, d)
    return resolve.match(resolve.lookup(p, _catalogue(spark, d)))


# ---------------------------------------------------------------- evidence


_TIER = "CASE WHEN source IS NOT NULL OR heard THEN 'confirmed' WHEN freq >= 2 OR ctx THEN 'verified' ELSE 'weak' END"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'spine' END AS source, l_tax > 0.06 AS heard, l_quantity::BIGINT % 4 AS freq, l_discount > 0.05 AS ctx FROM lineitem)
SELECT {_TIER} AS status, count(*) AS n FROM c GROUP BY 1""")
def status_counts(spark, d):
    c = _t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "spine").alias("source"), (F.col("l_tax") > 0.06).alias("heard"), (F.col("l_quantity").cast("long") % 4).alias("freq"), (F.col("l_discount") > 0.05).alias("ctx"))
    return c.select(evidence.tier(F.col("source"), F.col("heard"), F.col("freq"), F.col("ctx")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT user_id, event_type || ' ' || event_id AS phrase, value AS conf, event_id AS ord FROM events WHERE event_type IN ('view', 'click')), s AS (SELECT user_id, event_type || ' ' || event_id AS phrase, event_id AS ord FROM events WHERE event_type NOT IN ('view', 'click')),
u AS (SELECT user_id, phrase, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, ord) AS rn, 0 AS ch FROM v UNION ALL SELECT user_id, phrase, row_number() OVER (PARTITION BY user_id ORDER BY ord), 1 FROM s),
q AS (SELECT user_id, phrase, row_number() OVER (PARTITION BY user_id ORDER BY rn, ch)::INTEGER AS queue_pos FROM u) SELECT * FROM q WHERE queue_pos <= 40""")
def interleave(spark, d):
    e = _t(spark, d, "events").select("user_id", F.concat_ws(" ", "event_type", "event_id").alias("phrase"), F.col("value").alias("conf"), F.col("event_id").alias("ord"), F.col("event_type").isin("view", "click").alias("visual"))
    q = resolve.queue(e.where("visual").drop("visual"), e.where("NOT visual").drop("visual", "conf"), 40, "user_id")
    return q.select("user_id", "phrase", "queue_pos")


@query()
def verify_queue(spark, d):
    matched = resolve.match(resolve.lookup(_phrases(spark, d), _catalogue(spark, d)))
    p = _phrases(spark, d).withColumn("doc_id", F.length("phrase")).withColumn("queue_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("phrase")))
    alts = F.array(F.concat("phrase", F.lit("x")), F.col("phrase"))
    q = p.withColumn("alts", alts).withColumn("phrase", F.when(F.col("queue_pos") % 3 == 0, F.concat("phrase", F.lit("x"))).otherwise(F.col("phrase"))).withColumn("freq", F.lit(1))
    return resolve.verify(q, matched, most=40).select("doc_id", "queue_pos", "phrase", "matched_as", "verified", "skipped", "context_ok", "title")


@query("""SELECT DISTINCT doc_id, w AS phrase FROM documents, (VALUES ('the'), ('of ')) p(w) WHERE lang = 'en' AND regexp_matches(lower(text), '\\b(book|books|memoir|essay|writes|wrote|writing|author|read|reading|published|publication|chapter|title|titled|called|edition|press|argues|says|said|footnote|bibliography|cite|cites|monograph)\\b') AND contains(lower(text), w)
 AND len(list_filter(range(1, length(text)::BIGINT), lambda i: substr(lower(text), i, length(w)) = w AND regexp_matches(substr(lower(text), greatest(i - 80, 1), 80 + length(w) + least(i - 1, 80)), '(^|[^a-z])(book|books|memoir|essay|writes|wrote|writing|author|read|reading|published|publication|chapter|title|titled|called|edition|press|argues|says|said|footnote|bibliography|cite|cites|monograph)([^a-z]|$)'))) > 0""")
def book_context(spark, d):
    """Of the English documents, which its SQL has; book_context_all has all."""
    return _book_context(_segments(spark, d).where("lang = 'en'"))


@query()
def book_context_all(spark, d):
    return _book_context(_segments(spark, d))


def _book_context(s):
    p = s.select("doc_id", F.explode(F.array(F.lit("the"), F.lit("of "))).alias("phrase"))
    return mining.in_context(p, s)


@query()
def heard_titles(spark, d):
    """Title candidates of each document among all its lines, whole."""
    docs = _segments(spark, d)
    c = mining.title_candidates(docs).select("doc_id", F.col("phrase").alias("id"), F.col("phrase").alias("text"), F.when(F.length("phrase").between(6, 40), "spine").otherwise("cover").alias("source"), F.lit(0.7).alias("ar"))
    return evidence.hear(c, _lines(spark, d)).select("doc_id", F.col("id").alias("phrase"), "heard", "heard_as", "heard_score")


def _reads(spark, d):
    li = _t(spark, d, "lineitem").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return li.select(F.floor(F.col("l_orderkey") / 100).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("p_name").alias("text"), (F.lit(1) - F.col("l_discount")).alias("conf"), (F.col("l_orderkey") % 100 * 200.0).alias("x"), (F.col("l_linenumber") * 30.0).alias("y"), F.lit(100.0).alias("w"), F.lit(20.0).alias("h"))


@query()
def cluster_reads(spark, d):
    return evidence.cluster_reads(_reads(spark, d)).select("doc_id", "cluster", "text", "conf", F.size("variants").alias("n"))


@query()
def group_reads(spark, d):
    return evidence.group_reads(_reads(spark, d))


@query()
def dedupe_entries(spark, d):
    r = _reads(spark, d).select("doc_id", "ord", F.col("text").alias("phrase"), F.initcap("text").alias("title"), F.array(F.lit("A")).alias("authors"), F.lit(1990).alias("year"), F.col("conf").alias("score"), F.lit("exact").alias("match_type"), F.lit(1).alias("freq"), F.lit(None).cast("string").alias("source"), F.lit("weak").alias("status"))
    return evidence.dedupe(r)


# ---------------------------------------------------------------- boxes


_BOX = "WITH b AS (SELECT l_orderkey AS seg, l_linenumber AS file, min(l_partkey % 900)::BIGINT AS x, min(l_suppkey * 37 % 500)::BIGINT AS y, (120 + min(l_quantity::BIGINT) * 9) AS w, (130 + l_orderkey % 300)::BIGINT AS h, 0.5 + min(l_tax) * 3 AS density FROM lineitem GROUP BY 1, 2)"


def _boxes(spark, d):
    least = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").alias("file")).agg(*[F.expr(f"min({e})").alias(n) for e, n in (("l_partkey % 900", "x"), ("l_suppkey * 37 % 500", "y"), ("cast(l_quantity AS long)", "q"), ("l_tax", "tax"))])
    return least.selectExpr("seg", "file", "x", "y", "120 + q * 9 AS w", "130 + seg % 300 AS h", "0.5 + tax * 3 AS density")


@query(f"""{_BOX}, k AS (SELECT * FROM b WHERE density >= 0.6 AND w * h / (1280 * 720) BETWEEN 0.012 AND 0.85 AND least(w, h) >= 120),
s AS (SELECT seg, file, x, y, w, h FROM k WHERE w / h <= 1.15 UNION ALL SELECT seg, file, x, y, w // 2, h FROM k WHERE w / h > 1.15 UNION ALL SELECT seg, file, x + w // 2, y, w - w // 2, h FROM k WHERE w / h > 1.15)
SELECT seg, file, x::BIGINT AS x, y, w::BIGINT AS w, h, floor(w * h * 1000000 / 921600)::BIGINT AS frame_ppm, floor(w * 1000000 / h)::BIGINT AS ar_ppm FROM s""")
def panel_filter(spark, d):
    p = spatial.keep_panels(_boxes(spark, d), F.lit(1280), F.lit(720))
    exact = [F.floor(F.col("w") * F.col("h") * 1000000 / 921600).alias("frame_ppm"), F.floor(F.col("w") * 1000000 / F.col("h")).alias("ar_ppm")]  # engines round decimals apart
    return p.select("seg", "file", "x", "y", "w", "h", *exact)


@query(f"""{_BOX}, t AS (SELECT seg, file AS k, x AS x0, y AS y0, x + 10 AS x1, y + 10 AS y1, 'w' || file AS text FROM b)
SELECT p.seg, p.file, coalesce(string_agg(t.text, ' | ' ORDER BY t.y0, t.x0, t.text), '') AS text FROM b p LEFT JOIN t ON t.seg = p.seg AND (t.x0 + t.x1) / 2 BETWEEN p.x - p.w * 0.18 AND p.x + p.w * 1.18 AND (t.y0 + t.y1) / 2 BETWEEN p.y - p.h * 0.18 AND p.y + p.h * 1.18 GROUP BY 1, 2""")
def panel_text(spark, d):
    b = _boxes(spark, d)
    blocks = b.select(F.concat("seg", F.lit(".png")).alias("frame"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10).alias("x1"), (F.col("y") + 10).alias("y1"), F.concat(F.lit("w"), "file").alias("text"))
    return spatial.attach_panel_text(b, blocks).select("seg", "file", "text")


@query(f"""{_BOX}, l AS (SELECT seg, seg % 5 AS t, y::DOUBLE AS y, x::DOUBLE AS x, 'line ' || (x % 40) || ' end' AS text, density AS conf FROM b), q AS (SELECT seg, t, list_sort(list(x)) AS xs FROM l GROUP BY 1, 2),
c AS (SELECT l.*, CASE WHEN x > xs[(len(xs) // 3) + 1] THEN 1 ELSE 0 END AS col, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM l JOIN q USING (seg, t)),
f AS (SELECT *, row_number() OVER (PARTITION BY seg, k ORDER BY col, t, y, x, text) AS n FROM c WHERE length(k) >= 6)
SELECT seg, (row_number() OVER (PARTITION BY seg ORDER BY col, t, y, x, text) - 1)::INTEGER AS seq, col::INTEGER AS "column", text FROM f WHERE n = 1""")
def stitch_lines(spark, d):
    lines = _boxes(spark, d).select("seg", (F.col("seg") % 5).alias("t"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.concat(F.lit("line "), (F.col("x") % 40), F.lit(" end")).alias("text"), F.col("density").alias("conf"))
    return spatial.stitch(lines, "seg").select("seg", "seq", "column", "text")


@query(f"""{_BOX} SELECT seg, file, (x + o.o)::BIGINT AS x0, o.o::INTEGER AS "offset", CASE turn WHEN 'ccw' THEN 2000 - 1 - (y + h) WHEN 'cw' THEN y ELSE x + o.o END::INTEGER AS x, CASE turn WHEN 'ccw' THEN x + o.o WHEN 'cw' THEN 900 - 1 - (x + w + o.o) ELSE y END::INTEGER AS y
FROM (SELECT *, ['none', 'ccw', 'cw'][1 + file % 3] AS turn FROM b), (VALUES (0), (1600)) o(o)""")
def tiles_and_turns(spark, d):
    b = spatial.tiles(_boxes(spark, d).withColumn("width", F.lit(2000)))
    turn = F.element_at(F.array(F.lit("none"), F.lit("ccw"), F.lit("cw")), (F.lit(1) + F.col("file") % 3).cast("int"))
    r = b.select("seg", "file", "offset", (F.col("x") + F.col("offset")).alias("moved"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), turn.alias("turn"), F.lit(2000).alias("image_w"), F.lit(900).alias("image_h"))
    return spatial.unrotate(r).select("seg", "file", F.col("moved").alias("x0"), "offset", "x", "y")


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS n FROM (SELECT * FROM events)) SELECT user_id, event_id FROM r WHERE n <= 3""")
def sharpest_frames(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("sharpness"), F.struct("ts", "event_id").alias("t"))
    return spatial.sharpest(e, "user_id").select("user_id", "event_id")


# ---------------------------------------------------------------- lineage and exports


_TREE = [("a", None, "1", "kept"), ("b", "a", "1", "kept"), ("c", "b", "2", "dropped"), ("d", "a", "x", "keep"), ("r8-synth", "c", "8", "kept"), ("o-catalog", "zz", "open", "kept")]
_TREE_SQL = ", ".join(f"({i}, '{a}', {'NULL' if p is None else repr(p)}, '{r}', '{v}')" for i, (a, p, r, v) in enumerate(_TREE))


def _nodes(spark):
    rows = [(i, a, p, r, "why " + a, "do", "saw", "m=1", v, "") for i, (a, p, r, v) in enumerate(_TREE)]
    return spark.createDataFrame(rows, "seq int, id string, parent string, round string, intent string, action string, observation string, metric string, verdict string, commit string")


@query(f"""WITH RECURSIVE n(seq, id, parent, round, verdict) AS (VALUES {_TREE_SQL}), up AS (SELECT id, parent AS at, id AS path, 1 AS depth FROM n UNION ALL SELECT u.id, n.parent, n.id || ' <- ' || u.path, u.depth + 1 FROM up u JOIN n ON n.id = u.at)
SELECT id, arg_max(path, depth) AS path, max(depth)::INTEGER AS depth FROM up GROUP BY id""")
def lineage_paths(spark, d):
    return lineage.paths(_nodes(spark))


@query(f"""WITH n(seq, id, parent, round, verdict) AS (VALUES {_TREE_SQL}) SELECT id, CASE id WHEN 'r8-synth' THEN 0.79 WHEN 'o-catalog' THEN 0.35 ELSE 0.05 END::DOUBLE AS impact FROM n WHERE verdict = 'kept'""")
def lineage_rank(spark, d):
    return lineage.rank(_nodes(spark)).select("id", "impact")


def _tree(spark, d):
    """Customers as an exploration tree: each branches off from the one with half its key."""
    c = _t(spark, d, "customer")
    name = lambda k: F.concat(F.lit("c"), k.cast("string"))
    up = F.floor(F.col("c_custkey") / 2)
    verdict = F.when(F.col("c_acctbal") > 5000, "kept").when(F.col("c_acctbal") > 0, "keep").otherwise("dropped")
    return c.select(F.col("c_custkey").cast("int").alias("seq"), name(F.col("c_custkey")).alias("id"), F.when(up >= 1, name(up)).alias("parent"), F.col("c_nationkey").cast("string").alias("round"), F.col("c_name").alias("intent"), F.col("c_mktsegment").alias("action"), F.lit("seen").alias("observation"), F.lit("m").alias("metric"), verdict.alias("verdict"), F.lit("").alias("commit"))


_TREE_OF = """WITH RECURSIVE n AS (SELECT c_custkey AS seq, 'c' || c_custkey AS id, CASE WHEN c_custkey // 2 >= 1 THEN 'c' || (c_custkey // 2) END AS parent, c_nationkey::VARCHAR AS round, c_name AS intent, c_mktsegment AS action, CASE WHEN c_acctbal > 5000 THEN 'kept' WHEN c_acctbal > 0 THEN 'keep' ELSE 'dropped' END AS verdict FROM customer)"""


@query(f"""{_TREE_OF}, up AS (SELECT id, parent AS at, id AS path, 1 AS depth FROM n UNION ALL SELECT u.id, n.parent, n.id || ' <- ' || u.path, u.depth + 1 FROM up u JOIN n ON n.id = u.at)
SELECT id, arg_max(path, depth) AS path, max(depth)::INTEGER AS depth FROM up GROUP BY id""")
def lineage_tree(spark, d):
    return lineage.paths(_tree(spark, d))


@query(f"""{_TREE_OF} SELECT round, '## Round ' || round || chr(10) || chr(10) || string_agg('- **' || id || '** [' || verdict || ']' || chr(10) || '  - intent: ' || intent || chr(10) || '  - action: ' || action || chr(10) || '  - outcome: seen (metric: m)'
 || CASE WHEN parent IS NOT NULL THEN chr(10) || '  - branched from: ' || parent ELSE '' END, chr(10) ORDER BY seq) AS text FROM n GROUP BY round""")
def lineage_rounds(spark, d):
    return lineage.render(_tree(spark, d))


@query(f"""{_TREE_OF} SELECT id, 0.05::DOUBLE AS impact FROM n WHERE verdict = 'kept'""")
def lineage_ranks(spark, d):
    return lineage.rank(_tree(spark, d)).select("id", "impact")


@query()
def lineage_log(spark, d):
    return lineage.log(_nodes(spark))


@query("""SELECT p_partkey, '@book{' || regexp_replace(lower(p_brand), '[^a-z]', '', 'g') || (1900 + p_size) || ',' || chr(10) || '  title  = {' || p_name || '},' || chr(10) || '  author = {' || p_brand || '},' || chr(10) || '  year   = {' || (1900 + p_size) || '},' || chr(10)
 || '  note   = {score=None via exact; provenance=' || p_name || '}' || chr(10) || '}' AS bibtex, 'TY  - BOOK' || chr(10) || 'TI  - ' || p_name || chr(10) || 'AU  - ' || p_brand || chr(10) || 'PY  - ' || (1900 + p_size) || chr(10) || 'N1  - score=None match=exact' || chr(10) || 'ER  - ' || chr(10) AS ris FROM part""")
def exports(spark, d):
    e = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_name").alias("phrase"), F.array("p_brand").alias("authors"), (F.lit(1900) + F.col("p_size")).alias("year"), F.lit(None).cast("double").alias("score"), F.lit("exact").alias("match_type"), F.array("p_name").alias("provenance"))
    return export.ris(export.bibtex(e)).select("p_partkey", "bibtex", "ris")


@query()
def fused_report(spark, d):
    """The whole fusion plan: shelves made of order lines, talks, pages' lines as bibliographies, parts as catalogue."""
    from .pipeline import Artifacts, compile_entries

    talk = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("seq"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")
    out = compile_entries(Artifacts(scroll=_lines(spark, d).select("doc_id", F.col("seq").cast("long").alias("seq"), "text"), spines=_reads(spark, d), segments=talk, catalogues=[("catalogue", _catalogue(spark, d))]), spark)
    return out["entries"].select("doc_id", "phrase", "title", "year", "score", "match_type", "status")
