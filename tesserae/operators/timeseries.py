"""Change detection over ordered series: each series is a key, its rows are ordered by `pos` from 0.

Every window is partitioned by the series key, so series are independent and spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Numbers the rows of each series from 0."""
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))


def array_mad(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def consecutive_mad(df: DataFrame, key: str, value: str, is_array: bool = False) -> DataFrame:
    """Adds mad: how far each row is from the one before; the first row of a series has 0."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("pos"))
    diff = array_mad(F.col(value), before) if is_array else F.abs(F.col(value) - before)
    return df.withColumn("mad", F.when(before.isNull(), F.lit(0.0)).otherwise(diff))


def rolling_median(df: DataFrame, key: str, k: int, value: str = "mad", out: str = "win") -> DataFrame:
    """Centred median over 2k+1 rows, the ends repeated outwards."""
    n = F.max("pos").over(Window.partitionBy(key))
    df = df.withColumn("_last", n)
    # the first and last row stand k times more, outside the series
    places = F.when((F.col("pos") == 0) & (F.col("_last") == 0), F.sequence(F.lit(-k), F.lit(k)))
    places = places.when(F.col("pos") == 0, F.sequence(F.lit(-k), F.lit(0))).when(F.col("pos") == F.col("_last"), F.sequence(F.col("_last"), F.col("_last") + k))
    wide = df.withColumn("_at", F.explode(places.otherwise(F.array("pos"))))
    frame = Window.partitionBy(key).orderBy("_at").rowsBetween(-k, k)
    wide = wide.withColumn(out, F.percentile(value, F.lit(0.5)).over(frame))
    return wide.where(F.col("_at") == F.col("pos")).drop("_at", "_last")


def islands(df: DataFrame, key: str, gap: int = 2, pos: str = "pos") -> DataFrame:
    """Adds island: rows whose positions lie at most `gap` apart form one, numbered from 1."""
    w = Window.partitionBy(key).orderBy(pos)
    starts = F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap, F.lit(True))
    return df.withColumn("island", F.sum(starts.cast("int")).over(w))


def cuts(df: DataFrame, key: str, spike: float = 1.5, stable: float = 1.0, gap: int = 2) -> DataFrame:
    """The first row of each run of isolated spikes in a calm surrounding (mad, win needed)."""
    found = df.where((F.col("mad") > spike) & (F.col("win") < stable))
    before = F.lag("pos").over(Window.partitionBy(key).orderBy("pos"))
    return found.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("pos") - F.col("_b") > gap)).drop("_b")


def moving_runs(df: DataFrame, key: str, fps: float, stable: float = 1.0, least_s: float = 3.0, most_s: float = 180.0) -> DataFrame:
    """(key, start_s, end_s, n) of maximal runs of motion that last long enough and not too long."""
    moving = df.where(F.col("win") >= stable)
    run = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    runs = moving.withColumn("_run", run).groupBy(key, "_run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    return runs.where((F.col("n") / fps).between(least_s, most_s)).select(key, (F.col("lo") / fps).alias("start_s"), (F.col("hi") / fps).alias("end_s"), "n")


def representatives(df: DataFrame, cut_rows: DataFrame, key: str, fps: float, least: int = 2, include_head: bool = False) -> DataFrame:
    """(key, t): the calmest row from each cut to the next, in seconds; the stretch before the first cut is
    left out unless asked for."""
    marked = df.join(cut_rows.select(key, "pos", F.lit(1).alias("_cut")), [key, "pos"], "left")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("interval", F.coalesce(F.sum("_cut").over(w), F.lit(0)))
    best = marked.where(F.lit(include_head) | (F.col("interval") >= 1)).groupBy(key, "interval").agg(F.count("*").alias("n"), F.min_by("pos", F.struct("win", "pos")).alias("pos"))
    return best.where(F.col("n") >= least).select(key, F.bround(F.col("pos") / fps, 2).alias("t")).distinct()


def robust_spikes(df: DataFrame, key: str, value: str = "mad", z: float = 8.0, gap: int = 2) -> DataFrame:
    """The highest row of each group of rows above median + z * 1.4826 * MAD; the first row does not count
    for the statistics. A series without spikes gives no rows."""
    # percentile aggregates combine before the shuffle, so a long series is no single task's work
    med = df.where("pos > 0").groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    near = df.join(med, key)
    dev = near.where("pos > 0").groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).alias("_dev"))
    above = near.join(dev, key).where(F.col(value) > F.col("_med") + z * 1.4826 * (F.col("_dev") + 1e-9))
    grouped = islands(above, key, gap)
    peak = F.max_by(F.struct("pos", value), F.struct(F.col(value), -F.col("pos")))
    return grouped.groupBy(key, "island").agg(peak.alias("p")).select(key, F.col("p.pos").alias("pos"), F.col(f"p.{value}").alias(value))


def tolerance_scores(found: DataFrame, truth: DataFrame, key: str | list[str], tolerance: int) -> DataFrame:
    """(key, n, precision, recall, f1) of positions that match within a tolerance.

    Both sides meet in buckets of tolerance + 1 positions, so the range join is an equi-join."""
    keys, size = [key] if isinstance(key, str) else list(key), tolerance + 1
    f = found.select(*keys, F.col("pos").alias("f_pos")).distinct()
    t = truth.select(*keys, F.col("pos").alias("t_pos")).distinct()
    spread = f.withColumn("_b", F.explode(F.array(*[F.floor(F.col("f_pos") / size) + d for d in (-1, 0, 1)])))
    met = spread.join(t.withColumn("_b", F.floor(F.col("t_pos") / size)), [*keys, "_b"]).where(F.abs(F.col("f_pos") - F.col("t_pos")) <= tolerance)
    hits = met.groupBy(*keys).agg(F.countDistinct("f_pos").alias("tp_found"), F.countDistinct("t_pos").alias("tp_truth"))
    sizes = f.groupBy(*keys).agg(F.count("*").alias("n")).join(t.groupBy(*keys).agg(F.count("*").alias("n_truth")), keys, "full")
    totals = sizes.join(hits, keys, "left").na.fill(0, ["n", "n_truth", "tp_found", "tp_truth"])
    p = F.when(F.col("n") > 0, F.col("tp_found") / F.col("n")).otherwise(F.lit(0.0))
    r = F.when((F.col("n") > 0) & (F.col("n_truth") > 0), F.col("tp_truth") / F.col("n_truth")).otherwise(F.lit(0.0))
    both = totals.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return both.select(*keys, "n", "precision", "recall", f1.alias("f1"))


def hold_detector(df: DataFrame, key: str, distance, value: str, settings: list[tuple[float, int]]) -> DataFrame:
    """(key, thr, hold, pos) of cuts for each setting: a row that stays over `thr` away from the last kept
    row for `hold` rows running becomes the next kept one; position 0 is a cut. distance(a, b) is an expression.

    The scan is a fold over each series' ordered rows inside the JVM; series are gathered once for all settings."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("rows"))
    rows = rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("thr"), F.lit(h).alias("hold")) for t, h in settings])))
    zero = F.struct(F.lit(0).alias("run"), F.get("rows", F.lit(0))["v"].alias("kept"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, r: Column) -> Column:
        run = F.when(distance(r["v"], s["kept"]) > F.col("s.thr"), s["run"] + 1).otherwise(F.lit(0))
        cut_here = run >= F.col("s.hold")
        return F.struct(F.when(cut_here, F.lit(0)).otherwise(run).alias("run"), F.when(cut_here, r["v"]).otherwise(s["kept"]).alias("kept"), F.when(cut_here, F.concat(s["cuts"], F.array(r["pos"]))).otherwise(s["cuts"]).alias("cuts"))

    later = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    return rows.select(key, "s.thr", "s.hold", F.explode(F.aggregate(later, zero, step, lambda s: s["cuts"])).alias("pos"))


def pixel_share(a: Column, b: Column) -> Column:
    """Percent of values that differ by more than 25."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > 25)) * 100.0 / F.size(a)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def histogram_distance(a: Column, b: Column) -> Column:
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


#: The distances compared, with their thresholds; each is tried with these holds.
DETECTORS = {"pixdiff": (5, 12, 20), "blockmad": (5, 8, 12), "phash": (8, 14, 22), "histrgb": (0.05, 0.1, 0.2)}
HOLDS = (1, 3, 5)


def run_bench(frames: DataFrame, key: str, fps: float, spike: float = 1.5, stable: float = 1.0, window_s: float = 2.0) -> DataFrame:
    """(key, mode, thr, hold, segs, prec, rec, f1) of every detector against robust spikes, best first.
    frames: key, pos, gray, blocks, phash, hist."""
    moved = rolling_median(consecutive_mad(frames.select(key, "pos", "blocks"), key, "blocks", True).drop("blocks"), key, int(window_s * fps) // 2)
    truth, tolerance = robust_spikes(moved, key).select(key, "pos"), round(0.25 * fps)
    measures = {"pixdiff": (pixel_share, "gray"), "blockmad": (array_mad, "blocks"), "phash": (hamming, "phash"), "histrgb": (histogram_distance, "hist")}
    found = cuts(moved, key, spike, stable).select(key, F.lit("STABILITY-GATED").alias("mode"), F.lit(float(spike)).alias("thr"), F.lit("-").alias("hold"), "pos")
    for mode, thresholds in DETECTORS.items():
        settings = [(t, h) for t in thresholds for h in HOLDS]
        got = hold_detector(frames, key, measures[mode][0], measures[mode][1], settings)
        found = found.union(got.select(key, F.lit(mode).alias("mode"), "thr", F.col("hold").cast("string").alias("hold"), "pos"))
    every = [("STABILITY-GATED", float(spike), "-"), *[(m, float(t), str(h)) for m, ts in DETECTORS.items() for t in ts for h in HOLDS]]
    grid = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("thr"), F.lit(h).alias("hold")) for m, t, h in every])
    wanted = truth.withColumn("g", F.explode(grid)).select(key, "g.mode", "g.thr", "g.hold", "pos")
    s = tolerance_scores(found, wanted, [key, "mode", "thr", "hold"], tolerance)
    scores = [F.bround(c, 3).alias(a) for c, a in (("precision", "prec"), ("recall", "rec"), ("f1", "f1"))]
    return s.select(key, "mode", "thr", "hold", (F.col("n") + 1).alias("segs"), *scores).orderBy(F.desc("f1"), "mode", "thr", "hold")
