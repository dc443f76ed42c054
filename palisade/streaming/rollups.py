"""Gauges and distributions of streams as rollups that add up.

A stream gives one row for each short window, with mergeable sketches in place of exact distinct
sets and sorted values. Rows of any set of windows combine to the gauge of their union: hours
from minutes, one site from many, a batch beside a stream. The same functions take batch tables.

Errors: distinct counts have a relative standard error of 1.04 / sqrt(2 ** LG_K), 1.6 % here, and are
exact while few values were seen; quantiles are off by at most 1.7 % of the ranks at K = 200
with 99 % confidence. Counts and histogram buckets are exact."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palisade.operators.normalize import attribute

LG_K = 12
K = 200
BINS = 20
WATERMARK = "60 seconds"


def _windowed(df: DataFrame, every: str, watermark: str):
    timed = df.withWatermark("timestamp", watermark) if df.isStreaming else df
    return timed.groupBy(F.window("timestamp", every).alias("w"))


def gauge_rollup(events: DataFrame, every: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """start, events, pids, providers: of the events that name a provider, their number and
    sketches of the distinct pids and providers. As a stream: append mode, a row once the
    watermark has passed its window."""
    named = events.select("timestamp", F.col("process.pid").alias("pid"), attribute("provider").alias("provider")).where("provider IS NOT NULL")
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(LG_K)).alias(f"{c}s")
    return _windowed(named, every, watermark).agg(F.count(F.lit(1)).alias("events"), sketch("pid"), sketch("provider")).select(F.col("w.start").alias("start"), "events", "pids", "providers")


def coverage_gauges(rollups: DataFrame, every: str = "1 hour") -> DataFrame:
    """start, events, active_pids, providers_detected of longer windows, from rollups alone."""
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias({"pids": "active_pids", "providers": "providers_detected"}[c])
    rolled = rollups.groupBy(F.window("start", every).alias("w")).agg(F.sum("events").alias("events"), estimate("pids"), estimate("providers"))
    return rolled.select(F.col("w.start").alias("start"), "events", "active_pids", "providers_detected")


def confidence_rollup(classified: DataFrame, every: str = "1 minute", bins: int = BINS, watermark: str = WATERMARK) -> DataFrame:
    """start, payloads, bucket_1 .. bucket_<bins>, values: numbers of payloads by confidence and a sketch of
    the confidences. classified: timestamp, confidence (null ones do not count)."""
    known = classified.select("timestamp", F.col("confidence").cast("double").alias("confidence")).where("confidence IS NOT NULL")
    bucket = F.least(F.width_bucket("confidence", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    counts = [F.count_if(bucket == i).alias(f"bucket_{i}") for i in range(1, bins + 1)]
    rolled = _windowed(known, every, watermark).agg(F.count(F.lit(1)).alias("payloads"), *counts, F.kll_sketch_agg_double("confidence", F.lit(K)).alias("values"))
    return rolled.select(F.col("w.start").alias("start"), "payloads", *[f"bucket_{i}" for i in range(1, bins + 1)], "values")


def confidence_histogram(rollups: DataFrame, every: str = "1 hour", quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """start, payloads, histogram (array of bucket counts), q<percent> for each quantile, of longer
    windows, from rollups alone."""
    buckets = sorted((c for c in rollups.columns if c.startswith("bucket_")), key=lambda c: int(c.removeprefix("bucket_")))
    rolled = rollups.groupBy(F.window("start", every).alias("w")).agg(F.sum("payloads").alias("payloads"), F.array(*[F.sum(c) for c in buckets]).alias("histogram"), F.kll_merge_agg_double("values").alias("v"))
    names = [f"q{round(100 * q)}" for q in quantiles]
    return rolled.select(F.col("w.start").alias("start"), "payloads", "histogram", *[F.kll_sketch_get_quantile_double("v", F.lit(float(q))).alias(n) for q, n in zip(quantiles, names, strict=True)])


class LateRows(StreamingQueryListener):
    """Counts the rows that came after their watermark and were left out, by query and batch.

    Register with spark.streams.addListener; `table` has query, batch, late (batches with any)."""

    def __init__(self):
        super().__init__()
        self.seen: dict = {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if late:
            self.seen[p.name or str(p.id), p.batchId] = late

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(q, b, n) for (q, b), n in sorted(self.seen.items())], "query string, batch bigint, late bigint")
