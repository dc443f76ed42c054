"""Dashboard aggregates. Partial aggregation runs before every shuffle."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.operators.normalize import attribute


def _flat(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("process.name").alias("name"),
        F.col("process.pid").alias("pid"),
        attribute("provider").alias("provider"),
        attribute("bytes").alias("bytes"),
        attribute("pii_detected").alias("pii"),
        F.col("policy"),
        F.col("action.type").alias("action_type"),
        attribute("event_type").alias("event_type"),
    )


def _totals():
    return [
        F.count(F.lit(1)).alias("events"),
        F.sum("bytes").alias("bytes"),
        F.count_if("pii").alias("pii_events"),
    ]


def process_stats(events: DataFrame) -> DataFrame:
    """Per (name, pid): events, bytes, PII events, sorted providers; busiest first."""
    return (
        _flat(events)
        .groupBy("name", "pid")
        .agg(*_totals(), F.array_sort(F.collect_set("provider")).alias("providers"))
        .orderBy(F.desc("events"), "name", "pid")
    )


def provider_stats(events: DataFrame) -> DataFrame:
    """Per provider or 'Unknown': events, bytes, PII events, number of process names. The names
    are aggregated away first; `provider_processes` lists them as rows."""
    by_name = _flat(events).groupBy(F.coalesce("provider", F.lit("Unknown")).alias("provider"), "name").agg(*_totals())
    sums = [F.sum(c).alias(c) for c in ("events", "bytes", "pii_events")]
    return by_name.groupBy("provider").agg(*sums, F.count("name").alias("processes")).orderBy(F.desc("events"), "provider")


def provider_processes(events: DataFrame) -> DataFrame:
    """Process names seen with each provider, one row each with its events."""
    named = _flat(events).filter(F.col("name").isNotNull())
    return named.groupBy(F.coalesce("provider", F.lit("Unknown")).alias("provider"), F.col("name").alias("process")).agg(F.count(F.lit(1)).alias("events"))


def top_providers(events: DataFrame, n=3) -> DataFrame:
    return provider_stats(events).select("provider", "events").limit(n)


def kpis(events: DataFrame) -> DataFrame:
    # distinct (name, pid) is aggregated away first, so the final step sees one row per process
    per_process = _flat(events).groupBy("name", "pid").agg(*_totals(), *_decisions())
    return per_process.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("processes"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pii_events", "allow", "audit", "deny")],
    )


def _decisions():
    return [F.count_if(F.col("policy") == d).alias(d) for d in ("allow", "audit", "deny")]


def policy_breakdown(events: DataFrame) -> DataFrame:
    return events.agg(*_decisions())


def facets(events: DataFrame) -> DataFrame:
    """Distinct providers and action types as (facet, value) rows."""
    both = F.inline(
        F.array(
            F.struct(F.lit("provider").alias("facet"), F.col("provider").alias("value")),
            F.struct(F.lit("action_type").alias("facet"), F.col("action_type").alias("value")),
        )
    )
    return _flat(events).select(both).filter(F.col("value").isNotNull()).distinct().orderBy("facet", "value")


def event_counters(events: DataFrame) -> DataFrame:
    return (
        _flat(events)
        .groupBy("event_type", F.coalesce("provider", F.lit("none")).alias("provider"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))
    )


def coverage_gauges(events: DataFrame) -> DataFrame:
    """Distinct pids and providers among the events that name a provider."""
    named = _flat(events).filter(F.col("provider").isNotNull())
    pairs = named.select("pid", "provider").distinct()
    return pairs.agg(
        F.countDistinct("pid").alias("active_pids"), F.countDistinct("provider").alias("providers_detected")
    )


def decision_counters(decisions: DataFrame, column="policy") -> DataFrame:
    return (
        decisions.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("decision"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


def verdict_counters(connections: DataFrame) -> DataFrame:
    """Connections per verdict; undecided ones are tracked only."""
    return connections.groupBy("verdict").agg(F.count(F.lit(1)).alias("connections"))


def confidence_histogram(classified: DataFrame, bins=20) -> DataFrame:
    bucket = F.least(F.width_bucket(F.col("confidence"), F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins))
    return classified.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("payloads"))


def behavior_counters(windows: DataFrame) -> DataFrame:
    return windows.groupBy("behavior_class").agg(F.count(F.lit(1)).alias("windows"))


def events_per_second(events: DataFrame, keep=60) -> DataFrame:
    """The last `keep` one-second buckets, empty seconds included, with the five-bucket rate."""
    second = F.unix_seconds(F.col("timestamp"))
    counts = events.groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("events"))
    # a window of keep + 4 seconds up to the newest event; rows outside it never reach the gap fill
    last = counts.agg(F.max("second").alias("last"))
    axis = last.filter(F.col("last").isNotNull()).select(
        F.explode(F.sequence(F.col("last") - (keep + 3), F.col("last"))).alias("second"), "last"
    )
    filled = F.broadcast(axis).join(counts, "second", "left").fillna(0, ["events"])
    five = Window.orderBy("second").rowsBetween(-4, 0)
    return (
        filled.withColumn("rate", F.sum("events").over(five) / F.lit(5.0))
        .filter(F.col("second") > F.col("last") - keep)
        .select("second", "events", "rate")
    )


def recent_events(events: DataFrame, n=5000) -> DataFrame:
    """Newest n events, newest first (a top-k, not a full sort)."""
    return events.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def all_events(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first
