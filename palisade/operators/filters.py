"""Filters and predicates over events and raw records."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import rules
from palisade.functions.hashing import any_true
from palisade.operators.normalize import attribute
from palisade.plans.ordered import running, time_slice


def filter_events(events: DataFrame, provider=None, process=None, type=None, policy=None) -> DataFrame:
    wanted = [
        (attribute("provider"), provider),
        (F.col("process.name"), process),
        (F.col("action.type"), type),
        (F.col("policy"), policy),
    ]
    tests = [column == value for column, value in wanted if value is not None]
    return events.filter(reduce(lambda a, b: a & b, tests)) if tests else events


def search_events(events: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over the text attributes."""
    if not query:
        return events
    needle = F.lit(query.lower())
    fields = [F.col("process.name")] + [
        attribute(a) for a in ("sni", "model", "provider", "sdk", "user_message", "file_path")
    ]
    return events.filter(any_true(F.coalesce(F.contains(F.lower(f), needle), F.lit(False)) for f in fields))


def model_events(events: DataFrame) -> DataFrame:
    """Events that name a provider."""
    return events.filter(attribute("provider").isNotNull())


def ai_processes(processes: DataFrame, column="comm") -> DataFrame:
    return processes.filter(any_true(F.startswith(F.col(column), F.lit(n)) for n in rules.AI_PROCESS_NAMES))


def ai_path(path, within: int | None = None):
    """Path holds an AI pattern; with `within`, one that starts in its first so many characters
    (a capture probe scans 64)."""
    found = (F.locate(p, path) for p in rules.AI_PATH_PATTERNS)
    return any_true(at.between(1, within) if within else at > 0 for at in found)


def ai_paths(file_access: DataFrame) -> DataFrame:
    return file_access.filter(ai_path(F.col("path")))


def dns_events(raw: DataFrame) -> DataFrame:
    return raw.filter((F.col("event_type") == 5) & (F.col("dport") == 53))


def pid_running_stats(network: DataFrame, slice_ns=60 * 10**9, order=("timestamp_ns", "event_id")) -> DataFrame:
    """Events, bytes and rate of each pid up to and including each row."""
    stats = running(
        network, ["pid"], list(order), time_slice(F.col("timestamp_ns"), slice_ns),
        run_events=("sum", F.lit(1).cast("bigint")),
        run_bytes=("sum", F.col("bytes")),
        _first=("min", F.col("timestamp_ns")),
    )
    seconds = (F.col("timestamp_ns") - F.col("_first")) / F.lit(1e9)
    rate = F.when(seconds < 0.001, F.lit(0.0)).otherwise(F.col("run_events") / seconds)
    return stats.withColumn("rate", rate).drop("_first")


def high_rate_tls(network: DataFrame, per_second=10.0, **options) -> DataFrame:
    """Rows on port 443 without a provider whose pid runs above `per_second`."""
    return pid_running_stats(network, **options).filter(
        F.col("provider").isNull() & (F.col("dport") == 443) & (F.col("rate") > per_second)
    )
