"""Agent graph: relays, edges, nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import rules
from palisade.plans.ordered import carry_last, time_slice
from palisade.plans.stage import materialize

OUTBOUND = ["Prompt", "ToolResult", "McpRequest"]
INBOUND = ["Response", "ToolCall", "McpResponse"]


def relay_edges(actions: DataFrame, window_ms=rules.RELAY_WINDOW_MS, slice_ms=60_000) -> DataFrame:
    """One HttpRelay interaction per inbound action that follows, within the window and in the
    same container, an outbound action of another identity; the earliest such one is the source.

    actions(identity_id, container_id, type, ts_ms, event_id). Read backwards in time, both
    "next outbound" and "next outbound of another identity" are carried values, so an inbound
    row needs one lookup at the start of its window and no range join."""
    boxed = actions.filter(F.coalesce("container_id", F.lit("")) != "")
    sent = boxed.filter(F.col("type").isin(*OUTBOUND)).select("container_id", "identity_id", "ts_ms", "event_id")
    back = ["_rts", "_rkind", "_rev"]
    reverse = lambda df, kind: df.withColumn("_rts", -F.col("ts_ms")).withColumn("_rkind", F.lit(kind)).withColumn("_rev", -F.col("event_id"))
    slices = time_slice(F.col("_rts"), slice_ms)
    me = F.struct("ts_ms", "event_id", "identity_id")
    key = ["container_id"]
    chained = carry_last(reverse(sent, 0), key, back, slices, me, "_next", inclusive=False)
    turn = F.when(F.col("_next.identity_id") != F.col("identity_id"), F.col("_next"))
    chained = materialize(carry_last(chained, key, back, slices, turn, "_other"))
    offers = chained.select("container_id", *back, F.struct(me.alias("me"), F.col("_other").alias("other")).alias("_offer"))

    got = boxed.filter(F.col("type").isin(*INBOUND))
    probes = got.select(
        "container_id", F.col("identity_id").alias("to_id"), F.col("ts_ms").alias("_t"), F.col("event_id").alias("_e"),
        # in reversed time the probe comes after everything at or past the window's first instant
        (-(F.col("ts_ms") - (window_ms - 1))).alias("_rts"), F.lit(1).alias("_rkind"), F.lit(0).cast("bigint").alias("_rev"),
    )
    both = probes.unionByName(offers, allowMissingColumns=True)
    placed = carry_last(both, key, back, slices, F.col("_offer"), "_first").filter(F.col("_e").isNotNull())
    own = F.col("_first.me.identity_id") == F.col("to_id")
    source = placed.withColumn("_s", F.when(own, F.col("_first.other")).otherwise(F.col("_first.me")))
    earlier = F.struct("_s.ts_ms", "_s.event_id") < F.struct(F.col("_t").alias("ts_ms"), F.col("_e").alias("event_id"))
    return source.filter(F.col("_s").isNotNull() & earlier).select(
        F.col("_s.identity_id").alias("from_id"), "to_id", F.lit("HttpRelay").alias("type"), F.col("_t").alias("ts_ms"), F.col("_e").alias("event_id")
    )


def agent_edges(interactions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counted edges per (from, to, type); both ends must be nodes."""
    edges = interactions.groupBy("from_id", "to_id", "type").agg(
        F.count(F.lit(1)).alias("count"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen")
    )
    ends = nodes.select("identity_id").distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(ends.withColumnRenamed("identity_id", end), end, "left_semi")
    return edges


def agent_nodes(actions: DataFrame, label="identity_label") -> DataFrame:
    """(identity_id, label, first_seen, last_seen); the label is the first event's."""
    return actions.groupBy("identity_id").agg(
        F.min_by(label, F.struct("ts_ms", "event_id")).alias("label"), F.min("ts_ms").alias("first_seen"), F.max("ts_ms").alias("last_seen")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("bigint").alias("edges"))
    e = edges.agg(F.lit(0).cast("bigint").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return n.unionByName(e).agg(F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"))


def out_edges(edges: DataFrame, identity_ids: DataFrame) -> DataFrame:
    return edges.join(identity_ids.select(F.col("identity_id").alias("from_id")).distinct(), "from_id", "left_semi")


def remove_nodes(edges: DataFrame, identity_ids: DataFrame) -> DataFrame:
    """Edges that remain when the identities are gone."""
    gone = identity_ids.select("identity_id").distinct()
    for end in ("from_id", "to_id"):
        edges = edges.join(gone.withColumnRenamed("identity_id", end), end, "left_anti")
    return edges
