"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources they belong to). A min-cost
flow routes token capacity from patterns to source quotas; a pattern's tokens cost more with
each repetition (convex), so the flow repeats documents only where a quota needs it. Documents
are then selected in a seeded order, pattern by pattern, until the routed tokens are reached.

Totals and targets are tables: sources are numbered, weighted and filled on the cluster, and each
group of patterns that overlap is a flow of its own in a task. The order inside a pattern is found through hash buckets, of which only the one that holds the cut
is sorted, so one pattern may hold any share of the rows."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written
from palisade.llm.ngram_join import components

BUCKET_ROWS = 4096


def water_fill(sizes: dict, weights: dict, copies: int = 3) -> dict:
    """Shares of the total by weight; no source above copies x its size, the excess reshared: what
    `fill_sources` works out on tables, for a few sources."""
    total, targets, open_ = float(sum(sizes.values())), {}, set(sizes)
    left = total
    while open_:
        per = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if per * weights[s] > copies * sizes[s]}
        if not full:
            return targets | {s: per * weights[s] for s in open_}
        for s in full:
            targets[s] = float(copies * sizes[s])
        left -= sum(targets[s] for s in full)
        open_ -= full
    return targets


def route(patterns: dict, targets: dict, copies: int = 3) -> dict:
    """Min-cost flow: {pattern: tokens taken}. patterns: {tuple of sources: tokens}.

    Each pattern offers its tokens `copies` times, the k-th time at cost k. Successive cheapest
    paths: tiers fill in the order of cost, and inside a tier augmenting paths may reroute what
    other patterns have sent, until no quota can take more."""
    sent = {p: {s: 0.0 for s in p} for p in patterns}
    need = dict(targets)
    members: dict = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)

    def augment(start, room: float) -> float:
        """Push up to room tokens from pattern start to any source with need left."""
        seen, queue, back = {start}, [start], {}
        for p in queue:
            for s in p:
                if s in back or need.get(s, 0) < 0:
                    continue
                back[s] = p
                if need.get(s, 0) > 1e-9:
                    path, flow, at = [], min(room, need[s]), s
                    while True:
                        path.append((back[at], at))
                        if back[at] == start:
                            break
                        via = came[back[at]]
                        flow, at = min(flow, sent[back[at]][via]), via
                    for k, (q, to) in enumerate(path):
                        sent[q][to] += flow
                        if k + 1 < len(path):
                            sent[q][path[k + 1][1]] -= flow
                    need[s] -= flow
                    return flow
                for q in members[s]:
                    if q not in seen and sent[q][s] > 1e-9:
                        seen.add(q)
                        came[q] = s
                        queue.append(q)
        return 0.0

    for _ in range(copies):
        for p in sorted(patterns, key=lambda p: (len(p), tuple("" if s is None else s for s in p), None in p)):
            room = float(patterns[p])
            while room > 1e-9:
                came: dict = {}
                got = augment(p, room)
                if got <= 0:
                    break
                room -= got
    return {p: sum(x.values()) for p, x in sent.items()}


def cyclic_weights(names: list) -> dict:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    order = sorted(n for n in names if n is not None) + [None] * (None in names)
    return {s: 1 + i % 3 for i, s in enumerate(order)}


def _sources(patterns: DataFrame) -> DataFrame:
    """source, size, rank: sources with the tokens of all their patterns, numbered by code point from
    0, null last. Ranges are numbered by themselves, so any number of sources may be there."""
    spark = patterns.sparkSession
    sizes = patterns.select(F.explode("pattern").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("size"))
    order = F.asc_nulls_last("source")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(sizes.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(offsets, "_part").select("source", "size", (F.col("_before") + F.col("_place")).cast("bigint").alias("rank"))


def _weighted(sources: DataFrame, weights) -> DataFrame:
    """sources with their weight: 1, 2, 3, repeating, or weights(names) -> {name: weight}."""
    if weights is cyclic_weights:
        return sources.withColumn("weight", (1 + F.col("rank") % 3).cast("double"))
    names = [r["source"] for r in sources.select("source").collect()]
    given = weights(names)
    table = sources.sparkSession.createDataFrame([(n, float(given[n])) for n in names], "source string, weight double")
    return sources.join(table, sources["source"].eqNullSafe(table["source"])).select(sources["*"], "weight")


def fill_sources(sources: DataFrame, total: float, copies: int = 3) -> DataFrame:
    """sources (source, size, weight, ...) with their target: shares of `total` by weight, none above
    `copies` times its size (scaled to the total where sources overlap), the excess reshared.

    A target is min(cap, level * weight). The level rises from the plain share: what full sources
    leave over goes to the others, until no further one is full. Each step is one aggregate."""
    sums = sources.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not sums["weight"]:
        return sources.withColumn("target", F.lit(0.0))
    cap = F.col("size") * F.lit(copies * (total / sums["size"] if sums["size"] else 0.0))
    level = total / sums["weight"]
    while True:
        full = cap < F.lit(level) * F.col("weight")
        state = sources.agg(F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if state["taken"] is None or not state["weight"]:
            break
        higher = (total - state["taken"]) / state["weight"]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _routed(copies: int):
    """The flow of each group of patterns that hang together through their sources."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        targets = {s: t for r in rows for s, t in zip(r["pattern"], r["targets"], strict=True)}
        taken = route({tuple(r["pattern"]): r["tokens"] for r in rows}, targets, copies)
        return pa.table({"_p": pa.array([r["_p"] for r in rows]), "taken": pa.array([float(taken[tuple(r["pattern"])]) for r in rows])})

    return run


def plan_of(patterns: DataFrame, sources: DataFrame, copies: int = 3) -> DataFrame:
    """_p, tokens, rows, taken, source_size, target of each pattern.

    A pattern that shares no source with another takes its source's target. Patterns that hang
    together are one flow, solved in one task (a row a pattern); such groups are apart."""
    split = patterns.select("_p", "tokens", "rows", F.posexplode("pattern").alias("at", "source"))
    met = split.join(sources, split["source"].eqNullSafe(sources["source"])).select("_p", "tokens", "rows", "at", split["source"], "size", "target", "rank")
    facts = F.array_sort(F.collect_list(F.struct("at", "source", "target", "rank")))
    one = met.groupBy("_p").agg(F.first("tokens").alias("tokens"), F.first("rows").alias("rows"), F.sum("size").alias("source_size"), F.sum("target").alias("target"), facts.alias("f"))
    one = written(one.withColumn("node", F.col("f")[0]["rank"]), "mix-facts")
    links = one.where(F.size("f") > 1).select("node", F.explode(F.slice("f", 2, F.size("f"))).alias("x")).select(F.col("node").alias("a"), F.col("x.rank").alias("b"))
    alone = one.select("_p", F.least("target", F.lit(copies) * F.col("tokens")).alias("taken"))
    if links.isEmpty():
        taken = alone
    else:
        labels = components(links)
        grouped = one.join(labels, "node").select("_p", "tokens", "label", F.transform("f", lambda x: x["source"]).alias("pattern"), F.transform("f", lambda x: x["target"]).alias("targets"))
        routed = grouped.groupBy("label").applyInArrow(_routed(copies), "_p string, taken double")
        taken = alone.join(labels.select(F.col("node")).join(one.select("node", "_p"), "node").select("_p"), "_p", "left_anti").unionByName(routed)
    return one.drop("f", "node").join(taken, "_p")


def mix(docs: DataFrame, doc_id: str, size: Column, sources: Column, weights=cyclic_weights, copies: int = 3, seed: int = 17, key: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, size, pattern (sorted sources), n_copies, plus
    source_size and target, summed over the sources of its pattern, and `key` if one is given (it
    tells rows of one id apart).

    sources: an array of names (a null entry is a source of its own; a null or empty array
    counts as [null]). weights: source names -> weights; the default is worked out on the cluster,
    other functions get the names on the driver. Documents of size 0 are never taken. The document
    at the cut is taken once more if that brings its pattern nearer to the flow. Equal rows are
    interchangeable. An empty table gives an empty table. There may be any number of sources."""
    listed = F.coalesce(F.when(F.size(sources) > 0, F.array_sort(F.array_distinct(sources))), F.array(F.lit(None).cast("string")))
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), listed.alias("pattern"), *([] if key is None else [key.alias("key")]))
    more_columns = [] if key is None else ["key"]
    # a pattern has no null itself, but may hold one: compare as text
    base = written(base.withColumns({"_draw": F.xxhash64(F.lit(seed), "doc_id"), "_p": F.to_json("pattern")}), "mix-sizes")
    patterns = written(base.groupBy("_p", "pattern").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-patterns")
    named = written(_weighted(_sources(patterns), weights), "mix-weights")
    # quotas come from the real total; overlapping documents count once in it
    real = patterns.agg(F.sum("tokens")).first()[0] or 0
    targets = written(fill_sources(named, float(real), copies), "mix-targets")
    plan = plan_of(patterns, targets, copies)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(copies), F.floor(F.col("taken") / F.col("tokens") + 1e-9))).otherwise(0).cast("int")
    rest = F.when(F.col("whole") < copies, F.col("taken") - F.col("whole") * F.col("tokens")).otherwise(0.0)
    plan = written(plan.withColumn("whole", whole).select("_p", "whole", rest.alias("rest"), (1 + F.floor(F.col("rows") / BUCKET_ROWS)).alias("buckets"), "source_size", "target"), "mix-plan")
    named = base.join(plan, "_p")
    named = named.withColumn("_b", F.pmod(F.shiftrightunsigned("_draw", 20), F.col("buckets")))
    sums = named.where("size > 0").groupBy("_p", "_b").agg(F.sum("size").alias("_in"))
    before = Window.partitionBy("_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_p", "_b", "_in", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"))
    placed = named.join(starts, ["_p", "_b"], "left")
    inside = (F.col("_start") < F.col("rest")) & (F.col("_start") + F.col("_in") > F.col("rest")) & (F.col("size") > 0)
    cut = placed.where(inside)
    upto = Window.partitionBy("_p", "_b").orderBy("_draw", "doc_id", "size", *more_columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("_upto", F.col("_start") + F.sum("size").over(upto))
    # the document over the cut counts if at least half of it lies before the cut
    more = (F.col("_upto") - F.col("size") / 2 <= F.col("rest")).cast("int")
    rest_of = placed.where(~inside | inside.isNull()).withColumn("_more", F.coalesce(((F.col("_start") + F.col("_in") <= F.col("rest")) & (F.col("size") > 0)).cast("int"), F.lit(0)))
    both = cut.withColumn("_more", more).drop("_upto").unionByName(rest_of)
    n = F.when(F.col("size") > 0, F.col("whole") + F.col("_more")).otherwise(0)
    return both.select("doc_id", "size", "pattern", n.cast("int").alias("n_copies"), "source_size", "target", *more_columns)

