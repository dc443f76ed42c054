"""Streaming twins against their batch operators, fed in several micro-batches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palisade.checks.bindings import agentic, bound
from palisade.checks.q_sequences import chunk_rows
from palisade.operators import enrich, graph, identity, policy, sessions, windows
from palisade.operators import aggregates as A
from palisade.operators.normalize import symbolize
from palisade.sources import sinks
from palisade.streaming import flows, rollups


def replay(spark, df, tmp, order, files=3):
    """Write df as `files` Parquet files in time order and stream them one by one."""
    path = str(tmp / "in")
    total = df.count()
    numbered = df.orderBy(order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(df.schema.add("_i", "long"))
    for f in range(files):
        lo, hi = total * f // files, total * (f + 1) // files
        numbered.filter((F.col("_i") >= lo) & (F.col("_i") < hi)).drop("_i").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, name, tmp, mode="append"):
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp / name))
    finish(writer.trigger(availableNow=True).start())
    return spark.table(name)


def finish(query):
    try:
        assert query.awaitTermination(100), "stream did not finish"
    finally:
        query.stop()


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def sni_rows(spark, sf_dir):
    net, hs = bound(spark, sf_dir, "net"), bound(spark, sf_dir, "handshakes")
    both = net.select("event_id", "pid", "timestamp_ns", F.lit(None).cast("string").alias("sni"), F.lit(1).alias("kind")).union(
        hs.select("event_id", "pid", "timestamp_ns", "sni", F.lit(0))
    )
    return net, hs, both


def test_asof_sni(spark, sf_dir, tmp_path):
    net, hs, both = sni_rows(spark, sf_dir)
    s = replay(spark, both, tmp_path, "timestamp_ns")
    got = drain(spark, flows.asof_sni(s.filter("kind = 1"), s.filter("kind = 0")), "sni", tmp_path)
    # events up to the watermark are answered, the last minute still waits
    mark = both.agg(F.max("timestamp_ns")).first()[0] // 10**6 - 60_000
    want = enrich.asof_sni(net, hs).filter(F.floor(F.col("timestamp_ns") / 10**6) <= mark)
    assert want.count() > 100 and abs(got.count() - want.count()) <= 1
    assert set(rows(got, "event_id", "sni")) <= set(rows(enrich.asof_sni(net, hs), "event_id", "sni"))


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    """A newer handshake comes first, an older one and the event between them later."""
    sec = 10**9
    later = [(1, 7, 50 * sec, "new.example", 0), (2, 7, 60 * sec, None, 1)]
    earlier = [(3, 7, 10 * sec, "old.example", 0), (4, 7, 20 * sec, None, 1), (5, 7, 5 * sec, None, 1)]
    flush = [(9, 8, 10_000 * sec, None, 1)]
    schema = "event_id long, pid long, timestamp_ns long, sni string, kind int"
    for i, part in enumerate((later, earlier, flush)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = drain(spark, flows.asof_sni(s.filter("kind = 1"), s.filter("kind = 0")), "order", tmp_path)
    assert rows(got.filter("pid = 7"), "event_id", "sni") == [(2, "new.example"), (4, "old.example"), (5, None)]


def test_server_name_state_is_kept_by_buckets_of_pids(spark, tmp_path):
    sec = 10**9
    schema = "event_id long, pid long, timestamp_ns long, sni string, kind int"
    shakes = [(1000 + p, p, sec, f"host{p}", 0) for p in range(200)]
    asked = [(p, p, 2 * sec, None, 1) for p in range(250)] + [(900, None, 2 * sec, None, 1)]
    spark.createDataFrame(asked[:100] + shakes, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    spark.createDataFrame(asked[100:], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([(9999, 1, 10_000 * sec, None, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    named = flows.asof_sni(s.filter("kind = 1"), s.filter("kind = 0"), buckets=4)
    run = named.writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) <= 4 * 3
    want = {p: (p, f"host{p}" if p < 200 else None) for p in range(250)} | {900: (None, None)}
    assert {r.event_id: (r.pid, r.sni) for r in spark.table("buckets").collect()} == want


@pytest.mark.parametrize("rows, files", [(40, 1), (4000, 4)])
def test_replayed_batches_are_the_parts_in_order(spark, tmp_path, monkeypatch, rows, files):
    from palisade.checks import bindings

    monkeypatch.setattr(bindings, "REPLAY_ROWS", 250)
    s = bindings.replayed(spark, spark.range(rows), F.pmod("id", F.lit(4)), str(tmp_path))
    seen = []
    job = lambda df, _: seen.append(sorted(r.id for r in df.collect()))
    s.writeStream.foreachBatch(job).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [list(range(i, rows, 4)) for i in range(4)]
    assert all(len(list((tmp_path / "in" / str(i)).glob("*.parquet"))) == files for i in range(4))


def test_verdicts_and_turns(spark, sf_dir, tmp_path):
    c = chunk_rows(spark, sf_dir).select("pid", "ssl_ptr", "timestamp_ns", "seq", "direction", "sni", "comm", "payload")
    s = replay(spark, c, tmp_path, "timestamp_ns")
    got = drain(spark, flows.connection_verdicts(s), "verdicts", tmp_path)
    final = got.groupBy("pid", "ssl_ptr").agg(F.max_by(F.struct("verdict", "decided_at"), F.col("verdict") == "interesting").alias("v")).select("pid", "v.*")
    v = sessions.connection_verdicts(c)
    assert rows(final, "pid", "verdict", "decided_at") == rows(v.filter("verdict <> 'undecided'"), "pid", "verdict", "decided_at")
    got = drain(spark, flows.turns(s, segment=1000), "turns", tmp_path)
    every = c.select("pid", "ssl_ptr").distinct().select(
        "*", F.lit("interesting").alias("verdict"), F.struct(F.lit(0).cast("bigint").alias("timestamp_ns"), F.lit(0).cast("bigint").alias("seq")).alias("decided_by")
    )
    want = sessions.turns(c, every, segment=1000)
    # a pending response is flushed once the watermark is past its idle time
    mark = c.agg(F.max("timestamp_ns")).first()[0] // 10**6 - 60_000
    idle = (F.col("direction") == 1) & (F.col("ended_ns") / 10**6 + 300_000 < mark)
    # full segments of pending turns are out already
    want = want.filter(F.col("emitted") | idle | (F.octet_length("payload") == 1000))
    got = got.filter("closed OR length(payload) = 1000")
    have, full = rows(got, "pid", "direction", "segment", "payload"), rows(want, "pid", "direction", "segment", "payload")
    assert len(set(have)) > 100 and set(have) <= set(full) and set(rows(want.filter(F.col("emitted") | idle), "pid", "direction", "segment", "payload")) <= set(have)


def test_windows(spark, sf_dir, tmp_path):
    net = bound(spark, sf_dir, "net").withColumn("pid", F.col("pid") % 5)
    s = replay(spark, symbolize(net).select("pid", "timestamp_ns", "event_id", "symbol"), tmp_path, "timestamp_ns")
    got = drain(spark, flows.symbol_windows(s), "windows", tmp_path)
    want = windows.symbol_windows(net).withColumn("symbols", F.transform("ev", lambda e: e["symbol"]))
    assert want.count() > 50
    assert rows(got, "pid", "window_end", "symbols") == rows(want, "pid", "window_end", "symbols")


def test_counters(spark, sf_dir, tmp_path):
    e = agentic(spark, sf_dir)
    s = replay(spark, e, tmp_path, "timestamp")
    got = drain(spark, flows.event_counters(s, watermark="40 days"), "counters", tmp_path, "complete")
    total = got.groupBy("event_type", "provider").agg(F.sum("events").alias("events"), F.sum("bytes").alias("bytes"))
    assert rows(total, "event_type", "provider", "events", "bytes") == rows(A.event_counters(e), "event_type", "provider", "events", "bytes")
    per = drain(spark, flows.events_per_second(s, watermark="40 days"), "eps", tmp_path, "complete")
    assert per.agg(F.sum("events")).first()[0] == e.count()


def test_rules_are_read_again(spark, sf_dir, tmp_path):
    s = replay(spark, agentic(spark, sf_dir), tmp_path, "timestamp", files=2)
    calls, seen = [], {}

    def load(session):
        calls.append(1)
        decision = "deny" if len(calls) > 1 else "audit"
        return (lambda df: df), [policy.rule("any", decision, "true")]

    def write(df, batch_id):
        seen[batch_id] = {r.decision for r in df.select("decision").distinct().collect()}

    finish(flows.each_batch(s, flows.policy_job(load, write), str(tmp_path / "cp"), availableNow=True))
    assert seen == {0: {"audit"}, 1: {"deny"}}


def test_fan_out(spark, sf_dir, tmp_path):
    out = tmp_path / "sent"
    out.mkdir()

    def sender(target):
        import uuid

        def send(lines):
            lines = list(lines)
            if lines:
                (out / f"{target}-{uuid.uuid4().hex}").write_text("\n".join(lines))

        return send

    e = agentic(spark, sf_dir).limit(95)
    specs = [f"file:{tmp_path / 'nd'}", "webhook:hook", "syslog:log", "pager:x"]
    s = replay(spark, e, tmp_path, "timestamp", files=2)
    with pytest.warns(UserWarning, match="pager"):
        finish(sinks.fan_out_stream(s, specs, str(tmp_path / "cp"), {"availableNow": True}, senders={"webhook": sender, "syslog": sender}))
    sent = list(out.iterdir())
    hooks = [p.read_text().splitlines() for p in sent if p.name.startswith("hook")]
    logs = [x for p in sent if p.name.startswith("log") for x in p.read_text().splitlines()]
    assert sum(map(len, hooks)) == 95 and max(map(len, hooks)) <= 10
    assert len(logs) == 95 and all(x.startswith("<14>1 - palisade - - - - {") for x in logs)
    assert spark.read.json(str(tmp_path / "nd")).count() == 95


def test_relays_as_a_stream(spark, tmp_path):
    """Arrival out of order inside the watermark, containers over many periods, against the batch twin."""
    rnd = random.Random(11)
    sent = [(rnd.randrange(4), rnd.choice(["c", "c", "d", "", None]), rnd.choice(["Prompt", "Response", "McpRequest", "ToolCall", "Network"]), rnd.randrange(300_000), i) for i in range(700)]
    sent = sorted(sent, key=lambda r: r[3] + rnd.randrange(20_000))
    sent += [(9, "end", "Prompt", 10_000_000, 900 + i) for i in range(3)]  # moves the watermark on
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(sent)], "identity_id long, container_id string, type string, ts_ms long, event_id long, arrival long")
    names = ["from_id", "to_id", "type", "ts_ms", "event_id"]
    got = drain(spark, flows.relay_edges(replay(spark, df, tmp_path, "arrival", files=5), period_ms=20_000), "relays", tmp_path)
    want = graph.relay_edges(df.drop("arrival"))
    assert rows_of(got, names) == rows_of(want, names) and want.count() > 80


def rows_of(df, names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_identities_batch_by_batch(spark, sf_dir, tmp_path):
    e = agentic(spark, sf_dir)
    s = replay(spark, e, tmp_path, "timestamp")
    out = str(tmp_path / "out")
    names = ["event_id", "identity_id", "match_type"]
    job = flows.identity_job(str(tmp_path / "store"), lambda df, i: df.select(*names).write.parquet(f"{out}/batch={i}"))
    finish(flows.each_batch(s, job, str(tmp_path / "cp"), availableNow=True))
    actions = identity.identity_actions(e).drop("identity")
    want = identity.assign_identities(actions, identity.resolve_identities(actions))
    assert rows(spark.read.parquet(out), *names) == rows(want, *names)


def test_retraining_schedule(spark, tmp_path):
    samples = spark.range(450).select(F.col("id").alias("ts"), F.lit("a").alias("label"), F.array(F.col("id").cast("double")).alias("features"))
    s = replay(spark, samples, tmp_path, "ts", files=9)
    fits = []
    job = flows.retrain_job(str(tmp_path / "samples"), lambda df, n: fits.append((n, df.count(), df.agg(F.min("ts")).first()[0])), every=200, keep=120, bucket=20)
    finish(flows.each_batch(s, job, str(tmp_path / "cp"), availableNow=True))
    assert [n for n, _, _ in fits] == [200, 400] and fits[1][1:] == (120, 280)
    # a ring: buckets that the newest 120 samples do not need are gone, the count of all is not
    left = spark.read.parquet(str(tmp_path / "samples" / "samples"))
    kept = left.count()
    assert left.agg(F.min("ts")).first()[0] >= 300 and kept <= 150
    job(samples.where("ts >= 400"), 8)  # the last batch once more: as before
    assert [n for n, _, _ in fits] == [200, 400] and spark.read.parquet(str(tmp_path / "samples" / "samples")).count() == kept


def _timed_events(spark, n=4000):
    return spark.range(n).selectExpr(
        "id", "timestamp_seconds(1700000000 + cast(id / 4 as bigint)) AS timestamp", "named_struct('pid', id % 700) AS process",
        "named_struct('type', 'Prompt', 'provider', if(id % 3 = 0, concat('p', id % 9), null)) AS action", "cast(pmod(hash(id), 1000) / 1000.0 AS double) AS confidence",
    )


def test_gauges_and_quantiles_add_up(spark, tmp_path):
    """Minute rollups of a stream, combined to longer windows, against exact results of the table."""
    e = _timed_events(spark)
    s = replay(spark, e, tmp_path, "timestamp", files=4)
    made = drain(spark, rollups.gauge_rollup(s, watermark="0 seconds"), "gauge_minutes", tmp_path)
    exact = e.where("action.provider IS NOT NULL").groupBy(F.window("timestamp", "10 minutes").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("process.pid").alias("p"), F.countDistinct("action.provider").alias("q"))
    minutes = rollups.gauge_rollup(e)
    assert made.count() in (minutes.count(), minutes.count() - 1)  # the last window is still open
    want = {r["w"]["start"]: r for r in exact.collect()}
    got = {r["start"]: r for r in rollups.coverage_gauges(minutes, "10 minutes").collect()}
    assert want.keys() == got.keys()
    for k, r in want.items():
        assert got[k]["events"] == r["n"] and got[k]["providers_detected"] == r["q"] and abs(got[k]["active_pids"] - r["p"]) <= 0.05 * r["p"]
    rolled = rollups.confidence_histogram(rollups.confidence_rollup(e), "1 hour").orderBy("start").collect()
    first = min(r["start"] for r in rolled)
    values = sorted(r["confidence"] for r in e.where(F.date_trunc("hour", "timestamp") == F.lit(first)).collect())
    assert rolled[0]["payloads"] == len(values) == sum(rolled[0]["histogram"])
    for name, q in (("q50", 0.5), ("q90", 0.9), ("q99", 0.99)):
        rank = sum(v <= rolled[0][name] for v in values) / len(values)
        assert abs(rank - q) < 0.03
