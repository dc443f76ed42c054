"""Structured Streaming twins of the batch operators.

Stateless operators (normalisation, filters, classification, policy) take a streaming
DataFrame as they are. The ones below keep state per key: each micro-batch brings a key's
rows once, they are folded in event order, and state that idles past the watermark expires. The fold functions are
small; parsing and classification run before them as Column expressions."""

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade import rules
from palisade.operators.classify import classify_payloads
from palisade.operators.enrich import sni_provider
from palisade.operators.normalize import attribute, whole_micros
from palisade.operators.sessions import SEGMENT

WATERMARK = "60 seconds"
_IDLE_MS = 300_000


def _batches(frames) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True)


def _timed(df: DataFrame, watermark: str) -> DataFrame:
    """Add the event time that drives expiry."""
    return df.withColumn("event_time", F.timestamp_micros(whole_micros(F.col("timestamp_ns")))).withWatermark("event_time", watermark)


def _keep_until_idle(state: GroupState, rows: pd.DataFrame, idle_ms: int) -> None:
    state.setTimeoutTimestamp(int(rows["timestamp_ns"].max()) // 1_000_000 + idle_ms)


def _expiring(fold, idle_ms):
    """Wrap fold(key, rows, state tuple or None) -> (rows, new state) with an idle timeout."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _batches(frames)
        out, after = fold(key, rows, tuple(state.get) if state.exists else None)
        state.update(after)
        _keep_until_idle(state, rows, idle_ms)
        if len(out):
            yield out

    return run


def _stateful(df: DataFrame, keys, run, output: str, state: str, watermark=WATERMARK) -> DataFrame:
    return _timed(df, watermark).groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- counters


def event_counters(events: DataFrame, every="1 minute", watermark=WATERMARK) -> DataFrame:
    """Events and bytes per window, event type and provider; late rows beyond the watermark
    show in the query's progress metrics."""
    flat = events.select("timestamp", *events.drop("timestamp").columns).withWatermark("timestamp", watermark)
    keyed = flat.select("timestamp", *_flat_columns())
    return (
        keyed.groupBy(F.window("timestamp", every).alias("w"), "event_type", "provider")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"))
        .select(F.col("w.start").alias("start"), "event_type", "provider", "events", "bytes")
    )


def _flat_columns():
    return [
        attribute("event_type").alias("event_type"),
        F.coalesce(attribute("provider"), F.lit("none")).alias("provider"),
        attribute("bytes").alias("bytes"),
    ]


def events_per_second(events: DataFrame, watermark=WATERMARK) -> DataFrame:
    timed = events.select("timestamp").withWatermark("timestamp", watermark)
    return timed.groupBy(F.window("timestamp", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        F.unix_seconds("w.start").alias("second"), "events"
    )


# ---------------------------------------------------------------- server names


#: Buckets of pids that hold their state together.
SNI_BUCKETS = 256


def asof_sni(network: DataFrame, handshakes: DataFrame, ttl_ns=rules.SNI_TTL_NS, watermark=WATERMARK, buckets=SNI_BUCKETS) -> DataFrame:
    """event_id, pid, sni: the pid's latest handshake at or before each event, if younger than
    the TTL. Events wait until the watermark has passed them, so the order in which rows arrive
    does not matter; rows older than the watermark are dropped.

    State is kept per (bucket of pids, TTL-long period): handshakes also go to the period after
    theirs, so a busy pid is spread over periods and its state ends with them. The pids of a bucket
    are matched by one search, so calls do not grow with their number."""
    period = lambda: F.floor(F.col("timestamp_ns") / ttl_ns)
    bucket = F.pmod(F.xxhash64("pid"), F.lit(buckets)).alias("bucket")
    none = F.lit(None).cast("string")
    # events without a pid (kind 2) have no name, but are not lost
    of = F.coalesce("pid", F.lit(0)).cast("bigint").alias("pid")
    asked = network.select(bucket, of, "timestamp_ns", "event_id", F.when(F.col("pid").isNull(), 2).otherwise(1).alias("kind"), none.alias("sni"), period().alias("period"))
    seen = handshakes.where("pid IS NOT NULL").select(bucket, of, "timestamp_ns", "event_id", F.lit(0).alias("kind"), "sni", F.explode(F.array(period(), period() + 1)).alias("period"))

    def run(key, frames, state: GroupState):
        unpack = lambda x: [np.frombuffer(bytes(x), np.int64).reshape(4, -1)]
        shakes, names, pending = [np.zeros((4, 0), np.int64)], [], [np.zeros((4, 0), np.int64)]
        if state.exists:
            held = state.get
            shakes, names, pending = unpack(held[0]), list(held[1]), unpack(held[2])
        for f in frames if not state.hasTimedOut else ():
            rows = np.array([f[c].to_numpy(np.int64) for c in ("pid", "timestamp_ns", "event_id", "kind")])
            said = rows[3] == 0
            shakes.append(rows[:, said])
            names += f["sni"][said].tolist()
            pending.append(rows[:, ~said])
        shakes, pending, names = np.concatenate(shakes, axis=1), np.concatenate(pending, axis=1), np.array(names, object)
        mark = state.getCurrentWatermarkMs() * 1_000_000
        due = pending[:, pending[1] <= mark]
        if due.size:
            order = np.lexsort((shakes[2], shakes[1], shakes[0]))
            pid, at = shakes[0, order], shakes[1, order]
            # places on one line: each pid has a stretch of it
            known, stretch, start = np.unique(pid), 4 * ttl_ns, (int(key[1]) - 2) * ttl_ns
            line = lambda p, t: np.searchsorted(known, p) * stretch + t - start
            place = np.searchsorted(line(pid, at), line(due[0], due[1]), "right") - 1
            named = np.full(due.shape[1], None, object)
            if len(pid):
                near = np.maximum(place, 0)
                found = (place >= 0) & (pid[near] == due[0]) & (due[1] - at[near] < ttl_ns) & (due[3] == 1)
                named[found] = names[order][near[found]]
            of = pd.Series(due[0], dtype="Int64").mask(due[3] == 2)
            yield pd.DataFrame({"event_id": due[2], "pid": of, "sni": named})
        pending = pending[:, pending[1] > mark]
        end_ms = (int(key[1]) + 1) * ttl_ns // 1_000_000
        if not pending.size and state.getCurrentWatermarkMs() >= end_ms:
            if state.exists:
                state.remove()
            return
        state.update((shakes.tobytes(), names.tolist(), pending.tobytes()))
        # a timeout fires once the watermark is beyond it
        first = -(-int(pending[1].min()) // 1_000_000) - 1 if pending.size else end_ms - 1
        state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))

    kept = "shakes binary, names array<string>, pending binary"
    return _stateful(asked.union(seen), ["bucket", "period"], run, "event_id bigint, pid bigint, sni string", kept, watermark)


# ---------------------------------------------------------------- connections


def connection_verdicts(chunks: DataFrame, undecided=rules.UNDECIDED_CHUNKS, late=True) -> DataFrame:
    """A row whenever a connection is decided: pid, ssl_ptr, verdict, decided_at. A boring one
    may turn interesting later (unless late is False); its last row counts. Chunks of decided
    connections are still counted, but not kept."""
    hit = F.col("is_interesting") | sni_provider(F.col("sni")).isNotNull()
    flagged = classify_payloads(chunks, with_fingerprint=False).select("pid", "ssl_ptr", "timestamp_ns", "seq", hit.alias("hit"))

    def fold(key, batch, state):
        seen, said = state or (0, "")
        found = []
        if said != "interesting" and (late or not said):
            hits = np.flatnonzero(batch.sort_values(["timestamp_ns", "seq"])["hit"].to_numpy())
            at = seen + int(hits[0]) + 1 if len(hits) else None
            dull = not said and seen + len(batch) >= undecided and (at is None or at > undecided)
            if dull:
                found.append((*key, "boring", undecided))
                said = "boring"
            if at is not None and (late or not dull):
                found.append((*key, "interesting", at))
                said = "interesting"
        return pd.DataFrame(found, columns=["pid", "ssl_ptr", "verdict", "decided_at"]), (seen + len(batch), said)

    output = "pid bigint, ssl_ptr bigint, verdict string, decided_at int"
    return _stateful(flagged, ["pid", "ssl_ptr"], _expiring(fold, _IDLE_MS), output, "seen bigint, said string")


def turns(chunks: DataFrame, segment=SEGMENT, idle_ms=_IDLE_MS) -> DataFrame:
    """Turns of followed connections: pid, ssl_ptr, direction, segment, payload, chunks, closed.

    A full segment is emitted at once; the last one of a turn (closed) when the direction changes,
    for a pending response also when the connection idles. State holds less than a segment."""
    rows = chunks.select("pid", "ssl_ptr", "timestamp_ns", "seq", "direction", "payload").filter(F.octet_length("payload") > 0)
    names = ["pid", "ssl_ptr", "direction", "segment", "payload", "chunks", "closed"]

    def run(key, frames, state: GroupState):
        direction, number, held, n = state.get if state.exists else (None, 0, b"", 0)
        if state.hasTimedOut:
            state.remove()
            if direction == 1 and n:
                yield pd.DataFrame([(*key, direction, number, bytes(held), n, True)], columns=names)
            return
        batch = _batches(frames).sort_values(["timestamp_ns", "seq"])
        ways, payloads = batch["direction"].to_numpy(), batch["payload"].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(ways)) + 1).tolist(), len(ways)]
        done, held = [], bytes(held)
        for start, end in zip(cuts, cuts[1:]):
            if direction is not None and ways[start] != direction:
                done.append((*key, direction, number, held, n, True))
                number, held, n = 0, b"", 0
            direction = int(ways[start])
            held, n = held + b"".join(payloads[start:end]), n + end - start
            while len(held) > segment:
                done.append((*key, direction, number, held[:segment], n, False))
                number, held = number + 1, held[segment:]
        state.update((direction, number, held, n))
        _keep_until_idle(state, batch, idle_ms)
        if done:
            yield pd.DataFrame(done, columns=names)

    output = "pid bigint, ssl_ptr bigint, direction int, segment int, payload binary, chunks int, closed boolean"
    return _stateful(rows, ["pid", "ssl_ptr"], run, output, "direction int, segment int, held binary, n int")


# ---------------------------------------------------------------- relays


def relay_edges(actions: DataFrame, window_ms=rules.RELAY_WINDOW_MS, watermark=WATERMARK, period_ms=60_000) -> DataFrame:
    """from_id, to_id, type, ts_ms, event_id: the source of each inbound action that relays an outbound
    one of another identity in its container, the earliest within the window.

    actions(identity_id, container_id, type, ts_ms, event_id). Inbound actions wait until the
    watermark has passed them, so the order of arrival does not matter. State is kept by
    (container, period); what is sent also goes to the period that its window reaches into, so a
    busy container is spread over periods and its state ends with them."""
    from palisade.operators.graph import INBOUND, OUTBOUND

    kind = F.when(F.col("type").isin(*OUTBOUND), 0).when(F.col("type").isin(*INBOUND), 1)
    rows = actions.where(F.coalesce("container_id", F.lit("")) != "").select("container_id", "identity_id", "ts_ms", "event_id", kind.alias("kind"), (F.col("ts_ms") * 1_000_000).alias("timestamp_ns"))
    at = lambda ms: F.floor(ms / period_ms)
    first, last = at(F.col("ts_ms")), F.when(F.col("kind") == 0, at(F.col("ts_ms") + window_ms)).otherwise(at(F.col("ts_ms")))
    rows = rows.where("kind IS NOT NULL").withColumn("period", F.explode(F.sequence(first, last)))
    columns = ["ts_ms", "event_id", "identity_id"]

    def source(sent, mine, now):
        """The place of the earliest sent action of another identity before each received one."""
        at, event, who = sent
        other, nearest = np.empty(len(at), np.int64), len(at)  # the next one of another identity
        for i in range(len(at) - 1, -1, -1):
            nearest = nearest if i + 1 == len(at) else i + 1 if who[i + 1] != who[i] else other[i + 1]
            other[i] = nearest
        place = np.searchsorted(at, now[0] - window_ms, "right")
        held = np.append(who, 0)
        place = np.where((place < len(at)) & (held[np.minimum(place, len(at))] == mine), np.append(other, len(at))[np.minimum(place, len(at))], place)
        inside = np.minimum(place, len(at) - 1)
        earlier = (at[inside] < now[0]) | ((at[inside] == now[0]) & (event[inside] < now[1]))
        return np.where((place < len(at)) & earlier, inside, -1)

    def run(key, frames, state: GroupState):
        held = [list(x) for x in state.get] if state.exists else [[] for _ in range(6)]
        for f in frames if not state.hasTimedOut else ():
            for which in (0, 1):
                part = f[f["kind"] == which]
                for i, c in enumerate(columns):
                    held[3 * which + i] += part[c].tolist()
        mark = state.getCurrentWatermarkMs()
        sent, got = (np.array(held[i : i + 3], np.int64).reshape(3, -1) for i in (0, 3))
        sent = sent[:, np.lexsort((sent[1], sent[0]))]
        due = got[:, got[0] <= mark]
        if due.size and sent.size:
            place = source(sent, due[2], due)
            found = place >= 0
            yield pd.DataFrame({"from_id": sent[2][place[found]], "to_id": due[2][found], "type": "HttpRelay", "ts_ms": due[0][found], "event_id": due[1][found]})
        got = got[:, got[0] > mark]
        # what no action to come can follow any more goes
        sent = sent[:, sent[0] > min(mark, got[0].min(initial=mark + 1)) - window_ms]
        if not got.size and (not sent.size or mark >= (int(key[1]) + 1) * period_ms):
            if state.exists:
                state.remove()
            return
        state.update(tuple(x.tolist() for x in (*sent, *got)))
        state.setTimeoutTimestamp(max(int(got[0].min()) - 1 if got.size else (int(key[1]) + 1) * period_ms - 1, mark + 1))

    kept = ", ".join(f"{side}_{c} array<bigint>" for side in ("sent", "got") for c in columns)
    return _stateful(rows, ["container_id", "period"], run, "from_id bigint, to_id bigint, type string, ts_ms bigint, event_id bigint", kept, watermark)


# ---------------------------------------------------------------- behaviour windows


def symbol_windows(symbols: DataFrame, size=rules.WINDOW_SIZE, minimum=rules.WINDOW_MIN, stride=rules.WINDOW_STRIDE) -> DataFrame:
    """pid, window_end, symbols: the last `size` symbols at event minimum, minimum + stride, ..."""
    rows = symbols.select("pid", "timestamp_ns", "event_id", F.col("symbol").cast("int").alias("symbol"))

    def fold(key, batch, state):
        count, held = state or (0, [])
        held, found = list(held), []
        for r in batch.sort_values(["timestamp_ns", "event_id"]).itertuples():
            held = [*held[-(size - 1) :], int(r.symbol)]
            count += 1
            if count >= minimum and (count - minimum) % stride == 0:
                found.append((key[0], count, list(held)))
        return pd.DataFrame(found, columns=["pid", "window_end", "symbols"]), (count, held)

    return _stateful(rows, ["pid"], _expiring(fold, _IDLE_MS), "pid bigint, window_end bigint, symbols array<int>", "count bigint, held array<int>")


# ---------------------------------------------------------------- micro-batch jobs


def each_batch(stream: DataFrame, job, checkpoint: str, **trigger):
    """Run job(batch, batch_id) on every micro-batch."""
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def policy_job(load_rules, write, **options):
    """Job that reads the rules again for every micro-batch, so edits apply without a restart.

    load_rules(spark) -> (events -> events with rule-data flags, list of rules)."""
    from palisade.operators.policy import apply_policy

    def job(batch, batch_id):
        prepare, current = load_rules(batch.sparkSession)
        write(apply_policy(prepare(batch), current, **options), batch_id)

    return job


def routing_job(handlers):
    """Job that splits each micro-batch of a mixed capture by kind: handlers[kind](rows, batch_id)."""
    from palisade.sources.events import route_by_kind

    def job(batch, batch_id):
        kept = batch.persist()
        for kind, rows in route_by_kind(kept).items():
            if kind in handlers:
                handlers[kind](rows, batch_id)
        kept.unpersist()

    return job


def identity_job(path: str, write, **options):
    """Job that resolves the instances of each micro-batch against those stored under `path`.

    Stored are, appended by batch, the entries that resolution reads (first actions, first uses of
    providers, prompts) and the results. A batch folds its own entries, and of the stored ones
    the slices of time that late entries change (`resolution.extend`). Results equal those of all
    actions resolved at once; what was written for earlier batches stays as it was. A batch
    that runs again replaces what it had stored."""
    from palisade.operators import identity as I
    from palisade.operators import resolution as R
    from palisade.plans.stage import materialize, scratch_scope

    def log(spark, name, batch_id):
        try:
            return spark.read.parquet(f"{path}/{name}").where(F.col("batch") < batch_id)
        except AnalysisException:
            return None

    def job(batch, batch_id):
        spark = batch.sparkSession
        actions = I.identity_actions(batch).drop("identity")
        with scratch_scope(spark):
            stored, results = log(spark, "entries", batch_id), log(spark, "results", batch_id)
            state = None if results is None else materialize(R.latest(results))
            more, changed, state = R.extend(None if stored is None else stored.drop("batch"), state, I.resolution_entries(actions), **options)
            more.write.mode("overwrite").parquet(f"{path}/entries/batch={batch_id}")
            changed.write.mode("overwrite").parquet(f"{path}/results/batch={batch_id}")
            write(I.assign_identities(actions, I.with_confidence(state)), batch_id)

    return job


def retrain_job(store: str, train, every=200, keep=10_000, bucket=3_600_000_000):
    """Job that appends labelled vectors (ts, label, features) and refits on the newest `keep`
    after every `every` new samples. train(samples, n) is called with the training frame.

    Samples lie in buckets of time (`bucket` units of ts), and each batch records how many it put in
    which: the total and the newest buckets that hold `keep` rows come from these records, and
    only those buckets are read. Buckets behind them are deleted: the store is a ring. A batch that
    runs again replaces what it had stored."""
    from palisade.plans.stage import delete_path

    def job(batch, batch_id):
        spark = batch.sparkSession
        rows = batch.select("ts", "label", "features", F.floor(F.col("ts") / bucket).cast("bigint").alias("bucket"), F.lit(batch_id).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{store}/samples")
        batch.groupBy(F.floor(F.col("ts") / bucket).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").json(f"{store}/counts/batch={batch_id}")
        counts = spark.read.schema("bucket bigint, n bigint, batch bigint").json(f"{store}/counts").where(F.col("batch") <= batch_id)
        sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("batch") < batch_id, F.col("n"))), F.lit(0))).first()
        total, before = int(sums[0]), int(sums[1])
        if not total:
            return

        def needed(records):
            """The oldest bucket that the newest `keep` samples reach into."""
            newer = F.sum("n").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1))
            held = records.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("_newer", F.coalesce(newer, F.lit(0)))
            return held.where(F.col("_newer") < keep).agg(F.min("bucket")).first()[0]

        first, last_first = needed(counts), needed(counts.where(F.col("batch") < batch_id))
        if total // every > before // every:
            samples = spark.read.parquet(f"{store}/samples").where((F.col("bucket") >= first) & (F.col("batch") <= batch_id)).select("ts", "label", "features")
            train(samples.orderBy(F.desc("ts")).limit(keep), total)
        left = (F.col("bucket") < first) & ((F.col("batch") == batch_id) | (F.col("bucket") >= (first if last_first is None else last_first)))
        for r in counts.where(left).select("bucket").distinct().collect():  # what fell out with this batch
            delete_path(spark, f"{store}/samples/bucket={r['bucket']}")

    return job
