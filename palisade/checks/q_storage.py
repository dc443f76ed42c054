"""Queries on sources and sinks: written and read back in the shared folder."""

from functools import reduce

from pyspark.sql import functions as F

from palisade import schemas
from palisade.checks.bindings import agentic, bound, ctes, payload_rows, replayed, table
from palisade.checks.q_events import PII
from palisade.checks.registry import query
from palisade.plans.stage import scratch_path
from palisade.sources import events as S
from palisade.sources import keyed, sinks


def _scratch(spark, name):
    return scratch_path(spark, name)


@query("s1_read_events", ctes("flat") + f" SELECT event_id, us, type, provider, bytes, pid, policy, {PII} AS pii, FALSE AS corrupt FROM flat")
def s1(spark, d):
    """Events written as NDJSON and read back with the explicit schema."""
    path = _scratch(spark, "events")
    sinks.write_ndjson(agentic(spark, d), path)
    e = S.read_events(spark, path)
    pii = F.coalesce((F.col("action.type") == "PiiDetected") | F.col("action.pii_detected"), F.lit(False))
    return e.select(
        "event_id", F.unix_micros("timestamp").alias("us"), "action.type", "action.provider", "action.bytes", "process.pid", "policy",
        pii.alias("pii"), F.col(S.CORRUPT).isNotNull().alias("corrupt"),
    )


@query("s2_read_raw", ctes("net", "handshakes", "payloads", "file_access", "file_data") + """ SELECT 'network' AS kind, event_type::BIGINT AS code, count(*) AS n, sum(bytes)::BIGINT AS amount FROM net GROUP BY 2
 UNION ALL SELECT 'tls_handshake', 0, count(*), sum(length(sni))::BIGINT FROM handshakes UNION ALL SELECT 'tls_data', direction, count(*), sum(octet_length(encode(payload_text)))::BIGINT FROM payloads GROUP BY 2
 UNION ALL SELECT 'file_access', flags, count(*), sum(length(path))::BIGINT FROM file_access GROUP BY 2 UNION ALL SELECT 'file_data', direction, count(*), sum(octet_length(encode(text)))::BIGINT FROM file_data GROUP BY 2""")
def s2(spark, d):
    """Records of all five kinds written with their schemas and read back."""
    made = {
        "network": (bound(spark, d, "net"), "event_type", F.col("bytes")),
        "tls_handshake": (bound(spark, d, "handshakes"), None, F.length("sni")),
        "tls_data": (payload_rows(spark, d), "direction", F.octet_length("payload")),
        "file_access": (bound(spark, d, "file_access"), "flags", F.length("path")),
        "file_data": (bound(spark, d, "file_data").withColumn("payload", F.col("text").cast("binary")), "direction", F.octet_length("payload")),
    }
    parts = []
    for kind, (rows, code, amount) in made.items():
        path = _scratch(spark, f"raw-{kind}")
        fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.RAW[kind].fields]
        rows.select(*fields).write.parquet(path)
        number = F.col(code).cast("bigint") if code else F.lit(0).cast("bigint")
        read = S.read_raw(spark, kind, path).groupBy(number.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast("bigint").alias("amount"))
        parts.append(read.select(F.lit(kind).alias("kind"), "code", "n", "amount"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("s3_route_by_kind", ctes("ev") + """ SELECT CASE WHEN k % 11 = 6 THEN 'tls_handshake' WHEN k % 11 IN (7, 8) THEN 'tls_data' WHEN k % 11 = 9 THEN 'file_access' WHEN k % 11 = 10 THEN 'file_data' ELSE 'network' END AS kind, count(*) AS n FROM ev GROUP BY 1""")
def s3(spark, d):
    mixed = bound(spark, d, "ev").select((F.col("k") % 11).alias("event_type"))
    parts = [df.select(F.lit(kind).alias("kind")) for kind, df in S.route_by_kind(mixed).items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_LINE = "'{\"event_id\":' || event_id || ',\"pid\":' || user_id || CASE WHEN k % 2 = 0 THEN ',\"note\":\"n' || k || '\"' ELSE '' END || '}'"


@query("s4_write_ndjson", ctes("ev") + f" SELECT {_LINE} AS value FROM ev")
def s4(spark, d):
    path = _scratch(spark, "ndjson")
    sinks.write_ndjson(_notes(spark, d), path)
    return spark.read.text(path)


def _notes(spark, d):
    note = F.when(F.col("k") % 2 == 0, F.concat(F.lit("n"), F.col("k").cast("string")))
    return bound(spark, d, "ev").select("event_id", F.col("user_id").alias("pid"), note.alias("note"))


@query("s6_syslog_lines", ctes("ev") + f" SELECT '<14>1 - palisade - - - - ' || {_LINE} AS message FROM ev")
def s6(spark, d):
    return sinks.syslog_lines(_notes(spark, d), "palisade")


@query("s8_upsert_identities", ctes("flat") + """ SELECT pid AS identity_id, CASE WHEN pid % 3 = 0 THEN count(*) ELSE max(us) END AS last_seen FROM flat WHERE pid % 5 > 0 GROUP BY pid""")
def s8(spark, d):
    """Save, save over a third of the keys, remove a fifth, load."""
    path = _scratch(spark, "store")
    f = bound(spark, d, "flat").groupBy(F.col("pid").alias("identity_id")).agg(F.max("us").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    keyed.upsert_identities(f.select("identity_id", "last_seen"), path)
    keyed.upsert_identities(f.filter("identity_id % 3 = 0").select("identity_id", F.col("n").alias("last_seen")), path)
    keyed.remove(f.filter("identity_id % 5 = 0"), f"{path}/identities", ["identity_id"])
    return keyed.load(spark, f"{path}/identities")


@query("s9_upsert_vectors", """SELECT vec_id AS identity_id, len(embedding)::INT AS dim, round(CASE WHEN vec_id % 2 = 0 THEN embedding[1] ELSE embedding[2] END::DOUBLE, 6) AS x FROM embeddings""")
def s9(spark, d):
    path = _scratch(spark, "vectors")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("identity_id"), "embedding", F.get("embedding", F.lit(0)).alias("x"))
    keyed.upsert_vectors(v, path)
    keyed.upsert_vectors(v.filter("identity_id % 2 = 1").withColumn("x", F.get("embedding", F.lit(1))), path)
    out = keyed.load(spark, f"{path}/vectors")
    return out.select("identity_id", F.size("embedding").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("s5_write_webhook", "SELECT ceil(count(*) / 10)::BIGINT AS posts, count(*) AS lines, 10::BIGINT AS largest FROM events")
def s5(spark, d):
    """Posts and lines that the sender saw, counted on the executors."""
    sc = spark.sparkContext
    posts, sent, over = sc.accumulator(0), sc.accumulator(0), sc.accumulator(0)

    def send(lines):
        posts.add(1)
        sent.add(len(lines))
        over.add(len(lines) > sinks.WEBHOOK_BATCH)

    sinks.write_webhook(_notes(spark, d).coalesce(1), send)
    largest = sinks.WEBHOOK_BATCH if not over.value else -1
    return spark.createDataFrame([(posts.value, sent.value, largest)], "posts bigint, lines bigint, largest bigint")


@query("s7_fan_out", ctes("ev") + f" SELECT target, {_LINE} AS value FROM ev, (SELECT unnest(['a', 'b']) AS target)")
def s7(spark, d):
    """One batch to two files, read back from both."""
    paths = {name: _scratch(spark, f"fan-{name}") for name in ("a", "b")}
    sinks.fan_out(_notes(spark, d), [f"file:{p}" for p in paths.values()])
    parts = [spark.read.text(p).select(F.lit(name).alias("target"), "value") for name, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("r7_policy_job", ctes("flat") + """ SELECT event_id, CASE WHEN pii_detected THEN 'deny' WHEN provider IS NOT NULL THEN CASE WHEN event_id % 4 < 2 THEN 'audit' ELSE 'deny' END ELSE 'allow' END AS decision FROM flat""")
def r7(spark, d):
    """Rules are read again for every micro-batch: from the third on, providers are denied."""
    from palisade.operators import policy as R
    from palisade.streaming import flows

    folder, calls = _scratch(spark, "policy"), []
    stream = replayed(spark, agentic(spark, d), F.pmod("event_id", F.lit(4)), folder)

    def load(session):
        calls.append(1)
        named = "audit" if len(calls) <= 2 else "deny"
        return (lambda df: df), [R.rule("pii", "deny", "action.pii_detected"), R.rule("provider", named, "action.provider IS NOT NULL")]

    def write(df, batch_id):
        df.select("event_id", "decision").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    flows.each_batch(stream, flows.policy_job(load, write), f"{folder}/log", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "decision")


@query("m5_retrain_job", ctes("ev") + """, b AS (SELECT event_id % 4 AS part, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT part, sum(n) OVER (ORDER BY part) AS total, sum(n) OVER (ORDER BY part) - n AS before FROM b),
 seen AS (SELECT c.total::BIGINT AS total, ev.event_id, ev.us FROM c JOIN ev ON ev.event_id % 4 <= c.part WHERE c.total // 100 > c.before // 100),
 kept AS (SELECT total, us FROM seen QUALIFY row_number() OVER (PARTITION BY total ORDER BY us DESC) <= 150)
SELECT total, count(*) AS rows, min(us) AS oldest FROM kept GROUP BY 1""")
def m5(spark, d):
    """Samples, rows and oldest row of every refit on the newest 150."""
    from palisade.streaming import flows

    folder = _scratch(spark, "retrain")
    samples = bound(spark, d, "ev").select("event_id", F.col("us").alias("ts"), F.col("event_type").alias("label"), F.array("value").alias("features"))
    stream = replayed(spark, samples, F.pmod("event_id", F.lit(4)), folder)

    def train(rows, total):
        fit = rows.agg(F.lit(total).cast("bigint").alias("total"), F.count(F.lit(1)).alias("rows"), F.min("ts").alias("oldest"))
        fit.write.mode("overwrite").parquet(f"{folder}/fits/{total}")

    flows.each_batch(stream, flows.retrain_job(f"{folder}/store", train, every=100, keep=150), f"{folder}/log", availableNow=True).awaitTermination()
    return spark.read.parquet(f"{folder}/fits/*")
