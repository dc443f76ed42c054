"""Queries on behaviour windows and connection sessions."""

from pyspark.sql import functions as F

from palisade import rules
from palisade.checks.bindings import BY_NAME, bound, ctes, replayed
from palisade.checks.q_events import ASOF, SYMBOL
from palisade.checks.registry import query
from palisade.checks.sqlfn import CLASS, case_contains, fnv64_list, le_bytes
from palisade.operators import aggregates as A
from palisade.operators import h2
from palisade.operators import sessions as T
from palisade.operators import windows as W
from palisade.plans.stage import scratch_path
from palisade.streaming import flows

KEY = ["pid", "window_end"]
WIN = ctes("net") + f""", sq AS (SELECT *, {SYMBOL} AS sym, row_number() OVER (PARTITION BY pid ORDER BY timestamp_ns, event_id) AS seq FROM net),
ends AS (SELECT pid, seq AS window_end FROM sq WHERE seq >= 20 AND seq % 10 = 0),
we AS (SELECT e.*, w.window_end, least(w.window_end, 50) AS n FROM ends w JOIN sq e ON e.pid = w.pid AND e.seq BETWEEN w.window_end - 49 AND w.window_end),
wl AS (SELECT *, lag(sym) OVER x AS p1, lag(sym, 2) OVER x AS p2, timestamp_ns - lag(timestamp_ns) OVER x AS gap FROM we WINDOW x AS (PARTITION BY pid, window_end ORDER BY seq))"""


def _bin(code, bins):
    return (
        f"(list_reduce(list_transform({le_bytes(code, 8)}, lambda z: z::HUGEINT), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) "
        f"% 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) % {bins})::INT"
    )


BI = f""", big AS (SELECT pid, window_end, n, {_bin("(p1 * 181 + sym)::BIGINT", 100)} AS bin FROM wl WHERE p1 IS NOT NULL),
 bic AS (SELECT pid, window_end, n, bin, count(*) AS c FROM big GROUP BY ALL),
 unic AS (SELECT pid, window_end, n, sym, count(*) AS c FROM we GROUP BY ALL),
 tric AS (SELECT pid, window_end, n, {_bin("(p2 * 32761 + p1 * 181 + sym)::BIGINT", 50)} AS bin, count(*) AS c FROM wl WHERE p2 IS NOT NULL GROUP BY ALL)"""


def _windows(spark, d):
    return W.symbol_windows(bound(spark, d, "net"))


def _rounded(df, cols, keep=KEY):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in cols])


@query("w1_symbol_windows", WIN + " SELECT pid, window_end, count(*)::INT AS n, string_agg(sym::VARCHAR, ',' ORDER BY seq) AS symbols FROM we GROUP BY 1, 2")
def w1(spark, d):
    return _windows(spark, d).select(*KEY, "n", F.array_join(F.transform("ev", lambda e: e["symbol"].cast("string")), ",").alias("symbols"))


@query("w2_unigram_features", WIN + BI + " SELECT pid, window_end, sym AS symbol, round(c / n, 6) AS weight FROM unic")
def w2(spark, d):
    return _rounded(W.unigram_features(_windows(spark, d)), ["weight"], [*KEY, "symbol"])


@query("w3_bigram_features", WIN + BI + " SELECT pid, window_end, bin, round(c / (n - 1), 6) AS weight FROM bic")
def w3(spark, d):
    return _rounded(W.bigram_features(_windows(spark, d)), ["weight"], [*KEY, "bin"])


@query("w4_trigram_features", WIN + BI + " SELECT pid, window_end, bin, round(c / (n - 2), 6) AS weight FROM tric")
def w4(spark, d):
    return _rounded(W.trigram_features(_windows(spark, d)), ["weight"], [*KEY, "bin"])


TIMING = """SELECT pid, window_end, round(avg(gap) / 1e6, 6) AS gap_mean, round(stddev_pop(gap) / 1e6, 6) AS gap_std, round(min(gap) / 1e6, 6) AS gap_min,
  round(max(gap) / 1e6, 6) AS gap_max, round(list_sort(list(gap))[1 + floor(0.5 * (count(gap) - 1))::INT] / 1e6, 6) AS gap_p50,
  round(list_sort(list(gap))[1 + floor(0.9 * (count(gap) - 1))::INT] / 1e6, 6) AS gap_p90 FROM wl WHERE gap IS NOT NULL GROUP BY 1, 2"""


@query("w5_timing_features", WIN + " " + TIMING)
def w5(spark, d):
    return _rounded(W.timing_features(_windows(spark, d)), W.SCALARS[:6])


BYTES = """SELECT pid, window_end, round(CASE WHEN r > 0 THEN s / r WHEN s > 0 THEN 10.0 ELSE 0.0 END, 6) AS send_recv_ratio,
  round(CASE WHEN ns > 0 THEN s / ns / 1024 ELSE 0 END, 6) AS send_kb, round(CASE WHEN nr > 0 THEN r / nr / 1024 ELSE 0 END, 6) AS recv_kb,
  round((n * sq - tb * tb)::DOUBLE / (n * n) / 1e6, 6) AS byte_var, round(z / n, 6) AS zero_fraction, round((s + r) / 1024, 6) AS total_kb
  FROM (SELECT pid, window_end, max(n) AS n, coalesce(sum(bytes) FILTER (WHERE event_type = 2), 0)::DOUBLE AS s, coalesce(sum(bytes) FILTER (WHERE event_type = 3), 0)::DOUBLE AS r,
  count(*) FILTER (WHERE event_type = 2) AS ns, count(*) FILTER (WHERE event_type = 3) AS nr, sum(bytes * bytes)::BIGINT AS sq, sum(bytes)::BIGINT AS tb, count(*) FILTER (WHERE bytes = 0) AS z FROM we GROUP BY 1, 2)"""


@query("w6_byte_features", WIN + " " + BYTES)
def w6(spark, d):
    return _rounded(W.byte_features(_windows(spark, d)), W.SCALARS[6:12])


CONNS = """SELECT pid, window_end, round(count(DISTINCT daddr) / max(n), 6) AS ip_diversity, round(count(DISTINCT dport) / max(n), 6) AS port_diversity,
  count(DISTINCT daddr)::DOUBLE AS unique_ips, round(max(n) / count(DISTINCT daddr), 6) AS reuse FROM we GROUP BY 1, 2"""


@query("w7_connection_features", WIN + " " + CONNS)
def w7(spark, d):
    return _rounded(W.connection_features(_windows(spark, d)), W.SCALARS[12:16])


BURSTS = """, isl AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 500000000 THEN 1 ELSE 0 END) OVER (PARTITION BY pid, window_end ORDER BY seq) AS island FROM wl),
 runs AS (SELECT pid, window_end, island, count(*) AS len, sum(bytes) AS b FROM isl GROUP BY 1, 2, 3),
 br AS (SELECT pid, window_end, count(*) FILTER (WHERE len > 1) AS k, coalesce(sum(len) FILTER (WHERE len > 1), 0) AS l, coalesce(sum(b) FILTER (WHERE len > 1), 0) AS bb, sum(b) AS t FROM runs GROUP BY 1, 2),
 mg AS (SELECT pid, window_end, max(gap) AS g FROM wl GROUP BY 1, 2)"""
BURST_OUT = """SELECT pid, window_end, k::DOUBLE AS bursts, round(CASE WHEN k > 0 THEN l / k ELSE 0 END::DOUBLE, 6) AS burst_len, round(g / 1e9, 6) AS max_gap_s,
  round(CASE WHEN t > 0 THEN bb / t ELSE 0 END::DOUBLE, 6) AS burst_bytes FROM br JOIN mg USING (pid, window_end)"""


@query("w8_burst_features", WIN + BURSTS + " " + BURST_OUT)
def w8(spark, d):
    return _rounded(W.burst_features(_windows(spark, d)), W.SCALARS[16:20])


ENTROPY = """SELECT pid, window_end, round(se, 6) AS symbol_entropy, round(be, 6) AS bigram_entropy FROM
  (SELECT pid, window_end, -sum(c / n * log2(c / n)) AS se FROM unic GROUP BY 1, 2) JOIN
  (SELECT pid, window_end, -sum(c / (n - 1) * log2(c / (n - 1))) AS be FROM bic GROUP BY 1, 2) USING (pid, window_end)"""


@query("w9_entropy_features", WIN + BI + " " + ENTROPY)
def w9(spark, d):
    e = _rounded(W.entropy_features(_windows(spark, d)), W.SCALARS[20:])
    return e.select(*KEY, *[(F.col(c) + 0.0).alias(c) for c in W.SCALARS[20:]])


VECTOR = f""", fv AS (SELECT pid, window_end, sym AS i, c / n AS v FROM unic UNION ALL SELECT pid, window_end, 180 + bin, c / (n - 1) FROM bic UNION ALL SELECT pid, window_end, 280 + bin, c / (n - 2) FROM tric
  {' '.join(f"UNION ALL SELECT pid, window_end, {330 + i}, {c} FROM ({src})" for src, cols, at in ((TIMING, W.SCALARS[:6], 0), (BYTES, W.SCALARS[6:12], 6), (CONNS, W.SCALARS[12:16], 12), (BURST_OUT, W.SCALARS[16:20], 16), (ENTROPY, W.SCALARS[20:], 20)) for i, c in enumerate(cols, at))})
SELECT pid, window_end, i::INT AS i, round(v, 6) AS v FROM fv WHERE round(v, 6) <> 0"""


@query("w10_feature_vectors", WIN + BI + BURSTS + VECTOR)
def w10(spark, d):
    v = W.feature_vectors(_windows(spark, d))
    rows = v.select(*KEY, F.posexplode("features").alias("i", "v")).withColumn("v", F.round("v", 6))
    return rows.filter(F.col("v") != 0)


@query("w11_behavior_signature", WIN + BI + f""", grid AS (SELECT pid, window_end, unnest(range(100)) AS bin FROM ends),
 g AS (SELECT grid.pid, grid.window_end, grid.bin, coalesce(c, 0) AS c FROM grid LEFT JOIN bic USING (pid, window_end, bin)),
 t AS (SELECT pid, window_end, list(bin::HUGEINT ORDER BY c DESC, bin)[1:5] AS top FROM g GROUP BY 1, 2)
SELECT pid, window_end, {fnv64_list("top")} AS signature FROM t""")
def w11(spark, d):
    return W.behavior_signature(W.with_histograms(_windows(spark, d))).select(*KEY, "signature")


# ------------------------------------------------------------------ sessions

_CUT = "CAST(floor(length(payload_text) / 2) AS INT)"
CHUNKED = ctes("payloads").replace("payloads AS (", "payloads0 AS (") + f""", payloads1 AS (
  SELECT * EXCLUDE (payload_text, seq, timestamp_ns, part), turn * 2 + part AS seq, timestamp_ns + part * 1000 AS timestamp_ns,
    CASE part WHEN 0 THEN left(payload_text, {_CUT}) ELSE substr(payload_text, {_CUT} + 1) || CASE WHEN conv_id % 20 = 1 AND turn = 1 THEN repeat('x', 150000) ELSE '' END END AS payload_text
  FROM (SELECT *, unnest([0, 1]) AS part FROM payloads0)),
payloads AS (SELECT * FROM payloads1 UNION ALL BY NAME SELECT * EXCLUDE (i) REPLACE (i - 100 AS seq, timestamp_ns - (100 - i) * 1000 AS timestamp_ns, 'noise ' || i AS payload_text)
  FROM (SELECT *, unnest(range(12)) AS i FROM payloads1 WHERE conv_id % 5 = 0 AND turn = 0 AND seq = 0))"""


def chunk_rows(spark, d):
    """Every payload cut into two chunks; some connections open with a dozen dull ones, some
    chunks are longer than any buffer of a live probe."""
    rows = bound(spark, d, "payloads").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.length("payload_text") / 2).cast("int")
    long = F.when((F.col("conv_id") % 20 == 1) & (F.col("turn") == 1), F.lit("x" * 150_000)).otherwise("")
    piece = F.when(F.col("part") == 0, F.left("payload_text", half)).otherwise(F.concat(F.substr("payload_text", half + 1), long))
    cut = (
        rows.withColumn("payload", piece.cast("binary"))
        .withColumn("seq", F.col("turn") * 2 + F.col("part"))
        .withColumn("timestamp_ns", F.col("timestamp_ns") + F.col("part") * 1000)
        .drop("payload_text", "part")
    )
    dull = cut.filter("conv_id % 5 = 0 AND turn = 0 AND seq = 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    dull = dull.withColumn("seq", (F.col("_i") - 100).cast("bigint")).withColumn("timestamp_ns", F.col("timestamp_ns") - (100 - F.col("_i")) * 1000)
    return cut.unionByName(dull.withColumn("payload", F.concat(F.lit("noise "), F.col("_i").cast("string")).cast("binary")).drop("_i"))


SNI_HIT = case_contains("lower(sni)", rules.PROVIDER_HOSTS)
VERDICT = CHUNKED + CLASS + f""", num AS (SELECT *, row_number() OVER (PARTITION BY pid, ssl_ptr ORDER BY timestamp_ns, seq) AS cn FROM done),
 ver AS (SELECT pid, ssl_ptr, min(cn) FILTER (WHERE is_interesting OR {SNI_HIT} IS NOT NULL) AS hit, count(*) AS chunks_seen FROM num GROUP BY 1, 2),
 verdicts AS (SELECT pid, ssl_ptr, CASE WHEN hit IS NOT NULL THEN 'interesting' WHEN chunks_seen >= 10 THEN 'boring' ELSE 'undecided' END AS verdict,
   coalesce(hit, CASE WHEN chunks_seen >= 10 THEN 10 END)::INT AS decided_at, chunks_seen FROM ver)"""
FOLLOW = """, fol AS (SELECT num.* FROM num JOIN verdicts v USING (pid, ssl_ptr) WHERE v.verdict = 'interesting' AND cn >= decided_at AND payload_text <> '')"""


@query("t1_connection_verdicts", VERDICT + " SELECT * FROM verdicts")
def t1(spark, d):
    return T.connection_verdicts(chunk_rows(spark, d)).drop("decided_by")


@query("a10_verdict_counters", VERDICT + " SELECT verdict, count(*) AS connections FROM verdicts GROUP BY 1")
def a10(spark, d):
    return A.verdict_counters(T.connection_verdicts(chunk_rows(spark, d)))


SEGMENT = 1 << 16


@query("t2_flow_buffers", VERDICT + FOLLOW + f""" SELECT pid, ssl_ptr, direction, string_agg(payload_text, '' ORDER BY timestamp_ns, seq) AS text,
  ceil(sum(octet_length(encode(payload_text))) / {SEGMENT})::BIGINT AS segments FROM fol GROUP BY 1, 2, 3""")
def t2(spark, d):
    c = chunk_rows(spark, d)
    f = T.flow_buffers(c, T.connection_verdicts(c), segment=SEGMENT)
    glued = F.expr("listagg(payload) WITHIN GROUP (ORDER BY segment)").cast("string").alias("text")
    return f.groupBy("pid", "ssl_ptr", "direction").agg(glued, F.count(F.lit(1)).alias("segments"))


TURNS = FOLLOW + """, lg AS (SELECT *, lag(direction) OVER (PARTITION BY pid, ssl_ptr ORDER BY timestamp_ns, seq) AS pd FROM fol),
 il AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> direction THEN 1 ELSE 0 END) OVER (PARTITION BY pid, ssl_ptr ORDER BY timestamp_ns, seq)::BIGINT AS turn_no FROM lg),
 tn AS (SELECT pid, ssl_ptr, turn_no, min(direction) AS direction, string_agg(payload_text, '' ORDER BY timestamp_ns, seq) AS text, count(*) AS chunks, max(timestamp_ns) AS ended_ns, min(seq) AS seq,
   turn_no < max(max(turn_no)) OVER (PARTITION BY pid, ssl_ptr) AS emitted FROM il GROUP BY 1, 2, 3)"""


@query("t3_turns", VERDICT + TURNS + " SELECT * FROM tn")
def t3(spark, d):
    c = chunk_rows(spark, d)
    t = T.whole_turns(T.turns(c, T.connection_verdicts(c), segment=SEGMENT))
    return t.select("pid", "ssl_ptr", "turn_no", "direction", F.col("payload").cast("string").alias("text"), "chunks", "ended_ns", "seq", "emitted")


@query("t4_flush_idle_turns", VERDICT + TURNS + " SELECT pid, ssl_ptr, turn_no, chunks FROM tn WHERE NOT emitted AND direction = 1 AND 20000000000000 - ended_ns > 15000000000000")
def t4(spark, d):
    c = chunk_rows(spark, d)
    t = T.turns(c, T.connection_verdicts(c))
    return T.flush_idle_turns(t, now_ns=20000 * 10**9, idle_ns=15000 * 10**9).select("pid", "ssl_ptr", "turn_no", "chunks")


@query("t5_sni_state", ctes("net", "handshakes") + f", {ASOF} SELECT event_id, pid, sni FROM asofs WHERE timestamp_ns <= ((SELECT max(timestamp_ns) FROM net) // 1000000 - 60000) * 1000000")
def t5(spark, d):
    """The streaming twin of the as-of server name, in several micro-batches: handshakes and
    events of a pid meet in state whichever comes first, and leave it with the watermark."""
    events = spark.read.parquet(f"{d}/events.parquet")
    folder = scratch_path(spark, "sni")
    # six files in time order, half of the rows up to 20 hours late (36 s of capture time)
    at = F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 2 == 0, F.pmod(F.xxhash64("event_id"), F.lit(20)) * 3_600_000_000).otherwise(0)
    first, last = events.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - F.lit(first)) * 6 / F.lit(max(1, (last or 0) - (first or 0) + 1)))
    stream = replayed(spark, events, part, folder, batches=6)
    net = BY_NAME["net"].build(BY_NAME["ev"].build(stream))
    named = flows.asof_sni(net, BY_NAME["handshakes"].build(net))
    run = named.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(named.schema).parquet(f"{folder}/rows")


@query("t6_expire_connections", CHUNKED + """, b AS (SELECT *, min(timestamp_ns) OVER (PARTITION BY pid, ssl_ptr) AS born FROM payloads)
SELECT pid, ssl_ptr, seq FROM b WHERE timestamp_ns - born < 3000000000""")
def t6(spark, d):
    return T.expire_connections(chunk_rows(spark, d), ttl_ns=3 * 10**9).select("pid", "ssl_ptr", "seq")


@query("t6_expire_windows", ctes("net") + """, g AS (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY pid ORDER BY timestamp_ns, event_id) AS gap FROM net)
SELECT event_id, pid, sum(CASE WHEN gap IS NULL OR gap >= 60000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY timestamp_ns, event_id)::BIGINT AS period FROM g""")
def t6w(spark, d):
    return T.expire_windows(bound(spark, d, "net"), idle_ns=60 * 10**9).select("event_id", "pid", "period")


@query("t7_first_chunks", CHUNKED + " SELECT pid, ssl_ptr, seq, row_number() OVER (PARTITION BY pid, ssl_ptr ORDER BY timestamp_ns, seq) = 1 AS is_first_chunk FROM payloads")
def t7(spark, d):
    return T.first_chunks(chunk_rows(spark, d)).select("pid", "ssl_ptr", "seq", "is_first_chunk")


@query("c19_reassemble_h2", """WITH f AS (SELECT conv_id AS pid, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS direction, turn, text FROM conversations)
SELECT pid, direction, string_agg(text, '' ORDER BY turn) AS body FROM f GROUP BY 1, 2""")
def c19(spark, d):
    """Texts framed as HTTP/2 (preface, HEADERS, padded DATA), cut into chunks, and read back."""
    c = bound(spark, d, "conv")
    text = F.col("text").cast("binary")
    size = F.octet_length("text")
    frame = lambda length, rest: F.concat(F.unhex(F.lpad(F.hex(length), 6, "0")), F.unhex(F.lit(rest)))
    data = F.concat(frame(size + 4, "000800000001"), F.unhex(F.lit("03")), text, F.unhex(F.lit("000000")))
    headers = F.concat(frame(F.lit(2), "010400000001"), F.unhex(F.lit("8286")))
    wire = F.concat(F.when((F.col("turn") == 0) & (F.col("direction") == 0), F.lit(rules.H2_PREFACE.encode())).otherwise(F.lit(b"")), headers, data)
    rows = c.select(F.col("conv_id").alias("pid"), F.lit(1).alias("ssl_ptr"), "direction", (F.col("turn") * 1000).alias("timestamp_ns"), F.col("turn").alias("seq"), wire.alias("payload"))
    flows_ = T.flow_buffers(rows, every_connection(rows), segment=500)
    bodies = h2.reassemble_h2(flows_).groupBy("pid", "direction").agg(F.expr("listagg(body) WITHIN GROUP (ORDER BY segment)").alias("body"))
    return bodies.select("pid", F.col("direction").alias("direction"), F.col("body").cast("string").alias("body"))


def every_connection(rows):
    """Verdicts that follow every connection from its start."""
    first = F.struct(F.lit(0).cast("bigint").alias("timestamp_ns"), F.lit(0).cast("bigint").alias("seq"))
    return rows.select("pid", "ssl_ptr").distinct().select("*", F.lit("interesting").alias("verdict"), first.alias("decided_by"))
