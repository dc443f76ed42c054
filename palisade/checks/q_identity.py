"""Queries on identities, timelines and the agent graph."""

from pyspark.sql import functions as F

from palisade.checks.bindings import agentic, bound, ctes
from palisade.checks.q_events import ACTIONS, TAG
from palisade.checks.registry import query
from palisade.checks.sqlfn import fnv32, fnv64, fnv64_list, le_unsigned, text_bytes
from palisade.operators import graph as G
from palisade.operators import identity as I
from palisade.operators import normalize as P

LABEL_SQL = """CASE WHEN sdk IS NOT NULL AND model IS NOT NULL THEN sdk || ' (' || model || ')' WHEN sdk IS NOT NULL THEN sdk
  WHEN model IS NOT NULL AND provider IS NOT NULL THEN provider || ' ' || model WHEN provider IS NOT NULL THEN provider ELSE 'pid:' || pid END"""
_cid = f"CASE WHEN container_id = '' THEN 0 ELSE {fnv32('container_id')} END"
KEYS = f"""keys AS (SELECT event_id, us, pid, {_cid} AS container_hash, cgroup_id, coalesce(fingerprint, 0) AS sig, coalesce(sdk_hash, 0) AS sdk,
  coalesce(model_hash, 0) AS model, {TAG} AS tag FROM flat)"""
# a fixed grouping stands in for resolved identities where the operator only needs ids
ACT = f"{ACTIONS}, act AS (SELECT *, pid % 23 AS identity_id, us AS ts FROM actions)"
NEWEST = "tl AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY ts DESC, event_id DESC) AS pos FROM act QUALIFY pos <= 256)"
TIMELINE = "tl AS (SELECT *, row_number() OVER (PARTITION BY identity_id ORDER BY ts DESC, event_id DESC) AS pos FROM act)"


def _actions(spark, d):
    a = I.identity_actions(agentic(spark, d))
    return a.withColumn("identity_id", F.col("pid") % 23)


@query("i1_identity_keys", ctes("flat") + f", {KEYS} SELECT * EXCLUDE (us, tag) FROM keys")
def i1(spark, d):
    return I.identity_keys(agentic(spark, d)).select("event_id", *I.INSTANCE, *I.TYPE)


@query("i2_identity_ids", ctes("flat") + f""", {KEYS} SELECT event_id, CASE WHEN sig <> 0 OR sdk <> 0 OR model <> 0 THEN {fnv64_list("list_concat(" + le_unsigned("sig", 8) + ", " + le_unsigned("sdk", 4) + ", " + le_unsigned("model", 4) + ")")}
 ELSE {fnv64_list("list_concat(" + le_unsigned("pid", 4) + ", " + le_unsigned("cgroup_id", 8) + ", " + le_unsigned("container_hash", 4) + ")")} END AS identity_id FROM keys""")
def i2(spark, d):
    return I.identity_ids(I.identity_keys(agentic(spark, d))).select("event_id", "identity_id")


@query("i3_identity_labels", ctes("flat") + f" SELECT event_id, {LABEL_SQL} AS identity_label FROM flat")
def i3(spark, d):
    return I.identity_labels(agentic(spark, d)).select("event_id", "identity_label")


@query("i4_resolve_identities")
def i4(spark, d):
    """Event-by-event fold in the reference; tested against a brute-force fold."""
    r = I.resolve_identities(P.to_identity_actions(agentic(spark, d)))
    return r.select(*I.INSTANCE, "identity_id", "level", "confidence")


NEWS = """news AS (SELECT event_id AS new_id, fingerprint AS sig, sdk_hash AS sdk, model_hash AS model, CASE WHEN k % 3 = 0 THEN k % 5 END AS prompt, CASE WHEN k % 2 = 0 THEN k % 7 END AS digest, provider FROM flat WHERE type = 'Prompt'),
 idn AS (SELECT pid AS identity_id, min(us) AS first_seen, max(CASE WHEN k % 3 > 0 THEN fingerprint ELSE 0 END) AS sig, max(CASE WHEN k % 2 > 0 THEN sdk_hash ELSE 0 END) AS sdk, max(CASE WHEN k % 5 > 2 THEN model_hash ELSE 0 END) AS model, max(k % 5) AS prompt,
   max(k % 7) AS digest, list(DISTINCT provider) FILTER (WHERE provider IS NOT NULL AND k % 9 = 0) AS providers FROM flat WHERE type = 'Prompt' GROUP BY 1),
 pairs AS (SELECT new_id, identity_id, first_seen, CASE WHEN coalesce(n.sig, 0) <> 0 AND i.sig <> 0 THEN 0.4 ELSE 0 END AS ws, CASE WHEN coalesce(n.sdk, 0) <> 0 AND i.sdk <> 0 THEN 0.3 ELSE 0 END AS wk, CASE WHEN coalesce(n.model, 0) <> 0 AND i.model <> 0 THEN 0.3 ELSE 0 END AS wm,
   n.sig = i.sig AS es, n.sdk = i.sdk AS ek, n.model = i.model AS em, coalesce(n.prompt = i.prompt, FALSE) AS ep, coalesce(n.digest = i.digest, FALSE) AS eb, coalesce(list_contains(i.providers, n.provider), FALSE) AS en FROM news n, idn i),
 sc AS (SELECT new_id, identity_id, first_seen, round((CASE WHEN ep THEN 0.15 ELSE 0 END + 0.40 * CASE WHEN ws + wk + wm > 0 THEN (CASE WHEN ws > 0 AND es THEN 0.4 ELSE 0 END + CASE WHEN wk > 0 AND ek THEN 0.3 ELSE 0 END + CASE WHEN wm > 0 AND em THEN 0.3 ELSE 0 END)::DOUBLE / (ws + wk + wm)::DOUBLE ELSE 0 END
   + CASE WHEN eb THEN 0.25 ELSE 0 END + CASE WHEN en THEN 0.20 ELSE 0 END)::DOUBLE, 9) AS score FROM pairs)"""


def _candidates(spark, d):
    f = bound(spark, d, "flat").filter("type = 'Prompt'")
    new = f.selectExpr(
        "event_id AS new_id", "fingerprint AS sig", "sdk_hash AS sdk", "model_hash AS model", "CASE WHEN k % 3 = 0 THEN k % 5 END AS prompt",
        "CASE WHEN k % 2 = 0 THEN k % 7 END AS digest", "provider",
    )
    known = f.groupBy(F.col("pid").alias("identity_id")).agg(
        F.min("us").alias("first_seen"), F.expr("max(CASE WHEN k % 3 > 0 THEN fingerprint ELSE 0 END)").alias("sig"),
        F.expr("max(CASE WHEN k % 2 > 0 THEN sdk_hash ELSE 0 END)").alias("sdk"), F.expr("max(CASE WHEN k % 5 > 2 THEN model_hash ELSE 0 END)").alias("model"),
        F.expr("max(k % 5)").alias("prompt"), F.expr("max(k % 7)").alias("digest"), F.expr("collect_set(CASE WHEN k % 9 = 0 THEN provider END)").alias("providers"),
    )
    return new, known


@query("i5_score_candidates", ctes("flat") + f", {NEWS} SELECT new_id, identity_id, score FROM sc WHERE score >= 0.6")
def i5(spark, d):
    """Every pair that reaches the threshold."""
    return I.score_candidates(*_candidates(spark, d)).drop("first_seen")


@query("i6_best_composite_match", ctes("flat") + f""", {NEWS}, b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, first_seen, identity_id) AS r FROM sc WHERE score >= 0.6)
SELECT new_id, identity_id, score, CASE WHEN score >= 0.85 THEN 'SemanticMatch' ELSE 'CompositeMatch' END AS level FROM b WHERE r = 1""")
def i6(spark, d):
    return I.best_composite_match(I.pattern_candidates(*_candidates(spark, d)))


@query("w13_identity_timeline", ctes("flat") + f", {ACT}, {NEWEST} SELECT identity_id, pos, event_id, label FROM tl")
def w13(spark, d):
    return I.identity_timeline(_actions(spark, d)).select("identity_id", "pos", "event_id", "label")


SUMMARY = "sm AS (SELECT identity_id, string_agg(label || ' x' || n, ', ' ORDER BY n DESC, label) AS summary, sum(n)::BIGINT AS timeline_len FROM (SELECT identity_id, label, count(*) AS n FROM tl GROUP BY 1, 2) GROUP BY 1)"


@query("a13_timeline_summary", ctes("flat") + f", {ACT}, {TIMELINE}, {SUMMARY} SELECT * FROM sm")
def a13(spark, d):
    return I.timeline_summary(_actions(spark, d))


@query("a14_identity_rollup", ctes("flat") + f""", {ACT} SELECT identity_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS event_count, count(DISTINCT (pid, container_id, cgroup_id)) AS instances,
  array_to_string(list_sort(list(DISTINCT {TAG}) FILTER (WHERE provider IS NOT NULL)), ',') AS providers FROM act GROUP BY 1""")
def a14(spark, d):
    return I.identity_rollup(_actions(spark, d)).withColumn("providers", F.array_join("providers", ","))


_pl = lambda n: f"CASE WHEN {n} = 1 THEN '' ELSE 's' END"
NARR = f"""lb AS (SELECT identity_id, arg_min({LABEL_SQL}, (ts, event_id)) AS identity_label FROM act GROUP BY 1),
 fx AS (SELECT identity_id, count(*) AS n, count(*) FILTER (WHERE label = 'LlmCall') AS calls, count(*) FILTER (WHERE label = 'McpCall') AS tools, count(*) FILTER (WHERE label = 'PiiDetected') AS pii,
   count(*) FILTER (WHERE label = 'LlmStreamRecv' OR (label = 'LlmCall' AND streaming)) AS streams, arg_max(action_provider, (ts, event_id)) FILTER (WHERE label IN ('LlmCall', 'LlmStreamRecv', 'Connect') AND action_provider <> 'Other') AS prim FROM tl GROUP BY 1),
 pt AS (SELECT *, list_filter([CASE WHEN calls > 0 THEN calls || ' ' || coalesce(prim, 'Other') || ' call' || {_pl("calls")} || CASE WHEN streams > 0 THEN ' (' || streams || ' streaming)' ELSE '' END END,
   CASE WHEN tools > 0 THEN tools || ' MCP tool' || {_pl("tools")} END, CASE WHEN pii > 0 THEN pii || ' PII event' || {_pl("pii")} END], lambda x: x IS NOT NULL) AS parts FROM lb JOIN fx USING (identity_id)),
 nr AS (SELECT identity_id, CASE WHEN len(parts) = 0 THEN identity_label || ': ' || n || ' event' || {_pl("n")} ELSE identity_label || ' agent: ' || array_to_string(parts, ', ') END AS narrative FROM pt)"""


@query("a15_narratives", ctes("flat") + f", {ACT}, {TIMELINE}, {NARR} SELECT * FROM nr")
def a15(spark, d):
    a = _actions(spark, d)
    return I.narratives(a, I.founder_labels(a))


@query("w14_behavioral_digest", ctes("flat") + f""", {ACT}, {TIMELINE}, nx AS (SELECT identity_id, label AS a, lead(label) OVER (PARTITION BY identity_id ORDER BY pos DESC) AS b FROM tl),
 ct AS (SELECT identity_id, a, b, count(*) AS n FROM nx WHERE b IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY identity_id ORDER BY n DESC, a, b) <= 8),
 byt AS (SELECT identity_id, flatten(list(list_concat({text_bytes("(a || '|' || b || ':')")}, {le_unsigned("n", 4)}, [10::HUGEINT]) ORDER BY n DESC, a, b)) AS raw FROM ct GROUP BY 1)
SELECT identity_id, {fnv64_list("raw")} AS behavioral_digest FROM byt""")
def w14(spark, d):
    return I.behavioral_digest(_actions(spark, d))


@query("w15_digest_refresh_points", ctes("flat") + f", {ACT} SELECT identity_id, event_id, row_number() OVER (PARTITION BY identity_id ORDER BY ts, event_id) AS event_count FROM act QUALIFY event_count >= 4 AND event_count % 10 = 0")
def w15(spark, d):
    return I.digest_refresh_points(_actions(spark, d)).select("identity_id", "event_id", "event_count")


@query("i7_attach_identity", ctes("flat") + f""", {ACT}, {TIMELINE}, {SUMMARY}, {NARR}
SELECT f.event_id, a.identity_id AS id, CASE WHEN a.event_id IS NOT NULL THEN 'ExactInstance' END AS match_type, narrative, summary AS timeline, sm.timeline_len::INT AS timeline_len FROM flat f LEFT JOIN act a USING (event_id) LEFT JOIN nr ON nr.identity_id = a.identity_id LEFT JOIN sm ON sm.identity_id = a.identity_id""")
def i7(spark, d):
    e, a = agentic(spark, d), _actions(spark, d)
    facts = I.narratives(a, I.founder_labels(a)).join(I.timeline_summary(a), "identity_id")
    matches = a.select("event_id", "identity_id", *I.INSTANCE, F.lit("ExactInstance").alias("match_type"), F.lit(1.0).alias("match_confidence"))
    out = I.attach_identity(e, matches, facts)
    return out.select("event_id", *[F.col(f"identity.{c}").alias(c) for c in ("id", "match_type", "narrative", "timeline", "timeline_len")])


@query("i8_prompt_fingerprints", ctes("flat") + f" SELECT event_id, {fnv64('system_prompt')} AS prompt_fingerprint FROM flat WHERE system_prompt IS NOT NULL")
def i8(spark, d):
    p = I.prompt_fingerprints(bound(spark, d, "flat")).filter("system_prompt IS NOT NULL")
    return p.select("event_id", "prompt_fingerprint")


@query("i8_latest_prompt_fingerprint", ctes("flat") + f", l AS (SELECT pid % 23 AS identity_id, arg_max(system_prompt, (us, event_id)) FILTER (WHERE system_prompt IS NOT NULL) AS p FROM flat WHERE system_prompt IS NOT NULL GROUP BY 1) SELECT identity_id, {fnv64('p')} AS prompt_fingerprint FROM l")
def i8_latest(spark, d):
    rows = bound(spark, d, "flat").withColumn("identity_id", F.col("pid") % 23).withColumn("ts", F.col("us"))
    return I.latest_prompt_fingerprint(rows)


@query("i9_evict_identities", ctes("flat") + " SELECT pid AS identity_id, max(us) AS last_seen FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def i9(spark, d):
    f = bound(spark, d, "flat").groupBy(F.col("pid").alias("identity_id")).agg(F.max("us").alias("last_seen"))
    return I.evict_identities(f, 50)


# ------------------------------------------------------------------ graph

GACT = "ga AS (SELECT event_id, pid % 23 AS identity_id, container_id, type, floor(us / 20000)::BIGINT AS ts_ms, " + LABEL_SQL + " AS identity_label FROM flat)"
RELAY = """rl AS (SELECT arg_min(o.identity_id, (o.ts_ms, o.event_id)) AS from_id, i.identity_id AS to_id, 'HttpRelay' AS type, i.ts_ms, i.event_id FROM ga i JOIN ga o
  ON i.container_id = o.container_id AND i.container_id <> '' AND o.identity_id <> i.identity_id AND o.ts_ms > i.ts_ms - 5000 AND (o.ts_ms, o.event_id) < (i.ts_ms, i.event_id)
  WHERE i.type IN ('Response', 'ToolCall', 'McpResponse') AND o.type IN ('Prompt', 'ToolResult', 'McpRequest') GROUP BY i.identity_id, i.ts_ms, i.event_id)"""
NODES = "nd AS (SELECT identity_id, arg_min(identity_label, (ts_ms, event_id)) AS label, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen FROM ga WHERE identity_id % 5 > 0 GROUP BY 1)"
EDGES = "eg AS (SELECT from_id, to_id, type, count(*) AS count, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen FROM rl WHERE from_id IN (SELECT identity_id FROM nd) AND to_id IN (SELECT identity_id FROM nd) GROUP BY 1, 2, 3)"


def _graph_actions(spark, d):
    f = I.identity_labels(agentic(spark, d))
    return f.select(
        "event_id", (F.col("process.pid") % 23).alias("identity_id"), F.col("process.container_id").alias("container_id"), F.col("action.type").alias("type"),
        F.floor(F.unix_micros("timestamp") / 20000).cast("bigint").alias("ts_ms"), "identity_label",
    )


@query("g1_relay_edges", ctes("flat") + f", {GACT}, {RELAY} SELECT * FROM rl")
def g1(spark, d):
    return G.relay_edges(_graph_actions(spark, d))


def _graph(spark, d):
    a = _graph_actions(spark, d)
    nodes = G.agent_nodes(a.filter("identity_id % 5 > 0"))
    return nodes, G.agent_edges(G.relay_edges(a), nodes)


@query("g2_agent_edges", ctes("flat") + f", {GACT}, {RELAY}, {NODES}, {EDGES} SELECT * FROM eg")
def g2(spark, d):
    return _graph(spark, d)[1]


@query("g3_agent_nodes", ctes("flat") + f", {GACT}, {NODES} SELECT * FROM nd")
def g3(spark, d):
    return _graph(spark, d)[0]


@query("g4_graph_stats", ctes("flat") + f", {GACT}, {RELAY}, {NODES}, {EDGES} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM eg) AS edges")
def g4(spark, d):
    return G.graph_stats(*_graph(spark, d))


@query("g4_out_edges", ctes("flat") + f", {GACT}, {RELAY}, {NODES}, {EDGES} SELECT from_id, to_id, count FROM eg WHERE from_id < 5")
def g4_out(spark, d):
    nodes, edges = _graph(spark, d)
    return G.out_edges(edges, nodes.filter("identity_id < 5")).select("from_id", "to_id", "count")


@query("g4_remove_nodes", ctes("flat") + f", {GACT}, {RELAY}, {NODES}, {EDGES} SELECT from_id, to_id, type FROM eg WHERE from_id >= 5 AND to_id >= 5")
def g4_remove(spark, d):
    nodes, edges = _graph(spark, d)
    return G.remove_nodes(edges, nodes.filter("identity_id < 5")).select("from_id", "to_id", "type")
