"""Queries on sources, projections, filters, enrichment and dashboards."""

from pyspark.sql import functions as F

from palisade import rules
from palisade.checks.bindings import agentic, bound, ctes
from palisade.checks.registry import query
from palisade.operators import aggregates as A
from palisade.operators import enrich as J
from palisade.operators import filters as Fl
from palisade.operators import normalize as P


def case_equals(expr, pairs):
    return "CASE " + " ".join(f"WHEN {expr} = '{a}' THEN '{b}'" for a, b in pairs) + " END"


def case_contains(expr, pairs):
    return "CASE " + " ".join(f"WHEN contains({expr}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


KIND = "CASE event_type WHEN 1 THEN 'Connect' WHEN 2 THEN 'DataSent' WHEN 3 THEN 'DataReceived' WHEN 4 THEN 'Close' WHEN 5 THEN 'DnsQuery' ELSE 'Connect' END"
REASON = case_contains("path", [(p, "path_pattern:" + p) for p in rules.AI_PATH_PATTERNS])
MODE = "CASE flags & 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'readwrite' ELSE 'unknown' END"
PII = "(type = 'PiiDetected' OR coalesce(pii_detected, FALSE))"
EVENT_TYPE = "CASE WHEN type = 'Network' THEN " + case_equals("kind", P.KIND_EVENT_TYPES.items()) + " ELSE " + case_equals("type", P.EVENT_TYPES.items()) + " END"
HUMAN = ("CASE WHEN {b} < 1024 THEN {b} || ' B' WHEN {b} < 1048576 THEN printf('%.1f', {b} / 1024.0::DOUBLE) || ' KB' "
         "ELSE printf('%.1f', {b} / 1048576.0::DOUBLE) || ' MB' END")
TAG = "CASE WHEN provider IS NOT NULL THEN coalesce(" + case_equals("lower(provider)", rules.PROVIDER_TAGS) + ", 'Other') END"
ATTR = f"""event_id, provider, model, sdk, system_prompt, user_message, sni, sdk_hash, model_hash, fingerprint, method AS mcp_method, category AS mcp_category,
  {PII} AS pii_detected, type AS action_type, coalesce(bytes, 0) AS bytes,
  {case_equals("type", P.CONTENT_CLASSES.items())} AS content_class, {EVENT_TYPE} AS event_type, path AS file_path"""

# ------------------------------------------------------------------ projections


@query("p1_normalize_network", ctes("net") + f"""
SELECT event_id, floor(timestamp_ns / 1000)::BIGINT AS us, pid || ':net' AS session_id, {KIND} AS kind, daddr AS dst_ip,
       dport AS dst_port, bytes, comm AS name, container_id FROM net""")
def p1(spark, d):
    e = P.normalize_network(bound(spark, d, "net"))
    return e.select(
        "event_id", F.unix_micros("timestamp").alias("us"), "session_id", "action.kind", "action.dst_ip", "action.dst_port",
        "action.bytes", "process.name", "process.container_id",
    )


@query("p2_normalize_file_access", ctes("file_access") + f"""
SELECT event_id, pid || ':file' AS session_id, path, {MODE} AS mode, {REASON} AS reason FROM file_access""")
def p2(spark, d):
    e = P.normalize_file_access(bound(spark, d, "file_access"))
    return e.select("event_id", "session_id", "action.path", "action.mode", "action.reason")


@query("p3_normalize_file_data", ctes("file_data") + """
SELECT event_id, CASE direction WHEN 0 THEN 'write' ELSE 'read' END AS direction, left(text, payload_len::INT) AS content,
       payload_len AS bytes, CASE WHEN payload_len > octet_length(encode(text)) THEN TRUE END AS truncated FROM file_data""")
def p3(spark, d):
    raw = bound(spark, d, "file_data").withColumn("payload", F.col("text").cast("binary"))
    return P.normalize_file_data(raw).select(
        "event_id", "action.direction", "action.content", "action.bytes", "action.truncated"
    )


@query("p4_normalize_tls_actions", ctes("ev") + """
SELECT event_id, user_id || ':' || lower(hex(user_id * 4096 + k)) AS session_id, 0 AS uid, '' AS container_id, 'tools/call' AS method FROM ev""")
def p4(spark, d):
    rows = bound(spark, d, "ev").select(
        "event_id", F.col("user_id").alias("pid"), F.lit("x").alias("comm"), (F.col("user_id") * 4096 + F.col("k")).alias("ssl_ptr"),
        F.col("us").alias("timestamp_ns"), P.action_of("McpRequest", method=F.lit("tools/call")).alias("action"),
    )
    e = P.normalize_tls_actions(rows)
    return e.select("event_id", "session_id", "process.uid", "process.container_id", "action.method")


@query("p5_with_event_time", ctes("net") + """
SELECT event_id, ((timestamp_ns + 1700000000000000000) // 1000)::BIGINT AS us,
       strftime(make_timestamp(((timestamp_ns + 1700000000000000000) // 1000)::BIGINT), '%H:%M:%S.%g') AS time_text FROM net""")
def p5(spark, d):
    raw = bound(spark, d, "net").withColumn("boot_epoch_ns", F.lit(1700000000000000000))
    return P.with_event_time(raw).select("event_id", F.unix_micros("timestamp").alias("us"), "time_text")


@query("p6_event_attributes", ctes("flat") + f"SELECT {ATTR} FROM flat")
def p6(spark, d):
    return P.event_attributes(agentic(spark, d))


LABEL = """CASE WHEN type = 'PiiDetected' THEN 'PiiDetected' WHEN type IN ('McpRequest', 'McpResponse') THEN 'McpCall'
  WHEN type IN ('Prompt', 'ToolCall') THEN 'LlmCall' WHEN type = 'Response' THEN 'LlmStreamRecv'
  WHEN type = 'Network' AND kind = 'Connect' AND provider IS NOT NULL THEN 'Connect'
  WHEN type = 'Network' AND kind = 'Close' AND provider IS NOT NULL THEN 'Disconnect' END"""
CATEGORY_TAG = "coalesce(" + case_equals("lower(category)", rules.MCP_CATEGORY_TAGS) + ", 'Other')"
ACTIONS = f"""actions AS (SELECT *, {LABEL} AS label,
  CASE WHEN {LABEL} IN ('LlmCall', 'LlmStreamRecv', 'Connect') THEN {TAG} END AS action_provider,
  type = 'Prompt' AND coalesce(stream, FALSE) AS streaming,
  CASE WHEN type = 'McpRequest' THEN {CATEGORY_TAG} WHEN type = 'McpResponse' THEN 'Other' END AS category_tag
  FROM flat WHERE {LABEL} IS NOT NULL)"""


@query("p7_to_identity_actions", ctes("flat") + f""", {ACTIONS}
SELECT event_id, label, action_provider, streaming, category_tag FROM actions""")
def p7(spark, d):
    return P.to_identity_actions(agentic(spark, d)).select("event_id", "label", "action_provider", "streaming", "category_tag")


@query("p8_normalize_provider_tag", ctes("flat") + f"SELECT event_id, {TAG} AS provider_tag FROM flat")
def p8(spark, d):
    return P.normalize_provider_tag(bound(spark, d, "flat")).select("event_id", "provider_tag")


@query("p9_normalize_mcp_category", ctes("flat") + f"SELECT event_id, {CATEGORY_TAG} AS category_tag FROM flat WHERE type = 'McpRequest'")
def p9(spark, d):
    rows = bound(spark, d, "flat").filter("type = 'McpRequest'")
    return P.normalize_mcp_category(rows).select("event_id", "category_tag")


SYMBOL = """(CASE WHEN event_type BETWEEN 1 AND 5 THEN event_type - 1 ELSE 5 END * 30
  + CASE WHEN bytes = 0 THEN 0 WHEN bytes < 128 THEN 1 WHEN bytes < 1024 THEN 2 WHEN bytes < 8192 THEN 3 WHEN bytes < 65536 THEN 4 ELSE 5 END * 5
  + CASE WHEN dport = 443 THEN 0 WHEN dport = 80 THEN 1 WHEN dport = 53 THEN 2 WHEN dport < 1024 THEN 3 ELSE 4 END)"""


@query("p10_symbolize", ctes("net") + f"SELECT event_id, {SYMBOL} AS symbol FROM net")
def p10(spark, d):
    return P.symbolize(bound(spark, d, "net")).select("event_id", "symbol")


@query("p11_redact_headers", ctes("ev") + """
SELECT event_id, CASE WHEN length(event_type || k) > 4 AND octet_length(encode('Bearer ' || event_type)) > 12
    THEN left('Bearer ' || event_type, 8) || '...' || right('Bearer ' || event_type, 4) ELSE '[redacted]' END AS auth,
  '[present]' AS api_key, 'h' || k AS host, 3 AS kept FROM ev""")
def p11(spark, d):
    headers = F.create_map(
        F.lit("authorization"), F.concat(F.lit("Bearer "), "event_type"), F.lit("x-api-key"), F.col("event_type"),
        F.lit("host"), F.concat(F.lit("h"), "k"), F.lit("cookie"), F.col("event_type"),
    )
    h = P.redact_headers(bound(spark, d, "ev").withColumn("headers", headers))
    return h.select(
        "event_id", F.col("headers")["authorization"].alias("auth"), F.col("headers")["x-api-key"].alias("api_key"),
        F.col("headers")["host"].alias("host"), F.size("headers").alias("kept"),
    )


@query("p12_tag_file_reason", ctes("file_access") + f"""
SELECT event_id, CASE WHEN pid % 10 = 0 THEN 'pid_tracked' ELSE {REASON} END AS reason FROM file_access""")
def p12(spark, d):
    rows = bound(spark, d, "file_access").withColumn("pid_tracked", F.col("pid") % 10 == 0)
    return P.tag_file_reason(rows).select("event_id", "reason")


def _short(c, n):
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"


HEAD = "strftime(make_timestamp(us), '%H:%M:%S') || ' ' || comm || ' (' || pid || ') '"
LINE = f"""CASE type
  WHEN 'Prompt' THEN {HEAD} || '>>> ' || provider || ' ' || coalesce(model, '') ||
    CASE WHEN len(flags) > 0 THEN ' [' || array_to_string(flags, ' | ') || ']' ELSE '' END ||
    coalesce(chr(10) || '  user: ' || {_short("user_message", 120)}, '') || coalesce(chr(10) || '  system: ' || {_short("system_prompt", 120)}, '')
  WHEN 'Response' THEN {HEAD} || '<<< ' || provider || ' ' || coalesce(model, '') || ' (' || {HUMAN.format(b="bytes")} || ')'
  WHEN 'ToolCall' THEN {HEAD} || '<~> tool: ' || tool_name || ' (' || provider || ')'
  WHEN 'ToolResult' THEN {HEAD} || '~>  result: ' || tool_name || ' ' || coalesce({_short("output_preview", 80)}, '')
  WHEN 'McpRequest' THEN {HEAD} || '>>> MCP ' || method || coalesce(' (' || category || ')', '')
  WHEN 'McpResponse' THEN {HEAD} || '<<< MCP ' || method
  WHEN 'PiiDetected' THEN {HEAD} || '!! PII detected (' || direction || ') [email, phone]'
  WHEN 'FileAccess' THEN {HEAD} || '[o] ' || path || ' (' || mode || ')' || coalesce(' [' || reason || ']', '')
  WHEN 'FileData' THEN {HEAD} || CASE direction WHEN 'read' THEN '<-' ELSE '->' END || ' ' || path || ' (' || bytes || ' B)' ||
    CASE WHEN coalesce(truncated, FALSE) THEN ' [truncated]' ELSE '' END
  END"""


@query("p13_render_event_lines", ctes("flat") + f""", f AS (SELECT *, list_filter([CASE WHEN sdk IS NOT NULL THEN 'sdk:' || sdk END,
  CASE WHEN coalesce(stream, FALSE) THEN 'stream' END, CASE WHEN coalesce(pii_detected, FALSE) THEN 'PII!' END,
  CASE WHEN policy <> 'allow' THEN 'policy:' || policy END], lambda x: x IS NOT NULL) AS flags FROM flat)
SELECT event_id, {LINE} AS line FROM f WHERE type <> 'Network'""")
def p13(spark, d):
    return P.render_event_lines(agentic(spark, d))


@query("p14_event_grid", ctes("flat") + f"""
SELECT event_id, strftime(make_timestamp(us), '%H:%M:%S.%g') AS time,
  CASE WHEN type = 'FileData' THEN CASE direction WHEN 'read' THEN '<-[' ELSE ']->' END ELSE {case_equals("type", P.ARROWS.items())} END || ' ' || type AS action_label,
  comm AS process_name, pid, coalesce(provider, '-') AS provider,
  coalesce(CASE WHEN length(path) > 30 THEN '...' || right(path, 27) ELSE path END, sni, '-') AS dest,
  CASE WHEN coalesce(bytes, 0) > 0 THEN {HUMAN.format(b="bytes")} ELSE '-' END AS bytes_text, coalesce(policy, '-') AS policy, {PII} AS is_pii FROM flat""")
def p14(spark, d):
    return P.event_grid(agentic(spark, d))


# ------------------------------------------------------------------ filters


@query("f1_filter_events", ctes("flat") + "SELECT event_id FROM flat WHERE provider = 'OpenAI' AND comm = 'claude' AND policy = 'audit' AND type = 'Prompt'")
def f1(spark, d):
    return Fl.filter_events(agentic(spark, d), "OpenAI", "claude", "Prompt", "audit").select("event_id")


@query("f2_search_events", ctes("flat") + """
SELECT event_id FROM flat WHERE contains(lower(comm), 'claude') OR contains(lower(sni), 'claude') OR contains(lower(model), 'claude')
  OR contains(lower(provider), 'claude') OR contains(lower(sdk), 'claude') OR contains(lower(user_message), 'claude') OR contains(lower(path), 'claude')""")
def f2(spark, d):
    return Fl.search_events(agentic(spark, d), "CLAUDE").select("event_id")


@query("f3_model_events", ctes("flat") + "SELECT event_id, provider FROM flat WHERE provider IS NOT NULL")
def f3(spark, d):
    return Fl.model_events(agentic(spark, d)).select("event_id", "action.provider")


@query("f4_ai_processes", ctes("net") + "SELECT DISTINCT pid, comm FROM net WHERE regexp_matches(comm, '^(" + "|".join(rules.AI_PROCESS_NAMES) + ")')")
def f4(spark, d):
    return Fl.ai_processes(bound(spark, d, "net").select("pid", "comm").distinct())


@query("f5_ai_paths", ctes("file_access") + "SELECT event_id, path FROM file_access WHERE " + " OR ".join(f"contains(path, '{p}')" for p in rules.AI_PATH_PATTERNS))
def f5(spark, d):
    return Fl.ai_paths(bound(spark, d, "file_access")).select("event_id", "path")


@query("f6_dns_events", ctes("net") + "SELECT event_id, pid FROM net WHERE event_type = 5 AND dport = 53")
def f6(spark, d):
    return Fl.dns_events(bound(spark, d, "net")).select("event_id", "pid")


RUN = """run AS (SELECT *, count(*) OVER w AS run_events, CAST(sum(bytes) OVER w AS BIGINT) AS run_bytes,
  (timestamp_ns - min(timestamp_ns) OVER w) / 1e9 AS seconds FROM net WINDOW w AS (PARTITION BY pid ORDER BY timestamp_ns, event_id ROWS UNBOUNDED PRECEDING))"""
RATE = "CASE WHEN seconds < 0.001 THEN 0.0 ELSE run_events / seconds END"


@query("f7_high_rate_tls", ctes("net") + f""", {RUN}
SELECT event_id, run_events, round({RATE}, 6) AS rate FROM run WHERE dport = 443 AND {RATE} > 0.05 AND NOT (k % 8 IN (0, 1, 2, 3))""")
def f7(spark, d):
    net = J.join_provider_subnet(bound(spark, d, "net"), out="provider")
    net = net.withColumn("provider", F.when(F.col("k") % 8 != 7, F.col("provider")))
    return Fl.high_rate_tls(net, per_second=0.05).select("event_id", "run_events", F.round("rate", 6).alias("rate"))


@query("w12_pid_running_stats", ctes("net") + f", {RUN} SELECT event_id, run_events, run_bytes, round({RATE}, 6) AS rate FROM run")
def w12(spark, d):
    return Fl.pid_running_stats(bound(spark, d, "net")).select("event_id", "run_events", "run_bytes", F.round("rate", 6).alias("rate"))


# ------------------------------------------------------------------ joins

SNI_P = case_contains("lower(sni)", rules.PROVIDER_HOSTS)
SUBNET_P = ("CASE WHEN family = 10 THEN CASE WHEN daddr LIKE '2607:6bc0:%' OR daddr LIKE '2600:1901:%' THEN 'Anthropic' END "
            "ELSE " + "CASE " + " ".join(f"WHEN daddr LIKE '{p}.%' THEN '{v}'" for p, v in rules.PROVIDER_SUBNETS_V4) + " END END")
ASOF = """asofs AS (SELECT n.*, CASE WHEN n.timestamp_ns - h.timestamp_ns < 300000000000 THEN h.sni END AS sni
  FROM net n ASOF LEFT JOIN (SELECT pid, timestamp_ns, max_by(sni, event_id) AS sni FROM handshakes GROUP BY 1, 2) h
  ON n.pid = h.pid AND n.timestamp_ns >= h.timestamp_ns)"""


@query("j1_join_provider_ip", ctes("net", "dns") + """
SELECT event_id, CASE WHEN dport = 443 THEN provider END AS ip_provider FROM net LEFT JOIN dns ON daddr = ip""")
def j1(spark, d):
    return J.join_provider_ip(bound(spark, d, "net"), bound(spark, d, "dns")).select("event_id", "ip_provider")


@query("j2_join_provider_subnet", ctes("net") + f"SELECT event_id, CASE WHEN dport = 443 THEN {SUBNET_P} END AS subnet_provider FROM net")
def j2(spark, d):
    return J.join_provider_subnet(bound(spark, d, "net")).select("event_id", "subnet_provider")


@query("j3_join_provider_sni", ctes("handshakes") + f"SELECT event_id, {SNI_P} AS sni_provider FROM handshakes")
def j3(spark, d):
    return J.join_provider_sni(bound(spark, d, "handshakes")).select("event_id", "sni_provider")


@query("j4_asof_sni", ctes("net", "handshakes") + f", {ASOF} SELECT event_id, sni FROM asofs")
def j4(spark, d):
    return J.asof_sni(bound(spark, d, "net"), bound(spark, d, "handshakes")).select("event_id", "sni")


RESOLVED = f"""resolved AS (SELECT a.*, CASE WHEN dport = 443 THEN coalesce({SNI_P}, dns.provider, {SUBNET_P}) END AS provider
  FROM asofs a LEFT JOIN dns ON daddr = ip)"""


@query("j5_resolve_provider", ctes("net", "handshakes", "dns") + f", {ASOF}, {RESOLVED} SELECT event_id, provider FROM resolved")
def j5(spark, d):
    n = J.resolve_provider(bound(spark, d, "net"), bound(spark, d, "dns"), bound(spark, d, "handshakes"))
    return n.select("event_id", "provider")


@query("j6_resolve_container", ctes("net", "cgroups") + """
SELECT event_id, coalesce(nullif(left(coalesce(nullif(regexp_extract(content, '(?:docker-|cri-containerd-)([a-f0-9]{64})[.]scope', 1), ''),
  regexp_extract(content, '(?m)/([a-f0-9]{64})$', 1)), 12), ''), container_id) AS container_id FROM net LEFT JOIN cgroups USING (pid)""")
def j6(spark, d):
    return J.resolve_container(bound(spark, d, "net"), bound(spark, d, "cgroups")).select("event_id", "container_id")


PODS = """ids AS (SELECT name, namespace, service_account, unnest(list_concat(container_ids, init_container_ids)) AS cid FROM pods),
short AS (SELECT *, CASE WHEN contains(cid, '://') THEN split_part(cid, '://', 2) ELSE cid END AS tail FROM ids),
keyed AS (SELECT CASE WHEN length(tail) >= 12 THEN left(tail, 12) ELSE cid END AS container_id, min((namespace, name, service_account)) AS p FROM short GROUP BY 1),
containers AS (SELECT container_id, p[2] AS pod_name, p[1] AS pod_namespace, p[3] AS service_account FROM keyed)"""


@query("j7_explode_pods", ctes("pods") + f", {PODS} SELECT * FROM containers")
def j7(spark, d):
    return J.explode_pods(bound(spark, d, "pods"))


@query("j8_join_pods", ctes("net", "pods") + f""", {PODS},
cand AS (SELECT n.container_id AS cid, c.container_id AS key, CASE WHEN n.container_id = c.container_id THEN 0 ELSE 1 END AS rank
  FROM (SELECT DISTINCT container_id FROM net WHERE container_id <> '') n JOIN containers c
  ON starts_with(c.container_id, n.container_id) OR starts_with(n.container_id, c.container_id)),
best AS (SELECT cid, arg_min(key, (rank, key)) AS key FROM cand GROUP BY 1)
SELECT event_id, net.container_id, pod_name, pod_namespace, service_account FROM net LEFT JOIN best ON net.container_id = cid LEFT JOIN containers c ON c.container_id = key""")
def j8(spark, d):
    n = J.join_pods(bound(spark, d, "net"), J.explode_pods(bound(spark, d, "pods")))
    return n.select("event_id", "container_id", "pod_name", "pod_namespace", "service_account")


AI_PATH = "(" + " OR ".join(f"contains(path, '{p}')" for p in rules.AI_PATH_PATTERNS) + ")"


@query("j9_tracked_file_access", ctes("net", "file_access") + f""", t AS (SELECT DISTINCT pid FROM net WHERE comm = 'claude')
SELECT event_id, t.pid IS NOT NULL AS pid_tracked FROM file_access f LEFT JOIN t USING (pid) WHERE t.pid IS NOT NULL OR {AI_PATH}""")
def j9(spark, d):
    pids = Fl.ai_processes(bound(spark, d, "net").select("pid", "comm"))
    pids = pids.filter("comm = 'claude'")
    return J.tracked_file_access(bound(spark, d, "file_access"), pids).select("event_id", "pid_tracked")


@query("j10_asof_fd_path", ctes("fd_events") + """, s AS (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 END AS code FROM fd_events
   WHERE fd >= 0 OR event_type <> 'click'),
 l AS (SELECT *, last_value(CASE code WHEN 1 THEN 'O' || path WHEN 2 THEN 'C' END IGNORE NULLS) OVER (PARTITION BY pid, fd
   ORDER BY timestamp_ns, CASE code WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS st FROM s)
SELECT event_id, substr(st, 2) AS path FROM l WHERE event_type IN ('view', 'purchase') AND st LIKE 'O%'""")
def j10(spark, d):
    e = bound(spark, d, "fd_events")
    io = e.filter("event_type IN ('view', 'purchase')")
    return J.asof_fd_path(io, e.filter("event_type = 'click'"), e.filter("event_type = 'error'")).select("event_id", "path")


# ------------------------------------------------------------------ dashboards

FLAT = f"x AS (SELECT *, coalesce(bytes, 0) AS b, {PII} AS pii, {EVENT_TYPE} AS et FROM flat)"


@query("a1_process_stats", ctes("flat") + f""", {FLAT} SELECT comm AS name, pid, count(*) AS events, sum(b)::BIGINT AS bytes,
  count(*) FILTER (WHERE pii) AS pii_events, array_to_string(list_sort(list(DISTINCT provider) FILTER (WHERE provider IS NOT NULL)), ',') AS providers FROM x GROUP BY 1, 2""")
def a1(spark, d):
    s = A.process_stats(agentic(spark, d))
    return s.withColumn("providers", F.array_join("providers", ","))


@query("a2_provider_stats", ctes("flat") + f""", {FLAT} SELECT coalesce(provider, 'Unknown') AS provider, count(*) AS events, sum(b)::BIGINT AS bytes,
  count(*) FILTER (WHERE pii) AS pii_events, count(DISTINCT comm) AS processes FROM x GROUP BY 1""")
def a2(spark, d):
    return A.provider_stats(agentic(spark, d))


@query("a2_provider_processes", ctes("flat") + " SELECT coalesce(provider, 'Unknown') AS provider, comm AS process, count(*) AS events FROM flat GROUP BY 1, 2")
def a2_processes(spark, d):
    return A.provider_processes(agentic(spark, d))


@query("a3_kpis", ctes("flat") + f""", {FLAT} SELECT count(*) AS events, sum(b)::BIGINT AS bytes, count(DISTINCT (comm, pid)) AS processes,
  count(*) FILTER (WHERE pii) AS pii_events, count(*) FILTER (WHERE policy = 'allow') AS allow, count(*) FILTER (WHERE policy = 'audit') AS audit,
  count(*) FILTER (WHERE policy = 'deny') AS deny FROM x""")
def a3(spark, d):
    return A.kpis(agentic(spark, d))


@query("a4_policy_breakdown", ctes("flat") + """ SELECT count(*) FILTER (WHERE policy = 'allow') AS allow, count(*) FILTER (WHERE policy = 'audit') AS audit,
  count(*) FILTER (WHERE policy = 'deny') AS deny FROM flat""")
def a4(spark, d):
    return A.policy_breakdown(agentic(spark, d))


@query("a5_facets", ctes("flat") + """ SELECT DISTINCT 'provider' AS facet, provider AS value FROM flat WHERE provider IS NOT NULL
  UNION ALL SELECT DISTINCT 'action_type', type FROM flat""")
def a5(spark, d):
    return A.facets(agentic(spark, d))


@query("a6_event_counters", ctes("flat") + f", {FLAT} SELECT et AS event_type, coalesce(provider, 'none') AS provider, count(*) AS events, sum(b)::BIGINT AS bytes FROM x GROUP BY 1, 2")
def a6(spark, d):
    return A.event_counters(agentic(spark, d))


@query("a7_coverage_gauges", ctes("flat") + " SELECT count(DISTINCT pid) AS active_pids, count(DISTINCT provider) AS providers_detected FROM flat WHERE provider IS NOT NULL")
def a7(spark, d):
    return A.coverage_gauges(agentic(spark, d))


@query("a8_decision_counters", ctes("flat") + " SELECT policy AS decision, count(*) AS events FROM flat WHERE policy IS NOT NULL GROUP BY 1")
def a8(spark, d):
    return A.decision_counters(agentic(spark, d))


@query("a16_events_per_second", """WITH e AS (SELECT epoch(ts)::BIGINT AS s0, floor(epoch_us(ts) / 1000000)::BIGINT AS second FROM events),
 c AS (SELECT second, count(*) AS n FROM e GROUP BY 1), m AS (SELECT max(second) AS last FROM c),
 axis AS (SELECT unnest(range(last - 63, last + 1)) AS second, last FROM m), f AS (SELECT second, last, coalesce(n, 0) AS events FROM axis LEFT JOIN c USING (second)),
 r AS (SELECT *, sum(events) OVER (ORDER BY second ROWS 4 PRECEDING) / 5.0::DOUBLE AS rate FROM f)
SELECT second, events, rate FROM r WHERE second > last - 60""")
def a16(spark, d):
    return A.events_per_second(agentic(spark, d))


@query("k1_recent_events", ctes("flat") + " SELECT event_id, us, type FROM flat ORDER BY us DESC, event_id DESC LIMIT 5000")
def k1(spark, d):
    r = A.recent_events(agentic(spark, d), rules.RECENT_EVENTS)
    return r.select("event_id", F.unix_micros("timestamp").alias("us"), "action.type")


@query("k2_top_providers", ctes("flat") + " SELECT coalesce(provider, 'Unknown') AS provider, count(*) AS events FROM flat GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def k2(spark, d):
    return A.top_providers(agentic(spark, d))


@query("k3_all_events", ctes("net", "file_access", "file_data") + """
SELECT type, count(*) AS events, sum(bytes)::BIGINT AS bytes FROM (SELECT 'Network' AS type, bytes FROM net UNION ALL SELECT 'FileAccess', 0 FROM file_access
  UNION ALL SELECT 'FileData', payload_len FROM file_data) GROUP BY 1""")
def k3(spark, d):
    data = bound(spark, d, "file_data").withColumn("payload", F.col("text").cast("binary"))
    every = A.all_events(
        P.normalize_network(bound(spark, d, "net")), P.normalize_file_access(bound(spark, d, "file_access")), P.normalize_file_data(data)
    )
    return every.groupBy("action.type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("action.bytes", F.lit(0))).alias("bytes")
    )


@query("traffic_by_provider", ctes("net", "handshakes", "dns") + f""", {ASOF}, {RESOLVED}
SELECT coalesce(provider, 'Unknown') AS provider, count(*) AS events, sum(bytes)::BIGINT AS bytes, 0::BIGINT AS pii_events,
  count(DISTINCT comm) AS processes FROM resolved GROUP BY 1""")
def traffic_by_provider(spark, d):
    """Flagship: raw network records -> provider by server name, address, subnet -> traffic per provider."""
    n = J.resolve_provider(bound(spark, d, "net"), bound(spark, d, "dns"), bound(spark, d, "handshakes"))
    return A.provider_stats(P.normalize_network(n))
