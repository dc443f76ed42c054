"""Queries on policy."""

from pyspark.sql import functions as F

from palisade.checks.bindings import agentic, bound, ctes, table
from palisade.checks.registry import query
from palisade.operators import enrich as J
from palisade.operators import policy as R

_PII = "coalesce(pii_detected, FALSE)"
_LLM = "(provider IS NOT NULL OR type IN ('Prompt', 'McpRequest'))"
_SECRET = "(contains(path, '.env') OR contains(path, 'credentials') OR contains(path, 'secrets'))"
_SA = f"(type = 'FileAccess' AND {_SECRET})"
_SW = f"(type = 'FileData' AND direction = 'write' AND {_SECRET})"
DECIDE = f"""dec AS (SELECT *, CASE WHEN ({_PII} AND {_LLM}) OR ({_SA} AND NOT {_PII} AND NOT {_LLM}) OR ({_SW} AND NOT {_PII} AND NOT {_LLM}) THEN 'deny'
   WHEN ({_LLM} AND NOT {_PII}) OR (type = 'FileAccess' AND NOT {_SA}) OR (type = 'FileData' AND NOT {_SW}) THEN 'audit' ELSE 'allow' END AS decision,
  list_sort(list_distinct(list_filter([CASE WHEN {_PII} AND {_LLM} THEN 'PII detected in outbound LLM traffic' END, 'Traffic to LLM provider: ' || provider,
   'MCP tool invocation detected: ' || method, CASE WHEN type = 'FileAccess' THEN 'File access: ' || path || ' (' || mode || ')' END,
   CASE WHEN {_SA} THEN 'Sensitive file access: ' || path END, CASE WHEN type = 'FileData' THEN 'File data ' || direction || ': ' || path || ' (' || bytes || ' bytes)' END,
   CASE WHEN {_SW} THEN 'Sensitive file write: ' || path END], lambda x: x IS NOT NULL))) AS reasons FROM flat)"""
OUT = "event_id, decision, array_to_string(reasons, '; ') AS reasons"


def _out(df):
    return df.select("event_id", "decision", F.array_join("reasons", "; ").alias("reasons"))


@query("r2_default_policy", ctes("flat") + f", {DECIDE} SELECT {OUT} FROM dec")
def r2(spark, d):
    return _out(R.default_policy(agentic(spark, d)))


@query("r1_apply_policy", ctes("flat") + """, x AS (SELECT event_id, provider = 'OpenAI' AS a, pii_detected AS b, bytes > 100000 AS c FROM flat)
SELECT event_id, CASE WHEN coalesce(a, FALSE)::INT + coalesce(b, FALSE)::INT > 1 THEN 'allow' WHEN a THEN 'allow' WHEN b THEN 'deny' ELSE 'audit' END AS decision,
  array_to_string(list_filter([CASE WHEN c THEN 'big' END, CASE WHEN a THEN 'known' END, CASE WHEN b THEN 'pii' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM x""")
def r1(spark, d):
    """Conflicts fall open; rules given as SQL strings."""
    rules = [
        R.rule("a", "allow", "action.provider = 'OpenAI'", F.lit("known")),
        R.rule("b", "deny", "action.pii_detected", F.lit("pii")),
        R.rule("c", None, "action.bytes > 100000", F.lit("big")),
    ]
    return _out(R.apply_policy(agentic(spark, d), rules, default="audit", conflict="open"))


R3 = """, prov AS (SELECT DISTINCT n_name FROM nation), procs AS (SELECT DISTINCT comm FROM net WHERE pid % 8 IN (0, 3)), pref AS (SELECT DISTINCT 'box' || (s_suppkey % 5) AS p FROM supplier),
 mods AS (SELECT DISTINCT model FROM conv WHERE conv_id % 4 = 2), hosts AS (SELECT DISTINCT 'shadow.ai.example' AS h FROM region), paths AS (SELECT DISTINCT path FROM file_access WHERE pid % 2 = 0 AND path LIKE '%.env'),
 meths AS (SELECT DISTINCT rpc_method FROM conv WHERE turn % 6 = 0), sdks AS (SELECT DISTINCT sdk FROM flat WHERE k % 4 = 1), accts AS (SELECT DISTINCT service_account FROM flat WHERE pid % 4 < 2),
 f AS (SELECT event_id, provider IS NOT NULL AND comm NOT IN (SELECT comm FROM procs) AS bad_process, coalesce(method IN (SELECT rpc_method FROM meths), FALSE) AS bad_method,
   coalesce(model IN (SELECT model FROM mods), FALSE) AS bad_model, coalesce(sni IN (SELECT h FROM hosts), FALSE) AS bad_host, coalesce(path IN (SELECT path FROM paths), FALSE) AS bad_path,
   sdk IS NOT NULL AND sdk NOT IN (SELECT sdk FROM sdks WHERE sdk IS NOT NULL) AS bad_sdk, service_account IS NOT NULL AND service_account NOT IN (SELECT service_account FROM accts WHERE service_account IS NOT NULL) AS bad_account,
   container_id <> '' AND NOT EXISTS (SELECT 1 FROM pref WHERE starts_with(container_id, p)) AS bad_container FROM flat)
SELECT event_id, CASE WHEN bad_process OR bad_method OR bad_model OR bad_host OR bad_path THEN 'deny' WHEN bad_sdk OR bad_account OR bad_container THEN 'audit' ELSE 'allow' END AS decision,
  array_to_string(list_filter([CASE WHEN bad_account THEN 'account' END, CASE WHEN bad_container THEN 'container' END, CASE WHEN bad_host THEN 'host' END, CASE WHEN bad_method THEN 'method' END,
   CASE WHEN bad_model THEN 'model' END, CASE WHEN bad_path THEN 'path' END, CASE WHEN bad_process THEN 'process' END, CASE WHEN bad_sdk THEN 'sdk' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM f"""


@query("r3_data_driven_policy", ctes("flat", "net", "conv", "file_access") + R3)
def r3(spark, d):
    """Allow- and block-lists held in tables: processes, containers, SDKs, accounts, methods, models, hosts, paths."""
    e, b = agentic(spark, d), lambda n: bound(spark, d, n)
    a, p = lambda f: F.col(f"action.{f}"), lambda f: F.col(f"process.{f}")
    member = [
        (p("name"), b("net").filter("pid % 8 IN (0, 3)"), "comm", "ok_process"),
        (a("method"), b("conv").filter("turn % 6 = 0"), "rpc_method", "in_methods"),
        (a("model"), b("conv").filter("conv_id % 4 = 2"), "model", "in_models"),
        (a("sni"), table(spark, d, "region").select(F.lit("shadow.ai.example").alias("h")), "h", "in_hosts"),
        (a("path"), b("file_access").filter("pid % 2 = 0 AND path LIKE '%.env'"), "path", "in_paths"),
        (a("sdk"), b("flat").filter("k % 4 = 1"), "sdk", "ok_sdk"),
        (p("service_account"), b("flat").filter("pid % 4 < 2"), "service_account", "ok_account"),
    ]
    for column, data, field, flag in member:
        e = R.flag_member(e, column, data, field, flag)
    prefixes = table(spark, d, "supplier").select(F.concat(F.lit("box"), (F.col("s_suppkey") % 5).cast("string")).alias("p"))
    e = R.flag_prefix(e, p("container_id"), prefixes, "p", "ok_container")
    rules = [
        R.rule("process", "deny", "action.provider IS NOT NULL AND NOT ok_process", F.lit("process")),
        R.rule("method", "deny", "in_methods", F.lit("method")),
        R.rule("model", "deny", "in_models", F.lit("model")),
        R.rule("host", "deny", "in_hosts", F.lit("host")),
        R.rule("path", "deny", "in_paths", F.lit("path")),
        R.rule("sdk", "audit", "action.sdk IS NOT NULL AND NOT ok_sdk", F.lit("sdk")),
        R.rule("account", "audit", "process.service_account IS NOT NULL AND NOT ok_account", F.lit("account")),
        R.rule("container", "audit", "process.container_id <> '' AND NOT ok_container", F.lit("container")),
    ]
    return _out(R.apply_policy(e, rules))


@query("r3_large_list_policy", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) THEN 'deny' ELSE 'allow' END AS decision FROM lineitem""")
def r3_large(spark, d):
    """Lists that are too large to broadcast: every line against the orders and suppliers listed."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = R.flag_member(rows, F.col("l_orderkey"), table(spark, d, "orders").filter("o_custkey % 3 = 0"), "o_orderkey", "listed")
    rows = R.flag_member(rows, F.col("l_suppkey"), table(spark, d, "supplier").filter("s_nationkey % 2 = 0"), "s_suppkey", "approved")
    decided = R.apply_policy(rows, [R.rule("listed", "deny", "listed AND NOT approved")])
    return decided.select("l_orderkey", "l_linenumber", "decision")


@query("r3_provider_namespace_rules", ctes("flat") + """, r AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN 'DeepSeek' WHEN 1 THEN 'OpenAI' ELSE 'aws' END AS provider, CASE n_nationkey % 2 WHEN 0 THEN 'production' ELSE 'staging' END AS namespace FROM nation WHERE n_nationkey < 4)
SELECT event_id, CASE WHEN r.provider IS NOT NULL THEN 'deny' ELSE 'allow' END AS decision, CASE WHEN r.provider IS NOT NULL THEN 'Rule: deny ' || r.provider || ' in ' || namespace ELSE '' END AS reasons
FROM flat f LEFT JOIN r ON f.provider = r.provider AND f.pod_namespace = r.namespace""")
def r3_rows(spark, d):
    n = table(spark, d, "nation").filter("n_nationkey < 4")
    data = n.selectExpr(
        "CASE n_nationkey % 3 WHEN 0 THEN 'DeepSeek' WHEN 1 THEN 'OpenAI' ELSE 'aws' END AS provider",
        "CASE n_nationkey % 2 WHEN 0 THEN 'production' ELSE 'staging' END AS namespace",
    )
    e = R.flag_rows(
        agentic(spark, d), {"provider": F.col("action.provider"), "namespace": F.col("process.pod_namespace")}, data, "listed"
    )
    why = F.concat(F.lit("Rule: deny "), F.col("action.provider"), F.lit(" in "), F.col("process.pod_namespace"))
    return _out(R.apply_policy(e, [R.rule("rows", "deny", "listed", why)]))


@query("r4_threshold_policy", ctes("flat") + """, t AS (SELECT *, list_filter([CASE WHEN provider IS NOT NULL THEN 'has_provider' END, CASE WHEN coalesce(pii_detected, FALSE) THEN 'has_pii' END, CASE WHEN method IS NOT NULL THEN 'has_mcp' END], lambda v: v IS NOT NULL) AS tags FROM flat),
 f AS (SELECT event_id, coalesce(bytes > 1048576, FALSE) AS big, uid = 1003 AND provider IS NOT NULL AS svc, coalesce(type = 'Network' AND dst_port <> 443, FALSE) AS port, provider IS NOT NULL AND coalesce(pod_namespace = 'production', FALSE) AS ns,
   timeline_len > 30 AND id_confidence > 0.8 AS long, list_contains(tags, 'has_provider') AND list_contains(tags, 'has_pii') AS tag, len(tags) > 0 AS any_tag FROM t)
SELECT event_id, CASE WHEN svc OR ns OR tag THEN 'deny' WHEN big OR port OR long OR any_tag THEN 'audit' ELSE 'allow' END AS decision,
  array_to_string(list_filter([CASE WHEN big THEN 'bytes' END, CASE WHEN long THEN 'long' END, CASE WHEN ns THEN 'namespace' END, CASE WHEN port THEN 'port' END, CASE WHEN tag THEN 'tags' END, CASE WHEN svc THEN 'uid' END], lambda v: v IS NOT NULL), '; ') AS reasons FROM f""")
def r4(spark, d):
    tags = R.event_tags()
    rules = [
        R.rule("bytes", "audit", "action.bytes > 1048576", F.lit("bytes")),
        R.rule("uid", "deny", "process.uid = 1003 AND action.provider IS NOT NULL", F.lit("uid")),
        R.rule("port", "audit", "action.type = 'Network' AND action.dst_port <> 443", F.lit("port")),
        R.rule("namespace", "deny", "action.provider IS NOT NULL AND process.pod_namespace = 'production'", F.lit("namespace")),
        R.rule("long", "audit", "identity.timeline_len > 30 AND identity.confidence > 0.8", F.lit("long")),
        R.rule("tags", "deny", F.array_contains(tags, "has_provider") & F.array_contains(tags, "has_pii"), F.lit("tags")),
        R.rule("watched", "audit", F.arrays_overlap(tags, F.array(F.lit("has_provider"), F.lit("has_pii"), F.lit("has_mcp")))),
    ]
    return _out(R.apply_policy(agentic(spark, d), rules))


@query("r5_builtin_policy", ctes("net") + " SELECT event_id, CASE WHEN dport = 443 AND k % 8 IN (0, 1, 2, 3) THEN 'deny' END AS policy FROM net WHERE k % 8 < 7")
def r5(spark, d):
    n = J.join_provider_subnet(bound(spark, d, "net").filter("k % 8 < 7"), out="provider")
    return R.builtin_policy(n, enforce=True).select("event_id", "policy")


@query("r6_denied_pids", ctes("flat") + f", {DECIDE} SELECT pid, arg_max(CASE decision WHEN 'deny' THEN 1 ELSE 2 END, (us, event_id)) AS code FROM dec WHERE decision <> 'allow' GROUP BY 1")
def r6(spark, d):
    e = R.default_policy(agentic(spark, d)).select("event_id", "timestamp", "process.pid", "decision")
    return R.denied_pids(e)


@query("r8_eval_report", ctes("flat") + f""", {DECIDE} SELECT event_id, decision AS action, array_to_string(reasons, '; ') AS reasons, pid, comm AS process_name,
  decision || ': PID ' || pid || ' (' || comm || ')' || CASE WHEN len(reasons) > 0 THEN ' (' || array_to_string(reasons, '; ') || ')' ELSE '' END AS line FROM dec""")
def r8(spark, d):
    return R.eval_report(agentic(spark, d)).withColumn("reasons", F.array_join("reasons", "; "))


@query("a9_policy_test_report", ctes("flat") + f""", {DECIDE} SELECT count(*) AS events, count(*) FILTER (WHERE decision = 'allow') AS allow, count(*) FILTER (WHERE decision = 'audit') AS audit,
  count(*) FILTER (WHERE decision = 'deny') AS deny, 0::BIGINT AS errors FROM dec""")
def a9(spark, d):
    return R.policy_test_report(agentic(spark, d))
