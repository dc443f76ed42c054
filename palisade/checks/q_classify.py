"""Queries on payload classification and model-API bodies."""

from pyspark.sql import functions as F

from palisade import rules
from palisade.checks.bindings import bound, ctes, payload_rows, table
from palisade.checks.registry import query
from palisade.checks.sqlfn import CLASS, FLAGS, READ, fnv32, fnv64, text_bytes, fnv64_list
from palisade.operators import classify as C
from palisade.operators import enrich as J
from palisade.operators import aggregates as A

BASE = ctes("payloads")
ID = "conv_id, turn"


def _ids(*more):
    return ["conv_id", "turn", *more]


@query("c1_detect_protocol", BASE + READ + f" SELECT {ID}, protocol FROM pr")
def c1(spark, d):
    return C.detect_protocol(payload_rows(spark, d)).select(*_ids("protocol"))


@query("c2_parse_http", BASE + READ + f""" SELECT {ID}, method, path, status_code, body, h_host AS host, h_ua AS user_agent, h_ct AS content_type,
  CASE WHEN octet_length(encode(h_auth)) > 12 THEN left(h_auth, 8) || '...' || right(h_auth, 4) WHEN h_auth IS NOT NULL THEN '[redacted]' END AS auth FROM http""")
def c2(spark, d):
    m = C.parse_http(C.detect_protocol(payload_rows(spark, d)))
    h = lambda n: F.col("headers")[n]
    return m.select(
        *_ids("method", "path", "status_code", "body"), h("host").alias("host"), h("user-agent").alias("user_agent"),
        h("content-type").alias("content_type"), h("authorization").alias("auth"),
    )


_JSON_SQL = f"""model, temperature, max_tokens, top_p, stream, jsonrpc, rpc_method, rpc_id, {', '.join('has_' + k for k in FLAGS)},
  array_to_string(jkeys, ',') AS jkeys"""


def _json_cols():
    j = lambda n: F.col(f"j_{n}")
    return [
        *[j(n).alias(n) for n in ("model", "temperature", "max_tokens", "top_p", "stream", "jsonrpc")],
        j("method").alias("rpc_method"), j("id").alias("rpc_id"), *[j(f"has_{k}").alias(f"has_{k}") for k in FLAGS],
        F.array_join(j("keys"), ",").alias("jkeys"),
    ]


@query("c3_extract_json_fields", BASE + READ + f" SELECT {ID}, {_JSON_SQL} FROM flags WHERE complete")
def c3(spark, d):
    return C.read_payloads(payload_rows(spark, d)).filter("j_complete").select(*_ids(), *_json_cols())


@query("c4_scan_truncated_json", BASE + READ + f" SELECT {ID}, {_JSON_SQL} FROM flags WHERE body IS NOT NULL AND NOT complete")
def c4(spark, d):
    return C.read_payloads(payload_rows(spark, d)).filter("NOT j_complete").select(*_ids(), *_json_cols())


@query("c5_classify_mcp", BASE + READ + f" SELECT {ID}, rpc_method AS method, category, msg_type, rpc_id FROM mcpx WHERE is_mcp")
def c5(spark, d):
    return C.classify_mcp(C.read_payloads(payload_rows(spark, d))).filter("mcp IS NOT NULL").select(*_ids("mcp.*"))


@query("c6_infer_llm_response", BASE + READ + f" SELECT {ID}, resp_provider AS provider, resp_endpoint AS endpoint FROM resp WHERE resp_provider IS NOT NULL")
def c6(spark, d):
    r = C.infer_llm_response(C.read_payloads(payload_rows(spark, d)))
    named = r.filter("response_provider IS NOT NULL")
    return named.select(*_ids(F.col("response_provider").alias("provider"), F.col("response_endpoint").alias("endpoint")))


@query("c7_detect_sse", BASE + READ + f" SELECT {ID}, sse_provider FROM resp WHERE sse_provider IS NOT NULL")
def c7(spark, d):
    return C.detect_sse(C.detect_protocol(payload_rows(spark, d))).filter("sse_provider IS NOT NULL").select(*_ids("sse_provider"))


@query("c8_llm_indicator_score", BASE + READ + f" SELECT {ID}, n AS indicators FROM mcpx")
def c8(spark, d):
    return C.llm_indicator_score(C.read_payloads(payload_rows(spark, d))).select(*_ids("indicators"))


@query("c9_classify_payloads", BASE + CLASS + f""" SELECT {ID}, protocol, content_class, provider, endpoint, confidence, is_interesting,
  CASE WHEN content_class = 'LlmApi' OR printed THEN model END AS model, CASE WHEN content_class = 'LlmApi' AND protocol <> 'Http1Response' THEN stream END AS streaming,
  CASE WHEN content_class = 'Mcp' THEN rpc_method END AS mcp_method, CASE WHEN content_class = 'Mcp' THEN category END AS mcp_category FROM done""")
def c9(spark, d):
    c = C.classify_payloads(payload_rows(spark, d), with_fingerprint=False)
    return c.select(*_ids("protocol", "content_class", "provider", "endpoint", "confidence", "is_interesting", "model", "streaming", "mcp_method", "mcp_category"))


_PII_NAMES = [n for n, _ in rules.PII_PATTERNS]
_PII_BOOL = ", ".join("regexp_matches(text, '" + p + "') AS has_" + n for n, p in rules.PII_PATTERNS)
_PII_TYPES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN has_{n} THEN '{n}' END" for n in rules.PII_LIST_ORDER) + "], lambda x: x IS NOT NULL), ',')"
_PII_SQL = f"""WITH s AS (SELECT 'documents' AS src, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'pages', page_id, 0, html FROM pages
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations UNION ALL SELECT 'benchmark', item_id, 0, text FROM benchmark),
 f AS (SELECT src, id, part, {_PII_BOOL} FROM s)
SELECT *, {' + '.join(f'CAST(has_{n} AS INT)' for n in _PII_NAMES)} AS pii_pattern_count, {_PII_TYPES} AS pii_types FROM f"""


@query("c10_scan_pii", _PII_SQL)
def c10(spark, d):
    """Whole texts of every text table."""
    part = lambda t, id_, text, seq=F.lit(0).cast("bigint"): table(spark, d, t).select(
        F.lit(t).alias("src"), F.col(id_).alias("id"), seq.alias("part"), F.col(text).alias("text")
    )
    every = (
        part("documents", "doc_id", "text").unionByName(part("pages", "page_id", "html"))
        .unionByName(part("conversations", "conv_id", "text", F.col("turn"))).unionByName(part("benchmark", "item_id", "text"))
    )
    return C.scan_pii(every).drop("text", "pii_any").withColumn("pii_types", F.array_join("pii_types", ","))


_SHAPE = "method || path || array_to_string(hnames, '') || array_to_string(jkeys, '')"


@query("c11_fingerprint_sdk", BASE + CLASS + f""" SELECT {ID}, sdk_name, sdk_version, CASE WHEN sdk_version IS NULL THEN sdk_name ELSE sdk_name || '/' || sdk_version END AS sdk, h_av AS api_version,
  {fnv32("sdk_name")} AS sdk_hash, {fnv32("model")} AS model_hash, {fnv64(_SHAPE)} AS signature_hash FROM done WHERE printed""")
def c11(spark, d):
    c = C.classify_payloads(payload_rows(spark, d)).filter("signature_hash IS NOT NULL")
    return c.select(*_ids("sdk_name", "sdk_version", "sdk", "api_version", "sdk_hash", "model_hash", "signature_hash"))


@query("j11_join_endpoint_rules", BASE + CLASS + f" SELECT {ID}, ep_provider AS provider, ep_endpoint AS endpoint FROM ep WHERE protocol = 'Http1Request'")
def j11(spark, d):
    m = C.parse_http(C.detect_protocol(payload_rows(spark, d))).filter("protocol = 'Http1Request'")
    return J.join_endpoint_rules(m).select(*_ids("provider", "endpoint"))


@query("j12_join_mcp_methods", ctes("flat") + f""" SELECT event_id, CASE method {' '.join(f"WHEN '{m}' THEN '{c}'" for m, c in rules.MCP_METHODS)} END AS mcp_category,
  method IN ({', '.join(f"'{m}'" for m, _ in rules.MCP_METHODS)}) AS is_mcp_method FROM flat WHERE method IS NOT NULL""")
def j12(spark, d):
    rows = bound(spark, d, "flat").filter("method IS NOT NULL")
    return J.join_mcp_methods(rows, "method").select("event_id", "mcp_category", "is_mcp_method")


@query("j13_join_sdk_patterns", ctes("bodies") + """ SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'openai-python' WHEN conv_id % 4 = 1 THEN 'anthropic-python' WHEN conv_id % 4 = 2 THEN 'langchain' END AS sdk_name,
  CASE WHEN conv_id % 4 = 0 THEN '1.3.5' WHEN conv_id % 4 = 1 THEN '0.8.0' END AS sdk_version FROM bodies""")
def j13(spark, d):
    return J.join_sdk_patterns(bound(spark, d, "bodies"), "ua").select(*_ids("sdk_name", "sdk_version"))


@query("a11_confidence_histogram", BASE + CLASS + " SELECT least(floor(confidence * 20 + 1e-9) + 1, 20)::INT AS bucket, count(*) AS payloads FROM done GROUP BY 1")
def a11(spark, d):
    c = C.classify_payloads(payload_rows(spark, d), with_fingerprint=False)
    return A.confidence_histogram(c.withColumn("confidence", F.col("confidence") + F.lit(1e-9 / 20)))


@query("fnv_hashes", f"WITH t AS (SELECT DISTINCT source || lang AS s FROM documents UNION SELECT text FROM conversations) SELECT s, {fnv32('s')} AS h32, {fnv64('s')} AS h64 FROM t")
def fnv_hashes(spark, d):
    from palisade.functions.hashing import fnv32 as s32
    from palisade.functions.hashing import fnv64 as s64

    a = table(spark, d, "documents").select(F.concat("source", "lang").alias("s"))
    b = table(spark, d, "conversations").select(F.col("text").alias("s"))
    return a.unionByName(b).distinct().select("s", s32(F.col("s")).alias("h32"), s64(F.col("s")).alias("h64"))
