"""Queries on model-API requests, responses, tool calls and turn actions."""

from pyspark.sql import functions as F

from palisade import rules
from palisade.checks.bindings import bound, ctes, payload_rows
from palisade.checks.registry import query
from palisade.checks.sqlfn import CLASS, READ, fnv32, fnv64
from palisade.operators import classify as C
from palisade.operators import enrich as J
from palisade.operators import normalize as P
from palisade.operators import protocols as Q
from palisade.operators import sessions as T

BASE = ctes("payloads")
_s = lambda j, p: f"json_extract_string({j}, '{p}')"
_list = lambda j, p: f"coalesce(json_extract({j}, '{p}[*]'), [])"


def _join(lst):
    return f"array_to_string(list_filter({lst}, lambda x: x IS NOT NULL), chr(10))"


def _inner(b):
    return (f"CASE json_type({b}, '$.content') WHEN 'VARCHAR' THEN [{_s(b, '$.content')}] WHEN 'ARRAY' THEN "
            f"list_transform({_list(b, '$.content')}, lambda i: {_s('i', '$.text')}) ELSE [] END")  # fmt: skip


def _flat_a(c):
    blocks = f"flatten(list_transform({_list(c, '$')}, lambda b: list_concat([{_s('b', '$.text')}, {_s('b', '$.name')}], {_inner('b')})))"
    return f"CASE WHEN json_type({c}) = 'VARCHAR' THEN {_s(c, '$')} ELSE {_join(blocks)} END"


def _flat_o(c):
    texts = f"list_transform(list_filter({_list(c, '$')}, lambda b: {_s('b', '$.type')} = 'text'), lambda b: {_s('b', '$.text')})"
    return f"CASE WHEN json_type({c}) = 'VARCHAR' THEN {_s(c, '$')} WHEN json_type({c}) = 'ARRAY' THEN {_join(texts)} END"


def _cut(t):
    return f"CASE WHEN length({t}) > 200 THEN left({t}, 200) || '...' ELSE {t} END"


def _result(name, use, out):
    return f"{{'name': {name}, 'tool_use_id': {use}, 'output_preview': {_cut(out)}, 'output': {out}}}"


OPENAI_HINT = "coalesce(contains(lower(sni), 'openai') AND NOT contains(lower(sni), 'anthropic'), FALSE)"
REQUEST = f""", m0 AS (SELECT *, {_list("jb", "$.messages")} AS msgs FROM {{src}}),
m1 AS (SELECT *, len(msgs) > 0 AS has_req, {OPENAI_HINT} AS oai FROM m0),
req AS (SELECT *, CASE WHEN has_req THEN CASE WHEN oai THEN 'OpenAI' ELSE 'Anthropic' END END AS rq_provider,
  list_transform(msgs, lambda m: {{'role': {_s("m", "$.role")}, 'content': coalesce(CASE WHEN oai THEN {_flat_o("json_extract(m, '$.content')")} ELSE {_flat_a("json_extract(m, '$.content')")} END, '')}}) AS listed,
  CASE WHEN oai THEN nullif({_join(f"list_transform(list_filter(msgs, lambda m: {_s('m', '$.role')} = 'system'), lambda m: {_flat_o(chr(106)+'son_extract(m, '+chr(39)+'$.content'+chr(39)+')')})")}, '')
    ELSE {_s("jb", "$.system")} END AS rq_system,
  CASE WHEN oai THEN coalesce(CAST({_s("jb", "$.max_tokens")} AS BIGINT), CAST({_s("jb", "$.max_completion_tokens")} AS BIGINT)) ELSE CAST({_s("jb", "$.max_tokens")} AS BIGINT) END AS rq_max,
  coalesce(CAST(json_extract(jb, '$.stream') AS BOOLEAN), FALSE) AS rq_stream,
  CASE WHEN oai THEN list_transform(list_filter(msgs, lambda m: {_s("m", "$.role")} = 'tool'), lambda m: {_result(_s("m", "$.name"), _s("m", "$.tool_call_id"), _flat_o("json_extract(m, '$.content')"))})
    ELSE list_transform(list_filter(flatten(list_transform(msgs, lambda m: CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN {_list("m", "$.content")} ELSE [] END)), lambda b: {_s("b", "$.type")} = 'tool_result'),
      lambda b: {_result(_s("b", "$.name"), _s("b", "$.tool_use_id"), _join(_inner("b")))}) END AS results FROM m1)"""
RESPONSE = f""", s0 AS (SELECT *, {_list("jb", "$.choices")} AS choices, {OPENAI_HINT} AS oai2 FROM {{src}}),
s1 AS (SELECT *, len(choices) > 0 AS is_o, json_type(jb, '$.content') = 'ARRAY' AS is_a FROM s0),
rsp AS (SELECT *, CASE WHEN is_o THEN 'OpenAI' WHEN is_a THEN 'Anthropic' END AS rs_provider,
  CASE WHEN is_o THEN list_filter(list_transform(choices, lambda c: {_flat_o("json_extract(c, '$.message.content')")}), lambda t: t <> '')
    WHEN is_a THEN list_transform(list_filter({_list("jb", "$.content")}, lambda b: {_s("b", "$.type")} = 'text'), lambda b: {_s("b", "$.text")}) END AS texts,
  CASE WHEN is_o THEN list_transform(flatten(list_transform(choices, lambda c: {_list("c", "$.message.tool_calls")})),
      lambda t: {{'name': {_s("t", "$.function.name")}, 'input_json': {_s("t", "$.function.arguments")}, 'tool_call_id': {_s("t", "$.id")}}})
    WHEN is_a THEN list_transform(list_filter({_list("jb", "$.content")}, lambda b: {_s("b", "$.type")} = 'tool_use'),
      lambda b: {{'name': {_s("b", "$.name")}, 'input_json': CAST(json_extract(b, '$.input') AS VARCHAR), 'tool_call_id': {_s("b", "$.id")}}}) ELSE [] END AS calls FROM s1)"""
REQ_SQL = BASE + READ + REQUEST.replace("{src}", "js")
RSP_SQL = BASE + READ + RESPONSE.replace("{src}", "js")
USER = "list_filter(listed, lambda m: m.role = 'user')[-1].content"
TEXT = "CASE WHEN len(texts) > 0 THEN array_to_string(texts, chr(10)) END"
IDS = ["session_id", "seq"]


def _bodies(spark, d):
    return C.parse_http(C.detect_protocol(payload_rows(spark, d)))


def _requests(spark, d):
    return Q.parse_llm_requests(_bodies(spark, d)).filter("request IS NOT NULL")


def _responses(spark, d):
    return Q.parse_llm_responses(_bodies(spark, d)).filter("response IS NOT NULL")


@query("c12_parse_llm_requests", REQ_SQL + f""" SELECT session_id, seq, rq_provider AS provider, {_s("jb", "$.model")} AS model, rq_stream AS stream, rq_system AS system_prompt,
  {USER} AS user_message, CAST({_s("jb", "$.temperature")} AS DOUBLE) AS temperature, rq_max AS max_tokens, len(listed)::INT AS n_messages, len(results)::INT AS n_results FROM req WHERE has_req""")
def c12(spark, d):
    r = _requests(spark, d)
    return r.select(
        *IDS, *[F.col(f"request.{c}") for c in ("provider", "model", "stream", "system_prompt", "user_message", "temperature", "max_tokens")],
        F.size("request.messages").alias("n_messages"), F.size("request.tool_results").alias("n_results"),
    )


@query("c13_parse_llm_responses", RSP_SQL + f""" SELECT session_id, seq, rs_provider AS provider, {_s("jb", "$.model")} AS model, {TEXT} AS text, len(calls)::INT AS n_calls FROM rsp WHERE rs_provider IS NOT NULL""")
def c13(spark, d):
    r = _responses(spark, d)
    return r.select(*IDS, "response.provider", "response.model", "response.text", F.size("response.tool_calls").alias("n_calls"))


@query("c14_explode_messages", REQ_SQL + """, x AS (SELECT session_id, seq, unnest(listed) AS m, generate_subscripts(listed, 1) - 1 AS idx FROM req WHERE has_req)
SELECT session_id, seq, idx, m.role AS role, m.content AS content FROM x""")
def c14(spark, d):
    return Q.explode_messages(_requests(spark, d))


@query("c15_explode_tool_results", REQ_SQL + """, x AS (SELECT session_id, seq, unnest(results) AS m, generate_subscripts(results, 1) - 1 AS idx FROM req WHERE has_req)
SELECT session_id, seq, idx, m.name AS name, m.tool_use_id AS tool_use_id, m.output_preview AS output_preview, m.output AS output FROM x""")
def c15(spark, d):
    return Q.explode_tool_results(_requests(spark, d))


CALLS = """, calls AS (SELECT session_id, seq, m.name AS name, m.input_json AS input_json, m.tool_call_id AS tool_call_id, idx FROM
  (SELECT session_id, seq, unnest(calls) AS m, generate_subscripts(calls, 1) - 1 AS idx FROM rsp WHERE rs_provider IS NOT NULL))"""


@query("c16_explode_tool_calls", RSP_SQL + CALLS + " SELECT * FROM calls")
def c16(spark, d):
    return Q.explode_tool_calls(_responses(spark, d))


@query("j14_pair_tool_calls", BASE + READ + REQUEST.replace("{src}", "js") + RESPONSE.replace("{src}", "js") + CALLS + """,
 res AS (SELECT session_id, tool_use_id, arg_min(seq, (seq, idx)) AS result_seq, arg_min(output_preview, (seq, idx)) AS output_preview, arg_min(output, (seq, idx)) AS output FROM
   (SELECT session_id, seq, m.tool_use_id AS tool_use_id, m.output_preview AS output_preview, m.output AS output, idx FROM (SELECT session_id, seq, unnest(results) AS m, generate_subscripts(results, 1) - 1 AS idx FROM req WHERE has_req)) GROUP BY 1, 2)
SELECT c.*, result_seq, output_preview, output FROM calls c LEFT JOIN res r ON c.session_id = r.session_id AND c.tool_call_id = r.tool_use_id""")
def j14(spark, d):
    return J.pair_tool_calls(Q.explode_tool_calls(_responses(spark, d)), Q.explode_tool_results(_requests(spark, d)))


@query("j15_pair_rpc", BASE + READ + """, q AS (SELECT session_id, seq, rpc_id, rpc_method AS method FROM mcpx WHERE is_mcp AND msg_type = 'Request'),
 a AS (SELECT session_id, rpc_id, min(seq) AS response_seq, arg_min(msg_type, seq) AS response_type FROM mcpx WHERE is_mcp AND msg_type IN ('Response', 'Error') AND rpc_id IS NOT NULL GROUP BY 1, 2)
SELECT q.*, response_seq, response_type FROM q LEFT JOIN a USING (session_id, rpc_id)""")
def j15(spark, d):
    m = C.classify_mcp(C.read_payloads(payload_rows(spark, d))).filter("mcp IS NOT NULL")
    m = m.select("session_id", "seq", "mcp.rpc_id", "mcp.method", "mcp.msg_type")
    asked = m.filter("msg_type = 'Request'").drop("msg_type")
    return J.pair_rpc(asked, m.filter("msg_type IN ('Response', 'Error')"))


_PII = {n: "regexp_matches(payload_text, '" + p + "')" for n, p in rules.PII_PATTERNS}
_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_PII[n]} THEN '{n}' END" for n in rules.PII_LIST_ORDER) + "], lambda x: x IS NOT NULL)"
_E = "NULL::VARCHAR"


def _act(t, provider=_E, model=_E, user=_E, tool=_E, extra=_E, method=_E, size="NULL::BIGINT"):
    return (f"{{'type': '{t}', 'provider': {provider}, 'model': {model}, 'user_message': {user}, 'tool_name': {tool}, 'extra': {extra}, "
            f"'method': {method}, 'bytes': {size}}}")  # fmt: skip


_SIZE = "octet_length(encode(payload_text))"
_pii = lambda way: f"CASE WHEN len(pii) > 0 THEN [{_act('PiiDetected', extra=f'{chr(39)}{way}:{chr(39)} || array_to_string(pii, {chr(39)},{chr(39)})')}] ELSE [] END"
_SDK = "CASE WHEN sdk_version IS NULL THEN sdk_name ELSE sdk_name || '/' || sdk_version END"
_MODEL = "CASE WHEN content_class = 'LlmApi' OR printed THEN model END"
ACTIONS = BASE + CLASS + REQUEST.replace("{src}", "done") + RESPONSE.replace("{src}", "req") + f""", act AS (SELECT *, {_TYPES} AS pii FROM rsp),
turn_actions AS (SELECT *, CASE WHEN direction = 0 THEN
   CASE WHEN has_req THEN list_concat(list_transform(results, lambda r: {_act("ToolResult", tool="coalesce(r.name, 'unknown')", extra="r.output")}),
       [{_act("Prompt", "rq_provider", _s("jb", "$.model"), USER, extra=_SDK, size=_SIZE)}], {_pii("write")})
     WHEN content_class = 'Mcp' THEN [{_act("McpRequest", method="coalesce(rpc_method, 'unknown')", extra="category")}]
     WHEN is_interesting THEN [{_act("Prompt", "coalesce(provider, 'unknown')", _MODEL, extra=_SDK, size=_SIZE)}] ELSE [] END
   ELSE CASE WHEN rs_provider IS NOT NULL THEN list_concat(list_transform(calls, lambda c: {_act("ToolCall", "rs_provider", tool="c.name", extra="c.input_json")}),
       [{_act("Response", "rs_provider", _s("jb", "$.model"), size=_SIZE)}], {_pii("read")})
     WHEN content_class = 'Mcp' THEN [{_act("McpResponse", method="coalesce(rpc_method, 'unknown')")}]
     WHEN content_class = 'LlmStream' THEN [{_act("Response", "provider", size=_SIZE)}]
     WHEN is_interesting THEN [{_act("Response", "coalesce(provider, 'unknown')", _MODEL, size=_SIZE)}] ELSE [] END END AS acts FROM act)"""


@query("c17_turns_to_actions", ACTIONS + """, x AS (SELECT session_id, seq, unnest(acts) AS a, (generate_subscripts(acts, 1) - 1)::INT AS action_idx FROM turn_actions)
SELECT session_id, seq, action_idx, a.type AS type, a.provider AS provider, a.model AS model, a.user_message AS user_message, a.tool_name AS tool_name, a.extra AS extra, a.method AS method, a.bytes AS bytes FROM x""")
def c17(spark, d):
    t = payload_rows(spark, d).select("session_id", "seq", "direction", "sni", "payload")
    a = lambda n: F.col(f"action.{n}")
    extra = (
        F.when(a("type") == "Prompt", a("sdk")).when(a("type") == "ToolResult", a("output")).when(a("type") == "ToolCall", a("input_json"))
        .when(a("type") == "McpRequest", a("category"))
        .when(a("type") == "PiiDetected", F.concat(a("direction"), F.lit(":"), F.array_join(a("pii_types"), ",")))
    )
    names = ("type", "provider", "model", "user_message", "tool_name", "method", "bytes")
    return Q.turns_to_actions(t).select(*IDS, "action_idx", *[a(n).alias(n) for n in names], extra.alias("extra"))


def _h2_frame(size, kind, flags):
    """Nine header bytes on stream 1."""
    return F.concat(F.unhex(F.lpad(F.hex(size), 6, "0")), F.unhex(F.lit(f"{kind:02x}{flags:02x}00000001")))


def h2_chunks(spark, d):
    """The bodies of `payloads` framed as HTTP/2 (preface, SETTINGS, padded DATA), in two chunks."""
    p = payload_rows(spark, d).filter("sni IS NOT NULL AND fam < 3").drop("payload")
    b = bound(spark, d, "cutbodies").select("conv_id", "turn", F.col("doc").cast("binary").alias("doc"))
    rows = p.join(b, ["conv_id", "turn"])
    preface = F.when((F.col("turn") == 0) & (F.col("direction") == 0), F.lit(rules.H2_PREFACE.encode())).otherwise(F.lit(b""))
    size = F.octet_length("doc")
    wire = F.concat(preface, _h2_frame(F.lit(6), 4, 0), F.unhex(F.lit("00" * 6)), _h2_frame(size + 4, 0, 8), F.unhex(F.lit("03")), F.col("doc"), F.unhex(F.lit("000000")))
    cut = rows.withColumn("_wire", wire).drop("doc").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.octet_length("_wire") / 2).cast("int")
    piece = F.when(F.col("part") == 0, F.substring("_wire", F.lit(1), half)).otherwise(F.substring("_wire", half + 1, F.octet_length("_wire")))
    return (
        cut.withColumn("payload", piece).withColumn("seq", F.col("turn") * 2 + F.col("part"))
        .withColumn("timestamp_ns", F.col("timestamp_ns") + F.col("part") * 1000).drop("_wire", "part")
    )


# runs of one direction are one turn; its body is the joined documents, its size that of the frames
H2_ACTIONS = ctes("payloads") + """, h2docs AS (SELECT p.* EXCLUDE (payload_text), b.doc FROM payloads p JOIN cutbodies b ON p.conv_id = b.conv_id AND p.turn = b.turn WHERE p.sni IS NOT NULL AND p.fam < 3),
 lg AS (SELECT *, lag(direction) OVER (PARTITION BY conv_id ORDER BY turn) AS pd FROM h2docs),
 il AS (SELECT *, sum(CASE WHEN pd IS NULL OR pd <> direction THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM lg),
 h2turns AS (SELECT pid, ssl_ptr, turn_no, min(direction) AS direction, min(sni) AS sni, string_agg(doc, '' ORDER BY turn) AS payload_text,
   sum(octet_length(encode(doc)) + 9 + 6 + 9 + 4 + CASE WHEN turn = 0 AND direction = 0 THEN 24 ELSE 0 END)::BIGINT AS wire FROM il GROUP BY 1, 2, 3),
 h2js AS (SELECT *, CASE WHEN json_valid(payload_text) THEN payload_text::JSON END AS jb FROM h2turns)""" + REQUEST.replace("{src}", "h2js") + RESPONSE.replace("{src}", "req") + f""",
 act AS (SELECT *, {_TYPES} AS pii FROM rsp), turn_actions AS (SELECT *, CASE WHEN direction = 0 AND has_req THEN
   list_concat(list_transform(results, lambda r: {_act("ToolResult", tool="coalesce(r.name, 'unknown')", extra="r.output")}), [{_act("Prompt", "rq_provider", _s("jb", "$.model"), USER, size="wire")}], {_pii("write")})
   WHEN direction = 1 AND rs_provider IS NOT NULL THEN list_concat(list_transform(calls, lambda c: {_act("ToolCall", "rs_provider", tool="c.name", extra="c.input_json")}),
   [{_act("Response", "rs_provider", _s("jb", "$.model"), size="wire")}], {_pii("read")}) ELSE [] END AS acts FROM act)"""


@query("c17_h2_turns_to_actions", H2_ACTIONS + """, x AS (SELECT pid, ssl_ptr, turn_no, unnest(acts) AS a, (generate_subscripts(acts, 1) - 1)::INT AS action_idx FROM turn_actions)
SELECT pid, ssl_ptr, turn_no, action_idx, a.type AS type, a.provider AS provider, a.model AS model, a.user_message AS user_message, a.tool_name AS tool_name, a.extra AS extra, a.bytes AS bytes FROM x""")
def c17_h2(spark, d):
    """Chunks -> verdicts -> turns -> HTTP/2 bodies -> actions."""
    c = h2_chunks(spark, d)
    t = T.whole_turns(T.turns(c, T.connection_verdicts(c), segment=256))
    a = lambda n: F.col(f"action.{n}")
    extra = (
        F.when(a("type") == "ToolResult", a("output")).when(a("type") == "ToolCall", a("input_json"))
        .when(a("type") == "PiiDetected", F.concat(a("direction"), F.lit(":"), F.array_join(a("pii_types"), ",")))
    )
    names = ("type", "provider", "model", "user_message", "tool_name", "bytes")
    return Q.turns_to_actions(t).select("pid", "ssl_ptr", "turn_no", "action_idx", *[a(n).alias(n) for n in names], extra.alias("extra"))


@query("c18_mcp_capabilities", BASE + READ + f""", t AS (SELECT session_id, unnest(list_transform({_list("jb", "$.result.tools")}, lambda x: {_s("x", "$.name")})) AS tool FROM mcpx WHERE is_mcp AND msg_type = 'Response'),
 g AS (SELECT session_id, array_to_string(list_sort(list(DISTINCT tool)), chr(10)) AS tools FROM t GROUP BY 1)
SELECT session_id, tools, {fnv64("tools")} AS capability_hash FROM g""")
def c18(spark, d):
    m = C.classify_mcp(C.read_payloads(payload_rows(spark, d))).filter("mcp.msg_type = 'Response'")
    return Q.mcp_capabilities(m).withColumn("tools", F.array_join("tools", "\n"))
