"""DuckDB expressions for the oracles."""

from palisade import rules


def case_equals(expr, pairs):
    return "CASE " + " ".join(f"WHEN {expr} = '{a}' THEN '{b}'" for a, b in pairs) + " END"


def case_contains(expr, pairs):
    return "CASE " + " ".join(f"WHEN contains({expr}, '{a}') THEN '{b}'" for a, b in pairs) + " END"


def text_bytes(s):
    return (f"list_transform(range(0, octet_length(encode({s}))), lambda i: "
            f"('0x' || substr(hex(encode({s})), (2 * i + 1)::BIGINT, 2))::INT::HUGEINT)")  # fmt: skip


def fnv64_list(data):
    """Signed FNV-1a-64 of a list of numbers."""
    h = (f"list_reduce({data}, lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, "
         "14695981039346656037::HUGEINT)")  # fmt: skip
    return signed(h)


def signed(h):
    return f"(CASE WHEN ({h}) >= 9223372036854775808::HUGEINT THEN ({h}) - 18446744073709551616::HUGEINT ELSE ({h}) END)::BIGINT"


def fnv64(s):
    return fnv64_list(text_bytes(s))


def fnv32(s):
    return (f"list_reduce({text_bytes(s)}, lambda a, b: (xor(a, b) * 16777619::HUGEINT) % 4294967296::HUGEINT, "
            "2166136261::HUGEINT)::BIGINT")  # fmt: skip


def le_bytes(v, n):
    return "[" + ", ".join(f"(({v}) >> {8 * i}) & 255" for i in range(n)) + "]"


def le_unsigned(v, n):
    """Little-endian bytes of a signed BIGINT bit pattern, as HUGEINT."""
    u = f"(CASE WHEN ({v}) < 0 THEN ({v})::HUGEINT + 18446744073709551616::HUGEINT ELSE ({v})::HUGEINT END)"
    return "[" + ", ".join(f"(({u}) // {256 ** i}::HUGEINT) % 256" for i in range(n)) + "]"


REQ = r"^([A-Z]+)[ \t]+([^ \r\n]+)[ \t]+([^\r\n]+)\r\n"
STAT = r"^(HTTP/1[.][01])[ \t]+([0-9]+)[ \t]*([^\r\n]*)\r\n"
HEAD = r"^[!#$%&''*+.^_`|~0-9A-Za-z-]+:[ \t]*[^ \t\r\n][^\r\n]*$"
STR = r'"(?:[^"\\]|\\.)*'
TOKEN = rf'(?s){STR}(?:"(?:[ \t\r\n]*:[ \t\r\n]*(?:{STR}"|[0-9.eE-]+|true|false)?)?|\\?\z)'
KEYED = rf'(?s)^{STR}"[ \t\r\n]*:'
METHOD_TEST = " OR ".join(f"starts_with(text, '{m} ')" for m in rules.HTTP_METHODS)
_crlf = "chr(13) || chr(10)"


def last_raw(*keys):
    test = " OR ".join(f"e.key = '{k}'" for k in keys)
    return f"list_filter(entries, lambda e: {test})[-1].raw"


def _text(raw):
    return f"CASE WHEN starts_with({raw}, chr(34)) THEN substr({raw}, 2, length({raw}) - 2) END"


def _num(raw):
    return f"CASE WHEN regexp_matches({raw}, '^[0-9.eE-]+$') THEN TRY_CAST({raw} AS DOUBLE) END"


def _js(k):
    return f"CASE WHEN json_type(jb, '$.{k}') = 'VARCHAR' THEN json_extract_string(jb, '$.{k}') END"


_NUMT = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"


def _jn(k):
    return f"CASE WHEN json_type(jb, '$.{k}') IN {_NUMT} THEN CAST(json_extract(jb, '$.{k}') AS DOUBLE) END"


def _jw(k):
    return f"CASE WHEN json_type(jb, '$.{k}') = 'UBIGINT' THEN CAST(json_extract(jb, '$.{k}') AS BIGINT) END"


def _jb(k):
    return f"CASE WHEN json_type(jb, '$.{k}') = 'BOOLEAN' THEN CAST(json_extract(jb, '$.{k}') AS BOOLEAN) END"


def header(name):
    return (f"regexp_extract(list_filter(good, lambda s: starts_with(lower(s), '{name}:'))[-1], '^[^:]+:[ \\t]*(.*)$', 1)")


FLAGS = ["messages", "prompt", "result", "error", "choices", "content", "completion"]
_keys_c = "coalesce(list_sort(json_keys(jb)), [])"

# steps after a CTE `payloads` with payload_text, direction, sni
READ = f""", pr AS (SELECT *, payload_text AS text,
  CASE WHEN payload_text = '' THEN 'Unknown'
    WHEN direction = 1 AND (starts_with(payload_text, 'data: ') OR starts_with(payload_text, 'event: ') OR starts_with(payload_text, ': ')) THEN 'Sse'
    WHEN ({METHOD_TEST.replace("text", "payload_text")}) AND regexp_matches(payload_text, '{REQ}') THEN 'Http1Request'
    WHEN (starts_with(payload_text, 'HTTP/1.0 ') OR starts_with(payload_text, 'HTTP/1.1 ')) AND regexp_matches(payload_text, '{STAT}') THEN 'Http1Response'
    ELSE 'Unknown' END AS protocol FROM payloads),
h0 AS (SELECT *, CASE protocol WHEN 'Http1Request' THEN regexp_extract(text, '{REQ}', 0) WHEN 'Http1Response' THEN regexp_extract(text, '{STAT}', 0) END AS fst FROM pr),
h1 AS (SELECT *, substr(text, length(fst) + 1) AS rest FROM h0),
h2 AS (SELECT *, strpos(rest, {_crlf} || {_crlf}) AS blank FROM h1),
h3 AS (SELECT *, CASE WHEN starts_with(rest, {_crlf}) THEN []::VARCHAR[] WHEN blank > 0 THEN string_split(left(rest, blank - 1), {_crlf})
   ELSE list_slice(string_split(rest, {_crlf}), 1, -2) END AS lines FROM h2),
h4 AS (SELECT *, coalesce(list_position(list_transform(lines, lambda s: regexp_matches(s, '{HEAD}')), FALSE), 0) AS badpos FROM h3),
h5 AS (SELECT *, CASE WHEN badpos > 0 THEN list_slice(lines, 1, badpos - 1) ELSE lines END AS good FROM h4),
http AS (SELECT *, CASE WHEN protocol = 'Http1Request' THEN regexp_extract(fst, '{REQ}', 1) END AS method,
   CASE WHEN protocol = 'Http1Request' THEN regexp_extract(fst, '{REQ}', 2) END AS path,
   CASE WHEN protocol = 'Http1Response' THEN CAST(regexp_extract(fst, '{STAT}', 2) AS INT) END AS status_code,
   {header("host")} AS h_host, {header("user-agent")} AS h_ua, {header("authorization")} AS h_auth, {header("anthropic-version")} AS h_av, {header("content-type")} AS h_ct,
   CASE WHEN protocol IN ('Http1Request', 'Http1Response') THEN CASE WHEN (blank > 0 OR starts_with(rest, {_crlf})) AND badpos = 0
       THEN nullif(CASE WHEN starts_with(rest, {_crlf}) THEN substr(rest, 3) ELSE substr(rest, blank + 4) END, '') END
     WHEN protocol = 'Unknown' THEN text END AS body FROM h5),
j0 AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS jb FROM http),
j1 AS (SELECT *, CASE WHEN body IS NOT NULL AND jb IS NULL THEN list_transform(list_filter(regexp_extract_all(body, '{TOKEN}'),
     lambda t: regexp_matches(t, '{KEYED}')), lambda t: {{'key': regexp_extract(t, '(?s)^"((?:[^"\\\\]|\\\\.)*)"[ \\t\\r\\n]*:', 1),
     'raw': regexp_replace(t, '{KEYED}[ \\t\\r\\n]*', '')}}) END AS entries FROM j0),
js AS (SELECT *, jb IS NOT NULL AS complete,
   CASE WHEN jb IS NOT NULL THEN {_js("model")} ELSE {_text(last_raw("model"))} END AS model,
   CASE WHEN jb IS NOT NULL THEN {_jn("temperature")} ELSE {_num(last_raw("temperature"))} END AS temperature,
   CASE WHEN jb IS NOT NULL THEN coalesce({_jw("max_completion_tokens")}, {_jw("max_tokens")})
     ELSE CAST({_num(last_raw("max_tokens", "max_completion_tokens"))} AS BIGINT) END AS max_tokens,
   CASE WHEN jb IS NOT NULL THEN {_jn("top_p")} ELSE {_num(last_raw("top_p"))} END AS top_p,
   CASE WHEN jb IS NOT NULL THEN {_jb("stream")} ELSE CASE {last_raw("stream")} WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END END AS stream,
   CASE WHEN jb IS NOT NULL THEN {_js("jsonrpc")} ELSE {_text(last_raw("jsonrpc"))} END AS jsonrpc,
   CASE WHEN jb IS NOT NULL THEN {_js("method")} ELSE {_text(last_raw("method"))} END AS rpc_method,
   CASE WHEN jb IS NOT NULL THEN CASE WHEN json_type(jb, '$.id') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN json_extract_string(jb, '$.id') END
     ELSE coalesce({_text(last_raw("id"))}, ({_num(last_raw("id"))})::BIGINT::VARCHAR) END AS rpc_id,
   CASE WHEN jb IS NOT NULL THEN {_keys_c} ELSE list_transform(coalesce(entries, []), lambda e: e.key) END AS jkeys FROM j1),
flags AS (SELECT *, {", ".join(f"list_contains(jkeys, '{k}') AS has_{k}" for k in FLAGS)} FROM js),
rpc AS (SELECT *, CASE WHEN has_error AND rpc_id IS NOT NULL THEN 'Error' WHEN has_result AND rpc_id IS NOT NULL THEN 'Response'
   WHEN rpc_method IS NOT NULL AND rpc_id IS NOT NULL THEN 'Request' WHEN rpc_method IS NOT NULL THEN 'Notification' ELSE 'Response' END AS msg_type,
   coalesce({case_equals("rpc_method", rules.MCP_METHODS)}, 'Other') AS category,
   coalesce(rpc_method IN ({", ".join(f"'{m}'" for m, _ in rules.MCP_METHODS)}) OR {" OR ".join(f"starts_with(rpc_method, '{p}')" for p in rules.MCP_PREFIXES)}, FALSE) AS known FROM flags),
mcpx AS (SELECT *, coalesce(jsonrpc = '2.0', FALSE) AND (known OR msg_type IN ('Response', 'Error')) AS is_mcp,
   {case_contains("lower(sni)", rules.RESPONSE_SNI)} AS sni_p,
   CAST(has_messages AS INT) + CAST(has_prompt AS INT) + CAST(has_choices AS INT) + CAST(has_content AS INT) + CAST(has_completion AS INT)
     + CAST(model IS NOT NULL AS INT) + CAST(temperature IS NOT NULL AS INT) + CAST(max_tokens IS NOT NULL AS INT) AS n,
   coalesce(sni, h_host) AS hostname FROM rpc),
resp AS (SELECT *, CASE WHEN has_choices THEN coalesce(sni_p, 'OpenAI') WHEN has_content AND model IS NOT NULL THEN coalesce(sni_p, 'Anthropic')
     WHEN has_completion THEN coalesce(sni_p, 'Unknown') END AS resp_provider,
   CASE WHEN has_choices THEN 'chat_completions' WHEN has_content AND model IS NOT NULL THEN 'messages' WHEN has_completion THEN 'completions' END AS resp_endpoint,
   CASE WHEN contains(text, 'data: {{') OR contains(text, 'data:{{') THEN CASE
     WHEN contains(text, 'event: message_start') OR contains(text, 'event: content_block') OR contains(text, '"type":"message_start"') OR contains(text, '"type":"content_block_delta"') THEN coalesce(sni_p, 'Anthropic')
     WHEN contains(text, '"choices"') OR contains(text, '"delta"') OR contains(text, 'data: [DONE]') THEN coalesce(sni_p, 'OpenAI')
     WHEN contains(text, '"model"') OR contains(text, '"content"') THEN coalesce(sni_p, 'Unknown') END END AS sse_provider FROM mcpx)"""


def _rule_case(i):
    ordered = [r for r in rules.ENDPOINT_RULES if r[0]] + [r for r in rules.ENDPOINT_RULES if not r[0]]
    arms = []
    for r in ordered:
        test = [f"starts_with(path, '{r[1]}')"]
        if r[0]:
            test.append(f"contains(hostname, '{r[0]}')")
        if r[2]:
            test.append(f"method = '{r[2]}'")
        arms.append(f"WHEN {' AND '.join(test)} THEN '{r[i]}'")
    return "CASE " + " ".join(arms) + " END"


CLASS = READ + f""", ep AS (SELECT *, {_rule_case(3)} AS ep_provider, {_rule_case(4)} AS ep_endpoint FROM resp),
cls AS (SELECT *, CASE protocol
   WHEN 'Http1Request' THEN CASE WHEN is_mcp THEN 'Mcp' WHEN ep_provider IS NOT NULL THEN 'LlmApi' WHEN jsonrpc IS NOT NULL THEN 'JsonRpc' WHEN n >= 2 THEN 'LlmApi' ELSE 'GenericHttp' END
   WHEN 'Http1Response' THEN CASE WHEN is_mcp THEN 'Mcp' WHEN resp_provider IS NOT NULL THEN 'LlmApi' WHEN jsonrpc IS NOT NULL THEN 'JsonRpc' ELSE 'GenericHttp' END
   WHEN 'Sse' THEN CASE WHEN sse_provider IS NOT NULL THEN 'LlmStream' ELSE 'GenericHttp' END
   ELSE CASE WHEN is_mcp THEN 'Mcp' WHEN resp_provider IS NOT NULL THEN 'LlmApi' WHEN n >= 2 THEN 'LlmApi' WHEN sse_provider IS NOT NULL THEN 'LlmStream' END END AS content_class FROM ep),
fin AS (SELECT *, CASE WHEN content_class = 'LlmStream' THEN sse_provider WHEN content_class = 'LlmApi' THEN CASE WHEN protocol = 'Http1Request' THEN coalesce(ep_provider, 'Unknown') ELSE coalesce(resp_provider, 'Unknown') END END AS provider,
   CASE WHEN content_class = 'LlmApi' THEN CASE WHEN protocol = 'Http1Request' THEN coalesce(ep_endpoint, 'unknown') ELSE coalesce(resp_endpoint, 'unknown') END END AS endpoint,
   round(CASE protocol
     WHEN 'Http1Request' THEN CASE WHEN is_mcp THEN 0.95 WHEN ep_provider IS NOT NULL THEN 0.9 WHEN jsonrpc IS NOT NULL THEN 0.6 WHEN n >= 2 THEN 0.5 + least(n * 0.1, 0.4) ELSE 0.3 END
     WHEN 'Http1Response' THEN CASE WHEN is_mcp THEN 0.9 WHEN resp_provider IS NOT NULL THEN 0.85 WHEN jsonrpc IS NOT NULL THEN 0.6 ELSE 0.3 END
     WHEN 'Sse' THEN CASE WHEN sse_provider IS NOT NULL THEN 0.85 ELSE 0.3 END
     ELSE CASE WHEN is_mcp THEN 0.8 WHEN resp_provider IS NOT NULL THEN 0.7 WHEN n >= 2 THEN 0.4 + least(n * 0.1, 0.3) WHEN sse_provider IS NOT NULL THEN 0.7 ELSE 0.0 END END::DOUBLE, 6) AS confidence,
   coalesce(content_class <> 'GenericHttp', FALSE) AS is_interesting, protocol = 'Http1Request' AND content_class <> 'GenericHttp' AS printed,
   {case_contains("lower(h_ua)", rules.SDK_PATTERNS)} AS sdk_name0,
   {case_contains("lower(h_ua)", [(p, p) for p, _ in rules.SDK_PATTERNS])} AS needle FROM cls),
done AS (SELECT *, CASE WHEN printed THEN sdk_name0 END AS sdk_name,
   CASE WHEN printed THEN nullif(regexp_extract(substr(h_ua, strpos(lower(h_ua), needle) + length(needle)), '^[/ ]([A-Za-z0-9.-]+)', 1), '') END AS sdk_version,
   list_sort(list_distinct(list_filter(list_transform(good, lambda s: lower(regexp_extract(s, '^([^:]+):', 1))), lambda x: x IN ({", ".join(f"'{h}'" for h in rules.KEPT_HEADERS)})))) AS hnames FROM fin)"""

PII = {name: "regexp_matches({t}, '" + pattern + "')" for name, pattern in rules.PII_PATTERNS}


def pii_columns(t):
    return ", ".join(f"{PII[n].format(t=t) if '{t}' in PII[n] else PII[n]} AS has_{n}" for n in PII)
