"""Payload classification: protocol, HTTP parts, JSON fields, content class, PII, SDK fingerprint.

Input rows carry `payload` (BINARY), `direction` (0 write, 1 read) and `sni` (nullable).
All rules are Column expressions; nothing leaves the JVM and nothing shuffles."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import rules
from palisade.functions.hashing import fnv32, fnv64
from palisade.functions.jsonfields import with_json_fields
from palisade.functions.text import contains_first, lossy_text
from palisade.operators.enrich import endpoint_match, mcp_category, mcp_known, sdk_match
from palisade.operators.normalize import mask_authorization
from palisade.plans.stage import settle

_REQUEST_LINE = r"^([A-Z]+)[ \t]+([^ \r\n]+)[ \t]+([^\r\n]+)\r\n"
_STATUS_LINE = r"^(HTTP/1\.[01])[ \t]+([0-9]+)[ \t]*([^\r\n]*)\r\n"
_HEADER_LINE = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+:[ \t]*[^ \t\r\n][^\r\n]*$"


def _starts(text: Column, *prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def _byte(raw: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")


def is_h2(raw: Column) -> Column:
    """HTTP/2 preface, or nine bytes shaped like a frame header."""
    preface = F.substring(raw, 1, len(rules.H2_PREFACE)) == F.lit(rules.H2_PREFACE.encode())
    frame = (
        (F.octet_length(raw) >= 9)
        & (_byte(raw, 4) <= 9)
        & (F.hex(F.substring(raw, 1, 3)) != "000000")
        & (_byte(raw, 6) < 128)
    )
    return F.coalesce(preface | frame, F.lit(False))


def detect_protocol(payloads: DataFrame) -> DataFrame:
    """Add `text` and `protocol`."""
    raw, text = F.col("payload"), F.col("text")
    as_string = raw.cast("string")
    valid = F.is_valid_utf8(as_string)
    printable = F.hex(raw).rlike(r"^(?:(?!0[0-8]|7F)..)*+$")
    protocol = (
        F.when(F.octet_length(raw) == 0, "Unknown")
        .when(is_h2(raw), "Http2Binary")
        .when((F.col("direction") == 1) & valid & _starts(text, "data: ", "event: ", ": "), "Sse")
        .when(_starts(text, *[m + " " for m in rules.HTTP_METHODS]) & text.rlike(_REQUEST_LINE), "Http1Request")
        .when(_starts(text, "HTTP/1.0 ", "HTTP/1.1 ") & text.rlike(_STATUS_LINE), "Http1Response")
        .when(valid | printable, "Unknown")
        .otherwise("Binary")
    )
    return settle(settle(payloads, text=lossy_text(raw)), protocol=protocol)


def parse_http(detected: DataFrame) -> DataFrame:
    """Add method, path, status_code, headers and body. `body` is the text to look for JSON in:
    what follows complete headers, or the whole text when there is no HTTP framing."""
    text, protocol = F.col("text"), F.col("protocol")
    is_req, is_resp = protocol == "Http1Request", protocol == "Http1Response"
    first_line = F.when(is_req, F.regexp_extract(text, _REQUEST_LINE, 0)).when(is_resp, F.regexp_extract(text, _STATUS_LINE, 0))
    rest, lines, good = F.col("_rest"), F.col("_lines"), F.col("_good")
    blank = F.instr(rest, "\r\n\r\n")
    none = F.array().cast("array<string>")
    cut = F.split(rest, "\r\n")
    header_lines = (
        F.when(F.startswith(rest, F.lit("\r\n")), none)
        .when(blank > 0, F.split(F.left(rest, blank - 1), "\r\n"))
        .otherwise(F.slice(cut, F.lit(1), F.size(cut) - 1))
    )
    first_bad = F.array_position(F.transform(lines, lambda s: s.rlike(_HEADER_LINE)), F.lit(False)).cast("int")
    kept = F.when(first_bad > 0, F.slice(lines, F.lit(1), first_bad - 1)).otherwise(lines)
    value_of = lambda name: F.regexp_extract(
        F.try_element_at(F.filter(good, lambda s: F.startswith(F.lower(s), F.lit(name + ":"))), F.lit(-1)),
        r"^[^:]+:[ \t]*(.*)$", 1,
    )

    def masked(name):
        v = value_of(name)
        if name == "authorization":
            return mask_authorization(v)
        return F.when(v.isNotNull(), F.lit("[present]")) if name == "x-api-key" else v

    present = lambda name, v: F.when(value_of(name).isNotNull(), v)
    pairs = [x for name in rules.KEPT_HEADERS for x in (F.lit(name), present(name, masked(name)))]
    headers = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    complete = F.startswith(rest, F.lit("\r\n")) | (blank > 0)
    after = F.when(F.startswith(rest, F.lit("\r\n")), F.substr(rest, F.lit(3))).otherwise(F.substr(rest, blank + 4))
    http_body = F.when(complete & (F.size(good) == F.size(lines)), F.nullif(after, F.lit("")))
    # an SSE stream and binary frames are not looked at as JSON
    body = F.when(is_req | is_resp, http_body).when(protocol.isin("Unknown", "Binary"), text)

    staged = settle(detected, _first=first_line)
    staged = settle(staged, _rest=F.substr(text, F.length("_first") + 1))
    staged = settle(settle(staged, _lines=header_lines), _good=kept)
    return settle(
        staged,
        method=F.when(is_req, F.regexp_extract("_first", _REQUEST_LINE, 1)),
        path=F.when(is_req, F.regexp_extract("_first", _REQUEST_LINE, 2)),
        status_code=F.when(is_resp, F.regexp_extract("_first", _STATUS_LINE, 2).try_cast("int")),
        headers=F.when(is_req | is_resp, headers),
        body=body,
    ).drop("_first", "_rest", "_lines", "_good")


def extract_json_fields(bodies: DataFrame, body: str = "body") -> DataFrame:
    return with_json_fields(bodies, body)


# ---------------------------------------------------------------- classes of one body


def _j(name: str) -> Column:
    return F.col(f"j_{name}")


def rpc_message_type() -> Column:
    has_id, has_method = _j("id").isNotNull(), _j("method").isNotNull()
    return (
        F.when(_j("has_error") & has_id, "Error")
        .when(_j("has_result") & has_id, "Response")
        .when(has_method & has_id, "Request")
        .when(has_method, "Notification")
        .otherwise("Response")
    )


def is_mcp() -> Column:
    answer = rpc_message_type().isin("Response", "Error")
    return F.coalesce(_j("jsonrpc") == "2.0", F.lit(False)) & (mcp_known(_j("method")) | answer)


def classify_mcp(df: DataFrame) -> DataFrame:
    """Add `mcp`: struct(method, category, msg_type, rpc_id), null when the body is no MCP message."""
    info = F.struct(
        _j("method").alias("method"),
        mcp_category(_j("method")).alias("category"),
        rpc_message_type().alias("msg_type"),
        _j("id").alias("rpc_id"),
    )
    return settle(df, mcp=F.when(is_mcp(), info))


def _sni_or(default: str) -> Column:
    return F.coalesce(F.col("sni_provider"), F.lit(default))


def with_sni_provider(df: DataFrame) -> DataFrame:
    """Provider named by the server name, for payloads that carry no request line."""
    if "sni_provider" in df.columns:
        return df
    return settle(df, sni_provider=contains_first(F.lower(F.col("sni")), rules.RESPONSE_SNI))


def response_match() -> tuple[Column, Column]:
    """(provider, endpoint) that the shape of a response body names, else nulls."""
    chat, message, legacy = _j("has_choices"), _j("has_content") & _j("model").isNotNull(), _j("has_completion")
    provider = F.when(chat, _sni_or("OpenAI")).when(message, _sni_or("Anthropic")).when(legacy, _sni_or("Unknown"))
    endpoint = F.when(chat, "chat_completions").when(message, "messages").when(legacy, "completions")
    return provider, endpoint


def infer_llm_response(df: DataFrame) -> DataFrame:
    provider, endpoint = response_match()
    return settle(with_sni_provider(df), response_provider=provider, response_endpoint=endpoint)


def _has(text: Column, *needles) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def sse_provider(text: Column) -> Column:
    found = (
        F.when(
            _has(text, "event: message_start", "event: content_block", '"type":"message_start"', '"type":"content_block_delta"'),
            _sni_or("Anthropic"),
        )
        .when(_has(text, '"choices"', '"delta"', "data: [DONE]"), _sni_or("OpenAI"))
        .when(_has(text, '"model"', '"content"'), _sni_or("Unknown"))
    )
    return F.when(_has(text, "data: {", "data:{"), found)


def detect_sse(df: DataFrame) -> DataFrame:
    return settle(with_sni_provider(df), sse_provider=sse_provider(F.col("text")))


def indicator_score() -> Column:
    present = [_j(f"has_{k}") for k in ("messages", "prompt", "choices", "content", "completion")]
    present += [_j(k).isNotNull() for k in ("model", "temperature", "max_tokens")]
    return reduce(lambda a, b: a + b, [p.cast("int") for p in present])


def llm_indicator_score(df: DataFrame) -> DataFrame:
    return settle(df, indicators=indicator_score())


# ---------------------------------------------------------------- personal data


# Substrings or short patterns without which a PII pattern cannot match; they spare most texts
# the costly patterns. Every phone number, card number and SSN holds four digits in a row.
_FOUR_DIGITS = "[0-9]{4}"


def pii_flags(text: Column, digits: Column) -> dict[str, Column]:
    needs = {"email": text.contains("@"), "api_key": text.contains("sk-") | text.contains("api")}
    return {
        name: F.coalesce(needs.get(name, digits) & text.rlike(pattern), F.lit(False)) for name, pattern in rules.PII_PATTERNS
    }


def scan_pii(df: DataFrame, column: str = "text") -> DataFrame:
    """Add has_<kind> flags, pii_pattern_count, pii_any and the ordered pii_types."""
    text = F.col(column)
    staged = settle(df, _digits=text.rlike(_FOUR_DIGITS))
    flagged = settle(staged, **{f"has_{n}": c for n, c in pii_flags(text, F.col("_digits")).items()}).drop("_digits")
    names = [n for n, _ in rules.PII_PATTERNS]
    count = reduce(lambda a, b: a + b, [F.col(f"has_{n}").cast("int") for n in names])
    types = F.array_compact(F.array(*[F.when(F.col(f"has_{n}"), n) for n in rules.PII_LIST_ORDER]))
    return (
        flagged.withColumn("pii_pattern_count", count)
        .withColumn("pii_any", F.col("pii_pattern_count") > 0)
        .withColumn("pii_types", types)
    )


# ---------------------------------------------------------------- fingerprint


def fingerprint_sdk(messages: DataFrame) -> DataFrame:
    """Add sdk_name, sdk_version, sdk, api_version, sdk_hash, model_hash, signature_hash."""
    name, version = sdk_match(F.col("headers")["user-agent"])
    header_names = F.array_join(F.array_sort(F.map_keys("headers")), "")
    keys = F.coalesce(F.array_join("j_keys", ""), F.lit(""))
    shape = F.concat(F.col("method"), F.col("path"), header_names, keys)
    named = settle(messages, sdk_name=name, sdk_version=version)
    return settle(
        named,
        sdk=F.nullif(F.concat_ws("/", "sdk_name", "sdk_version"), F.lit("")),
        api_version=F.col("headers")["anthropic-version"],
        sdk_hash=F.when(F.col("sdk_name").isNotNull(), fnv32(F.col("sdk_name"))),
        model_hash=F.when(_j("model").isNotNull(), fnv32(_j("model"))),
        signature_hash=F.when(F.col("method").isNotNull(), fnv64(shape)),
    )


# ---------------------------------------------------------------- the cascade


def read_payloads(payloads: DataFrame) -> DataFrame:
    """Protocol, HTTP parts and JSON fields of each payload."""
    return extract_json_fields(parse_http(detect_protocol(payloads)))


def classify_payloads(payloads: DataFrame, with_fingerprint=True) -> DataFrame:
    """Add content_class, provider, endpoint, model, streaming, mcp_*, confidence, is_interesting,
    PII flags and (for classified requests) the fingerprint columns."""
    read = with_sni_provider(scan_pii(read_payloads(payloads)))
    req_provider, req_endpoint = endpoint_match(F.col("sni"), F.col("headers")["host"], F.col("method"), F.col("path"))
    resp_provider, resp_endpoint = response_match()
    staged = settle(
        read, _mcp=is_mcp(), _rqp=req_provider, _rqe=req_endpoint, _rsp=resp_provider, _rse=resp_endpoint,
        _sse=sse_provider(F.col("text")), _n=indicator_score(), _utf8=F.is_valid_utf8(F.col("payload").cast("string")),
    )
    n, protocol = F.col("_n"), F.col("protocol")
    rpc, answered, sse = _j("jsonrpc").isNotNull(), F.col("_rsp").isNotNull(), F.col("_sse").isNotNull()
    request = (
        F.when(F.col("_mcp"), "request_mcp")
        .when(F.col("_rqp").isNotNull(), "request_endpoint")
        .when(rpc, "jsonrpc")
        .when(n >= 2, "request_likely")
        .otherwise("generic")
    )
    response = F.when(F.col("_mcp"), "response_mcp").when(answered, "response_body").when(rpc, "jsonrpc").otherwise("generic")
    raw = (
        F.when(F.col("_mcp"), "raw_mcp")
        .when(answered, "raw_body")
        .when(n >= 2, "raw_likely")
        .when(sse & F.col("_utf8"), "raw_sse")
        .otherwise("nothing")
    )
    case = (
        F.when(protocol == "Http1Request", request)
        .when(protocol == "Http1Response", response)
        .when(protocol == "Sse", F.when(sse, "sse").otherwise("generic"))
        .when(protocol == "Http2Binary", "h2")
        .otherwise(raw)
    )
    decided = settle(staged, _case=case)
    is_case = lambda *names: F.col("_case").isin(*names)
    likely = is_case("request_likely", "raw_likely")
    by_body = is_case("response_body", "raw_body")
    known = F.when(likely & is_case("request_likely"), F.lit(0.5) + F.least(n * F.lit(0.1), F.lit(0.4)))
    known = known.when(likely, F.lit(0.4) + F.least(n * F.lit(0.1), F.lit(0.3))).when(is_case("h2"), rules.CONFIDENCE["generic"])
    for name, value in rules.CONFIDENCE.items():
        known = known.when(is_case(name), value)
    decided = settle(
        decided,
        content_class=F.when(is_case("request_mcp", "response_mcp", "raw_mcp"), "Mcp")
        .when(likely | by_body | is_case("request_endpoint"), "LlmApi")
        .when(is_case("sse", "raw_sse"), "LlmStream")
        .when(is_case("jsonrpc"), "JsonRpc")
        .when(is_case("generic"), "GenericHttp"),
        provider=F.when(is_case("request_endpoint"), F.col("_rqp"))
        .when(by_body, F.col("_rsp"))
        .when(likely, "Unknown")
        .when(is_case("sse", "raw_sse"), F.col("_sse")),
        endpoint=F.when(is_case("request_endpoint"), F.col("_rqe")).when(by_body, F.col("_rse")).when(likely, "unknown"),
        confidence=F.round(known.otherwise(0.0), 6),
    )
    cls = F.col("content_class")
    fingerprinted = (protocol == "Http1Request") & (cls != "GenericHttp")
    done = settle(
        decided,
        is_interesting=F.coalesce(cls != "GenericHttp", F.lit(False)),
        streaming=F.when((cls == "LlmApi") & (protocol != "Http1Response"), _j("stream")),
        mcp_method=F.when(cls == "Mcp", _j("method")),
        mcp_category=F.when(cls == "Mcp", mcp_category(_j("method"))),
        model=F.when((cls == "LlmApi") | fingerprinted, _j("model")),
    )
    if with_fingerprint:
        printed = ["sdk", "sdk_name", "sdk_version", "sdk_hash", "model_hash", "signature_hash", "api_version"]
        done = settle(fingerprint_sdk(done), **{name: F.when(fingerprinted, F.col(name)) for name in printed})
    return done.drop("_mcp", "_rqp", "_rqe", "_rsp", "_rse", "_sse", "_n", "_utf8", "_case", "sni_provider")
