"""Raw records to enriched events, and per-event projections."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import rules, schemas
from palisade.functions.hashing import fnv32
from palisade.functions.text import contains_first, equals_first, human_bytes, lossy_text, shorten

# Names of event codes, kinds and arrows
NETWORK_KINDS = {1: "Connect", 2: "DataSent", 3: "DataReceived", 4: "Close", 5: "DnsQuery"}
KIND_EVENT_TYPES = {
    "Connect": "TCP_CONNECT",
    "Close": "CONNECTION_CLOSED",
    "DataSent": "DATA_SENT",
    "DataReceived": "DATA_RECEIVED",
    "DnsQuery": "DNS_QUERY",
}
EVENT_TYPES = {
    "Prompt": "PROMPT",
    "Response": "RESPONSE",
    "ToolCall": "TOOL_CALL",
    "ToolResult": "TOOL_RESULT",
    "McpRequest": "MCP_REQUEST",
    "McpResponse": "MCP_RESPONSE",
    "PiiDetected": "PII_DETECTED",
    "FileAccess": "FILE_ACCESS",
    "FileData": "FILE_DATA",
}
CONTENT_CLASSES = {
    "Prompt": "LlmApi",
    "Response": "LlmApi",
    "ToolCall": "LlmApi",
    "ToolResult": "LlmApi",
    "McpRequest": "Mcp",
    "McpResponse": "Mcp",
    "FileAccess": "FileAccess",
    "FileData": "FileData",
}
ARROWS = {
    "Prompt": ">>>",
    "Response": "<<<",
    "ToolCall": "<~>",
    "ToolResult": "~>",
    "McpRequest": "-->",
    "McpResponse": "<--",
    "PiiDetected": "!!!",
    "Network": "---",
    "FileAccess": "[o]",
}


def struct_of(schema, /, **given) -> Column:
    """Struct with every field of `schema`; fields not given are null."""
    unknown = set(given) - set(schema.names)
    if unknown:
        raise ValueError(f"not in schema: {sorted(unknown)}")
    return F.struct(
        *[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def action_of(variant: str, /, **given) -> Column:
    return struct_of(schemas.ACTION, type=F.lit(variant), **given)


def process_of(container=None, **given) -> Column:
    return struct_of(
        schemas.PROCESS,
        pid=F.col("pid"),
        uid=given.get("uid", F.col("uid")),
        name=F.col("comm"),
        container_id=F.lit("") if container is None else container,
        cgroup_id=given.get("cgroup_id", F.col("cgroup_id")),
    )


def _event(df, session: Column, process: Column, action: Column, policy=None, keep=()) -> DataFrame:
    return df.select(
        *([F.col("event_id")] if "event_id" in df.columns else []),
        F.timestamp_micros(whole_micros(F.col("timestamp_ns"))).alias("timestamp"),
        session.alias("session_id"),
        (F.lit(None).cast("string") if policy is None else policy).alias("policy"),
        process.alias("process"),
        F.lit(None).cast(schemas.IDENTITY).alias("identity"),
        action.alias("action"),
        *[F.col(c) for c in keep],
    )


def whole_micros(ns: Column) -> Column:
    # integer division: epoch nanoseconds do not fit a double
    return F.call_function("div", ns, F.lit(1000).cast("bigint"))


def network_kind(code: Column) -> Column:
    chain = None
    for value, name in NETWORK_KINDS.items():
        chain = F.when(code == value, name) if chain is None else chain.when(code == value, name)
    return chain.otherwise("Connect")


def normalize_network(raw: DataFrame, keep=()) -> DataFrame:
    """Network records -> events. Optional columns provider, sni, policy are carried when present."""
    opt = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    action = action_of(
        "Network",
        kind=network_kind(F.col("event_type")),
        src_ip=F.col("saddr"),
        src_port=F.col("sport"),
        dst_ip=F.col("daddr"),
        dst_port=F.col("dport"),
        bytes=F.col("bytes"),
        provider=opt("provider"),
        sni=opt("sni"),
    )
    session = F.concat(F.col("pid").cast("string"), F.lit(":net"))
    return _event(raw, session, process_of(F.col("container_id")), action, opt("policy").cast("string"), keep)


def open_mode(flags: Column) -> Column:
    low = flags.bitwiseAND(3)
    return F.when(low == 0, "read").when(low == 1, "write").when(low == 2, "readwrite").otherwise("unknown")


def file_reason(path: Column, pid_tracked: Column) -> Column:
    by_path = contains_first(path, [(p, f"path_pattern:{p}") for p in rules.AI_PATH_PATTERNS])
    return F.when(F.coalesce(pid_tracked, F.lit(False)), F.lit("pid_tracked")).otherwise(by_path)


def tag_file_reason(file_access: DataFrame, tracked: str = "pid_tracked") -> DataFrame:
    flag = F.col(tracked) if tracked in file_access.columns else F.lit(False)
    return file_access.withColumn("reason", file_reason(F.col("path"), flag))


def normalize_file_access(raw: DataFrame) -> DataFrame:
    tagged = raw if "reason" in raw.columns else tag_file_reason(raw)
    action = action_of("FileAccess", path=F.col("path"), mode=open_mode(F.col("flags")), reason=F.col("reason"))
    return _event(tagged, F.concat(F.col("pid").cast("string"), F.lit(":file")), process_of(), action)


def normalize_file_data(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """File contents as events. `truncated` where the record holds fewer bytes than were moved,
    or (with a cap, as a capture probe has) where the cap cut them."""
    kept = F.octet_length("payload") if cap is None else F.least(F.octet_length("payload"), F.lit(cap))
    length = F.least(F.col("payload_len"), kept)
    action = action_of(
        "FileData",
        path=F.col("path"),
        direction=F.when(F.col("direction") == 0, "write").otherwise("read"),
        content=lossy_text(F.substring(F.col("payload"), F.lit(1), length.cast("int"))),
        bytes=F.col("payload_len"),
        truncated=F.when(F.col("payload_len") > kept, F.lit(True)),
    )
    return _event(raw, F.concat(F.col("pid").cast("string"), F.lit(":file")), process_of(), action)


def tls_session_id(pid: Column, ssl_ptr: Column) -> Column:
    return F.concat(pid.cast("string"), F.lit(":"), F.lower(F.hex(ssl_ptr)))


def normalize_tls_actions(actions: DataFrame, keep=()) -> DataFrame:
    """Session actions (pid, comm, ssl_ptr, timestamp_ns, action struct) -> events."""
    process = process_of(uid=F.lit(0), cgroup_id=F.lit(0))
    return _event(actions, tls_session_id(F.col("pid"), F.col("ssl_ptr")), process, F.col("action"), keep=keep)


def with_event_time(raw: DataFrame, boot_epoch_ns: str = "boot_epoch_ns") -> DataFrame:
    """Boot-relative nanoseconds + boot epoch -> timestamp and HH:mm:ss.SSS."""
    wall_us = whole_micros(F.col("timestamp_ns") + F.col(boot_epoch_ns))
    return raw.withColumn("timestamp", F.timestamp_micros(wall_us)).withColumn(
        "time_text", F.date_format("timestamp", "HH:mm:ss.SSS")
    )


# ---------------------------------------------------------------- event attributes


def _for(types, field) -> Column:
    return F.when(F.col("action.type").isin(*types), F.col(f"action.{field}"))


def _named(table, key: Column) -> Column:
    return equals_first(key, list(table.items()))


def attribute(name: str) -> Column:
    """One derived attribute of an event; null when the variant does not carry it."""
    t = F.col("action.type")
    if name == "provider":
        return _for(["Prompt", "Response", "ToolCall", "Network"], "provider")
    if name == "model":
        return _for(["Prompt", "Response"], "model")
    if name in ("sdk", "system_prompt", "user_message", "sdk_hash", "model_hash", "fingerprint"):
        return _for(["Prompt"], name)
    if name == "sni":
        return _for(["Prompt", "Response", "Network"], "sni")
    if name == "mcp_method":
        return _for(["McpRequest", "McpResponse"], "method")
    if name == "mcp_category":
        return _for(["McpRequest"], "category")
    if name == "pii_detected":
        flagged = (t == "Prompt") & F.coalesce(F.col("action.pii_detected"), F.lit(False))
        return F.coalesce((t == "PiiDetected") | flagged, F.lit(False))
    if name == "action_type":
        return t
    if name == "bytes":
        return F.coalesce(_for(["Prompt", "Response", "Network", "FileData"], "bytes"), F.lit(0).cast("bigint"))
    if name == "content_class":
        return _named(CONTENT_CLASSES, t)
    if name == "event_type":
        return F.when(t == "Network", _named(KIND_EVENT_TYPES, F.col("action.kind"))).otherwise(_named(EVENT_TYPES, t))
    if name == "file_path":
        return _for(["FileAccess", "FileData"], "path")
    raise KeyError(name)


ATTRIBUTES = [
    "provider", "model", "sdk", "system_prompt", "user_message", "sni", "sdk_hash", "model_hash", "fingerprint",
    "mcp_method", "mcp_category", "pii_detected", "action_type", "bytes", "content_class", "event_type", "file_path",
]


def event_attributes(events: DataFrame, keep=("event_id",)) -> DataFrame:
    return events.select(*keep, *[attribute(a).alias(a) for a in ATTRIBUTES])


def provider_tag(provider: Column) -> Column:
    """Known provider name or 'Other'; null stays null."""
    return F.when(
        provider.isNotNull(), F.coalesce(equals_first(F.lower(provider), rules.PROVIDER_TAGS), F.lit("Other"))
    )


def normalize_provider_tag(df: DataFrame, column="provider", out="provider_tag") -> DataFrame:
    return df.withColumn(out, provider_tag(F.col(column)))


def category_tag(category: Column) -> Column:
    return F.coalesce(equals_first(F.lower(category), rules.MCP_CATEGORY_TAGS), F.lit("Other"))


def normalize_mcp_category(df: DataFrame, column="category", out="category_tag") -> DataFrame:
    return df.withColumn(out, category_tag(F.col(column)))


def to_identity_actions(events: DataFrame) -> DataFrame:
    """Events that say something about an identity, with label, provider tag and stream flag."""
    t, kind = F.col("action.type"), F.col("action.kind")
    has_provider = F.col("action.provider").isNotNull()
    label = (
        F.when(t == "PiiDetected", "PiiDetected")
        .when(t.isin("McpRequest", "McpResponse"), "McpCall")
        .when(t.isin("Prompt", "ToolCall"), "LlmCall")
        .when(t == "Response", "LlmStreamRecv")
        .when((t == "Network") & (kind == "Connect") & has_provider, "Connect")
        .when((t == "Network") & (kind == "Close") & has_provider, "Disconnect")
    )
    tagged = label.isin("LlmCall", "LlmStreamRecv", "Connect")
    return (
        events.withColumn("label", label)
        .filter(F.col("label").isNotNull())
        .withColumn("action_provider", F.when(tagged, F.coalesce(provider_tag(F.col("action.provider")), F.lit("Other"))))
        .withColumn("streaming", (t == "Prompt") & F.coalesce(F.col("action.stream"), F.lit(False)))
        .withColumn("category_tag", F.when(t == "McpRequest", category_tag(F.col("action.category"))).when(t == "McpResponse", "Other"))
        .withColumn("method_hash", F.when(t.isin("McpRequest", "McpResponse"), fnv32(F.col("action.method"))))
    )


def symbolize(network: DataFrame, out="symbol") -> DataFrame:
    """kind * 30 + size bucket * 5 + port class, 0..179."""
    code, size, port = F.col("event_type"), F.col("bytes"), F.col("dport")
    kind = F.when(code.between(1, 5), code.cast("int") - 1).otherwise(5)
    bucket = (
        F.when(size == 0, 0).when(size < 128, 1).when(size < 1024, 2).when(size < 8192, 3).when(size < 65536, 4).otherwise(5)
    )
    cls = F.when(port == 443, 0).when(port == 80, 1).when(port == 53, 2).when(port < 1024, 3).otherwise(4)
    return network.withColumn(out, (kind * 30 + bucket * 5 + cls).cast("int"))


def mask_authorization(value: Column) -> Column:
    long_enough = F.octet_length(value) > 12
    return F.when(
        long_enough, F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(4)))
    ).otherwise("[redacted]")


def redact_headers(messages: DataFrame, column="headers") -> DataFrame:
    """Keep the listed headers only; mask authorization, hide the API key."""
    kept = F.map_filter(F.col(column), lambda k, _: k.isin(*rules.KEPT_HEADERS))
    masked = F.transform_values(
        kept, lambda k, v: F.when(k == "authorization", mask_authorization(v)).when(k == "x-api-key", "[present]").otherwise(v)
    )
    return messages.withColumn(column, masked)


# ---------------------------------------------------------------- rendering


def render_event_lines(events: DataFrame, verbose=False, keep=("event_id",)) -> DataFrame:
    """One text per event (several lines where the variant shows messages)."""
    a = lambda f: F.col(f"action.{f}")
    text = lambda c: F.coalesce(c, F.lit(""))
    cut = (lambda c, n: c) if verbose else shorten
    head = F.concat_ws(
        " ",
        F.date_format("timestamp", "HH:mm:ss"),
        F.col("process.name"),
        F.concat(F.lit("("), F.col("process.pid").cast("string"), F.lit(")")),
    )
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    flags = F.array_compact(
        F.array(
            F.concat(F.lit("sdk:"), a("sdk")),
            F.when(F.coalesce(a("stream"), F.lit(False)), "stream"),
            F.when(F.coalesce(a("pii_detected"), F.lit(False)), "PII!"),
            F.when(F.col("policy") != "allow", F.concat(F.lit("policy:"), F.col("policy"))),
        )
    )
    bracket = F.when(F.size(flags) > 0, F.concat(F.lit(" ["), F.array_join(flags, " | "), F.lit("]"))).otherwise("")
    prompt = F.concat_ws(
        "\n",
        say(">>> ", a("provider"), " ", text(a("model")), bracket),
        F.concat(F.lit("  user: "), cut(a("user_message"), 120)),
        F.concat(F.lit("  system: "), cut(a("system_prompt"), 120)),
    )
    category = F.coalesce(F.concat(F.lit(" ("), a("category"), F.lit(")")), F.lit(""))
    reason = F.coalesce(F.concat(F.lit(" ["), a("reason"), F.lit("]")), F.lit(""))
    mark = F.when(F.coalesce(a("truncated"), F.lit(False)), " [truncated]").otherwise("")
    arrow = F.when(a("direction") == "read", "<-").otherwise("->")
    file_line = say(arrow, " ", a("path"), " (", a("bytes").cast("string"), " B)", mark)
    if verbose:
        file_line = F.concat(file_line, F.lit("\n  content: "), shorten(a("content"), 200))
    t = a("type")
    line = (
        F.when(t == "Prompt", prompt)
        .when(t == "Response", say("<<< ", a("provider"), " ", text(a("model")), " (", human_bytes(a("bytes")), ")"))
        .when(t == "ToolCall", say("<~> tool: ", a("tool_name"), " (", a("provider"), ")"))
        .when(t == "ToolResult", say("~>  result: ", a("tool_name"), " ", text(shorten(a("output_preview"), 80))))
        .when(t == "McpRequest", say(">>> MCP ", a("method"), category))
        .when(t == "McpResponse", say("<<< MCP ", a("method")))
        .when(t == "PiiDetected", say("!! PII detected (", a("direction"), ") [", text(F.array_join(a("pii_types"), ", ")), "]"))
        .when(t == "FileAccess", say("[o] ", a("path"), " (", a("mode"), ")", reason))
        .when(t == "FileData", file_line)
    )
    if verbose:
        net = say("[", a("kind"), "] ", a("dst_ip"), ":", a("dst_port").cast("string"), " ", a("bytes").cast("string"), " bytes")
        line = line.when(t == "Network", net)
    line = F.concat(head, F.lit(" "), line)
    if verbose:
        line = F.concat_ws("\n", line, F.concat(F.lit("  identity: "), F.col("identity.narrative")))
        return events.select(*keep, line.alias("line"))
    # network events have no line in the short form
    return events.filter(t != "Network").select(*keep, line.alias("line"))


def action_arrow() -> Column:
    t = F.col("action.type")
    file_arrow = F.when(F.col("action.direction") == "read", "<-[").otherwise("]->")
    return F.when(t == "FileData", file_arrow).otherwise(_named(ARROWS, t))


def event_grid(events: DataFrame, keep=("event_id",)) -> DataFrame:
    """Display row of an event."""
    path, bytes_ = attribute("file_path"), attribute("bytes")
    short_path = F.when(F.octet_length(path) > 30, F.concat(F.lit("..."), F.right(path, F.lit(27)))).otherwise(path)
    return events.select(
        *keep,
        F.date_format("timestamp", "HH:mm:ss.SSS").alias("time"),
        F.concat_ws(" ", action_arrow(), F.col("action.type")).alias("action_label"),
        F.col("process.name").alias("process_name"),
        F.col("process.pid").alias("pid"),
        F.coalesce(attribute("provider"), F.lit("-")).alias("provider"),
        F.coalesce(short_path, attribute("sni"), F.lit("-")).alias("dest"),
        F.when(bytes_ > 0, human_bytes(bytes_)).otherwise("-").alias("bytes_text"),
        F.coalesce(F.col("policy"), F.lit("-")).alias("policy"),
        attribute("pii_detected").alias("is_pii"),
    )
