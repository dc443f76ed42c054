"""Reference-shaped tables derived from the driver tables by plain arithmetic.

A binding is one SELECT whose expressions mean the same in Spark SQL and DuckDB, so
the oracle rebuilds the very same rows. `spark(...)` gives DataFrames, `ctes(...)` the
matching WITH clause."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(expr: str, values) -> str:
    """CASE over 0..n-1; strings are quoted, the rest is taken as an expression."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def quoted(*texts) -> list[str]:
    return ["'" + t.replace("'", "''") + "'" for t in texts]


class Binding:
    def __init__(self, name, source, columns, where=None):
        self.name, self.source, self.columns, self.where = name, source, columns, where

    def sql(self) -> str:
        fields = ", ".join(f"{self._pick(e, 1)} AS {a}" for a, e in self.columns.items())
        return f"{self.name} AS (SELECT {fields} FROM {self.source}" + (f" WHERE {self.where})" if self.where else ")")

    @staticmethod
    def _pick(e, i):
        return e[i] if isinstance(e, tuple) else e

    def build(self, src: DataFrame) -> DataFrame:
        rows = src.where(self.where) if self.where else src
        return rows.selectExpr(*[f"{self._pick(e, 0)} AS {a}" for a, e in self.columns.items()])


K8 = "k % 8"
_STR = lambda e: f"CAST({e} AS STRING)"
COMMS = quoted("python", "claude", "cursor-agent", "node", "curl", "aider", "java", "Code")
PROVIDERS = quoted("OpenAI", "anthropic", "Google", "aws", "DeepSeek", "Mystery", "Ollama")
MODELS = quoted("gpt-4", "gpt-4o", "claude-3", "mistral-large")
METHODS = quoted("tools/call", "tools/list", "resources/read", "initialize", "prompts/get", "custom/do")
PATHS = quoted(
    "/home/u/.claude/settings.json", "/src/CLAUDE.md", "/home/u/.cursor/rules", "/app/.env", "/opt/skills/a.md",
    "/home/u/.anthropic/key", "/etc/credentials.txt",
    "/var/lib/a/very/long/directory/name/that/pushes/the/pattern/behind/.env",
)

TABLES = [
    Binding("ev", "events", {
        "event_id": "event_id",
        "us": ("unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"),
        "user_id": "user_id", "event_type": "event_type", "value": "value", "props": "props",
        "k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
    }),
    # raw network records
    Binding("net", "ev", {
        "event_id": "event_id", "pid": "user_id", "tid": "user_id", "uid": "user_id % 5 + 1000", "gid": "100",
        "cgroup_id": "user_id % 11 + 4000",
        "event_type": "CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 "
                      "WHEN 'error' THEN 4 WHEN 'purchase' THEN 5 ELSE 0 END AS INT)",
        "family": f"CAST(CASE WHEN {K8} = 7 THEN 10 ELSE 2 END AS INT)",
        "sport": "CAST(40000 + k AS INT)",
        "dport": "CAST(" + pick("k % 10", ["443"] * 5 + ["80", "53", "8080", "22", "11434"]) + " AS INT)",
        "saddr": f"'10.0.0.' || {_STR('user_id % 250')}",
        "daddr": pick(K8, [
            f"'160.79.' || {_STR('k')} || '.10'", f"'104.18.' || {_STR('k')} || '.1'",
            f"'172.66.0.' || {_STR('k')}", f"'162.159.' || {_STR('k')} || '.7'",
            f"'10.1.0.' || {_STR('k')}", f"'192.168.1.' || {_STR('k')}", f"'172.16.0.' || {_STR('k')}",
            f"'2607:6bc0::' || {_STR('k')}",
        ]),
        "bytes": "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(floor(value * 400) AS BIGINT) ELSE 0 END",
        "timestamp_ns": "CAST(floor(us / 2) AS BIGINT)",
        "comm": pick("user_id % 8", COMMS),
        "container_id": pick("user_id % 7", [
            "''", f"'c0ffee' || lpad({_STR('user_id')}, 6, '0')", "'c0ffee000002'", "'c0ffee000003'", "'c0ffee'",
            "'c0ffee000005deadbeef'", "'feed'",
        ]),
        "cgroup": "''", "us": "us", "k": "k",
    }),
    Binding("dns", "(SELECT DISTINCT daddr FROM net WHERE k % 16 = 4)", {"ip": "daddr", "provider": "'Perplexity'"}),
    Binding("handshakes", "net", {
        "event_id": "event_id", "pid": "pid", "tid": "tid", "timestamp_ns": "timestamp_ns", "comm": "comm",
        "sni": pick("k % 6", quoted("api.openai.com", "EU.api.anthropic.com", "example.com",
                                    "bedrock-runtime.us-east-1.amazonaws.com", "API.MISTRAL.AI", "cdn.static.net")),
    }, "event_type = 3 AND event_id % 3 = 0"),
    Binding("cgroups", "(SELECT DISTINCT pid FROM net)", {
        "pid": "pid",
        "content": pick("pid % 4", [
            f"'0::/system.slice/docker-' || md5({_STR('pid')}) || md5({_STR('pid + 1')}) || '.scope'",
            f"'12:cpu:/kubepods/' || md5({_STR('pid')}) || md5({_STR('pid + 1')}) || chr(10) || '0::/init'",
            f"'1:name=x' || chr(10) || '0::/cri-containerd-' || md5({_STR('pid')}) || md5({_STR('pid')}) || '.scope'",
            "'0::/user.slice'",
        ]),
    }),
    Binding("pods", "supplier", {
        "name": f"'pod-' || {_STR('s_suppkey')}",
        "namespace": pick("s_suppkey % 3", quoted("production", "staging", "dev")),
        "service_account": f"'sa-' || {_STR('s_nationkey')}",
        "container_ids": (
            f"array('containerd://c0ffee' || lpad({_STR('s_suppkey')}, 6, '0') || md5({_STR('s_suppkey')}))",
            f"['containerd://c0ffee' || lpad({_STR('s_suppkey')}, 6, '0') || md5({_STR('s_suppkey')})]",
        ),
        "init_container_ids": (
            f"array('docker://' || md5({_STR('s_suppkey + 7')}), 'feed' || {_STR('s_suppkey')})",
            f"['docker://' || md5({_STR('s_suppkey + 7')}), 'feed' || {_STR('s_suppkey')}]",
        ),
    }),
    Binding("file_access", "ev", {
        "event_id": "event_id", "pid": "user_id", "tid": "user_id", "uid": "user_id % 5 + 1000",
        "timestamp_ns": "CAST(floor(us / 2) AS BIGINT)", "cgroup_id": "user_id % 11 + 4000",
        "comm": pick("user_id % 8", COMMS), "flags": "CAST(k % 9 AS INT)", "path": pick(K8, PATHS),
    }, "event_type IN ('click', 'signup')"),
    Binding("fd_events", "ev", {
        "event_id": "event_id", "pid": "user_id", "fd": "CAST(k % 4 - 1 AS INT)", "event_type": "event_type",
        "timestamp_ns": "CAST(floor(us / 2) AS BIGINT)", "path": pick(K8, PATHS), "bytes": "k",
    }),
    Binding("file_data", "ev", {
        "event_id": "event_id", "pid": "user_id", "tid": "user_id", "uid": "user_id % 5 + 1000",
        "timestamp_ns": "CAST(floor(us / 2) AS BIGINT)", "cgroup_id": "user_id % 11 + 4000",
        "comm": pick("user_id % 8", COMMS), "fd": "CAST(k % 4 AS INT)", "direction": "CAST(k % 2 AS INT)",
        "payload_len": ("CASE WHEN k % 5 = 0 THEN 5000 WHEN k % 5 = 1 THEN octet_length(props) * 700 ELSE octet_length(props) END",
                        "CASE WHEN k % 5 = 0 THEN 5000 WHEN k % 5 = 1 THEN octet_length(encode(props)) * 700 ELSE octet_length(encode(props)) END"),
        "path": pick(K8, PATHS), "text": "CASE WHEN k % 5 = 1 THEN repeat(props, 700) ELSE props END",
    }, "event_type IN ('view', 'purchase')"),
    # enriched events of every variant
    Binding("flat", "ev", {
        "event_id": "event_id", "us": "us",
        "session_id": f"{_STR('user_id')} || ':s'",
        "policy": pick("k % 4", quoted("allow", "audit", "deny") + ["CAST(NULL AS STRING)"]),
        "pid": "user_id", "uid": "user_id % 5 + 1000", "comm": pick("user_id % 8", COMMS),
        "container_id": pick("user_id % 3", ["''", f"'box' || {_STR('user_id % 9')}", f"'box' || {_STR('user_id % 9')}"]),
        "cgroup_id": "user_id % 11 + 4000",
        "pod_namespace": pick("user_id % 3", quoted("production", "staging") + ["CAST(NULL AS STRING)"]),
        "service_account": pick("user_id % 4", quoted("sa-a", "sa-b", "sa-c") + ["CAST(NULL AS STRING)"]),
        "type": pick("event_id % 10", quoted("Prompt", "Response", "ToolCall", "ToolResult", "McpRequest",
                                             "McpResponse", "PiiDetected", "Network", "FileAccess", "FileData")),
        "provider": f"CASE WHEN event_id % 10 IN (0, 1, 2) OR (event_id % 10 = 7 AND k % 3 > 0) THEN {pick('k % 7', PROVIDERS)} END",
        "model": f"CASE WHEN event_id % 10 IN (0, 1) AND k % 5 > 0 THEN {pick('k % 4', MODELS)} END",
        "user_message": f"CASE WHEN event_id % 10 = 0 AND k % 6 > 0 THEN repeat('Tell me about ' || {_STR('k')} || ' ', CAST(k % 12 + 1 AS INT)) END",
        "system_prompt": f"CASE WHEN event_id % 10 = 0 AND k % 3 = 0 THEN 'You are helper ' || {_STR('k % 5')} END",
        "stream": "CASE WHEN event_id % 10 = 0 THEN k % 2 = 0 END",
        "sdk": "CASE WHEN event_id % 10 = 0 AND k % 4 > 0 THEN " + pick("k % 4", quoted("-", "openai-python/1.2", "langchain", "curl/8.0")) + " END",
        "fingerprint": "CASE WHEN event_id % 10 = 0 AND k % 4 > 0 THEN (user_id % 6) * 1000003 + k % 2 END",
        "sdk_hash": "CASE WHEN event_id % 10 = 0 AND k % 4 > 0 THEN k % 4 * 7919 END",
        "model_hash": "CASE WHEN event_id % 10 = 0 AND k % 5 > 0 THEN (k % 4 + 1) * 104729 END",
        "bytes": "CASE WHEN event_id % 10 IN (0, 1, 7, 9) THEN CAST(floor(value * value * 17) AS BIGINT) END",
        "sni": "CASE WHEN event_id % 10 IN (0, 1, 7) AND k % 2 = 0 THEN " + pick("k % 3", quoted("api.openai.com", "api.anthropic.com", "shadow.ai.example")) + " END",
        "pii_detected": "CASE WHEN event_id % 10 = 0 AND k % 3 < 2 THEN k % 3 = 0 END",
        "tool_name": "CASE WHEN event_id % 10 IN (2, 3) THEN " + pick("k % 3", quoted("search", "lookup", "shell")) + " END",
        "output_preview": f"CASE WHEN event_id % 10 = 3 AND k % 4 > 0 THEN repeat('out ' || {_STR('k')} || ' ', CAST(k % 20 + 1 AS INT)) END",
        "method": f"CASE WHEN event_id % 10 IN (4, 5) THEN {pick('k % 6', METHODS)} END",
        "category": "CASE WHEN event_id % 10 = 4 AND k % 5 > 0 THEN " + pick("k % 4", quoted("Tools", "tool_use", "Lifecycle", "weird")) + " END",
        "direction": "CASE WHEN event_id % 10 IN (6, 9) THEN CASE WHEN k % 2 = 0 THEN 'read' ELSE 'write' END END",
        "kind": "CASE WHEN event_id % 10 = 7 THEN " + pick("k % 5", quoted("Connect", "Close", "DataSent", "DataReceived", "DnsQuery")) + " END",
        "dst_ip": f"CASE WHEN event_id % 10 = 7 THEN '10.0.0.' || {_STR('k')} END",
        "dst_port": "CAST(CASE WHEN event_id % 10 = 7 THEN CASE WHEN k % 4 = 0 THEN 8443 ELSE 443 END END AS INT)",
        "path": f"CASE WHEN event_id % 10 IN (8, 9) THEN {pick(K8, PATHS)} END",
        "mode": "CASE WHEN event_id % 10 = 8 THEN " + pick("k % 4", quoted("read", "write", "readwrite", "unknown")) + " END",
        "reason": "CASE WHEN event_id % 10 = 8 AND k % 3 = 0 THEN 'pid_tracked' END",
        "content": f"CASE WHEN event_id % 10 = 9 THEN repeat('data ', CAST(k AS INT)) END",
        "truncated": "CASE WHEN event_id % 10 = 9 AND k % 4 = 0 THEN TRUE END",
        "id_confidence": "CAST(k % 11 AS DOUBLE) / 10", "timeline_len": "CAST(k % 40 AS INT)",
        "k": "k",
    }),
]
BY_NAME = {b.name: b for b in TABLES}


def register(binding: Binding):
    TABLES.append(binding)
    BY_NAME[binding.name] = binding


def _needs(name, seen):
    b = BY_NAME.get(name)
    if b is None or name in seen:
        return
    for other in BY_NAME:
        if other != name and _mentions(b.source, other):
            _needs(other, seen)
    seen.append(name)


def _mentions(source: str, name: str) -> bool:
    import re

    return re.search(rf"(?<![A-Za-z_]){name}(?![A-Za-z_])", source) is not None


def ctes(*names) -> str:
    """WITH clause (no trailing comma) that defines the named bindings."""
    seen: list[str] = []
    for n in names:
        _needs(n, seen)
    return "WITH " + ",\n".join(BY_NAME[n].sql() for n in seen)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The binding as a DataFrame."""
    b = BY_NAME.get(name)
    if b is None:
        return table(spark, sf_dir, name)
    if b.source.startswith("("):
        # (SELECT DISTINCT col FROM x [WHERE c])
        import re

        col, src, _, cond = re.match(r"\(SELECT DISTINCT (\w+) FROM (\w+)( WHERE (.*))?\)$", b.source).groups()
        rows = bound(spark, sf_dir, src)
        rows = (rows.where(cond) if cond else rows).select(col).distinct()
    else:
        rows = bound(spark, sf_dir, b.source)
    return b.build(rows)


#: Rows of a file of a replayed stream, about; smaller micro-batches are one file.
REPLAY_ROWS = 50_000


def replayed(spark: SparkSession, rows: DataFrame, key, folder: str, batches=4) -> DataFrame:
    """The rows as a stream of micro-batches in the order of `key` (0, 1, ...), each of the same
    number of files, written by as many tasks."""
    least = rows.groupBy(key.alias("key")).count().agg(F.min("count")).first()[0] or 0
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), least // REPLAY_ROWS))
    for i in range(batches):
        part = rows.filter(key == i)
        # each input partition deals its rows out in turn, so no file stays empty
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")


def agentic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`flat` as nested enriched events."""
    from palisade import schemas
    from palisade.operators.normalize import struct_of

    f = bound(spark, sf_dir, "flat")
    names = [n for n in schemas.ACTION.names if n in f.columns]
    action = struct_of(
        schemas.ACTION,
        pii_types=F.when(F.col("type") == "PiiDetected", F.array(F.lit("email"), F.lit("phone"))),
        **{n: F.col(n) for n in names},
    )
    return f.select(
        "event_id",
        F.timestamp_micros("us").alias("timestamp"),
        "session_id",
        "policy",
        struct_of(
            schemas.PROCESS, pid=F.col("pid"), uid=F.col("uid"), name=F.col("comm"), container_id=F.col("container_id"),
            cgroup_id=F.col("cgroup_id"), pod_namespace=F.col("pod_namespace"), service_account=F.col("service_account"),
        ).alias("process"),
        struct_of(
            schemas.IDENTITY, id=F.col("pid"), confidence=F.col("id_confidence"), timeline_len=F.col("timeline_len")
        ).alias("identity"),
        action.alias("action"),
    )


# ------------------------------------------------------------------ payloads from conversations

_ESC = "text"
for _a, _b in (("chr(92)", "chr(92) || chr(92)"), ("chr(34)", "chr(92) || chr(34)"), ("chr(10)", "chr(92) || 'n'"),
               ("chr(13)", "chr(92) || 'r'"), ("chr(9)", "chr(92) || 't'")):
    _ESC = f"replace({_ESC}, {_a}, {_b})"
CRLF = "chr(13) || chr(10)"


def _json(template: str) -> str:
    """'...{col}...' -> a concatenation; {name} inserts a column."""
    import re

    out = []
    for piece in re.split(r"(<\w+>)", template):
        if not piece:
            continue
        out.append(f"CAST({piece[1:-1]} AS STRING)" if re.fullmatch(r"<\w+>", piece) else "'" + piece.replace("'", "''") + "'")
    return " || ".join(out)


HOSTS = quoted("api.openai.com", "api.anthropic.com", "corp.openai.azure.com", "mcp.internal", "box.internal", "example.com")
REQ_PATHS = quoted("/v1/chat/completions", "/v1/messages", "/openai/deployments/x/chat/completions?v=1", "/rpc", "/run", "/upload")
REQUEST_BODIES = [
    '{"model":"<model>","messages":[{"role":"system","content":"Be brief <fam>"},{"role":"user","content":"<esc>"}],"temperature":0.5,"max_tokens":256,"stream":true}',
    '{"model":"<model>","system":"Be kind","messages":[{"role":"user","content":[{"type":"text","text":"<esc>"},{"type":"tool_result","tool_use_id":"toolu_<prev>","content":[{"type":"text","text":"ok <esc>"}]}]}],"max_tokens":1024}',
    '{"model":"<model>","messages":[{"role":"user","content":[{"type":"text","text":"<esc>"},{"type":"image_url"}]},{"role":"tool","tool_call_id":"call_<prev>","name":"search","content":"<esc>"}],"max_completion_tokens":99}',
    '{"jsonrpc":"2.0","id":<turn>,"method":"<rpc_method>","params":{"name":"lookup","q":"<esc>"}}',
    '{"prompt":"<esc>","temperature":0.1,"top_p":0.9}',
    '{"note":"<esc>"}',
]
RESPONSE_BODIES = [
    '{"id":"r<turn>","model":"<model>","choices":[{"message":{"role":"assistant","content":"<esc>","tool_calls":[{"id":"call_<turn>","function":{"name":"search","arguments":"{}"}}]}}]}',
    '{"type":"message","model":"<model>","content":[{"type":"text","text":"<esc>"},{"type":"tool_use","id":"toolu_<turn>","name":"lookup","input":{"q":1}}]}',
    'data: {"choices":[{"delta":{"content":"<esc>"}}]}',
    '{"jsonrpc":"2.0","id":<prev>,"result":{"tools":[{"name":"zeta"},{"name":"alpha <fam>"},{"name":"t<prev>"}]}}',
    '{"completion":"<esc>"}',
    "<text>",
]
UAS = quoted("openai-python/1.3.5", "Anthropic-Python 0.8.0", "curl/8.1.2 langchain", "Mozilla/5.0")

register(Binding("conv", "conversations", {
    "conv_id": "conv_id", "turn": "turn", "prev": "turn - 1", "role": "role", "text": "text", "esc": _ESC,
    "fam": "conv_id % 6", "direction": "CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS INT)",
    "model": pick("conv_id % 4", MODELS), "rpc_method": pick("turn % 6", METHODS),
    "framed": "(conv_id + turn) % 5 <> 4", "cut": "(conv_id + turn) % 7 = 6",
}))
register(Binding("bodies", "conv", {
    **{c: c for c in ("conv_id", "turn", "role", "text", "fam", "direction", "framed", "cut")},
    "host": pick("fam", HOSTS), "req_path": pick("fam", REQ_PATHS), "ua": pick("conv_id % 4", UAS),
    "doc": f"CASE direction WHEN 0 THEN {pick('fam', [_json(b) for b in REQUEST_BODIES])} ELSE {pick('fam', [_json(b) for b in RESPONSE_BODIES])} END",
}))
register(Binding("cutbodies", "bodies", {
    **{c: c for c in ("conv_id", "turn", "role", "text", "fam", "direction", "framed", "host", "req_path", "ua")},
    "doc": "CASE WHEN cut THEN left(doc, CAST(greatest(length(doc) - 40, 0) AS INT)) ELSE doc END",
}))
register(Binding("payloads", "cutbodies", {
    "conv_id": "conv_id", "turn": "turn", "fam": "fam", "direction": "direction",
    "pid": "conv_id", "ssl_ptr": "conv_id * 16 + 1", "seq": "turn", "comm": "'agent' || " + _STR("fam"),
    "session_id": f"{_STR('conv_id')} || ':x'",
    "timestamp_ns": "(1000000 + conv_id * 100000 + turn * 1000) * 1000000",
    "sni": "CASE WHEN conv_id % 5 > 0 THEN host END",
    "payload_text": f"""CASE WHEN NOT framed OR (fam = 2 AND direction = 1) THEN doc
      WHEN direction = 0 THEN 'POST ' || req_path || ' HTTP/1.1' || {CRLF} || 'Host: ' || host || {CRLF} || 'User-Agent: ' || ua || {CRLF}
        || CASE WHEN conv_id % 9 = 4 THEN 'bad header' || {CRLF} ELSE '' END || 'Authorization: Bearer sk-abcdefghijkl' || {CRLF} || 'X-Request: 1' || {CRLF}
        || CASE WHEN fam = 1 THEN 'anthropic-version: 2023-06-01' || {CRLF} ELSE '' END || 'Content-Type: application/json' || {CRLF} || {CRLF} || doc
      ELSE 'HTTP/1.1 200 OK' || {CRLF} || 'Content-Type: application/json' || {CRLF} || {CRLF} || doc END""",
}))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "payloads")
    return rows.withColumn("payload", F.col("payload_text").cast("binary")).drop("payload_text")
