"""Explicit schemas of the raw tables and of the enriched event."""

from pyspark.sql import types as T

_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


RAW_NETWORK = _struct(
    pid=_L, tid=_L, uid=_L, gid=_L, cgroup_id=_L, event_type=T.ByteType(), family=_I, sport=_I, dport=_I,
    saddr=_S, daddr=_S, bytes=_L, timestamp_ns=_L, comm=_S, container_id=_S, cgroup=_S,
)
RAW_TLS_HANDSHAKE = _struct(pid=_L, tid=_L, timestamp_ns=_L, comm=_S, sni=_S)
RAW_TLS_DATA = _struct(
    pid=_L, tid=_L, uid=_L, timestamp_ns=_L, comm=_S, direction=T.ByteType(), payload_len=_L, ssl_ptr=_L,
    is_first_chunk=_B, payload=T.BinaryType(),
)
RAW_FILE_ACCESS = _struct(pid=_L, tid=_L, uid=_L, timestamp_ns=_L, cgroup_id=_L, comm=_S, flags=_I, path=_S)
RAW_FILE_DATA = _struct(
    pid=_L, tid=_L, uid=_L, timestamp_ns=_L, cgroup_id=_L, comm=_S, fd=_I, direction=T.ByteType(),
    payload_len=_L, path=_S, payload=T.BinaryType(),
)
RAW = {
    "network": RAW_NETWORK,
    "tls_handshake": RAW_TLS_HANDSHAKE,
    "tls_data": RAW_TLS_DATA,
    "file_access": RAW_FILE_ACCESS,
    "file_data": RAW_FILE_DATA,
}

PROCESS = _struct(
    pid=_L, uid=_L, name=_S, container_id=_S, cgroup_id=_L, pod_name=_S, pod_namespace=_S, service_account=_S
)
IDENTITY = _struct(
    id=_L, instance=_S, confidence=T.DoubleType(), match_type=_S, narrative=_S, timeline=_S, timeline_len=_I,
    prompt_fingerprint=_L, behavioral_digest=_L, capability_hash=_L, graph_node_count=_I, graph_edge_count=_I,
)
# One wide struct with a type tag; a field is null when the variant has no such field.
ACTION = _struct(
    type=_S, provider=_S, model=_S, user_message=_S, system_prompt=_S, stream=_B, sdk=_S, bytes=_L, sni=_S,
    endpoint=_S, fingerprint=_L, pii_detected=_B, confidence=T.DoubleType(), sdk_hash=_L, model_hash=_L,
    tool_name=_S, input_json=_S, output_preview=_S, output=_S, method=_S, category=_S, params_preview=_S, result_preview=_S,
    direction=_S, pii_types=T.ArrayType(_S), kind=_S, src_ip=_S, src_port=_I, dst_ip=_S, dst_port=_I,
    path=_S, mode=_S, reason=_S, content=_S, truncated=_B,
)
EVENT = T.StructType(
    [
        T.StructField("event_id", _L),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("session_id", _S),
        T.StructField("policy", _S),
        T.StructField("process", PROCESS),
        T.StructField("identity", IDENTITY),
        T.StructField("action", ACTION),
    ]
)
