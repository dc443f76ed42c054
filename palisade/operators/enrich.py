"""Joins that add provider, server name, container, pod and path to raw records.

Lookups are equi-joins on derived keys; as-of joins are a union plus a carried last
value (plans.ordered), so neither needs a range join or a pair list."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import rules
from palisade.functions.text import contains_first, equals_first
from palisade.operators.filters import ai_path
from palisade.plans.ordered import carry_last, time_slice

SLICE_NS = 600 * 10**9


# ---------------------------------------------------------------- providers


def join_provider_ip(network: DataFrame, dns: DataFrame, out="ip_provider") -> DataFrame:
    """Exact destination address -> provider, on port 443 only. dns: (ip, provider)."""
    by_ip = dns.groupBy(F.col("ip").alias("daddr")).agg(F.min("provider").alias("_p"))
    joined = network.join(by_ip, "daddr", "left")
    return joined.select(*network.columns, F.when(F.col("dport") == 443, F.col("_p")).alias(out))


def subnet_key(address: Column, family: Column) -> Column:
    """First two octets of IPv4, first 32 bits of IPv6 in hex."""
    v4 = F.regexp_extract(address, r"^([0-9]+\.[0-9]+)\.", 1)
    group = lambda i: F.lpad(F.split_part(F.lower(address), F.lit(":"), F.lit(i)), 4, "0")
    return F.when(family == 10, F.concat(group(1), group(2))).otherwise(v4)


def subnet_provider(address: Column, family: Column) -> Column:
    return equals_first(subnet_key(address, family), rules.PROVIDER_SUBNETS_V4 + rules.PROVIDER_SUBNETS_V6)


def join_provider_subnet(network: DataFrame, out="subnet_provider") -> DataFrame:
    found = subnet_provider(F.col("daddr"), F.col("family"))
    return network.withColumn(out, F.when(F.col("dport") == 443, found))


def sni_provider(sni: Column) -> Column:
    return contains_first(F.lower(sni), rules.PROVIDER_HOSTS)


def join_provider_sni(df: DataFrame, sni="sni", out="sni_provider") -> DataFrame:
    return df.withColumn(out, sni_provider(F.col(sni)))


def asof_sni(network: DataFrame, handshakes: DataFrame, ttl_ns=rules.SNI_TTL_NS, slice_ns=SLICE_NS) -> DataFrame:
    """Server name of the pid's latest handshake, if it is younger than the TTL."""
    seen = handshakes.select(
        "pid",
        "timestamp_ns",
        F.struct("timestamp_ns", "sni").alias("_shake"),
        F.lit(0).alias("_kind"),
        F.coalesce(F.col("event_id"), F.lit(0)).alias("_tie") if "event_id" in handshakes.columns else F.lit(0).alias("_tie"),
    )
    rows = network.withColumn("_kind", F.lit(1)).withColumn("_tie", F.col("event_id"))
    both = rows.unionByName(seen, allowMissingColumns=True)
    order = ["timestamp_ns", "_kind", "_tie"]
    carried = carry_last(both, ["pid"], order, time_slice(F.col("timestamp_ns"), slice_ns), F.col("_shake"), "_last")
    # age in whole seconds, as a timer would report it
    fresh = (F.col("timestamp_ns") - F.col("_last.timestamp_ns")) < ttl_ns
    base = [c for c in network.columns if c != "sni"]
    return carried.filter(F.col("_kind") == 1).select(*base, F.when(fresh, F.col("_last.sni")).alias("sni"))


def resolve_provider(network: DataFrame, dns: DataFrame, handshakes: DataFrame | None = None, **options) -> DataFrame:
    """Provider by server name, then exact address, then subnet; port 443 only."""
    named = network if handshakes is None else asof_sni(network, handshakes, **options)
    if "sni" not in named.columns:
        named = named.withColumn("sni", F.lit(None).cast("string"))
    by_ip = join_provider_subnet(join_provider_ip(named, dns))
    found = F.coalesce(sni_provider(F.col("sni")), F.col("ip_provider"), F.col("subnet_provider"))
    return by_ip.withColumn("provider", F.when(F.col("dport") == 443, found)).drop("ip_provider", "subnet_provider")


# ---------------------------------------------------------------- containers and pods


def container_of_cgroup(content: Column) -> Column:
    scope = F.regexp_extract(content, r"(?:docker-|cri-containerd-)([a-f0-9]{64})\.scope", 1)
    bare = F.regexp_extract(content, r"(?m)/([a-f0-9]{64})$", 1)
    return F.left(F.coalesce(F.nullif(scope, F.lit("")), F.nullif(bare, F.lit(""))), F.lit(12))


def resolve_container(network: DataFrame, cgroups: DataFrame) -> DataFrame:
    """Short container id from the pid's cgroup text; overrides the record's own when found."""
    by_pid = (
        cgroups.select("pid", container_of_cgroup(F.col("content")).alias("_cid"))
        .filter(F.col("_cid").isNotNull())
        .groupBy("pid")
        .agg(F.min("_cid").alias("_cid"))
    )
    joined = network.join(by_pid, "pid", "left")
    rest = [c for c in network.columns if c != "container_id"]
    return joined.select(*rest, F.coalesce("_cid", "container_id").alias("container_id"))


def explode_pods(pods: DataFrame) -> DataFrame:
    """One row per (init) container with the 12-character id; one pod per id."""
    none = F.array().cast("array<string>")
    ids = F.concat(F.coalesce("container_ids", none), F.coalesce("init_container_ids", none))
    rows = pods.select("name", "namespace", "service_account", F.explode(ids).alias("full_id"))
    tail = F.substring_index("full_id", "://", -1)
    short = F.when(F.length(tail) >= 12, F.left(tail, F.lit(12))).otherwise(F.col("full_id"))
    pod = F.struct("namespace", "name", "service_account")
    return (
        rows.groupBy(short.alias("container_id"))
        .agg(F.min(pod).alias("pod"))
        .select(
            "container_id",
            F.col("pod.name").alias("pod_name"),
            F.col("pod.namespace").alias("pod_namespace"),
            F.col("pod.service_account").alias("service_account"),
        )
    )


def _proper_prefixes(column: str) -> Column:
    text = F.col(column)
    size = F.length(text)
    return F.when(size > 1, F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.left(text, n))).otherwise(
        F.array().cast("array<string>")
    )


def match_containers(ids: DataFrame, containers: DataFrame) -> DataFrame:
    """ids(container_id) -> (container_id, key): exact key, else the smallest key where one
    of the two is a prefix of the other. Prefixes are exploded on either side, so both
    directions are equi-joins, and every prefix is reduced to one key before joining."""
    wanted = ids.filter(F.col("container_id") != "").select("container_id").distinct()
    keys = containers.select(F.col("container_id").alias("key")).distinct()
    exact = keys.select(F.col("key").alias("container_id"), "key", F.lit(0).alias("rank"))
    longer_key = (
        keys.select("key", F.explode(_proper_prefixes("key")).alias("container_id"))
        .groupBy("container_id")
        .agg(F.min("key").alias("key"))
        .withColumn("rank", F.lit(1))
    )
    shorter_key = (
        wanted.select("container_id", F.explode(_proper_prefixes("container_id")).alias("key"))
        .join(keys, "key")
        .withColumn("rank", F.lit(1))
    )
    direct = wanted.join(exact.unionByName(longer_key), "container_id")
    best = direct.unionByName(shorter_key).groupBy("container_id").agg(F.min(F.struct("rank", "key")).alias("best"))
    return best.select("container_id", F.col("best.key").alias("key"))


def join_pods(network: DataFrame, containers: DataFrame) -> DataFrame:
    """Add pod_name, pod_namespace, service_account by container id (empty id: none)."""
    pods = containers.withColumnRenamed("container_id", "key")
    by_id = match_containers(network, containers).join(pods, "key").drop("key")
    return network.join(by_id, "container_id", "left")


# ---------------------------------------------------------------- files


def tracked_file_access(file_access: DataFrame, pids: DataFrame) -> DataFrame:
    """Accesses by a tracked pid or to an AI path, with the pid_tracked flag."""
    tracked = pids.select("pid").distinct().withColumn("_t", F.lit(True))
    flagged = file_access.join(tracked, "pid", "left").withColumn("pid_tracked", F.coalesce("_t", F.lit(False))).drop("_t")
    return flagged.filter(F.col("pid_tracked") | ai_path(F.col("path")))


def asof_fd_path(io: DataFrame, opens: DataFrame, closes: DataFrame, slice_ns=SLICE_NS) -> DataFrame:
    """Path behind (pid, fd): the latest successful open that was not closed since.
    Rows on descriptors without one are dropped."""
    cols = ["pid", "fd", "timestamp_ns"]
    opened = opens.filter(F.col("fd") >= 0).select(
        *cols, F.struct(F.col("path")).alias("_state"), F.lit(0).alias("_kind"), F.col("event_id").alias("_tie")
    )
    closed = closes.select(
        *cols,
        F.struct(F.lit(None).cast("string").alias("path")).alias("_state"),
        F.lit(2).alias("_kind"),
        F.col("event_id").alias("_tie"),
    )
    rows = io.withColumn("_kind", F.lit(1)).withColumn("_tie", F.col("event_id"))
    both = rows.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True)
    carried = carry_last(
        both, ["pid", "fd"], ["timestamp_ns", "_kind", "_tie"],
        time_slice(F.col("timestamp_ns"), slice_ns), F.col("_state"), "_last",
    )
    base = [c for c in io.columns if c != "path"]
    found = carried.filter((F.col("_kind") == 1) & F.col("_last.path").isNotNull())
    return found.select(*base, F.col("_last.path").alias("path"))


# ---------------------------------------------------------------- messages


def endpoint_match(sni: Column, host: Column, method: Column, path: Column) -> tuple[Column, Column]:
    """(provider, endpoint) of the first matching endpoint rule, else nulls."""
    name = F.coalesce(sni, host)
    ordered = [r for r in rules.ENDPOINT_RULES if r[0]] + [r for r in rules.ENDPOINT_RULES if not r[0]]
    chain = None
    for need_host, prefix, need_method, provider, endpoint in ordered:
        hit = path.startswith(prefix)
        if need_host:
            hit = hit & name.contains(need_host)
        if need_method:
            hit = hit & (method == need_method)
        value = f"{provider}|{endpoint}"
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.split_part(chain, F.lit("|"), F.lit(1)), F.split_part(chain, F.lit("|"), F.lit(2))


def join_endpoint_rules(messages: DataFrame) -> DataFrame:
    provider, endpoint = endpoint_match(F.col("sni"), F.col("headers")["host"], F.col("method"), F.col("path"))
    return messages.withColumn("provider", provider).withColumn("endpoint", endpoint)


def mcp_category(method: Column) -> Column:
    return F.coalesce(equals_first(method, rules.MCP_METHODS), F.lit("Other"))


def mcp_known(method: Column) -> Column:
    known = method.isin(*[m for m, _ in rules.MCP_METHODS])
    for prefix in rules.MCP_PREFIXES:
        known = known | method.startswith(prefix)
    return F.coalesce(known, F.lit(False))


def join_mcp_methods(messages: DataFrame, column="rpc_method") -> DataFrame:
    return messages.withColumn("mcp_category", equals_first(F.col(column), rules.MCP_METHODS)).withColumn(
        "is_mcp_method", mcp_known(F.col(column))
    )


def sdk_match(user_agent: Column) -> tuple[Column, Column]:
    """(sdk name, version after '/' or a space) of the first known pattern."""
    low = F.lower(user_agent)
    name = contains_first(low, rules.SDK_PATTERNS)
    needle = contains_first(low, [(p, p) for p, _ in rules.SDK_PATTERNS])
    after = F.substr(user_agent, F.instr(low, needle) + F.length(needle))
    version = F.nullif(F.regexp_extract(after, r"^[/ ]([A-Za-z0-9.-]+)", 1), F.lit(""))
    return name, F.when(name.isNotNull(), version)


def join_sdk_patterns(messages: DataFrame, column="user_agent") -> DataFrame:
    name, version = sdk_match(F.col(column))
    return messages.withColumn("sdk_name", name).withColumn("sdk_version", version)


def _first_by(df: DataFrame, keys, order, payload) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_first"))


def pair_tool_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool call with the first result that names its id in the same session."""
    answers = _first_by(
        results.filter(F.col("tool_use_id").isNotNull()),
        ["session_id", F.col("tool_use_id").alias("tool_call_id")],
        ["seq", "idx"],
        ["seq", "output_preview", "output"],
    )
    return calls.join(answers, ["session_id", "tool_call_id"], "left").select(
        *calls.columns, F.col("_first.seq").alias("result_seq"), F.col("_first.output_preview").alias("output_preview"), F.col("_first.output").alias("output")
    )


def pair_rpc(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each JSON-RPC request with the first response of the same id in the session."""
    answers = _first_by(
        responses.filter(F.col("rpc_id").isNotNull()), ["session_id", "rpc_id"], ["seq"], ["seq", "msg_type"]
    )
    return requests.join(answers, ["session_id", "rpc_id"], "left").select(
        *requests.columns, F.col("_first.seq").alias("response_seq"), F.col("_first.msg_type").alias("response_type")
    )
