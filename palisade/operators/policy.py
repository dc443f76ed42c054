"""Rules over events: one decision and a set of reasons per event.

A rule is (id, decision, predicate, reason); predicates and reasons are Columns or SQL
strings. An undefined (null) predicate does not fire. Rule data that can grow lives in
tables and is joined as flags (`flag_member`, `flag_prefix`) before the rules run."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.plans.stage import settle

# Decisions by severity
SEVERITY = ["allow", "audit", "deny"]


@dataclass(frozen=True)
class Rule:
    id: str
    decision: str | None
    predicate: object
    reason: object = None


def rule(id: str, decision: str | None, predicate, reason=None) -> Rule:
    if decision is not None and decision not in SEVERITY:
        raise ValueError(f"rule {id}: unknown decision {decision!r}")
    return Rule(id, decision, predicate, reason)


def _column(value) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def fires(predicate) -> Column:
    return F.coalesce(_column(predicate), F.lit(False))


def apply_policy(events: DataFrame, rules, default="allow", conflict="severity") -> DataFrame:
    """Add decision, reasons (sorted, distinct) and rule_ids.

    conflict="severity": deny over audit over allow. conflict="open": different decisions
    at once give allow."""
    if conflict not in ("severity", "open"):
        raise ValueError(conflict)
    flagged = settle(events, **{f"_r{i}": fires(r.predicate) for i, r in enumerate(rules)})
    hit = lambda i: F.col(f"_r{i}")
    texts = F.array().cast("array<string>")
    deciding = [F.when(hit(i), F.lit(SEVERITY.index(r.decision))) for i, r in enumerate(rules) if r.decision]
    reasons = [F.when(hit(i), _column(r.reason)) for i, r in enumerate(rules) if r.reason is not None]
    ids = [F.when(hit(i), r.id) for i, r in enumerate(rules)]
    listed = lambda cols: F.array_compact(F.array(*cols)) if cols else texts
    found = settle(
        flagged,
        _levels=F.array_distinct(listed(deciding)) if deciding else F.array().cast("array<int>"),
        reasons=F.array_sort(F.array_distinct(listed(reasons))),
        rule_ids=listed(ids),
    )
    level = F.when(F.size("_levels") == 0, SEVERITY.index(default))
    if conflict == "open":
        level = level.when(F.size("_levels") > 1, SEVERITY.index("allow"))
    level = level.otherwise(F.array_max("_levels"))
    names = F.array(*[F.lit(s) for s in SEVERITY])
    return settle(found, decision=F.get(names, level)).drop("_levels", *[f"_r{i}" for i in range(len(rules))])


# ---------------------------------------------------------------- shipped rules


def default_rules() -> list[Rule]:
    a = lambda f: F.col(f"action.{f}")
    kind = a("type")
    pii = F.coalesce(a("pii_detected"), F.lit(False))
    model_traffic = a("provider").isNotNull() | kind.isin("Prompt", "McpRequest")
    secret = reduce(lambda x, y: x | y, [a("path").contains(w) for w in (".env", "credentials", "secrets")])
    access, data = kind == "FileAccess", kind == "FileData"
    secret_access = access & F.coalesce(secret, F.lit(False))
    secret_write = data & F.coalesce((a("direction") == "write") & secret, F.lit(False))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return [
        rule("pii-to-model", "deny", pii & model_traffic, F.lit("PII detected in outbound LLM traffic")),
        rule("model-traffic", "audit", model_traffic & ~pii),
        rule("provider-seen", None, a("provider").isNotNull(), say("Traffic to LLM provider: ", a("provider"))),
        rule("mcp-seen", None, a("method").isNotNull(), say("MCP tool invocation detected: ", a("method"))),
        rule("secret-access", "deny", secret_access & ~pii & ~model_traffic),
        rule("secret-access-seen", None, secret_access, say("Sensitive file access: ", a("path"))),
        rule("file-access", "audit", access & ~secret_access),
        rule("file-access-seen", None, access, say("File access: ", a("path"), " (", a("mode"), ")")),
        rule("secret-write", "deny", secret_write & ~pii & ~model_traffic),
        rule("secret-write-seen", None, secret_write, say("Sensitive file write: ", a("path"))),
        rule("file-data", "audit", data & ~secret_write),
        rule(
            "file-data-seen", None, data,
            say("File data ", a("direction"), ": ", a("path"), " (", a("bytes").cast("string"), " bytes)"),
        ),
    ]


def default_policy(events: DataFrame, conflict="severity") -> DataFrame:
    return apply_policy(events, default_rules(), "allow", conflict)


# ---------------------------------------------------------------- rule data


def flag_member(events: DataFrame, column: Column, data: DataFrame, field: str, flag: str) -> DataFrame:
    """Add `flag`: does the column occur in data[field]? (null: false)"""
    members = data.select(F.col(field).alias("_m")).filter(F.col("_m").isNotNull()).distinct().withColumn(flag, F.lit(True))
    keyed = settle(events, _m=column)
    return keyed.join(members, "_m", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_m")


def flag_prefix(events: DataFrame, column: Column, data: DataFrame, field: str, flag: str) -> DataFrame:
    """Add `flag`: does the column start with one of data[field]? The prefixes of the distinct
    values are exploded, so this is an equi-join on distinct values, not on events."""
    keyed = settle(events, _m=column)
    values = keyed.select("_m").filter(F.length("_m") > 0).distinct()
    cut = F.transform(F.sequence(F.lit(1), F.length("_m")), lambda n: F.left(F.col("_m"), n))
    listed = data.select(F.col(field).alias("_p")).distinct()
    matched = values.select("_m", F.explode(cut).alias("_p")).join(listed, "_p", "left_semi").select("_m").distinct()
    return keyed.join(matched.withColumn(flag, F.lit(True)), "_m", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_m")


def flag_rows(events: DataFrame, keys: dict[str, Column], data: DataFrame, flag: str) -> DataFrame:
    """Add `flag`: is there a data row equal on all keys (data column -> event expression)?"""
    names = list(keys)
    wanted = data.select(*[F.col(n).alias(f"_k_{n}") for n in names]).distinct().withColumn(flag, F.lit(True))
    keyed = settle(events, **{f"_k_{n}": c for n, c in keys.items()})
    on = [f"_k_{n}" for n in names]
    return keyed.join(wanted, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop(*on)


def event_tags() -> Column:
    """Tag set of an event: has_provider, has_pii, has_mcp."""
    return F.array_compact(
        F.array(
            F.when(F.col("action.provider").isNotNull(), "has_provider"),
            F.when(F.coalesce(F.col("action.pii_detected"), F.lit(False)), "has_pii"),
            F.when(F.col("action.method").isNotNull(), "has_mcp"),
        )
    )


# ---------------------------------------------------------------- decisions


def builtin_policy(network: DataFrame, enforce=False) -> DataFrame:
    """Without rules: traffic to a provider is denied when enforcing, else audited."""
    return network.withColumn("policy", F.when(F.col("provider").isNotNull(), "deny" if enforce else "audit"))


def denied_pids(decisions: DataFrame, order=("timestamp", "event_id")) -> DataFrame:
    """Latest deny (1) or audit (2) of each pid; allow leaves the older value."""
    code = F.when(F.col("decision") == "deny", 1).when(F.col("decision") == "audit", 2)
    kept = decisions.withColumn("code", code).filter(F.col("code").isNotNull())
    return kept.groupBy("pid").agg(F.max_by("code", F.struct(*order)).alias("code"))


def eval_report(events: DataFrame, rules=None, **options) -> DataFrame:
    """(event_id, action, reasons, pid, process_name, line) per event."""
    decided = apply_policy(events, default_rules() if rules is None else rules, **options)
    why = F.when(F.size("reasons") > 0, F.concat(F.lit(" ("), F.array_join("reasons", "; "), F.lit(")"))).otherwise("")
    name, pid = F.col("process.name"), F.col("process.pid")
    line = F.concat(F.col("decision"), F.lit(": PID "), pid.cast("string"), F.lit(" ("), name, F.lit(")"), why)
    return decided.select(
        "event_id", F.col("decision").alias("action"), "reasons", pid.alias("pid"), name.alias("process_name"), line.alias("line")
    )


def policy_test_report(events: DataFrame, rules=None, corrupt="_corrupt", **options) -> DataFrame:
    """One row: events, allow, audit, deny, errors (lines that did not parse)."""
    bad = F.col(corrupt).isNotNull() if corrupt in events.columns else F.lit(False)
    decided = apply_policy(events.withColumn("_bad", bad), default_rules() if rules is None else rules, **options)
    count = lambda d: F.count_if(~F.col("_bad") & (F.col("decision") == d)).alias(d)
    return decided.agg(
        F.count(F.lit(1)).alias("events"), *[count(d) for d in SEVERITY], F.count_if("_bad").alias("errors")
    )
