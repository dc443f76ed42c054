"""Agent identities across events: keys, resolution, timelines, rollups, narratives.

Events are reduced to one row per instance (pid, container, cgroup) before anything is
resolved: once an instance is known, its later events follow it."""

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import rules, schemas
from palisade.functions.hashing import fnv32, fnv64, fnv64_bytes, le_bytes, utf8_bytes
from palisade.functions.text import plural
from palisade.operators import resolution
from palisade.operators.normalize import attribute, provider_tag, struct_of, to_identity_actions
from palisade.operators.resolution import AT, INSTANCE, TYPE
from palisade.plans.ordered import carry_last, sequence_number, time_slice
from palisade.plans.stage import materialize, settle

SLICE_US = 600 * 10**6


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def type_identity_id() -> Column:
    return fnv64_bytes(F.concat(le_bytes(F.col("sig"), 8), le_bytes(F.col("sdk"), 4), le_bytes(F.col("model"), 4)))


def instance_identity_id() -> Column:
    return fnv64_bytes(F.concat(le_bytes(F.col("pid"), 4), le_bytes(F.col("cgroup_id"), 8), le_bytes(F.col("container_hash"), 4)))


def build_label() -> Column:
    """'sdk (model)', sdk, 'provider model', provider, or 'pid:N'."""
    some = lambda n: F.nullif(attribute(n), F.lit(""))
    sdk, model, provider = some("sdk"), some("model"), some("provider")
    return F.coalesce(
        F.concat(sdk, F.lit(" ("), model, F.lit(")")), sdk, F.concat(provider, F.lit(" "), model), provider,
        F.concat(F.lit("pid:"), F.col("process.pid").cast("string")),
    )


def identity_keys(events: DataFrame) -> DataFrame:
    """Add the instance key, the type key, ts (epoch microseconds), the provider tag and a hash of the
    system prompt."""
    container = F.col("process.container_id")
    return settle(
        events,
        pid=F.col("process.pid"),
        container_hash=F.when(F.coalesce(container, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(fnv32(container)),
        cgroup_id=F.col("process.cgroup_id"),
        sig=_zero(attribute("fingerprint")),
        sdk=_zero(attribute("sdk_hash")),
        model=_zero(attribute("model_hash")),
        ts=F.unix_micros("timestamp"),
        tag=provider_tag(attribute("provider")),
        # equal prompts are all that resolution asks for
        prompt=F.when(F.length(attribute("system_prompt")) > 0, F.xxhash64(attribute("system_prompt"))),
    )


def identity_ids(keys: DataFrame) -> DataFrame:
    typed = (F.col("sig") != 0) | (F.col("sdk") != 0) | (F.col("model") != 0)
    return settle(keys, identity_id=F.when(typed, type_identity_id()).otherwise(instance_identity_id()))


def identity_labels(events: DataFrame) -> DataFrame:
    return events.withColumn("identity_label", build_label())


# ---------------------------------------------------------------- resolution


def first_actions(actions: DataFrame) -> DataFrame:
    """The first identity action of every instance, with its keys, label and the id it would found."""
    return _firsts(identity_labels(identity_keys(actions)))


def _firsts(keyed: DataFrame) -> DataFrame:
    cols = [*AT, *TYPE, "tag", "prompt", "identity_label"]
    first = keyed.groupBy(*INSTANCE).agg(F.min_by(F.struct(*cols), F.struct(*AT)).alias("f"))
    return identity_ids(first.select(*INSTANCE, "f.*")).withColumnRenamed("identity_id", "own_id")


def resolve_identities(actions: DataFrame, slice_entries: int = resolution.SLICE_ENTRIES, report: list | None = None) -> DataFrame:
    """(instance key, identity_id, level, confidence, ts, event_id) of every instance's first action.

    Cascade: same full type key as a founder (StrongType), same signature and model as one
    (MediumType), provider already used by an identity when the type key is incomplete (Weak),
    else the best composite score of type key, provider and latest system prompt that reaches
    the threshold (CompositeMatch, with the score as confidence), else New. Ties go to the
    earliest founder, then the smallest id.

    Weak and composite matches depend on providers and prompts that earlier matches added:
    `resolution` folds slices of time at once and again where what enters them has changed.
    `report` takes the number of slices of each round."""
    return with_confidence(resolution.resolve(resolution.sliced(resolution_entries(actions), slice_entries), report))


def resolution_entries(actions: DataFrame) -> DataFrame:
    """What resolution reads of the actions: first actions, first uses of providers, prompts."""
    keyed = materialize(identity_labels(identity_keys(actions)).select(*INSTANCE, *AT, *TYPE, "tag", "prompt", "identity_label"))
    return resolution.entries_of(keyed, _firsts(keyed))


def with_confidence(state: DataFrame) -> DataFrame:
    confidence = F.when(F.col("level").isin("CompositeMatch", "SemanticMatch"), F.col("score"))
    for name, value in rules.MATCH_CONFIDENCE.items():
        confidence = confidence.when(F.col("level") == name, value)
    return state.select(*INSTANCE, "identity_id", "level", confidence.alias("confidence"), *AT)


def assign_identities(actions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every action with identity_id, match_type and confidence."""
    keyed = identity_keys(actions)
    by_instance = resolved.select(*INSTANCE, "identity_id", "level", F.col("confidence").alias("_c"), F.col("event_id").alias("_first"))
    joined = keyed.join(by_instance, INSTANCE)
    opening = F.col("event_id") == F.col("_first")
    return joined.withColumn("match_type", F.when(opening, F.col("level")).otherwise("ExactInstance")).withColumn(
        "match_confidence", F.when(opening, F.col("_c")).otherwise(rules.MATCH_CONFIDENCE["ExactInstance"])
    ).drop("level", "_c", "_first")


# ---------------------------------------------------------------- composite scores

_FLAGS = ["prompt", "digest", "provider"]
#: Members of a class that meet as one row.
PAIR_BLOCK = 1024


def _combos(weights, threshold) -> list[tuple]:
    """(mask of parts the candidate has, parts that are equal, flags that are equal) that can
    still reach the threshold."""
    found = []
    for mask in range(8):
        for equal in range(8):
            if equal & ~mask:
                continue
            for flags in range(8):
                top = (weights["type"] if equal else 0) + sum(
                    weights[w] for i, w in enumerate(("prompt", "behavior", "network")) if flags >> i & 1
                )
                if top >= threshold - 1e-9:
                    found.append((mask, equal, flags))
    return found


def _combo_rows(combos) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('mask', {m}, 'equal', {e}, 'flags', {f})" for m, e, f in combos) + ")")


def _pattern_key(c) -> Column:
    bit = lambda field, i: F.shiftright(c[field], i).bitwiseAND(1) == 1
    parts = [F.when(bit("equal", i), F.col(n).cast("string")) for i, n in enumerate(TYPE)]
    parts += [F.when(bit("flags", i), F.col(n).cast("string")) for i, n in enumerate(_FLAGS)]
    return F.concat_ws("|", c["mask"].cast("string"), c["equal"].cast("string"), c["flags"].cast("string"), *parts)


def _blocking(weights: dict, threshold: float, fuzzy: bool) -> list:
    """Smallest sets of equal attributes, (type part or None, flags), without which no pair
    reaches the threshold. One equal part may give the whole type score; a fuzzy prompt may
    add its whole weight to any pair."""
    flags = [("digest", "behavior"), ("provider", "network")] + ([] if fuzzy else [("prompt", "prompt")])
    sets = []
    for size in range(len(flags) + 1):
        for chosen in combinations(flags, size):
            names = frozenset(f for f, _ in chosen)
            base = sum(weights[w] for _, w in chosen) + (weights["prompt"] if fuzzy else 0.0)
            for part, gain in ((None, 0.0), *((t, weights["type"]) for t in TYPE)):
                if base + gain >= threshold - 1e-9 and not any(p in (None, part) and f <= names for p, f in sets):
                    sets.append((part, names))
    return sets


def _blocks(members: DataFrame, name: str, id_: Column) -> DataFrame:
    """key, name, place: the members `m` of each key as lists of about PAIR_BLOCK."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("place", F.pmod(F.xxhash64(id_), F.col("blocks")))
    return dealt.groupBy("key", "place").agg(F.collect_list("m").alias(name)).withColumnRenamed("place", f"{name}_place")


def score_candidates(new: DataFrame, identities: DataFrame, semantic=False, threshold=rules.COMPOSITE_THRESHOLD) -> DataFrame:
    """All pairs at or above the threshold, each once: (new_id, identity_id, first_seen, score).

    new(new_id, sig, sdk, model, prompt, digest, provider); identities(identity_id, first_seen,
    sig, sdk, model, prompt, digest, providers); 0 or null = absent. With semantic weights prompts
    are SimHashes that count by 1 - hamming / 64, else they are equal or not.

    Rows of equal attributes are one class, scored once (`class_scores`). Members of the classes that
    match meet in blocks, dealt out evenly, so a popular model or provider fills no single task. The
    result has as many rows as there are pairs; `pattern_candidates` with `best_composite_match` gives
    the best one of each new row without them."""
    asked = new.select(F.col("new_id").alias("m"), F.struct(*TYPE, *_FLAGS).alias("key"))
    listed = F.array_sort(F.array_distinct(F.coalesce("providers", F.array().cast("array<string>"))))
    known = identities.select("identity_id", "first_seen", F.struct(*TYPE, "prompt", "digest", listed.alias("providers")).alias("known"))
    scores = class_scores(asked.select("key").distinct(), known.select("known").distinct(), semantic, threshold)
    matched = scores.join(known, "known").select("key", F.struct("identity_id", "first_seen", "score").alias("m"))
    theirs = _blocks(matched, "theirs", F.col("m.identity_id"))
    mine = _blocks(asked.join(scores.select("key").distinct(), "key", "left_semi"), "mine", F.col("m"))
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = mine.join(theirs, "key").repartition(parts, "key", "mine_place", "theirs_place")
    return met.select("theirs", F.explode("mine").alias("new_id")).select("new_id", F.inline("theirs"))


def class_scores(new: DataFrame, identities: DataFrame, semantic=False, threshold=rules.COMPOSITE_THRESHOLD) -> DataFrame:
    """(key, known, score) of the classes that reach the threshold: new(key: struct of sig, sdk, model,
    prompt, digest, provider), identities(known: the same with providers).

    Classes meet on the attribute sets that a pair needs (equi-joins), and a pair is kept at the
    first set it shares."""
    weights = rules.SCORE_WEIGHTS["semantic" if semantic else "fallback"]
    sets = _blocking(weights, threshold, semantic)
    a, b = F.col("key"), F.col("known")
    part_of = lambda row, n: F.nullif(row[n].cast("bigint"), F.lit(0))

    def set_key(row, i, provider):
        part, flags = sets[i]
        values = ([part_of(row, part)] if part else []) + [provider if f == "provider" else row[f] for f in ("prompt", "digest", "provider") if f in flags]
        present = reduce(lambda x, y: x & y, [v.isNotNull() for v in values])
        return F.when(present, F.concat_ws("|", F.lit(str(i)), *[v.cast("string") for v in values]))

    asked = new.select("key", F.explode(F.array_compact(F.array(*[set_key(a, i, a["provider"]) for i in range(len(sets))]))).alias("_set"))

    def sets_of(i):
        return F.transform(b["providers"], lambda p: set_key(b, i, p)) if "provider" in sets[i][1] else F.array(set_key(b, i, None))

    known = identities.select("known", F.explode(F.array_compact(F.flatten(F.array(*[sets_of(i) for i in range(len(sets))])))).alias("_set"))

    equal = {n: F.coalesce(part_of(a, n) == part_of(b, n), F.lit(False)) for n in TYPE}
    equal |= {"prompt": F.coalesce(a["prompt"] == b["prompt"], F.lit(False)), "digest": F.coalesce(a["digest"] == b["digest"], F.lit(False)), "provider": F.coalesce(F.array_contains(b["providers"], a["provider"]), F.lit(False))}
    total = lambda test: sum((F.when(test(n), rules.TYPE_WEIGHTS[n]).otherwise(0.0) for n in TYPE), F.lit(0.0))
    shared = total(lambda n: part_of(a, n).isNotNull() & part_of(b, n).isNotNull())
    prompt = F.when(equal["prompt"], 1.0).otherwise(0.0)
    if semantic:
        prompt = F.coalesce(1 - F.bit_count(a["prompt"].cast("bigint").bitwiseXOR(b["prompt"].cast("bigint"))) / F.lit(64.0), F.lit(0.0))
    score = weights["prompt"] * prompt + weights["type"] * F.when(shared > 0, F.try_divide(total(lambda n: equal[n]), shared)).otherwise(0.0)
    score = score + F.when(equal["digest"], weights["behavior"]).otherwise(0.0) + F.when(equal["provider"], weights["network"]).otherwise(0.0)
    first = F.coalesce(*[F.when(reduce(lambda x, y: x & y, [equal[n] for n in ([p] if p else []) + sorted(f)]), F.lit(str(i))) for i, (p, f) in enumerate(sets)])
    met = asked.join(known, "_set").select("key", "known", "_set", F.round(score, 9).alias("score"), first.alias("_first"))
    return met.filter((F.col("score") >= threshold) & (F.substring_index("_set", "|", 1) == F.col("_first"))).select("key", "known", "score")


def pattern_candidates(new: DataFrame, identities: DataFrame, semantic=False, threshold=rules.COMPOSITE_THRESHOLD) -> DataFrame:
    """Candidates of each new row: (new_id, identity_id, first_seen, score), the earliest one per
    pattern of equal attributes, scores at or above the threshold; the best of a row is among
    them. Prompts count as equal or not.

    new(new_id, sig, sdk, model, prompt, digest, provider); identities(identity_id, first_seen,
    sig, sdk, model, prompt, digest, providers); 0 or null = absent. The score depends only on
    which attributes are equal, so candidates are reduced to the earliest one per pattern key
    before the join, and no pair list of a popular model or provider is ever built."""
    weights = rules.SCORE_WEIGHTS["semantic" if semantic else "fallback"]
    combos = _combos(weights, threshold)
    present = lambda: sum((F.when(F.coalesce(F.col(n), F.lit(0)) != 0, 1 << i).otherwise(0) for i, n in enumerate(TYPE)), F.lit(0))
    has_flags = sum((F.when(F.col(n).isNotNull(), 1 << i).otherwise(0) for i, n in enumerate(_FLAGS)), F.lit(0))

    offered = identities.withColumn("provider", F.explode_outer("providers"))
    offered = settle(offered, _mask=present(), _flags=has_flags)
    fits = lambda c: (c["mask"] == F.col("_mask")) & (c["flags"].bitwiseAND(F.bitwise_not("_flags")) == 0)
    offered = offered.select("identity_id", "first_seen", *TYPE, *_FLAGS, F.explode(F.filter(_combo_rows(combos), fits)).alias("c"))
    best = offered.groupBy(_pattern_key(F.col("c")).alias("key")).agg(F.min(F.struct("first_seen", "identity_id")).alias("who"))

    asked = settle(new, _mask=present(), _flags=has_flags)
    possible = lambda c: (c["equal"].bitwiseAND(F.bitwise_not("_mask")) == 0) & (c["flags"].bitwiseAND(F.bitwise_not("_flags")) == 0)
    asked = asked.select("new_id", "_mask", *TYPE, *_FLAGS, F.explode(F.filter(_combo_rows(combos), possible)).alias("c"))
    part_weights = [rules.TYPE_WEIGHTS[n] for n in TYPE]
    total = lambda bits: sum((F.when(F.shiftright(bits, i).bitwiseAND(1) == 1, w).otherwise(0.0) for i, w in enumerate(part_weights)), F.lit(0.0))
    shared = total(F.col("c.mask").bitwiseAND(F.col("_mask")))
    type_score = F.when(shared > 0, F.try_divide(total(F.col("c.equal")), shared)).otherwise(0.0)
    score = F.lit(weights["type"]) * type_score
    for i, w in enumerate(("prompt", "behavior", "network")):
        score = score + F.when(F.shiftright(F.col("c.flags"), i).bitwiseAND(1) == 1, weights[w]).otherwise(0.0)
    keyed = settle(asked, score=F.round(score, 9), key=_pattern_key(F.col("c"))).filter(F.col("score") >= threshold)
    found = keyed.join(best, "key")
    return found.select("new_id", F.col("who.identity_id").alias("identity_id"), F.col("who.first_seen").alias("first_seen"), "score")


def best_composite_match(scores: DataFrame) -> DataFrame:
    """Best candidate per new row; ties: earliest first_seen, smallest id."""
    order = F.struct(-F.col("score"), F.col("first_seen"), F.col("identity_id"))
    best = scores.groupBy("new_id").agg(F.min_by(F.struct("identity_id", "score"), order).alias("b"))
    level = F.when(F.col("b.score") >= rules.SEMANTIC_THRESHOLD, "SemanticMatch").otherwise("CompositeMatch")
    return best.select("new_id", "b.identity_id", "b.score", level.alias("level"))


# ---------------------------------------------------------------- per identity
# Input of the operators below: actions with identity_id, ts (microseconds), event_id, label,
# action_provider, streaming.


def identity_timeline(actions: DataFrame, cap=rules.TIMELINE_CAP) -> DataFrame:
    """The last `cap` actions per identity, with pos = 1 for the newest: a top-n view. Spark limits
    each group before the shuffle (row_number <= cap). Summaries, narratives and digests take all
    actions, or such a view where one is wanted."""
    newest = Window.partitionBy("identity_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return actions.withColumn("pos", F.row_number().over(newest)).filter(F.col("pos") <= cap)


def timeline_summary(actions: DataFrame) -> DataFrame:
    """'Label xN, ...' by count, then label."""
    counts = actions.groupBy("identity_id", "label").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("label"))))
    text = F.transform(ordered, lambda s: F.concat(s["label"], F.lit(" x"), (-s["m"]).cast("string")))
    return counts.groupBy("identity_id").agg(
        F.array_join(text, ", ").alias("summary"), F.sum("n").alias("timeline_len")
    )


def identity_rollup(actions: DataFrame) -> DataFrame:
    return actions.groupBy("identity_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("event_count"),
        F.countDistinct(*INSTANCE).alias("instances"), F.array_sort(F.collect_set("tag")).alias("providers"),
    )


def narratives(actions: DataFrame, labels: DataFrame) -> DataFrame:
    """One sentence per identity from its actions; labels(identity_id, identity_label)."""
    is_ = lambda name: F.col("label") == name
    known = F.col("label").isin("LlmCall", "LlmStreamRecv", "Connect") & (F.col("action_provider") != "Other")
    facts = actions.groupBy("identity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_("LlmCall")).alias("calls"), F.count_if(is_("McpCall")).alias("tools"),
        F.count_if(is_("PiiDetected")).alias("pii"), F.count_if(is_("LlmStreamRecv") | (is_("LlmCall") & F.col("streaming"))).alias("streams"),
        F.max_by(F.col("action_provider"), F.when(known, F.struct(*AT))).alias("primary"),
    )
    text = lambda n: F.col(n).cast("string")
    streamed = F.when(F.col("streams") > 0, F.concat(F.lit(" ("), text("streams"), F.lit(" streaming)"))).otherwise("")
    calls = F.concat(text("calls"), F.lit(" "), F.coalesce("primary", F.lit("Other")), F.lit(" call"), plural(F.col("calls")), streamed)
    parts = F.array_compact(
        F.array(
            F.when(F.col("calls") > 0, calls),
            F.when(F.col("tools") > 0, F.concat(text("tools"), F.lit(" MCP tool"), plural(F.col("tools")))),
            F.when(F.col("pii") > 0, F.concat(text("pii"), F.lit(" PII event"), plural(F.col("pii")))),
        )
    )
    name = F.col("identity_label")
    bare = F.concat(name, F.lit(": "), text("n"), F.lit(" event"), plural(F.col("n")))
    told = F.concat(name, F.lit(" agent: "), F.array_join(parts, ", "))
    joined = labels.join(facts, "identity_id", "left")
    none = F.concat(name, F.lit(": no activity recorded"))
    return joined.select(
        "identity_id", F.when(F.col("n").isNull(), none).when(F.size(parts) == 0, bare).otherwise(told).alias("narrative")
    )


def founder_labels(actions: DataFrame) -> DataFrame:
    """Label of each identity: that of its first event."""
    return identity_labels(actions).groupBy("identity_id").agg(F.min_by("identity_label", F.struct(*AT)).alias("identity_label"))


def behavioral_digest(actions: DataFrame, top=8, slice_us=SLICE_US) -> DataFrame:
    """FNV-64 over the most frequent pairs of consecutive labels; none below two actions."""
    steps = carry_last(actions, ["identity_id"], AT, time_slice(F.col("ts"), slice_us), F.col("label"), "_last", inclusive=False)
    pairs = steps.filter(F.col("_last").isNotNull())
    counts = pairs.groupBy("identity_id", "_last", "label").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("_last").alias("a"), F.col("label").alias("b"))))
    best = counts.groupBy("identity_id").agg(F.slice(ordered, 1, top).alias("best"))
    as_bytes = lambda s: F.concat(
        utf8_bytes(F.concat(s["a"], F.lit("|"), s["b"], F.lit(":"))), le_bytes(-s["m"], 4), F.array(F.lit(10).cast("bigint"))
    )
    return best.select("identity_id", fnv64_bytes(F.flatten(F.transform("best", as_bytes))).alias("behavioral_digest"))


def digest_refresh_points(actions: DataFrame, every=10, minimum=4, slice_us=SLICE_US) -> DataFrame:
    """Actions after which the digest is recomputed: every tenth, once four are kept."""
    numbered = sequence_number(actions, ["identity_id"], AT, time_slice(F.col("ts"), slice_us), "event_count")
    return numbered.filter((F.col("event_count") >= minimum) & (F.col("event_count") % every == 0))


def prompt_fingerprints(events: DataFrame, prompt="system_prompt") -> DataFrame:
    """Add prompt_fingerprint: FNV-64 of the prompt, hashed once per distinct text."""
    texts = events.select(prompt).filter(F.length(prompt) > 0).distinct()
    return events.join(texts.withColumn("prompt_fingerprint", fnv64(F.col(prompt))), prompt, "left")


def latest_prompt_fingerprint(events: DataFrame, prompt="system_prompt") -> DataFrame:
    """Per identity, the fingerprint of its newest non-empty prompt."""
    last = events.filter(F.length(prompt) > 0).groupBy("identity_id").agg(F.max_by(prompt, F.struct(*AT)).alias(prompt))
    return last.select("identity_id", fnv64(F.col(prompt)).alias("prompt_fingerprint"))


def evict_identities(identities: DataFrame, cap=256) -> DataFrame:
    """The `cap` most recently seen identities (a top-k)."""
    return identities.orderBy(F.desc("last_seen"), "identity_id").limit(cap)


def instance_text() -> Column:
    return F.concat(
        F.lit("pid="), F.col("pid").cast("string"), F.lit(" cgroup="), F.col("cgroup_id").cast("string"),
        F.lit(" container=0x"), F.lower(F.hex("container_hash")),
    )


def attach_identity(events: DataFrame, matches: DataFrame, facts: DataFrame) -> DataFrame:
    """Fill the identity struct of each event: matches(event_id, identity_id, match_type,
    match_confidence, instance key), facts(identity_id, narrative, summary, timeline_len, ...)."""
    opt = lambda n: F.col(n) if n in facts.columns else F.lit(None)
    found = matches.join(facts, "identity_id", "left").select(
        "event_id",
        struct_of(
            schemas.IDENTITY, id=F.col("identity_id"), instance=instance_text(), confidence=F.col("match_confidence"),
            match_type=F.col("match_type"), narrative=opt("narrative"), timeline=opt("summary"), timeline_len=opt("timeline_len"),
            prompt_fingerprint=opt("prompt_fingerprint"), behavioral_digest=opt("behavioral_digest"), capability_hash=opt("capability_hash"),
            graph_node_count=opt("graph_node_count"), graph_edge_count=opt("graph_edge_count"),
        ).alias("_id"),
    )
    rest = [c for c in events.columns if c != "identity"]
    return events.join(found, "event_id", "left").select(*rest, F.col("_id").alias("identity"))


def identity_actions(events: DataFrame) -> DataFrame:
    """Events that count for identities, with their keys."""
    return identity_keys(to_identity_actions(events))
