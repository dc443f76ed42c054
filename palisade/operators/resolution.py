"""Identity resolution by slices of time.

The cascade is a fold over events in time. Entries (first actions of instances, first uses of
providers, system prompts) are cut into slices of time of bounded size. One task folds a slice
from the state that enters it: founders of the type keys, identities of the instances and the
leaders of the providers that its entries ask for, and nothing else. That state comes from the
results of the earlier slices by joins. All slices run at once; those whose entering state has
changed run again, until none has. After round n the first n slices are right for good, and as a
slice asks for few facts that are mostly old, the rounds follow how far a change travels and
not the number of instances. The fixpoint is unique and equals the event-by-event fold."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import rules
from palisade.plans.stage import materialize

INSTANCE = ["pid", "container_hash", "cgroup_id"]
TYPE = ["sig", "sdk", "model"]
AT = ["ts", "event_id"]
SLICE_ENTRIES = 100_000
MAX_SLICES = 50_000

#: Parts of a full type key that a candidate must share, whether its key is full (it then differs
#: in the model), and the type score that gives. Signature and model together are an owner.
PATTERNS = [
    (("sig", "sdk"), False, 1.0), (("sdk", "model"), False, 1.0), (("sig",), False, 1.0), (("sdk",), False, 1.0), (("model",), False, 1.0),
    (("sig", "sdk"), True, rules.TYPE_WEIGHTS["sig"] + rules.TYPE_WEIGHTS["sdk"]),
]

KNOWN, FIRST, LINK, SAID = -1, 0, 1, 2
_KEYS = "pid long, container_hash long, cgroup_id long"
_FACT = f"slice int, {_KEYS}, identity_id long, f_ts long, f_ev long, sig long, sdk long, model long, tag string, tags array<string>, prompt long"
_BORN = f"{_KEYS}, identity_id long, level string, score double, slice int, ts long, event_id long, sig long, sdk long, model long"


def pattern_keys(key: tuple) -> list:
    """(key to look up, type score) of a full type key."""
    parts = dict(zip(TYPE, key, strict=True))
    return [((*(parts[c] if c in keep else 0 for c in TYPE), full), score) for keep, full, score in PATTERNS]


class Folded:
    """What is known while a slice is folded."""

    def __init__(self):
        self.identity: dict = {}  # instance -> identity
        self.founded: dict = {}  # identity -> (ts, event, identity) of its founder
        self.owner: dict = {}  # (signature, model) -> (founded, sdk)
        self.leader: dict = {}  # provider -> founded of the earliest identity that used it
        self.by_key: dict = {}  # type key as candidates are looked up -> identities
        self.used: dict = {}  # identity -> providers
        self.latest: dict = {}  # identity -> system prompt

    def know(self, who: tuple, key: tuple) -> None:
        """An identity and the type key of its founder."""
        one = who[2]
        if one in self.founded and self.founded[one] <= who:
            return
        self.founded[one] = who
        sig, sdk, model = key
        if sig and model and (sig, model) not in self.owner:
            self.owner[sig, model] = (who, sdk)
        listed = self.by_key.setdefault((sig, sdk, 0, True) if all(key) else (*key, False), [])
        if one not in listed:
            listed.append(one)

    def first(self, instance: tuple, at: tuple, key: tuple, tag, prompt, own: int) -> tuple:
        """Identity, level and score of an instance at its first action."""
        full = all(key)
        owned = self.owner.get((key[0], key[2])) if key[0] and key[2] else None
        found, level, score = own, "New", 0.0
        if owned is not None:
            found, level = owned[0][2], "StrongType" if full and owned[1] == key[1] else "MediumType"
        elif tag is not None and not full and tag in self.leader:
            found, level = self.leader[tag][2], "Weak"
        elif tag is not None and full:
            best = self._composite(key, tag, prompt)
            if best is not None:
                score, found = -best[0], best[1][2]
                level = "SemanticMatch" if score >= rules.SEMANTIC_THRESHOLD else "CompositeMatch"
        if level == "New":
            self.know((*at, own), key)
        self.identity[instance] = found
        return found, level, score

    def _composite(self, key: tuple, tag, prompt):
        """(-score, founded) of the best candidate that has used the provider."""
        weights, best = rules.SCORE_WEIGHTS["fallback"], None
        for look, like in pattern_keys(key):
            for one in self.by_key.get(look, ()):
                if tag in self.used.get(one, ()):
                    said = weights["prompt"] if prompt is not None and self.latest.get(one) == prompt else 0.0
                    score = round(weights["network"] + weights["type"] * like + said, 6)
                    if score >= rules.COMPOSITE_THRESHOLD and (best is None or (-score, self.founded[one]) < best):
                        best = (-score, self.founded[one])
        return best

    def link(self, instance: tuple, tag: str) -> None:
        one = self.identity.get(instance)
        if one is not None:
            self.used.setdefault(one, set()).add(tag)
            if one in self.founded and (tag not in self.leader or self.founded[one] < self.leader[tag]):
                self.leader[tag] = self.founded[one]

    def said(self, instance: tuple, prompt: int) -> None:
        one = self.identity.get(instance)
        if one is not None:
            self.latest[one] = prompt


def _fold(batches):
    """Rows of a slice in order: what is known, then entries. One row for each first action."""
    import pyarrow as pa

    slice_, folded = None, None
    names = [c.split()[0] for c in _BORN.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.int32()] + [pa.int64()] * 5
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("slice", "kind", *INSTANCE, *AT, *TYPE, "tag", "tags", "prompt", "identity_id", "f_ts", "f_ev")]
        for at_slice, kind, pid, container, cgroup, ts, ev, sig, sdk, model, tag, tags, prompt, one, f_ts, f_ev in zip(*columns, strict=True):
            if at_slice != slice_:
                slice_, folded = at_slice, Folded()
            instance = (pid, container, cgroup)
            if kind == FIRST:
                out.append((*instance, *folded.first(instance, (ts, ev), (sig, sdk, model), tag, prompt, one), slice_, ts, ev, sig, sdk, model))
            elif kind == LINK:
                folded.link(instance, tag)
            elif kind == SAID:
                folded.said(instance, prompt)
            else:
                who = (f_ts, f_ev, one)
                folded.know(who, (sig, sdk, model))
                if pid is not None:
                    folded.identity[instance] = one
                if tag is not None:
                    folded.leader[tag] = who
                if tags is not None:
                    folded.used[one] = set(tags)
                    folded.latest[one] = prompt
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names)


def entries_of(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """First actions, first uses of providers and system prompts as rows of one kind.

    keyed: actions with instance, AT, tag and prompt; firsts: instances with AT, type key, tag,
    prompt and own_id."""
    none = {**{c: F.lit(None).cast("bigint").alias(c) for c in TYPE}, "identity_id": F.lit(None).cast("bigint").alias("identity_id")}
    born = firsts.select(*INSTANCE, *AT, F.lit(FIRST).alias("kind"), *TYPE, "tag", "prompt", F.col("own_id").alias("identity_id"))
    links = keyed.where(F.col("tag").isNotNull()).groupBy(*INSTANCE, "tag").agg(F.min(F.struct(*AT)).alias("at"))
    links = links.select(*INSTANCE, "at.*", F.lit(LINK).alias("kind"), *[none[c] for c in TYPE], "tag", F.lit(None).cast("bigint").alias("prompt"), none["identity_id"])
    said = keyed.where(F.col("prompt").isNotNull()).select(*INSTANCE, *AT, F.lit(SAID).alias("kind"), *[none[c] for c in TYPE], F.lit(None).cast("string").alias("tag"), "prompt", none["identity_id"])
    return born.unionByName(links).unionByName(said)


def sliced(entries: DataFrame, slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """entries with their slice: consecutive ranges of time of about equal size. Entries of one
    event stay together."""
    entries = materialize(entries)
    n = max(1, min(MAX_SLICES, -(-entries.count() // slice_entries)))
    return materialize(entries.repartitionByRange(n, *AT).withColumn("slice", F.spark_partition_id()))


def founders_of(state: DataFrame) -> DataFrame:
    """identity_id, f_ts, f_ev, f_slice and the type key of the founder."""
    first = F.min_by(F.struct(*AT, *TYPE, "slice"), F.struct(*AT)).alias("f")
    one = state.where("level = 'New'").groupBy("identity_id").agg(first)
    return one.select("identity_id", F.col("f.ts").alias("f_ts"), F.col("f.event_id").alias("f_ev"), F.col("f.slice").alias("f_slice"), *[F.col(f"f.{c}") for c in TYPE])


def _look_up(full: Column) -> list:
    """The columns by which a founder is looked up as a candidate."""
    model = F.when(full, F.lit(0).cast("bigint")).otherwise(F.col("model"))
    return [F.col("sig").alias("k_sig"), F.col("sdk").alias("k_sdk"), model.alias("k_model"), full.alias("k_full")]


def _facts(df: DataFrame, **columns) -> DataFrame:
    """Rows of the entering state; columns that a kind of fact has not are null."""
    fields = [f.rsplit(" ", 1) for f in _FACT.split(", ")]
    return df.select(*[(columns.get(n, F.col(n) if n in df.columns else F.lit(None))).cast(t).alias(n) for n, t in fields])


class Slices:
    """Entries with their slices, and what each slice from `since` on asks of the earlier ones."""

    def __init__(self, entries: DataFrame, since: int = 0):
        self.entries, self.since = entries, F.col("slice") >= since
        self.born = entries.where((F.col("kind") == FIRST) & self.since)
        full = (F.col("sig") != 0) & (F.col("sdk") != 0) & (F.col("model") != 0)
        self.full = full
        at = entries.where(F.col("kind") == FIRST).select(*INSTANCE, F.col("slice").alias("_born"))
        later = entries.where((F.col("kind") != FIRST) & self.since).select("slice", *INSTANCE).distinct()
        self.visits = materialize(later.join(at, INSTANCE).where("_born < slice").drop("_born"))
        self.groups = self.born.where("sig <> 0 AND model <> 0").select("slice", "sig", "model").distinct()
        self.tags = self.born.where("tag IS NOT NULL").select("slice", "tag").distinct()
        zero = F.lit(0).cast("bigint")
        looks = [F.struct(*[(F.col(c) if c in keep else zero).alias(f"k_{c}") for c in TYPE], F.lit(whole).alias("k_full")) for keep, whole, _ in PATTERNS]
        self.keys = self.born.where(full & F.col("tag").isNotNull()).select("slice", F.inline(F.array(*looks))).distinct()

    def entering(self, state: DataFrame) -> DataFrame:
        """The facts that each slice asks for, from the earlier slices' results."""
        founders = materialize(founders_of(state))
        who = F.struct("f_ts", "f_ev", "identity_id", *TYPE)
        owned = founders.where("sig <> 0 AND model <> 0")
        owners = self.groups.join(owned, ["sig", "model"]).where("f_slice < slice").groupBy("slice", "sig", "model").agg(F.min(who).alias("w")).select("slice", "w.*")
        members = state.select(*INSTANCE, "identity_id")
        seen = self.visits.join(members, INSTANCE).join(founders, "identity_id")
        events = self.entries.where(F.col("kind") != FIRST).join(members.withColumnRenamed("identity_id", "one"), INSTANCE)
        used = materialize(events.where(F.col("kind") == LINK).groupBy(F.col("one").alias("identity_id"), "tag").agg(F.min("slice").alias("since")))
        offered = used.join(founders, "identity_id").groupBy("tag", F.col("since").alias("slice")).agg(F.min(who).alias("w"))
        before = Window.partitionBy("tag").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
        asked = self.tags.withColumn("asks", F.lit(True)).unionByName(offered, allowMissingColumns=True)
        leaders = asked.withColumn("w", F.min("w").over(before)).where("asks AND w IS NOT NULL").select("slice", "tag", "w.*")
        offers = founders.select("*", *_look_up(self.full))
        chosen = self.keys.join(offers, ["k_sig", "k_sdk", "k_model", "k_full"]).where("f_slice < slice").select("slice", *founders.columns).distinct()
        chosen = materialize(chosen.drop("f_slice"))
        ask = chosen.select("slice", "identity_id")
        had = ask.join(used, "identity_id").where("since < slice").groupBy("slice", "identity_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
        wanted = events.where(F.col("kind") == SAID).join(ask.select(F.col("identity_id").alias("one")).distinct(), "one", "left_semi")
        said = wanted.groupBy(F.col("one").alias("identity_id"), "slice").agg(F.max_by(F.col("prompt"), F.struct(*AT)).alias("said"))
        earlier = Window.partitionBy("identity_id").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
        both = ask.withColumn("asks", F.lit(True)).unionByName(said, allowMissingColumns=True)
        last = both.withColumn("prompt", F.last("said", ignorenulls=True).over(earlier)).where("asks").select("slice", "identity_id", "prompt")
        empty = F.array().cast("array<string>")
        candidates = chosen.join(last, ["slice", "identity_id"]).join(had, ["slice", "identity_id"], "left").withColumn("tags", F.coalesce("tags", empty))
        parts = [_facts(owners), _facts(seen), _facts(leaders), _facts(candidates)]
        return materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))

    def fold(self, entering: DataFrame | None, only: DataFrame | None) -> DataFrame:
        """Results of the first actions, of the slices in `only` or of all."""
        rows = self.entries.where(self.since).withColumns({c: F.lit(None).cast("bigint") for c in ("f_ts", "f_ev")}).withColumn("tags", F.lit(None).cast("array<string>"))
        if entering is not None:
            rows = rows.unionByName(entering.withColumn("kind", F.lit(KNOWN)), allowMissingColumns=True)
        if only is not None:
            rows = rows.join(only, "slice", "left_semi")
        ordered = rows.repartition("slice").sortWithinPartitions("slice", F.col("kind") >= 0, *AT, "kind", *INSTANCE, "tag", "identity_id")
        return ordered.mapInArrow(_fold, _BORN)


def changed_slices(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Slices whose facts are not the same in both, row by row."""
    counted = new.withColumn("n", F.lit(1))
    if old is not None:
        counted = counted.unionByName(old.withColumn("n", F.lit(-1)))
    return counted.groupBy(*new.columns).agg(F.sum("n").alias("n")).where("n <> 0").select("slice").distinct()


def resolve(entries: DataFrame, report: list | None = None) -> DataFrame:
    """Instance, identity_id, level, score, slice, AT and type key of each first action.

    entries: rows of `entries_of` with their slice. `report` takes the number of slices that ran
    in each round."""
    slices = Slices(entries)
    state = materialize(slices.fold(None, None))
    count = entries.select("slice").distinct().count()
    if report is not None:
        report.append(count)
    return state if count < 2 else _settle(slices, state, None, None, report)[0]


def _settle(slices: Slices, state: DataFrame, entering: DataFrame | None, touched: DataFrame | None, report: list | None) -> tuple:
    """(state, slices that ran): slices run until what enters them stays the same. entering: what
    the results in `state` were made from; touched: slices to run in any case."""
    ran = None
    while True:
        following = slices.entering(state)
        again = changed_slices(entering, following)
        again = materialize(again if touched is None else again.unionByName(touched).distinct())
        n = again.count()
        if n == 0:
            return state, ran
        if report is not None:
            report.append(n)
        redone = slices.fold(following, again)
        state = materialize(state.join(again, "slice", "left_anti").unionByName(redone.select(*state.columns)))
        ran = again if ran is None else ran.unionByName(again)
        entering, touched = following, None


# ---------------------------------------------------------------- more entries

_ONE = [*INSTANCE, "kind", "_use", "_said"]


def _keyed(entries: DataFrame) -> DataFrame:
    """What there is one entry of: the first action, the first use of a provider, a prompt's event."""
    return entries.withColumns({"_use": F.when(F.col("kind") == LINK, F.col("tag")), "_said": F.when(F.col("kind") == SAID, F.col("event_id"))})


def current(log: DataFrame) -> DataFrame:
    """The entries that count of all that were stored: the earliest of each kind."""
    rest = [c for c in log.columns if c not in (*INSTANCE, "kind")]
    one = _keyed(log).groupBy(*_ONE).agg(F.min_by(F.struct(*rest), F.struct(*AT)).alias("e"))
    return one.select(*INSTANCE, "kind", "e.*")


def latest(log: DataFrame) -> DataFrame:
    """The newest result of each instance; log has a column batch."""
    rest = [c for c in log.columns if c not in (*INSTANCE, "batch")]
    return log.groupBy(*INSTANCE).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*INSTANCE, "r.*")


def extend(stored: DataFrame | None, state: DataFrame | None, fresh: DataFrame, slice_entries: int = SLICE_ENTRIES, report: list | None = None) -> tuple:
    """(entries to store, results to store, results of all instances) after `fresh` entries came.

    stored: entries with their slices so far; state: their results. Entries that say nothing new
    (a known instance, a provider that it has used) are dropped. What is later than everything
    stored makes new slices, and only these run. Late entries join the slice of their time; it
    runs again and so do the slices that its changed results enter. The results are those of
    all entries resolved at once. Stored entries and results are read, not resolved again."""
    if stored is None:
        entries = sliced(fresh, slice_entries)
        state = resolve(entries, report)
        return entries, state, state
    now = materialize(current(stored))
    known = _keyed(now).select(*_ONE, F.struct(*AT).alias("_at"), F.col("slice").alias("_in"))
    asked = _keyed(fresh)
    on = [asked[c].eqNullSafe(known[c]) for c in _ONE]
    met = asked.join(known, on, "left").where(F.col("_at").isNull() | (F.struct(*[asked[c] for c in AT]) < F.col("_at")))
    news = materialize(met.select(*[asked[c] for c in fresh.columns], F.col("_in")))
    if news.isEmpty():
        return news.drop("_in").withColumn("slice", F.lit(0)).limit(0), state.limit(0), state
    last = now.agg(F.max(F.struct(*AT)).alias("at"), F.max("slice").alias("slice")).first()
    late = (F.col("ts") < last["at"]["ts"]) | ((F.col("ts") == last["at"]["ts"]) & (F.col("event_id") <= last["at"]["event_id"]))
    later = sliced(news.where(~late).drop("_in"), slice_entries).withColumn("slice", F.col("slice") + F.lit(last["slice"] + 1))
    behind = news.where(late)
    entering, touched = None, later.select("slice")
    if not behind.isEmpty():
        # late entries are few, and there is one row a slice: their slice is the last that starts before them
        starts = now.groupBy("slice").agg(F.min(F.struct(*AT)).alias("at")).select(F.col("at.ts").alias("ts"), F.col("at.event_id").alias("event_id"), "slice")
        order = Window.orderBy(*AT, F.col("slice").isNull())
        placed = starts.withColumn("_start", F.lit(True)).unionByName(behind, allowMissingColumns=True).withColumn("slice", F.coalesce(F.last("slice", ignorenulls=True).over(order), F.lit(0)))
        placed = materialize(placed.where("_start IS NULL").select(*later.columns, "_in"))
        touched = touched.unionByName(placed.select("slice")).unionByName(placed.where("_in IS NOT NULL").select(F.col("_in").alias("slice")))
        later = later.unionByName(placed.drop("_in"))
    later, touched = materialize(later), materialize(touched.distinct())
    since = touched.agg(F.min("slice")).first()[0]
    if since <= last["slice"]:
        entering = Slices(now, since).entering(state)
    entries = materialize(current(now.unionByName(later.select(*now.columns))))
    state, ran = _settle(Slices(entries, since), state, entering, touched, report)
    return later, state.join(ran.distinct(), "slice", "left_semi"), state
