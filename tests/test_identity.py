"""Identity resolution against an event-by-event fold, and match-level cases."""

import random

import pytest
from pyspark.sql import functions as F

from palisade import schemas
from palisade.operators import graph as G
from palisade.operators import identity as I
from palisade.operators import resolution
from palisade.operators.normalize import struct_of, to_identity_actions
from palisade.plans.stage import materialize

COLUMNS = "event_id long, us long, pid long, type string, provider string, kind string, fingerprint long, sdk_hash long, model_hash long, system_prompt string"


def events(spark, rows):
    f = spark.createDataFrame([(*r, None)[:10] for r in rows], COLUMNS)
    names = ["type", "provider", "kind", "fingerprint", "sdk_hash", "model_hash", "system_prompt"]
    return f.select(
        "event_id", F.timestamp_micros("us").alias("timestamp"),
        struct_of(schemas.PROCESS, pid=F.col("pid"), name=F.lit("x"), container_id=F.lit(""), cgroup_id=F.lit(1)).alias("process"),
        struct_of(schemas.ACTION, **{n: F.col(n) for n in names}).alias("action"),
    )


def score(identity, key, provider, prompt):
    """Composite score of an identity for a new instance, from its definition."""
    total = 0.15 if prompt is not None and identity["prompt"] == prompt else 0.0
    shared = [(w, a == b) for w, a, b in zip((0.4, 0.3, 0.3), identity["key"], key) if a and b]
    if shared:
        total += 0.40 * sum(w for w, same in shared if same) / sum(w for w, _ in shared)
    return round(total + (0.20 if provider is not None and provider in identity["providers"] else 0.0), 6)


def fold(rows):
    """Plain statement of the cascade, one event at a time: pid -> (founder, level, confidence)."""
    known, identities, out = {}, [], {}
    fixed = {"StrongType": 0.95, "MediumType": 0.75, "Weak": 0.45, "New": 0.3}
    for ev, us, pid, kind, provider, net, sig, sdk, model, prompt in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "Network" and (net not in ("Connect", "Close") or provider is None):
            continue
        key = (sig or 0, sdk or 0, model or 0) if kind == "Prompt" else (0, 0, 0)
        if pid not in known:
            ranked = sorted(identities, key=lambda i: i["born"])
            same = [i for i in ranked if key[0] and key[2] and (i["key"][0], i["key"][2]) == (key[0], key[2])]
            users = [i for i in ranked if provider is not None and provider in i["providers"]]
            scores = [(score(i, key, provider, prompt), i) for i in ranked]
            best = max((s for s, _ in scores), default=0)
            sure = None
            if all(key) and any(i["key"] == key for i in same):
                found, level = next(i for i in same if i["key"] == key), "StrongType"
            elif same:
                found, level = same[0], "MediumType"
            elif not all(key) and users:
                found, level = users[0], "Weak"
            elif best >= 0.6:
                found, level, sure = next(i for s, i in scores if s == best), "CompositeMatch", best
            else:
                found, level = {"key": key, "born": (us, ev), "providers": set(), "founder": pid, "prompt": None}, "New"
                identities.append(found)
            known[pid] = found
            out[pid] = (found["founder"], level, sure or fixed[level])
        if provider is not None:
            known[pid]["providers"].add(provider)
        if prompt:
            known[pid]["prompt"] = prompt
    return out


SEEN: set = set()


def made(seed, n=220):
    rnd = random.Random(seed)
    rows = []
    for ev in range(n):
        kind = rnd.choice(["Prompt", "Prompt", "Response", "PiiDetected", "Network"])
        provider = rnd.choice(["OpenAI", "Anthropic", "Groq", "Cohere"]) if kind in ("Prompt", "Response") else None
        if kind == "Network":
            provider = rnd.choice([None, "Mistral", "OpenAI"])
        key = [rnd.choice([None, 11, 12, 13]), rnd.choice([None, 21, 22]), rnd.choice([None, 31, 32])] if kind == "Prompt" else [None] * 3
        net = rnd.choice(["Connect", "Close", "DataSent"]) if kind == "Network" else None
        prompt = rnd.choice([None, "", "be brief", "be kind"]) if kind == "Prompt" else None
        # late instances keep appearing, so matches depend on earlier matches
        rows.append((ev, ev * 1_000_000 * 120, rnd.randrange(max(1, ev // 4), ev // 3 + 2), kind, provider, net, *key, prompt))
    return rows


@pytest.mark.parametrize("seed,slice_entries", [(0, 100_000), (1, 100_000), (2, 100_000), (3, 50), (4, 50), (5, 20)])
def test_resolution_equals_fold(spark, seed, slice_entries):
    """In one slice, and in many that are folded at once until nothing changes."""
    rows, rounds = made(seed), []
    resolved = I.resolve_identities(to_identity_actions(events(spark, rows)), slice_entries, rounds)
    assert len(rounds) == 1 if slice_entries > 1000 else rounds[0] > 3 and len(rounds) < 8
    got = {r.pid: (r.identity_id, r.level, round(r.confidence, 6)) for r in resolved.collect()}
    want = fold(rows)
    assert {p: x[1:] for p, x in got.items()} == {p: x[1:] for p, x in want.items()}
    levels = {lvl for _, lvl, _ in want.values()}
    assert levels >= {"New", "Weak", "MediumType"}
    SEEN.update((lvl, sure) for _, lvl, sure in want.values())
    founder_id = {p: got[p][0] for p, (_, lvl, _) in got.items() if lvl == "New"}
    assert all(got[p][0] == founder_id[f] for p, (f, _, _) in want.items())


def test_every_level_was_seen():
    assert {lvl for lvl, _ in SEEN} == {"New", "Weak", "MediumType", "StrongType", "CompositeMatch"}
    assert {sure for lvl, sure in SEEN if lvl == "CompositeMatch"} >= {0.6, 0.75}


@pytest.mark.parametrize("seed,late", [(7, 0), (8, 25)])
def test_batches_equal_the_whole(spark, seed, late):
    """Batches in order fold their own entries alone; late ones also what they change."""
    rows = made(seed, 160)
    rnd = random.Random(seed)
    moved = set(rnd.sample(range(110), late))
    parts = [[r for i, r in enumerate(rows) if i < 110 and i not in moved], [r for i, r in enumerate(rows) if 110 <= i < 140], [r for i, r in enumerate(rows) if i >= 140 or i in moved]]
    log, state = None, None
    for part in parts:
        ran = []
        before = 0 if log is None else log.select("slice").distinct().count()
        entries = I.resolution_entries(to_identity_actions(events(spark, part)))
        more, changed, state = resolution.extend(log, state, entries, 40, ran)
        log = materialize(more if log is None else log.unionByName(more.select(*log.columns)))
        new = log.select("slice").distinct().count() - before
        if before and not (late and part is parts[2]):
            assert ran[0] == new and changed.where(F.col("slice") < before).isEmpty()
    whole = I.resolve_identities(to_identity_actions(events(spark, rows)))
    names = ["pid", "identity_id", "level", "confidence", "ts", "event_id"]
    key = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert key(I.with_confidence(state)) == key(whole)
    # nothing new: nothing runs
    again, changed, _ = resolution.extend(log, state, I.resolution_entries(to_identity_actions(events(spark, parts[1]))), 40, ran := [])
    assert ran == [] and again.count() == changed.count() == 0


def test_an_agent_that_changes_its_model_stays_itself(spark):
    rows = [
        (1, 1000, 1, "Prompt", "OpenAI", None, 5, 6, 7, "You are a helper"),
        (2, 2000, 2, "Prompt", "OpenAI", None, 5, 6, 8, "You are a helper"),
        (3, 3000, 3, "Prompt", "OpenAI", None, 5, 6, 9, "You are something else"),
        (4, 4000, 1, "Prompt", "OpenAI", None, 5, 6, 7, "A newer prompt"),
        (5, 5000, 4, "Prompt", "OpenAI", None, 5, 6, 4, "You are a helper"),
    ]
    got = {r.pid: (r.level, round(r.confidence, 6)) for r in I.resolve_identities(to_identity_actions(events(spark, rows))).collect()}
    assert got == {1: ("New", 0.3), 2: ("CompositeMatch", 0.63), 3: ("New", 0.3), 4: ("New", 0.3)}


def test_match_levels(spark):
    rows = [
        (1, 1000, 1, "Prompt", "OpenAI", None, 5, 6, 7),
        (2, 2000, 1, "Prompt", "OpenAI", None, 5, 6, 7),
        (3, 3000, 2, "Prompt", "OpenAI", None, 5, 6, 7),
        (4, 4000, 3, "Prompt", "Groq", None, 5, 9, 7),
        (5, 5000, 4, "Response", "OpenAI", None, None, None, None),
        (6, 6000, 5, "Prompt", "OpenAI", None, 8, 6, 7),
        (7, 7000, 6, "PiiDetected", None, None, None, None, None),
    ]
    actions = to_identity_actions(events(spark, rows))
    got = I.assign_identities(actions, I.resolve_identities(actions))
    level = {r.event_id: (r.match_type, r.match_confidence) for r in got.collect()}
    assert level == {
        1: ("New", 0.3), 2: ("ExactInstance", 1.0), 3: ("StrongType", 0.95), 4: ("MediumType", 0.75), 5: ("Weak", 0.45),
        6: ("New", 0.3), 7: ("New", 0.3),
    }


@pytest.mark.parametrize("semantic", [False, True])
def test_all_pairs_are_scored_once(spark, semantic):
    rnd = random.Random(7)
    some = lambda *v: rnd.choice([None, *v])
    prompts = [rnd.getrandbits(63) for _ in range(3)]
    near = lambda: (lambda p: p and p ^ (1 << rnd.randrange(60)) if semantic and rnd.random() < 0.7 else p)(some(*prompts))
    new = [(i, some(0, 1, 2), some(0, 1, 2), some(0, 1), near(), some(5, 6), some("A", "B")) for i in range(60)]
    known = [(i, i, some(0, 1, 2), some(0, 1, 2), some(0, 1), near(), some(5, 6), rnd.sample(["A", "B", "C"], rnd.randrange(4))) for i in range(40)]
    weights = {"prompt": 0.40, "type": 0.25, "digest": 0.20, "net": 0.15} if semantic else {"prompt": 0.15, "type": 0.40, "digest": 0.25, "net": 0.20}
    want = set()
    for n, *key, prompt, digest, provider in new:
        for i, _, *other, prompt2, digest2, providers in known:
            shared = [(w, a == b) for w, a, b in zip((0.4, 0.3, 0.3), key, other) if a and b]
            like = 0.0 if prompt is None or prompt2 is None else 1 - bin(prompt ^ prompt2).count("1") / 64 if semantic else float(prompt == prompt2)
            total = weights["prompt"] * like + (weights["type"] * sum(w for w, s in shared if s) / sum(w for w, _ in shared) if shared else 0)
            total += weights["digest"] * (digest is not None and digest == digest2) + weights["net"] * (provider in providers)
            if round(total, 9) >= 0.6:
                want.add((n, i, round(total, 9)))
    a = spark.createDataFrame(new, "new_id long, sig long, sdk long, model long, prompt long, digest long, provider string")
    b = spark.createDataFrame(known, "identity_id long, first_seen long, sig long, sdk long, model long, prompt long, digest long, providers array<string>")
    rows = [(r.new_id, r.identity_id, r.score) for r in I.score_candidates(a, b, semantic=semantic).collect()]
    assert len(rows) == len(set(rows)) == len(want) > 30 and set(rows) == want


def test_pairs_of_one_class_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(I, "PAIR_BLOCK", 100, raising=False)
    new = spark.range(600).selectExpr("id AS new_id", "1L AS sig", "2L AS sdk", "3L AS model", "4L AS prompt", "5L AS digest", "'A' AS provider")
    known = spark.range(500).selectExpr("id AS identity_id", "id AS first_seen", "1L AS sig", "2L AS sdk", "0L AS model", "4L AS prompt", "6L AS digest", "array('B', 'A') AS providers")
    pairs = I.score_candidates(new, known)
    limits = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for name in limits:
        spark.conf.set(name, "-1")
    try:
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert sum(tasks) == 300_000 == pairs.select("new_id", "identity_id").distinct().count() and max(tasks) < 150_000


def test_relays(spark):
    cols = "identity_id long, container_id string, type string, ts_ms long, event_id long"
    case = lambda rows: sorted(tuple(r) for r in G.relay_edges(spark.createDataFrame(rows, cols)).select("from_id", "to_id").collect())
    sent = (1, "c", "Prompt", 10_000, 1)
    assert case([sent, (2, "c", "Response", 12_000, 2)]) == [(1, 2)]
    assert case([sent, (2, "d", "Response", 12_000, 2)]) == []
    assert case([sent, (2, "c", "Response", 15_000, 2)]) == []
    assert case([sent, (1, "c", "Response", 12_000, 2)]) == []
    assert case([(1, "", "Prompt", 1, 1), (2, "", "Response", 2, 2)]) == []
    # the receiver's own call comes first, the other's counts
    assert case([(2, "c", "Prompt", 9_000, 1), (3, "c", "Prompt", 9_500, 2), (1, "c", "Prompt", 9_600, 3), (2, "c", "ToolCall", 9_700, 4)]) == [(3, 2)]


def test_relays_across_slices(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(4), "c", rnd.choice(["Prompt", "Response", "McpRequest", "ToolCall"]), rnd.randrange(400_000), i) for i in range(600)]
    want = []
    for b, _, kind, t, e in rows:
        if kind in G.INBOUND:
            before = [(ts, ev, i) for i, _, k, ts, ev in rows if k in G.OUTBOUND and i != b and ts > t - 5000 and (ts, ev) < (t, e)]
            if before:
                want.append((min(before)[2], b, e))
    df = spark.createDataFrame(rows, "identity_id long, container_id string, type string, ts_ms long, event_id long")
    got = [tuple(r) for r in G.relay_edges(df, slice_ms=7_000).select("from_id", "to_id", "event_id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 50
