import re

from pyspark.sql import functions as F

from palisade.llm.common import n_words
from palisade.llm.mixing import _sources, _weighted, cyclic_weights, fill_sources, mix, plan_of, route
from palisade.llm.queries import QUERIES


def filled(sizes, weights):
    """Water-filling by bisection of the level."""
    total, lo, hi = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(3 * sizes[s], mid * weights[s]) for s in sizes) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(3 * sizes[s], hi * weights[s]) for s in sizes}


def test_targets_equal_bisection(llm):
    for sizes in ({"a": 10, "b": 1000, None: 3}, {"x": 1}, {"a": 0, "b": 7, "c": 5, "d": 100, "é": 2}, {"a": 10, "b": 1000, None: 3, "é": 70, "zz": 0, "c": 5}):
        named = _weighted(_sources(llm.createDataFrame([([s], n) for s, n in sizes.items()], "pattern array<string>, tokens long")), cyclic_weights)
        got = {r["source"]: (r["weight"], r["target"]) for r in fill_sources(named, float(sum(sizes.values()))).collect()}
        w = cyclic_weights(list(sizes))
        want = filled(sizes, w)
        assert {s: x for s, (x, _) in got.items()} == w and all(abs(got[s][1] - want[s]) < 1e-6 for s in sizes)


def test_weights_go_by_code_point_null_last():
    assert cyclic_weights([None, "é", "b", "a"]) == {"a": 1, "b": 2, "é": 3, None: 1}


def test_flow_reroutes_what_overlapping_patterns_sent():
    # the overlap must serve b, though a could take it
    got = route({("a",): 10, ("a", "b"): 10}, {"a": 10.0, "b": 10.0})
    assert got == {("a",): 10.0, ("a", "b"): 10.0}
    got = route({("a", "b"): 10, ("b",): 10}, {"a": 30.0, "b": 0.0})
    assert got == {("a", "b"): 30.0, ("b",): 0.0}


def test_flow_repeats_only_where_needed():
    got = route({("a",): 10, ("b",): 100}, {"a": 25.0, "b": 50.0})
    assert got == {("a",): 25.0, ("b",): 50.0}


def check(rows, got):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = filled(sizes, cyclic_weights(list(sizes))) if sum(sizes.values()) else {s: 0 for s in sizes}
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        s = r["pattern"][0]
        assert 0 <= r["n_copies"] <= 3 and r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-3 * max(1, targets[s])
        taken[s] = taken.get(s, 0) + r["n_copies"] * r["size"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]


def test_odd_rows(odd_docs):
    got = mix(odd_docs, "doc_id", n_words(F.col("text")), F.array("source")).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()], got)


def test_whole_table_and_reruns_agree(llm, sf_dir):
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    a = mix(docs, "doc_id", n_words(F.col("text")), F.array("source")).collect()
    b = mix(docs.repartition(5), "doc_id", n_words(F.col("text")), F.array("source")).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], a)
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_many_buckets(llm, monkeypatch):
    from palisade.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    docs = llm.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 7))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 5))").alias("source"))
    check([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], mix(docs, "doc_id", n_words(F.col("text")), F.array("source")).collect())


def test_overlapping_sources(llm):
    docs = llm.createDataFrame([(i, 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)], "doc_id long, size long, sources array<string>")
    got = mix(docs, "doc_id", F.col("size"), F.col("sources"), weights=lambda names: {"a": 1, "b": 1}).collect()
    assert len(got) == 100 and abs(sum(r["n_copies"] * 10 for r in got) - 1000) <= 20


def test_flows_apart(llm):
    """Overlaps in two groups and a source of its own: each group's flow as if it were alone."""
    rows = [(["a", "b"], 100), (["a"], 40), (["c", "d"], 60), (["d"], 10), (["e"], 30), ([None, "f"], 20)]
    patterns = llm.createDataFrame(rows, "pattern array<string>, tokens long").selectExpr("*", "to_json(pattern) AS _p", "1L AS rows")
    names = ["a", "b", "c", "d", "e", None, "f"]
    targets = dict(zip(names, [50.0, 90.0, 100.0, 20.0, 45.0, 10.0, 5.0]))
    sources = llm.createDataFrame([(n, 1, i, targets[n]) for i, n in enumerate(names)], "source string, size long, rank long, target double")
    got = {tuple(r["pattern"]): r["taken"] for r in plan_of(patterns, sources).join(patterns.select("_p", "pattern"), "_p").collect()}
    assert got == route({tuple(p): n for p, n in rows}, targets)


def test_very_many_sources(llm):
    """A source for each document: nothing but tables of that size, and none of it on the driver."""
    n = 200_000
    docs = llm.range(n).selectExpr("id AS doc_id", "1 + id % 5 AS size", "array(concat('s', id)) AS sources")
    got = mix(docs, "doc_id", F.col("size"), F.col("sources"))
    total = got.agg(F.count("*"), F.sum(F.col("n_copies") * F.col("size")), F.sum("target"), F.max("n_copies")).first()
    assert total[0] == n and abs(total[2] - 3 * n) < 1e-3 * n and abs(total[1] - 3 * n) < n and total[3] <= 3
    targets = {r["t"] for r in got.where("size = 5").select(F.round("target", 6).alias("t")).distinct().collect()}
    assert len(targets) == 3


def test_empty_table(no_docs, llm, sf_dir):
    assert mix(no_docs, "doc_id", n_words(F.col("text")), F.array("source")).collect() == []
    assert QUERIES["op5_mixing"](llm, sf_dir).count() == llm.read.parquet(f"{sf_dir}/documents.parquet").count()
