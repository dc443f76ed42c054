import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import quality
from palisade.llm.queries import QUERIES


def made(n=600, seed=1):
    """Prose against shouted junk; host h0 is bad, h1 good, h2 has one document."""
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        host = f"h{i % 2}"
        bad = r.random() < (0.7 if host == "h0" else 0.05)
        words = ["".join("abcdefghij"[j] for j in r.integers(0, 10, r.integers(2, 8))) for _ in range(r.integers(20, 90))]
        text = " ".join(w.upper() + "!!" if bad else w for w in words) + "."
        rows.append((i, text, host, f"p{i % 3}", "x"))
        if r.random() < 0.5:
            labels.append((i, int(not bad)))
    rows.append((n, "one more plain text of some words that nobody labelled", "h2", "p0", "x"))
    return rows, labels


def spark_rows(llm, rows, labels):
    return llm.createDataFrame(rows, "doc_id long, text string, host string, path string, evidence string"), llm.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_shrinkage(llm):
    rows, labels = made()
    docs, known = spark_rows(llm, rows, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, known, F.col("host"), F.col("path")).collect()}
    assert len(got) == len(rows)
    open_ = [r for r in rows if r[0] not in dict(labels)]
    right = np.mean([got[d]["kept"] == ("!!" not in t) for d, t, *_ in open_])
    assert right > 0.98
    by_host = {h: next(got[d]["host_rate"] for d, _, g, *_ in rows if g == h) for h in ("h0", "h1", "h2")}
    assert by_host["h0"] < by_host["h2"] < by_host["h1"]  # a host of one document stays near the mean


def test_rates_equal_a_plain_computation(llm):
    counted = [("a", "x", 50.0, 45.0), ("a", "y", 5.0, 1.0), ("b", "x", 200.0, 20.0), ("c", "x", 1.0, 1.0)]
    got = {(r["host"], r["path"]): (r["host_rate"], r["path_rate"]) for r in quality.shrunk_sites(llm.createDataFrame(counted, "host string, path string, n double, k double")).collect()}

    def strength(groups):
        n = sum(g[0] for g in groups)
        m = sum(g[2] for g in groups) / len(groups)
        spread, noise = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups), sum(g[2] * (1 - g[2]) for g in groups)
        return min(max(m * (1 - m) / max((spread - noise) / n, 1e-4) - 1, 1.0), 10_000.0)

    overall = (sum(c[3] for c in counted) + 1) / (sum(c[2] for c in counted) + 2)
    hosts = {h: (sum(c[2] for c in counted if c[0] == h), sum(c[3] for c in counted if c[0] == h)) for h in "abc"}
    s = strength([(n, k, overall) for n, k in hosts.values()])
    rate = {h: (k + s * overall) / (n + s) for h, (n, k) in hosts.items()}
    s = strength([(n, k, rate[h]) for h, _, n, k in counted])
    for h, p, n, k in counted:
        assert got[h, p] == pytest.approx((rate[h], (k + s * rate[h]) / (n + s)))


def test_odd_rows(llm, odd_docs, no_docs):
    _, labels = made()
    known = llm.createDataFrame([*labels, (1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality.classify(odd_docs, known, F.col("source"), F.col("block")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(no_docs, known, F.col("source"), F.col("block")).collect() == []


def test_without_labels_all_are_kept(llm, odd_docs):
    known = llm.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] and r["evidence"] == 0 for r in quality.classify(odd_docs, known, F.col("source"), F.col("block")).collect())


def test_scores_follow_from_evidence_and_rate(llm):
    rows, labels = made(300, 2)
    docs, known = spark_rows(llm, rows, labels)
    for r in quality.classify(docs, known, F.col("host"), F.col("path")).collect():
        z = r["evidence"] + math.log(r["path_rate"] / (1 - r["path_rate"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z))) and r["kept"] == (r["score"] >= quality.KEEP)


def test_query_keeps_clean_documents(llm):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in QUERIES["op4_quality"](llm, sf_dir).collect()}
    good, bad = [got[d] for d, q in labels.items() if q == 1], [got[d] for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_samples_count_equal_rows_once(llm):
    """A row that most of the table repeats comes once, and the sample is as large without it."""
    from palisade.llm.common import bounded_sample

    rows = llm.range(3000).selectExpr("id AS a", "cast(id % 7 AS string) AS b").unionByName(llm.range(6000).selectExpr("5L AS a", "'5' AS b"))
    got = bounded_sample(rows, F.xxhash64("a", "b"), 200)
    assert len(got) == 200 == len(set(got))
    assert sorted(bounded_sample(rows.repartition(7), F.xxhash64("a", "b"), 200)) == sorted(got)
    assert len(bounded_sample(rows, F.xxhash64("a", "b"), 10_000)) == 3000
