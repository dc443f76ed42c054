import hashlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import sketch
from palisade.llm.queries import QUERIES


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode("utf-8", "surrogatepass").split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows):
    """doc_id, n_chars, digest of the edited text, text, edited text and next text by row."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return out


def same(got, want):
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == sorted(w[:3] for w in want if w[0] is not None)
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is None) == sorted(w[1:3] for w in want if w[0] is None)


@pytest.mark.parametrize("rows", [2000, 2])
def test_odd_rows(odd_docs, rows):
    got = sketch.fingerprints(odd_docs, rows=rows).collect()
    same(got, brute([(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] and prints[6] == prints[10] and prints[3] == prints[4] == prints[5] == ""


def test_one_row_and_none(llm, no_docs):
    one = llm.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")
    got = sketch.fingerprints(one).first()
    assert got["edited_sha256"] == brute([(5, "a b c d e f g h i")])[0][2] and got["near_next"] == 1.0
    assert sketch.fingerprints(no_docs).collect() == []


def test_estimates_against_exact_sets(llm, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op10_sketch"](llm, sf_dir).collect()}
    want = brute(docs)
    same(got.values(), want)
    worst, total = 0.0, 0.0
    for d, _, _, text, edited, after in want:
        a, b, c = shingles(text), shingles(edited), shingles(after)
        err = abs(len(a & b) / len(a | b) - got[d]["near_edited"])
        total += err
        if len(a | b) > 400:
            worst = max(worst, err, abs(len(a & c) / len(a | c) - got[d]["near_next"]))
    assert worst < 0.25 and total / len(want) < 0.08


def test_sketches_merge_and_contain(llm):
    words = [f"w{i}" for i in range(4000)]
    df = llm.createDataFrame([(" ".join(words), " ".join(words[:1000]), " ".join(words[1000:]))], "whole string, head string, tail string")
    whole, head, tail = (sketch.sketch(F.col(c)) for c in ("whole", "head", "tail"))
    r = df.select(sketch.containment(head, whole).alias("c"), sketch.containment(whole, head).alias("w"), F.size(F.array_except(sketch.merged(head, tail), whole)).alias("m"), F.size(whole).alias("n")).first()
    assert r["c"] == 1.0 and 0.15 < r["w"] < 0.35 and r["m"] == 0 and 350 < r["n"] < 650


def words(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_short_near_copies_are_compared_exactly(llm):
    rows = [(words(n, i), words(n, i) + " more") for i, n in enumerate([1, 4, 5, 6, 9, 20, 20, 20, 20, 40, 60] * 4)]
    df = llm.createDataFrame(rows, "a string, b string")
    a, b = (sketch.sketch(F.col(c)) for c in "ab")
    for r, (x, y) in zip(df.select(sketch.likeness(a, b).alias("l"), sketch.containment(a, b).alias("c")).collect(), rows, strict=True):
        x, y = shingles(x), shingles(y)
        assert r["l"] == pytest.approx(len(x & y) / len(x | y)) and r["c"] == pytest.approx(len(x & y) / len(x))


def test_short_texts_inside_long_ones(llm):
    rows = [(f"{words(n, i)}", f"{words(m, 1000 + i)} {words(n, i)} {words(m, 2000 + i)}") for i, (n, m) in enumerate([(20, 10), (20, 40), (50, 100), (90, 2000)] * 20)]
    df = llm.createDataFrame(rows, "short string, long string")
    short, long, other = sketch.sketch(F.col("short")), sketch.sketch(F.col("long")), sketch.sketch(F.reverse(F.col("long")))
    got = df.select(sketch.containment(short, long).alias("c"), sketch.containment(short, other).alias("o")).collect()
    assert all(r["c"] == 1.0 for r in got) and all(r["o"] == 0.0 for r in got)
    # a single shingle says nothing where the long text does not cover its hash
    one = llm.createDataFrame([(words(5, i), f"{words(5, i)} {words(3000, 9000 + i)}") for i in range(60)], "short string, long string")
    said = [r["c"] for r in one.select(sketch.containment(short, long).alias("c")).collect()]
    assert set(said) == {1.0, None}


def test_merged_is_the_sketch_of_the_union(llm):
    sizes = [(3, 8), (30, 30), (64, 70), (90, 20), (300, 5), (300, 400), (2000, 10), (0, 100), (0, 0)]
    rows = [(words(n, i), words(m, 100 + i) + " " + words(n, i)[: 4 * n]) for i, (n, m) in enumerate(sizes)]
    df = llm.createDataFrame(rows, "a string, b string")
    a, b = (sketch.sketch(F.col(c)) for c in "ab")
    everything = lambda c: sketch.sketch(F.col(c), least=1_000_000)
    for r in df.select(sketch.merged(a, b).alias("m"), everything("a").alias("x"), everything("b").alias("y")).collect():
        union = sorted(set(r["x"]) | set(r["y"]))
        assert r["m"] == union[: max(64, sum(h < -(2**63) + 2**61 for h in union))]
