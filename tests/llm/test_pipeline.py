import numpy as np
import pytest
from pyspark.sql import functions as F
from test_bpe import ids_of
from test_ngram_join import brute as near

import corpus_pipeline
from palisade.llm import quality

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, sf_dir, folder):
    """The result of each stage, written and read again as a driver would."""
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def results(llm, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.01"
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, sf_dir, staged(llm, docs, sf_dir, str(tmp_path_factory.mktemp("pipeline")))


def test_stages_against_brute_force(llm, results):
    docs, sf_dir, (good, distinct, unlike, mixed, tokens) = results
    all_ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    # quality: clean documents stay, bad ones go
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert good.columns == DOCUMENTS and set(kept) <= all_ids
    judged = quality.classify(docs, llm.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
    assert set(kept) == {r["doc_id"] for r in judged.where("kept").collect()}
    assert np.mean([d in kept for d, q in labels.items() if q == 1]) > 0.97 and np.mean([d in kept for d, q in labels.items() if q == 0]) < 0.3
    # exact copies: the smallest id of each text
    first = {}
    for d, t in kept.items():
        first[t] = min(first.get(t, d), d)
    assert distinct.columns == DOCUMENTS and sorted(r["doc_id"] for r in distinct.collect()) == sorted(first.values())
    # near copies: the smallest id of each component
    rows = [(r["doc_id"], r["text"]) for r in distinct.collect()]
    assert unlike.columns == DOCUMENTS and sorted(r["doc_id"] for r in unlike.collect()) == sorted({c for *_, c in near(rows, 5, 80)})
    # mix: words per source near the targets, each document at most three times
    counts, sizes, taken = {}, {}, {}
    words = lambda t: len((t or "").encode().split())
    for r in unlike.collect():
        sizes.setdefault(r["source"], []).append(words(r["text"]))
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    assert mixed.columns == DOCUMENTS and max(counts.values()) <= 3
    from palisade.llm.mixing import cyclic_weights, water_fill

    targets = water_fill({s: sum(n) for s, n in sizes.items()}, cyclic_weights(list(sizes)))
    assert all(abs(taken.get(s, 0) - targets[s]) <= max(sizes[s]) for s in sizes)
    # encoding: one row for each row of the mix
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    encoded = tokens.collect()
    assert len(encoded) == mixed.count()
    for r in encoded[:200]:
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids_of(texts[r["doc_id"]])


def test_run_gives_the_rows_of_its_stages(llm, results):
    _, sf_dir, stages = results
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(llm, sf_dir)) == key(stages[-1])


def test_odd_and_empty_tables(llm, odd_docs, no_docs, sf_dir, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        typed = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"))
        out = staged(llm, typed, sf_dir, str(tmp_path / name))
        assert [d.columns for d in out[:4]] == [DOCUMENTS] * 4
        assert out[0].count() == typed.count()  # too few labels: nothing is rejected
        assert out[-1].count() == out[-2].count()


TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_stage_with_null_ids_and_an_id_on_two_texts(llm):
    sf_dir = "/root/testdata/sf0.01"
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet").select(DOCUMENTS).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("n_chars", F.col("n_chars").cast("long"))
    labels = llm.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels, F.col("source"), F.col("lang")).join(labels.select("doc_id"), "doc_id", "left_anti")
    bad, good = (judged.orderBy(order).first()["doc_id"] for order in (F.asc("score"), F.desc("score")))
    texts = {r["doc_id"]: r for r in docs.where(F.col("doc_id").isin(bad, good)).collect()}
    more = [(None, *texts[bad][1:]), (bad, *texts[good][1:]), (None, *texts[good][1:])]
    out = corpus_pipeline.good_documents(llm, docs.unionByName(llm.createDataFrame(more, docs.schema)), sf_dir)
    got = [(r["doc_id"], r["text"]) for r in out.where(F.col("doc_id").isNull() | (F.col("doc_id") == bad)).collect()]
    assert sorted(got, key=str) == sorted([(bad, texts[good]["text"]), (None, texts[good]["text"])], key=str)


def test_near_copy_stage_with_null_ids_and_an_id_on_two_texts(llm, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a + " tail"), (5, b), (9, b + " tail"), (None, b + " other"), (None, c)]
    docs = llm.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], TYPES)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.unlike_documents(llm, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(3, a), (5, b), (None, c)], key=str)


def test_mix_stage_with_null_ids_and_an_id_on_two_texts(llm, sf_dir):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(10))
    for ids, texts in (([None] * 120, range(120)), ([7] * 120, range(120)), ([None] * 120, [1] * 120)):
        rows = [(d, text(t), "en", "ab"[i % 2], 1) for i, (d, t) in enumerate(zip(ids, texts, strict=True))]
        out = corpus_pipeline.weighted_sources(llm, llm.createDataFrame(rows, TYPES), sf_dir)
        assert out.columns == DOCUMENTS
        taken = {r["source"]: r["count"] * 10 for r in out.groupBy("source").count().collect()}
        assert abs(taken["a"] - 400) <= 10 and abs(taken["b"] - 800) <= 10  # of 600 words each, weights 1 and 2
