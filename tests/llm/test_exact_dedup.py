import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palisade.llm.exact_dedup import Trie, _smallest, drop_copies, exact_dedup


def brute(rows, keep):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: (max if keep == "largest" else min)([d for d in ds if d is not None], default=None) for t, ds in groups.items()}
    return sorted(
        ((d, best[t or ""], len(groups[t or ""]), best[t or ""] is None or d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str
    )


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [48 << 20, 5_000])
def test_odd_rows(odd_docs, keep, budget):
    got = sorted((tuple(r) for r in exact_dedup(odd_docs, keep=keep, budget=budget).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], keep)


def test_texts_that_share_length_and_hash(odd_docs):
    weak = lambda c: F.encode(F.lit("same"), "UTF-8")
    got = sorted((tuple(r) for r in exact_dedup(odd_docs, hash_of=weak).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], "smallest")


def test_empty_table(no_docs):
    assert exact_dedup(no_docs).collect() == [] and drop_copies(no_docs).collect() == []


def test_drop_copies_keeps_columns_and_owners(odd_docs):
    kept = drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 6, 7, 8, 9, 9, 5, 11, None], key=str)


def test_normalised(llm):
    docs = llm.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup(docs, normalise=F.lower).collect()} == {1}


def test_trie_spills_and_drains_whole():
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 40))).encode() for _ in range(3000)]
    trie = Trie(_smallest, 20_000)
    want = {}
    for i, w in enumerate(words):
        trie.insert(w, i)
        want.setdefault(w, [i, 0])[1] += 1
    assert trie.spilled
    assert sorted((k, o, n) for k, o, n in trie.drain()) == sorted((k, o, n) for k, (o, n) in want.items())


def test_oracle_of_the_query(llm, sf_dir):
    from palisade.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op8_exact_dedup"](llm, sf_dir).collect()), key=str) == brute(rows, "largest")
