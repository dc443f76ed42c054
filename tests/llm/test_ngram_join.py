import random

import numpy as np
import pytest

from palisade.llm import ngram_join as N
from palisade.llm.queries import QUERIES


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """(doc_id, set size, class, component) of each row, by comparing all rows that share a shingle."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least, twins = {}, {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
            twins[sets[i]] = min(twins.get(sets[i], d), d)
    return sorted(((d, len(sets[i]), twins.get(sets[i], d) if sets[i] else d, least.get(root(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def joined(docs, k, percent, **more):
    return sorted((tuple(r) for r in N.jaccard_components(docs, k, percent, **more).collect()), key=str)


def near_copies(seed=1):
    """Families of near copies around the limit, a template that many rows share, and plain rows."""
    r = random.Random(seed)
    word = lambda: f"t{r.randint(0, 3000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 25)):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                x[r.randrange(len(x))] = word()
            rows.append(" ".join(x))
    template = [word() for _ in range(60)]
    rows += [" ".join(template + [word() for _ in range(r.randint(6, 14))]) for _ in range(60)]
    rows += [" ".join(word() for _ in range(r.randint(1, 200))) for _ in range(40)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_odd_rows(odd_docs, k, percent):
    assert joined(odd_docs, k, percent) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], k, percent)


@pytest.mark.parametrize("block", [20_000, 5])
def test_families_around_the_limit(llm, block):
    rows = near_copies()
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert joined(docs, 4, 85, block=block) == brute(rows, 4, 85)


def test_long_documents_and_sizes_at_the_limit(llm, monkeypatch):
    """Bitmaps are full; wide ones decide. Some pairs differ in size alone, by just too much or not."""
    r = random.Random(9)
    word = lambda: f"t{r.randint(0, 400)}"
    rows = []
    for n in (1500, 2500, 40, 100):
        base = [word() for _ in range(n)]
        for share in (0, 0.02, 0.035, 0.05, 0.1):
            x = list(base)
            for i in r.sample(range(n), int(n * share)):
                x[i] = word()
            rows.append(" ".join(x))
        rows += [" ".join(base + [f"u{n}{i}" for i in range(int(n * extra))]) for extra in (0.1, 0.17, 0.175, 0.18, 0.25)]
    rows = list(enumerate(rows))
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(docs, 4, 85) == brute(rows, 4, 85)


def test_whole_table(llm, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op1_ngram_join"](llm, sf_dir).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_empty_table(no_docs):
    assert N.jaccard_components(no_docs).collect() == [] and N.drop_near_copies(no_docs).collect() == []


def test_drop_near_copies(odd_docs):
    kept = N.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 9, 9, 11, None, None], key=str)


def arrays(sets):
    bits = np.array([np.frombuffer(N._bitmap(s), np.uint64) for s in sets])
    cls = np.arange(len(sets))
    return {"cls": cls, "comp": cls.copy(), "n": np.array([len(s) for s in sets]), "bits": bits}


@pytest.mark.parametrize("split", [False, True])
def test_walk_connects_all_that_compares_alike(split):
    r = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, r.integers(5, 300)).astype(np.uint64)
        for _ in range(r.integers(1, 12)):
            x = base.copy()
            i = r.integers(0, len(x), max(1, len(x) // 40))
            x[i] = r.integers(0, 2**63, len(i)).astype(np.uint64)
            sets.append(np.unique(x))
    x = arrays(sets)
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    if split:
        left, right = ({k: v[s] for k, v in x.items()} for s in (slice(0, 100), slice(100, None)))
        similar = {(i, j) for i, j in similar if (i < 100) != (j < 100)}
    else:
        left, right = x, None
    # exact mode without effective limit: every similar pair is among the candidates
    pairs = N.Pairs(10**9)
    N.walk(left, right, 85, pairs)
    assert similar <= {(b, a) for a, b in pairs.out} and not pairs.held
    # a forest connects the same rows
    forest = N.Pairs(None)
    N.walk(left, right, 85, forest)
    assert len(forest.out) < len(sets)
    joined_ = N.Forest(np.arange(len(sets)))
    for a, b in forest.out:
        joined_.union(a, b)
    assert all(joined_.root(i) == joined_.root(j) for i, j in similar)


def test_components_of_chains_and_stars(llm):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 300), (300, 250)] + [(r.randint(1000, 1100), r.randint(1000, 1100)) for _ in range(80)]
    got = {r["node"]: r["label"] for r in N.components(llm.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {n: root(n) for n in got} == got and {x for a, b in links if a != b for x in (a, b)} <= set(got)
