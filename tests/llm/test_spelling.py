import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from palisade.llm import spelling as sp
from palisade.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, least=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def deletions(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in deletions(max(a, b, key=len))


def brute_pairs(words):
    """All pairs that share a word with one letter out, or are one."""
    by = {}
    for w in words:
        for d in deletions(w) | {w}:
            by.setdefault(d, set()).add(w)
    return {frozenset(p) for group in by.values() for p in combinations(group, 2) if near(*p)}


def brute(rows, least=3):
    n = brute_counts(rows, least)
    nears = {w: set() for w in n}
    for a, b in map(tuple, brute_pairs(n)):
        nears[a].add(b)
        nears[b].add(a)
    form = {}
    for w, all_ in nears.items():
        best = min(all_, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(nears[w]), n[form[w]] if form[w] else None))
    return out


def rows_of(df):
    got = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n, letters="abcé", most=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(4, most))) for _ in range(300)]
    vocabulary += [w.upper() for w in vocabulary[:20]] + ["Étééé", "it's", "a1bcdefgh", "Škoda"]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("size", [3, 5])
@pytest.mark.parametrize("letters,most", [("abcé", 9), ("ab", 12), ("abcdefghijklmnop", 6)])
def test_against_brute_force(llm, letters, most, size):
    rows = made(len(letters), 80, letters, most)
    docs = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(sp.variants(docs, size=size, held=50)) == brute(rows)


def test_every_word_of_few_letters(llm):
    """Every pair of near words over two letters, each found once."""
    words = [f"{i:0{k}b}".translate({48: "a", 49: "b"}) for k in (5, 6, 7) for i in range(2**k)]
    pairs = sp.near_words(llm.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    assert len(pairs) == len({frozenset((r["a"], r["b"])) for r in pairs})
    assert {frozenset((r["a"], r["b"])) for r in pairs} == brute_pairs(words)


def test_pivots_are_disjoint_and_cheapest():
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choice("abc") for _ in range(r.randint(5, 10)))
        rank = {g: i for i, g in enumerate(r.sample([a + b for a in "abc" for b in "abc"], 9))}
        places = sp.gram_prefix(w, rank)
        cost = {(a + b, p): r.randint(1, 99) for a in "abc" for b in "abc" for p in range(-sp.PLACES, sp.PLACES)}
        total = lambda i, j: cost[w[i : i + 2], sp._place(i, len(w))[0]] + cost[w[j : j + 2], -1 - sp._place(j, len(w))[1]]
        i, j = sp.pivots(w, places, cost)
        assert i in places and j in places and j - i >= 2
        assert total(i, j) == min(total(a, b) for a, b in combinations(places, 2) if b - a >= 2)


def test_chains_of_forms(llm):
    """A word led on by ever more frequent near words, ties by code point."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    rows = [(7, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)) + " tieaa" * 9 + " tieab" * 9 + " tieac" * 4)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sp.variants(docs)) == brute(rows)
    assert {r[2] for r in rows_of(sp.variants(docs)) if r[0] in chain} == {chain[-1]}


def test_long_text_is_cut_between_runs(monkeypatch):
    text = ("Abcdef défghi, ghïjklšmnopq " * 50 + "x" * 200 + " ending").encode()
    want = list(sp._runs(text))[0]
    monkeypatch.setattr(sp, "LONG", 10)
    assert [w for part in sp._runs(text) for w in part] == want


def test_odd_rows(odd_docs):
    docs = odd_docs.withColumn("word", sp.F.lit("x")).withColumn("n", sp.F.lit(1)).unionByName(odd_docs, allowMissingColumns=True)
    assert rows_of(sp.variants(docs, least=1)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], least=1)


def test_empty_table(no_docs):
    assert sp.variants(no_docs).collect() == []


def test_whole_table(llm, sf_dir):
    rows = [tuple(r) for r in llm.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_spelling"](llm, sf_dir)) == brute(rows)
