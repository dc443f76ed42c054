import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from palisade.llm import divergence as dv
from palisade.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    """rows of (text, lang, source)"""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n[lang, source].update(words)
        df[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]
        total = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def p(count, all_):
            return 1 + 10**9 * (count + 1) // (all_ + len(kept))

        own = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        probs = {s: {t: p(n[lang, s][t], own[s]) for t in kept} for s in sources}
        whole = {t: p(total[t], sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum((probs[s][t] - probs[o][t]) ** 2 // probs[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((probs[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if n[lang, s][t] and probs[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)}
    return out


def rows_of(df):
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n, langs, sources):
    r = random.Random(seed)
    words = ["The", "the", "of", "été", "Été", "中文", "x", "Zz", "a1b", "\U0001f600", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))]
    return [(" ".join(r.choice(words[: r.randint(1, len(words))]) for _ in range(r.randint(0, 30))), r.choice(langs), r.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"held": 5, "slab": 7, "index_groups": 2, "pair_groups": 2}, {"top": 3, "slab": 1}])
def test_against_brute_force(llm, kw):
    rows = made(1, 150, ["en", "de", None, ""], ["a", "b", "c", "é", None, "z" * 9]) + [(None, "fr", "only"), ("", "it", "x"), ("aa", "it", "y"), ("bb", "it", None)]
    docs = llm.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert rows_of(dv.divergence(docs, **kw)) == brute(rows, top=kw.get("top", 200))


def test_hot_source_ties_and_repeats(llm):
    rows = made(2, 60, ["en"], ["a", "b"]) + [("same words here", "en", "hot")] * 200 + [("p q r", "en", s) for s in "uvw"] * 2
    docs = llm.createDataFrame([(*x, 1, 2, "t") for x in rows], "text string, lang string, source string, n long, p long, term string").repartition(3)
    assert rows_of(dv.divergence(docs)) == brute(rows)


def test_many_sources(llm):
    rows = made(3, 400, ["en"], [f"s{i}" for i in range(70)])
    docs = llm.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert rows_of(dv.divergence(docs, index_groups=16, pair_groups=8)) == brute(rows)


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(dv, "LONG", 10)
    text = ("Abc déf, ghi " * 50 + "x" * 200 + " end").encode()
    assert [w for part in dv._terms(text) for w in part] == dv.TERM.findall(text.lower())


def test_scaled_is_exact(llm):
    r = random.Random(4)
    pairs = [(c, t) for t in (1, 7, 10**6 + 3, 2**47 + 11) for c in (1, t // 3 + 1, t)] + [(r.randint(1, 10**6), r.randint(10**6, 2**47)) for _ in range(50)] + [(1, 0)]
    got = llm.createDataFrame(pairs, "c long, t long").select(dv.scaled(dv.F.col("c"), dv.F.col("t"))).collect()
    assert [x[0] for x in got] == [1 + 10**9 * c // t if t else 1 for c, t in pairs]


def test_odd_rows(odd_docs):
    docs = odd_docs.withColumn("lang", dv.F.lit(None).cast("string"))
    assert rows_of(dv.divergence(docs)) == brute([(r["text"], None, r["source"]) for r in odd_docs.collect()])


def test_empty_table(no_docs):
    assert dv.divergence(no_docs.withColumn("lang", dv.F.lit("a"))).collect() == []


def test_whole_table(llm, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cur = con.execute(ORACLES["op12_divergence"])
    names = [d[0] for d in cur.description]
    want = {tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in cur.fetchall()}
    assert rows_of(QUERIES["op12_divergence"](llm, sf_dir)) == want
