import re

import pytest

from palisade.llm import licenses
from palisade.llm.queries import QUERIES

MIT = dict((k, v) for k, v in licenses.TEMPLATES)["mit"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    return len(w), sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


TEXTS = [
    "The MIT License, or mit-license; MIT License is not", "under the GNU General Public License v3, Apache License", None, "", "general public general public license", "mit license" * 3,
    "Licensed under CC BY-NC 4.0.", "licensed under CC BY 4.0", "licensed under the CC BY-SA 4.0", "[mit] license", "mit 'license'", "é mit license é", "license mit",
]


def test_base_places(llm, odd_docs, no_docs):
    docs = llm.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, places string")
    got = {r["doc_id"]: (r["n_words"], sorted((p["start"], p["label"]) for p in r["places"])) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    odd = sorted((r["n_words"] for r in licenses.scan(odd_docs).collect()))
    assert odd == sorted(len(words(r["text"])) for r in odd_docs.collect())
    assert licenses.scan(no_docs).collect() == []


def found(text):
    return licenses.Matcher(licenses.PHRASES, licenses.TEMPLATES).match(text)[2:]


def test_templates():
    assert found("Licensed under CC BY-NC 4.0.") == ({"cc-by-nc"}, 1.0)
    assert found("licensed under CC BY 4.0") == ({"cc-by"}, 1.0)
    assert found("nothing here") == (set(), 0.0)


def test_mandatory_wording_is_exact():
    plain = re.sub(r"<<any [^>]*>>", "2020 somebody", MIT)
    full = re.sub(r"<</?optional>>", "", plain)
    bare = re.sub(r"<<optional>>.*?<</optional>>", "", plain, flags=re.S)
    assert found("before. " + full.title() + " after")[0] == {"mit"} and found(bare)[0] == {"mit"}
    labels, score = found(bare.replace("merchantability", "merchandise"))
    assert "mit" not in labels and 0.8 < score < 1
    assert "mit" not in found(bare.replace("free of charge", "free of any charge"))[0]


@pytest.mark.parametrize("markup, yes, no", [
    ("a <<optional>>b <<optional>>c <</optional>>d <</optional>>e", ["a e", "a b d e", "a b c d e"], ["a b e", "a c e", "a d e", "e"]),
    ("a <<any 1-3>> b", ["a x b", "a x y z b", "a b b"], ["a b", "a w x y z b"]),
    ("a <<any 0-2>>", ["a"], ["b"]),
])
def test_automata(markup, yes, no):
    a = licenses.Automaton("x", markup)
    assert all(a.run(licenses.words_of(t), 0)[0] is not None for t in yes)
    assert all(a.run(licenses.words_of(t), 0)[0] is None for t in no)


def test_unbalanced_markup():
    for markup in ("a <<optional>>b", "<<any 0-3>>"):
        with pytest.raises(ValueError):
            licenses.Automaton("x", markup)


def test_query_equals_brute_force(llm, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_licenses"](llm, sf_dir).collect():
        n, places = brute(docs[r["doc_id"]])
        starts, labels = [p[0] for p in places], sorted({p[1] for p in places})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
