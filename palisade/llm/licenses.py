"""License scans by template markup.

A template is license wording with markup: `<<optional>> ... <</optional>>` may be left out,
`<<any 0-20>>` stands for that many words. It is compiled to an automaton over words, which
accepts a passage only if all mandatory wording stands there exactly. Passages are searched at
any place of a text; a run of the automaton starts only where one of its first words stands.

Phrases that name a license are templates without markup."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license wording with markup, and labels.
TEMPLATES = [
    ("cc-by-nc", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>>cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>>cc by sa"),
    ("cc-by", "licensed under <<optional>>a <</optional>><<optional>>the <</optional>>cc by <<any 1-1>> 0"),
    ("mit", """<<optional>>the mit license <</optional>><<optional>>copyright <<any 0-30>> <</optional>>permission is hereby granted free of charge to any
        person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next
        paragraph <</optional>>shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"""),
    ("isc", """permission to use copy modify and <<optional>>or <</optional>>distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<any 0-1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<any 0-1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution"""),
    ("apache", """licensed under the apache license version 2 0 <<optional>>the license <</optional>>you may not use this file except in compliance with the
        license you may obtain a copy of the license at <<any 0-8>> unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version <<any 1-2>> of the license or at your option any later version"""),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v <<any 1-2>>"),
]

_MARK = re.compile(r"<<(optional)>>|<<(/optional)>>|<<any (\d+)-(\d+)>>")
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def spaced(text: str) -> bytes:
    """A-Z lower-cased, all but `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` as spaces, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str) -> list:
    return spaced(text).split()


class Automaton:
    """Words of one template. Transitions of state i: (word or None for any, next state);
    skips lead on without a word. States are numbered in the order of the text."""

    def __init__(self, label: str, markup: str):
        self.label, self.step, self.skip, self.mandatory = label, [[]], [[]], []
        depth, opened, at = 0, [], 0
        state = 0
        for m in [*_MARK.finditer(markup), None]:
            for word in words_of(markup[at : m.start() if m else len(markup)]):
                state = self._next(state, word)
                if not depth:
                    self.mandatory.append((state, word))
            if m is None:
                break
            at = m.end()
            if m[1]:
                depth += 1
                opened.append(state)
            elif m[2]:
                depth -= 1
                self.skip[opened.pop()].append(state)
            else:
                least, most = int(m[3]), int(m[4])
                start = state
                for i in range(most):
                    if i >= least:
                        self.skip[state].append(start + most)
                    state = self._next(state, None)
        if opened or not self.mandatory:
            raise ValueError(f"unbalanced or empty template {label}")
        self.end = state
        self.first = {w for s in self._closed({0}) for w, _ in self.step[s]}

    def _next(self, state: int, word) -> int:
        self.step.append([])
        self.skip.append([])
        self.step[state].append((word, len(self.step) - 1))
        return len(self.step) - 1

    def _closed(self, states: set) -> set:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def run(self, words: list, start: int):
        """(end or None, furthest state): the shortest accepted passage from start."""
        states, far, i = self._closed({0}), 0, start
        while states:
            if self.end in states:
                return i, self.end
            if i == len(words):
                break
            w = words[i]
            states = self._closed({t for s in states for x, t in self.step[s] if x is None or x == w})
            far = max(far, max(states, default=0))
            i += 1
        return None, far

    def share(self, state: int) -> float:
        """Mandatory words up to a state, as a share of all."""
        return sum(s <= state for s, _ in self.mandatory) / len(self.mandatory)


class Matcher:
    """All templates at once: a run is tried where a first word of a template stands."""

    def __init__(self, phrases: dict, templates: list):
        self.phrases = [Automaton(label, phrase) for phrase, label in phrases.items()]
        self.templates = [Automaton(label, markup) for label, markup in templates]
        self.by_first: dict = {}
        for a in self.phrases + self.templates:
            for w in a.first:
                self.by_first.setdefault(w, []).append(a)
        self.any_first = re.compile(b"|".join(map(re.escape, self.by_first)))

    def match(self, text: str):
        """(words, base places as (start, label), labels of the templates, score)."""
        low = spaced(text)
        words = low.split()
        base, labels, score = [], set(), 0.0
        if self.any_first.search(low):
            for i, w in enumerate(words):
                for a in self.by_first.get(w, ()):
                    end, far = a.run(words, i)
                    if a in self.phrases:
                        if end is not None:
                            base.append((i, a.label))
                            score = max(score, 0.5)
                    elif end is not None:
                        labels.add(a.label)
                        score = 1.0
                    else:
                        score = max(score, 0.99 * a.share(far))
        return words, base, labels, score


RESULT = "doc_id long, n_words long, places array<struct<start:long,label:string>>, found array<string>, score double"


def _scan(phrases: dict, templates: list):
    def run(batches):
        matcher = Matcher(phrases, templates)
        place = pa.struct([("start", pa.int64()), ("label", pa.string())])
        for batch in batches:
            n, places, found, scores = [], [], [], []
            for text in batch.column("text"):
                words, base, labels, score = matcher.match(text.as_py())
                n.append(len(words))
                places.append([{"start": s, "label": label} for s, label in base])
                found.append(sorted(labels))
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(found, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                ["doc_id", "n_words", "places", "found", "score"],
            )

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict = PHRASES, templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (start word and label of every phrase), found (labels of accepted
    templates), score: 1 with an accepted template, 0.5 at least with a phrase, else 0.99 times
    the largest share of a template's mandatory wording that stands in a row.

    Null texts count as empty (no words, score 0); repeated rows are scanned each."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_scan(phrases, templates), RESULT)
