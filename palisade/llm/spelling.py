"""Spelling variants: words one edit apart, each led to its most frequent near word.

Candidates come from pivotal grams. All bigrams have one order, the rarer first. A word's gram prefix
is its PREFIX first bigrams (and others as rare as the last of them); two disjoint bigrams of the
prefix, chosen by dynamic programming for the least expected matches, are its pivots. One edit
leaves a pivot whole: the first with all letters before it, if the edit stands behind it, else
the second with all letters behind it. Of two near words take the one whose prefix ends at the
rarer bigram: its whole pivot is a bigram of the other's prefix, in the same place from that end. So
pivots meet prefix entries on (end, letters up to the bigram) - place and bigram agree - and the
pair is verified. The rule names one side and one pivot for each pair: no pair is found twice.

The order and the expected matches come from tables with a row for each bigram and place: at most
90 letters squared and PLACES places."""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Maximal runs; shorter ones never become words.
LEAST_LENGTH = 5
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
LETTER_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
LEAST = 3
DROP = 97
HELD = 400_000
LONG = 4 << 20
PREFIX = 3
PLACES = 24
MAX_ROUNDS = 64


def _runs(text: bytes):
    """Lists of the lower-cased runs of a text, cut between runs."""
    text, at = text.lower(), 0  # bytes: A-Z alone
    while len(text) - at > LONG:
        cut = LETTER_BREAK.search(text, at + LONG)
        if cut is None:
            break
        yield RUN.findall(text[at : cut.start()].decode())
        at = cut.end()
    yield RUN.findall(text[at:].decode() if at else text.decode())


def edited(run: str, h: int) -> str:
    """The run, without code point h % length if DROP divides h."""
    if h % DROP:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count(held: int):
    """word, n of what a task has read, given out whenever `held` words are kept."""

    def run(batches):
        words: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, crc = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id)), zlib.crc32
                for runs in _runs(text.as_py()):
                    words.update(runs)
                    cut = {w: h for w in set(runs) if not (h := crc(w.encode(), start)) % DROP}
                    if cut:  # all places of a run in a document have one hash
                        for w, n in Counter(filter(cut.__contains__, runs)).items():
                            words[w] -= n
                            words[edited(w, cut[w])] += n
                if len(words) > held:
                    yield rows()
                    words = Counter()
        if words:
            yield rows()

    return run


def word_counts(docs: DataFrame, least: int = LEAST, held: int = HELD) -> DataFrame:
    """word, n: results of at least LEAST_LENGTH code points and `least` occurrences."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = base.mapInArrow(_count(held), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) & (F.length("word") >= LEAST_LENGTH))


def _place(i: int, length: int) -> tuple:
    """Place of the bigram at i from the front and from the back, the far ones as one."""
    return min(i, PLACES - 1), min(length - 2 - i, PLACES - 1)


def _gram_counts(batches):
    """gram, place from the front or (negative) from the back, words: at most one row for each a task."""
    seen: Counter = Counter()
    for batch in batches:
        for w in batch.column("word").to_pylist():
            for i in range(len(w) - 1):
                front, back = _place(i, len(w))
                seen[w[i : i + 2], front] += 1
                seen[w[i : i + 2], -1 - back] += 1
    rows = list(seen.items())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.int64())], ["gram", "place", "n"])


def gram_prefix(word: str, rank: dict, size: int = PREFIX) -> list:
    """Places of the bigrams up to the size-th in order (all of its rank), ascending."""
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[min(size, len(ranks)) - 1]
    return [i for i, r in enumerate(ranks) if r <= last]


def pivots(word: str, places: list, cost: dict) -> tuple:
    """(first, second): disjoint places of least cost. One pass from the left holds the best first
    pivot that ends before the place at hand."""
    best = answer = None
    ready = 0
    for j in places:
        while places[ready] <= j - 2:
            i = places[ready]
            c = cost[word[i : i + 2], _place(i, len(word))[0]]
            if best is None or c < best[0]:
                best = (c, i)
            ready += 1
        if best is not None:
            total = best[0] + cost[word[j : j + 2], -1 - _place(j, len(word))[1]]
            if answer is None or total < answer[0]:
                answer = (total, best[1], j)
    return answer[1:]


FRONT, BACK = 0, 1


def _entries(rank: dict, cost: dict, size: int):
    """Rows of the join: pivots (two a word) and entries of gram prefixes (two a bigram). `last` is the
    rank at which the prefix ends; `other` is the whole front pivot of a back one, which must not fit."""

    def run(batches):
        names = ["pivot", "key", "word", "n", "last", "other"]
        kinds = [pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            rows: list = []
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                places = gram_prefix(w, rank, size)
                last = max(rank[w[i : i + 2]] for i in places)
                i, j = pivots(w, places, cost)
                rows.append((True, f"{w[: i + 2]}-", w, n, last, None))
                rows.append((True, f"-{w[j:]}", w, n, last, w[: i + 2]))
                for k in places:
                    rows.append((False, f"{w[: k + 2]}-", w, n, last, None))
                    rows.append((False, f"-{w[k:]}", w, n, last, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return run


def near_words(words: DataFrame, size: int = PREFIX) -> DataFrame:
    """a, a_n, b, b_n: each unordered pair of words exactly one edit apart, once.

    words: word (distinct, at least LEAST_LENGTH code points), n."""
    rows = words.mapInArrow(_gram_counts, "gram string, place int, n long").groupBy("gram", "place").agg(F.sum("n").alias("n")).collect()
    cost = {(r["gram"], r["place"]): r["n"] for r in rows}
    total = Counter()
    for (gram, place), n in cost.items():
        total[gram] += n if place >= 0 else 0
    rank = {gram: i for i, (_, gram) in enumerate(sorted((n, g) for g, n in total.items()))}
    entries = words.mapInArrow(_entries(rank, cost, size), "pivot boolean, key string, word string, n long, last int, other string")
    entries = written(entries, "gram-entries")
    left = entries.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), "other", F.length("word").alias("a_len"))
    right = entries.where("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), F.length("word").alias("b_len"))
    earlier = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a") < F.col("b")))
    unseen = F.col("other").isNull() | ~F.startswith("b", "other")
    fits = (left["key"] == right["key"]) & earlier & (F.abs(F.col("a_len") - F.col("b_len")) <= 1) & unseen
    return left.join(right, fits).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: forms followed to the last, in doubling steps. A form has at least
    twice the occurrences, so there are few rounds whatever the number of words."""
    at = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("_next")).where("root <> _next")
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = written(moved, "roots")
        if moved.where("_moved").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")
    raise RuntimeError("forms do not end")


def variants(docs: DataFrame, least: int = LEAST, size: int = PREFIX, held: int = HELD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Null texts have no words; a null doc_id counts as empty in the hash; repeated rows count
    each. No words give an empty table."""
    words = written(word_counts(docs, least, held), "words")
    pairs = near_words(words, size)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    leads: Column = -F.col("best.less") >= 2 * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", F.when(leads, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(leads, -F.col("best.less")).alias("form_n"),
    )
    formed = written(formed, "word-forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
