"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Every source of a language gives each kept term a scaled probability, also the terms that it does
not have. The sum over all terms of f(p, q) = floor((p - q)^2 / q) for two sources g and h is made of

* zero baselines, from the histogram of each source's counts alone: what the sum would be if no
  term stood in both,
* corrections for the terms that stand in both. Terms live in a term-major index (term, source,
  count); a task takes a slab of whole terms, and each group scatters its terms through the slab into
  a dense accumulator with a cell for each peer. One row for each group and peer with a common
  term leaves a slab; posting pairs are never rows.

Probabilities and f are exact: integers of 64 bits, products kept below 2^63 for languages of up to
2^48 words."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

#: Term bytes of lower-cased UTF-8: a-z and every byte of other code points from 128 on.
TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^a-z\x80-\xff]")
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
HELD = 400_000
SLAB = 500_000
LONG = 4 << 20
INDEX_GROUPS = 4096
PAIR_GROUPS = 64


def _terms(text: bytes):
    """Lists of the terms of a text, cut between terms."""
    text, at = text.lower(), 0  # bytes: A-Z alone
    while len(text) - at > LONG:
        cut = BREAK.search(text, at + LONG)
        if cut is None:
            break
        yield TERM.findall(text, at, cut.start())
        at = cut.end()
    yield TERM.findall(text, at)


def _count(held: int):
    """Occurrences and documents by (lang, source, term) of what a task has read, given out
    whenever `held` entries are kept; a row without a term for each group."""

    def run(batches):
        groups: dict = {}
        size = 0

        def rows():
            for (lang, source), (n, docs) in groups.items():
                terms = list(n)
                columns = [pa.array([*terms, None], pa.binary()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())]
                lead = [pa.array([x] * (len(terms) + 1), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*lead, *columns], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                lists = list(_terms(text.as_py()))
                for terms in lists:
                    n.update(terms)
                docs.update(set(lists[0]) if len(lists) == 1 else set().union(*lists))
                size += len(n)
                if size > held:
                    yield from rows()
                    groups, size = {}, 0
        yield from rows()

    return run


def scaled(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * count / total), exact for totals below 2^48; 1 if there is no total."""
    most = F.when(total > 0, total)
    first = count * F.lit(31_250)
    p = F.call_function("div", first, most) * F.lit(32_000) + F.call_function("div", (first % most) * F.lit(32_000), most) + F.lit(1)
    return F.coalesce(p, F.lit(1)).cast("bigint")


def far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _far(p, q):
    d = p - q
    return d * d // q


def _scatter(lang: str, block: int, rows: tuple):
    """(g, h, sum) of the corrections of one slab: whole terms of one language, for the groups
    of one block."""
    blocks, starts, group, p, zero = rows
    lens = np.diff(np.append(starts, len(group)))
    term = np.repeat(np.arange(len(starts)), lens)
    peers, peer = np.unique(group, return_inverse=True)
    zeros = np.zeros(len(peers), np.int64)
    zeros[peer] = zero
    own = np.flatnonzero(group % blocks == block)
    own = own[np.argsort(peer[own], kind="stable")]
    cuts = np.flatnonzero(np.diff(peer[own], prepend=-1))
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
        mine = own[i:j]
        g, seen, sums = int(peer[mine[0]]), np.zeros(len(peers), bool), np.zeros(len(peers), np.int64)
        for k in range(0, len(mine), 4096):  # the group's terms, some thousand at a time
            some = mine[k : k + 4096]
            n = lens[term[some]]
            at = np.arange(n.sum()) + np.repeat(starts[term[some]] - (np.cumsum(n) - n), n)
            h, q, a = peer[at], p[at], np.repeat(p[some], n)
            np.add.at(sums, h, _far(a, q) - _far(zeros[g], q) - _far(a, zeros[h]) + _far(zeros[g], zeros[h]))
            seen[h] = True
        seen[g] = False
        h = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), peers[g])), pa.array(peers[h]), pa.array(sums[h])], ["lang", "g", "h", "common"])


def _accumulate(slab: int):
    def run(batches):
        """Rows come sorted by language, block and term; slabs end where a term ends."""
        held, size = [], 0

        def scattered(table: pa.Table):
            for key in dict.fromkeys(zip(table["lang"].to_pylist(), table["block"].to_pylist(), strict=True)):
                lang, block = key
                here = table.filter(pc.and_(pc.equal(table["lang"], lang), pc.equal(table["block"], block)))
                runs = here["term"].combine_chunks().dictionary_encode().indices.to_numpy()
                starts = np.flatnonzero(np.diff(runs, prepend=-1))
                columns = [here[c].to_numpy() for c in ("gid", "p", "zero")]
                yield from _scatter(lang, block, (int(here["blocks"][0].as_py()), starts, *columns))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > slab:
                table = pa.Table.from_batches(held)
                last = tuple(table[c][size - 1].as_py() for c in ("lang", "block", "term"))
                cut = size - 1
                while cut and tuple(table[c][cut - 1].as_py() for c in ("lang", "block", "term")) == last:
                    cut -= 1
                if cut:
                    yield from scattered(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield from scattered(pa.Table.from_batches(held))

    return run


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents), partly summed: rows of one key may
    come from many tasks. A row with a null term names each group."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = docs.select(name("lang"), name("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = base.mapInArrow(_count(held), "lang string, source string, term binary, n long, docs long")
    return rows.withColumn("term", F.col("term").cast("string"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, held: int = HELD, slab: int = SLAB, index_groups: int = INDEX_GROUPS, pair_groups: int = PAIR_GROUPS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank.

    Null text, lang and source count as empty strings, each row as a document. Terms stand in
    at least `least` documents of their language. Part `pair` has every other source of the
    language, also sources without terms; part `term` the `top` terms that the source has oftener
    than its language. Rank is by value descending, then item ascending in bytes. An empty table
    gives no rows.

    Counts are shuffled once by (lang, term) after each task has summed its own, so no key meets
    more rows than there are sources and tasks. Languages of more than index_groups sources are
    scattered block by block of groups."""
    words = term_counts(docs, held).repartition("lang", "term")
    by_term = Window.partitionBy("lang", "term")
    summed = words.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # the term-major index: kept terms with their sources, and one row a source without a term
    index = summed.select(
        "lang", "term", "source", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"),
        (F.row_number().over(by_term.orderBy("source")) == 1).alias("lead"),
    )
    index = written(index.where((F.col("lang_docs") >= least) | F.col("term").isNull()).drop("lang_docs"), "term-index")
    counted = index.groupBy("lang", "source", "n").agg(F.count("term").alias("terms"))
    groups = counted.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("size"),
        F.collect_list(F.when(F.col("terms") > 0, F.struct("n", "terms"))).alias("hist"),
    )
    first = F.col("lead") & F.col("term").isNotNull()
    langs = index.groupBy("lang").agg(F.count_if(first).alias("v"), F.sum(F.when(first, F.col("lang_n")).otherwise(0)).alias("lang_total"), F.count_if(F.col("term").isNull()).alias("sources"))
    groups = groups.join(langs, "lang").withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint"))
    all_ = F.col("total") + F.col("v")
    groups = written(groups.withColumn("zero", scaled(F.lit(1).cast("bigint"), all_)), "term-groups")
    posts = index.where(F.col("term").isNotNull()).drop("lead")
    posts = posts.join(groups.drop("hist", "size"), ["lang", "source"]).withColumn("p", scaled(F.col("n") + 1, all_))
    far_pairs = _pairs(groups, _common(posts, slab, index_groups), pair_groups)
    q = scaled(F.col("lang_n") + 1, F.col("lang_total") + F.col("v"))
    oftener = posts.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return far_pairs.withColumn("rank", rank).unionByName(oftener.withColumn("rank", rank).where(F.col("rank") <= top))


def _common(posts: DataFrame, slab: int, index_groups: int) -> DataFrame:
    """lang, g, h, common: the corrections for the terms that both have."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / index_groups)).cast("int")
    rows = posts.select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "term", "gid", "p", "zero", blocks.alias("blocks"))
    slabs = rows.repartition("lang", "block", "term").sortWithinPartitions("lang", "block", "term")
    parts = slabs.mapInArrow(_accumulate(slab), "lang string, g long, h long, common long")
    return parts.groupBy("lang", "g", "h").agg(F.sum("common").alias("common"))


def _pairs(groups: DataFrame, common: DataFrame, pair_groups: int) -> DataFrame:
    """Each source with each other of its language: baselines from the histograms, and corrections."""
    p = F.transform("hist", lambda x: F.struct(scaled(x["n"] + 1, F.col("total") + F.col("v")).alias("p"), x["terms"].alias("terms")))
    one = groups.select("lang", "gid", "source", "zero", "size", "v", "sources", p.alias("hist"))
    # peers stand once in each block of groups: a language's pairs are made in many tasks
    blocks = F.ceil(F.col("sources") / pair_groups).cast("int")
    mine = one.select("lang", F.pmod("gid", F.ceil(F.col("sources") / pair_groups)).cast("int").alias("block"), F.col("gid").alias("g"), "source", "v", F.col("zero").alias("g_zero"), F.col("size").alias("g_size"), F.col("hist").alias("g_hist"))
    peers = one.select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("gid").alias("h"), F.col("source").alias("item"), F.col("zero").alias("h_zero"), F.col("size").alias("h_size"), F.col("hist").alias("h_hist"))
    pairs = mine.join(peers, ["lang", "block"]).where("g <> h")
    none = F.lit(0).cast("bigint")
    theirs = F.aggregate("h_hist", none, lambda a, x: a + x["terms"] * far(F.col("g_zero"), x["p"]))
    ours = F.aggregate("g_hist", none, lambda a, x: a + x["terms"] * far(x["p"], F.col("h_zero")))
    base = theirs + ours + (F.col("v") - F.col("g_size") - F.col("h_size")) * far(F.col("g_zero"), F.col("h_zero"))
    based = pairs.select("lang", "g", "h", "source", "item", base.alias("base"))
    value = F.col("base") + F.coalesce("common", F.lit(0))
    return based.join(common, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("bigint").alias("value"))
