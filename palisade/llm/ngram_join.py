"""Exact n-gram Jaccard join with signature trees.

Documents are sets of distinct k-word shingles (64-bit hashes). Documents of equal sets form a
class, known by the 128-bit digest of its set; classes, not copies, are compared.

Candidates. Under any fixed order of shingles, two sets with Jaccard similarity of at least t
share a shingle among the first n - ceil(t n) + 1 of each, and of the smaller one among the
first n - ceil(2 t n / (1 + t)) + 1. The order puts shingles that many documents have last (a
fixed-size sketch of counts over the whole corpus decides), then goes by hash. Classes that
share such a shingle form a bucket; rows without a partner of fitting size and place are
dropped before any signature travels.

Signature trees. Inside a bucket, rows carry a bitmap of their tokens. They are put into a tree
whose nodes hold the OR of the bitmaps below, the range of set sizes and the range of
components. Two trees (or one with itself) are walked together; a pair of nodes is cut if its
largest possible overlap is too small for t, its sizes do not fit, or all below it is one
component already. What remains is a forest of candidate pairs. Pairs of long documents, whose
bitmaps are full, are tested again on bitmaps as wide as their sets need (`WIDE` bits a
shingle); the rest is verified on the full sets.

Rounds. The first round joins within each bucket a forest alone, so a group of thousands of near
copies costs a line of pairs, not all of them. Where pairs of that forest fail verification,
later rounds go over the buckets concerned and try further pairs between the components that
remain, FURTHER ** round for each two components, until no bucket has held any back: no link between
different components is lost.

Hot shingles (HOT or more documents by the sketch's upper bound) are counted with partial
aggregation before their rows meet; hot buckets are cut into blocks of `block` rows and walked
by pairs of blocks in tasks of their own, so no task holds more than two blocks. The sets of
candidates alone are shuffled. Bitmaps are joined to rows as they are walked; tables that no later
step reads are deleted."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import drop_written, text_sha, written

CELLS = 1 << 18
CELL_SHIFT = np.uint64(46)
BITS = 1024
LEAF = 16
BLOCK = 20_000
HOT = 1_000_000
LONG, WIDE = 1_000, 4
FURTHER = 64
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """A hash for each k words in a row, repeats included: A-Z lower-cased, words
    `[^\\x20\\x09-\\x0D]+`; fewer than k words are one shingle, none give an empty array."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1 if len(h) >= k else min(1, len(h))
    out = np.full(n, min(len(h), k), np.uint64)
    for i in range(min(k, len(h))):
        out = _mixed((out * _MIX[0]) ^ h[i : i + n])
    return out


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set of similarity >= percent / 100."""
    return -(-percent * n // 100)


def required_of_smaller(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set of at least that size."""
    return -(-2 * percent * n // (100 + percent))


# ---- order of shingles


def _sketch(k: int):
    def run(batches):
        from pyspark import TaskContext

        counts, held, size = np.zeros(CELLS, np.int64), [], 0

        def add():
            return np.bincount((np.concatenate(held) >> CELL_SHIFT).astype(np.int64), minlength=CELLS)

        for batch in batches:
            for text in batch.column("text"):
                held.append(shingle_hashes(text.as_py(), k))
                size += len(held[-1])
                if size > 1 << 20:
                    counts += add()
                    held, size = [], 0
        if held:
            counts += add()
        pieces = counts.reshape(64, -1)
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([salt] * 64, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "salt", "counts"])

    return run


def _sum_counts(batches):
    """One row for each piece of this task; the sums take 2 MB at most."""
    total: dict = {}
    for batch in batches:
        for piece, c in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
            total[piece] = total.get(piece, 0) + np.frombuffer(c.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["piece", "counts"])


def cell_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of the whole corpus by the leading 18 bits of their hash: always CELLS counts."""
    each = docs.mapInArrow(_sketch(k), "piece int, salt int, counts binary")
    salted = each.repartition("piece", "salt").mapInArrow(_sum_counts, "piece int, counts binary")
    rows = salted.repartition("piece").mapInArrow(_sum_counts, "piece int, counts binary").collect()
    counts = np.zeros(CELLS, np.int64)
    for r in rows:
        counts.reshape(64, -1)[r["piece"]] += np.frombuffer(r["counts"], np.int64)
    return counts


# ---- sets, classes, prefixes


def _bitmap(s: np.ndarray, size: int = BITS) -> bytes:
    """Bit h mod size for each hash; size is a power of two."""
    bits = np.zeros(size, np.uint8)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _wide(s: np.ndarray) -> bytes:
    return _bitmap(s, 1 << (WIDE * len(s) - 1).bit_length())


# tokens, hot: the first shingles in order, the `lead` and `hot_lead` first of which are those of a smaller set
SETS = "doc_id long, text_key long, digest binary, n long, tokens array<long>, lead int, hot array<long>, hot_lead int, bitmap binary, wide binary"


def _sets(k: int, percent: int, order: np.ndarray):
    """For each document its class; once in a task for each class its first tokens and bitmap."""

    def run(batches):
        seen: set = set()
        tokens_type = pa.list_(pa.int64())
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("tokens", tokens_type), ("lead", pa.int32()), ("hot", tokens_type), ("hot_lead", pa.int32()), ("bitmap", pa.binary()), ("wide", pa.binary())])
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
                s = np.unique(shingle_hashes(text.as_py(), k))
                digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                once = (None,) * 6
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    rank = order[(s >> CELL_SHIFT).astype(np.int64)]
                    first = np.lexsort((s, rank))[: len(s) - required(len(s), percent) + 1]
                    tokens, often, small = s[first].view(np.int64), rank[first] >= HOT, len(s) - required_of_smaller(len(s), percent) + 1
                    once = (tokens[~often], int((~often[:small]).sum()), tokens[often], int(often[:small].sum()), _bitmap(s), _wide(s) if len(s) > LONG else None)
                rows.append((doc_id, key, digest, len(s), *once))
            out = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema]
            more = batch.schema.names[3:]  # what else the rows carry
            yield pa.RecordBatch.from_arrays([*out, *[batch.column(c) for c in more]], [*schema.names, *more])

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], ["cls", "set"])

    return run


# ---- signature trees


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1, dtype=np.int64)


class Tree:
    """Level 0 holds the rows; each node of a level covers FAN of the level below."""

    FAN = 8

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        pop = _count(bits)
        self.levels = [{"bits": bits, "nmin": n, "nmax": n, "slack": n - pop}]
        while len(self.levels[-1]["nmin"]) > self.FAN:
            x = self.levels[-1]
            at = np.arange(0, len(x["nmin"]), self.FAN)
            self.levels.append({"bits": np.bitwise_or.reduceat(x["bits"], at), "nmin": np.minimum.reduceat(x["nmin"], at), "nmax": np.maximum.reduceat(x["nmax"], at), "slack": np.maximum.reduceat(x["slack"], at)})

    def color(self, comp: np.ndarray) -> None:
        """Range of components below each node."""
        self.comp = [(comp, comp)]
        for _ in self.levels[1:]:
            lo, hi = self.comp[-1]
            at = np.arange(0, len(lo), self.FAN)
            self.comp.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))


def fits(a: dict, p: np.ndarray, b: dict, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair below the nodes p of a and q of b may reach the similarity.

    A set below p has at least n - slack bits, of which at most `common` lie in q; each other
    bit stands for a token that no set below q has. So no overlap exceeds slack + common."""
    ok = (100 * a["nmax"][p] >= percent * b["nmin"][q]) & (100 * b["nmax"][q] >= percent * a["nmin"][p])
    i = np.flatnonzero(ok)
    p, q = p[i], q[i]
    common = _count(a["bits"][p] & b["bits"][q])
    most = np.minimum(np.minimum(a["nmax"][p], b["nmax"][q]), common + np.minimum(a["slack"][p], b["slack"][q]))
    ok[i] = (100 + percent) * most >= percent * (a["nmin"][p] + b["nmin"][q])
    return ok


class Forest:
    """Union-find over rows."""

    def __init__(self, comp: np.ndarray):
        self.parent: dict = {}
        self.comp = comp

    def root(self, x: int) -> int:
        p = self.parent
        while x in p:
            y = p[x]
            if y in p:
                p[x] = p[y]
            x = y
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def colors(self) -> np.ndarray:
        if not self.parent:
            return self.comp
        values, back = np.unique(self.comp, return_inverse=True)
        return np.array([self.root(v) for v in values.tolist()], self.comp.dtype)[back]


class Pairs:
    """Pairs that a walk lets through. Without a limit: a forest over components. With one: so
    many pairs for each two components of a bucket; `held` tells that more were there."""

    def __init__(self, limit: int | None):
        self.limit, self.out, self.held, self.counts = limit, [], False, {}

    def take(self, forest: Forest, cls_a, comp_a, cls_b, comp_b) -> bool:
        """Adds candidate pairs (arrays); True if components were joined."""
        order = np.lexsort((np.maximum(cls_a, cls_b), np.minimum(cls_a, cls_b)))
        changed = False
        for a, x, b, y in zip(cls_a[order].tolist(), comp_a[order].tolist(), cls_b[order].tolist(), comp_b[order].tolist(), strict=True):
            if self.limit is None:
                if not forest.union(x, y):
                    continue
                changed = True
            else:
                key = (x, y) if x < y else (y, x)
                n = self.counts.get(key, 0)
                if n >= self.limit:
                    self.held = True
                    continue
                self.counts[key] = n + 1
            self.out.append((a, b) if a < b else (b, a))
        return changed


def walk(left: dict, right: dict | None, percent: int, pairs: Pairs, chunk: int = 512) -> None:
    """Dual traversal of the trees over left and right (None: left with itself).

    left, right: arrays cls, comp, n, bits. Like sizes and like components stand together in
    the trees, so their ranges are narrow."""

    def planted(x):
        order = np.lexsort((x["cls"], x["n"], x["comp"]))
        x = {k: v[order] for k, v in x.items()}
        return x, Tree(x["n"], x["bits"])

    a, ta = planted(left)
    b, tb = (a, ta) if right is None else planted(right)
    same = right is None
    forest = Forest(np.concatenate([a["comp"]] + ([] if same else [b["comp"]])))

    def color():
        comp = forest.colors()
        ta.color(comp[: len(a["cls"])])
        if not same:
            tb.color(comp[len(a["cls"]) :])

    color()
    level_a, level_b = len(ta.levels) - 1, len(tb.levels) - 1
    p, q = np.meshgrid(np.arange(len(ta.levels[-1]["nmin"])), np.arange(len(tb.levels[-1]["nmin"])), indexing="ij")
    p, q = p.ravel(), q.ravel()
    if same:
        p, q = p[p <= q], q[p <= q]
    stack = [(level_a, level_b, p, q)]
    fan = np.arange(Tree.FAN)
    while stack:
        la, lb, p, q = stack.pop()
        if len(p) > chunk and (la or lb):
            stack.append((la, lb, p[chunk:], q[chunk:]))
            p, q = p[:chunk], q[:chunk]
        lo_a, hi_a = ta.comp[la]
        lo_b, hi_b = tb.comp[lb]
        open_ = (lo_a[p] != hi_a[p]) | (lo_b[q] != hi_b[q]) | (lo_a[p] != lo_b[q])
        p, q = p[open_], q[open_]
        ok = fits(ta.levels[la], p, tb.levels[lb], q, percent)
        p, q = p[ok], q[ok]
        if not len(p):
            continue
        if not la and not lb:
            if pairs.take(forest, a["cls"][p], lo_a[p], b["cls"][q], lo_b[q]):
                color()
            continue
        # go down where the tree is higher, in both at equal height
        down_a, down_b = la >= lb, lb >= la
        cp = p[:, None, None] * Tree.FAN + fan[None, :, None] if down_a else p[:, None, None]
        cq = q[:, None, None] * Tree.FAN + fan[None, None, :] if down_b else q[:, None, None]
        cp, cq = (x.ravel() for x in np.broadcast_arrays(cp, cq))
        la, lb = la - down_a, lb - down_b
        keep = (cp < len(ta.levels[la]["nmin"])) & (cq < len(tb.levels[lb]["nmin"]))
        if same:
            keep &= (cp <= cq) if la else (cp < cq)
        cp, cq = cp[keep], cq[keep]
        near = np.argsort(cq - cp, kind="stable") if same else slice(None)  # neighbours first: they join early
        stack.append((la, lb, cp[near], cq[near]))


def _small(x: dict, start: np.ndarray, size: np.ndarray, percent: int, limit) -> list:
    """(number of the group, pairs) of many small groups (single leaves) at once: rows i and
    i + d of a group."""
    group = np.repeat(np.arange(len(start)), size)
    rows = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    x = {k: v[rows] for k, v in x.items()}
    level = {"bits": x["bits"], "nmin": x["n"], "nmax": x["n"], "slack": x["n"] - _count(x["bits"])}
    found = []
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero((group[:-d] == group[d:]) & (x["comp"][:-d] != x["comp"][d:]))
        i = i[fits(level, i, level, i + d, percent)]
        found.append((group[i], i, i + d))
    if not found:
        return []
    g, i, j = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(g, kind="stable")
    g, i, j = g[order], i[order], j[order]
    out = []
    for part in np.split(np.arange(len(g)), np.flatnonzero(np.diff(g)) + 1):
        if len(part):
            pairs = Pairs(limit)
            pairs.take(Forest(x["comp"]), x["cls"][i[part]], x["comp"][i[part]], x["cls"][j[part]], x["comp"][j[part]])
            out.append((int(g[part[0]]), pairs))
    return out


def _join_buckets(percent: int, limit: int | None):
    """Rows sorted by bucket (token, blocks) and side -> candidate pairs a < b with the token of
    their bucket; a row without a pair tells that a bucket held some back."""

    def run(batches):
        carried = None

        def result(done):
            out = [(*x, token) for token, p in done for x in p.out] + [(None, None, token) for token, p in done if p.held]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["a", "b", "token"])

        def groups(t: dict, cuts: np.ndarray):
            size = np.diff(cuts)
            x = {k: t[k] for k in ("cls", "comp", "n", "bits")}
            done = []
            one_sided = np.array([not t["side"][e - 1] for e in cuts[1:]], bool)
            little = (size <= LEAF) & (size > 1) & one_sided
            starts = cuts[:-1][little]
            done += [(t["token"][starts[g]], pairs) for g, pairs in _small(x, starts, size[little], percent, limit)]
            for g in np.flatnonzero((size > LEAF) & one_sided | ~one_sided):
                s, e = cuts[g], cuts[g + 1]
                cut = s + int(np.searchsorted(t["side"][s:e], 1))
                if cut == s or (cut - s < 2 and cut == e):
                    continue
                pairs = Pairs(limit)
                part = lambda u, v: {k: c[u:v] for k, c in x.items()}
                walk(part(s, cut), part(cut, e) if cut < e else None, percent, pairs)
                done.append((t["token"][s], pairs))
            return done

        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "blocks", "side", "cls", "comp", "n")}
            raw = batch.column("bitmap")
            t["bits"] = np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if carried is not None:
                t = {k: np.concatenate([carried[k], v]) for k, v in t.items()}
            if not len(t["token"]):
                continue
            new = np.flatnonzero((np.diff(t["token"]) != 0) | (np.diff(t["blocks"]) != 0)) + 1
            cuts = np.concatenate([[0], new])
            carried = {k: v[cuts[-1] :].copy() for k, v in t.items()}
            if len(cuts) > 1:
                yield result(groups(t, cuts))
        if carried is not None:
            yield result(groups(carried, np.array([0, len(carried["token"])])))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return run


# ---- the join


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label (smallest node reachable) of every node of links (a, b): large-star and
    small-star steps until only stars are left. Stars are joined, never collected."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), name)
        # stars: every node has one centre, or is one
        ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.col("v")))
        if ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo != hi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels with further links: components of the labels that they join, then of the nodes."""
    if labels is None:
        return written(components(links), "labels")
    labels = labels.select("node", "label")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    met = written(met.where("a != b"), "labels")
    if met.isEmpty():
        return labels
    joined = components(met).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    moved = labels.join(joined, "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    # nodes that had no link before
    new = joined.select(F.col("label").alias("node"), F.col("_to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return written(moved.unionByName(new), "labels")


def _placed(rows: DataFrame, block: int) -> DataFrame:
    """Buckets of more than `block` rows as pairs of blocks: each row goes to every pair of its
    block, on side 0 or 1."""
    parts = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("cls"), parts.cast("bigint")).cast("int")
    hot = rows.where(F.col("size") > block).withColumn("_k", parts).withColumn("_i", mine)
    hot = hot.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    blocks = F.least("_i", "_j").cast("bigint") * F.col("_k") + F.greatest("_i", "_j")
    hot = hot.withColumn("blocks", blocks).withColumn("side", (F.col("_i") > F.col("_j")).cast("int")).drop("_k", "_i", "_j")
    cold = rows.where(F.col("size") <= block).withColumn("blocks", F.lit(0).cast("bigint")).withColumn("side", F.lit(0))
    return cold.unionByName(hot)


MAX_BROADCAST_KEYS = 1_000_000


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, sha: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id, with `sha` also the SHA-256
    of the text.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    class_id is the smallest doc_id with an equal set, component_id the smallest reachable by
    links. Null texts count as empty; documents without words have n_shingles 0 and link with
    nothing. Repeated rows and rows of equal id are documents of their own; null ids have no say
    in a class that has others. An empty table gives an empty table."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("text_key", F.xxhash64("text"))
    order = cell_counts(base, k).astype(np.int64)
    more = ["sha"] if sha else []
    carried = keyed.select("*", *[text_sha(F.col("text")).alias(c) for c in more])
    sets = written(carried.mapInArrow(_sets(k, percent, order), SETS + ", sha binary" * sha), "jaccard-sets")
    documents = written(sets.select("doc_id", "digest", F.col("n").alias("n_shingles"), *more), "jaccard-documents")
    full = written(sets.where("tokens IS NOT NULL").drop(*more).dropDuplicates(["digest"]).withColumn("cls", F.monotonically_increasing_id()), "jaccard-full")
    drop_written(sets)
    # rows without a partner under their token go: a smaller one among whose leading shingles it
    # is, or, where it leads itself, any larger one
    at = lambda tokens, lead: full.select("cls", "n", lead, F.posexplode(tokens).alias("_at", "token")).select("cls", "n", "token", (F.col("_at") < F.col(lead)).alias("leads"))
    w = Window.partitionBy("token").orderBy("n", F.desc("leads"), "cls")
    smaller = F.last(F.when(F.col("leads"), F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fits_ = (smaller * 100 >= F.col("n") * percent, F.col("leads") & (F.lead("n").over(w) * percent <= F.col("n") * 100))
    fitting = at("tokens", "lead").withColumn("_fit", F.coalesce(fits_[0], F.lit(False)) | F.coalesce(fits_[1], F.lit(False)))
    cold = fitting.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_fit").drop("_fit", "leads")
    # hot tokens: counted first, no window over them
    often = at("hot", "hot_lead").drop("leads")
    hot = often.join(often.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "token")
    rows = written(cold.unionByName(hot), "jaccard-rows")
    classes = written(full.drop("tokens", "lead", "hot", "hot_lead"), "jaccard-classes")
    drop_written(full)
    bitmaps = classes.select("cls", "bitmap")

    labels, turn = None, 0
    while True:
        limit = None if turn == 0 else FURTHER**turn
        now = rows.withColumn("comp", F.col("cls")) if labels is None else rows.join(labels, rows["cls"] == labels["node"], "left").withColumn("comp", F.coalesce("label", "cls")).drop("node", "label")
        walked = _placed(now.join(bitmaps, "cls"), block).select("token", "blocks", "side", "cls", "comp", "n", "bitmap").repartition("token", "blocks").sortWithinPartitions("token", "blocks", "side", "cls")
        found = written(walked.mapInArrow(_join_buckets(percent, limit), "a long, b long, token long"), "jaccard-found")
        checked = _checked(found.where("a IS NOT NULL").select("a", "b").distinct(), classes, keyed, k, percent)
        labels = _relabelled(labels, checked.where("linked").select("a", "b"))
        # a forest whose pairs all hold connects its bucket; other buckets, and those with more pairs, come again
        open_ = found.join(checked.where("NOT linked"), ["a", "b"], "left_semi") if turn == 0 else found.where("a IS NULL")
        live = written(open_.select("token").distinct(), "jaccard-live")
        drop_written(found, checked)
        if live.isEmpty():
            break
        old, rows, turn = rows, written(rows.join(live, "token", "left_semi"), "jaccard-rows"), turn + 1
        drop_written(old, live)
    known = documents.join(classes.select("digest", "cls"), "digest", "left")
    known = written(known.join(labels, known["cls"] == labels["node"], "left").select("doc_id", "n_shingles", "cls", F.coalesce("label", "cls").alias("label"), *more), "jaccard-known")
    firsts = written(known.where("cls IS NOT NULL").groupBy("cls", "label").agg(F.min("doc_id").alias("class_id")), "jaccard-firsts")
    groups = written(firsts.groupBy("label").agg(F.min("class_id").alias("component_id")), "jaccard-groups")
    out = known.join(firsts.select("cls", "class_id"), "cls", "left").join(groups, "label", "left")
    # documents without words, and groups without any id, are their own
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def _plausible(percent: int):
    """Whether a pair of long documents may be similar, by their wide bitmaps; others may."""

    def fold(bits: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*[batch.column(c).to_pylist() for c in ("n_a", "n_b", "wide_a", "wide_b")], strict=True):
                if x is None or y is None:
                    ok.append(True)
                    continue
                size = min(len(x), len(y))
                x, y = fold(np.frombuffer(x, np.uint8), size), fold(np.frombuffer(y, np.uint8), size)
                most = min(n - int(_count(x & ~y)), m - int(_count(y & ~x)))
                ok.append((100 + percent) * most >= percent * (n + m))
            kept = ["a", "b", "text_key_a", "text_key_b", "doc_id_a", "doc_id_b"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(ok, pa.bool_())], [*kept, "plausible"])

    return run


def _checked(pairs: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs with `linked`: long documents by their wide bitmaps first, then by the full sets of
    the classes that are left."""
    facts = ("n", "wide", "text_key", "doc_id")
    of = lambda c: classes.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in facts])
    schema = "a long, b long, text_key_a long, text_key_b long, doc_id_a long, doc_id_b long, plausible boolean"
    tried = written(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_plausible(percent), schema), "jaccard-pairs")
    left = tried.where("plausible")
    ends = [left.select(F.col(c).alias("cls"), F.col(f"text_key_{c}").alias("text_key"), F.col(f"doc_id_{c}").alias("rep")) for c in "ab"]
    wanted = written(ends[0].unionByName(ends[1]).distinct(), "jaccard-wanted")
    few = wanted.count() <= MAX_BROADCAST_KEYS  # 24 bytes each
    asked = F.broadcast(wanted) if few else wanted
    # one row for each class; rows that repeat its id and text give the same set again
    texts = keyed.join(asked, (keyed["text_key"] == asked["text_key"]) & keyed["doc_id"].eqNullSafe(asked["rep"])).select("cls", "text")
    full = texts.mapInArrow(_full_sets(k), "cls long, set binary").repartition("cls")
    side = lambda c: full.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))
    verified = left.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(percent), "a long, b long, linked boolean")
    checked = written(verified.unionByName(tried.where("NOT plausible").select("a", "b", F.lit(False).alias("linked"))), "jaccard-checked")
    drop_written(tried, wanted)
    return checked


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", null_ids: bool = True) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, all columns; of rows that
    repeat this id in a component all stay. Rows are known by id and text. null_ids: whether rows
    without an id stay in components that have one; those of components without any id stay."""
    found = jaccard_components(docs, k, percent, doc_id, text, sha=True)
    other = F.col("doc_id") != F.col("component_id") if null_ids else ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = found.where(other).select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_sha")).distinct()
    return docs.join(gone, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_gone")) & (text_sha(F.col(text)) == F.col("_sha")), "left_anti")
