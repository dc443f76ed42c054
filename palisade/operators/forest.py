"""Random forest of hard votes: the trees of spark.ml's RandomForestClassifier (Gini, all features at
every node, Poisson counts as bootstrap, thresholds from at most SAMPLE rows), grown from small tables.

1. Rows become blocks: a byte a feature (its bin) and a byte a tree (how often the tree has the row).
2. Each pass over the blocks counts classes by bin for as many nodes as histogram_mb holds; only rows
   that a tree has are counted, and where nodes are few, only bins other than that of zero: the rest
   are differences.
3. Tasks add up the counts of a node and find its best split; the driver has the trees only.

spark.ml counts every row, feature and tree, keeps 1.8 KB a row and sends 8 bytes a cell."""

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.plans.stage import arrow_batches, materialize

#: As in spark.ml: most bins of a feature, rows that thresholds are found from.
MAX_BINS, SAMPLE = 32, 10_000
BLOCK_ROWS = 2000
#: Bytes and blocks that go to a Python task at once, blocks read at once.
BATCH_BYTES, READ_ROWS = 4 << 20, 16
_EPSILON = 2.0**-52


# ---------------------------------------------------------------- bootstrap counts

_U = np.uint32
#: 70 words side by side in one number: masks of what a shift leaves of each.
_LANES, _ONES = struct.Struct("<70I"), sum(1 << 32 * i for i in range(70))
_UP = {k: _ONES * (0xFFFFFFFF << k & 0xFFFFFFFF) for k in (9, 21, 25, 31)}
_DOWN = {k: _ONES * (0xFFFFFFFF >> k) for k in (1, 9, 21, 27)}


class Draws:
    """Poisson counts of commons-math's PoissonDistribution, reseeded: WELL 19937c. What a word takes from
    words 70 and more ago is computed for as many at once; the word before it comes in one by one."""

    LAG, KEPT = 70, 623

    def __init__(self, seed: int, mean: float):
        seed &= (1 << 64) - 1
        v = [seed >> 32, seed & 0xFFFFFFFF]
        for i in range(2, 624):
            last = v[i - 2] - (1 << 32) if v[i - 2] >> 31 else v[i - 2]
            v.append((1812433253 * (last ^ (last >> 30)) + i) & 0xFFFFFFFF)
        self.past = np.array(v[:0:-1], "<u4").tobytes()  # words that the next ones are made from, oldest first
        self.last, self.least = v[0], math.exp(-mean)
        self.uniform, self.found = np.zeros(0), np.zeros(0, np.uint8)

    def _words(self, n: int) -> np.ndarray:
        n = -(-n // self.LAG) * self.LAG
        size, at, last = 4 * self.LAG, 4 * self.KEPT, self.last
        z3, out = bytearray(self.past) + bytearray(4 * n), bytearray(4 * n + 4)
        struct.pack_into("<I", out, 0, last)
        for to in range(4, 4 * n + 4, size):
            a, m3 = (int.from_bytes(z3[at - 4 * k : at - 4 * k + size], "little") for k in (70, 449))
            a ^= a >> 27 & _DOWN[27]
            z2 = (int.from_bytes(z3[at - 716 : at - 716 + size], "little") >> 9 & _DOWN[9]) ^ m3 ^ (m3 >> 1 & _DOWN[1])
            z0 = int.from_bytes(z3[at - 2492 : at - 2492 + size], "little") & _UP[31] ^ int.from_bytes(z3[at - 2488 : at - 2488 + size], "little") & _DOWN[1]
            x = a ^ z2
            new = list(_LANES.unpack((z0 ^ a ^ (a << 9 & _UP[9]) ^ z2 ^ (z2 << 21 & _UP[21]) ^ x ^ (x >> 21 & _DOWN[21])).to_bytes(size, "little")))
            for i, word in enumerate(new):
                new[i] = last = word ^ (last << 9 & 0xFFFFFFFF) ^ (last >> 21) ^ ((last & 127) << 4)
            _LANES.pack_into(out, to, *new)
            before = int.from_bytes(out[to - 4 : to - 4 + size], "little")
            z3[at : at + size] = (x ^ before ^ (before << 25 & _UP[25])).to_bytes(size, "little")
            at += size
        self.past, self.last, out = bytes(z3[-4 * self.KEPT :]), last, np.frombuffer(out, "<u4")[1:]
        out = out ^ ((out << _U(7)) & _U(0xE46E1700))
        return out ^ ((out << _U(15)) & _U(0x9B868000))

    def _more(self, n: int) -> None:
        words = self._words(max(140, int(3.6 * n))) >> _U(6)
        u = np.concatenate([self.uniform, ((words[0::2].astype(np.int64) << 26) | words[1::2]) * 2.0**-52])
        # counts of a draw that starts at each place; the number is one more
        count, product, open_ = np.zeros(len(u), np.int64), u.copy(), np.arange(len(u))
        while len(open_ := open_[product[open_] >= self.least]):
            count[open_] += 1
            after = open_ + count[open_]
            count[open_[after >= len(u)]] = -1  # not ended yet
            open_, after = open_[after < len(u)], after[after < len(u)]
            product[open_] *= u[after]
        counts, at, starts = count.tolist(), 0, []
        while at < len(counts) and counts[at] >= 0:
            starts.append(at)
            at += counts[at] + 1
        self.uniform = u[at:]
        self.found = np.concatenate([self.found, count[starts].astype(np.uint8)])

    def take(self, n: int) -> np.ndarray:
        while len(self.found) < n:
            self._more(n - len(self.found))
        out, self.found = self.found[:n], self.found[n:]
        return out


# ---------------------------------------------------------------- thresholds and blocks


def thresholds_of(values: np.ndarray, rows: float) -> np.ndarray:
    """Thresholds of a feature from its values in a sample of about that many rows."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    if not len(found):
        return np.zeros(0)
    counts = counts.astype(float)
    if rows - counts.sum() > _EPSILON * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, rows - counts.sum())
    middle, splits = (found[:-1] + found[1:]) / 2.0, min(MAX_BINS, max(2, int(rows))) - 1
    if len(middle) <= splits:
        return middle
    stride = rows / (splits + 1)
    target, now, out = stride, counts[0], []
    for i in range(1, len(found)):
        before, now = now, now + counts[i]
        if abs(before - target) < abs(now - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _flat(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


_BLOCKS = "class binary, bins binary, bag binary"


def _blocks(used: list, trees: int, share: float, seed: int):
    def run(batches):
        from pyspark import TaskContext

        draws = Draws(seed + TaskContext.get().partitionId() + 1, share)
        for batch in batches:
            classes = np.asarray(batch.column("class")).astype(np.uint16)
            x = _flat(batch.column("features")) if len(classes) else None
            for s in range(0, len(classes), BLOCK_ROWS):
                own = x[s : s + BLOCK_ROWS]
                bins = np.empty((len(own), len(used)), np.uint8)
                for i, (f, cuts) in enumerate(used):
                    bins[:, i] = np.searchsorted(cuts, own[:, f])
                bag = draws.take(len(own) * trees)
                kind = pa.binary()
                yield _batch(**{"class": ([classes[s : s + BLOCK_ROWS].tobytes()], kind), "bins": ([bins.tobytes()], kind), "bag": ([bag.tobytes()], kind)})

    return run


# ---------------------------------------------------------------- nodes


class _Layout:
    """Places of the counts of a node: by class, the bins of all features and then the whole."""

    def __init__(self, used: list, classes: int):
        sizes = np.array([len(cuts) + 1 for _, cuts in used], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.zero = np.array([np.searchsorted(cuts, 0.0) for _, cuts in used], np.uint8)
        self.features, self.classes, self.bins = len(used), classes, int(sizes.sum())
        self.width = self.bins + 1
        self.cells = classes * self.width
        self.feature = np.repeat(np.arange(len(used)), sizes)
        last = self.start + sizes - 1
        self.split = np.setdiff1d(np.arange(self.bins), last)  # a split is after its bin


_COUNTS = "node long, counts binary"


def _count(layout: _Layout, trees: int, state):
    """Counts of the nodes that state asks for, from the blocks of a task."""

    def rows(hist):
        step = max(1, BATCH_BYTES // (4 * layout.cells))
        names, some = state.value["names"], np.flatnonzero(hist[:, layout.bins :: layout.width].any(axis=1))
        for s in range(0, len(some), step):
            part = [hist[i] for i in some[s : s + step]]
            yield _batch(node=(names[some[s : s + step]], pa.int64()), counts=([h.astype(np.min_scalar_type(h.max())).tobytes() for h in part], pa.binary()))

    def run(batches):
        asked, hist = state.value, None
        for batch in batches:
            read = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind)  # noqa: B023, E731
            classes = read("class", np.uint16).astype(np.int64)
            n = len(classes)
            if not n:
                continue
            bins, bag = read("bins", np.uint8).reshape(n, -1), read("bag", np.uint8).reshape(n, trees).T.copy()
            if hist is None:
                hist = np.zeros((len(asked["names"]), layout.cells), np.int32)
            flat = hist.reshape(-1)
            other = bins != layout.zero
            column = np.flatnonzero(other) % layout.features
            place, many = (layout.start[column] + bins[other]).astype(np.int32), other.sum(axis=1)
            from_, every = np.cumsum(many) - many, None
            for t, tree in asked["trees"].items():
                mine = np.flatnonzero(bag[t])
                node = np.zeros(len(mine), np.int64)
                for _ in range(asked["level"]):
                    left = bins[mine, tree["feature"][node]] <= tree["bin"][node]
                    node = np.where(left, tree["left"][node], tree["right"][node])
                    mine, node = mine[node >= 0], node[node >= 0]
                slot = tree["slot"][node]
                mine, slot = mine[slot >= 0], slot[slot >= 0]
                if not len(mine):
                    continue
                base, weight, c = slot * layout.cells + classes[mine] * layout.width, bag[t][mine].astype(np.int32), many[mine]
                np.add.at(flat, base + layout.bins, weight)
                first, last = tree["first"] * layout.cells, tree["last"] * layout.cells
                if last - first <= 2 * c.sum():  # few nodes: bins other than that of zero, counted apart
                    ends = np.cumsum(c)
                    at = place[np.repeat(from_[mine] - (ends - c), c) + np.arange(ends[-1])] + np.repeat(base - first, c)
                    flat[first:last] += np.bincount(at, np.repeat(weight, c), last - first).astype(np.int32)
                else:
                    every = (layout.start + bins).astype(np.int32) if every is None else every
                    for s in range(0, len(mine), 1024):
                        np.add.at(flat, (every[mine[s : s + 1024]] + base[s : s + 1024, None]).ravel(), np.repeat(weight[s : s + 1024], layout.features))
        if hist is not None:
            yield from rows(hist)

    return run


def _gini(counts, total):
    out = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in counts:
            share = c / total
            out = out - share * share
    return np.where(total == 0, 0.0, out)


_SPLITS = "node long, place int, gain double, whole array<double>, low array<double>"


def best_split(counts: np.ndarray, layout: _Layout, least: int) -> tuple:
    """(place of the split or -1, gain, class counts, those of the left side) of one node."""
    whole = counts[:, -1].astype(float)
    if not len(layout.split):
        return -1, 0.0, whole, whole
    by_bin = counts[:, :-1].astype(float)
    by_bin[:, layout.start + layout.zero] += whole[:, None] - np.add.reduceat(by_bin, layout.start, axis=1)
    low = np.cumsum(by_bin, axis=1)
    low -= np.concatenate([np.zeros((len(low), 1)), low[:, layout.start[1:] - 1]], axis=1)[:, layout.feature]
    low = low[:, layout.split]
    high = whole[:, None] - low
    n_low, n_high, n = low.sum(axis=0), high.sum(axis=0), whole.sum()
    gain = _gini(whole, n) - n_low / n * _gini(low, n_low) - n_high / n * _gini(high, n_high)
    gain = np.where((n_low < least) | (n_high < least) | (gain < 0), -np.inf, gain)
    best = int(gain.argmax())
    return (int(layout.split[best]) if gain[best] > 0 else -1), float(gain[best]), whole, low[:, best]


def _best(layout: _Layout, least: int):
    def run(batches):
        node, total = None, None

        def row():
            place, gain, whole, low = best_split(total.reshape(layout.classes, layout.width), layout, least)
            lists = pa.list_(pa.float64())
            return _batch(node=([node], pa.int64()), place=([place], pa.int32()), gain=([gain], pa.float64()), whole=([whole.tolist()], lists), low=([low.tolist()], lists))

        for batch in batches:
            for i in range(batch.num_rows):
                name, given = batch.column("node")[i].as_py(), batch.column("counts")[i].as_py()
                if name != node:
                    if node is not None:
                        yield row()
                    node, total = name, np.zeros(layout.cells, np.int64)
                total += np.frombuffer(given, np.dtype(f"u{len(given) // layout.cells}"))
        if node is not None:
            yield row()

    return run


class Forest:
    """Trees as arrays: feature, threshold, left, right (-1: leaf), prediction (class)."""

    def __init__(self, trees: list):
        self.trees = trees

    @property
    def toDebugString(self) -> str:
        lines = [f"Forest of {len(self.trees)} trees"]
        for i, t in enumerate(self.trees):
            lines.append(f"Tree {i}")
            lines += [f" {n}: " + (f"predict {p:g}" if a < 0 else f"feature {f} <= {c!r}: {a} else {b}") for n, (f, c, a, b, p) in enumerate(zip(*(t[k].tolist() for k in ("feature", "threshold", "left", "right", "prediction")), strict=True))]
        return "\n".join(lines)


class _Tree:
    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.prediction = [-1], [0], [-1], [-1], [0]

    def add(self, prediction: int) -> int:
        for column, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.prediction, prediction)):
            column.append(v)
        return len(self.left) - 1


def grow(rows: DataFrame, classes: int, n: int, trees: int, depth: int, share: float, least: int, seed: int, histogram_mb: int) -> Forest:
    """A forest on rows (class, features array<double>) of a table whose partitions keep their order."""
    spark = rows.sparkSession
    with arrow_batches(spark, BATCH_BYTES, BLOCK_ROWS, READ_ROWS):
        part = min(1.0, SAMPLE / n)
        some = rows.select("features") if part == 1.0 else rows.select("features").sample(False, part, seed)
        x = _flat(some.toArrow().column("features").combine_chunks())
        cuts = [thresholds_of(x[:, f], part * n) for f in range(x.shape[1])]
        used = [(f, c) for f, c in enumerate(cuts) if len(c)]
        if not used:
            return Forest([{"feature": np.array([-1]), "threshold": np.zeros(1), "left": np.array([-1]), "right": np.array([-1]), "prediction": np.array([_common(rows)])} for _ in range(trees)])
        layout = _Layout(used, classes)
        blocks = materialize(rows.mapInArrow(_blocks(used, trees, share, seed), _BLOCKS), "blocks")
        blocks = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))
        grown = [_Tree() for _ in range(trees)]
        open_ = [(t, 0) for t in range(trees)]
        most = max(1, (histogram_mb << 20) // (4 * layout.cells))
        for level in range(depth):
            following = []
            for s in range(0, len(open_), most):
                following += _level(blocks, grown, open_[s : s + most], level, depth, layout, trees, least)
            open_ = following
    return Forest([{
        "feature": np.array([used[f][0] if f >= 0 else -1 for f in t.feature]), "threshold": np.array([float(used[f][1][b]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin, strict=True)]),
        "left": np.array(t.left), "right": np.array(t.right), "prediction": np.array(t.prediction),
    } for t in grown])


def _common(rows: DataFrame) -> int:
    return int(rows.groupBy("class").count().orderBy(F.desc("count"), "class").first()["class"])


def _level(blocks: DataFrame, grown: list, nodes: list, level: int, depth: int, layout: _Layout, trees: int, least: int) -> list:
    """Splits nodes (tree, node) of a level; the children that may split again."""
    asked = {"level": level, "names": np.array([(t << 32) | i for t, i in nodes], np.int64), "trees": {}}
    for slot, (t, i) in enumerate(nodes):
        if t not in asked["trees"]:
            own = grown[t]
            asked["trees"][t] = {k: np.array(getattr(own, k), np.int64) for k in ("feature", "bin", "left", "right")} | {"slot": np.full(len(own.left), -1, np.int64), "first": slot}
        asked["trees"][t]["slot"][i], asked["trees"][t]["last"] = slot, slot + 1
    state = blocks.sparkSession.sparkContext.broadcast(asked)
    counts = blocks.mapInArrow(_count(layout, trees, state), _COUNTS)
    found = counts.repartition("node").sortWithinPartitions("node").mapInArrow(_best(layout, least), _SPLITS).collect()
    state.unpersist()
    following = []
    for r in sorted(found, key=lambda r: r["node"]):
        t, i = r["node"] >> 32, r["node"] & 0xFFFFFFFF
        tree, whole, low = grown[t], np.array(r["whole"]), np.array(r["low"])
        tree.prediction[i] = int(whole.argmax())
        if r["place"] < 0:
            continue
        f = int(layout.feature[r["place"]])
        tree.feature[i], tree.bin[i] = f, int(r["place"] - layout.start[f])
        for side, held in (("left", low), ("right", whole - low)):
            child = tree.add(int(held.argmax()))
            getattr(tree, side)[i] = child
            if level + 1 < depth and abs(_gini(held, held.sum())) >= _EPSILON:
                following.append((t, child))
    return following
