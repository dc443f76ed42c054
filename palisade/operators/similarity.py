"""Pairs of similar SimHash fingerprints."""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import rules
from palisade.functions.simhash import similarity, with_simhash
from palisade.plans.stage import materialize

BITS = rules.SIMHASH_PLANES
KEY_BITS = 32
#: The widest distance that block keys serve.
KEYED_DISTANCE = 6


def simhash(vectors: DataFrame, dim: int, column="embedding") -> DataFrame:
    return with_simhash(vectors, dim, column)


def block_plan(max_distance: int, keys: int = 128) -> tuple[int, int]:
    """(blocks, blocks that must agree): hashes within max_distance agree on at least
    blocks - max_distance blocks, whichever bits differ. More blocks make longer, more
    selective keys but more of them: the fewest blocks whose keys have KEY_BITS bits, as long
    as no hash gets more than `keys` of them."""
    plans = [(b, b - max_distance) for b in range(max_distance + 1, BITS + 1)]
    held = [p for p in plans if comb(*p) <= keys] or plans[:1]
    return next((p for p in held if BITS * p[1] / p[0] >= KEY_BITS), held[-1])


def _block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(h: Column, max_distance: int) -> Column:
    """All (combination number, bits of the chosen blocks) of a hash."""
    blocks, agree = block_plan(max_distance)
    masks = _block_masks(blocks)
    chosen = [_signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), agree)]
    literal = F.expr("array(" + ", ".join(f"CAST({m} AS BIGINT)" for m in chosen) + ")")
    return F.transform(literal, lambda m, i: F.struct(i.alias("combo"), h.bitwiseAND(m).alias("bits")))


def similar_pairs(hashes: DataFrame, min_similarity: float, column="simhash") -> DataFrame:
    """(hash_a, hash_b, members_a, members_b, similarity) with hash_a < hash_b, exact.

    Equal hashes are collapsed first (their group shows as hash_a = hash_b with similarity 1),
    so copies never multiply. Distinct hashes meet only where they agree on a block
    combination; a pair is kept at the first combination it agrees on, which removes
    duplicates without another shuffle.

    Similarities of 0.9 and more have keys of at least 18 bits. Below, keys would be short and a
    hash meet a growing share of all others: such pairs come from `wide_pairs`."""
    distance = int((1.0 - min_similarity) * BITS + 1e-9)
    distinct = materialize(hashes.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("h")).agg(F.count(F.lit(1)).alias("members")))
    same = distinct.filter(F.col("members") > 1).select(
        F.col("h").alias("hash_a"), F.col("h").alias("hash_b"), F.col("members").alias("members_a"),
        F.col("members").alias("members_b"), F.lit(1.0).alias("similarity"),
    )
    if distance > KEYED_DISTANCE:
        pairs = wide_pairs(distinct, distance)
        return pairs.withColumn("similarity", similarity(F.col("hash_a"), F.col("hash_b"))).unionByName(same)
    keyed = distinct.select("h", "members", F.explode(_keys(F.col("h"), distance)).alias("k"))
    side = lambda s: keyed.select("k.combo", "k.bits", F.col("h").alias(f"hash_{s}"), F.col("members").alias(f"members_{s}"))
    near = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b"))) <= distance
    met = side("a").join(side("b"), ["combo", "bits"]).filter((F.col("hash_a") < F.col("hash_b")) & near)
    blocks, agree = block_plan(distance)
    masks = _block_masks(blocks)
    chosen = [_signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), agree)]
    literal = F.expr("array(" + ", ".join(f"CAST({m} AS BIGINT)" for m in chosen) + ")")
    differing = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    first = F.array_position(F.transform(literal, lambda m: differing.bitwiseAND(m) == 0), F.lit(True)) - 1
    pairs = met.filter(F.col("combo") == first).select(
        "hash_a", "hash_b", "members_a", "members_b", similarity(F.col("hash_a"), F.col("hash_b")).alias("similarity")
    )
    return pairs.unionByName(same)

# ---------------------------------------------------------------- wide searches

PIVOTS = 32
MAX_BLOCKS = 1000
PAIRS_A_TASK = 16
BLOCK = 2048


def _bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _to_pivots(pivots: np.ndarray):
    """h, members, the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            d = _bits_between(batch.column("h").to_numpy().view(np.uint64), pivots)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("members"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell].astype(np.int32))], ["h", "members", "cell", "near"])

    return run


def _blocks(pivots: np.ndarray, size: int):
    """Blocks of hashes in order of cell and distance, with the range of their distances to every pivot."""

    def run(batches):
        from pyspark import TaskContext

        part, number, held, cell = TaskContext.get().partitionId(), 0, [], None

        def block():
            h, members = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            d = _bits_between(h.view(np.uint64), pivots)
            lists = lambda v, t: pa.array([v.tolist()], pa.list_(t))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), lists(h, pa.int64()), lists(members, pa.int64()), lists(d.min(axis=0), pa.int32()), lists(d.max(axis=0), pa.int32())], ["block", "h", "members", "low", "high"])

        for batch in batches:
            cells, at = batch.column("cell").to_numpy(), 0
            h, members = batch.column("h").to_numpy(), batch.column("members").to_numpy()
            while at < len(h):
                room = size - sum(len(x[0]) for x in held)
                if held and (cells[at] != cell or not room):
                    yield block()
                    number, held, room = number + 1, [], size
                cell = cells[at]
                to = min(at + room, at + int(np.searchsorted(cells[at:], cell, "right")))
                held.append((h[at:to], members[at:to]))
                at = to
        if held:
            yield block()

    return run


_PAIR = "hash_a bigint, hash_b bigint, members_a bigint, members_b bigint, examined bigint"


def _near(distance: int):
    """Pairs of two blocks (or of one) within the distance; a last row has the pairs examined."""

    def run(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                a, ma, b, mb = (np.asarray(batch.column(c)[j].values) for c in ("h", "members", "other_h", "other_members"))
                same, found = batch.column("same")[j].as_py(), []
                for i in range(0, len(a), 256):
                    d = _bits_between(a[i : i + 256].view(np.uint64), b.view(np.uint64))
                    x, y = np.nonzero(d <= distance)
                    x = x + i
                    keep = a[x] < b[y] if same else slice(None)
                    found.append((x[keep], y[keep]))
                x, y = (np.concatenate(c) for c in zip(*found, strict=True))
                turn = a[x] > b[y]
                columns = [np.where(turn, b[y], a[x]), np.where(turn, a[x], b[y]), np.where(turn, mb[y], ma[x]), np.where(turn, ma[x], mb[y])]
                n = len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)
                rows = [pa.array(np.append(c, 0), pa.int64(), mask=np.append(np.zeros(len(c), bool), True)) for c in columns]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.append(np.zeros(len(x), np.int64), n))], [c.split()[0] for c in _PAIR.split(", ")])

    return run


def wide_pairs(distinct: DataFrame, distance: int, pivots: int = PIVOTS, block: int = BLOCK, report: list | None = None) -> DataFrame:
    """hash_a < hash_b, members_a, members_b of all pairs of distinct hashes (h, members) within
    `distance` bits, exact at any distance.

    Hashes are put into blocks around pivots; two blocks meet unless the triangle inequality over
    the pivots keeps all their hashes apart, and compare by machine words. Families that lie apart
    do not meet; where hashes are spread evenly and the distance is wide, most blocks do, and
    the work is that of all pairs at some nanoseconds each. Blocks grow with the table, so there
    are about MAX_BLOCKS of them and each is sent as often at most. `report` takes the number of
    pairs examined."""
    n = distinct.count()
    chosen = [r["h"] for r in distinct.orderBy(F.xxhash64("h"), "h").limit(pivots).collect()]
    spread = np.array(chosen, np.int64).view(np.uint64)
    size = max(block, -(-n // MAX_BLOCKS))
    placed = distinct.select("h", "members").mapInArrow(_to_pivots(spread), "h bigint, members bigint, cell int, near int")
    ordered = placed.repartitionByRange(max(1, -(-n // (4 * size))), "cell", "near", "h").sortWithinPartitions("cell", "near", "h")
    blocks = materialize(ordered.mapInArrow(_blocks(spread, size), "block bigint, h array<bigint>, members array<bigint>, low array<int>, high array<int>"))
    heads = blocks.select("block", "low", "high", F.row_number().over(Window.orderBy("block")).alias("i"))
    count = blocks.count()
    # every block asks for those from itself on: an equi-join on their numbers, ranges alone travel
    asked = heads.withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(max(count, 1)))))
    other = heads.select(F.col("i").alias("j"), F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    apart = lambda x, y: F.array_max(F.zip_with(x, y, lambda low, high: low - high))
    gap = F.greatest(apart("low", "other_high"), apart("other_low", "high"))
    met = materialize(asked.join(other, "j").where(gap <= distance).select("block", "other", (F.col("i") == F.col("j")).alias("same")))
    there = blocks.select(F.col("block").alias("other"), F.col("h").alias("other_h"), F.col("members").alias("other_members"))
    rows = met.join(blocks.select("block", "h", "members"), "block").join(there, "other").select("h", "members", "other_h", "other_members", "same")
    found = materialize(rows.repartition(max(1, -(-met.count() // PAIRS_A_TASK))).mapInArrow(_near(distance), _PAIR))
    if report is not None:
        report.append(found.agg(F.sum("examined")).first()[0] or 0)
    return found.where("hash_a IS NOT NULL").drop("examined")
