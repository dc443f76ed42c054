"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch retains every shingle hash below a fixed fraction of the hash range, and the smallest
LEAST hashes in any case. It thus covers a range of hashes completely: all of them if it holds
fewer than LEAST, else at least that fraction. Two sketches are compared on the range that both
cover, so short texts are compared exactly and unequal ones without bias; sketches merge into
the sketch of all their shingles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import texts

SHINGLE = 5
FRACTION = 8
LEAST = 64
QUANTILES = 128
SLICE_ROWS = 2000
MAX_SLICES = 200_000


def _below(fraction: int) -> int:
    return -(2**63) + 2**64 // fraction


def sketch(text: Column, k: int = SHINGLE, fraction: int = FRACTION, least: int = LEAST) -> Column:
    """Sorted array of the distinct shingle hashes in the lowest 1/fraction of the range, or of the
    `least` smallest ones where fewer lie there.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer than k words make one shingle, no
    words (or null) an empty array."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # hashes of words first, so that a shingle hashes k longs, not k strings
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    at = lambda h, i, j: F.get(h, i + j)

    def shingles(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[at(h, i, F.lit(j)) for j in range(k)]))

    def kept(all_: Column) -> Column:
        low = F.array_distinct(F.filter(all_, lambda x: x < F.lit(_below(fraction))))
        smallest = F.slice(F.sort_array(F.array_distinct(all_)), 1, least)
        return F.get(F.transform(F.array(low), lambda h: F.when(F.size(h) >= least, F.sort_array(h)).otherwise(smallest)), F.lit(0))

    # one-element arrays bind intermediate results, so each is evaluated once
    empty = F.array().cast("array<bigint>")
    bound = F.transform(F.array(hashed), lambda h: F.when(F.size(h) == 0, empty).otherwise(F.get(F.transform(F.array(shingles(h)), kept), F.lit(0))))
    return F.get(bound, F.lit(0))


def as_string(sk: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(sk, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merged(*sketches: Column, fraction: int = FRACTION, least: int = LEAST) -> Column:
    """Sketch of the shingles of all together. Where one does not cover the whole range it holds
    `least` hashes of its own, so the smallest `least` of all are known."""
    all_ = F.sort_array(F.array_distinct(F.concat(*sketches)))
    return F.get(F.transform(F.array(all_), lambda u: F.slice(u, F.lit(1), F.greatest(F.lit(least), F.size(F.filter(u, lambda x: x < F.lit(_below(fraction))))))), F.lit(0))


def _limit(sk: Column, fraction: int, least: int) -> Column:
    """The last hash of the range that the sketch covers completely."""
    return F.when(F.size(sk) < least, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(_below(fraction) - 1), F.get(sk, F.size(sk) - 1)))


def _within(a: Column, b: Column, fraction: int, least: int) -> Column:
    """Number of hashes of a in the range that b covers too."""
    top = _limit(b, fraction, least)
    return F.when(_limit(a, fraction, least) <= top, F.size(a)).otherwise(F.size(F.filter(a, lambda x: x <= top)))


def likeness(a: Column, b: Column, fraction: int = FRACTION, least: int = LEAST) -> Column:
    """Jaccard similarity, 0 to 1, of the hashes in the range that both cover: an estimate for the
    documents, exact if both have fewer than `least` shingles. Two empty sketches are alike."""
    # what both hold lies in the range of both
    common, both = F.size(F.array_intersect(a, b)), _within(a, b, fraction, least) + _within(b, a, fraction, least)
    return F.when(both == 0, F.lit(1.0)).otherwise((common / (both - common)).cast("double"))


def containment(a: Column, b: Column, fraction: int = FRACTION, least: int = LEAST) -> Column:
    """Share of a's shingles that b has, 0 to 1, from the range that both cover; an empty a is
    contained in anything. Null if no hash of a lies in that range, as then nothing is known (a has
    few shingles and b many)."""
    n = _within(a, b, fraction, least)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(n > 0, (F.size(F.array_intersect(a, b)) / n).cast("double"))


def with_next(docs: DataFrame, *columns: str, add: dict | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """docs (doc_id, columns and those of `add`) with next_<column>: that of the next row by
    descending doc_id, after the last row the first one's. Rows of equal id are ordered by
    their columns, null ids stand last.

    The order is cut into slices of about `rows` rows (quantiles, then equal widths of ids), so
    rows are shuffled once, by slice; the first row of each slice also goes to the slice before.
    One small row a slice is broadcast: there are at most MAX_SLICES. `add` is computed once a row,
    after the head rows are found."""
    spark = docs.sparkSession
    n = docs.count()
    parts = max(1, -(-n // (max(rows, n // MAX_SLICES) * QUANTILES)))
    bounds = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / QUANTILES for i in range(QUANTILES)], 0.5 / QUANTILES) if n > rows else []
    bounds = sorted({int(b) for b in bounds}) or [0]
    edges = [(i, b, max(1, -(-(hi - b) // parts))) for i, (b, hi) in enumerate(zip(bounds, bounds[1:] + [bounds[-1] + 1], strict=True))]
    at = F.greatest(F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    placed = docs.withColumn("_c", F.coalesce(at, F.lit(0))).join(F.broadcast(spark.createDataFrame(edges, "_c int, _lo bigint, _w bigint")), "_c")
    fine = F.greatest(F.least(F.floor((F.col("doc_id") - F.col("_lo")) / F.col("_w")), F.lit(parts - 1)), F.lit(0))
    slice_ = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_c") * parts + fine).cast("bigint")
    placed = placed.select("doc_id", *columns, slice_.alias("_slice"))
    # for each slice the one that ends before it (the next larger that has rows); the largest follows the smallest
    firsts = placed.groupBy("_slice").agg(F.max("doc_id").alias("_top"))
    by = Window.orderBy(F.desc("_slice"))
    ring = firsts.select("_top", F.col("_slice").alias("_from"), F.lag("_slice").over(by).alias("_to"), F.min("_slice").over(Window.partitionBy()).alias("_last"))
    ring = ring.select("_top", "_from", F.coalesce("_to", "_last").alias("_to"))
    heads = placed.join(F.broadcast(ring), (F.col("_slice") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_top")))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), *columns)
    heads = heads.groupBy("_to").agg(F.max_by(F.struct("doc_id", *columns), order).alias("_h"))
    both = placed.withColumn("_head", F.lit(False)).unionByName(heads.select("_h.*", F.col("_to").alias("_slice"), F.lit(True).alias("_head")))
    both = both.withColumns(add or {})
    w = Window.partitionBy("_slice").orderBy(F.col("_head"), *[F.desc_nulls_last(c) for c in ("doc_id", *columns)])
    ahead = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (*columns, *(add or {}))])
    return ahead.where(~F.col("_head")).drop("_slice", "_head")


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: int = FRACTION, rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document's. Null texts count as empty, repeated rows are documents of
    their own, a single row is its own next; an empty table gives an empty table."""
    base = texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    both = with_next(base, "text", add={"sk": sketch(F.col("text"), k, fraction)}, rows=rows)
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    both = both.select("doc_id", n.cast("bigint").alias("n_chars"), "sk", "next_sk", edited.alias("edited"))
    # a generator keeps its columns from being computed again in each of their uses
    both = both.select("doc_id", "n_chars", F.inline(F.array(F.struct("sk", "next_sk", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, fraction).alias("esk")))))
    return both.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("sk")).alias("fingerprint"), as_string(F.col("esk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("esk"), fraction).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk"), fraction).alias("near_next"))
