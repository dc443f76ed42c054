"""Connection sessions over payload chunks.

A connection is (pid, ssl_ptr); its chunks are known and ordered by (timestamp_ns, seq). One
connection may carry a large share of all chunks, so numbering, direction changes and byte
offsets are worked out on narrow columns with the sliced helpers of plans.ordered, payloads
join once, and bytes meet in numbered segments of bounded size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade import rules
from palisade.operators.classify import classify_payloads
from palisade.operators.enrich import sni_provider
from palisade.plans.ordered import SLICE, carry_last, running, sequence_number, time_slice
from palisade.plans.stage import materialize

CONN = ["pid", "ssl_ptr"]
ORDER = ["timestamp_ns", "seq"]
SLICE_NS = 600 * 10**9
SEGMENT = 1 << 20


def _slice(width=SLICE_NS):
    return time_slice(F.col("timestamp_ns"), width)


def connection_verdicts(chunks: DataFrame, undecided=rules.UNDECIDED_CHUNKS, late=True) -> DataFrame:
    """Per connection: verdict, deciding chunk number, chunks seen.

    A connection of at least `undecided` chunks without an interesting one is boring. With
    late=False, as in a live probe that stops looking, only the first `undecided` chunks can
    make it interesting."""
    hit = F.col("is_interesting") | sni_provider(F.col("sni")).isNotNull()
    hits = classify_payloads(chunks, with_fingerprint=False).groupBy(*CONN).agg(F.min(F.when(hit, F.struct(*ORDER))).alias("_hit"))
    counted = (
        chunks.select(*CONN, *ORDER)
        .join(hits, CONN)
        .groupBy(*CONN)
        .agg(F.count(F.lit(1)).alias("chunks_seen"), F.count_if(F.struct(*ORDER) <= F.col("_hit")).alias("_no"), F.first("_hit").alias("_hit"))
    )
    boring = F.col("chunks_seen") >= undecided
    found = F.col("_hit").isNotNull() & (F.lit(late) | (F.col("_no") <= undecided))
    return counted.select(
        *CONN,
        F.when(found, "interesting").when(boring, "boring").otherwise("undecided").alias("verdict"),
        F.when(found, F.col("_no")).when(boring, F.lit(undecided)).cast("int").alias("decided_at"),
        F.when(found, F.col("_hit")).alias("decided_by"),
        "chunks_seen",
    )


def first_chunks(chunks: DataFrame, slice_ns=SLICE_NS) -> DataFrame:
    """Flag the first chunk of every connection."""
    numbered = sequence_number(chunks, CONN, ORDER, _slice(slice_ns), "_n")
    return numbered.withColumn("is_first_chunk", F.col("_n") == 1).drop("_n")


def followed_chunks(chunks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Non-empty chunks of interesting connections from the deciding chunk on."""
    chosen = verdicts.filter(F.col("verdict") == "interesting").select(*CONN, "decided_by")
    filled = chunks.filter(F.octet_length("payload") > 0)
    return filled.join(chosen, CONN).filter(F.struct(*ORDER) >= F.col("decided_by")).drop("decided_by")


_GLUE = "listagg(_piece) WITHIN GROUP (ORDER BY timestamp_ns, seq)"


def _size():
    return F.octet_length("payload").cast("bigint")


def _segments(rows: DataFrame, start: str, segment: int, cap: int | None) -> DataFrame:
    """Rows with the number of each segment that their bytes touch and the piece that lies in
    it; start: bytes before this chunk."""
    end = F.col(start) + _size()
    if cap is not None:
        rows, end = rows.filter(F.col(start) < cap), F.least(end, F.lit(cap))
    rows = rows.withColumn("_to", end)
    at = F.sequence(F.floor(F.col(start) / segment), F.floor((F.col("_to") - 1) / segment))
    cut = rows.withColumn("segment", F.explode(at))
    low = F.greatest(F.col("segment") * segment, F.col(start))
    high = F.least((F.col("segment") + 1) * segment, F.col("_to"))
    return cut.withColumn("_piece", F.substring("payload", (low - F.col(start) + 1).cast("int"), (high - low).cast("int")))


def flow_buffers(chunks: DataFrame, verdicts: DataFrame, segment=SEGMENT, cap=None, slice_ns=SLICE_NS) -> DataFrame:
    """Bytes of each direction of every interesting connection, in segments numbered from 0
    (all bytes, or the first `cap`), with the number of chunks in each."""
    kept = followed_chunks(chunks, materialize(verdicts))
    key = [*CONN, "direction"]
    sized = running(kept.select(*key, *ORDER, _size().alias("_size")), key, ORDER, _slice(slice_ns), _end=("sum", F.col("_size")))
    starts = sized.select(*key, *ORDER, (F.col("_end") - F.col("_size")).alias("_start"))
    pieces = _segments(kept.join(starts, [*key, *ORDER]), "_start", segment, cap)
    return pieces.groupBy(*key, "segment").agg(F.expr(_GLUE).alias("payload"), F.count(F.lit(1)).alias("chunks"))


def turns(chunks: DataFrame, verdicts: DataFrame, segment=SEGMENT, cap=None, slice_ns=SLICE_NS, keep=("sni", "comm")) -> DataFrame:
    """Runs of one direction as segments numbered from 0: all their bytes, or the first `cap`.

    turn_no counts from 1 per connection; direction, seq, timestamp_ns, chunks, ended_ns and
    `keep` are those of the whole turn. `emitted` is false for the last run, which no chunk of
    the other direction has closed yet. `whole_turns` joins the segments."""
    kept = followed_chunks(chunks, materialize(verdicts))
    # everything but the bytes is worked out on narrow rows
    narrow = kept.select(*CONN, *ORDER, "direction", *keep, _size().alias("_size")).withColumn(SLICE, _slice(slice_ns))
    inside = Window.partitionBy(*CONN, SLICE).orderBy(*ORDER)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turned = narrow.withColumn("_turned", (F.col("direction") != F.lag("direction").over(inside)).cast("bigint"))
    local = materialize(turned.withColumn("_turn", F.coalesce(F.sum("_turned").over(upto), F.lit(0))).withColumn("_end", F.sum("_size").over(upto)).drop("_turned"))

    # one summary row per slice decides whether its first run continues the previous slice's last one
    slices = local.groupBy(*CONN, SLICE).agg(
        F.max("_turn").alias("_turns"), F.sum("_size").alias("_bytes"),
        F.min_by("direction", F.struct(*ORDER)).alias("_first"), F.max_by("direction", F.struct(*ORDER)).alias("_last"),
    )
    along = Window.partitionBy(*CONN).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opened = slices.withColumn("_open", F.coalesce((F.lag("_last").over(along) != F.col("_first")).cast("bigint"), F.lit(1)))
    offsets = opened.select(
        *CONN, SLICE,
        (F.coalesce(F.sum(F.col("_open") + F.col("_turns")).over(before), F.lit(0)) + F.col("_open")).alias("_turn0"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
    )
    placed = materialize(
        local.join(offsets, [*CONN, SLICE])
        .withColumn("turn_no", F.col("_turn0") + F.col("_turn"))
        .withColumn("_start", F.col("_byte0") + F.col("_end") - F.col("_size"))
        .drop("_turn", "_end", "_turn0", "_byte0", "_size", SLICE)
    )
    summary = placed.groupBy(*CONN, "turn_no").agg(
        F.min("_start").alias("_base"), F.count(F.lit(1)).alias("chunks"), F.max("timestamp_ns").alias("ended_ns"),
        F.min("direction").alias("direction"), F.min("timestamp_ns").alias("_t"), F.min("seq").alias("_seq"),
        *[F.max_by(c, F.struct(*ORDER)).alias(c) for c in keep],
    )
    last = summary.groupBy(*CONN).agg(F.max("turn_no").alias("_last"))
    summary = summary.join(last, CONN).withColumn("emitted", F.col("turn_no") < F.col("_last")).drop("_last")
    at = placed.select(*CONN, *ORDER, "turn_no", "_start").join(summary.select(*CONN, "turn_no", "_base"), [*CONN, "turn_no"])
    at = at.select(*CONN, *ORDER, "turn_no", (F.col("_start") - F.col("_base")).alias("_off"))
    pieces = _segments(kept.select(*CONN, *ORDER, "payload").join(at, [*CONN, *ORDER]), "_off", segment, cap)
    bodies = pieces.groupBy(*CONN, "turn_no", "segment").agg(F.expr(_GLUE).alias("payload"))
    facts = summary.select(*CONN, "turn_no", "direction", F.col("_seq").alias("seq"), F.col("_t").alias("timestamp_ns"), *keep, "chunks", "ended_ns", "emitted")
    return bodies.join(facts, [*CONN, "turn_no"])


def whole_turns(segments: DataFrame) -> DataFrame:
    """Turns with all their bytes in one row, as a body must be to be parsed."""
    key = [*CONN, "turn_no"]
    rest = [c for c in segments.columns if c not in (*key, "segment", "payload")]
    glued = F.expr("listagg(payload) WITHIN GROUP (ORDER BY segment)")
    return segments.groupBy(*key).agg(glued.alias("payload"), *[F.first(c).alias(c) for c in rest])


def flush_idle_turns(all_turns: DataFrame, now_ns: int, idle_ns: int) -> DataFrame:
    """Pending responses whose last chunk is older than the idle threshold (all their segments)."""
    idle = F.lit(now_ns) - F.col("ended_ns") > idle_ns
    return all_turns.filter(~F.col("emitted") & (F.col("direction") == 1) & idle)


def expire_connections(chunks: DataFrame, ttl_ns=rules.CONNECTION_TTL_NS) -> DataFrame:
    """Chunks that arrive while their connection is younger than the TTL."""
    born = chunks.groupBy(*CONN).agg(F.min("timestamp_ns").alias("_born"))
    return chunks.join(born, CONN).filter(F.col("timestamp_ns") - F.col("_born") < ttl_ns).drop("_born")


def expire_windows(network: DataFrame, idle_ns=rules.CONNECTION_TTL_NS, slice_ns=SLICE_NS) -> DataFrame:
    """Number the activity periods of each pid: an idle gap of the TTL starts a new one."""
    order = ["timestamp_ns", "event_id"]
    slices = _slice(slice_ns)
    before = carry_last(network, ["pid"], order, slices, F.col("timestamp_ns"), "_before", inclusive=False)
    started = before.withColumn(
        "_new", F.coalesce((F.col("timestamp_ns") - F.col("_before") >= idle_ns).cast("bigint"), F.lit(1).cast("bigint"))
    )
    return running(started, ["pid"], order, slices, period=("sum", F.col("_new"))).drop("_before", "_new")
