"""HTTP/2 bodies: the DATA frames of a flow or a turn, joined.

Frames straddle chunks and segments, and where one ends is known only from the one before. A turn
is read front to back; a flow of any length is cut into segments that are read at once
(`reassemble_h2`). Only frame headers are looked at one by one; payloads are cut out whole."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import rules
from palisade.plans.stage import materialize

_PREFACE = rules.H2_PREFACE.encode()
# Frame layout
_HEADER, _DATA, _PADDED, _MAX_FRAME = 9, 0, 0x08, 16 * 1024 * 1024


class Frames:
    """Reader of one flow: feed it bytes in order, it returns the DATA bytes they complete."""

    def __init__(self):
        self.rest, self.started, self.broken = b"", False, False

    def feed(self, data: bytes) -> bytes:
        if self.broken:
            return b""
        held = self.rest + data
        if not self.started:
            if len(held) < len(_PREFACE) and _PREFACE.startswith(held):
                self.rest = held
                return b""
            held = held.removeprefix(_PREFACE)
            self.started = True
        at, parts = 0, []
        while len(held) - at >= _HEADER:
            size = int.from_bytes(held[at : at + 3], "big")
            if size > _MAX_FRAME:
                self.broken = True
                break
            end = at + _HEADER + size
            if end > len(held):
                break
            if held[at + 3] == _DATA and size:
                parts.append(self._content(held[at + _HEADER : end], held[at + 4]))
            at = end
        self.rest = b"" if self.broken else held[at:]
        return b"".join(parts)

    @staticmethod
    def _content(frame: bytes, flags: int) -> bytes:
        """A DATA frame without its padding; padding that would take all of it is ignored."""
        if not flags & _PADDED:
            return frame
        padding, body = frame[0], frame[1:]
        return body[: len(body) - padding] if padding < len(body) else body


def data_frames(flow: bytes | None) -> bytes | None:
    """Joined payloads of the complete DATA frames; None when there are none."""
    return (Frames().feed(flow) or None) if flow else None


def body_of(payload: Column) -> Column:
    """data_frames of a whole turn, as an Arrow function; null rows cost nothing."""

    @F.pandas_udf("binary")
    def decode(flows: pd.Series) -> pd.Series:
        return flows.map(data_frames, na_action="ignore")

    return decode(payload)


_KEY = ["pid", "ssl_ptr", "direction"]
#: Bytes that a segment is given of the next one: the rest of a header and the padding's length.
_AHEAD = 9
#: Frames that a segment is searched for; others are looked up once they are reached.
_USUAL_KIND, _USUAL_SIZE = 9, 1 << 16
MAX_LOOK_UPS = 4


def _size_at(data, at: int) -> int:
    return data[at] << 16 | data[at + 1] << 8 | data[at + 2]


def _leaves(data, at: int, own: int, known: dict) -> int | None:
    """Where the first header behind the segment stands if there is one at `at`; None where the
    flow ends. known: the same for places seen before."""
    passed = []
    while at < own and at not in known:
        passed.append(at)
        if at + _HEADER > len(data):
            known[at] = None
            break
        at += _HEADER + _size_at(data, at)
    end = known[at] if at in known else at
    for p in passed:
        known[p] = end
    return end


def _usual_headers(data: bytes) -> np.ndarray:
    """Places in a segment where a usual header may stand."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - _HEADER + 1
    if n < 1:
        return np.zeros(0, np.int64)
    small = a[:n] <= _USUAL_SIZE >> 16
    return np.flatnonzero(small & (a[3 : n + 3] <= _USUAL_KIND) & (a[5 : n + 5] < 128))


def _jumps(size: int, asked: bool):
    """pid, ssl_ptr, direction, at, next: where the frames from a header on leave its segment. For
    the places asked for, or for all usual headers that no other one leads to."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own, known = len(r["payload"]), {}
                data = r["payload"] + (r["ahead"] or b"")
                if asked:
                    places = [r["at"] - r["segment"] * size]
                else:
                    usual = [int(p) for p in _usual_headers(data) if p < own]
                    led = {p + _HEADER + _size_at(data, p) for p in usual}
                    places = [p for p in reversed(usual) if p not in led]
                for p in places:
                    end = _leaves(data, p, own, known)
                    start = r["segment"] * size
                    out.append((r["pid"], r["ssl_ptr"], r["direction"], start + p, None if end is None else start + end))
            yield _arrow(out, [("pid", pa.int64()), ("ssl_ptr", pa.int64()), ("direction", pa.int32()), ("at", pa.int64()), ("next", pa.int64())])

    return run


def _arrow(rows: list, fields: list):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _bodies(size: int):
    """The DATA bytes of a segment whose first header is known, and the range of those that its
    last frame has in later segments."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                start, own, total = r["segment"] * size, len(r["payload"]), r["total"]
                data, at, parts, rest = r["payload"] + (r["ahead"] or b""), r["at"] - r["segment"] * size, [], None
                while at < own and at + _HEADER <= len(data):
                    n, kind, flags = _size_at(data, at), data[at + 3], data[at + 4]
                    low, high = at + _HEADER, at + _HEADER + n
                    if start + high > total:
                        break
                    if kind == _DATA and n:
                        if flags & _PADDED:
                            padding = data[low]
                            low, high = low + 1, high - padding if padding < n - 1 else high
                        if low < own:
                            parts.append(data[low : min(high, own)])
                        if high > own:
                            rest = (start + max(low, own), start + high)
                    at += _HEADER + n
                out.append((r["pid"], r["ssl_ptr"], r["direction"], r["segment"], b"".join(parts), *(rest or (None, None))))
            yield _arrow(out, [("pid", pa.int64()), ("ssl_ptr", pa.int64()), ("direction", pa.int32()), ("segment", pa.int64()), ("body", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    return run


def _reached(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """Places on the ways from the starts: in doubling steps, so their number follows the
    logarithm of a flow's segments."""
    reached, jump = starts.select(*_KEY, "at"), jumps.where("next IS NOT NULL").select(*_KEY, "at", "next")
    while True:
        jump = materialize(jump)
        if jump.isEmpty():
            return materialize(reached)
        further = reached.join(jump, [*_KEY, "at"]).select(*_KEY, F.col("next").alias("at"))
        reached = materialize(reached.unionByName(further).distinct())
        second = jump.select(*_KEY, F.col("at").alias("next"), F.col("next").alias("_end"))
        jump = jump.join(second, [*_KEY, "next"]).select(*_KEY, "at", F.col("_end").alias("next"))


def reassemble_h2(flows: DataFrame, segment: int | None = None) -> DataFrame:
    """flows(pid, ssl_ptr, direction, segment, payload, ...) -> pid, ssl_ptr, direction, segment,
    body: the bytes of complete DATA frames that lie in each segment, rows without any dropped.

    Segments of a flow are numbered from 0 and have `segment` bytes (default: those of the longest),
    the last one maybe fewer. Where a frame starts is known only from the one before, but not
    the bytes between: every segment tells for the headers it may hold where their frames lead
    to, these jumps are put together by joins from the flow's start on, and then all segments
    are decoded at once. A header of unusual kind or size is looked up when it is reached; flows
    with more than MAX_LOOK_UPS of such segments one after the other, and all flows if segments
    have fewer than 24 bytes, are read in order in one task each."""
    typed = flows.select(F.col("pid").cast("bigint").alias("pid"), F.col("ssl_ptr").cast("bigint").alias("ssl_ptr"), F.col("direction").cast("int").alias("direction"), F.col("segment").cast("bigint").alias("segment"), F.col("payload").cast("binary").alias("payload"))
    size = segment or typed.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    if size < len(_PREFACE):
        return _in_order(typed)
    ahead = typed.select(*_KEY, (F.col("segment") - 1).alias("segment"), F.substring("payload", 1, _AHEAD).alias("ahead"))
    held = materialize(typed.join(ahead, [*_KEY, "segment"], "left"))
    totals = materialize(held.groupBy(*_KEY).agg(F.max(F.col("segment") * size + F.octet_length("payload")).alias("total")))
    head = F.substring("payload", 1, len(_PREFACE))
    whole = F.lit(_PREFACE)
    cut = (F.octet_length(head) < len(_PREFACE)) & (F.substring(whole, F.lit(1), F.octet_length(head)) == head)
    starts = held.where("segment = 0").where(~cut).select(*_KEY, F.when(head == whole, F.lit(len(_PREFACE))).otherwise(F.lit(0)).cast("bigint").alias("at"))
    jumps = materialize(held.select(*_KEY, "segment", "payload", "ahead").mapInArrow(_jumps(size, False), "pid long, ssl_ptr long, direction int, at long, next long"))
    at_segment = F.floor(F.col("at") / size).cast("bigint")
    slow = None
    for look_up in range(MAX_LOOK_UPS + 1):
        reached = _reached(starts, jumps)
        places = reached.join(totals, _KEY).where(F.col("at") + _HEADER <= F.col("total")).withColumn("segment", at_segment)
        missing = materialize(places.join(jumps, [*_KEY, "at"], "left_anti").select(*_KEY, "at", "segment"))
        if missing.isEmpty():
            break
        if look_up == MAX_LOOK_UPS:
            slow = missing.select(*_KEY).distinct()
            break
        found = held.join(missing, [*_KEY, "segment"]).select(*_KEY, "segment", "payload", "ahead", "at").mapInArrow(_jumps(size, True), "pid long, ssl_ptr long, direction int, at long, next long")
        jumps = materialize(jumps.unionByName(found))
    if slow is not None:
        places = places.join(slow, _KEY, "left_anti")
    opened = held.join(places, [*_KEY, "segment"]).select(*_KEY, "segment", "payload", "ahead", "at", "total")
    parts = materialize(opened.mapInArrow(_bodies(size), "pid long, ssl_ptr long, direction int, segment long, body binary, low long, high long"))
    rest = parts.where("low < high").select(*_KEY, "low", "high", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size))).alias("segment"))
    start = F.col("segment") * size
    first, last = F.greatest(F.col("low"), start), F.least(F.col("high"), start + size)
    rest = held.select(*_KEY, "segment", "payload").join(rest, [*_KEY, "segment"]).select(*_KEY, "segment", F.substring("payload", (first - start + 1).cast("int"), (last - first).cast("int")).alias("body"), F.lit(0).alias("turn"))
    both = rest.unionByName(parts.select(*_KEY, "segment", "body", F.lit(1).alias("turn"))).where(F.octet_length("body") > 0)
    out = both.groupBy(*_KEY, "segment").agg(F.expr("listagg(body) WITHIN GROUP (ORDER BY turn)").alias("body"))
    return out if slow is None else out.unionByName(_in_order(typed.join(slow, _KEY, "left_semi")))


def _in_order(typed: DataFrame) -> DataFrame:
    """The same with the segments of a flow read in order in one task, with one unfinished frame in
    memory; its bytes stand in the segment that completes it."""

    def decode(batches):
        flow, reader = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*_KEY, "segment")]
            for *now, segment, payload in zip(*columns, batch.column("payload"), strict=True):
                if now != flow:
                    flow, reader = now, Frames()
                body = reader.feed(payload.as_py())
                if body:
                    out.append((*now, segment, body))
            yield _arrow(out, [("pid", pa.int64()), ("ssl_ptr", pa.int64()), ("direction", pa.int32()), ("segment", pa.int64()), ("body", pa.binary())])

    ordered = typed.repartition(*_KEY).sortWithinPartitions(*_KEY, "segment")
    return ordered.mapInArrow(decode, "pid bigint, ssl_ptr bigint, direction int, segment bigint, body binary")
