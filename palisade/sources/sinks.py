"""Sinks: NDJSON files, webhook batches, syslog lines, and fan-out to several of them."""

import socket
import urllib.request
import warnings
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEBHOOK_BATCH = 10
SYSLOG_PORT = 514
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def json_line(events: DataFrame) -> Column:
    """The event as JSON; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in events.columns]), _JSON)


def write_ndjson(events: DataFrame, path: str) -> None:
    events.write.mode("append").options(**_JSON).json(path)


def post_ndjson(url: str, timeout=10):
    """Sender for write_webhook: one POST per batch of lines."""

    def send(lines):
        body = ("\n".join(lines) + "\n").encode()
        request = urllib.request.Request(url, body, {"Content-Type": "application/x-ndjson"})
        with urllib.request.urlopen(request, timeout=timeout):
            pass

    return send


def write_webhook(events: DataFrame, send, batch=WEBHOOK_BATCH) -> None:
    """Call send(lines) with at most `batch` lines at a time, from the executors."""

    def run(rows):
        for group in batched((r.line for r in rows), batch):
            send(list(group))

    events.select(json_line(events).alias("line")).foreachPartition(run)


def syslog_lines(events: DataFrame, app: str, keep=()) -> DataFrame:
    return events.select(*keep, F.concat(F.lit(f"<14>1 - {app} - - - - "), json_line(events)).alias("message"))


def send_udp(host: str, port=SYSLOG_PORT):
    def send(messages):
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for m in messages:
                s.sendto(m.encode(), (host, port))

    return send


def write_syslog(events: DataFrame, send, app: str) -> None:
    """Call send(messages) once per partition."""

    def run(rows):
        send(r.message for r in rows)

    syslog_lines(events, app).foreachPartition(run)


def parse_specs(specs) -> list[tuple[str, str]]:
    """'webhook:URL', 'file:PATH', 'syslog:HOST' -> (kind, target); others are warned about and left out."""
    found = []
    for spec in specs:
        kind, _, target = spec.partition(":")
        if kind in ("webhook", "file", "syslog") and target:
            found.append((kind, target))
        else:
            warnings.warn(f"unknown sink {spec!r} ignored", stacklevel=2)
    return found


def fan_out(events: DataFrame, specs, app="palisade", senders=None) -> None:
    """Write one batch of events to every sink; `senders` may override kinds, as in tests."""
    senders = senders or {}
    targets = parse_specs(specs)
    kept = events.persist()
    try:
        for kind, target in targets:
            if kind == "file":
                write_ndjson(kept, target)
            elif kind == "webhook":
                write_webhook(kept, senders.get(kind, post_ndjson)(target))
            else:
                write_syslog(kept, senders.get(kind, send_udp)(target), app)
    finally:
        kept.unpersist()


def fan_out_stream(events: DataFrame, specs, checkpoint: str, trigger=None, **options):
    """Streaming fan-out: every micro-batch goes to all sinks (at least once)."""
    writer = events.writeStream.foreachBatch(lambda batch, _: fan_out(batch, specs, **options))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
