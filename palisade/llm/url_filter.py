"""URL filters over a sorted digest array.

Rules are (host, path) prefixes. Each is keyed by the 64-bit xxhash of "host path"; the keys
stand sorted in one array, with the rule strings beside them. A task memory-maps the array
from a scratch file, probes it with a vectorised binary search for every host suffix and rule
path length of its urls, and confirms hits against the stored strings, so a collision of
digests never decides a url.

Lists are cut into shards by the leading bits of the digest. A list of one shard (at most
SHARD_RULES rules) goes to the tasks with the closure, its size checked; larger lists stay in
a table, the distinct probes of all urls are dealt to the shards and the hits joined back."""

import mmap
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_RULES = 100_000
MAX_RULE_CHARS = 2_000


def _key(host: str, path: str) -> bytes:
    return f"{host} {path}".encode()


class DigestArray:
    """Sorted 64-bit keys, memory-mapped, and the strings and verdicts behind them."""

    def __init__(self, rules: list):
        """rules: (host, path, verdict); of equal rules the smallest verdict counts ("allow" first)."""
        best: dict = {}
        for host, path, verdict in rules:
            k = _key(host, path)
            best[k] = min(verdict, best.get(k, verdict))
        entries = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in best.items())
        keys = np.array([e[0] for e in entries], np.uint64)
        self.strings, self.verdicts = [e[1] for e in entries], [e[2] for e in entries]
        self._file = tempfile.TemporaryFile()
        self._file.write(keys.tobytes())
        self._file.flush()
        self.keys = np.frombuffer(mmap.mmap(self._file.fileno(), 0, access=mmap.ACCESS_READ), np.uint64) if len(keys) else keys

    def find(self, probes: list) -> list:
        """For each probe string its position in the array, or -1; strings decide, not digests."""
        if not len(self.keys) or not probes:
            return [-1] * len(probes)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        out = [-1] * len(probes)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.strings[j] == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: str) -> list:
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _judge(rules: list, lengths: list, default: str):
    def run(batches):
        index = DigestArray(rules)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for suffix in _suffixes(host):
                    for n in lengths:
                        if n <= len(path):
                            probes.append(_key(suffix, path[:n]))
                            owner.append(i)
            best: list = [None] * len(hosts)
            for i, probe, j in zip(owner, probes, index.find(probes), strict=True):
                if j >= 0 and (best[i] is None or len(probe) > len(best[i][0])):  # of equal length the first, whose host is longer
                    best[i] = (probe, index.verdicts[j])
            rule = [b and b[0].decode().replace(" ", "", 1) for b in best]
            verdict = [b[1] if b else default for b in best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return run


def _probe_shard(batches):
    """Rows of one partition, sorted by shard: its rules first (kind 0), then its probes."""
    rules: list = []
    index, shard = None, None
    for batch in batches:
        hits = []
        kinds, shards = batch.column("kind").to_pylist(), batch.column("shard").to_pylist()
        hosts, paths, verdicts = (batch.column(c).to_pylist() for c in ("host", "path", "verdict"))
        pending: list = []

        def answer():
            for (h, p), j in zip(pending, index.find([_key(h, p) for h, p in pending]), strict=True):  # noqa: B023
                if j >= 0:
                    hits.append((h, p, index.verdicts[j]))  # noqa: B023
            pending.clear()  # noqa: B023

        for kind, s, h, p, v in zip(kinds, shards, hosts, paths, verdicts, strict=True):
            if s != shard:
                if index is not None:
                    answer()
                rules, index, shard = [], None, s
            if kind == 0:
                rules.append((h, p, v))
            else:
                if index is None:
                    index, rules = DigestArray(rules), []
                pending.append((h, p))
        if index is not None:
            answer()
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*hits)], ["host", "path", "verdict"])


def judge_urls(urls: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", shard_rules: int = SHARD_RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules: host, path, verdict ("allow" or "block"). A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest (host and path together) wins, of
    equal length the longer host; with none the verdict is `default`. Null urls and urls
    without :// have empty host and path, and rules fit them like any other. Rules with a null
    host or path never fit. Repeated rules count once, an "allow" before a "block"."""
    base = urls.select(F.col(page_id).alias("page_id"), host_of(F.col(url).cast("string")).alias("host"), path_of(F.col(url).cast("string")).alias("path"))
    listed = rules.select("host", "path", "verdict").dropna().distinct()
    n, lengths, chars, longest = listed.agg(F.count(F.lit(1)), F.collect_set(F.length("path")), F.max(F.length("host") + F.length("path")), F.max(F.length("host"))).first()
    lengths = sorted(lengths, reverse=True)
    if n <= shard_rules and (chars or 0) <= MAX_RULE_CHARS:
        held = [tuple(r) for r in listed.collect()]
        return base.mapInArrow(_judge(held, lengths, default), "page_id long, host string, path string, rule string, verdict string")
    # distinct probes meet the shards of the list; hits join back to the urls
    shard = F.pmod(F.xxhash64("host", "path"), F.lit(1 + n // shard_rules)).cast("int")
    # the last labels of the host, up to as many as the longest host of a rule can have
    most = F.least(F.size(F.split("host", r"\.")), F.lit((longest or 0) + 1))
    parts = F.transform(F.sequence(F.lit(1), most), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    cuts = F.array(*[F.lit(x) for x in lengths])
    distinct = base.select("host", "path").distinct().select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.explode(parts).alias("host"), "path")
    distinct = distinct.select("_h", "_p", "host", F.explode(F.filter(cuts, lambda x: x <= F.length("path"))).alias("_n"), "path").select("_h", "_p", "host", F.expr("left(path, _n)").alias("path"))
    both = (
        listed.select(F.lit(0).alias("kind"), shard.alias("shard"), "host", "path", "verdict")
        .unionByName(distinct.select("host", "path").distinct().select(F.lit(1).alias("kind"), shard.alias("shard"), "host", "path", F.lit(None).cast("string").alias("verdict")))
    )
    hits = both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_probe_shard, "host string, path string, verdict string")
    size = F.length("host") + F.length("path")
    best = (
        distinct.join(hits, ["host", "path"])
        .groupBy("_h", "_p").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.struct(size, F.length("host"))).alias("b"))
    )
    joined = base.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return joined.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
