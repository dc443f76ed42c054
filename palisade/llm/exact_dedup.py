"""Exact deduplication with Patricia-trie owners.

Rows are dealt by byte length and content hash. Each task inserts the full byte strings of its
rows into a compressed radix trie whose terminal nodes hold the owner's id and the number of
rows, so two texts share an owner only if every byte agrees; the hash merely deals rows out.

Hot groups: a first trie per input partition leaves one row for each distinct text before the
shuffle, so a text that fills a third of the table arrives once per input partition. Memory:
a trie over its byte budget spills its largest subtree to a scratch file of the task, which is
replayed into a trie of its own afterwards (`Trie.drain`)."""

import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import written

TRIE_BYTES = 48 << 20


class Node:
    __slots__ = ("label", "children", "owner", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.rows = label, None, None, 0


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Radix trie over byte strings; terminals hold (owner, rows).

    better(a, b) names the owner of two ids. Inserts beyond `budget` bytes of labels make the
    largest subtree below the first branching spill to a file."""

    def __init__(self, better, budget: int = TRIE_BYTES):
        self.better, self.budget = better, budget
        self.root, self.bytes, self.spilled = Node(b""), 0, {}

    def insert(self, key: bytes, owner, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + 200
                node, at = child, len(key)
                break
            if child in self.spilled:
                self._append(self.spilled[child], key, owner, rows)
                return
            rest = key[at : at + len(child.label)]
            n = len(rest) if rest == child.label else _shared(rest, child.label)
            if n < len(child.label):
                fork = Node(child.label[:n])
                child.label = child.label[n:]
                fork.children = {child.label[0]: child}
                node.children[key[at]] = fork
                self.bytes += 200
                child = fork
            node, at = child, at + n
        node.owner = owner if not node.rows else self.better(node.owner, owner)
        node.rows += rows
        if self.bytes > self.budget:
            self._spill()

    @staticmethod
    def _append(file, key, owner, rows):
        pickle.dump((key, owner, rows), file, protocol=5)

    def _below(self, node: Node, prefix: bytes):
        """(key, owner, rows) of each terminal in the subtree, without recursion."""
        stack = [(node, prefix + node.label)]
        while stack:
            x, key = stack.pop()
            if x in self.spilled:
                continue
            if x.rows:
                yield key, x.owner, x.rows
            for child in (x.children or {}).values():
                stack.append((child, key + child.label))

    def _spill(self) -> None:
        """Move the largest subtree below the first branching to a file."""
        node, prefix = self.root, b""
        while node.children and len(node.children) == 1 and (only := next(iter(node.children.values()))).children:
            node, prefix = only, prefix + only.label
        weigh = {c: sum(len(k) - len(prefix) for k, _, _ in self._below(c, prefix)) for c in node.children.values() if c not in self.spilled}
        if len(weigh) < 2 and not self.spilled:  # one text alone is over the budget
            self.budget *= 2
            return
        if not weigh:
            return
        child = max(weigh, key=weigh.get)
        file = tempfile.TemporaryFile()
        for key, owner, rows in self._below(child, prefix):
            self._append(file, key, owner, rows)
        child.children, child.owner, child.rows = None, None, 0
        self.spilled[child] = file
        self.bytes -= weigh[child]

    def drain(self):
        """(text, owner, rows) of each distinct text; spilled subtrees last, one trie at a time."""
        yield from self._below(self.root, b"")
        for file in self.spilled.values():
            file.seek(0)
            sub, end = Trie(self.better, self.budget), os.fstat(file.fileno()).st_size
            while file.tell() < end:
                sub.insert(*pickle.load(file))
            file.close()
            yield from sub.drain()


def _smallest(a, b):
    return b if a is None else a if b is None else min(a, b)


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


COMBINED = "n_bytes long, hash binary, content binary, owner long, rows long"


def _tries(keep: str, budget: int, combine: bool):
    """One trie over the rows of a task: length and hash lead the byte string. With combine, a
    full trie is emptied into the output instead of spilled (the next step meets its rows again)."""
    better = _largest if keep == "largest" else _smallest

    def entries(trie):
        for key, owner, rows in trie.drain():
            cut = 9 + key[8]
            yield int.from_bytes(key[:8], "big"), key[9:cut], key[cut:], owner, rows

    def run(batches):
        trie = Trie(better, 2 * budget if combine else budget)
        for batch in batches:
            for size, digest, text, owner, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                trie.insert(size.to_bytes(8, "big") + len(digest).to_bytes(1, "big") + digest + text, owner, rows)
                if combine and trie.bytes > budget:
                    yield from _rows(entries(trie))
                    trie = Trie(better, 2 * budget)
        yield from _rows(entries(trie))

    return run


def _rows(entries, most: int = 4 << 20):
    """Record batches of a few MB."""
    names = ["n_bytes", "hash", "content", "owner", "rows"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    chunk, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], names)

    for row in entries:
        chunk.append(row)
        size += len(row[2]) + 100
        if size > most:
            yield batch()
            chunk, size = [], 0
    if chunk:
        yield batch()


def content_hash(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", normalise=None, hash_of=content_hash, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones. Texts are equal when their bytes are, after `normalise`
    (a Column function; None: no change). keep: "smallest" or "largest" doc_id of a group owns
    it. Null ids own a group only if it has no other; repeated rows of an owner's id are all
    kept (and a group of null ids keeps them all). An empty table gives an empty table."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    content = F.encode(normalise(value) if normalise else value, "UTF-8")
    default = hash_of is content_hash
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), content.alias("content"))
    base = base.select("*", F.octet_length("content").cast("bigint").alias("n_bytes"), hash_of(F.col("content")).alias("hash"), *([] if default else [F.sha2("content", 256).alias("sha")]))
    # one row for each distinct text of an input partition, then one trie for each partition of (length, hash)
    combined = base.select("n_bytes", "hash", "content", F.col("doc_id").alias("owner"), F.lit(1).cast("bigint").alias("rows")).mapInArrow(_tries(keep, budget, True), COMBINED)
    tries = combined.repartition("n_bytes", "hash").mapInArrow(_tries(keep, budget, False), COMBINED)
    tagged = tries.select("n_bytes", "hash", F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), "content")
    same = tagged.groupBy("n_bytes", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    plain = written(same, "owners")
    joined = base.drop("content").join(plain.where("n = 1").drop("n"), ["n_bytes", "hash"])
    if not plain.where("n > 1").isEmpty():  # different texts of one length and hash are joined by their bytes
        clashing = tagged.join(plain.where("n > 1").select("n_bytes", "hash"), ["n_bytes", "hash"], "left_semi")
        joined = joined.unionByName(base.join(clashing, ["n_bytes", "hash", "content"]).drop("content"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    sha = F.lower(F.hex("hash")) if default else F.col("sha")
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The rows of docs that own their text, all columns; repeated rows of an owner stay as they are."""
    owners = exact_dedup(docs, text, doc_id, keep)
    gone = owners.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 256)
    return docs.join(gone, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_gone")) & (sha == F.col("_sha")), "left_anti")
