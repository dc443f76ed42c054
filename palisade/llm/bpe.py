"""Byte-level BPE encoding and decoding through a table of distinct words.

Tasks split texts into words (a space and the run after it, or white space) and keep, for each
block of documents, a list of its words and the positions of each document's words in that
list. The lists are dealt out by word hash, packed, one row for each block and share: a task
that holds a share of the vocabulary encodes each distinct word once with the tokenizers
library. The ids return to their blocks in the order of the lists, and documents are put
together by position. Decoding gathers the pieces of ids from the vocabulary, a table of fixed
size.

A word never crosses the borders that the tokenizer's own splitting sets, so encoding words
one by one gives the ids of the whole text. Special tokens in a text are words of their own."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.plans.stage import scratch_table

BLOCK_CHARS = 16 << 20
MAX_WORDS = 300_000
#: White space as the tokenizer's pattern sees it (the Unicode property).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def split_words(text: str, special: "re.Pattern | None") -> list:
    """Words of a text; concatenated they give the text."""
    if special is None or not special.search(text):
        return WORDS.findall(text)
    out = []
    for part in special.split(text):  # the pattern has one group: special tokens are kept
        out += [part] if special.fullmatch(part) else WORDS.findall(part)
    return out


def _special(spec: str):
    import json

    tokens = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
    return re.compile("(" + "|".join(re.escape(t) for t in sorted(tokens, key=len, reverse=True)) + ")") if tokens else None


DOCS = -1
BLOCKS = "block long, share int, data binary"


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers with their four bytes apart, so that the upper ones compress to nothing."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel()


def _pack(docs: list, place: np.ndarray) -> bytes:
    """Document ids (with null flags), word counts and word positions, and the place of each
    position's word in the lists by share."""
    ids = np.array([0 if d is None else d for d, _ in docs], np.int64)
    null = np.array([d is None for d, _ in docs], np.bool_)
    lens = np.array([len(x) for _, x in docs], np.int64)
    at = np.concatenate([x for _, x in docs])
    head = np.array([len(docs), len(at), len(place)], np.int64)
    return _squeeze(b"".join((head.tobytes(), ids.tobytes(), null.tobytes(), lens.tobytes(), _planes(place), _planes(at))))


def _unpack(data: bytes):
    raw = _expand(data)
    n, m, w = np.frombuffer(raw, np.int64, 3).tolist()
    ids, null, lens = np.frombuffer(raw, np.int64, n, 24), np.frombuffer(raw, np.bool_, n, 24 + 8 * n), np.frombuffer(raw, np.int64, n, 24 + 9 * n)
    place = _joined(raw, w, 24 + 17 * n)
    return ids, null, lens, place[_joined(raw, m, 24 + 17 * n + 4 * w)]


def _pack_lists(parts: list) -> bytes:
    lens = np.array([len(p) for p in parts], np.int64)
    return _squeeze(len(parts).to_bytes(8, "little") + _planes(lens) + b"".join(parts))


def _unpack_lists(data: bytes):
    """(lengths, bytes of all parts)."""
    raw = _expand(data)
    n = int.from_bytes(raw[:8], "little")
    return _joined(raw, n, 8).astype(np.int64), raw[8 + 4 * n :]


def _blocks(spec: str, block_chars: int, shares: int):
    def run(batches):
        from collections import defaultdict

        import xxhash
        from pyspark import TaskContext

        special, part, number = _special(spec), TaskContext.get().partitionId(), 0
        seen, docs, size = defaultdict(), [], 0  # a word's place is the number of words before it
        seen.default_factory = seen.__len__

        def block():
            """Rows of a block: its documents, and its words by share."""
            words = [w.encode() for w in seen]
            share = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words)) % shares
            order = np.argsort(share, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            cuts = np.searchsorted(share[order], np.arange(shares + 1))
            rows = [(DOCS, _pack(docs, place))]
            rows += [(s, _pack_lists([words[i] for i in order[cuts[s] : cuts[s + 1]]])) for s in range(shares) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "share", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                words = split_words(text, special)
                docs.append((doc_id.as_py(), np.fromiter(map(seen.__getitem__, words), np.int32, len(words))))
                size += len(text) + 16
                if size > block_chars:
                    yield block()
                    number, docs, size = number + 1, [], 0
                    seen.clear()
        if docs:
            yield block()
        seen.default_factory = None  # else the table, which holds itself, would stay until a full collection

    return run


def _kind(spec: str) -> np.dtype:
    """Two bytes carry an id between tasks if the vocabulary is that small."""
    import json

    model = json.loads(spec)
    most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))], default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _encode_shares(spec: str, most: int = MAX_WORDS):
    def run(batches):
        """The distinct words of this task's share, each encoded once until `most` are held and the
        table starts anew, and the ids of every list."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        table: dict = {}
        kind = _kind(spec)
        for batch in batches:
            out = []
            for data in batch.column("data"):
                lens, raw = _unpack_lists(data.as_py())
                ends = np.cumsum(lens).tolist()
                words = [raw[e - n : e] for e, n in zip(ends, lens.tolist(), strict=True)]
                if len(table) > most:
                    table.clear()
                new = [w for w in words if w not in table]
                for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    table[w] = np.array(e.ids, kind).tobytes()
                out.append(_pack_lists([table[w] for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("share"), pa.array(out, pa.binary())], ["block", "share", "data"])

    return run


def pieces(spec: str) -> list:
    """Bytes of each id: the id-to-piece table of a byte-level vocabulary."""
    import json

    model = json.loads(spec)
    # the byte alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    table = {i: bytes(alphabet[c] for c in piece) for piece, i in model["model"]["vocab"].items() if all(c in alphabet for c in piece)}
    table |= {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(1 + max(table, default=-1))]


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + len]."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lens)
    return flat[np.arange(total) + np.repeat(starts - (ends - lens), lens)]


class _Pieces:
    def __init__(self, spec: str):
        table = pieces(spec)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.lens = np.array([len(p) for p in table], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def decode(self, ids: np.ndarray) -> str:
        return _gather(self.flat, self.starts[ids], self.lens[ids]).tobytes().decode("utf-8", "replace")


def _assemble(spec: str, decoded: bool):
    """doc_id, ids (and text) of the documents of each block; some MB at a time."""

    def run(batches):
        table, kind = _Pieces(spec) if decoded else None, _kind(spec)
        names = ["doc_id", "ids", "text"][: 3 if decoded else 2]

        def rows(out):
            columns = [pa.array([d for d, _ in out], pa.int64()), pa.array([i.tobytes() for _, i in out], pa.binary())]
            return pa.RecordBatch.from_arrays(columns + ([pa.array([table.decode(i) for _, i in out], pa.string())] if decoded else []), names)

        for batch in batches:
            for lists, packed in zip(batch.column("lists"), batch.column("docs"), strict=True):
                parts = [_unpack_lists(x.as_py()) for x in lists.values] if lists.is_valid and len(lists) else []
                lens = np.concatenate([n for n, _ in parts]) // kind.itemsize if parts else np.zeros(0, np.int64)
                flat, starts = np.frombuffer(b"".join(raw for _, raw in parts), kind).astype("<u4"), np.cumsum(lens) - lens
                doc_ids, null, counts, at = _unpack(packed.as_py())
                end, out, size = 0, [], 0
                for doc_id, missing, n in zip(doc_ids.tolist(), null.tolist(), counts.tolist(), strict=True):
                    words = at[end : end + n]
                    end += n
                    out.append((None if missing else doc_id, _gather(flat, starts[words], lens[words])))
                    size += out[-1][1].nbytes + 16
                    if size > 2 << 20:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)

    return run


def encode(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of each row, add_special_tokens=False;
    with `decoded` also the text that the ids decode to, in the same pass.

    spec: the tokenizer's JSON. Null texts count as empty and have no ids; repeated rows are
    encoded each. Blocks hold about block_chars characters or one longer document.

    Blocks are kept in a table bucketed by block in the shared folder, which goes with the other
    scratch tables: the ids come to them, they do not move again. Tasks hold MAX_WORDS encoded
    words and those of one list."""
    spark = docs.sparkSession
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    name, path = scratch_table(spark, "bpe-blocks")
    made = base.mapInArrow(_blocks(spec, block_chars, shares), BLOCKS)
    made.write.bucketBy(shares, "block").format("parquet").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    lists = blocks.where(F.col("share") != DOCS).repartition(shares, "share").mapInArrow(_encode_shares(spec), BLOCKS)
    back = lists.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("share", "data"))).alias("_l"))
    joined = blocks.where(F.col("share") == DOCS).select("block", F.col("data").alias("docs")).join(back, "block", "left")
    schema = "doc_id long, ids binary" + (", text string" if decoded else "")
    return joined.select(F.transform("_l", lambda x: x["data"]).alias("lists"), "docs").mapInArrow(_assemble(spec, decoded), schema)


def _decode(spec: str):
    def run(batches):
        table = _Pieces(spec)
        for batch in batches:
            out = [table.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])

    return run


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """doc_id, ids and text: the pieces of the ids, bytes that are no UTF-8 replaced."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(spec), "doc_id long, ids binary, text string")


def tokenizer_spec(name: str = "byte_bpe_50k.json") -> str:
    """JSON of a tokenizer file, read on the driver; 1.5 MB travel to the tasks in the closure."""
    import os

    if os.path.exists(name):
        path = name
    else:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()
