"""Token ids as binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, one after another, in two or four bytes each. The
ends of the documents and their ids are two non-decreasing sequences in Elias-Fano form: the low
bits of each number packed, the high bits in unary, a bit vector of at most three bits a number,
with the place of every SELECT-th set bit in 32 bits. `select` finds one number by reading the
bits between two such places; nothing holds 64 bits a document.

Writing: texts are dealt out by ranges of doc_id and sorted; tasks encode them through a table of
words, cut the ids into files of bounded size and hand these to Spark's writer, which adds a line
feed that readers skip. An index table beside the files (one row a file, made from the files as they stand)
has the number of ids before each file. Lost tasks are run again; nothing stays on one machine."""

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.bpe import WHITE, tokenizer_spec
from palisade.llm.common import written
from palisade.plans.stage import arrow_batches, scratch_path

SELECT = 256
FILE_IDS = 4 << 20
MAX_PARTITIONS = 50_000
MAX_WORDS = 300_000
BATCH_CHARS = 3 << 20
#: Bytes and rows that go to a Python task at once.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 10_000
#: Files that a range of documents makes.
FILES = 4
#: Text bytes for each id, in the number of ranges alone.
BYTES_AN_ID = 2
MAGIC = b"PIDS"
#: magic, bytes an id, bytes of the two sequences, part and number of the file, ids, documents, documents without id
HEAD = struct.Struct("<4sIQQIIQII")


def _low_width(n: int, top: int) -> int:
    return max(0, (top // n).bit_length() - 1) if n else 0


class EliasFano:
    """n non-decreasing numbers from 0 on, read from bytes without copies."""

    HEAD = struct.Struct("<QQIQ")

    def __init__(self, data):
        self.n, self.base, self.low, size = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        lows, samples = -(-self.n * self.low // 8), -(-self.n // SELECT)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        self.lows = np.frombuffer(data, np.uint8, lows, at + 4 * samples)
        self.high = np.frombuffer(data, np.uint8, size, at + 4 * samples + lows)
        self.nbytes = at + 4 * samples + lows + size

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        """values: non-decreasing signed 64-bit numbers; the first is taken off all."""
        n = len(values)
        base = int(values[0]) if n else 0
        rest = values.view(np.uint64) - np.uint64(base % 2**64)
        low = _low_width(n, int(rest[-1]) if n else 0)
        packed = []
        for i in range(0, n if low else 0, 1 << 16):  # 2^16 numbers end on a whole byte
            bits = (rest[i : i + (1 << 16), None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
            packed.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        at = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").tobytes()
        return cls.HEAD.pack(n, base % 2**64, low, len(high)) + at[::SELECT].astype("<u4").tobytes() + b"".join(packed) + high

    def _lows(self, i: int, j: int) -> np.ndarray:
        if not self.low:
            return np.zeros(j - i, np.uint64)
        first, last = i * self.low, j * self.low
        bits = np.unpackbits(self.lows[first // 8 : -(-last // 8)], bitorder="little")[first % 8 :][: last - first]
        return (bits.reshape(j - i, self.low).astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Number i, from the bits between two sampled places."""
        k = i // SELECT
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first // 8 : -(-last // 8)], bitorder="little")
        bits[: first % 8] = 0
        at = int(np.flatnonzero(bits)[i - k * SELECT]) + first // 8 * 8
        return self._signed(((at - i) << self.low) + int(self._lows(i, i + 1)[0]))

    def _signed(self, value: int) -> int:
        value = (value + self.base) % 2**64
        return value - 2**64 if value >= 2**63 else value

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        lows = [self._lows(i, min(self.n, i + (1 << 16))) for i in range(0, self.n, 1 << 16)]
        high = at.astype(np.uint64) << np.uint64(self.low)
        return ((high | np.concatenate(lows) if lows else high) + np.uint64(self.base)).view(np.int64)


class TokenFile:
    """One file: `ends` (ids up to and with each document), `doc_ids` (of the documents that have
    one; those without stand last), `ids`."""

    def __init__(self, data):
        magic, self.width, ends, docs, self.part, self.number, self.n_ids, self.n_docs, self.n_null = HEAD.unpack_from(data)
        if magic != MAGIC or self.width not in (2, 4):
            raise ValueError("not a file of token ids")
        view = memoryview(data)
        self.ends = EliasFano(view[HEAD.size : HEAD.size + ends])
        self.doc_ids = EliasFano(view[HEAD.size + ends : HEAD.size + ends + docs])
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, HEAD.size + ends + docs)

    @staticmethod
    def encode(part: int, number: int, width: int, doc_ids: list, lens: list, ids: list) -> bytes:
        have = np.array([d for d in doc_ids if d is not None], np.int64)
        ends = np.cumsum(np.array(lens, np.int64))
        a, b = EliasFano.encode(ends), EliasFano.encode(have)
        head = HEAD.pack(MAGIC, width, len(a), len(b), part, number, int(ends[-1]), len(doc_ids), len(doc_ids) - len(have))
        return b"".join((head, a, b, *ids))

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, its place found by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def find(self, doc_id: int) -> int | None:
        """Place of the first document of that id, by binary search over selects."""
        low, high = 0, self.n_docs - self.n_null
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.doc_ids.select(middle) < doc_id else (low, middle)
        return low if low < self.n_docs - self.n_null and self.doc_ids.select(low) == doc_id else None


#: A run of white space that is more than one space, from its first character on.
GAP = re.compile(f"([{WHITE.replace(' ', '')}][{WHITE}]*| [{WHITE}]+)")
#: Words of these characters alone are split here as the tokenizer's pattern splits them: letters,
#: digits and ASCII marks are what they are in every version of Unicode.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_MARKS = r"!-/:-@\[-`{-~"
PLAIN = re.compile(f" ?[{_LETTERS}{_MARKS}0-9]+")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\n|[^\n]")
#: Fixed value: the pre-tokenizer whose pattern SPLIT follows.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> list:
    """Characters that stand for the bytes: printable Latin-1 for itself, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


#: Tables of parts by tokenizer, kept while Spark's Python worker lives: its tasks share them.
_PARTS: dict = {}


class _Encoder:
    """Ids of texts through a table of parts of words: each is encoded once until the table is full,
    then the table starts anew. Words are what stands between white space, with the space
    before it; the tokenizer's own splitting never joins two of them.

    Texts are brought to words with one space between: a word without a space before it in the text
    gets a line feed in front, other white space and special tokens are two line feeds and a
    number. Arrow then splits them, finds the distinct words, and puts the ids together."""

    def __init__(self, spec: str, most: int):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        model = json.loads(spec)
        added = [t["content"] for t in model.get("added_tokens", [])]
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.kind, self.most = id_kind(model), most
        before = model.get("pre_tokenizer") or {}
        self.split = not model.get("normalizer") and all(before.get(k) == v for k, v in BYTE_LEVEL.items())
        alphabet = byte_alphabet()
        self.model, self.as_bytes = self.library.model, {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x180)}
        self.parts: dict = _PARTS.setdefault(hash(spec), {})  # part of a word -> bytes of its ids
        self.parts["\n"] = b""
        self.others: dict = {}  # white space, special tokens -> number, for one call
        self.gaps: dict = {}  # white space between words -> how it stands in a form, whether a space follows

    def _form(self, text: str) -> str:
        """The text's words with one space between."""
        if any(t in text for t in self.added):
            parts = self.special.split(text)
            out = []
            for i in range(0, len(parts), 2):
                out += [self._spaced(parts[i])] if parts[i] else []
                out += [self._other(parts[i + 1])] if i + 1 < len(parts) else []
            return " ".join(out)
        return self._spaced(text)

    def _other(self, word: str) -> str:
        return f"\n\n{self.others.setdefault(word, len(self.others))}"

    def _spaced(self, text: str) -> str:
        parts = GAP.split(text)
        last = parts.pop()
        out, space = [], False
        for segment, gap in zip(parts[::2], parts[1::2], strict=True):
            if segment:
                out.append(segment if space else segment[1:] if segment[0] == " " else f"\n{segment}")
            if gap not in self.gaps:
                # its last character is a word, or the space before the next one
                words = [gap[:-1]] if gap[-1] == " " else [gap[:-1], gap[-1]] if len(gap) > 1 else [gap]
                self.gaps[gap] = " ".join(map(self._other, words)), gap[-1] == " "
            form, space = self.gaps[gap]
            out.append(form)
        if last:
            out.append(last if space else last[1:] if last[0] == " " else f"\n{last}")
        elif out:  # white space up to the end is one word
            out[-1] = self._other(gap)
        return " ".join(out) if out else "\n"

    def _learn(self, parts: set) -> None:
        """Ids of parts of words; None for characters that are no part."""
        new = [p for p in parts if p not in self.parts]
        if len(self.parts) + len(new) > self.most:
            self.parts.clear()
            self.parts["\n"] = b""
            new = [p for p in parts if p != "\n"]
        known, tokenize, as_bytes, space, code = self.parts, self.model.tokenize, self.as_bytes, self.as_bytes[32], self.kind.char
        for part in new:
            if len(part) == 1 and not PLAIN.fullmatch(part):  # what SPLIT finds is plain, but for single characters
                known[part] = None
                continue
            raw = part.translate(as_bytes) if not part.isascii() else part if part[0] != " " else space + part[1:]
            known[part] = array(code, [t.id for t in tokenize(raw)]).tobytes()

    def _words(self, words: list) -> tuple:
        """(ids of the plain words, put together from their parts; ids of the others, encoded
        whole; place of each word in both together)."""
        texts = [f" {w}" if w[:1] != "\n" else w[1:] if w[1:2] != "\n" else "" for w in words]
        if self.split:
            found = SPLIT.findall("\n".join([*texts, ""]))
            self._learn(set(found))
            parts = pa.array(map(self.parts.__getitem__, found), pa.large_binary(), size=len(found))
        else:
            parts = pa.array([b"" if i % 2 else None for i in range(2 * len(texts))], pa.large_binary())
        at = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1)
        odd = np.asarray(parts.is_null())
        breaks = np.flatnonzero((np.diff(at) == 0) & ~odd)
        whole = {int(i) for i in np.unique(np.searchsorted(breaks, np.flatnonzero(odd)))} | {i for i, w in enumerate(words) if w[:2] == "\n\n"}
        ends = np.concatenate([[0], at[breaks]])
        plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), parts.buffers()[2] or pa.py_buffer(b"")])
        others, places, rest = list(self.others), np.arange(len(words)), []
        for n, i in enumerate(sorted(whole)):
            w = words[i]
            places[i] = len(words) + n
            text = others[int(w)] if w[:2] == "\n\n" else texts[i]
            rest.append(np.array(self.library.encode(text, add_special_tokens=False).ids if text else [], self.kind).tobytes())
        return plain, pa.array(rest, pa.large_binary()), places

    def encode(self, texts: list, end: bytes = b"") -> pa.Array:
        """Bytes of the ids of each text, with `end` behind."""
        self.others, self.gaps = {"": 0}, {}
        lists = pc.split_pattern(pa.array([f"{self._form(t)} \n\n0" for t in texts], pa.large_string()), " ")
        words = pc.dictionary_encode(lists.values)
        plain, rest, places = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        if texts:
            last = places[pc.index(words.dictionary, "\n\n0").as_py()] - len(plain)
            rest = pa.concat_arrays([rest.slice(0, last), pa.array([end], pa.large_binary()), rest.slice(last + 1)])
        ids = pa.concat_arrays([plain, rest]).take(pa.array(places[np.asarray(words.indices)]))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        at = ends[np.asarray(lists.offsets)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])


def id_kind(model: dict) -> np.dtype:
    """Two bytes an id if the vocabulary is that small, else four."""
    most = max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))], default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _chunks(batches):
    """(doc_ids, texts) of about BATCH_CHARS characters, whatever the size of the batches."""
    given, texts, chars = [], [], 0
    for batch in batches:
        for d, text in zip(batch.column(0), batch.column(1), strict=True):
            given.append(d.as_py())
            texts.append(text.as_py())
            chars += len(texts[-1]) + 64
            if chars >= BATCH_CHARS:
                yield given, texts
                given, texts, chars = [], [], 0
    if given:
        yield given, texts


def _write(spec: str, end_id: int, max_words: int, file_ids: int):
    """Files of a range: its documents come sorted."""

    def run(batches):
        from pyspark import TaskContext

        coder = _Encoder(spec, max_words)
        width, end = coder.kind.itemsize, np.array([end_id], coder.kind).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, lens, ids, size = [], [], [], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([TokenFile.encode(part, number, width, doc_ids, lens, ids)], pa.binary())], ["data"])

        for given, texts in _chunks(batches):
            coded = coder.encode(texts, end).to_pylist()
            pa.default_memory_pool().release_unused()
            for d, data in zip(given, coded, strict=True):
                n = len(data) // width
                if ids and size + n > file_ids:
                    yield file()
                    number, doc_ids, lens, ids, size = number + 1, [], [], [], 0
                doc_ids.append(d)
                lens.append(n)
                ids.append(data)
                size += n
        if ids:
            yield file()

    return run


def _heads(batches):
    for batch in batches:
        rows = [TokenFile(x.as_py()) for x in batch.column("content")]
        columns = [(pa.int32(), [f.part for f in rows]), (pa.int32(), [f.number for f in rows]), (pa.int64(), [f.n_ids for f in rows]), (pa.int64(), [f.n_docs for f in rows]), (pa.int64(), [f.doc_ids.select(0) if f.n_docs > f.n_null else None for f in rows])]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns], ["part", "number", "n_ids", "n_docs", "first_doc"])


def _documents(digest: bool):
    """Rows of the files' documents; with `digest` the crc32 in place of the ids."""

    def run(batches):
        last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
        for batch in batches:
            for data in batch.column("content"):
                f = TokenFile(data.as_py())
                ends, doc_ids = f.ends.all(), [*f.doc_ids.all().tolist(), *[None] * f.n_null]
                starts = np.concatenate([[0], ends[:-1]])
                at = 0
                while at < f.n_docs:  # some MB at a time
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
                    raw = [f.ids[s:e].astype("<u4").tobytes() for s, e in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)]
                    n = to - at
                    columns = [pa.array([f.part] * n, pa.int32()), pa.array([f.number] * n, pa.int32()), pa.array(doc_ids[at:to], pa.int64()), pa.array(starts[at:to]), pa.array(ends[at:to] - starts[at:to])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.crc32(r) for r in raw] if digest else raw, last[1])], ["part", "number", "doc_id", "_at", "n_tokens", last[0]])
                    at = to

    return run


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/ids").select("content")


def write_ids(docs: DataFrame, path: str, spec: str | None = None, end_id: int = 0, file_ids: int = FILE_IDS, max_words: int = MAX_WORDS) -> None:
    """Encode docs (doc_id, text) and write `path`/ids (files of about file_ids ids, or one longer
    document) and `path`/index, in ascending doc_id order.

    Every document ends with end_id. Null texts count as empty: the end id alone. Rows of one
    doc_id are documents of their own, ordered by their ids; those without doc_id come last.
    Other columns are ignored. An empty table gives no files and an empty index.

    The number of ranges follows from the bytes of all texts, at most MAX_PARTITIONS; a range
    with more ids than a file has becomes several files."""
    spark, spec = docs.sparkSession, spec or tokenizer_spec()
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = max(1, min(MAX_PARTITIONS, -(-size // (BYTES_AN_ID * file_ids * FILES))))
    # equal ids of documents are told apart by their texts, then by their place, so that ranges can split them
    keyed = base.withColumns({"_h": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    order = [F.asc_nulls_last("doc_id"), F.col("_h"), F.col("_tie")]
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(order[0], "_h", "text").select("doc_id", "text")
    files = ordered.mapInArrow(_write(spec, end_id, max_words, file_ids), "data binary")
    with arrow_batches(spark, BATCH_BYTES, BATCH_ROWS):
        files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/ids")
    heads = _files(spark, path).mapInArrow(_heads, "part int, number int, n_ids long, n_docs long, first_doc long")
    heads = written(heads, "token-heads")
    inside, before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    index = heads.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    index.select("part", "number", "n_ids", "n_docs", "first_doc", (F.col("_before") + F.col("_in")).alias("start")).write.parquet(f"{path}/index")


def read_index(spark, path: str) -> DataFrame:
    """One row a file: part, number (in order), n_ids, n_docs, first_doc, start (ids before it)."""
    return spark.read.schema("part int, number int, n_ids long, n_docs long, first_doc long, start long").parquet(f"{path}/index")


def read_ids(spark, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian
    unsigned 32-bit; with `digest` ids_crc32, their unsigned crc32, instead)."""
    schema = f"part int, number int, doc_id long, _at long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}"
    # the index has a row for each file: small beside the documents, Spark chooses how to join it
    rows = _files(spark, path).mapInArrow(_documents(digest), schema).join(read_index(spark, path).select("part", "number", "start"), ["part", "number"])
    start: Column = F.col("start") + F.col("_at")
    return rows.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def round_trip(docs: DataFrame, spec: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """docs written in the file format to the shared folder and read back: doc_id, start,
    n_tokens, ids_crc32."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, path, spec, file_ids=file_ids)
    return read_ids(docs.sparkSession, path, digest=True)
