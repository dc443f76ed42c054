import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import token_files as tf
from palisade.llm.bpe import tokenizer_spec
from palisade.llm.queries import QUERIES

SPEC = tokenizer_spec()
LIBRARY = Tokenizer.from_str(SPEC)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, ids of null last."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*ids_of(text), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("top", [0, 1, 9, 1000, 2**40, 2**62])
def test_elias_fano(top):
    r = random.Random(top)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for base in (0, -5, -(2**63)):
            values = np.array(sorted(base + r.randint(0, top) for _ in range(n)), np.int64)
            data = tf.EliasFano.encode(values)
            ef = tf.EliasFano(data + b"\n")
            assert ef.all().tolist() == values.tolist() and ef.nbytes == len(data)
            for i in r.sample(range(n), min(n, 20)):
                assert ef.select(i) == values[i]


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 900, 100_000))
    assert len(tf.EliasFano.encode(ends)) < 100_000 * 12 / 8  # two bits over log2 of the mean length


def test_encoder_splits_as_the_library():
    alphabet = ["a", "Bc", " ", "  ", "\n", "\t", "'s", "'", "1", "<|endoftext|>", "<|", "_", "\r\n", "\0", "?!", "\U0001f600"]
    alphabet += ["\u0085", "\u00a0", "\u2003", "\u001c", "\u200b", "\u0301", "\u3000", "\ufeff", "\u00bd", "\u0120", "\u00e9", "\u4e2d"]
    r = random.Random(3)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    coder = tf._Encoder(SPEC, 2000)
    for i in range(0, len(texts), 500):
        for text, ids in zip(texts[i : i + 500], coder.encode(texts[i : i + 500]), strict=True):
            assert np.frombuffer(ids.as_py(), coder.kind).tolist() == ids_of(text), repr(text)


def test_words_split_as_the_pattern():
    """Plain words, whose parts the encoder finds itself, against the library."""
    r = random.Random(9)
    letters = "abéßZęſ019'\".,!-_#%`~|[]\\^"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(6000)]
    words += [a + b + c for a in ("", "it", "'") for b in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S") for c in ("", "x", "'", "1")]
    text = " ".join(words)
    assert np.frombuffer(tf._Encoder(SPEC, 500).encode([text])[0].as_py(), "<u2").tolist() == ids_of(text)
    coder = tf._Encoder(SPEC, 500)
    coder.split = False  # as for a tokenizer with another pattern
    assert np.frombuffer(coder.encode([text[:4000]])[0].as_py(), "<u2").tolist() == ids_of(text[:4000])


def test_table_that_is_full():
    text = " start " + " ".join(f"w{i % 97}é" for i in range(500)) + "\n\n  two " + "x" * 300 + " end "
    coder = tf._Encoder(SPEC, 10)
    for _ in range(3):
        got = coder.encode([text, "", text[:50]], b"\0\0").to_pylist()
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [[*ids_of(t), 0] for t in (text, "", text[:50])]


def test_odd_rows(odd_docs, tmp_path):
    spark = odd_docs.sparkSession
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None])
    for file_ids in (tf.FILE_IDS, 40):
        tf.write_ids(odd_docs, f"{tmp_path}/{file_ids}", SPEC, file_ids=file_ids)
        got = sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in tf.read_ids(spark, f"{tmp_path}/{file_ids}").collect()), key=lambda r: r[1])
        assert got[: len(want)] == want
        assert sorted(r[2] for r in got[len(want) :]) == [len(ids_of(t)) + 1 for t in ("one two", "lonely words here")] and {r[0] for r in got[len(want) :]} == {None}
        ends = [r[1] + r[2] for r in got]
        assert [r[1] for r in got] == [0, *ends[:-1]]
        again = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.round_trip(odd_docs, SPEC, file_ids).collect()), key=lambda r: r[1])
        assert again == got
    assert tf.read_index(spark, f"{tmp_path}/40").count() > 5


def test_random_access(odd_docs, tmp_path):
    spark = odd_docs.sparkSession
    tf.write_ids(odd_docs, str(tmp_path / "t"), SPEC)
    files = [tf.TokenFile(bytes(r["content"])) for r in tf._files(spark, str(tmp_path / "t")).collect()]
    assert len(files) == 1 and files[0].n_null == 2
    for r in odd_docs.where("doc_id is not null").collect():
        at = files[0].find(r["doc_id"])
        assert files[0].document(at).tolist() == [*ids_of(r["text"]), 0]
    assert files[0].find(12345) is None and files[0].find(-1) is None


def test_one_id_on_most_rows(llm, tmp_path):
    rows = [(7, f"t {i % 5}") for i in range(300)] + [(i, "x y") for i in range(20)]
    got = tf.round_trip(llm.createDataFrame(rows, "doc_id long, text string").repartition(4), SPEC, file_ids=100).collect()
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert len(got) == 320 and [a for a, _ in ends] == [0, *[b for _, b in ends][:-1]]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(d for d, _ in rows)


def test_empty_table(no_docs, tmp_path):
    assert tf.round_trip(no_docs, SPEC).collect() == []


def test_whole_table(llm, sf_dir):
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in QUERIES["op11_token_files"](llm, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == brute(docs)


def test_texts_go_to_tasks_in_small_batches(llm, tmp_path, monkeypatch):
    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"data": pa.array([f"{b.num_rows} {b.nbytes}".encode()], pa.binary())})

        return run

    monkeypatch.setattr(tf, "_write", sizes)
    docs = llm.range(200).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 6000)").alias("text")).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017 - these files hold no ids
        tf.write_ids(docs, str(tmp_path / "t"), SPEC)
    got = [tuple(map(int, r["value"].split())) for r in llm.read.text(str(tmp_path / "t" / "ids")).where("value <> ''").collect()]
    assert sum(n for n, _ in got) == 200 and max(size for _, size in got) < 4 << 20


def test_chunks_do_not_follow_the_batches():
    texts = ["x" * 100_000] * 100
    batches = lambda n: [pa.RecordBatch.from_pydict({"doc_id": list(range(i, min(100, i + n))), "text": texts[i : i + n]}) for i in range(0, 100, n)]
    want = list(tf._chunks(batches(100)))
    assert sum((d for d, _ in want), []) == list(range(100)) and all(len(t) == 32 for _, t in want[:-1])
    assert all(list(tf._chunks(batches(n))) == want for n in (1, 7, 33)) and list(tf._chunks([])) == []


def test_known_parts_do_not_empty_the_table():
    coder = tf._Encoder(SPEC, 150)
    text = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    first, held = coder.encode([text]).to_pylist(), len(coder.parts)
    assert 75 < held <= 150
    coder.parts["mark"] = b""
    assert coder.encode([text]).to_pylist() == first and "mark" in coder.parts
