import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe
from palisade.llm.queries import QUERIES

SPEC = bpe.tokenizer_spec()
LIBRARY = Tokenizer.from_str(SPEC)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_splitting_loses_no_border():
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "\x85", "\xa0", "\u2003", "\x1c", "\u200b", "'s", "'", "1", "é", "中", "😀", "\u0301", "<|endoftext|>", "<|", "_", "\r\n", "\u3000", "\ufeff", "\0", "½"]
    special, table, r = bpe._special(SPEC), bpe._Pieces(SPEC), random.Random(5)
    for _ in range(5000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 12)))
        words = bpe.split_words(text, special)
        assert "".join(words) == text
        assert [i for w in words for i in ids_of(w)] == ids_of(text)
        assert table.decode(np.array(ids_of(text), np.int64)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


@pytest.mark.parametrize("block", [bpe.BLOCK_CHARS, 50])
def test_odd_rows(odd_docs, block):
    got = bpe.encode(odd_docs, SPEC, block_chars=block, decoded=True).collect()
    have = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in got), key=str)
    want = sorted(((r["doc_id"], ids_of(r["text"]), LIBRARY.decode(ids_of(r["text"]), skip_special_tokens=False)) for r in odd_docs.collect()), key=str)
    assert have == want


def test_few_words_held(llm, sf_dir, monkeypatch):
    """A table of words that starts anew again and again gives the same ids; nothing stays in the catalog."""
    from palisade.plans.stage import clear_scratch

    monkeypatch.setattr(bpe._encode_shares, "__defaults__", (3,))
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet").limit(40).persist()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in bpe.encode(docs, SPEC, block_chars=2000).collect()}
    assert got == {r["doc_id"]: ids_of(r["text"]) for r in docs.collect()}
    clear_scratch(llm)
    assert not [t for t in llm.catalog.listTables() if t.name.startswith("bpe_blocks")]


def test_decode_replaces_broken_bytes(llm):
    ids = ids_of("中")[:1]
    df = llm.createDataFrame([(1, bytearray(np.array(ids, "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df, SPEC).collect()} == {1: LIBRARY.decode(ids, skip_special_tokens=False), 2: ""}


def test_whole_table_round_trip(llm, sf_dir):
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    encoded = bpe.encode(docs, SPEC)
    assert encoded.columns == ["doc_id", "ids"]
    back = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in bpe.decode(encoded, SPEC).collect()}
    for r in docs.collect():
        assert back[r["doc_id"]] == (ids_of(r["text"]), r["text"])
    n = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op6_bpe"](llm, sf_dir).collect()}
    assert n == {d: len(ids) for d, (ids, _) in back.items()}


def test_empty_table(no_docs):
    assert bpe.encode(no_docs, SPEC, decoded=True).collect() == []


def test_word_tables_go_with_their_blocks(monkeypatch):
    """Tasks leave no table of words behind for the garbage collector."""
    import gc
    from collections import defaultdict
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [f"marker{i} of words" for i in range(40)]})
    gc.collect()
    gc.disable()
    try:
        made = [b.num_rows for b in bpe._blocks("{}", 200, 3)(iter([batch]))]
        left = [x for x in gc.get_objects() if isinstance(x, defaultdict) and any(str(k).startswith("marker") for k in list(x)[:3])]
    finally:
        gc.enable()
    assert len(made) > 3 and not left
