import random
from pathlib import Path

import pytest

from gridloom.llm import corpus_ids
from gridloom.llm.corpus_ids import PATTERN, decode_corpus, encode_corpus, load_ranks

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(RANKS).exists(), reason="no vocabularies")


def texts():
    r = random.Random(2)
    pool = " \t\n\x0b\x1c\x85\xa0 ​　'aZsdéß1²٣!?.-日本語кэ\U0001f600\0"
    odd = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(300)]
    return [None, "", " ", "  ", "it's we'll", "<|endoftext|>", "a" * 40_000, "word " * 5000, *odd, *odd[:20]]


def test_ids_and_round_trip(spark, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    rows = [(i, t, None, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, words string").repartition(3)
    for limit, hot in ((corpus_ids.CHUNK_CHARS, corpus_ids.HOT_CHUNKS), (500, 3)):
        monkeypatch.setattr(corpus_ids, "CHUNK_CHARS", limit)
        monkeypatch.setattr(corpus_ids, "HOT_CHUNKS", hot)
        encoded = encode_corpus(df, RANKS)
        got = {r.doc_id: list(r.ids) for r in encoded.collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t, *_ in rows}
        counts = {r.doc_id: r.n_tokens for r in encode_corpus(df, RANKS, counts_only=True).collect()}
        assert counts == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in decode_corpus(encoded, RANKS).collect()}
    assert back == {i: t or "" for i, t, *_ in rows}


def test_same_as_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = list(enumerate(texts()))
    got = {r.doc_id: list(r.ids) for r in encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string"), RANKS).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows}


def test_empty_and_equal_keys(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_corpus(empty, RANKS).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(same, RANKS).collect()) == [(0, 1), (1, 2), (1, 2)]
