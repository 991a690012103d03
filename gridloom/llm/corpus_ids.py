"""Encoding of a whole corpus: pre-tokens with positions, each distinct word encoded once, ids joined back, reassembly.

Positions don't travel one by one. The documents of a chunk are written as indices into the chunk's own list of words
(``pretokens``), so what meets in the shuffle by word is each chunk's distinct words only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import MAX_HOT
from ..session import Scratch

#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern means it: the property White_Space, without the separators U+001C to U+001F.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters after which a chunk is closed; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000
#: Chunks of a word, at least, from which it is joined by a broadcast.
HOT_CHUNKS = 200_000


def tokenizer_path(spark) -> str:
    """The folder of vocabularies: ``spark.gridloom.tokenizers``, by default /opt/tokenizers."""
    return spark.conf.get("spark.gridloom.tokenizers", "/opt/tokenizers")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def _shared(spark: SparkSession, path: str):
    """A vocabulary file, read by the driver and broadcast: its size doesn't depend on the corpus, and executors need no copy of it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _splitter():
    import regex

    return regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a, pa.int32())


def _lists(values: pa.Array, lengths) -> pa.Array:
    return pa.ListArray.from_arrays(_ints(np.r_[0, np.cumsum(lengths, dtype=np.int64)]), values)


def pretokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of documents: chunk BIGINT, ``keys``, ``lengths`` (pre-tokens of each document), ``codes`` (indices into words), ``words``.

    NULL and empty texts have no pre-tokens; a row with a NULL key keeps its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, n = _splitter(), TaskContext.get().partitionId(), 0
        names = ["chunk", "keys", "lengths", "codes", "words"]
        keys: list = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        index: dict[str, int] = {}
        chars = 0

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
            arrays = [pa.array([(part << 33) + n], pa.int64()), _lists(pa.array(keys, pa.int64()), [len(keys)]), _lists(pa.array(lengths, pa.int32()), [len(lengths)]), _lists(_ints(flat), [len(flat)]), _lists(pa.array(list(index), pa.string()), [len(index)])]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = split(t) if t else []
                for w in dict.fromkeys(words):
                    index.setdefault(w, len(index))
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                keys.append(k)
                lengths.append(len(words))
                chars += len(t or "") + 100
                if chars >= CHUNK_CHARS:
                    yield chunk()
                    n, chars = n + 1, 0
                    keys, lengths, codes, index = [], [], [], {}
        if keys:
            yield chunk()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "chunk bigint, keys array<bigint>, lengths array<int>, codes array<int>, words array<string>")


def encode_words(words: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``words`` with the ``ids`` of ``word``; each word is encoded by the merges alone, as a pre-token is."""
    ranks = _shared(words.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=parse_ranks(ranks.value), special_tokens={})
        for b in batches:
            ids = [enc._core_bpe.encode_single_piece(w.encode()) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "chunks", "ids"])

    return words.select("word", "chunks").mapInArrow(run, "word string, chunks bigint, ids array<int>")


def _join_words(vocabulary: DataFrame, words: DataFrame, most: int, total: int) -> DataFrame:
    """``vocabulary`` with the columns of ``words``. A word of very many chunks doesn't meet them in one task: there are fewer than MAX_HOT such words, which are broadcast."""
    limit = max(HOT_CHUNKS, total // MAX_HOT)
    if most <= limit:
        return vocabulary.join(words.drop("chunks"), "word")
    hot = F.broadcast(words.filter(F.col("chunks") > limit).drop("chunks"))
    rare = vocabulary.join(hot.select("word"), "word", "left_anti").join(words.filter(F.col("chunks") <= limit).drop("chunks"), "word")
    return rare.unionByName(vocabulary.join(hot, "word"))


def encode_corpus(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text", counts_only: bool = False) -> DataFrame:
    """Every document with the ids of its text, or with ``n_tokens`` only: key, ids ARRAY<INT> | n_tokens INT.

    No special tokens. An empty and a NULL text both have the empty list (no tokens). Whole texts are encoded, however
    long; documents with equal keys keep one row each.
    """
    scratch = Scratch(docs.sparkSession)
    chunks = scratch.write(pretokens(docs, key, text))
    vocabulary = chunks.select("chunk", F.posexplode("words").alias("at", "word"))
    distinct = vocabulary.groupBy("word").agg(F.count(F.lit(1)).alias("chunks"))
    words, (most, rows) = scratch.write_and_sum(encode_words(distinct, ranks_path), F.max("chunks"), F.sum("chunks"))
    value = F.size("ids").alias("n") if counts_only else F.col("ids")
    name = "n" if counts_only else "ids"
    back = _join_words(vocabulary, words.select("word", "chunks", value), most or 0, rows or 0).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", name))).alias("table"))
    met = chunks.select("chunk", "keys", "lengths", "codes").join(back, "chunk", "left").select("keys", "lengths", "codes", "table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, lengths, codes, table = (b.column(c)[i].values for c in range(4))
                lengths = lengths.to_numpy(zero_copy_only=False)
                codes = codes.to_numpy(zero_copy_only=False) if codes is not None else np.empty(0, np.int32)
                ends = np.cumsum(lengths, dtype=np.int64)
                if table is None:
                    size, flat = np.zeros(0, np.int64), np.empty(0, np.int32)
                elif counts_only:
                    size, flat = table.field("n").to_numpy(zero_copy_only=False).astype(np.int64), None
                else:
                    lists = table.field("ids")
                    size, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
                per = size[codes] if len(codes) else np.zeros(0, np.int64)
                upto = np.r_[0, np.cumsum(per)]
                total = np.diff(upto[np.r_[0, ends]])
                if counts_only:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(total, pa.int32())], names=[key, "n_tokens"])
                    continue
                start = (np.cumsum(size) - size)[codes] if len(codes) else np.zeros(0, np.int64)
                at = np.repeat(start - upto[:-1], per) + np.arange(upto[-1])
                out = _lists(_ints(flat[at]), total)
                for p in range(0, len(keys), 500):
                    yield pa.RecordBatch.from_arrays([keys[p : p + 500], out[p : p + 500]], names=[key, "ids"])

    return met.mapInArrow(run, f"`{key}` bigint, n_tokens int" if counts_only else f"`{key}` bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text: the bytes of the ids, from the token-byte table, in order. A list without ids gives the empty text, a NULL list NULL."""

    shared = _shared(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = parse_ranks(shared.value)
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for x, r in ranks.items():
            table[r] = x
        for b in batches:
            texts = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
