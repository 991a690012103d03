"""Subject areas of documents: weighted terms, truncated singular value decomposition, centroids refined from seeds.

Terms are hashed to ``DIMS`` places, so everything that reaches the driver or is broadcast (counts by term, the
term vectors, the centroids) has a fixed bound, whatever the corpus; counts, decomposition and refinement run over all
documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch
from .pages import paragraphs

#: Places of the term hash; columns kept of the decomposition and more that it works with; passes of its iteration.
DIMS, RANK, EXTRA, PASSES = 1 << 17, 96, 32, 3
#: Paragraphs a term must occur in. Cosine from which a paragraph counts, and from which it moves a centroid.
MIN_PARAGRAPHS, COUNTS, MOVES = 3, 0.35, 0.4
#: Rows of a block of partial sums.
BLOCK = 512
#: Fixed value: words; runs of Han, Katakana and Hiragana are words of their own, as are some signs.
WORD = r"\p{Han}+|[\p{Katakana}ー]+|\p{Hiragana}+|[^\W\d_\p{Han}\p{Katakana}\p{Hiragana}]+|[§%→°]"
#: The same where there are only ASCII letters, in lower case.
ASCII_WORD = "[a-z]+|%"


def document_terms(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ``lengths`` (terms of each paragraph of the main content), ``terms`` (hashed, distinct in a paragraph)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, plain, known = regex.compile(WORD).findall, re.compile(ASCII_WORD).findall, {}
        for b in batches:
            lengths, terms = [], []
            for raw, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own, flat = [], []
                for p in paragraphs(raw, text):
                    places = set()
                    for w in set((plain if p.isascii() else find)(p.lower())):
                        h = known.get(w)
                        if h is None:
                            h = zlib.crc32(w.encode()) % DIMS
                            if len(known) < 500_000:
                                known[w] = h
                        places.add(h)
                    if places:
                        own.append(len(places))
                        flat.extend(places)
                lengths.append(own)
                terms.append(flat)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, kind), pa.array(terms, kind)], names=["doc_id", "lang", "lengths", "terms"])

    code = F.lower(F.regexp_extract("lang", "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    rows = docs.select("doc_id", F.nullif(code, F.lit("")).alias("lang"), "raw_bytes", "text").filter("text IS NOT NULL AND doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id bigint, lang string, lengths array<int>, terms array<int>").filter("size(terms) > 0")


class Batch:
    """Documents of one Arrow batch in compressed rows: a row for each paragraph, with the terms that have a place in ``index``."""

    def __init__(self, b: pa.RecordBatch, index: np.ndarray):
        lengths, terms = b.column("lengths"), b.column("terms")
        self.n = b.num_rows
        per_doc = pc.list_value_length(lengths).to_numpy(zero_copy_only=False)
        size = lengths.flatten().to_numpy(zero_copy_only=False)
        flat = index[terms.flatten().to_numpy(zero_copy_only=False)]
        self.doc = np.repeat(np.arange(self.n), per_doc)
        self.rows = len(size)
        row = np.repeat(np.arange(self.rows), size)
        keep = flat >= 0
        self.term, self.row = flat[keep], row[keep]

    def weighted(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, term, value of the terms that have weight, each paragraph at most of length one; and the paragraphs' raw lengths."""
        w = weight[self.term]
        keep = w > 0
        row, term, w = self.row[keep], self.term[keep], w[keep]
        raw = np.sqrt(np.bincount(row, w * w, self.rows))
        return row, term, w / np.maximum(raw, 1.0)[row], raw


def _sums(at: np.ndarray, values: np.ndarray, n: int, in_order: bool = False) -> np.ndarray:
    """Rows of ``values`` added up by ``at``; ``in_order`` says that ``at`` is sorted."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(at):
        if not in_order:
            order = np.argsort(at, kind="stable")
            at, values = at[order], values[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[start]] = np.add.reduceat(values, start, axis=0)
    return out


def total(rows: DataFrame, shape: tuple[int, int], part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of ``part``, a matrix of a fixed shape. Partial sums are added in two shuffles before the driver gets the result."""
    n, width = shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            if b.num_rows:
                m = part(b)
                acc = m if acc is None else acc + m
        if acc is not None:
            starts = [s for s in range(0, n, BLOCK) if acc[s : s + BLOCK].any()]
            data = [acc[s : s + BLOCK].astype(np.float64).tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in starts], pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = np.frombuffer(x)
                acc[k] = acc[k] + m if k in acc else m
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([m.tobytes() for m in acc.values()], pa.binary())], names=["block", "data"])

    schema = "block int, data binary"
    parts = rows.mapInArrow(local, schema)
    some = parts.repartition("block", F.pmod(F.spark_partition_id(), F.lit(8))).mapInArrow(add, schema)
    out = np.zeros((n, width))
    for r in some.repartition("block").mapInArrow(add, schema).collect():
        m = np.frombuffer(r.data).reshape(-1, width)
        out[r.block * BLOCK : r.block * BLOCK + len(m)] = m
    return out


def concentration(counts: np.ndarray) -> np.ndarray:
    """For each term, 1 less the entropy of its spread over the classes, as if the classes were equally large and with two counts spread evenly."""
    prior = counts.sum(0) + 1e-9
    prior /= prior.sum()
    p = (counts + 2 * prior) / (counts.sum(1, keepdims=True) + 2) / prior
    p /= p.sum(1, keepdims=True)
    return 1 + (p * np.log(np.maximum(p, 1e-12))).sum(1) / np.log(counts.shape[1])


def _unit(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Model:
    """What a task needs to place a paragraph: the places of terms, their weights and vectors, and the centroids with their classes."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, vectors: np.ndarray):
        self.index, self.weight, self.vectors = index, weight.astype(np.float32), vectors.astype(np.float32)
        self.centroids = np.zeros((0, vectors.shape[1]), np.float32)

    def embed(self, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of the paragraphs, their weight (at most 1), and how many weighted terms they have."""
        row, term, value, raw = batch.weighted(self.weight)
        x = _sums(row, value[:, None].astype(np.float32) * self.vectors[term], batch.rows, True)
        return _unit(x), np.minimum(1, raw), np.bincount(row, minlength=batch.rows)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        empty = ~self.centroids.any(1)
        s = x @ self.centroids.T
        s[:, empty] = -1
        return s


def document_vectors(rows: DataFrame, index: np.ndarray, weight: np.ndarray, balance: dict[str | None, float]) -> DataFrame:
    """``terms`` (places) and ``values`` of each document: the sum of its paragraphs' vectors, of a length that balances its language.

    A document weighs the less the more documents its language has, so the subjects of a rare language have places of
    their own in the decomposition.
    """
    shared, n = rows.sparkSession.sparkContext.broadcast((index, weight.astype(np.float32))), len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        for b in batches:
            batch = Batch(b, index)
            row, term, value, _ = batch.weighted(weight)
            key, at = np.unique(batch.doc[row].astype(np.int64) * n + term, return_inverse=True)
            value = np.bincount(at, value, len(key))
            doc, term = key // n, (key % n).astype(np.int32)
            own = np.array([balance.get(x, balance[None]) for x in b.column("lang").to_pylist()])
            value *= (own / np.maximum(np.sqrt(np.bincount(doc, value * value, batch.n)), 1e-9))[doc]
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=batch.n))], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(term)), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))], names=["terms", "values"])

    return rows.mapInArrow(run, "terms array<int>, values array<float>")


def decompose(vectors: DataFrame, n: int, seed: int = 7) -> np.ndarray:
    """The first RANK right singular vectors of the documents' vectors, by subspace iteration over all of them."""
    width, sc = min(RANK + EXTRA, n), vectors.sparkSession.sparkContext
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(PASSES):
        shared = sc.broadcast(q.astype(np.float32))

        def part(b: pa.RecordBatch) -> np.ndarray:
            q = shared.value
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
            term = b.column("terms").flatten().to_numpy(zero_copy_only=False)
            value = b.column("values").flatten().to_numpy(zero_copy_only=False)[:, None]
            y = _sums(doc, value * q[term], b.num_rows, True)
            return _sums(term, value * y[doc], n)

        g = total(vectors, (n, width), part)
        shared.unpersist()
        ritz = q.T @ g
        last, q = q, np.linalg.qr(g)[0]
    _, u = np.linalg.eigh((ritz + ritz.T) / 2)
    return (last @ u[:, ::-1])[:, :RANK]


def subjects_of(docs: DataFrame, labels: DataFrame, names: list[str], rounds: int = 2) -> DataFrame:
    """doc_id, subject for every subject on which the main content of a page has a paragraph.

    ``labels`` (doc_id, subject) give the seeds: for each language and subject the mean of the labelled pages'
    paragraphs. Then paragraphs go to the centroid of the greatest cosine, first those of labelled pages among their own
    labels, then all, and the centroids move. ``none`` is a class of its own that gives no row. Terms weigh by rarity
    and by how far they keep to few classes, first in the labels, then in the classes found.

    A paragraph counts if its cosine is at least COUNTS; a subject counts if one such paragraph has two weighted terms,
    or if no subject has more paragraphs of the page. NULL, blank and unreadable pages have no subjects; labels of
    other subjects or of unknown pages are not used; without labels there are no subjects. One row a page and subject.
    """
    spark: SparkSession = docs.sparkSession
    scratch, sc = Scratch(spark), spark.sparkContext
    empty = spark.createDataFrame([], "doc_id bigint, subject string")
    classes = [*names, "none"]
    k = len(classes)
    rows = scratch.write(document_terms(docs))
    bit = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(1 << i))])
    mask = labels.filter(F.col("subject").isin(classes)).groupBy("doc_id").agg(F.bit_or(F.try_element_at(bit, F.col("subject"))).alias("mask"))
    labelled = scratch.write(rows.join(mask, "doc_id"))
    frequency = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    df = np.zeros(DIMS)
    for r in frequency:
        df[r.t] = r.n
    spoken = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = [r.lang for r in labelled.filter("lang IS NOT NULL").groupBy("lang").count().filter(F.col("count") >= k).orderBy("lang").collect()]
    seen = np.flatnonzero(df >= MIN_PARAGRAPHS)
    if not len(seen) or labelled.isEmpty():
        return empty
    index = np.full(DIMS, -1, np.int32)
    index[seen] = np.arange(len(seen))
    n = len(seen)
    rarity = np.log((df.sum() + 1) / (df[seen] + 1))
    balance = {x: 1 / np.sqrt(c) for x, c in spoken.items()}
    balance[None] = 0.5 * balance.get(None, 1.0)
    # Languages with fewer labelled pages than classes share a group of seeds; a page without a language gives seeds only if all are in it.
    place, groups = {x: i for i, x in enumerate(langs)}, len(langs) + 1
    if langs:
        place[None] = -1
    slots = groups * k
    bits = 1 << np.arange(k)

    def allowed(b: pa.RecordBatch, batch: Batch) -> np.ndarray:
        return (b.column("mask").to_numpy(zero_copy_only=False)[batch.doc][:, None] & bits) > 0

    def by_label(b: pa.RecordBatch) -> np.ndarray:
        batch = Batch(b, index_b.value)
        share = allowed(b, batch).astype(float)
        share /= np.maximum(share.sum(1, keepdims=True), 1)
        return _sums(batch.term, share[batch.row], n)

    index_b = sc.broadcast(index)
    counts = total(labelled, (n, k), by_label)
    for turn in range(rounds):
        weight = rarity * concentration(counts)
        weight[weight < 0.15 * np.quantile(weight, 0.9)] = 0
        vectors = scratch.write(document_vectors(rows, index, weight, balance))
        model = Model(index, weight, decompose(vectors, n))
        scratch.drop(vectors)

        def seeds(b: pa.RecordBatch) -> np.ndarray:
            m = shared.value
            batch = Batch(b, m.index)
            x, heavy, _ = m.embed(batch)
            share = allowed(b, batch)
            lang = np.array([place.get(c, groups - 1) for c in b.column("lang").to_pylist()])[batch.doc]
            r, c = np.nonzero(share & (lang >= 0)[:, None])
            return _sums(lang[r] * k + c, x[r] * (heavy[r] / share.sum(1)[r])[:, None], slots)

        def move(own: bool) -> Callable[[pa.RecordBatch], np.ndarray]:
            def part(b: pa.RecordBatch) -> np.ndarray:
                m = shared.value
                batch = Batch(b, m.index)
                x, heavy, _ = m.embed(batch)
                s = m.cosines(x)
                if own:
                    s[~np.tile(allowed(b, batch), (1, groups))] = -1
                at, best = s.argmax(1), s.max(1)
                ok = best > (MOVES / 2 if own else MOVES)
                return _sums(at[ok], x[ok] * heavy[ok, None], slots)

            return part

        for step, (source, part) in enumerate([(labelled, seeds), *[(labelled, move(True))] * 3, *[(rows, move(False))] * 3]):
            shared = sc.broadcast(model)
            model.centroids = _unit(total(source, (slots, model.vectors.shape[1]), part))
            shared.unpersist()
        shared = sc.broadcast(model)

        def by_class(b: pa.RecordBatch) -> np.ndarray:
            m = shared.value
            batch = Batch(b, m.index)
            x, heavy, _ = m.embed(batch)
            s = m.cosines(x)
            one = np.zeros((batch.rows, k))
            ok = np.flatnonzero((s.max(1) > MOVES) & (heavy > 0.5))
            one[ok, s.argmax(1)[ok] % k] = 1
            return _sums(batch.term, one[batch.row], n)

        if turn + 1 < rounds:
            counts = total(rows, (n, k), by_class)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            batch = Batch(b, m.index)
            x, heavy, count = m.embed(batch)
            s = m.cosines(x)
            cls = s.argmax(1) % k
            ok = (s.max(1) >= COUNTS) & (count > 0) & (cls < k - 1)
            held, strong = np.zeros((batch.n, k), int), np.zeros((batch.n, k), bool)
            np.add.at(held, (batch.doc[ok], cls[ok]), 1)
            both = ok & (count >= 2)
            strong[batch.doc[both], cls[both]] = True
            d, c = np.nonzero((held > 0) & (strong | (held == held.max(1, keepdims=True))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d)), pa.array([classes[i] for i in c], pa.string())], names=["doc_id", "subject"])

    return rows.mapInArrow(assign, "doc_id bigint, subject string").distinct()
