"""Benchmark decontamination by latent semantic retrieval.

Texts become word hashes once, in a table that the later passes share. Document frequencies are counted over all documents. The benchmark's
passages, weighted by them, are reduced by a distributed randomised SVD: each task multiplies its passages with the current subspace and only
that product, vocabulary times rank, is gathered. Every window of every document is then a candidate if its latent cosine with a passage is COSINE
or more. A window's part in the benchmark's vocabulary bounds that cosine from above and costs two running sums, so most windows end there,
without loss. A copy that shares its window with other text, or whose words many documents have, may still have a low cosine. So documents are
also searched by words alone: one that has COPY of an item's words, or PARAPHRASE of them and ANSWER of the answer's, whatever they weigh, is a
candidate in each stretch that has PARAPHRASE of them. Candidates are settled by the longest common subsequence of words with the whole item, and paraphrases also by the item's answer.

The benchmark goes through in blocks of about RANK passages. A block's rank is the number of its passages, so that its space holds each of them
whole and a copy's cosine doesn't sink as the benchmark grows. GROUP blocks share a pass over the documents, which bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import free, saved, to_python

WINDOW, STRIDE, COSINE, RANK = 32, 16, 0.45, 128
#: Parts of an item's words that a document must have in order: for a copy, and for a paraphrase that also has so much of the answer.
COPY, PARAPHRASE, ANSWER = 0.8, 0.55, 0.8
#: Items of fewer words are told by chance and not searched.
LEAST = 8
#: Blocks in a pass.
GROUP = 16
#: Hashed words with a document frequency of their own, and how many of them make a row.
FEATURES, ROW = 1 << 18, 2048
SEED = 5


def words(text: Column) -> Column:
    """32-bit hashes of the lower-cased runs of letters and digits; none for null."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""), lambda w: F.hash(w))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and where each list begins and the last ends."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def document_frequencies(hashed: DataFrame) -> np.ndarray:
    """How many documents have each feature, over all documents. Tasks send their counts in rows of ROW features, which are summed row by row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for b in batches:
            v, at = _values(b.column(0))
            f = v & (FEATURES - 1)
            for lo, hi in zip(at, at[1:]):
                df[np.unique(f[lo:hi])] += 1
        rows = df.reshape(-1, ROW)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "n"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in g["n"]), np.zeros(ROW, np.int64))
        return pd.DataFrame({"row": [g["row"].iloc[0]], "n": [total.tobytes()]})

    out = np.zeros((FEATURES // ROW, ROW), np.int64)
    for r in hashed.select("w").mapInArrow(count, "row int, n binary").groupBy("row").applyInPandas(add, "row int, n binary").collect():
        out[r["row"]] = np.frombuffer(r["n"], np.int64)
    return out.ravel()


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]
    where: dict[int, int] = field(init=False)
    answer_where: dict[int, int] = field(init=False)

    def __post_init__(self) -> None:
        self.where, self.answer_where = places(self.words), places(self.answer)


def places(ws: Sequence[int]) -> dict[int, int]:
    """For each word, the bits of the places where it stands."""
    out: dict[int, int] = {}
    for i, w in enumerate(ws):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(where: dict[int, int], n: int, ws: Sequence[int]) -> int:
    """Length of the longest common subsequence of n words, given by their places, and ws; one step on n bits for each word."""
    full = (1 << n) - 1
    v = full
    for w in ws:
        if m := where.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def starts(n: int) -> range:
    """Where the windows of n words begin; the last reaches the end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


@dataclass
class Space:
    """A block of the benchmark in its latent space."""

    items: list[Item]
    row: dict[int, int]  # word -> row of basis
    idf: np.ndarray  # of each feature
    basis: np.ndarray
    vectors: np.ndarray  # of passages, latent
    owner: np.ndarray  # the item of each passage


def passage(ws: Sequence[int], row: dict[int, int], idf: np.ndarray) -> np.ndarray:
    """TF-IDF over the block's vocabulary, of length 1 where it has any weight; the frequency counts by its root."""
    x = np.zeros(len(row))
    for w in ws:
        if w in row:
            x[row[w]] += 1
    own = np.sqrt(x) * np.array([idf[w & FEATURES - 1] for w in row])
    return own / (np.linalg.norm(own) or 1.0)


def randomised_svd(passages: DataFrame, row: dict[int, int], idf: np.ndarray, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """The leading right singular vectors of the passages' matrix, as columns. passages: a list of words w for each."""
    m = len(row)

    def times(q: np.ndarray) -> np.ndarray:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(q)
            for b in batches:
                for ws in b.column(0).to_pylist():
                    x = passage(ws, row, idf)
                    at = np.flatnonzero(x)
                    out[at] += x[at, None] * (x[at] @ q[at])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["g"])

        return sum((np.frombuffer(r[0], float).reshape(q.shape) for r in passages.coalesce(4).mapInArrow(multiply, "g binary").collect()), np.zeros_like(q))

    q = np.random.default_rng(SEED).standard_normal((m, min(m, rank + 16)))
    for _ in range(rounds):
        q = np.linalg.qr(times(q))[0]
    values, u = np.linalg.eigh(q.T @ times(q))
    keep = np.argsort(-values)[:rank]
    return q @ u[:, keep[values[keep] > 1e-9]]


def spaces(benchmark: DataFrame, df: np.ndarray, n_docs: int) -> Iterator[Space]:
    """The benchmark, block by block."""
    text = F.col("text")
    answer = F.col("answer") if "answer" in benchmark.columns else F.regexp_extract(text, r"([^.!?\n]+)[.!?\s]*$", 1)
    rows = saved(benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), words(text).alias("w"), words(answer).alias("a")).where(F.size("w") >= LEAST))
    idf = np.maximum(0, np.log((n_docs + 1) / (df + 1)))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - WINDOW + STRIDE - 1), F.lit(STRIDE)), lambda i: F.slice("w", i + 1, WINDOW))
    total = rows.agg(F.coalesce(F.sum(F.size(cut)), F.lit(0))).first()[0]
    blocks = -(-total // RANK)
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == k)
        items = [Item(r["item_id"], r["w"], r["a"] if len(r["a"]) > 3 else r["w"][-8:]) for r in own.collect()]
        row = {w: i for i, w in enumerate(dict.fromkeys(w for it in items for w in it.words))}
        if not row:
            continue
        parts = [(i, it.words[s : s + WINDOW]) for i, it in enumerate(items) for s in starts(len(it.words))]
        basis = randomised_svd(own.select(F.explode(cut).alias("w")), row, idf, rank=len(parts))
        v = np.array([passage(ws, row, idf) for _, ws in parts]) @ basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        yield Space(items, row, idf, basis.astype(np.float32), (v / np.where(norm > 0, norm, 1)).astype(np.float32), np.array([i for i, _ in parts]))


def candidates(v: np.ndarray, at: np.ndarray, space: Space, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, first word in it, item) of each window whose latent cosine with a passage is COSINE or more. row: of each word in the basis, or -1."""
    weight = space.idf[v & FEATURES - 1]
    energy = weight * weight
    every, ours = np.append(0, np.cumsum(energy)), np.append(0, np.cumsum(np.where(row >= 0, energy, 0)))
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW + STRIDE) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = at[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    last = np.minimum(first + WINDOW, at[doc + 1])
    a, o = every[last] - every[first], ours[last] - ours[first]
    alive = np.flatnonzero((o > 1e-9) & (o >= COSINE**2 * a))
    padded = np.append(row, np.full(WINDOW, -1))
    root = np.append(weight, np.zeros(WINDOW)).astype(np.float32)
    basis = np.vstack([space.basis, np.zeros((1, space.basis.shape[1]), np.float32)])
    for k in range(0, len(alive), 1024):
        own = alive[k : k + 1024]
        place = first[own, None] + np.arange(WINDOW)
        r = np.where(place < last[own, None], padded[place], -1)
        tf = (r[:, :, None] == r[:, None, :]).sum(2)
        x = np.where(r >= 0, root[place], 0) / np.sqrt(tf, dtype=np.float32)
        latent = np.einsum("nw,nwr->nr", x, basis[r], optimize=True) / np.sqrt(a[own, None])
        for i, p in np.argwhere(latent.astype(np.float32) @ space.vectors.T >= COSINE):
            yield int(doc[own[i]]), int(first[own[i]] - at[doc[own[i]]]), int(space.owner[p])


@dataclass
class Index:
    """Which items, and after them which items' answers, have a word, and how often."""

    keys: np.ndarray  # words, sorted
    begin: np.ndarray  # of each word's postings; the last ends
    item: np.ndarray
    times: np.ndarray
    has: np.ndarray  # by item or answer and word
    sizes: np.ndarray  # words of each


def indexed(items: Sequence[Item]) -> Index:
    every = [it.where for it in items] + [it.answer_where for it in items]
    rows = sorted((w, i, bits.bit_count()) for i, where in enumerate(every) for w, bits in where.items())
    w, item, times = (np.array(c, np.int64) for c in zip(*rows))
    keys, begin = np.unique(w, return_index=True)
    has = np.zeros((len(every), len(keys)), bool)
    has[item, np.searchsorted(keys, w)] = True
    return Index(keys.astype(np.int32), np.append(begin, len(w)), item, times, has, np.array([len(it.words) for it in items] + [len(it.answer) for it in items]))


def holders(k: np.ndarray, at: np.ndarray, items: Sequence[Item], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(document, first word, last word, item) of each stretch that may hold a copy or a paraphrase. Stretches overlap so that any one
    of up to one and a half times the item's words lies in one whole. k: of each word among the index's keys, or -1."""
    place = np.flatnonzero(k >= 0)
    key, doc = k[place], np.repeat(np.arange(len(at) - 1), np.diff(at))[place]
    has = np.zeros((len(at) - 1, len(index.keys)), bool)
    has[doc, key] = True
    d, w = np.nonzero(has)
    n = index.begin[w + 1] - index.begin[w]
    p = np.repeat(index.begin[w] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    share = np.bincount(np.repeat(d, n) * len(index.sizes) + index.item[p], index.times[p], len(has) * len(index.sizes)).reshape(len(has), -1) / index.sizes
    share, told = share[:, : len(items)], share[:, len(items) :]
    ends = np.searchsorted(doc, np.arange(len(at)))
    for d, i in np.argwhere((share >= COPY) | (share >= PARAPHRASE) & (told >= ANSWER)).tolist():
        size = len(items[i].words)
        own = place[ends[d] : ends[d + 1]][index.has[i, key[ends[d] : ends[d + 1]]]]
        first = np.arange(at[d], at[d + 1], max(1, size // 2))
        last = np.minimum(first + 2 * size, at[d + 1])
        lo, hi = np.searchsorted(own, first), np.searchsorted(own, last)
        for j in np.flatnonzero(hi - lo >= PARAPHRASE * size).tolist():
            yield d, int(first[j]), int(last[j]), i


def matches(hashed: DataFrame, group: Sequence[Space]) -> DataFrame:
    """(doc_id, uid, item_id, lcs, item_words, answer_lcs, answer_words) of documents that hold a copy or a paraphrase of an item."""
    schema = "doc_id bigint, uid bigint, item_id bigint, lcs int, item_words int, answer_lcs int, answer_words int"
    items = [it for s in group for it in s.items]
    index = indexed(items)
    rows = [np.array([*(s.row.get(k, -1) for k in index.keys.tolist()), -1]) for s in group]
    before = np.cumsum([0, *(len(s.items) for s in group)]).tolist()

    def stretches(v: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        k = np.minimum(np.searchsorted(index.keys, v), len(index.keys) - 1)
        k[index.keys[k] != v] = -1
        yield from holders(k, at, items, index)
        for s, b, row in zip(group, before, rows):
            for d, first, i in candidates(v, at, s, row[k]):
                size = len(s.items[i].words)
                yield d, at[d] + max(0, first - size), min(at[d + 1], at[d] + first + WINDOW + size), b + i

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, at = _values(b.column(2))
            out: dict[tuple[int, int], tuple] = {}
            hits = stretches(v, at) if len(v) else ()
            for d, lo, hi, i in hits:
                it = items[i]
                size, answer = len(it.words), len(it.answer)
                near = v[lo:hi].tolist()
                lcs = common_subsequence(it.where, size, near)
                if lcs < PARAPHRASE * size:
                    continue
                told = common_subsequence(it.answer_where, answer, near)
                if lcs >= COPY * size or told >= ANSWER * answer:
                    out[d, i] = max(out.get((d, i), ()), (lcs, size, told, answer))
            ids, uids = b.column(0), b.column(1)
            cols = [[ids[d].as_py() for d, _ in out], [uids[d].as_py() for d, _ in out], [items[i].item_id for _, i in out], *([x[k] for x in out.values()] for k in range(4))]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])

    return hashed.mapInArrow(search, schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `matches` for all documents and items, one for each document, text and item.

    Null and empty texts match nothing; an empty table of either kind gives no rows. Items without item_id or with fewer than LEAST words aren't
    searched; items that occur again match again only under another item_id. Documents without doc_id are reported with null. The column answer
    of the benchmark, if there is one, holds an item's answer; else it is the last sentence, or the last 8 words where that has 3 or less.
    """
    spark = docs.sparkSession
    to_python(spark)
    hashed = saved(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("uid"), words(F.col("text")).alias("w")))
    n_docs = hashed.count()
    df = document_frequencies(hashed)
    out = spark.createDataFrame([], "doc_id bigint, uid bigint, item_id bigint, lcs int, item_words int, answer_lcs int, answer_words int")
    for group in batched(spaces(benchmark, df, n_docs), GROUP):
        out = out.unionByName(matches(hashed, group))
    return out.dropDuplicates(["doc_id", "uid", "item_id"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    key, uid = free(docs, "_key"), free(docs, "_uid")
    found = saved(contamination(docs, benchmark).select(F.col("doc_id").alias(key), F.col("uid").alias(uid)).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(uid)), "left_anti")
