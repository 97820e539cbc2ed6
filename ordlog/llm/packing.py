"""Best-fit packing by minimum bin slack.

Documents are tokenized where they are read and only their pieces' lengths, a few numbers each, go on. There are as many lengths as a sequence
has tokens, so the count of pieces by length is small whatever the corpus, and is packed on the driver: for each bin, the largest length left
and the combination of the others that fills the rest best, found by a subset-sum table kept as bits; a combination is repeated while there
are lengths for it. Pieces then find their place by their rank among those of equal length, which needs no sort of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.llm.common import saved, to_python
from ordlog.llm.tokens import default_path, encoder

SEQUENCE, END_ID = 4096, 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bucket int, nth bigint"


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(a bin's lengths with how many of each, how many such bins)] for so many pieces of each length from 1 to capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    order, out = sorted(left, reverse=True), []
    for first in order:
        while left.get(first, 0):
            space = capacity - first
            bin_ = {first: 1} | _fullest(order, left, first, space)
            if bin_.get(-1):
                bin_[first] += bin_.pop(-1)
            times = min(left[n] // k for n, k in bin_.items())
            for n, k in bin_.items():
                left[n] -= k * times
            out.append((bin_, times))
        left.pop(first, None)
    return out


def _fullest(order: list[int], left: dict[int, int], first: int, space: int) -> dict[int, int]:
    """What to add to a bin that holds one piece of length `first`, the longest left; more pieces of that length are under -1."""
    bits, steps, goal = 1, [], 1 << space
    for n in order:
        have = left.get(n, 0) - (n == first)
        if n > space or have <= 0:
            continue
        have, chunk = min(have, space // n), 1
        while have:
            take = min(chunk, have)
            steps.append((n, take, bits))
            bits |= bits << n * take & (goal << 1) - 1
            have, chunk = have - take, chunk * 2
        if bits & goal:
            break
    at, out = bits.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            key = -1 if n == first else n
            out[key] = out.get(key, 0) + take
    return out


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """Tokens of each text and the end token, cut every `capacity` tokens. Adds the task that made a piece and its rank among that task's
    pieces of equal length."""
    to_python(docs.sparkSession)
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = encoder(path).batch, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, (flat, bounds) = [], encode(b.column(1))
            for doc_id, lo, hi in zip(b.column(0).to_pylist(), bounds, bounds[1:]):
                ids = np.append(flat[lo:hi], np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), task, nth[len(part)]))
                    nth[len(part)] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces in as few sequences of `capacity` tokens as found.

    A null or empty text is one piece of the end token. Repeated rows and doc_ids, null ones too, are packed each for itself. Other columns are
    ignored. An empty table gives no rows. Ties between pieces of equal length may fall either way; the sequences are equally full.
    """
    made = saved(pieces(docs, tokenizer, capacity))
    counts = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r[0]: r[1] for r in made.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows

    keys, table, bins = [], [], 0
    seen = dict.fromkeys(totals, 0)
    for bin_, times in minimum_bin_slack(totals, capacity):
        offset = 0
        for n, k in bin_.items():
            keys.append((n, seen[n]))
            table.append((seen[n], k, bins, offset))
            seen[n] += k * times
            offset += n * k
        bins += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lengths = np.array([keys[i][0] for i in order], np.int64)
    ranges = np.array([table[i] for i in order], np.int64).reshape(-1, 4)
    first = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *out, rank = b.columns
            n, rank = out[3].to_numpy(), rank.to_numpy()
            at = np.zeros(len(n), np.int64)
            for length in np.unique(n):
                own = n == length
                lo, hi = first[length], first[length + 1]
                at[own] = lo + np.searchsorted(ranges[lo:hi, 0], rank[own], "right") - 1
            start, each, bin0, offset = ranges[at].T
            k = rank - start
            yield pa.RecordBatch.from_arrays([*out, pa.array(bin0 + k // each), pa.array(offset + k % each * n)], [*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = made.join(base, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
