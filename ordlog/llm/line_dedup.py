"""Line dedup by winnowing over line hashes.

A window is the shortest run of lines, forwards from a line or backwards from it, that has LEAST words; a line that long is a window by itself.
Each window selects the least of its line hashes: a run of LEAST words or more that occurs twice holds equal windows, which select equal
fingerprints at equal places, so each such repeat is found. Only windows whose fingerprint occurs again go on. They are joined by fingerprint and
a hash of their whole run to their first occurrence by doc_id and line, a minimum that aggregates before the shuffle, so no pairs are made. Windows
that lie in two texts at one distance are one match, which is then extended both ways, line by line, over 128-bit hashes of the two texts' lines
until they differ: what a hash of the run alone brought together ends there, and only lines that are equal one by one are deleted. A match goes
on for EXTEND lines beyond its windows at most; a longer repeat has windows of its own there, which are matched by themselves. A line that goes
has an equal one earlier, so by induction one copy of every text stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import free, saved, to_python

LEAST, EXTEND = 50, 50
#: A key with more than 1/HOT of the rows to be joined is spread over SPREAD places. There are fewer than HOT such keys, whatever the data.
HOT, SPREAD = 1000, 256
#: Fixed odd number for hashes of runs; its inverse modulo 2^64 undoes a place.
BASE = 0x9E3779B97F4A7C15
#: Bytes of a line's hash; its second half alone is what windows select by.
DIGEST = 16
#: A character that is not white space of any kind.
SOLID = r"(?U)[^\s\x1c-\x1f]"
WINDOWS = "doc bigint, uid bigint, mark bigint, place int, run bigint, first int, last int, h binary"


def line_hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def least_places(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The place of the first least hash of each range [lo, hi]. Ranges of a length from 2^k on are told from two stretches of 2^k lines, whose
    least places come from those of half the length: time and memory are linear in the lines but for the logarithm of the longest range."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out, at, size = np.zeros(len(lo), np.int64), np.arange(len(hashes)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        own = np.flatnonzero(level == k)
        a, b = at[lo[own]], at[hi[own] - size + 1]
        out[own] = np.where(hashes[a] <= hashes[b], a, b)
        a, b = at[:-size], at[size:]
        at, size = np.where(hashes[a] <= hashes[b], a, b), 2 * size
    return out


def windows_of(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[np.ndarray, ...]]:
    """For lines of several documents one after another: (mark, its line, run, first, last) of each distinct window, lines counted over all."""
    n = len(hashes)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(words)])
    edge = np.flatnonzero(np.diff(doc)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    size = ends - starts
    begin, end = np.repeat(starts, size), np.repeat(ends, size)
    i = np.arange(n)
    last = np.searchsorted(total, total[:-1] + least, "left") - 1
    first = np.searchsorted(total, total[1:] - least, "right") - 1
    fore, back = last < end, first >= begin
    # A blank line at a window's edge has no words; windows that differ by such lines are different runs.
    lo, hi = np.divmod(np.unique(np.concatenate([i[fore] * n + last[fore], first[back] * n + i[back]])), n)
    power, inverse = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    run = (prefix[hi + 1] - prefix[lo]) * inverse[lo] ^ (hi - lo).astype(np.uint64)
    place = least_places(hashes, lo, hi)
    return [(hashes[place].view(np.int64), place, run.view(np.int64), lo, hi)]


def windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The windows of each document's lines; uid tells texts of equal doc_id apart. A document that has windows gives one row more, without a
    mark, with the hashes of its lines one after another."""
    to_python(docs.sparkSession)
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    digest = line_hash

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, uids = np.array(b.column(0).to_pylist(), dtype=np.int64), b.column(1).to_numpy()
            lines = [t.split(b"\n") for t in b.column(2).to_pylist()]
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            flat = [x for t in lines for x in t]
            whole = b"".join(map(digest, flat))
            hashes = np.frombuffer(whole, ">u8")[1::2].astype(np.uint64)
            words = np.fromiter((x.count(b" ") + x.count(b"\t") + 1 if x else 0 for x in flat), np.int64, len(flat))  # never less than there are
            doc = np.repeat(np.arange(len(lines)), sizes)
            before = np.cumsum(sizes) - sizes
            for mark, place, run, lo, hi in windows_of(hashes, words, doc, least):
                d = doc[lo]
                cols = [ids[d], uids[d], mark, place - before[d], run, lo - before[d], hi - before[d], pa.nulls(len(d), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                have = np.unique(d)
                h = [whole[DIGEST * before[x] : DIGEST * (before[x] + sizes[x])] for x in have]
                cols = [pa.array(ids[have]), pa.array(uids[have]), *(pa.nulls(len(have), k) for k in kinds[2:7]), pa.array(h, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("uid"), F.col("text").cast("binary").alias("text")).mapInArrow(make, WINDOWS)


def spread_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner", by: Sequence[str] = ("doc", "uid", "first")) -> DataFrame:
    """left joined to right by keys. right is a saved table that has a key once, with n, how many rows of left have it; n doesn't go on. Rows of
    keys whose last column is a hot key's are dealt over SPREAD places, to each of which the key's row of right goes too, so that no key fills a
    task. A row's place follows from its columns `by` and its partition of left, which has to be a saved table as well."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in right.where(F.col("n") * HOT > total).select(keys[-1]).distinct().collect()]  # fewer than HOT rows
    right = right.drop("n").hint("merge")  # the same plan at every size
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.col(keys[-1]).isin(hot)
    place = F.when(is_hot, F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))
    places = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("at", place).join(right.withColumn("at", F.explode(places)).hint("merge"), [*keys, "at"], how).drop("at")


def matches(made: DataFrame) -> DataFrame:
    """(doc, uid, xdoc, xuid, shift, seeds): windows (first, last) of a text that stand `shift` lines earlier in another place, their first. made: a
    saved table of windows."""
    # Most fingerprints occur at one place and end here.
    where = F.struct("doc", "uid", "place")
    again = made.groupBy("mark").agg(F.min(where).alias("x"), F.max(where).alias("y"), F.count("*").alias("n")).where("x != y").select("mark", "n")
    alive = saved(spread_join(made, saved(again), "mark", "left_semi"))
    at = F.struct("doc", "uid", "first")
    earliest = alive.groupBy("mark", "run").agg(F.min(at).alias("x"), F.max(at).alias("y"), F.count("*").alias("n")).where("x != y").select("mark", "run", "x", "n")
    later = spread_join(alive, saved(earliest), ["mark", "run"]).where(at != F.col("x"))
    by = ["doc", "uid", F.col("x.doc").alias("xdoc"), F.col("x.uid").alias("xuid"), (F.col("first") - F.col("x.first")).alias("shift")]
    # A set, which is made before the shuffle too: however often a document is repeated, it is no larger than the document's own windows.
    return later.groupBy(*by).agg(F.collect_set(F.struct("first", "last")).alias("seeds"))


def extended(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, uid, first, last): each match's runs of lines that are equal one by one, from its windows to both sides. found: the saved matches;
    lines: (doc, uid, h)."""
    used = found.select("doc", "uid").unionByName(found.select(F.col("xdoc").alias("doc"), F.col("xuid").alias("uid"))).distinct()
    lines = saved(lines.groupBy("doc", "uid").agg(F.max("h").alias("h")).join(used, ["doc", "uid"], "left_semi"))
    start = F.greatest(F.lit(0), F.col("shift"), F.array_min("seeds.first") - EXTEND)
    size = F.array_max("seeds.last") + 1 + EXTEND - F.col("start")
    cut = lambda skip: F.substring("h", (F.col("start") - skip) * DIGEST + 1, F.col("size") * DIGEST)
    own = found.withColumn("start", start).withColumn("size", size).join(lines.hint("merge"), ["doc", "uid"]).withColumn("own", cut(F.lit(0))).drop("h")
    own = saved(own)
    there = own.groupBy("xdoc", "xuid").agg(F.count("*").alias("n")).join(lines.select(F.col("doc").alias("xdoc"), F.col("uid").alias("xuid"), "h").hint("merge"), ["xdoc", "xuid"])
    both = spread_join(own, saved(there), ["xdoc", "xuid"], by=("doc", "uid", "shift")).withColumn("other", cut(F.col("shift")))
    to_python(found.sparkSession)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, uid, start, seeds, own, other in zip(*(c.to_pylist() for c in b.columns)):
                n = min(len(own), len(other)) // DIGEST
                halves = [np.frombuffer(x[: n * DIGEST], np.uint64).reshape(-1, 2) for x in (own, other)]
                ends = np.concatenate([[-1], np.flatnonzero((halves[0] != halves[1]).any(1)), [n]])
                first, last = (np.array([s[c] for s in seeds], np.int64) - start for c in ("first", "last"))
                at = np.searchsorted(ends, first, "right")
                lo, hi = ends[at - 1] + 1, ends[np.minimum(at, len(ends) - 1)] - 1
                out += [(doc, uid, start + x, start + y) for x, y in set(zip(lo[(lo <= first) & (last <= hi)].tolist(), hi[(lo <= first) & (last <= hi)].tolist()))]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "uid", "first", "last"])

    return both.select("doc", "uid", "start", "seeds", "own", "other").mapInArrow(extend, "doc_id bigint, uid bigint, first int, last int")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, uid, first, last): runs of lines, counted from 0, that have occurred before in order of doc_id and line; they may overlap."""
    made = saved(windows(docs, least))
    found = saved(matches(made.where("mark is not null").drop("h")))
    return extended(found, made.where("h is not null").select("doc", "uid", "h"))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines whose numbers are in `gone`. The lambda holds the lines, so that they are split once."""
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))


def deduplicate(docs: DataFrame, least: int = LEAST, drop_empty: bool = False) -> DataFrame:
    """Documents with the lines of later repeated runs deleted; n_chars, if there is one, follows the text. drop_empty drops documents of which
    this leaves nothing but white space.

    Runs of under `least` words stay; a line's words are counted by its spaces and tabs, each of a row of them too. Null and empty texts and rows without doc_id stay as they are. Rows of equal doc_id and text are one
    document and stay or go together; rows of equal doc_id and other text are documents of their own. Other columns stay. An empty table gives
    no rows.
    """
    uid, gone, kept = free(docs, "_uid"), free(docs, "_gone"), free(docs, "_hit")
    # A set, which is made before the shuffle too: however often a document is repeated, its group is no larger than its own windows.
    runs = repeats(docs, least).groupBy("doc_id", F.col("uid").alias(uid)).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    # Saved, so that AQE can split the join where a document is repeated often.
    spans = saved(runs.select("doc_id", uid, F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))).alias(gone)))
    out = docs.withColumn(uid, F.xxhash64("text")).join(spans.hint("merge"), ["doc_id", uid], "left")
    hit = F.col(gone).isNotNull()
    new = {"text": F.when(hit, without(F.col("text"), F.col(gone))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    out = out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns], hit.alias(kept))
    return (out.where(~F.col(kept) | F.rlike("text", F.lit(SOLID))) if drop_empty else out).drop(kept)
