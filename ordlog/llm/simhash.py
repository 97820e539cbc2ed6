"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is made in the task that reads the text. Distinct fingerprints then go to 2^(r+1) - 1 tables: each bit has a code of
r + 1 bits, all codes being used alike, and table v keeps the bits whose code has an odd product with v. The codes of r differing bits span less than all r + 1 dimensions, so
some v other than zero is orthogonal to all of them, and in that table the pair has equal keys: every pair within the radius meets in some table.

A table's bucket yields a spanning forest of its links, found by walking out from one fingerprint at a time over those not yet reached, so copies
of a text never make all pairs. Buckets above BLOCK fingerprints are cut into blocks, and each two blocks are one task: memory is bounded
and no link is lost. Components of the forest are the classes.

Texts that share a part SIMILAR of their shingles differ in up to 14 bits of the shingles' fingerprint, too many for tables that all pairs meet in.
`similar` therefore covers fingerprints of single words, which such texts share nearly all of and where they differ in few bits; there are VIEWS of
them by unlike hashes, so that a pair which one places beyond the radius has another chance. What meets in a bucket is held against the
shingles' fingerprint there and then. A bucket yields its near pairs where they are few for each text, else a spanning forest of the nearest. These
links are held against a wide fingerprint of the shingles, and each that is left is verified by the exact similarity of the two texts' sets.

What fingerprints, forests or failed links leave out is found by an exact pass over texts of unlike classes. Two sets that share the part SIMILAR
have a common shingle among the first of each in any one order, of which a set of n has n - SIMILAR n + 1 (`remaining`); rare shingles come first.
Sizes, places and parity bitmaps, which bound the similarity from above, tell pairs apart before their texts are read again, and lose none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlog.llm.common import free, saved, to_python
from ordlog.llm.components import components

WORDS, RADIUS, BLOCK, SEED = 4, 4, 4096, 42
#: Bits of a fingerprint.
BITS = 64
#: For `similar`: words in a shingle, the least part of two texts' shingles that they share, and fingerprints of a text's words.
SHINGLE, SIMILAR, VIEWS = 5, 0.8, 2
#: Numbers of 64 bits in the wide fingerprint of a text's shingles.
WIDE = 4
#: Buckets up to which all pairs are looked at together; near pairs for each of a bucket's texts up to which they are listed, and up to which all of them
#: go on as links; beyond it a spanning forest of the nearest does.
SMALL, DENSE, FEW = 64, 64, 2
#: One of so many texts is counted to tell large buckets beforehand; what is found doesn't depend on it.
COUNTED = 16
#: Rows that a task looks through together, besides those of a group that isn't whole yet.
WALK = 200_000
#: Frequent shingles come last in the order of `remaining`: those that are LISTED times or more in one of SAMPLED texts, FREQUENT of them at most. The
#: order decides how many pairs are looked at, not which are found.
FREQUENT, LISTED, SAMPLED = 50_000, 3, 64
#: Bits of the largest parity bitmap, and pairs that leave a task together.
PARITY, EMIT = 1 << 15, 500_000
#: Sizes times similarities are compared with this much to spare.
SPARE = 1e-6


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64 majority bits of the XXH64 of a text's word shingles; 0 if it has no word."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not w:
        return 0
    line = b" ".join(w)
    n = len(w)
    if n <= words:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 4096):
        bits = np.unpackbits(h[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, uid, fp): uid tells texts of equal doc_id apart; the fingerprint is a signed bigint."""
    to_python(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "uid", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("uid"), "text").mapInArrow(make, "doc_id bigint, uid bigint, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask for each v other than zero, as signed 64-bit numbers; each keeps half the bits, or as nearly as the radius allows."""
    out = []
    for v in range(1, 1 << radius + 1):
        m = sum(1 << i for i in range(BITS) if ((i % (1 << radius + 1)) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(fps: np.ndarray, radius: int, fps2: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints are within the radius of each other; with fps2, all of both arrays."""
    rest = np.unique(fps if fps2 is None else np.concatenate([fps, fps2])).view(np.uint64)
    out = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                queue += list(found)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of the distinct fingerprints fp within the radius."""
    ms = F.array(*[F.lit(m) for m in masks(radius)])
    keyed = nodes.select("fp", F.posexplode(F.transform(ms, lambda m: m.bitwiseAND(F.col("fp")))).alias("t", "key"))
    # Saved, so that AQE can split the rows of a big bucket, which it can't where the other side is an aggregate itself.
    size = saved(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    met = keyed.join(size.hint("merge"), ["t", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", "t"), blocks).cast("int")
    other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = met.select("fp", "t", "key", F.explode(other).alias("p")).select("fp", "t", "key", "p.i", "p.j")
    by = ["t", "key", "i", "j"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups follow one another; one that goes on in the next batch waits for it. A group has at most about two blocks of rows."""
        held = np.zeros((0, 5), np.int64)
        empty = lambda: np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1) if b.num_rows else empty()
            rows = np.concatenate([held, rows])
            cut = np.flatnonzero((rows[1:, 1:] != rows[:-1, 1:]).any(1)) + 1
            last = cut[-1] if len(cut) else 0
            held = rows[last:]
            yield from each(rows[:last], cut[:-1])
        yield from each(held, np.zeros(0, np.int64))

    def each(rows: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, bounds = [], np.concatenate([[0], cut, [len(rows)]]).astype(np.int64)
        pair = bounds[:-1][np.diff(bounds) == 2]
        a, b = rows[pair, 0], rows[pair + 1, 0]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        two = np.stack([a[near], b[near]], 1) if len(pair) else np.zeros((0, 2), np.int64)
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo > 2:
                out += forest(rows[lo:hi, 0], radius)
        edges = np.concatenate([two, np.array(out, np.int64).reshape(-1, 2)])
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(walk, "a bigint, b bigint")


def classes(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, uid, fp, root, component_id) of every row; root names the class by a fingerprint."""
    made = saved(fingerprints(docs, words))
    nodes = saved(made.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # for a big class, as in links
    named = rooted.join(least.hint("merge"), "root").select("fp", "root", "component_id")
    return made.join(named, "fp").select("doc_id", "uid", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links of at most `radius` differing bits lead to.

    Null, empty and wordless texts have fingerprint zero, linked like any other. Rows with equal doc_ids stay and share a class only if their
    texts link; a component_id is null only if none of the class's rows has a doc_id. Other columns are ignored. An empty table gives no rows.
    """
    return classes(docs, radius, words).drop("uid", "root")


def deduplicate(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """Documents without near-duplicates, with all their columns: of each class one row of the least doc_id stays. Rows without a doc_id stay, as
    no class can name them. An empty table gives no rows."""
    stays = classes(docs, radius, words).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "uid")).alias("r")).select("r.*")
    uid = free(docs, "_uid")
    named = docs.where("doc_id is not null").withColumn(uid, F.xxhash64("text"))
    stays = stays.withColumnRenamed("uid", uid)
    kept = named.join(stays, ["doc_id", uid], "left_semi").dropDuplicates(["doc_id", uid]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def majority(h: np.ndarray) -> np.ndarray:
    """For each column of hashes the 64 bits that over half of them have."""
    total = np.zeros(h.shape[1] * BITS, np.int64)
    for lo in range(0, len(h), 4096):
        total += np.unpackbits(np.ascontiguousarray(h[lo : lo + 4096]).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A row of VIEWS hashes for each word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w, SEED) for w in words]), np.uint64).reshape(-1, VIEWS)


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n numbers of 64 bits for each hash, as rows."""
    out = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(odd)
    return out ^ out >> np.uint64(31)


def shingles(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of the whole sequence of words where there are fewer, none without a word. A shingle's hash
    is made of its words' hashes in order."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    own = word_hashes(w)
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h = (h ^ own[k : k + n, 0]) * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n, 1]
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9) ^ h >> np.uint64(32))


def word_fingerprints(text: str | None) -> np.ndarray:
    """For each view the 64 majority bits of the hashes of a text's words, repeats included; words are runs of letters and digits, or of anything but
    white space where there are none."""
    low = (text or "").encode().lower()
    w = re.findall(rb"[0-9a-z\x80-\xff]+", low) or low.split()
    return majority(word_hashes(w)) if w else np.zeros(VIEWS, np.uint64)


def most_apart(similarity: float, bits: int = BITS) -> int:
    """Differing bits of shingles' fingerprints up to which sets of this similarity stay with odds of over 99 in 100. Their cosine is at least
    2 s / (1 + s), and a bit differs with the part of a half turn that the angle is."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(np.ceil(bits * p + 2.6 * np.sqrt(bits * p * (1 - p))))


def spanning(fp: np.ndarray, wide: np.ndarray, radius: int, apart: int) -> Iterator[tuple[int, int]]:
    """Links that join what is near, the nearest first: to what is joined already, the place that is fewest bits apart comes next."""
    best, via = np.full(len(fp), apart + 1), np.full(len(fp), -1)
    rest = np.arange(len(fp))
    while len(rest):
        k = int(np.argmin(best[rest]))
        x = int(rest[k])
        if via[x] >= 0:
            yield int(via[x]), x
        rest = np.delete(rest, k)
        d = np.bitwise_count(wide[rest] ^ wide[x])
        nearer = (d < best[rest]) & (np.bitwise_count(fp[rest] ^ fp[x]) <= radius)
        best[rest[nearer]], via[rest[nearer]] = d[nearer], x


def near_pairs(fp: np.ndarray, wide: np.ndarray, radius: int, apart: int) -> np.ndarray | None:
    """(bits apart, a, b) of all near pairs of a group; None if there are over DENSE for each place."""
    out, n = [], 0
    for lo in range(0, len(fp), 256):
        close = np.bitwise_count(fp[lo : lo + 256, None] ^ fp[None, lo:]) <= radius
        a, b = np.nonzero(close)
        keep = b > a
        a, b = a[keep] + lo, b[keep] + lo
        d = np.bitwise_count(wide[a] ^ wide[b]).astype(np.int64)
        out.append(np.stack([d, a, b], 1)[d <= apart])
        n += len(out[-1])
        if n > DENSE * len(fp):
            return None
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def joined(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs (bits apart, a, b), the nearest first; all of them where they are FEW for each place."""
    if len(pairs) <= FEW * len(np.unique(pairs[:, 1:])):
        yield from map(tuple, pairs[:, 1:].tolist())
        return
    parent: dict[int, int] = {}
    for _, a, b in sorted(map(tuple, pairs.tolist())):
        x, y = a, b
        while x in parent:
            x = parent[x]
        while y in parent:
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield a, b


def candidates(nodes: DataFrame, radius: int, apart: int, block: int = BLOCK) -> DataFrame:
    """(a, b): near pairs or links that join them, bucket by bucket, of the nodes of which a view v0, v1, ... of the words is within the radius and whose shingles'
    fingerprints s are at most `apart`. nodes: a saved table with a column node.

    Rows are shuffled once, to their buckets. Large buckets are told beforehand by a count of one node of COUNTED, and are cut into blocks, each two
    of which are a group; a bucket that the count misjudges is a larger group and loses nothing.
    """
    ms = F.array(*[F.lit(m) for m in masks(radius)])
    keys = lambda fp: F.transform(ms, lambda m: F.struct(m.bitwiseAND(fp).alias("key"), fp.alias("fp")))
    every = F.concat(*[keys(F.col(f"v{i}")) for i in range(VIEWS)])
    keyed = nodes.select("node", "s", F.posexplode(every).alias("t", "x")).select("node", "s", "t", "x.key", "x.fp")
    by = ["t", "key", "i", "j"]
    n = len(by)

    def forest_of(rows: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int]]:
        """rows: by, fp, s, node; cut: where groups begin, the end too."""
        size = np.diff(cut)
        alive = np.repeat(size > 1, size)  # most buckets hold one
        rows, size = rows[alive], size[size > 1]
        cut = np.append(0, np.cumsum(size))
        fp, wide, node = (np.ascontiguousarray(rows[:, n + k]) for k in range(3))
        fp, wide = fp.view(np.uint64), wide.view(np.uint64)
        small = np.where(size <= SMALL, size, 0)
        left, place = np.repeat(small, size), np.arange(len(rows)) - np.repeat(cut[:-1], size)
        found = []
        at = np.flatnonzero(left > 0)
        for off in range(1, int(left.max(initial=0))):
            at = at[place[at] + off < left[at]]
            a = at[np.bitwise_count(fp[at] ^ fp[at + off]) <= radius]
            d = np.bitwise_count(wide[a] ^ wide[a + off]).astype(np.int64)
            found.append(np.stack([d, a, a + off], 1)[d <= apart])
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        group = np.repeat(np.arange(len(size)), size)[pairs[:, 1]] if len(pairs) else np.zeros(0, np.int64)
        many = (np.bincount(group, minlength=len(size)) > FEW * size)[group] if len(pairs) else np.zeros(0, bool)
        yield from zip(node[pairs[~many, 1]].tolist(), node[pairs[~many, 2]].tolist())
        yield from ((node[a], node[b]) for a, b in joined(pairs[many]))
        for g in np.flatnonzero(size > SMALL):
            lo, hi = cut[g], cut[g + 1]
            pairs = near_pairs(fp[lo:hi], wide[lo:hi], radius, apart)
            yield from ((node[lo + a], node[lo + b]) for a, b in (spanning(fp[lo:hi], wide[lo:hi], radius, apart) if pairs is None else joined(pairs)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cut in groups(batches, n, n + 3):
            pairs = np.array(list(forest_of(rows, cut)), np.int64).reshape(-1, 2)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    return dealt(keyed, ["t", "key"], block).select(*by, "fp", "s", "node").mapInArrow(walk, "a bigint, b bigint").distinct()


def dealt(keyed: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The rows of keyed by groups (*keys, i, j), one after another. Large buckets are told beforehand by a count of one node of COUNTED, and are cut into
    blocks, each two of which are a group."""
    some = keyed.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0)
    large = saved(some.groupBy(*keys).agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > block // 2))
    blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("node", *keys[:-1]), blocks).cast("int")
    other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    out = keyed.join(large, keys, "left").select(*keyed.columns, F.explode(other).alias("p")).select(*keyed.columns, "p.i", "p.j")
    return out.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def groups(batches: Iterator[pa.RecordBatch], n: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, where groups begin and the end) of whole groups, which are told by the first n of `width` columns of numbers. Groups follow one another; one
    that goes on in the next batch waits for it. A group has at most about two blocks of rows."""
    held, size = [np.zeros((0, width), np.int64)], 0
    for b in _and_none(batches):
        if b is not None:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1))
            size += b.num_rows
            if size < WALK:
                continue
        rows = np.concatenate(held)
        cut = np.append(0, np.flatnonzero((rows[1:, :n] != rows[:-1, :n]).any(1)) + 1)
        cut = np.append(cut, len(rows)) if b is None else cut
        held, size = [rows[cut[-1] :]], 0
        yield rows[: cut[-1]], cut


def _and_none(xs: Iterator, end: object = None) -> Iterator:
    yield from xs
    yield end


def may_share(rows: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows (root, size, place) of a shingle are of unlike roots and may be similar, if no shingle before these places is common."""
    root, size, place = rows.T
    most = np.minimum(size[a] - place[a], size[b] - place[b])
    return (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - SPARE) & ((1 + similarity) * most >= similarity * (size[a] + size[b]) - SPARE)


def pairs_across(rows: np.ndarray, cut: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all pairs in groups of rows (root, size, place) that `may_share` lets through. cut: where groups begin, the end too."""
    size = np.diff(cut)
    if not len(rows):
        return
    root = rows[:, 0]
    alive = np.repeat(np.minimum.reduceat(root, cut[:-1]) != np.maximum.reduceat(root, cut[:-1]), size)
    group = np.repeat(np.arange(len(size)), size)[alive]
    places = np.flatnonzero(alive)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    left = np.repeat(size, size) - (np.arange(len(group)) - np.repeat(begin, size))  # rows to the group's end, this one included
    at = np.flatnonzero(left <= SMALL)  # what is left of a large group too
    for off in range(1, SMALL):
        at = at[left[at] > off]
        a, b = places[at], places[at + off]
        keep = may_share(rows, a, b, similarity)
        yield a[keep], b[keep]
    for x in np.flatnonzero(left > SMALL):
        a, b = places[x], places[x + 1 : x + left[x]]
        b = b[may_share(rows, a, b, similarity)]
        yield np.full(len(b), a), b


def remaining(nodes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of nodes of unlike roots, every two that share the part `similarity` of their shingles among them. nodes: a saved table (node, root,
    size, keys), keys being the first shingles of a set (`first_keys`); all without words have one.

    Rows are shuffled once, to their shingles; frequent ones are cut into blocks as in `candidates`.
    """
    by = ["key", "i", "j"]
    n = len(by)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for rows, cut in groups(batches, n, n + 4):
            for a, b in _and_none(pairs_across(rows[:, n : n + 3], cut, similarity), (None, None)):
                if a is not None:
                    out.append(np.stack([rows[a, n + 3], rows[b, n + 3]], 1))
                    size += len(a)
                if size >= EMIT or a is None and size:
                    pairs, out, size = np.unique(np.sort(np.concatenate(out), 1), axis=0), [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])
            out = []

    keyed = nodes.select("node", "root", "size", F.posexplode("keys").alias("place", "key"))
    return dealt(keyed, ["key"], block).select(*by, "root", "size", "place", "node").mapInArrow(walk, "a bigint, b bigint").distinct()


def first_keys(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set of sorted hashes, in order of how frequent they are and of themselves: any two sets that share the part `similarity` have one of
    these in common. The key of an empty set is 0. frequent: sorted hashes and how often they were seen."""
    if not len(h):
        return np.zeros(1, np.uint64)
    known, seen = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        h = h[np.argsort(np.where(known[at] == h, seen[at], 0), kind="stable")]
    return h[: len(h) - int(np.ceil(similarity * len(h) - SPARE)) + 1]


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that one of SAMPLED texts (id, text) hold LISTED times or more, sorted, and how often; the FREQUENT most frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingles(t, words) for t in b.column(0).to_pylist())]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(count, "h bigint, n bigint")
    rows = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LISTED).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h, n = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def parity(h: np.ndarray) -> bytes:
    """A bitmap of a set of hashes, of as many bits as it has members or up to twice as many, PARITY at most: whether the members that fall on a bit are
    odd in number. A member that only one of two sets has changes one bit."""
    n = min(PARITY, 64 << max(0, len(h) - 1 >> 6).bit_length())
    return np.packbits((np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_apart(x: bytes, y: bytes) -> int:
    """Bits in which two parity bitmaps differ, which no more members than that can be in one set alone; the larger is folded to the size of the other."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def not_apart(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, size, bits) of which parity bitmaps don't tell that they share less than the part `similarity`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns[2:]))
            keep = pa.array([(1 + similarity) * parity_apart(x, y) <= (1 - similarity) * (m + n) + SPARE for m, x, n, y in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    side = lambda end, n, x: nodes.select(F.col("node").alias(end), F.col("size").alias(n), F.col("bits").alias(x))
    both = pairs.join(side("a", "m", "x").hint("merge"), "a").join(side("b", "n", "y").hint("merge"), "b")
    return both.select("a", "b", "m", "x", "n", "y").mapInArrow(compare, "a bigint, b bigint")


def told_apart(pairs: DataFrame, nodes: DataFrame, apart: int) -> DataFrame:
    """The pairs (a, b) of nodes whose wide fingerprints w0, w1, ... differ in at most `apart` bits."""
    wide = [f"w{i}" for i in range(WIDE)]
    side = lambda end, x: nodes.select(F.col("node").alias(end), F.array(*wide).alias(x))
    both = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b")
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, b: n + b)
    return both.where(bits <= apart).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) share at least the part `similarity` of their distinct shingles; two without words share
    all. pairs: a saved table; a text that occurs again counts once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, True))
                alike.append(common >= similarity * (len(x) + len(y) - common))
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    to_python(pairs.sparkSession)
    own = saved(texts.dropDuplicates(["node"]).mapInArrow(sets, "node bigint, h binary"))
    side = lambda end, h: own.select(F.col("node").alias(end), F.col("h").alias(h))
    return pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def similar(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, id, root) of every row with a doc_id: id is 16 bytes that tell its text, root a number that names its class. Two texts that share
    a part `similarity` of their shingles or more are linked, and no link is weaker.

    Null and empty texts have one id, and all texts without words are one class. Repeated rows stay. Other columns are ignored. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    to_python(spark)
    marks = [f"v{i}" for i in range(VIEWS)] + ["s"] + [f"w{i}" for i in range(WIDE)]

    def of(text: str, h: np.ndarray) -> np.ndarray:
        own = majority(np.concatenate([h[:, None], mixed(h, WIDE)], 1)) if len(h) else np.zeros(1 + WIDE, np.uint64)
        return np.concatenate([word_fingerprints(text), own])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_pylist()
            sets = [shingles(t, words) for t in own]
            every = np.array([of(t, h) for t, h in zip(own, sets)], np.uint64).reshape(-1, len(marks)).view(np.int64)
            first = pa.array([first_keys(h, frequent, similarity).view(np.int64) for h in sets], pa.list_(pa.int64()))
            cols = [*(np.ascontiguousarray(every[:, i]) for i in range(len(marks))), np.array([len(h) for h in sets], np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols), pa.array([parity(h) for h in sets], pa.binary()), first], ["doc_id", "id", *marks, "size", "bits", "keys"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_id(F.col("text")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    frequent = frequent_shingles(texts, words)
    made = saved(texts.mapInArrow(make, f"doc_id bigint, id binary, {', '.join(f'{m} bigint' for m in marks)}, size bigint, bits binary, keys array<bigint>"))
    nodes = saved(made.groupBy("id").agg(*[F.max(c).alias(c) for c in [*marks, "size", "bits", "keys"]]).withColumn("node", F.monotonically_increasing_id()))

    def exact(pairs: DataFrame) -> DataFrame:
        # Only texts that have a candidate are read again; where these are few, the others aren't shuffled.
        used = saved(nodes.join(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "node", "left_semi").select("id", "node"))
        return verified(pairs, texts.join(used, "id").select("node", "text"), words, similarity)

    near = saved(told_apart(saved(candidates(nodes, radius, most_apart(similarity))), nodes, most_apart(similarity, WIDE * BITS)))
    linked = components(exact(near))
    rooted = saved(nodes.select("node", "size", "keys").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")))
    rest = saved(not_apart(saved(remaining(rooted, similarity)), nodes, similarity))
    linked = components(exact(rest).unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = saved(nodes.select("id", "node").join(linked, "node", "left").select("id", F.coalesce("root", "node").alias("root")))
    return made.select("doc_id", "id").join(rooted.hint("merge"), "id").select("doc_id", "id", "root")


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def deduplicate_similar(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILAR) -> DataFrame:
    """Documents without near-duplicates by shingles, with all their columns: of each class of `similar` one row of the least doc_id stays, the
    one of the least text id where several have it. Rows without a doc_id stay, as no class can name them. An empty table gives no rows."""
    rows = saved(similar(docs, words, similarity).groupBy("doc_id", "id", "root").agg(F.count("*").alias("n")))
    least = saved(rows.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("least")))
    marked = rows.join(least.hint("merge"), "root").select("doc_id", "id", "n", (F.struct("doc_id", "id") == F.col("least")).alias("stays"))
    # Most rows neither go nor are repeated; they are not shuffled where the others are few.
    other = saved(marked.where("not stays or n > 1"))
    id_, key = free(docs, "_id"), free(docs, "_doc")
    mark = other.select(F.col("doc_id").alias(key), F.col("id").alias(id_), "stays")
    named = docs.withColumn(id_, text_id(F.col("text"))).withColumn(key, F.col("doc_id").cast("bigint"))
    single = named.join(mark.drop("stays"), [key, id_], "left_anti")
    once = named.join(mark.where("stays").drop("stays"), [key, id_], "left_semi").dropDuplicates([key, id_])
    return single.select(*docs.columns).unionByName(once.select(*docs.columns))
