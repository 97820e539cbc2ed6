import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ordlog.llm import packing, sharding, token_counts
from ordlog.llm.common import table
from ordlog.llm.tokens import Encoder, default_path, encoder

SF = "/root/testdata/sf0.01"
ODD = ["İstanbul ΑΣ x̧ é naïve's can't 12 a1b2 …—! 日本語 <|endoftext|> a\x1cb \x1f ​q ﬁ Ǆ", "", None, "🎉🎉 !!'s it's''s", "a b　c\u0085d", "  lead \n\n trail  ", "word " * 9000]


def test_ids_are_the_tokenizers_own(spark):
    texts = [r[0] for r in table(spark, SF, "documents").select("text").collect()] + ODD
    e = encoder(default_path())
    flat, at = e.batch(pa.array(texts, pa.string()))
    assert e.fast
    for t, lo, hi in zip(texts, at, at[1:]):
        assert flat[lo:hi].tolist() == e.whole.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    e = encoder(default_path())
    flat, at = e.batch(pa.array(texts, pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [e.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_cache_is_bounded():
    e = Encoder(default_path())
    long = ["a" * 300_000, "ab1" * 50_000, "日本" * 20_000]
    flat, at = e.batch(pa.array([" ".join(["x", t, "x"]) for t in long], pa.string()))
    assert set(e.cache) == {"x"}
    for t, lo, hi in zip(long, at, at[1:]):
        assert flat[lo:hi].tolist() == e.whole.encode(f"x {t} x", add_special_tokens=False).ids


def checked(rows, texts, capacity=4096):
    """Every piece is there once with its ids; sequences are gapless and not too long. The number of sequences."""
    e, own, seqs = encoder(default_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for k, t in texts.items():
        ids = np.array([*e.whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(own.pop(k), key=lambda r: r.piece)
        assert [r.start for r in got] == list(range(0, len(ids), capacity)) and [r.piece for r in got] == list(range(len(got)))
        for r in got:
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    assert not own
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


def test_packing_of_the_whole_table(spark):
    df = table(spark, SF, "documents")
    rows = packing.pack(df).collect()
    n = checked(rows, {r.doc_id: r.text for r in df.collect()})
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_of_odd_rows(spark, docs):
    rows = packing.pack(docs(*enumerate(ODD))).collect()
    checked(rows, dict(enumerate(ODD)))
    assert len(packing.pack(docs((1, "a b"), (1, "a b"), (None, None))).collect()) == 3
    assert packing.pack(docs((1, "")).limit(0)).collect() == []


def least_bins(sizes, capacity):
    """Brute force: the least number of bins."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bins_hold_every_piece_and_are_few(sizes):
    counts = {n: sizes.count(n) for n in set(sizes)}
    bins = packing.minimum_bin_slack(counts, 12)
    held = defaultdict(int)
    for b, times in bins:
        assert times > 0 and sum(n * k for n, k in b.items()) <= 12
        for n, k in b.items():
            held[n] += k * times
    assert held == counts
    assert sum(t for _, t in bins) <= least_bins(sorted(sizes, reverse=True), 12) + 1


def test_histogram_against_brute_force(spark, docs):
    texts = [r.text for r in table(spark, SF, "documents").collect()] + ODD
    e = encoder(default_path()).whole
    n = [len(e.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = token_counts.histogram(docs(*enumerate(texts)))
    got = {r.length: r for r in rows.collect()}
    assert set(got) == set(n)
    for k, r in got.items():
        assert (r.docs, r.tokens) == (n.count(k), k * n.count(k))
        assert (r.docs_from, r.tokens_from) == (sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert r.truncated_tokens == sum(min(x, k) for x in n)
        assert r.share_up_to == pytest.approx(sum(x <= k for x in n) / len(n))
    a = token_counts.at_limit(rows, 500).first()
    assert a.kept_tokens == sum(min(x, 500) for x in n) and a.docs_over == sum(x > 500 for x in n)
    assert token_counts.quantile(rows, 0.5) == sorted(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(docs((1, "x")).limit(0)).collect() == []


def test_lookup_table_by_hand():
    """Turn by turn, with plain lists of preferences."""
    import xxhash

    shards, m = ["a", "b", "c"], 13
    prefer = [[(xxhash.xxh64_intdigest(s, 1) + j * (xxhash.xxh64_intdigest(s, 2) % (m - 1) + 1)) % m for j in range(m)] for s in shards]
    owner = {}
    while len(owner) < m:
        for i, p in enumerate(prefer):
            free = [x for x in p if x not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.lookup_table(shards, m) == [owner[i] for i in range(m)]


def test_shards_are_even_and_stable(spark, docs):
    names = [f"s{i}" for i in range(10)]
    full, less = sharding.lookup_table(names), sharding.lookup_table(names[:-1])
    share = np.bincount(full)
    assert share.max() - share.min() <= 1
    moved = sum(a != b for a, b in zip(full, less) if a != 9) / len(full)
    assert moved < 0.1
    rows = sharding.assign(docs((1, "x"), (1, "y"), (None, None), (2, "")), "doc_id", names).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 1}) == 1 and all(r.shard in names for r in rows)
    assert sharding.assign(docs((1, "x")).limit(0), "doc_id", names).collect() == []
    clash = spark.createDataFrame([("mine", "a", 5), ("mine", "b", 6)], "Slot string, SHARD string, _at int")
    out = sharding.assign(clash, "SHARD", names)
    assert out.columns == ["_at", "slot", "shard"] and {r["_at"]: r.slot for r in out.collect()} == {i: plain_slot(k) for k, i in (("a", 5), ("b", 6))}


def plain_slot(key):
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS


def test_slots_of_the_whole_table(spark):
    """Every row's slot by the hash itself, and its shard by the table; shares are as equal as the slots allow."""
    names = [f"shard-{i:03d}" for i in range(128)]
    owner = sharding.lookup_table(names)
    df = table(spark, SF, "documents")
    got = sharding.assign(df.select("doc_id"), "doc_id", names).collect()
    assert len(got) == df.count() and all(r.slot == plain_slot(str(r.doc_id)) and r.shard == names[owner[r.slot]] for r in got)
    assert max(owner.count(i) for i in range(128)) - min(owner.count(i) for i in range(128)) <= 1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])
