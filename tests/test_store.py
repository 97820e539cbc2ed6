"""The store against a plain dict model, and the reading, batch and file operators on hand-made logs."""

import random

import pytest
from ordlog.functions import bloom, coding
from ordlog.operators import batches, compaction, files, reads
from ordlog.operators.batches import WriteBatch
from ordlog.plans.ordering import neighbours, prefix_sum, ranked
from ordlog.plans.store import Store, StoreError
from ordlog.sources import runs
from ordlog.streaming import tail
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store.open(spark, str(tmp_path / "db"))


def test_put_overwrite_delete_and_batch(store):
    store.put("k", "v1")
    store.put("k", "v2")
    assert store.get("k") == "v2" and store.get("none") is None
    store.put("c", "old")
    store.write(WriteBatch().put("a", "1").put("b", "2").delete("c"))
    assert (store.get("a"), store.get("b"), store.get("c")) == ("1", "2", None)
    assert store.write(None) == store.write(WriteBatch()) == store.m.last_seq == 6
    store.put("", "")
    assert store.get("") == ""


def test_snapshot_scan_and_reopen(spark, store, tmp_path):
    for k in "caebd":
        store.put(k, f"v_{k}")
    s = store.snapshot()
    store.put("a", "new")
    assert store.get("a", s) == "v_a" and store.get("a") == "new"
    assert [r.k for r in store.scan().collect()] == list("abcde") and [r.k for r in store.scan(descending=True).collect()] == list("edcba")
    assert [r.k for r in store.scan("b", "d").collect()] == ["b", "c"] and store.seek("bb").first().k == "c"
    again = Store.open(spark, str(tmp_path / "db"))
    assert again.get("c") == "v_c" and again.m.last_seq == 6
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "db"), error_if_exists=True)
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "db"), comparator="other")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "none"), create_if_missing=False)


def test_of_two_writers_one_fails(spark, store, tmp_path):
    other = Store.open(spark, str(tmp_path / "db"))
    store.put("a", "1")
    with pytest.raises(Exception, match="exist"):
        other.put("a", "2")
    assert Store.open(spark, str(tmp_path / "db")).get("a") == "1"


def test_flush_and_compaction_change_nothing_that_is_seen(spark, tmp_path):
    rnd, model, pinned = random.Random(1), {}, {}
    db = Store.open(spark, str(tmp_path / "db"), max_file=2000)
    for step in range(6):
        b = WriteBatch()
        for _ in range(40):
            k = f"{rnd.randrange(30):03d}"
            if rnd.random() < 0.3:
                b.delete(k)
                model.pop(k, None)
            else:
                v = f"v{rnd.randrange(1000)}"
                b.put(k, v)
                model[k] = v
        db.write(b)
        if step in (1, 3):
            pinned[db.snapshot()] = dict(model)
        db.flush()
        if step == 4:
            db.compact_step()
    seen = lambda s=None: {r.k: r.v for r in db.scan(snapshot=s).collect()}
    assert seen() == model and all(seen(s) == m for s, m in pinned.items())
    db.compact_range("005", "010")
    assert seen() == model and all(seen(s) == m for s, m in pinned.items())
    for s in list(pinned):
        db.release(s)
    db.compact_range()
    assert seen() == model and sum(f["deletes"] for f in db.m.files) == 0 and sum(f["entries"] for f in db.m.files) == len(model)
    assert db.collect_garbage() and seen() == model and db.property("num-files-at-level0") == "0"
    assert db.property("num-files-at-level99") is None and db.property("x") is None and len(db.property("stats").split("\n")) == 7
    assert db.approximate_offset("zzz") == sum(f["bytes"] for f in db.m.files)
    assert db.get("000") == model.get("000")


def log(spark, *rows):
    return spark.createDataFrame(rows, "k string, seq long, op int, v string")


def test_compaction_keeps_what_snapshots_see(spark):
    rnd = random.Random(4)
    rows = [(f"k{rnd.randrange(9)}", i, int(rnd.random() < 0.7), f"v{i}") for i in range(1, 120)]
    df = log(spark, *rows)
    want = lambda s: sorted(map(tuple, reads.visible(df, s).collect()))
    for snaps in ((), (40,), (30, 70)):
        for out in (compaction.keep(df, snaps), compaction.compact(df, snaps)):
            out = out.select("k", "seq", "op", "v")
            for s in (*snaps, None):
                assert sorted(map(tuple, reads.visible(out, s).collect())) == want(s)


def test_merge_keeps_duplicates(spark):
    a, b, c = (log(spark, *[(k, 1, 1, "") for k in ks]) for ks in ("ab", "bc", "ac"))
    assert [r.k for r in reads.merge(a, b, c).collect()] == list("aabbcc")


def test_order_without_a_global_window(spark):
    df = spark.createDataFrame([(f"{i:04d}",) for i in range(0, 3000, 3)], "k string").repartition(5)
    assert [(r.k, r.rn) for r in ranked(df, "k").orderBy("rn").collect()] == [(f"{i:04d}", n + 1) for n, i in enumerate(range(0, 3000, 3))]
    got = {r.k: (r.prev_k, r.next_k) for r in neighbours(df, "k").collect()}
    assert got["0000"] == (None, "0003") and got["1500"] == ("1497", "1503") and got["2997"] == ("2994", None)
    assert ranked(df.limit(0), "k").collect() == []
    s = prefix_sum(spark.range(10), F.expr("id div 4"), [F.col("id")], F.col("id"), "s")
    assert [r.s for r in s.orderBy("id").collect()] == [sum(range(i)) for i in range(10)]


def test_bloom_misses_no_key(spark):
    made = spark.range(1000).select(F.concat(F.lit("insert-"), "id").alias("k"))
    b = bloom.build(made, "k", 1000)
    assert bloom.may_match(made, "k", b).count() == 1000
    assert bloom.may_match(spark.range(10000).select(F.concat(F.lit("query-"), "id").alias("k")), "k", b).count() < 200


def test_codecs(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    for x, n in ((0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2**63 - 1, 9)):
        assert one(coding.varint_length(F.lit(x))) == n
    assert one(coding.fixed_le(F.lit(258), 4)) == "02010000"
    assert one(coding.shortest_separator(F.lit("abc1"), F.lit("abe"))) == "abd" and one(coding.shortest_separator(F.lit("ab"), F.lit("abc"))) == "ab"
    assert one(coding.short_successor(F.lit("\x7fa"))) == "\x7fb"
    assert coding.successor("ab") == "ac" and coding.successor("") is None and coding.successor(b"a\xff") == b"b" and coding.successor(b"\xff") is None
    assert one(coding.crc_unmask(coding.crc_mask(F.lit(123456789)))) == 123456789


def test_batches_and_files(spark):
    b = WriteBatch().put("a", "1").delete("b")
    assert b.count() == 2 and b.clear().count() == 0
    assert batches.greedy_groups([5, 5, 20, 1, 1], 10) == [0, 0, 1, 2, 2]
    f = spark.createDataFrame([(0, 1, "a", "c", 1, 0, 9, 1), (0, 2, "b", "e", 1, 0, 9, 2), (0, 3, "d", "f", 1, 0, 9, 3), (0, 4, "x", "z", 1, 0, 9, 4)], "level int, file_no long, smallest string, largest string, entries long, deletes long, bytes long, max_seq long")
    assert sorted(r.file_no for r in files.closure(f, 1).collect()) == [1, 2, 3] and files.flush_level(f, "a", "b") == 0 and files.flush_level(f, "g", "h") == 2


def test_tail_follows_the_log(spark, tmp_path):
    for i in range(3):
        runs.write_wal(log(spark, ("a", i + 1, i % 2, f"v{i}"), (f"k{i}", 10 + i, 1, "x")), str(tmp_path / f"wal/{i}"))
    q = tail.latest(tail.tail(spark, str(tmp_path / "wal/*"))).writeStream.format("memory").queryName("t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: (r.seq, r.op) for r in spark.table("t").collect()} == {"a": (3, 0), "k0": (10, 1), "k1": (11, 1), "k2": (12, 1)}
