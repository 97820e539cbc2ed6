"""Edits, keys of bytes, key orders, exact cuts, picking and byte codecs, against plain versions of the rules."""

import random
import zlib

import pytest
from ordlog.functions import bloom, coding, order
from ordlog.operators import compaction, cuts, files, picking
from ordlog.operators.batches import WriteBatch
from ordlog.plans.store import Store, StoreError
from ordlog.sources import edits, manifest
from ordlog.sources.cache import TableCache
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_edit_bytes():
    e = edits.Edit("bytewise", 42, 100, 999, {1: b"ptr"}, [(0, 10)], [(1, 42, 1024, b"aaa", b"zzz")])
    assert edits.decode(edits.encode(e)) == e and edits.decode(b"") == edits.Edit()
    assert edits.encode(edits.Edit(log_number=300)) == b"\x02\xac\x02"
    assert edits.decode(edits.encode(edits.Edit(last_seq=7)) + b"\x63junk") == edits.Edit(last_seq=7)
    with pytest.raises(IndexError):
        edits.decode(b"\x01\x05ab")


def test_manifest_is_a_log_of_edits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT", 3)
    root, states = str(tmp_path / "db"), []
    m = None
    for i in range(8):
        new = m.copied() if m else manifest.Manifest()
        new.last_seq += i
        new.files.append({"level": i % 2, "file_no": i, "smallest": bytes([i]), "largest": b"\xff", "bytes": i})
        if i > 4:
            new.files = [f | {"level": 3} if f["file_no"] == 1 else f for f in new.files if f["file_no"] != 2]
            new.pointers["1"] = b"\x00\xff"
        e = manifest.as_edit(m or manifest.Manifest(), new)
        assert edits.decode(edits.encode(e)) == e and len(e.new) >= 1
        m = manifest.commit(spark, root, new, m)
        states.append(m.copied())
    assert manifest.load(spark, root) == m and all(manifest.load(spark, root, s.version) == s for s in states)
    small = (tmp_path / "db/manifest/000000000005.edit").read_text()
    assert '"+files"' in small and len(small) < 200  # what changed, not all files
    manifest.forget(spark, root, 5)
    assert manifest.versions(spark, root) == [5, 6, 7, 8] and manifest.load(spark, root) == m and manifest.load(spark, root, 5) == states[4]


def test_keys_of_bytes(spark, tmp_path):
    db = Store.open(spark, str(tmp_path / "db"), binary=True, max_file=200)
    model, rnd = {}, random.Random(2)
    for _ in range(3):
        b = WriteBatch()
        for _ in range(30):
            k, v = bytes(rnd.choices([0, 1, 97, 127, 128, 255], k=rnd.randrange(4))), bytes(rnd.choices(range(256), k=20))
            b.put(k, v)
            model[k] = v
        db.write(b)
        db.flush()
    db.put(b"\xff\xfe", b"")
    model[b"\xff\xfe"] = b""
    got = lambda df: [(bytes(r.k), bytes(r.v)) for r in df.collect()]
    assert got(db.scan()) == sorted(model.items()) and all(db.get(k) == v for k, v in list(model.items())[:2]) and db.get(b"\x05") is None
    assert db.get(b"") == model.get(b"") and got(db.prefix(b"\xff")) == sorted((k, v) for k, v in model.items() if k[:1] == b"\xff")
    db.compact_range(b"\x00", b"\x80")
    assert got(Store.open(spark, str(tmp_path / "db"), binary=True).scan(b"\x01", b"\xff")) == sorted((k, v) for k, v in model.items() if b"\x01" <= k < b"\xff")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "db"))
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "other"), comparator="unknown")


def test_orders(spark, tmp_path):
    db = Store.open(spark, str(tmp_path / "n"), comparator=order.decimal())
    db.write(WriteBatch().put("10", "a").put("9", "b").put("0", "c").delete("9").put("100", "d"))
    assert [r.k for r in db.scan().collect()] == ["0", "10", "100"] and db.get("10") == "a" and db.seek("11").first().k == "100"
    db.flush()
    assert [r.k for r in db.scan("5", "100").collect()] == ["10"] and [r.k for r in Store.open(spark, str(tmp_path / "n"), comparator="decimal-20").scan(descending=True).collect()] == ["100", "10", "0"]
    with pytest.raises(StoreError):
        db.prefix("1")
    back = Store.open(spark, str(tmp_path / "r"), comparator="reverse", binary=True)
    keys = [b"", b"a", b"ab", b"b", b"\xff", b"\x00"]
    for k in keys:
        back.put(k, k)
    assert [bytes(r.k) for r in back.scan().collect()] == sorted(keys, reverse=True) and back.get(b"ab") == b"ab"
    for c in (order.decimal(), order.reverse()):
        for k in keys[1:] if c.name == "reverse" else ["7", "0", "123"]:
            assert c.given(c.stored(k)) == k


def test_writers_are_held_up_and_levels_take_turns(spark, tmp_path, monkeypatch):
    db = Store.open(spark, str(tmp_path / "db"), write_buffer=1)
    monkeypatch.setattr("ordlog.plans.store.L0_STOP", 3)
    for i in range(6):
        db.write(WriteBatch().put("a", str(i)).put("z", str(i)))
    assert db.get("a") == "5" and len([f for f in db.m.files if f["level"] == 0]) <= 3
    flushed = Store.open(spark, str(tmp_path / "f"))
    flushed.put("a", "1")
    flushed.flush()
    assert [f["level"] for f in flushed.m.files] == [2]  # nothing in its way
    flushed.put("a", "2")
    flushed.flush()
    assert sorted(f["level"] for f in flushed.m.files) == [1, 2]
    # A lookup that has to look into two files is counted against the first, which is compacted when it has had too many.
    assert not flushed.compact_step()
    assert flushed.get("a") == "2" and flushed.sought["level"] == 1 and flushed.compact_step() and flushed.sought is None
    assert [f["level"] for f in flushed.m.files] == [2] and flushed.get("a") == "2" and flushed.m.pointers == {"1": "a"}


def plain_files(rnd, n):
    out = []
    for level in range(4):
        edges = sorted(rnd.sample(range(200), 12))
        for i in range(0, 12, 2):
            lo, hi = (edges[i], edges[i + 1]) if level else sorted(rnd.sample(range(200), 2))
            out.append({"level": level, "file_no": len(out) + 1, "path": str(len(out)), "smallest": f"{lo:03d}", "largest": f"{hi:03d}", "bytes": rnd.randrange(1, n), "entries": 1, "deletes": 0, "max_seq": 1})
    return out


def test_picking(spark):
    rnd = random.Random(3)
    own = plain_files(rnd, 5 << 20)
    columns = "level int, file_no long, smallest string, largest string, entries long, deletes long, bytes long, max_seq long"
    df = spark.createDataFrame([tuple(f[c.split()[0]] for c in columns.split(", ")) for f in own], columns)
    roles = lambda p: sorted([("input", f["file_no"]) for f in p.inputs] + [("parent", f["file_no"]) for f in p.parents] + [("grandparent", f["file_no"]) for f in p.grandparents])
    for level, after in ((0, None), (1, None), (1, "100"), (2, "199")):
        one = [f for f in own if f["level"] == level]
        pointers = {} if after is None else {str(level): after}
        picked = picking.pick([f | {"bytes": 11 << 20 if f["level"] == level and level else 1} for f in one] + [f | {"bytes": 1} for f in own if f["level"] not in (level, 0)], pointers) if level else picking.pick([f | {"bytes": 1} for f in own], {})
        if level != 2:
            assert roles(picked) == sorted(map(tuple, files.pick(df, level, after).collect()))
    assert picking.pick([f | {"bytes": 1} for f in own if f["level"]], {}) is None
    sought = next(f for f in own if f["level"] == 2)
    assert picking.pick([f | {"bytes": 1} for f in own if f["level"]], {}, sought).inputs == [sought]
    ranges = [(f"{a:03d}", f"{a + w:03d}") for a in range(0, 250, 7) for w in (0, 3, 20)]
    deep = df.where("level > 0")
    got = {(r.lo, r.hi): r.level for r in files.flush_levels(deep, spark.createDataFrame(ranges, "lo string, hi string")).collect()}
    assert got == {r: picking.flush_level([f for f in own if f["level"]], *r) for r in ranges} and len(set(got.values())) > 1
    keys = spark.createDataFrame([(f"{i:03d}",) for i in range(210)], "k string")
    want = sorted((f"{i:03d}", f["level"], f["file_no"]) for i in range(210) for f in own if f["level"] and f["smallest"] <= f"{i:03d}" <= f["largest"])
    assert sorted(map(tuple, files.located(keys, df).collect())) == want
    want = sorted(f"{i:03d}" for i in range(210) if any(f["smallest"] <= f"{i:03d}" <= f["largest"] for f in own if f["level"] == 3))
    assert sorted(r.k for r in compaction.covered(keys, df.where("level = 3").select("smallest", "largest")).collect()) == want
    assert compaction.covered(keys, df.limit(0).select("smallest", "largest")).count() == 0


def plain_cuts(sizes, width, whole):
    out, group, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i and (held + n > width if whole else held > width) and held:
            group, held = group + 1, 0
        held += n
        out.append(group)
    return out


def test_exact_cuts(spark):
    rnd = random.Random(5)
    for whole in (False, True):
        for sizes in ([1], [500] * 5, [rnd.randrange(1, 30) for _ in range(400)], [rnd.choice([1, 2, 900]) for _ in range(200)]):
            rows, at = [], 0
            for i, n in enumerate(sizes):
                rows.append((i, at, n))
                at += n
            df = spark.createDataFrame(rows, "i int, cum long, n long").repartition(3)
            for span in (1, 32):
                got = {r.i: r.g for r in cuts.greedy(df, "cum", "n", "g", 100, whole, span).collect()}
                assert [got[i] for i in range(len(sizes))] == plain_cuts(sizes, 100, whole), (whole, span, sizes[:5])
    assert cuts.greedy(df.limit(0), "cum", "n", "g", 100).collect() == []


def test_table_cache():
    opened = []
    c = TableCache(2, lambda p: opened.append(p) or p)
    assert [c.get(p) for p in "abacab"] == list("abacab") and opened == ["a", "b", "c", "b"]
    c.evict("a")
    c.get("a")
    assert opened[-1] == "a" and len(c.held) == 2


def plain_hash(data, seed):
    m, h = 0xC6A4A793, seed ^ len(data) * 0xC6A4A793 & 0xFFFFFFFF
    for i in range(0, len(data) - len(data) % 4, 4):
        h = (h + int.from_bytes(data[i : i + 4], "little")) * m & 0xFFFFFFFF
        h ^= h >> 16
    if len(data) % 4:
        h = (h + int.from_bytes(data[len(data) - len(data) % 4 :], "little")) * m & 0xFFFFFFFF
        h ^= h >> 24
    return h


def test_bytes_and_hashes(spark):
    rnd = random.Random(6)
    data = [bytes(rnd.choices(range(256), k=k)) for k in range(12)] + [b"\xff" * 5, b"\x00"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "i int, x binary")
    got = {r.i: r for r in df.select("i", coding.hash32(F.col("x")).alias("h"), coding.hash32(F.col("x"), 7).alias("h7"), coding.checksum(F.col("x")).alias("c"), coding.checksum(F.col("x"), F.lit(0x01020304)).alias("c2"), coding.successor_bytes(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(data):
        assert (got[i].h, got[i].h7, got[i].c, got[i].c2) == (plain_hash(x, 0xBC9F1D34), plain_hash(x, 7), zlib.crc32(x), zlib.crc32(b"\x04\x03\x02\x01" + x))
        cut = len(x) - len(x.lstrip(b"\xff"))
        assert bytes(got[i].s) == (x if cut == len(x) else x[:cut] + bytes([x[cut] + 1]))
    one = lambda e: spark.range(1).select(e).first()[0]
    for a, b, want in ((b"abc1", b"abe", b"abd"), (b"ab", b"abc", b"ab"), (b"\xc3\x01", b"\xc5", b"\xc4"), (b"a", b"b", b"a"), (b"", b"x", b""), (b"\xff", b"\xff", b"\xff")):
        assert bytes(one(coding.separator_bytes(F.lit(a), F.lit(b)))) == want
    for n in (0, 1, 127, 128, 16383, 16384, 2**31, 2**63 - 1, -1, -(2**63)):
        v = one(coding.varint(F.lit(n)))
        assert bytes(v) == edits._varint(n & (1 << 64) - 1) and one(coding.varint_decode(F.lit(bytes(v))))["value"] == n
        assert one(coding.fixed_decode(F.unhex(coding.fixed_le(F.lit(n))))) == n
    assert one(coding.varint_decode(F.lit(b"\x80"))) is None and one(coding.fixed_decode(F.lit(b"\xff\xff\xff\xff"), 4)) == 0xFFFFFFFF
    got = one(coding.length_prefixed_decode(F.concat(F.lit(b"x"), coding.length_prefixed(F.lit(b"y" * 200))), 1))
    assert bytes(got["value"]) == b"y" * 200 and got["next"] == 203
    for f, known in ((coding.record_type, 4), (coding.value_type, 1)):
        assert one(f(F.lit(known)))
        with pytest.raises(PySparkException):
            one(f(F.lit(known + 1)))


def test_filters_by_file(spark):
    rows = [(i % 7, f"k{i}") for i in range(300)] + [(99, "")]
    df = spark.createDataFrame(rows, "f int, k string")
    made = bloom.build(df, "k", by="f")
    sizes = {r.f: (len(r.filter), r.filter[-1]) for r in made.collect()}
    assert sizes[99] == (9, 6) and sizes[0] == ((max(64, 43 * 10) + 7) // 8 + 1, 6)
    probe = df.select("f", "k").join(made, "f")
    assert probe.where(bloom.might_contain(F.col("filter"), F.col("k"))).count() == len(rows)
    other = spark.createDataFrame([(i % 7, f"q{i}") for i in range(2000)], "f int, k string").join(made, "f")
    assert other.where(bloom.might_contain(F.col("filter"), F.col("k"))).count() < 60
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(bloom.might_contain(F.lit(b"\x06"), F.lit("x"))) is False and one(bloom.might_contain(F.lit(b"\x00" * 8 + b"\x1f"), F.lit("x"))) is True
