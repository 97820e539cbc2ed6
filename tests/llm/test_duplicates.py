import random
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ordlog.llm import components, decontamination, language_id, line_dedup, simhash
from ordlog.llm.common import saved, table

SF = "/root/testdata/sf0.01"


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, None)], [(0, i) for i in range(1, 50)] + [(99, 100), (100, 99)], [(i, 1000 - i) for i in range(20)] + [(1000 - i, i + 1) for i in range(20)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == roots({x for e in real for x in e}, real)


@pytest.mark.parametrize("name", ["chain", "backwards", "comb", "star", "zigzag", "hubs"])
def test_components_take_few_rounds(spark, monkeypatch, name):
    """Graphs that take a contraction without jumps as many rounds as they have nodes, or that have one large hub."""
    n = 10_000 if name == "chain" else 3000
    edges = {
        "chain": [(i, i + 1) for i in range(n)],
        "backwards": [(n - i, n - i - 1) for i in range(n)],
        "comb": [(i, i + 1) for i in range(n // 2)] + [(i, n + i) for i in range(n // 2)],
        "star": [(n, i) for i in range(n)],
        "zigzag": [(i, n + i) for i in range(n // 2)] + [(n + i, i + 1) for i in range(n // 2)],
        "hubs": [(10 * n + i % 50, i) for i in range(n)] + [(10 * n + i, 10 * n + i + 1) for i in range(49)],
    }[name]
    saves, keep = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df: saves.append(1) or keep(df))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)
    assert len(saves) <= 40


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    for n in (300,):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * 0.7))]
        got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        real = [(a, b) for a, b in edges if a != b]
        assert got == roots({x for e in real for x in e}, real)


def plain_fingerprint(text, words=4):
    """Character by character, as the rule says."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            w, cur = (w + [cur], "") if cur else (w, "")
        else:
            cur += c
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbB \n\t\x1cé\u0085", max_size=60) | st.none())
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    assert len(masks) == 31 and all(m.bit_count() == 32 for m in masks)
    rnd = random.Random(3)
    for _ in range(5000):
        diff = sum(1 << i for i in rnd.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)


def brute(rows, radius=4):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    edges = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1]
    return fps, roots(ids, edges)


def test_near_duplicates_of_the_whole_table(spark):
    df = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps, root = brute(rows)
    got = simhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {i: (fps[i], root[i]) for i, _ in rows}
    assert len(set(root.values())) < len(rows)
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == set(root.values())


def test_blocks_lose_no_link(spark):
    rnd = np.random.default_rng(5)
    centre = rnd.integers(-(2**63), 2**63 - 1, 6)
    fps = {int(c ^ np.int64(sum(1 << int(i) for i in rnd.choice(62, rnd.integers(0, 6), False)))) for c in centre for _ in range(60)}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (4, 4096):
        got = simhash.links(nodes, 4, block).collect()
        assert roots(fps, [(r.a, r.b) for r in got]) == want


def test_odd_documents(spark, docs):
    long = "w%d " * 4000 % tuple(range(4000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "One two three four five six"), (1, "ONE two three four five six"), (9, long), (8, long + " x"), (None, "solo text here now ok"), (7, "a b c d"), (7, "e f g h"), (7, "a b c d")]
    got = simhash.near_duplicates(docs(*rows)).collect()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert len(got) == 11 and by[(5, 0)] == by[(4, 0)] == by[(3, 0)] == 3
    assert len({v for k, v in by.items() if k[0] in (1, 2)}) == 1 and len({v for k, v in by.items() if k[0] in (8, 9)}) == 1
    kept = simhash.deduplicate(docs(*rows))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, rows[7][1]), (1, rows[4][1]), (3, " \n"), (7, "a b c d"), (7, "e f g h"), (8, long + " x")])
    assert kept.columns == docs(*rows).columns
    assert simhash.near_duplicates(docs((1, "x")).limit(0)).collect() == []


def jaccard_roots(rows, words=5, similarity=0.8):
    """Classes of texts by all pairs of shingle sets."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    has = {}
    for i, s in sets.items():
        for x in s or {None}:
            has.setdefault(x, []).append(i)
    common = {}
    for own in has.values():
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    edges = [(a, b) for (a, b), n in common.items() if not sets[a] or n >= similarity * (len(sets[a]) + len(sets[b]) - n)]
    return roots(list(sets), edges), edges


def test_similar_texts_of_the_whole_table(spark):
    df = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, edges = jaccard_roots(rows)
    got = simhash.similar(df).collect()
    root = {r.doc_id: r.root for r in got}
    texts = dict(rows)
    near = [(a, b) for a, b in edges if texts[a] != texts[b]]
    assert len(got) == len(rows) and len(near) > 10
    assert np.mean([root[a] == root[b] for a, b in near]) >= 0.97 and all(root[a] == root[b] for a, b in edges if texts[a] == texts[b])
    by = {}
    for i, r in root.items():
        by.setdefault(r, set()).add(want[i])
    assert all(len(x) == 1 for x in by.values())  # no class holds more than a class of all pairs
    kept = {r.doc_id for r in simhash.deduplicate_similar(df).collect()}
    least = {}
    for i, r in root.items():
        least[r] = min(i, least.get(r, i))
    assert kept == set(least.values()) and set(want.values()) <= kept


def test_large_groups_of_near_copies(spark, docs):
    """A group of more than SMALL texts, each with words of its own, and one of more than a block."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]
    copies = [(i, " ".join(w if rnd.random() > 0.004 else f"x{rnd.randrange(9**9)}" for w in base)) for i in range(300)]
    other = [(1000 + i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))) for i in range(200)]
    want, _ = jaccard_roots(copies + other)
    assert len({want[i] for i, _ in copies}) == 1 and len(set(want.values())) == 201
    assert {r.doc_id for r in simhash.deduplicate_similar(docs(*copies, *other)).collect()} == set(want.values())
    rows = [(i, 0, -1 - i, (1 << i % 20) - 1) for i in range(300)]
    nodes = spark.createDataFrame(rows, "node long, v0 long, v1 long, s long")
    for block in (40, 4096):
        pairs = [(r.a, r.b) for r in simhash.candidates(nodes, 4, 3, block).collect()]
        assert len(set(roots(range(300), pairs).values())) == 1 and len(pairs) < 300 * 299 / 8


def test_no_similar_pair_is_left_out(spark, docs):
    """Short texts, whose fingerprints lie far apart, and a dense group about the least similarity, where most links of a forest are too weak."""
    rnd = random.Random(4)
    rows = []
    for k in range(150):
        base = [f"w{k}.{i}" for i in range(rnd.randrange(5, 31))]
        rows += [base, base + ["more"], ["front"] + base, base[:-1] + ["end"]]
    base = [f"b{i}" for i in range(400)]
    for k in range(120):
        changed = set(rnd.sample(range(400), rnd.randrange(3, 8)))
        rows.append([f"x{k}.{i}" if i in changed else w for i, w in enumerate(base)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want, edges = jaccard_roots(rows)
    got = {r.doc_id: r.root for r in simhash.similar(docs(*rows)).collect()}
    assert len(edges) > 500 and 150 < len(set(want.values())) < len(rows) - 200
    least = {}
    for i, r in got.items():
        least[r] = min(i, least.get(r, i))
    assert {i: least[r] for i, r in got.items()} == want


def test_remaining_pairs_of_unlike_roots(spark):
    """All similar pairs of unlike roots are found, whatever the blocks and the order of shingles, and parity bitmaps tell none of them apart."""
    rnd = np.random.default_rng(6)
    pool = [np.unique(rnd.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in (1, 3, 5, 40, 300, 2000)]
    sets = [np.zeros(0, np.uint64)] * 3 + [x[rnd.random(len(x)) < 0.93] for x in pool for _ in range(90)]
    roots_ = [i % 7 if i % 2 else i for i in range(len(sets))]
    alike = lambda x, y: (n := len(np.intersect1d(x, y, True))) >= 0.8 * (len(x) + len(y) - n)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if roots_[a] != roots_[b] and alike(sets[a], sets[b])}
    assert len(want) > 2000 and all(1.8 * simhash.parity_apart(*map(simhash.parity, (sets[a], sets[b]))) <= 0.2 * (len(sets[a]) + len(sets[b])) + 1e-6 for a, b in want)
    h = np.sort(np.concatenate([x[::3] for x in pool]))
    for block, frequent in ((4096, (h[:0], h[:0])), (16, (h, rnd.integers(3, 9, len(h))))):
        rows = [(i, roots_[i], len(x), simhash.first_keys(x, frequent, 0.8).view(np.int64).tolist(), simhash.parity(x)) for i, x in enumerate(sets)]
        nodes = saved(spark.createDataFrame(rows, "node long, root long, size long, keys array<long>, bits binary"))
        pairs = saved(simhash.remaining(nodes, 0.8, block))
        got = [(r.a, r.b) for r in pairs.collect()]
        assert len(got) == len(set(got)) and want <= set(got) and all(roots_[a] != roots_[b] for a, b in got)
        assert want <= {(r.a, r.b) for r in simhash.not_apart(pairs, nodes, 0.8).collect()}


def test_forests_of_groups():
    """Small and large groups, with many near pairs and few, join what all pairs join."""
    rnd = np.random.default_rng(7)
    for n in (2, 60, 300, 700):
        centre = rnd.integers(0, 1 << 63, 12).astype(np.uint64)
        fp = np.array([centre[k] ^ np.uint64(1 << int(rnd.integers(0, 60))) for k in rnd.integers(0, 12, n)], np.uint64)
        wide = np.array([np.uint64((1 << int(k)) - 1) for k in rnd.integers(0, 40, n)], np.uint64)
        every = [(a, b) for a in range(n) for b in range(a + 1, n) if int(fp[a] ^ fp[b]).bit_count() <= 4 and int(wide[a] ^ wide[b]).bit_count() <= 2]
        want = roots(range(n), every)
        pairs = simhash.near_pairs(fp, wide, 4, 2)
        assert pairs is None or {(a, b) for _, a, b in pairs.tolist()} == set(every)
        if pairs is not None:
            assert roots(range(n), simhash.joined(pairs)) == want
        assert roots(range(n), list(simhash.spanning(fp, wide, 4, 2))) == want


def test_odd_texts_among_similar_ones(spark, docs):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "One two three"), (1, "ONE two\tthree"), (9, long), (8, long + " x"), (None, "solo"), (None, "solo"), (7, "a b c d e f"), (7, "u v w x y z"), (7, "a b c d e f"), (6, "| | |"), (10, "| | | |")]
    df = docs(*rows).selectExpr("*", "1 as id", "2 as root", "3 as _id", "4 as _doc", "5 as fp", "6 as stays")
    out = simhash.deduplicate_similar(df)
    assert out.columns == df.columns and all(r[-6:] == (1, 2, 3, 4, 5, 6) for r in out.collect())
    assert sorted((r.doc_id or 0, (r.text or "")[:11]) for r in out.collect()) == sorted([(0, "solo"), (0, "solo"), (1, "ONE two\tthr"), (3, " \n"), (6, "| | |"), (7, "a b c d e f"), (7, "u v w x y z"), (8, "w0 w1 w2 w3"), (10, "| | | |")])
    assert simhash.deduplicate_similar(df.limit(0)).collect() == []


# lines


def plain_dedup(rows, least=50):
    """Every run of lines of `least` words or more that has occurred before goes: all runs, all pairs."""
    lines = {i: t.split("\n") for i, t in rows}
    count = lambda x: x.count(" ") + x.count("\t") + 1 if x else 0
    seen, gone = {}, {i: set() for i in lines}
    for i in sorted(lines):
        n = [count(x) for x in lines[i]]
        for a in range(len(n)):
            total = 0
            for b in range(a, len(n)):
                total += n[b]
                if total < least:
                    continue
                if total - n[a] < least or total - n[b] < least:
                    key = tuple(lines[i][a : b + 1])
                    if key in seen and seen[key] != (i, a):
                        gone[i].update(range(a, b + 1))
                    seen.setdefault(key, (i, a))
                else:
                    break
    return {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i in lines}


def test_line_dedup_of_the_whole_table(spark):
    df = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = line_dedup.deduplicate(df).collect()
    assert {r.doc_id: r.text for r in got} == plain_dedup(rows)
    assert any(len(r.text) < len(t) for r, t in zip(sorted(got, key=lambda r: r.doc_id), [t for _, t in sorted(rows)]))
    assert all(r.n_chars == len(r.text) for r in got)


def test_random_lines(spark, docs):
    rnd = random.Random(2)
    pool = [" ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.choice([1, 2, 5, 12, 30]))) for _ in range(12)] + ["", "x\ty"]
    for _ in range(3):
        rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 14)))) for i in range(60)]
        got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs(*rows), 20).collect()}
        assert got == plain_dedup(rows, 20)


def test_least_places():
    rnd = np.random.default_rng(8)
    for n in (1, 2, 7, 300):
        h = rnd.integers(0, 9, n).astype(np.uint64)
        lo = rnd.integers(0, n, 200)
        hi = np.minimum(n - 1, lo + rnd.integers(0, n, 200))
        assert line_dedup.least_places(h, lo, hi).tolist() == [a + int(np.argmin(h[a : b + 1])) for a, b in zip(lo, hi)]


def test_many_blank_lines(spark, docs):
    """A million blank lines in one text take a moment, not their square."""
    head, tail = (" ".join(f"{c}{i}" for i in range(40)) for c in "ht")
    text = head + "\n" * 1_000_000 + tail
    t = time.time()
    got = line_dedup.windows_of(np.concatenate([[5], np.full(999_999, 3), [4]]).astype(np.uint64), np.array([40, *[0] * 999_999, 40]), np.zeros(1_000_001, int), 50)[0]
    assert time.time() - t < 20 and set(got[0].tolist()) == {3}
    few = head + "\n" * 20_000 + tail
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(docs((1, few), (2, "x\n" + few + "\ny"), (3, text)), drop_empty=True).collect()}
    assert out[1] == few and out[2] == "x\ny" and out[3] == text


def test_equal_hashes_of_runs_delete_nothing(spark):
    """Windows that only a hash of their run brought together are held against each other line by line, and true ones grow to both sides."""
    h = lambda text: b"".join(line_dedup.line_hash(c.encode()) for c in text)
    lines = saved(spark.createDataFrame([(1, 0, h("abcdefg")), (2, 0, h("xbcdey")), (3, 0, h("abXdefgabc")), (4, 0, h("q" * 300)), (5, 0, h("zz" + "q" * 300))], "doc long, uid long, h binary"))
    rows = [
        (2, 0, 1, 0, 0, [(2, 3)]), (2, 0, 1, 0, 1, [(2, 3)]), (3, 0, 1, 0, 0, [(1, 2), (3, 4), (5, 5), (2, 2)]), (3, 0, 1, 0, 7, [(8, 8)]),
        (3, 0, 3, 0, 7, [(7, 8)]), (5, 0, 4, 0, 2, [(100, 101), (290, 291)]), (5, 0, 4, 0, 2, [(10, 10)]),
    ]
    found = saved(spark.createDataFrame(rows, "doc long, uid long, xdoc long, xuid long, shift int, seeds array<struct<first:int,last:int>>"))
    got = sorted((r.doc_id, r["first"], r["last"]) for r in line_dedup.extended(found, lines).collect())
    assert got == sorted([(2, 1, 4), (3, 3, 6), (3, 7, 9), (3, 7, 8), (5, 50, 301), (5, 2, 60)])


def test_white_space_of_any_kind_is_nothing(spark, docs):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, passage), (2, f"\n\t\u00a0\n{passage}\n \x1c"), (3, "\n\t")]
    assert {r.doc_id for r in line_dedup.deduplicate(docs(*rows), drop_empty=True).collect()} == {1, 3}


def test_columns_of_any_name_stay(spark, docs):
    passage = " ".join(f"p{i}" for i in range(55))
    df = docs((1, passage), (2, "x\n" + passage), (3, "other words that stay here")).selectExpr("*", "1 as _uid", "2 as _gone", "3 as _hit", "4 as uid", "5 as _key", "6 as fp", "7 as root", "8 as first", "9 as _id")
    extra = tuple(range(1, 10))
    got = {r.doc_id: r for r in line_dedup.deduplicate(df, drop_empty=True).collect()}
    assert {k: r.text for k, r in got.items()} == {1: passage, 2: "x", 3: "other words that stay here"}
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    for out in (line_dedup.deduplicate(df), simhash.deduplicate(df), decontamination.decontaminate(df, benchmark), language_id.keep_known(df, 0.0)):
        assert out.columns == df.columns and all(r[-9:] == extra for r in out.collect())


def test_hot_keys_are_spread(spark):
    """A fingerprint that a third of all rows share loses no row in the join and fills no task."""
    rows = [(7 if i % 3 == 0 else i, i, i % 5, 0) for i in range(9000)]
    left = saved(spark.createDataFrame(rows, "mark long, doc long, uid long, first int"))
    right = saved(left.groupBy("mark").count().withColumnRenamed("count", "n"))
    got = line_dedup.spread_join(left, right, "mark")
    assert sorted(map(tuple, got.select("mark", "doc", "uid", "first").collect())) == sorted(rows)
    some = saved(right.where("mark = 7 or mark % 2 = 0"))
    for how in ("inner", "left_semi"):
        out = line_dedup.spread_join(left, some, "mark", how)
        assert out.columns == left.columns and sorted(r.doc for r in out.collect()) == [d for m, d, _, _ in rows if m == 7 or m % 2 == 0]
    assert line_dedup.spread_join(left, right.limit(0), "mark", "left_semi").collect() == []


def test_a_document_repeated_many_times(spark, docs):
    """Repeats of a document join its group as one set of runs, of no more than its own windows."""
    passage = "\n".join(" ".join(f"p{i}.{k}" for i in range(20)) for k in range(6))
    rows = [(1, passage), *[(2, "lead\n" + passage)] * 3000]
    got = line_dedup.deduplicate(docs(*rows)).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text, r["count"]) for r in got} == {(1, passage, 1), (2, "lead", 3000)}


def test_a_repeated_passage_goes_once_and_clean_lines_stay(spark, docs):
    passage = " ".join(f"p{i}" for i in range(55))
    two = "\n".join([" ".join(f"q{i}" for i in range(30)), " ".join(f"r{i}" for i in range(30))])
    short = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"one\n{passage}\nalpha"), (2, f"two\n{passage}\nbeta"), (3, f"three\n{two}\n{short}"), (4, f"{short}\n{two}\nfour\n{passage}"), (5, short), (6, passage), (7, None), (None, passage), (8, ""), (9, passage), (9, passage)]
    out = line_dedup.deduplicate(docs(*rows)).collect()
    got = {r.doc_id: r.text for r in out}
    assert len(out) == len(rows)
    assert got == {1: rows[0][1], 2: "two\nbeta", 3: rows[2][1], 4: f"{short}\nfour", 5: short, 6: "", 7: None, None: passage, 8: "", 9: ""}
    left = {r.doc_id for r in line_dedup.deduplicate(docs(*rows), drop_empty=True).collect()}
    assert left == {1, 2, 3, 4, 5, 7, None, 8}
    same = line_dedup.deduplicate(docs((9, passage), (9, passage), (9, "other"))).collect()
    assert sorted(r.text for r in same) == sorted([passage, passage, "other"])
    long = "\n".join(f"{passage} {i}" for i in range(3000))
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(docs((1, long), (2, "x\n" + long))).collect()}
    assert got == {1: long, 2: "x"}
    assert line_dedup.deduplicate(docs((1, "x")).limit(0)).collect() == []
