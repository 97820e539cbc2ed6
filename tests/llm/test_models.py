import zlib

import numpy as np
from ordlog.llm import language_id, nearest
from ordlog.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    df = table(spark, SF, "documents")
    lang = {r.doc_id: r.lang for r in df.collect()}
    got = language_id.identify(df).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_known(df)
    assert kept.columns == df.columns and kept.count() > 0.95 * len(lang)


def test_weights_are_sparse_and_the_temperature_calibrates(spark):
    df = table(spark, SF, "documents")
    m = language_id.train(df)
    assert (m.weights == 0).mean() > 0.3 and m.languages == ["de", "en", "es", "fr"] and 0.02 <= m.temperature <= 20


def plain_prediction(model, text):
    """The likeliest language and its probability, n-gram by n-gram."""
    spread = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    codes = [32 if ord(c) <= 32 or ord(c) == 160 or "0" <= c <= "9" else ord(c) for c in f" {text.lower()} "]
    n = {}
    for size in (1, 2, 3):
        for i in range(len(codes) - size + 1):
            h = 0
            for k in range(size):
                h ^= codes[i + k] * spread[k] & 0xFFFFFFFF
            h = ((h ^ h >> 15) * spread[1] & 0xFFFFFFFF) >> 18
            n[h] = n.get(h, 0) + 1
    x = {h: c**0.5 * model.idf[h] for h, c in n.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    z = [(sum(v * model.weights[h][j] for h, v in x.items()) / norm + model.bias[j]) / model.temperature for j in range(len(model.languages))]
    e = [np.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda j: (z[j], -j))
    return model.languages[best], e[best] / sum(e)


def test_predictions_against_a_plain_version(spark):
    df = table(spark, SF, "documents")
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    want = {r.doc_id: plain_prediction(model, r.text) for r in df.collect() if len(r.text or "") < 2000}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df).collect()}
    assert len(want) > 500 and all(got[i][0] == lang and abs(got[i][1] - p) < 1e-9 for i, (lang, p) in want.items())


def test_every_language_is_learned_within_the_bounds(spark, docs):
    """More languages than documents of each, one of them rare, and a bound on bytes."""
    rnd = np.random.default_rng(3)
    rows = [(k * 1000 + i, " ".join("".join(rnd.choice(list(f"{chr(97 + k % 20)}{chr(0x4E00 + k)}{chr(0x4F00 + k)}x"), 5)) for _ in range(30)), f"l{k:03d}") for k in range(230) for i in range(3)]
    labelled = docs(*rows, (10**6, "rare words that are here once", "zz"))
    m = language_id.train(labelled)
    assert len(m.languages) == 231 and "zz" in m.languages
    few = language_id.sample(labelled, 600, 50_000)
    assert {r[0] for r in few} == set(m.languages) and len(few) < len(language_id.sample(labelled, 600))


def test_odd_texts(spark, docs):
    rows = [(1, "the cat and the dog " * 9, "en"), (2, "le chat et le chien " * 9, "fr"), (3, None, "en"), (4, "", None), (5, "123 4!", "en"), (None, "the dog", None), (7, "the " * 50000, None), (1, "the cat and the dog " * 9, "en")]
    got = language_id.identify(docs(*rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    alone = language_id.identify(docs((1, "abc", None))).collect()
    assert [(r.lang_pred, r.score) for r in alone] == [("und", 0.0)]
    assert language_id.identify(docs((1, "x")).limit(0)).collect() == []
    assert {r.doc_id for r in language_id.keep_known(docs(*rows)).collect()} <= {1, 2, 7, None}


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = np.einsum("ij,j->i", x, x[ids == q][0])
        keep = ids != q
        best = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = [(int(i), float(v)) for i, v in zip(ids[keep][best], s[keep][best])]
    return out


def run(spark, df, k=20, **kw):
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, k, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_recall_of_the_whole_table(spark):
    df = table(spark, SF.replace("0.01", "0.1"), "embeddings")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = run(spark, df, shard=700, block=40)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        for i, s in found:
            assert abs(s - float(np.dot(x[ids == q][0], x[ids == i][0]))) < 1e-12


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.5], "b"), (2, [0.0, 0.0], None), (3, None, ""), (4, [nan, 1.0], "x"), (5, [1.0, None], "x"), (6, [inf, 1.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (20, [1.0, 0.0], "q"), (None, [1.0, 1.0], "n"), (9, [1.0, 0.0], "t"), (8, [1.0, 0.0], "t"), (40, None, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, q string")
    assert run(spark, df) == {0: [(1, 2.0), (8, 1.0), (9, 1.0), (20, 1.0)], 20: [(1, 2.0), (0, 1.0), (8, 1.0), (9, 1.0)]}
    assert run(spark, df.limit(0)) == {}
    assert run(spark, df.where("vec_id = 0")) == {}
    # Rows that share a vec_id are rows of their own; vectors of other lengths are searched among themselves.
    twice = [(20, [1.0, 0.0]), (20, [3.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (40, [1.0, 1.0, 1.0]), (2, [1.0, 0.0, 0.0])]
    got = nearest.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == sorted([(20, 1, 20, 3.0), (20, 2, 1, 2.0), (20, 3, 1, 2.0), (20, 1, 1, 6.0), (20, 2, 1, 6.0), (20, 3, 20, 3.0), (40, 1, 2, 1.0)])
    clash = df.selectExpr("*", "1 as _q", "2 as row", "3 as d", "4 as s", "5 as rank")
    assert run(spark, clash) == run(spark, df)
    many = spark.createDataFrame([(i, [1.0, 1.0] if i % 3 else [float(i), -1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    ids, x = np.arange(300), np.array([[1.0, 1.0] if i % 3 else [float(i), -1.0] for i in range(300)])
    assert run(spark, many, shard=64) == exact(ids, x, range(0, 300, 20), 20)
