"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased text with a space at both ends, white space and digits being one character. Document
frequencies come from every document that may be learned from. Weights are fitted to a bounded sample of labelled documents by
follow-the-regularised-leader with L1 and L2 penalties, which leaves most of them zero; a part of the sample that is not fitted sets the
temperature of the softmax. Prediction reads whole texts where they lie and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.llm.common import saved, to_python

#: Hashed n-grams.
FEATURES = 1 << 14
#: Documents of each language in the sample that the weights are fitted to, documents of all languages together, of which each language has an equal
#: part but one at least, and bytes of their counts: these bound the sample, and no language is left out for its rank.
SAMPLE, SAMPLE_ALL, SAMPLE_BYTES = 600, 20_000, 256 << 20
#: Languages up to which a number for each is sent to every task.
BROADCAST = 65_536
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 3
UNKNOWN = "und"
# Odd numbers that spread code points over 32 bits, one for each place in an n-gram.
_SPREAD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, repeats included; none if it has no letter."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c <= 32) | (c == 160) | (c >= 48) & (c <= 57), np.uint32(32), c)
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    one = c * np.uint32(_SPREAD[0])
    two = one[:-1] ^ c[1:] * np.uint32(_SPREAD[1])
    three = two[:-1] ^ c[2:] * np.uint32(_SPREAD[2])
    h = np.concatenate([one, two, three])
    return (h ^ h >> np.uint32(15)) * np.uint32(_SPREAD[1]) >> np.uint32(32 - 14)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=FEATURES)


def tfidf(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(n) * idf
    return x / (np.linalg.norm(x) or 1.0)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, how many have each feature) over all rows of `text`. Every task sends one row for each feature it saw, summed by feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if has_letter(t):
                    n += 1
                    df += np.bincount(grams(t), minlength=FEATURES) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, FEATURES), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["feature", "n"])

    got = texts.select("text").mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    df = np.zeros(FEATURES + 1, np.int64)
    for r in got:
        df[r[0]] = r[1]
    return int(df[-1]), df[:-1]


def sample(labelled: DataFrame, per_language: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of about `per_language` documents of each language, picked by hash; the order is by hash too. Where their counts
    take over `most_bytes`, the last of each language in that order go, but one of each stays."""
    sizes = labelled.where(F.length("text") > 0).groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return []
    per_language = max(1, min(per_language, SAMPLE_ALL // len(sizes)))
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    share = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    odds = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in sizes], "lang string, _odds double")

    odds = F.broadcast(odds) if len(sizes) <= BROADCAST else odds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, rank, text = (c.to_pylist() for c in b.columns)
            n = [counts(t) if has_letter(t) else np.zeros(FEATURES, np.int64) for t in text]
            at = [np.flatnonzero(x).astype(np.int32) for x in n]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rank, pa.int64()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([x[a].astype(np.int32).tobytes() for x, a in zip(n, at)], pa.binary())], ["lang", "rank", "at", "n"])

    wanted = labelled.join(odds, "lang").where(share < F.col("_odds"))
    rows = saved(wanted.select("lang", h.alias("rank"), "text").mapInArrow(count, "lang string, rank bigint, at binary, n binary").where(F.octet_length("at") > 0))
    # Places and sums over the sample alone, which the odds bound.
    size = F.octet_length("at").cast("bigint") + F.octet_length("n")
    own = Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("place", F.count("*").over(own)).withColumn("size", size)
    total = placed.agg(F.sum("size")).first()[0] or 0
    part = min(1.0, most_bytes / max(1, total))
    kept = placed.withColumn("held", F.sum("size").over(own)).withColumn("all", F.sum("size").over(Window.partitionBy("lang")))
    kept = kept.where((F.col("place") <= 2 * per_language) & ((F.col("held") <= part * F.col("all")) | (F.col("place") == 1)))
    return [(r["lang"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in kept.orderBy("rank", "lang").select("lang", "at", "n").collect()]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], n_docs: int, df: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Weights by follow-the-regularised-leader over the rows in order, but for each fifth, which sets the temperature."""
    languages = sorted({r[0] for r in rows})
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    y = {lang: i for i, lang in enumerate(languages)}

    def vector(at, c):
        x = np.sqrt(c) * idf[at]
        return np.append(at, FEATURES), np.append(x / (np.linalg.norm(x) or 1.0), 1.0)  # the last feature is the bias

    def weights(at):
        zi, ni = z[at], n[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    for _ in range(epochs):
        for i, (lang, at, c) in enumerate(rows):
            if i % 5 == 4:
                continue
            at, x = vector(at, c)
            w = weights(at)
            p = softmax(x @ w)
            p[y[lang]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(FEATURES + 1))
    logits = np.array([(lambda a, x: x @ w[a])(*vector(at, c)) for _, at, c in held]).reshape(-1, k)
    truth = np.array([y[r[0]] for r in held], int)
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() if len(truth) else 0.0
    return Model(languages, idf, w[:-1], w[-1], min(np.geomspace(0.02, 20, 121).tolist(), key=loss) if len(truth) else 1.0)


def train(labelled: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """A model from (doc_id, text, lang); None if no row has a language and a letter. Null languages and texts teach nothing."""
    to_python(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    got = sample(rows, per_language)
    return fit(got, *document_frequencies(rows)) if got else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each whole text and its calibrated probability. A null text, one without a letter
    and any text without a model are `und` with score 0; repeated rows are predicted each; ties go to the first language by name."""
    to_python(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = None if model is None else np.ascontiguousarray(model.weights)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                if model is None or not has_letter(t):
                    out.append((UNKNOWN, 0.0))
                    continue
                p = softmax((tfidf(counts(t), model.idf) @ w + model.bias) / model.temperature)
                i = int(p.argmax())
                out.append((model.languages[i], float(p[i])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out.

    Whole texts are read, however long. Null and empty texts and those without a letter are `und` with score 0; repeated rows and null doc_ids are
    told each; ties go to the first language by name; other columns are ignored. Without a document to learn from all is `und`. An empty
    table gives no rows.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is told with a probability of at least `least`, with all their columns, of whatever name. The decision is made
    beside the text, so nothing is shuffled. Null and empty texts and those without a letter go, unless `least` is 0; repeated rows stay or go
    each. An empty table gives no rows."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    to_python(docs.sparkSession)

    @F.pandas_udf("double")
    def sure(text):
        import pandas as pd

        return pd.Series([0.0 if model is None or not has_letter(t) else float(softmax((tfidf(counts(t), model.idf) @ model.weights + model.bias) / model.temperature).max()) for t in text])

    return docs.where(sure("text") >= least)
