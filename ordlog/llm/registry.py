"""The registered queries of this subpackage: op<N>_<name>, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordlog.llm import decontamination, language_id, line_dedup, nearest, packing, pii, sharding, simhash, token_counts, url_filter
from ordlog.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark, d):
    return language_id.identify(table(spark, d, "documents"))


@query
def op2_nearest_neighbours(spark, d):
    return nearest.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"))


@query
def op4_decontamination(spark, d):
    return decontamination.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("uid")


@query
def op5_url_filter(spark, d):
    return url_filter.judge(table(spark, d, "pages"))


ORACLE["op5_url_filter"] = url_filter.SQL


@query
def op6_sharding(spark, d):
    return sharding.assign(table(spark, d, "documents").select("doc_id"), "doc_id", SHARDS)


@query
def op7_token_counts(spark, d):
    return token_counts.histogram(table(spark, d, "documents"))


@query
def op8_pii(spark, d):
    docs = table(spark, d, "documents")
    return pii.digest(docs, pii.train(docs))


@query
def op9_line_dedup(spark, d):
    return line_dedup.deduplicate(table(spark, d, "documents"))


@query
def op10_simhash(spark, d):
    out = simhash.near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)
