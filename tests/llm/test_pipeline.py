import corpus_pipeline
import test_duplicates as D
from ordlog.llm import decontamination, language_id
from ordlog.llm.common import table
from pyspark.sql import functions as F
from test_tokens_and_packing import checked

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash", "decontamination", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}

    out = stages["language_id"](spark, docs, SF)
    sure = {r.doc_id for r in language_id.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == sure and len(sure) > 0.95 * len(rows)

    out = stages["line_dedup"](spark, docs, SF)
    want = {i: t for i, t in D.plain_dedup(list(rows.items())).items() if t.strip() or t == rows[i]}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == want

    out = stages["simhash"](spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(D.jaccard_roots(list(rows.items()))[0].values())

    out = stages["decontamination"](spark, docs, SF)
    bad = {r.doc_id for r in decontamination.contamination(docs, table(spark, SF, "benchmark")).collect()}
    assert bad and out.columns == docs.columns and {r.doc_id for r in out.collect()} == rows.keys() - bad


def test_run_packs_what_the_stages_leave(spark):
    docs = table(spark, SF, "documents")
    got = corpus_pipeline.run(spark, SF).collect()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    n = checked(got, {r.doc_id: r.text for r in kept.collect()})
    assert n <= -(-sum(r.length for r in got) // 4096) + 1


def test_odd_documents_run_through(spark, tmp_path):
    """Null and empty texts, repeated rows, rows without doc_id, columns of clashing names, a very long text, and empty tables."""
    base = table(spark, SF, "documents")
    some = base.orderBy("doc_id").limit(60).withColumn("_uid", F.lit(1)).withColumn("id", F.lit("x")).withColumn("Root", F.lit(2.5))
    schema = some.schema
    rows = [tuple(r) for r in some.collect()]
    tail = rows[0][2:]
    long = " ".join(w for _ in range(40) for r in rows[:20] for w in (r[1] or "").split())
    rows += [(1000, None, *tail), (1001, "", *tail), (None, "the quick words " * 20, *tail), rows[5], rows[5], (1002, long, *tail), (1003, "\n\n", *tail)]
    (tmp_path / "a").mkdir()
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a/documents.parquet"))
    benchmark = table(spark, SF, "benchmark")
    benchmark.write.parquet(str(tmp_path / "a/benchmark.parquet"))
    docs = table(spark, str(tmp_path / "a"), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path / "a"))
        assert out.columns == docs.columns and out.count() <= len(rows), name
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert len(got) > 30 and sum(r.doc_id is None for r in got) == 1 and max(r.piece for r in got) >= 1
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b/documents.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "b/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []
    docs.write.parquet(str(tmp_path / "c/documents.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "c/benchmark.parquet"))
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path / "c")).count() == len(rows)
