"""Exact token counts from a histogram of encoded lengths.

Each task counts its documents by length; the counts are summed, one row for each length. Suffix sums over lengths then give, for a context limit
of each length, the documents that reach it, their tokens, and what remains of the corpus when every document is cut there. Any total or
quantile follows from these rows, without another pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ordlog.llm.common import saved, to_python
from ordlog.llm.tokens import default_path, encoder

#: Lengths in a block of suffix sums; one row per block is summed over all blocks.
BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, docs): how many documents have so many tokens. A null text has none."""
    to_python(docs.sparkSession)
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path).batch, Counter()
        for b in batches:
            seen.update(np.diff(encode(b.column(0))[1]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "docs"])

    part = docs.select("text").mapInArrow(count, "length bigint, docs bigint")
    return part.groupBy("length").agg(F.sum("docs").alias("docs"))


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row for each length that occurs: docs and tokens of that length; docs_from and tokens_from of that length and longer; truncated_tokens
    when every document is cut at it; share_up_to, the part of documents no longer. Null and empty texts have length 0, repeated rows count
    each, other columns are ignored, and an empty table gives no rows."""
    own = saved(lengths(docs, tokenizer))  # one row for each length, used twice
    own = own.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("_b", F.expr(f"length div {BLOCK}"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("_b").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    blocks = blocks.select("_b", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_t"), F.sum("_d").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"), F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_sum"))
    here = Window.partitionBy("_b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(blocks, "_b").withColumn("docs_from", F.sum("docs").over(here) + F.col("_d")).withColumn("tokens_from", F.sum("tokens").over(here) + F.col("_t"))
    below = F.col("_sum") - F.col("tokens_from")
    return out.select("length", "docs", "tokens", "docs_from", "tokens_from", (below + F.col("length") * F.col("docs_from")).alias("truncated_tokens"), ((F.col("_all") - F.col("docs_from") + F.col("docs")) / F.col("_all")).alias("share_up_to"))


def at_limit(rows: DataFrame, limit: int) -> DataFrame:
    """One row from the histogram: documents, tokens, documents over a context limit and tokens left when cut at it."""
    over = F.col("length") > limit
    return rows.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.when(over, limit * F.col("docs")).otherwise(F.col("tokens"))), F.lit(0)).alias("kept_tokens"))


def quantile(rows: DataFrame, q: float) -> int | None:
    """The least length that at least the part q of documents does not exceed."""
    return rows.where(F.col("share_up_to") >= q).agg(F.min("length")).first()[0]
