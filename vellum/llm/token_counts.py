"""Token counts: the exact length histogram of a corpus.

Documents are aggregated by their encoded length. Suffix sums over the histogram answer, for every length L that
occurs: how many documents have L tokens or more, their tokens, the corpus total when every document is truncated to L
tokens, and the share of documents that fit. The sums run within buckets of 1,024 lengths and over the buckets' totals, so
no task sees more than one bucket.

Defined results: null and empty texts have length 0; repeated rows count each time; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vellum.llm import bpe
from vellum.llm.common import cut

BUCKET = 1024


def histogram(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: documents by encoded length."""
    slim = docs.select(F.lit(0).alias("k"), F.col(text_col).alias("t"))
    counts = bpe.encode(slim, ranks_path, pattern, id_col="k", text_col="t", ids=False)
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """From n_tokens, n_docs to context_limit, n_docs, docs_at_least, tokens_at_least, docs_fitting, truncated_total, total_tokens, quantile."""
    # read more than once below; uncut, every reading would encode the corpus again
    h = cut(hist).withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tok", F.col("n_tokens") * F.col("n_docs"))
    after = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    per_bucket = h.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tok").alias("b_tok"))
    offs = per_bucket.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("o_docs"),
        F.coalesce(F.sum("b_tok").over(after), F.lit(0)).alias("o_tok"),
    )
    total = per_bucket.agg(F.sum("b_docs").alias("all_docs"), F.sum("b_tok").alias("total_tokens"))
    inside = W.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    s = (
        h.withColumn("s_docs", F.sum("n_docs").over(inside))
        .withColumn("s_tok", F.sum("tok").over(inside))
        .join(F.broadcast(offs), "bucket")  # a row for each 1,024 lengths
        .crossJoin(F.broadcast(total))  # one row
    )
    docs_ge, tok_ge = F.col("s_docs") + F.col("o_docs"), F.col("s_tok") + F.col("o_tok")
    fitting = F.col("all_docs") - docs_ge + F.col("n_docs")
    return s.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        docs_ge.alias("docs_at_least"),
        tok_ge.alias("tokens_at_least"),
        fitting.alias("docs_fitting"),
        (F.col("total_tokens") - tok_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
        "total_tokens",
        (fitting / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Corpus totals for any limits, those between occurring lengths included: context_limit, truncated_total, docs_over.

    For a limit L, the next longer occurring length N has the same documents above L.
    """
    spark = sums.sparkSession
    want = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "lim long"))
    total = sums.agg(F.max("total_tokens").alias("t"))
    longer = (
        want.join(sums, sums.context_limit > want.lim, "left")
        .groupBy("lim")
        .agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("tok"))
    )
    d, tok = F.coalesce("d", F.lit(0)), F.coalesce("tok", F.lit(0))
    return longer.crossJoin(F.broadcast(total)).select(
        F.col("lim").alias("context_limit"), (F.coalesce("t", F.lit(0)) - tok + F.col("lim") * d).alias("truncated_total"), d.alias("docs_over")
    )
