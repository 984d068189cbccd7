"""Exact histogram of encoded lengths, with suffix sums.

Documents are encoded where they lie and reduced to (length, documents) counts
before anything is shuffled. From the histogram come, for every context limit,
the documents above it, the tokens that truncation keeps, and exact quantiles.

Edge cases: null and empty texts have length 0; repeated rows count each time; an
empty table has an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm import bpe
from casebook.llm.common import cut

#: Neighbouring lengths whose suffix sums are taken together, so that no task has all.
BLOCK = 1024


def histogram(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and n_docs."""
    return bpe.lengths(docs, path, doc_id, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds, for each length n that occurs:

    n_docs_at_least, n_tokens_at_least: documents of n tokens or more, and their tokens;
    n_tokens_kept: tokens left if every document is cut to n;
    rank_from, rank_to: the documents of this length among all by length, from 1.

    Blocks of lengths are summed first; the window over the blocks has a row for each
    BLOCK lengths, and the windows within blocks at most BLOCK rows. The counts are written to
    the shared folder first, so the texts are encoded once.
    """
    rows = cut(counts).withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"))
    all_docs, all_tokens = rows.agg(F.sum("n_docs")).scalar(), rows.agg(F.sum(F.col("n_docs") * F.col("n_tokens"))).scalar()
    here = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(blocks, "block").withColumns({"all_docs": all_docs, "all_tokens": all_tokens})
    found = found.withColumn("n_docs_at_least", F.sum("n_docs").over(here) + F.col("later_docs"))
    found = found.withColumn("n_tokens_at_least", F.sum(F.col("n_docs") * F.col("n_tokens")).over(here) + F.col("later_tokens"))
    return found.select(
        "n_tokens", "n_docs", "n_docs_at_least", "n_tokens_at_least",
        (F.col("all_tokens") - F.col("n_tokens_at_least") + F.col("n_docs_at_least") * F.col("n_tokens")).alias("n_tokens_kept"),
        (F.col("all_docs") - F.col("n_docs_at_least") + 1).alias("rank_from"),
        (F.col("all_docs") - F.col("n_docs_at_least") + F.col("n_docs")).alias("rank_to"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least this share of documents has at most."""
    asked = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    ranks = asked.withColumn("all_docs", sums.agg(F.max("rank_to")).scalar()).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("all_docs"))))
    return F.broadcast(ranks).join(sums, F.col("rank").between(F.col("rank_from"), F.col("rank_to"))).select("share", "n_tokens")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit and n_tokens: the tokens left if every document is cut to the limit."""
    asked = F.broadcast(sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long"))
    # documents up to the limit keep their tokens, the others keep the limit
    return sums.join(asked).groupBy("limit").agg(F.sum(F.col("n_docs") * F.least("n_tokens", "limit")).alias("n_tokens"))
