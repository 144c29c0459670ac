"""Exact token-length histogram of a corpus, and what suffix sums over it answer.

Documents are counted by encoded length: each task adds its rows up before the shuffle, so what moves is at most one
row per task and distinct length. Suffix sums over the histogram give, for every context limit, the number of
documents and tokens beyond it and the total after truncation, exactly. The sums run in two levels (blocks of
``BLOCK`` lengths, then inside each block), so no task sees the whole histogram.

Defined cases: null and empty texts have length 0; very long texts are encoded whole, one at a time, and make a row like any
other; documents of equal length share a row; repeated rows count each time; an empty table gives an empty
histogram, total 0 and null quantiles; columns other than the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftglass.llm.common import materialize
from driftglass.llm.tokens import DEFAULT, broadcast_vocabulary, worker_encoder

BLOCK = 256


def token_lengths(docs: DataFrame, vocabulary: str = DEFAULT, text: str = "text") -> DataFrame:
    """One row for each distinct length of each task: ``n_tokens`` and ``n_docs``."""
    content = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        encode = worker_encoder(content.value)
        seen: dict[int, int] = {}
        for batch in batches:
            for x in batch.column(0):
                n = len(encode(x.as_py()))
                seen[n] = seen.get(n, 0) + 1
        keys = np.array(sorted(seen), np.int64)
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(keys), "n_docs": pa.array([seen[k] for k in keys.tolist()], pa.int64())})

    return docs.select(text).mapInArrow(run, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str = DEFAULT, text: str = "text") -> DataFrame:
    return token_lengths(docs, vocabulary, text).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L present: documents and tokens of length >= L, and the total when every document is cut at L tokens."""
    histogram = materialize(histogram, "length-histogram")  # read twice below; encoding the corpus once is enough
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.coalesce(F.sum("t").over(below), F.lit(0)).alias("t_below"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    summed = h.withColumns({
        "d_in": F.sum("n_docs").over(inside), "t_in": F.sum("tokens").over(inside), "t_lower": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
    }).join(offsets, "block")
    at_least = F.col("d_in") + F.col("d_above")
    return summed.select(
        "n_tokens", "n_docs", "tokens",
        at_least.alias("docs_at_least"),
        (F.col("t_in") + F.col("t_above")).alias("tokens_at_least"),
        (F.col("t_lower") + F.col("t_below") + F.col("n_tokens") * at_least).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Exact token totals when every document is cut at each of ``limits``, one row per distinct limit: one pass over the histogram."""
    limits = sorted(set(map(int, limits)))
    if not limits:
        return sums.sparkSession.createDataFrame([], "context_limit long, total long")
    cut = [F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")).alias(f"c{i}") for i, x in enumerate(limits)]
    pairs = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("total")) for i, x in enumerate(limits)]))
    return sums.agg(*cut).select(pairs.alias("p")).select("p.*")


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q, the smallest length L with at least q of all documents no longer than L (q = 0: the minimum)."""
    total = sums.agg(F.sum("n_docs")).first()[0] or 0
    up_to = F.lit(total) - F.col("docs_at_least") + F.col("n_docs")
    row = sums.agg(*[F.min(F.when(up_to >= float(q) * total, F.col("n_tokens"))).alias(f"c{i}") for i, q in enumerate(shares)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"c{i}").alias("n_tokens")) for i, q in enumerate(shares)]))
    return row.select(pairs.alias("p")).select("p.*")
