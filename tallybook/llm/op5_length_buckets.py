"""Packing by optimal length buckets and token-budget batches.

The histogram of lengths over all documents is counted in Spark: one cell for
each length that occurs, so it grows with the longest text, not with the corpus.
On it, dynamic programming (divide and conquer over the monotone choice) finds
the bucket boundaries that minimise padding, exactly. Inside each
bucket, documents in input order fill batches of floor(budget / boundary) rows.
Ranks come from counts of short input slices plus the place in the slice, so no
bucket is ever sorted or numbered in one task.

Lengths are white-space words, or what length_col holds (such as n_tokens of
encode_pieces; null counts as 0), of which the budget is then kept.

Defined results: null or empty text has length 0 and still gets a batch; a
document longer than the budget is a batch alone; equal rows are rows like any
others; other columns of the input are left out but for id_cols, which must not
be named like a result column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.runtime import durable

SLICE = 20_000


def word_count(text: str):
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (some of the ascending distinct lengths, the last included) of least total padding.

    The best choice before a boundary moves up with it, so each layer is found
    by halving: all middle boundaries of a level at once, each among the choices
    that its neighbours leave.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * lengths)))
    ends = np.concatenate(([0], lengths)).astype(np.int64)
    big = np.iinfo(np.int64).max // 4
    cost = np.full(n + 1, big, np.int64)
    cost[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, big, np.int64), np.zeros(n + 1, np.int64)
        new[0] = 0
        lo, hi, first, last = (np.array([x]) for x in (1, n, 0, n))
        while len(lo):
            j = (lo + hi) // 2
            sizes = np.minimum(last, j - 1) - first + 1
            starts = np.cumsum(sizes) - sizes
            i = np.arange(sizes.sum()) - np.repeat(starts - first, sizes)
            at = np.repeat(j, sizes)
            values = cost[i] + ends[at] * (rows[at] - rows[i]) - (tokens[at] - tokens[i])
            least = np.minimum.reduceat(values, starts)
            where = np.flatnonzero(values == np.repeat(least, sizes))
            best = i[where[np.searchsorted(where, starts)]]
            new[j], choice[j] = least, best
            below, above = lo < j, j < hi
            lo, hi, first, last = (np.concatenate(x) for x in ((lo[below], j[above] + 1), (j[below] - 1, hi[above]), (first[below], best[above]), (best[below], last[above])))
        cost = new
        choices.append(choice)
    out, j = [], n
    for choice in reversed(choices):
        if j == 0:
            break
        out.append(int(ends[j]))
        j = int(choice[j])
    return sorted(set(out))


def length_buckets(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), buckets: int = 16, budget: int = 16_384, length_col: str | None = None) -> DataFrame:
    """id_cols with n_tokens, bucket, bucket_length, batch, place and padding."""
    ids = [docs[f"`{c}`"] for c in id_cols]
    length = word_count(text_col) if length_col is None else F.greatest(F.coalesce(docs[f"`{length_col}`"].cast("long"), F.lit(0)), F.lit(0))
    rows = durable(docs.select(*ids, length.alias("n_tokens")))
    cells = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    bounds = best_boundaries(np.array([c.n_tokens for c in cells], np.int64), np.array([c.n for c in cells], np.int64), buckets) or [0]

    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    numbered = rows.withColumn("bucket", F.size(F.filter(at, lambda b: b < F.col("n_tokens")))).withColumn("_at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_slice", F.shiftright("_at", 33) * (1 << 20) + F.expr(f"(_at & 8589934591L) div {SLICE}"))
    counted = numbered.groupBy("bucket", "_slice").agg(F.count("*").alias("_n"))
    before = counted.select("bucket", "_slice", (F.sum("_n").over(Window.partitionBy("bucket").orderBy("_slice")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("_at")) - 1
    ranked = numbered.withColumn("_in", inside).join(before, ["bucket", "_slice"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    length = F.element_at(at, F.col("bucket") + 1)
    cap = F.greatest(F.lit(1), F.expr(f"{budget}L div greatest(1L, bucket_length)"))
    out = ranked.withColumn("bucket_length", length).withColumn("_cap", cap)
    return out.select(*id_cols, "n_tokens", "bucket", "bucket_length", F.expr("_rank div _cap").alias("batch"), F.expr("_rank % _cap").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))


def op5_length_buckets(spark, sf_dir: str) -> DataFrame:
    return length_buckets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
