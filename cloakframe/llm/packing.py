"""Packing: length buckets with least padding, then batches under a token budget.

The global histogram of lengths is one aggregate with a row per different length, so
it has at most as many rows as the longest document has tokens.  It comes to the driver
as Arrow columns, and dynamic programming over it finds the optimum: for each number of
buckets the best cuts are the lower envelope of straight lines, which one pass follows.

Inside a bucket the documents are dealt by hash to shards whose size follows the
bucket's row count; a window numbers each shard.  No bucket is one task, however
many documents it holds.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a shard, and the full batches that it holds at least.
SHARD_ROWS = 1024
SHARD_BATCHES = 8


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend and are not repeated; a bucket's upper bound is its longest
    length.  ``cost[j]``: least padded tokens of the first ``j`` lengths.  A bucket after
    the first ``i`` costs ``cost[i] + (rows[j] - rows[i]) * lengths[j - 1]``: for each ``i`` a
    line over the length, and both the slopes and the lengths are in order.
    """
    n = len(lengths)
    if not n:
        return []
    rows = [0, *accumulate(counts)]
    cost: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = [0] * (n + 1), np.zeros(n + 1, np.int32)
        lines: list[int] = []
        at = 0  # the line that is lowest at the last length
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] is not None:
                while len(lines) - at >= 2:
                    a, b = lines[-2], lines[-1]
                    if (cost[i] - cost[a]) * (rows[b] - rows[a]) > (cost[b] - cost[a]) * (rows[i] - rows[a]):
                        break
                    lines.pop()  # never the lowest
                lines.append(i)
            top = lengths[i]
            while len(lines) - at >= 2 and cost[lines[at + 1]] - rows[lines[at + 1]] * top <= cost[lines[at]] - rows[lines[at]] * top:
                at += 1
            cut[j] = lines[at]
            new[j] = cost[lines[at]] + (rows[j] - rows[lines[at]]) * top
        cost = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(docs: DataFrame, tokens: Column | None = None, budget: int = 65_536, buckets: int = 16) -> DataFrame:
    """One row per document row: its bucket, its batch and its place in the batch.

    ``tokens`` is the length of a document in tokens; by default the length of its
    text under a byte-level vocabulary.  A batch holds ``budget // bucket_len``
    documents, one at least, so a document longer than the budget is a batch of its
    own.  A null or empty text has length 0 and goes to the shortest bucket; a null
    ``doc_id`` is a document like any other; repeated rows are packed as often as
    they occur; other columns are ignored.  An empty table gives no row.

    Returns ``doc_id, n_tokens, bucket, bucket_len, shard, batch, slot``: a batch
    is named by bucket, shard and batch.
    """
    length = F.coalesce(tokens if tokens is not None else F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", length.alias("n_tokens"), F.xxhash64("doc_id", "text").alias("order"))
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (histogram.column(c).to_pylist() for c in ("n_tokens", "n"))
    bounds = best_buckets(lengths, counts, buckets)
    if not bounds:
        return rows.select(
            "doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"),
            F.lit(0).alias("shard"), F.lit(0).alias("batch"), F.lit(0).alias("slot"),
        ).where("false")
    numbers = np.searchsorted(bounds, lengths)
    sizes = np.bincount(numbers, weights=counts, minlength=len(bounds)).astype(np.int64)
    per_batch = [max(1, budget // max(1, b)) for b in bounds]
    shards = [int(max(1, -(-int(n) // max(SHARD_ROWS, SHARD_BATCHES * k)))) for n, k in zip(sizes, per_batch)]

    def by_bucket(values: list[int], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1).cast(kind)

    bucket = F.lit(0)
    for i, bound in enumerate(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") > bound, i + 1).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", by_bucket(bounds, "long"))
    rows = rows.withColumn("shard", F.pmod(F.col("order"), by_bucket(shards, "long")).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order", "doc_id")) - 1
    rows = rows.withColumn("place", place).withColumn("per_batch", by_bucket(per_batch, "int"))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len", "shard",
        F.floor(F.col("place") / F.col("per_batch")).cast("int").alias("batch"),
        (F.col("place") % F.col("per_batch")).cast("int").alias("slot"),
    )
