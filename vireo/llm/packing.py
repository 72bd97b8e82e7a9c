"""Packing: sequences fall into length buckets whose bounds minimise padding, and token-budget batches form inside each.

A document is cut into sequences of at most ``max_len`` tokens (runs of characters other than white space). The global
histogram of sequence lengths, at most ``max_len`` rows, goes to the driver; dynamic programming over it chooses
``buckets`` upper bounds so that the total padding is least (of equally good bounds the lexicographically smallest from
the longest down). A batch of a bucket with bound L holds floor(budget / L) sequences.

Inside a bucket, sequences are ordered by a multiplicative hash of doc_id and then by doc_id: ranks are row numbers
within (bucket, hash cell) plus the counts of the cells before, so no bucket is ever sorted in one task.

Defined results: null and empty texts, and texts of white space, have one sequence of no tokens in no bucket and batch;
a text of any length is used whole; rows that repeat a doc_id are sequences of their own; a null doc_id sorts first;
without any sequence there are no buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.llm import common

MAX_LEN, BUCKETS, BUDGET, CELLS = 2048, 8, 65_536, 1024


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\r\\f]+")).cast("bigint")


def best_bounds(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over {length: count} with the least padding.

    The cost of lengths i+1..j in one bucket is L[j] * (C[j] - C[i]) - (S[j] - S[i]), with running counts C and sums S;
    for a fixed i it is a line in L[j] with slope -C[i], so each layer is a lower envelope of lines.
    """
    lengths = sorted(k for k, c in histogram.items() if k > 0 and c > 0)
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for x in lengths:
        c.append(c[-1] + histogram[x])
        s.append(s[-1] + x * histogram[x])
    layers = min(buckets, n)
    cost = [lengths[j - 1] * c[j] - s[j] if j else None for j in range(n + 1)]
    back = [[0] * (n + 1)]
    for k in range(2, layers + 1):
        new, prev = [None] * (n + 1), [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # (slope, intercept, i), slopes falling
        at = 0
        for j in range(k, n + 1):
            i = j - 1
            m, b = -c[i], cost[i] + s[i]
            while len(lines) - at >= 2 or len(lines) >= 2 and len(lines) > at + 1:
                (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                if (b - b1) * (m1 - m2) < (b2 - b1) * (m1 - m):
                    lines.pop()
                else:
                    break
            lines.append((m, b, i))
            at = min(at, len(lines) - 1)
            x = lengths[j - 1]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            new[j] = lines[at][0] * x + lines[at][1] + x * c[j] - s[j]
            prev[j] = lines[at][2]
        cost = new
        back.append(prev)
    bounds, j = [], n
    for k in range(layers, 0, -1):
        bounds.append(lengths[j - 1])
        j = back[k - 1][j]
    return bounds[::-1]


def sequences(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, seq_no, n_tokens): each document's tokens in runs of at most ``max_len``."""
    n = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), token_count(F.col("text")).alias("n"))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / max_len)).cast("int")
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("seq_no"))
    return cut.select("doc_id", "seq_no", F.least(F.lit(max_len), F.col("n") - F.col("seq_no") * max_len).cast("int").alias("n_tokens"))


def packed(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row per sequence: doc_id, seq_no, n_tokens, bucket_len (its bucket's bound), batch_id within the bucket, slot
    within the batch."""
    seqs = common.written(sequences(docs, max_len), "sequences")
    histogram = dict(tuple(r) for r in seqs.groupBy("n_tokens").count().collect())  # at most max_len + 1 rows
    bounds = best_bounds(histogram, buckets)
    bound = F.lit(None).cast("int")
    for b in reversed(bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
    bound = F.when(F.col("n_tokens") > 0, bound)
    mod = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 31))
    cell = F.shiftright(F.pmod(mod * F.lit(2654435761), F.lit(1 << 32)), 22).cast("int")
    placed = seqs.withColumn("bucket_len", bound).withColumn("cell", cell)
    cells = placed.where("bucket_len is not null").groupBy("bucket_len", "cell").count()  # buckets x CELLS rows at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("bucket_len").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cells.select("bucket_len", "cell", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket_len", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "seq_no", "n_tokens"))
    ranked = placed.where("bucket_len is not null").withColumn("rank", own - 1).join(F.broadcast(offsets), ["bucket_len", "cell"])
    rank, size = F.col("before") + F.col("rank"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("bigint")
    row = ["doc_id", "seq_no", "n_tokens", "bucket_len"]
    full = ranked.select(*row, F.floor(rank / size).cast("bigint").alias("batch_id"), F.pmod(rank, size).cast("int").alias("slot"))
    none = placed.where("bucket_len is null").select(*row, F.lit(None).cast("bigint").alias("batch_id"), F.lit(None).cast("int").alias("slot"))
    return full.unionByName(none)
