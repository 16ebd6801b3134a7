"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are written once with the number of the partition that read them and two random
   keys; later stages, and their retries, see the same rows in the same partitions.
2. From the row counts of partitions and the exact shard sizes the driver draws the matrix of
   rows sent from each partition to each shard: row by row, a multivariate hypergeometric draw
   of the shards' remaining places. It has partitions x shards small numbers.
3. Each partition permutes its rows (rank of the first key); the matrix row cuts the ranks
   into runs, one a shard.
4. Rows are exchanged and permuted again: rank of the second key within the shard. A shard's
   rank is made of counted key ranges, so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import Scratch, fresh, utf8


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Exact sizes, at most one apart."""
    return np.full(shards, n // shards, dtype=np.int64) + (np.arange(shards) < n % shards)


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent from each partition (of ``counts`` rows) to each shard (of ``sizes`` places).

    Row sums equal ``counts``, column sums equal ``sizes``; the draw is that of a uniform
    permutation of all rows.
    """
    rng = np.random.default_rng(seed)
    left = np.asarray(sizes, dtype=np.int64).copy()
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for i, c in enumerate(counts):
        total, want = int(left.sum()), int(c)
        if total < 10**9:
            out[i] = rng.multivariate_hypergeometric(left, want, method="marginals")
            left -= out[i]
            continue
        for j in range(len(left)):
            if not want:
                break
            rest = total - int(left[j])
            got = want if rest == 0 else _hypergeometric(rng, int(left[j]), rest, want)
            out[i, j] = got
            want, total = want - got, rest
        left -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """numpy's generator takes populations under 1e9; larger ones use the normal limit, clipped to the support."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p, total = good / (good + bad), good + bad
    sd = (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, sd)), max(0, n - bad)), min(n, good)))


def hypergeometric_shards(df: DataFrame, shards: int = 24, seed: int = 17, rows_per_range: int = 100_000) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard) to every row of ``df``.

    Shard sizes differ by at most one. Nulls, repeated rows and ties need no care: the keys are
    random and no column of ``df`` is looked at. An empty table stays empty. Columns of ``df``
    named shard or slot are replaced; all others pass through.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    pid, k1, k2, rng, rank, cuts = fresh(df, "pid_", "k1_", "k2_", "range_", "rank_", "cuts_")
    scratch = Scratch(spark, "shard")
    keyed = df.withColumns({pid: F.spark_partition_id(), k1: F.rand(seed), k2: F.rand(seed + 1)})
    keyed = scratch.write(keyed, "keyed")
    counts = sorted((r[0], r[1]) for r in keyed.groupBy(pid).count().collect())
    n = sum(c for _, c in counts)
    matrix = communication_matrix(np.array([c for _, c in counts], dtype=np.int64), shard_sizes(n, shards), seed)
    ends = np.cumsum(matrix, axis=1)
    # Partitions x shards numbers; joined by key, so it is broadcast only while Spark finds it small.
    table = pa.table({pid: pa.array([p for p, _ in counts], pa.int32()), cuts: pa.array(list(ends), pa.list_(pa.int64()))})
    plan = spark.createDataFrame(table)
    local = Window.partitionBy(pid).orderBy(k1)
    dealt = (
        keyed.withColumn(rank, F.row_number().over(local) - 1)
        .join(plan, pid)
        .withColumn("shard", F.size(F.filter(cuts, lambda x: x <= F.col(rank))))
        .drop(rank, cuts, pid, k1)
    )
    ranges = max(1, -(-n // shards // rows_per_range))
    dealt = scratch.write(dealt.withColumn(rng, F.floor(F.col(k2) * ranges).cast("int")), "dealt")
    scratch.drop("keyed")
    base = fresh(dealt, "base_")[0]
    per_range = dealt.groupBy("shard", rng).count()
    before = Window.partitionBy("shard").orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    bases = per_range.select("shard", rng, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("shard", rng).orderBy(k2)
    return (
        dealt.withColumn("slot", (F.row_number().over(within) - 1).cast("long"))
        .join(bases, ["shard", rng])
        .withColumn("slot", F.col("slot") + F.col(base))
        .drop(rng, base, k2)
    )


def op5_hypergeometric_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``. A null text has no bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"))
    out = hypergeometric_shards(rows, shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
