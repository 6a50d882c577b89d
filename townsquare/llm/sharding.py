"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

In a uniform shuffle, how many rows of each input partition go to each shard
follows a multivariate hypergeometric law whose margins, the sizes of the
partitions and of the shards, are known. So that matrix is drawn first. Each
partition then permutes its rows and deals them out by its line of the matrix,
and each shard permutes what it gets. Every assignment of rows to slots is
equally likely, and the shard sizes are exact, whatever the input looks like.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townsquare.llm.common import cut, packed, scratch, unpacked

#: numpy draws hypergeometric numbers for populations below this.
NUMPY_BELOW = 10**9


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement are among the ``good`` ones."""
    if good + bad < NUMPY_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    reach = 12 * math.sqrt(max(mean * bad / (good + bad), 1.0)) + 12
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach))
    # Inverse of the distribution; the steps of its log density are exact ratios.
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    density = np.concatenate([[0.0], np.cumsum(steps)])
    density = np.exp(density - density.max())
    total = np.cumsum(density)
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with these margins: multivariate hypergeometric, line by line."""
    if sum(rows) != sum(columns):
        raise ValueError("both margins must have the same sum")
    rng, left, matrix = np.random.default_rng(seed), list(columns), []
    for n in rows:
        line, rest = [], sum(left)
        for shard, size in enumerate(left):
            rest -= size
            got = _draw(rng, size, rest, n) if n else 0
            line.append(got)
            left[shard] -= got
            n -= got
        matrix.append(line)
    return matrix


def uniform_shards(df: DataFrame, n_shards: int = 24, seed: int = 7, rows_per_block: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    Shard sizes differ by one at most; every arrangement is equally likely.
    Rows are never compared, so null, equal or repeated rows are rows like any
    other and no key can be hot. An empty input gives no rows. Columns of
    ``df`` named ``shard`` or ``slot`` are replaced. Texts of any length are
    moved once, as they are.

    The random numbers depend on ``seed`` and on the layout of ``df``. They are
    written to the shared folder before anything is decided by them, so a task
    that runs again after the loss of an executor meets the same ones.

    The driver holds one line of counts per input partition. ``rows_per_block``
    bounds what one task sorts in the second permutation.
    """
    spark = df.sparkSession
    drawn = cut(
        packed(df).select(
            "row", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"),
            F.rand(seed).alias("first"), F.rand(seed + 1).alias("second"),
        ),
        scratch(spark, "shards"),
    )
    counts = [(r["part"], r["n"]) for r in drawn.groupBy("part").agg(F.count("*").alias("n")).collect()]
    counts.sort()
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    bounds = spark.createDataFrame(
        [(part, np.cumsum(line).tolist()) for (part, _), line in zip(counts, matrix, strict=True)],
        "part int, bounds array<bigint>",
    )
    # Both permutations move ids; the rows themselves are moved once, at the end.
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first", "second")) - 1
    blocks = max(1, -(-total // (n_shards * rows_per_block)))
    dealt = (
        drawn.select("id", "part", "first", "second")
        .withColumn("rank", rank)
        .join(bounds, "part")
        .select(
            "id",
            "second",
            F.size(F.filter("bounds", lambda b: b <= F.col("rank"))).alias("shard"),
            F.floor(F.col("second") * blocks).cast("int").alias("block"),
        )
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("second")) - 1
    slot = (F.col("offset") + F.col("inside")).cast("bigint").alias("slot")
    placed = dealt.withColumn("inside", inside).join(offsets, ["shard", "block"]).select("id", "shard", slot)
    return unpacked(drawn.select("id", "row").join(placed, "id"), shard=F.col("shard"), slot=F.col("slot"))


def shard_digest(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """Where :func:`uniform_shards` puts each document, with its size and a checksum of its text.

    A null text has size 8 and the checksum of an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return uniform_shards(rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
