"""Mixing sources to target weights by temperature.

Source i holds a share p_i of all tokens. Its weight is p_i^a / sum_j p_j^a: as
it is for a = 1, equal for all sources for a = 0. The exponent a is found by
bisection. The weights are then realised exactly: every source is read in a
fresh permutation per pass until its budget of tokens is spent, and all sources
are dealt into blocks, each with the weights of the whole.

Only DataFrame functions; the driver sees a few sums per step of the bisection.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townsquare.llm.common import WORD, cut, scratch, unpacked

SECTIONS = 16  # the bisection halves its interval four times per job
STEPS = 10_000  # exponents are multiples of 1 / STEPS


class Mixture(NamedTuple):
    exponent: float
    entropy: float  #: of the weights, in nats
    repeats: float  #: passes over the source that is read most often
    budget: float  #: tokens of the mixture


def n_tokens(text: str | Column = "text") -> Column:
    """Words of the text and one end; a null text has the end alone."""
    column = F.col(text) if isinstance(text, str) else text
    return (F.regexp_count(F.coalesce(column.cast("string"), F.lit("")), F.lit(WORD)) + 1).cast("bigint")


def source_totals(docs: DataFrame) -> DataFrame:
    """``source``, its documents ``n_docs`` and tokens ``tokens``; documents without source are one of their own."""
    return _totals(docs.select("source", n_tokens().alias("n")))


def _totals(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("tokens"))


def _sums(totals: DataFrame, all_tokens: int, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    share = F.col("tokens") / F.lit(float(all_tokens))
    powers = totals.select(share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    weight = F.pow("p", "a")
    rows = powers.groupBy("a").agg(
        F.sum(weight).alias("z"), F.sum(weight * F.log("p")).alias("l"), F.max("p").alias("most"), F.min("p").alias("least")
    )
    return {r["a"]: (r["z"], r["l"], r["most"], r["least"]) for r in rows.collect()}


def fit(
    totals: DataFrame, entropy_share: float = 0.98, max_repeats: float = 2.0, budget: float | None = None
) -> Mixture | None:
    """The exponent for these sources; None if there are none.

    The largest exponent up to 1 whose weights reach ``entropy_share`` of the
    entropy of equal weights. If some source would then be read more than
    ``max_repeats`` times, the smallest exponent that keeps to the limit, or 1.
    Exponents have four digits.

    ``budget`` is the number of tokens of the mixture. None takes the least
    budget that reads every document at least once.
    """
    head = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not head["n"]:
        return None
    all_tokens, n = head["t"], head["n"]
    target = entropy_share * math.log(n)

    def measured(steps: list[int]) -> dict[int, Mixture]:
        out = {}
        for a, (z, logs, most, least) in _sums(totals, all_tokens, [step / STEPS for step in steps]).items():
            held = budget / all_tokens if budget else z * most ** (1 - a)
            entropy = math.log(z) - a * logs / z
            out[round(a * STEPS)] = Mixture(a, entropy, held * least ** (a - 1) / z, held * all_tokens)
        return out

    def bisect(low: int, high: int, holds) -> tuple[int, int]:
        """The last step at which ``holds`` is true and the first where not; it is so at both ends."""
        while high - low > 1:
            points = sorted({low + max(1, (high - low) * i // SECTIONS) for i in range(1, SECTIONS)})
            found = measured(points)
            true = [p for p in points if holds(found[p])]
            low, high = max([low, *true]), min([high, *(p for p in points if p not in true)])
        return low, high

    def flat_enough(m: Mixture) -> bool:
        return m.entropy >= target - 1e-12

    def too_often(m: Mixture) -> bool:
        return m.repeats > max_repeats + 1e-9

    ends = measured([0, STEPS])
    step = STEPS
    if not flat_enough(ends[STEPS]):
        step = bisect(0, STEPS, flat_enough)[0] if flat_enough(ends[0]) else 0
    chosen = measured([step])[step]
    if too_often(chosen):
        step = STEPS if too_often(ends[STEPS]) else bisect(step, STEPS, too_often)[1]
        chosen = measured([step])[step]
    return chosen


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts; SQL engines agree on it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    entropy_share: float = 0.98,
    max_repeats: float = 2.0,
    budget: float | None = None,
    block_tokens: int = 1 << 20,
    docs_per_bucket: int = 4096,
    seed: int = 7,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` as the mixture reads them: a row per document and pass, with the columns added below.

    ``tokens`` (words and one end), ``epoch`` (pass over the source, from 0),
    ``block`` and ``position`` (place in the block, from 0). Every pass takes
    the documents of a source in a fresh permutation, by a hash of seed, pass,
    id and text. The last pass ends with the document in which the budget of
    the source is spent. A block holds about ``block_tokens`` tokens, of every
    source as many as its weight says.

    Null sources are a source of their own, a null text has one token. Rows
    that are equal are told apart by nothing, so each counts; they lie side by
    side. Texts of any length are counted whole. No documents, no rows. Columns of ``docs`` with the names of added ones are replaced;
    ``carry`` names the columns to return (None: all).

    A source of any size is dealt into buckets of about ``docs_per_bucket``
    documents by the hash; running totals are taken inside a bucket, and the
    buckets' totals are summed in a table of one row per bucket.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "mixture")
    keys = [
        F.col("source"), F.col("doc_id").cast("string").alias("id"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"), n_tokens().alias("n"),
    ]
    sizes = cut(docs.select(*keys), f"{folder}/sizes")
    totals = cut(_totals(sizes), f"{folder}/sources")
    mixture = fit(totals, entropy_share, max_repeats, budget)
    if mixture is None:
        mixture = Mixture(1.0, 0.0, 1.0, 1.0)
    n_blocks = max(1, math.ceil(mixture.budget / block_tokens))
    plan = _plan(totals, mixture, budget is None, docs_per_bucket)

    def passes(rows: DataFrame) -> DataFrame:
        return (
            rows.join(plan, F.col("source").eqNullSafe(F.col("key"))).drop("key")
            .select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"))
            .withColumn("u", uniform(F.lit(seed), F.col("epoch"), F.col("id"), F.col("digest")))
            .withColumn("bucket", F.floor(F.col("u") * F.col("buckets")).cast("int"))
        )

    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    group = ["source", "epoch", "bucket"]
    running = Window.partitionBy(*group).orderBy("u", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = passes(docs.select(row, *keys)).withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    ahead = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = passes(sizes).groupBy(*group).agg(F.sum("n").alias("held")).select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"),
    )
    # A table, so that its size is known and the documents are not dealt out once more for this join.
    offsets = cut(offsets, f"{folder}/offsets")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("bucket") == F.col("b"))
    at = F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("before")
    placed = (
        inside.join(offsets, same)
        .withColumn("at", at)
        .where(F.col("at") < F.col("share"))
        .withColumn("block", F.floor(F.col("at") / F.col("share") * n_blocks).cast("int"))
    )
    order = Window.partitionBy("block").orderBy(
        uniform(F.lit(seed), F.lit("block"), F.col("epoch"), F.col("id"), F.col("digest")), "id", "digest", "epoch"
    )
    return unpacked(
        placed.withColumn("position", F.row_number().over(order) - 1),
        tokens=F.col("n"), epoch=F.col("epoch"), block=F.col("block"), position=F.col("position"),
    )


def _plan(totals: DataFrame, mixture: Mixture, covers: bool, docs_per_bucket: int) -> DataFrame:
    """Per source ``key``: its ``tokens``, its ``share`` of the budget, ``passes`` and ``buckets``."""
    power = F.pow(F.col("tokens").cast("double"), F.lit(mixture.exponent))
    summed = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    share = F.floor(power / F.lit(summed) * F.lit(mixture.budget)).cast("bigint")
    if covers:  # rounding must not cost the largest source its last document
        share = F.greatest(share, F.col("tokens"))
    return totals.select(
        F.col("source").alias("key"), "tokens", share.alias("share"),
        F.greatest(F.ceil(share / F.col("tokens")), F.lit(1)).cast("int").alias("passes"),
        F.ceil(F.col("n_docs") / docs_per_bucket).cast("int").alias("buckets"),
    )
