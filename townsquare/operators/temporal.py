"""Posts per minute, hour or day, per symbol; a corpus split by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions.links import let
from townsquare.functions.time import bucket, one_step, scale_name, wall_clock


def frequency(
    posts: DataFrame, scale: str, ts: str = "created_time", tz: str = "UTC", sort: bool = True
) -> DataFrame:
    """(bucket, n): posts per time bucket, with zeros for the empty buckets
    between the first and the last. Posts without a time do not count."""
    times = _timed(posts, ts, scale, tz).select("bucket")
    counts = times.groupBy("bucket").agg(F.count("*").alias("n"))
    out = _fill(counts, "n", scale, ["n"])
    return out.orderBy("bucket") if sort else out


def thread_frequency(threads: DataFrame, scale: str, tz: str = "UTC") -> DataFrame:
    """Threads per time bucket by the time of their opening post."""
    dated = threads.select(opening_time(F.col("opening.time")).alias("created_time"))
    return frequency(dated, scale, tz=tz)


def opening_time(epoch: Column) -> Column:
    """An opening post's time; zero and less mean that there is none."""
    return F.when(epoch > 0, F.timestamp_seconds(epoch))


def reddit_frequency(posts: DataFrame, scale: str, tz: str = "UTC") -> DataFrame:
    """Submissions and comments per time bucket. Here ``created`` goes before
    ``created_utc``, and times before 1970 do not count."""
    epoch = F.coalesce("created", "created_utc")
    dated = posts.select(F.when(epoch >= 0, F.timestamp_seconds(epoch)).alias("created_time"))
    return frequency(dated, scale, tz=tz)


def symbol_frequency(
    posts: DataFrame,
    symbols: Sequence[str],
    scale: str,
    ts: str = "created_time",
    text: str = "text",
    tz: str = "UTC",
    wide: bool = False,
    sort: bool = True,
) -> DataFrame:
    """(bucket, symbol, n): posts whose text contains each symbol, compared
    case-blind and counted once per post, with zeros where there are none.
    ``wide`` gives one column per symbol instead.

    Buckets span all posts with text, also those that hold no symbol.
    """
    symbols = list(dict.fromkeys(s.strip().lower() for s in symbols if s.strip()))
    rows = _timed(posts.where(F.length(text) > 0), ts, scale, tz)
    listed = F.lit(symbols) if symbols else F.array().cast("array<string>")
    # "" stands for the post itself, so that every bucket is known.
    hits = let(F.lower(F.col(text)), lambda t: F.filter(listed, lambda s: F.contains(t, s)))
    matched = rows.select("bucket", F.explode(F.concat(F.array(F.lit("")), hits)).alias("symbol"))
    counts = matched.groupBy("bucket", "symbol").agg(F.count("*").alias("n"))
    spine = _spine(counts, "n", scale)
    if wide:
        sums = [F.sum(F.when(F.col("symbol") == s, F.col("n")).otherwise(0)).alias(s) for s in symbols]
        known = counts.groupBy("bucket").agg(F.count("*").alias("_rows"), *sums)
        filled = spine.join(known, "bucket", "left")
        out = filled.select("bucket", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in symbols])
        return out.orderBy("bucket") if sort else out
    each = spine.select("bucket", F.explode(listed).alias("symbol"))
    out = each.join(counts, ["bucket", "symbol"], "left").select(
        "bucket", "symbol", F.coalesce("n", F.lit(0)).alias("n")
    )
    return out.orderBy("bucket", "symbol") if sort else out


def _timed(posts: DataFrame, ts: str, scale: str, tz: str) -> DataFrame:
    # The null test is on the bucket, which is what the join tests as well: so
    # all branches over the counts are alike and share one exchange.
    return posts.withColumn("bucket", bucket(F.col(ts), scale, tz)).where(F.col("bucket").isNotNull())


def _spine(counts: DataFrame, positive: str, scale: str) -> DataFrame:
    """Every bucket from the first to the last: days first, then the steps of
    each day, so that no row holds a long array.

    The filter on a column that is always positive keeps that column in this
    branch too; so both branches need the same aggregation, and Spark runs it
    once and reuses its exchange.
    """
    ends = counts.where(F.col(positive) > 0).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    if scale_name(scale) == "day":
        return ends.select(F.explode(F.sequence("lo", "hi", one_step(scale))).alias("bucket"))
    first = F.date_trunc("day", "lo").cast("timestamp_ntz")
    days = ends.select("lo", "hi", F.explode(F.sequence(first, F.col("hi"), one_step("day"))).alias("day"))
    last = F.col("day") + F.expr("interval 1 day") - one_step(scale)
    # Days are few rows; dealt out, so that a long span is not one task's work.
    days = days.repartition("day")
    steps = days.select("lo", "hi", F.explode(F.sequence(F.col("day"), last, one_step(scale))).alias("bucket"))
    return steps.where(F.col("bucket").between(F.col("lo"), F.col("hi"))).select("bucket")


def _fill(counts: DataFrame, positive: str, scale: str, columns: Sequence[str]) -> DataFrame:
    filled = _spine(counts, positive, scale).join(counts, "bucket", "left")
    return filled.select("bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def split_by_day(posts: DataFrame, ts: str = "created_time", tz: str = "UTC") -> DataFrame:
    """Posts with the ``day`` they belong to; those without a time are left
    out. ``sinks.write_by_day`` writes one folder per day."""
    dated = posts.where(F.col(ts).isNotNull())
    return dated.withColumn("day", wall_clock(F.col(ts), tz).cast("date"))


def threads_by_day(threads: DataFrame, tz: str = "UTC") -> DataFrame:
    """Threads with the day of their opening post."""
    return split_by_day(threads.withColumn("created_time", opening_time(F.col("opening.time"))), tz=tz)


def day_report(posts: DataFrame, ts: str = "created_time", tz: str = "UTC") -> DataFrame:
    """(day, n) of the split, with zeros for days without posts."""
    return frequency(posts, "day", ts, tz).select(F.col("bucket").cast("date").alias("day"), "n")
