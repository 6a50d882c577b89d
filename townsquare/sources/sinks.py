"""Writers. Each takes a job's result and writes it in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.functions.time import format_date_text


def write_raw(df: DataFrame, path: str, column: str = "raw") -> None:
    """The original JSON lines (or any one text column), gzipped."""
    df.select(F.col(column).cast("string")).write.text(path, compression="gzip")


def write_frequency(df: DataFrame, path: str) -> None:
    """``date, n`` or ``date, n1, n2, ...`` lines in order of time."""
    bucket, *counts = df.columns
    line = F.concat_ws(", ", format_date_text(F.col(bucket)), *[F.col(_quoted(c)) for c in counts])
    df.orderBy(bucket).select(line.alias("line")).write.text(path)


def write_edges(df: DataFrame, path: str) -> None:
    """``src <tab> dst <tab> {"time": seconds}`` lines, gzipped; an edge
    without a time gets -1."""
    seconds = F.coalesce(F.unix_seconds(F.col("time").cast("timestamp")), F.lit(-1))
    line = F.concat_ws(
        "\t", F.col("src").cast("string"), F.col("dst"), F.to_json(F.struct(seconds.alias("time")))
    )
    df.select(line.alias("line")).write.text(path, compression="gzip")


def write_link_counts(df: DataFrame, path: str) -> None:
    """``url,count`` with a quote doubled inside quotes, gzipped."""
    df.select("url", "n").write.csv(path, quote='"', escape='"', compression="gzip")


def write_user_names(df: DataFrame, path: str) -> None:
    """``{"userid": id, "usernames": [...]}`` lines, gzipped."""
    df.select("userid", "usernames").write.json(path, compression="gzip")


def write_by_day(df: DataFrame, path: str, compact: bool = True, column: str = "raw") -> None:
    """One folder ``day=YYYY-MM-DD`` of JSON lines per day, in one pass.

    ``compact`` moves the rows of a day together first, so that each task does
    not write a file for every day; a day too large for one task is split.
    """
    rows = df.where(F.col("day").isNotNull()).select("day", F.col(column).alias("value"))
    if compact:
        rows = rows.hint("rebalance", "day")
    rows.write.partitionBy("day").text(path, compression="gzip")


def write_topic_model(lda, vectorizer, lda_path: str, vectorizer_path: str) -> None:
    lda.write().overwrite().save(lda_path)
    vectorizer.write().overwrite().save(vectorizer_path)


def _quoted(name: str) -> str:
    return f"`{name}`"
