"""Frequencies and day splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from townsquare.operators import temporal as job
from townsquare.plans import Plan, tables
from townsquare.plans.tables import over, submissions, table, threads
from townsquare.sources import posts

SYMBOLS = ["i", "ERR", "view"]


def _events(spark, d):
    return table(spark, d, "events")


def _frequency_sql(scale: str, source: str = "events", ts: str = "ts") -> str:
    return f"""counts AS (
  SELECT date_trunc('{scale}', {ts}) AS bucket, count(*) AS n FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1),
spine AS (
  SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 {scale})) AS bucket FROM counts)"""


_FILLED = """SELECT CAST(spine.bucket AS TIMESTAMP) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN counts ON counts.bucket = spine.bucket"""


def frequency(scale):
    return Plan(
        lambda spark, d: job.frequency(_events(spark, d), scale, ts="ts"),
        f"WITH {_frequency_sql(scale)} {_FILLED}",
    )


def frequency_errors(spark, d):
    return job.frequency(_events(spark, d).where(F.col("event_type") == "error"), "hour", ts="ts")


def frequency_new_york(spark, d):
    return job.frequency(_events(spark, d), "day", ts="ts", tz="America/New_York")


def thread_frequency(spark, d):
    return job.thread_frequency(threads(spark, d), "hour")


def reddit_frequency(spark, d):
    lines = tables.submission_lines(spark, d).unionByName(tables.comment_lines(spark, d))
    return job.reddit_frequency(posts.reddit_posts(lines), "hour")


def symbols_long(spark, d):
    return job.symbol_frequency(_events(spark, d), SYMBOLS, "day", ts="ts", text="event_type")


def symbols_wide(spark, d):
    return job.symbol_frequency(_events(spark, d), SYMBOLS, "hour", ts="ts", text="event_type", wide=True)


def symbols_many(spark, d):
    """More symbols than get a sum each: letters, and the pairs of them."""
    letters = "abcdefghij"
    pairs = list(letters) + [a + b for a in letters for b in "eiru"]
    return job.symbol_frequency(_events(spark, d), pairs, "day", ts="ts", text="event_type")


_LETTERS = """SELECT unnest(['a','b','c','d','e','f','g','h','i','j']) AS a"""
_SPINE_DAYS = """SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)),
  INTERVAL 1 day)) AS bucket FROM events"""


def _symbol_sql(symbols: str) -> str:
    return f"""WITH symbols AS ({symbols}), spine AS ({_SPINE_DAYS}),
hits AS (SELECT date_trunc('day', ts) AS bucket, symbol, count(*) AS n FROM events, symbols
  WHERE contains(lower(event_type), symbol) GROUP BY 1, 2)
SELECT CAST(spine.bucket AS TIMESTAMP) AS bucket, symbols.symbol AS symbol, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM spine CROSS JOIN symbols LEFT JOIN hits ON hits.bucket = spine.bucket AND hits.symbol = symbols.symbol"""


def threads_by_day(spark, d):
    rows = job.threads_by_day(threads(spark, d))
    return rows.select(F.col("opening.no").alias("no"), _text_day(), F.size("posts").cast("bigint").alias("posts"))


def submissions_by_day(spark, d):
    return job.split_by_day(submissions(spark, d)).select("id", _text_day())


def thread_day_report(spark, d):
    rows = threads(spark, d).select(job.opening_time(F.col("opening.time")).alias("created_time"))
    return job.day_report(rows).select(_text_day(), "n")


def _text_day():
    return F.col("day").cast("string").alias("day")


_DAYS = """SELECT CAST(CAST(spine.bucket AS DATE) AS VARCHAR) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM spine LEFT JOIN counts ON counts.bucket = spine.bucket"""

PLANS = {
    "frequency_minute": frequency("minute"),
    "frequency_hour": frequency("hour"),
    "frequency_day": frequency("day"),
    "frequency_hour_errors": Plan(
        frequency_errors,
        "WITH " + _frequency_sql("hour", "(SELECT ts FROM events WHERE event_type = 'error')") + _FILLED,
    ),
    "frequency_day_new_york": Plan(
        frequency_new_york,
        # January, the month of the events, has one offset: five hours.
        "WITH " + _frequency_sql("day", "(SELECT ts - INTERVAL 5 hour AS ts FROM events)") + _FILLED,
    ),
    "frequency_threads": Plan(
        thread_frequency, over("threads", _FILLED, _frequency_sql("hour", "threads"))
    ),
    "frequency_reddit": Plan(
        reddit_frequency,
        over(
            "submissions comments",
            _FILLED,
            _frequency_sql("hour", "(SELECT ts FROM submissions UNION ALL SELECT ts FROM comments)"),
        ),
    ),
    "symbol_frequency": Plan(
        symbols_long, _symbol_sql("SELECT unnest(['i', 'err', 'view']) AS symbol")
    ),
    "symbol_frequency_wide": Plan(
        symbols_wide,
        """WITH counts AS (SELECT date_trunc('hour', ts) AS bucket,
  sum(contains(event_type, 'i')::INT) AS i, sum(contains(event_type, 'err')::INT) AS err,
  sum(contains(event_type, 'view')::INT) AS "view" FROM events GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 hour)) AS bucket FROM counts)
SELECT CAST(spine.bucket AS TIMESTAMP) AS bucket, CAST(coalesce(i, 0) AS BIGINT) AS i,
  CAST(coalesce(err, 0) AS BIGINT) AS err, CAST(coalesce("view", 0) AS BIGINT) AS "view"
FROM spine LEFT JOIN counts ON counts.bucket = spine.bucket""",
    ),
    "symbol_frequency_many": Plan(
        symbols_many,
        _symbol_sql(
            f"SELECT a AS symbol FROM ({_LETTERS}) UNION ALL "
            f"SELECT a || b FROM ({_LETTERS}) CROSS JOIN (SELECT unnest(['e','i','r','u']) AS b)"
        ),
    ),
    "threads_by_day": Plan(
        threads_by_day,
        over(
            "threads",
            """SELECT thread_no * 1000 AS no, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS day, count(*) AS posts
FROM thread_posts GROUP BY thread_no""",
        ),
    ),
    "submissions_by_day": Plan(
        submissions_by_day, over("submissions", "SELECT id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM submissions")
    ),
    "thread_day_report": Plan(
        thread_day_report, over("threads", _DAYS, _frequency_sql("day", "threads"))
    ),
}
