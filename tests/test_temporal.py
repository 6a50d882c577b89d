import datetime as dt

from pyspark.sql import functions as F
from records import THREAD, comment, submission, tweet

from townsquare.operators import temporal
from townsquare.sources import posts, sinks


def at(spark, *times):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t) if t else None,) for t in times], "created_time timestamp")


def test_gaps_are_filled(spark):
    table = at(spark, "2024-01-01 23:58:59", "2024-01-02 00:01:00", "2024-01-02 00:01:30", None)
    got = [(str(r.bucket), r.n) for r in temporal.frequency(table, "-m").collect()]
    assert got == [
        ("2024-01-01 23:58:00", 1), ("2024-01-01 23:59:00", 0), ("2024-01-02 00:00:00", 0), ("2024-01-02 00:01:00", 2),
    ]
    hours = [(str(r.bucket), r.n) for r in temporal.frequency(table, "hour").collect()]
    assert hours == [("2024-01-01 23:00:00", 1), ("2024-01-02 00:00:00", 2)]
    days = [(str(r.bucket)[:10], r.n) for r in temporal.frequency(table, "day").collect()]
    assert days == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_one_bucket_and_none(spark):
    assert [r.n for r in temporal.frequency(at(spark, "2024-01-01 05:00:00"), "hour").collect()] == [1]
    assert temporal.frequency(at(spark, None), "hour").collect() == []
    assert temporal.symbol_frequency(at(spark, None).withColumn("text", F.lit("a")), ["a"], "day").collect() == []


def test_buckets_are_contiguous_and_add_up(spark):
    rows = spark.range(5000).select(
        F.timestamp_seconds(F.lit(1700000000) + F.pmod(F.xxhash64("id"), F.lit(86400 * 9))).alias("created_time")
    )
    for scale, step in (("minute", 60), ("hour", 3600), ("day", 86400)):
        got = temporal.frequency(rows, scale).collect()
        assert sum(r.n for r in got) == 5000
        gaps = {(b.bucket - a.bucket).total_seconds() for a, b in zip(got, got[1:])}
        assert gaps == {float(step)}
        assert got[0].n > 0 and got[-1].n > 0


def test_days_of_another_zone(spark):
    table = at(spark, "2024-03-10 03:00:00", "2024-03-11 03:30:00")
    got = [str(r.bucket)[:10] for r in temporal.frequency(table, "day", tz="America/New_York").collect()]
    assert got == ["2024-03-09", "2024-03-10"]


def test_symbols(spark):
    rows = spark.createDataFrame(
        [
            (dt.datetime(2024, 1, 1, 5), "Buy $ABC and $abc"), (dt.datetime(2024, 1, 1, 7), "nothing"),
            (dt.datetime(2024, 1, 1, 7), "xyz $abc"), (dt.datetime(2024, 1, 1, 9), ""),
        ],
        "created_time timestamp, text string",
    )
    few = temporal.symbol_frequency(rows, ["$ABC", "XYZ", " "], "hour").collect()
    assert [(r.bucket.hour, r.symbol, r.n) for r in few] == [
        (5, "$abc", 1), (5, "xyz", 0), (6, "$abc", 0), (6, "xyz", 0), (7, "$abc", 1), (7, "xyz", 1),
    ]
    wide = temporal.symbol_frequency(rows, ["$abc", "xyz"], "hour", wide=True)
    assert wide.columns == ["bucket", "$abc", "xyz"]
    assert [tuple(r)[1:] for r in wide.collect()] == [(1, 0), (0, 0), (1, 1)]


def test_symbols_long_and_wide_agree(spark):
    rows = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 1800 + 1700000000).alias("created_time"),
        F.concat_ws(" ", F.hex("id"), F.hash("id")).alias("text"),
    )
    symbols = ["1", "2f", "-", "99", "zz"]
    each = {(r["bucket"], r["symbol"]): r["n"] for r in temporal.symbol_frequency(rows, symbols, "day").collect()}
    wide = temporal.symbol_frequency(rows, symbols, "day", wide=True).collect()
    assert each == {(r["bucket"], s): r[s] for r in wide for s in symbols}
    texts = [(r["created_time"].date(), r["text"].lower()) for r in rows.collect()]
    for (bucket, symbol), n in each.items():
        assert n == sum(symbol in text for day, text in texts if day == bucket.date())


def test_no_symbols(spark):
    rows = spark.sql("SELECT timestamp '2024-01-01' AS created_time, 'x' AS text")
    assert temporal.symbol_frequency(rows, [" ", ""], "day").collect() == []
    assert temporal.symbol_frequency(rows, [], "day", wide=True).columns == ["bucket"]


def test_buckets_do_not_depend_on_the_session_zone(spark):
    rows = spark.sql("SELECT timestamp_seconds(1704276000 + id * 40000) AS created_time FROM range(9)").cache()
    want = [temporal.frequency(rows, "day", tz=tz).collect() for tz in ("UTC", "America/New_York")]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [temporal.frequency(rows, "day", tz=tz).collect() for tz in ("UTC", "America/New_York")] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reddit_and_thread_times(lines):
    early = comment("c", created=-5)
    table = lines(submission("s", created=1704279600, created_utc=1704276000), early, comment("d"))
    got = [(r.bucket.hour, r.n) for r in temporal.reddit_frequency(posts.reddit_posts(table), "hour").collect()]
    assert got == [(11, 2)]
    dead = {"posts": [{**THREAD["posts"][0], "time": 0}]}
    got = temporal.thread_frequency(posts.threads(lines(THREAD, THREAD, dead)), "day").collect()
    assert [(str(r.bucket)[:10], r.n) for r in got] == [("2024-01-03", 2)]


def test_split_by_day_in_one_write(spark, lines, tmp_path):
    rows = [submission(f"s{i}", created_utc=1704276000 + i * 43200) for i in range(5)]
    undated = submission("none")
    del undated["created_utc"]
    split = temporal.split_by_day(posts.submissions(lines(*rows, undated)))
    for compact in (True, False):
        out = str(tmp_path / f"days-{compact}")
        sinks.write_by_day(split, out, compact)
        back = spark.read.text(out)
        assert {str(r.day): r["count"] for r in back.groupBy("day").count().collect()} == {
            "2024-01-03": 2, "2024-01-04": 2, "2024-01-05": 1,
        }
        assert posts.submissions(back).count() == 5
    report = temporal.day_report(posts.submissions(lines(rows[0], rows[4])))
    assert [(str(r.day), r.n) for r in report.collect()] == [("2024-01-03", 1), ("2024-01-04", 0), ("2024-01-05", 1)]


def test_counts_are_aggregated_once(spark, tmp_path):
    """The spine and the counts share one scan and one exchange."""
    at(spark, "2024-01-01 05:00:00", "2024-01-01 08:00:00").write.parquet(str(tmp_path / "t"))
    df = temporal.frequency(spark.read.parquet(str(tmp_path / "t")), "hour")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_thread_split(lines):
    days = temporal.threads_by_day(posts.threads(lines(THREAD, {"posts": []}))).select("day").collect()
    assert [str(r.day) for r in days] == ["2024-01-03"]


def test_tweets_by_minute(lines):
    table = posts.tweets(lines(tweet(1), tweet(2, at="Wed Jan 03 10:21:59 +0000 2024")))
    assert [r.n for r in temporal.frequency(table, "minute").collect()] == [1, 1]
