import json

from pyspark.sql import functions as F
from records import tweet, url

from townsquare.operators import extract, temporal
from townsquare.sources import posts, sinks


def read(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_raw_lines_come_out_as_they_went_in(spark, lines, tmp_path):
    table = lines(tweet(1, "ünï &amp; x"), tweet(2))
    sinks.write_raw(posts.tweets(table), str(tmp_path / "raw"))
    assert read(spark, str(tmp_path / "raw")) == sorted(r.value for r in table.collect())
    assert list((tmp_path / "raw").glob("*.gz"))


def test_frequency_lines(spark, lines, tmp_path):
    table = posts.tweets(lines(tweet(1, "a"), tweet(2, "b", at="Wed Jan 03 12:00:00 +0000 2024")))
    sinks.write_frequency(temporal.frequency(table, "hour"), str(tmp_path / "f"))
    assert read(spark, str(tmp_path / "f")) == [
        "Wed Jan 3 10:00:00 +0000 2024, 1", "Wed Jan 3 11:00:00 +0000 2024, 0", "Wed Jan 3 12:00:00 +0000 2024, 1",
    ]
    sinks.write_frequency(temporal.symbol_frequency(table, ["a", "b"], "day", wide=True), str(tmp_path / "s"))
    assert read(spark, str(tmp_path / "s")) == ["Wed Jan 3 00:00:00 +0000 2024, 1, 1"]


def test_edges_links_and_names(spark, lines, tmp_path):
    table = posts.tweets(lines(tweet(1, user=5, urls=[url('http://a.org/"q",x')])))
    edges = extract.tweet_domain_edges(table)
    sinks.write_edges(edges.unionByName(edges.withColumn("time", F.lit(None).cast("timestamp"))), str(tmp_path / "e"))
    assert read(spark, str(tmp_path / "e")) == ['5\ta.org\t{"time":-1}', '5\ta.org\t{"time":1704277230}']
    sinks.write_link_counts(extract.link_counts(table), str(tmp_path / "l"))
    assert read(spark, str(tmp_path / "l")) == ['"http://a.org/""q"",x",1']
    sinks.write_user_names(extract.user_ids(table), str(tmp_path / "u"))
    assert [json.loads(v) for v in read(spark, str(tmp_path / "u"))] == [{"userid": 5, "usernames": ["ann"]}]
