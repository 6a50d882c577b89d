"""Jobs that keep no state also take a streaming table of lines."""

from records import tweet, url

from townsquare.operators import extract, search
from townsquare.sources import posts


def run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_filters_and_edges_of_a_stream(spark, lines, tmp_path):
    folder = str(tmp_path / "in")
    lines(tweet(1, "big news", urls=[url("http://www.e.org")]), tweet(2, "small")).write.text(folder)
    tweets = posts.tweets(spark.readStream.text(folder))
    assert run(spark, search.keyword_filter(tweets, ["big"]).select("id"), "hits") == [(1,)]
    edges = extract.tweet_domain_edges(tweets).select("src", "dst")
    assert run(spark, edges, "edges") == [(1, "e.org")]
    listed = spark.createDataFrame([(2,)], "id long")
    assert run(spark, extract.tweets_by_id(tweets, listed).select("id"), "listed") == [(2,)]
