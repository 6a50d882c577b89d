import datetime as dt
import re

from pyspark.sql import functions as F
from records import THREAD, comment, post, submission, tweet, url

from townsquare.operators import extract
from townsquare.sources import posts


def test_thread_has_its_posts(lines):
    thread = posts.threads(lines(THREAD)).first()
    assert len(thread.posts) == 4
    assert {p["name"] for p in thread.posts} == {"Anonymous"}
    assert thread.opening["no"] == 100


def test_plain_text_of_posts(lines):
    found = posts.thread_posts(posts.threads(lines(THREAD), strict=True)).orderBy("pos").collect()
    assert [r.text for r in found] == [
        "It's a fine day.", ">>100 so they say", ">a fine day is it?", "yes & no",
    ]
    assert [r.pos for r in found] == [0, 1, 2, 3]


def test_submission_title_and_text(lines):
    a, b = posts.submissions(
        lines(submission("s1", title="One"), submission("s2", title="Two", is_self=True, selftext="body"))
    ).orderBy("id").collect()
    assert (a.title, a.text) == ("One", "One")
    assert (b.title, b.text) == ("Two", "Two,body")
    assert a.created_time == dt.datetime(2024, 1, 3, 10, 0)


def test_time_falls_back_to_created(lines):
    made = comment("c1", created=1704279600)
    del made["created_utc"]
    none = comment("c2")
    del none["created_utc"]
    got = {r.id: r.created_time for r in posts.comments(lines(made, none)).collect()}
    assert got == {"c1": dt.datetime(2024, 1, 3, 11, 0), "c2": None}


def test_bad_lines_are_dropped(lines):
    good = tweet(1)
    no_id, no_text = tweet(2), tweet(3)
    del no_id["id"], no_text["text"]
    table = lines(good, no_id, no_text, "not json", '{"id": 4, "text": "cut of', "", "[1]", tweet(5, at="yesterday"))
    assert [r.id for r in posts.tweets(table).collect()] == [1]


def test_strict_needs_all_fields_and_types(lines):
    short = comment("c1")
    del short["gilded"]
    mistyped = comment("c2", score="many")
    table = lines(short, mistyped, comment("c3"))
    assert sorted(r.id for r in posts.comments(table).collect()) == ["c1", "c2", "c3"]
    assert [r.id for r in posts.comments(table, strict=True).collect()] == ["c3"]
    bare = {"posts": [{k: v for k, v in post(1).items() if k != "country"}]}
    assert posts.threads(lines(bare)).count() == 1
    assert posts.threads(lines(bare), strict=True).count() == 0


def test_tweet_text_is_unescaped_and_retweet_kept(lines):
    inner = tweet(1, "a &lt;b&gt; &amp;amp;", urls=[url("http://e.org")])
    row = posts.tweets(lines(tweet(2, "x &amp; y", retweeted_status=inner))).first()
    assert row.text == "x & y"
    assert row.retweeted_status.entities.urls[0].expanded_url == "http://e.org"
    assert row.raw.startswith('{"id": 2')


def test_mixed_lines_are_told_apart_by_their_keys(lines, rows):
    """Words of another platform inside a text do not mislead."""
    table = lines(
        tweet(1, 'they said "is_self" and "resto" and parent_id', name="Ann"),
        submission("s1", title='"parent_id"'),
        comment("c1", body='"selftext" "resto"'),
        THREAD,
        "junk",
        {"posts": []},
        {"some": "thing"},
    )
    got = posts.unified_posts(table).select("platform", "kind", "id", "author", "text")
    assert rows(got) == [
        ("fourchan", "thread", "100", "Anonymous", "It's a fine day."),
        ("reddit", "comment", "c1", "Cat", '"selftext" "resto"'),
        ("reddit", "submission", "s1", "Bob", '"parent_id"'),
        ("twitter", "tweet", "1", "Ann", 'they said "is_self" and "resto" and parent_id'),
    ]
    for names in (["author"], ["created_at", "id"], ["text"], ["kind", "raw"]):
        some = posts.unified_posts(table, columns=names)
        assert some.columns == names and rows(some) == rows(posts.unified_posts(table).select(*names))
    pruned = posts.unified_posts(table, columns=["author"])._jdf.queryExecution().executedPlan().toString()
    assert "StructField(com," not in pruned and "StructField(is_self," not in pruned
    report = {(r.platform, r.kind): r.n for r in posts.ingest_report(table).collect()}
    assert report[None, None] == 3 and sum(report.values()) == 7


def test_each_line_is_decoded_once(lines):
    table = lines(tweet(1))
    for df in (posts.tweets(table), posts.tweets(table).select("id"), posts.unified_posts(table).select("id", "author")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json") == 1


def test_reads_gz_and_lists(spark, lines, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    lines(tweet(1)).write.text(a, compression="gzip")
    lines(tweet(2)).write.text(b, compression="bzip2")
    both = posts.tweets(posts.read_lines(spark, f"{a}, {b}", partitions=3))
    assert sorted(r.id for r in both.select("id").collect()) == [1, 2]
    assert both.where(F.col("created_time") == dt.datetime(2024, 1, 3, 10, 20, 30)).count() == 2


def decoded_fields(df):
    """The struct types that the optimized plan decodes lines into."""
    return re.findall(r"from_json\(StructField\(.*?\), value", df._jdf.queryExecution().optimizedPlan().toString())


def test_only_named_fields_are_decoded(lines):
    table = lines(tweet(1, urls=[url("http://e.org")], retweeted_status=tweet(2)))
    (plan,) = decoded_fields(posts.tweets(table, columns=["created_time"]))
    for name in ("entities", "retweeted_status", "quoted_status", "lang", "screen_name"):
        assert name not in plan
    assert posts.tweets(table, columns=["created_time"]).columns == ["created_time"]
    assert posts.submissions(lines(submission("s")), columns=["title"]).first() == ("A title",)
    assert posts.comments(lines(comment("c")), columns=["text", "created_time"]).columns == ["text", "created_time"]
    (plan,) = decoded_fields(posts.reddit_posts(lines(submission("s"), comment("c"))))
    assert "thumbnail" not in plan


def test_citations_are_read_as_deep_as_asked(lines):
    deep = tweet(4, urls=[url("http://d.org")])
    for i in (3, 2, 1):
        deep = tweet(i, urls=[url(f"http://{i}.org")], quoted_status=deep)
    for citations, n in ((1, 2), (2, 3), (3, 4)):
        table = posts.tweets(lines(deep), citations=citations)
        assert extract.link_counts(table, citations=citations).count() == n


def test_report_and_readers_agree_on_bad_lines(lines):
    no_user_id = tweet(2)
    del no_user_id["user"]["id"]
    bad_reply = {"posts": [post(1), {k: v for k, v in post(2).items() if k != "time"}]}
    table = lines(
        tweet(1), no_user_id, tweet(3, at="yesterday"), {**tweet(4), "id": "x"}, THREAD, bad_reply, {"posts": []},
        submission("s"), comment("c"), "junk", '{"id": 5, "text": "cut',
    )
    got = {(r.platform, r.kind): r.n for r in posts.ingest_report(table).collect()}
    assert got == {
        ("twitter", "tweet"): posts.tweets(table).count(), ("fourchan", "thread"): posts.threads(table).count(),
        ("reddit", "submission"): posts.submissions(table).count(), ("reddit", "comment"): posts.comments(table).count(),
        (None, None): 7,
    }
    assert got["twitter", "tweet"] == 1 and posts.reddit_posts(table).count() == 2
