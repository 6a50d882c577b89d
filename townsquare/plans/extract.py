"""Posts by id, user and domain; names, links and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from townsquare.functions import links
from townsquare.operators import extract as job
from townsquare.plans import Plan, tables
from townsquare.plans.tables import over, sql_domain, table
from townsquare.sources import posts


def user_names(spark, d):
    return job.user_names(posts.unified_posts(tables.mixed_lines(spark, d), columns=["author"]))


def user_ids(spark, d):
    """Users of the events, under the kinds of their events as names."""
    rows = job.user_ids(table(spark, d, "events"), user_id="user_id", name="event_type")
    return rows.select("userid", F.array_join("usernames", ",").alias("usernames"))


def tweets_by_id(spark, d):
    ids = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return job.tweets_by_id(tables.tweets(spark, d), ids).select("id", "text")


def tweets_by_id_once(spark, d):
    """Lines of an order as copies of a tweet; orders of one priority listed."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber").alias("raw")
    )
    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return job.tweets_by_id_once(lines, ids)


def tweets_by_user(spark, d):
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    rows = job.tweets_by_user(table(spark, d, "events"), ids, user_id="user_id")
    return rows.select("event_id", "user_id", "event_type")


def posts_by_author(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("AUTHOR_"), F.col("n_nationkey")).alias("name"))
    lines = tables.submission_lines(spark, d).unionByName(tables.comment_lines(spark, d))
    return job.posts_by_author(posts.reddit_posts(lines), names).select("kind", "id", "author")


def _domains(spark, d):
    """The sites of the pages but one, in capitals."""
    sites = table(spark, d, "pages").select(links.registered_domain(F.col("url")).alias("site")).distinct()
    return sites.where("site <> 'example.net'").select(F.upper("site").alias("domain"))


def users_by_domain(spark, d):
    return job.users_by_domain(tables.tweets(spark, d, "user", "entities"), _domains(spark, d))


def users_by_domain_distinct(spark, d):
    return job.users_by_domain(tables.tweets(spark, d, "user", "entities"), _domains(spark, d), distinct=True)


def _cited(spark, d):
    return tables.tweets(spark, d, "user", "raw")


def link_counts_decoded(spark, d):
    """Citations of two levels from decoded fields."""
    return job.link_counts(tables.tweets(spark, d, "user", "entities", "retweeted_status", "quoted_status"), citations=2)


def link_counts_chain(spark, d):
    """Tweets that quote each other in chains of up to twelve."""
    return job.link_counts(posts.tweets(tables.chain_lines(spark, d), columns=["user", "raw"]))


def link_counts(spark, d):
    return job.link_counts(_cited(spark, d))


def link_counts_top(spark, d):
    return job.link_counts(_cited(spark, d), k=25)


def tweet_domain_edges(spark, d):
    rows = job.tweet_domain_edges(tables.tweets(spark, d, "user", "entities", "created_time"))
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


def reddit_domain_edges(spark, d):
    rows = job.reddit_domain_edges(
        tables.submissions(spark, d, "author", "created_time", "url"), tables.comments(spark, d, "author", "created_time", "body")
    )
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


_LINKS = """links AS (
  SELECT DISTINCT id, regexp_replace(url, '/$', '') AS url FROM (
    SELECT id, url FROM tweets WHERE url IS NOT NULL
    UNION ALL SELECT id, other_url FROM tweets WHERE other_url IS NOT NULL))"""
_COUNTED = "SELECT url, count(*) AS n FROM links GROUP BY url"

PLANS = {
    "user_names": Plan(
        user_names,
        over(
            "tweets submissions comments threads",
            """SELECT DISTINCT lower(author) AS name FROM (SELECT screen_name AS author FROM tweets
UNION ALL SELECT author FROM submissions UNION ALL SELECT author FROM comments
UNION ALL SELECT name FROM threads) WHERE author <> ''""",
        ),
    ),
    "user_ids": Plan(
        user_ids,
        """SELECT user_id AS userid, array_to_string(list_sort(list(DISTINCT lower(event_type))), ',') AS usernames
FROM events GROUP BY user_id""",
    ),
    "tweets_by_id": Plan(
        tweets_by_id,
        over("tweets", "SELECT id, text FROM tweets WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    ),
    "tweets_by_id_once": Plan(
        tweets_by_id_once,
        """SELECT l_orderkey AS id, min(l_partkey || '|' || l_suppkey || '|' || l_linenumber) AS raw FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""",
    ),
    "tweets_by_user": Plan(
        tweets_by_user,
        """SELECT event_id, user_id, event_type FROM events
WHERE user_id IN (SELECT n_nationkey FROM nation)""",
    ),
    "posts_by_author": Plan(
        posts_by_author,
        over(
            "submissions comments",
            """SELECT kind, id, author FROM (
  SELECT 'submission' AS kind, id, author, title AS text FROM submissions
  UNION ALL SELECT 'comment', id, author, body FROM comments)
WHERE length(text) > 0 AND lower(author) IN (SELECT 'author_' || n_nationkey FROM nation)""",
        ),
    ),
    "users_by_domain": Plan(
        users_by_domain,
        over(
            "tweets",
            f"SELECT user_id AS userid FROM tweets WHERE {sql_domain('url')} IN ('example.com', 'example.org')",
        ),
    ),
    "users_by_domain_distinct": Plan(
        users_by_domain_distinct,
        over(
            "tweets",
            f"SELECT DISTINCT user_id AS userid FROM tweets WHERE {sql_domain('url')} IN ('example.com', 'example.org')",
        ),
    ),
    "link_counts": Plan(link_counts, over("tweets", _COUNTED, _LINKS)),
    "link_counts_decoded": Plan(link_counts_decoded, over("tweets", _COUNTED, _LINKS)),
    "link_counts_chain": Plan(
        link_counts_chain,
        f"""WITH e AS MATERIALIZED (SELECT event_id, event_id // {tables.CHAIN} AS chain, url FROM events
  JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages)),
links AS (SELECT DISTINCT a.event_id AS id, regexp_replace(b.url, '/$', '') AS url
  FROM e a JOIN e b ON b.chain = a.chain AND b.event_id <= a.event_id) {_COUNTED}""",
    ),
    "link_counts_top": Plan(link_counts_top, over("tweets", _COUNTED + " ORDER BY n DESC, url LIMIT 25", _LINKS)),
    "tweet_domain_edges": Plan(
        tweet_domain_edges,
        over("tweets", f"SELECT user_id AS src, {sql_domain('url')} AS dst, ts AS time FROM tweets WHERE url IS NOT NULL"),
    ),
    "reddit_domain_edges": Plan(
        reddit_domain_edges,
        over(
            "submissions comments",
            f"""SELECT author AS src, {sql_domain('url')} AS dst, ts AS time FROM (
  SELECT author, url, ts FROM submissions
  UNION ALL SELECT author, unnest(regexp_extract_all(body, '\\b(https?://[^\\s<>")]+|www\\.[^\\s<>"]+co\\.uk)', 1)), ts
    FROM comments)
WHERE lower(author) <> '[deleted]'""",
        ),
    ),
}
