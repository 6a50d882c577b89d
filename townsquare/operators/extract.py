"""Who posted, which posts by these ids, users or domains, which links.

Id, user and domain lists are tables, matched by a semi join without a hint:
Spark broadcasts a list whose size it has checked to be small and shuffles
both sides otherwise, splitting hot keys (adaptive skew join). Nothing behind
the join needs its partitioning, which is what lets hot keys be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions import links

DELETED = "[deleted]"  # fixed value: author of a removed post


def keep_listed(df: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in the one-column table ``listed``; keeps
    duplicate rows."""
    (name,) = listed.columns
    keys = listed.select(F.col(name).alias("_listed"))
    return df.join(keys, key == F.col("_listed"), "left_semi")


def user_names(posts: DataFrame, author: str = "author", kinds: Sequence[str] | None = None) -> DataFrame:
    """Distinct lower-cased author names, empty ones left out."""
    if kinds is not None:
        posts = posts.where(F.col("kind").isin(list(kinds)))
    names = posts.select(F.lower(F.col(author)).alias("name"))
    return names.where(F.length("name") > 0).distinct()


def user_ids(tweets: DataFrame, user_id: str = "user.id", name: str = "user.screen_name") -> DataFrame:
    """User id and the sorted set of lower-cased names it was seen under.

    Pairs are made distinct first, by hash and already in the map tasks, so a
    busy user arrives as a few names and not as its posts. All names of an id
    are one row, as asked; an id that many users share makes a long one.
    """
    pairs = tweets.select(F.col(user_id).alias("userid"), F.lower(F.col(name)).alias("name"))
    pairs = pairs.where(F.col("userid").isNotNull() & F.col("name").isNotNull()).distinct()
    return pairs.groupBy("userid").agg(F.sort_array(F.collect_list("name")).alias("usernames"))


def tweets_by_id(tweets: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Tweets whose id is listed; duplicates are kept."""
    return keep_listed(tweets, F.col(id_col), ids)


def tweets_by_id_once(
    tweets: DataFrame, ids: DataFrame, id_col: str = "id", raw: str = "raw"
) -> DataFrame:
    """For each listed id its line, the smallest one where there are copies.

    Each task keeps one line per id before anything is shuffled, so an id with
    very many copies is one row per task.
    """
    found = keep_listed(tweets.select(id_col, raw), F.col(id_col), ids)
    return found.groupBy(id_col).agg(F.min(raw).alias(raw))


def tweets_by_user(tweets: DataFrame, user_ids: DataFrame, user_id: str = "user.id") -> DataFrame:
    """Tweets by the listed user ids."""
    return keep_listed(tweets, F.col(user_id), user_ids)


def posts_by_author(
    posts: DataFrame, names: DataFrame, author: str = "author", text: str = "text"
) -> DataFrame:
    """Posts with some text by the listed authors, compared case-blind."""
    (name,) = names.columns
    lowered = names.select(F.lower(F.col(name)).alias("name"))
    return keep_listed(posts.where(F.length(text) > 0), F.lower(F.col(author)), lowered)


def _tweet_links(tweets: DataFrame, user_id: str, urls: str, *keep: Column) -> DataFrame:
    """One row per URL of a tweet that has a registered domain. Domains are
    found inside the row, so that a test on them does not find them again."""
    known = tweets.where(F.col(user_id).isNotNull())
    found = links.domains(links.expanded_urls(F.col(urls)))
    return known.select(F.col(user_id).alias("src"), *keep, F.explode(found).alias("dst"))


def users_by_domain(
    tweets: DataFrame,
    domains: DataFrame,
    user_id: str = "user.id",
    urls: str = "entities.urls",
    distinct: bool = False,
) -> DataFrame:
    """Ids of the users that linked to a listed domain, once per link unless
    ``distinct``."""
    (name,) = domains.columns
    lowered = domains.select(F.lower(F.col(name)).alias("name"))
    found = keep_listed(_tweet_links(tweets, user_id, urls), F.col("dst"), lowered)
    users = found.select(F.col("src").alias("userid"))
    return users.distinct() if distinct else users


def link_counts(tweets: DataFrame, k: int | None = None, citations: int | None = None, raw: str = "raw") -> DataFrame:
    """In how many tweets each URL stands, counting what they retweet or
    quote; the ``k`` most frequent if asked, ties in order of the URL.

    Citations of any depth are read from the tweet's line, ``raw``. With
    ``citations`` they are taken from the decoded fields, so many levels deep.
    """
    if citations is None:
        found = links.cited_urls(F.col(raw))
    else:
        found = links.all_urls(F.struct("entities", "retweeted_status", "quoted_status"), citations)
    urls = tweets.where(F.col("user").isNotNull()).select(F.explode(found).alias("url"))
    return top(urls.groupBy("url").agg(F.count("*").alias("n")), k, "n", "url")


def top(counts: DataFrame, k: int | None, by: str, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties in order of ``tie``."""
    return counts if k is None else counts.orderBy(F.desc(by), F.asc(tie)).limit(k)


def tweet_domain_edges(
    tweets: DataFrame,
    user_id: str = "user.id",
    urls: str = "entities.urls",
    time: str = "created_time",
) -> DataFrame:
    """(src user id, dst domain, time), one row per link."""
    rows = _tweet_links(tweets, user_id, urls, F.col(time).alias("time"))
    return rows.select("src", "dst", "time")


def reddit_domain_edges(submissions: DataFrame, comments: DataFrame) -> DataFrame:
    """(src author, dst domain, time) for the URL of each submission and for
    every link in a comment's body; removed authors are left out."""
    linked = submissions.select("author", "created_time", F.array("url").alias("urls"))
    written = comments.select("author", "created_time", links.links_in_text(F.col("body")).alias("urls"))
    rows = linked.unionByName(written).where(F.lower("author") != DELETED)
    return rows.select(
        F.col("author").alias("src"),
        F.explode(links.domains(F.col("urls"))).alias("dst"),
        F.col("created_time").alias("time"),
    ).select("src", "dst", "time")
