"""Ingest: JSON lines to typed posts, and all platforms in one table.

Every reader takes a DataFrame with one JSON line per row in ``value`` and
keeps that line as ``raw``. Lines that do not decode, or that lack key fields,
are dropped; ``strict=True`` demands every field that is not optional and
well-typed values throughout. A line is decoded once: the required fields are
tested inside the row, since a filter behind the decoding would be moved in
front of it and decode again for each of its conditions.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townsquare.functions.text import plain_text, submission_text, unescape_tweet
from townsquare.functions.time import first_time, from_epoch, parse_date_text
from townsquare.sources import schemas as S

_CORRUPT = "_corrupt"


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Text lines as ``value``; globs, lists, comma lists, .gz and .bz2 work.

    ``partitions`` spreads files that cannot be split (.gz) before decoding.
    """
    if isinstance(paths, str):
        paths = paths.split(",")
    lines = spark.read.text([p.strip() for p in paths])
    return lines.repartition(partitions) if partitions else lines


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _decode(lines: DataFrame, ddl: str, strict: bool, usable: Callable[[Column], Column]) -> DataFrame:
    """``raw`` and the fields of each line whose record is ``usable``."""
    if not strict:
        record = F.from_json("value", ddl)
    else:
        # Tells mistyped values from absent ones.
        with_corrupt = ddl.rstrip()[:-1] + f", {_CORRUPT}: string>"
        mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        record = F.from_json("value", with_corrupt, mode)
    good = F.filter(
        F.array(record), lambda p: usable(p) & p[_CORRUPT].isNull() if strict else usable(p)
    )
    rows = lines.select(F.col("value").alias("raw"), F.explode(good).alias("post"))
    return rows.select("raw", "post.*").drop(_CORRUPT)


def _has(*fields: str) -> Callable[[Column], Column]:
    def usable(record: Column) -> Column:
        return _all([reduce(lambda r, name: r[name], f.split("."), record).isNotNull() for f in fields])

    return usable


# What makes a record usable, for the readers and for mixed lines alike.


def _usable_tweet(record: Column) -> Column:
    keys = _has("text", "created_at", "user.id")(record)
    # Mixed lines have ids as text.
    return keys & record["id"].try_cast("bigint").isNotNull() & parse_date_text(record["created_at"]).isNotNull()


_usable_submission = _has("author", "id", "title", "selftext")
_usable_comment = _has("author", "id", "body", "parent_id")


def _usable_thread(record: Column) -> Column:
    return (F.size(record["posts"]) > 0) & F.forall(record["posts"], _has("no", "time"))


def _both(*tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda record: _all([test(record) for test in tests])


def tweets(
    lines: DataFrame, strict: bool = False, columns: Sequence[str] | None = None, citations: int = 2
) -> DataFrame:
    """Tweets: the fields of the schema, ``created_time`` and ``raw``.

    ``columns`` names the ones to return; no other field is decoded but those
    that a tweet must have. ``citations`` is how deep the tweets that a tweet
    retweets or quotes are read.
    """
    fields = S.tweet(citations)
    wanted = ["raw", *fields, "created_time"] if columns is None else list(columns)
    needed = {"id", "text", "created_at", "user"} | set(wanted)
    if "user" not in wanted and not strict:
        fields["user"] = "struct<id: bigint>"
    usable = _both(_usable_tweet, _has("user.screen_name")) if strict else _usable_tweet
    rows = _decode(lines, S.struct(fields, needed), strict, usable)
    rows = rows.withColumn("text", unescape_tweet(F.col("text")))
    return rows.withColumn("created_time", parse_date_text(F.col("created_at"))).select(*wanted)


def submissions(lines: DataFrame, strict: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Submissions, with ``created_time`` and ``text`` (title, and the body of
    self posts); of ``columns`` alone, if named."""
    keys = S.SUBMISSION_REQUIRED if strict else ["author", "id", "title", "selftext"]
    text = submission_text(F.col("title"), F.col("is_self"), F.col("selftext"))
    return _reddit(lines, S.SUBMISSION, keys, _both(_usable_submission, _has(*keys)), strict, columns, text, ["is_self"])


def comments(lines: DataFrame, strict: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Comments, with ``created_time`` and ``text`` (the body); of ``columns``
    alone, if named."""
    keys = S.COMMENT_REQUIRED if strict else ["author", "id", "body", "parent_id"]
    return _reddit(lines, S.COMMENT, keys, _both(_usable_comment, _has(*keys)), strict, columns, F.col("body"), [])


def _reddit(
    lines: DataFrame,
    fields: dict[str, str],
    keys: list[str],
    usable: Callable[[Column], Column],
    strict: bool,
    columns: Sequence[str] | None,
    text: Column,
    text_needs: list[str],
) -> DataFrame:
    wanted = ["raw", *fields, "created_time", "text"] if columns is None else list(columns)
    needed = {*keys, *wanted}
    if "created_time" in wanted:
        needed |= {"created", "created_utc"}
    if "text" in wanted:
        needed |= {*text_needs}
    rows = _decode(lines, S.struct(fields, needed), strict, usable)
    if "created_time" in wanted:
        rows = rows.withColumn("created_time", first_time(F.col("created_utc"), F.col("created")))
    if "text" in wanted:
        rows = rows.withColumn("text", text)
    return rows.select(*wanted)


def threads(lines: DataFrame, strict: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Threads of one post or more: ``raw``, ``posts`` and ``opening``, the
    first of them. ``columns`` names the fields of a post to decode."""
    fields = S.POST_REQUIRED if strict else ["no", "time"]
    needed = None if columns is None else {*fields, *columns}
    usable = _both(_usable_thread, lambda record: F.forall(record["posts"], _has(*fields)))
    rows = _decode(lines, f"struct<posts: array<{S.struct(S.POST, needed)}>>", strict, usable)
    return rows.select("raw", "posts", F.get("posts", F.lit(0)).alias("opening"))


def thread_posts(thread_rows: DataFrame) -> DataFrame:
    """One row per post of each thread: ``thread_no``, ``pos``, its fields and
    ``text`` without markup."""
    rows = thread_rows.select(
        F.col("opening.no").alias("thread_no"), F.posexplode("posts").alias("pos", "post")
    )
    return rows.select("thread_no", "pos", "post.*").withColumn("text", plain_text(F.col("com")))


def reddit_posts(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Submissions and comments under the view they share, decoded once."""
    shared = ["id", "created", "created_utc", "author", "score", "subreddit", "subreddit_id"]
    keys = S.SUBMISSION_REQUIRED if strict else ["title", "selftext"]
    more = S.COMMENT_REQUIRED if strict else ["body", "parent_id"]
    submission = _both(_usable_submission, _has(*keys))
    comment = _both(_usable_comment, _has(*more))
    needed = {*shared, *keys, *more, "title", "selftext", "is_self", "body", "parent_id"}
    ddl = S.struct({**S.SUBMISSION, **S.COMMENT}, needed)
    rows = _decode(lines, ddl, strict, lambda record: comment(record) | submission(record))
    is_comment = F.col("body").isNotNull() & F.col("parent_id").isNotNull()
    text = submission_text(F.col("title"), F.col("is_self"), F.col("selftext"))
    return rows.select(
        "raw", F.when(is_comment, "comment").otherwise("submission").alias("kind"), "id", "created", "created_utc",
        first_time(F.col("created_utc"), F.col("created")).alias("created_time"), "author", "score", "subreddit",
        "subreddit_id", F.when(is_comment, F.col("body")).otherwise(text).alias("text"),
    )


# One schema that holds what tells the platforms apart and what the common
# table needs, so that a mixed corpus is decoded once. Ids are text here: a
# number for tweets, letters and digits for Reddit. Some fields are for one
# column of the table alone.
_COLUMNS = ["platform", "kind", "id", "author", "created_at", "text", "raw"]


def _any_ddl(columns: Collection[str]) -> str:
    def only(name: str, fields: str) -> str:
        return fields if name in columns else ""

    return f"""struct<
  id: string, text: string, created_at: string, user: struct<id: bigint{only("author", ", screen_name: string")}>,
  author: string, title: string, {only("text", "is_self: boolean, ")}selftext: string, body: string, parent_id: string,
  {only("created_at", "created: bigint, created_utc: bigint, ")}
  posts: array<struct<no: bigint{only("text", ", com: string")}{only("author", ", name: string")}, time: bigint>>>"""


def unified_posts(lines: DataFrame, keep_corrupt: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """All platforms in one table: platform, kind, id, author, created_at,
    text, raw. Rows are told apart by their parsed top-level keys.

    Of a thread the opening post is taken. ``keep_corrupt`` keeps the lines
    that are none of the kinds, with a null platform. ``columns`` names the
    ones to return; what only the others need is not decoded.
    """
    wanted = _COLUMNS if columns is None else list(columns)
    decoded = F.explode(F.array(F.from_json("value", _any_ddl(wanted))))
    rows = lines.select(F.col("value").alias("raw"), decoded.alias("p"))
    p, opening = F.col("p"), F.get(F.col("p.posts"), F.lit(0))

    kind = (
        F.when(_usable_thread(p), "thread")
        .when(_usable_comment(p), "comment")
        .when(_usable_submission(p), "submission")
        .when(_usable_tweet(p), "tweet")
    )
    rows = rows.withColumn("kind", kind)

    def by_kind(**columns: Column) -> Column:
        chosen = F.lit(None)
        for name, column in columns.items():
            chosen = F.when(F.col("kind") == name, column).otherwise(chosen)
        return chosen

    def created_at() -> Column:
        reddit_time = first_time(p["created_utc"], p["created"])
        return by_kind(
            thread=from_epoch(opening["time"]), comment=reddit_time, submission=reddit_time, tweet=parse_date_text(p["created_at"])
        )

    makers = {
        "platform": lambda: by_kind(
            thread=F.lit("fourchan"), comment=F.lit("reddit"), submission=F.lit("reddit"), tweet=F.lit("twitter")
        ),
        "kind": lambda: F.col("kind"),
        "id": lambda: by_kind(thread=opening["no"].cast("string"), comment=p["id"], submission=p["id"], tweet=p["id"]),
        "author": lambda: by_kind(
            thread=opening["name"], comment=p["author"], submission=p["author"], tweet=p["user"]["screen_name"]
        ),
        "created_at": created_at,
        "text": lambda: by_kind(
            thread=plain_text(opening["com"]), comment=p["body"],
            submission=submission_text(p["title"], p["is_self"], p["selftext"]), tweet=unescape_tweet(p["text"]),
        ),
        "raw": lambda: F.col("raw"),
    }
    out = rows if keep_corrupt else rows.where(F.col("kind").isNotNull())
    return out.select(*[makers[name]().alias(name) for name in wanted])


def ingest_report(lines: DataFrame) -> DataFrame:
    """Lines per platform and kind; nulls count the lines that are neither."""
    kinds = unified_posts(lines, keep_corrupt=True, columns=["platform", "kind"])
    return kinds.groupBy("platform", "kind").agg(F.count("*").alias("n"))
