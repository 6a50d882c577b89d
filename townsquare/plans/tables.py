"""Posts of each platform, derived by Spark from the sample tables.

The tables hold no posts, so each platform's records are put together from
them and written as JSON lines, the form the readers take. For each there is a
SQL view of the same records in columns, from which the checks start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townsquare.functions.links import THREE_LABEL_COUNTRIES
from townsquare.functions.time import format_date_text
from townsquare.sources import posts

SUPPLIER_OFFSET = 1_000_000_000  # keeps supplier ids apart from customer ids


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(rows: DataFrame, **fields: Column) -> DataFrame:
    record = F.struct(*[column.alias(name) for name, column in fields.items()])
    return rows.select(F.to_json(record).alias("value"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.date_trunc("second", "ts").alias("ts")
    )


def turn(key: str, rows: DataFrame, id_col: str, times: int = 1) -> Column:
    """The id that an event's number stands for: all ids from 0 on, in turn.
    With ``times``, only each so many-th round has one."""
    n = rows.select(id_col).distinct().count()
    return F.col(key) % (n * times)


def spread(posts: DataFrame, *keys: Column | str) -> DataFrame:
    """Posts dealt out over all tasks by what they meet their texts by. They are few bytes each before that, by which
    Spark would leave millions of them, and all work on their texts, to a few tasks, or send them to the texts."""
    spark = posts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return posts.repartition(tasks, *keys).hint("merge")


# Every event is a post. A tweet has the text of the document whose turn it is,
# and in each fourth round the link of a page. Clicks are retweets of the event
# before, purchases quote it.
_TWEETS = """tweets AS MATERIALIZED (
  SELECT e.event_id AS id, d.lang, e.user_id, e.event_type, d.source AS hashtag, p.page_id, p.url,
    date_trunc('second', e.ts) AS ts, 'User' || e.user_id || '_' || d.source AS screen_name,
    d.text || ' #' || d.source || coalesce(' https://t.co/' || p.page_id, '') AS text,
    oe.event_id AS other_id, o.text AS other_text, oe.user_id AS other_user,
    'User' || oe.user_id || '_' || o.source AS other_name, op.url AS other_url
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
  LEFT JOIN pages p ON p.page_id = e.event_id % (SELECT 4 * count(*) FROM pages)
  LEFT JOIN events oe ON oe.event_id = e.event_id - 1 AND e.event_type IN ('click', 'purchase')
  LEFT JOIN documents o ON o.doc_id = oe.event_id % (SELECT count(*) FROM documents)
  LEFT JOIN pages op ON op.page_id = oe.event_id % (SELECT 4 * count(*) FROM pages))"""


def tweet_lines(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, d, "pages").select("page_id", "url")
    doc, name = turn("event_id", documents, "doc_id"), F.concat(F.lit("User"), F.col("user_id"), F.lit("_"), F.col("source"))
    # Who cites what is settled between rows without a text: there are many more posts than texts.
    posted = (
        _events(spark, d)
        .join(pages, turn("event_id", pages, "page_id", 4) == F.col("page_id"), "left")
        .withColumn("own_doc", doc)
    )
    short = F.concat(F.lit("https://t.co/"), F.col("page_id"))
    links = F.when(
        F.col("url").isNotNull(),
        F.array(F.struct(short.alias("url"), F.col("url").alias("expanded_url"), F.array(F.lit(9999)).alias("indices"))),
    ).otherwise(F.array())
    before = posted.join(documents.select("doc_id"), F.col("own_doc") == F.col("doc_id"), "left_semi").select(
        (F.col("event_id") + 1).alias("event_id"), F.col("own_doc").alias("other_doc"),
        F.struct("event_id", "user_id", links.alias("urls")).alias("cited"),
    )
    cites = F.col("event_type").isin("click", "purchase")
    citing = posted.where(cites).join(before, "event_id", "left")
    alone = posted.where(~cites).unionByName(
        citing.where(F.col("other_doc").isNull()).drop("other_doc", "cited")
    )
    alone = spread(alone, "own_doc").join(documents, F.col("own_doc") == F.col("doc_id"))
    # Two texts that stand in one tweet are put together once, for all tweets that they stand in.
    citing = citing.where(F.col("other_doc").isNotNull())
    others = documents.select(
        F.col("doc_id").alias("other_doc"), F.struct("text", F.col("source")).alias("said")
    )
    both = (
        citing.select("own_doc", "other_doc").distinct()
        .join(others, "other_doc")
        .join(documents, F.col("own_doc") == F.col("doc_id"))
    )
    user = F.struct(F.col("user_id").alias("id"), name.alias("screen_name"))
    cited_name = F.concat(F.lit("User"), F.col("cited.user_id"), F.lit("_"), F.col("said.source"))
    other = F.struct(
        F.col("cited.event_id").alias("id"), F.col("said.text").alias("text"),
        F.struct(F.col("cited.user_id").alias("id"), cited_name.alias("screen_name")).alias("user"),
        F.struct(F.col("cited.urls").alias("urls")).alias("entities"),
    )
    rows = spread(citing, "own_doc", "other_doc").join(both, ["own_doc", "other_doc"]).withColumn("other", other).unionByName(
        alone, allowMissingColumns=True
    )
    text = F.concat("text", F.lit(" #"), "source", F.coalesce(F.concat(F.lit(" "), short), F.lit("")))
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    tag = F.struct(F.col("source").alias("text"), F.array(F.lit(9000)).alias("indices"))
    return _lines(
        rows,
        id=F.col("event_id"),
        text=text,
        created_at=format_date_text(F.col("ts")),
        lang=F.col("lang"),
        user=user,
        entities=F.struct(F.array(tag).alias("hashtags"), links.alias("urls")),
        retweeted_status=F.when(F.col("event_type") == "click", F.col("other")),
        quoted_status=F.when(F.col("event_type") == "purchase", F.col("other")),
    )


def tweets(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return posts.tweets(tweet_lines(spark, d), columns=columns or None)


CHAIN = 12  # events that quote each other


def chain_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a tweet that links to the page whose turn it is and quotes
    the event before it, which quotes the one before, back to the first of a
    dozen. Chains are short, so one is one row on the way."""
    pages = table(spark, d, "pages").select("page_id", "url")
    written = _events(spark, d).join(pages, turn("event_id", pages, "page_id") == F.col("page_id"))
    own = F.struct(
        F.col("event_id").alias("id"), F.lit("see").alias("text"), format_date_text(F.col("ts")).alias("created_at"),
        F.struct(F.col("user_id").alias("id"), F.lit("x").alias("screen_name")).alias("user"),
        F.struct(F.array(F.struct(F.lit("t").alias("url"), F.col("url").alias("expanded_url"))).alias("urls")).alias("entities"),
    )
    chains = written.groupBy(F.floor(F.col("event_id") / CHAIN).alias("chain")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", F.to_json(own).alias("json")))).alias("all")
    )

    def quoting(earlier: Column, one: Column) -> Column:
        return F.concat(F.substr(one["json"], F.lit(1), F.length(one["json"]) - 1), F.lit(',"quoted_status":'), earlier, F.lit("}"))

    places = chains.select("all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("n"))
    return places.select(F.aggregate(F.slice("all", F.lit(1), F.col("n")), F.lit("null"), quoting).alias("value"))


# Every event is a submission of the page whose turn it is, titled with the
# text of the document.
_SUBMISSIONS = """submissions AS MATERIALIZED (
  SELECT 'p' || e.event_id AS id, 'Author_' || e.user_id AS author, p.url, d.text AS title,
    date_trunc('second', e.ts) AS ts, e.event_type = 'click' AS is_self, d.source || ' ' || d.lang AS selftext
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""


def submission_lines(spark: SparkSession, d: str) -> DataFrame:
    pages, documents = table(spark, d, "pages").select("page_id", "url"), table(spark, d, "documents")
    doc = turn("event_id", documents, "doc_id")
    linked = _events(spark, d).join(pages, turn("event_id", pages, "page_id") == F.col("page_id"))
    rows = spread(linked, doc).join(documents, doc == F.col("doc_id"))
    number = F.lit(1).cast("bigint")
    return _lines(
        rows,
        id=F.concat(F.lit("p"), "event_id"),
        author=F.concat(F.lit("Author_"), "user_id"),
        title=F.col("text"),
        selftext=F.concat_ws(" ", "source", "lang"),
        is_self=F.col("event_type") == "click",
        url=F.col("url"),
        created_utc=F.unix_seconds(F.col("ts").cast("timestamp")),
        domain=F.lit("example"), thumbnail=F.lit(""), permalink=F.col("url"), num_comments=number, score=number,
    )


def submissions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return posts.submissions(submission_lines(spark, d), columns=columns or None)


# Every event is posted as the conversation whose turn it is; each of its turns
# is a comment. It names the page with the number of the conversation, once as
# a link in brackets and once by its www name, with brackets inside. Assistants'
# turns were removed.
_CONVERSATION = "c.conv_id = e.event_id % (SELECT count(DISTINCT conv_id) FROM conversations)"
_COMMENTS = f"""comments AS MATERIALIZED (
  SELECT 'c' || e.event_id || '_' || c.turn AS id, date_trunc('second', e.ts) AS ts, p.url,
    CASE WHEN c.role = 'assistant' THEN '[Deleted]' ELSE 'Author_' || e.user_id END AS author,
    c.text || coalesce(' see (' || p.url || '), www.page' || p.page_id || '.co.uk/a_(b).', '') AS body
  FROM events e JOIN conversations c ON {_CONVERSATION} LEFT JOIN pages p ON p.page_id = c.conv_id)"""


def comment_lines(spark: SparkSession, d: str) -> DataFrame:
    conversations = table(spark, d, "conversations")
    said = turn("event_id", conversations, "conv_id")
    rows = (
        spread(_events(spark, d), said)
        .join(conversations, said == F.col("conv_id"))
        .join(table(spark, d, "pages").select("page_id", "url"), F.col("conv_id") == F.col("page_id"), "left")
    )
    seen = F.concat(F.lit(" see ("), "url", F.lit("), www.page"), "page_id", F.lit(".co.uk/a_(b)."))
    number = F.lit(1).cast("bigint")
    author = F.when(F.col("role") == "assistant", "[Deleted]").otherwise(F.concat(F.lit("Author_"), "user_id"))
    thread = F.concat(F.lit("t3_"), "event_id")
    return _lines(
        rows,
        id=F.concat(F.lit("c"), "event_id", F.lit("_"), "turn"),
        author=author,
        body=F.concat("text", F.coalesce(seen, F.lit(""))),
        parent_id=thread, link_id=thread,
        created=F.unix_seconds(F.col("ts").cast("timestamp")),
        controversiality=number, gilded=number, retrieved_on=number, score=number,
    )


def comments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return posts.comments(comment_lines(spark, d), columns=columns or None)


# Every event is a thread too: the turns of its conversation are the posts, in
# HTML with a tag's sign in an attribute and in a comment.
_THREADS = f"""thread_posts AS MATERIALIZED (
  SELECT e.event_id AS thread_no, c.turn AS pos, e.event_id * 1000 + c.turn AS no, c.role || e.user_id AS name,
    trim(regexp_replace(c.text, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text, date_trunc('second', e.ts) AS ts
  FROM events e JOIN conversations c ON {_CONVERSATION}),
threads AS (SELECT * FROM thread_posts WHERE pos = 0)"""


def thread_lines(spark: SparkSession, d: str) -> DataFrame:
    conversations = table(spark, d, "conversations")
    markup = F.col("text")
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#039;"), ("\n", "<br>")):
        markup = F.replace(markup, F.lit(sign), F.lit(reference))
    com = F.concat(F.lit('<span class="quote" title="a>b">'), markup, F.lit("</span><!-- </p> -->"))
    # A thread is one record; its posts are few. The turns of a conversation are put together once, for all
    # threads that it is posted as, so that threads are not dealt out with their texts.
    turns = conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", com.alias("com"), "role")).alias("turns"))
    starts = _events(spark, d).groupBy("event_id").agg(F.collect_list(F.struct("user_id", "ts")).alias("starts"))
    conversation = turn("event_id", conversations, "conv_id")
    rows = spread(starts, conversation).join(turns, conversation == F.col("conv_id"))

    def post(start: Column, said: Column) -> Column:
        return F.struct(
            said["turn"].alias("turn"),
            (F.col("event_id") * 1000 + said["turn"]).alias("no"),
            said["com"].alias("com"),
            F.concat(said["role"], start["user_id"]).alias("name"),
            F.unix_seconds(start["ts"].cast("timestamp")).alias("time"),
            F.when(said["turn"] == 0, 0).otherwise(F.col("event_id") * 1000).alias("resto"),
            F.lit("").alias("now"), F.lit("").alias("country"), F.lit("").alias("country_name"),
        )

    of_start = F.transform("starts", lambda start: F.transform("turns", lambda said: post(start, said)))
    return _lines(rows, posts=F.sort_array(F.flatten(of_start)))


def threads(spark: SparkSession, d: str) -> DataFrame:
    return posts.threads(thread_lines(spark, d))


def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = tweet_lines(spark, d)
    for other in (submission_lines, comment_lines, thread_lines):
        lines = lines.unionByName(other(spark, d))
    return lines


def order_tweets(spark: SparkSession, d: str) -> DataFrame:
    """An order as a tweet by its customer that mentions the supplier of each
    of its lines. Orders have few lines each."""
    mention = F.struct(
        (F.col("l_suppkey") + SUPPLIER_OFFSET).alias("id"),
        F.col("s_name").alias("screen_name"),
        F.array(F.lit(0)).alias("indices"),
    )
    lines = (
        table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey").agg(F.collect_list(mention).alias("user_mentions"))
    )
    rows = (
        table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    )
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("id"), F.col("c_name").alias("screen_name")).alias("user"),
        F.struct("user_mentions").alias("entities"),
        F.col("o_orderdate").alias("created_time"),
    )


VIEWS = {
    "tweets": _TWEETS,
    "submissions": _SUBMISSIONS,
    "comments": _COMMENTS,
    "threads": _THREADS,
}


def over(views: str, query: str, *more: str) -> str:
    """SQL with the named views, and ``more`` of them, in front of ``query``."""
    return "WITH " + ",\n".join([VIEWS[v] for v in views.split()] + list(more)) + "\n" + query


# Fixed pattern: the registered domain of a URL column in SQL.
_COUNTRIES = ", ".join(f"'{country}'" for country in THREE_LABEL_COUNTRIES)


def sql_domain(url: str) -> str:
    host = f"rtrim(lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.')"
    labels = f"string_split({host}, '.')"
    return (
        f"CASE WHEN len({labels}) <= 2 THEN {host} WHEN {labels}[-1] IN ({_COUNTRIES}) "
        f"THEN array_to_string({labels}[-3:], '.') ELSE array_to_string({labels}[-2:], '.') END"
    )
