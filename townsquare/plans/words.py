"""Token tables and plain text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from townsquare.functions import segmentation
from townsquare.functions import text as T
from townsquare.operators import tokens as job
from townsquare.plans import Plan, search, tables
from townsquare.plans.search import SQL_WORD
from townsquare.plans.tables import over, table
from townsquare.session import kept

# The stopwords of the sample runs.
STOPWORDS = ["The", "and", "of", "de", "la", "que", "und", "der"]


def _long(tokens):
    return tokens.withColumn("pos", F.col("pos").cast("bigint"))


def _digest(posts, split):
    """A row per post: how many tokens it has, and a checksum of all of them in order.

    Tokens are handed over post by post, so neither texts nor tokens are dealt out to tell a post's. Only where
    several rows have one id, these are split once more, next to each other.
    """
    spark, kind = posts.sparkSession, dict(posts.dtypes)["id"]
    # Tokens are handed over so many at a time; to weigh each of them, too, would take longer than to split the texts.
    weighed = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(weighed, None)
    spark.conf.set(weighed, str(2**31 - 1))
    try:
        each = kept(split(posts).mapInArrow(by_post, f"doc_id {kind}, n bigint, tokens string"))
    finally:
        spark.conf.unset(weighed) if before is None else spark.conf.set(weighed, before)
    repeated = each.groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("doc_id").alias("again"))
    if repeated.isEmpty():
        return each
    copies = split(posts.join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_semi").repartition("id"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "token")))
    together = copies.groupBy("doc_id").agg(listed.alias("t"))
    together = together.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t.token", " ")).alias("tokens"))
    return each.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left_anti").unionByName(together)


def by_post(batches):
    """(doc_id, n, tokens) of (doc_id, pos, token) rows in which each post's stand in order, from place 0 on."""
    pending = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("pos").to_numpy(zero_copy_only=False) == 0)
        if len(starts):  # the last post may go on in the next batch
            yield from _digested_posts([*pending, batch.slice(0, starts[-1])])
            pending = []
            batch = batch.slice(starts[-1])
        pending.append(batch)
    yield from _digested_posts(pending)


def _digested_posts(batches):
    rows = pa.Table.from_batches(batches).combine_chunks() if batches else ()
    if not len(rows):
        return
    pos, tokens = rows["pos"].to_numpy(), rows["token"].combine_chunks()
    starts = np.flatnonzero(pos == 0)
    n = np.diff(np.append(starts, len(pos)))
    if (pos != np.arange(len(pos)) - np.repeat(starts, n)).any():
        raise ValueError("the tokens of a post do not stand in order")
    listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pos)), pa.int32()), tokens)
    joined = pc.binary_join(listed, " ")
    sums = []
    for i, text in enumerate(joined):
        found = text.as_py() if text.is_valid else " ".join(t for t in listed[i].as_py() if t is not None)
        sums.append(hashlib.md5(found.encode()).hexdigest())
    yield pa.RecordBatch.from_arrays([rows["doc_id"].take(starts).combine_chunks(), pa.array(n, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n", "tokens"])


def tweet_tokens(spark, d):
    return _digest(tables.tweets(spark, d, "id", "text", "entities"), job.tweet_tokens)


def tweet_tokens_bigrams(spark, d):
    return _digest(
        tables.tweets(spark, d, "id", "text", "entities"), lambda posts: job.tweet_tokens(posts, make_bigrams=True, preserve_case=False)
    )


def text_tokens(spark, d):
    """Tokens of texts without entity arrays."""
    rows = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return _long(job.tweet_tokens(rows, entities=None, make_bigrams=True, preserve_case=False))


# A letter of a script without blanks for each one from a to z.
_LATIN, _THAI = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x0E01 + i) for i in range(26))


def segmented_tokens(spark, d):
    """Benchmark texts in a script without blanks, split by the words of the documents."""
    words = table(spark, d, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    )
    counted = words.groupBy(F.translate("word", _LATIN, _THAI).alias("word")).agg(F.count("*").alias("n"))
    texts = table(spark, d, "benchmark").select(
        F.col("item_id").alias("id"), F.replace(F.translate(F.lower("text"), _LATIN, _THAI), F.lit(" "), F.lit("")).alias("text")
    )
    return _long(job.tweet_tokens(texts, entities=None, lexicon=segmentation.lexicon(counted)))


def reddit_tokens(spark, d):
    return _digest(tables.comments(spark, d, "id", "text"), job.reddit_tokens)


def topic_tokens(spark, d):
    return _long(job.topic_tokens(table(spark, d, "documents"), STOPWORDS, id_col="doc_id"))


def plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("text"))


def _numbered(source: str, id_col: str, tokens: str) -> str:
    """(doc_id, pos, token) of a list column in SQL."""
    return f"""SELECT doc_id, CAST(z[2] AS BIGINT) AS pos, z[1] AS token FROM (
  SELECT {id_col} AS doc_id, unnest(list_zip({tokens}, range(len({tokens})))) AS z FROM {source})"""


def _digested(source: str, id_col: str, tokens: str) -> str:
    """The rows of ``_digest`` in SQL."""
    return f"""SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens
FROM (SELECT {id_col} AS doc_id, {tokens} AS t FROM {source}) WHERE len(t) > 0"""


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_WORD}')"


# The tag and the link stand at the end of these tweets, as whole tokens.
_BODY = "left(text, length(text) - length(' #' || hashtag || coalesce(' https://t.co/' || page_id, '')))"
_TWEET = f"{_words(_BODY)} || ['#' || hashtag] || CASE WHEN url IS NULL THEN [] ELSE [url] END"
_FOLDED = "list_transform({0}, lambda t: CASE WHEN starts_with(t, 'http') THEN t ELSE lower(t) END)"
_PAIRED = """list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || '_' || {0}[i + 1]))"""
_MARKED = r"https?://\S+|[#@]\w+|" + SQL_WORD
# What the sample comments hold behind their text.
_SEEN = """CASE WHEN url IS NULL THEN [] ELSE ['see', url, 'www.page' || regexp_extract(body, 'www\\.page(\\d+)\\.co\\.uk', 1)
  || '.co.uk/a_(b)'] END"""
_SAID = "CASE WHEN url IS NULL THEN body ELSE left(body, length(body) - length(' see (' || url || '), www.page.co.uk/a_(b).')" \
        " - length(regexp_extract(body, 'www\\.page(\\d+)\\.co\\.uk/a_\\(b\\)\\.$', 1))) END"

# The cheapest way through each run, place by place, then back from its end.
_SEGMENTED = rf"""WITH RECURSIVE counted AS (
  SELECT translate(w, '{_LATIN}', '{_THAI}') AS word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1),
lex AS (SELECT word, floor(1000 * ln((SELECT sum(n) FROM counted)::DOUBLE / n))::BIGINT AS cost FROM counted),
u AS (SELECT floor(1000 * ln((SELECT sum(n) FROM counted)::DOUBLE))::BIGINT + {segmentation.SURPRISE} AS unknown),
t AS (SELECT item_id AS id, regexp_extract_all(replace(translate(lower(text), '{_LATIN}', '{_THAI}'), ' ', ''),
  '\p{{Thai}}+|[\p{{Latin}}\p{{N}}_]+(?:[''’.][\p{{Latin}}\p{{N}}_]+)*') AS toks FROM benchmark),
parts AS (SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM t),
runs AS (SELECT DISTINCT tok AS run FROM parts WHERE regexp_matches(tok, '^\p{{Thai}}')),
begins AS (SELECT run, unnest(range(length(run))) AS begins FROM runs),
ends AS (SELECT run, begins, unnest(range(begins + 1, least(length(run), begins + (SELECT max(length(word)) FROM lex)) + 1)) AS ends
  FROM begins),
edges AS (SELECT run, begins, ends, cost FROM ends JOIN lex ON word = substr(run, begins + 1, ends - begins)
  UNION ALL SELECT run, begins, begins + 1, unknown FROM begins, u),
best(run, i, b) AS (
  SELECT run, 0::BIGINT, [{{'cost': 0::BIGINT, 'n': 0::BIGINT, 'begins': 0::BIGINT}}] FROM runs
  UNION ALL
  SELECT v.run, v.i + 1, list_append(any_value(v.b),
    min({{'cost': v.b[e.begins + 1].cost + e.cost, 'n': v.b[e.begins + 1].n + 1, 'begins': e.begins}}))
  FROM best v JOIN edges e ON e.run = v.run AND e.ends = v.i + 1 GROUP BY v.run, v.i),
path(run, b, ends) AS (
  SELECT run, b, i FROM best WHERE i = length(run)
  UNION ALL SELECT run, b, b[ends + 1].begins FROM path WHERE ends > 0),
pieces AS (SELECT run, b[ends + 1].begins AS begins, substr(run, b[ends + 1].begins + 1, ends - b[ends + 1].begins) AS piece
  FROM path WHERE ends > 0),
known AS (SELECT run, begins, piece, word IS NULL AS strange FROM pieces LEFT JOIN lex ON word = piece),
grouped AS (SELECT *, CASE WHEN strange THEN begins - row_number() OVER (PARTITION BY run, strange ORDER BY begins) ELSE -1 - begins END AS g
  FROM known),
segments AS (SELECT run, min(begins) AS begins, string_agg(piece, '' ORDER BY begins) AS token FROM grouped GROUP BY run, strange, g)
SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY pos, begins) - 1 AS pos, coalesce(token, tok) AS token
FROM parts LEFT JOIN segments ON run = tok"""

_CLEAN = "html"
for _pattern, _blank in (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>", " "),
    (r"(?i)</?(?:article|body|br|div|footer|h1|head|html|li|meta|nav|p|title|ul)\b[^>]*>", " "),
    (r"</?[A-Za-z][^>]*>", ""),
):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_blank}', 'g')"
for _reference, _sign in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_reference}', '{_sign}')"

PLANS = {
    "cooccurring_terms_tweets": Plan(
        search.cooccurring_tweets,
        over(
            "tweets",
            f"""SELECT token, count(*) AS n FROM (SELECT unnest({_PAIRED.format("t")}) AS token FROM (
  SELECT {_FOLDED.format('(' + _TWEET + ')')} AS t FROM tweets
  WHERE {search.SQL_KEYWORDS.format('(' + search.SQL_SEARCHED + ')')}))
GROUP BY 1 ORDER BY n DESC, token LIMIT 50""",
        ),
    ),
    "tweet_tokens": Plan(tweet_tokens, over("tweets", _digested("tweets", "id", f"({_TWEET})"))),
    "tweet_tokens_bigrams": Plan(
        tweet_tokens_bigrams,
        over(
            "tweets",
            _digested(f"(SELECT id, {_FOLDED.format('(' + _TWEET + ')')} AS t FROM tweets)", "id", _PAIRED.format("t")),
        ),
    ),
    "text_tokens": Plan(
        text_tokens,
        "SELECT * FROM (" + _numbered(
            f"""(SELECT conv_id * 1000 + turn AS id,
    {_FOLDED.format(f"regexp_extract_all(text, '{_MARKED}')")} AS t FROM conversations)""",
            "id",
            _PAIRED.format("t"),
        ) + ")",
    ),
    "segmented_tokens": Plan(segmented_tokens, _SEGMENTED),
    "reddit_tokens": Plan(
        reddit_tokens, over("comments", _digested("comments", "id", f"({_words(_SAID)} || {_SEEN})"))
    ),
    "topic_tokens": Plan(
        topic_tokens,
        _numbered(
            r"""(SELECT doc_id, list_filter(regexp_extract_all(lower(text), '#?[\p{L}\p{N}_.''-]+'),
    lambda t: t NOT IN ('the','and','of','de','la','que','und','der')) AS t FROM documents)""",
            "doc_id",
            "t",
        ),
    ),
    "plain_text": Plan(
        plain_text,
        f"""SELECT page_id, trim(regexp_replace({_CLEAN}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM pages""",
    ),
}
