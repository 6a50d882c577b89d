"""Keyword and fielded search, query expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.operators import search as job
from townsquare.operators.tokens import tweet_token_array
from townsquare.plans import Plan, tables
from townsquare.plans.tables import over, table

KEYWORDS = ["the with", "QUE de la", "nicht", " "]

# Fixed pattern: a word, in SQL.
SQL_WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*"


def _documents(spark, d):
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def keyword_filter(spark, d):
    return job.keyword_filter(_documents(spark, d), KEYWORDS).select("id", "lang")


def keyword_filter_tweets(spark, d):
    tweets = tables.tweets(spark, d, "id", "text", "retweeted_status", "raw")
    return job.keyword_filter(tweets, KEYWORDS, job.tweet_search_text()).select("id", "raw").select("id")


def keyword_filter_reddit(spark, d):
    posts = tables.submissions(spark, d).select("id", "text").unionByName(
        tables.comments(spark, d).select("id", "text")
    )
    return job.keyword_filter(posts, ["co.uk la", "SRC1", "the that with"]).select("id")


def keyword_filter_many(spark, d):
    """A long list of queries: each pair of a few syllables."""
    syllables = ["éreç", "schun", "ndthe", "ciónla", "thwh", "auxqueé", "tionre", "ungsch", "osent", "leéeux"]
    return job.keyword_filter(_documents(spark, d), [[a, b] for a in syllables for b in syllables if a != b]).select("id")


def keyword_filter_indexed(spark, d):
    """A list that grows with the tables: neighbouring words of the benchmark, the last word of an item alone."""
    words = table(spark, d, "benchmark").select(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.array(a, b))).alias("words"))
    return job.keyword_filter_indexed(_documents(spark, d), pairs).select("id")


FIELDED = [
    {
        "clauses": [
            {"value": "the"},
            {"value": "with", "occur": "must"},
            {"value": "of the", "kind": "phrase", "occur": "must_not"},
        ]
    },
    {"op": "OR", "clauses": [{"value": "tio*re", "kind": "wildcard"}, {"field": "lang", "value": "DE"}]},
    {"clauses": [{"field": "hashtag", "value": "src3"}, {"field": "url", "value": "blog.", "kind": "prefix"}]},
]


def _searched_tweets(spark, d):
    """What the fields of a tweet are made of, and no more of it, is decoded."""
    return tables.tweets(spark, d, "id", "text", "lang", "user", "entities", "retweeted_status")


def fielded_tweets(spark, d):
    return job.fielded_search(_searched_tweets(spark, d), FIELDED, job.tweet_fields()).select("id")


def fielded_tweets_twice(spark, d):
    """Posts that match more than one of the queries."""
    return job.fielded_search(_searched_tweets(spark, d), FIELDED, job.tweet_fields(), threshold=1.0).select("id")


def fielded_documents(spark, d):
    fields = {"content": T.words(F.lower("text")), "lang": F.array("lang")}
    query = {
        "clauses": [
            {"value": "de"},
            {"value": "la", "occur": "should"},
            {"value": "que", "kind": "prefix", "occur": "must"},
            {"field": "lang", "value": "en", "occur": "must_not"},
        ]
    }
    return job.fielded_search(_documents(spark, d), [query], fields).select("id")


NESTED = {
    "clauses": [
        {"clauses": [{"value": "the"}, {"value": "que"}], "op": "OR"},
        {"clauses": [{"value": "with"}, {"value": "las"}], "op": "OR"},
        {"occur": "must_not", "clauses": [{"value": "was"}, {"value": "on"}]},
    ]
}


def fielded_nested(spark, d):
    """(the OR que) AND (with OR las) AND NOT (was AND on)."""
    return job.fielded_search(_documents(spark, d), [NESTED], {"content": T.words(F.lower("text"))}).select("id")


def fielded_punctuation(spark, d):
    """Values with signs between their words, and around them."""
    queries = [{"clauses": [{"value": "GNU-General"}]}, {"clauses": [{"value": "(License)..."}]}]
    return job.fielded_search(_documents(spark, d), queries, {"content": T.words(F.lower("text"))}).select("id")


def fielded_submissions(spark, d):
    queries = [{"clauses": [{"value": "the"}, {"value": "src7"}]}, {"clauses": [{"value": "le la", "kind": "phrase"}]}]
    return job.fielded_search(tables.submissions(spark, d), queries, job.submission_fields()).select("id")


def bm25_documents(spark, d):
    fields = {"content": T.words(F.lower("text"))}
    queries = [{"op": "OR", "clauses": [{"value": "the"}, {"value": "and"}]}, {"clauses": [{"value": "nicht"}]}]
    return job.fielded_search(_documents(spark, d), queries, fields, threshold=1.0, score="bm25").select("id")


def cooccurring(spark, d):
    return job.cooccurring_terms(_documents(spark, d), KEYWORDS, 50, T.words(F.col("text")))


def cooccurring_tweets(spark, d):
    tweets = tables.tweets(spark, d, "text", "entities", "retweeted_status")
    return job.cooccurring_terms(tweets, KEYWORDS, 50, tweet_token_array(), job.tweet_search_text())


def expand_all(spark, d):
    rows = job.expand_query(_documents(spark, d), KEYWORDS, 50, T.words(F.col("text")), background="all")
    return rows.select("token", F.round("kl", 9).alias("kl"))


def expand_sample(spark, d):
    rows = job.expand_query(_documents(spark, d), KEYWORDS, 50, T.words(F.col("text")))
    return rows.select("token", F.round("kl", 9).alias("kl"))


def kl_by_source(spark, d):
    """Words of the benchmark against words of the documents."""

    def counts(name):
        words = table(spark, d, name).select(F.explode(T.words(F.lower("text"))).alias("token"))
        return words.groupBy("token").agg(F.count("*").alias("n"))

    scores = job.kl_scores(counts("benchmark"), counts("documents"))
    return scores.select("token", F.round("kl", 9).alias("kl"))


SQL_KEYWORDS = """((contains(lower({0}), 'the') AND contains(lower({0}), 'with'))
  OR (contains(lower({0}), 'que') AND contains(lower({0}), 'de') AND contains(lower({0}), 'la'))
  OR contains(lower({0}), 'nicht'))"""
SQL_SEARCHED = "text || ', ' || CASE WHEN event_type = 'click' THEN coalesce(other_text, '') ELSE '' END"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{SQL_WORD}')"


_PADDED = "' ' || array_to_string({0}, ' ') || ' '"
_CONTENT = _PADDED.format(
    _words("lower(text || ' ' || CASE WHEN event_type = 'click' THEN coalesce(other_text, '') ELSE '' END)")
)
_FIELDED = f"""scored AS (SELECT id,
  (contains(c, ' the ') AND contains(c, ' with ') AND NOT contains(c, ' of the '))::INT AS a,
  (regexp_matches(c, ' tio\\S*re ') OR lang = 'de')::INT AS b,
  (hashtag = 'src3' AND coalesce(regexp_matches(url, '^https?://blog\\.'), false))::INT AS c
  FROM (SELECT *, {_CONTENT} AS c FROM tweets))"""


def _expanded(source: str, text: str = "text") -> str:
    """Tokens and bigrams (id, token) of a relation in SQL."""
    return f"""tok AS (SELECT id, lower(t.w) AS w, t.i FROM (
    SELECT id, unnest(list_zip({_words(text)}, range(len({_words(text)})))) AS z FROM {source}),
    LATERAL (SELECT z[1] AS w, z[2] AS i) t),
  expanded AS (SELECT id, w AS token FROM tok
    UNION ALL SELECT a.id, a.w || '_' || b.w FROM tok a JOIN tok b ON b.id = a.id AND b.i = a.i + 1)"""


_EXPAND = f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {_expanded('docs')},
fg AS (SELECT id FROM docs WHERE {SQL_KEYWORDS.format('text')}),
fore AS (SELECT token, count(*) AS n FROM expanded WHERE id IN (SELECT id FROM fg) GROUP BY 1),
back AS (SELECT token, count(*) AS n FROM expanded WHERE id IN (SELECT id FROM BACKGROUND) GROUP BY 1),
totals AS (SELECT (SELECT sum(n) FROM fore)::DOUBLE AS f, (SELECT sum(n) FROM back)::DOUBLE AS b)
SELECT token, round(kl, 9) AS kl FROM (
  SELECT fore.token, (fore.n / f) * (ln(fore.n / f) - ln(coalesce(back.n, 1) / b)) AS kl
  FROM fore LEFT JOIN back ON back.token = fore.token, totals) ORDER BY kl DESC, token LIMIT 50"""

# As many posts as match, drawn by the first 60 bits of the md5 of id and seed.
_DRAWN = """(SELECT id FROM docs WHERE ('0x' || substr(md5(id || ':17'), 1, 15))::BIGINT / 1152921504606846976.0
  < (SELECT count(*) FROM fg) / (SELECT count(*) FROM docs))"""

PLANS = {
    "keyword_filter": Plan(
        keyword_filter, f"SELECT doc_id AS id, lang FROM documents WHERE {SQL_KEYWORDS.format('text')}"
    ),
    "keyword_filter_tweets": Plan(
        keyword_filter_tweets, over("tweets", f"SELECT id FROM tweets WHERE {SQL_KEYWORDS.format('(' + SQL_SEARCHED + ')')}")
    ),
    "keyword_filter_reddit": Plan(
        keyword_filter_reddit,
        over(
            "submissions comments",
            """SELECT id FROM (SELECT id, lower(title || CASE WHEN is_self THEN ',' || selftext ELSE '' END) AS t
  FROM submissions UNION ALL SELECT id, lower(body) FROM comments)
WHERE (contains(t, 'co.uk') AND contains(t, 'la')) OR contains(t, 'src1')
  OR (contains(t, 'the') AND contains(t, 'that') AND contains(t, 'with'))""",
        ),
    ),
    "keyword_filter_many": Plan(
        keyword_filter_many,
        """SELECT doc_id AS id FROM (SELECT doc_id, len(list_filter(
  ['éreç','schun','ndthe','ciónla','thwh','auxqueé','tionre','ungsch','osent','leéeux'],
  lambda s: contains(lower(text), s))) AS hits FROM documents) WHERE hits >= 2""",
    ),
    "keyword_filter_indexed": Plan(
        keyword_filter_indexed,
        r"""WITH b AS (SELECT regexp_extract_all(text, '\S+') AS w FROM benchmark),
q AS (SELECT DISTINCT lower(w[i]) AS a, lower(coalesce(w[i + 1], w[i])) AS b FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM b)),
d AS (SELECT doc_id AS id, lower(text) AS t FROM documents)
SELECT DISTINCT id FROM d JOIN q ON contains(t, a) AND contains(t, b)""",
    ),
    "fielded_tweets": Plan(fielded_tweets, over("tweets", "SELECT id FROM scored WHERE a + b + c > 0", _FIELDED)),
    "fielded_tweets_twice": Plan(
        fielded_tweets_twice, over("tweets", "SELECT id FROM scored WHERE a + b + c > 1", _FIELDED)
    ),
    "fielded_documents": Plan(
        fielded_documents,
        f"""SELECT doc_id AS id FROM (SELECT *, {_words('lower(text)')} AS w FROM documents)
WHERE list_contains(w, 'de') AND len(list_filter(w, lambda x: starts_with(x, 'que'))) > 0 AND lang <> 'en'""",
    ),
    "fielded_submissions": Plan(
        fielded_submissions,
        over(
            "submissions",
            f"""SELECT id FROM (SELECT id, {_PADDED.format(_words("lower(title || ', ' || selftext)"))} AS c FROM submissions)
WHERE (contains(c, ' the ') AND contains(c, ' src7 ')) OR contains(c, ' le la ')""",
        ),
    ),
    "fielded_bm25": Plan(
        bm25_documents,
        f"""SELECT doc_id AS id FROM (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a,
  len(list_filter(w, lambda x: x = 'and')) AS b, len(list_filter(w, lambda x: x = 'nicht')) AS c
  FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents))
WHERE ln(4.0 / 3) * 2.2 * (a / (a + 1.2) + b / (b + 1.2) + c / (c + 1.2)) > 1.0""",
    ),
    "cooccurring_terms": Plan(
        cooccurring,
        f"""WITH docs AS (SELECT doc_id AS id, text FROM documents WHERE {SQL_KEYWORDS.format('text')}), {_expanded('docs')}
SELECT token, count(*) AS n FROM expanded GROUP BY 1 ORDER BY n DESC, token LIMIT 50""",
    ),
    "expand_query_all": Plan(expand_all, _EXPAND.replace("BACKGROUND", "docs")),
    "expand_query_sample": Plan(expand_sample, _EXPAND.replace("BACKGROUND", _DRAWN)),
    "fielded_nested": Plan(
        fielded_nested,
        f"""SELECT doc_id AS id FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents)
WHERE list_has_any(w, ['the', 'que']) AND list_has_any(w, ['with', 'las']) AND NOT list_has_all(w, ['was', 'on'])""",
    ),
    "fielded_punctuation": Plan(
        fielded_punctuation,
        f"""SELECT doc_id AS id FROM (SELECT doc_id, {_PADDED.format(_words('lower(text)'))} AS c FROM documents)
WHERE contains(c, ' gnu general ') OR contains(c, ' license ')""",
    ),
    "kl_scores": Plan(
        kl_by_source,
        f"""WITH fore AS (SELECT unnest({_words('lower(text)')}) AS token, count(*) AS n FROM benchmark GROUP BY 1),
back AS (SELECT unnest({_words('lower(text)')}) AS token, count(*) AS n FROM documents GROUP BY 1),
totals AS (SELECT (SELECT sum(n) FROM fore)::DOUBLE AS f, (SELECT sum(n) FROM back)::DOUBLE AS b)
SELECT fore.token, round((fore.n / f) * (ln(fore.n / f) - ln(coalesce(back.n, 1) / b)), 9) AS kl
FROM fore LEFT JOIN back ON back.token = fore.token, totals""",
    ),
}
