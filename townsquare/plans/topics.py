"""Topic models over documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.operators import topics as job
from townsquare.plans import Plan, tables
from townsquare.plans.tables import over, table
from townsquare.plans.words import STOPWORDS
from townsquare.session import cut, kept, scratch

TOPICS = 5
SAMPLE = 20
TRAINING = {"max_iter": 5, "min_tf": 1, "min_df": 3, "partitions": 8}


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _model(spark, d, corpus=None):
    return job.train(_documents(spark, d) if corpus is None else corpus, TOPICS, STOPWORDS, **TRAINING)


def quality_tweets(spark, d):
    return job.tweet_corpus(tables.tweets(spark, d, "id", "text", "lang", "entities", "retweeted_status"))


def submission_corpus(spark, d):
    return job.submission_corpus(tables.submissions(spark, d, "id", "title"))


def thread_corpus(spark, d):
    return job.thread_corpus(tables.threads(spark, d))


def _corpora(spark, d):
    return {
        "twitter": job.tweet_corpus(tables.tweets(spark, d, "id", "text"), quality=False),
        "reddit": job.submission_corpus(tables.submissions(spark, d, "id", "title")),
        "fourchan": job.thread_corpus(tables.threads(spark, d)),
    }


def mixed_corpus(spark, d):
    return job.mixed_corpus(**_corpora(spark, d))


def term_counts(spark, d):
    return job.term_counts(_documents(spark, d), STOPWORDS, min_tf=3, min_df=5)


def vocabulary(spark, d):
    return job.vocabulary(_documents(spark, d), STOPWORDS, min_df=5)


def vectorized(spark, d):
    """Documents as vectors over the vocabulary, back as rows."""
    terms = vocabulary(spark, d).select("term").toArrow()["term"]  # as the vectorizer needs them
    vectors = job.vectorize(_documents(spark, d), job.vectorizer_of(terms.to_pylist(), min_tf=2), STOPWORDS)
    # A vector has as many slots as there are terms; the ones that it fills are read as they are kept.
    filled = vectors.select("id", F.unwrap_udt("features").alias("f"))
    slots = filled.select("id", F.inline(F.arrays_zip(F.col("f.indices").alias("slot"), F.col("f.values").alias("n")))).where("n > 0")
    known = spark.createDataFrame(pa.table({"slot": pa.array(range(len(terms)), pa.int32()), "term": terms}))
    return slots.join(known, "slot").select("id", "term", F.col("n").cast("bigint").alias("n"))


def _report(model, vocabulary):
    """Per topic how many terms are reported, all different, whether all are in the vocabulary and their weights
    fall, and what the weights over the whole vocabulary add up to."""
    known = job.describe(model).join(vocabulary.select("term", F.lit(True).alias("known")), "term", "left")
    listed = F.sort_array(F.collect_list(F.struct("rank", "weight")))
    reported = known.groupBy("topic").agg(
        F.countDistinct("term").alias("n_terms"), F.every(F.coalesce("known", F.lit(False))).alias("known"),
        F.forall(F.transform(listed, lambda x, i: (x["rank"] == i) & (x["weight"] > 0) & (x["weight"] <= 1)), lambda x: x).alias("ranked"),
        (F.transform(listed, lambda x: x["weight"]) == F.reverse(F.array_sort(F.transform(listed, lambda x: x["weight"])))).alias("falling"),
    )
    whole = job.topic_terms(model).groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("total"))
    return reported.join(whole, "topic")


def _topics_of(corpus):
    """Texts are put together and split into words once, for the model and for the vocabulary that it is held against."""
    spark = corpus.sparkSession
    with scratch(spark) as folder:
        words = cut(job.filtered(corpus, STOPWORDS), f"{folder}/words")
        model = job.train(words, TOPICS, STOPWORDS, **TRAINING)
        return kept(_report(model, job.vocabulary(words, STOPWORDS, min_df=TRAINING["min_df"])))


def topics_of_documents(spark, d):
    return _topics_of(_documents(spark, d))


def topics_of_tweets(spark, d):
    return _topics_of(job.tweet_corpus(tables.tweets(spark, d, "id", "text", "lang", "entities", "retweeted_status")))


def topics_of_mixed(spark, d):
    return _topics_of(mixed_corpus(spark, d).select("id", "text"))


def held_out(spark, d):
    """How many texts a model was scored on, and whether the bounds of the texts add up to the score."""
    model, texts = _model(spark, d), _benchmark(spark, d)
    bounds = job.document_bounds(model, texts, STOPWORDS).agg(F.sum("tokens").alias("tokens"), F.sum("bound").alias("bound"))
    scored = job.held_out(model, texts, STOPWORDS, size=0).join(bounds)  # one row each
    total = F.col("bound") + job.topics_bound(model)
    return scored.select("docs", "tokens", (F.abs(total / F.col("log_likelihood") - 1) < 1e-5).alias("adds_up"))


def held_out_sample(spark, d):
    return job.held_out(_model(spark, d), _benchmark(spark, d), STOPWORDS, size=SAMPLE).select("docs")


def document_bounds(spark, d):
    """Each document's known words, whether its bound is one, and its weights added up: the prior's and a unit per word."""
    rows = job.document_bounds(_model(spark, d), _documents(spark, d), STOPWORDS)
    weights = F.aggregate("weights", F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "id", "tokens", ((F.col("bound") < 0) | (F.col("tokens") == 0)).alias("bounded"), F.round(weights, 4).alias("weights")
    )


def purity(spark, d):
    """The purity table: the texts without a known word, and the others of all topics."""
    corpora = _corpora(spark, d)
    table = job.purity(_model(spark, d), corpora, STOPWORDS, size=0)
    return table.groupBy((F.col("topic") >= 0).alias("known")).agg(
        F.count("*").alias("topics"), *[F.sum(p).alias(p) for p in corpora]
    )


def purity_of_slots(spark, d):
    """Top slot of each vector, as a document's topic weights, per label."""
    vectors = table(spark, d, "embeddings")
    slots = vectors.agg(F.max(F.size("embedding"))).first()[0]
    rows = vectors.select(
        F.concat(F.lit("label"), F.col("label") % 3).alias("platform"),
        job.top_slot(F.col("embedding")).alias("topic"),
    )
    return job.purity_table(rows, ["label0", "label1", "label2"], slots)


def _term_table(spark, d, by):
    """Counted by all that a table may be asked by, so that tables of several share that count."""
    words = table(spark, d, "documents").select("lang", "source", F.explode(T.words(F.lower("text"))).alias("term"))
    # Joins by term ask for this; asked here, it is alike in all branches, which then share one exchange.
    words = words.where(F.col("term").isNotNull())
    counts = words.groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col(by).alias("topic"), "term").agg(F.sum("n").cast("double").alias("weight"))


def similarity(spark, d):
    """Languages against sources, as topics of two models."""
    rows = job.similarity(_term_table(spark, d, "lang"), _term_table(spark, d, "source"))
    return rows.withColumn("cosine", F.round("cosine", 9))


def model_similarity(spark, d):
    """Each topic of a model against each: alike to itself alone, and either way the same."""
    terms = job.topic_terms(_model(spark, d))
    rows = job.similarity(terms, terms).select("left_topic", "right_topic", "cosine")
    turned = rows.select(F.col("left_topic").alias("right_topic"), F.col("right_topic").alias("left_topic"), F.col("cosine").alias("other"))
    return rows.join(turned, ["left_topic", "right_topic"]).select(
        "left_topic", "right_topic", (F.abs(F.col("cosine") - 1) < 1e-9).alias("same"),
        (F.abs(F.col("cosine") - F.col("other")) < 1e-9).alias("symmetric"), F.col("cosine").between(0, 1 + 1e-9).alias("bounded"),
    )


def _dated(spark, d):
    """Events with the text of the document whose turn it is, by week of the
    year; even and odd sources stand for two platforms."""
    documents = table(spark, d, "documents")
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    thursday = F.date_add(F.date_trunc("week", "day").cast("date"), 3)
    week = F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear("day"), 2, "0"))
    odd = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2
    doc = tables.turn("event_id", documents, "doc_id")
    rows = tables.spread(events, doc).join(documents, doc == F.col("doc_id"))
    return rows.select(
        F.when(odd == 1, "odd").otherwise("even").alias("platform"), week.alias("week"), F.col("event_id").alias("id"), "text"
    )


_GRID = {"period": "week", "max_iter": 2, "min_tf": 1, "min_df": 3, "partitions": 8}


def month_ahead(spark, d):
    """Which models were scored on what, on how many texts, and whether the score is one."""
    rows = job.month_ahead(_dated(spark, d), [3], stopwords=STOPWORDS, size=0, **_GRID)
    return rows.withColumn("scored", F.col("log_likelihood") < 0).drop("log_likelihood")


def purity_ahead(spark, d):
    """The purity tables added up over their topics, and how many of these there are."""
    rows = job.purity_ahead(_dated(spark, d), 3, stopwords=STOPWORDS, size=0, **_GRID)
    return rows.groupBy("train", "week").agg(
        F.countDistinct("topic").alias("topics"), F.sum("even").alias("even"), F.sum("odd").alias("odd")
    )


_STOPS = ", ".join("'" + w.lower() + "'" for w in STOPWORDS)
_COUNTS = rf"""counts AS (SELECT id, term, count(*) AS n FROM (SELECT doc_id AS id,
    unnest(regexp_extract_all(lower(text), '#?[\p{{L}}\p{{N}}_.''-]+')) AS term FROM documents)
  WHERE term NOT IN ({_STOPS}) GROUP BY ALL)"""
_TERM = r"'#?[\p{L}\p{N}_.''-]+'"
_KNOWN = f"known AS (SELECT term FROM counts GROUP BY term HAVING count(*) >= {TRAINING['min_df']})"  # to a model of the documents
_VOCABULARY = "SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 5"
_MIXED = """SELECT 'twitter' AS platform, 'twitter:' || id AS id, text FROM tweets
UNION ALL SELECT 'reddit', 'reddit:' || id, title FROM submissions
UNION ALL SELECT 'fourchan', 'fourchan:' || no, text FROM threads"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*')"

_QUALITY = "lang = 'en' AND (event_type <> 'click' OR other_id IS NULL)"


def _reported(views: str, corpus: str) -> str:
    """As many terms per topic as are reported, or as there are."""
    size = f"""size AS (SELECT count(*) AS n FROM (SELECT term FROM (
  SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '#?[\\p{{L}}\\p{{N}}_.''-]+')) AS term FROM ({corpus}))
  WHERE term NOT IN ({_STOPS}) GROUP BY term HAVING count(*) >= {TRAINING["min_df"]}))"""
    return over(
        views, f"SELECT CAST(t AS INT) AS topic, least(n, {job.TERMS_PER_TOPIC})::BIGINT AS n_terms, true AS known, true AS ranked, true AS falling, 1.0::DOUBLE AS total FROM range({TOPICS}) r(t), size", size
    )


_WEEKS = """d AS (SELECT CASE WHEN regexp_extract(source, '(\\d+)', 1)::INT % 2 = 1 THEN 'odd' ELSE 'even' END AS platform,
  date_trunc('week', ts)::DATE AS monday, text
  FROM events JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)),
n AS (SELECT platform, monday, strftime(monday, '%G-W%V') AS week, count(*) AS docs FROM d WHERE text IS NOT NULL GROUP BY ALL)"""

PLANS = {
    "quality_tweets": Plan(
        quality_tweets,
        over("tweets", f"SELECT id, text FROM tweets WHERE {_QUALITY}"),
    ),
    "submission_corpus": Plan(submission_corpus, over("submissions", "SELECT id, title AS text FROM submissions")),
    "thread_corpus": Plan(thread_corpus, over("threads", "SELECT no AS id, text FROM threads")),
    "mixed_corpus": Plan(mixed_corpus, over("tweets submissions threads", _MIXED)),
    "term_counts": Plan(
        term_counts,
        f"""WITH {_COUNTS} SELECT id, term, n FROM counts
WHERE n >= 3 AND term IN (SELECT term FROM counts GROUP BY term HAVING count(*) >= 5)""",
    ),
    "vocabulary": Plan(vocabulary, f"WITH {_COUNTS} {_VOCABULARY}"),
    "vectorized": Plan(
        vectorized,
        f"WITH {_COUNTS} SELECT id, term, n FROM counts WHERE n >= 2 AND term IN (SELECT term FROM ({_VOCABULARY}))",
    ),
    "topics_of_documents": Plan(topics_of_documents, _reported("", "SELECT doc_id AS id, text FROM documents")),
    "topics_of_tweets": Plan(topics_of_tweets, _reported("tweets", f"SELECT id, text FROM tweets WHERE {_QUALITY}")),
    "topics_of_mixed": Plan(topics_of_mixed, _reported("tweets submissions threads", f"SELECT id, text FROM ({_MIXED})")),
    "held_out_likelihood": Plan(
        held_out,
        f"""WITH {_COUNTS}, {_KNOWN},
w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), {_TERM})) AS term FROM benchmark)
SELECT (SELECT count(*) FROM benchmark WHERE text IS NOT NULL) AS docs,
  (SELECT count(*) FROM w WHERE term IN (SELECT term FROM known)) AS tokens, true AS adds_up""",
    ),
    "document_bounds": Plan(
        document_bounds,
        f"""WITH {_COUNTS}, {_KNOWN},
t AS (SELECT id, sum(n)::BIGINT AS tokens FROM counts WHERE term IN (SELECT term FROM known) GROUP BY id)
SELECT doc_id AS id, coalesce(tokens, 0) AS tokens, true AS bounded, 1.0::DOUBLE + coalesce(tokens, 0) AS weights
FROM documents LEFT JOIN t ON id = doc_id WHERE text IS NOT NULL""",
    ),
    "held_out_likelihood_sample": Plan(
        held_out_sample,
        f"""WITH b AS (SELECT ('0x' || substr(md5(item_id || ':17'), 1, 15))::BIGINT / 1152921504606846976.0 AS u FROM benchmark),
m AS (SELECT {SAMPLE} / count(*) AS mean FROM benchmark),
p AS (SELECT j, sum(exp(-mean) * pow(mean, j) / gamma(j + 1)) OVER (ORDER BY j) AS below FROM m, range(60) r(j))
SELECT CAST(coalesce(sum((below <= u)::INT), 0) AS BIGINT) AS docs FROM b, p""",
    ),
    "topic_purity": Plan(
        purity,
        over(
            "tweets submissions threads",
            f"""SELECT known, CASE WHEN known THEN {TOPICS} ELSE 1 END AS topics,
  count(*) FILTER (platform = 'twitter') AS twitter, count(*) FILTER (platform = 'reddit') AS reddit,
  count(*) FILTER (platform = 'fourchan') AS fourchan
FROM (SELECT platform, hit IS NOT NULL AS known FROM posts LEFT JOIN hits ON hit = r)
RIGHT JOIN (VALUES (true), (false)) v(known) USING (known) GROUP BY known""",
            _COUNTS, _KNOWN,
            f"posts AS MATERIALIZED (SELECT row_number() OVER () AS r, platform, text FROM ({_MIXED}) WHERE text IS NOT NULL)",
            f"""hits AS (SELECT DISTINCT r AS hit FROM (
  SELECT r, unnest(regexp_extract_all(lower(text), {_TERM})) AS term FROM posts) WHERE term IN (SELECT term FROM known))""",
        ),
    ),
    "purity_table": Plan(
        purity_of_slots,
        """WITH t AS (SELECT label % 3 AS l, CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN -1
    ELSE list_position(embedding, list_max(embedding)) - 1 END AS topic FROM embeddings)
SELECT CAST(s.topic AS INT) AS topic, CAST(coalesce(sum((l = 0)::INT), 0) AS BIGINT) AS label0,
  CAST(coalesce(sum((l = 1)::INT), 0) AS BIGINT) AS label1, CAST(coalesce(sum((l = 2)::INT), 0) AS BIGINT) AS label2
FROM (SELECT unnest(range(-1, (SELECT max(len(embedding)) FROM embeddings))) AS topic) s LEFT JOIN t ON t.topic = s.topic GROUP BY 1""",
    ),
    "topic_similarity": Plan(
        similarity,
        f"""WITH t AS (SELECT lang, source, unnest({_WORDS}) AS term FROM documents),
l AS (SELECT lang AS topic, term, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
r AS (SELECT source AS topic, term, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
ln AS (SELECT topic, sqrt(sum(w * w)) AS norm FROM l GROUP BY 1), rn AS (SELECT topic, sqrt(sum(w * w)) AS norm FROM r GROUP BY 1),
dots AS (SELECT l.topic AS a, r.topic AS b, sum(l.w * r.w) AS dot FROM l JOIN r ON r.term = l.term GROUP BY 1, 2)
SELECT ln.topic AS left_topic, rn.topic AS right_topic, round(coalesce(dot, 0) / (ln.norm * rn.norm), 9) AS cosine
FROM ln CROSS JOIN rn LEFT JOIN dots ON dots.a = ln.topic AND dots.b = rn.topic""",
    ),
    "model_similarity": Plan(
        model_similarity,
        f"""SELECT CAST(a AS INT) AS left_topic, CAST(b AS INT) AS right_topic, a = b AS same, true AS symmetric, true AS bounded
FROM range({TOPICS}) l(a), range({TOPICS}) r(b) WHERE (SELECT count(*) FROM documents) > 0""",
    ),
    "month_ahead": Plan(
        month_ahead,
        f"""WITH {_WEEKS}
SELECT DISTINCT a.platform AS train, n.platform AS test, n.week, 3 AS k, n.docs, true AS scored FROM n a JOIN n ON n.monday = a.monday + 7""",
    ),
    "purity_ahead": Plan(
        purity_ahead,
        f"""WITH {_WEEKS},
t AS (SELECT DISTINCT platform AS train, monday FROM n UNION SELECT 'all', monday FROM n)
SELECT train, n.week, 4 AS topics, CAST(coalesce(sum(docs) FILTER (platform = 'even'), 0) AS BIGINT) AS even,
  CAST(coalesce(sum(docs) FILTER (platform = 'odd'), 0) AS BIGINT) AS odd
FROM t JOIN n ON n.monday = t.monday + 7 GROUP BY ALL""",
    ),
}
