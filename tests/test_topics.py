import math

import pytest
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F
from records import THREAD, submission, tweet, url

from townsquare.functions import text as T
from townsquare.operators import topics
from townsquare.sources import posts, sinks
from townsquare.sources.lists import load_topic_model

STOPS = ["the", "And"]


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["cat", "dog", "fish", "bird"], ["gold", "coin", "bank", "loan"]
    texts = []
    for i in range(60):
        side = words[i % 2]
        texts.append((i, " ".join([side[(i // 2 + j) % 4] for j in range(6)] + ["the", "AND"])))
    return spark.createDataFrame(texts, "id long, text string")


@pytest.fixture(scope="module")
def model(corpus):
    return topics.train(corpus, 2, STOPS, max_iter=20, min_tf=1, min_df=2, partitions=2)


def test_corpora(lines, rows):
    table = posts.tweets(
        lines(
            tweet(1), tweet(2, lang="EN"), tweet(3, lang="de"), tweet(4, lang=None),
            tweet(5, retweeted_status=tweet(9)),
            tweet(6, hashtags=[{"text": str(i), "indices": [i]} for i in range(4)]),
            tweet(7, urls=[url(f"http://a.org/{i}") for i in range(3)]),
            tweet(8, urls=[url(f"http://a.org/{i}") for i in range(2)]),
        )
    )
    assert sorted(r.id for r in topics.tweet_corpus(table).collect()) == [1, 2, 8]
    assert topics.tweet_corpus(table, quality=False).count() == 8
    subs = posts.submissions(lines(submission("s", title="T", is_self=True, selftext="no")))
    opening = posts.threads(lines(THREAD, {"posts": []}))
    mixed = topics.mixed_corpus(reddit=topics.submission_corpus(subs), fourchan=topics.thread_corpus(opening))
    assert rows(mixed) == [("fourchan", "fourchan:100", "It's a fine day."), ("reddit", "reddit:s", "T")]


def test_counts_equal_the_vectorizer_of_the_library(spark):
    rows = spark.createDataFrame(
        [(1, "The a a b it's #x"), (2, "a b b B and"), (3, "c a #X"), (4, "the"), (5, None)], "id long, text string"
    )
    steps = RegexTokenizer(gaps=False, pattern=T.TOPIC_WORD, inputCol="text", outputCol="w").transform(rows.dropna())
    steps = StopWordsRemover(stopWords=STOPS, caseSensitive=False, inputCol="w", outputCol="f").transform(steps)
    fitted = CountVectorizer(inputCol="f", outputCol="v", minDF=2, minTF=2).fit(steps)
    vocab = topics.vocabulary(rows, STOPS, min_df=2).collect()
    assert {r.term for r in vocab} == set(fitted.vocabulary)
    assert [(r.term, r.n, r.df) for r in vocab] == [("a", 4, 3), ("b", 4, 2), ("#x", 2, 2)]
    want = set()
    for r in fitted.transform(steps).collect():
        want |= {(r.id, fitted.vocabulary[i], int(n)) for i, n in zip(r.v.indices, r.v.values)}
    got = {tuple(r) for r in topics.term_counts(rows, STOPS, min_tf=2, min_df=2).collect()}
    assert got == want == {(1, "a", 2), (2, "b", 3)}


def test_train_and_describe(model):
    rows = topics.describe(model, 4).collect()
    found = {t: {r.term for r in rows if r.topic == t} for t in (0, 1)}
    assert sorted(map(sorted, found.values())) == [["bank", "coin", "gold", "loan"], ["bird", "cat", "dog", "fish"]]
    assert {r["rank"] for r in rows} == {0, 1, 2, 3}
    sums = topics.topic_terms(model).groupBy("topic").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    assert set(model.vectorizer.vocabulary).isdisjoint({"the", "and"})


def test_training_can_be_repeated(corpus, model):
    again = topics.train(corpus.repartition(5), 2, STOPS, max_iter=20, min_tf=1, min_df=2, partitions=2)
    assert again.vectorizer.vocabulary == model.vectorizer.vocabulary
    a, b = (topics.topic_terms(m).orderBy("topic", "term").collect() for m in (model, again))
    assert [r.weight for r in a] == pytest.approx([r.weight for r in b])


def test_no_vocabulary_is_an_error(corpus):
    with pytest.raises(ValueError):
        topics.train(corpus, 2, min_df=1000)


def test_held_out(spark, corpus, model):
    row = topics.held_out(model, corpus, STOPS, size=0).first()
    assert row.docs == 60 and row.log_likelihood < 0
    sampled = topics.held_out(model, corpus, STOPS, size=20).first()
    assert 5 <= sampled.docs <= 45
    shuffled = corpus.withColumn("text", F.lit("cat gold cat gold"))
    assert row.log_likelihood / 360 > topics.held_out(model, shuffled, STOPS, size=0).first().log_likelihood / 240


def test_bounds_add_up_to_the_likelihood(spark, corpus, model):
    mixed = corpus.unionByName(spark.createDataFrame([(100, "cat gold dog bank cat"), (101, "nothing known"), (102, ""), (103, None)], corpus.schema))
    rows = {r.id: r for r in topics.document_bounds(model, mixed, STOPS).collect()}
    want = topics.held_out(model, mixed, STOPS, size=0).first()
    assert len(rows) == want.docs == 63
    total = sum(r.bound for r in rows.values()) + topics.topics_bound(model)
    assert total == pytest.approx(want.log_likelihood, rel=1e-6)
    assert all(sum(r.weights) == pytest.approx(1 + r.tokens) for r in rows.values())
    assert (rows[101].tokens, rows[101].bound, rows[102].bound) == (0, 0, 0) and rows[100].tokens == 5
    sides = {max((0, 1), key=lambda t: rows[i].weights[t]) for i in range(0, 60, 2)}
    assert len(sides) == 1 and sides != {max((0, 1), key=lambda t: rows[1].weights[t])}


def test_scores_do_not_take_the_model_anew_for_each_document(spark, corpus, model, monkeypatch):
    want = model.lda.logLikelihood(topics.vectorize(corpus, model.vectorizer, STOPS))
    monkeypatch.setattr(type(model.lda), "logLikelihood", lambda *a: pytest.fail("topics x terms for each document"))
    assert topics.held_out(model, corpus, STOPS, size=0).first().log_likelihood == pytest.approx(want, rel=1e-5)
    nothing = topics.held_out(model, corpus.limit(0), STOPS, size=0).first()
    assert nothing.docs == 0 and nothing.log_likelihood == pytest.approx(topics.topics_bound(model))


def test_models_are_taken_over_in_pieces(corpus, model, monkeypatch):
    def read():
        terms = {(r.topic, r.term): r.weight for r in topics.topic_terms(model).collect()}
        bounds = {r.id: r.bound for r in topics.document_bounds(model, corpus, STOPS).collect()}
        return terms, bounds, topics.topics_bound(model), [(r.topic, r["rank"], r.term) for r in topics.describe(model, 5).collect()]

    words = model.vectorizer.vocabulary
    asked = [(r.topic, i, words[t]) for r in model.lda.describeTopics(5).collect() for i, t in enumerate(r.termIndices)]
    whole = read()
    monkeypatch.setattr(topics, "MATRIX_AT_ONCE", 6)  # three terms
    monkeypatch.setattr(type(model.lda), "topicsMatrix", lambda *a: pytest.fail("all of it"))
    monkeypatch.setattr(type(model.lda), "describeTopics", lambda *a: pytest.fail("all of it"))
    parts = read()
    assert len(list(topics._weights(model.lda))) == -(-len(words) // 3) > 1
    assert all(a == pytest.approx(b) for a, b in zip(whole[:3], parts[:3], strict=True))
    assert whole[3] == parts[3] == asked


def test_large_models_wait_for_each_other():
    import threading
    import time

    room, held, most = topics._Room(10), [], []

    def run(size):
        with room.held() as ready:
            ready(size)
            held.append(size)
            most.append(sum(min(s, 10) for s in held))
            time.sleep(0.02)
            held.remove(size)

    threads = [threading.Thread(target=run, args=(size,)) for size in (4, 4, 7, 30, 3, 10, 1)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join(10)
    assert not held and len(most) == 7 and max(most) <= 10 and room.free == 10


def test_terms_are_counted_by_document(spark):
    """Each of a document's terms once, however often it has it; documents without words, and of one id, too."""
    rows = spark.createDataFrame([(1, "a a b"), (1, "a a b"), (2, "b"), (3, "the"), (4, None), (5, "")], "id int, text string")
    found = [tuple(r) for r in topics.vocabulary(rows, ["the"], min_df=1).collect()]
    assert found == [("a", 4, 2), ("b", 3, 3)]
    assert topics.vocabulary(rows, ["the"], min_df=3).collect() == [("b", 3, 3)]


def test_digamma():
    import numpy as np

    x = np.array([1e-3, 0.1, 1, 2, 5.5, 6, 1e6])
    steps = np.array([(math.lgamma(v * (1 + 1e-5)) - math.lgamma(v * (1 - 1e-5))) / (2e-5 * v) for v in x])
    assert np.allclose(topics.digamma(x), steps, rtol=1e-6)
    assert topics.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


def test_training_by_expectation_maximisation(corpus, tmp_path):
    made = topics.train(corpus, 2, STOPS, max_iter=30, min_tf=1, min_df=2, partitions=2, optimizer="em", checkpoint_interval=5)
    assert made.lda.isDistributed()
    rows = topics.describe(made, 4).collect()
    found = {t: {r.term for r in rows if r.topic == t} for t in (0, 1)}
    assert sorted(map(sorted, found.values())) == [["bank", "coin", "gold", "loan"], ["bird", "cat", "dog", "fish"]]
    pets, money = corpus.where("id % 2 = 0"), corpus.where("id % 2 = 1")
    table = topics.purity(made, {"pets": pets, "money": money}, STOPS, size=0).collect()
    assert sorted((r.pets, r.money) for r in table) == [(0, 0), (0, 30), (30, 0)]
    paths = str(tmp_path / "em"), str(tmp_path / "cv")
    sinks.write_topic_model(*made, *paths)
    loaded = topics.TopicModel(*load_topic_model(*paths))
    a, b = (topics.held_out(m, corpus, STOPS, size=0).first() for m in (loaded, made))
    assert a.log_likelihood == pytest.approx(b.log_likelihood) and a.docs == 60
    with pytest.raises(ValueError):
        topics.train(corpus, 2, optimizer="gibbs")


def test_cells_run_at_the_same_time(spark):
    import threading
    import time

    running, most, lock = [0], [0], threading.Lock()

    def cell(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.2)
        with lock:
            running[0] -= 1
        return i * i, spark.range(i).count()

    assert topics._at_once(spark, cell, [(i,) for i in range(8)]) == [(i * i, i) for i in range(8)]
    assert 1 < most[0] <= topics.AT_ONCE and topics._at_once(spark, cell, []) == []


def test_sample_size(spark):
    rows = spark.range(10_000)
    assert topics.sample(rows, 0).count() == 10_000
    assert abs(topics.sample(rows, 1000, seed=3).count() - 1000) < 200
    assert topics.sample(rows.limit(0), 10).count() == 0


def test_purity(spark, corpus, model):
    pets = corpus.where("id % 2 = 0")
    unknown = spark.createDataFrame([("u", "nothing known")], "id string, text string")
    table = topics.purity(model, {"pets": pets, "money": corpus.where("id % 2 = 1"), "other": unknown}, STOPS, size=0)
    rows = {r.topic: (r.pets, r.money, r.other) for r in table.collect()}
    assert rows[-1] == (0, 0, 1)
    assert sorted([rows[0], rows[1]]) == [(0, 30, 0), (30, 0, 0)]
    merged = topics.purity(model, {"other": unknown}, STOPS, size=0, none_row=False)
    assert {r.topic: r.other for r in merged.collect()} == {0: 1, 1: 0}


def test_top_slot(spark):
    rows = spark.createDataFrame([([0.1, 0.5, 0.5],), ([0.0, 0.0],), ([-1.0, -2.0],)], "v array<double>")
    assert [r[0] for r in rows.select(topics.top_slot(F.col("v"))).collect()] == [1, -1, 0]


def test_similarity(spark, model):
    own = topics.topic_terms(model)
    rows = {(r.left_topic, r.right_topic): r.cosine for r in topics.similarity(own, own).collect()}
    assert rows[0, 0] == pytest.approx(1) and rows[1, 1] == pytest.approx(1)
    assert rows[0, 1] == pytest.approx(rows[1, 0]) and rows[0, 1] < 0.5
    schema = "topic int, term string, weight double"
    left = spark.createDataFrame([(0, "a", 3.0), (0, "b", 4.0), (1, "c", 2.0)], schema)
    right = spark.createDataFrame([(0, "a", 1.0), (0, "z", 1.0), (5, "q", 1.0)], schema)
    rows = {(r.left_topic, r.right_topic): r.cosine for r in topics.similarity(left, right).collect()}
    assert rows[0, 0] == pytest.approx(3 / (5 * 2**0.5))
    assert (rows[0, 5], rows[1, 0], rows[1, 5]) == (0, 0, 0)


def test_save_and_load(corpus, model, tmp_path):
    paths = str(tmp_path / "lda"), str(tmp_path / "cv")
    sinks.write_topic_model(*model, *paths)
    loaded = topics.TopicModel(*load_topic_model(*paths))
    a, b = (topics.held_out(m, corpus, STOPS, size=0).first() for m in (loaded, model))
    assert a.docs == b.docs and a.log_likelihood == pytest.approx(b.log_likelihood)


def test_month_ahead(corpus):
    rows = corpus.select(
        F.when(F.col("id") % 2 == 0, "reddit").otherwise("twitter").alias("platform"),
        F.concat(F.lit("2016-0"), (F.col("id") / 20).cast("int") + 7).alias("month"), "id", "text",
    )
    grid = topics.month_ahead(rows, [2], stopwords=STOPS, size=0, max_iter=2, min_tf=1, min_df=2).collect()
    assert len(grid) == 8
    assert {(r.train, r.test) for r in grid} == {(a, b) for a in ("reddit", "twitter") for b in ("reddit", "twitter")}
    assert all(r.docs == 10 and r.log_likelihood <= 0 for r in grid)
    one = topics.month_ahead(
        rows, [2], stopwords=STOPS, size=0, pairs=[("reddit", "twitter")], max_iter=1, min_tf=1, min_df=2
    ).collect()
    assert [(r.train, r.test, r.month) for r in one] == [("reddit", "twitter", "2016-08"), ("reddit", "twitter", "2016-09")]
    table = topics.purity_ahead(rows, 2, stopwords=STOPS, size=0, max_iter=1, min_tf=1, min_df=2)
    assert {r.train for r in table.collect()} == {"all", "reddit", "twitter"}


def test_gaps_thin_groups_and_single_periods(spark, corpus):
    rows = corpus.select(
        F.when(F.col("id") % 2 == 0, "reddit").otherwise("twitter").alias("platform"),
        F.when(F.col("id") < 30, "2016-12").when(F.col("id") < 45, "2017-01").otherwise("2017-03").alias("month"), "id", "text",
    )
    options = {"stopwords": STOPS, "size": 0, "max_iter": 1, "min_tf": 1, "min_df": 2}
    grid = topics.month_ahead(rows, [2], **options).collect()
    assert {r.month for r in grid} == {"2017-01"} and len(grid) == 4
    thin = spark.createDataFrame([("blog", "2016-12", "x", "once"), ("blog", "2017-01", "y", "again")], rows.select("platform", "month", F.col("id").cast("string"), "text").schema)
    more = rows.withColumn("id", F.col("id").cast("string")).unionByName(thin)
    assert {(r.train, r.test) for r in topics.month_ahead(more, [2], **options).collect()} == {
        (a, b) for a in ("reddit", "twitter") for b in ("reddit", "twitter", "blog")
    }
    table = topics.purity_ahead(more, 2, **options).collect()
    assert {r.train for r in table} == {"all", "reddit", "twitter"} and sum(r.blog for r in table if r.train == "all") == 1
    single = rows.where("month = '2017-03'")
    assert topics.month_ahead(single, [2], **options).collect() == []
    assert topics.purity_ahead(single, 2, **options).columns == ["train", "month", "topic", "reddit", "twitter"]


def test_next_period():
    import datetime

    pairs = [("2016", "2017"), ("2016-12", "2017-01"), ("2016-07", "2016-08"), ("2016-12-31", "2017-01-01"), ("2020-W53", "2021-W01")]
    assert all(topics.next_period(a) == b for a, b in pairs)
    assert topics.next_period(datetime.date(2024, 2, 28)) == datetime.date(2024, 2, 29)


def test_vocabulary_is_not_capped_and_too_large_a_model_is_refused(corpus, monkeypatch):
    assert topics.vocabulary(corpus, min_df=1).count() > topics.vocabulary(corpus, min_df=1, vocab_size=3).count() == 3
    monkeypatch.setattr(topics, "MODEL_AT_MOST", 4)
    with pytest.raises(ValueError, match="terms are too many"):
        topics.train(corpus, 2, min_tf=1, min_df=1)


def test_topics_without_weight_and_beyond_the_spine(spark):
    schema = "topic int, term string, weight double"
    left = spark.createDataFrame([(0, "a", 0.0), (1, "a", 1.0)], schema)
    assert {(r.left_topic, r.cosine) for r in topics.similarity(left, left.where("topic = 1")).collect()} == {(0, 0.0), (1, 1.0)}
    rows = spark.createDataFrame([("p", 9), ("p", 0), ("p", -1)], "platform string, topic int")
    assert {r.topic: r.p for r in topics.purity_table(rows, ["p"], 2).collect()} == {-1: 1, 0: 1, 1: 0, 9: 1}


def test_sample_does_not_depend_on_layout(spark):
    rows = spark.range(3000)
    one, two = (sorted(r.id for r in topics.sample(rows.repartition(n), 2500).collect()) for n in (1, 7))
    assert one == two and abs(len(one) - 2500) < 200 and len(set(one)) < len(one)
