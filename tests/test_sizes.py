"""What is moved between tasks, on tables of the test's own rows."""

import contextlib
import io
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from townsquare.functions import links
from townsquare.functions import text as T
from townsquare.operators import community, search, topics
from townsquare.plans import search as search_plans
from townsquare.plans import tables
from townsquare.plans import topics as topic_plans
from townsquare.plans import words as word_plans


def exchanges(df):
    """(columns, how they are dealt out) of each exchange of a plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    found = re.findall(r"\) Exchange.*\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", out.getvalue())
    return [(re.sub(r"#\d+L?", "", columns).split(", "), how) for columns, how in found]


@pytest.fixture
def shuffled(spark):
    """No table is small enough to be sent to all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def folder(spark, tmp_path):
    """Events 0 to 6, some twice, of three documents, one page and two conversations."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    kinds = ["view", "click", "purchase", "click", None, "purchase", "click"]
    events = [(i, i % 2, kind) for i, kind in enumerate(kinds)] + [(2, 5, "view"), (3, 7, "click"), (None, 1, "view")]
    rows = spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string")
    rows.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    put("documents", [(0, "a & b", "en", "s"), (1, None, "de", "t"), (1, "one", "en", "t")],
        "doc_id bigint, text string, lang string, source string")
    put("pages", [(0, "https://a.org/")], "page_id bigint, url string")
    put("conversations", [(0, 0, "user", "x <y>"), (0, 1, "assistant", "it's"), (1, 0, "user", "z"), (1, 0, "user", None)],
        "conv_id bigint, turn bigint, role string, text string")
    return str(tmp_path)


def test_tweets_are_not_dealt_out_with_their_texts(spark, folder, shuffled):
    dealt = exchanges(tables.tweet_lines(spark, folder))
    by_post = [columns for columns, how in dealt if "event_id" in how]
    assert by_post and not any({"text", "other", "said"} & set(columns) for columns in by_post)


def test_tweets_of_repeated_rows(spark, folder):
    """Every copy of an event with every copy of its text, citing every copy of the one before."""
    found = [json.loads(r.value) for r in tables.tweet_lines(spark, folder).collect()]
    told = sorted(
        (t["id"], t["user"]["id"], t.get("text", ""), *[(k, t[k]["user"]["id"], t[k].get("text", "")) for k in t if "_status" in k])
        for t in found
    )
    # Documents are counted by their ids: two of them, events of odd ids have both texts of the second.
    zero, one = "a &amp; b #s https://t.co/0", "one #t"
    assert [t for t in told if t[0] == 0] == [(0, 0, zero)]
    assert [t for t in told if t[0] == 1] == [(1, 1, x, ("retweeted_status", 0, "a & b")) for x in ("", one)]
    assert [t for t in told if t[0] == 2] == [
        (2, 0, "a &amp; b #s", ("quoted_status", 1, x)) for x in ("", "one")
    ] + [(2, 5, "a &amp; b #s")]
    third = [(3, u, x, ("retweeted_status", o, "a & b")) for u in (1, 7) for x in ("", one) for o in (0, 5)]
    assert [t for t in told if t[0] == 3] == third
    assert {t[0] for t in told} == {0, 1, 2, 3, 5, 6}


def test_threads_are_not_dealt_out_with_their_texts(spark, folder, shuffled):
    dealt = exchanges(tables.thread_lines(spark, folder))
    by_thread = [columns for columns, how in dealt if "event_id" in how]
    assert by_thread and not any(re.search("text|com|post|turns", " ".join(columns)) for columns in by_thread)


def test_threads_of_repeated_rows(spark, folder):
    """An id is one thread, with the turns of its conversation for each of its events."""
    found = {t["posts"][0]["no"]: t["posts"] for t in (json.loads(r.value) for r in tables.thread_lines(spark, folder).collect())}
    assert sorted(found) == [0, 1000, 2000, 3000, 4000, 5000, 6000]
    assert [(p["no"], p["name"], p["resto"]) for p in found[2000]] == [
        (2000, "user0", 0), (2000, "user5", 0), (2001, "assistant0", 2000), (2001, "assistant5", 2000)
    ]
    assert [p["com"] for p in found[0]] == [
        f'<span class="quote" title="a>b">{x}</span><!-- </p> -->' for x in ("x &lt;y&gt;", "it&#039;s")
    ]
    assert [(p["name"], "com" in p) for p in found[3000]] == [("user1", False), ("user7", False), ("user1", True), ("user7", True)]


def test_weights_of_many_documents_are_those_of_each():
    draw = np.random.default_rng(3)
    beta = np.exp(topics.expected_logs(draw.gamma(0.3, 1, (4, 300)) + 0.2)).T.copy()
    alpha, lengths = np.full(4, 0.25), draw.integers(1, 60, 40)
    documents = [draw.choice(300, n, replace=False) for n in lengths]
    counts = [draw.integers(1, 5, n).astype(float) for n in lengths]
    each = [topics.settled_weights(n, beta[at], alpha) for n, at in zip(counts, documents)]
    starts = np.cumsum(lengths) - lengths
    together = topics.settled_weights(np.concatenate(counts), beta[np.concatenate(documents)], alpha, starts=starts)
    assert np.array_equal(together, each)


def test_vectors_are_not_filled_up(spark, tmp_path):
    """As many slots as a document has terms, not as there are terms."""
    documents = [(i, f"tree tree house house car own{i}") for i in range(6)]
    spark.createDataFrame(documents, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, plan = topic_plans.vectorized(spark, str(tmp_path)), io.StringIO()
    assert sorted(map(tuple, rows.collect())) == [(i, term, 2) for i in range(6) for term in ("house", "tree")]
    with contextlib.redirect_stdout(plan):
        rows.explain("extended")
    assert "arrays_zip" in plan.getvalue() and "posexplode" not in plan.getvalue()


def test_whole_topics_are_put_together_in_the_tasks(spark, monkeypatch):
    """The report of a topic's first terms is not asked for all of them."""
    corpus = spark.createDataFrame([(i, "one two two three"[: 3 + 4 * (i % 4)]) for i in range(20)], "id bigint, text string")
    model = topics.train(corpus, 2, max_iter=2, min_tf=1, min_df=1, partitions=2)
    told = {(r.topic, r.term): r.weight for r in topics.describe(model, 10).collect()}
    monkeypatch.setattr(type(model.lda), "describeTopics", lambda *a: pytest.fail("gathers all"))
    rows = topics.topic_terms(model)
    assert rows.dtypes == [("topic", "int"), ("term", "string"), ("weight", "double")]
    assert {(r.topic, r.term): r.weight for r in rows.collect()} == pytest.approx(told)


def test_texts_are_split_once_for_both_sides(spark, tmp_path):
    documents = [(i, f"l{i % 2}", f"s{i % 3}", "one two two") for i in range(6)]
    spark.createDataFrame(documents, "doc_id bigint, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = topic_plans.similarity(spark, str(tmp_path))
        assert sorted(map(tuple, rows.collect())) == [(f"l{i}", f"s{j}", 1.0) for i in range(2) for j in range(3)]
        with contextlib.redirect_stdout(plan):
            rows.explain("formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"(?m)^\(\d+\) Scan parquet", plan.getvalue())) == 1


def test_listed_queries_are_not_dealt_out_with_posts(spark, shuffled):
    """Only the runs of posts are counted; posts meet the list where they are."""
    posts = spark.createDataFrame([(i % 7, f"word{i} common text") for i in range(40)] + [(1, None)], "id int, text string")
    queries = spark.createDataFrame([([f"word{i}", "common"],) for i in range(0, 60, 3)] + [(["x", "common"],)], "words array<string>")
    found = search.keyword_filter_indexed(posts, queries)
    assert sorted(r.text for r in found.collect()) == sorted(r.text for r in search.keyword_filter(posts, [r.words for r in queries.collect()]).collect())
    assert not any({"q_key", "text"} & set(columns) for columns, _ in exchanges(found))


def test_lists_in_pieces_find_the_same(spark, monkeypatch):
    """One id has many texts, and one text many ids."""
    posts = spark.createDataFrame([(i % 5, f"a{i % 12} b c") for i in range(36)] + [(None, "a1 b"), (None, None)], "id int, text string")
    queries = spark.createDataFrame([([f"a{i}", w],) for i in range(0, 12, 3) for w in "bcz"] + [(["a1 b"],)], "words array<string>")
    whole = sorted(map(str, search.keyword_filter_indexed(posts, queries).collect()))
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 2)
    assert sorted(map(str, search.keyword_filter_indexed(posts, queries).collect())) == whole
    assert len(whole) == sum(i % 12 in (0, 1, 3, 6, 9) for i in range(36)) + 1


@pytest.mark.parametrize("total, kind", [(3_000_000_000, "bigint"), (3_000_000_001, "decimal(38,0)")])
def test_gains_are_whole_numbers_that_hold_the_square(spark, total, kind):
    row = f"1L AS community, 2L AS current, {total}L AS w, {total}L AS sigma_tot, {total}L AS node_weight, 0L AS internal"
    gains = spark.sql(f"SELECT {row} UNION ALL SELECT {row.replace(f'{total}L AS w', '0L AS w')}").select(community._gain(total).alias("gain"))
    assert gains.dtypes == [("gain", kind)]
    assert sorted(int(r.gain) for r in gains.collect()) == [-total * total, 0]


@pytest.mark.parametrize("query", ["tweet_tokens", "tweet_tokens_bigrams"])
def test_tokens_are_not_dealt_out(spark, folder, shuffled, query):
    rows = word_plans.PLANS[query].run(spark, folder)
    assert not any({"buf", "token", "pos"} & set(columns) for columns, _ in exchanges(rows))
    # Both copies of an id are one row, with the tokens of both.
    assert {r.doc_id: r.n for r in rows.collect()}.keys() == {0, 1, 2, 3, 5, 6}


@pytest.mark.parametrize("query", ["tweet_tokens", "tweet_tokens_bigrams", "reddit_tokens"])
def test_posts_of_one_row_are_not_dealt_out_by_id(spark, folder, shuffled, query):
    once = spark.read.parquet(f"{folder}/events.parquet").dropDuplicates(["event_id"])
    once.write.parquet(f"{folder}/once/events.parquet")
    for name in ("documents", "pages", "conversations"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        rows.dropDuplicates(rows.columns[: 1 + (name == "conversations")]).write.parquet(f"{folder}/once/{name}.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    rows = word_plans.PLANS[query].run(spark, f"{folder}/once")
    assert not exchanges(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    assert rows.count() == rows.select("doc_id").distinct().count() > 0


def test_tokens_of_a_post_are_told_by_their_places():
    import hashlib

    import pyarrow as pa

    texts = [(1, ["a", "b"]), (2, ["c"]), (None, ["d", None, "e"]), (2, [str(i) for i in range(7)])]
    rows = [(i, pos, token) for i, tokens in texts for pos, token in enumerate(tokens)]
    kind = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("token", pa.string())])
    whole = pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], kind)
    asked = [(i, len(t), hashlib.md5(" ".join(x for x in t if x is not None).encode()).hexdigest()) for i, t in texts]
    for size in (1, 2, 3, 5, 100):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in word_plans.by_post(iter(batches)) for r in b.to_pylist()] == asked
    assert list(word_plans.by_post(iter([]))) == list(word_plans.by_post(iter([whole.slice(0, 0)]))) == []
    with pytest.raises(ValueError):
        list(word_plans.by_post(iter([whole.take(pa.array([0, 5]))])))


@pytest.mark.parametrize("lines", ["tweet_lines", "submission_lines", "comment_lines", "thread_lines"])
def test_posts_meet_their_texts_in_all_tasks(spark, folder, lines):
    """However few bytes they are, and whatever may be sent to all."""
    tasks = spark.sparkContext.defaultParallelism
    rows = getattr(tables, lines)(spark, folder)
    dealt = [how for _, how in exchanges(rows) if "REPARTITION_BY_NUM" in how]
    assert dealt and all(int(re.search(r"(\d+)\), REPARTITION", how)[1]) >= tasks for how in dealt)
    assert rows.rdd.getNumPartitions() >= tasks


def test_texts_are_split_once_for_a_model_and_its_vocabulary(spark, monkeypatch):
    calls, split = [], T.topic_tokens
    monkeypatch.setattr(topics.T, "topic_tokens", lambda *a: calls.append(a) or split(*a))
    corpus = spark.createDataFrame([(i, f"a{i % 3} b{i % 4} the c") for i in range(24)], "id int, text string")
    rows = topic_plans._topics_of(corpus)
    assert len(calls) == 1 and not exchanges(rows)
    found = [tuple(r) for r in rows.orderBy("topic").collect()]
    assert found == [(topic, 8, True, True, True, 1.0) for topic in range(topic_plans.TOPICS)]


@pytest.mark.parametrize("query", ["fielded_tweets", "fielded_tweets_twice"])
def test_tweets_are_decoded_as_far_as_they_are_searched(spark, folder, monkeypatch, query):
    asked, read = [], tables.tweets
    monkeypatch.setattr(tables, "tweets", lambda *a: asked.append(a[2:]) or read(*a))
    assert search_plans.PLANS[query].run(spark, folder).columns == ["id"]
    assert asked and all(columns and not {"raw", "quoted_status"} & set(columns) for columns in asked)


def test_texts_without_the_letters_are_not_split(spark):
    class Loud(search.Words):
        def terms(self):
            return F.transform(super().terms(), lambda t: F.when(t == "other", F.raise_error(F.lit("split"))).otherwise(t))

    rows = spark.createDataFrame([(1, "the src7, le  LA"), (2, "other src"), (3, "other le the la"), (4, None)], "id int, text string")
    queries = [
        {"clauses": [{"value": "the"}, {"value": "src7"}]}, {"clauses": [{"value": "le la", "kind": "phrase"}]},
        {"clauses": [{"value": "zz", "kind": "prefix"}, {"value": "the", "occur": "must_not"}]},
    ]
    for threshold in (0, 1):
        found = search.fielded_search(rows, queries, {"content": Loud(F.lower("text"))}, threshold=threshold)
        assert [r.id for r in found.collect()] == [1]


def test_texts_are_told_apart_as_their_words_are(spark):
    import random

    rng = random.Random(5)
    bits = ["le", "la", "the", "src7", "src", "'", ".", " ", "-", "日本", "カタ", "ไทย", "Le", "İ", "\n", "_", "é"]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)], "id int, text string, lang string")
    text, lang = F.lower("text"), F.array("lang")

    def clause(depth):
        if depth and rng.random() < 0.3:
            return query(depth - 1) | rng.choice([{}, {"occur": "must_not"}])
        if rng.random() < 0.15:
            return {"field": "lang", "value": "de", "occur": rng.choice(["must", "should", "must_not"])}
        kind = rng.choice(["term", "phrase", "prefix", "wildcard"])
        value = rng.choice(["le", "le la", "The", "日", "日 本", "カタ", "l*", "s?c*", "la.the", "le'la", "l", "-", "", "le\nla", "i̇"])
        return {"kind": kind, "value": value, "occur": rng.choice(["must", "should", "must_not", "default"])}

    def query(depth):
        return {"op": rng.choice(["AND", "OR"]), "clauses": [clause(depth) for _ in range(rng.randrange(1, 4))]}

    for i in range(40):
        queries = [query(2) for _ in range(rng.randrange(1, 4))]
        more = {"threshold": [0, 1, -1, 0.5][i % 4], "score": ["matches", "bm25"][i // 4 % 2]}
        told, split = (
            search.fielded_search(rows, queries, {"content": content, "lang": lang}, **more)
            for content in (search.Words(text), T.words(text))
        )
        assert sorted(r.id for r in told.collect()) == sorted(r.id for r in split.collect()), (queries, more)


def test_plain_runs_are_told_without_reading_piece_by_piece(spark, monkeypatch):
    import random

    plain = ["https://a.org/x),", "www.page3.co.uk/a_(b).", "http://a.org/(x)[y]{z}", "http://a.org/x]y(z"]
    other = ["http://a.org/((x))", "http://a.org/(x", "http://a.org/x)http://b.org", "http://a.org/(x]"]
    told = spark.createDataFrame([(r,) for r in plain + other], "r string").select(F.col("r").rlike(links._PLAIN_RUN).alias("p"))
    assert [r.p for r in told.collect()] == [True] * len(plain) + [False] * len(other)
    rng = random.Random(7)
    bits = ["http://", "www.", "a", "/x", "(", ")", "[", "]", "{", "}", ".", "é"]
    runs = [rng.choice(["http://", "www."]) + "".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(2000)]
    table = spark.createDataFrame([(r,) for r in runs], "r string")
    spans = table.select("r", links.link_spans(F.col("r")).alias("spans")).collect()
    monkeypatch.setattr(links, "_PLAIN_RUN", "(?!)")
    assert spans == table.select("r", links.link_spans(F.col("r")).alias("spans")).collect()
