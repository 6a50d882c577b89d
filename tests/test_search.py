import collections
import math
import random

import pytest
from pyspark.sql import functions as F
from records import submission, tweet, url

from townsquare.functions import text as T
from townsquare.operators import search
from townsquare.operators.tokens import tweet_token_array
from townsquare.sources import posts
from townsquare.sources.lists import read_keywords

TEXTS = ["The cat sat on the mat", "A dog and a CAT", "dogs only", "", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_or_of_ands(docs):
    assert ids(search.keyword_filter(docs, [["cat", "mat"], ["DOGS"]])) == [0, 2]
    assert ids(search.keyword_filter(docs, ["dog cat"])) == [1]
    assert ids(search.keyword_filter(docs, ["", " "])) == []
    assert ids(search.keyword_filter(docs, [])) == []
    assert ids(search.keyword_filter(docs, ["o"])) == [0, 1, 2]


def test_many_queries(docs):
    queries = [["cat", "mat"], ["dogs"], ["x"], ["sat", "dog"]] + [[f"no{i}", "cat"] for i in range(200)]
    assert ids(search.keyword_filter(docs, queries)) == [0, 2]


def test_values_are_analysed_like_the_text(spark):
    docs = spark.createDataFrame([(1, "rock-n-roll it's U.S.A."), (2, "rock and roll, USA"), (3, "roll n rock")], "id long, text string")
    assert found(docs, clause("rock-n-roll")) == [1]
    assert found(docs, clause("u.s.a.")) == [1]
    assert found(docs, clause("It's")) == [1]
    assert found(docs, clause("...")) == []
    assert found(docs, clause("rock-n-roll"), score="bm25") == [1]


def test_nested_groups(docs):
    either = {"clauses": [clause("dog"), clause("mat")], "op": "OR"}
    assert found(docs, either, clause("cat")) == [0, 1]
    assert found(docs, {**either, "occur": "must_not"}, clause("cat")) == []
    assert found(docs, {"clauses": [either, clause("the", occur="must_not")]}, clause("cat")) == [1]
    assert found(docs, either, clause("cat"), score="bm25") == [0, 1]


def test_background_sample_is_as_large_as_the_foreground(spark):
    rows = spark.range(200_000).select("id", F.when(F.col("id") < 20, "needle hay").otherwise("hay").alias("text"))
    drawn = rows.where(search.uniform_hash(F.col("id"), 17) < 20 / 200_000).count()
    assert 5 <= drawn <= 45


def test_keywords_see_the_retweeted_text(lines):
    table = posts.tweets(lines(tweet(1, "RT", retweeted_status=tweet(2, "Big News")), tweet(3, "big"), tweet(4, "big news")))
    assert ids(search.keyword_filter(table, ["big news"], search.tweet_search_text())) == [1, 4]


def clause(value, **more):
    return {"value": value, **more}


def found(docs, *clauses, op="AND", **more):
    query = {"clauses": list(clauses)}
    return ids(search.fielded_search(docs, [query], {"content": T.words(F.lower("text"))}, op=op, **more))


def test_clauses(docs):
    assert found(docs, clause("cat"), clause("the")) == [0]
    assert found(docs, clause("cat"), clause("the"), op="OR") == [0, 1]
    assert found(docs, clause("CAT")) == [0, 1]
    assert found(docs, clause("the mat", kind="phrase")) == [0]
    assert found(docs, clause("mat the", kind="phrase")) == []
    assert found(docs, clause("dog", kind="prefix")) == [1, 2]
    assert found(docs, clause("*o?s", kind="wildcard")) == [2]
    assert found(docs, clause("c.t", kind="wildcard")) == []
    assert found(docs, clause("cat"), clause("dog", occur="must_not")) == [0]
    assert found(docs, clause("dog", occur="must_not")) == []
    assert found(docs, clause("cat"), clause("mat", occur="should")) == [0, 1]
    assert found(docs, clause("ca")) == []


def test_wrong_queries_are_refused(docs):
    with pytest.raises(ValueError):
        found(docs, clause("x", field="nonesuch"))
    with pytest.raises(ValueError):
        found(docs, clause("x", kind="fuzzy"))
    with pytest.raises(ValueError):
        found(docs, clause("x"), score="tfidf")


def test_threshold_counts_matching_queries(docs):
    fields = {"content": T.words(F.lower("text"))}
    queries = [{"clauses": [clause("cat")]}, {"clauses": [clause("the")]}]
    assert ids(search.fielded_search(docs, queries, fields)) == [0, 1]
    assert ids(search.fielded_search(docs, queries, fields, threshold=1)) == [0]


def test_bm25_of_a_one_post_index(docs):
    the_twice = math.log(4 / 3) * 2.2 * 2 / (2 + 1.2)
    assert found(docs, clause("the"), score="bm25", threshold=the_twice - 1e-9) == [0]
    assert found(docs, clause("the"), score="bm25", threshold=the_twice + 1e-9) == []
    assert found(docs, clause("ca", kind="prefix"), score="bm25", threshold=0.99) == [0, 1]


def test_fields_of_tweets(lines):
    table = posts.tweets(
        lines(
            tweet(1, "Hi", name="Ann", user=77, hashtags=[{"text": "Big", "indices": [0, 1]}]),
            tweet(2, "yo", lang=None, urls=[url("https://E.org/Path"), url("no scheme")], user=7),
            tweet(3, "RT", user_mentions=[{"id": 1, "screen_name": "Bob", "indices": [0]}], retweeted_status=tweet(4, "Hi all")),
        )
    )

    def with_(field, value, kind="term"):
        query = {"clauses": [{"field": field, "value": value, "kind": kind}]}
        return ids(search.fielded_search(table, [query], search.tweet_fields()))

    assert with_("content", "hi") == [1, 3]
    assert with_("screen_name", "ANN") == [1, 2, 3]
    assert with_("user_id", "7") == [2]
    assert with_("lang", "en") == [1, 3]
    assert with_("hashtag", "big") == [1]
    assert with_("mention", "bob") == [3]
    assert with_("url", "e.org/path") == [2]
    assert with_("url", "*.org*", "wildcard") == [2]
    assert table.columns == search.fielded_search(
        table, [{"clauses": [{"value": "hi"}]}], search.tweet_fields()
    ).columns


def test_submissions_default_to_and(lines):
    table = posts.submissions(lines(submission("a", title="One two", selftext="three"), submission("b", title="One")))
    query = {"clauses": [clause("one"), clause("three")]}
    assert ids(search.fielded_search(table, [query], search.submission_fields())) == ["a"]
    assert ids(search.fielded_search(table, [query], search.submission_fields(), op="OR")) == ["a", "b"]


def test_cooccurring_terms(spark):
    table = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "z z z")], "id long, text string")
    got = search.cooccurring_terms(table, ["a", "c"], 3, T.words(F.col("text"))).collect()
    assert [(r.token, r.n) for r in got] == [("a", 2), ("b", 2), ("a_b", 1)]


def _terms_by_hand(texts, k):
    counts = collections.Counter()
    for words in (t.lower().split() for t in texts if t):
        counts.update(words + [f"{a}_{b}" for a, b in zip(words, words[1:])])
    return sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]


def test_frequent_terms_equal_all_counted(spark):
    """Ties, words that are alike to a bigram or to parts of one, fewer words than are asked for."""
    rng = random.Random(5)
    for words in (["a", "b", "a_b", "_", "b_a_b", "a_", "c"], list("abcdefgh") + ["a_b", "c_d"], ["x", "x_x", "x_x_x"]):
        shares = [rng.random() ** 3 for _ in words]
        texts = [" ".join(rng.choices(words, shares, k=rng.randrange(0, 9))) for _ in range(60)] + [None, "Zz zz"]
        table = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        # Blank is in nearly all of them; what is in none is left out by hand, too.
        there = [t for t in texts if t and any(c in t.lower() for c in "abcxz_defgh")]
        keywords = list("abcxz_defgh")
        for k in (0, 1, 2, 5, 40):
            got = search.cooccurring_terms(table, keywords, k, F.split("text", " +")).collect()
            assert [(r.token, r.n) for r in got if r.token != ""] == [c for c in _terms_by_hand(there, k)][: len(got)], (words, k)
            assert len(got) == len(_terms_by_hand(there, k))


def test_seldom_bigrams_are_not_counted(spark, monkeypatch):
    """Bigrams are nearly as many as words; those of seldom words go no further than the text."""
    table = spark.range(500).selectExpr(
        "id", "concat_ws(' ', 'the', md5(string(id)), 'of', 'the', md5(string(-id - 1)), 'a_b') AS text"
    )
    counted, top = [], search.top

    def spied(counts, *rest):
        counted.append(counts.count())
        return top(counts, *rest)

    monkeypatch.setattr(search, "top", spied)
    tokens = F.split("text", " ")
    got = [(r.token, r.n) for r in search.cooccurring_terms(table, ["the"], 3, tokens).collect()]
    assert got == [("the", 1000), ("a_b", 500), ("of", 500)]
    assert counted == [504]  # three words, of_the, and what stands before a_b
    monkeypatch.setattr(search, "WORDS_AT_ONCE", 2)  # then all are
    assert [(r.token, r.n) for r in search.cooccurring_terms(table, ["the"], 3, tokens).collect()] == got
    assert counted[1] > 3000


def test_kl_by_hand(spark):
    fore = spark.createDataFrame([("a", 3), ("b", 1)], "token string, n long")
    back = spark.createDataFrame([("a", 2), ("c", 6)], "token string, n long")
    got = {r.token: r.kl for r in search.kl_scores(fore, back).collect()}
    assert got["a"] == pytest.approx(0.75 * (math.log(0.75) - math.log(0.25)))
    assert got["b"] == pytest.approx(0.25 * (math.log(0.25) - math.log(1 / 8)))
    same = search.kl_scores(fore, fore).collect()
    assert all(abs(r.kl) < 1e-12 for r in same)


def test_expansion_in_one_pass_equals_two_tables(spark):
    table = spark.range(300).select(
        "id", F.concat_ws(" ", F.col("id") % 3, F.lit("w"), F.hex(F.col("id") % 7), F.col("id") % 11).alias("text")
    )
    tokens = T.words(F.col("text"))

    def counts(df):
        each = search._expansion_tokens(df, tokens)
        return each.groupBy("token").agg(F.count("*").alias("n"))

    hits = search.keyword_filter(table, ["0 w"])
    two = {r.token: round(r.kl, 12) for r in search.kl_scores(counts(hits), counts(table)).collect()}
    one = search.expand_query(table, ["0 w"], None, tokens, background="all").collect()
    assert {r.token: round(r.kl, 12) for r in one} == two
    everything = search.expand_query(table, ["w"], None, tokens, background="all").collect()
    assert all(abs(r.kl) < 1e-12 for r in everything)


def test_sampled_background_does_not_depend_on_partitions(spark):
    table = spark.range(2000).select("id", F.concat_ws(" ", F.col("id") % 5, F.col("id") % 13).alias("text"))
    runs = [
        search.expand_query(table.repartition(n), ["1"], 10, T.words(F.col("text"))).collect() for n in (1, 7)
    ]
    assert runs[0] == runs[1] and len(runs[0]) == 10
    other = search.expand_query(table, ["1"], 10, T.words(F.col("text")), seed=4).collect()
    assert [r.kl for r in other] != [r.kl for r in runs[0]]


def test_expansion_over_tweets(lines):
    table = posts.tweets(lines(tweet(1, "big cats", urls=[]), tweet(2, "big dogs"), tweet(3, "none")))
    got = search.expand_query(table, ["big"], 2, tweet_token_array(), search.tweet_search_text(), background="all")
    assert [r.token for r in got.collect()][0] == "big"


def test_keyword_files(spark, tmp_path):
    (tmp_path / "k").write_text("one two\n\nthree\n")
    assert read_keywords(spark, str(tmp_path / "k")) == [["one", "two"], ["three"]]


def test_indexed_keywords_find_the_same(spark):
    rng = random.Random(9)
    signs = "abÄ c.d"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, "", "  "]
    posts_ = spark.createDataFrame([(i % 150, t) for i, t in enumerate(texts)], "id int, text string")
    for longest in (6, 2):
        lists = [["".join(rng.choice(signs) for _ in range(rng.randrange(0, longest))) for _ in range(rng.randrange(0, 3))] for _ in range(150)]
        lists += [["zzz"], ["ab", "zzz"], [" "], []]
        queries = spark.createDataFrame([(q,) for q in lists] + [(None,), ([None, "AB"],)], "words array<string>")
        want = search.keyword_filter(posts_, [q for q in lists if all(" " not in w.strip() for w in q)] + [["AB"]])
        spaced = [q for q in lists if any(" " in w.strip() for w in q)]
        holds = lambda t: any(any(w.strip() for w in q) and all(w.strip().lower() in t.lower() for w in q) for q in spaced)
        more = [(i % 150, t) for i, t in enumerate(texts) if t and holds(t)]
        got = [tuple(r) for r in search.keyword_filter_indexed(posts_, queries).collect()]
        assert set(got) == {tuple(r) for r in want.collect()} | set(more)
        assert len(got) >= len(set(got))
    assert search.keyword_filter_indexed(posts_, queries.limit(0)).count() == 0


def test_many_keywords_meet_few_posts(spark):
    """The posts that are compared grow with the matches, not with the list."""
    posts_ = spark.range(300).selectExpr("id", "concat('word', id, ' common text ', md5(string(id))) AS text")
    queries = spark.range(20_000).selectExpr("array(concat('word', id), 'common') AS words")
    found = search.keyword_filter_indexed(posts_, queries)
    assert sorted(r.id for r in found.collect()) == list(range(300))
