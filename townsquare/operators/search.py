"""Posts that match keywords or fielded queries; query expansion.

Queries are short hand-written lists. They become predicates inside the scan
stage: no shuffle, no join, whole-stage code.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.functions.links import let
from townsquare.functions.segmentation import Lexicon, with_words
from townsquare.operators.extract import top
from townsquare.session import kept
from townsquare.sources.lists import keyword_queries

# Fields whose text is split into words, and the same split for query values.
ANALYSED = ("content",)
PLAIN_WORD = regex.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", T.WORD), regex.V1)


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


# --- keywords ---------------------------------------------------------------


def matches_keywords(text: Column, queries: Sequence[Sequence[str] | str]) -> Column:
    """True where every word of some query is a substring of the text. Case is
    ignored on both sides, and so are queries without a word."""
    queries = keyword_queries(queries)
    if not queries:
        return F.lit(False)
    # Each word is looked for once, then the queries are looked up by number.
    words = sorted({w for q in queries for w in q})
    place = {w: i for i, w in enumerate(words)}
    numbers = F.lit([[place[w] for w in q] for q in queries])
    there = let(F.lower(text), lambda t: F.transform(F.lit(words), lambda w: F.contains(t, w)))
    return let(there, lambda has: F.exists(numbers, lambda q: F.forall(q, lambda i: F.get(has, i))))


def tweet_search_text(text: str = "text", retweeted: str = "retweeted_status") -> Column:
    """A tweet's text and, behind a comma, the text of what it retweets."""
    inner = F.col(f"{retweeted}.text")
    return F.concat(F.col(text), F.lit(", "), F.coalesce(inner, F.lit("")))


def keyword_filter(
    posts: DataFrame, queries: Sequence[Sequence[str] | str], text: str | Column = "text"
) -> DataFrame:
    """Posts (of any platform) with text that match some keyword query."""
    column = F.col(text) if isinstance(text, str) else text
    return posts.where((F.length(column) > 0) & matches_keywords(column, queries))


def keyword_filter_indexed(
    posts: DataFrame, queries: DataFrame, words: str = "words", text: str | Column = "text", key: str = "id"
) -> DataFrame:
    """What :func:`keyword_filter` finds, for lists of any length: ``queries`` is a
    table with a query's words in an array.

    A post that holds all words of a query holds all runs of three signs in them.
    So each query is filed under that run of its words which the fewest posts
    hold, and a post meets the queries filed under its own runs alone; these are
    tested exactly. A query with a run that no post holds matches nothing and is
    not filed.

    A post meets far more queries than it matches. They are looked up and tested
    where its text is, up to the first that matches, so that no pairs are dealt
    out. The tasks hold ``QUERIES_AT_ONCE`` queries; for a longer list, the posts
    are read once for each so many, and what is dealt out is which texts match.
    ``key`` then tells posts apart as well as may be, so that copies of one text
    are not all sought in one place. Posts and queries may be null or blank;
    those match nothing.
    """
    column = F.lower(F.col(text) if isinstance(text, str) else text)
    lowered = F.transform(words, lambda w: F.lower(F.trim(w)))
    asked = queries.select(F.array_sort(F.array_distinct(F.filter(lowered, lambda w: F.length(w) > 0))).alias("q_words"))
    asked = asked.where(F.size("q_words") > 0).distinct()
    of_query = asked.select("q_words", F.explode(F.array_distinct(F.flatten(F.transform("q_words", _grams)))).alias("gram"))
    short = F.lit(asked.where(F.exists("q_words", lambda w: F.length(w) < GRAM)).limit(1).count() > 0)
    held = F.when(short, F.concat(*[_runs(column, n) for n in range(1, GRAM + 1)])).otherwise(_runs(column, GRAM))
    grams, spoken = F.array_distinct(held), F.length(column) > 0
    # Counted before they meet the queries': there are few runs, and each task has one row for each.
    known = posts.where(spoken).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("posts"))
    filed = of_query.join(known, "gram", "left").groupBy("q_words").agg(
        F.min(F.coalesce("posts", F.lit(0))).alias("least"), F.min_by("gram", F.struct("posts", "gram")).alias("gram")
    )
    filed = kept(filed.where("least > 0").select("gram", "q_words"))
    n = filed.count()
    pieces = -(-n // QUERIES_AT_ONCE)

    def matched(piece: int) -> DataFrame:
        part = filed.where(F.pmod(F.xxhash64("q_words"), F.lit(pieces)) == piece)
        indexed = posts.withColumn("q_index", _index(part, 2 * min(n, QUERIES_AT_ONCE)))
        return indexed.where(spoken & let(column, lambda t: _holds_filed(t, grams, F.col("q_index")))).drop("q_index")

    if pieces <= 1:
        return matched(0) if pieces else posts.where(F.lit(False))
    mark = F.sha2(column, 256)
    marks = [matched(i).select(F.col(key).alias("q_key"), mark.alias("q_mark")) for i in range(pieces)]
    found = reduce(DataFrame.unionByName, marks).distinct()
    return posts.join(found, F.col(key).eqNullSafe(F.col("q_key")) & (mark == F.col("q_mark")), "left_semi")


def _slot(gram: Column, slots: Column | int) -> Column:
    """Which of so many slots a run has; two may share one."""
    return F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")


def _index(filed: DataFrame, slots: int) -> Column:
    """The queries by the slots of the runs that they are filed under, as one value of so many arrays."""
    there = filed.groupBy(_slot(F.col("gram"), slots).alias("slot")).agg(F.collect_list("q_words").alias("asked"))
    every = filed.sparkSession.range(slots).join(there, F.col("id") == F.col("slot"), "left")
    none = F.array().cast("array<array<string>>")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("asked", none).alias("asked")))).alias("all"))
    return rows.select("all").scalar()


def _holds_filed(text: Column, grams: Column, index: Column) -> Column:
    """Whether a text holds all words of some query that is filed under one of its runs."""

    def holds(query: Column) -> Column:
        return F.forall(query, lambda word: F.contains(text, word))

    return let(index, lambda at: F.exists(grams, lambda g: F.exists(F.get(at, _slot(g, F.size(at)))["asked"], holds)))


QUERIES_AT_ONCE = 100_000  # of a list, in the memory of an executor
GRAM = 3  # signs in a run


def _runs(text: Column, n: int) -> Column:
    """All runs of so many signs; those of a text in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def _grams(word: Column) -> Column:
    """The runs of a word, or a shorter word itself."""
    return F.when(F.length(word) < GRAM, F.array(word)).otherwise(_runs(word, GRAM))


# --- fielded queries --------------------------------------------------------


class Words(NamedTuple):
    """A field whose terms are the words of a lower-cased text. A post whose text lacks the letters
    that a query asks for is told before the text is split."""

    text: Column

    def terms(self) -> Column:
        return T.words(self.text)


def tweet_fields() -> dict[str, Column | Words]:
    """Searchable fields of a tweet, each as an array of lower-cased terms or the text that they are words of."""
    retweeted = F.coalesce(F.col("retweeted_status.text"), F.lit(""))
    content = F.concat(F.col("text"), F.lit(" "), retweeted)

    def terms(items: Column) -> Column:
        return F.transform(items, lambda t: F.lower(t))

    urls = F.filter(
        F.transform(F.col("entities.urls"), lambda u: u["expanded_url"]), lambda u: F.contains(u, F.lit("://"))
    )
    return {
        "content": Words(F.lower(content)),
        "screen_name": F.split(F.lower(F.col("user.screen_name")), r"\s+"),
        "user_id": F.array(F.col("user.id").cast("string")),
        "lang": F.array(F.lower(F.col("lang"))),
        "url": terms(F.transform(urls, lambda u: F.regexp_replace(u, "^[^:]*://", ""))),
        "hashtag": terms(F.transform(F.col("entities.hashtags"), lambda h: h["text"])),
        "mention": terms(F.transform(F.col("entities.user_mentions"), lambda m: m["screen_name"])),
    }


def submission_fields(title: str = "title", selftext: str = "selftext") -> dict[str, Words]:
    """The one searchable field of a submission: its title and body."""
    body = F.coalesce(F.col(selftext), F.lit(""))
    return {"content": Words(F.lower(F.concat(F.col(title), F.lit(", "), body)))}


def fielded_search(
    posts: DataFrame,
    queries: Sequence[Mapping],
    fields: Mapping[str, Column | Words],
    threshold: float = 0.0,
    op: str = "AND",
    score: str = "matches",
) -> DataFrame:
    """Posts whose score over all queries is above ``threshold``.

    A query is ``{"clauses": [...], "op": "AND" | "OR"}``, a clause
    ``{"field", "kind", "value", "occur"}`` with kind ``term`` (default),
    ``phrase``, ``prefix`` or ``wildcard`` and occur ``must``, ``should``,
    ``must_not`` or, by default, what ``op`` says. The field is ``content``
    unless named. A clause may also be a query itself, with ``clauses`` and
    ``op`` of its own. A query of ``must_not`` clauses alone matches nothing.

    Values of text fields are split into words as the text was; several words
    are a phrase, and a value without a word matches nothing. Prefixes and
    wildcards are taken as they are.

    ``score="matches"`` counts the queries that match. ``score="bm25"`` adds
    up the term weights of a one-post index: ln(4/3) * 2.2 tf / (tf + 1.2) for
    terms and phrases, 1 for prefixes and wildcards.
    """
    if score not in ("matches", "bm25"):
        raise ValueError(f"unknown score {score!r}")
    used = {c.get("field", "content") for q in queries for c in _leaves(q)}
    unknown = used - set(fields)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    # Terms of a field as one string with a blank around each, so that every
    # kind of clause is a plain string test.
    none = F.array().cast("array<string>")

    def joined(field: Column | Words) -> Column:
        terms = field.terms() if isinstance(field, Words) else field
        return F.concat(F.lit(" "), F.array_join(F.coalesce(terms, none), " "), F.lit(" "))

    texts = {f for f in used if isinstance(fields[f], Words)}
    padded = F.struct(*[joined(fields[f]).alias(f) for f in sorted(used)])
    unsplit = F.struct(*[(fields[f].text if f in texts else joined(fields[f])).alias(f) for f in sorted(used)])

    def above(post: Column) -> Column:
        if score == "matches" and threshold == 0:
            return _any([query_matches(q, post, op) for q in queries])
        weigh = _bm25 if score == "bm25" else (lambda query, fields: F.lit(1.0))
        scores = [F.when(query_matches(q, post, op), weigh(q, post)).otherwise(0.0) for q in queries]
        return reduce(lambda a, b: a + b, scores, F.lit(0.0)) > threshold

    def perhaps_above(post: Column) -> Column:
        perhaps = [_perhaps_matches(q, post, texts, op) for q in queries]
        if score == "bm25" or threshold == 0:
            return _any(perhaps)
        return reduce(lambda a, b: a + b, [F.when(p, 1.0).otherwise(0.0) for p in perhaps], F.lit(0.0)) > threshold

    # The fields are analysed once per post, whatever the number of clauses.
    found = let(padded, above)
    if texts and threshold >= 0:
        found = F.when(let(unsplit, perhaps_above), found).otherwise(F.lit(False))
    return posts.where(found)


def query_matches(query: Mapping, fields: Column, op: str = "AND") -> Column:
    """Whether a post's padded fields satisfy one query."""
    default = {"AND": "must", "OR": "should"}[query.get("op", op).upper()]
    groups: dict[str, list[Column]] = {"must": [], "should": [], "must_not": []}
    for clause in query["clauses"]:
        occur = clause.get("occur", "default")
        found = query_matches(clause, fields, op) if "clauses" in clause else _clause_matches(clause, fields)
        groups[default if occur == "default" else occur].append(found)
    if not groups["must"] and not groups["should"]:
        return F.lit(False)
    wanted = _every(groups["must"]) if groups["must"] else _any(groups["should"])
    return wanted & ~_any(groups["must_not"])


def _perhaps_matches(query: Mapping, fields: Column, texts: Collection[str], op: str = "AND") -> Column:
    """True of each post that satisfies a query, and of few others, from fields of which ``texts`` are not split yet."""
    default = {"AND": "must", "OR": "should"}[query.get("op", op).upper()]
    groups: dict[str, list[Column]] = {"must": [], "should": [], "must_not": []}
    for clause in query["clauses"]:
        occur = clause.get("occur", "default")
        if "clauses" in clause:
            found = _perhaps_matches(clause, fields, texts, op)
        elif clause.get("field", "content") in texts:
            found = _letters_match(clause, fields)
        else:
            found = _clause_matches(clause, fields)
        groups[default if occur == "default" else occur].append(found)
    if not groups["must"] and not groups["should"]:
        return F.lit(False)
    return _every(groups["must"]) if groups["must"] else _any(groups["should"])


def _letters_match(clause: Mapping, fields: Column) -> Column:
    """Whether a text holds the letters of a clause's words, those of a phrase with no letter or digit from a to z
    and 0 to 9 between them: whatever stands between two words, these would be a word of their own."""
    text, kind, value = _clause_parts(clause, fields)
    if not value:
        return F.lit(False)
    if kind == "wildcard":
        return _every([F.contains(text, F.lit(part)) for part in re.split(r"[*?\s]+", value) if part])
    words = value.split()
    return F.contains(text, F.lit(value)) if len(words) == 1 else text.rlike("[^a-z0-9]*".join(map(re.escape, words)))


def _leaves(query: Mapping) -> list[Mapping]:
    """The clauses of a query and of the queries in it."""
    return [leaf for c in query["clauses"] for leaf in (_leaves(c) if "clauses" in c else [c])]


def _clause_matches(clause: Mapping, fields: Column) -> Column:
    field, kind, value = _clause_parts(clause, fields)
    if not value:
        return F.lit(False)
    if kind == "wildcard":
        return field.rlike(_wildcard(value))
    return F.contains(field, F.lit(f" {value}" if kind == "prefix" else f" {value} "))


def _clause_parts(clause: Mapping, fields: Column) -> tuple[Column, str, str]:
    kind = clause.get("kind", "term")
    if kind not in ("term", "phrase", "prefix", "wildcard"):
        raise ValueError(f"unknown clause kind {kind!r}")
    name, value = clause.get("field", "content"), clause["value"].lower()
    if name in ANALYSED and kind in ("term", "phrase"):
        words = PLAIN_WORD.findall(value)
    else:
        words = value.split()
    return fields[name], kind, " ".join(words)


def _wildcard(value: str) -> str:
    """``*`` stands for any characters of a term, ``?`` for one."""
    signs = {"*": r"\S*", "?": r"\S"}
    return "(?<= )" + "".join(signs.get(ch, re.escape(ch)) for ch in value) + "(?= )"


def _bm25(query: Mapping, fields: Column) -> Column:
    # Fixed values of the ranking formula for an index of one document.
    idf, k1 = "ln(4.0D / 3.0D)", 1.2
    weights = []
    for clause in query["clauses"]:
        if clause.get("occur") == "must_not":
            continue
        if "clauses" in clause:
            weights.append(_bm25(clause, fields))
            continue
        field, kind, value = _clause_parts(clause, fields)
        if not value:
            continue
        if kind in ("prefix", "wildcard"):
            weights.append(F.when(_clause_matches(clause, fields), 1.0).otherwise(0.0))
            continue
        tf = F.regexp_count(field, F.lit("(?<= )" + re.escape(value) + "(?= )")).cast("double")
        weights.append(F.expr(idf) * tf * (k1 + 1) / (tf + k1))
    return reduce(lambda a, b: a + b, weights, F.lit(0.0))


# --- query expansion --------------------------------------------------------


PAIR = "_"  # between the words of a bigram; a word may hold it, too
WORDS_AT_ONCE = 2_000  # in the predicate that tells which bigrams may be frequent


def _folded(posts: DataFrame, tokens: Column, lexicon: Lexicon | None, *keep: Column) -> DataFrame:
    """The lower-cased tokens of each post as ``t``, a column, so that they are computed once."""
    folded = posts.select(*keep, T.fold_case(tokens).alias("t"))
    return folded if lexicon is None else with_words(folded, "t", lexicon)


def _words_and_pairs(folded: DataFrame) -> DataFrame:
    """One row for each token of ``t`` and for each pair of neighbours: ``first`` and, of a pair, ``second``. Places
    are exploded and looked up in the tokens, so that no array of pairs is built."""
    n, i = F.size("t"), F.col("i")
    places = F.when(n > 0, F.sequence(F.lit(0), 2 * n - 2))
    # Outer, since Spark would filter by the size of the tokens first, and so compute them twice.
    rows = folded.select("*", F.explode_outer(places).alias("i"))
    first = F.get("t", F.when(i < n, i).otherwise(i - n))
    return rows.select(
        *[c for c in folded.columns if c != "t"], (i >= n).alias("pair"), first.alias("first"),
        F.when(i >= n, F.get("t", i - n + 1)).alias("second"),
    )


def _joined(rows: DataFrame) -> DataFrame:
    token = F.when(F.col("pair"), F.concat("first", F.lit(PAIR), "second")).otherwise(F.col("first"))
    rest = [c for c in rows.columns if c not in ("pair", "first", "second")]
    return rows.select(*rest, token.alias("token")).where(F.col("token").isNotNull())


def _expansion_tokens(posts: DataFrame, tokens: Column, lexicon: Lexicon | None = None, *keep: Column) -> DataFrame:
    """One row per lower-cased token and per bigram of neighbours."""
    return _joined(_words_and_pairs(_folded(posts, tokens, lexicon, *keep)))


def _perhaps_frequent(folded: DataFrame, k: int) -> Column | None:
    """Which rows of :func:`_words_and_pairs` may count for one of the ``k`` most frequent tokens; none if that
    takes too many words to say.

    At least ``k`` tokens occur as often as the k-th most frequent word. A bigram is no more frequent than either of
    its words, so both have to be as frequent as that. Signs of a pair inside a word are the exception: a token with
    one such sign may be a word and a bigram, whose counts add up, and a token with more of them may be several.
    The former are told by the sum of what both can be, the latter are all kept.
    """
    words = folded.select(F.explode_outer("t").alias("token")).where(F.col("token").isNotNull())
    words = words.groupBy("token").agg(F.count("*").alias("n")).persist()
    try:
        first = words.orderBy(F.desc("n")).limit(k).agg(F.min("n"), F.count("*")).first()
        least = first[0] if first[1] == k > 0 else 0
        parts = F.split("token", PAIR)
        doubtful = words.where(F.size(parts) == 2).select("token", "n", parts[0].alias("a"), parts[1].alias("b"))
        a, b = (words.select(F.col("token").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        doubtful = doubtful.join(a, "a").join(b, "b").where(F.col("n") + F.least("n_a", "n_b") >= least)
        chosen = words.where(F.col("n") >= least).select("token", F.lit(True).alias("frequent")).unionByName(
            doubtful.select("token", F.lit(False).alias("frequent"))
        )
        chosen = chosen.limit(WORDS_AT_ONCE + 1).collect()
    finally:
        words.unpersist()
    if len(chosen) > WORDS_AT_ONCE:
        return None
    frequent, both = ([r["token"] for r in chosen if r["frequent"] == f] for f in (True, False))
    one, two = F.col("first"), F.col("second")
    of_pair = (one.isin(frequent) & two.isin(frequent)) | F.contains(one, F.lit(PAIR)) | F.contains(two, F.lit(PAIR))
    if both:
        of_pair = of_pair | F.concat(one, F.lit(PAIR), two).isin(both)
    of_word = one.isin(frequent + both) | one.rlike(f"(?s){PAIR}.*{PAIR}")
    return F.when(F.col("pair"), of_pair).otherwise(of_word)


def cooccurring_terms(
    posts: DataFrame,
    keywords: Sequence[Sequence[str] | str],
    k: int,
    tokens: Column,
    text: str | Column = "text",
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """(token, n): the ``k`` most frequent tokens and bigrams of the posts
    that match the keywords; ties in order of the token. ``lexicon`` splits the
    runs of scripts without blanks among ``tokens``, if these leave them whole.

    Words are counted first. These are few; unlike bigrams are nearly as many as
    the words of all posts, and only those that may be among the ``k`` are counted,
    when the posts are read a second time.
    """
    folded = _folded(keyword_filter(posts, keywords, text), tokens, lexicon)
    perhaps = _perhaps_frequent(folded, k)
    each = _words_and_pairs(folded)
    each = _joined(each if perhaps is None else each.where(perhaps))
    return top(each.groupBy("token").agg(F.count("*").alias("n")), k, "n", "token")


def kl_scores(foreground: DataFrame, background: DataFrame) -> DataFrame:
    """(token, kl) for two token count tables (token, n): p (ln p - ln q),
    where a token the background lacks counts as seen there once."""
    fore = foreground.select("token", F.col("n").alias("fore"))
    back = background.select("token", F.col("n").alias("back"))
    # Totals are scalar subqueries: one value each, computed inside the plan.
    fore_total = fore.agg(F.sum("fore")).scalar()
    back_total = back.agg(F.sum("back")).scalar()
    joined = fore.join(back, "token", "left")
    return joined.select("token", _kl(F.col("fore"), F.col("back"), fore_total, back_total).alias("kl"))


def _kl(fore: Column, back: Column, fore_total: Column, back_total: Column) -> Column:
    p = fore.cast("double") / fore_total.cast("double")
    q = F.coalesce(back, F.lit(1)).cast("double") / back_total.cast("double")
    return p * (F.log(p) - F.log(q))


def uniform_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 60 bits of the md5 of key and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 60))


def expand_query(
    posts: DataFrame,
    keywords: Sequence[Sequence[str] | str],
    k: int | None,
    tokens: Column,
    text: str | Column = "text",
    id_col: str = "id",
    background: str = "sample",
    seed: int = 17,
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """(token, kl): the ``k`` tokens and bigrams that set the posts matching
    the keywords apart from the background, the most telling first.

    The background is a sample of all posts of about as many posts as match,
    drawn by a hash of the id, or with ``background="all"`` all of them. Both
    sides are counted in one pass over the text: a post's tokens carry two
    flags, which are summed up per token.
    """
    if background not in ("sample", "all"):
        raise ValueError(f"unknown background {background!r}")
    column = F.col(text) if isinstance(text, str) else text
    usable = posts.where(column.isNotNull())
    matched = (F.length(column) > 0) & matches_keywords(column, keywords)
    marked = usable.withColumn("fore", matched.cast("int"))
    if background == "all":
        each = _expansion_tokens(marked, tokens, lexicon, F.col("fore"), F.lit(1).alias("back"))
    else:
        ratio = usable.agg(F.avg(matched.cast("double"))).scalar()
        drawn = uniform_hash(F.col(id_col), seed) < ratio
        marked = marked.withColumn("back", drawn.cast("int")).where("fore + back > 0")
        each = _expansion_tokens(marked, tokens, lexicon, F.col("fore"), F.col("back"))
    counts = each.groupBy("token").agg(F.sum("fore").alias("fore"), F.sum("back").alias("back"))
    # Both branches use both sums, so the aggregation runs once and its
    # exchange is reused for the totals.
    totals = counts.agg(F.struct(F.sum("fore").alias("fore"), F.sum("back").alias("back"))).scalar()
    seen = F.when(F.col("back") > 0, F.col("back"))
    scored = (
        counts.where(F.col("fore") > 0)
        .withColumn("totals", totals)
        .select("token", _kl(F.col("fore"), seen, F.col("totals.fore"), F.col("totals.back")).alias("kl"))
    )
    return top(scored, k, "kl", "token")
