"""Token tables: one row per token of a post, with its position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.functions.segmentation import Lexicon, with_words


def _table(posts: DataFrame, id_col: str, tokens: Column, lexicon: Lexicon | None = None, bigrams: bool = False) -> DataFrame:
    rows = posts.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))
    if lexicon is not None:
        rows = with_words(rows, "tokens", lexicon)
    if bigrams:
        rows = rows.withColumn("tokens", F.concat("tokens", T.bigrams(F.col("tokens"))))
    # Outer, since Spark would filter by the size of the tokens first, and so compute them twice.
    return rows.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("pos").isNotNull())


def tweet_tokens(
    tweets: DataFrame,
    id_col: str = "id",
    text: str = "text",
    entities: str | None = "entities",
    make_bigrams: bool = False,
    preserve_case: bool = True,
    lexicon: Lexicon | None = None,
) -> DataFrame:
    """(doc_id, pos, token) of tweets: hashtags, mentions, links, media and
    cash symbols are whole tokens, a link in its expanded form; the rest is
    split into words. Bigrams follow the tokens they are made of.

    Without entity arrays (``entities=None``) links, tags and names are told
    by their form. ``lexicon``, a word list, splits scripts without blanks into
    words; without one they are split by the rules of Unicode.
    """
    tokens = tweet_token_array(text, entities, False, preserve_case, lexicon is not None)
    return _table(tweets, id_col, tokens, lexicon, make_bigrams)


def tweet_token_array(
    text: str = "text",
    entities: str | None = "entities",
    make_bigrams: bool = False,
    preserve_case: bool = True,
    whole_runs: bool = False,
) -> Column:
    if entities is None:
        tokens = T.words(F.col(text), T.ENTITY_OR_WORD, whole_runs)
    else:
        tokens = T.entity_tokens(F.col(text), F.col(entities), whole_runs)
    if not preserve_case:
        tokens = T.fold_case(tokens)
    return F.concat(tokens, T.bigrams(tokens)) if make_bigrams else tokens


def reddit_tokens(
    posts: DataFrame, id_col: str = "id", text: str = "text", lexicon: Lexicon | None = None
) -> DataFrame:
    """(doc_id, pos, token) of forum posts: character references decoded,
    links whole, the rest in words, case kept; ``lexicon`` as for tweets."""
    decoded = posts.withColumn("_text", T.decode_entities(F.col(text)))
    return _table(decoded, id_col, T.link_and_word_tokens(F.col("_text"), lexicon is not None), lexicon)


def topic_tokens(
    posts: DataFrame, stopwords: Sequence[str] = (), id_col: str = "id", text: str = "text"
) -> DataFrame:
    """(doc_id, pos, token) as the topic jobs see a text."""
    return _table(posts, id_col, T.topic_tokens(F.col(text), list(stopwords)))
