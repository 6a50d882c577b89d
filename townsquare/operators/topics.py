"""Topic models: train, describe, score elsewhere, compare.

The model itself is Spark ML's LDA. Online training keeps topics x vocabulary
numbers on the driver; ``min_df``, the least number of documents a term must be
in, decides how many those are, and training refuses a vocabulary that would
not fit. Training by expectation-maximisation keeps documents and terms as a
distributed graph. Corpora are tables with an id and a text column.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Condition, Event
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaClass, JavaObject
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.clustering import LDA, DistributedLDAModel, LDAModel
from pyspark.ml.common import _java2py
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.operators.search import uniform_hash
from townsquare.session import kept, scratch, scratch_folder

# The least counts of a term, and the length of a topic's report.
MIN_TF = 10
MIN_DF = 10
TERMS_PER_TOPIC = 20

MODEL_AT_MOST = 1 << 28  # topics x terms of a model, eight bytes each
NO_TOPIC = -1  # row of documents that hold no known term
AT_ONCE = 4  # cells of an evaluation grid that are worked on at the same time
SETTLED = 1e-9  # mean change of a document's weights at which they count as settled
TURNS_AT_MOST = 500  # of a document's fixed point
SCORED = 1e-3  # the same, where the score of a whole corpus is asked for
MATRIX_AT_ONCE = 1 << 20  # topics x terms of a model that are taken over from it together
HELD_AT_ONCE = 1 << 21  # topics x terms of all models that the driver holds at the same time, unless one has more
NUMBERS_AT_ONCE = 1 << 19  # terms x topics of the documents that are scored together


class NoTerms(ValueError):
    """A corpus is too thin for a vocabulary."""


class TopicModel(NamedTuple):
    lda: LDAModel
    vectorizer: CountVectorizerModel


# --- corpora ----------------------------------------------------------------


def quality_tweets(tweets: DataFrame) -> DataFrame:
    """Original English tweets with at most three hashtags and two links."""

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.col(f"entities.{name}")), F.lit(0))

    return tweets.where(
        F.col("retweeted_status").isNull()
        & (F.lower("lang") == "en")
        & (count("hashtags") <= 3)
        & (count("urls") <= 2)
    )


def tweet_corpus(tweets: DataFrame, quality: bool = True) -> DataFrame:
    rows = quality_tweets(tweets) if quality else tweets
    return rows.select("id", "text")


def submission_corpus(submissions: DataFrame) -> DataFrame:
    """Titles only."""
    return submissions.select("id", F.col("title").alias("text"))


def thread_corpus(threads: DataFrame) -> DataFrame:
    """The plain text of opening posts."""
    return threads.where(F.col("opening").isNotNull()).select(
        F.col("opening.no").alias("id"), T.plain_text(F.col("opening.com")).alias("text")
    )


def mixed_corpus(**corpora: DataFrame) -> DataFrame:
    """Corpora of several platforms as one, ids prefixed by the platform."""
    out = None
    for platform, corpus in corpora.items():
        rows = corpus.select(
            F.lit(platform).alias("platform"),
            F.concat_ws(":", F.lit(platform), F.col("id").cast("string")).alias("id"),
            "filtered" if "filtered" in corpus.columns else "text",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# --- counts -----------------------------------------------------------------


def filtered(corpus: DataFrame, stopwords: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A corpus with the words of its texts in ``filtered``."""
    if "filtered" in corpus.columns:  # already
        return corpus
    tokens = T.topic_tokens(F.col("text"), list(stopwords))
    rows = corpus.where(F.col("text").isNotNull())
    return rows.select("id", *keep, tokens.alias("filtered"))


def vocabulary(
    corpus: DataFrame, stopwords: Sequence[str] = (), min_df: int = MIN_DF, vocab_size: int | None = None
) -> DataFrame:
    """(term, n, df): the terms that are in at least ``min_df`` documents, the
    most frequent first, ties in order of the term; all of them, or the first
    ``vocab_size`` if asked."""
    ordered = _frequent(corpus, stopwords, min_df).orderBy(F.desc("n"), F.asc("term"))
    return ordered if vocab_size is None else ordered.limit(vocab_size)


def _frequent(corpus: DataFrame, stopwords: Sequence[str], min_df: int) -> DataFrame:
    """(term, n, df). A document hands on all of its tokens, and each unlike one once more; neither is put in order."""
    tokens = F.col("filtered")
    both = F.inline(F.array(
        F.struct(tokens.alias("t"), F.lit(0).alias("first")), F.struct(F.array_distinct(tokens).alias("t"), F.lit(1).alias("first"))
    ))
    each = filtered(corpus, stopwords).select(both).select(F.explode_outer("t").alias("term"), "first").where(F.col("term").isNotNull())
    terms = each.groupBy("term").agg(F.sum(1 - F.col("first")).alias("n"), F.sum("first").alias("df"))
    return terms.where(F.col("df") >= min_df)


def _counts(corpus: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    """(id, term, n). A document is one row, so its terms are counted inside
    the row, as runs of its sorted tokens; nothing is shuffled by document."""
    rows = filtered(corpus, stopwords).where(F.size("filtered") > 0)
    rows = rows.select("id", F.sort_array("filtered").alias("s"))

    def starts_run(i: Column) -> Column:
        return (i == 0) | (F.get("s", i) != F.get("s", i - 1))

    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), starts_run)
    rows = rows.select("id", "s", starts.alias("starts"))
    stops = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("s")))
    runs = rows.select("id", "s", F.explode(F.arrays_zip("starts", stops.alias("stops"))).alias("run"))
    return runs.select(
        "id",
        F.get("s", F.col("run.starts")).alias("term"),
        (F.col("run.stops") - F.col("run.starts")).cast("bigint").alias("n"),
    )


def term_counts(
    corpus: DataFrame,
    stopwords: Sequence[str] = (),
    min_tf: int = MIN_TF,
    min_df: int = MIN_DF,
) -> DataFrame:
    """(id, term, n): how often each document holds each term, for terms in at
    least ``min_df`` documents and at least ``min_tf`` times in this one."""
    counts = _counts(corpus, stopwords)
    kept = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return counts.where(F.col("n") >= min_tf).join(kept.select("term"), "term", "left_semi").select("id", "term", "n")


def vectorizer_of(terms: Sequence[str] | pa.ChunkedArray, min_tf: float = 1) -> CountVectorizerModel:
    """A vectorizer over given terms, in their order.

    ``CountVectorizerModel.from_vocabulary`` hands terms to the JVM one call
    each, which takes long for many; here they go over as one string.
    """
    jvm = SparkContext._active_spark_context._jvm
    if isinstance(terms, pa.ChunkedArray):
        text = "\n".join(pc.binary_join(pa.ListArray.from_arrays([0, len(c)], c), "\n")[0].as_py() for c in terms.chunks if len(c))
    else:
        text = "\n".join(terms)
    words = jvm.java.util.regex.Pattern.compile("\n").split(text)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", words)
    model.setInputCol("filtered").setOutputCol("features").setMinTF(float(min_tf))
    return model._set(vocabSize=len(terms))


def vectorize(
    corpus: DataFrame, vectorizer: CountVectorizerModel, stopwords: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """(id, ..., features): term counts of each document as sparse vectors."""
    return vectorizer.transform(filtered(corpus, stopwords, keep)).drop("filtered")


# --- models -----------------------------------------------------------------


def train(
    corpus: DataFrame,
    k: int,
    stopwords: Sequence[str] = (),
    max_iter: int = 10,
    min_tf: int = MIN_TF,
    min_df: int = MIN_DF,
    vocab_size: int | None = None,
    seed: int = 17,
    partitions: int | None = None,
    optimizer: str = "online",
    checkpoint_interval: int = 10,
    ready: Callable[[int], None] | None = None,
) -> TopicModel:
    """Fit ``k`` topics. ``partitions`` fixes how documents are laid out, by
    id, so that a run can be repeated exactly. Texts are split into words once,
    for the vocabulary and the vectors; a corpus of words, in ``filtered``, is
    read as it is.

    ``optimizer="em"`` fits by expectation-maximisation over a graph of
    documents and terms; the model stays distributed, and the graph is written
    to the shared folder every ``checkpoint_interval`` iterations, so that a
    lost executor costs no more than those. ``ready`` is called before the
    driver holds the model, with the topics x terms of it.
    """
    if optimizer not in ("online", "em"):
        raise ValueError(f"no such optimizer: {optimizer}")
    split = "filtered" not in corpus.columns
    tokens = filtered(corpus, stopwords)
    if split:
        tokens = tokens.persist()
    try:
        most = MODEL_AT_MOST // k
        counted = _frequent(tokens, stopwords, min_df) if vocab_size is None else vocabulary(tokens, stopwords, min_df, vocab_size)
        # One more than there may be, and put in order here, where they are needed.
        found = counted.select("term", "n").limit(most + 1).toArrow()
        terms = found.sort_by([("n", "descending"), ("term", "ascending")])["term"]
        if not len(terms):
            raise NoTerms("no term is in enough documents")
        if len(terms) > most:
            raise ValueError(f"the terms are too many for {k} topics; raise min_df")
        del found
        if ready is not None:
            ready(len(terms) * k)
        documents = vectorize(tokens, vectorizer := vectorizer_of(terms, min_tf), stopwords)
        if partitions:
            documents = documents.repartition(partitions, "id").sortWithinPartitions("id")
        documents = documents.select("id", "features").persist()
        documents.count()
    finally:
        if split:
            tokens.unpersist()
    try:
        settings = {"k": k, "maxIter": max_iter, "seed": seed, "featuresCol": "features", "optimizer": optimizer}
        if optimizer == "online":
            lda = LDA(optimizeDocConcentration=False, **settings).fit(documents)
        else:
            spark = corpus.sparkSession
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(scratch_folder(spark))
            lda = LDA(checkpointInterval=checkpoint_interval, **settings).fit(documents)
    finally:
        documents.unpersist()
    return TopicModel(lda, vectorizer)


def local(model: TopicModel) -> TopicModel:
    """The model as one that scores new documents: a distributed one gathers its topics x terms on the driver."""
    return TopicModel(model.lda.toLocal(), model.vectorizer) if isinstance(model.lda, DistributedLDAModel) else model


def _part(array: JavaObject, kind: JavaClass, begin: int, stop: int) -> JavaObject:
    """Some of the JVM's array, still there."""
    context = SparkContext._active_spark_context
    out = context._gateway.new_array(kind, stop - begin)
    context._jvm.java.lang.System.arraycopy(array, begin, out, 0, stop - begin)
    return out


def _weights(lda: LDAModel) -> Iterator[tuple[int, np.ndarray]]:
    """The model's matrix of terms x topics, some terms at a time, each time with the number of the first: whole, it
    would lie on the driver several times."""
    context, matrix = SparkContext._active_spark_context, lda._java_obj.topicsMatrix()
    terms, topics, values = matrix.numRows(), matrix.numCols(), matrix.values()

    def piece(begin: int, stop: int) -> np.ndarray:
        some = _part(values, context._jvm.double, begin, stop)
        return _java2py(context, context._jvm.org.apache.spark.ml.linalg.DenseVector(some)).toArray()

    step = max(1, MATRIX_AT_ONCE // topics)
    for begin in range(0, terms, step):
        stop = min(begin + step, terms)
        if matrix.isTransposed():
            yield begin, piece(begin * topics, stop * topics).reshape(-1, topics)
        else:
            yield begin, np.stack([piece(t * terms + begin, t * terms + stop) for t in range(topics)], axis=1)


def _totals(lda: LDAModel) -> np.ndarray:
    return sum(part.sum(axis=0) for _, part in _weights(lda))


def _words(model: TopicModel, begin: int, stop: int) -> list[str]:
    """Terms of the vocabulary, which is not taken over as a whole."""
    context = SparkContext._active_spark_context
    return _java2py(context, _part(model.vectorizer._java_obj.vocabulary(), context._jvm.java.lang.String, begin, stop))


def describe(model: TopicModel, terms: int = TERMS_PER_TOPIC) -> DataFrame:
    """(topic, rank, term, weight): the heaviest terms of each topic, the first in the vocabulary among equals."""
    lda = local(model).lda
    totals = _totals(lda)
    best = [(np.empty(0, int), np.empty(0))] * len(totals)
    for begin, part in _weights(lda):
        for topic, (slots, weights) in enumerate(best):
            weights = np.concatenate([weights, part[:, topic] / totals[topic]])
            slots = np.concatenate([slots, np.arange(begin, begin + len(part))])
            first = np.argsort(-weights, kind="stable")[:terms]
            best[topic] = slots[first], weights[first]
    listed = [
        (topic, i, _words(model, int(slot), int(slot) + 1)[0], float(weight))
        for topic, found in enumerate(best) for i, (slot, weight) in enumerate(zip(*found, strict=True))
    ]
    return SparkSession.active().createDataFrame(listed, "topic int, rank int, term string, weight double")


def topic_terms(model: TopicModel) -> DataFrame:
    """(topic, term, weight) over the whole vocabulary: a row of the model's
    matrix for each term, put next to its topics in the tasks. Rows of a large
    matrix are written some at a time."""
    lda, spark = local(model).lda, SparkSession.active()
    totals, tables = _totals(lda), []
    for begin, part in _weights(lda):
        part = part / totals
        weights = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), part.shape[1])
        words = pa.array(_words(model, begin, begin + len(part)), pa.string())
        rows = pa.table({"term": words, "weights": weights.cast(pa.list_(pa.float64()))})
        tables.append(spark.createDataFrame(rows))
        if lda.vocabSize() > len(part):
            tables[-1] = kept(tables[-1])
    table = reduce(DataFrame.unionByName, tables)
    return table.select(F.posexplode("weights").alias("topic", "weight"), "term").select("topic", "term", "weight")


def sample(corpus: DataFrame, size: int, seed: int = 17) -> DataFrame:
    """About ``size`` documents, drawn with replacement; all if 0 or less.

    How often a document is drawn follows the Poisson law and is decided by a
    hash of its id, so the sample does not depend on how rows are laid out.
    """
    total = corpus.count() if size > 0 else 0
    if not total:
        return corpus
    mean = size / total
    chances, below = math.exp(-mean), []
    while sum(below[-1:]) < 1 - 1e-12 and len(below) < 10 * (mean + 10):
        below.append(sum(below[-1:]) + chances)
        chances *= mean / len(below)
    copies = F.size(F.filter(F.lit(below), lambda b: b <= uniform_hash(F.col("id"), seed)))
    drawn = corpus.withColumn("_copies", copies).where("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")


def held_out(
    model: TopicModel, corpus: DataFrame, stopwords: Sequence[str] = (), size: int = 100, seed: int = 17
) -> DataFrame:
    """One row (log_likelihood, docs) of a model on another corpus."""
    model = TopicModel(local(model).lda, model.vectorizer)
    # Spark's own score takes the exponential of topics x terms anew for each document.
    bounds = document_bounds(model, sample(corpus, size, seed), stopwords, settled=SCORED)
    bound, docs = bounds.agg(F.sum("bound"), F.count("*")).first()
    row = ((bound or 0.0) + topics_bound(model), docs)
    return corpus.sparkSession.createDataFrame([row], "log_likelihood double, docs bigint")


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for numbers above 0."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(10):  # up to where the series holds
        small = x < 10
        out -= np.where(small, 1 / x, 0)
        x = x + small
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """Mean logarithm of each share of a Dirichlet distribution with these weights in a row."""
    return digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True))


def settled_weights(
    counts: np.ndarray, beta: np.ndarray, alpha: np.ndarray, settled: float = SETTLED, turns: int = TURNS_AT_MOST,
    starts: np.ndarray | None = None,
) -> np.ndarray:
    """Topic weights of a document: the fixed point of ``alpha`` plus the counts shared out among the topics.

    ``beta`` has a row for each term of the document and a column for each topic.
    With ``starts``, the places where the terms of several documents begin, each of
    which has some: a row for each of them, the same as if it were alone.
    """
    alone = starts is None
    starts = np.zeros(1, int) if alone else np.asarray(starts, int)
    sizes = np.diff(np.append(starts, len(counts)))
    gammas = np.full((len(starts), len(alpha)), 1.0)
    at = np.arange(len(starts))  # of those that are worked on
    live = np.ones(len(starts), bool)  # of these, the ones that are not settled
    for _ in range(turns if len(counts) else 0):
        gamma = gammas[at]
        theta = np.exp(expected_logs(gamma))
        shares = np.einsum("ij,ij->i", beta, np.repeat(theta, sizes, axis=0))
        parts = (counts / (shares + 1e-100))[:, None] * beta
        new = alpha + theta * np.add.reduceat(parts, np.cumsum(sizes) - sizes, axis=0)
        gammas[at[live]] = new[live]
        live &= np.abs(new - gamma).mean(axis=1) >= settled
        if not live.any():
            break
        if 2 * live.sum() < len(at):  # seldom, since what is left is copied
            terms = np.repeat(live, sizes)
            counts, beta, sizes, at, live = counts[terms], beta[terms], sizes[live], at[live], live[live]
    return gammas[0] if alone else gammas


def document_bounds(
    model: TopicModel, corpus: DataFrame, stopwords: Sequence[str] = (), turns: int = TURNS_AT_MOST, settled: float = SETTLED
) -> DataFrame:
    """(id, tokens, bound, weights): each document's share of the variational bound of
    its likelihood, and its topic weights, from which a document's topics are read.

    The weights are a fixed point, found for each document in the tasks; only the
    topics, which a model keeps on the driver, go to them.
    A document without a known term has bound 0 and the weights of the prior.
    The bounds add up, with :func:`topics_bound`, to the likelihood of the corpus.
    """
    lda = local(model).lda
    of_totals = digamma(_totals(lda))
    k = len(of_totals)
    beta = np.empty((lda.vocabSize(), k))
    for begin, part in _weights(lda):
        beta[begin:begin + len(part)] = np.exp(digamma(part) - of_totals)
    alpha = np.asarray(lda.estimatedDocConcentration().toArray(), float)
    alpha = np.full(k, alpha[0]) if len(alpha) == 1 else alpha
    gammas = np.vectorize(math.lgamma, otypes=[float])

    @F.pandas_udf("tokens bigint, bound double, weights array<double>")
    def score(slots: pd.Series, counts: pd.Series) -> pd.DataFrame:
        sizes = slots.map(len).to_numpy(int)
        weights, words = np.tile(alpha, (len(sizes), 1)), np.zeros(len(sizes))
        # Some documents at a time, so that a task's memory does not grow with their number.
        group = np.where(sizes > 0, np.cumsum(sizes) * k // NUMBERS_AT_ONCE, -1)
        for g in np.unique(group[sizes > 0]):
            some = np.flatnonzero(group == g)
            at, n = np.concatenate(slots.to_numpy()[some]), np.concatenate(counts.to_numpy()[some])
            starts = np.cumsum(sizes[some]) - sizes[some]
            rows = beta[at]
            weights[some] = settled_weights(n, rows, alpha, settled, turns, starts)
            shares = np.exp(expected_logs(weights[some]))
            logs = np.log(np.einsum("ij,ij->i", rows, np.repeat(shares, sizes[some], axis=0)))
            words[some] = np.add.reduceat(n * logs, starts)
        logs = expected_logs(weights)
        bound = words + ((alpha - weights) * logs).sum(axis=1) + (gammas(weights) - gammas(alpha)).sum(axis=1)
        bound += math.lgamma(alpha.sum()) - gammas(weights.sum(axis=1))
        return pd.DataFrame({"tokens": [int(sum(n)) for n in counts], "bound": bound, "weights": list(weights)})

    vectors = vectorize(corpus, model.vectorizer, stopwords).select("id", F.unwrap_udt("features").alias("f"))
    return vectors.select("id", score("f.indices", "f.values").alias("s")).select("id", "s.*")


def topics_bound(model: TopicModel) -> float:
    """The part of the bound that belongs to the topics, whatever the documents."""
    lda = local(model).lda
    eta = float(lda._java_obj.oldLocalModel().topicConcentration())  # what the model was made with, wherever it comes from
    gammas, totals, bound = np.vectorize(math.lgamma, otypes=[float]), _totals(lda), 0.0
    for _, part in _weights(lda):
        logs = digamma(part) - digamma(totals)
        bound += float(((eta - part) * logs + gammas(part) - math.lgamma(eta)).sum())
    return bound + float((math.lgamma(eta * lda.vocabSize()) - gammas(totals)).sum())


def top_slot(weights: Column) -> Column:
    """0-based place of the greatest value, the first among equals; -1 where
    all are zero."""
    best = F.array_max(weights)
    none = F.forall(weights, lambda w: w == 0)
    return F.when(none, F.lit(NO_TOPIC)).otherwise(F.array_position(weights, best).cast("int") - 1)


def purity_table(
    assigned: DataFrame, platforms: Sequence[str], k: int, none_row: bool = True
) -> DataFrame:
    """(topic, one count per platform) from (platform, topic) rows, with a row
    for each of ``k`` topics and for any beyond them that occurs. Documents
    without a known term stand in row -1; ``none_row=False`` counts them under
    topic 0."""
    topic = F.col("topic") if none_row else F.greatest("topic", F.lit(0))
    counts = assigned.groupBy(topic.cast("int").alias("topic")).agg(
        *[F.sum((F.col("platform") == p).cast("bigint")).alias(p) for p in platforms]
    )
    first = NO_TOPIC if none_row else 0
    spine = assigned.sparkSession.range(first, k).select(F.col("id").cast("int").alias("topic"))
    return spine.join(counts, "topic", "full").select(
        "topic", *[F.coalesce(F.col(p), F.lit(0)).alias(p) for p in platforms]
    )


def purity(
    model: TopicModel,
    corpora: Mapping[str, DataFrame],
    stopwords: Sequence[str] = (),
    size: int = 100,
    seed: int = 17,
    none_row: bool = True,
) -> DataFrame:
    """For each topic, how many sampled documents of each platform have it as
    their top topic."""
    drawn = {p: sample(c, size, seed) for p, c in corpora.items()}
    vectors = vectorize(mixed_corpus(**drawn), model.vectorizer, stopwords, keep=["platform"])
    topics = local(model).lda.transform(vectors).select(
        "platform", top_slot(vector_to_array("topicDistribution")).alias("topic")
    )
    return purity_table(topics, list(corpora), model.lda.getK(), none_row)


# --- similarity -------------------------------------------------------------


def similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_topic, right_topic, cosine) of every left with every right topic,
    from two (topic, term, weight) tables: products over shared terms, norms
    over each whole vocabulary, zero where nothing is shared.

    Each side is packed to one row per term holding its weights by topic. The
    packed sides meet on the term; their products are added up by pair of
    topics, first within each task. A topic without any weight has cosine 0.
    """
    both = _packed(left, "l").join(_packed(right, "r"), "term").select(F.explode("l").alias("l"), "r")
    products = both.select("l", F.explode("r").alias("r")).groupBy(
        F.col("l.topic").alias("left_topic"), F.col("r.topic").alias("right_topic")
    )
    dots = products.agg(F.sum(F.col("l.weight") * F.col("r.weight")).alias("dot"))
    # Every left topic with every right one, which is the result that is asked for.
    rights = _norms(right).agg(F.collect_list(F.struct("topic", "norm"))).scalar()
    pairs = _norms(left).select("topic", "norm", F.explode(rights).alias("other")).select(
        F.col("topic").alias("left_topic"), F.col("other.topic").alias("right_topic"),
        (F.col("norm") * F.col("other.norm")).alias("norms"),
    )
    cosine = F.when((F.col("norms") > 0) & F.col("dot").isNotNull(), F.col("dot") / F.col("norms")).otherwise(0.0)
    return pairs.join(dots, ["left_topic", "right_topic"], "left").select(
        "left_topic", "right_topic", cosine.alias("cosine")
    )


def _norms(table: DataFrame) -> DataFrame:
    weight = F.col("weight").cast("double")
    return table.groupBy("topic").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))


def _packed(table: DataFrame, name: str) -> DataFrame:
    """(term, weights): a term has at most one weight per topic."""
    pair = F.struct("topic", F.col("weight").cast("double").alias("weight"))
    return table.groupBy("term").agg(F.collect_list(pair).alias(name))


# --- evaluation grid --------------------------------------------------------


def month_ahead(
    posts: DataFrame,
    ks: Sequence[int],
    period: str = "month",
    stopwords: Sequence[str] = (),
    size: int = 1_000_000,
    seed: int = 17,
    pairs: Sequence[tuple[str, str]] | None = None,
    **training,
) -> DataFrame:
    """(train, test, period, k, log_likelihood, docs): models of each platform
    and period scored on the next period, within and across platforms.

    ``posts`` has platform, ``period`` (a date, or text such as ``2016``,
    ``2016-07``, ``2016-W27`` or ``2016-07-31``), id and text. The next period is that of the
    calendar. A cell is left out if one of its corpora is missing or too thin
    for a model. Platforms and periods are few; each model is one distributed
    training run. Texts are split into words once for all of them, and models
    are trained and scored ``AT_ONCE`` at the same time, fewer where they are large.
    """
    spark, room = posts.sparkSession, _Room(HELD_AT_ONCE)
    kind = dict(posts.dtypes)[period]
    with scratch(spark) as folder:
        stored, have = _stored(posts, period, stopwords, folder)
        platforms = sorted({p for p, _ in have})
        wanted = [(a, b) for a in platforms for b in platforms] if pairs is None else list(pairs)

        def cells(trained: str, before: str | datetime.date, k: int) -> list[tuple]:
            now, rows = next_period(before), []
            tests = [b for a, b in wanted if a == trained and (b, now) in have]
            with room.held() as ready:
                model = _model_or_none(stored(trained, before), k, stopwords, seed, training, ready) if tests else None
                for tested in tests if model is not None else []:
                    score = held_out(model, stored(tested, now), stopwords, size, seed).first()
                    rows.append((trained, tested, now, k, score["log_likelihood"], score["docs"]))
                del model
            return rows

        models = [(a, t, k) for a, t in sorted(have, key=str) for k in ks]
        found = _at_once(spark, cells, models)
    schema = f"train string, test string, {period} {kind}, k int, log_likelihood double, docs bigint"
    return spark.createDataFrame([row for rows in found for row in rows], schema)


def _at_once(spark: SparkSession, run: Callable, tasks: list[tuple]) -> list:
    """Results of ``run`` in the order of the tasks, some of which run at the same time, each in
    a pool of its own where the scheduler is fair. After a failure no further one begins."""
    failed = Event()

    def pooled(numbered: tuple[int, tuple]) -> object:
        if failed.is_set():
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cell-{numbered[0] % AT_ONCE}")
        try:
            return run(*numbered[1])
        except BaseException:
            failed.set()
            raise

    if not tasks:
        return []
    with ThreadPool(min(AT_ONCE, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(spark)(pooled), list(enumerate(tasks)), chunksize=1)


class _Room:
    """Lets in as many models as there is room for on the driver, or one that is larger."""

    def __init__(self, size: int) -> None:
        self.size, self.free, self.changed = size, size, Condition()

    @contextmanager
    def held(self) -> Iterator[Callable[[int], None]]:
        """A call that waits until there is room for so many numbers, which are given back in the end."""
        taken = 0

        def take(numbers: int) -> None:
            nonlocal taken
            numbers = min(numbers, self.size)
            with self.changed:
                self.changed.wait_for(lambda: self.free >= numbers)
                self.free -= numbers
                taken += numbers

        try:
            yield take
        finally:
            with self.changed:
                self.free += taken
                self.changed.notify_all()


def purity_ahead(
    posts: DataFrame,
    k: int,
    period: str = "month",
    stopwords: Sequence[str] = (),
    size: int = 1_000_000,
    seed: int = 17,
    **training,
) -> DataFrame:
    """(train, period, topic, one count per platform): the purity of each
    platform's model, and of one trained on all, on the next period of the
    calendar; platforms without posts there count 0."""
    spark, room = posts.sparkSession, _Room(HELD_AT_ONCE)
    kind = dict(posts.dtypes)[period]
    with scratch(spark) as folder:
        stored, have = _stored(posts, period, stopwords, folder)
        platforms = sorted({p for p, _ in have})
        counts = "".join(f", `{p}` bigint" for p in platforms)
        schema = f"train string, {period} {kind}, topic int{counts}"

        def table(trained: str, before: str | datetime.date) -> list[tuple]:
            now = next_period(before)
            with room.held() as ready:
                model = _model_or_none(stored(None if trained == "all" else trained, before), k, stopwords, seed, training, ready)
                if model is None:
                    return []
                rows = purity(model, {p: stored(p, now) for p in platforms}, stopwords, size, seed).collect()
                del model
            return [(trained, now, *row) for row in rows]  # a row for each topic

        before = [t for t in sorted({t for _, t in have}) if any((p, next_period(t)) in have for p in platforms)]
        found = _at_once(spark, table, [(trained, t) for t in before for trained in ("all", *platforms)])
    return spark.createDataFrame([row for rows in found for row in rows], schema)


def next_period(value: str | datetime.date) -> str | datetime.date:
    """The calendar's next year, month, week or day."""
    if isinstance(value, datetime.date):
        return value + datetime.timedelta(days=1)
    if len(value) == 10:
        return str(next_period(datetime.date.fromisoformat(value)))
    if "W" in value:
        monday = datetime.date.fromisocalendar(int(value[:4]), int(value[-2:]), 1) + datetime.timedelta(days=7)
        return f"{monday.isocalendar().year:04d}-W{monday.isocalendar().week:02d}"
    if len(value) == 7:
        year, month = map(int, value.split("-"))
        return f"{year + month // 12:04d}-{month % 12 + 1:02d}"
    return f"{int(value) + 1:04d}"


def _stored(posts: DataFrame, period: str, stopwords: Sequence[str], folder: str):
    """The words of the corpus by platform and period, written once as a table
    of folders, and which of them there are. No platform means all."""
    posts = posts.where(F.col("platform").isNotNull() & F.col(period).isNotNull())
    rows = filtered(posts.select("platform", period, "id", "text"), stopwords, ["platform", period])
    rows.write.partitionBy("platform", period).parquet(f"{folder}/corpus")
    table = posts.sparkSession.read.schema(rows.schema).parquet(f"{folder}/corpus")
    have = {(r["platform"], r[period]) for r in table.select("platform", period).distinct().collect()}

    def stored(platform: str | None, when) -> DataFrame:
        own = table.where(F.col(period) == F.lit(when))
        return (own if platform is None else own.where(F.col("platform") == platform)).select("id", "filtered")

    return stored, have


def _model_or_none(corpus: DataFrame, k: int, stopwords: Sequence[str], seed: int, training: Mapping, ready: Callable) -> TopicModel | None:
    try:
        return train(corpus, k, stopwords, seed=seed, ready=ready, **training)
    except NoTerms:
        return None
