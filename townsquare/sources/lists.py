"""Side lists (ids, names, domains, keywords, symbols, stopwords) and models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.clustering import DistributedLDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A list of ids of any length as a distributed table ``id``."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("id")).dropna()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A list of names or domains as a distributed table ``name``, lower-cased
    without blank lines."""
    names = spark.read.text(path).select(F.lower(F.trim("value")).alias("name"))
    return names.where(F.length("name") > 0)


def read_entries(spark: SparkSession, path: str) -> list[str]:
    """A short hand-written list (symbols, stopwords), which becomes part of
    the plan itself."""
    return [r.value for r in spark.read.text(path).where(F.length(F.trim("value")) > 0).collect()]


def read_keywords(spark: SparkSession, path: str) -> list[list[str]]:
    """Keyword queries, one per line, as lists of words."""
    return [line.split() for line in read_entries(spark, path)]


def as_table(spark: SparkSession, values: Iterable, name: str, kind: T.DataType) -> DataFrame:
    """A Python list as a one-column table."""
    schema = T.StructType([T.StructField(name, kind)])
    return spark.createDataFrame([(v,) for v in values], schema)


def load_topic_model(lda_path: str, vectorizer_path: str):
    """A saved LDA model (of either kind, as a local one) and its vectorizer."""
    try:
        lda = DistributedLDAModel.load(lda_path).toLocal()
    except Exception:  # saved as a local model: the class check raises
        lda = LocalLDAModel.load(lda_path)
    return lda, CountVectorizerModel.load(vectorizer_path)


def keyword_queries(queries: Sequence[Sequence[str] | str]) -> list[list[str]]:
    """Lower-cased word lists without blanks; a query of no words is no query."""
    split = [q.split() if isinstance(q, str) else list(q) for q in queries]
    cleaned = [[w.strip().lower() for w in q if w.strip()] for q in split]
    return [q for q in cleaned if q]
