"""A pipeline over ``documents``, one corpus operator after the other.

Each stage takes the session, what the stage before kept, and the folder of the
tables; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of their documents, with the
values they came with, ``lang`` alone excepted; the last adds ``shard`` and ``slot``.

Null and empty texts have no language and go in the first stage, which later
stages do not see; very long texts are read whole, repeated rows stay once, ties
go to the smaller id, a null id counts as the largest, no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townsquare.llm import common, decontamination, langid, mixing, neardup, sharding

SHARDS = 24
MIN_LANGUAGE_SCORE = 0.3


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """All columns as one struct ``row``, out of reach of an operator's own columns, and those it works on beside it."""
    return common.packed(docs).select("row", *[F.col(f"row.`{name}`") for name in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language; texts without a letter, and those of no clear language, go."""
    model = langid.train(docs.where(langid.learned_from(docs)))
    tagged = langid.languages(_packed(docs, "text"), model)
    kept = tagged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return common.unpacked(kept, lang=F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, that with the smallest id, at 80 % of common five-word shingles."""
    return neardup.without_near_duplicates(docs, shingle=5, threshold=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item leaks."""
    found = decontamination.find_leaks(_packed(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.unpacked(found.where(F.size("leaks") == 0).select("row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, so that the sources come near equal weights; none goes."""
    mixed = mixing.mix(_packed(docs, "doc_id", "text", "source"), carry=["row"])
    return common.unpacked(mixed.select("row"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in a shard, by a uniform shuffle."""
    return sharding.uniform_shards(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express learned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, with a table in the shared folder after each but the last."""
    folder = common.scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = common.cut(stage(spark, docs, sf_dir), f"{folder}/{number}-{name}")
    return docs
