"""Results do not depend on how the rows are laid out, nor on a hot key."""

import pytest
from pyspark.sql import functions as F

from townsquare.functions import text as T
from townsquare.operators import extract, network, search, temporal, topics


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows share one user, one id, one link and one hour."""
    hot = F.col("n") % 3 == 0
    return spark.range(3000).withColumnRenamed("id", "n").select(
        F.when(hot, 1).otherwise(F.col("n") % 200).alias("id"),
        F.when(hot, F.lit("hot words here")).otherwise(F.concat_ws(" ", F.col("n") % 17, F.hex(F.col("n") % 5))).alias("text"),
        F.timestamp_seconds(F.when(hot, 1700000000).otherwise(1700000000 + F.col("n") * 977)).alias("created_time"),
        F.concat(F.lit("raw"), "n").alias("raw"),
        F.struct(F.when(hot, 5).otherwise(F.col("n") % 50).alias("id"), F.lit("Ann").alias("screen_name")).alias("user"),
    )


def pairs(rows):
    return rows.select(
        F.col("user.id").alias("src"), F.col("user.screen_name").alias("src_name"),
        F.col("id").alias("dst"), F.lit("Bob").alias("dst_name"),
    )


JOBS = {
    "frequency": lambda r: temporal.frequency(r, "hour"),
    "symbols": lambda r: temporal.symbol_frequency(r, ["hot", "1"], "day"),
    "user_ids": lambda r: extract.user_ids(r),
    "once": lambda r: extract.tweets_by_id_once(r, r.sparkSession.range(1, 20, 3)),
    "by_user": lambda r: extract.tweets_by_user(r, r.sparkSession.range(5, 7)).select("raw"),
    "cooccurring": lambda r: search.cooccurring_terms(r, ["hot", "1"], 10, T.words(F.col("text"))),
    "terms": lambda r: topics.vocabulary(r.select(F.col("raw").alias("id"), "text"), [], min_df=2),
    "trimmed": lambda r: network.pairs_to_graph(pairs(r), 4).edges,
}


@pytest.mark.parametrize("job", sorted(JOBS))
def test_layout(rows, job):
    results = [sorted(map(str, JOBS[job](rows.repartition(n)).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2]
    assert results[0]
