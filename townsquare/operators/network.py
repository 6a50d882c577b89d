"""User graphs as two tables: vertices (id, name) and edges (src, dst, w)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.session import kept


class Graph(NamedTuple):
    vertices: DataFrame
    edges: DataFrame


def mention_pairs(tweets: DataFrame) -> DataFrame:
    """One row per mention: author, mentioned user, and the tweet's time."""
    rows = tweets.select(
        F.col("user.id").alias("src"),
        F.col("user.screen_name").alias("src_name"),
        F.explode("entities.user_mentions").alias("to"),
        F.col("created_time").alias("time"),
    )
    return _known(
        rows.select(
            "src", "src_name", F.col("to.id").alias("dst"), F.col("to.screen_name").alias("dst_name"), "time"
        )
    )


def retweet_pairs(tweets: DataFrame) -> DataFrame:
    """One row per retweet: retweeter, original author, and the time."""
    rows = tweets.where(F.col("retweeted_status").isNotNull()).select(
        F.col("user.id").alias("src"),
        F.col("user.screen_name").alias("src_name"),
        F.col("retweeted_status.user.id").alias("dst"),
        F.col("retweeted_status.user.screen_name").alias("dst_name"),
        F.col("created_time").alias("time"),
    )
    return _known(rows)


def _known(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def mention_graph(tweets: DataFrame, min_degree: int = 0) -> Graph:
    """Author to mentioned user, weighted by the number of mentions."""
    return pairs_to_graph(mention_pairs(tweets), min_degree)


def retweet_graph(tweets: DataFrame, min_degree: int = 0) -> Graph:
    """Retweeter to original author, weighted by the number of retweets."""
    return pairs_to_graph(retweet_pairs(tweets), min_degree)


def merge_edges(pairs: DataFrame) -> DataFrame:
    """(src, dst, w): pairs counted, or their weights ``w`` summed."""
    weight = F.sum("w") if "w" in pairs.columns else F.count("*")
    return pairs.groupBy("src", "dst").agg(weight.alias("w"))


def users(pairs: DataFrame) -> DataFrame:
    """(id, name) of both ends: the name seen last, or without times the
    greatest. Sightings are reduced per (id, name) first."""
    time = [F.col("time")] if "time" in pairs.columns else []
    ends = [
        F.struct(F.col(end).alias("id"), F.col(f"{end}_name").alias("name"), *time) for end in ("src", "dst")
    ]
    seen = pairs.select(F.inline(F.array(*ends)))
    if not time:
        return seen.distinct().groupBy("id").agg(F.max("name").alias("name"))
    last = seen.groupBy("id", "name").agg(F.max("time").alias("time"))
    return last.groupBy("id").agg(F.max_by("name", F.struct("time", "name")).alias("name"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out per vertex; a self loop counts twice."""
    # w > 0 always holds; naming w here lets this branch share the merged
    # edges' exchange instead of counting the pairs again without w.
    ends = edges.where(F.col("w") > 0).select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def trim(graph: Graph, min_degree: int) -> Graph:
    """Vertices of at least ``min_degree`` and the edges between them; one
    pass, so degrees in the result can be lower. 0 keeps everything."""
    if min_degree == 0:
        return graph
    keep = degrees(graph.edges).where(F.col("degree") >= min_degree).select("id")
    edges = graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(
        keep.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )
    vertices = graph.vertices.join(keep, "id", "left_semi")
    return Graph(vertices, edges.select("src", "dst", "w"))


def pairs_to_graph(pairs: DataFrame, min_degree: int = 0) -> Graph:
    """Graph of (src, src_name, dst, dst_name[, w][, time]) rows, trimmed."""
    return trim(Graph(users(pairs), merge_edges(pairs)), min_degree)


def stored(graph: Graph) -> Graph:
    """The graph as two checkpoints, for jobs that read it many times."""
    return Graph(kept(graph.vertices), kept(graph.edges))
