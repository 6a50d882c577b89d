"""User graphs and communities, over customers, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from townsquare.operators import community as louvain
from townsquare.operators import network as job
from townsquare.plans import Plan, tables
from townsquare.plans.tables import SUPPLIER_OFFSET, over

MIN_DEGREE = 30


def _graph(spark, d, min_degree=0):
    return job.mention_graph(tables.order_tweets(spark, d), min_degree)


def mention_edges(spark, d):
    return _graph(spark, d).edges


def mention_vertices(spark, d):
    return _graph(spark, d).vertices


def _retweets(spark, d):
    return tables.tweets(spark, d, "user", "retweeted_status", "created_time")


def retweet_edges(spark, d):
    return job.retweet_graph(_retweets(spark, d)).edges


def retweet_vertices(spark, d):
    return job.retweet_graph(_retweets(spark, d)).vertices


def trimmed_edges(spark, d):
    return _graph(spark, d, MIN_DEGREE).edges


def trimmed_vertices(spark, d):
    return _graph(spark, d, MIN_DEGREE).vertices


def _start(spark, d):
    graph = job.stored(_graph(spark, d))
    return louvain.initial_state(graph.vertices, graph.edges), graph.edges


def initial_state(spark, d):
    return _start(spark, d)[0].drop("changed")


def neighbour_weights(spark, d):
    state, edges = _start(spark, d)
    return louvain.neighbour_weights(state, louvain.adjacency(edges))


def best_moves(spark, d):
    state, edges = _start(spark, d)
    weights = louvain.neighbour_weights(state, louvain.adjacency(edges))
    moves = louvain.best_moves(state, weights, louvain.total_weight(state), even=True)
    return moves.select("vid", "community", "changed")


def half_cycle(spark, d):
    state, edges = _start(spark, d)
    return louvain.half_cycle(state, louvain.adjacency(edges), louvain.total_weight(state), even=True).drop("changed")


def _by_nation(spark, d):
    """The graph under a given labelling: customers and suppliers in the
    community of their nation."""
    state, edges = _start(spark, d)
    customers = tables.table(spark, d, "customer").select(
        F.col("c_custkey").alias("vid"), F.col("c_nationkey").cast("bigint").alias("community")
    )
    suppliers = tables.table(spark, d, "supplier").select(
        (F.col("s_suppkey") + SUPPLIER_OFFSET).alias("vid"), F.col("s_nationkey").cast("bigint").alias("community")
    )
    labels = customers.unionByName(suppliers)
    return louvain.with_totals(state.drop("community").join(labels, "vid")), edges


def modularity(spark, d):
    state, edges = _by_nation(spark, d)
    rows = louvain.modularity(state, louvain.adjacency(edges))
    return rows.select(F.round("modularity", 9).alias("modularity"))


def modularity_plain(spark, d):
    state, edges = _by_nation(spark, d)
    rows = louvain.modularity(state, louvain.adjacency(edges), floor_at_zero=False)
    return rows.select(F.round("modularity", 9).alias("modularity"))


def compressed_state(spark, d):
    state, _ = louvain.compress(*_by_nation(spark, d))
    return state.drop("changed", "community")


def compressed_edges(spark, d):
    return louvain.compress(*_by_nation(spark, d))[1]


def modularity_closed(spark, d):
    """Textbook modularity of a compressed graph: the one of the nations, with
    every nation closed, as no edge between two of them is left."""
    state, edges = _by_nation(spark, d)
    there = state.select("vid", F.col("community"))
    ends = edges.join(there.toDF("src", "a"), "src").join(there.toDF("dst", "b"), "dst")
    inner, between = louvain.compress(state, ends.where("a = b").select("src", "dst", "w"))
    rows = louvain.modularity(inner, louvain.adjacency(between), floor_at_zero=False)
    return rows.select(F.round("modularity", 9).alias("modularity"))


def louvain_two_cycles(spark, d):
    """The state after two whole cycles."""
    state, edges = _start(spark, d)
    adjacent, total = louvain.adjacency(edges), louvain.total_weight(state)
    for half in range(4):
        state = louvain.half_cycle(state, adjacent, total, even=half % 2 == 0)
    return state.drop("changed")


def louvain_level(spark, d):
    level = louvain.one_level(*_start(spark, d))
    return level.state.drop("changed")


def louvain_labels(spark, d):
    graph = job.stored(_graph(spark, d))
    labelled, _, _ = louvain.label_graph(graph.vertices, graph.edges)
    return labelled


def louvain_hierarchy(spark, d):
    graph = job.stored(_graph(spark, d))
    return louvain.hierarchy(graph.vertices, graph.edges).labels


_PAIRS = f"""pairs AS (
  SELECT o.o_custkey AS src, c.c_name AS src_name, l.l_suppkey + {SUPPLIER_OFFSET} AS dst, s.s_name AS dst_name
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""
_GRAPH = _PAIRS + """,
edges AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS w FROM pairs GROUP BY ALL),
vertices AS (SELECT DISTINCT src AS id, src_name AS name FROM pairs UNION SELECT DISTINCT dst, dst_name FROM pairs)"""
_DEGREES = f"""keep AS (SELECT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
  GROUP BY id HAVING count(*) >= {MIN_DEGREE})"""
_RETWEETS = """pairs AS (SELECT user_id AS src, screen_name AS src_name, other_user AS dst, other_name AS dst_name, ts
  FROM tweets WHERE event_type = 'click' AND other_id IS NOT NULL)"""

# State of the start, and of the start under the nations' labels.
_STATE = _GRAPH + """,
adj AS (SELECT src AS vid, dst AS neighbour, w FROM edges UNION ALL SELECT dst, src, w FROM edges),
state AS (SELECT vid, vid AS community, CAST(sum(w) AS BIGINT) AS sigma_tot, CAST(0 AS BIGINT) AS internal,
  CAST(sum(w) AS BIGINT) AS node_weight FROM adj GROUP BY vid)"""
_WEIGHTS = """weights AS (SELECT adj.vid, s.community, s.sigma_tot, CAST(sum(adj.w) AS BIGINT) AS w
  FROM adj JOIN state s ON s.vid = adj.neighbour GROUP BY ALL)"""


def _half(n: int, down: bool) -> str:
    """A half cycle in SQL, from ``state`` or ``state<n>`` to ``state<n + 1>``."""
    old, new, sign = f"state{n or ''}", f"state{n + 1}", ">" if down else "<"
    return f"""weights{n} AS (SELECT adj.vid, s.community, s.sigma_tot, CAST(sum(adj.w) AS BIGINT) AS w
  FROM adj JOIN {old} s ON s.vid = adj.neighbour GROUP BY ALL),
gains{n} AS (SELECT c.vid, c.community,
  CASE WHEN c.community = s.community AND c.sigma_tot = s.node_weight + s.internal THEN 0
    ELSE (c.w + CASE WHEN c.community = s.community THEN s.internal ELSE 0 END)::HUGEINT * m
      - (s.node_weight + s.internal)::HUGEINT
        * (c.sigma_tot - CASE WHEN c.community = s.community THEN s.node_weight + s.internal ELSE 0 END) END AS gain
  FROM weights{n} c JOIN {old} s ON s.vid = c.vid, (SELECT sum(internal + node_weight) AS m FROM state)),
best{n} AS (SELECT vid, community FROM gains{n} WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY vid ORDER BY gain DESC, community DESC) = 1),
moves{n} AS (SELECT s.vid, CASE WHEN s.community {sign} b.community THEN b.community ELSE s.community END AS community,
  coalesce(s.community {sign} b.community, false) AS changed, s.internal, s.node_weight
  FROM {old} s LEFT JOIN best{n} b ON b.vid = s.vid),
{new} AS (SELECT vid, community, CAST(sum(internal + node_weight) OVER (PARTITION BY community) AS BIGINT) AS sigma_tot,
  internal, node_weight FROM moves{n})"""


_NATIONS = f"""labels AS (SELECT c_custkey AS vid, CAST(c_nationkey AS BIGINT) AS community FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER_OFFSET}, CAST(s_nationkey AS BIGINT) FROM supplier),
lab AS (SELECT s.vid, l.community, s.node_weight, sum(s.node_weight) OVER (PARTITION BY l.community) AS sigma
  FROM state s JOIN labels l ON l.vid = s.vid),
m AS (SELECT sum(node_weight)::DOUBLE AS m FROM state),
inner_w AS (SELECT a.vid, sum(a.w) AS w FROM adj a JOIN lab x ON x.vid = a.vid JOIN lab y ON y.vid = a.neighbour
  WHERE x.community = y.community GROUP BY 1),
q AS (SELECT coalesce(i.w, 0) / m - lab.sigma::DOUBLE * lab.node_weight / (m * m) AS q
  FROM lab LEFT JOIN inner_w i ON i.vid = lab.vid, m)"""
_MERGED = """merged AS (SELECT least(x.community, y.community) AS src, greatest(x.community, y.community) AS dst,
  CAST(sum(e.w) AS BIGINT) AS w FROM edges e JOIN lab x ON x.vid = e.src JOIN lab y ON y.vid = e.dst GROUP BY 1, 2)"""

PLANS = {
    "mention_edges": Plan(mention_edges, f"WITH {_GRAPH} SELECT src, dst, w FROM edges"),
    "mention_vertices": Plan(mention_vertices, f"WITH {_GRAPH} SELECT id, name FROM vertices"),
    "retweet_edges": Plan(
        retweet_edges, over("tweets", "SELECT src, dst, count(*) AS w FROM pairs GROUP BY src, dst", _RETWEETS)
    ),
    "retweet_vertices": Plan(
        retweet_vertices,
        over(
            "tweets",
            """SELECT id, max(struct_pack(ts := ts, name := name)).name AS name FROM (
  SELECT src AS id, src_name AS name, ts FROM pairs UNION ALL SELECT dst, dst_name, ts FROM pairs) GROUP BY id""",
            _RETWEETS,
        ),
    ),
    "trimmed_edges": Plan(
        trimmed_edges,
        f"""WITH {_GRAPH}, {_DEGREES} SELECT src, dst, w FROM edges
WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""",
    ),
    "trimmed_vertices": Plan(
        trimmed_vertices,
        f"WITH {_GRAPH}, {_DEGREES} SELECT id, name FROM vertices WHERE id IN (SELECT id FROM keep)",
    ),
    "louvain_initial_state": Plan(initial_state, f"WITH {_STATE} SELECT * FROM state"),
    "louvain_neighbour_weights": Plan(neighbour_weights, f"WITH {_STATE}, {_WEIGHTS} SELECT * FROM weights"),
    "louvain_best_moves": Plan(best_moves, f"WITH {_STATE}, {_half(0, True)} SELECT vid, community, changed FROM moves0"),
    "louvain_half_cycle": Plan(half_cycle, f"WITH {_STATE}, {_half(0, True)} SELECT * FROM state1"),
    "louvain_two_cycles": Plan(
        louvain_two_cycles,
        f"WITH {_STATE}, " + ",\n".join(_half(n, n % 2 == 0) for n in range(4)) + "\nSELECT * FROM state4",
    ),
    "modularity_closed": Plan(
        modularity_closed,
        f"""WITH {_STATE}, {_NATIONS}, {_MERGED},
own AS (SELECT src, 2 * w AS w FROM merged WHERE src = dst)
SELECT round(sum(w / t - (w / t) * (w / t)), 9) AS modularity FROM own, (SELECT sum(w)::DOUBLE AS t FROM own)""",
    ),
    "modularity": Plan(
        modularity, f"WITH {_STATE}, {_NATIONS} SELECT round(sum(greatest(q, 0)), 9) AS modularity FROM q"
    ),
    "modularity_plain": Plan(
        modularity_plain, f"WITH {_STATE}, {_NATIONS} SELECT round(sum(q), 9) AS modularity FROM q"
    ),
    "compressed_state": Plan(
        compressed_state,
        f"""WITH {_STATE}, {_NATIONS}, {_MERGED},
outer_w AS (SELECT vid, sum(w) AS w FROM (SELECT src AS vid, w FROM merged WHERE src <> dst
  UNION ALL SELECT dst, w FROM merged WHERE src <> dst) GROUP BY vid),
ins AS (SELECT src AS vid, 2 * w AS w FROM merged WHERE src = dst)
SELECT c.vid, CAST(coalesce(i.w, 0) + coalesce(o.w, 0) AS BIGINT) AS sigma_tot,
  CAST(coalesce(i.w, 0) AS BIGINT) AS internal, CAST(coalesce(o.w, 0) AS BIGINT) AS node_weight
FROM (SELECT DISTINCT community AS vid FROM lab) c LEFT JOIN ins i ON i.vid = c.vid LEFT JOIN outer_w o ON o.vid = c.vid""",
    ),
    "compressed_edges": Plan(
        compressed_edges, f"WITH {_STATE}, {_NATIONS}, {_MERGED} SELECT src, dst, w FROM merged WHERE src <> dst"
    ),
    "louvain_level": Plan(louvain_level),
    "louvain_labels": Plan(louvain_labels),
    "louvain_hierarchy": Plan(louvain_hierarchy),
}
