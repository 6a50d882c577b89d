import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from records import mention, tweet

from townsquare.operators import community, network
from townsquare.sources import posts


def test_mentions_and_names(lines, rows):
    table = posts.tweets(
        lines(
            tweet(1, user=1, name="Ann", user_mentions=[mention(2, "Bob"), mention(2, "Bob"), mention(1, "Ann")]),
            tweet(2, user=2, name="Bobby", at="Thu Jan 04 00:00:00 +0000 2024", user_mentions=[mention(1, "Ann")]),
            tweet(3, user=9),
        )
    )
    graph = network.mention_graph(table)
    assert rows(graph.edges) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    assert rows(graph.vertices) == [(1, "Ann"), (2, "Bobby")]
    assert graph.edges.agg(F.sum("w")).first()[0] == 4


def test_retweets(lines, rows):
    inner = tweet(5, user=7, name="Gil")
    table = posts.tweets(lines(tweet(1, user=1, retweeted_status=inner), tweet(2, user=1, retweeted_status=inner), tweet(3)))
    graph = network.retweet_graph(table)
    assert rows(graph.edges) == [(1, 7, 2)]
    assert rows(graph.vertices) == [(1, "Ann"), (7, "Gil")]


def test_trim_is_one_pass_and_counts_self_loops_twice(spark, rows):
    pairs = spark.createDataFrame(
        [(1, "a", 2, "b"), (2, "b", 3, "c"), (3, "c", 1, "a"), (3, "c", 4, "d"), (5, "e", 5, "e"), (1, "a", 2, "b")],
        "src long, src_name string, dst long, dst_name string",
    )
    graph = network.pairs_to_graph(pairs, min_degree=2)
    assert rows(graph.vertices) == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]
    assert rows(graph.edges) == [(1, 2, 2), (2, 3, 1), (3, 1, 1), (5, 5, 1)]
    assert network.pairs_to_graph(pairs).vertices.count() == 5
    assert rows(network.pairs_to_graph(pairs, min_degree=3).vertices) == [(3, "c")]


# --- communities ------------------------------------------------------------


def table(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, w long")


def vertices(spark, edges, extra=()):
    ids = sorted({v for e in edges for v in e[:2]} | set(extra))
    return spark.createDataFrame([(v, f"n{v}") for v in ids], "id long, name string")


def by_hand(edges, internal=None):
    """The half cycles on dictionaries, in exact fractions."""
    internal = internal or defaultdict(int)
    links = defaultdict(Counter)
    for a, b, w in edges:
        links[a][b] += w
        links[b][a] += w
    weight = {v: sum(c.values()) for v, c in links.items()}
    total = sum(weight.values()) + sum(internal[v] for v in weight)
    label = {v: v for v in weight}

    def sums():
        out = Counter()
        for v, c in label.items():
            out[c] += weight[v] + internal[v]
        return out

    def pull(v):
        out = Counter()
        for n, w in links[v].items():
            out[label[n]] += w
        return out

    count = stalled = moved_before = moved = 0
    while True:
        count += 1
        even = count % 2 == 1
        sigma, goes = sums(), {}
        for v in label:
            k = weight[v] + internal[v]
            best = (Fraction(0), None)
            for c, w in pull(v).items():
                if c == label[v]:
                    rest = sigma[c] - k
                    gain = Fraction(0) if rest == 0 else w + internal[v] - Fraction(k * rest, total)
                else:
                    gain = w - Fraction(k * sigma[c], total)
                if gain > 0 and (best[1] is None or (gain, c) > best):
                    best = (gain, c)
            c = best[1]
            if c is not None and (label[v] > c if even else label[v] < c):
                goes[v] = c
        label.update(goes)
        moved = len(goes) + (0 if even else moved)
        if not even:
            stalled += moved >= moved_before - 1
            moved_before = moved
            if stalled > 1 or moved == 0:
                break
    sigma = sums()
    q = sum(
        max(0.0, (internal[v] + pull(v)[label[v]]) / total - sigma[label[v]] * (weight[v] + internal[v]) / total**2)
        for v in label
    )
    return label, q, count // 2


def random_edges(seed, n=30, m=90):
    draw = random.Random(seed)
    return [(draw.randrange(n), draw.randrange(n), draw.randint(1, 4)) for _ in range(m)]


def clusters():
    return [(g * 10 + a, g * 10 + b, 3) for g in range(3) for a in range(5) for b in range(a)] + [(0, 10, 1), (10, 20, 1)]


@pytest.mark.parametrize("edges", [random_edges(1), random_edges(2), clusters()], ids=["r1", "r2", "clusters"])
def test_one_level_equals_the_rules_by_hand(spark, edges):
    label, q, cycles = by_hand(edges)
    e = table(spark, edges)
    got = community.one_level(community.initial_state(vertices(spark, edges, extra=[999]), e), e)
    found = {r.vid: r.community for r in got.state.collect()}
    assert found.pop(999) == 999
    assert found == label
    assert got.cycles == cycles
    assert got.modularity == pytest.approx(q)


def test_one_level_does_not_depend_on_layout_or_hub_splits(spark):
    edges = random_edges(3) + [(0, v, 1) for v in range(1, 30)]
    label, q, _ = by_hand(edges)
    for parts, split_rows in ((1, 1_000_000), (7, 1_000_000), (5, 4)):
        e = table(spark, edges).repartition(parts)
        got = community.one_level(community.initial_state(vertices(spark, edges), e), e, split_rows=split_rows)
        assert {r.vid: r.community for r in got.state.collect()} == label
        assert got.modularity == pytest.approx(q)


def test_hubs_are_split_by_their_size(spark):
    edges = [(0, v, 1) for v in range(1, 11)]
    got = community.hubs(community.adjacency(table(spark, edges)), split_rows=4).collect()
    assert [(r.vid, r.parts) for r in got] == [(0, 3)]


def test_totals_follow_the_labels(spark):
    edges = clusters()
    e = table(spark, edges)
    state = community.initial_state(vertices(spark, edges), e)
    after = community.half_cycle(state, community.adjacency(e), community.total_weight(state), even=True)
    rows = after.collect()
    sums = Counter()
    for r in rows:
        sums[r.community] += r.node_weight + r.internal
    assert all(r.sigma_tot == sums[r.community] for r in rows)
    assert any(r.changed for r in rows)


def test_modularity_of_a_known_labelling(spark):
    edges = [(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 5, 1), (5, 6, 1), (6, 4, 1), (3, 4, 1)]
    e = table(spark, edges)
    state = community.initial_state(vertices(spark, edges), e)
    state = community.with_totals(state.withColumn("community", F.when(F.col("vid") <= 3, 1).otherwise(4).cast("bigint")))
    q = community.modularity(state, community.adjacency(e), floor_at_zero=False).first()[0]
    assert q == pytest.approx(6 / 7 - 0.5)


def test_compress(spark, rows):
    edges = [(1, 2, 2), (2, 3, 1), (3, 4, 5), (1, 1, 3), (4, 1, 1)]
    e = table(spark, edges)
    state = community.initial_state(vertices(spark, edges, extra=[9]), e)
    state = state.withColumn("community", F.when(F.col("vid") <= 2, 1).when(F.col("vid") <= 4, 3).otherwise(9).cast("bigint"))
    small, between = community.compress(state, e)
    assert rows(between) == [(1, 3, 2)]
    assert rows(small.select("vid", "community", "sigma_tot", "internal", "node_weight")) == [
        (1, 1, 12, 10, 2), (3, 3, 12, 10, 2), (9, 9, 0, 0, 0),
    ]
    assert community.total_weight(small) == community.total_weight(state)


def test_labels_of_a_graph(spark):
    edges = clusters()
    labelled, q, cycles = community.label_graph(vertices(spark, edges, extra=[50]), table(spark, edges))
    got = {r.id: r.community for r in labelled.collect()}
    assert q > 0.5 and cycles >= 1
    assert got[50] == 50
    assert set(labelled.columns) == {"id", "name", "community"}


def test_hierarchy_gets_better_by_levels(spark):
    edges = clusters()
    got = community.hierarchy(vertices(spark, edges), table(spark, edges))
    assert got.modularities == sorted(got.modularities)
    top = got.labels.where(F.col("level") == len(got.modularities) - 1)
    groups = defaultdict(set)
    for r in top.collect():
        groups[r.vid // 10].add(r.community)
    assert all(len(g) == 1 for g in groups.values())
    assert len({c for g in groups.values() for c in g}) == 3
    per_level = {r["level"]: r["count"] for r in got.labels.groupBy("level").count().collect()}
    assert set(per_level.values()) == {15}


def ring_of_triangles(n, first=0):
    edges = []
    for i in range(n):
        a = first + 3 * i
        edges += [(a, a + 1, 1), (a + 1, a + 2, 1), (a, a + 2, 1), (a + 2, first + 3 * ((i + 1) % n), 1)]
    return edges


def textbook(edges, labels):
    total = 2 * sum(w for *_, w in edges)
    inside, sigma = 0, {}
    for a, b, w in edges:
        inside += 2 * w * (labels[a] == labels[b])
        for end in (a, b):
            sigma[labels[end]] = sigma.get(labels[end], 0) + w
    return inside / total - sum((s / total) ** 2 for s in sigma.values())


def test_closed_communities_count_in_the_hierarchy(spark):
    clique = [(100 + i, 100 + j, 1) for i in range(5) for j in range(i)]
    edges = ring_of_triangles(12) + clique
    got = community.hierarchy(vertices(spark, edges), table(spark, edges))
    levels = {}
    for r in got.labels.collect():
        levels.setdefault(r["level"], {})[r["vid"]] = r["community"]
    assert [len(set(levels[i].values())) for i in sorted(levels)][:2] == [13, 7]
    for i, q in enumerate(got.modularities):
        assert q == pytest.approx(textbook(edges, levels[i]))


def test_runs_clear_their_folder(spark):
    import os

    base = spark.conf.get("spark.checkpoint.dir")
    edges = ring_of_triangles(4)
    labelled, _, _ = community.label_graph(vertices(spark, edges), table(spark, edges))
    assert labelled.count() == 12
    assert not [name for name in os.listdir(base) if name.startswith("townsquare-")]
    broken = table(spark, edges).selectExpr("src", "dst", "raise_error('no') AS w")
    with pytest.raises(Exception, match="no"):
        community.one_level(community.initial_state(vertices(spark, edges), table(spark, edges)), broken)
    assert not [name for name in os.listdir(base) if name.startswith("townsquare-")]
