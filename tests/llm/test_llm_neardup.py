"""Near duplicates against brute force, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, frame, prose
from pyspark.sql import functions as F

import corpus_pipeline
from townsquare.llm import decontamination, mixing, neardup


def brute(rows, shingle=3, percent=85):
    """Per row the size of its set, the smallest id of its component, and the row of it that stays, by comparing all pairs."""
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        n = min(shingle, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    order = {c: min(own, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for c, own in members.items()}
    return [(len(sets[i]), rows[order[find(i)]][0], order[find(i)]) for i in range(len(rows))]


def check(got, rows, **options):
    want = Counter((r[0], n, least, r[0] == least) for r, (n, least, _) in zip(rows, brute(rows, **options), strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_copies_and_edits_of_many_strengths(spark):
    rng = random.Random(1)
    rows = documents(30)
    base = [prose(rng, "en", 120) for _ in range(6)]
    for i in range(260):
        rows.append((1000 + i, edited(rng, base[i % 6], rng.randrange(0, 9)), "en", "s", 0))
    check(neardup.near_duplicates(frame(spark, rows)).collect(), rows)


def test_a_chain_of_edits_is_one_component(spark):
    rng, rows = random.Random(2), []
    text = prose(rng, "en", 150)
    for i in range(40):
        rows.append((i * 7 % 40, text, "en", "s", 0))
        text = edited(rng, text, 2)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    check(got, rows)
    assert len({r["component_id"] for r in got}) < 10


def test_other_shingles_and_threshold(spark):
    rng = random.Random(3)
    base = [prose(rng, "en", 100) for _ in range(5)]
    rows = [(i, edited(rng, base[i % 5], rng.randrange(0, 6)), "en", "s", 0) for i in range(120)]
    found = neardup.near_duplicates(frame(spark, rows), shingle=5, threshold=0.8).collect()
    check(found, rows, shingle=5, percent=80)


def test_buckets_with_several_components(spark, monkeypatch):
    """Tiles of three members, and bands so wide that unlike texts share buckets."""
    monkeypatch.setattr(neardup, "TILE", 3)
    monkeypatch.setattr(neardup, "bands_for", lambda threshold, rows: 120)
    rng = random.Random(4)
    shared = prose(rng, "en", 60)
    base = [f"{shared} {prose(rng, 'en', 40)}" for _ in range(4)]
    rows = [(i, edited(rng, base[i * 13 % 4], rng.randrange(0, 5)), "en", "s", 0) for i in range(60)]
    check(neardup.near_duplicates(frame(spark, rows), rows=2).collect(), rows)


def test_nothing_and_empty_texts_only(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n", "en", "s", 0)]
    check(neardup.near_duplicates(frame(spark, rows)).collect(), rows)


def test_whole_rows_are_kept(spark):
    rows = documents()
    docs = frame(spark, rows).withColumn("id", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("dropped_id", F.lit(3))
    got = neardup.without_near_duplicates(docs).collect()
    want = brute(rows)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for i, r in enumerate(rows) if want[i][2] == i)
    assert {(r["id"], r["kept"], r["dropped_id"]) for r in got} == {(1, 2, 3)}


def test_rows_that_share_an_id(spark):
    """Each row is compared by its own text; clean texts stay, whatever their id, and one copy of each group."""
    rng = random.Random(8)
    a, b, c, d = (prose(rng, "en", 80) for _ in range(4))
    rows = [(100, a, "en", "s", 0), (101, a, "en", "s", 0), (101, b, "en", "s", 0), (None, c, "en", "s", 0), (None, c, "en", "t", 0)]
    rows += [(None, d, "en", "s", 0), (7, edited(rng, d, 1), "en", "s", 0), (9, b, "en", "s", 0), (9, b, "en", "s", 0)]
    check(neardup.near_duplicates(frame(spark, rows)).collect(), rows)
    got = neardup.without_near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(100, a), (9, b), (None, c), (7, rows[6][1])], key=str)


def test_components(spark, tmp_path):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in neardup.components(links, str(tmp_path)).collect()}
    top = {i: i for p in pairs for i in p}
    for _ in range(len(top)):
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    assert got == {i: t for i, t in top.items() if i != t}


def test_registers_merge_and_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(6)
    sketcher = neardup.Sketcher(4000)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    left, right = pool[:900], pool[100:]
    a, b, union = sketcher.registers([left, right, pool])
    assert (neardup.merge(a, b) == union).all()
    assert abs((a == b).mean() - 0.8) < 0.03
    grid = np.linspace(0, 1, 101)
    value = neardup.log_likelihoods(a[None], b[None], np.array([900.0]), np.array([900.0]), grid)[0]
    assert abs(grid[value.argmax()] - 0.8) < 0.03


def test_likelihood_keeps_similar_and_drops_unlike_pairs():
    rng = np.random.default_rng(7)
    sketcher = neardup.Sketcher(180)
    for similarity, wanted in ((0.85, True), (0.95, True), (0.3, False)):
        both = round(2000 * similarity / (1 + similarity))
        kept = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2000 - both).astype(np.uint64)
            a, b = sketcher.registers([pool[:1000], pool[1000 - both :]])
            kept.append(bool(neardup.plausible(a[None], b[None], np.array([1000]), np.array([1000]), 0.85)[0]))
        assert all(k == wanted for k in kept)


def test_bands():
    assert (1 - 0.85**6) ** neardup.bands_for(0.85, 6) <= 1e-6
    assert (1 - 0.8**4) ** neardup.bands_for(0.8, 4) <= 1e-6


# --- pipeline -----------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and a benchmark, and the rows of both."""
    rng = random.Random(20)
    tests = [(i, prose(rng, "en", 30)) for i in range(5)]
    rows = documents(60)
    rows += [(200 + i, f"{prose(rng)}\n{text}", "en", "s0", 0) for i, text in tests]
    rows += [(300 + i, rows[i][1], "en", "s4", 0) for i in range(4, 8)]
    folder = tmp_path_factory.mktemp("corpus")
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(tests, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, tests


def test_pipeline_against_brute_force(spark, corpus):
    folder, rows, tests = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = got.collect()
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    groups = brute(lettered, shingle=5, percent=80)
    single = [r for i, r in enumerate(lettered) if groups[i][2] == i]
    runs = [decontamination.grams(decontamination.words(text)) for _, text in tests]
    clean = [r for r in single if not any(t <= decontamination.grams(decontamination.words(r[1])) for t in runs)]
    assert {r["doc_id"] for r in got} == {r[0] for r in clean}
    assert not {200, 201, 202, 203, 204} & {r["doc_id"] for r in got}
    mixed = mixing.mix(frame(spark, clean)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in mixed)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(got)
    assert {r["lang"] for r in got} <= {"en", "de"}


def test_each_stage_returns_the_columns_of_documents(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.shard(spark, docs.limit(0), folder).count() == 0


CLASHES = ["score", "epoch", "lang_pred", "lang_shares", "leaks", "tokens", "block", "position", "row", "id", "component", "kept", "found0", "text2"]


def test_stages_take_extra_columns(spark, corpus):
    """And leave their values alone."""
    folder, rows, _ = corpus
    own = spark.read.parquet(f"{folder}/documents.parquet")
    docs = own.withColumns({name: F.lit(f"my {name}") for name in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        assert {tuple(r) for r in got.select(*CLASHES).distinct().collect()} == {tuple(f"my {c}" for c in CLASHES)}, name
