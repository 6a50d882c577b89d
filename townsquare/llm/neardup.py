"""Near duplicates by SetSketch registers.

A text is the set of its word shingles. A register holds how small the smallest
of many exponential variates is, one per shingle: the truncated minimum on a
scale of powers of ``BASE``. Registers of a union are the maxima of those of its
parts, and two sets agree in a register with about their Jaccard similarity.

1. Texts with equal sets are one class, found by a fingerprint of the set.
2. Bands of registers put classes that may be similar into a bucket.
3. In each bucket all are compared with the member that shares most buckets with
   others. That settles groups of copies of any size. Only in buckets that still
   hold different components, what is outside of the largest one is compared
   with the rest, tile by tile.
4. A candidate's similarity is estimated jointly with both sizes, by likelihood.
   It goes on unless the likelihood speaks strongly against the threshold.
5. Links are confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import (
    Numbers, cut, distinct, distinct_places, empty, packed, pieces, ragged, scratch, small_batches, unpacked, utf8, words_of,
)

BASE, RATE = 1.02, 20.0  # of the registers' scale, and of the variates
TOP = (1 << 16) - 1  # of a register
MISSED = 1e-6  # chance that a pair at the threshold shares no band
AGAINST = 12.0  # difference of log likelihoods that speaks strongly against a link
TILE = 256  # members of a bucket in a tile
NUMBERED_AT_MOST = 200_000  # distinct words that a task remembers
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, rows: int) -> int:
    """Bands of ``rows`` registers with which a pair at the threshold is missed with a chance of 1e-6."""
    return math.ceil(math.log(MISSED) / math.log(1 - threshold**rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingles of texts as 64-bit hashes, with the distinct words of a task remembered."""

    def __init__(self, size: int) -> None:
        self.size, self.numbers, self.hashes = size, Numbers(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text its sorted distinct shingles; of fewer words, the whole sequence as one; of none, none."""
        if len(self.numbers) > NUMBERED_AT_MOST:
            self.numbers, self.hashes = Numbers(), np.zeros(0, np.uint64)
        ids, sizes = ragged([list(map(self.numbers.__getitem__, words_of(t))) for t in texts])
        fresh = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers.take()], np.uint64)
        self.hashes = np.concatenate([self.hashes, fresh])
        words = self.hashes[ids]
        runs = self._runs(words, self.size)
        out, at = [], 0
        for n in sizes.tolist():
            if n >= self.size:
                out.append(distinct(runs[at : at + n - self.size + 1]))
            elif n:
                out.append(self._runs(words[at : at + n], n))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out

    @staticmethod
    def _runs(words: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of so many words; the length goes into the hash."""
        n = max(0, len(words) - size + 1)
        out = np.full(n, size, np.uint64)
        for i in range(size):
            out = mixed(out * MULTIPLIER + words[i : i + n])
        return out


class Sketcher:
    """Registers of sets."""

    def __init__(self, registers: int) -> None:
        rng = np.random.default_rng(29)
        self.flip = rng.integers(0, 1 << 32, registers, dtype=np.uint32)
        self.turn = rng.integers(0, 1 << 31, registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """The smallest 32-bit hash of each register, per set; sets may not be empty."""
        sizes = np.array([len(s) for s in sets])
        out = np.empty((len(sets), len(self.flip)), np.uint32)
        low = 0
        while low < len(sets):  # as many sets at a time as fit into the processor's cache
            high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), 65_536, side="right")) + low)
            values = (np.concatenate(sets[low:high]) >> np.uint64(32)).astype(np.uint32)
            begins = np.cumsum(sizes[low:high]) - sizes[low:high]
            hashed = np.empty_like(values)
            for i, (flip, turn) in enumerate(zip(self.flip, self.turn, strict=True)):
                np.bitwise_xor(values, flip, out=hashed)
                np.multiply(hashed, turn, out=hashed)
                out[low:high, i] = np.minimum.reduceat(hashed, begins)
            low = high
        return out

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """The uniform minima as truncated exponential ones, on the scale of powers of the base."""
        uniform = (self.minima(sets).astype(np.float64) + 0.5) / 2.0**32
        smallest = -np.log1p(-uniform) / RATE
        return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, TOP).astype(np.uint16)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per band of so many registers."""
    bands = registers.shape[1] // rows
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MULTIPLIER, (len(registers), bands)).copy()
    for i in range(rows):
        out = mixed(out * MULTIPLIER + registers[:, i : bands * rows : rows])
    return out


def log_likelihoods(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, grid: np.ndarray):
    """Of each similarity of ``grid`` given the registers and sizes of pairs of sets; -inf where the sizes forbid it."""
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u

    def greater(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)

    more, less = greater(u - v * grid), greater(v - u * grid)
    more_n = (left > right).sum(axis=1)[:, None]
    less_n = (left < right).sum(axis=1)[:, None]
    equal_n = left.shape[1] - more_n - less_n
    value = more_n * np.log(more) + less_n * np.log(less) + equal_n * np.log(np.maximum(1 - more - less, 1e-12))
    return np.where(grid <= np.minimum(u / v, v / u) + 1e-12, value, -np.inf)


def plausible(left, right, n_left, n_right, threshold: float) -> np.ndarray:
    """Whether a pair may reach the threshold: its likelihood there is not far below the highest one."""
    grid = np.unique(np.append(np.linspace(0, 1, 101), threshold))
    value = log_likelihoods(left, right, n_left.astype(float), n_right.astype(float), grid)
    best = value[:, grid >= threshold].max(axis=1)
    return best >= value.max(axis=1) - AGAINST  # -inf, where the sizes forbid it, is never


def sketches(docs: DataFrame, text: str, shingle: int, rows: int, bands: int) -> DataFrame:
    """``id`` of the row, ``doc_id``, size ``n``, fingerprint ``f1`` and ``f2`` of the set, ``registers``, band ``keys``."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, sketcher = Shingler(shingle), Sketcher(rows * bands)
        for batch in batches:
            for part in pieces(batch):
                sets = shingler.sets([bytes(t) for t in part["text"]])
                full = [s for s in sets if len(s)]
                registers = sketcher.registers(full) if full else np.zeros((0, rows * bands), np.uint16)
                keys = band_keys(registers, rows).view(np.int64)
                place = np.cumsum([len(s) > 0 for s in sets]) - 1
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "doc_id": part["doc_id"].to_numpy(),
                        "known": part["known"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "f1": np.array([mixed(s).sum() for s in sets], np.uint64).view(np.int64),
                        "f2": np.array([mixed(s * MULTIPLIER).sum() for s in sets], np.uint64).view(np.int64),
                        "registers": [registers[p].tobytes() if len(s) else None for s, p in zip(sets, place, strict=True)],
                        "keys": [keys[p] if len(s) else None for s, p in zip(sets, place, strict=True)],
                    }
                )

    schema = "id bigint, doc_id bigint, known boolean, n bigint, f1 bigint, f2 bigint, registers binary, keys array<bigint>"
    number = F.col("row.doc_id").cast("bigint")
    rows = docs.select(
        "id", F.coalesce(number, F.lit(0)).alias("doc_id"), number.isNotNull().alias("known"), utf8(f"row.`{text}`").alias("text")
    ).mapInPandas(sketch, schema)
    # Null ids would turn a batch's ids into doubles.
    return rows.select("id", F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), *rows.columns[3:])


def _numbered(docs: DataFrame, folder: str) -> DataFrame:
    """All rows, each as one struct ``row`` beside a number ``id`` of its own, written as a table so that it keeps it."""
    return cut(packed(docs).withColumn("id", F.monotonically_increasing_id()), f"{folder}/numbered")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a``, ``b`` that registers and sizes do not speak against."""

    @F.pandas_udf("boolean")
    def may(n_a: pd.Series, n_b: pd.Series, r_a: pd.Series, r_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(map(bytes, r)), np.uint16).reshape(len(r), -1) for r in (r_a, r_b))
        return pd.Series(plausible(left, right, n_a.to_numpy(), n_b.to_numpy(), threshold))

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))

    sized = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sized).where(may("n_a", "n_b", "r_a", "r_b")).select("a", "b")


def _sets(docs: DataFrame, text: str, shingle: int, ids: DataFrame) -> DataFrame:
    """``id`` and its sorted shingles, for these ids."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shingle)
        for batch in batches:
            for part in pieces(batch):
                sets = shingler.sets([bytes(t) for t in part["text"]])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "shingles": [s.tobytes() for s in sets]})

    # Merged at any size: the ids grow with the documents, and so the plan is the same for few and many.
    texts = docs.select("id", utf8(f"row.`{text}`").alias("text")).join(ids.hint("merge"), "id", "left_semi")
    return texts.mapInPandas(make, "id bigint, shingles binary")


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets reach the threshold, in whole percents."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both > 0 and 100 * both >= round(threshold * 100) * (len(left) + len(right) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [
            linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), threshold) for a, b in zip(left, right, strict=True)
        ]
        return pd.Series(found, dtype=bool)

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("shingles").alias(f"s_{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(similar("s_a", "s_b")).select("a", "b")


class Tile(NamedTuple):
    """Members of a bucket; registers and sets as bytes."""

    ids: np.ndarray
    components: np.ndarray
    n: np.ndarray
    registers: list[bytes]
    sets: list[bytes]


def compare_tiles(left: Tile, right: Tile, same: bool, threshold: float) -> list[tuple[int, int]]:
    """Links between members of two tiles that join different components.

    Whatever is in one component, by its label or by a link found here, is not
    compared; so there are fewer links than components. Of the others, each
    likely pair is confirmed on the full sets, the most similar ones first.
    """
    if not len(left.ids) or not len(right.ids):
        return []
    _, places = distinct_places(np.concatenate([left.components, right.components]))
    label, own, other = np.arange(len(places)), places[: len(left.ids)], places[len(left.ids) :]
    registers = np.frombuffer(b"".join(right.registers), np.uint16).reshape(len(right.ids), -1)
    found = []
    for i, (doc, n) in enumerate(zip(left.ids.tolist(), left.n.tolist(), strict=True)):
        some = label[other] != label[own[i]]
        some &= np.minimum(right.n, n) >= threshold * np.maximum(right.n, n) - 1e-6
        at = np.flatnonzero(some & (right.ids > doc) if same else some)
        if not len(at):
            continue
        one = np.frombuffer(left.registers[i], np.uint16)
        agree = (registers[at] == one).mean(axis=1)
        near = agree >= threshold - 0.25  # far below what the likelihood lets pass
        at, agree = at[near], agree[near]
        if not len(at):
            continue
        many = np.broadcast_to(one, (len(at), len(one)))
        good = plausible(many, registers[at], np.full(len(at), n), right.n[at], threshold)
        mine = np.frombuffer(left.sets[i], np.uint64)
        for j in at[good][np.argsort(-agree[good], kind="stable")].tolist():
            if label[other[j]] != label[own[i]] and linked(mine, np.frombuffer(right.sets[j], np.uint64), threshold):
                found.append((min(doc, int(right.ids[j])), max(doc, int(right.ids[j]))))
                label[label == label[other[j]]] = label[own[i]]
    return found


def _compared(threshold: float):
    """Over rows sorted by pair of tiles, a pair at a time; a pair is a few hundred rows at most."""

    def links(frame: pd.DataFrame, first: np.ndarray) -> list[tuple[int, int]]:
        ids, components, n, low, high, leads = (
            frame[c].to_numpy() for c in ("id", "component", "n", "low", "high", "first")
        )
        registers, sets = list(map(bytes, frame["registers"])), list(map(bytes, frame["shingles"]))

        def tile(at: np.ndarray) -> Tile:
            return Tile(ids[at], components[at], n[at], [registers[i] for i in at], [sets[i] for i in at])

        found = []
        for begin, end in zip(first, np.append(first[1:], len(frame)), strict=True):
            rows = np.arange(begin, end)
            same = low[begin] == high[begin]
            left, right = (rows, rows) if same else (rows[leads[begin:end]], rows[~leads[begin:end]])
            found += compare_tiles(tile(left), tile(right), same, threshold)
        return found

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = frame[["key", "low", "high"]].to_numpy()
            first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1))) if len(frame) else []
            if len(first) > 1:
                found = links(frame.iloc[: first[-1]], first[:-1])
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
                frame = frame.iloc[first[-1] :]
            held = frame
        if held is not None and len(held):
            yield pd.DataFrame(links(held, np.array([0])), columns=["a", "b"], dtype="int64")

    return compare


def _between(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between different components in the buckets that hold several.

    ``members``: ``key``, ``id``, ``component``. Members of the component with
    most members in a bucket need no comparison among each other; the others
    are compared with all. Tiles of members are compared two at a time, and only
    confirmed links that join components come out.
    """
    counted = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("all"),
        F.max("n").alias("in_main"),
    ).where((F.col("parts") > 1) & (F.col("all") > 2))
    tiles_out = F.ceil((F.col("all") - F.col("in_main")) / TILE).cast("int")
    tiles_in = F.ceil(F.col("in_main") / TILE).cast("int")
    # Dealt into tiles by a hash, so that no task has to number a bucket.
    tile_of = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), tiles_out).otherwise(tiles_in)).cast("int")
    placed = members.join(mixed, "key").withColumn("outside", F.col("component") != F.col("main")).withColumn("tile", tile_of)
    # Tiles are numbered so that odd ones are outside of the largest component.
    outer = F.transform(F.sequence(F.lit(0), tiles_out - 1), lambda t: t * 2 + 1)
    inner = F.transform(F.sequence(F.lit(0), tiles_in - 1), lambda t: t * 2)
    # A member of an outside tile meets every tile; one of an inside tile only outside ones.
    meets = F.when(F.col("outside"), F.concat(outer, inner)).otherwise(outer)
    own = F.col("tile") * 2 + F.col("outside").cast("int")
    pairs = placed.select("key", "id", "component", own.alias("own"), F.explode(meets).alias("other"))
    rows = pairs.select(
        "key", "id", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") <= F.col("other")).alias("first"),
    ).join(nodes.select("id", "n", "registers"), "id").join(sets, "id")
    sorted_ = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return sorted_.mapInPandas(_compared(threshold), "a bigint, b bigint").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """``id`` and ``component``, the smallest id it reaches, of all ids in ``links`` but the smallest ones.

    Alternates two steps until nothing changes: every vertex links its larger
    neighbours to its smallest one, then itself and its smaller neighbours.
    What is left are stars around the smallest ids. Each turn is a table in the
    shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges, f"{folder}/edges-0")
    before, turn = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, turn = tuple(mark), turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, f"{folder}/large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct(), f"{folder}/edges-{turn}")


def _components(docs: DataFrame, text: str, shingle: int, threshold: float, rows: int, folder: str) -> DataFrame:
    """``id``, ``doc_id``, ``n`` and ``component``, the smallest ``id`` that links lead to, of each numbered row."""
    bands = bands_for(threshold, rows)
    sketched = cut(sketches(docs, text, shingle, rows, bands), f"{folder}/sketches")
    same = ["f1", "f2", "n"]
    picked = sketched.where("n > 0").groupBy(*same).agg(
        F.min("id").alias("id"), F.min_by(F.struct("registers", "keys"), "id").alias("s")
    )
    nodes = cut(picked.select("id", *same, "s.registers", "s.keys"), f"{folder}/classes")
    buckets = nodes.select("id", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(buckets.join(shared, "key").select("key", "id", "size"), f"{folder}/members")
    sets = cut(_sets(docs, text, shingle, members.select("id").distinct()), f"{folder}/sets")
    # All members of a bucket are compared with the one that shares most buckets
    # with others: of edited copies that is the text they were made from.
    shares = members.groupBy("id").agg(F.sum("size").alias("shares"))
    centres = members.join(shares, "id").groupBy("key").agg(F.max_by("id", F.struct("shares", -F.col("id"))).alias("centre"))
    stars = members.join(centres, "key").where("id <> centre").select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")
    ).distinct()
    likely = cut(_likely(stars, nodes, threshold), f"{folder}/likely")
    links = cut(_confirmed(likely, sets, threshold), f"{folder}/links")
    first = components(links, f"{folder}/first")
    labelled = members.where("size > 2").select("key", "id").join(first, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component")
    )
    more = _between(cut(labelled, f"{folder}/labelled"), nodes, sets, threshold)
    linked_ = components(links.unionByName(more), f"{folder}/all")
    found = nodes.select(*same, "id").join(linked_, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    placed = sketched.select("id", "doc_id", *same).join(found, same, "left")
    result = cut(placed.select("id", "doc_id", "n", F.coalesce("component", "id").alias("component")), f"{folder}/placed")
    empty(docs.sparkSession, *[f"{folder}/{name}" for name in ("sketches", "classes", "members", "sets", "likely", "labelled")])
    return result


def near_duplicates(
    docs: DataFrame, text: str = "text", shingle: int = 3, threshold: float = 0.85, rows: int = 4
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row.

    Words are set apart by blanks, A-Z lower-cased; a set holds the distinct
    runs of ``shingle`` words, or the whole sequence of fewer. Two texts are
    linked if the similarity of their sets reaches ``threshold`` (in whole
    percents); ``component_id`` is the smallest id that links lead to, and the
    one document kept has it as its own. Texts that are null or have no words
    have an empty set, are linked with nothing and are kept. Every row is a
    document of its own, so that two texts may share an id and be linked with
    different ones; a row without id is linked as others are, and its component
    is null, and it is kept, if there is none with an id in it. No documents, no rows.

    A pair at the threshold goes unseen with a chance of 1e-6, a more similar
    one with less. All tables between the steps are in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "neardup")
    numbered = _numbered(docs.select("doc_id", text), folder)
    placed = _components(numbered, text, shingle, threshold, rows, folder)
    # A component of many rows is one row for each task. A table, so that a join with it can be split.
    smallest = cut(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), f"{folder}/smallest")
    result = placed.join(smallest, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    empty(spark, f"{folder}/numbered")
    return result


def without_near_duplicates(
    docs: DataFrame, text: str = "text", shingle: int = 3, threshold: float = 0.85, rows: int = 4
) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all its columns: the one with the smallest id, a
    null id being the largest; of rows with one id, any one. Repeated rows stay once, texts without words all."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "neardup")
    numbered = _numbered(docs, folder)
    placed = _components(numbered, text, shingle, threshold, rows, folder)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    best = cut(placed.groupBy("component").agg(F.min_by("id", order).alias("best")), f"{folder}/best")
    dropped = placed.join(best, "component").where("id <> best").select("id")
    # The same plan for few and many.
    return unpacked(numbered.join(dropped.hint("merge"), "id", "left_anti"))
