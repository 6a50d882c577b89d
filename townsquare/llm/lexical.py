"""Ranked lexical search over a trie of documents.

All documents are ranked for each item of a query set.

1. One pass counts the terms of every document and keeps, of each, the counts of
   terms that occur in items: its restricted vector. Document counts of terms
   and the average length come from that table.
2. Terms are ordered by frequency, the rarest first, and so are those of a
   vector. Each task builds tries of the documents it reads: vectors that begin
   alike share a path. A node knows, of the documents below it, the largest count
   of each term, the least length figure ``m`` and the least id. With the rarest
   terms at the top, what an item weighs most is soon absent below a node.
3. Depth first, the most promising branch first, each item descends only where
   the score that the maxima and the minimum allow could still enter its best
   ones. These go along from one trie of a task to the next.
4. The best of all tasks are ranked in two steps.

The score is exact in 64-bit integers, and so is its bound: it grows with a
term's count and falls with ``m``.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from townsquare.llm.common import cut, pieces, scratch, small_batches, utf8

#: A term: letters and digits of ASCII, and whatever lies beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps bytes of UTF-8: A-Z to a-z, whatever parts terms to a blank.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

PAIRS = 1 << 19  # pairs of item and term that are searched at once; more are more passes
ENTRIES = 1 << 19  # counts in a trie
LEAF = 16  # documents below a node that is not parted any more
BUCKETS = 64  # in which the best of the tasks are ranked first
NO_ID = (1 << 63) - 1


def weight(n_docs: int, df: int) -> int:
    """What a term that ``df`` of the documents hold counts for."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_figure(n: int, n_docs: int, n_terms: int) -> int:
    """``m`` of a document of ``n`` terms: 100 for one of average length."""
    return 100 - 90 + (90 * n * n_docs) // n_terms


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight; 0 for a count of 0."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _ranges(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after the other."""
    sizes = highs - lows
    return np.arange(sizes.sum()) + np.repeat(lows - (np.cumsum(sizes) - sizes), sizes)


def _child_groups(paths: list[bytes], low: int, high: int) -> list[tuple[int, int]]:
    """Parts of a sorted run of paths: by their first term that is not the same in all of them.

    Neighbouring parts share a part while they are small. Equal paths are parted by number.
    """
    first, last, at = paths[low], paths[high - 1], 0
    while at < len(last) and first[at : at + 4] == last[at : at + 4]:
        at += 4
    if at >= len(last):
        return [(i, min(i + LEAF, high)) for i in range(low, high, LEAF)]
    groups, begin, own, before = [], low, low, first[at : at + 4]
    for i in range(low + 1, high + 1):
        term = paths[i][at : at + 4] if i < high else None
        if term != before:
            if i - begin > LEAF and own > begin:
                groups.append((begin, own))
                begin = own
            own, before = i, term
    groups.append((begin, high))
    return groups


class Trie:
    """Restricted vectors of some documents. The nodes are numbered level by level, the documents after them,
    so that the children of a node have consecutive numbers."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, top: int) -> None:
        order = np.lexsort((terms, np.repeat(np.arange(len(ids)), sizes)))
        terms, tfs = terms[order], tfs[order]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        cells, counts = terms.astype(">u4").tobytes(), tfs.astype(">u4").tobytes()
        vectors = [(cells[4 * b : 4 * e], counts[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        ranked = sorted(range(len(ids)), key=lambda i: (*vectors[i], m[i], ids[i]))
        kept, before, times = [], None, 0
        for i in ranked:  # of equal vectors only the least ids can be among the best
            same = (vectors[i], m[i])
            times = times + 1 if same == before else 0
            before = same
            if times < top:
                kept.append(i)
        at = np.array(kept, np.int64)
        self.ids = ids[at]
        entries = _ranges(begins[at], ends[at])
        self._build([vectors[i][0] for i in kept], m[at], sizes[at], terms[entries], tfs[entries])

    def _build(self, paths: list[bytes], m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        of = np.repeat(np.arange(len(paths)), sizes)
        level, number = [(0, len(paths))], 0
        first, count, nodes, all_terms, most, least_m, least_id, leaves = [], [], [], [], [], [], [], []
        while level:
            place = np.full(len(paths), -1, np.int64)
            deeper = []
            for low, high in level:
                place[low:high] = number
                groups = _child_groups(paths, low, high) if high - low > LEAF else []
                if not groups:
                    leaves.append((number, low))
                first.append(len(deeper))  # within the next level, for now
                count.append(len(groups) or high - low)
                deeper += groups
                number += 1
            for i in range(number - len(level), number):
                first[i] += number
            lows = np.array([low for low, _ in level])
            inside = np.flatnonzero(place >= 0)
            runs = np.searchsorted(inside, lows)
            least_m.append(np.minimum.reduceat(m[inside], runs))
            least_id.append(np.minimum.reduceat(self.ids[inside], runs))
            cells = np.flatnonzero(place[of] >= 0)
            owner, term = place[of[cells]], terms[cells]
            order = np.lexsort((term, owner))
            owner, term, tf = owner[order], term[order], tfs[cells][order]
            if len(order):
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])))
                nodes.append(owner[new])
                all_terms.append(term[new])
                most.append(np.maximum.reduceat(tf, new))
            level = deeper
        for node, low in leaves:
            first[node] = number + low
        self.inner = number
        self.first, self.count = np.array(first), np.array(count)
        self.m = np.concatenate([*least_m, m])
        self.least_id = np.concatenate([*least_id, self.ids])
        # Counts by term, then by node: those of consecutive nodes lie side by side.
        owner, term, tf = np.concatenate([*nodes, of + number]), np.concatenate([*all_terms, terms]), np.concatenate([*most, tfs])
        self.width = number + len(paths)
        key = term.astype(np.int64) * self.width + owner
        order = np.argsort(key)
        self.key, self.tf = key[order], tf[order].astype(np.int64)

    def bounds(self, low: int, high: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a document below each of these nodes can score; of documents, what they do."""
        begins = np.searchsorted(self.key, terms * self.width + low)
        ends = np.searchsorted(self.key, terms * self.width + high)
        at = _ranges(begins, ends)
        node = self.key[at] % self.width
        parts = np.repeat(weights, ends - begins) * gain(self.tf[at], self.m[node])
        out = np.zeros(high - low, np.int64)
        np.add.at(out, node - low, parts)
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], top: int) -> None:
        """Brings ``best``, pairs (-score, id) in order, up to date with the documents of this trie."""
        stack = [(0, None, None)]
        while stack:
            node, bound, least = stack.pop()
            if bound is not None and not _enters(bound, least, best, top):
                continue
            low = int(self.first[node])
            high = low + int(self.count[node])
            scores = self.bounds(low, high, terms, weights)
            floor = -best[-1][0] if len(best) == top else 1
            near = np.flatnonzero(scores >= floor)
            near = near[np.argsort(scores[near], kind="stable")]
            if low >= self.inner:
                for i in near[::-1].tolist():
                    score, doc = int(scores[i]), int(self.least_id[low + i])
                    if _enters(score, doc, best, top):
                        insort(best, (-score, doc))
                        del best[top:]
            else:
                stack += [(low + i, int(scores[i]), int(self.least_id[low + i])) for i in near.tolist()]


def _enters(score: int, doc: int, best: list[tuple[int, int]], top: int) -> bool:
    """Whether a score, of this id at the least, would be among the best."""
    return score > 0 and (len(best) < top or (-score, doc) < best[-1])


def restricted_vectors(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (``NO_ID`` for null), number of terms ``n``, and the places in the vocabulary and counts of those
    that are in it, of all documents with a term."""
    numbers = {term.encode(): i for i, term in enumerate(vocabulary)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch):
                sizes, terms, tfs = [], [], []
                for t in part["text"]:
                    words = bytes(t).translate(FOLD).split()
                    counts = Counter(words)
                    known = counts.keys() & numbers.keys()
                    sizes.append(len(words))
                    terms.append([numbers[w] for w in known])
                    tfs.append([counts[w] for w in known])
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": sizes, "terms": terms, "tfs": tfs})

    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), utf8(text).alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>").where("n > 0")


def _best_of_tasks(
    vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], rank: np.ndarray, n_docs: int, n_terms: int, top: int
) -> DataFrame:
    """``item`` (its number), ``doc_id`` and ``score``: the best of what each task has read."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        held, size = [], 0

        def descend() -> None:
            ids, m, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            trie = Trie(ids, m, sizes, terms, tfs, top)
            for (_, q, weights), found in zip(queries, best, strict=True):
                trie.search(q, weights, found, top)

        for batch in batches:
            some = batch[batch["terms"].map(len) > 0]
            for part in (some.iloc[i : i + 256] for i in range(0, len(some), 256)):
                sizes = part["terms"].map(len).to_numpy(np.int64)
                m = np.array([length_figure(n, n_docs, n_terms) for n in part["n"].tolist()], np.int64)
                terms = rank[np.concatenate(part["terms"].to_list())]
                held.append((part["doc_id"].to_numpy(np.int64), m, sizes, terms, np.concatenate(part["tfs"].to_list()).astype(np.int64)))
                size += len(terms)
                if size >= ENTRIES:
                    descend()
                    held, size = [], 0
        if held:
            descend()
        rows = [(q[0], doc, -score) for q, found in zip(queries, best, strict=True) for score, doc in found]
        yield pd.DataFrame(rows, columns=["item", "doc_id", "score"], dtype="int64")

    return vectors.select("doc_id", "n", "terms", "tfs").mapInPandas(search, "item bigint, doc_id bigint, score bigint")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item that score above 0.

    Equal scores rank by ascending id, a null id last. Every row is a document,
    repeated ones too. Null and empty texts, and those without a term, match
    nothing and do not count. Rows of one item id, the null one included, are one
    item with the terms of all of them; an item without terms has no rows.
    No documents or no items: no rows. Texts of any length count whole; other
    columns are not read.

    The pairs of item and term are searched in blocks of about ``PAIRS``; a
    block is what a task holds of the items.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "lexical")
    lower = F.translate(F.coalesce(F.col(item_text).cast("string"), F.lit("")), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    pairs = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.explode(terms).alias("term")).distinct()
    pairs = cut(pairs, f"{folder}/pairs")
    blocks = 1 + pairs.count() // PAIRS
    found = None
    for number in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        best = _ranked(docs, block, f"{folder}/{number}", top, doc_id, text)
        found = best if found is None else found.unionByName(best)
    return found


def _ranked(docs: DataFrame, pairs: list, folder: str, top: int, doc_id: str, text: str) -> DataFrame:
    """The result for the items of these pairs."""
    spark = docs.sparkSession
    vocabulary = sorted({p["term"] for p in pairs})
    vectors = cut(restricted_vectors(docs, vocabulary, doc_id, text), f"{folder}/vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    dfs = {r["term"]: r["df"] for r in counted.collect()}  # a vocabulary at most
    order = sorted(range(len(vocabulary)), key=lambda t: (dfs.get(t, 0), vocabulary[t]))
    rank = np.empty(len(vocabulary), np.int64)
    rank[order] = np.arange(len(vocabulary))
    place = {term: i for i, term in enumerate(vocabulary)}
    of_item: dict = {}
    for pair in pairs:
        if place[pair["term"]] in dfs:
            of_item.setdefault(pair["item_id"], []).append(place[pair["term"]])
    names, queries = list(of_item), []
    for number, own in enumerate(of_item.values()):
        own = sorted(own, key=rank.__getitem__)
        queries.append((number, rank[own], np.array([weight(n_docs, dfs[t]) for t in own], np.int64)))
    best = cut(_best_of_tasks(vectors, queries, rank, n_docs, n_terms, top), f"{folder}/best")

    def first(rows: DataFrame, *key: str) -> DataFrame:
        by = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc("doc_id"))
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    # A few rows for each item and task, so at first in buckets.
    dealt = best.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    ranked = first(first(dealt, "item", "bucket").drop("rank"), "item")
    known = spark.createDataFrame(list(enumerate(names)), "item bigint, item_id bigint")
    return ranked.join(known, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"
    )
