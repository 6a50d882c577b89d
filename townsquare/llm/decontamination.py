"""Benchmark decontamination: BM25 with block-max WAND over an inverted index of the test items.

The index holds the items, not the corpus: a benchmark is small, and every
passage of the corpus is a query against it. An item has two entries, the whole
item and its question alone. An entry's score is divided by the score it would
give itself, and its threshold is a bound: no passage with the runs of five words
that make a leak can score less. What passes is verified: how much of the item's
question, of its answer and of both as one text, in such runs, the passage has.

Passages overlap by half and are twice as long as the longest item of the index,
so every item-long run of words lies inside one whole passage. Long items have
indexes of their own, by length, so that they don't make all passages long.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import packed, pieces, ragged, small_batches, unpacked

K1, B = 1.2, 0.75
MIN_SHARE = 0.5  # of an item's own score; a leak that its runs prove may have less
GRAM = 5  # words of a verified run
SURE, LIKELY = 0.8, 0.5  # overlaps, see ``leaked``
BLOCK = 64  # postings under one bound
RANGES = 256  # of entries; each has its own bounds
ITEMS_AT_MOST = 10_000  # items of one index; more items are more indexes
WORDS_AT_MOST = 2_000  # words of an item of the first indexes; twice as many in each next kind
CELLS = 1 << 21  # words of the passages that are looked at together

WORDS = re.compile(r"\w+")
ANSWER = re.compile(r"(?:\banswer\s*:|\n\s*a\s*:|\?)", re.IGNORECASE)
SENTENCE = re.compile(r"[.!?。！？]\s+")


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before and after its last question mark or answer label.

    Without one, the last sentence is the answer; a single sentence is cut after
    three quarters of its words.
    """
    for cuts in (list(ANSWER.finditer(text)), list(SENTENCE.finditer(text.rstrip()))):
        if cuts:
            question, answer = words(text[: cuts[-1].end()]), words(text[cuts[-1].end() :])
            if question and answer:
                return question, answer
    every = words(text)
    at = -(-3 * len(every) // 4)
    return every[:at], every[at:]


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    """Runs of five words; of a shorter list, the list as one run."""
    n = min(GRAM, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def enough(share: float, runs: int) -> int:
    """How many of an entry's runs reach the share."""
    return math.ceil(share * runs - 1e-9)


def least(weights: dict[str, float], parts: list[tuple[set[tuple[str, ...]], int]]) -> float:
    """No passage with so many runs of each part has words of less weight in all.

    A word's weight is dealt out evenly to the runs that it is in. The runs that
    a passage has are then worth at most what their words weigh together, and
    at least as much as the cheapest ones.
    """
    shared = Counter(term for runs, _ in parts for run in runs for term in set(run))
    costs = [sorted(sum(weights[t] / shared[t] for t in set(run)) for run in runs)[:n] for runs, n in parts]
    return sum(map(sum, costs))


class Posting(NamedTuple):
    """A term's entries in rising order with its share of each one's own score, and bounds of these shares."""

    items: list[int]
    shares: list[float]
    most: float
    block_most: list[float]


class Index:
    """Inverted index of one part of the items. ``frequencies``: in how many of ``n_items`` a term occurs.

    Of n items, entry i is the whole of item i and entry n + i its question, if
    that has five words. ``needed`` is the least share of an entry's own score
    that a leak can have.
    """

    def __init__(self, items: list[tuple[str, str]], frequencies: dict[str, int], n_items: int, mean: float) -> None:
        self.ids = [item for item, _ in items]
        split = [question_and_answer(text) for _, text in items]
        self.long = [len(q) >= GRAM for q, _ in split]
        self.parts = [(grams(q), grams(a), grams(q + a)) for q, a in split]
        self.terms: dict[str, int] = {}
        found: list[list[tuple[int, float]]] = [[]]  # term 0 is every word that no item has
        self.whole: list[dict[int, float]] = []  # an item's terms with their shares
        self.needed = np.ones(2 * len(items))
        questions = []
        for number, (question, answer) in enumerate(split):
            counts = Counter(question + answer)
            norm = K1 * (1 - B + B * counts.total() / max(mean, 1.0))
            weights = {
                term: math.log(1 + (n_items - frequencies[term] + 0.5) / (frequencies[term] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for term, tf in counts.items()
            }
            own = sum(weights.values())
            self.whole.append({})
            for term, weight in weights.items():
                at = self.terms.setdefault(term, len(found))
                if at == len(found):
                    found.append([])
                found[at].append((number, weight / own))
                self.whole[-1][at] = weight / own
            q, a, both = self.parts[number]
            rules = [[(both, enough(LIKELY, len(both)))]]
            if a:
                rules.append([(q, enough(LIKELY, len(q))), (a, enough(LIKELY, len(a)))])
            self.needed[number] = min(MIN_SHARE, *(least(weights, rule) / (own or 1) for rule in rules))
            part = {term: weights[term] for term in dict.fromkeys(question)} if len(question) >= GRAM else {}
            questions.append({self.terms[term]: weight / sum(part.values()) for term, weight in part.items()})
            if part:
                self.needed[len(items) + number] = least(weights, [(q, enough(SURE, len(q)))]) / sum(part.values())
        for number, part in enumerate(questions, len(items)):
            for term, share in part.items():
                found[term].append((number, share))
        self.postings = [self._posting(rows) for rows in found]
        longest = max((len(q) + len(a) for q, a in split), default=1)
        self.step = max(longest, 16)
        # Bounds by ranges of entries: what a term can give to any entry of the range, of what that one needs.
        self.width = max(1, -(-len(self.needed) // RANGES))
        self.bounds = np.zeros((len(found), max(1, -(-len(self.needed) // self.width))), np.float32)
        for term, rows in enumerate(found):
            for entry, share in rows:
                most = share / self.needed[entry]
                self.bounds[term, entry // self.width] = max(self.bounds[term, entry // self.width], most)
        self.most = self.bounds.max(axis=1)

    @staticmethod
    def _posting(rows: list[tuple[int, float]]) -> Posting:
        shares = [share for _, share in rows]
        blocks = [max(shares[i : i + BLOCK]) for i in range(0, len(shares), BLOCK)]
        return Posting([item for item, _ in rows], shares, max(shares, default=0.0), blocks)

    def above(self, terms: list[int], low: int, high: int, threshold: float = MIN_SHARE) -> dict[int, float]:
        """All entries from ``low`` to below ``high`` whose share reaches the threshold, by block-max WAND.

        The lists are kept by their current entry. The pivot is the first list at
        which the bounds of the lists so far can reach the threshold; no entry
        before it can. At the pivot the bounds of the blocks are summed: if they
        fall short, all these lists move past the end of the nearest block.
        """
        lists = [(p, [bisect_left(p.items, low)]) for p in map(self.postings.__getitem__, terms)]
        lists = [(p, at) for p, at in lists if at[0] < len(p.items) and p.items[at[0]] < high]
        found = {}
        while lists:
            lists.sort(key=lambda entry: entry[0].items[entry[1][0]])
            total, pivot = 0.0, -1
            for i, (posting, _) in enumerate(lists):
                total += posting.most
                if total >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot][0].items[lists[pivot][1][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0].items[lists[pivot + 1][1][0]] == item:
                pivot += 1
            chosen = lists[: pivot + 1]
            for posting, at in chosen:
                at[0] = bisect_left(posting.items, item, at[0])
            here = [(p, at) for p, at in chosen if at[0] < len(p.items)]
            if sum(p.block_most[at[0] // BLOCK] for p, at in here) < threshold - 1e-9:
                ends = [p.items[min(len(p.items), (at[0] // BLOCK + 1) * BLOCK) - 1] for p, at in here]
                beyond = min([*ends, *(p.items[at[0]] - 1 for p, at in lists[pivot + 1 :])], default=item)
                beyond = max(beyond, item) + 1
            else:
                score = sum(p.shares[at[0]] for p, at in here if p.items[at[0]] == item)
                if score >= threshold - 1e-9:
                    found[item] = score
                beyond = item + 1
            for posting, at in here:
                at[0] = bisect_left(posting.items, beyond, at[0])
            lists = [(p, at) for p, at in lists if at[0] < len(p.items) and p.items[at[0]] < high]
        return found

    def verify(self, item: int, passage: set[tuple[str, ...]], tokens: list[str]) -> tuple[float, float, float]:
        """Shares of the runs of the item's question, of its answer and of the whole item that the passage has."""
        shares = []
        for part in self.parts[item]:
            n = len(next(iter(part), ()))
            have = passage if n == GRAM else {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)}
            shares.append(len(part & have) / len(part) if part else 0.0)
        return shares[0], shares[1], shares[2]

    def search(self, texts: list[list[str]]) -> list[list[tuple[str, int, float, float, float]]]:
        """Per text, its leaked items: id, first word of the best passage, score, question and answer overlap."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        term = self.terms
        ids, sizes = ragged([[term.get(w, 0) for w in text] for text in texts])
        step = self.step
        width = max(1, min(2 * step, int(sizes.max(initial=1))))
        counts = np.maximum(1, -(-(sizes - 2 * step) // step) + 1)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        first = np.cumsum(sizes) - sizes
        ids = np.append(ids, 0)
        rows_at_once = max(1, min(8192, CELLS // width))
        for at in range(0, len(owner), rows_at_once):
            some, begin = owner[at : at + rows_at_once], starts[at : at + rows_at_once]
            places = begin[:, None] + np.arange(width)
            inside = places < sizes[some][:, None]
            grid = np.sort(np.where(inside, ids[np.where(inside, first[some][:, None] + places, len(ids) - 1)], 0), axis=1)
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = 0  # a word counts once
            rows = np.flatnonzero(self.most[grid].sum(axis=1, dtype=np.float64) >= 1 - 1e-4)
            block_rows = max(1, min(1024, 16 * CELLS // (width * self.bounds.shape[1])))
            for block in range(0, len(rows), block_rows):
                part = rows[block : block + block_rows]
                known, ranges = self._ranges(grid[part])
                for row, span in zip(part[known], ranges, strict=True):
                    text = texts[some[row]]
                    tokens = text[begin[row] : begin[row] + width]
                    self._passage(grid[row][grid[row] > 0].tolist(), span * self.width, tokens, int(begin[row]), out[some[row]])
        return [[(self.ids[item], *hit) for item, hit in sorted(hits.items())] for hits in out]

    def _ranges(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of passages and ranges of entries whose summed bounds reach what an entry needs."""
        which, place = np.nonzero(grid)
        sizes = np.bincount(which, minlength=len(grid))
        begins = np.minimum(np.cumsum(sizes) - sizes, max(0, len(which) - 1))
        if not len(which):
            return np.zeros(0, int), np.zeros(0, int)
        total = np.add.reduceat(self.bounds[grid[which, place]], begins, axis=0, dtype=np.float64)
        return np.nonzero((total >= 1 - 1e-4) & (sizes > 0)[:, None])

    def _passage(self, terms: list[int], low: int, tokens: list[str], start: int, hits: dict[int, tuple]) -> None:
        needed = self.needed[low : low + self.width]
        found = self.above(terms, low, low + self.width, float(needed.min()))
        likely = {entry % len(self.ids) for entry, share in found.items() if share >= needed[entry - low] - 1e-9}
        if not likely:
            return
        runs = grams(tokens)
        for item in sorted(likely):
            question, answer, whole = self.verify(item, runs, tokens)
            score = sum(self.whole[item].get(t, 0.0) for t in terms)
            if leaked(question, answer, whole, self.long[item] or score >= MIN_SHARE - 1e-9):
                hit = (start, score, question, answer)
                hits[item] = max(hits.get(item, hit), hit, key=lambda h: (h[2], h[3], h[1], -h[0]))


def leaked(question: float, answer: float, whole: float = 0.0, alone: bool = True) -> bool:
    """A question is there almost whole, or half of it together with half of the answer, or half of the whole item.

    A question is often short, and one changed word takes up to five of its
    runs; the runs of the whole item outlast that. ``alone``: whether the
    question by itself says enough. One of fewer than five words may stand in
    any text, and does so only with half of the item's own score.
    """
    return alone and question >= SURE or question >= LIKELY and answer >= LIKELY or whole >= LIKELY


def indexes(items: DataFrame, text: str = "text", key: str = "item_id") -> list[Index]:
    """The items as indexes of at most 10,000 items each, with frequencies over all of them.

    Items without a word and null ones are left out; repeated items stay. An
    index is collected and goes to every task, which is why its size is bounded;
    a larger benchmark is several indexes, each a pass over the corpus. Items of
    more than 2,000 words are of the next kind, more than 4,000 of the one after,
    and so on; each kind has indexes of its own, of half as many items.
    """
    rows = items.select(F.col(key).cast("string").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike(r"(?U)\w"))
    n = rows.count()

    def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [words(t) for t in batch["text"]]
            sizes = [len(m) for m in made]
            kinds = [max(0, (-(-n // WORDS_AT_MOST) - 1).bit_length()) for n in sizes]
            yield batch.assign(n=sizes, kind=kinds, terms=[sorted(set(m)) for m in made])

    terms = rows.mapInPandas(tokenised, "item string, text string, n int, kind int, terms array<string>")
    mean = terms.agg(F.avg("n")).first()[0] or 1.0
    counted = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kinds = {r["kind"]: r["count"] for r in terms.groupBy("kind").count().collect()}
    built = []
    for kind in sorted(kinds):
        parts = -(-kinds[kind] // max(1, ITEMS_AT_MOST >> kind))
        part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        for i in range(parts):
            own = terms.where((F.col("kind") == kind) & (part == i))
            texts = sorted((r["item"] or "", r["text"]) for r in own.select("item", "text").collect())
            used = own.select(F.explode("terms").alias("term")).distinct()
            frequencies = {r["term"]: r["df"] for r in counted.join(used, "term").collect()}
            built.append(Index(texts, frequencies, n, mean))
    return built


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, start, score, question, answer), by item.

    Whole texts, in overlapping passages. ``start`` is the passage's first word,
    ``score`` the share of the whole item's own BM25 score, the others overlaps. Per
    item only the best passage is named, the first of equal ones. Null and empty
    texts, and an empty benchmark, have no leaks; equal texts have equal ones; no
    documents, no rows. Texts of any length are searched whole. A column ``leaks``
    is replaced. Item ids are text here.
    """
    kind = "array<struct<item_id:string,start:bigint,score:double,question:double,answer:double>>"
    names = ["item_id", "start", "score", "question", "answer"]
    small_batches(docs.sparkSession)
    rows = packed(docs)
    found = F.array().cast(kind)
    for number, index in enumerate(indexes(items)):
        rows = rows.withColumn(f"found{number}", _search(index, kind, names)(F.col(f"row.`{text}`").cast("string")))
        found = F.concat(found, F.col(f"found{number}"))
    return unpacked(rows, leaks=F.array_sort(found))


def _search(index: Index, kind: str, names: list[str]):
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for part in pieces(pd.DataFrame({"text": batch.fillna("")})):
                hits = index.search([words(t) for t in part["text"]]) if index.ids else [[] for _ in part["text"]]
                out += [[dict(zip(names, hit, strict=True)) for hit in row] for row in hits]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(search, kind).asNondeterministic()


def leak_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and leaked item."""
    found = find_leaks(docs.select("doc_id", "text"), items).where(F.size("leaks") > 0)
    rows = found.select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select(
        "doc_id", F.col("leak.item_id").cast(items.schema["item_id"].dataType).alias("item_id"),
        F.col("leak.start").alias("passage_start"), F.round("leak.score", 6).alias("bm25_share"),
        F.round("leak.question", 6).alias("question_overlap"), F.round("leak.answer", 6).alias("answer_overlap"),
    )
