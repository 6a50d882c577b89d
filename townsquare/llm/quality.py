"""Quality classifier by supervised subword embeddings.

A document is a bag of its words and of the character n-grams of each word, all
hashed into a table of learned vectors. The average of their vectors goes
through a linear layer and a softmax. Vectors and layer are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows.

Scoring needs the product of vectors and layer only, so a word's share of the
result is computed once per distinct word and then looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import Numbers, fold, packed, pieces, ragged, small_batches, sums, unpacked, utf8

GRAMS = (3, 4)  # lengths of character n-grams, in bytes of the word between < and >
PIECE = 64  # bytes; a longer word is looked up in pieces
FRESH = 10_000  # words whose n-grams are hashed together
AGAIN = 4  # a word is repeated if it ends a run of so many words seen before in the text
NUMBERED_AT_MOST = 150_000  # distinct words that a task remembers


class Model(NamedTuple):
    """``logits``: the product of each bucket's vector and the layer; ``bias``: of the layer."""

    logits: np.ndarray
    bias: np.ndarray


def word_buckets(word: bytes, buckets: int) -> list[int]:
    """Hashes of a word and of its character n-grams.

    A piece of a long word, which begins with a blank, has the n-grams that
    begin in its first 64 bytes and no hash of its own; another pseudo-word,
    which has a blank elsewhere, has no n-grams.
    """
    if word[:1] == b" ":
        return [crc32(word[i : i + n], n) % buckets for n in GRAMS for i in range(1, min(PIECE, len(word) - n) + 1)]
    found = [crc32(word) % buckets]
    if b" " not in word:
        marked = b"<" + word + b">"
        for n in GRAMS:
            found += [crc32(marked[i : i + n], n) % buckets for i in range(len(marked) - n + 1)]
    return found


def in_pieces(word: bytes) -> list[bytes]:
    """A long word as a pseudo-word for the whole and pieces, which share out its n-grams without repeating any."""
    marked = b"<" + word + b">"
    starts = range(0, len(marked) - min(GRAMS) + 1, PIECE)
    return [b"long %d" % crc32(word), *[b" " + marked[i : i + PIECE + max(GRAMS) - 1] for i in starts]]


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, and pseudo-words on its form.

    One pseudo-word tells the order of magnitude of the text's length, given
    once per 16 words so as to keep its weight in the average. Others stand for
    each word that equals the one before, and for each that ends a run of words
    seen before. Words of more than 64 bytes, which in scripts without
    blanks are whole lines, are given in pieces.
    """
    words = text.split()
    size, sizes = b"size %d" % len(words).bit_length(), 1 + len(words) // 16
    twice = sum(map(eq, words, words[1:]))
    runs = list(zip(*[words[i:] for i in range(AGAIN)], strict=False))
    again = len(runs) - len(set(runs))
    if any(len(w) > PIECE for w in words):
        words = [p for w in words for p in (in_pieces(w) if len(w) > PIECE else [w])]
    return words + [size] * sizes + [b"twice "] * twice + [b"again "] * again


class _Bags:
    """Bags of buckets of texts, with the distinct words of a task remembered."""

    def __init__(self, buckets: int, logits: np.ndarray | None = None) -> None:
        self.buckets, self.logits = buckets, logits
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.shares, self.counts = Numbers(), np.zeros((0, 0)), np.zeros(0)
        self.lists: list[np.ndarray] = []

    def _learn(self) -> None:
        words = self.numbers.take()
        for at in range(0, len(words), FRESH):
            fresh = [word_buckets(w, self.buckets) for w in words[at : at + FRESH]]
            if self.logits is None:
                self.lists += [np.array(f, np.int32) for f in fresh]
            else:
                ids, sizes = ragged(fresh)
                shares = sums(self.logits[ids], sizes)
                self.shares = np.concatenate([self.shares, shares]) if len(self.shares) else shares
                self.counts = np.concatenate([self.counts, sizes])

    def averages(self, texts: list[bytes]) -> np.ndarray:
        """The averaged logits of each text."""
        if len(self.numbers) > NUMBERED_AT_MOST:
            self._forget()
        ids, sizes = ragged([list(map(self.numbers.__getitem__, tokens(t))) for t in texts])
        self._learn()
        return sums(self.shares[ids], sizes) / np.maximum(sums(self.counts[ids], sizes), 1)[:, None]

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of a text and how often each occurs."""
        if len(self.numbers) > NUMBERED_AT_MOST:
            self._forget()
        ids = list(map(self.numbers.__getitem__, tokens(text)))
        self._learn()
        counts = np.bincount(np.concatenate([self.lists[i] for i in ids]), minlength=self.buckets)
        found = np.flatnonzero(counts)
        return found.astype(np.int32), counts[found].astype(np.int32)


def sample(labelled: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), drawn by a hash of the id; never over twice as many."""
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    return labelled.where(draw < math.ceil((1 << 30) * min(1.0, rows / max(n, 1)))).limit(2 * rows)


def train(
    labelled: DataFrame,
    label: str = "label",
    rows: int = 1500,
    buckets: int = 1 << 15,
    dim: int = 12,
    epochs: int = 12,
    rate: float = 1.5,
    seed: int = 7,
) -> Model:
    """Vectors and layer for ``labelled``: ``doc_id``, ``text`` and a ``label`` of 0 or 1.

    Learns from whole texts of a sample of about ``rows`` rows. The driver gets
    the bags of these, at most 2 * ``rows`` * ``buckets`` pairs of four-byte
    numbers, and does the descent, one document per step with a falling rate.
    Rows without label are left out; without any row all scores are 1/2.
    """

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = _Bags(buckets)
        for batch in batches:
            for part in pieces(batch, "text"):
                made = [maker.bag(bytes(t)) for t in part["text"]]
                yield pd.DataFrame({"y": part["y"].to_numpy(), "ids": [m[0] for m in made], "n": [m[1] for m in made]})

    small_batches(labelled.sparkSession)
    chosen = sample(labelled.where(F.col(label).isin(0, 1)), rows, seed)
    rows_ = (
        chosen.select(F.col(label).cast("int").alias("y"), utf8("text").alias("text"), "doc_id")
        .mapInPandas(bags, "y int, ids array<int>, n array<int>").collect()
    )
    # In an order that does not depend on the layout of the input.
    rows_.sort(key=lambda r: (len(r["ids"]), sum(r["n"]), r["ids"][:8], r["y"]))
    examples = [(r["y"], np.array(r["ids"]), np.array(r["n"], dtype=np.float64)) for r in rows_]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, ids, counts = examples[k]
            share = counts / counts.sum()
            rows_of = vectors[ids]
            mean = share @ rows_of
            out = mean @ layer + bias
            error = np.exp(out - out.max())
            error /= error.sum()
            error[y] -= 1
            step = rate * (1 - done / steps)
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= 0.1 * step * error
            # An average over n features passes 1/n of the gradient to each; the
            # square root keeps long texts from hardly teaching anything.
            vectors[ids] = rows_of - step * (share * math.sqrt(len(ids)))[:, None] * back
            done += 1
    return Model((vectors @ layer).astype(np.float32), bias)


def scores(docs: DataFrame, model: Model, text: str | Column = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in a column ``name`` (replaced, if there is one).

    Whole texts; null ones count as empty, and an empty text has the score of a
    text without words. Equal texts get equal scores, however often they stand
    there; texts of any length are read whole. No rows, no result. The model,
    whose size is fixed by its parameters, goes to the tasks with the function.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bags = _Bags(len(model.logits), model.logits)
        for batch in batches:
            found = []
            for part in pieces(pd.DataFrame({"text": batch}), "text"):
                out = bags.averages([bytes(t) for t in part["text"]]) + model.bias
                found.append(1 / (1 + np.exp(np.clip(out[:, 0] - out[:, 1], -50, 50))))
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    small_batches(docs.sparkSession)
    scored = F.pandas_udf(score, "double").asNondeterministic()
    body = F.col(f"row.`{text}`") if isinstance(text, str) else text
    return unpacked(packed(docs).withColumn("scored", scored(utf8(body))), **{name: F.col("scored")})


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict per document; learns from rows whose fold of 4 is not 2. A document with two different
    labels teaches both, a label without a document or a value none."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label")).distinct()
    learn = docs.select("doc_id", "text").where(fold("doc_id", 4) != 2).join(known, "doc_id")
    scored = scores(docs.select("doc_id", "text"), train(learn))
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
