"""Language of each word by a linear-chain conditional random field.

The words of a text form chains. A word's features are its affixes, the
character n-grams inside it and what a learned lexicon says about it; each has a
weight per language. Further weights belong to pairs of languages of neighbours.
Forward-backward gives every word its distribution over the languages given the
whole text, so a text may switch between languages; the sum over its words
decides the language of the text.

A word's features do not depend on its neighbours, so their weights are summed
once per distinct word. The recursions run over many chains at a time. A long
text is several chains; products of matrices carry the messages over the seams,
so that its words have the distributions of one long chain.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import Numbers, fold, packed, pieces, ragged, small_batches, sums, unpacked

UNDETERMINED = "und"
CHAIN = 64  # words of a chain; a longer text is several chains
HALF = 32  # words of a training window; a training chain is two of them
NUMBERED_AT_MOST = 150_000  # distinct words that a task remembers
LABELS_AT_MOST = 1000
PIECE = 48  # letters of a word; a longer run is several words

# Signs that count as letters or digits to Python but are numbers, such as a half or a Roman eight.
_NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMBERS)}]+")
PERHAPS_LETTERS = re.compile(r"[^\W\d_]+")  # with number signs, but many times faster


class Model(NamedTuple):
    """Weights of hashed features and of transitions, in the order of ``labels``; the lexicon gives a word its features."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: dict[str, int]


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, lower-cased.

    A run of more than 48 letters, in scripts without blanks a whole sentence,
    is given as pieces that overlap by two letters, each a word of the chain. A
    hyphen at an end of a piece says that the run goes on there.
    """
    words = PERHAPS_LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, words)):
        words = [p for w in words for p in ([w] if w.isalpha() else LETTERS.findall(w))]
    return [p for w in words for p in _pieces_of(w)] if any(len(w) > PIECE for w in words) else words


def _pieces_of(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    starts = range(0, len(word) - 2, PIECE - 2)
    return [f"{'-' if i else ''}{word[i : i + PIECE]}{'-' if i + PIECE < len(word) else ''}" for i in starts]


def features(word: str, buckets: int, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a lower-case word; the lexicon's own ones lie above the buckets.

    The pieces of a run have its affixes at its ends only, and each of its
    n-grams once.
    """
    begins, ends = not word.startswith("-"), not word.endswith("-")
    core = word.strip("-")
    marked = f"{'^' if begins else ''}{core}{'$' if ends else ''}"
    names = [f"p{core[:n]}" for n in (1, 2, 3) if begins] + [f"s{core[-n:]}" for n in (1, 2, 3) if ends]
    names += [marked[i : i + n] for n in (2, 3) for i in range(len(marked) - (n if ends else 3) + 1)]
    found = [crc32(name.encode("utf-8", "replace")) % buckets for name in names]
    known = lexicon.get(word)
    return found if known is None else [*found, buckets + known]


def learn_lexicon(windows: list[tuple[int, list[str]]], size: int) -> dict[str, int]:
    """Words seen in two windows or more, with a feature for their commonest label and how clearly it leads."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for label, words in windows:
        for word in set(words):
            seen[word][label] += 1
    lexicon = {}
    for word, counts in sorted(seen.items(), key=lambda item: (-item[1].total(), item[0]))[:size]:
        if counts.total() > 1:
            label, n = max(counts.items(), key=lambda item: (item[1], -item[0]))
            share = n / counts.total()
            lexicon[word] = label * 3 + (2 if share > 0.95 else 1 if share > 0.6 else 0)
    return lexicon


def _steps(emitted: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of labels at each place and of transitions, and how many chains are longer than each place."""
    here = np.exp(emitted - emitted.max(axis=2, keepdims=True))
    running = np.searchsorted(-lengths, -np.arange(emitted.shape[1]), side="left")
    return here, np.exp(moves - moves.max()), running


def forward_backward(
    emitted: np.ndarray, lengths: np.ndarray, moves: np.ndarray, before=None, after=None, with_pairs: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains and, summed over them, of transitions.

    ``emitted`` holds log weights (chain, place, label), chains by falling
    length; ``moves`` the log weights of transitions. Places beyond a chain's
    length have marginals of 0. ``before`` and ``after`` are the messages that
    reach the first and the last place of each chain from outside; none by default.
    """
    n, places, k = emitted.shape
    here, turn, running = _steps(emitted, lengths, moves)
    ahead = np.zeros((n, places, k))
    ahead[:, 0] = here[:, 0] if before is None else here[:, 0] * before
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, places):
        m = running[t]
        ahead[:m, t] = (ahead[:m, t - 1] @ turn) * here[:m, t]
        ahead[:m, t] /= ahead[:m, t].sum(axis=1, keepdims=True)
    behind = np.ones((n, k)) if after is None else after.copy()
    marginals, pairs = np.zeros((n, places, k)), np.zeros((k, k))
    for t in range(places - 1, -1, -1):
        m = running[t]
        both = ahead[:m, t] * behind[:m]
        marginals[:m, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            message = here[:m, t] * behind[:m]
            if with_pairs:
                joint = ahead[:m, t - 1, :, None] * turn * message[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = message @ turn.T
            behind[:m] = back / back.sum(axis=1, keepdims=True)
    return marginals, pairs


def passages(emitted: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Per chain the matrix that takes a message at its first place to its last one, up to a factor."""
    n, places, k = emitted.shape
    here, turn, running = _steps(emitted, lengths, moves)
    out = np.eye(k) * here[:, 0, None, :]
    for t in range(1, places):
        m = running[t]
        out[:m] = (out[:m].reshape(-1, k) @ turn).reshape(m, k, k) * here[:m, t, None, :]
        out[:m] /= out[:m].sum(axis=(1, 2), keepdims=True)
    return out


def carried(through: np.ndarray, nth: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages that reach the chains of texts from the chains around them.

    ``through`` holds the passages of all chains, text by text; ``nth`` is a
    chain's number in its text, ``counts`` how many chains that text has.
    """
    turn = np.exp(moves - moves.max())
    before, after = np.ones(through.shape[:2]), np.ones(through.shape[:2])
    for r in range(1, int(counts.max(initial=1))):
        at = np.flatnonzero(nth == r)
        message = np.einsum("ni,nij->nj", before[at - 1], through[at - 1]) @ turn
        before[at] = message / message.sum(axis=1, keepdims=True)
        at = np.flatnonzero(nth == counts - 1 - r)
        message = np.einsum("nij,nj->ni", through[at + 1], after[at + 1]) @ turn.T
        after[at] = message / message.sum(axis=1, keepdims=True)
    return before, after


def train(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    rows_per_label: int = 250,
    windows_per_row: int = 8,
    buckets: int = 1 << 15,
    lexicon_size: int = 20_000,
    epochs: int = 3,
    rate: float = 0.5,
    seed: int = 7,
) -> Model:
    """The field for the labels of ``docs``; rows without a label or a letter teach nothing.

    Learns from a sample: about ``rows_per_label`` rows of each label, drawn by
    a hash of the id, and from each up to ``windows_per_row`` windows of 32
    words, spread evenly over the whole text. The driver gets these windows and
    no more. A training chain is two windows in random order, so that some
    switch language in the middle, which is how transitions are learned.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), "doc_id", F.col(text).alias("text"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(totals)
    if len(labels) > LABELS_AT_MOST:
        raise ValueError(f"{len(labels)} languages; at most {LABELS_AT_MOST} are learned")
    if not labels:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((0, 0)), {})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, body in zip(batch["label"], batch["text"], strict=True):
                words = words_of(body)
                starts = range(0, max(1, len(words) - HALF // 2), HALF)
                step = max(1, -(-len(starts) // windows_per_row))
                rows += [(name, " ".join(words[s : s + HALF])) for s in starts[::step] if words]
            yield pd.DataFrame(rows, columns=["label", "words"])

    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    most = F.create_map(*[F.lit(x) for name in labels for x in (name, math.ceil((1 << 30) * min(1.0, rows_per_label / totals[name])))])
    # In order of the draw, so that the rows do not depend on the layout if there are too many.
    chosen = known.where(draw < most[F.col("label")]).orderBy(draw, F.xxhash64("text")).limit(2 * rows_per_label * len(labels))
    place = {name: i for i, name in enumerate(labels)}
    found = chosen.select("label", "text").mapInPandas(windows, "label string, words string").collect()
    taught = sorted((place[r["label"]], r["words"]) for r in found)
    return _descend(labels, [(y, w.split(" ")) for y, w in taught], buckets, lexicon_size, epochs, rate, seed)


def _descend(labels, taught, buckets, lexicon_size, epochs, rate, seed) -> Model:
    """Stochastic gradient ascent on the likelihood, with a step per weight that shrinks as it moves."""
    rng, k = np.random.default_rng(seed), len(labels)
    lexicon = learn_lexicon(taught, lexicon_size)
    numbers = Numbers()
    texts = [np.array([numbers[w] for w in words]) for _, words in taught]
    flat, sizes = ragged([features(w, buckets, lexicon) for w in numbers.take()])
    begins = np.cumsum(sizes) - sizes
    weights, moves = np.zeros((buckets + 3 * k, k)), np.zeros((k, k))
    moved_w, moved_m = np.full(len(weights), 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(taught))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            chains = [some[i : i + 2] for i in range(0, len(some), 2)]
            rows = [np.concatenate([texts[i] for i in chain]) for chain in chains]
            truth = [np.concatenate([np.full(len(texts[i]), taught[i][0]) for i in chain]) for chain in chains]
            ranked = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
            rows, truth = [rows[i] for i in ranked], [truth[i] for i in ranked]
            lengths = np.array([len(r) for r in rows])
            words, where = np.unique(np.concatenate(rows), return_inverse=True)
            ids = np.concatenate([flat[begins[w] : begins[w] + sizes[w]] for w in words])
            scored = sums(weights[ids], sizes[words])
            filled = np.arange(lengths.max()) < lengths[:, None]
            emitted = np.zeros((*filled.shape, k))
            emitted[filled] = scored[where]
            marginals, pairs = forward_backward(emitted, lengths, moves)
            error = -marginals[filled]
            error[np.arange(len(error)), np.concatenate(truth)] += 1
            per_word = np.zeros((len(words), k))
            np.add.at(per_word, where, error)
            slope = np.zeros_like(weights)
            np.add.at(slope, ids, np.repeat(per_word, sizes[words], axis=0))
            touched = np.unique(ids)
            slope = slope[touched] / len(rows) - 1e-5 * weights[touched]
            moved_w[touched] += (slope**2).mean(axis=1)
            weights[touched] += rate * slope / np.sqrt(moved_w[touched])[:, None] / 4
            real = np.zeros((k, k))
            for t in truth:
                np.add.at(real, (t[:-1], t[1:]), 1)
            slope = (real - pairs) / len(rows) - 1e-3 * moves
            moved_m += slope**2
            moves += rate * slope / np.sqrt(moved_m)
    return Model(labels, weights.astype(np.float32), moves, lexicon)


class Tagger:
    """The model over texts, with the distinct words of a task remembered."""

    def __init__(self, model: Model) -> None:
        self.model, self.buckets = model, len(model.weights) - 3 * len(model.labels)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.scores = Numbers(), np.zeros((0, len(self.model.labels)))

    def _learn(self) -> None:
        fresh = self.numbers.take()
        if fresh:
            ids, sizes = ragged([features(w, self.buckets, self.model.lexicon) for w in fresh])
            self.scores = np.concatenate([self.scores, sums(self.model.weights[ids], sizes)])

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Distributions over the languages of all words, one text after the other, and the texts' lengths."""
        if len(self.numbers) > NUMBERED_AT_MOST:
            self._forget()
        ids, sizes = ragged([list(map(self.numbers.__getitem__, words)) for words in texts])
        self._learn()
        counts = -(-sizes // CHAIN)
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begins = (np.cumsum(sizes) - sizes)[owner] + nth * CHAIN
        lengths = np.minimum(CHAIN, sizes[owner] - nth * CHAIN)
        k, moves = len(self.model.labels), self.model.moves
        out = np.zeros((len(ids), k))
        if not k:
            return out, sizes

        def blocks(chains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """Chains by falling length, a few thousand at a time: which, their places, which of these are full, weights."""
            order = chains[np.argsort(-lengths[chains], kind="stable")]
            for at in range(0, len(order), 4096):
                some = order[at : at + 4096]
                long = lengths[some]
                filled = np.arange(long[0]) < long[:, None]
                places = (begins[some][:, None] + np.arange(long[0]))[filled]
                emitted = np.zeros((*filled.shape, k))
                emitted[filled] = self.scores[ids[places]]
                yield some, places, filled, emitted

        of_text = counts[owner]
        parted = np.flatnonzero(of_text > 1)
        before, after = np.ones((len(owner), k)), np.ones((len(owner), k))
        if len(parted):
            through = np.zeros((len(owner), k, k))
            for some, _, _, emitted in blocks(parted):
                through[some] = passages(emitted, lengths[some], moves)
            before[parted], after[parted] = carried(through[parted], nth[parted], of_text[parted], moves)
        for some, places, filled, emitted in blocks(np.arange(len(owner))):
            found, _ = forward_backward(emitted, lengths[some], moves, before[some], after[some], with_pairs=False)
            out[places] = found[filled]
        return out, sizes

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean distribution over a text's words, and the number of its words."""
        out, sizes = self.marginals([words_of(t) for t in texts])
        return sums(out, sizes) / np.maximum(sizes, 1)[:, None], sizes


def languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, its ``score``, and ``lang_shares``, the share of each language in the words.

    Whole texts, however long. A text that is null, empty or without a letter is
    ``und`` with score 0, as is every text if nothing was learned. Among equal
    shares the language that sorts first wins. Repeated rows are rows like any
    other; no rows, no result. Columns of these names are replaced. The model's
    size is bounded by its parameters; it goes to the tasks with the function.
    """
    labels = model.labels
    small_batches(docs.sparkSession)

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for batch in batches:
            names, scores, lists = [], [], []
            for part in pieces(pd.DataFrame({"text": batch.fillna("")})):
                shares, sizes = tagger.shares(list(part["text"]))
                for row, n in zip(shares, sizes, strict=True):
                    best = int(row.argmax()) if n and labels else -1
                    names.append(labels[best] if best >= 0 else UNDETERMINED)
                    scores.append(min(1.0, float(row[best])) if best >= 0 else 0.0)
                    lists.append(row if n else np.zeros(len(labels)))
            yield pd.DataFrame({"lang": names, "score": scores, "shares": lists})

    tagged = F.pandas_udf(tag, "lang string, score double, shares array<double>").asNondeterministic()
    rows = packed(docs).withColumn("tagged", tagged(F.col(f"row.`{text}`").cast("string")))
    return unpacked(
        rows, lang_pred=F.col("tagged.lang"), score=F.col("tagged.score"), lang_shares=F.col("tagged.shares")
    )


def learned_from(docs: DataFrame) -> Column:
    """Whether a row may be learned from: its fold of 5 is not 0."""
    return fold("doc_id", 5) != 0


def language_digest(docs: DataFrame) -> DataFrame:
    """Predicted language and score per document."""
    rows = docs.select("doc_id", "text", "lang")
    model = train(rows.where(learned_from(rows)))
    tagged = languages(rows.select("doc_id", "text"), model)
    return tagged.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
