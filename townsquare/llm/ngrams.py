"""Language model scoring by deleted interpolation of n-grams.

A token's probability mixes the maximum-likelihood estimates of all orders and
an equal share for each type. How much weight an order has depends on how often
the context was seen: contexts are put into buckets by frequency, and each
bucket has its own weights. A part of the training documents is deleted from
the counts, and expectation-maximisation finds the weights under which the rest
predicts it best.

Counts are exact and belong to the whole corpus, so they are never in one
place. Documents are dealt into chunks by id and text. A chunk's distinct n-grams
are 64-bit hashes, and ranges of hashes are added up by range; each chunk gets
the totals of its own n-grams back, in order. A frequent n-gram is one entry
per chunk, so no key is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import (
    Numbers, cut, distinct, distinct_counts, distinct_places, fold, pieces, ragged, scratch, small_batches, sums, utf8, words_of,
)

ADD = 0.1  # added to each count by the base score
DELETED = 8  # each eighth chunk is deleted to learn the weights
STEPS = 4  # per octave, in which ratios of estimates are told apart to learn the weights
ITERATIONS = 40
END, START = (np.uint64(xxhash.xxh64_intdigest(name)) for name in (b" end", b" start"))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

GRAMS = "part int, chunk int, sizes array<int>, keys binary, counts binary"
TOTALS = "chunk int, part int, totals binary, mains binary, tokens bigint, types bigint, deleted bigint, documents array<bigint>"


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its beginning and its last word."""
    x = (context * MULTIPLIER + word) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= MULTIPLIER
    return x ^ (x >> np.uint64(32))


class Chunk:
    """The n-grams of a chunk's tokens: ``grams[k]`` holds the hashes of order k + 1, token by token."""

    def __init__(self, texts: pd.Series, order: int) -> None:
        numbers, ids, sizes = Numbers(), [], []
        end = numbers[b" end"]
        for part in pieces(pd.DataFrame({"text": texts})):
            found, counts = ragged([[*map(numbers.__getitem__, words_of(bytes(t))), end] for t in part["text"]])
            ids.append(found)
            sizes.append(counts)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers.take()], np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        words = hashes[np.concatenate(ids)] if ids else np.zeros(0, np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.grams = [words]
        for _ in range(1, order):
            self.grams.append(joined(self.shifted(self.grams[-1], START), words))

    def shifted(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before; ``start`` for the first one of a document."""
        out = np.roll(values, 1)
        out[self.first] = start
        return out


def _counted(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often each occurs where ``train`` holds."""
    seen, counts = distinct_counts(hashes[train])
    other = distinct(hashes[~train])
    if len(seen):
        other = other[seen[np.minimum(np.searchsorted(seen, other), len(seen) - 1)] != other]
    place = np.searchsorted(seen, other)
    return np.insert(seen, place, other), np.insert(counts, place, 0)


def _bounds(parts: int) -> np.ndarray:
    """Where the ranges of hashes begin, but for the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _count(order: int, parts: int):
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(frame["text"], order)
        train = np.repeat(~frame["held_out"].to_numpy(bool), chunk.sizes)
        found = [_counted(hashes, train) for hashes in chunk.grams]
        edges = [[0, *np.searchsorted(seen, _bounds(parts)).tolist(), len(seen)] for seen, _ in found]
        rows = []
        for part in range(parts):
            cuts = [slice(e[part], e[part + 1]) for e in edges]
            steps = [np.diff(seen[c], prepend=np.uint64(0)) for (seen, _), c in zip(found, cuts, strict=True)]
            counts = np.concatenate([n[c] for (_, n), c in zip(found, cuts, strict=True)])
            rows.append((part, frame["chunk"].iloc[0], [len(s) for s in steps], pack(np.concatenate(steps)), pack(counts)))
        return pd.DataFrame(rows, columns=["part", "chunk", "sizes", "keys", "counts"])

    return count


def _add(order: int):
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        """The totals of one range of hashes, dealt back to the chunks in the order of their own hashes."""
        chunks, sizes = frame["chunk"].to_numpy(), np.array(frame["sizes"].tolist())
        keys, counts = [unpack(k) for k in frame["keys"]], [unpack(c).astype(np.int64) for c in frame["counts"]]
        ends = np.cumsum(sizes, axis=1)
        deleted = chunks % DELETED == 0
        totals: list[list[np.ndarray]] = [[] for _ in chunks]
        mains: list[list[np.ndarray]] = [[] for _ in chunks]
        head: dict[str, int] = {}
        documents = [0, 0]
        for k in range(order):
            cuts = [slice(e[k] - s[k], e[k]) for e, s in zip(ends, sizes, strict=True)]
            hashes = np.concatenate([np.cumsum(key[c], dtype=np.uint64) for key, c in zip(keys, cuts, strict=True)])
            seen, place = distinct_places(hashes)
            own = np.concatenate([n[c] for n, c in zip(counts, cuts, strict=True)])
            left_out = np.repeat(deleted, sizes[:, k])
            total = np.bincount(place, own, len(seen)).astype(np.int64)
            gone = np.bincount(place[left_out], own[left_out], len(seen)).astype(np.int64)
            if k == 0:
                head = {"tokens": int(total.sum()), "types": int((total > 0).sum()), "deleted": int(gone.sum())}
                at = np.searchsorted(seen, END)
                if at < len(seen) and seen[at] == END:
                    documents = [int(total[at]), int(gone[at])]
            at = 0
            for i, size in enumerate(sizes[:, k].tolist()):
                mine = place[at : at + size]
                totals[i].append(total[mine])
                if deleted[i]:
                    mains[i].append(total[mine] - gone[mine])
                at += size
        part = int(frame["part"].iloc[0])
        rows = [
            (int(c), part, pack(_laid(t, sizes[i])), pack(_laid(m, sizes[i])) if m else None, None, None, None, None)
            for i, (c, t, m) in enumerate(zip(chunks, totals, mains, strict=True))
        ]
        rows.append((-1, part, None, None, head["tokens"], head["types"], head["deleted"], documents))
        return pd.DataFrame(
            rows, columns=["chunk", "part", "totals", "mains", "tokens", "types", "deleted", "documents"]
        ).astype({"tokens": "Int64", "types": "Int64", "deleted": "Int64"})

    return add


def _laid(counts: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """How many entries each order has, then the counts of all of them."""
    return np.concatenate([sizes.astype(np.uint64), *[c.astype(np.uint64) for c in counts]])


def _looked_up(chunk: Chunk, rows: pd.Series) -> list[np.ndarray]:
    """The count of each token's n-gram, by order, from the totals of a chunk's ranges in rising order."""
    order = len(chunk.grams)
    laid = [unpack(row) for row in rows]
    out = []
    for k, hashes in enumerate(chunk.grams):
        seen, place = distinct_places(hashes)
        counts = []
        for row in laid:
            begin = order + int(row[:k].sum())
            counts.append(row[begin : begin + int(row[k])])
        values = np.concatenate(counts).astype(np.int64)
        if len(values) != len(seen):
            raise RuntimeError("a chunk and its totals differ; the documents changed while they were read")
        out.append(values[place])
    return out


def estimates(chunk: Chunk, counts: list[np.ndarray], tokens: int, types: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Per token the estimates from the uniform one to the highest order, and the bucket of its contexts.

    The context of an n-gram is the shorter n-gram that ends one token before;
    it was continued as often as it was counted. At the start of a document it
    was continued once per document. A context that was never seen estimates 0.
    """
    columns = [np.full(len(counts[0]), 1 / (types + 1)), counts[0] / max(tokens, 1)]
    bucket = np.zeros(len(counts[0]), np.int64)
    for k in range(1, len(counts)):
        context = chunk.shifted(counts[k - 1], documents)
        columns.append(counts[k] / np.maximum(context, 1))
        bucket = bucket * 64 + np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return np.stack(columns, axis=1), bucket


def _events(order: int, tokens: int, types: int, documents: int):
    def events(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        """How often each bucket and rounded ratio of the estimates to the uniform one occurs in deleted documents."""
        if not len(docs):
            return pd.DataFrame({"bucket": [], "ratios": [], "n": []}, dtype=object)
        chunk = Chunk(docs["text"], order)
        values, bucket = estimates(chunk, _looked_up(chunk, totals.sort_values("part")["mains"]), tokens, types, documents)
        learn = np.repeat(~docs["held_out"].to_numpy(bool), chunk.sizes)
        values, bucket = values[learn], bucket[learn]
        with np.errstate(divide="ignore"):
            ratios = np.log2(values[:, 1:] / values[:, :1]) * STEPS
        ratios = np.where(np.isfinite(ratios), np.rint(np.clip(ratios, -400, 400)), -1000).astype(np.int64)
        cells, n = np.unique(np.column_stack([bucket, ratios]), axis=0, return_counts=True)
        # Objects, since a chunk may hold nothing to learn from.
        return pd.DataFrame({"bucket": cells[:, 0], "ratios": pd.Series(list(cells[:, 1:]), dtype=object), "n": n})

    return events


def learn_weights(cells: list[tuple[int, list[int], int]], order: int) -> dict[int, np.ndarray]:
    """Weights of the estimates by bucket, by expectation-maximisation on counted events."""
    by_bucket: dict[int, list] = {}
    for bucket, ratios, n in cells:
        by_bucket.setdefault(bucket, []).append((ratios, n))
    weights = {}
    for bucket, rows in by_bucket.items():
        ratios = np.array([r for r, _ in rows], float)
        n = np.array([c for _, c in rows], float)
        # Relative to the uniform estimate, which no ratio reaches in weight by itself.
        value = np.column_stack([np.ones(len(n)), np.where(ratios > -1000, 2.0 ** (ratios / STEPS), 0)])
        share = np.full(order + 1, 1 / (order + 1))
        for _ in range(ITERATIONS):
            each = value * share
            share = (each / each.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
        # No bucket may rule out a new type, however few events it has.
        share = np.maximum(share, 1e-4)
        weights[bucket] = share / share.sum()
    return weights


def _weights_of(bucket: np.ndarray, weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """Each token's weights; a bucket without events takes the average ones."""
    average = np.mean(list(weights.values()), axis=0) if weights else np.full(order + 1, 1 / (order + 1))
    seen, place = np.unique(bucket, return_inverse=True)
    return np.array([weights.get(int(b), average) for b in seen]).reshape(-1, order + 1)[place]


def _score(order: int, tokens: int, types: int, documents: int, weights: dict[int, np.ndarray]):
    def score(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        chunk = Chunk(docs["text"], order)
        counts = _looked_up(chunk, totals.sort_values("part")["totals"])
        base = np.log10((counts[0] + ADD) / (tokens + ADD * (types + 1)))
        values, bucket = estimates(chunk, counts, tokens, types, documents)
        share = _weights_of(bucket, weights, order)
        # Contexts that were never seen have no estimate; their weight goes to the others.
        for k in range(1, order):
            share[:, k + 1] *= chunk.shifted(counts[k - 1], documents) > 0
        share[:, 1] *= tokens > 0
        share /= share.sum(axis=1, keepdims=True)
        model = np.log10((values * share).sum(axis=1))
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].to_numpy(),
                "held_out": docs["held_out"].to_numpy(bool),
                "n_tokens": chunk.sizes,
                "n_known": sums((counts[0] > 0).astype(float), chunk.sizes).astype(np.int64),
                "base_score": sums(base, chunk.sizes),
                "score": sums(model, chunk.sizes),
            }
        )

    return score


def ngram_scores(docs: DataFrame, text: str = "text", order: int = 2, chunk_bytes: int = 12_000_000) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row.

    Tokens are words (set apart by blanks, A-Z lower-cased) and one end per
    document; a null text is an empty one and has the end alone. The model
    learns from rows whose fold of 10 is not 0. ``base_score`` sums the log10 of
    the unigram estimate with 0.1 added to each count, ``score`` that of the
    interpolated estimate of order ``order``. Rows are independent, so repeated
    ones are counted and scored as often as they occur; rows that share an id,
    or have none, are dealt out by their texts. Without training rows all types
    are alike. No rows, no result. Columns beside these two are not read.

    A chunk holds about ``chunk_bytes`` of text, and so many chunks there are,
    so many ranges of hashes; for much more than some TB, larger chunks keep
    the blocks between them from getting small.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch(spark, "ngrams")
    held_out = fold("doc_id", 10) == 0
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body).cast("bigint"))).first()[0] or 0
    chunks = max(2 * DELETED, -(-size // chunk_bytes))
    rows = docs.select(
        "doc_id", held_out.alias("held_out"), utf8(text).alias("text"),
        F.pmod(F.xxhash64("doc_id", body), F.lit(chunks)).cast("int").alias("chunk"),
    )
    grams = rows.groupBy("chunk").applyInPandas(_count(order, chunks), GRAMS)
    totals = cut(grams.groupBy("part").applyInPandas(_add(order), TOTALS), f"{folder}/totals")
    head = totals.where("chunk = -1").agg(
        F.sum("tokens"), F.sum("types"), F.sum("deleted"), F.sum(F.get("documents", F.lit(0))), F.sum(F.get("documents", F.lit(1)))
    ).first()
    tokens, types, deleted, documents, gone = (value or 0 for value in head)
    own = totals.where("chunk >= 0").select("chunk", "part", "totals", "mains")

    some = rows.where(F.col("chunk") % DELETED == 0).groupBy("chunk")
    events = some.cogroup(own.where("mains is not null").select("chunk", "part", "mains").groupBy("chunk")).applyInPandas(
        _events(order, tokens - deleted, types, documents - gone), "bucket bigint, ratios array<bigint>, n bigint"
    )
    cells = events.groupBy("bucket", "ratios").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights([(r["bucket"], r["ratios"], r["n"]) for r in cells], order)

    scored = rows.groupBy("chunk").cogroup(own.select("chunk", "part", "totals").groupBy("chunk")).applyInPandas(
        _score(order, tokens, types, documents, weights),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double",
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
