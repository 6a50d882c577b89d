"""What the corpus operators share: words, folds, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java's and RE2's regular expressions.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's tables.

    It lies below ``spark.checkpoint.dir`` or the folder given to
    ``SparkContext.setCheckpointDir``; where neither is set, as in tests, below the
    warehouse, which a cluster has to share as well. Lazy results read these
    tables, so they stay until the folder is cleared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table and read it back, so that what follows never runs ``df`` again."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, *paths: str) -> None:
    """Replace tables written by :func:`cut` that nothing reads any more by empty ones."""
    for path in paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(n))


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that columns added beside it can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The columns of ``row`` and those of ``added``, which win over columns of the same name."""
    taken = {name.lower() for name in added}
    kept = [F.col(f"row.`{f.name}`") for f in df.schema["row"].dataType if f.name.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in added.items()])


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: bytes.split() cuts at the blanks of BLANK only."""
    return text.lower().split()


def utf8(column: str | Column) -> Column:
    """The text as UTF-8 bytes, a null one as empty."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold so many rows at most, from now on in this session: texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def pieces(batch: pd.DataFrame, column: str = "text", most: int = 1 << 21) -> Iterator[pd.DataFrame]:
    """The batch, cut so that the texts of a piece hold ``most`` bytes, or are a single longer text."""
    start = held = 0
    for i, size in enumerate(map(len, batch[column])):
        if i > start and held + size > most:
            yield batch.iloc[start:i]
            start, held = i, 0
        held += size
    if len(batch) > start:
        yield batch.iloc[start:]


class Numbers(dict):
    """Numbers words in the order in which they are first looked up; ``fresh`` collects the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order. Sorts, which is faster here than numpy's hashing."""
    ordered = np.sort(values)
    return ordered[_first(ordered)]


def _first(ordered: np.ndarray) -> np.ndarray:
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def distinct_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and how often each occurs."""
    ordered = np.sort(values)
    places = np.flatnonzero(_first(ordered))
    return ordered[places], np.diff(np.append(places, len(ordered)))


def distinct_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    first = _first(ordered)
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(first) - 1
    return ordered[first], places


def ragged(parts: list[list[int]], dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """The lists as one array, and their lengths."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), dtype, int(sizes.sum())), sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes; 0 for an empty run."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float64)
    return out
