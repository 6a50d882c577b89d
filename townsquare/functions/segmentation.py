"""Words of scripts that are written without blanks between words.

A run of such letters is one token to begin with. Without a word list it is
split by the rules for word boundaries of Unicode alone: a Han or Hiragana
letter is a word, a run of Katakana, Thai, Lao, Khmer or Burmese one. With a word
list it is split into the most likely words, by dynamic programming over the
places of the run.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions.links import let
from townsquare.session import kept

# The ranges of the scripts without blanks. Ranges, since a test of
# a letter's script is many times slower than all of these.
_HAN = r"\u2E80-\u2FDF\u3005\u3007\u3021-\u3029\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
_HIRAGANA = r"\u3041-\u3096\u3099-\u309F"
_KATAKANA = r"\u3099\u309A\u30A1-\u30FA\u30FC-\u30FF\u31F0-\u31FF\uFF66-\uFF9F"
_THAI, _LAO, _KHMER = r"\u0E01-\u0E3A\u0E40-\u0E4E", r"\u0E81-\u0EBD\u0EC0-\u0ECE\u0EDC-\u0EDF", r"\u1780-\u17D3\u17D7\u17DC-\u17DD"
_MYANMAR = r"\u1000-\u103F\u1050-\u108F\u109A-\u109F\uA9E0-\uA9EF\uA9FA-\uA9FE\uAA60-\uAA7F"
_SOUTH_EAST = [_THAI, _LAO, _KHMER, _MYANMAR]
UNSPACED = _HAN + _HIRAGANA + _KATAKANA + "".join(_SOUTH_EAST)
RUN = f"[{UNSPACED}]+"
# Letters, marks and digits of other scripts; those before Thai are told first.
_ANY = r"\p{L}\p{M}\p{N}_"
SPACED = rf"[[{_ANY}&&[\x00-\u0DFF]][{_ANY}&&[\u0E00-\x{{10FFFF}}&&[^{UNSPACED}]]]]"
# All of these letters, and few others, stand from here on.
_PERHAPS = r"[\u0E00-\x{3FFFF}]"
# What stays together without a word list, and what unknown letters form with one.
_WHOLE = [f"[{_KATAKANA}]+", *[f"[{script}]+" for script in _SOUTH_EAST]]
UNIT = "|".join([*_WHOLE, r".\p{M}*"])
_UNKNOWN = regex.compile(UNIT.replace(r"\x{20000}-\x{3FFFF}", r"\U00020000-\U0003FFFF"), regex.DOTALL)

WORDS_AT_MOST = 200_000  # of a word list that every task holds; a longer one stays a table
LETTERS_AT_ONCE = 1_000  # of a run, the beginnings of whose words are looked up together
SURPRISE = 10_000  # what an unknown letter costs more than the rarest word


class Lexicon(NamedTuple):
    """Words and what they cost, in thousandths of the negative logarithm of their share."""

    costs: dict[str, int]
    longest: int
    unknown: int


class LongLexicon(NamedTuple):
    """The same of a list that is too long for the memory of a task: (word, cost) in a table."""

    words: DataFrame
    longest: int
    unknown: int


def lexicon(words: DataFrame, word: str = "word", n: str = "n") -> Lexicon | LongLexicon:
    """A word list with counts, of any length. Null and empty words do not count,
    and the counts of one that is listed twice add up."""
    listed = words.where((F.length(word) > 0) & (F.col(n) > 0)).groupBy(F.col(word).alias("word")).agg(F.sum(n).alias("n")).persist()
    try:
        rows = listed.limit(WORDS_AT_MOST + 1).collect()
        if len(rows) > WORDS_AT_MOST:
            return _long(listed)
    finally:
        listed.unpersist()
    total = sum(r["n"] for r in rows)
    costs = {r["word"]: _cost(total, r["n"]) for r in rows}
    return Lexicon(costs, max(map(len, costs), default=0), _unknown(total))


def _cost(total: float, n: float) -> int:
    return math.floor(1000 * math.log(total / n))


def _unknown(total: float) -> int:
    return math.floor(1000 * math.log(max(total, 1))) + SURPRISE


def _long(listed: DataFrame) -> LongLexicon:
    total, longest = listed.agg(F.sum("n"), F.max(F.length("word"))).first()

    @F.pandas_udf("bigint")
    def cost(n: pd.Series) -> pd.Series:
        return n.map(lambda one: _cost(total, one))

    return LongLexicon(kept(listed.select("word", cost("n").alias("cost"))), longest, _unknown(total))


def segment(run: str, known: Lexicon) -> list[str]:
    """The words of a run with the least cost in all; of equal ones the fewest, then the longest at the end.

    Letters in no word are joined where their script joins them.
    """
    cost, count, start = [0], [0], [0]
    for stop in range(1, len(run) + 1):
        best = (cost[stop - 1] + known.unknown, count[stop - 1] + 1, stop - 1)
        for begin in range(max(0, stop - known.longest), stop):
            price = known.costs.get(run[begin:stop])
            if price is not None:
                best = min(best, (cost[begin] + price, count[begin] + 1, begin))
        for values, value in zip((cost, count, start), best, strict=True):
            values.append(value)
    cuts = [len(run)]
    while cuts[-1]:
        cuts.append(start[cuts[-1]])
    cuts.reverse()
    out, strange = [], ""
    for begin, stop in zip(cuts, cuts[1:], strict=False):
        piece = run[begin:stop]
        if piece not in known.costs:
            strange += piece
            continue
        out += _UNKNOWN.findall(strange)
        out.append(piece)
        strange = ""
    return out + _UNKNOWN.findall(strange)


def is_run(token: Column) -> Column:
    return token.rlike(f"^[{UNSPACED}]")


def split_runs(tokens: Column, text: Column) -> Column:
    """``tokens`` of ``text`` with the runs among them split by the rules of Unicode."""
    units = F.flatten(
        F.transform(tokens, lambda t: F.when(is_run(t), F.regexp_extract_all(t, F.lit(UNIT), F.lit(0))).otherwise(F.array(t)))
    )
    return F.when(text.rlike(_PERHAPS), units).otherwise(tokens)


def with_words(rows: DataFrame, tokens: str, known: Lexicon | LongLexicon) -> DataFrame:
    """``rows`` with the runs in a column of tokens split by a word list.

    The distinct runs of a row, and nothing else of it, are handed to Python.
    """
    if isinstance(known, LongLexicon):
        return _with_long_list(rows, tokens, known)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("array<array<string>>")
    def split(runs: pd.Series) -> pd.Series:
        return runs.map(lambda some: None if some is None else [segment(run, shared.value) for run in some])

    # Called so, it is not run once more for a filter that Spark infers.
    split = split.asNondeterministic()
    found = rows.withColumn("_runs", F.array_distinct(F.filter(tokens, is_run)))
    found = found.withColumn("_words", split("_runs"))
    words = F.map_from_arrays("_runs", "_words")
    return found.withColumn(tokens, _replaced(tokens, words)).drop("_runs", "_words")


def _replaced(tokens: str, words: Column) -> Column:
    return let(words, lambda m: F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), F.array(t)))))


def _with_long_list(rows: DataFrame, tokens: str, known: LongLexicon) -> DataFrame:
    """Each unlike run meets the words that are parts of it, and is split by these alone; no other can be in it.

    Rows and runs are written once with a number of their own.
    """
    runs_of = F.array_distinct(F.filter(tokens, is_run))
    numbered = kept(rows.withColumn("_runs", runs_of).withColumn("_row", F.monotonically_increasing_id()))
    of_rows = numbered.select("_row", F.explode("_runs").alias("run"))
    runs = kept(of_rows.select("run").distinct().withColumn("_run", F.monotonically_increasing_id()))

    begins = F.explode(F.sequence(F.lit(1), F.length("run"), F.lit(LETTERS_AT_ONCE))).alias("begin")
    piece = F.substr("run", F.col("begin"), F.lit(LETTERS_AT_ONCE + known.longest - 1))
    pieces = runs.select("_run", "run", begins).select("_run", piece.alias("piece"))
    at = F.explode(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(LETTERS_AT_ONCE)))).alias("at")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(known.longest), F.length("piece") - F.col("at") + 1))).alias("size")
    parts = pieces.select("_run", "piece", at).select("_run", "piece", "at", size)
    parts = parts.select("_run", F.substr("piece", F.col("at"), F.col("size")).alias("word")).distinct()
    found = parts.join(known.words, "word").groupBy("_run").agg(F.collect_list(F.struct("word", "cost")).alias("_known"))

    @F.pandas_udf("array<string>")
    def split(some: pd.Series, costs: pd.Series) -> pd.Series:
        def one(run: str, listed: list | None) -> list[str]:
            priced = {w["word"]: w["cost"] for w in listed} if listed is not None else {}
            return segment(run, Lexicon(priced, longest, unknown))

        return pd.Series([one(*pair) for pair in zip(some, costs, strict=True)], dtype=object)

    longest, unknown = known.longest, known.unknown
    split = split.asNondeterministic()
    of_runs = runs.join(found, "_run", "left").select("run", split("run", "_known").alias("words"))
    of_row = of_rows.join(of_runs, "run").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("run", "words"))).alias("_words"))
    both = numbered.join(of_row, "_row", "left")
    return both.withColumn(tokens, _replaced(tokens, F.col("_words"))).drop("_runs", "_words", "_row")
