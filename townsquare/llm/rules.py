"""Quality rules, lines first: remove bad lines, then reject documents that lost too much.

Only DataFrame functions, and all inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.functions.links import let
from townsquare.llm.common import BLANK, WORD

WINDOW = 8  # words of a window that counts as repeated
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST = 0.4  # share of the characters that line rules may remove
LONG_LINE = 8  # words from which a line without an end mark may still be prose

# The patterns mean the same to Java and to RE2, so that SQL can check them.
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[.!?…:;,。！？，；：]"
END = r"[.!?…:;。！？；：]['\"”’»)\]]*[\x20\x09-\x0D]*\z"
#: Words set apart by signs that stand between links.
SEPARATORS = r"(?:^|[\x20\x09-\x0D])[|»«›‹·•→←>]+(?:[\x20\x09-\x0D]|\z)"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(?:home|menu|search|share|print|next|previous|prev|back|top|more|read more|"
    r"continue reading|back to top|skip to (?:main )?content|log ?in|log ?out|sign (?:in|up|out)|register|subscribe|"
    r"contact(?: us)?|about(?: us)?|site ?map|page [0-9]+(?: of [0-9]+)?|[0-9]+ comments?|leave a (?:comment|reply)|"
    r"add to cart)[^0-9A-Za-z_]*\z"
)
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie policy|"
    r"(?:we|this (?:web)?site) uses? cookies|enable javascript|javascript is (?:disabled|required)|click here|"
    r"lorem ipsum|subscribe to our|sign up for our|follow us on|share this (?:article|page|post)|"
    r"copyright (?:\(c\)|©)|powered by [a-z]+|your browser (?:does not|is))"
)
#: A word that ends in signs no prose puts there: doubled marks or symbols.
ODD_WORD = r"(?:[!?]{2,}|[#*$%&|<>]{2,})(?:[\x20\x09-\x0D]|\z)"
MAX_ODD_WORDS = 0.3  # share of a line's words


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words found twice or more, the first included."""
    n = F.size(tokens)

    def covered(hashes: Column) -> Column:
        """Of windows by hash: those equal to a neighbour in sorted order, then the union of their words."""
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            def twice(row: Column, k: Column) -> Column:
                before, after = F.get(rows, k - 1)["h"], F.get(rows, k + 1)["h"]
                return F.coalesce(row["h"] == before, F.lit(False)) | F.coalesce(row["h"] == after, F.lit(False))

            return F.array_sort(F.transform(F.filter(rows, twice), lambda row: row["i"]))

        def union(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

        return let(starts_of(placed, starts), union)

    def starts_of(placed: Column, starts) -> Column:
        return let(placed, starts)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            covered(hashes)
        )

    windows = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    return F.when(n < window, F.lit(0).cast("bigint")).otherwise(let(windows, counted))


def bad_line(line: Column) -> Column:
    """Whether a line with words fails a rule.

    Punctuation: no mark at its end, and either short or without any mark at
    all; or too many words that end in doubled marks or symbols. Navigation:
    two separators or more, or a known label alone. Boilerplate: a known phrase.
    """
    n = F.regexp_count(line, F.lit(WORD))
    unended = ~line.rlike(END) & ((n < LONG_LINE) | ~line.rlike(MARKS))
    odd = F.regexp_count(line, F.lit(ODD_WORD)) > n * MAX_ODD_WORDS
    return (
        unended | odd | (F.regexp_count(line, F.lit(SEPARATORS)) >= 2)
        | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)
    )


def line_cleaning(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and verdicts of the rules, and the cleaned text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line),
    ``n_repeat_words`` (see :func:`repeated_words`), ``base_failed`` (fewer than
    20 words, or over 30 % of them repeated), ``lost`` (share of the characters
    of lines that the line rules remove), ``kept`` (not failed, and ``lost`` at
    most 0.4), ``clean_text`` (the lines that stay).

    Null and empty texts have no words, so they fail with zero counts and lose
    nothing. Texts of any length are read whole. Equal rows get equal verdicts;
    no rows, no result. Columns of ``docs`` with the names of added ones are
    replaced.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def measured(body: Column) -> Column:
        return let(F.split(body, "\n"), lambda lines: let(words(body), lambda tokens: of(body, lines, tokens)))

    def of(body: Column, lines: Column, tokens: Column) -> Column:
        full = F.filter(lines, lambda line: line.rlike(WORD))
        n_full = let(full, lambda rows: F.size(rows) - F.size(F.array_distinct(rows)))
        return F.struct(
            F.size(tokens).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(tokens, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            n_full.cast("bigint").alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            F.array_join(F.filter(lines, lambda line: ~(line.rlike(WORD) & bad_line(line))), "\n")
            .alias("clean_text"),
        )

    names = list(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    counted = docs.select(row, let(body, measured).alias("m"), F.char_length(body).alias("chars"))
    m = {k: F.col(f"m.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text")}
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    lost = F.when(F.col("chars") > 0, 1 - F.char_length(m["clean_text"]) / F.col("chars")).otherwise(F.lit(0.0))
    added = m | {"base_failed": failed, "lost": lost, "kept": ~failed & (lost <= MAX_LOST)}
    taken = set(added)
    kept = [F.col(f"row.`{c}`") for c in names if c.lower() not in taken]
    return counted.select(*kept, *[column.alias(name) for name, column in added.items()])


def rules_digest(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document, of whole texts."""
    return line_cleaning(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
