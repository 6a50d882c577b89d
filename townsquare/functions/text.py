"""Words, entities, bigrams and plain text, as Column expressions."""

from __future__ import annotations

import string
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from townsquare.functions.links import LINK_IN_TEXT, LINK_START, let, link_at, link_spans
from townsquare.functions.segmentation import RUN, SPACED, split_runs

# A word: a run of letters of a script without blanks; or other letters, digits,
# marks and underscores, joined by an inner apostrophe or period.
# Most letters are plain ones, which are told by a table; the ranges of the others are
# asked for signs beyond those alone. No run gives back a letter, which changes no word.
_PLAIN = string.ascii_letters + string.digits + "_"
_BEYOND = r"(?=[^\x00-\x7F])"
_LETTERS = rf"(?:[{_PLAIN}]++(?:{_BEYOND}{SPACED}++)?+|{_BEYOND}{SPACED}++)"
WORD = rf"{_LETTERS}(?:['’.]{_LETTERS})*+|(?=[\u0E00-\x{{3FFFF}}]){RUN}"
# Words for topic models: an optional hash sign, then letters, digits, _ . ' -
# The hyphen stands last: before the apostrophe it would be an invalid range.
TOPIC_WORD = r"#?[\p{L}\p{N}_.'-]+"
# Plain text whose entities are unknown: links, tags and names are whole words.
ENTITY_OR_WORD = r"https?://\S+|[#@]\w+|" + WORD

_NONE = "array<string>"


def words(text: Column, pattern: str = WORD, whole_runs: bool = False) -> Column:
    """The words of a text. ``whole_runs`` leaves runs of scripts without blanks for a word list to split."""
    found = _found(text, pattern)
    return found if whole_runs else split_runs(found, text)


def _found(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """``a_b`` for each pair of neighbours."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), n - 1),
        F.slice(tokens, F.lit(2), n - 1),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast(_NONE))


def fold_case(tokens: Column) -> Column:
    """Lower-cased tokens; links keep their case."""
    return F.transform(tokens, lambda t: F.when(t.startswith("http"), t).otherwise(F.lower(t)))


def entity_spans(entities: Column) -> Column:
    """A tweet's entities as (start, find, emit), in order of their start.

    ``find`` is the text looked for in the tweet, ``emit`` the token put out.
    """
    span = "array<struct<start:int,find:string,emit:string>>"

    def spans(name: str, find, emit) -> Column:
        items = F.transform(
            entities[name],
            lambda e: F.struct(
                F.get(e["indices"], F.lit(0)).alias("start"),
                find(e).alias("find"),
                emit(e).alias("emit"),
            ),
        )
        return F.coalesce(items, F.array().cast(span)).cast(span)

    def tagged(sign: str, key: str):
        return lambda e: F.concat(F.lit(sign), e[key])

    def plain(key: str):
        return lambda e: e[key]

    everything = F.concat(
        spans("hashtags", tagged("#", "text"), tagged("#", "text")),
        spans("media", plain("url"), plain("url")),
        spans("urls", plain("url"), plain("expanded_url")),
        spans("user_mentions", tagged("@", "screen_name"), tagged("@", "screen_name")),
        spans("symbols", plain("text"), plain("text")),
    )
    usable = F.filter(everything, lambda e: (F.length(e["find"]) > 0) & e["emit"].isNotNull())
    return F.sort_array(F.array_distinct(usable))


def entity_tokens(text: Column, entities: Column, whole_runs: bool = False) -> Column:
    """Tokens of a tweet: its entities whole, the text between them in words.

    Each entity is looked for behind the previous one; one that is not there
    is passed over.
    """
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(_NONE).alias("tokens"))

    def take(done: Column, entity: Column) -> Column:
        at = F.position(entity["find"], text, done["upto"] + 1)
        before = F.substr(text, done["upto"] + 1, at - 1 - done["upto"])
        found = F.struct(
            (at - 1 + F.length(entity["find"])).alias("upto"),
            F.concat(done["tokens"], _found(before), F.array(entity["emit"])).alias("tokens"),
        )
        return F.when(at > 0, found).otherwise(done)

    def rest(done: Column) -> Column:
        return F.concat(done["tokens"], _found(F.substr(text, done["upto"] + 1)))

    found = F.aggregate(entity_spans(entities), start, take, rest)
    return found if whole_runs else split_runs(found, text)


def link_and_word_tokens(text: Column, whole_runs: bool = False) -> Column:
    """Tokens of forum text: links whole, the rest in words, case kept."""
    tokens = _found(text, f"(?:{LINK_IN_TEXT[4:]})|{WORD}")
    found = F.when(text.rlike(LINK_START), F.flatten(F.transform(tokens, _links_and_words))).otherwise(tokens)
    return found if whole_runs else split_runs(found, text)


def _links_and_words(token: Column) -> Column:
    """A word as it is; of a run that begins with a link, its links and the words between them."""

    def parts(spans: Column) -> Column:
        def part(span: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)
            return F.concat(_found(F.substr(token, before + 1, span["start"] - before)), F.array(link_at(token, span)))

        rest = _found(F.substr(token, F.element_at(spans, -1)["stop"] + 1))
        return F.concat(F.flatten(F.transform(spans, part)), rest)

    link = token.rlike(r"(?i)^(?:https?://|www\.)")
    return F.when(link, let(link_spans(token), parts)).otherwise(F.array(token))


def topic_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-cased topic words without stopwords (compared case-blind)."""
    tokens = _found(F.lower(text), TOPIC_WORD)
    if not stopwords:
        return tokens
    drop = sorted({w.lower() for w in stopwords})
    return F.filter(tokens, lambda t: ~t.isin(drop))


# A character reference, the text between two of them, or a lone ampersand.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_PARTS = REFERENCE + r"|[^&]+|&"
_NAMES, _VALUES = map(list, zip(*sorted(html5.items()), strict=True))
_SHORT = max(len(name) for name in _NAMES if not name.endswith(";"))  # names that need no semicolon
# What the numbers 128 to 159 stand for on the web.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def decode_entities(text: Column) -> Column:
    """HTML character references decoded, by the rules of the HTML standard."""
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))

    def decoded(part: Column) -> Column:
        number = part.startswith("&#") & (F.length(part) > 2)
        known = F.when(part == "&amp;", "&").when(part == "&lt;", "<").when(part == "&gt;", ">")
        known = known.when(part == "&quot;", '"').when(part == "&#039;", "'")
        return F.when(~part.startswith("&") | (part == "&"), part).otherwise(
            F.coalesce(known, F.when(number, let(_code(part), _character)).otherwise(_named(part)))
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def _code(reference: Column) -> Column:
    """The number of a reference; one beyond all characters if it is too large."""
    digits = F.concat(F.lit("0"), F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*)", 1))
    base = F.when(reference.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))
    return F.when(F.length(digits) > 9, F.lit(0x110000).cast("bigint")).otherwise(base.cast("bigint"))


def _character(code: Column) -> Column:
    low = F.pmod(code, F.lit(0x10000))
    silent = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    )
    utf32 = F.unhex(F.lpad(F.hex(F.when(code.between(0, 0x10FFFF), code).otherwise(F.lit(0xFFFD))), 8, "0"))
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(128, 159), F.substring(F.lit(_WINDOWS), (code - 127).cast("int"), F.lit(1)))
        .when(silent, "")
        .otherwise(F.decode(utf32, "UTF-32"))
    )


def _named(reference: Column) -> Column:
    """A named reference, or the longest beginning that is one without a semicolon."""
    names = F.map_from_arrays(F.lit(_NAMES), F.lit(_VALUES))
    name = F.substring(reference, 2, 40)
    found = [F.try_element_at(names, name)]
    for n in range(_SHORT, 1, -1):
        rest = F.substring(name, n + 1, 40)
        found.append(F.when(F.length(name) > n, F.concat(F.try_element_at(names, F.substring(name, 1, n)), rest)))
    return F.coalesce(*found, reference)


# Markup is read from left to right, a token at a time: an element whose content
# is no markup, a comment, a declaration, a tag with its quoted attributes, the
# text up to the next token. What lacks its end lasts to the end of the text.
# Comments and tags vanish; script, style and block tags part words.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_HIDDEN = rf"<(script|style)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\z)|\z)|\z)"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_DECLARATION = r"<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\z)"
_TAG = rf"</?[A-Za-z]{_ATTRIBUTES}(?:>|\z)"
MARKUP = rf"(?is){_HIDDEN}|{_COMMENT}|{_DECLARATION}|{_TAG}|[^<]++|<"
PARTS_WORDS = (
    r"(?i)^(?:<!doctype|</?(?:address|article|aside|audio|blockquote|body|br|canvas|caption|center|col|colgroup"
    r"|dd|del|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html"
    r"|ins|li|link|main|menu|meta|nav|noscript|ol|p|pre|script|section|style|table|tbody|td|template|tfoot|th"
    r"|thead|title|tr|ul|video)(?![^\s/>]))"
)


def strip_tags(markup: Column) -> Column:
    tokens = F.regexp_extract_all(markup, F.lit(MARKUP), F.lit(0))

    def shown(token: Column) -> Column:
        tag = token.startswith("<") & (F.length(token) > 1)
        return F.when(~tag, token).when(token.rlike(PARTS_WORDS), " ").otherwise("")

    return F.when(F.contains(markup, F.lit("<")), F.array_join(F.transform(tokens, shown), "")).otherwise(markup)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def plain_text(markup: Column) -> Column:
    """What a reader sees of HTML: no tags, references decoded, runs of white
    space as one blank."""
    return squeeze(decode_entities(strip_tags(markup)))


def submission_text(title: Column, is_self: Column, selftext: Column) -> Column:
    """Title, and behind a comma the body of a self post."""
    return F.when(is_self, F.concat(title, F.lit(","), selftext)).otherwise(title)


def unescape_tweet(text: Column) -> Column:
    """Tweets escape three characters only."""
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return text
