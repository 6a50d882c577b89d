"""Links and the registered domain of a URL, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country codes below which three labels name a site.
THREE_LABEL_COUNTRIES = [
    "ar", "at", "au", "br", "de", "es", "fr", "il", "jp",
    "kr", "nz", "ru", "tr", "ua", "uk", "us", "za",
]

# Scheme and user-info are skipped; port, path, query and fragment end the host.
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)"
# Labels of letters, digits and inner hyphens, ending in a top-level label.
VALID_HOST = (
    r"^(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+"
    r"(?:\p{L}{2,63}|xn--[a-z0-9-]{1,59})$"
)
LINK_START = r"(?i)\b(?:https?://|www\.)"
# The first letter is told before the boundary in front of it, which takes longer.
LINK_IN_TEXT = r"(?i)(?=[hw])" + LINK_START[4:] + r'[^\s<>"]+'
# Signs that end no link: punctuation, and brackets that are opened but hold nothing.
TRAILING_PUNCTUATION = r"[.,;:!?'(\[{]+$"
_BRACKET_OR_REST = r"[()\[\]{}]|[^()\[\]{}]+"
_PAIRS = {"round": "()", "square": "[]", "curly": "{}"}
# A beginning in which no bracket stands within others, and each has its partner; and a run that is such a beginning,
# or one ended by a bracket behind which no other link begins.
_PLAIN = r"^(?:[^()\[\]{}]++|\([^()\[\]{}]*+\)|\[[^()\[\]{}]*+\]|\{[^()\[\]{}]*+\})*+"
_PLAIN_RUN = r"(?is)" + _PLAIN + r"(?:\z|[)\]}](?!.*(?:https?://|www\.)))"


def registered_domain(url: Column, top_level: Sequence[str] | None = None) -> Column:
    """Lower-cased site of a URL: the last two labels of its host, or the last
    three below the listed country codes; null when that is no valid host.

    ``top_level`` optionally restricts the last label to a given list.
    """
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))

    def site(labels: Column) -> Column:
        three = F.element_at(labels, -1).isin(THREE_LABEL_COUNTRIES)
        kept = F.least(F.size(labels), F.when(three, 3).otherwise(2))
        return F.array_join(F.slice(labels, -kept, kept), ".")

    def checked(name: Column) -> Column:
        valid = name.rlike(VALID_HOST)
        if top_level is not None:
            valid = valid & F.substring_index(name, ".", -1).isin([t.lower() for t in top_level])
        return F.when(valid, name)

    return let(let(F.split(host, r"\."), site), checked)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def domains(urls: Column) -> Column:
    """The registered domains of an array of URLs, where there are any."""
    return F.filter(F.transform(urls, lambda u: registered_domain(u)), lambda d: d.isNotNull())


def clean_url(url: Column) -> Column:
    """``url`` without one trailing slash."""
    return F.regexp_replace(url, "/$", "")


def expanded_urls(entities_urls: Column) -> Column:
    """Expanded forms of a tweet's URL entities that have a display URL."""
    shown = F.filter(entities_urls, lambda u: F.length(u["url"]) > 0)
    return F.transform(shown, lambda u: u["expanded_url"])


def cited_urls(raw: Column) -> Column:
    """Distinct cleaned URLs of a tweet's JSON line, of what it retweets or
    quotes, of what those quote, and so on to the last of them.

    The line is parsed once, without a schema. Level by level the cited tweets
    take the place of those that cite them; a line has no more levels than
    names of such fields.
    """
    none = F.array().cast("array<string>")
    name = F.lit('_status"')
    levels = F.floor((F.length(raw) - F.length(F.replace(raw, name, F.lit("")))) / F.length(name)).cast("int")
    shown = "array<struct<url:string,expanded_url:string>>"

    def next_level(now: Column, _: Column) -> Column:
        urls = F.flatten(
            F.transform(
                now["statuses"],
                lambda s: F.coalesce(expanded_urls(F.try_variant_get(s, "$.entities.urls", shown)), none),
            )
        )
        cited = F.flatten(
            F.transform(
                now["statuses"],
                lambda s: F.array(*[F.try_variant_get(s, f"$.{name}", "variant") for name in ("retweeted_status", "quoted_status")]),
            )
        )
        there = F.filter(cited, lambda s: s.isNotNull() & ~F.is_variant_null(s))
        return F.struct(there.alias("statuses"), F.concat(now["urls"], urls).alias("urls"))

    def cleaned(end: Column) -> Column:
        present = F.filter(end["urls"], lambda u: u.isNotNull())
        return F.array_distinct(F.transform(present, clean_url))

    start = F.struct(F.array(F.try_parse_json(raw)).alias("statuses"), none.alias("urls"))
    return F.aggregate(F.sequence(F.lit(0), levels), start, next_level, cleaned)


def all_urls(tweet: Column, citations: int = 2) -> Column:
    """Distinct cleaned URLs of a tweet, of what it retweets and of what it
    quotes, ``citations`` levels deep, as they were read."""
    none = F.array().cast("array<string>")

    def urls(status: Column) -> Column:
        return F.coalesce(expanded_urls(status["entities"]["urls"]), none)

    parts = [urls(tweet)]
    for name in ("retweeted_status", "quoted_status"):
        status = tweet
        for level in range(citations):
            status = status[name if level == 0 else "quoted_status"]
            parts.append(urls(status))
    present = F.filter(F.concat(*parts), lambda u: u.isNotNull())
    return F.array_distinct(F.transform(present, clean_url))


def links_in_text(text: Column) -> Column:
    """Links found in free text, sentence punctuation cut off, ``www.`` links
    given a scheme. A closing bracket belongs to a link that holds its partner
    and ends any other."""
    runs = F.regexp_extract_all(text, F.lit(LINK_IN_TEXT), F.lit(0))
    found = F.flatten(F.transform(runs, lambda run: F.transform(link_spans(run), lambda span: link_at(run, span))))
    return F.transform(F.filter(found, _holds_more), _with_scheme)


def link_spans(run: Column) -> Column:
    """The links in a run of signs without blanks that begins with one, as
    (start, stop) from 0 on.

    The run is read from left to right, a bracket or what lies between two of
    them at a time, with the number of open brackets of each kind. The bracket
    that closes none ends the link; behind it another one may begin.
    """
    spans = "array<struct<start:int,stop:int>>"
    state = F.struct(
        F.lit(0).alias("at"), F.lit(-1).alias("start"), *[F.lit(0).alias(kind) for kind in _PAIRS],
        F.array().cast(spans).alias("spans"),
    )

    def read(now: Column, piece: Column) -> Column:
        within = now["start"] >= 0
        ends = F.lit(False)
        for kind, (_, closing) in _PAIRS.items():
            ends = ends | (within & (piece == closing) & (now[kind] == 0))
        first = F.regexp_instr(piece, F.lit(LINK_START))
        start = F.when(ends, -1).when(within, now["start"]).when(first > 0, now["at"] + first - 1).otherwise(-1)
        depths = [
            F.when(ends | ~within, 0)
            .otherwise(now[kind] + (piece == opening).cast("int") - (piece == closing).cast("int")).alias(kind)
            for kind, (opening, closing) in _PAIRS.items()
        ]
        done = F.array(F.struct(now["start"].alias("start"), now["at"].alias("stop")))
        return F.struct(
            (now["at"] + F.length(piece)).alias("at"), start.cast("int").alias("start"), *depths,
            F.when(ends, F.concat(now["spans"], done)).otherwise(now["spans"]).alias("spans"),
        )

    def whole(end: Column) -> Column:
        last = F.array(F.struct(end["start"].alias("start"), end["at"].alias("stop")))
        return F.when(end["start"] >= 0, F.concat(end["spans"], last)).otherwise(end["spans"])

    pieces = F.regexp_extract_all(run, F.lit(_BRACKET_OR_REST), F.lit(0))

    def one(stop: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("start"), stop.alias("stop"))).cast(spans)

    return (
        F.when(~run.rlike(r"[)\]}]"), one(F.length(run)))
        .when(run.rlike(_PLAIN_RUN), one(F.length(F.regexp_extract(run, _PLAIN, 0))))
        .otherwise(F.aggregate(pieces, state, read, whole))
    )


def link_at(run: Column, span: Column) -> Column:
    """The link in a span, without the punctuation behind it."""
    return F.regexp_replace(F.substr(run, span["start"] + 1, span["stop"] - span["start"]), TRAILING_PUNCTUATION, "")


def _holds_more(link: Column) -> Column:
    return link.rlike(LINK_START + ".")


def _with_scheme(link: Column) -> Column:
    return F.when(link.rlike("(?i)^http"), link).otherwise(F.concat(F.lit("http://"), link))
