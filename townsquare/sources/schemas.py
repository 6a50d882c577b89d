"""Record schemas. The field names and types of each platform."""

from __future__ import annotations

from collections.abc import Collection, Mapping

_ENTITIES = """struct<
  hashtags: array<struct<text: string, indices: array<int>>>,
  urls: array<struct<url: string, expanded_url: string, indices: array<int>>>,
  user_mentions: array<struct<id: bigint, screen_name: string, indices: array<int>>>,
  media: array<struct<url: string, indices: array<int>>>,
  symbols: array<struct<text: string, indices: array<int>>>>"""

_STATUS = {
    "id": "bigint", "text": "string", "created_at": "string", "lang": "string",
    "user": "struct<id: bigint, screen_name: string>", "entities": _ENTITIES,
}

SUBMISSION = {
    "author": "string", "created": "bigint", "created_utc": "bigint", "domain": "string", "downs": "bigint",
    "ups": "bigint", "id": "string", "is_self": "boolean", "num_comments": "bigint", "permalink": "string",
    "score": "bigint", "selftext": "string", "subreddit": "string", "subreddit_id": "string", "thumbnail": "string",
    "title": "string", "url": "string",
}
SUBMISSION_REQUIRED = [
    "author", "domain", "id", "is_self", "num_comments", "permalink", "score",
    "selftext", "thumbnail", "title", "url",
]

COMMENT = {
    "author": "string", "body": "string", "controversiality": "bigint", "created": "bigint", "created_utc": "bigint",
    "distinguished": "string", "gilded": "bigint", "id": "string", "link_id": "string", "parent_id": "string",
    "retrieved_on": "bigint", "score": "bigint", "subreddit": "string", "subreddit_id": "string",
}
COMMENT_REQUIRED = [
    "author", "body", "controversiality", "gilded", "id", "link_id",
    "parent_id", "retrieved_on", "score",
]

POST = {
    "no": "bigint", "com": "string", "now": "string", "name": "string", "time": "bigint",
    "resto": "bigint", "country": "string", "country_name": "string",
}
POST_REQUIRED = list(POST)


def struct(fields: Mapping[str, str], names: Collection[str] | None = None) -> str:
    """The fields, or those of them that are named, as a struct type."""
    return "struct<" + ", ".join(f"{k}: {t}" for k, t in fields.items() if names is None or k in names) + ">"


def tweet(citations: int = 2) -> dict[str, str]:
    """A tweet's fields. What it retweets or quotes is read, and what those
    quote, and so on: ``citations`` levels."""
    cited = struct(_STATUS)
    for _ in range(citations - 1):
        cited = struct({**_STATUS, "quoted_status": cited})
    return {**_STATUS, "retweeted_status": cited, "quoted_status": cited} if citations else dict(_STATUS)
