"""Small records of each platform."""


def tweet(id, text="hello", user=1, name="Ann", at="Wed Jan 03 10:20:30 +0000 2024", lang="en", **more):
    entities = {k: more.pop(k) for k in ("hashtags", "urls", "user_mentions", "media", "symbols") if k in more}
    return {
        "id": id, "text": text, "created_at": at, "lang": lang,
        "user": {"id": user, "screen_name": name}, "entities": entities, **more,
    }


def url(expanded, short="https://t.co/x", at=0):
    return {"url": short, "expanded_url": expanded, "indices": [at, at + len(short)]}


def mention(id, name, at=0):
    return {"id": id, "screen_name": name, "indices": [at, at + len(name) + 1]}


def submission(id, author="Bob", title="A title", **more):
    record = {
        "id": id, "author": author, "title": title, "selftext": "", "is_self": False,
        "url": "https://www.example.org/a", "domain": "example.org", "permalink": "/r/x", "thumbnail": "",
        "num_comments": 3, "score": 5, "created_utc": 1704276000, "subreddit": "x", "subreddit_id": "t5_1",
    }
    return {**record, **more}


def comment(id, author="Cat", body="well", **more):
    record = {
        "id": id, "author": author, "body": body, "parent_id": "t3_1", "link_id": "t3_1", "score": 1,
        "gilded": 0, "controversiality": 0, "retrieved_on": 1704276001, "created_utc": 1704279600,
        "subreddit": "x", "subreddit_id": "t5_1",
    }
    return {**record, **more}


def post(no, com="text", time=1704276000, resto=0, name="Anonymous", **more):
    record = {"no": no, "com": com, "time": time, "resto": resto, "name": name, "now": "01/03/24",
              "country": "US", "country_name": "United States"}
    return {**record, **more}


THREAD = {
    "posts": [
        post(100, "It&#039;s a fine day.", ext=".jpg", replies=2),
        post(101, '<a href="#p100" class="quotelink">&gt;&gt;100</a><br>so they say', 1704276060, 100),
        post(102, '<span class="quote">&gt;a fine day</span><br><br>is it?', 1704276120, 100),
        post(103, "yes &amp; no", 1704276180, 100),
    ]
}
