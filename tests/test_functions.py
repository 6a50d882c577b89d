import pytest
from pyspark.sql import functions as F
from records import mention, tweet, url

from townsquare.functions import links, segmentation, text, time
from townsquare.operators import search, tokens
from townsquare.sources import posts


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "address, site",
    [
        ("https://news.bbc.co.uk/1/hi", "bbc.co.uk"),
        ("http://www.nytimes.com", "nytimes.com"),
        ("http://www.spiegel.de/x", "www.spiegel.de"),
        ("http://spiegel.de", "spiegel.de"),
        ("HTTP://WWW.Example.COM/", "example.com"),
        ("http://x.co.uk:80/a", "x.co.uk"),
        ("http://a.b.example.com?q=1", "example.com"),
        ("http://me:pw@a.example.com#top", "example.com"),
        ("www.example.net/a", "example.net"),
        ("example.com.", "example.com"),
        ("host.example.org:8080/x", "example.org"),
        ("http://1.2.3.4/x", None),
        ("http://localhost/x", None),
        ("http://exa mple.com", None),
        ("http://-a.com", None),
        (":", None),
        ("", None),
        (None, None),
    ],
)
def test_registered_domain(spark, address, site):
    assert one(spark, links.registered_domain, address) == site


def test_domain_with_known_top_levels(spark):
    def known(c):
        return links.registered_domain(c, top_level=["com"])

    assert one(spark, known, "http://a.example.com") == "example.com"
    assert one(spark, known, "http://a.example.nonesuch") is None


def test_links_in_text(spark):
    body = "see (http://a.org/x), www.b.co.uk/y. <https://c.de> and not example.com or notwww.x.y HTTP://D.com!"
    assert one(spark, links.links_in_text, body) == [
        "http://a.org/x", "http://www.b.co.uk/y", "https://c.de", "HTTP://D.com",
    ]


@pytest.mark.parametrize(
    "body, found",
    [
        ("https://en.wikipedia.org/wiki/Foo_(bar)", ["https://en.wikipedia.org/wiki/Foo_(bar)"]),
        ("(https://en.wikipedia.org/wiki/Foo_(bar))", ["https://en.wikipedia.org/wiki/Foo_(bar)"]),
        ("(see http://a.org/x).", ["http://a.org/x"]),
        ("[a](http://a.org/x)and[b](www.b.org/y_[1]).", ["http://a.org/x", "http://www.b.org/y_[1]"]),
        ("http://a.org/((x)(y))z)", ["http://a.org/((x)(y))z"]),
        ("{http://a.org/x}y", ["http://a.org/x"]),
        ("http://a.org/(x].", ["http://a.org/(x"]),
        ("http://a.org/(", ["http://a.org/"]),
        ("http://a.org/(x)'!", ["http://a.org/(x)"]),
        ("http://x.org/http://y.org/(z)", ["http://x.org/http://y.org/(z)"]),
        ("http://) www.] https://(", []),
        ("http://a.org/" + "(" * 3000 + "x" + ")" * 3001, ["http://a.org/" + "(" * 3000 + "x" + ")" * 3000]),
        (None, None),
    ],
)
def test_brackets_in_links(spark, body, found):
    assert one(spark, links.links_in_text, body) == found


def balanced(run):
    """Links of a run without blanks, a character at a time."""
    out, start, depth, i = [], None, {}, 0
    while i <= len(run):
        ch = run[i] if i < len(run) else ")"
        if start is None:
            if any(run.startswith(s, i) for s in ("http://", "www.")) and (i == 0 or not run[i - 1].isalnum()):
                start, depth = i, {}
        if start is not None:
            if ch in "([{":
                depth[ch] = depth.get(ch, 0) + 1
            elif ch in ")]}":
                opening = "([{"[")]}".index(ch)]
                if i == len(run) or not depth.get(opening):
                    out.append(run[start:i].rstrip(".,;:!?'([{"))
                    start = None
                else:
                    depth[opening] -= 1
        i += 1
    return [u if u.startswith("http") else f"http://{u}" for u in out if u not in ("http:/", "http://", "www", "www.")]


def test_links_like_a_scan_of_characters(spark):
    import random

    rng = random.Random(11)
    bits = ["http://", "www.", "a", "/x", "(", ")", "[", "]", "{", "}", ".", ",", "-", "!"]
    runs = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    table = spark.createDataFrame([(r,) for r in runs], "t string")
    for r in table.select("t", links.links_in_text(F.col("t")).alias("u")).collect():
        assert [u for u in r.u if u != "http:/"] == balanced(r.t), r.t


def test_clean_url_takes_one_slash(spark):
    assert one(spark, links.clean_url, "http://a.org//") == "http://a.org/"


@pytest.mark.parametrize(
    "given, want",
    [
        ("It's a.b, naïve_café! 3.5 ’tis", ["It's", "a.b", "naïve_café", "3.5", "tis"]),
        ("", []),
        ("… — !", []),
        ("हिन्दी शब्द", ["हिन्दी", "शब्द"]),
    ],
)
def test_words(spark, given, want):
    assert one(spark, text.words, given) == want


def test_bigrams(spark):
    assert one(spark, lambda c: text.bigrams(text.words(c)), "a b c") == ["a_b", "b_c"]
    assert one(spark, lambda c: text.bigrams(text.words(c)), "a") == []
    assert one(spark, lambda c: text.bigrams(text.words(c)), "") == []


def test_tweet_tokens_keep_entities_whole(lines):
    body = "Hey @Ann and @Bob: see https://t.co/x #Big-ish $TWTR pic https://t.co/m end"
    at = body.index
    made = tweet(
        7, body,
        hashtags=[{"text": "Big", "indices": [at("#Big"), 0]}],
        user_mentions=[mention(2, "Bob", at("@Bob")), mention(1, "Ann", at("@Ann")), mention(3, "Gone", 90)],
        urls=[url("HTTP://Example.org/Long", at=at("https://t.co/x")), url(None, "https://t.co/none")],
        media=[{"url": "https://t.co/m", "indices": [at("https://t.co/m"), 0]}],
        symbols=[{"text": "TWTR", "indices": [at("$TWTR"), 0]}],
    )
    tweets = posts.tweets(lines(made))
    got = [r.token for r in tokens.tweet_tokens(tweets).orderBy("pos").collect()]
    assert got == [
        "Hey", "@Ann", "and", "@Bob", "see", "HTTP://Example.org/Long", "#Big", "ish", "TWTR", "pic",
        "https://t.co/m", "end",
    ]
    folded = tokens.tweet_tokens(tweets, preserve_case=False, make_bigrams=True).orderBy("pos").collect()
    assert [r.token for r in folded][:3] == ["hey", "@ann", "and"]
    assert [r.token for r in folded][12:15] == ["hey_@ann", "@ann_and", "and_@bob"]
    assert len(folded) == 23


def test_entities_are_looked_for_behind_each_other(lines):
    """The same mention twice is two tokens; order follows the offsets."""
    made = tweet(1, "@Ann @Ann x", user_mentions=[mention(1, "Ann", 5), mention(1, "Ann", 0)])
    got = tokens.tweet_tokens(posts.tweets(lines(made, tweet(2, "no entities"))))
    assert sorted((r.doc_id, r.pos, r.token) for r in got.collect()) == [
        (1, 0, "@Ann"), (1, 1, "@Ann"), (1, 2, "x"), (2, 0, "no"), (2, 1, "entities"),
    ]


def test_reddit_tokens(spark):
    posts_ = spark.createDataFrame(
        [("a", "It&#39;s &lt;here&gt; (https://x.org/a_b?c=1), www.y.com. Bye")], "id string, text string"
    )
    got = [r.token for r in tokens.reddit_tokens(posts_).orderBy("pos").collect()]
    assert got == ["It's", "here", "https://x.org/a_b?c=1", "www.y.com", "Bye"]


def test_words_between_links_are_tokens(spark):
    text_ = "[a](http://x.org/y_(z))und so,(www.q.org) w"
    got = tokens.reddit_tokens(spark.createDataFrame([("a", text_)], "id string, text string"))
    assert [r.token for r in got.orderBy("pos").collect()] == ["a", "http://x.org/y_(z)", "und", "so", "www.q.org", "w"]


def test_topic_tokens_drop_stopwords_in_any_case(spark):
    rows = spark.createDataFrame([(1, "The #World it's a.b re-do THE end")], "id long, text string")
    got = [r.token for r in tokens.topic_tokens(rows, ["the", "END"]).orderBy("pos").collect()]
    assert got == ["#world", "it's", "a.b", "re-do"]


@pytest.mark.parametrize(
    "markup, plain",
    [
        ("I&#039;m <b>b</b>old", "I'm bold"),
        ("a<br>b<br/><br />c", "a b c"),
        ("<p>a</p><p>b</p>", "a b"),
        ("a<!-- x > y -->b", "ab"),
        ('x<script>var a = "<p>";</script>y<style>p{}</style>', "x y"),
        ("<a href='#1'>&gt;&gt;1</a>  &lt;i&gt; &amp;amp; &eacute;", ">>1 <i> &amp; é"),
        ("2 < 3 and 4 > 1", "2 < 3 and 4 > 1"),
        ("<a title=\"a>b\" href='x'>hi</a>", "hi"),
        ("<a title='<p>' x=\"<!--\">h</a>i<!-- <p> -->!", "hi!"),
        ("a<b x=y'>b<i title=\"a'b\">c", "abc"),
        ('a<script>if (a < b) "</p>"</script >b<STYLE>x</STYLE\n>c', "a b c"),
        ("a<!-- open <p> b", "a"),
        ("a<p>b<script>c</p>", "a b"),
        ("a <b", "a"),
        ("<!DOCTYPE html><p>a<?php x ?>b</p>", "ab"),
        ("</ x>a</>b", "ab"),
        ("", ""),
        (None, None),
    ],
)
def test_plain_text(spark, markup, plain):
    assert one(spark, text.plain_text, markup) == plain


def test_markup_like_the_standard_library(spark):
    import random
    from html.parser import HTMLParser

    class Shown(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], False

        def handle_starttag(self, tag, attrs):
            self.hidden = tag in ("script", "style")
            self.parts.append(" " if tag in ("p", "br", "div", "script", "style") else "")

        def handle_endtag(self, tag):
            self.hidden = False
            self.parts.append(" " if tag in ("p", "br", "div", "script", "style") else "")

        def handle_data(self, data):
            self.parts.append("" if self.hidden else data)

    rng = random.Random(5)
    bits = ["<p>", "</p>", "<br/>", "<b>", "</b>", "x", " y ", "<a href='a>b'>", '<i title="<p>">', "</a>", "<!-- <p> -->", "&lt;", "<div class=c>"]
    bits += ["<script>a<b</script>", "<style>p{}</style>", "<p\n id = 'q' >", "2 < 3", '<a b="c" d=\'e"f\' g>', "<!---->", "&amp;amp;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.plain_text(F.col("t")).alias("p")).collect():
        parser = Shown()
        parser.feed(r.t)
        parser.close()
        assert r.p == " ".join("".join(parser.parts).split()), r.t


def test_hostile_markup(spark):
    for part in ("<", "<a ", "<a b='", "<!--", "<script ", "=", "<p x="):
        assert one(spark, text.plain_text, part * 5000) is not None
    assert one(spark, text.plain_text, "<p " + "a='b' " * 5000 + ">x") == "x"


WORD_LIST = ["東京", "タワー", "に", "行く", "日本", "日本語", "語", "を", "話す", "我", "来到", "北京", "清华大学", "清华", "大学", "ฉัน", "รัก", "ภาษา", "ไทย"]


@pytest.mark.parametrize(
    "given, ruled, listed",
    [
        ("東京タワーに行く", ["東", "京", "タワー", "に", "行", "く"], ["東京", "タワー", "に", "行く"]),
        ("I saw 東京Tower!", ["I", "saw", "東", "京", "Tower"], ["I", "saw", "東京", "Tower"]),
        ("日本語を話す。我来到北京清华大学", list("日本語を話す我来到北京清华大学"), ["日本語", "を", "話す", "我", "来到", "北京", "清华大学"]),
        ("ฉันรักภาษาไทย 2 ครั้ง", ["ฉันรักภาษาไทย", "2", "ครั้ง"], ["ฉัน", "รัก", "ภาษา", "ไทย", "2", "ครั้ง"]),
        ("新東京ポケモンに", ["新", "東", "京", "ポケモン", "に"], ["新", "東京", "ポケモン", "に"]),
        ("it's 3年 don’t_x", ["it's", "3", "年", "don’t_x"], ["it's", "3", "年", "don’t_x"]),
        ("が゙𠀋", ["が゙", "𠀋"], ["が゙", "𠀋"]),
        ("", [], []),
        (None, None, None),
    ],
)
def test_words_without_blanks(spark, given, ruled, listed):
    known = segmentation.lexicon(spark.createDataFrame([(w, 1) for w in WORD_LIST], "word string, n int"))
    assert one(spark, text.words, given) == ruled
    rows = spark.createDataFrame([(given,)], "v string").select(text.words(F.col("v"), whole_runs=True).alias("t"))
    assert segmentation.with_words(rows, "t", known).first().t == listed


def test_segments_are_the_cheapest():
    import itertools
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("甲乙丙") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 5000) for _ in range(12)}
    known = segmentation.Lexicon(words, 3, 9000)
    for _ in range(300):
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
            parts = [run[a:b] for a, b in itertools.pairwise(at)]
            if all(p in words or len(p) == 1 for p in parts):
                ways.append((sum(min(words.get(p, 9000), 9000) for p in parts), len(parts)))
        got = segmentation.segment(run, known)
        assert "".join(got) == run and (sum(words.get(p, 9000) for p in got), len(got)) == min(ways)


def test_word_list(spark):
    words = spark.createDataFrame([("一", 2), ("一", 1), ("", 5), (None, 5), ("二二", 1), ("三", 0)], "word string, n int")
    known = segmentation.lexicon(words)
    assert set(known.costs) == {"一", "二二"} and known.longest == 2 and known.costs["一"] < known.costs["二二"] < known.unknown
    assert segmentation.segment("一" * 5000, known) == ["一"] * 5000
    assert segmentation.lexicon(words.limit(0)).longest == 0


def test_a_long_word_list_is_a_table(spark, monkeypatch):
    """It splits as a short one does: runs longer than what is looked up together, of several rows, in rows of one id."""
    import random

    rng = random.Random(5)
    letters, words = "甲乙丙丁กขค", {}
    for _ in range(60):
        words["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5)))] = rng.randrange(1, 90)
    table = spark.createDataFrame([*words.items(), (None, 2), ("", 3), ("丙丙丙丙", 0)], "word string, n int")
    short = segmentation.lexicon(table)
    monkeypatch.setattr(segmentation, "WORDS_AT_MOST", len(words) - 1)
    monkeypatch.setattr(segmentation, "LETTERS_AT_ONCE", 4)
    known = segmentation.lexicon(table)
    assert {r.word: r.cost for r in known.words.collect()} == short.costs and known[1:] == short[1:]
    texts = [" ".join("".join(rng.choice(letters + "戊") for _ in range(rng.randrange(1, 30))) for _ in range(4)) + " x" for _ in range(20)]
    rows = [(i % 7, t) for i, t in enumerate([*texts, *texts[:5], "plain", "", None])]
    split = spark.createDataFrame(rows, "id int, v string").select("id", text.words(F.col("v"), whole_runs=True).alias("t"))
    found = [sorted(map(str, segmentation.with_words(split, "t", k).collect())) for k in (short, known)]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_tweets_and_comments_take_a_word_list(spark, lines):
    known = segmentation.lexicon(spark.createDataFrame([(w, 1) for w in WORD_LIST], "word string, n int"))
    made = posts.tweets(lines(tweet(1, "@Ann 日本語を話す x", user_mentions=[mention(5, "Ann", 0)])))
    assert [r.token for r in tokens.tweet_tokens(made, lexicon=known).orderBy("pos").collect()] == ["@Ann", "日本語", "を", "話す", "x"]
    pairs = tokens.tweet_tokens(made, make_bigrams=True, preserve_case=False, lexicon=known).orderBy("pos").collect()
    assert [r.token for r in pairs[5:]] == ["@ann_日本語", "日本語_を", "を_話す", "話す_x"]
    near = search.cooccurring_terms(made, ["日本"], 3, tokens.tweet_token_array(whole_runs=True), lexicon=known)
    assert [r.token for r in near.collect()] == ["@ann", "@ann_日本語", "x"]
    said = spark.createDataFrame([(1, "北京(http://a.org/x)清华大学")], "id int, text string")
    assert [r.token for r in tokens.reddit_tokens(said, lexicon=known).orderBy("pos").collect()] == ["北京", "http://a.org/x", "清华大学"]


def test_date_text_round_trip(spark):
    given = "Wed Jan 3 10:20:30 +0000 2024"
    assert one(spark, lambda c: time.format_date_text(time.parse_date_text(c)), given) == given
    assert one(spark, time.parse_date_text, "Wed Jan 03 10:20:30 +0200 2024").hour == 8
    assert one(spark, time.parse_date_text, "soon") is None


def test_scale_names():
    assert [time.scale_name(s) for s in ("-m", "hourly", "Day")] == ["minute", "hour", "day"]
    with pytest.raises(ValueError):
        time.scale_name("week")


def test_references_like_the_standard(spark):
    import html
    import random

    rng = random.Random(7)
    bits = ["&", "&amp;", "&lt", "&gt;", "&notit;", "&not", "&copy", "&copyx", "&eacute;", "&NotEqualTilde;", "&#", "&#x", "&#39;", "&#039;"]
    bits += ["&#x27", "&#128;", "&#150", "&#0;", "&#13;", "&#1;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#x1F600;", "&#xFDD0;"]
    bits += ["&unknown;", "&#xZ;", "&ampamp;", " ", "x", "\n", ";", "é", "&#65533;", "&#x1FFFE;", "&fjlig;", "&hellip"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(3000)] + [f"{b}." for b in bits]
    table = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = table.select("t", text.decode_entities(F.col("t")).alias("d"))
    for r in got.collect():
        assert r.d == (html.unescape(r.t) if r.t is not None else None), r.t
    assert "Python" not in got._jdf.queryExecution().toString()
