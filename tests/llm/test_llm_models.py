"""Quality, languages, language model, licenses and leaks."""

import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from helpers import documents, frame, prose

from townsquare.llm import decontamination, langid, licenses, ngrams, quality
from townsquare.llm.common import Numbers, pieces, ragged, sums


def crc(doc_id, n):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % n


def clashing(docs, *names):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("mine").alias(n) for n in names])


# --- helpers ------------------------------------------------------------------


def test_ragged_sums_and_numbers():
    flat, sizes = ragged([[1, 2], [], [3]])
    assert flat.tolist() == [1, 2, 3] and sums(flat.astype(float), sizes).tolist() == [3, 0, 3]
    assert sums(np.zeros((0, 2)), np.zeros(0, int)).shape == (0, 2)
    numbers = Numbers()
    assert [numbers[w] for w in "abac"] == [0, 1, 0, 2] and numbers.take() == ["a", "b", "c"] and numbers.take() == []


def test_pieces():
    import pandas as pd

    batch = pd.DataFrame({"text": [b"x" * n for n in (4, 4, 20, 1, 0)]})
    assert [list(map(len, p["text"])) for p in pieces(batch, most=8)] == [[4, 4], [20], [1, 0]]


# --- quality ------------------------------------------------------------------


def labelled(n=240):
    rng, rows = random.Random(2), []
    for i in range(n):
        text = prose(rng)
        rows.append((i, text if i % 3 else " ".join(w + "$$$" for w in text.split()), "en", "s", 0))
    return rows


def test_quality_separates_held_out_rows(spark):
    rows = labelled()
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows], "doc_id bigint, quality int, toxic int")
    got = quality.quality_digest(frame(spark, rows + documents()[40:]), labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows + documents()[40:])
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    seen = [(r["score"], r["doc_id"] % 3 > 0) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 60]
    assert min(s for s, good in seen if good) > max(s for s, good in seen if not good)


def test_quality_never_learns_from_held_out_labels(spark):
    rows = labelled(120)
    docs = frame(spark, rows)
    labels = [(r[0], int(r[0] % 3 > 0), 0) for r in rows]
    turned = [(i, 1 - q if crc(i, 4) == 2 else q, t) for i, q, t in labels]
    scores = []
    for some in (labels, turned):
        table = spark.createDataFrame(some, "doc_id bigint, quality int, toxic int")
        scores.append({r["doc_id"]: r["score"] for r in quality.quality_digest(docs, table).collect()})
    assert scores[0] == scores[1]


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.quality_digest(frame(spark, documents()), none).collect()} == {0.5}
    assert quality.quality_digest(frame(spark, []), none).count() == 0
    nulls = spark.createDataFrame([(1, None, 0), (1, 1, 0), (1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_digest(frame(spark, documents()), nulls).count() == len(documents())


def test_scores_equal_the_average_of_the_bag(spark):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=(64, 2)).astype(np.float32), np.array([0.1, -0.2]))
    rows = documents()
    got = quality.scores(clashing(frame(spark, rows), "row", "scored", "score"), model).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        buckets = [b for w in quality.tokens(texts[r["doc_id"]]) for b in quality.word_buckets(w, 64)]
        out = model.logits[buckets].astype(float).mean(axis=0) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + math.exp(out[0] - out[1])), abs=1e-9)
        assert r["row"] == "mine"


def test_long_words_count_whole():
    rng = random.Random(17)
    for size in [*range(1, 140), 191, 192, 193, 5000]:
        word = bytes(rng.choice(b"abcdefgh") for _ in range(size))
        marked = b"<" + word + b">"
        want = Counter(zlib.crc32(marked[i : i + n], n) % 997 for n in (3, 4) for i in range(len(marked) - n + 1))
        made = [t for t in quality.tokens(word) if not t.startswith(b"size")]
        whole = zlib.crc32(word if size <= 64 else b"long %d" % zlib.crc32(word)) % 997
        assert Counter(b for t in made for b in quality.word_buckets(t, 997)) == want + Counter([whole])
        assert all(len(t) <= 80 for t in made)
    bags = quality._Bags(64, np.random.default_rng(3).normal(size=(64, 2)))
    line = b"x" * 200 + b"good" * 50
    assert not np.allclose(*bags.averages([line, b"x" * 200 + b"evil" * 50]))
    assert quality._Bags(64).bag(line)[1].sum() == 2 * len(line) + 1 + 1 + 1 - 2


# --- languages ----------------------------------------------------------------


@pytest.mark.parametrize("chain", [1, 3, 64])
def test_long_texts_are_one_chain(monkeypatch, chain):
    """A word's distribution is that of the whole text, wherever the chains are cut."""
    monkeypatch.setattr(langid, "CHAIN", chain)
    rng = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], rng.normal(size=((1 << 8) + 9, 3)).astype(np.float32) / 3, rng.normal(size=(3, 3)) + 2 * np.eye(3), {})
    texts = [[f"w{rng.integers(30)}" for _ in range(n)] for n in (200, 1, 0, 64, 65, 7, 131)]
    got, sizes = langid.Tagger(model).marginals(texts)
    at = 0
    for words, size in zip(texts, sizes, strict=True):
        if size:
            ids = [langid.features(w, 1 << 8, {}) for w in words]
            emitted = np.array([model.weights[i].sum(axis=0) for i in ids], float)[None]
            want = langid.forward_backward(emitted, np.array([size]), model.moves)[0][0]
            assert np.allclose(got[at : at + size], want, atol=1e-6)
        at += size


def test_letters_are_letters():
    import unicodedata

    for c in map(chr, range(0x20000)):
        assert bool(langid.LETTERS.fullmatch(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))
    assert langid.words_of("½ ² ① Ⅷ 3 _ one2two") == ["one", "two"]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    emitted, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    marginals, pairs = langid.forward_backward(emitted, lengths, moves)
    wanted, wanted_pairs = np.zeros_like(marginals), np.zeros((3, 3))
    for chain, n in enumerate(lengths):
        paths = list(product(range(3), repeat=n))
        weight = np.array(
            [math.exp(sum(emitted[chain, t, p[t]] for t in range(n)) + sum(moves[p[t - 1], p[t]] for t in range(1, n))) for p in paths]
        )
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t in range(n):
                wanted[chain, t, p[t]] += w
                if t:
                    wanted_pairs[p[t - 1], p[t]] += w
    assert np.allclose(marginals, wanted) and np.allclose(pairs, wanted_pairs)


def test_languages_of_held_out_rows(spark):
    rows = documents(160)
    got = langid.language_digest(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    truth = {r[0]: r[2] for r in rows[:160]}
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in truth:
            assert r["lang_pred"] == truth[r["doc_id"]]
    named = {r["doc_id"]: r for r in got}
    for i in (160, 161, 162, 164):
        assert (named[i]["lang_pred"], named[i]["score"]) == ("und", 0.0)


def test_switched_words_are_labelled_by_language(spark):
    rows = documents(160)
    model = langid.train(frame(spark, rows))
    rng = random.Random(8)
    first, second = prose(rng, "en", 20), prose(rng, "de", 20)
    words = langid.LETTERS.findall(f"{first} {second}".lower())
    cut = len(langid.LETTERS.findall(first.lower()))
    out, sizes = langid.Tagger(model).marginals([words, [], ["morning"]])
    assert sizes.tolist() == [len(words), 0, 1] and np.allclose(out.sum(axis=1), 1)
    best = [model.labels[i] for i in out[: len(words)].argmax(axis=1)]
    assert Counter(best[: cut - 2]) == {"en": cut - 2} and Counter(best[cut + 2 :]) == {"de": len(words) - cut - 2}


def test_long_runs_of_letters_count_whole():
    rng = random.Random(18)
    for size in [*range(1, 200), 2000]:
        run = "".join(rng.choice("abcdefgh") for _ in range(size))
        pieces_ = langid.words_of(run)
        assert all(len(p) <= 50 for p in pieces_) and (size > 48 or pieces_ == [run])
        got = Counter(f for p in pieces_ for f in langid.features(p, 1 << 30, {}))
        assert got == Counter(langid.features(run, 1 << 30, {}))


def test_languages_without_blanks():
    rng = random.Random(19)
    shared, own = "一二三四五六七八", {"ja": "のはをにが", "zh": "的是了在不"}

    def line(lang, n=150):
        return "".join(rng.choice(shared + own[lang]) for _ in range(n))

    taught = [(y, langid.words_of(line(lang))) for y, lang in enumerate(sorted(own)) for _ in range(40)]
    tagger = langid.Tagger(langid._descend(sorted(own), taught, 1 << 12, 100, 3, 0.5, 7))
    common = "".join(rng.choice(shared) for _ in range(60))
    for y, lang in enumerate(sorted(own)):
        shares, sizes = tagger.shares([common + line(lang, 2000)])
        assert shares[0].argmax() == y and shares[0][y] > 0.9 and sizes[0] > 40


def test_languages_without_training_rows(spark):
    model = langid.train(frame(spark, []))
    got = langid.languages(clashing(frame(spark, documents()), "row", "tagged", "score"), model)
    assert {r["lang_pred"] for r in got.collect()} == {"und"} and got.columns.count("score") == 1
    assert langid.language_digest(frame(spark, [])).count() == 0


def test_held_out_languages_are_not_learned(spark):
    rows = documents(60)
    turned = [(i, t, "xx" if crc(i, 5) == 0 else lang, s, n) for i, t, lang, s, n in rows]
    scores = [sorted(map(tuple, langid.language_digest(frame(spark, r)).collect()), key=str) for r in (rows, turned)]
    assert scores[0] == scores[1]


# --- language model -----------------------------------------------------------


def brute_base(rows):
    tokens = [(i, ((t or "").encode().lower().split()) + [b" end"]) for i, t, *_ in rows]
    counts = Counter(w for i, ws in tokens if crc(i, 10) for w in ws)
    n, v = counts.total(), len(counts)
    return sorted(
        (
            (str(i), crc(i, 10) == 0, len(ws), sum(counts[w] > 0 for w in ws), n,
             round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
            for i, ws in tokens
        ),
    )


@pytest.mark.parametrize("order", [1, 2, 3])
def test_base_scores(spark, order):
    rows = documents(60)
    got = ngrams.ngram_scores(clashing(frame(spark, rows), "chunk", "part", "score"), order=order, chunk_bytes=4000).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:5], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    for r in got:
        assert -math.inf < r["score"] <= 0


def brute_model(rows, chunk_of, order):
    """Scores of rows (id, text) by dictionaries of n-grams, a token at a time."""

    def grams(words):
        """Per token its n-grams of rising order; before the first word stands a mark."""
        out = []
        for i in range(len(words)):
            out.append([tuple(words[max(0, i - k) : i + 1]) if k <= i else ("^", *words[: i + 1]) for k in range(order)])
        return out

    docs = []
    for (doc_id, text), chunk in zip(rows, chunk_of, strict=True):
        docs.append((crc(doc_id, 10) == 0, chunk % ngrams.DELETED == 0, grams([*(text or "").lower().split(), "$"])))

    def counted(chosen):
        counts = Counter(g for tokens in chosen for token in tokens for k, g in enumerate(token) for g in [(k, g)])
        n = sum(c for (k, _), c in counts.items() if k == 0)
        return counts, n, sum(k == 0 for k, _ in counts), len(chosen)

    def estimates(token, before, counts, n, n_types, n_docs):
        values, bucket = [1 / (n_types + 1), counts[0, token[0]] / max(n, 1)], 0
        for k in range(1, order):
            context = counts[k - 1, before[k - 1]] if before else n_docs
            values.append(counts[k, token[k]] / max(context, 1))
            bucket = bucket * 64 + (int(math.log2(context)) + 1 if context else 0)
        return values, bucket, [True, n > 0] + [bool(counts[k - 1, before[k - 1]] if before else n_docs) for k in range(1, order)]

    every, n, types, n_docs = counted([t for held, _, t in docs if not held])
    main, main_n, _, main_docs = counted([t for held, gone, t in docs if not held and not gone])
    cells = Counter()
    for tokens in (t for held, gone, t in docs if gone and not held):
        for i, token in enumerate(tokens):
            values, bucket, _ = estimates(token, tokens[i - 1] if i else None, main, main_n, types, main_docs)
            ratios = tuple(
                round(min(400, max(-400, math.log2(v / values[0]) * ngrams.STEPS))) if v > 0 else -1000 for v in values[1:]
            )
            cells[bucket, ratios] += 1
    weights = ngrams.learn_weights([(b, list(r), c) for (b, r), c in cells.items()], order)
    out = []
    for _, _, tokens in docs:
        score = 0.0
        for i, token in enumerate(tokens):
            values, bucket, usable = estimates(token, tokens[i - 1] if i else None, every, n, types, n_docs)
            average = np.mean(list(weights.values()), axis=0) if weights else np.full(order + 1, 1 / (order + 1))
            share = weights.get(bucket, average) * np.array(usable)
            score += math.log10(float(share @ values) / float(share.sum()))
        out.append(score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_dictionaries(spark, order):
    from pyspark.sql import functions as F

    rows = [(r[0], r[1]) for r in documents(50)] + [(None, f"river {i % 7} stones {i % 3} river") for i in range(60)]
    docs = frame(spark, rows, "doc_id bigint, text string")
    size = sum(len((t or "").encode()) for _, t in rows)
    chunks = max(2 * ngrams.DELETED, -(-size // 4000))
    placed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(chunks)).alias("c")).collect()
    assert len({r["c"] for r in placed if r["doc_id"] is None}) > 5
    got = ngrams.ngram_scores(docs, order=order, chunk_bytes=4000).collect()
    want = brute_model([(r["doc_id"], r["text"]) for r in placed], [r["c"] for r in placed], order)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], w) for r, w in zip(placed, want, strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-9, atol=1e-6)


def test_model_beats_the_base_and_does_not_depend_on_layout(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(prose(rng, "en", 12) for _ in range(3)), "en", "s", 0) for i in range(200)]
    runs = [
        {r["doc_id"]: r for r in ngrams.ngram_scores(frame(spark, rows, parts=p), order=2, chunk_bytes=3000).collect()} for p in (1, 5)
    ]
    assert all(runs[0][i]["score"] == pytest.approx(runs[1][i]["score"], abs=1e-9) for i in runs[0])
    held = [r for r in runs[0].values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_interpolated_estimates():
    """Bigram by hand: two documents `a b` and `a c`, scored text `a b`."""
    import pandas as pd

    chunk = ngrams.Chunk(pd.Series([b"a b"]), 2)
    counts = [np.array([2, 1, 2]), np.array([2, 1, 1])]  # a, b, end; start a, a b, b end
    values, bucket = ngrams.estimates(chunk, counts, tokens=6, types=4, documents=2)
    assert values.tolist() == [[0.2, 2 / 6, 1.0], [0.2, 1 / 6, 0.5], [0.2, 2 / 6, 1.0]]
    assert bucket.tolist() == [2, 2, 1]


def test_weights_by_expectation_maximisation():
    # Half of the tokens follow the bigram for certain, the other half are new.
    weights = ngrams.learn_weights([(3, [0, 40], 50), (3, [0, -1000], 50)], 2)[3]
    assert weights.sum() == pytest.approx(1) and weights[2] == pytest.approx(0.5, abs=0.01)
    assert ngrams.learn_weights([], 2) == {}


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 1 << 40, (1 << 64) - 1], np.uint64)
    assert ngrams.unpack(ngrams.pack(values)).tolist() == values.tolist()
    assert len(ngrams.unpack(ngrams.pack(values[:0]))) == 0


def test_language_model_of_nothing(spark):
    assert ngrams.ngram_scores(frame(spark, [])).count() == 0
    held = [(i, "a b", "en", "s", 0) for i in range(60) if crc(i, 10) == 0]
    got = ngrams.ngram_scores(frame(spark, held)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got} == {(0, 0, 0.0, 0.0)}


# --- licenses -----------------------------------------------------------------


def test_templates_are_found_whole_and_edited(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 40:
            words[20] = "edited"
        rows.append((i, f"{prose(rng)}\n{' '.join(words).upper()}\n{prose(rng)}", "en", "s", 0))
        want[i] = name
    got = {}
    for r in licenses.license_rows(frame(spark, rows + documents()[:0])).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(want[i] in got[i] for i in want)


def test_license_containment_is_exact():
    text = "This is free and unencumbered software released into the public domain."
    matcher = licenses.Matcher((("U", text),))
    words = licenses.WORDS.findall(text.lower())
    assert matcher.search([["x"] * 7 + words + ["y"]]) == [[("U", 7, 7 + len(words), 1.0)]]
    assert matcher.search([words[1:]])[0][0][3] == pytest.approx(6 / 7)
    assert matcher.search([words[:4] + ["z"] + words[4:]]) == [[]]  # 3 of 7 shingles are left
    assert matcher.search([[], ["a"], words * 2])[2] == [("U", 0, 11, 1.0), ("U", 11, 22, 1.0)]


def test_repeated_long_notices_are_all_found():
    rng = random.Random(21)
    words = [f"t{i}" for i in range(60)]
    matcher = licenses.Matcher((("N", " ".join(words)),))
    for gap in (0, 1, 5, 9, 13, 40):
        text, want = ["x"] * 7, []
        for _ in range(4):
            want.append(("N", len(text), len(text) + 60, 1.0))
            text += words + ["y"] * gap
        assert matcher.search([text]) == [want]
    for _ in range(50):  # edited copies, one directly behind the other
        text = []
        for _ in range(3):
            copy = words.copy()
            copy[rng.randrange(5, 55)] = "edited"
            text += copy
        found = matcher.search([text])[0]
        assert [hit[1:3] for hit in found] == [(0, 60), (60, 120), (120, 180)] and all(hit[3] >= 0.9 for hit in found)


def test_licenses_of_odd_rows(spark):
    docs = clashing(frame(spark, documents()), "row", "found", "licenses")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(documents()) and all(r["licenses"] == [] for r in got)
    assert licenses.license_rows(frame(spark, [])).count() == 0


# --- leaks --------------------------------------------------------------------


def items(rng, n=30):
    return [(i, prose(rng, "en", 30) if i % 2 else f"{prose(rng, 'en', 24)} What is it? It is the {prose(rng, 'en', 6)}") for i in range(n)]


def brute_scores(tests, passage):
    """BM25 of all items over their own scores."""
    bags = [Counter(decontamination.words(t)) for _, t in tests]
    mean = sum(b.total() for b in bags) / len(bags)
    df = Counter(w for b in bags for w in b)

    def score(bag, terms):
        return sum(
            math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * bag.total() / mean))
            for w, f in bag.items() if w in terms
        )

    return [score(b, set(passage)) / score(b, set(b)) for b in bags]


def test_wand_finds_all_items_above_the_threshold():
    rng = random.Random(9)
    tests = items(rng, 150)
    df = Counter(w for _, t in tests for w in set(decontamination.words(t)))
    mean = sum(len(decontamination.words(t)) for _, t in tests) / len(tests)
    index = decontamination.Index([(str(i), t) for i, t in tests], df, len(tests), mean)
    for _ in range(60):
        words = decontamination.words(rng.choice(tests)[1])
        passage = rng.sample(words, len(words) * rng.randrange(4, 9) // 10) + decontamination.words(prose(rng))
        terms = sorted({index.terms[w] for w in passage if w in index.terms})
        want = {i: s for i, s in enumerate(brute_scores(tests, passage)) if s >= 0.5}
        assert index.above(terms, 0, len(tests)) == pytest.approx(want)


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(10)
    tests = items(rng)
    other = random.Random(11)
    rows, want = documents(20), set()
    for i, text in tests:
        rows.append((100 + i, f"{prose(other, 'de', 90)}\n{text}\n{prose(other, 'de', 400)}", "en", "s", 0))
        want.add((100 + i, i))
    rows.append((300, " ".join(text for _, text in tests), "en", "s", 0))
    want |= {(300, i) for i, _ in tests}
    table = spark.createDataFrame([*tests, (900, None), (901, ""), (902, "...")], "item_id bigint, text string")
    got = decontamination.leak_pairs(frame(spark, rows), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in got)


def test_question_and_answer():
    split = decontamination.question_and_answer
    assert split("What is it? A stone.") == (["what", "is", "it"], ["a", "stone"])
    assert split("First part. Then more. The end.") == (["first", "part", "then", "more"], ["the", "end"])
    assert split("one two three four") == (["one", "two", "three"], ["four"])
    assert split("") == ([], [])
    assert decontamination.leaked(0.8, 0) and decontamination.leaked(0.5, 0.5) and not decontamination.leaked(0.7, 0.4)


def built(tests):
    """An index of all items."""
    df = Counter(w for _, t in tests for w in set(decontamination.words(t)))
    mean = sum(len(decontamination.words(t)) for _, t in tests) / len(tests)
    return decontamination.Index([(str(i), t) for i, t in tests], df, len(tests), mean)


def test_items_with_one_changed_word_or_a_cut_end_are_leaks():
    rng = random.Random(13)
    own = [f"w{i}" for i in range(400)]
    tests = [(i, f"{' '.join(rng.sample(own, 9))}? {' '.join(rng.sample(own, 25))}") for i in range(20)]
    index = built(tests)
    for i, text in tests:
        words = decontamination.words(text)
        copies = [[*words[:at], "changed", *words[at + 1 :]] for at in range(len(words))]
        copies += [words[len(words) // 10 :], words[: -(len(words) // 10)]]
        found = index.search([["before"] * 30 + copy + ["behind"] * 30 for copy in copies])
        assert all(str(i) in {hit[0] for hit in hits} for hits in found)
    assert index.search([rng.sample(own, 60)]) == [[]]


def test_questions_without_their_long_answers_are_retrieved():
    rng = random.Random(14)
    own = [f"w{i}" for i in range(300)]
    tests = [(i, f"{' '.join(rng.sample(own, 10))}? {' '.join(rng.sample(own, 40))}") for i in range(20)]
    index = built(tests)
    for i, text in tests:
        question = decontamination.words(text[: text.index("?")])
        (hits,) = index.search([["before"] * 30 + question + ["behind"] * 30])
        assert [(hit[0], hit[3], hit[4]) for hit in hits] == [(str(i), 1, 0)] and hits[0][2] < 0.5


def test_a_word_or_two_are_no_leak():
    tests = [(0, "Oninhe. " + " ".join(f"w{i}" for i in range(30))), (1, " ".join(f"v{i}" for i in range(30)))]
    index = built(tests)
    assert index.search([["a"] * 20 + ["oninhe"] + ["b"] * 20]) == [[]]
    assert [hit[0] for hit in index.search([decontamination.words(tests[0][1])])[0]] == ["0"]


def test_all_that_counts_as_a_leak_is_retrieved():
    rng = random.Random(15)
    common = [f"c{i}" for i in range(12)]
    tests = []
    for i in range(60):
        text = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(500)}" for _ in range(rng.randrange(3, 50))]
        at = rng.randrange(1, len(text))
        tests.append((i, f"{' '.join(text[:at])}? {' '.join(text[at:])}"))
    index = built(tests)
    seen = 0
    for _ in range(1500):
        words = decontamination.words(rng.choice(tests)[1])
        a, b = sorted(rng.sample(range(len(words) + 1), 2))
        passage = words[a:b]
        if rng.random() < 0.5:
            passage[rng.randrange(len(passage))] = "changed"
        runs = decontamination.grams(passage)
        shares = brute_scores(tests, passage)
        long = [len(decontamination.question_and_answer(t)[0]) >= 5 for _, t in tests]
        want = {
            str(i) for i, _ in tests
            if decontamination.leaked(*index.verify(i, runs, passage), long[i] or shares[i] >= 0.5 - 1e-9)
        }
        (hits,) = index.search([passage])
        assert [hit[2] for hit in hits] == pytest.approx([shares[int(hit[0])] for hit in hits])
        assert {hit[0] for hit in hits} == want
        seen += sum(hit[2] < 0.5 for hit in hits)
    assert seen > 5  # leaks with less than half of the item's own score


def test_items_longer_than_any_passage_were(spark):
    rng = random.Random(16)

    def long(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    tests = [(i, f"{long(n)}? {long(m)}") for i, (n, m) in enumerate([(30, 10), (4000, 1000), (3900, 4100), (20, 8100), (2000, 1)])]
    rows = [(i, f"{prose(rng, 'en', 2500)} {text} {prose(rng, 'de', 1500)}", "en", "s", 0) for i, text in tests]
    table = spark.createDataFrame(tests, "item_id bigint, text string")
    assert [index.step for index in decontamination.indexes(table)] == [40, 2001, 8000, 8120]
    got = decontamination.leak_pairs(frame(spark, rows), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i, _ in tests}
    assert all(r["question_overlap"] == 1 and r["answer_overlap"] == 1 for r in got)


def test_leaks_with_several_indexes_and_without_items(spark, monkeypatch):
    rng = random.Random(12)
    tests = items(rng, 9)
    docs = frame(spark, [(i, text, "en", "s", 0) for i, text in tests] + documents()[40:])
    table = spark.createDataFrame(tests, "item_id bigint, text string")
    whole = sorted(map(tuple, decontamination.leak_pairs(docs, table).collect()))
    assert {r[:2] for r in whole} == {(i, i) for i, _ in tests}
    monkeypatch.setattr(decontamination, "ITEMS_AT_MOST", 4)
    assert sorted(map(tuple, decontamination.leak_pairs(docs, table).collect())) == whole
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.leak_pairs(docs, none).count() == 0
    assert decontamination.leak_pairs(frame(spark, []), table).count() == 0
    got = decontamination.find_leaks(clashing(docs, "row", "found0", "leaks"), table)
    assert got.count() == docs.count() and got.columns.count("leaks") == 1
