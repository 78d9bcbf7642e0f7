"""Collocations against a plain count, with every way of splitting the work forced, and odd input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sentryspark.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, rank string, phrase string, n string"


def plain(docs, max_words, min_count, subsumed, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    rows = {}
    for (lang, w), a in cand.items():
        longer = [v for (other, x), v in cand.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * v >= subsumed * a for v in longer):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        rows.setdefault(lang, []).append((score, a, " ".join(w), l, r))
    out = []
    for lang, found in rows.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k, p, a, l, r, n[lang], score) for k, (score, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def found(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "A", "été", "x y", "zz", "q'q", "\u0001"] + [f"w{k}" for k in range(12)]
    text = lambda: "".join(rng.choices(words, [2 ** (8 - min(k, 8)) for k in range(len(words))])[0] + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(rng.randrange(60)))
    docs = [(text(), rng.choice(["en", "en", "de", None])) for _ in range(60)]
    return docs + [(None, "en"), ("", "fr"), ("...", None)] + [("the the the the the of", "en")] * 5


@pytest.mark.parametrize(("ranked", "part", "mined"), [(1 << 17, 1 << 20, 1 << 22), (3, 1 << 20, 1 << 22), (0, 40, 1 << 22), (6, 25, 7), (1 << 17, 1, 3)])
def test_equals_plain(spark, ranked, part, mined):
    docs = corpus(ranked + part)
    frame = spark.createDataFrame([(k, t, lang, "a", "b", "c") for k, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)
    got = C.collocations(frame, max_words=4, min_count=3, top=40, ranked=ranked, part_windows=part, mined_windows=mined)
    assert found(got) == plain(docs, 4, 3, 80, 40)


def test_two_words_and_ties(spark):
    docs = [("a b, a b, c d, c d, e f, e f", "xx")] * 3
    frame = spark.createDataFrame([(1, t, lang, "", "", "") for t, lang in docs], SCHEMA)
    assert found(C.collocations(frame, max_words=2, min_count=2, top=2)) == plain(docs, 2, 2, 80, 2)


def test_empty_and_rare(spark):
    assert found(C.collocations(spark.createDataFrame([], SCHEMA))) == []
    assert found(C.collocations(spark.createDataFrame([(1, "one two", "en", "", "", "")], SCHEMA))) == []


def test_long_text(spark):
    docs = [("to be or not " * 40_000, "en")]
    frame = spark.createDataFrame([(1, docs[0][0], "en", "", "", "")], SCHEMA)
    assert found(C.collocations(frame)) == plain(docs, 4, 30, 80, 2000)


def test_windows_own_each_gram_once():
    rng = random.Random(1)
    codes = np.array([rng.choice([0, 1, 1, 2, 3, 3, 4]) for _ in range(3000)], np.int64)
    expected = Counter(tuple(codes[i : i + k].tolist()) for k in (2, 3, 4) for i in range(len(codes) - k + 1) if codes[i : i + k].all())
    columns = C.windows_of(codes, 3)
    got = Counter()
    for grams, sums, _ in C.mined([np.ones(len(columns[0]), np.int64), *columns], np.zeros(len(columns[0]), bool), 3, 1):
        for row, n in zip(np.stack(grams, axis=1).tolist(), sums.tolist(), strict=True):
            got[tuple(row)] += n
    assert got == expected


def test_piece_ends_are_no_words_to_a_full_filter():
    full = np.full(C.FILTER_BITS // 64, 0xFFFFFFFFFFFFFFFF, np.uint64)
    codes = C._Codes("en", {b"a": 1}, 0, full)
    assert [codes[x] for x in C.tokens_of("a. a\nb")][1::2] == [0, 0] and codes[b"b"] >= C.HASHED
